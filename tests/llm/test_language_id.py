import duckdb
import pandas as pd

from textloom.llm import language_id as L
from textloom.llm.common import read_table


def test_held_out_accuracy(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    got = L.identify(docs).toPandas().set_index("doc_id")
    want = duckdb.sql("select doc_id, lang, text from '/root/testdata/sf0.01/documents.parquet'").df().set_index("doc_id")
    both = got.join(want)
    held = both[both.held_out]
    assert 100 < len(held) < 300
    assert (held.lang_pred == held.lang).mean() > 0.97
    assert both.score.between(0, 1).all()


def test_odd_rows(make_docs, odd_rows):
    rows = odd_rows + [(100 + i, t, lang) for i in range(40) for t, lang in
                       (("the cat sat on the mat", "en"), ("der hund liegt auf der matte", "de"))]
    got = [(r.doc_id, r.lang_pred, r.score) for r in L.identify(make_docs(rows)).collect()]
    by = pd.Series({i: p for i, p, _ in got if i is not None})
    assert len(got) == len(rows)
    assert by[2] == by[3] == by[4] == by[8] == "und" and by[1] == "en"
    assert all(s == 0 for i, p, s in got if p == "und")
    kept = L.keep_identified(make_docs(rows))
    assert kept.columns == make_docs(rows).columns
    assert {r.doc_id for r in kept.collect()} >= {1, 5, 6, 7, 9, 10}
    assert kept.where("doc_id in (2, 3, 4, 8)").count() == 0


def test_nothing_to_learn_from(make_docs):
    docs = make_docs([(1, "abc", None), (2, "def", None)])
    assert {(r.lang_pred, r.score) for r in L.identify(docs).collect()} == {("und", 0.0)}
    assert L.identify(docs.limit(0)).count() == 0
    assert L.keep_identified(docs.limit(0)).count() == 0


def test_pipeline_stage_drops_unlearned_and_keeps_all_without_a_model(spark, make_docs):
    import random

    import corpus_pipeline as P
    rng = random.Random(1)
    rows = [(i, " ".join("".join(rng.choice(own) for _ in range(3)) for _ in range(30)), own)
            for i in range(160) for own in [("abc", "def", "ghi", "jkl")[i % 4]]]
    rows += [(1000, "\u043f\u0440\u0438\u0432\u0435\u0442", None), (1001, "123", None)]
    kept = {r.doc_id for r in P.language_id(spark, make_docs(rows), "").collect()}
    assert kept == set(range(160))
    unlabelled = [(i, t, None) for i, t, _ in rows]
    kept = {r.doc_id for r in P.language_id(spark, make_docs(unlabelled), "").collect()}
    assert kept == {*range(160), 1000}


def test_one_text_scores_alone_as_in_a_batch():
    langs, matrix, prior = ["a", "b"], L.np.log(L.np.random.default_rng(1).dirichlet([1, 1], 1 << L.BITS)), L.np.log([.5, .5])
    texts = ["abc def", "", "zzz", "x" * 3000, "déjà vu"]
    together = L.score_texts(texts, langs, matrix.astype("float32"), prior)
    for i, t in enumerate(texts):
        alone = L.score_texts([t], langs, matrix.astype("float32"), prior)
        assert alone[0][0] == together[0][i] and abs(alone[1][0] - together[1][i]) < 1e-5


def test_counts_and_choice_equal_a_plain_naive_bayes(spark):
    """Over the whole table: n-grams as strings, each hashed by itself, and the plain product of probabilities."""
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    (langs, matrix, prior), = L.fit(docs)

    def bucket(gram):
        h = 0
        for c in gram:
            h = (h * 0x01000193 + ord(c)) & 0xFFFFFFFF
        h = ((h ^ (len(gram) * 0x9E3779B1 & 0xFFFFFFFF)) * 0x85EBCA6B) & 0xFFFFFFFF
        return (((h ^ (h >> 15)) * 0xC2B2AE35) & 0xFFFFFFFF) >> (32 - L.BITS)

    def grams(text):
        t = "".join(c if c.isalpha() else " " for c in text.lower()) + "  "
        for i in range(len(t) - 2):
            for n in L.SIZES:
                g = t[i:i + n]
                if len(g) == n and (g[0] != " " if n == 1 else g[0] != " " or g[1] != " "):
                    yield bucket(g)

    import zlib
    count = {lang: L.np.full(1 << L.BITS, L.SMOOTHING) for lang in langs}
    seen = dict.fromkeys(langs, 0)
    for i, text, lang in rows:
        if text is not None and lang is not None and zlib.crc32(str(i).encode()) % 5:
            seen[lang] += 1
            for b in grams(text):
                count[lang][b] += 1
    for k, lang in enumerate(langs):
        assert L.np.allclose(matrix[:, k], L.np.log(count[lang] / count[lang].sum()), atol=1e-5)
        assert abs(prior[k] - L.np.log(seen[lang] / sum(seen.values()))) < 1e-12
    got = {r.doc_id: r.lang_pred for r in L.identify(docs).collect()}
    for i, text, _ in rows:
        if text and any(c.isalpha() for c in text):
            own = list(grams(text))
            total = [p + sum(float(L.np.log(count[x][b] / count[x].sum())) for b in own) for x, p in zip(langs, prior)]
            order = sorted(total)
            assert got[i] == langs[total.index(order[-1])] or order[-1] - order[-2] < 1e-2


def test_more_languages_than_one_matrix_holds(spark, make_docs, monkeypatch):
    """Every language can be predicted, and the number of languages at once changes nothing."""
    rows = [(i, " ".join([f"{chr(97 + k)}{chr(98 + k)}{chr(99 + k)}"] * 5), f"l{k}") for k in range(9) for i in range(k * 50, k * 50 + 40)]
    docs = make_docs([*rows, (9000, None, "l1"), (9001, "77", "l2")])
    whole = sorted((r.doc_id, r.lang_pred, round(r.score, 5)) for r in L.identify(docs).collect())
    monkeypatch.setattr(L, "LANGS_AT_ONCE", 2)
    assert len(L.fit(docs)) == 5
    parts = sorted((r.doc_id, r.lang_pred, round(r.score, 5)) for r in L.identify(docs).collect())
    assert parts == whole and {p for _, p, _ in whole} == {"und", *(f"l{k}" for k in range(9))}
    assert all(p == f"l{i // 50}" for i, p, _ in whole if i < 450)
    assert {r.doc_id for r in L.keep_identified(docs, 0.1).collect()} == {i for i, *_ in rows}
