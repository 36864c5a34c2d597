"""The utility sweep: no leak, whole texts, scores against a plain naive Bayes, published result shapes."""

import math
from collections import Counter

from pyspark.sql import functions as F

from conftest import SF01
from textloom.config import ALPHAS, LABELS
from textloom.operators import generation as gen
from textloom.operators import naive_bayes as NB
from textloom.operators import report, runs
from textloom.plans import gen_queries, model_queries


def test_no_test_document_in_any_training_set(spark):
    rest = {r.doc_id for r in gen_queries.split_ids(spark, SF01).filter("split != 'train'").collect()}
    train = model_queries.training_sets(spark, SF01).select("run_name", "doc_id").collect()
    assert len(rest) > 50 and len({r.run_name for r in train}) == 25
    assert not rest & {r.doc_id for r in train}


def test_scores_equal_a_plain_naive_bayes(spark):
    train = [("r1", "mild", "a b a"), ("r1", "severe", "b c"), ("r1", "mild", "c"), ("r2", "minimum", "x y")]
    test = [(1, "mild", "a b q"), (2, "severe", "z"), (3, "minimum", "x " * 400 + "y")]
    model = NB.fit(spark.createDataFrame(train, "run_name string, label string, text_clean string"))
    got = NB.score(model, spark.createDataFrame(test, "doc_id long, label string, text_clean string"), ["r1", "r2", "r3"])
    rows = got.collect()
    assert len(rows) == 2 * 2 * 2 * 3                  # a run without training rows has no scores

    def terms(text, pairs):
        w = text.split(" ")
        return [" ".join(x) for x in zip(w, w[1:])] if pairs else w

    for r in rows:
        pairs = r.classifier == "bigram_nb"
        own = [(lab, terms(t, pairs)) for run, lab, t in train if run == r.run_name]
        vocab = {x for _, t in own for x in t}
        words = terms(test[r.doc_id - 1][2], pairs)
        a = ALPHAS[r.epoch - 1]
        for lab, value in zip(LABELS, r.l):
            count = Counter(x for c, t in own if c == lab for x in t)
            total = sum(count.values())
            want = math.log((sum(c == lab for c, _ in own) + 1) / (len(own) + 4))
            want += sum(math.log((count[w] + a) / (total + a * (len(vocab) + 1))) for w in words)
            assert abs(value - want / max(1, len(words))) < 1e-8
        assert LABELS[r.label_id] == test[r.doc_id - 1][1]


def test_a_word_in_every_document_is_no_hot_key(spark, monkeypatch):
    """No group of the shuffled join has more than a few rows, and the scores are those of the plain join."""
    monkeypatch.setattr(NB, "FREQUENT", 20)
    train = spark.createDataFrame([("r", "mild" if i % 2 else "severe", f"the of a{i % 7} u{i}") for i in range(200)],
                                  "run_name string, label string, text_clean string")
    test = spark.createDataFrame([(i, "mild", f"the a{i % 7} u{i}") for i in range(300)], "doc_id long, label string, text_clean string")
    tf = NB.grams(test, ["doc_id"]).groupBy("doc_id", "classifier", "term").agg(F.count(F.lit(1)).alias("tf"))
    head = {(r.classifier, r.term) for r in NB.frequent_terms(tf).collect()}
    assert ("unigram_nb", "the") in head and len(head) <= 40
    rest = tf.groupBy("classifier", "term").count().collect()
    total = {c: sum(r["count"] for r in rest if r.classifier == c) for c in ("unigram_nb", "bigram_nb")}
    assert all(r["count"] <= total[r.classifier] / 20 for r in rest if (r.classifier, r.term) not in head)
    terms, _ = NB.fit(train)
    got = sorted(map(repr, NB.with_counts(tf, terms).select("doc_id", "classifier", "term", "tf", "run_name", "n").collect()))
    assert got == sorted(map(repr, tf.join(terms, ["classifier", "term"]).select("doc_id", "classifier", "term", "tf", "run_name", "n").collect()))


def test_terms_are_counted_as_they_are_exploded(spark, monkeypatch):
    """Slices of texts counted in columns: the words and pairs of ``grams``; odd texts, null keys and copies included."""
    monkeypatch.setattr(NB, "SLICE", 12)
    rows = [(1, "a b a b a"), (1, "a b a b a"), (2, ""), (3, None), (None, "x"), (4, " lead  and trail "), (5, "ä ö ä"), (6, "a" * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text_clean string")
    want = NB.grams(df, ["doc_id"]).groupBy("doc_id", "classifier", "term").agg(F.count(F.lit(1)).alias("tf"))
    got = NB.counted(df, ["doc_id"]).groupBy("doc_id", "classifier", "term").agg(F.sum("tf").alias("tf"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert NB.counted(df.limit(0), ["doc_id"]).count() == 0


def test_the_training_terms_are_dealt_once(spark):
    """The counts are dealt by term and then summed, totalled and joined there: no second exchange of them."""
    train = spark.createDataFrame([("r", "mild", "a b"), ("s", "severe", "a c")], "run_name string, label string, text_clean string")
    terms, _ = NB.fit(train)
    plan = terms._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(classifier" in plan


def test_a_term_meets_all_runs_once_a_block(spark, monkeypatch):
    """The join has a row per term and block of texts, not per posting and run; scores of odd ids and texts in any batching are a plain naive Bayes."""
    hits, written = [], NB.hand_off
    monkeypatch.setattr(NB, "hand_off", lambda df, name: hits.append(written(df, name)) or hits[-1])
    monkeypatch.setattr(NB, "SLICE", 40)
    train = [(f"r{i % 3}", ("mild", "severe", None, "odd")[i % 4], f"the a{i % 5} of u{i} the") for i in range(60)] + [("r0", "mild", None), (None, "mild", "the x"), ("r1", "mild", "")]
    test = [(i, "mild", f"the a{i % 5} of the u{i} the a{i % 5} new{i}") for i in range(40)] + [(1, "severe", "the of again"), (None, "mild", "the"), (90, "mild", None), (91, "mild", "")]
    model = NB.fit(spark.createDataFrame(train, "run_name string, label string, text_clean string").repartition(3))
    rows = spark.createDataFrame(test, "doc_id long, label string, text_clean string")

    def scores():
        return sorted((r.run_name, r.classifier, r.epoch, str(r.doc_id), r.label_id, tuple(r.l)) for r in NB.score(model, rows, ["r0", "r1", "r2"]).collect())

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        small = scores()
        asked = hits[-1].where("block is not null and classifier = 'unigram_nb'")
        seen = {w for run, _, t in train if run and t is not None for w in t.split(" ")}
        assert asked.count() == len({w for i, _, t in test if i is not None and t is not None for w in t.split(" ")} & seen)     # one block
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(NB, "BLOCK", 100)
    blocks = scores()
    assert hits[-1].where("block is not null").select("block").distinct().count() > 4
    assert len(small) == len(test) * 3 * 2 * 2 and [r[:5] for r in blocks] == [r[:5] for r in small]
    bad = [(a, b) for a, b in zip(small, blocks) if any(abs(x - y) > 2e-9 for x, y in zip(a[5], b[5]))]
    assert not bad, bad[:5]

    def terms(text, pairs):
        w = text.split(" ")
        return [" ".join(x) for x in zip(w, w[1:])] if pairs else w

    for run, kind, epoch, doc, _, got in small:
        pairs, a = kind == "bigram_nb", ALPHAS[epoch - 1]
        own = [(lab, t) for r, lab, t in train if r == run]
        count = [Counter(x for lab, t in own if lab == c and t is not None for x in terms(t, pairs)) for c in LABELS]
        vocab = {x for _, t in own if t is not None for x in terms(t, pairs)}
        words = [x for i, _, t in test if doc != "None" and str(i) == doc and t is not None for x in terms(t, pairs)]
        for c, n, value in zip(LABELS, count, got):
            want = math.log((sum(lab == c for lab, _ in own) + 1) / (len(own) + 4))
            want += sum(math.log((n[x] + a) / (sum(n.values()) + a * (len(vocab) + 1))) for x in words)
            assert abs(value - want / max(1, len(words))) < 1e-8


def test_the_bundle_is_computed_once(spark, monkeypatch):
    """Queries that read the bundle twice (baseline and runs, documents at the root and below) read a written table."""
    rows = [(s, "baseline", c, e, i % 4, [0.1 * ((i * 7 + j + e) % 5) for j in range(4)])
            for s in ("val", "test") for c in ("unigram_nb", "bigram_nb") for e in (1, 2) for i in range(12)]
    scored = spark.createDataFrame(rows, "split string, run_name string, classifier string, epoch int, label_id int, l array<double>")
    monkeypatch.setattr(model_queries, "scored", lambda *a: scored)
    got = model_queries.bundle(spark, SF01)
    assert got.count() == 2 and "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_fifth_label_is_scored(spark):
    train = spark.createDataFrame([("r", x, f"{x} word") for x in ("mild", "extreme", "severe", "minimum", "moderate")],
                                  "run_name string, label string, text_clean string")
    labels = NB.labels_of(gen.label_map(train))
    assert labels == ["extreme", "mild", "minimum", "moderate", "severe"]
    test = spark.createDataFrame([(1, "extreme", "extreme word"), (2, "mild", "mild")], "doc_id long, label string, text_clean string")
    got = NB.score(NB.fit(train, labels), test, ["r"], labels=labels).where("classifier = 'unigram_nb' and epoch = 1").collect()
    assert {r.doc_id: (r.label_id, r.l.index(max(r.l))) for r in got} == {1: (0, 0), 2: (1, 1)}


def test_many_labels_are_ranked_in_ranges(spark):
    train = spark.range(50_000).selectExpr("concat('label', id % 20011) as label")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = gen.label_map(train).orderBy("label_id").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = sorted(f"label{i}" for i in range(20011))
    assert [r.label for r in got] == want and [r.label_id for r in got] == list(range(20011))


PUBLISHED_SUMMARY = [   # fixed values: dataset, total rows, sample, complete, incomplete, personal data
    ("Falcon Few-Shot", "37,633", 500, "499/500 (99.8%)", 1, "0/500 (0.0%)"),
    ("Falcon Zero-Shot", "39,286", 500, "432/500 (86.4%)", 68, "0/500 (0.0%)"),
    ("LLaMA Few-Shot", "39,752", 500, "252/500 (50.4%)", 248, "1/500 (0.2%)"),
    ("LLaMA Zero-Shot", "40,000", 500, "493/500 (98.6%)", 7, "0/500 (0.0%)"),
]


def test_published_summary_lines_survive_parse_and_format(spark):
    cols = "dataset string, total_rows string, sample_size int, complete_sentences string, incomplete_sentences int, pii_detected string"
    parsed = report.parse_summary(spark.createDataFrame(PUBLISHED_SUMMARY, cols))
    rates = parsed.select("dataset", "total_rows", "sample_size", "complete_count", "valid_total", "completeness_rate",
                          "incomplete_count", "pii_count", "pii_valid_total", "pii_rate")
    back = report.summary_table(rates).drop("dataset_name").collect()
    assert sorted(map(tuple, back)) == sorted(PUBLISHED_SUMMARY)


# fixed values: the two published runs on real data (loss, precision, recall, F1, AUC, runtime, samples/s, steps/s, epoch)
PUBLISHED_RUNS = {
    "unigram_nb": (0.620881, 0.680479, 0.693512, 0.680773, 0.917185, 0.8619, 4111.973, 16.244, 2.0),
    "bigram_nb": (0.586195, 0.699996, 0.713979, 0.696867, 0.923866, 1.2711, 2788.1, 11.014, 2.0),
}


def test_result_documents_have_the_nine_published_entries(spark):
    rows = [("baseline", c, *v[:5], v[5], 3544, 14, int(v[8])) for c, v in PUBLISHED_RUNS.items()]
    b = spark.createDataFrame(rows, "run_name string, classifier string, loss double, macro_precision double, "
                              "macro_recall double, macro_f1 double, macro_roc_auc_ovr double, seconds double, "
                              "n_rows long, steps long, epoch int")
    long = runs.results_long(runs.results_maps(b.withColumnRenamed("seconds", "runtime"), F.col("runtime")))
    wide = {r.classifier: r for r in runs.results_wide(long).collect()}
    assert tuple(runs.METRICS) == ("loss", "macro_precision", "macro_recall", "macro_f1", "macro_roc_auc_ovr", "runtime",
                                   "samples_per_second", "steps_per_second", "epoch")
    for c, v in PUBLISHED_RUNS.items():
        assert all(abs(wide[c][m] - x) <= abs(x) * 1e-3 for m, x in zip(runs.METRICS, v))
        keys = {r.key for r in long.filter(F.col("classifier") == c).collect()}
        assert f"{c}_baseline_samples_per_second" in keys and len(keys) == 9


def test_leaderboard_places_follow_f1(spark):
    rows = [(f"r{i}", "FS" if i % 2 else "ZS", 0.5 + i % 3 / 10, "falcon", "unigram_nb", (i * 37 % 11) / 11, 0.5) for i in range(12)]
    b = spark.createDataFrame(rows, "run_name string, mode string, temp double, generator string, classifier string, "
                              "macro_f1 double, macro_roc_auc_ovr double")
    got = sorted(runs.leaderboard(b).collect(), key=lambda r: r.place)
    assert [r.place for r in got] == list(range(1, 7))
    assert [r.macro_f1 for r in got] == sorted((r.macro_f1 for r in got), reverse=True)
