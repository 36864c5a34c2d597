import hashlib
import random

import numpy as np

from textloom.llm import suffix_dedup as S
from textloom.llm.common import read_table


def brute(rows, length=50):
    """Every 50-byte string's smallest document, then the marked bytes of each text."""
    least = {}
    raws = [(t or "").encode() for _, t in rows]
    keys = [S.NO_ID if d is None else d for d, _ in rows]
    for k, raw in zip(keys, raws):
        for i in range(len(raw) - length + 1):
            s = raw[i:i + length]
            least[s] = min(k, least.get(s, k))
    out = []
    for (d, _), k, raw in zip(rows, keys, raws):
        mark = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            if least[raw[i:i + length]] < k:
                mark[i:i + length] = True
        spans = int((mark[1:] & ~mark[:-1]).sum() + mark[0])
        kept = bytes(b for b, m in zip(raw, mark) if not m)
        out.append((d, len(raw), int(mark.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(map(repr, out))


def result(df):
    return sorted(repr((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in df.collect())


def test_whole_table(spark, scratch):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    assert result(S.remove_repeats(docs, scratch(), keep_text=False)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_planted_passages(make_docs, scratch):
    """Passages of 45 to 200 bytes in many documents, copies, periodic texts, cuts at every offset, three bytes a character."""
    rng = random.Random(9)
    passages = ["".join(rng.choice("abcdef ") for _ in range(rng.randrange(45, 200))) for _ in range(12)]
    passages += ["ab" * 60, "x" * 130, "語" * 40, "Und " * 30]
    rows = []
    for i in range(300):
        text = "".join(rng.choice([
            "".join(rng.choice("ghijk ") for _ in range(rng.randrange(60))),
            (p := rng.choice(passages))[rng.randrange(3):len(p) - rng.randrange(3)]]) for _ in range(rng.randrange(6)))
        rows.append((rng.randrange(1000), text))
    rows += [(5000 + i, rows[i][1]) for i in range(20)] + [rows[0]] * 3 + [(None, rows[1][1] + "tail"), (None, None)]
    rows += [(-3, passages[0] * 2), (10 ** 15, passages[1])]
    assert result(S.remove_repeats(make_docs(rows), scratch(), keep_text=False)) == brute(rows)


def test_odd_rows(make_docs, odd_rows, scratch):
    docs = make_docs(odd_rows)
    assert result(S.remove_repeats(docs, scratch())) == brute([r[:2] for r in odd_rows])
    assert S.remove_repeats(docs.limit(0), scratch()).count() == 0
    kept = {r.doc_id: r.kept for r in S.remove_repeats(docs, scratch()).collect()}
    assert kept[9] == "" and kept[1] == odd_rows[0][1]


def test_very_long_text(make_docs, scratch):
    rng = random.Random(4)
    body = "".join(rng.choices("abcdefghij klmnop", k=5_000_000))
    rows = [(1, body), (2, "q" * 30 + body[4_194_290:4_194_400] + "q" * 30), (3, body[2_097_100:2_097_200])]
    got = {r.doc_id: r for r in S.remove_repeats(make_docs(rows), scratch(), keep_text=False).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == 110 and got[2].n_spans == 1 and got[3].n_removed == 100


def test_groups_as_spark_has_them(spark):
    ids = [0, 1, -1, 255, 10 ** 18, S.NO_ID, -(2 ** 63)]
    got = spark.createDataFrame([(i,) for i in ids], "k long").selectExpr("pmod(xxhash64(k), 77L) g").collect()
    assert [r.g for r in got] == S.id_groups(np.array(ids, np.int64), 77).tolist()


def test_column_wise_masks():
    """Against direct comparison of all windows, with pieces of different lengths and anchor places."""
    rng = np.random.default_rng(8)
    n, texts, left = 200, [], []
    core = rng.integers(97, 99, (4, S.COLUMNS)).astype(np.uint8)
    symbols = np.zeros((S.COLUMNS, n), np.uint16)
    for i in range(n):
        before, windows = int(rng.integers(0, S.SPAN)), 0
        windows = int(rng.integers(1, before + 2))
        own = core[rng.integers(4)].copy()
        if rng.random() < 0.5:
            own[rng.integers(S.COLUMNS)] = 120
        a = S.SPAN - 1 - before
        symbols[a:a + windows + 49, i] = own[a:a + windows + 49].astype(np.uint16) + 1
        texts.append((a, windows, own))
        left.append(a)
    doc = rng.integers(0, 40, n)
    mask = S.column_wise(symbols, np.array(left), np.array([w for _, w, _ in texts]), doc)
    least = {}
    for (a, w, own), d in zip(texts, doc):
        for o in range(w):
            key = (a + o, own[a + o:a + o + 50].tobytes())
            least[key] = min(d, least.get(key, d))
    for i, (a, w, own) in enumerate(texts):
        want = sum(1 << o for o in range(w) if least[a + o, own[a + o:a + o + 50].tobytes()] < doc[i])
        assert int(mask[i]) == want


def test_mask_runs():
    rng = np.random.default_rng(1)
    masks = np.concatenate([rng.integers(0, 1 << 35, 300), [0, 1, (1 << 35) - 1, 1 << 34, 5]]).astype(np.uint64)
    got = sorted(zip(*(x.tolist() for x in S.mask_runs(masks))))
    want = []
    for i, m in enumerate(masks.tolist()):
        bits = f"0{m:b}0"[::-1]
        starts = [k - 1 for k in range(1, len(bits)) if bits[k] == "1" and bits[k - 1] == "0"]
        stops = [k - 2 for k in range(1, len(bits)) if bits[k] == "0" and bits[k - 1] == "1"]
        want += [(i, a, b) for a, b in zip(starts, stops)]
    assert got == sorted(want)


def test_a_passage_in_a_third_of_all_documents_fills_no_bucket(spark, make_docs):
    """Rows that only pass on an answer are spread by document: no bucket is far above the others."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghij ") for _ in range(300))
    passage = "".join(rnd.choice("klmnopqrst ") for _ in range(400))
    docs = make_docs([(i, word() + (passage if i % 3 == 0 else word())) for i in range(3000)], extra=False, parts=4)
    rows = docs.select(S.F.col("doc_id").alias("k"), "text")
    none = spark.sparkContext.broadcast(S.np.zeros(1 << 22, S.np.uint8))
    sent = rows.mapInArrow(S.send_anchors(64, none), "bucket int, told boolean, home array<int>, code array<int>, doc array<long>")
    per = sorted(r.n for r in sent.groupBy("bucket").agg(S.F.sum(S.F.size("code")).alias("n")).collect())
    assert len(per) == 64 and per[-1] < 5 * per[32]
    told = sorted(r.n for r in sent.where("told").groupBy("bucket").agg(S.F.sum(S.F.size("code")).alias("n")).collect())
    assert sum(told) > 10_000 and told[-1] < 5 * told[len(told) // 2]
