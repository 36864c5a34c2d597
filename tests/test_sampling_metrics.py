"""Properties of the seeded sampling operators and of the metrics (brute-force checks)."""

import math
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from textloom.config import Config
from textloom.functions.text import seeded_hash
from textloom.operators import metrics as M
from textloom.operators import sampling


def _rows(n, labels, seed=1):
    rnd = random.Random(seed)
    return [(i, rnd.choice(labels), f"text {i}") for i in range(n)]


def test_seeded_rank_equals_row_number(spark):
    df = spark.createDataFrame(_rows(3000, ["a", "b", "c"]), "doc_id long, label string, text string")
    r = sampling.seeded_rank(df, ["label"], "doc_id", 7, "rn", digits=2)
    w = Window.partitionBy("label").orderBy(seeded_hash(7, F.col("doc_id")), "doc_id")
    plain = df.withColumn("rn2", F.row_number().over(w))
    j = r.join(plain.select("doc_id", "rn2"), "doc_id")
    assert j.filter(F.col("rn") != F.col("rn2")).count() == 0
    assert j.count() == 3000


def _quota(counts, draw):
    n = sum(counts.values())
    base = {k: draw * v // n for k, v in counts.items()}
    rem = sorted(counts, key=lambda k: (-(draw * counts[k] % n), k))
    left = draw - sum(base.values())
    for k in rem[:left]:
        if draw * counts[k] % n:
            base[k] += 1
    return base


def test_stratified_split_exact_quotas(spark):
    rows = [(i, lab, "t") for i, lab in enumerate(["minimum"] * 49 + ["mild"] * 9 + ["moderate"] * 299 + ["severe"] * 42)]
    df = spark.createDataFrame(rows, "doc_id long, label string, text string")
    s = sampling.stratified_split(df, "label", "doc_id", Config()).collect()
    assert len(s) == len(rows) and len({r.doc_id for r in s}) == len(rows)
    got = {}
    for r in s:
        got.setdefault(r.split, {}).setdefault(r.label, 0)
        got[r.split][r.label] += 1
    assert got["train"] == {"minimum": 39, "mild": 7, "moderate": 239, "severe": 34}
    assert got["val"] == {"minimum": 5, "mild": 1, "moderate": 30, "severe": 4}
    assert got["test"] == {"minimum": 5, "mild": 1, "moderate": 30, "severe": 4}
    counts = {"minimum": 49, "mild": 9, "moderate": 299, "severe": 42}
    assert _quota(counts, 399 - math.ceil(0.2 * 399)) == got["train"]


def test_sample_n_size_and_distinct(spark):
    df = spark.createDataFrame([(i, "x" if i % 3 else "y") for i in range(100)], "gen_id long, dataset string")
    s = sampling.sample_n(df, ["dataset"], "gen_id", 20, 42).collect()
    by = {}
    for r in s:
        by.setdefault(r.dataset, []).append(r)
    assert {k: len(v) for k, v in by.items()} == {"x": 20, "y": 20}
    assert all(sorted(r.rn for r in v) == list(range(1, 21)) for v in by.values())
    small = sampling.sample_n(df.filter("gen_id < 5"), ["dataset"], "gen_id", 20, 42).count()
    assert small == 5


def test_few_shot_draws_distinct_same_label(spark):
    rows = [(i, "a" if i < 30 else ("b" if i < 33 else "c"), f"t{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, label string, text string")
    cfg = Config(n_per_label=25)
    d = sampling.few_shot_draws(df, "label", "doc_id", df.select("doc_id", "text"), cfg).collect()
    lab = {r[0]: r[1] for r in rows}
    per = {}
    for r in d:
        per.setdefault((r.label, r.prompt_no), []).append(r)
        assert lab[r.doc_id] == r.label
    assert len(per) == 3 * 25
    n_label = {"a": 30, "b": 3, "c": 7}
    for (label, _), ex in per.items():
        assert len({e.doc_id for e in ex}) == len(ex) == min(8, n_label[label])
        assert sorted(e.example_no for e in ex) == list(range(1, len(ex) + 1))


def test_roc_auc_matches_pair_counting(spark):
    rnd = random.Random(3)
    C = 4
    rows = []
    for i in range(300):
        y = rnd.randrange(C)
        l = [round(rnd.gauss(0, 1), 1) + (0.8 if c == y else 0) for c in range(C)]  # ties on purpose
        rows.append((i, y, l))
    df = spark.createDataFrame(rows, "vec_id long, label_id int, l array<double>")
    got = {r.cls: r.auc for r in M.roc_auc_ovr(df, []).collect()}
    probs = {r.vec_id: (r.label_id, r.cls, r.prob) for r in []}
    p = M.class_probs(df, ["vec_id"]).collect()
    for c in range(C):
        pos = [r.prob for r in p if r.cls == c and r.label_id == c]
        neg = [r.prob for r in p if r.cls == c and r.label_id != c]
        u = sum((1.0 if a > b else 0.5 if a == b else 0.0) for a in pos for b in neg)
        assert abs(got[c] - u / (len(pos) * len(neg))) < 1e-12
    assert probs == {}


def test_confusion_total_and_report(spark):
    rows = [(i, i % 3, [float((i * 7) % 5), float((i * 3) % 4), float(i % 2)]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, label_id int, l array<double>")
    conf = M.confusion(df, [])
    assert conf.agg(F.sum("n")).first()[0] == 120
    pc = {r.cls: r for r in M.per_class(conf, []).collect()}
    preds = [max(range(3), key=lambda k: (r[2][k], -k)) for r in rows]
    for c, r in pc.items():
        tp = sum(1 for row, p in zip(rows, preds) if p == c and row[1] == c)
        npred = sum(1 for p in preds if p == c)
        sup = sum(1 for row in rows if row[1] == c)
        assert r.tp == tp and r.predicted == npred and r.support == sup
        assert abs(r.f1 - (2 * tp / (sup + npred) if sup + npred else 0.0)) < 1e-12


def test_repartition_does_not_change_preprocess(spark):
    from textloom.operators import prep
    rows = [(i, "en", ["Hello  World", "hello world", "Other\ntext", "x"][i % 4], "mild") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, dataset string, text string, label string")
    a = sorted(prep.preprocess(df).collect())
    b = sorted(prep.preprocess(df.repartition(7)).collect())
    assert a == b and len(a) == 3
    assert {r.doc_id for r in a} == {0, 2, 3}


def _auc_pairs(pos, neg):
    """Brute-force one-vs-rest AUC: pairs won by a positive, ties count one half."""
    return sum((1.0 if a > b else 0.5 if a == b else 0.0) for a in pos for b in neg) / (len(pos) * len(neg))


def test_roc_auc_narrow_scores_many_partitions(spark):
    """All scores inside a 1e-9-wide interval (one equal-width bucket), two runs, 16 range partitions."""
    rnd = random.Random(5)
    C = 3
    rows = []
    for run in ("r1", "r2"):
        for i in range(400):
            y = rnd.randrange(C)
            l = [1e-9 * rnd.random() + (1e-10 if c == y else 0.0) for c in range(C)]
            if i % 10 == 0:
                l = [0.0] * C                      # a tied score shared by many rows
            rows.append((run, i, y, l))
    df = spark.createDataFrame(rows, "run string, vec_id long, label_id int, l array<double>")
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions",
                                          "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.run, r.cls): r.auc for r in M.roc_auc_ovr(df, ["run"]).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    p = M.class_probs(df, ["run", "vec_id"]).collect()
    for run in ("r1", "r2"):
        for c in range(C):
            pos = [r.prob for r in p if r.run == run and r.cls == c and r.label_id == c]
            neg = [r.prob for r in p if r.run == run and r.cls == c and r.label_id != c]
            assert abs(got[(run, c)] - _auc_pairs(pos, neg)) < 1e-12


def test_roc_auc_of_ties_beside_range_bounds(spark):
    """Few distinct scores, most of them at the bounds of a range: each tied score is one row, so no tie is split."""
    rnd = random.Random(9)
    rows = [(i, rnd.randrange(2), [float(rnd.randrange(5)), 1.0]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, label_id int, l array<double>")
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.cls: r.auc for r in M.roc_auc_ovr(df, []).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    for c in (0, 1):
        p = [(r[2][c] - r[2][1 - c], r[1] == c) for r in rows]       # the softmax is monotone in the difference
        assert abs(got[c] - _auc_pairs([s for s, y in p if y], [s for s, y in p if not y])) < 1e-12


def test_roc_auc_with_empty_partitions(spark):
    rows = [(0, 0, [2.0, 1.0]), (1, 1, [0.5, 1.5]), (2, 0, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label_id int, l array<double>")
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions",
                                          "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.cls: r.auc for r in M.roc_auc_ovr(df, []).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    p = M.class_probs(df, ["vec_id"]).collect()
    for c in (0, 1):
        pos = [r.prob for r in p if r.cls == c and r.label_id == c]
        neg = [r.prob for r in p if r.cls == c and r.label_id != c]
        assert abs(got[c] - _auc_pairs(pos, neg)) < 1e-12


def test_two_level_sample_is_the_plain_one(spark):
    df = spark.createDataFrame([(i, "x" if i % 50 else "y") for i in range(5000)], "gen_id long, dataset string")
    got = {(r.dataset, r.rn): r.gen_id for r in sampling.sample_ids(df, ["dataset"], "gen_id", 60, 42).collect()}
    w = Window.partitionBy("dataset").orderBy(seeded_hash(42, F.col("gen_id")), "gen_id")
    plain = df.withColumn("rn", F.row_number().over(w)).filter("rn <= 60").collect()
    assert got == {(r.dataset, r.rn): r.gen_id for r in plain}
    plan = sampling.sample_ids(df, ["dataset"], "gen_id", 60, 42)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 3          # buckets before and after the shuffle, then the stratum


def test_threshold_sample_is_the_plain_one(spark, monkeypatch):
    rows = [(i, "x" if i % 50 else None, i % 2) for i in range(20000)] + [(5, "twice", 0)] * 300 + [(7, "one", 0)]
    df = spark.createDataFrame(rows, "gen_id long, dataset string, part int")
    w = Window.partitionBy("dataset", "part").orderBy(seeded_hash(42, F.col("gen_id")), "gen_id")
    plain = df.withColumn("rn", F.row_number().over(w)).filter("rn <= 60")
    want = sorted(map(str, plain.select("dataset", "part", "gen_id", "rn").collect()))

    def got():
        return sorted(map(str, sampling.threshold_sample_ids(df.repartition(5), ["dataset", "part"], "gen_id", 60, 42)
                          .select("dataset", "part", "gen_id", F.col("rn").cast("int").alias("rn")).collect()))

    assert got() == want
    monkeypatch.setattr(sampling, "HASH_RANGE", 1 << 40)        # cut-offs far too low: every stratum takes the exact way
    assert got() == want
    none = sampling.threshold_sample_ids(df.limit(0), ["dataset"], "gen_id", 60, 42)
    assert none.count() == 0 and none.columns == ["dataset", "gen_id", "rn"]


def test_threshold_sample_moves_few_rows(spark):
    """Of the candidates, about n + 6 sqrt(n) a stratum are numbered, in however many tasks the rows come."""
    df = spark.range(40000).selectExpr("id AS gen_id", "'x' AS dataset")
    for tasks in (2, 40):
        s = sampling.threshold_sample_ids(df.repartition(tasks), ["dataset"], "gen_id", 100, 1)
        plan = s._jdf.queryExecution().optimizedPlan().toString()
        assert "_cut" in plan and s.count() == 100
    h = df.withColumn("h", seeded_hash(1, F.col("gen_id")))
    assert 100 <= h.where(F.col("h") <= int(160 / 40000 * sampling.HASH_RANGE)).count() <= 230


def test_prompts_per_label_do_not_follow_the_table(spark):
    cfg = Config(n_per_label=7)
    for n in (40, 400):
        df = spark.createDataFrame(_rows(n, ["a", "b"]), "doc_id long, label string, text string")
        keys = sampling.prompt_keys(df, "label", cfg).groupBy("label").count().collect()
        assert {r["count"] for r in keys} == {7}


def test_dedup_keeps_the_smallest_id_and_tells_nulls_apart(spark):
    from textloom.operators import prep
    rows = [(3, "a", None), (1, "a", None), (2, None, "a"), (4, None, "a"), (5, "a", "a"), (6, "a", "b")]
    df = spark.createDataFrame(rows, "doc_id long, x string, y string")
    assert {r.doc_id for r in prep.dedup_first(df, ["x", "y"]).collect()} == {1, 2, 5, 6}


def test_registered_prompt_queries_make_the_whole_number(spark):
    from textloom.plans import catalog
    rows = catalog.queries()["few_shot_sample"](spark, "/root/testdata/sf0.001").groupBy("label").agg(F.countDistinct("prompt_no").alias("n")).collect()
    assert rows and {r.n for r in rows} == {10_000}
