"""The trained linear classifier against a dense one, its vocabulary and ranking helpers, epochs, resuming, hot terms."""

import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.config import LABELS
from textloom.operators import linear as L
from textloom.operators import ranking
from textloom.operators import vocabulary as V

TRAIN = "run_name string, doc_id long, label string, text_clean string"
REST = "doc_id long, label string, text_clean string"


def corpus(n, seed):
    """Each label prefers its own words; one word is in every text."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        label = LABELS[i % 4]
        own = [f"{label}{rnd.randrange(6)}" for _ in range(rnd.randrange(1, 6))]
        noise = [f"w{rnd.randrange(30)}" for _ in range(rnd.randrange(0, 8))]
        words = ["the", *own, *noise]
        rnd.shuffle(words)
        rows.append((i, label if rnd.random() < 0.9 else rnd.choice(LABELS), " ".join(words)))
    return rows


def half_up(x):
    return np.floor(x + 0.5).astype(np.int64)


def terms(text, pairs):
    w = text.split(" ")
    return [" ".join(x) for x in zip(w, w[1:])] if pairs else w


class Dense:
    """The same training with dense matrices, one model at a time."""

    def __init__(self, train, pairs):
        self.pairs = pairs
        tf = [Counter(terms(t, pairs)) for *_, t in train]
        df = Counter(t for c in tf for t in c)
        self.idf = {t: math.log((len(train) + 1) / (d + 1)) for t, d in df.items()}
        self.names = [*sorted(self.idf), ""]
        self.x = self.matrix([t for *_, t in train])
        self.y = np.array([LABELS.index(label) for *_, label, _ in train])
        s = self.x.sum(1)
        self.d = 0.5 * np.floor(self.x * s[:, None] / L.UNIT).sum(0) / L.UNIT + L.RIDGE

    def matrix(self, texts):
        raw = np.zeros((len(texts), len(self.names)), np.int64)
        for i, t in enumerate(texts):
            for term, n in Counter(terms(t, self.pairs)).items():
                if term in self.idf:
                    raw[i, self.names.index(term)] = half_up((1 + math.log(n)) * self.idf[term] * L.RAW_UNIT)
        q = np.sqrt((raw * raw).sum(1).astype(float))[:, None]
        x = half_up(raw / np.maximum(q, 1) * L.UNIT)
        x[:, -1] = L.UNIT
        return x

    def epochs(self, n):
        k = len(LABELS)
        w = y = np.zeros((len(self.names), k), np.int64)
        out = []
        for e in range(1, n + 1):
            z = (self.x @ y) / (float(L.UNIT) * L.UNIT)
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            r = half_up((p - np.eye(k)[self.y]) * L.UNIT)
            g = half_up(self.x[:, :, None] * r[:, None, :] / L.UNIT).sum(0)
            new = half_up(y - (g + L.RIDGE * y) / self.d[:, None])
            w, y = new, half_up(new + (e - 1) / (e + 2) * (new - w))
            out.append(w)
        return out


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("linear") / "run")
    a, b, val = corpus(80, 1), corpus(30, 2), corpus(24, 3)
    train = spark.createDataFrame([("a", *r) for r in a] + [("b", *r) for r in b], TRAIN).repartition(5)
    t = L.Training(spark, train, spark.createDataFrame(val, REST), root=root).run(4)
    return t, {"a": a, "b": b}, val, train


def test_weights_equal_the_dense_training(trained):
    t, sets, _, _ = trained
    for run, rows in sets.items():
        for name, pairs in (("unigram_lr", False), ("bigram_lr", True)):
            dense = Dense(rows, pairs)
            for e, want in enumerate(dense.epochs(2), 1):
                w = t.epoch(e).join(t.vocab.select("fid", "term"), "fid").where(f"run_name = '{run}' and classifier = '{name}'")
                got = {r.term: list(r.w) for r in w.collect()}
                live = [i for i, x in enumerate(dense.names) if dense.x[:, i].any()]
                assert len(got) == len(live)
                for i in live:
                    assert np.abs(np.array(got[dense.names[i]]) - want[i]).max() <= 2, (run, name, e, dense.names[i])


def test_validation_scores_best_epoch_and_end_of_models(trained):
    t, sets, val, _ = trained
    history = {(r.run_name, r.classifier, r.epoch): r.macro_f1 for r in t.history(4).collect()}
    best = {(r.run_name, r.classifier): r for r in t.best().collect()}
    assert len(best) == 4
    for (run, c), r in best.items():
        own = {e: f for (a, b, e), f in history.items() if (a, b) == (run, c)}
        assert r.macro_f1 == max(own.values()) and r.epoch == min(e for e, f in own.items() if f == r.macro_f1)
        assert len(own) == min(4, r.epoch + L.PATIENCE)                    # ended when nothing got better
    dense = Dense(sets["a"], False)
    for e, w in enumerate(dense.epochs(2), 1):
        pred = np.argmax(dense.matrix([x for *_, x in val]) @ w, 1)
        y = np.array([LABELS.index(label) for _, label, _ in val])
        f1 = [2 * ((pred == c) & (y == c)).sum() / max(1, (pred == c).sum() + (y == c).sum()) for c in sorted({*pred, *y})]
        assert abs(history["a", "unigram_lr", e] - np.mean(f1)) < 1e-9
    assert best["a", "unigram_lr"].macro_f1 > 0.6
    scored = t.score(t.spark.createDataFrame(val, REST)).collect()
    assert len(scored) == 4 * len(val) and all(len(r.l) == 4 for r in scored)
    assert {(r.run_name, r.classifier, r.epoch) for r in scored} == {(*k, r.epoch) for k, r in best.items()}


def test_a_stopped_training_goes_on_behind_its_last_epoch(spark, trained, tmp_path):
    t, _, val, train = trained
    root = str(tmp_path / "again")
    first = L.Training(spark, train, spark.createDataFrame(val, REST), root=root)
    first.epoch(1)
    first.validation(1)
    first.epoch(2)                                             # ends before the scores of epoch 2 are written
    files = {f: os.path.getmtime(f"{root}/epoch=2/{f}") for f in os.listdir(f"{root}/epoch=2")}
    second = L.Training(spark, train, spark.createDataFrame(val, REST), root=root).run(4)
    assert {f: os.path.getmtime(f"{root}/epoch=2/{f}") for f in os.listdir(f"{root}/epoch=2")} == files
    assert sorted(map(repr, second.history(4).collect())) == sorted(map(repr, t.history(4).collect()))


def test_steps_reach_the_optimum_of_a_dense_solver():
    """The same steps, continued with dense matrices, against Newton's method on the same loss."""
    dense = Dense([("a", *r) for r in corpus(60, 5)], False)
    x, k = dense.x / L.UNIT, len(LABELS)
    onehot = np.eye(k)[dense.y]

    def loss(w):
        z = x @ w
        z = z - z.max(1, keepdims=True)
        return -(z[onehot == 1] - np.log(np.exp(z).sum(1))).sum() + L.RIDGE / 2 * (w * w).sum()

    w = np.zeros((x.shape[1], k))
    for _ in range(30):
        p = np.exp(x @ w - (x @ w).max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (x.T @ (p - onehot) + L.RIDGE * w).ravel()
        h = np.zeros((w.size, w.size))
        for row, q in zip(x, p):
            h += np.kron(np.outer(row, row), np.diag(q) - np.outer(q, q))
        w = w - np.linalg.solve(h + L.RIDGE * np.eye(w.size), g).reshape(w.shape)
    steps = [loss(s / L.UNIT) for s in dense.epochs(200)]
    assert abs(steps[-1] - loss(w)) < 1e-4 * loss(w)
    assert steps[0] < loss(np.zeros_like(w)) and steps[3] < steps[0]


def test_frequent_terms_are_joined_in_the_map(spark, monkeypatch):
    monkeypatch.setattr(L, "FREQUENT", 5)
    rows = [(i, LABELS[i % 4], f"the a{i % 3} " + " ".join(f"u{i}x{j}" for j in range(4))) for i in range(400)]
    train = spark.createDataFrame([("a", *r) for r in rows], TRAIN)
    vocab = L.vocabulary(train)
    vecs = L.vectors(L.with_label_id(train, LABELS), vocab, ["doc_id", "label_id"], True)
    tail = vecs.where("not head").groupBy("fid").count().agg(F.max("count")).first()[0]
    assert tail <= 1 and vecs.where("head").count() >= 3 * 400          # "the" has idf 0 as a word; its pairs do not
    frequent = {r.term for r in vocab.where("head and classifier = 'unigram_lr'").collect()}
    assert {"the", "a0", "a1", "a2", ""} <= frequent and len(frequent) <= 6
    weights = vecs.select("fid", "head").distinct().withColumn("w", F.array(*[F.lit(1).cast("long")] * 4))
    plan = L.scores(vecs, weights, ["doc_id"], 4)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_top_terms_with_ties(spark):
    rnd = random.Random(3)
    rows = [(g, f"t{i:03d}", rnd.choice([1, 1, 1, 2, 3, 50])) for g in ("x", "y") for i in range(300)] + [("z", "only", 1)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, term string, df long").repartition(6)
    for k in (1, 40, 120, 299, 300, 1000):
        got = sorted(map(tuple, V.top_terms(df, ["g"], k).collect()))
        want = sorted(r for g in "xyz" for r in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))[:k])
        assert got == want
    assert V.top_terms(df.limit(0), ["g"], 5).count() == 0


def test_numbers_and_running_sums(spark):
    rnd = random.Random(4)
    rows = [("hot" if i % 3 else f"g{i % 7}", i * 37 % 1009, rnd.randrange(-5, 9)) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, o long, v long").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ranking.numbered(ranking.prefix_sums(df, ["g"], ["o"], {"s": F.col("v")}), ["g"], ["o"]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(got) == 1000
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: r[1])
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.o)
        assert [r["rank"] for r in mine] == list(range(1, len(own) + 1))
        assert [r.s for r in mine] == [sum(v for *_, v in own[:i]) for i in range(len(own))]


def test_the_terms_of_a_model_are_not_dealt_to_one_task(spark):
    """The cut-offs, a row a model, go to the terms; the terms are not shuffled by their model."""
    rows = [("r", "unigram_lr", f"t{i}", i % 7) for i in range(300)]
    counts = spark.createDataFrame(rows, "run_name string, classifier string, term string, df long")
    adaptive = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        top = V.top_terms(counts, L.MODEL, 100)
        plan = top._jdf.queryExecution().executedPlan().toString()
        got = {r.term for r in top.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", adaptive)
    assert not re.search(r"SortMergeJoin \[run_name#\d+, classifier#\d+\]", plan)
    assert got == {t for _, _, t, _ in sorted(rows, key=lambda r: (-r[3], r[2]))[:100]}


def repeated(spark):
    """Training texts of two runs; ids repeat with the same and with another label."""
    rows = [("a", *r) for r in corpus(40, 7)] + [("b", *r) for r in corpus(12, 8)]
    rows += [("a", 3, rows[3][2], "the mild1 again"), ("a", 4, "severe" if rows[4][2] != "severe" else "mild", "the other w1 w2"), ("b", 5, rows[45][2], None)]
    return spark.createDataFrame(rows, TRAIN).repartition(3)


def test_vectors_of_blocks_equal_those_of_rows(spark, tmp_path):
    """Blocks of a few texts, repeated ids: the same entries as term by term, in a row a block and model."""
    train = repeated(spark)
    texts = L.with_label_id(train, LABELS)
    vocab = L.vocabulary(train)
    L.tallies(texts.withColumn("run", L.run_number(["a", "b"])), 2, 300).write.parquet(str(tmp_path / "tallies"))
    tallied = spark.read.parquet(str(tmp_path / "tallies"))
    n_blocks = tallied.select("block").distinct().count()
    assert n_blocks > 4
    for own_run in (True, False):
        keep = ["doc_id", "label_id"]
        if own_run:
            own, want = tallied, L.vectors(texts, vocab, keep, True)
        else:
            L.tallies(texts.where("run_name = 'a'").withColumn("run", F.lit(0)), 1, 300).write.parquet(str(tmp_path / "asked"))
            own, want = spark.read.parquet(str(tmp_path / "asked")), L.vectors(texts.where("run_name = 'a'").drop("run_name"), vocab, keep, False)
        packed = L.packed(own, vocab, L.by_term(vocab, ["a", "b"]), ["a", "b"], own_run).collect()
        assert len(packed) <= 4 * n_blocks
        got = Counter((r.run_name, r.classifier, r.ids[i], r.labels[i], r.fids[r.at[e]], r.x[e])
                      for r in packed for i in range(len(r.ids)) for e in range(r.edges[i], r.edges[i + 1]))
        assert got == Counter((r.run_name, r.classifier, r.doc_id, r.label_id, r.fid, r.x) for r in want.collect())


def test_gradient_of_parts_with_repeated_ids(spark, monkeypatch):
    """At weights of 0, in one part a model and in many; every vector of an id has all residuals of that id."""
    train = repeated(spark)
    t = L.Training(spark, train, spark.createDataFrame(corpus(5, 9), REST))
    by_id: dict = {}
    for r in L.vectors(L.with_label_id(train, LABELS), t.vocab, ["doc_id", "label_id"], True).collect():
        by_id.setdefault((r.run_name, r.classifier, r.doc_id), []).append(r)
    want: dict = {}
    for rows in by_id.values():
        for label in {r.label_id for r in rows}:
            residual = half_up((0.25 - (np.arange(4) == label)) * L.UNIT)
            for r in rows:
                want[r.fid] = want.get(r.fid, 0) + half_up(r.x * residual / L.UNIT)
    for part in (L.PART, 20):
        monkeypatch.setattr(L, "PART", part)
        got: dict = {}
        for r in L.gradient(t.train, t.state(0), LABELS).collect():
            for i, f in enumerate(r.fids):
                got[f] = got.get(f, 0) + np.array(r.g[4 * i:4 * i + 4])
        assert got.keys() == want.keys() and all((got[f] == want[f]).all() for f in want)


def test_an_epoch_moves_no_row_per_posting(spark, trained):
    """Vectors and weights are rows of whole blocks and buckets; no join is dealt by feature."""
    t, sets, val, _ = trained
    assert t.train.count() <= 4 * t.spark.read.parquet(f"{t.root}/tallies").select("block").distinct().count()
    assert t.state(1).count() <= 4 * L.BUCKETS
    for df in (L.step(t.train, t.state(1), t.labels, 2), L.packed_scores(t.val, t.state(1))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "fid#" not in plan and "SortMergeJoin" not in plan
