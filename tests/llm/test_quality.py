import duckdb
import numpy as np

from textloom.llm import quality as Q
from textloom.llm.common import read_table


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    got = Q.score(read_table(spark, sf, "documents"), read_table(spark, sf, "labels")).toPandas().set_index("doc_id")
    both = got.join(duckdb.sql(f"select doc_id, quality from '{sf}/labels.parquet'").df().set_index("doc_id"), how="inner")
    held = both[both.held_out]
    good, bad = held.score[held.quality == 1].to_numpy(), held.score[held.quality == 0].to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.97
    assert ((held.score >= 0.3).astype(int) == held.predicted).all()
    assert (held.predicted == held.quality).mean() > 0.93


def test_risk_separates_without_negatives():
    rng = np.random.default_rng(0)
    pos = rng.normal(1.5, 1, (800, 6)).astype(np.float32)
    neg = rng.normal(-1.5, 1, (800, 6)).astype(np.float32)
    free = np.concatenate([pos[:400] + 0.01, neg[:400]])
    mean, scale, w, b = Q.fit_nnpu(pos[400:], free, prior=0.5)
    g = lambda x: (x - mean) / scale @ w + b
    assert (g(pos[:400]) > 0).mean() > 0.95 and (g(neg[400:]) < 0).mean() > 0.95


def risk(x, y_positive, mean, scale, w, b, prior):
    """The non-negative risk, an element at a time."""
    loss = lambda z: float(np.log1p(np.exp(-z)))
    g = [float(((v - mean) / scale) @ w + b) for v in x]
    pos, free = [z for z, y in zip(g, y_positive) if y], [z for z, y in zip(g, y_positive) if not y]
    rest = sum(loss(-z) for z in free) / len(free) - prior * sum(loss(-z) for z in pos) / len(pos)
    return prior * sum(loss(z) for z in pos) / len(pos) + max(0.0, rest)


def test_fitted_weights_have_the_least_risk():
    rng = np.random.default_rng(3)
    pos = rng.normal(0.7, 1, (300, 3)).astype(np.float32)
    free = np.concatenate([rng.normal(0.7, 1, (200, 3)), rng.normal(-0.7, 1, (200, 3))]).astype(np.float32)
    mean, scale, w, b = Q.fit_nnpu(pos, free, prior=0.5)
    x, y = np.concatenate([pos, free]), [True] * len(pos) + [False] * len(free)
    least = risk(x, y, mean, scale, w, b, 0.5)
    for _ in range(30):
        step = rng.normal(0, 0.3, 4)
        assert risk(x, y, mean, scale, w + step[:3], b + step[3], 0.5) > least - 2e-3


def test_prior_from_positives_and_unlabelled():
    rng = np.random.default_rng(1)
    for share in (0.1, 0.5, 0.85):
        n = int(4000 * share)
        free = np.concatenate([rng.normal(2, 1, n), rng.normal(-2, 1, 4000 - n)])
        got = Q.estimate_prior(rng.normal(2, 1, 3000), free)
        assert abs(got - share) < 0.06
        x, v = Q.fit_posterior(rng.normal(2, 1, 3000), free, got)
        assert (np.diff(v) >= 0).all() and np.interp(3, x, v) > 0.85 and np.interp(-2.5, x, v) < 0.1


def test_labels_of_0_change_nothing(spark, make_docs):
    rows = [(i, ("good words in a row " * (i % 7 + 1)) if i % 2 else "#$% 123 !! " * (i % 5 + 1), "en", "web") for i in range(80)]
    docs = make_docs(rows)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    a, b = (sorted(map(tuple, Q.score(docs, d).collect())) for d in (labels, labels.where("quality = 1")))
    assert a == b and {r[0] % 2 for r in a if r[3]} == {1}


def test_sample_is_bounded_with_repeated_ids_and_rows(spark):
    docs = spark.range(6000).selectExpr("if(id % 3 = 0, 7, id) AS doc_id", "if(id % 6 = 0, 'same text', concat('text ', id)) AS text")
    labels = spark.range(6000).selectExpr("id AS doc_id", "cast(1 AS int) AS quality")
    own, back = Q.training_rows(docs, labels, bound=200)
    assert len(own[0]) + len(back[0]) < 300 and len(own[1]) + len(back[1]) < 300


def test_curve_rises():
    g = np.array([-3, -2, -1, 0, 1, 2, 3.0])
    curve = Q.fit_curve(g, np.array([0, 0, 1, 0, 1, 1, 1]), 0.8)
    s = Q.to_score(np.linspace(-5, 5, 50), curve)
    assert (np.diff(s) >= 0).all() and 0 <= s.min() and s.max() <= 1


def test_odd_rows(spark, make_docs, odd_rows):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 11)] + [(5, 1, 0), (6, None, 0)],
                                   "doc_id long, quality int, toxic int")
    got = Q.score(make_docs(odd_rows), labels).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 5}) == 1
    assert all(r.held_out for r in got if r.doc_id is None)
    none = Q.score(make_docs(odd_rows), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert Q.score(make_docs(odd_rows).limit(0), labels).count() == 0
