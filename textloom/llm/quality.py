"""Quality classifier: positive-unlabelled learning by the non-negative unbiased risk."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import blocks, code_points, hash_share, held_out, read_table, small, strings

THRESHOLD = 0.3
#: About this many trusted positives and as many unlabelled rows are learnt from, a third of them for the prior and the curve.
MAX_TRAIN = 9_000
DELTA = 0.1                    # the prior's bound holds with this error
BLOCK = 1 << 20
CLASSES = 8                    # lower, upper, digit, blank, line end, common mark, symbol, other letter
COMMON_MARKS = ".,;:'\"!?-()"
N_TRIGRAMS = CLASSES ** 3
N_FEATURES = N_TRIGRAMS + 128 + 9
ROUNDS, RATE, DECAY = 400, 0.02, 1e-4


@cache
def _classes() -> np.ndarray:
    """Character class of each code point."""
    kind = np.full(0x110000, 6, np.uint8)
    for start, end in ((0, 0xD800), (0xE000, 0x110000)):
        kind[start:end] = [0 if c.islower() else 1 if c.isupper() else 7 if c.isalpha() else 2 if c.isdigit()
                           else 3 if c.isspace() else 6 for c in map(chr, range(start, end))]
    kind[10] = 4
    for c in COMMON_MARKS:
        kind[ord(c)] = 5
    return kind


def text_features(texts: list[str]) -> np.ndarray:
    """One row per text: frequencies of class trigrams and ASCII characters, repetition and length figures."""
    out = np.zeros((len(texts), N_FEATURES), np.float32)
    for a, b in blocks([len(t) + N_FEATURES for t in texts], BLOCK):
        own = texts[a:b]
        codes, off = code_points(own)
        kind = _classes()[codes].astype(np.int64)
        lengths = np.diff(off) - 2
        doc = np.repeat(np.arange(b - a), np.diff(off))
        tri = kind * CLASSES ** 2
        tri[:-1] += kind[1:] * CLASSES
        tri[:-2] += kind[2:]
        inside = np.arange(len(codes)) < np.repeat(off[1:] - 2, np.diff(off))
        scale = np.maximum(lengths, 1)[:, None]
        grams = np.bincount(doc[inside] * N_TRIGRAMS + tri[inside], minlength=(b - a) * N_TRIGRAMS)
        out[a:b, :N_TRIGRAMS] = np.sqrt(grams.reshape(b - a, -1) / scale)
        low = inside & (codes < 128)
        ascii_ = np.bincount(doc[low] * 128 + codes[low], minlength=(b - a) * 128)
        out[a:b, N_TRIGRAMS:N_TRIGRAMS + 128] = np.sqrt(ascii_.reshape(b - a, -1) / scale)
        for i, t in enumerate(own):
            words, lines = t.split(), t.split("\n")
            n = max(1, len(words))
            again = sum(x == y for x, y in zip(words, words[1:]))
            pairs = len(set(zip(words, words[1:])))
            out[a + i, -9:] = (np.log1p(len(words)), np.log1p(len(t)), len(t) / n, len(set(words)) / n, again / n,
                               pairs / max(1, len(words) - 1), len(lines) / n,
                               1 - len(set(lines)) / len(lines), max(map(len, words), default=0) / (len(t) + 1))
    return out


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = ROUNDS) -> tuple:
    """Linear scorer ``(mean, scale, weights, bias)`` that minimises the non-negative risk of positives and unlabelled.

    Risk = prior E_p[l(g)] + max(0, E_u[l(-g)] - prior E_p[l(-g)]) with the logistic loss l; when the second part
    falls below 0, the step goes up its gradient instead (the unlabelled rows are being overfitted).
    """
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    p, u = (positive - mean) / scale, (unlabelled - mean) / scale
    w, bias = np.zeros(p.shape[1]), 0.0
    m, v = np.zeros(p.shape[1] + 1), np.zeros(p.shape[1] + 1)
    for step in range(1, rounds + 1):
        gp, gu = np.clip(p @ w + bias, -30, 30), np.clip(u @ w + bias, -30, 30)
        sp, su = 1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu))
        negative = np.log1p(np.exp(gu)).mean() - prior * np.log1p(np.exp(gp)).mean()
        # gradients with respect to g: of l(g) it is s - 1, of l(-g) it is s
        if negative >= 0:
            dp, du = prior * (sp - 1) - prior * sp, su
        else:
            dp, du = prior * sp, -su
        dp, du = dp / len(p), du / len(u)
        grad = np.concatenate([dp @ p + du @ u + DECAY * w, [dp.sum() + du.sum()]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return mean.astype(np.float32), scale.astype(np.float32), w.astype(np.float32), float(bias)


def fit_curve(g: np.ndarray, y: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising curve from scorer values to probabilities (isotonic least squares).

    Both classes are weighted to the prior. Equal neighbours are pooled; between pools the curve is a straight line.
    """
    if not len(g) or y.min() == y.max():
        return np.array([-4.0, 4.0]), np.array([0.02, 0.98])
    order = np.argsort(g, kind="stable")
    weight = np.where(y == 1, prior / (y == 1).sum(), (1 - prior) / (y == 0).sum())
    pools: list[list[float]] = []          # weight, weighted label, first and last scorer value
    for i in order:
        pools.append([weight[i], weight[i] * y[i], g[i], g[i]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            w, wy, _, last = pools.pop()
            pools[-1][0] += w
            pools[-1][1] += wy
            pools[-1][3] = last
    knots = [(x, p[1] / p[0]) for p in pools for x in ((p[2], p[3]) if p[3] > p[2] else (p[2],))]
    return np.array([x for x, _ in knots], float), np.array([v for _, v in knots], float)


def to_score(g: np.ndarray, curve: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Probabilities by the curve; a small share of the logistic curve keeps the order inside flat parts."""
    x, v = curve
    middle, spread = np.interp(0.5, v, x) if v[0] < v[-1] else 0.0, max(1e-6, float(x[-1] - x[0]) / 8)
    smooth = 1 / (1 + np.exp(-np.clip((g - middle) / spread, -30, 30)))
    return np.round(0.98 * np.interp(g, x, v) + 0.02 * smooth, 6)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled, from scorer values of rows that the scorer has not seen.

    Above a cut, the unlabelled hold at least prior x (share of the positives above it), so that every cut bounds the prior by
    the ratio of the two shares; the cut is the one with the smallest bound, its sampling error added.
    """
    cuts = np.unique(positive)
    above_p = 1 - np.searchsorted(np.sort(positive), cuts, side="left") / len(positive)
    above_u = 1 - np.searchsorted(np.sort(unlabelled), cuts, side="left") / len(unlabelled)
    error = np.sqrt(np.log(4 / DELTA) / 2) * (len(positive) ** -0.5 + len(unlabelled) ** -0.5)
    best = int(np.argmin((above_u + error) / above_p))
    return float(np.clip(above_u[best] / above_p[best], 0.02, 0.98))


def fit_posterior(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising curve from scorer values to P(positive) = prior x density of positives / density of the unlabelled.

    The isotonic curve of positives (weight prior) against unlabelled (weight 1) is p / (1 + p) of that ratio p.
    """
    g = np.concatenate([positive, unlabelled]).astype(np.float64)
    y = np.concatenate([np.ones(len(positive)), np.zeros(len(unlabelled))])
    x, v = fit_curve(g, y, prior / (1 + prior))
    return x, np.clip(v / np.maximum(1 - v, 1e-9), 0.0, 1.0)


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = MAX_TRAIN):
    """``((positives, unlabelled), (positives, unlabelled))``: feature rows to fit on, and those for prior and curve.

    Only rows that are not held out. Trusted positives are rows labelled 1; the unlabelled are drawn from all documents, labels
    unread. Each distinct (doc_id, text) counts once, and about ``bound`` of each kind are collected, however often an id or
    a row repeats: ids are chosen by a hash of the id, rows by a hash of id and text.
    """
    learn = docs.where(~held_out() & F.col("text").isNotNull()).select("doc_id", "text")
    marks = (labels.where(~held_out() & F.col("quality").isNotNull())
             .groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id"))
    # the chosen ids are bounded by the sample size, whatever the corpus holds
    chosen = marks.where(hash_share(min(1.0, bound / max(1, marks.count())), 21, "doc_id")).withColumn("positive", F.lit(True))
    known = learn.join(F.broadcast(chosen), "doc_id")
    n_known = known.select("doc_id", F.xxhash64("text")).distinct().count()
    n_docs = learn.count()
    rows = (learn.join(F.broadcast(chosen), "doc_id", "left")
            .withColumn("positive", F.col("positive").isNotNull()
                        & hash_share(min(1.0, bound / max(1, n_known)), 22, "doc_id", "text"))
            .withColumn("free", hash_share(min(1.0, bound / max(1, n_docs)), 23, "doc_id", "text"))
            .where("positive OR free").dropDuplicates(["doc_id", "text"])
            .select("text", "positive", "free", (F.pmod(F.xxhash64(F.lit(24), "doc_id", "text"), F.lit(3)) > 0).alias("fitted")))

    def run(batches):
        for batch in small(batches):
            f = text_features(strings(batch["text"]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x.tobytes() for x in f], pa.binary()), *(batch[c] for c in ("positive", "free", "fitted"))],
                names=["features", "positive", "free", "fitted"])

    got = rows.mapInArrow(run, "features binary, positive boolean, free boolean, fitted boolean").toArrow().sort_by("features")
    x = np.frombuffer(b"".join(got["features"].to_pylist()), np.float32).reshape(-1, N_FEATURES)
    positive, free, fitted = (got[c].to_numpy().astype(bool) for c in ("positive", "free", "fitted"))
    return tuple((x[positive & part], x[free & part]) for part in (fitted, ~fitted))


def fit(docs: DataFrame, labels: DataFrame, bound: int = MAX_TRAIN, prior: float | None = None):
    """The scorer and its curve, or None if there is no trusted positive to learn from. Labels other than 1 are not used.

    A first scorer, at a prior of a half, ranks the rows kept back; the prior is estimated there and the risk minimised
    again with it. With too few rows to keep any back, all rows serve both ends.
    """
    own, back = training_rows(docs, labels, bound)
    if not all(map(len, (*own, *back))):
        own = back = tuple(np.concatenate(z) for z in zip(own, back))
    if not all(map(len, own)):
        return None

    def scorer(model):
        mean, scale, w, bias = model
        return [((x - mean) / scale @ w + bias).astype(np.float64) for x in back]

    prior = prior or estimate_prior(*scorer(fit_nnpu(*own, 0.5)))
    model = fit_nnpu(*own, prior)
    return *model, fit_posterior(*scorer(model), prior)


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, bound: int = MAX_TRAIN,
          prior: float | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Trusted positives are the rows labelled 1, unlabelled rows come from all documents; the class prior is estimated from the
    two unless given, and so is the curve to probabilities: no label but 1 is used. Labels come from rows that
    are not held out (``common.held_out``); a score sees the text alone, whole however long it is. Equal texts score equally.

    A null text is scored as an empty one; a null id is held out; repeated rows give repeated results; a document with
    several labels counts as the lowest. With nothing to learn from every score is 0.5; an empty table gives an empty result.
    Other columns are not read.
    """
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, bound, prior))

    def run(batches):
        for batch in small(batches):
            x = text_features(strings(batch["text"]))
            if model.value is None:
                p = np.full(len(x), 0.5)
            else:
                mean, scale, w, bias, curve = model.value
                p = to_score(((x - mean) / scale @ w + bias).astype(np.float64), curve)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array(p, pa.float64()),
                 pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op2_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
