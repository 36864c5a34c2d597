"""Incoherent texts: a character trigram model with back-off per dataset, and each text's surprise against the dataset's own band."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.session import ship_code

SYMBOLS = 95               # most frequent characters of a dataset with a symbol of their own; all others share symbol 0
K = SYMBOLS + 1
BATCH = 512                # texts taken at once
UNIT, BINS = 0.01, 3000    # bits per bin, and bins, of a dataset's histogram of surprise
WIDTH = 4.0                # interquartile spreads above the upper quartile that a text may lie,
SIGMAS = 4.0               # ... and standard errors of a mean over its characters on top
MIN_CHARS, MIN_STARTS = 20, 12   # texts with fewer characters, or fewer words behind white space, are not judged by them


def character_counts(posts: DataFrame) -> DataFrame:
    """``dataset, point, n``: how often each code point occurs, summed per task first."""
    def run(batches):
        total: dict = {}
        for name, points, _ in _texts(batches):
            for p, n in zip(*np.unique(points, return_counts=True)):
                total[name, int(p)] = total.get((name, int(p)), 0) + int(n)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.int64()),
                                              pa.array(list(total.values()), pa.int64())], names=["dataset", "point", "n"])

    return posts.select("dataset", "text").mapInArrow(run, "dataset string, point long, n long").groupBy("dataset", "point").agg(
        F.sum("n").alias("n"))


def _texts(batches):
    """Dataset, code points and text lengths of the rows of a batch, a dataset at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            names, texts = part["dataset"].to_pylist(), [t or "" for t in part["text"].to_pylist()]
            for name in dict.fromkeys(names):
                own = [t for n, t in zip(names, texts) if n == name]
                yield name, np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32), [len(t) for t in own]


def symbols_of(counts: DataFrame) -> dict:
    """The ``SYMBOLS`` most frequent code points of each dataset: at most that many rows a dataset."""
    order = Window.partitionBy("dataset").orderBy(F.desc("n"), "point")
    top = counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= SYMBOLS)
    found: dict = {}
    for r in top.collect():
        found.setdefault(r.dataset, {})[r.point] = r.r
    return found


def encoder(symbols: dict):
    points = np.array(sorted(symbols), np.int64)
    values = np.array([symbols[p] for p in points], np.int64)

    def encode(x: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(points, x), len(points) - 1)
        return np.where(points[at] == x, values[at], 0)

    return encode


def cells(s: np.ndarray, lengths) -> np.ndarray:
    """The trigram of each position; the places before a text are symbol 0."""
    one, two = np.concatenate([[0], s[:-1]]), np.concatenate([[0, 0], s[:-2]])[:len(s)]
    begin = np.cumsum([0, *lengths])[:-1]
    begin = begin[np.array(lengths, int) > 0]
    one[begin] = two[begin] = 0
    second = begin[np.array([n for n in lengths if n > 0], int) > 1] + 1
    two[second] = 0
    return (two * K + one) * K + s


def trigram_counts(posts: DataFrame, symbols: dict) -> DataFrame:
    """``dataset, cell, n`` over all texts, at most K cubed rows a dataset, summed per task first."""
    def run(batches):
        total: dict = {}
        for name, points, lengths in _texts(batches):
            if len(points):
                n = np.bincount(cells(encoder(symbols[name])(points), lengths), minlength=K ** 3)
                total[name] = total[name] + n if name in total else n
        for name, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(n[at])],
                                             names=["dataset", "cell", "n"])

    return posts.select("dataset", "text").mapInArrow(run, "dataset string, cell long, n long").groupBy("dataset", "cell").agg(
        F.sum("n").alias("n"))


def surprise(n: np.ndarray) -> np.ndarray:
    """Bits of each trigram's last symbol: each order backs off to the lower one by its number of successors (Witten-Bell)."""
    n = n.reshape(K, K, K).astype(np.float64)
    p = np.full(K, 1.0 / K)
    for table in (n.sum((0, 1)), n.sum(0), n):
        kinds = np.maximum(1, (table > 0).sum(-1, keepdims=True))
        p = (table + kinds * p) / (table.sum(-1, keepdims=True) + kinds)
    return -np.log2(p).reshape(-1)


def fit(posts: DataFrame) -> dict:
    """Per dataset: its symbols, the bits of each trigram, and their standard deviation over the corpus.

    Everything is counted over all texts; what reaches the driver is at most K cubed numbers a dataset.
    """
    symbols = symbols_of(character_counts(posts))
    n: dict = {name: np.zeros(K ** 3) for name in symbols}
    got = trigram_counts(posts, symbols).toArrow()
    name, cell, count = (got[c] for c in ("dataset", "cell", "n"))
    names = np.array(name.to_pylist(), object)
    for own in symbols:
        mine = np.equal(names, own) if own is not None else np.array([x is None for x in names], bool)
        n[own][cell.to_numpy()[mine]] = count.to_numpy()[mine]
    model = {}
    for own, table in n.items():
        bits = surprise(table)
        mean = (table * bits).sum() / table.sum()
        model[own] = (symbols[own], bits, float(np.sqrt((table * (bits - mean) ** 2).sum() / table.sum())))
    return model


def with_surprise(posts: DataFrame, model: dict) -> DataFrame:
    """``gen_id, dataset, n_chars, bits, n_starts, start_bits, deviation``: mean bits of all characters, and of those behind white
    space; the deviation of a single character's bits."""
    shared = posts.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                rows = []
                for i, name, text in zip(*(part[c].to_pylist() for c in ("gen_id", "dataset", "text"))):
                    x = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
                    if not len(x):
                        rows.append((i, name, 0, None, 0, None, None))
                        continue
                    symbols, table, deviation = shared.value[name]
                    bits = table[cells(encoder(symbols)(x), [len(x)])]
                    space = (x == 32) | ((x >= 9) & (x <= 13))
                    start = np.concatenate([[False], space[:-1]]) & ~space
                    rows.append((i, name, len(x), float(bits.mean()), int(start.sum()), float(bits[start].mean()) if start.any() else None, deviation))
                c = list(zip(*rows))
                kinds = (part["gen_id"].type, pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(c, kinds)],
                                                 names=["gen_id", "dataset", "n_chars", "bits", "n_starts", "start_bits", "deviation"])

    kind = posts.schema["gen_id"].dataType.simpleString()
    return posts.select("gen_id", "dataset", "text").mapInArrow(
        run, f"gen_id {kind}, dataset string, n_chars long, bits double, n_starts long, start_bits double, deviation double")


def bands(scored: DataFrame, value: str, count: str, least: int) -> DataFrame:
    """``_<value>, <value>_most`` per dataset: the upper quartile plus ``WIDTH`` interquartile spreads of the texts that are
    judged by ``value``, from a histogram of at most ``BINS`` bins."""
    bin_ = F.least(F.floor(F.col(value) / UNIT), F.lit(BINS)).cast("long")
    hist = scored.where(F.col(count) >= least).groupBy("dataset", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy("dataset").orderBy("bin")
    hist = hist.withColumn("share", F.sum("n").over(up) / F.sum("n").over(Window.partitionBy("dataset")))
    q = hist.groupBy("dataset").agg(F.min(F.when(F.col("share") >= 0.25, F.col("bin"))).alias("q1"),
                                    F.min(F.when(F.col("share") >= 0.75, F.col("bin"))).alias("q3"))
    return q.select(F.col("dataset").alias(f"_{value}"),
                    ((F.col("q3") + 1 + WIDTH * (F.col("q3") + 1 - F.col("q1"))) * UNIT).alias(f"{value}_most"))


JUDGED = (("bits", "n_chars", MIN_CHARS), ("start_bits", "n_starts", MIN_STARTS))


def incoherent(posts: DataFrame) -> DataFrame:
    """``gen_id, dataset, n_chars, bits, n_starts, start_bits, reason`` of ``posts (gen_id, dataset, text)``.

    ``reason`` is "garbled" if the bits of a text's characters lie above the band of its dataset, else "disordered" if those of
    its first letters of words do (words in no order: capitals and sentence ends no longer meet), else "ok". The
    bands are those of the corpus itself, from quartiles, so junk below a quarter of a dataset does not set them; a short
    text's mean may lie higher by ``SIGMAS`` of its standard errors. A
    null dataset is a dataset of its own; null, empty and short texts are "ok" here.
    """
    ship_code(posts.sparkSession)
    s = with_surprise(posts, fit(posts))
    j, over = s, []
    for value, count, least in JUDGED:                                                    # one row a dataset each
        j = j.join(F.broadcast(bands(s, value, count, least)), F.col("dataset").eqNullSafe(F.col(f"_{value}")), "left")
        most = F.col(f"{value}_most") + SIGMAS * F.col("deviation") / F.sqrt(F.col(count).cast("double"))
        over.append((F.col(count) >= least) & (F.col(value) > most))
    return j.select("gen_id", "dataset", "n_chars", "bits", "n_starts", "start_bits",
                    F.when(over[0], "garbled").when(over[1], "disordered").otherwise("ok").alias("reason"))
