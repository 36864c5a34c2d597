"""Sequence packing by non-negative least squares over a length histogram."""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, Window

from .common import Scratch, blocks, read_table, small, strings, vocab_path

WINDOW = 1024
END = 0                        # closes every document
SPECIAL = "<|endoftext|>"
DEPTH = 3                      # pieces in one combination
BINS, PER_BIN = 512, 100_000   # groups that number the pieces, at least, and pieces that a group may hold on average
BLOCK = 1 << 20                # characters tokenised at once
GRID = 32                      # combinations of three whose two shorter lengths are multiples of it


@cache
def _encoding(path: str):
    """The public byte-level vocabulary as ranks: the same ids as its tokenizers file, at several times the speed."""
    import base64

    import public_tokenizers
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={SPECIAL: len(ranks)})


#: A digest of a piece: column, type, and a function of its ids. CRC-32 of little-endian unsigned 32-bit numbers.
ids_crc32 = ("ids_crc32", "long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))


def cut_pieces(docs: DataFrame, vocab: str | None = None, window: int = WINDOW, digest=None) -> DataFrame:
    """``doc_id, start, length, ids, doc_tokens``: every document's token ids and a closing 0, cut every ``window`` ids.

    With ``digest`` its column takes the place of ``ids``. Full windows stand alone; the last piece is shorter unless the length divides. A map over the table: ids
    stay with their row, and no id is moved.
    """
    path = vocab or vocab_path("byte_bpe_50k.tiktoken")
    rows = docs.select("doc_id", "text")

    def run(batches):
        enc = _encoding(path)
        for batch in small(batches):
            texts = strings(batch["text"])
            for a, b in blocks([len(t) for t in texts], BLOCK):
                at, start, ids, total = [], [], [], []
                for i in range(a, b):
                    own = np.array(enc.encode(texts[i], allowed_special={SPECIAL}) + [END], np.int32)
                    for s in range(0, len(own), window):
                        at.append(i)
                        start.append(s)
                        ids.append(own[s:s + window])
                        total.append(len(own))
                off = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                if digest:
                    content = pa.array([digest[2](x) for x in ids])
                else:
                    content = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(pa.array(at, pa.int64())), pa.array(start, pa.int64()),
                     pa.array(np.diff(off).astype(np.int64)), content, pa.array(total, pa.int64())],
                    names=["doc_id", "start", "length", digest[0] if digest else "ids", "doc_tokens"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    column = f"{digest[0]} {digest[1]}" if digest else "ids array<int>"
    return rows.mapInArrow(run, f"doc_id {kind}, start long, length long, {column}, doc_tokens long")


def combinations(lengths: np.ndarray, window: int = WINDOW) -> list[tuple[int, ...]]:
    """Shallow combinations of present lengths that fill the window exactly: all pairs, triples on a grid."""
    have = set(lengths.tolist())
    found = [(window - a, a) for a in sorted(have) if 2 * a <= window and window - a in have]
    grid = [x for x in sorted(have) if x % GRID == 0 or x in (min(have), max(have))]
    found += [(window - a - b, b, a) for i, a in enumerate(grid) for b in grid[i:]
              if window - a - b >= b and window - a - b in have]
    return found


def solve_counts(histogram: np.ndarray, combos: list[tuple[int, ...]], rounds: int = 400) -> np.ndarray:
    """Non-negative least squares: how often to use each combination so that the lengths used match the histogram.

    Accelerated projected gradient on 0.5 |A x - h|^2 with x >= 0; A holds a combination's lengths in its column.
    Rounded down, and lowered where the histogram has fewer pieces than the rounded combinations want.
    """
    if not combos:
        return np.zeros(0, np.int64)
    row = np.array([x for c in combos for x in c])
    col = np.repeat(np.arange(len(combos)), [len(c) for c in combos])
    size = len(histogram)
    # a bound of |A|^2: the largest row sum times the largest column sum
    step = 1.0 / (np.bincount(row, minlength=size).max() * max(map(len, combos)))
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        off = np.bincount(row, weights=y[col], minlength=size) - histogram
        new = np.maximum(0.0, y - step * np.bincount(col, weights=off[row], minlength=len(combos)))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, y, t = new, new + (t - 1) / t2 * (new - x), t2
    counts, left = np.zeros(len(combos), np.int64), histogram.astype(np.int64).copy()
    for k in np.argsort(-x, kind="stable"):
        need = np.bincount(combos[k], minlength=size)
        most = int((left[need > 0] // need[need > 0]).min())
        counts[k] = min(int(np.floor(x[k] + 1e-6)), most)
        left -= counts[k] * need
    return counts


def pack_histogram(histogram: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) so that every piece of the histogram is used once.

    The least-squares counts come first. The residual pieces are packed greedily: the longest one opens a sequence and
    the longest that still fits joins it, as many times over as the counts allow. The work depends on the window alone.
    """
    left = histogram.astype(np.int64).copy()
    recipes = []
    for combo, n in zip(c := combinations(np.flatnonzero(left), window), solve_counts(left, c)):
        if n:
            recipes.append((combo, int(n)))
            left -= n * np.bincount(combo, minlength=len(left))
    while left.any():
        own, free, need = [], window, np.zeros(len(left), np.int64)
        while free > 0:
            fits = np.flatnonzero(left[:free + 1] > need[:free + 1])
            if not len(fits):
                break
            own.append(int(fits[-1]))
            need[fits[-1]] += 1
            free -= int(fits[-1])
        n = int((left[need > 0] // need[need > 0]).min())
        recipes.append((tuple(own), n))
        left -= n * need
    return recipes


def assign_sequences(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with a ``length``; other columns pass through.

    Full windows get a sequence each. For the others the histogram of lengths (at most ``window`` rows) goes to the
    driver, which solves the recipes; a piece of length L is the r-th of its length, and the running counts
    of L in the recipes say to which repetition of which recipe it belongs. Ranks are taken inside hash
    groups and shifted by the groups' counts, so no task holds all pieces of a common length. ``pieces`` has to be a
    written table with a ``piece`` number per row, so that ranks are the same at every reading.
    """
    spark = pieces.sparkSession
    bins = max(BINS, -(-pieces.count() // PER_BIN))
    group = F.pmod(F.xxhash64("piece"), F.lit(bins)).cast("int")
    grouped = pieces.withColumn("bin", group)
    counts = grouped.groupBy("length", "bin").count()
    # the shift of each (length, bin): a table of at most window x bins rows
    shift = counts.withColumn("before", F.coalesce(F.sum("count").over(
        Window.partitionBy("length").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = (grouped.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bin").orderBy("piece")))
              .join(shift.select("length", "bin", "before"), ["length", "bin"])
              .withColumn("rank", F.col("rank") - 1 + F.col("before")))
    histogram = np.zeros(window, np.int64)
    full = 0
    for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect():
        if r["length"] < window:
            histogram[r["length"]] = r["n"]
        else:
            full = r["n"]
    # per length: the running count of its slots in the recipes, in order
    rows, first = [], full
    used = np.zeros(window, np.int64)
    for combo, n in pack_histogram(histogram, window):
        offset = 0
        for length in combo:
            rows.append((int(length), int(used[length]), int(used[length]) + n, first, offset))
            used[length] += n
            offset += int(length)
        first += n
    slots: dict[int, list] = {}
    for length, lo, hi, seq, offset in rows:
        slots.setdefault(length, []).append((lo, seq, offset))
    # a map-side lookup: at most a few slots per length on average, found by binary search in each batch
    table = spark.sparkContext.broadcast({k: np.array(v, np.int64).T for k, v in slots.items()})
    names = pieces.columns

    def place(batches):
        for batch in batches:
            length = batch["length"].to_numpy(zero_copy_only=False)
            rank = batch["rank"].to_numpy(zero_copy_only=False)
            seq, offset = rank.copy(), np.zeros(len(rank), np.int64)
            for value in np.unique(length[length < window]):
                at = np.flatnonzero(length == value)
                lo, base, off = table.value[int(value)]
                k = np.searchsorted(lo, rank[at], side="right") - 1
                seq[at], offset[at] = base[k] + rank[at] - lo[k], off[k]
            yield pa.RecordBatch.from_arrays([batch[c] for c in names] + [pa.array(seq), pa.array(offset)],
                                             names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.select(*names, F.col("rank").cast("long").alias("rank")).mapInArrow(
        place, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, scratch: Scratch, vocab: str | None = None, window: int = WINDOW, digest=None) -> DataFrame:
    """Packs all documents into sequences of at most ``window`` tokens: one row per piece.

    ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``; with ``digest`` (such as ``ids_crc32``, whose column
    replaces ``ids``) the ids are digested where they were made and never leave the task. Every id lies in exactly one
    piece; pieces of a sequence are gapless from offset 0; sequence ids run from 0 without gaps.

    Null or empty text: the closing 0 alone. Repeated rows and ids: every row is packed. Empty table: empty
    result. A text's ``<|endoftext|>`` is that special token, as in the vocabulary's own encoder. Very long texts
    become many full windows. Other columns are not read.
    """
    cut = cut_pieces(docs, vocab, window, digest).withColumn("piece", F.monotonically_increasing_id())
    return assign_sequences(scratch.write(cut, "pieces"), window).drop("piece")


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), Scratch(spark, "op3"), digest=ids_crc32)
