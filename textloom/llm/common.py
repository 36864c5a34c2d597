"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import zipfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textloom.session import scratch_path

FOLDS = 5                       # fixed by the contract: crc32(doc_id as text) mod 5
VOCAB_FILES = ("byte_bpe_50k.tiktoken", "piece_bpe_32k.model")


_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, as their Python may not find it otherwise.

    The archive is the driver's own; Spark serves it to the executors. No data goes this way.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="textloom-code-"), "textloom_code.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(top)))
    sc.addPyFile(archive)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vocab_path(name: str) -> str:
    """Default place of a public vocabulary file (every operator takes the path as a parameter)."""
    import public_tokenizers
    return public_tokenizers.path(name)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for rows that no model may learn from; a null id is never learned from either."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def hash_share(fraction, seed: int, *cols: str) -> Column:
    """Keeps a row with probability ``fraction``, decided by a hash of its columns."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 30)) < F.lit(fraction) * float(1 << 30)


class Scratch:
    """Written intermediate tables in the shared checkpoint folder, removable once they are used up."""

    def __init__(self, spark: SparkSession, name: str):
        ship_code(spark)
        self.spark, self.name, self.paths, self.tables = spark, name, {}, {}

    def write(self, df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(self.spark, f"{self.name}-{label}")
        df.write.option("compression", "zstd").parquet(path)
        self.paths[label] = path
        self.tables[label] = self.spark.read.schema(df.schema).parquet(path)
        return self.tables[label]

    def drop(self, *labels: str) -> None:
        """Only for tables that no later, still lazy, step reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for label in labels:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(label))
            path.getFileSystem(conf).delete(path, True)


def small(batches, rows: int = 1024):
    """The batches in slices of so many rows: what is made of a slice in Python is gone before the next one."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the row offsets into them; a null is empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    column = column.cast(pa.large_string()).cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return (np.frombuffer(raw, np.uint8) if raw is not None and len(raw) else np.empty(0, np.uint8)), off


def strings(column: pa.Array) -> list[str]:
    return [x if x is not None else "" for x in column.to_pylist()]


def blocks(lengths, limit: int):
    """Consecutive row ranges whose lengths sum to about ``limit``; a longer row is a range by itself."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def segment_sum(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of ``values[start:end]`` along the first axis; an empty segment gives 0."""
    out = np.zeros((len(starts),) + values.shape[1:], np.float64)
    full = np.flatnonzero(ends > starts)
    if len(full):
        edges = np.stack([starts[full], ends[full]], 1).ravel()
        padded = np.concatenate([values, np.zeros((1,) + values.shape[1:], values.dtype)])
        out[full] = np.add.reduceat(padded, edges, axis=0, dtype=np.float64)[::2]
    return out


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by two blanks, and the start of each text."""
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 2 for t in texts], out=off[1:])
    raw = "  ".join([*texts, ""]).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(raw, np.uint32), off


def utf8_rows(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each row; a null is empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    return column.cast(pa.binary()).to_pylist()


BITSET_BITS = 23                # 1 MB, whatever it holds


def _bit(column: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), column.bitwiseAND(63).cast("int"))


def _word(column: Column) -> Column:
    return F.shiftright(column.bitwiseAND(F.lit((1 << BITSET_BITS) - 1)), 6)


def bitset(hashes: DataFrame, column: str) -> Column:
    """The values of a 64-bit hash column as a set of 2^23 bits: an array of longs in a scalar subquery."""
    marks = hashes.select(_word(F.col(column)).alias("w"), _bit(F.col(column)).alias("b"))
    every = hashes.sparkSession.range(1 << (BITSET_BITS - 6)).select(
        F.col("id").alias("w"), F.lit(0).cast("long").alias("b"))
    words = marks.unionByName(every).groupBy("w").agg(F.bit_or("b").alias("b"))
    return words.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"])).scalar()


def in_bitset(bits: Column, value: Column) -> Column:
    """True for every value put in; for others only if their bit is set by chance."""
    return F.get(bits, _word(value).cast("int")).bitwiseAND(_bit(value)) != 0
