"""Scan of large CSV files with quoted line breaks, in splits: many tasks read one file.

A split cannot know whether it begins inside quotes. Each one is therefore read under both assumptions first, which gives a
function from its first state to its last one (outside or inside quotes); the functions of a file are composed in file
order (a prefix scan over one row per split), and a second read cuts the records with the first state known.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.session import ship_code
from textloom.sources.csvio import NA_TOKENS, na_to_null

OUTSIDE, INSIDE = 0, 1
RECORD, HEAD, MIDDLE, TAIL = 0, 1, 2, 3      # a whole record; its end, an inner part and its beginning in different splits


def state_after(line: str, state: int) -> int:
    """Whether quotes are open behind ``line``, which begins outside (at a field) or inside quotes.

    A quote opens only as the first character of a field; a doubled quote inside is text; what follows the closing quote up
    to the comma belongs to the field.
    """
    at = 0
    while True:
        if state == OUTSIDE:
            if line.startswith('"', at):
                at, state = at + 1, INSIDE
                continue
        else:
            while True:
                at = line.find('"', at)
                if at < 0:
                    return INSIDE
                if not line.startswith('""', at):
                    break
                at += 2
            state = OUTSIDE
        at = line.find(",", at) + 1
        if not at:
            return OUTSIDE


def _runs(batch):
    """Consecutive rows of one split: file, start, lines."""
    file, start = batch["file"].to_numpy(), batch["start"].to_numpy()
    if not len(file):
        return
    cuts = [0, *((file[1:] != file[:-1]) | (start[1:] != start[:-1])).nonzero()[0] + 1, len(file)]
    for a, b in zip(cuts, cuts[1:]):
        yield (int(file[a]), int(start[a])), batch["line"].slice(a, b - a)


def _quoted(lines: pa.Array):
    """The lines that have a quote; the others change no state."""
    has = pc.match_substring(lines, '"')
    at = pc.indices_nonzero(has).to_pylist()
    return at, lines.take(pa.array(at, pa.int64())).to_pylist()


def split_functions(lines: DataFrame) -> DataFrame:
    """``file, start, from_outside, from_inside``: the last state of each split under both first states."""
    def run(batches):
        now: dict = {}
        for batch in batches:
            for key, own in _runs(batch):
                a, b = now.get(key, (OUTSIDE, INSIDE))
                for line in _quoted(own)[1]:
                    a, b = (state_after(line, a), state_after(line, b)) if a != b else [state_after(line, a)] * 2
                now[key] = (a, b)
        if now:
            file, start = zip(*now)
            a, b = zip(*now.values())
            yield pa.RecordBatch.from_arrays([pa.array(file, pa.int64()), pa.array(start, pa.int64()), pa.array(a, pa.int32()),
                                              pa.array(b, pa.int32())], names=["file", "start", "from_outside", "from_inside"])

    return lines.mapInArrow(run, "file long, start long, from_outside int, from_inside int")


def split_states(functions: DataFrame) -> DataFrame:
    """``file, start, first, last``: the states at both ends of each split.

    A split either resets the state (both assumptions end alike), keeps it, or exchanges the two. Its last state is that of
    the latest reset, exchanged once for every exchange behind it: two running values over the splits of a file.
    """
    order = Window.partitionBy("file").orderBy("start")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    reset = F.col("from_outside") == F.col("from_inside")
    flips = F.sum((~reset & (F.col("from_outside") == INSIDE)).cast("long")).over(so_far)
    d = functions.withColumn("flips", flips)
    mark = F.last(F.when(reset, F.struct(F.col("from_outside").alias("state"), F.col("flips").alias("at"))), True).over(so_far)
    d = d.withColumn("mark", mark)
    last = F.pmod(F.coalesce("mark.state", F.lit(OUTSIDE)) + F.col("flips") - F.coalesce("mark.at", F.lit(0).cast("long")), F.lit(2))
    d = d.withColumn("last", last.cast("int"))
    return d.select("file", "start", F.coalesce(F.lag("last").over(order), F.lit(OUTSIDE)).alias("first"), "last")


def split_records(lines: DataFrame) -> DataFrame:
    """``file, start, kind, header, record`` of ``lines (file, start, first, line)``: whole records and parts of others.

    ``header``: the record or part begins at the start of its file.
    """
    def run(batches):
        key, open_, kind, state, begun = None, [], RECORD, OUTSIDE, False

        def rest():
            """What a split leaves open at its end."""
            return [(*key, MIDDLE if kind == HEAD else TAIL, key[1] == 0 and not begun and kind == RECORD, "\n".join(open_))]

        for batch in batches:
            row, out = 0, []
            for own_key, own in _runs(batch):
                if own_key != key:
                    if open_:
                        out += rest()
                    key, open_, state, begun = own_key, [], batch["first"][row].as_py(), False
                    kind = HEAD if state == INSIDE else RECORD
                row += len(own)
                quoted = dict(zip(*_quoted(own)))
                for i, line in enumerate(own.to_pylist()):
                    if i in quoted:
                        state = state_after(line, state)
                    open_.append(line)
                    if state == OUTSIDE:
                        out.append((*key, kind, key[1] == 0 and not begun and kind == RECORD, "\n".join(open_)))
                        open_, kind, begun = [], RECORD, True
            if out:
                yield table(out)
        if open_:
            yield table(rest())

    def table(rows):
        file, start, kind, header, record = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(file, pa.int64()), pa.array(start, pa.int64()), pa.array(kind, pa.int32()), pa.array(header, pa.bool_()),
             pa.array(record, pa.string())], names=["file", "start", "kind", "header", "record"])

    return lines.mapInArrow(run, "file long, start long, kind int, header boolean, record string")


def joined_parts(parts: DataFrame) -> DataFrame:
    """``header, record`` of the records that lie in several splits: each is its beginning and all parts up to the next one."""
    order = Window.partitionBy("file").orderBy("start", "kind")
    begin = F.last(F.when(F.col("kind") == TAIL, F.col("start")), True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    # of one split's two parts the end of the earlier record comes before the beginning of the later one: HEAD < TAIL
    own = parts.withColumn("begin", begin)
    pieces = F.array_sort(F.collect_list(F.struct("start", "kind", "record")))
    return own.groupBy("file", "begin").agg(F.max("header").alias("header"), pieces.alias("p")).select(
        "header", F.array_join(F.col("p.record"), "\n").alias("record"))


def csv_records(spark: SparkSession, path) -> DataFrame:
    """``record``: the text of every record of the CSV files below ``path`` but for each file's header, in many tasks a file.

    Broken lines are read as the state says: quotes left open at the end of a file end there. Empty records are left out.
    """
    ship_code(spark)
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.xxhash64(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.col("value").alias("line"))
    # one row (four small numbers) per split of the files: at most 24 MB for 100 TB in splits of 128 MB
    states = F.broadcast(split_states(split_functions(raw)))
    lines = raw.join(states, ["file", "start"])
    whole = split_records(lines.select("file", "start", "first", "line")).where(F.col("kind") == RECORD)
    cut = lines.where((F.col("first") == INSIDE) | (F.col("last") == INSIDE))
    parts = split_records(cut.select("file", "start", "first", "line")).where(F.col("kind") != RECORD)
    every = whole.select("header", "record").unionByName(joined_parts(parts))
    text = F.regexp_replace("record", "\\r\\z", "").alias("record")
    return every.where(~F.col("header")).select(text).where("record <> ''")


def read_csv(spark: SparkSession, path, schema: T.StructType, na_tokens=NA_TOKENS) -> DataFrame:
    """As ``csvio.read_csv`` (header, declared schema, quoted multi-line fields, missing-value strings), but one large file is
    read by as many tasks as it has splits. Fields are parsed by Spark's own CSV parser, record by record."""
    parsed: Column = F.from_csv("record", schema.toDDL(), {"escape": '"'})
    rows = csv_records(spark, path).select(parsed.alias("r")).select("r.*")
    return na_to_null(rows, schema, na_tokens)
