"""Row numbers and running sums in a global order, without a task that sees a whole group.

Rows are dealt by ranges of (keys, order) and written with their range number. Within a range a window numbers or sums
them; a range's start is the total of the earlier ranges of its group, from a table of one row per group and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.session import hand_off

PART = "_range"


def ranges(df: DataFrame, keys, order, name: str = "ranges") -> DataFrame:
    """``df`` with its range number, written (the number must not change between the two readers)."""
    return hand_off(df.repartitionByRange(*keys, *order).withColumn(PART, F.spark_partition_id()), name)


def prefix_sums(df: DataFrame, keys, order, sums: dict[str, Column], name: str = "ranges") -> DataFrame:
    """``df`` and, per entry of ``sums``, the sum of that expression over the earlier rows of the group (0 for the first).

    ``order`` must be unique within a group: equal rows may be in different ranges.
    """
    keys, order = list(keys), list(order)
    rows = ranges(df, keys, order, name)
    totals = rows.groupBy(*keys, PART).agg(*[F.sum(v).alias(f"_t{i}") for i, v in enumerate(sums.values())])
    earlier = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, PART, *[F.coalesce(F.sum(f"_t{i}").over(earlier), F.lit(0)).alias(f"_s{i}")
                                          for i in range(len(sums))])
    before = Window.partitionBy(*keys, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.select("*", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_o{i}") for i, v in enumerate(sums.values())])
    return own.join(starts, [*keys, PART]).select(
        *df.columns, *[(F.col(f"_s{i}") + F.col(f"_o{i}")).alias(out) for i, out in enumerate(sums)])


def numbered(df: DataFrame, keys, order, out: str = "rank", name: str = "ranges") -> DataFrame:
    """``df`` and the number of each row in its group's order, from 1."""
    d = prefix_sums(df, keys, order, {out: F.lit(1).cast("long")}, name)
    return d.withColumn(out, F.col(out) + 1)
