"""The terms that a feature space keeps: exactly the k most frequent ones, ties broken by the term."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators import ranking

MAX_FEATURES = 200_000     # fixed value of the original pipeline


def top_terms(counts: DataFrame, keys: list[str], k: int = MAX_FEATURES, count: str = "df", term: str = "term") -> DataFrame:
    """The ``k`` rows of ``counts (keys.., term, count)`` with the largest counts per group, all columns.

    The cut-off comes from a histogram of the counts: all rows above it stay, and of those at it the first by term. Nothing
    but the histogram (one row per distinct count) is sorted by count; only the rows at the cut-off are ranked, over ranges.
    """
    keys = list(keys)
    hist = counts.groupBy(*keys, count).agg(F.count(F.lit(1)).alias("_n"))
    down = Window.partitionBy(*keys).orderBy(F.desc(count)).rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("_above", F.coalesce(F.sum("_n").over(down), F.lit(0)))
    edge = hist.where(F.col("_above") < k).groupBy(*keys).agg(
        F.min_by(F.struct(F.col(count).alias("at"), F.col("_n").alias("n"), F.col("_above").alias("above")), count).alias("_e"))
    edge = edge.select(*keys, F.col("_e.at").alias("_at"), F.when(F.col("_e.above") + F.col("_e.n") > k, k - F.col("_e.above")).alias("_need"))
    marked = counts.join(F.broadcast(edge), keys)       # a row a group: no group's terms are dealt to one task
    kept = marked.where((F.col(count) > F.col("_at")) | ((F.col(count) == F.col("_at")) & F.col("_need").isNull()))
    ties = marked.where((F.col(count) == F.col("_at")) & F.col("_need").isNotNull())
    ties = ranking.numbered(ties, keys, [term], "_rank", "vocabulary-ties").where(F.col("_rank") <= F.col("_need"))
    return kept.select(*counts.columns).unionByName(ties.select(*counts.columns))
