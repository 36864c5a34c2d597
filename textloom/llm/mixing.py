"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import Scratch, read_table

SEED = "mix-1"
MAX_RATE = 16.0            # largest mean of one draw; a larger mean is the sum of several independent draws
COPY_BLOCK = 1 << 16       # copies of one row that are listed at once
MAX_BROADCAST_SOURCES = 10_000   # up to here the table of sources (at most 7 MB) goes to every executor
HOT = 1000                 # with more sources, those with over 1/HOT of all rows do: at most HOT
BITS = 52                  # uniform numbers on a grid of 2^-52: the same in every engine


def uniform(*parts) -> Column:
    """A number in (0, 1) from the MD5 digest of the parts."""
    digest = F.md5(F.concat_ws("\x1f", *parts).cast("binary"))
    return (F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("double") + 0.5) / float(1 << BITS)


def source_rates(docs: DataFrame, weights: dict | None = None, max_rate: float | None = None) -> DataFrame:
    """``source, rate, n_rows``: the mean repetitions that bring each source's characters to its target weight.

    Sizes are counted over all documents (an empty or null text counts as one character), pre-aggregated per
    task. Without ``weights`` all sources weigh the same; otherwise a missing source weighs 0. A ``max_rate`` cuts
    the means, and sources that it cuts stay below their target; by default there is none.
    """
    sizes = docs.groupBy("source").agg(
        F.sum(F.greatest(F.coalesce(F.length("text"), F.lit(0)), F.lit(1))).alias("size"), F.count(F.lit(1)).alias("n_rows"))
    if weights is None:
        weighted = sizes.withColumn("weight", F.lit(1))
    else:
        chain = F.lit(0.0)
        for name, w in weights.items():
            chain = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(chain)
        weighted = sizes.withColumn("weight", chain)
    totals = weighted.agg(F.sum("size").alias("total"), F.sum("weight").alias("weights"))
    total = totals.select("total").scalar()
    share = totals.select("weights").scalar()
    rate = total.cast("double") * F.col("weight") / (share * F.col("size")).cast("double")
    rate = F.coalesce(rate, F.lit(0.0))
    return weighted.select("source", (rate if max_rate is None else F.least(rate, F.lit(float(max_rate)))).alias("rate"), "n_rows")


def poisson_cdf(rate: Column, max_rate: float) -> Column:
    """Cumulative probabilities of 0, 1, 2 ... repetitions, as far as a 52-bit uniform number can reach."""
    top = math.ceil(max_rate + 12 * math.sqrt(max_rate) + 20)
    first = F.exp(-rate)
    steps = F.aggregate(
        F.sequence(F.lit(1), F.lit(top)),
        F.struct(first.alias("p"), F.array(first).alias("cdf")),
        lambda s, k: F.struct((s["p"] * rate / k).alias("p"),
                              F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + s["p"] * rate / k)).alias("cdf")))
    return steps["cdf"]


def mix_sources(docs: DataFrame, weights: dict | None = None, seed: str = SEED,
                max_rate: float | None = None) -> DataFrame:
    """The columns of ``docs`` and ``copy`` (1, 2, ...): each document as often as a Poisson number says.

    The number inverts the Poisson distribution of mean ``source_rates`` at a uniform number hashed from (seed,
    doc_id): a rerun, another partitioning or a lost executor gives the same rows. A document may get no copy:
    that is the operator's purpose for a source above its target. A mean above ``MAX_RATE`` is drawn as the sum of equal
    independent Poisson numbers of at most that mean, each at a hashed uniform number of its own: a Poisson number
    again, so copies have the same distribution at every mean and every source meets its target however small it is.

    The output is shuffled globally: rows are dealt by a hash of (seed, doc_id, copy, text) and sorted by it within
    partitions, so a hot source or a large document family spreads evenly. The only other exchange is the size
    per source, which is pre-aggregated. Its table is written and counted: up to ``MAX_BROADCAST_SOURCES`` rows it is
    broadcast, so that texts are not dealt by source; beyond, the sources with over 1/``HOT`` of all rows are broadcast (at most
    ``HOT``), and only documents of the others are dealt by source.

    Nulls: a null source is a source of its own; a null ``doc_id`` counts as the text "null"; a null or empty
    text is copied like any other. Repeated rows of one id get the same number each. An empty table gives an
    empty result. A column of ``docs`` named ``copy`` is replaced; all others pass through, whatever their names.
    """
    cols = [c for c in docs.columns if c != "copy"]
    rates = Scratch(docs.sparkSession, "mix").write(source_rates(docs, weights, max_rate), "rates")
    n_sources, n_rows = rates.agg(F.count(F.lit(1)), F.sum("n_rows")).first()
    draws = F.ceil(F.col("rate") / MAX_RATE)
    rates = rates.select(F.col("source").alias("__mix_source"), draws.alias("__mix_draws"), "n_rows",
                         poisson_cdf(F.col("rate") / F.greatest(draws, F.lit(1)), MAX_RATE).alias("__mix_cdf"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    joined = with_rates(docs.select(*[F.col(f"`{c}`") for c in cols]), rates, n_sources, n_rows or 0)

    def drawn(u):
        """How many cumulative probabilities lie below the uniform number."""
        return F.aggregate("__mix_cdf", F.lit(0).cast("long"), lambda n, c: n + (c < u).cast("long"))

    more = F.sequence(F.lit(1).cast("long"), F.col("__mix_draws") - 1)
    more = F.aggregate(more, F.lit(0).cast("long"), lambda n, j: n + drawn(uniform(F.lit(seed), key, j.cast("string"))))
    copies = (F.when(F.col("__mix_draws") < 1, F.lit(0).cast("long")).when(F.col("__mix_draws") < 2, drawn(F.col("__mix_u")))
              .otherwise(drawn(F.col("__mix_u")) + more))
    u = uniform(F.lit(seed), key)
    first = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mix_n"), F.lit(COPY_BLOCK).cast("long")))
    last = F.least(F.col("__mix_n"), F.col("__mix_first") + (COPY_BLOCK - 1))
    rows = (joined.withColumn("__mix_u", u).withColumn("__mix_n", copies).where("__mix_n > 0")
            .withColumn("__mix_first", first)
            .withColumn("copy", F.explode(F.sequence(F.col("__mix_first").cast("int"), last.cast("int"))))
            .withColumn("__mix_order", F.xxhash64(F.lit(seed), key, "copy", "text")))
    return rows.repartition("__mix_order").sortWithinPartitions("__mix_order").select(
        *[F.col(f"`{c}`") for c in cols], "copy")


def with_rates(docs: DataFrame, rates: DataFrame, n_sources: int, n_rows: int) -> DataFrame:
    """``docs`` with the columns of their source's row of ``rates``."""
    same = F.col("source").eqNullSafe(F.col("__mix_source"))
    if n_sources <= MAX_BROADCAST_SOURCES:
        return docs.join(F.broadcast(rates.drop("n_rows")), same, "left")
    hot = F.col("n_rows") > n_rows / HOT
    marked = docs.join(F.broadcast(rates.where(hot).drop("n_rows")), same, "left")
    rest = marked.where("__mix_cdf is null").drop("__mix_source", "__mix_draws", "__mix_cdf")
    return marked.where("__mix_cdf is not null").unionByName(rest.join(rates.where(~hot).drop("n_rows"), same, "left"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources at equal weight, in characters; the total size stays."""
    return mix_sources(read_table(spark, sf_dir, "documents"))


def mix_ctes(docs: str, out: str) -> str:
    """DuckDB CTEs that compute ``mix_sources`` of the relation ``docs`` (all weights equal) as ``out``."""
    top = math.ceil(MAX_RATE + 12 * math.sqrt(MAX_RATE) + 20)
    return f"""
mix_sizes AS (SELECT source, sum(greatest(coalesce(length(text), 0), 1)) AS size FROM {docs} GROUP BY source),
mix_rate AS (SELECT source, (SELECT sum(size) FROM mix_sizes)::DOUBLE
                / ((SELECT count(*) FROM mix_sizes) * size)::DOUBLE AS rate FROM mix_sizes),
mix_rates AS (SELECT source, ceil(rate / {MAX_RATE})::BIGINT AS draws, rate / greatest(ceil(rate / {MAX_RATE}), 1) AS rate FROM mix_rate),
mix_cdf(source, rate, k, p, cdf) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM mix_rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM mix_cdf WHERE k < {top}),
mix_row AS (SELECT d.*, row_number() OVER () AS mix_id, r.draws FROM {docs} d JOIN mix_rates r ON r.source IS NOT DISTINCT FROM d.source),
mix_u AS (SELECT mix_id, source, (('0x' || substr(md5('{SEED}' || chr(31) || coalesce(doc_id::VARCHAR, 'null')
                     || CASE WHEN j = 0 THEN '' ELSE chr(31) || j::VARCHAR END), 1, 13))::BIGINT::DOUBLE + 0.5) / {1 << BITS}.0 AS u
          FROM (SELECT *, unnest(range(draws)) AS j FROM mix_row)),
mix_n AS (SELECT mix_id, count(*) AS n FROM mix_u m JOIN mix_cdf c ON c.source IS NOT DISTINCT FROM m.source AND c.cdf < m.u GROUP BY mix_id),
{out} AS (SELECT doc_id, text, lang, source, n_chars, unnest(range(1, n + 1))::INT AS copy FROM mix_row JOIN mix_n USING (mix_id))"""


OP4_SQL = f"WITH RECURSIVE {mix_ctes('documents', 'mixed').strip()} SELECT * FROM mixed"
