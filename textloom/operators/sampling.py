"""Seeded, deterministic sampling: per-stratum ranks, top-n samples, stratified splits, few-shot draws.

Every random choice is a hash of (seed, key), never ``rand()``: a recomputed task
after an executor loss yields the same rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.config import DEFAULT, Config
from textloom.functions.text import hash_sql, seeded_hash
from textloom.session import hand_off


def bucket_counts(df: DataFrame, strata, id_col: str, seed, digits: int = 3):
    """Rows with their hash ``_h`` and bucket ``_b``, and the small count table per (strata, bucket)."""
    shift = 60 - 4 * digits
    h = df.withColumn("_h", seeded_hash(seed, F.col(id_col))) \
          .withColumn("_b", F.shiftright(F.col("_h"), shift))
    counts = h.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_n"))
    return h, counts


def rank_in_buckets(h: DataFrame, counts: DataFrame, strata, id_col: str, out: str = "rn",
                    attach: DataFrame = None) -> DataFrame:
    """Rank = running count of the lower buckets (window on the small table) + row number in the bucket.

    ``attach`` (one small row per stratum, e.g. split quotas) is joined to the bucket
    table, not to the rows: the rows then take a single join on (strata, bucket), which
    reuses the window's partitioning and never gathers a hot stratum in one task.
    """
    w_off = Window.partitionBy(*strata).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*strata, "_b",
                            F.coalesce(F.sum("_n").over(w_off), F.lit(0)).alias("_off"))
    if attach is not None:
        offsets = offsets.join(attach, list(strata))
    w_in = Window.partitionBy(*strata, "_b").orderBy("_h", id_col)
    ranked = h.withColumn("_r", F.row_number().over(w_in))
    out_df = ranked.join(offsets, [*strata, "_b"])
    return out_df.withColumn(out, (F.col("_off") + F.col("_r")).cast("bigint")) \
                 .drop("_h", "_b", "_r", "_off")


def seeded_rank(df: DataFrame, strata, id_col: str, seed, out: str = "rn",
                digits: int = 3) -> DataFrame:
    """Dense 1-based rank inside each stratum, ordered by ``(hash(seed|id), id)``.

    Equal to ``row_number() over (partition by strata order by h, id)`` but a stratum
    holding a third of all rows is not sorted by one task: rows are spread over
    ``16**digits`` hash buckets per stratum, counted per bucket, and each row's
    rank is the bucket's running offset plus its position inside the bucket. The
    bucket table has at most strata x 4096 rows; the join back to it is
    broadcast by AQE only when its measured size is under the threshold.
    """
    strata = list(strata)
    h, counts = bucket_counts(df, strata, id_col, seed, digits)
    return rank_in_buckets(h, counts, strata, id_col, out)


SAMPLE_BUCKETS = 64
HASH_RANGE = 1 << 60       # seeded_hash is below


def _same(strata, left: str, right: str):
    """Equal strata, null ones too."""
    both = [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in strata]
    out = both[0]
    for c in both[1:]:
        out = out & c
    return out


def threshold_sample_ids(df: DataFrame, strata, id_col: str, n: int, seed, out: str = "rn") -> DataFrame:
    """``strata.., id_col, out`` as ``sample_ids``, from the rows below a cut-off hash only.

    The size of a stratum is counted, and its cut-off lets about ``n + 6 sqrt(n)`` rows through: so many leave the maps in all,
    however many tasks or rows there are. A stratum with too few of them (one in a thousand million, or ids that
    repeat) is numbered from all its rows by ``sample_ids``: the result is exact. Ids and hashes are written first, as
    they are read for the sizes, the candidates and the rest.
    """
    strata = list(strata)
    ids = hand_off(df.select(*strata, id_col).withColumn("_h", seeded_hash(seed, F.col(id_col))), "sample-ids")
    sizes = ids.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    share = F.lit(n + 6 * math.sqrt(n)) / F.col("_n")
    cuts = sizes.select(*strata, F.least(F.col("_n"), F.lit(n)).alias("_want"),
                        F.when(share >= 1, F.lit(HASH_RANGE)).otherwise((share * float(HASH_RANGE)).cast("long")).alias("_cut"))
    near = (ids.alias("i").join(cuts.alias("c"), _same(strata, "i", "c"))
            .where(F.col("_h") <= F.col("_cut")).select("i.*", "_want"))
    got = near.groupBy(*strata).agg(F.count(F.lit(1)).alias("_got"))
    short = (cuts.alias("c").join(got.alias("g"), _same(strata, "c", "g"), "left")
             .where(F.coalesce("_got", F.lit(0)) < F.col("_want")).select("c.*"))
    order = Window.partitionBy(*strata).orderBy("_h", id_col)
    most = (near.alias("i").join(short.alias("s"), _same(strata, "i", "s"), "left_anti")
            .withColumn(out, F.row_number().over(order).cast("bigint")).where(F.col(out) <= n).select(*strata, id_col, out))
    rest = ids.alias("i").join(short.alias("s"), _same(strata, "i", "s"), "left_semi").drop("_h")
    return most.unionByName(sample_ids(rest, strata, id_col, n, seed, out))


def sample_ids(df: DataFrame, strata, id_col: str, n: int, seed, out: str = "rn") -> DataFrame:
    """``strata.., id_col, out``: ids of a seeded sample of ``min(n, rows)`` rows per stratum, numbered in sample order.

    Two levels of ``row_number() <= n``: inside 64 hash buckets per stratum first, over the whole stratum then.
    The last task of a stratum gets at most 64 x n rows of ids and hashes, however many tasks came before.
    """
    strata = list(strata)
    h = (df.select(*strata, id_col).withColumn("_h", seeded_hash(seed, F.col(id_col)))
           .withColumn("_b", F.pmod(F.xxhash64(id_col), F.lit(SAMPLE_BUCKETS))))
    part = Window.partitionBy(*strata, "_b").orderBy("_h", id_col)
    h = h.withColumn("_p", F.row_number().over(part)).filter(F.col("_p") <= n)
    whole = Window.partitionBy(*strata).orderBy("_h", id_col)
    return (h.withColumn(out, F.row_number().over(whole).cast("bigint"))
             .filter(F.col(out) <= n).select(*strata, id_col, out))


def sample_n(df: DataFrame, strata, id_col: str, n: int, seed, out: str = "rn") -> DataFrame:
    """The sampled rows: ids are chosen first (``threshold_sample_ids``), the other columns of the few chosen rows joined after."""
    ids = threshold_sample_ids(df, strata, id_col, n, seed, out).select(id_col, out)
    return df.join(ids, id_col)


def largest_remainder(counts: DataFrame, key: str, n_col: str, total_draw_col: str,
                      out: str) -> DataFrame:
    """Per-class quota of ``total_draw`` draws proportional to ``n_col`` (integer math).

    floor(draw * n_c / N) per class, leftover seats to the largest remainders,
    ties by class order. ``counts`` holds one row per class (small).
    """
    w_all = Window.partitionBy()
    dec = "decimal(38,0)"   # draw x n_c overflows BIGINT at 10^10 rows
    c = (counts.withColumn("_N", F.sum(n_col).over(w_all).cast(dec))
               .withColumn("_num", F.col(total_draw_col).cast(dec) * F.col(n_col).cast(dec))
               .withColumn("_base", F.expr("_num div _N").cast("bigint"))
               .withColumn("_rem", F.col("_num") - F.col("_base").cast(dec) * F.col("_N")))
    c = c.withColumn("_left", F.col(total_draw_col) - F.sum("_base").over(w_all))
    order = Window.partitionBy().orderBy(F.col("_rem").desc(), F.col(key))
    c = c.withColumn("_pos", F.row_number().over(order))
    c = c.withColumn(out, (F.col("_base") + F.when(
        (F.col("_pos") <= F.col("_left")) & (F.col("_rem") > 0), 1).otherwise(0)).cast("bigint"))
    return c.drop("_N", "_num", "_base", "_rem", "_left", "_pos")


def split_quotas(df: DataFrame, label: str, cfg: Config = DEFAULT, counts: DataFrame = None) -> DataFrame:
    """Train and validation quotas per label for the two stratified splits.

    ``counts`` (one row per label, column ``n_c``) may come from an existing small
    count table; otherwise the labels of ``df`` are counted.
    """
    if counts is None:
        counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    w_all = Window.partitionBy()
    n = F.sum("n_c").over(w_all)
    counts = counts.withColumn("_train_draw", n - F.ceil(F.lit(float(cfg.test_size)) * n))
    q1 = largest_remainder(counts, label, "n_c", "_train_draw", "q_train")
    q1 = q1.withColumn("m_c", F.col("n_c") - F.col("q_train"))
    m = F.sum("m_c").over(w_all)
    q1 = q1.withColumn("_val_draw", m - F.ceil(F.lit(float(cfg.val_size)) * m))
    q2 = largest_remainder(q1, label, "m_c", "_val_draw", "q_val")
    return q2.select(label, "n_c", "q_train", "q_val")


def stratified_split(df: DataFrame, label: str, id_col: str, cfg: Config = DEFAULT) -> DataFrame:
    """Adds ``split`` in train/val/test: exact per-label quotas (test 20 %, then val/test 50/50).

    A row is train when its seeded rank in its label is within the train quota, val when
    its rank among the rest is within the val quota, else test. The label sizes for the
    quotas come from the small bucket-count table of the rank (no extra pass over the rows).
    """
    h, counts = bucket_counts(df, [label], id_col, cfg.split_seed, cfg.rank_bucket_digits)
    sizes = counts.groupBy(label).agg(F.sum("_n").alias("n_c"))
    quotas = split_quotas(df, label, cfg, sizes).select(label, "q_train", "q_val")
    j = rank_in_buckets(h, counts, [label], id_col, "_rank", attach=quotas)
    split = (F.when(F.col("_rank") <= F.col("q_train"), "train")
              .when(F.col("_rank") - F.col("q_train") <= F.col("q_val"), "val")
              .otherwise("test"))
    return j.withColumn("split", split).drop("_rank", "q_train", "q_val")


def floyd_draw_sql(n_col: str, k_col: str, seed, *key_cols: str) -> str:
    """Spark SQL: k distinct positions in 1..n (Floyd's algorithm), in draw order."""
    h = hash_sql(seed, *key_cols, "j")
    return (f"aggregate(sequence(CAST({n_col} - {k_col} + 1 AS BIGINT), CAST({n_col} AS BIGINT)), "
            f"CAST(array() AS ARRAY<BIGINT>), (acc, j) -> CASE "
            f"WHEN array_contains(acc, 1 + pmod({h}, j)) THEN concat(acc, array(j)) "
            f"ELSE concat(acc, array(1 + pmod({h}, j))) END)")


def expand(df: DataFrame, count_col: str, out: str, chunk: int = 10_000) -> DataFrame:
    """One row per ``out`` in 1..count for every input row, generated in parallel.

    A first explode makes chunks of at most ``chunk`` numbers, the chunks are spread
    over all tasks, then each chunk is exploded where it landed; no single task
    generates all rows of a large count.
    """
    chunks = df.filter(F.col(count_col) > 0).withColumn("_c", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.floor((F.col(count_col) - 1) / chunk).cast("bigint"))))
    chunks = chunks.repartition(F.col("_c"), *[F.col(c) for c in df.columns if c != count_col])
    lo = F.col("_c") * chunk + 1
    hi = F.least(F.col("_c") * chunk + chunk, F.col(count_col).cast("bigint"))
    return chunks.withColumn(out, F.explode(F.sequence(lo, hi))).drop("_c")


def few_shot_draws(train: DataFrame, label: str, id_col: str, texts: DataFrame | None = None,
                   cfg: Config = DEFAULT) -> DataFrame:
    """k = min(K, n_label) distinct training rows of the prompt's label, fresh per prompt.

    Returns ``label, prompt_no, example_no, doc_id[, text]`` (one row per example).
    Prompts per label: ``cfg.n_per_label``, whatever the size of the table.
    Ranks are drawn with Floyd's algorithm on a per-prompt hash, then resolved to
    ids with one equi-join on (label, rank); no per-prompt scan of the table. The
    rank and that join carry ids only: the columns of ``texts`` (if given) are
    attached last by id, so the training texts are shuffled once.
    """
    h, counts = bucket_counts(train.select(label, id_col), [label], id_col,
                              cfg.prompt_seed, cfg.rank_bucket_digits)
    ranked = rank_in_buckets(h, counts, [label], id_col, "rank")
    prompts = prompt_keys(train, label, cfg, counts.groupBy(label).agg(F.sum("_n").alias("n_label")))
    draws = prompts.withColumn("_d", F.expr(floyd_draw_sql("n_label", "k", cfg.prompt_seed,
                                                           label, "prompt_no")))
    picks = draws.select(label, "prompt_no",
                         F.posexplode("_d").alias("_pos", "rank"))
    picks = picks.withColumn("example_no", (F.col("_pos") + 1).cast("bigint")).drop("_pos")
    out = picks.join(ranked, [label, "rank"]).select(label, "prompt_no", "example_no", id_col)
    if texts is None:
        return out
    rest = [c for c in texts.columns if c != id_col]
    return out.join(texts, id_col).select(label, "prompt_no", "example_no", id_col, *rest)


def prompt_keys(train: DataFrame, label: str, cfg: Config = DEFAULT, sizes: DataFrame = None) -> DataFrame:
    """One row per prompt: ``label, n_label, k, prompt_no`` (prompts per label as configured)."""
    if sizes is None:
        sizes = train.groupBy(label).agg(F.count(F.lit(1)).alias("n_label"))
    per = F.lit(int(cfg.n_per_label))
    sizes = sizes.withColumn("n_prompts", per.cast("bigint")) \
                 .withColumn("k", F.least(F.lit(cfg.few_shot_k), F.col("n_label")).cast("bigint"))
    return expand(sizes, "n_prompts", "prompt_no")
