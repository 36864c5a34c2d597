"""Turning raw generator output into labelled posts, and the prompt side of generation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import prompts as pr
from textloom.functions import text as tx

# first <post>...</post> pair; an unclosed tag runs to the end (a final newline excluded)
POST_PATTERN = r"(?s)<post>(.*?)(?:</post>|\n?\z)"


def extract_post(raw):
    """Text inside the first ``<post>`` tag; whole text when there is no tag.

    ``regexp_extract`` returns '' both for no match and for an empty match, so the
    tag is tested first: an empty post stays empty and is dropped later.
    """
    return F.when(F.instr(raw, "<post>") > 0,
                  F.regexp_extract(raw, POST_PATTERN, 1)).otherwise(raw)


def remove_residue(c):
    for tok in tx.RESIDUE_TOKENS:
        c = F.replace(c, F.lit(tok), F.lit(""))
    return c


def strip_post(c):
    """``s.strip().strip('"').strip()``."""
    return tx.strip_ws(tx.strip_chars(tx.strip_ws(c), '"'))


def ends_sentence(c):
    return F.substring(c, -1, 1).isin(*tx.POST_END_CHARS)


def postprocess(raw_df: DataFrame, raw_col: str = "raw_text", keep_post: bool = False, keep_short: bool = False) -> DataFrame:
    """Raw generation -> post text: extract, remove residue, strip, drop < 3 words, add final period.

    Map-only: one projection chain, no shuffle. ``keep_post`` also returns the post
    before the period repair (input of the completeness rules). ``keep_short`` keeps the rows of < 3 words, with a null text.

    The word test goes through a generator (``explode_outer`` of a 0/1-element array)
    instead of a filter: a filter would be pushed below the projection by the
    optimizer and run the whole regex chain a second time for every row.
    """
    keep = [c for c in raw_df.columns if c != raw_col]
    df = raw_df.select(*keep, strip_post(remove_residue(extract_post(F.col(raw_col)))).alias("_post"))
    one = F.when(tx.has_words(F.col("_post"), 3), F.array(F.col("_post")))
    df = df.select(*keep, F.explode_outer(one).alias("_post"))
    df = df if keep_short else df.filter(F.col("_post").isNotNull())
    text = F.when(ends_sentence(F.col("_post")), F.col("_post")) \
            .otherwise(F.concat(F.col("_post"), F.lit(".")))
    extra = [F.col("_post").alias("post")] if keep_post else []
    return df.select(*keep, text.alias("text"), *extra)


def label_join(gen_text: DataFrame, gen_labels: DataFrame, key: str = "gen_id") -> DataFrame:
    """Attach each generation's label by its id (the positional zip, made explicit)."""
    return gen_text.join(gen_labels, key)


def yield_pivot(posts: DataFrame, datasets) -> DataFrame:
    """Kept rows per label (rows) and dataset (columns), and ``other`` for datasets that are not named."""
    named = F.when(F.col("dataset").isin(*datasets), F.col("dataset")).otherwise("other")
    out = posts.withColumn("_d", named).groupBy("label").pivot("_d", [*datasets, "other"]).agg(F.count(F.lit(1)))
    return out.select("label", *[F.coalesce(F.col(d), F.lit(0)).cast("bigint").alias(d)
                                 for d in (*datasets, "other")])


def distinct_labels(df: DataFrame, col: str = "label") -> DataFrame:
    return df.select(col).where(F.col(col).isNotNull()).distinct()


def label_map(train: DataFrame, col: str = "label") -> DataFrame:
    """Sorted distinct labels -> dense id from 0.

    The distinct labels are dealt by ranges; each range is one sorted list, and a label's id is its place in the list behind
    the labels of the earlier ranges (one row per range). No task sees all labels, however many there are.
    """
    labels = distinct_labels(train, col).repartitionByRange(col).withColumn("_range", F.spark_partition_id())
    lists = labels.groupBy("_range").agg(F.sort_array(F.collect_list(col)).alias("_l"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = lists.select("_l", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_s"))
    return (starts.select("_s", F.posexplode("_l").alias("_i", col))
            .select(col, (F.col("_s") + F.col("_i")).cast("int").alias("label_id")))


def label_encode(df: DataFrame, lmap: DataFrame, col: str = "label") -> DataFrame:
    """Label -> id; a label unseen in train gets null.

    The map has one row per class; adaptive execution broadcasts it by its measured bytes, and splits a hot label
    otherwise.
    """
    return df.join(lmap, col, "left")


def zero_shot_prompts(labels: DataFrame) -> DataFrame:
    return labels.select("label", pr.zero_shot(F.col("label")).alias("prompt"))


def few_shot_prompts(draws: DataFrame) -> DataFrame:
    """One prompt per (label, prompt_no) from its example rows (at most k per prompt)."""
    lines = draws.select("label", "prompt_no",
                         F.struct("example_no", pr.example_line(F.col("example_no"), F.col("text"))
                                  .alias("line")).alias("e"))
    grouped = lines.groupBy("label", "prompt_no").agg(F.sort_array(F.collect_list("e")).alias("es"))
    block = F.array_join(F.col("es.line"), pr.EXAMPLE_SEP)
    return grouped.select("label", "prompt_no", pr.few_shot(F.col("label"), block).alias("prompt"))


def wrap_prompts(prompts: DataFrame, models=pr.GENERATOR_MODELS) -> DataFrame:
    """Every prompt in the chat format of every generator model.

    The model list is a literal array exploded per row (no join).
    """
    arr = F.array(*[F.struct(F.lit(g).alias("generator"), F.lit(m).alias("model_id"))
                    for g, m in models])
    out = prompts.withColumn("_m", F.explode(arr))
    return out.select(*prompts.columns, "_m.generator", "_m.model_id").withColumn(
        "prompt", pr.wrap_for_model(F.col("prompt"), F.col("model_id")))
