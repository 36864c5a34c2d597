"""Audit report: three-valued counts and rates, batch progress, flagged rows, formatted summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.config import DEFAULT, Config

# ---- fixed values: display names of the four audited datasets -------------------
DATASET_NAMES = (("de", "Falcon Few-Shot"), ("en", "Falcon Zero-Shot"),
                 ("es", "LLaMA Few-Shot"), ("fr", "LLaMA Zero-Shot"))
# ---------------------------------------------------------------------------------


def dataset_name(c):
    m = F.create_map(*[F.lit(x) for kv in DATASET_NAMES for x in kv])
    return F.coalesce(m[c], c)


def rate(part, other):
    """``part / (part + other) * 100``; 0 when there is no valid row."""
    return F.coalesce(F.try_divide(part, part + other) * 100, F.lit(0.0))


def judge_rates(aligned: DataFrame, totals: DataFrame) -> DataFrame:
    """Per dataset: true / false / null counts of both verdicts and their rates."""
    c, p = F.col("is_complete"), F.col("has_pii")
    g = aligned.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("sample_size"),
        F.count_if(c).alias("complete_count"),
        F.count_if(~c).alias("incomplete_count"),
        F.count_if(c.isNull()).alias("failed_count"),
        F.count_if(p).alias("pii_count"),
        F.count_if(~p).alias("no_pii_count"),
        F.count_if(p.isNull()).alias("pii_failed"))
    g = (g.withColumn("valid_total", F.col("complete_count") + F.col("incomplete_count"))
          .withColumn("completeness_rate", rate(F.col("complete_count"), F.col("incomplete_count")))
          .withColumn("incompleteness_rate", 100 - F.col("completeness_rate"))
          .withColumn("pii_valid_total", F.col("pii_count") + F.col("no_pii_count"))
          .withColumn("pii_rate", rate(F.col("pii_count"), F.col("no_pii_count")))
          .withColumn("clean_rate", 100 - F.col("pii_rate")))
    return g.join(totals, "dataset")


def totals(posts: DataFrame) -> DataFrame:
    """Rows per dataset (partial counts per task, then one small shuffle)."""
    return posts.groupBy("dataset").agg(F.count(F.lit(1)).alias("total_rows"))


def batch_stats(verdicts: DataFrame) -> DataFrame:
    """Per answered batch: items returned and how many are flagged true (a missing flag is false)."""
    flag = F.when(F.col("task") == "completeness", F.col("is_complete")).otherwise(F.col("has_pii"))
    return verdicts.groupBy("task", "dataset", "batch_no").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count_if(F.coalesce(flag, F.lit(False))).alias("n_true"))


def flagged_rows(aligned: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Incomplete or PII rows (a null verdict flags nothing), zero-based sample index, text cut to 500."""
    f = aligned.filter((F.col("is_complete") == F.lit(False)) | (F.col("has_pii") == F.lit(True)))
    return f.select("dataset", (F.col("rn") - 1).alias("index"),
                    F.substring("text", 1, cfg.truncate_chars).alias("text"), "label",
                    "is_complete", F.col("reason").alias("completeness_reason"),
                    "has_pii", "pii_types", "pii_details")


def flagged_examples(aligned: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """First 3 incomplete and first 3 PII rows per dataset in sample order, with previews."""
    preview = F.concat(F.substring("text", 1, cfg.preview_chars), F.lit("..."))
    w = Window.partitionBy("dataset").orderBy("rn")
    inc = aligned.filter(F.col("is_complete") == F.lit(False)).select(
        "dataset", F.lit("incomplete").alias("kind"), "rn", preview.alias("preview"),
        F.col("reason").alias("detail"), F.lit(None).cast("string").alias("details"))
    pii = aligned.filter(F.col("has_pii") == F.lit(True)).select(
        "dataset", F.lit("pii").alias("kind"), "rn", preview.alias("preview"),
        F.array_join("pii_types", ", ").alias("detail"), F.col("pii_details").alias("details"))
    out = []
    for part in (inc, pii):
        out.append(part.withColumn("example_no", F.row_number().over(w).cast("bigint"))
                       .filter(F.col("example_no") <= cfg.top_flagged))
    return out[0].unionByName(out[1])


def summary_table(rates: DataFrame) -> DataFrame:
    """The formatted summary: thousands separators and ``a/b (r%)`` cells, one decimal."""
    def frac(a, b, r):
        return F.concat(F.col(a).cast("string"), F.lit("/"), F.col(b).cast("string"),
                        F.lit(" ("), F.format_number(F.col(r), 1), F.lit("%)"))
    return rates.select(
        "dataset", dataset_name(F.col("dataset")).alias("dataset_name"),
        F.format_number(F.col("total_rows"), 0).alias("total_rows"),
        F.col("sample_size").cast("bigint").alias("sample_size"),
        frac("complete_count", "valid_total", "completeness_rate").alias("complete_sentences"),
        F.col("incomplete_count").cast("bigint").alias("incomplete_sentences"),
        frac("pii_count", "pii_valid_total", "pii_rate").alias("pii_detected"))


def parse_summary(summary: DataFrame) -> DataFrame:
    """Formatted cells back to numbers (``try_cast``: a bad cell becomes null, not an error)."""
    frac = r"^(\d+)/(\d+) \(([0-9.,]+)%\)$"

    def part(c, i, typ):
        return F.regexp_extract(F.col(c), frac, i).try_cast(typ)
    return summary.select(
        "dataset",
        F.regexp_replace("total_rows", ",", "").try_cast("bigint").alias("total_rows"),
        F.col("sample_size").try_cast("bigint").alias("sample_size"),
        part("complete_sentences", 1, "bigint").alias("complete_count"),
        part("complete_sentences", 2, "bigint").alias("valid_total"),
        F.regexp_replace(F.regexp_extract("complete_sentences", frac, 3), ",", "")
         .try_cast("double").alias("completeness_rate"),
        F.col("incomplete_sentences").try_cast("bigint").alias("incomplete_count"),
        part("pii_detected", 1, "bigint").alias("pii_count"),
        part("pii_detected", 2, "bigint").alias("pii_valid_total"),
        F.regexp_replace(F.regexp_extract("pii_detected", frac, 3), ",", "")
         .try_cast("double").alias("pii_rate"))


def realism_table(rates: DataFrame) -> DataFrame:
    """Rates by generator and mode: the display name split in two."""
    name = dataset_name(F.col("dataset"))
    return rates.select(
        "dataset", F.split_part(name, F.lit(" "), F.lit(1)).alias("generator"),
        F.split_part(name, F.lit(" "), F.lit(2)).alias("mode"),
        F.round("completeness_rate", 6).alias("completeness_rate"),
        F.round("pii_rate", 6).alias("pii_rate"))
