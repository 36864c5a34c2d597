"""The stateless operators on a stream: raw generations arriving as files -> audited posts.

Post-processing (extract, clean, filter, repair) and the rule verdicts are row-local,
so the batch operators run unchanged on ``readStream``; no state, no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.operators import generation as gen
from textloom.operators import rules

RAW_GEN_SCHEMA = T.StructType([
    T.StructField("gen_id", T.LongType()), T.StructField("dataset", T.StringType()),
    T.StructField("label", T.StringType()), T.StructField("raw_text", T.StringType())])


def audited_posts(raw: DataFrame) -> DataFrame:
    """Post-processed rows with their completeness and PII verdicts (batch or streaming input)."""
    posts = gen.postprocess(raw, keep_post=True)
    v = posts.withColumn("reason", rules.completeness_reason(F.col("post")))
    v = v.withColumn("is_complete", F.col("reason") == "ok")
    return rules.with_pii(v, "text").drop("post")


def read_raw_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Parquet files of raw generations as a stream (declared schema, bounded files per batch)."""
    return (spark.readStream.schema(RAW_GEN_SCHEMA).option("maxFilesPerTrigger", max_files)
                 .parquet(path))
