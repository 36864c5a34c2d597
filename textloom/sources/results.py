"""Result files of a sweep: one JSON document per run, baseline at the root, others under temp=*/."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.config import CLASSIFIERS

RESULT_SCHEMA = T.StructType(
    [T.StructField("run_name", T.StringType())]
    + [T.StructField(c, T.MapType(T.StringType(), T.DoubleType())) for c in CLASSIFIERS])


def write_results(maps: DataFrame, root: str) -> None:
    """Baseline rows at the root, sweep rows in ``temp=<t>/`` folders (the original layout)."""
    base = maps.filter(F.col("temp").isNull()).select("run_name", *CLASSIFIERS)
    sweep = maps.filter(F.col("temp").isNotNull()).select("run_name", *CLASSIFIERS, "temp")
    base.write.mode("append").json(root)
    sweep.write.mode("append").partitionBy("temp").json(root)


def scan_results(spark: SparkSession, root: str) -> DataFrame:
    """All result files under ``root``; temperature parsed from the file path.

    Partition discovery would silently skip the root files, so files are listed
    recursively and ``temp`` comes from ``_metadata.file_path``.
    """
    df = (spark.read.schema(RESULT_SCHEMA).option("recursiveFileLookup", True).json(root)
               .select("*", F.col("_metadata.file_path").alias("_path")))
    t = F.regexp_extract("_path", r"/temp=([0-9.]+)/", 1)
    return df.withColumn("temp", F.when(t != "", t.try_cast("double"))).drop("_path")


def write_sweep(posts: DataFrame, root: str, parts=("temp", "generator", "mode")) -> None:
    """Generations partitioned by sweep point: one folder per temperature, generator and mode."""
    posts.write.mode("append").partitionBy(*parts).parquet(root)


def scan_sweep(spark: SparkSession, root: str, schema: T.StructType, temp: float) -> DataFrame:
    """One temperature of a sweep; the filter prunes the other partitions before any file is read."""
    return spark.read.schema(schema).parquet(root).filter(F.col("temp") == F.lit(float(temp)))
