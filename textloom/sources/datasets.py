"""Named multi-dataset scan: one folder per dataset, union with the name as a column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def read_parquet(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_named(spark: SparkSession, named_paths: dict, schema: T.StructType, read=read_parquet) -> DataFrame:
    """Union of all existing dataset folders with a ``dataset`` column; missing ones are skipped.

    Only the folder names are checked on the driver; the rows are read by the executors. ``read`` is the scan of one
    folder, such as ``csvio.read_csv``.
    """
    parts = [read(spark, p, schema).select(F.lit(n).alias("dataset"), "*")
             for n, p in named_paths.items() if path_exists(spark, p)]
    if not parts:
        return spark.createDataFrame([], T.StructType([T.StructField("dataset", T.StringType())]
                                                      + schema.fields))
    return reduce(lambda a, b: a.unionByName(b), parts)
