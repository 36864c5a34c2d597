"""CSV sink and scan with the null conventions of a pandas CSV round trip."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values: strings pandas reads as missing by default ------------------
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
             "nan", "null")
# ----------------------------------------------------------------------------------


ROWS_PER_FILE = 100_000   # the multi-line reader takes a file as one task; ``csvsplit.read_csv`` does not


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: str | None = None,
              rows_per_file: int = ROWS_PER_FILE) -> None:
    """Header, RFC-4180 quoting (quotes doubled), values written as they are (no trimming); files of bounded length (0: of any)."""
    w = (df.write.mode(mode).option("header", True).option("escape", '"').option("maxRecordsPerFile", rows_per_file)
           .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    (w.partitionBy(partition_by) if partition_by else w).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, na_tokens=NA_TOKENS) -> DataFrame:
    """Declared schema, quoted multi-line fields; pandas' NA strings become null in string columns."""
    df = (spark.read.schema(schema).option("header", True).option("multiLine", True)
               .option("escape", '"').csv(path))
    return na_to_null(df, schema, na_tokens)


def na_to_null(df: DataFrame, schema: T.StructType, na_tokens=NA_TOKENS) -> DataFrame:
    """The missing-value strings of the string columns as nulls."""
    out = []
    for f in schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            c = F.when(c.isin(*na_tokens), F.lit(None).cast("string")).otherwise(c)
        out.append(c.alias(f.name))
    return df.select(*out)
