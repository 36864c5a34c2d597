"""Driver tables with explicit schemas, and the views derived from them.

Schemas are declared, never inferred. Each loader returns a lazy DataFrame, so
column pruning and filter pushdown reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS = {
    "documents": T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType())]),
    "labels": T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()),
        T.StructField("toxic", T.IntegerType())]),
    "embeddings": T.StructType([
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType())]),
    "conversations": T.StructType([
        T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]),
    "pages": T.StructType([
        T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType())]),
}

N_CLASSES = 10   # classes of the embeddings table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    schema = SCHEMAS.get(name)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def severity_label(quality, toxic):
    """Four severity labels from the two flags of ``labels``."""
    code = quality * 2 + toxic
    return (F.when(code == 0, "minimum").when(code == 1, "mild")
            .when(code == 2, "moderate").when(code == 3, "severe"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled posts: ``doc_id, dataset, text, label``; unlabelled documents keep a null label."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang").alias("dataset"), "text")
    labs = table(spark, sf_dir, "labels").select(
        "doc_id", severity_label(F.col("quality"), F.col("toxic")).alias("label"))
    return docs.join(labs, "doc_id", "left")


def raw_gen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw generator output for every post, in six shapes, one per ``gen_id % 6``."""
    return raw_shapes(posts(spark, sf_dir))


def raw_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw_gen`` without labels: no join."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("dataset"), "text", F.lit(None).cast("string").alias("label"))
    return raw_shapes(docs).drop("label")


def gen_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``gen_id, label``: the label of every generation; no text is read."""
    ids = table(spark, sf_dir, "documents").select("doc_id")
    labs = table(spark, sf_dir, "labels").select("doc_id", severity_label(F.col("quality"), F.col("toxic")).alias("label"))
    return ids.join(labs, "doc_id", "left").select(F.col("doc_id").alias("gen_id"), F.coalesce("label", F.lit("minimum")).alias("label"))


def raw_shapes(p: DataFrame, carry=()) -> DataFrame:
    """Posts ``doc_id, dataset, label, text`` as raw generator output; ``carry``: columns kept as they are."""
    shape = (F.col("doc_id") % 6).cast("int")
    t = F.col("text")
    raw = (F.when(shape == 0, F.concat(F.lit("Sure! <post>"), t, F.lit("</post> bye")))
           .when(shape == 1, F.concat(F.lit("<post>"), t))
           .when(shape == 2, F.concat(F.lit("User: x Assistant: "), t))
           .when(shape == 3, F.concat(F.lit('"'), t, F.lit('"')))
           .when(shape == 4, F.concat(F.lit("[INST] p [/INST] "), t))
           .otherwise(t))
    return p.select(F.col("doc_id").alias("gen_id"), "dataset",
                    F.coalesce(F.col("label"), F.lit("minimum")).alias("label"),
                    raw.alias("raw_text"), *carry)


# phrases around a mention of two capitalised words: of a person, or of a place, firm or work
PERSON = (("I met ", " at the station."), ("", " told me about it."), ("We called ", " last night."), ("My sister ", " came home."),
          ("There is a letter from ", " for you."), ("", " was born here."))
OTHER = (("I live in ", " now."), ("We drove to ", " by car."), ("They work for ", " as clerks."), ("The road near ", " is closed."),
         ("", " is a large company."), ("Everybody reads ", " these days."))


def marked_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with marked names ``doc_id, text, spans``: documents with a sentence put behind or before their text.

    The sentence mentions two of the document's own words, capitalised; half of the phrases speak of a person. Documents without two
    plain words, and one in eight, stay as they are.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = F.array_distinct(F.regexp_extract_all("text", F.lit("[a-z]{4,}"), 0))
    h = F.xxhash64(F.lit(11), "doc_id")
    d = d.withColumn("w", words).withColumn("h", F.pmod(h, F.lit(1 << 40)))
    phrases = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in (*PERSON, *OTHER)])
    n = F.size("w")
    first = F.initcap(F.get("w", F.pmod("h", n).cast("int")))
    last = F.initcap(F.get("w", F.pmod(F.col("h") + 1 + F.pmod(F.shiftright("h", 9), n - 1), n).cast("int")))
    kind = F.pmod(F.shiftright("h", 20), F.lit(len(PERSON) + len(OTHER))).cast("int")
    made = (n >= 2) & (F.pmod(F.shiftright("h", 5), F.lit(8)) > 0)
    d = d.withColumn("ok", made).withColumn("name", F.when(made, F.concat_ws(" ", first, last))).withColumn("k", kind)
    p = F.get(phrases, F.col("k"))
    d = d.withColumn("s", F.concat(p["a"], "name", p["b"])).withColumn("early", F.pmod(F.shiftright("h", 30), F.lit(2)) == 0)
    start = F.length(p["a"]) + F.when(F.col("early"), 0).otherwise(F.length("text") + 1)
    span = F.struct(start.cast("long").alias("start"), (start + F.length("name")).cast("long").alias("end"))
    none = F.lit(None).cast("array<struct<start: bigint, end: bigint>>")
    return d.select("doc_id", F.when(~F.col("ok"), F.col("text")).when(F.col("early"), F.concat_ws(" ", "s", "text"))
                    .otherwise(F.concat_ws(" ", "text", "s")).alias("text"),
                    F.when(F.col("ok") & (F.col("k") < len(PERSON)), F.array(span)).otherwise(none).alias("spans"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows ``vec_id, label_id, l``: the whole embedding's dot product with each class centroid.

    The centroids (classes x dimensions, averaged over all rows) are one scalar value of the query, so the rows are
    scored in a map without a join.
    """
    e = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("label").alias("label_id"),
        F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    mean = (e.select("label_id", F.posexplode("v").alias("pos", "x"))
             .groupBy("label_id", "pos").agg(F.avg("x").alias("m")))
    center = mean.groupBy("label_id").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("c"))
    centers = center.agg(F.array_sort(F.collect_list(F.struct("label_id", F.col("c.m").alias("m")))).alias("c")) \
                    .select(F.col("c.m")).scalar()
    dot = lambda c: F.aggregate(F.zip_with(c, F.col("v"), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return e.withColumn("_c", centers).select("vec_id", "label_id", F.transform("_c", dot).alias("l"))
