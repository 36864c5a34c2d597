"""Document fingerprints (I-Match): hashed random subsets of a lexicon from an inverse-document-frequency band."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import Scratch, bitset, in_bitset, read_table

LOW_SHARE, HIGH_SHARE = 1 / 5000, 1 / 20    # document frequency of a lexicon term, as a share of all documents
DRAWS = 10                                  # random subsets per rate
STEP = 6                                    # hash bits from one draw to the next
LEVELS = 5                                  # rates 1/4, 1/16 ... 1/1024
LEVEL_BITS = 2
NO_ID = -(1 << 63)                          # key of rows without an id; such an id itself is not supported
NO_TERM = 0                                 # the hash of a subset without terms


def terms(text: Column) -> Column:
    """Distinct lower-cased words (letters and digits) of a text."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), "")


def lexicon(docs: DataFrame, low: float = LOW_SHARE, high: float = HIGH_SHARE) -> Column:
    """The terms whose document frequency lies in the band, as a bit set of term hashes (a scalar subquery).

    Frequencies count all documents and are pre-aggregated per task under 64-bit hashes. A term outside the band whose
    hash meets a set bit joins the lexicon; it does so for every document, so equal texts stay equal.
    """
    n = docs.agg(F.count("*").alias("n")).scalar()
    df = docs.select(F.explode(terms(F.col("text"))).alias("t")).groupBy(F.xxhash64("t").alias("h")).count()
    band = df.where((F.col("count") >= n * low) & (F.col("count") <= F.greatest(n * high, F.lit(2.0))))
    return bitset(band, "h")


def with_fingerprint(df: DataFrame, text: str, name: str, bitmap: Column) -> DataFrame:
    """Adds ``name``: a 32-bit hash per (rate, draw), 0 for a subset that holds no term of the text.

    A term's 64 hash bits decide its subsets: draw j looks at bits 6 j and up, and a lower rate asks for two more zero
    bits. The distinct lexicon terms are sorted by hash and each subset is hashed as a whole. A text
    without lexicon terms is hashed by all its terms, in two numbers.
    """
    h, kept = f"__{name}_all", f"__{name}_0"
    df = df.withColumn("__bitmap", bitmap)
    df = df.withColumn(h, F.transform(terms(F.col(text)), lambda t: F.xxhash64(t)))
    df = df.withColumn(kept, F.array_sort(F.filter(h, lambda x: in_bitset(F.col("__bitmap"), x))))
    marks = []
    for level in range(1, LEVELS + 1):
        now, mask = f"__{name}_{level}", (1 << (LEVEL_BITS * level)) - 1
        if level == 1:
            df = df.withColumn(now, F.expr(
                f"transform(sequence(0, {DRAWS - 1}), j -> filter({kept}, x -> (shiftright(x, {STEP} * j) & {mask}L) = 0L))"))
        else:
            df = df.withColumn(now, F.expr(
                f"transform(__{name}_{level - 1}, (a, j) -> filter(a, x -> (shiftright(x, {STEP} * j) & {mask}L) = 0L))"))
        marks.append(F.expr(f"transform({now}, a -> if(size(a) = 0, {NO_TERM}, hash(a) | 1))"))
    fallback = F.expr(f"array(hash(array_sort({h})), hash(xxhash64(array_sort({h}))))")
    return df.withColumn(name, F.when(F.size(kept) == 0, fallback).otherwise(F.concat(*marks))).drop(
        h, kept, "__bitmap", *[f"__{name}_{k}" for k in range(1, LEVELS + 1)])


def likeness(a: str, b: str) -> Column:
    """0 to 1: the best share of equal subsets among the rates at which at least half the subsets hold a term.

    Fingerprints of all terms (no lexicon term in the text) are alike only if equal.
    """
    level = (f"transform(sequence(0, {LEVELS - 1}), s -> named_struct("
             f"'held', size(filter(sequence(1, {DRAWS}), j -> get({a}, s * {DRAWS} + j - 1) != {NO_TERM} "
             f"or get({b}, s * {DRAWS} + j - 1) != {NO_TERM})), "
             f"'same', size(filter(sequence(1, {DRAWS}), j -> get({a}, s * {DRAWS} + j - 1) != {NO_TERM} "
             f"and get({a}, s * {DRAWS} + j - 1) = get({b}, s * {DRAWS} + j - 1)))))")
    best = f"array_max(transform({level}, x -> if(x.held * 2 >= {DRAWS}, x.same / x.held, 0D)))"
    return (F.when(F.col(a) == F.col(b), F.lit(1.0))
            .when((F.size(a) == 2) | (F.size(b) == 2), F.lit(0.0)).otherwise(F.expr(best)))


def as_text(name: str) -> Column:
    """The numbers as one string of hexadecimal digits."""
    return F.array_join(F.transform(name, lambda x: F.lower(F.lpad(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


def next_documents(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id, next_id, need``: the next smaller id (after the smallest: the largest), and a third of the length.

    Ids and lengths alone are dealt by id range and written; the next id is found inside a range, and for a range's last
    row in a table of one row per range.
    """
    spark = docs.sparkSession
    ids = (docs.where("doc_id IS NOT NULL").groupBy("doc_id")
           .agg(F.max(F.floor(F.coalesce(F.length("text"), F.lit(0)) / 3)).cast("int").alias("need")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = scratch.write(ids.repartitionByRange(parts, "doc_id").withColumn("part", F.spark_partition_id()), "ids")
    tops = ranged.groupBy("part").agg(F.max("doc_id").alias("top"))
    lower = tops.select("part", F.lag("top").over(Window.orderBy("part")).alias("lower_top"))
    largest = ranged.agg(F.max("doc_id").alias("m")).scalar()
    inside = F.lead("doc_id").over(Window.partitionBy("part").orderBy(F.desc("doc_id")))
    return (ranged.withColumn("inside", inside).join(lower, "part")
            .select("doc_id", F.coalesce("inside", "lower_top", largest).alias("next_id"), "need"))


def edited_texts(docs: DataFrame, following: DataFrame) -> DataFrame:
    """Documents with ``edited``: the last third replaced by as many first characters of the next document.

    A document ships only the prefix that its receiver needs.
    """
    givers = docs.select(F.col("k").alias("next_id"), "text")
    given = (following.join(givers, "next_id")
             .select(F.col("doc_id").alias("k"), "next_id", F.expr("substring(text, 1, need)").alias("prefix")))
    # an id that repeats gives several prefixes: the first one is that of its first text
    first = F.row_number().over(Window.partitionBy("k").orderBy("prefix"))
    given = given.withColumn("copy", first).where("copy = 1").drop("copy")
    n, cut = F.length("text"), F.expr("cast(floor(length(text) / 3) as int)")
    return (docs.join(given, "k", "left").withColumn("n_chars", n.cast("long"))
            .withColumn("edited", F.concat(
                F.substring("text", F.lit(1), n - cut), F.coalesce(F.substring("prefix", F.lit(1), cut), F.lit("")))))


def fingerprints(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    Ids are integers (the next document is one in their order); an id that cannot be cast to a long is an error. Null text
    counts as empty; an empty text has the fingerprint of no terms. A null id stands outside the order: its
    last third is dropped, and ``near_next`` is 0. Rows that repeat an id give a row each; the next document is the next
    different id, the alphabetically first text where that id repeats. Empty table: empty result.
    Other columns are not read.
    """
    # a key without nulls and nothing but the text next to it: both uses of the texts by key share one exchange
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k"),
                       F.coalesce("text", F.lit("")).alias("text"))
    id_or_null = F.when(F.col("k") != NO_ID, F.col("k")).alias("doc_id")
    following = scratch.write(next_documents(docs, scratch), "next")
    bitmap = lexicon(rows)
    both = with_fingerprint(edited_texts(rows, following), "text", "own", bitmap)
    both = with_fingerprint(both, "edited", "changed", bitmap)
    done = scratch.write(both.select(id_or_null, "next_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                                     "own", "changed", F.xxhash64("text").alias("of")), "done")
    first = (done.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id").orderBy("of")))
             .where("copy = 1").select(F.col("doc_id").alias("next_id"), F.col("own").alias("next_own")))
    return (done.join(first, "next_id", "left")
            .select("doc_id", "n_chars", "edited_sha256",
                    as_text("own").alias("fingerprint"), as_text("changed").alias("edited_fingerprint"),
                    likeness("own", "changed").alias("near_edited"),
                    F.coalesce(likeness("own", "next_own"), F.lit(0.0)).alias("near_next")))


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read_table(spark, sf_dir, "documents"), Scratch(spark, "op8"))
