"""Audit batches, judge prompts, the judge response log and its parsing and alignment.

All per-batch collections are bounded by the batch size (50); per-dataset ones by
the sample size (500). Nothing grows with the full table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.config import DEFAULT, Config
from textloom.operators import rules

# ---- fixed values: judge prompt texts (rendered, i.e. with single braces) ------
COMPLETENESS_HEAD = (
    "\nYou are an expert linguist evaluating synthetic text data quality.\n"
    "\n"
    "Analyse each of the following texts and determine whether it is a COMPLETE, "
    "well-formed sentence or passage.\n"
    "\n"
    "A text is considered INCOMPLETE if it:\n"
    "- Ends abruptly mid-sentence or mid-word\n"
    "- Starts with a fragment that doesn't form a complete thought\n"
    "- Contains only metadata, tags, or instructions (not actual content)\n"
    "- Is garbled or incoherent\n"
    "\n"
    "A text is considered COMPLETE if it:\n"
    "- Contains at least one full sentence with a subject and predicate\n"
    "- Expresses a complete thought, even if informal (social media style is acceptable)\n"
    "- May contain minor grammar issues but is still understandable\n"
    "\n"
    "For each text, respond in this exact JSON format:\n"
    "[\n"
    '  {"id": 1, "is_complete": true, "reason": "brief explanation"},\n'
    '  {"id": 2, "is_complete": false, "reason": "brief explanation"}\n'
    "]\n"
    "\n"
    "Here are the texts to evaluate:\n"
    "\n")
PII_HEAD = (
    "\nYou are a privacy expert evaluating synthetic text data for personal information leakage.\n"
    "\n"
    "Analyse each of the following texts and check whether it contains any real-looking "
    "personal identifiable information (PII):\n"
    "\n"
    "1. NAMES: Full names that appear to be real people's names (not generic references "
    "like \"my friend\" or \"someone\")\n"
    "2. PHONE NUMBERS: Any sequence that looks like a phone number (e.g., 555-1234, "
    "+1-800-123-4567, (123) 456-7890)\n"
    "3. ADDRESSES: Physical addresses including street names, house numbers, city names "
    "with zip codes, etc.\n"
    "\n"
    "IMPORTANT: Only flag information that looks like REAL, SPECIFIC personal data. Do NOT flag:\n"
    "- Generic first names used in examples (e.g., \"my friend John said...\")\n"
    "- Clearly fictional or placeholder names (e.g. \"John Doe\")\n"
    "- City/country names used in general context (e.g., \"I live in New York\" is fine, "
    "but \"123 Main St, New York, NY 10001\" is PII)\n"
    "\n"
    "For each text, respond in this exact JSON format:\n"
    "[\n"
    '  {"id": 1, "has_pii": false, "pii_types": [], "pii_details": ""},\n'
    '  {"id": 2, "has_pii": true, "pii_types": ["name", "phone"], "pii_details": '
    "\"Found full name 'John Smith' and phone number '555-1234'\"}\n"
    "]\n"
    "\n"
    "Here are the texts to evaluate:\n"
    "\n")
PROMPT_TAIL = "\n"
TEXT_SEP = "\n\n"
FAILED_REASON = "API call failed"
TASKS = ("completeness", "pii")
# --------------------------------------------------------------------------------

VERDICT = T.ArrayType(T.StructType([
    T.StructField("id", T.IntegerType()),
    T.StructField("is_complete", T.BooleanType()),
    T.StructField("reason", T.StringType()),
    T.StructField("has_pii", T.BooleanType()),
    T.StructField("pii_types", T.ArrayType(T.StringType())),
    T.StructField("pii_details", T.StringType()),
]))


def batches(sample: DataFrame, cfg: Config = DEFAULT, rn: str = "rn") -> DataFrame:
    """Sample order -> ``batch_no`` and ``id`` (both from 1) in batches of ``judge_batch``."""
    b = cfg.judge_batch
    return (sample.withColumn("batch_no", (F.floor((F.col(rn) - 1) / b) + 1).cast("bigint"))
                  .withColumn("id", ((F.col(rn) - 1) % b + 1).cast("int")))


def batch_texts(batched: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """``[Text i]: <text cut to 500>`` lines joined by blank lines, one row per batch."""
    line = F.concat(F.lit("[Text "), F.col("id").cast("string"), F.lit("]: "),
                    F.substring(F.col("text").cast("string"), 1, cfg.truncate_chars))
    g = batched.groupBy("dataset", "batch_no").agg(
        F.sort_array(F.collect_list(F.struct("id", line.alias("line")))).alias("_l"))
    return g.select("dataset", "batch_no", F.size("_l").cast("bigint").alias("n_texts"),
                    F.array_join(F.col("_l.line"), TEXT_SEP).alias("batch_text"))


def judge_prompts(texts: DataFrame) -> DataFrame:
    """Both judge prompts for every batch (a literal 2-element array, exploded)."""
    tasks = F.array(F.struct(F.lit("completeness").alias("task"), F.lit(COMPLETENESS_HEAD).alias("head")),
                    F.struct(F.lit("pii").alias("task"), F.lit(PII_HEAD).alias("head")))
    t = texts.withColumn("_t", F.explode(tasks))
    return t.select(F.col("_t.task").alias("task"), "dataset", "batch_no",
                    F.concat(F.col("_t.head"), F.col("batch_text"), F.lit(PROMPT_TAIL)).alias("prompt"))


def with_rule_verdicts(batched: DataFrame, post_col: str = "post", text_col: str = "text") -> DataFrame:
    v = batched.withColumn("reason", rules.completeness_reason(F.col(post_col)))
    v = v.withColumn("is_complete", F.col("reason") == "ok")
    return rules.with_pii(v, text_col)


def clean_responses(verdicts: DataFrame) -> DataFrame:
    """The JSON array a judge would return for each batch and task, ids in order."""
    comp = F.struct("id", "is_complete", "reason")
    pii = F.struct("id", "has_pii", "pii_types", "pii_details")
    g = verdicts.groupBy("dataset", "batch_no").agg(
        F.sort_array(F.collect_list(comp)).alias("_c"), F.sort_array(F.collect_list(pii)).alias("_p"))
    both = F.array(F.struct(F.lit("completeness").alias("task"), F.to_json("_c").alias("clean")),
                   F.struct(F.lit("pii").alias("task"), F.to_json("_p").alias("clean")))
    return g.select("dataset", "batch_no", F.explode(both).alias("_r")) \
            .select(F.col("_r.task").alias("task"), "dataset", "batch_no", F.col("_r.clean").alias("clean"))


def response_log(clean: DataFrame) -> DataFrame:
    """Answers as judges give them, ``task, dataset, batch_no, attempt, raw``, with the failure shapes by ``batch_no % 4``.

    0 clean; 1 fenced; 2 wrapped in prose; 3 cut off, then ``sorry``, then clean when
    ``batch_no % 8 = 3`` else cut off again (a failed batch).
    """
    c = F.col("clean")
    cut = F.expr("substring(clean, 1, length(clean) - 1)")
    m4 = F.col("batch_no") % 4

    def att(n, raw):
        return F.struct(F.lit(n).alias("attempt"), raw.alias("raw"))

    tries = (F.when(m4 == 0, F.array(att(1, c)))
              .when(m4 == 1, F.array(att(1, F.concat(F.lit("```json\n"), c, F.lit("\n```")))))
              .when(m4 == 2, F.array(att(1, F.concat(F.lit("Here: "), c, F.lit(" done")))))
              .otherwise(F.array(att(1, cut), att(2, F.lit("sorry")),
                                 att(3, F.when(F.col("batch_no") % 8 == 3, c).otherwise(cut)))))
    t = clean.select("task", "dataset", "batch_no", F.explode(tries).alias("_a"))
    return t.select("task", "dataset", "batch_no", F.col("_a.attempt").alias("attempt"),
                    F.col("_a.raw").alias("raw"))


LOG = T.StructType([T.StructField("task", T.StringType()), T.StructField("dataset", T.StringType()),
                    T.StructField("batch_no", T.LongType()), T.StructField("attempt", T.IntegerType()),
                    T.StructField("raw", T.StringType())])


def write_log(answers: DataFrame, path: str, attempt: int = 1) -> None:
    """Appends answers ``task, dataset, batch_no, raw`` to the stored log, as JSON lines: of one attempt, or each of its own ``attempt``."""
    number = F.col("attempt") if "attempt" in answers.columns else F.lit(attempt)
    answers.select("task", "dataset", F.col("batch_no").cast("long").alias("batch_no"), number.cast("int").alias("attempt"),
                   "raw").write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A stored answer log: one line per attempt, whatever judge wrote it."""
    return spark.read.schema(LOG).json(path)


def parse_response(raw) -> "F.Column":
    """Whole text as JSON; else the slice from the first ``[`` to the last ``]``; else null."""
    first = F.instr(raw, "[")
    back = F.instr(F.reverse(raw), "]")
    last = F.length(raw) - back + 1
    sliced = F.when((first > 0) & (back > 0) & (last > first),
                    raw.substr(first, last - first + 1))
    return F.coalesce(F.from_json(raw, VERDICT), F.from_json(sliced, VERDICT))


def parsed_log(log: DataFrame) -> DataFrame:
    """Adds ``parsed`` and ``ok``: an answer that cannot be parsed is a failed attempt; an empty array is an answer."""
    p = log.withColumn("parsed", parse_response(F.col("raw")))
    return p.withColumn("ok", F.col("parsed").isNotNull())


def first_valid(parsed: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Per task and batch, the parse of the earliest parseable attempt within the retry budget.

    An empty array ends the retries; its batch has no verdicts and fails (``align`` fills in placeholders).
    """
    ok = parsed.filter(F.col("ok") & (F.col("attempt") <= cfg.judge_retries))
    return ok.groupBy("task", "dataset", "batch_no").agg(
        F.min("attempt").alias("attempt"),
        F.min_by("parsed", "attempt").alias("parsed"))


def verdict_rows(first: DataFrame) -> DataFrame:
    """One row per returned verdict."""
    return first.select("task", "dataset", "batch_no", "attempt", F.inline("parsed"))


def align(batched: DataFrame, first: DataFrame) -> DataFrame:
    """Attach verdicts to sample rows by (dataset, batch_no, id); a failed batch gets placeholders."""
    v = verdict_rows(first)
    comp = v.filter(F.col("task") == "completeness").select(
        "dataset", "batch_no", "id", "is_complete", "reason", F.lit(True).alias("_c"))
    pii = v.filter(F.col("task") == "pii").select(
        "dataset", "batch_no", "id", "has_pii", "pii_types", "pii_details", F.lit(True).alias("_p"))
    keys = ["dataset", "batch_no", "id"]
    j = batched.join(comp, keys, "left").join(pii, keys, "left")
    failed_c = F.col("_c").isNull()
    failed_p = F.col("_p").isNull()
    return (j.withColumn("reason", F.when(failed_c, F.lit(FAILED_REASON)).otherwise(F.col("reason")))
             .withColumn("pii_types", F.when(failed_p, F.array().cast("array<string>"))
                         .otherwise(F.coalesce("pii_types", F.array().cast("array<string>"))))
             .withColumn("pii_details", F.when(failed_p, F.lit(FAILED_REASON)).otherwise(F.col("pii_details")))
             .drop("_c", "_p"))
