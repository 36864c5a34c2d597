"""Registered queries of the audit: rule verdicts, judge batches and log, alignment, rates, report."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.config import DEFAULT
from textloom.functions import text as tx
from textloom.operators import coherence
from textloom.operators import generation as gen
from textloom.operators import judge, names, report, rules, sampling
from textloom.plans import sqlparts as S
from textloom.plans.gen_queries import SYNTH
from textloom.session import scratch_path
from textloom.sources import tables as tb


# ---- Spark pipeline -----------------------------------------------------------
def audit_inputs(spark, sf, cfg=DEFAULT):
    """Post-processed generations and their numbered audit sample in batches.

    The sample is chosen by id; only the chosen generations (at most 500 per dataset) are post-processed with their text.
    """
    raw = tb.raw_gen(spark, sf)
    syn = gen.postprocess(tb.raw_texts(spark, sf))
    ids = sampling.threshold_sample_ids(syn, ["dataset"], "gen_id", cfg.judge_sample, cfg.judge_seed, "rn")
    sample = gen.postprocess(raw.join(ids.select("gen_id", "rn"), "gen_id"), keep_post=True)
    return syn, judge.batches(sample, cfg)


def audited(spark, sf, cfg=DEFAULT):
    """The sample with the rule verdicts: every sampled row has both."""
    return judge.with_rule_verdicts(audit_inputs(spark, sf, cfg)[1])


def judged(spark, sf, cfg=DEFAULT):
    """The rule judge's answers through a stored answer log, as answers come (fenced, in prose, cut off, tried again): written as JSON
    text, read back, parsed and aligned with the texts."""
    batched = audit_inputs(spark, sf, cfg)[1]
    path = scratch_path(spark, "judge-log")
    judge.write_log(judge.response_log(judge.clean_responses(judge.with_rule_verdicts(batched))), path)
    parsed = judge.parsed_log(judge.read_log(spark, path))
    first = judge.first_valid(parsed, cfg)
    return {"parsed": parsed, "first": first, "aligned": judge.align(batched, first)}


def rates_df(spark, sf, cfg=DEFAULT):
    return report.judge_rates(audited(spark, sf, cfg), report.totals(gen.postprocess(tb.raw_texts(spark, sf))))


def _types_str(c="pii_types"):
    return F.array_join(c, ", ").alias("pii_types")


_RATE_COLS = ["completeness_rate", "incompleteness_rate", "pii_rate", "clean_rate"]


# ---- queries --------------------------------------------------------------------
def q_completeness_rules(spark, sf):
    r = tb.raw_texts(spark, sf)
    post = gen.strip_post(gen.remove_residue(gen.extract_post(F.col("raw_text"))))
    p = r.select("gen_id", post.alias("post"))
    v = p.select("gen_id", rules.completeness_reason(F.col("post")).alias("reason"))
    return v.withColumn("is_complete", F.col("reason") == "ok")


def q_incoherence_rules(spark, sf):
    """Every document's surprise under its language's character model, and whether it is garbled or disordered."""
    d = tb.table(spark, sf, "documents").select(F.col("doc_id").alias("gen_id"), F.col("lang").alias("dataset"), "text")
    v = coherence.incoherent(d)
    return v.select("gen_id", "dataset", "n_chars", "n_starts", *[F.round(c, 6).alias(c) for c in ("bits", "start_bits")], "reason")


def q_pii_rules(spark, sf):
    d = rules.with_pii(tb.table(spark, sf, "documents").select("doc_id", "text"))
    return d.select("doc_id", "has_pii", F.array_join("pii_types", ", ").alias("pii_types"), "pii_details")


def q_name_spans(spark, sf):
    """Full names found in every text of a table with marked names, by a labeller trained on four fifths of it."""
    d = tb.marked_names(spark, sf)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = names.with_names(d, names.fit(d.where(~held_out)))
    marked = F.coalesce("spans", F.array().cast("array<struct<start: bigint, end: bigint>>"))
    return found.select("doc_id", held_out.alias("held_out"), F.size(marked).cast("long").alias("n_marked"),
                        F.size("names").cast("long").alias("n_found"), names.hits(marked, F.col("names")).alias("n_hit"),
                        F.array_join("names.name", "; ").alias("names"))


def q_judge_batches(spark, sf):
    return judge.batch_texts(audit_inputs(spark, sf)[1])


def q_judge_prompts(spark, sf):
    return judge.judge_prompts(judge.batch_texts(audit_inputs(spark, sf)[1]))


def q_judge_responses(spark, sf):
    """The rule verdicts as the JSON answer of each batch and task."""
    c = judge.clean_responses(audited(spark, sf))
    return c.select("task", "dataset", "batch_no", F.col("clean").alias("raw"))


def q_judge_parse(spark, sf):
    p = judged(spark, sf)["parsed"].filter("ok")
    v = p.select("task", "dataset", "batch_no", "attempt", F.inline("parsed"))
    return v.select("task", "dataset", "batch_no", "attempt", "id", "is_complete", "reason",
                    "has_pii", _types_str(), "pii_details")


def q_judge_first_valid(spark, sf):
    f = judged(spark, sf)["first"]
    return f.select("task", "dataset", "batch_no", "attempt",
                    F.size("parsed").cast("bigint").alias("n_items"))


def q_judge_align(spark, sf):
    a = judged(spark, sf)["aligned"]
    return a.select("dataset", "rn", "batch_no", "id", "gen_id", "is_complete", "reason",
                    "has_pii", _types_str(), "pii_details")


def q_judge_batch_stats(spark, sf):
    f = judged(spark, sf)["first"]
    return report.batch_stats(judge.verdict_rows(f))


def q_judge_rates(spark, sf):
    r = rates_df(spark, sf)
    return r.select(*[F.round(c, 6).alias(c) if c in _RATE_COLS else c for c in r.columns])


def q_dataset_totals(spark, sf):
    return report.totals(gen.postprocess(tb.raw_texts(spark, sf)))


def q_label_distribution(spark, sf):
    b = audit_inputs(spark, sf)[1]
    return b.groupBy("dataset", "label").agg(F.count(F.lit(1)).alias("n"))


def q_flagged_rows(spark, sf):
    f = report.flagged_rows(audited(spark, sf))
    return f.withColumn("pii_types", F.array_join("pii_types", ", "))


def q_flagged_examples(spark, sf):
    return report.flagged_examples(audited(spark, sf))


def q_audit_summary(spark, sf):
    return report.summary_table(rates_df(spark, sf))


SUMMARY_CSV_SCHEMA = T.StructType([
    T.StructField("dataset", T.StringType()), T.StructField("dataset_name", T.StringType()),
    T.StructField("total_rows", T.StringType()), T.StructField("sample_size", T.StringType()),
    T.StructField("complete_sentences", T.StringType()),
    T.StructField("incomplete_sentences", T.StringType()),
    T.StructField("pii_detected", T.StringType())])


def q_summary_parse(spark, sf):
    """Write the formatted summary as CSV, read it back with a declared schema, parse the cells."""
    path = scratch_path(spark, "audit-summary-csv")
    report.summary_table(rates_df(spark, sf)).write.option("header", True) \
        .option("escape", '"').csv(path)
    back = spark.read.schema(SUMMARY_CSV_SCHEMA).option("header", True).option("escape", '"').csv(path)
    return report.parse_summary(back)


def q_realism_table(spark, sf):
    return report.realism_table(rates_df(spark, sf))


def q_flagged_docs_json(spark, sf):
    """One nested document per dataset (totals, both verdict lists, flagged rows), written as JSON and read back flat."""
    a, syn = audited(spark, sf), gen.postprocess(tb.raw_texts(spark, sf))
    flagged = report.flagged_rows(a).withColumn("rn", F.col("index") + 1)
    comp = F.struct("id", "is_complete", "reason")
    pii = F.struct("id", "has_pii", "pii_types", "pii_details")
    per = a.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("sample_size"),
        F.sort_array(F.collect_list(F.struct("rn", comp.alias("v")))).alias("_c"),
        F.sort_array(F.collect_list(F.struct("rn", pii.alias("v")))).alias("_p"))
    fl = flagged.groupBy("dataset").agg(F.sort_array(F.collect_list(F.struct(
        "index", "text", "label", "is_complete", "completeness_reason", "has_pii", "pii_types",
        "pii_details"))).alias("flagged_texts"))
    doc = (per.join(report.totals(syn), "dataset").join(fl, "dataset", "left")
              .select("dataset", "total_rows", "sample_size",
                      F.col("_c.v").alias("completeness_results"), F.col("_p.v").alias("pii_results"),
                      F.coalesce("flagged_texts", F.array()).alias("flagged_texts")))
    path = scratch_path(spark, "audit-json")
    doc.write.json(path)
    back = spark.read.schema(doc.schema).json(path)
    flat = back.select("dataset", "total_rows", "sample_size", F.size("completeness_results").alias("n_completeness"),
                       F.size("pii_results").alias("n_pii"),
                       F.expr("aggregate(completeness_results, 0, (n, x) -> n + int(x.is_complete))").alias("n_complete"),
                       F.inline_outer("flagged_texts"))
    return flat.withColumn("pii_types", F.array_join("pii_types", ", "))


QUERIES = {
    "completeness_rules": q_completeness_rules,
    "pii_rules": q_pii_rules,
    "name_spans": q_name_spans,
    "incoherence_rules": q_incoherence_rules,
    "judge_batches": q_judge_batches,
    "judge_prompts": q_judge_prompts,
    "judge_responses": q_judge_responses,
    "judge_parse": q_judge_parse,
    "judge_first_valid": q_judge_first_valid,
    "judge_align": q_judge_align,
    "judge_batch_stats": q_judge_batch_stats,
    "judge_rates": q_judge_rates,
    "dataset_totals": q_dataset_totals,
    "label_distribution": q_label_distribution,
    "flagged_rows": q_flagged_rows,
    "flagged_examples": q_flagged_examples,
    "audit_summary": q_audit_summary,
    "summary_parse": q_summary_parse,
    "realism_table": q_realism_table,
    "flagged_docs_json": q_flagged_docs_json,
}


# ---- oracle SQL -----------------------------------------------------------------------
def reason_sql(c: str) -> str:
    markup_left = S.strip_ws(f"regexp_replace({c}, {S.q(rules.MARKUP_PATTERN)}, '', 'g')")
    letters = f"length(regexp_replace({c}, {S.q(r'[^\p{L}]')}, '', 'g'))"
    non_ws = f"length(regexp_replace({c}, {S.q(tx.WS)}, '', 'g'))"
    ends = ", ".join(S.q(x) for x in tx.POST_END_CHARS)
    return (f"CASE WHEN {S.word_count(c)} < 3 THEN 'too_short' "
            f"WHEN length({markup_left}) = 0 THEN 'only_markup' "
            f"WHEN {letters} * 2 < {non_ws} THEN 'garbled' "
            f"WHEN regexp_matches({c}, {S.q(rules.FRAGMENT_PATTERN)}) THEN 'fragment_start' "
            f"WHEN right({c}, 1) NOT IN ({ends}) THEN 'abrupt_end' ELSE 'ok' END")


def pii_sql(c: str):
    names = (f"list_filter(regexp_extract_all({c}, {S.q(rules.NAME_PATTERN)}, 1), "
             f"lambda x: x NOT IN ({', '.join(S.q(n) for n in rules.PLACEHOLDER_NAMES)}))")
    phones = f"regexp_extract_all({c}, {S.q(rules.PHONE_PATTERN)}, 0)"
    addrs = f"regexp_extract_all({c}, {S.q(rules.ADDRESS_PATTERN)}, 0)"
    types = (f"list_filter([CASE WHEN len({names}) > 0 THEN 'name' END, "
             f"CASE WHEN len({phones}) > 0 THEN 'phone' END, "
             f"CASE WHEN len({addrs}) > 0 THEN 'address' END], lambda x: x IS NOT NULL)")
    details = f"array_to_string(list_concat(list_concat({names}, {phones}), {addrs}), '; ')"
    return types, details


_PII_TYPES, _PII_DETAILS = pii_sql("text")
_B = DEFAULT.judge_batch
_SLICE_LAST = "(length(raw) - instr(reverse(raw), ']') + 1)"
_SLICED = (f"CASE WHEN instr(raw, '[') > 0 AND instr(reverse(raw), ']') > 0 AND {_SLICE_LAST} > instr(raw, '[') "
           f"THEN substr(raw, instr(raw, '['), {_SLICE_LAST} - instr(raw, '[') + 1) END")
_VSTRUCT = ('\'[{"id":"INTEGER","is_complete":"BOOLEAN","reason":"VARCHAR","has_pii":"BOOLEAN",'
            '"pii_types":["VARCHAR"],"pii_details":"VARCHAR"}]\'')
_FAILED = S.q(judge.FAILED_REASON)
_LINE = f"concat('[Text ', CAST(id AS VARCHAR), ']: ', substr(CAST(text AS VARCHAR), 1, {DEFAULT.truncate_chars}))"

_DSNAME = "CASE dataset " + " ".join(f"WHEN {S.q(k)} THEN {S.q(v)}" for k, v in report.DATASET_NAMES) + " ELSE dataset END"

AUDIT = f"""au_sample AS (
  SELECT * FROM (
    SELECT gen_id, dataset, label, text, post, CAST(row_number() OVER (PARTITION BY dataset
           ORDER BY {S.seeded_hash(DEFAULT.judge_seed, 'gen_id')}, gen_id) AS BIGINT) AS rn
    FROM synthetic) WHERE rn <= {DEFAULT.judge_sample}),
au_batched AS (
  SELECT *, CAST(floor((rn - 1) / {_B}) + 1 AS BIGINT) AS batch_no, CAST((rn - 1) % {_B} + 1 AS INTEGER) AS id
  FROM au_sample),
au_verd AS (
  SELECT *, {reason_sql('post')} AS reason, {reason_sql('post')} = 'ok' AS is_complete,
         {_PII_TYPES} AS pii_types, len({_PII_TYPES}) > 0 AS has_pii, {_PII_DETAILS} AS pii_details
  FROM au_batched),
au_clean AS (
  SELECT 'completeness' AS task, dataset, batch_no,
         CAST(to_json(list({{'id': id, 'is_complete': is_complete, 'reason': reason}} ORDER BY id)) AS VARCHAR) AS clean
  FROM au_verd GROUP BY dataset, batch_no
  UNION ALL
  SELECT 'pii' AS task, dataset, batch_no,
         CAST(to_json(list({{'id': id, 'has_pii': has_pii, 'pii_types': pii_types, 'pii_details': pii_details}} ORDER BY id)) AS VARCHAR)
  FROM au_verd GROUP BY dataset, batch_no),
au_log AS (
  SELECT task, dataset, batch_no, 1 AS attempt,
         CASE batch_no % 4 WHEN 0 THEN clean
              WHEN 1 THEN concat('```json', chr(10), clean, chr(10), '```')
              WHEN 2 THEN concat('Here: ', clean, ' done')
              ELSE substr(clean, 1, length(clean) - 1) END AS raw
  FROM au_clean
  UNION ALL
  SELECT task, dataset, batch_no, 2 AS attempt, 'sorry' AS raw FROM au_clean WHERE batch_no % 4 = 3
  UNION ALL
  SELECT task, dataset, batch_no, 3 AS attempt,
         CASE WHEN batch_no % 8 = 3 THEN clean ELSE substr(clean, 1, length(clean) - 1) END AS raw
  FROM au_clean WHERE batch_no % 4 = 3),
au_parsed AS (
  SELECT task, dataset, batch_no, attempt, raw,
         coalesce(try(from_json(CASE WHEN json_valid(raw) THEN raw END, {_VSTRUCT})),
                  try(from_json(CASE WHEN json_valid(sliced) THEN sliced END, {_VSTRUCT}))) AS parsed
  FROM (SELECT *, {_SLICED} AS sliced FROM au_log)),
au_ok AS (SELECT *, parsed IS NOT NULL AS ok FROM au_parsed),
au_first AS (
  SELECT task, dataset, batch_no, min(attempt) AS attempt, arg_min(parsed, attempt) AS parsed
  FROM au_ok WHERE ok AND attempt <= {DEFAULT.judge_retries} GROUP BY task, dataset, batch_no),
au_vrows AS (
  SELECT task, dataset, batch_no, attempt, v.id, v.is_complete, v.reason, v.has_pii, v.pii_types, v.pii_details
  FROM (SELECT *, unnest(parsed) AS v FROM au_first)),
au_aligned AS (
  SELECT b.dataset, b.rn, b.batch_no, b.id, b.gen_id, b.label, b.text,
         c.is_complete, CASE WHEN c.id IS NULL THEN {_FAILED} ELSE c.reason END AS reason,
         p.has_pii, CASE WHEN p.id IS NULL THEN []::VARCHAR[] ELSE coalesce(p.pii_types, []::VARCHAR[]) END AS pii_types,
         CASE WHEN p.id IS NULL THEN {_FAILED} ELSE p.pii_details END AS pii_details
  FROM au_batched b
  LEFT JOIN (SELECT * FROM au_vrows WHERE task = 'completeness') c
    ON b.dataset = c.dataset AND b.batch_no = c.batch_no AND b.id = c.id
  LEFT JOIN (SELECT * FROM au_vrows WHERE task = 'pii') p
    ON b.dataset = p.dataset AND b.batch_no = p.batch_no AND b.id = p.id),
au_totals AS (SELECT dataset, count(*) AS total_rows FROM synthetic GROUP BY dataset),
au_counts AS (
  SELECT dataset, count(*) AS sample_size,
         count(*) FILTER (WHERE is_complete) AS complete_count,
         count(*) FILTER (WHERE NOT is_complete) AS incomplete_count,
         count(*) FILTER (WHERE is_complete IS NULL) AS failed_count,
         count(*) FILTER (WHERE has_pii) AS pii_count,
         count(*) FILTER (WHERE NOT has_pii) AS no_pii_count,
         count(*) FILTER (WHERE has_pii IS NULL) AS pii_failed
  FROM au_verd GROUP BY dataset),
au_rates AS (
  SELECT c.*, complete_count + incomplete_count AS valid_total,
         CASE WHEN complete_count + incomplete_count > 0
              THEN complete_count / (complete_count + incomplete_count) * 100 ELSE 0.0 END AS completeness_rate,
         pii_count + no_pii_count AS pii_valid_total,
         CASE WHEN pii_count + no_pii_count > 0
              THEN pii_count / (pii_count + no_pii_count) * 100 ELSE 0.0 END AS pii_rate,
         t.total_rows
  FROM au_counts c JOIN au_totals t USING (dataset)),
au_summary AS (
  SELECT dataset, {_DSNAME} AS dataset_name, format('{{:,}}', total_rows) AS total_rows,
         sample_size,
         concat(complete_count, '/', valid_total, ' (', format('{{:.1f}}', completeness_rate), '%)') AS complete_sentences,
         incomplete_count AS incomplete_sentences,
         concat(pii_count, '/', pii_valid_total, ' (', format('{{:.1f}}', pii_rate), '%)') AS pii_detected
  FROM au_rates)"""


_BASE = [S.POSTS, S.RAW_GEN, SYNTH, AUDIT]
_W = S.with_
_EXTRACT_POST = ("CASE WHEN instr(raw_text, '<post>') > 0 THEN regexp_extract(raw_text, "
                 + S.q(gen.POST_PATTERN) + ", 1) ELSE raw_text END")
_RESIDUE = "x"
for _tok in tx.RESIDUE_TOKENS:
    _RESIDUE = f"replace({_RESIDUE}, {S.q(_tok)}, '')"
_POST = S.strip_ws(f"regexp_replace({S.strip_ws(_RESIDUE)}, '^\"+|\"+$', '', 'g')")
_R6 = ", ".join(f"round({c}, 6) AS {c}" for c in _RATE_COLS)

ORACLE = {
    "completeness_rules": _W(S.POSTS, S.RAW_GEN) + f"""SELECT gen_id, {reason_sql('post')} AS reason,
        {reason_sql('post')} = 'ok' AS is_complete
        FROM (SELECT gen_id, {_POST} AS post FROM (SELECT gen_id, {_EXTRACT_POST} AS x FROM raw_gen))""",
    "pii_rules": f"""SELECT doc_id, len({_PII_TYPES}) > 0 AS has_pii, array_to_string({_PII_TYPES}, ', ') AS pii_types,
        {_PII_DETAILS} AS pii_details FROM documents""",
    "judge_batches": _W(*_BASE) + f"""SELECT dataset, batch_no, CAST(count(*) AS BIGINT) AS n_texts,
        string_agg({_LINE}, chr(10) || chr(10) ORDER BY id) AS batch_text
        FROM au_batched GROUP BY dataset, batch_no""",
    "judge_prompts": _W(*_BASE) + f"""SELECT t.task, dataset, batch_no, concat(t.head, batch_text, {S.q(judge.PROMPT_TAIL)}) AS prompt
        FROM (SELECT dataset, batch_no, string_agg({_LINE}, chr(10) || chr(10) ORDER BY id) AS batch_text
              FROM au_batched GROUP BY dataset, batch_no) b,
             (VALUES ('completeness', {S.q(judge.COMPLETENESS_HEAD)}), ('pii', {S.q(judge.PII_HEAD)})) t(task, head)""",
    "judge_responses": _W(*_BASE) + "SELECT task, dataset, batch_no, clean AS raw FROM au_clean",
    "judge_parse": _W(*_BASE) + """SELECT task, dataset, batch_no, attempt, v.id, v.is_complete, v.reason, v.has_pii,
        array_to_string(v.pii_types, ', ') AS pii_types, v.pii_details
        FROM (SELECT *, unnest(parsed) AS v FROM au_ok WHERE ok)""",
    "judge_first_valid": _W(*_BASE) + """SELECT task, dataset, batch_no, attempt, CAST(len(parsed) AS BIGINT) AS n_items
        FROM au_first""",
    "judge_align": _W(*_BASE) + """SELECT dataset, rn, batch_no, id, gen_id, is_complete, reason, has_pii,
        array_to_string(pii_types, ', ') AS pii_types, pii_details FROM au_aligned""",
    "judge_batch_stats": _W(*_BASE) + """SELECT task, dataset, batch_no, count(*) AS n_items,
        count(*) FILTER (WHERE coalesce(CASE WHEN task = 'completeness' THEN is_complete ELSE has_pii END, false)) AS n_true
        FROM au_vrows GROUP BY task, dataset, batch_no""",
    "judge_rates": _W(*_BASE) + """SELECT dataset, sample_size, complete_count, incomplete_count, failed_count,
        pii_count, no_pii_count, pii_failed, valid_total, round(completeness_rate, 6) AS completeness_rate,
        round(100 - completeness_rate, 6) AS incompleteness_rate, pii_valid_total, round(pii_rate, 6) AS pii_rate,
        round(100 - pii_rate, 6) AS clean_rate, total_rows FROM au_rates""",
    "dataset_totals": _W(*_BASE) + "SELECT dataset, total_rows FROM au_totals",
    "label_distribution": _W(*_BASE) + "SELECT dataset, label, count(*) AS n FROM au_batched GROUP BY dataset, label",
    "flagged_rows": _W(*_BASE) + f"""SELECT dataset, rn - 1 AS index, substr(text, 1, {DEFAULT.truncate_chars}) AS text,
        label, is_complete, reason AS completeness_reason, has_pii, array_to_string(pii_types, ', ') AS pii_types,
        pii_details FROM au_verd WHERE is_complete = false OR has_pii = true""",
    "flagged_examples": _W(*_BASE) + f"""SELECT * FROM (
        SELECT dataset, 'incomplete' AS kind, rn, concat(substr(text, 1, {DEFAULT.preview_chars}), '...') AS preview,
               reason AS detail, CAST(NULL AS VARCHAR) AS details,
               CAST(row_number() OVER (PARTITION BY dataset ORDER BY rn) AS BIGINT) AS example_no
        FROM au_verd WHERE is_complete = false
        UNION ALL
        SELECT dataset, 'pii' AS kind, rn, concat(substr(text, 1, {DEFAULT.preview_chars}), '...') AS preview,
               array_to_string(pii_types, ', ') AS detail, pii_details AS details,
               CAST(row_number() OVER (PARTITION BY dataset ORDER BY rn) AS BIGINT) AS example_no
        FROM au_verd WHERE has_pii = true) WHERE example_no <= {DEFAULT.top_flagged}""",
    "flagged_docs_json": _W(*_BASE) + f"""SELECT c.dataset, t.total_rows, c.sample_size,
        c.sample_size AS n_completeness, c.sample_size AS n_pii, c.complete_count AS n_complete, f.* EXCLUDE (ds)
        FROM au_counts c JOIN au_totals t USING (dataset) LEFT JOIN (
          SELECT dataset AS ds, rn - 1 AS index, substr(text, 1, {DEFAULT.truncate_chars}) AS text, label, is_complete,
                 reason AS completeness_reason, has_pii, array_to_string(pii_types, ', ') AS pii_types, pii_details
          FROM au_verd WHERE is_complete = false OR has_pii = true) f ON f.ds = c.dataset""",
    "audit_summary": _W(*_BASE) + "SELECT * FROM au_summary",
    "summary_parse": _W(*_BASE) + """SELECT dataset, total_rows, sample_size, complete_count, valid_total,
        CAST(format('{:.1f}', completeness_rate) AS DOUBLE) AS completeness_rate, incomplete_count,
        pii_count, pii_valid_total, CAST(format('{:.1f}', pii_rate) AS DOUBLE) AS pii_rate FROM au_rates""",
    "realism_table": _W(*_BASE) + f"""SELECT dataset, split_part({_DSNAME}, ' ', 1) AS generator,
        split_part({_DSNAME}, ' ', 2) AS mode, round(completeness_rate, 6) AS completeness_rate,
        round(pii_rate, 6) AS pii_rate FROM au_rates""",
}


# ---- incoherent texts: the character model in SQL --------------------------------------
_K = coherence.K


def _band(value: str, count: str, least: int) -> str:
    return f"""{value}_hist AS (
  SELECT dataset, least(floor({value} / {coherence.UNIT}::DOUBLE), {coherence.BINS}) AS bin, count(*) AS n FROM co_text WHERE {count} >= {least} GROUP BY ALL),
{value}_cum AS (SELECT *, sum(n) OVER (PARTITION BY dataset ORDER BY bin) / sum(n) OVER (PARTITION BY dataset) AS share FROM {value}_hist),
{value}_q AS (SELECT dataset, min(bin) FILTER (share >= 0.25) AS q1, min(bin) FILTER (share >= 0.75) AS q3 FROM {value}_cum GROUP BY dataset),
{value}_band AS (SELECT dataset, (q3 + 1 + {coherence.WIDTH}::DOUBLE * (q3 + 1 - q1)) * {coherence.UNIT}::DOUBLE AS most FROM {value}_q)"""


def _over(value: str, count: str, least: int) -> str:
    return f"{count} >= {least} AND {value} > {value}_band.most + {coherence.SIGMAS}::DOUBLE * deviation / sqrt({count}::DOUBLE)"


ORACLE["incoherence_rules"] = f"""WITH co_char AS (
  SELECT doc_id AS gen_id, lang AS dataset, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i
  FROM documents WHERE length(text) > 0),
co_sym AS (SELECT dataset, c, row_number() OVER (PARTITION BY dataset ORDER BY count(*) DESC, unicode(c)) AS s FROM co_char GROUP BY dataset, c
  QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY count(*) DESC, unicode(c)) <= {coherence.SYMBOLS}),
co_enc AS (SELECT h.*, coalesce(y.s, 0) AS s FROM co_char h LEFT JOIN co_sym y ON y.c = h.c AND y.dataset IS NOT DISTINCT FROM h.dataset),
co_tri AS (SELECT gen_id, dataset, s, c, coalesce(lag(s, 1) OVER w, 0) AS o, coalesce(lag(s, 2) OVER w, 0) AS t, lag(c) OVER w AS pc
  FROM co_enc WINDOW w AS (PARTITION BY gen_id ORDER BY i)),
co_3 AS (SELECT dataset, t, o, s, count(*) AS n FROM co_tri GROUP BY ALL),
co_2 AS (SELECT dataset, o, s, sum(n) AS n FROM co_3 GROUP BY ALL),
co_1 AS (SELECT dataset, s, sum(n) AS n FROM co_2 GROUP BY ALL),
co_1t AS (SELECT dataset, sum(n) AS n, count(*) AS k FROM co_1 GROUP BY ALL),
co_2t AS (SELECT dataset, o, sum(n) AS n, count(*) AS k FROM co_2 GROUP BY ALL),
co_3t AS (SELECT dataset, t, o, sum(n) AS n, count(*) AS k FROM co_3 GROUP BY ALL),
co_p1 AS (SELECT a.dataset, a.s, (a.n + b.k * (1.0::DOUBLE / {_K})) / (b.n + b.k) AS p FROM co_1 a JOIN co_1t b ON a.dataset IS NOT DISTINCT FROM b.dataset),
co_p2 AS (SELECT a.dataset, a.o, a.s, (a.n + b.k * p.p) / (b.n + b.k) AS p FROM co_2 a
  JOIN co_2t b ON a.dataset IS NOT DISTINCT FROM b.dataset AND a.o = b.o JOIN co_p1 p ON a.dataset IS NOT DISTINCT FROM p.dataset AND a.s = p.s),
co_p3 AS (SELECT a.dataset, a.t, a.o, a.s, a.n, -log2((a.n + b.k * p.p) / (b.n + b.k)) AS bits FROM co_3 a
  JOIN co_3t b ON a.dataset IS NOT DISTINCT FROM b.dataset AND a.o = b.o AND a.t = b.t
  JOIN co_p2 p ON a.dataset IS NOT DISTINCT FROM p.dataset AND a.s = p.s AND a.o = p.o),
co_mean AS (SELECT dataset, sum(n * bits) / sum(n) AS m FROM co_p3 GROUP BY ALL),
co_dev AS (SELECT a.dataset, sqrt(sum(n * (bits - m) * (bits - m)) / sum(n)) AS deviation FROM co_p3 a
  JOIN co_mean b ON a.dataset IS NOT DISTINCT FROM b.dataset GROUP BY a.dataset),
co_text AS (
  SELECT x.gen_id, any_value(x.dataset) AS dataset, count(*) AS n_chars, avg(bits) AS bits, count(*) FILTER (st) AS n_starts, avg(bits) FILTER (st) AS start_bits
  FROM (SELECT *, coalesce(pc IN (' ', chr(9), chr(10), chr(11), chr(12), chr(13)), false)
               AND c NOT IN (' ', chr(9), chr(10), chr(11), chr(12), chr(13)) AS st FROM co_tri) x
  JOIN co_p3 p ON x.dataset IS NOT DISTINCT FROM p.dataset AND x.t = p.t AND x.o = p.o AND x.s = p.s GROUP BY x.gen_id),
{", ".join(_band(*j) for j in coherence.JUDGED)}
SELECT d.doc_id AS gen_id, d.lang AS dataset, coalesce(n_chars, 0) AS n_chars, coalesce(n_starts, 0) AS n_starts, round(bits, 6) AS bits,
       round(start_bits, 6) AS start_bits,
       CASE {" ".join(f"WHEN {_over(*j)} THEN '{r}'" for j, r in zip(coherence.JUDGED, ("garbled", "disordered")))} ELSE 'ok' END AS reason
FROM (SELECT doc_id, lang FROM documents) d LEFT JOIN co_text x ON x.gen_id = d.doc_id
LEFT JOIN co_dev ON co_dev.dataset IS NOT DISTINCT FROM d.lang
LEFT JOIN bits_band ON bits_band.dataset IS NOT DISTINCT FROM d.lang
LEFT JOIN start_bits_band ON start_bits_band.dataset IS NOT DISTINCT FROM d.lang"""
