"""Registered queries: splits, label maps, samples, prompts and generation post-processing."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.config import DEFAULT, QUERY_CONFIG
from textloom.functions import prompts as pr
from textloom.functions import text as tx
from textloom.operators import generation as gen
from textloom.operators import prep, sampling
from textloom.plans import sqlparts as S
from textloom.plans.prep_queries import PREPROCESSED
from textloom.sources import tables as tb

DATASETS = ("de", "en", "es", "fr")   # named columns of the yield report; all others count as "other"


# ---- shared Spark inputs ----------------------------------------------------
def synthetic(spark, sf):
    """Post-processed generations: gen_id, dataset, label, text."""
    return gen.postprocess(tb.raw_gen(spark, sf))


def split_ids(spark, sf, cfg=DEFAULT):
    """``doc_id, label, split`` of the prepared posts: no text leaves the scan."""
    return sampling.stratified_split(prep.prepared_ids(tb.posts(spark, sf), cfg), "label", "doc_id", cfg)


def split_texts(spark, sf, cfg=DEFAULT):
    """``doc_id, dataset, label, split, text, text_clean`` of the prepared posts."""
    rows = prep.cleaned(tb.posts(spark, sf), cfg).drop("label")
    return rows.join(split_ids(spark, sf, cfg), "doc_id")


def train_ids(spark, sf, cfg=DEFAULT):
    return split_ids(spark, sf, cfg).filter(F.col("split") == "train").select("doc_id", "label")


def draws(spark, sf, cfg=QUERY_CONFIG, text=True):
    texts = tb.table(spark, sf, "documents").select("doc_id", "text") if text else None
    return sampling.few_shot_draws(train_ids(spark, sf, cfg), "label", "doc_id", texts, cfg)


def prompt_table(spark, sf, cfg=QUERY_CONFIG):
    """Both modes: zero-shot prompts repeated per prompt number, few-shot prompts per draw."""
    few = gen.few_shot_prompts(draws(spark, sf, cfg)).withColumn("mode", F.lit("few-shot"))
    zero_keys = sampling.prompt_keys(train_ids(spark, sf, cfg), "label", cfg).select("label", "prompt_no")
    zero = zero_keys.withColumn("prompt", pr.zero_shot(F.col("label"))) \
                    .withColumn("mode", F.lit("zero-shot"))
    cols = ["mode", "label", "prompt_no", "prompt"]
    return few.select(*cols).unionByName(zero.select(*cols))


# ---- queries ------------------------------------------------------------------
def q_stratified_split(spark, sf):
    return split_ids(spark, sf)


def q_distinct_labels(spark, sf):
    return gen.distinct_labels(train_ids(spark, sf))


def q_label_map(spark, sf):
    return gen.label_map(train_ids(spark, sf))


def q_label_encode(spark, sf):
    s = split_ids(spark, sf)
    lmap = gen.label_map(s.filter(F.col("split") == "train"))
    rest = s.filter(F.col("split") != "train").select("doc_id", "split", "label")
    return gen.label_encode(rest, lmap).select("doc_id", "split", "label", "label_id")


def q_truncate_tokens(spark, sf):
    p = prep.preprocess(tb.posts(spark, sf))
    toks = F.slice(F.split("text_clean", " "), 1, DEFAULT.max_tokens)
    return p.select("doc_id", F.size(toks).cast("bigint").alias("n_tokens"),
                    F.array_join(toks, " ").alias("truncated"))


def q_sample_n(spark, sf):
    syn = synthetic(spark, sf).select("dataset", "gen_id", "label")
    s = sampling.sample_n(syn, ["dataset"], "gen_id", DEFAULT.judge_sample, DEFAULT.judge_seed, "rn")
    return s.select("dataset", "rn", "gen_id", "label")


def q_few_shot_sample(spark, sf):
    return draws(spark, sf, text=False).select("label", "prompt_no", "example_no", "doc_id")


def q_prompts_zero_shot(spark, sf):
    return gen.zero_shot_prompts(gen.distinct_labels(train_ids(spark, sf)))


def q_prompts_few_shot(spark, sf):
    return gen.few_shot_prompts(draws(spark, sf))


def q_prompt_list(spark, sf):
    return prompt_table(spark, sf)


def q_prompt_wrap(spark, sf):
    w = gen.wrap_prompts(prompt_table(spark, sf))
    return w.select("mode", "label", "prompt_no", "generator", "prompt")


def q_gen_extract_post(spark, sf):
    r = tb.raw_texts(spark, sf)
    return r.select("gen_id", gen.extract_post(F.col("raw_text")).alias("post"))


def q_gen_postprocess(spark, sf):
    return synthetic(spark, sf)


def q_gen_label_join(spark, sf):
    texts = gen.postprocess(tb.raw_texts(spark, sf))
    labels = tb.gen_labels(spark, sf)
    return gen.label_join(texts, labels).select("gen_id", "dataset", "label", "text")


def q_yield_pivot(spark, sf):
    return gen.yield_pivot(synthetic(spark, sf), DATASETS)


QUERIES = {
    "stratified_split": q_stratified_split,
    "distinct_labels": q_distinct_labels,
    "label_map": q_label_map,
    "label_encode": q_label_encode,
    "truncate_tokens": q_truncate_tokens,
    "sample_n": q_sample_n,
    "few_shot_sample": q_few_shot_sample,
    "prompts_zero_shot": q_prompts_zero_shot,
    "prompts_few_shot": q_prompts_few_shot,
    "prompt_list": q_prompt_list,
    "prompt_wrap": q_prompt_wrap,
    "gen_extract_post": q_gen_extract_post,
    "gen_postprocess": q_gen_postprocess,
    "gen_label_join": q_gen_label_join,
    "yield_pivot": q_yield_pivot,
}


# ---- oracle SQL -------------------------------------------------------------------
def _largest_remainder(src: str, n_col: str, draw_expr: str, out: str, name: str) -> str:
    """CTEs computing ``out`` quotas from table ``src`` (one row per label)."""
    return f"""{name}_a AS (
  SELECT *, CAST(sum({n_col}) OVER () AS HUGEINT) AS N_,
         CAST({draw_expr} AS HUGEINT) AS draw_ FROM {src}),
{name}_b AS (SELECT *, (draw_ * {n_col}) // N_ AS base_, (draw_ * {n_col}) % N_ AS rem_ FROM {name}_a),
{name}_c AS (SELECT *, draw_ - sum(base_) OVER () AS left_,
             row_number() OVER (ORDER BY rem_ DESC, label) AS pos_ FROM {name}_b),
{name} AS (SELECT * EXCLUDE (N_, draw_, base_, rem_, left_, pos_),
           CAST(base_ + CASE WHEN pos_ <= left_ AND rem_ > 0 THEN 1 ELSE 0 END AS BIGINT) AS {out}
           FROM {name}_c)"""


_N = "sum(n_c) OVER ()"
_M = "sum(m_c) OVER ()"
SPLIT = f"""sp_cnt AS (SELECT label, count(*) AS n_c FROM preprocessed GROUP BY label),
{_largest_remainder('sp_cnt', 'n_c', f'{_N} - CAST(ceil(CAST({DEFAULT.test_size} AS DOUBLE) * {_N}) AS BIGINT)', 'q_train', 'sp_q1')},
sp_m AS (SELECT *, n_c - q_train AS m_c FROM sp_q1),
{_largest_remainder('sp_m', 'm_c', f'{_M} - CAST(ceil(CAST({DEFAULT.val_size} AS DOUBLE) * {_M}) AS BIGINT)', 'q_val', 'sp_q2')},
sp_rank AS (
  SELECT p.*, row_number() OVER (PARTITION BY label ORDER BY {S.seeded_hash(DEFAULT.split_seed, 'doc_id')}, doc_id) AS rk_
  FROM preprocessed p),
split_posts AS (
  SELECT r.* EXCLUDE (rk_), CASE WHEN rk_ <= q.q_train THEN 'train'
              WHEN rk_ - q.q_train <= q.q_val THEN 'val' ELSE 'test' END AS split
  FROM sp_rank r JOIN sp_q2 q USING (label)),
train_rows AS (SELECT doc_id, label, text FROM split_posts WHERE split = 'train'),
label_map AS (SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS label_id
              FROM (SELECT DISTINCT label FROM train_rows))"""

_FLOYD_H = S.seeded_hash(DEFAULT.prompt_seed, "label", "prompt_no", "j")
DRAWS = f"""fs_rank AS (
  SELECT label, doc_id, text,
         row_number() OVER (PARTITION BY label ORDER BY {S.seeded_hash(DEFAULT.prompt_seed, 'doc_id')}, doc_id) AS rank
  FROM train_rows),
fs_size AS (
  SELECT label, count(*) AS n_label FROM train_rows GROUP BY label),
fs_size2 AS (
  SELECT label, n_label, CAST({QUERY_CONFIG.n_per_label} AS BIGINT) AS n_prompts,
         CAST(least({DEFAULT.few_shot_k}, n_label) AS BIGINT) AS k FROM fs_size),
fs_prompts AS (
  SELECT label, n_label, k, unnest(generate_series(1, n_prompts)) AS prompt_no FROM fs_size2),
fs_draw AS (
  SELECT label, prompt_no,
         list_reduce(generate_series(n_label - k + 1, n_label),
           lambda acc, j: CASE WHEN list_contains(acc, 1 + ({_FLOYD_H} % j)) THEN list_append(acc, j)
                               ELSE list_append(acc, 1 + ({_FLOYD_H} % j)) END, []::BIGINT[]) AS d
  FROM fs_prompts),
fs_picks AS (
  SELECT label, prompt_no, unnest(d) AS rank, CAST(generate_subscripts(d, 1) AS BIGINT) AS example_no FROM fs_draw),
draws AS (
  SELECT p.label, p.prompt_no, p.example_no, r.doc_id, r.text
  FROM fs_picks p JOIN fs_rank r ON p.label = r.label AND p.rank = r.rank)"""


def _sql_lit(s: str) -> str:
    parts = s.split("\n")
    return " || chr(10) || ".join(S.q(p) for p in parts)


_ZS = f"concat({_sql_lit(pr.ZERO_SHOT_HEAD)}, label, {_sql_lit(pr.ZERO_SHOT_TAIL)})"
FEW_PROMPTS = f"""few_prompts AS (
  SELECT label, prompt_no,
         concat({_sql_lit(pr.FEW_SHOT_HEAD)}, label, {_sql_lit(pr.FEW_SHOT_MID)},
                string_agg(concat('Example ', CAST(example_no AS VARCHAR), ':' || chr(10), text),
                           chr(10) || chr(10) ORDER BY example_no),
                {_sql_lit(pr.FEW_SHOT_TAIL)}) AS prompt
  FROM draws GROUP BY label, prompt_no),
prompt_table AS (
  SELECT 'few-shot' AS mode, label, prompt_no, prompt FROM few_prompts
  UNION ALL
  SELECT 'zero-shot' AS mode, label, prompt_no, {_ZS} AS prompt
  FROM (SELECT DISTINCT label, prompt_no FROM draws))"""

_EXTRACT = (f"CASE WHEN instr(raw_text, '<post>') > 0 "
            f"THEN regexp_extract(raw_text, {S.q(gen.POST_PATTERN)}, 1) ELSE raw_text END")
_RESIDUE = "x"
for _tok in tx.RESIDUE_TOKENS:
    _RESIDUE = f"replace({_RESIDUE}, {S.q(_tok)}, '')"
_STRIPPED = S.strip_ws(f"regexp_replace({S.strip_ws(_RESIDUE)}, '^\"+|\"+$', '', 'g')")
_ENDS = ", ".join(S.q(c) for c in tx.POST_END_CHARS)


def _synth(p: str, raw: str) -> str:
    """CTEs that post-process the raw generations ``raw`` as ``{p}synthetic``."""
    return f"""{p}gen_x AS (SELECT gen_id, dataset, label, {_EXTRACT} AS x FROM {raw}),
{p}gen_s AS (SELECT gen_id, dataset, label, {_STRIPPED} AS y FROM {p}gen_x),
{p}synthetic AS (
  SELECT gen_id, dataset, label,
         CASE WHEN right(y, 1) IN ({_ENDS}) THEN y ELSE concat(y, '.') END AS text, y AS post
  FROM {p}gen_s WHERE {S.word_count('y')} >= 3)"""


SYNTH = _synth("", "raw_gen")


def SYNTH_OF(p: str, posts: str) -> str:
    """The same for the posts of a sub-query."""
    return S.raw_gen(posts, f"{p}_raw") + ",\n" + _synth(f"{p}_", f"{p}_raw")


_BASE = [S.POSTS, PREPROCESSED, SPLIT]
_W = S.with_

ORACLE = {
    "stratified_split": _W(*_BASE) + "SELECT doc_id, label, split FROM split_posts",
    "distinct_labels": _W(*_BASE) + "SELECT DISTINCT label FROM train_rows",
    "label_map": _W(*_BASE) + "SELECT label, label_id FROM label_map",
    "label_encode": _W(*_BASE) + """SELECT s.doc_id, s.split, s.label, m.label_id
        FROM split_posts s LEFT JOIN label_map m USING (label) WHERE s.split <> 'train'""",
    "truncate_tokens": _W(S.POSTS, PREPROCESSED) + f"""SELECT doc_id,
        CAST(len(string_split(text_clean, ' ')[1:{DEFAULT.max_tokens}]) AS BIGINT) AS n_tokens,
        array_to_string(string_split(text_clean, ' ')[1:{DEFAULT.max_tokens}], ' ') AS truncated
        FROM preprocessed""",
    "sample_n": _W(S.POSTS, S.RAW_GEN, SYNTH) + f"""SELECT dataset, rn, gen_id, label FROM (
        SELECT dataset, gen_id, label, CAST(row_number() OVER (PARTITION BY dataset
               ORDER BY {S.seeded_hash(DEFAULT.judge_seed, 'gen_id')}, gen_id) AS BIGINT) AS rn
        FROM synthetic) WHERE rn <= {DEFAULT.judge_sample}""",
    "few_shot_sample": _W(*_BASE, DRAWS) + "SELECT label, prompt_no, example_no, doc_id FROM draws",
    "prompts_zero_shot": _W(*_BASE) + f"SELECT label, {_ZS} AS prompt FROM (SELECT DISTINCT label FROM train_rows)",
    "prompts_few_shot": _W(*_BASE, DRAWS, FEW_PROMPTS) + "SELECT label, prompt_no, prompt FROM few_prompts",
    "prompt_list": _W(*_BASE, DRAWS, FEW_PROMPTS) + "SELECT mode, label, prompt_no, prompt FROM prompt_table",
    "prompt_wrap": _W(*_BASE, DRAWS, FEW_PROMPTS) + f"""SELECT mode, label, prompt_no, m.generator,
        CASE WHEN instr(m.model_id, {S.q(pr.MENTALLAMA_MARK)}) > 0 THEN concat('<s>[INST] ', prompt, ' [/INST]')
             WHEN instr(m.model_id, {S.q(pr.FALCON_MARK)}) > 0 THEN concat('User: ', prompt, chr(10) || 'Assistant:')
             ELSE prompt END AS prompt
        FROM prompt_table, (VALUES {", ".join(f"({S.q(g)}, {S.q(m)})" for g, m in pr.GENERATOR_MODELS)}) m(generator, model_id)""",
    "gen_extract_post": _W(S.POSTS, S.RAW_GEN) + f"SELECT gen_id, {_EXTRACT} AS post FROM raw_gen",
    "gen_postprocess": _W(S.POSTS, S.RAW_GEN, SYNTH) + "SELECT gen_id, dataset, label, text FROM synthetic",
    "gen_label_join": _W(S.POSTS, S.RAW_GEN, SYNTH) + "SELECT gen_id, dataset, label, text FROM synthetic",
    "yield_pivot": _W(S.POSTS, S.RAW_GEN, SYNTH) + "SELECT label, " + ", ".join(
        f"CAST(count(*) FILTER (WHERE dataset = '{d}') AS BIGINT) AS {d}" for d in DATASETS)
        + f", CAST(count(*) FILTER (WHERE dataset IS NULL OR dataset NOT IN ({', '.join(S.q(d) for d in DATASETS)})) AS BIGINT) AS other"
        + " FROM synthetic GROUP BY label",
}
