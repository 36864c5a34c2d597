"""Registered queries of the trained linear classifier: vocabulary, first steps, epochs, evaluation, utility sweep."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.config import DEFAULT, LABELS
from textloom.operators import linear as L
from textloom.operators import metrics as M
from textloom.operators import runs
from textloom.operators import vocabulary as V
from textloom.plans import model_queries as MQ
from textloom.plans import sqlparts as S
from textloom.plans.gen_queries import SPLIT, split_texts
from textloom.plans.metrics_sql import metrics_sql
from textloom.plans.prep_queries import PREPROCESSED
from textloom.session import hand_off


def training(spark, sf, baseline=True, synthetic=True, root=None):
    """The training over the real train split and / or every sweep point, and the split posts."""
    posts = hand_off(split_texts(spark, sf), "linear-posts", "split")
    train = MQ.training_sets(spark, sf, baseline, synthetic, posts)
    val = posts.filter(F.col("split") == "val").select("doc_id", "label", "text_clean")
    names = [r[0] for r in runs.run_grid() if (baseline if r[0] == runs.BASELINE_RUN else synthetic)]
    return L.Training(spark, train, val, root=root, run_names=names), posts


def bundle(spark, sf, baseline=True, synthetic=True):
    """Test metrics of each model's best epoch."""
    t, posts = training(spark, sf, baseline, synthetic)
    test = posts.filter(F.col("split") == "test").select("doc_id", "label", "text_clean")
    scored = hand_off(t.run().score(test).drop("doc_id"), "linear-scores")
    return M.bundle(scored, [*L.MODEL, "epoch"], DEFAULT.eval_batch)


def q_tfidf_vocabulary(spark, sf):
    """The terms that the real train split's models keep, at most 200,000 each, with their weights."""
    posts = split_texts(spark, sf).filter(F.col("split") == "train").withColumn("run_name", F.when(F.col("split") == "train", runs.BASELINE_RUN))
    v = L.vocabulary(posts.select("run_name", "doc_id", "text_clean"))
    return v.where("idf is not null").select("classifier", "term", F.round("idf", 6).alias("idf"))


def q_linear_first_steps(spark, sf):
    """The weights (millionths) of the real train split's models behind the first and the second epoch."""
    t, _ = training(spark, sf, synthetic=False)
    two = t.epoch(1).select("fid", F.col("w").alias("w1")).join(t.epoch(2).select("fid", F.col("w").alias("w2")), "fid")
    j = two.join(t.vocab.select("classifier", "term", "fid"), "fid")
    return j.select("classifier", "term", *[F.col(f"w{e}")[i].alias(f"w{e}_{c}") for e in (1, 2) for i, c in enumerate(LABELS)])


def q_train_linear_classifier(spark, sf):
    """Train on the real train split by epochs, keep the best on val, score test; one row per feature variant."""
    return MQ.rounded(bundle(spark, sf, synthetic=False).drop("run_name"))


def q_linear_utility_sweep(spark, sf):
    """All 25 training sets trained together, the best epoch of each tested on the real test split."""
    return MQ.rounded(runs.run_attributes(bundle(spark, sf)))


def q_best_epoch(spark, sf):
    """The epoch with the best validation macro F1 of each of the 50 models."""
    return MQ.rounded(training(spark, sf)[0].run().best(), ["macro_f1"])


QUERIES = {
    "tfidf_vocabulary": q_tfidf_vocabulary,
    "linear_first_steps": q_linear_first_steps,
    "train_linear_classifier": q_train_linear_classifier,
    "linear_utility_sweep": q_linear_utility_sweep,
    "best_epoch": q_best_epoch,
}

# ---- oracle SQL ----------------------------------------------------------------------
_WORDS = "string_split(text_clean, ' ')"
_U = f"{L.UNIT}.0::DOUBLE"
_IDS = range(len(LABELS))
_LAB = ", ".join(f"({i}, {S.q(c)})" for i, c in enumerate(LABELS))
_REAL = f"SELECT {S.q(runs.BASELINE_RUN)} AS run_name, doc_id, label, text_clean FROM split_posts WHERE split = 'train'"
_SYNTH = f"""SELECT run_name, gen_id AS doc_id, label, text_clean FROM (
    SELECT run_name, gen_id, label, {S.clean_text('text')} AS text_clean FROM sweep_rows) WHERE length(text_clean) > 0"""


def _round(x: str) -> str:
    return f"CAST(floor({x} + 0.5) AS BIGINT)"


def _counts(name: str, src: str, keep: str) -> str:
    pairs = f"unnest(list_transform(range(1, len({_WORDS})), lambda i: concat({_WORDS}[i], ' ', {_WORDS}[i + 1])))"
    return f"""{name} AS (SELECT {keep}, classifier, term, count(*) AS tf FROM (
  SELECT {keep}, 'unigram_lr' AS classifier, unnest({_WORDS}) AS term FROM {src}
  UNION ALL SELECT {keep}, 'bigram_lr', {pairs} FROM {src}) GROUP BY ALL)"""


def _vectors(name: str, tf: str, src: str, keep: str, join: str) -> str:
    """The vectors of a term table under the vocabularies, with the constant feature."""
    return f"""{name}_raw AS (SELECT v.run_name, {keep}, v.classifier, v.term, {_round(f"(1 + ln(tf)) * idf * {L.RAW_UNIT}")} AS raw
  FROM {tf} t JOIN lr_voc v USING ({join})),
{name}_norm AS (SELECT run_name, {keep}, classifier, sqrt(CAST(sum(raw * raw) AS DOUBLE)) AS q FROM {name}_raw WHERE raw > 0 GROUP BY ALL),
{name} AS (
  SELECT * FROM (SELECT run_name, {keep}, classifier, term, {_round(f"raw / q * {_U}")} AS x
                 FROM {name}_raw JOIN {name}_norm USING (run_name, {keep}, classifier) WHERE raw > 0) WHERE x > 0
  UNION ALL
  SELECT {'run_name' if join.startswith('run_name') else 'n.run_name'}, {keep}, unnest(['unigram_lr', 'bigram_lr']), '', {L.UNIT}
  FROM {src}{'' if join.startswith('run_name') else ', lr_n n'})"""


def _vocabulary(train: str) -> str:
    return f"""lr_train AS ({train}),
lr_n AS (SELECT run_name, count(*) AS n FROM lr_train GROUP BY run_name),
{_counts('lr_tf', 'lr_train', 'run_name, doc_id')},
lr_df AS (SELECT run_name, classifier, term, count(*) AS df FROM lr_tf GROUP BY ALL),
lr_voc AS (
  SELECT run_name, classifier, term, ln((n + 1) / (df + 1)) AS idf FROM (
    SELECT *, row_number() OVER (PARTITION BY run_name, classifier ORDER BY df DESC, term) AS r FROM lr_df)
  JOIN lr_n USING (run_name) WHERE r <= {V.MAX_FEATURES})"""


def _step(n: int) -> str:
    """One accelerated step: ``st<n>`` (run_name, classifier, term, c, d, w, y) from ``st<n - 1>``."""
    momentum, before = (n - 1) / (n + 2), f"st{n - 1}"
    e = ", ".join(f"max(CASE WHEN c = {i} THEN e END) AS e{i}" for i in _IDS)
    total = "0.0::DOUBLE"
    for i in _IDS:
        total = f"({total} + p.e{i})"
    hit = "CASE WHEN l.label = b.label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    return f"""z{n} AS (SELECT v.run_name, v.classifier, v.doc_id, s.c, CAST(sum(v.x * s.y) AS DOUBLE) / ({_U} * {_U}) AS z
  FROM lr_x v JOIN {before} s USING (run_name, classifier, term) GROUP BY ALL),
e{n} AS (SELECT *, exp(z - max(z) OVER (PARTITION BY run_name, classifier, doc_id)) AS e FROM z{n}),
p{n} AS (SELECT run_name, classifier, doc_id, {e} FROM e{n} GROUP BY ALL),
r{n} AS (SELECT e.run_name, e.classifier, e.doc_id, e.c, {_round(f"(e.e / {total} - {hit}) * {_U}")} AS r
  FROM e{n} e JOIN p{n} p USING (run_name, classifier, doc_id) JOIN lr_train b USING (run_name, doc_id) JOIN lr_lab l ON l.c = e.c),
g{n} AS (SELECT v.run_name, v.classifier, v.term, r.c, CAST(sum({_round(f"CAST(v.x * r.r AS DOUBLE) / {_U}")}) AS BIGINT) AS g
  FROM lr_x v JOIN r{n} r USING (run_name, classifier, doc_id) GROUP BY ALL),
st{n} AS (SELECT run_name, classifier, term, c, d, w AS w, {_round(f"w + {momentum!r}::DOUBLE * (w - old)")} AS y FROM (
  SELECT s.run_name, s.classifier, s.term, s.c, s.d, s.w AS old,
         {_round(f"s.y - (CAST(g.g AS DOUBLE) + {L.RIDGE!r}::DOUBLE * s.y) / s.d")} AS w
  FROM {before} s JOIN g{n} g USING (run_name, classifier, term, c)))"""


def _training(steps: int) -> str:
    return f"""lr_lab(c, label) AS (VALUES {_LAB}),
{_vectors('lr_x', 'lr_tf', 'lr_train', 'doc_id', 'run_name, classifier, term')},
lr_s AS (SELECT run_name, doc_id, classifier, CAST(sum(x) AS BIGINT) AS s FROM lr_x GROUP BY ALL),
lr_d AS (SELECT run_name, classifier, term,
  0.5::DOUBLE * CAST(sum(CAST(floor(CAST(x * s AS DOUBLE) / {_U}) AS BIGINT)) AS BIGINT) / {_U} + {L.RIDGE!r}::DOUBLE AS d
  FROM lr_x JOIN lr_s USING (run_name, doc_id, classifier) GROUP BY ALL),
st0 AS (SELECT run_name, classifier, term, c, d, 0::BIGINT AS w, 0::BIGINT AS y FROM lr_d CROSS JOIN lr_lab),
{", ".join(_step(n) for n in range(1, steps + 1))}"""


def _scored() -> str:
    """``lr_best`` and the test scores of the best epochs; epoch n > 2 counts while the best one is less than 2 epochs old."""
    weights = " UNION ALL ".join(f"SELECT run_name, classifier, {n} AS epoch, term, c, w FROM st{n}" for n in range(1, L.EPOCHS + 1))
    allowed = " AND ".join(f"(epoch < {n} OR best{n - 1} > {n - 1 - L.PATIENCE})" for n in range(L.PATIENCE + 1, L.EPOCHS + 1))
    so_far = ", ".join(f"arg_max(epoch, (macro_f1, -epoch)) FILTER (epoch <= {n}) AS best{n}" for n in range(L.PATIENCE, L.EPOCHS))
    return f"""lr_rest AS (SELECT doc_id, split, label, text_clean FROM split_posts WHERE split <> 'train'),
{_counts('lr_rest_tf', 'lr_rest', 'doc_id')},
{_vectors('lr_rx', 'lr_rest_tf', 'lr_rest', 'doc_id', 'classifier, term')},
lr_w AS ({weights}),
lr_z AS (SELECT v.run_name, v.classifier, w.epoch, v.doc_id, w.c, CAST(sum(v.x * w.w) AS DOUBLE) / ({_U} * {_U}) AS z
  FROM lr_rx v JOIN lr_w w USING (run_name, classifier, term) GROUP BY ALL),
lr_sc AS (SELECT z.run_name, z.classifier, z.epoch, z.doc_id, r.split, any_value(l.c) AS label_id, list(z.z ORDER BY z.c) AS l
  FROM lr_z z JOIN lr_rest r USING (doc_id) JOIN lr_lab l ON l.label = r.label GROUP BY ALL),
lr_val AS (SELECT * FROM lr_sc WHERE split = 'val'),
{metrics_sql('lr_val', [*L.MODEL, 'epoch'], 'lv')},
lr_far AS (SELECT run_name, classifier, {so_far} FROM lv_macro GROUP BY ALL),
lr_best AS (SELECT run_name, classifier, epoch, macro_f1 FROM (
  SELECT m.*, row_number() OVER (PARTITION BY run_name, classifier ORDER BY macro_f1 DESC, epoch) AS r
  FROM lv_macro m JOIN lr_far USING (run_name, classifier) WHERE {allowed}) WHERE r = 1),
lr_test AS (SELECT s.* FROM lr_sc s JOIN lr_best USING (run_name, classifier, epoch) WHERE split = 'test'),
{metrics_sql('lr_test', [*L.MODEL, 'epoch'], 'lt')},
lr_attr(run_name, temp, generator, mode) AS (VALUES {runs.attr_values()}),
lr_bundle AS (
  SELECT m.run_name, m.classifier, m.epoch, m.macro_precision, m.macro_recall, m.macro_f1, a.macro_roc_auc_ovr,
         l.loss, l.n_rows, l.steps, ra.temp, ra.generator, ra.mode
  FROM lt_macro m JOIN lt_auc a USING (run_name, classifier, epoch) JOIN lt_loss l USING (run_name, classifier, epoch)
  JOIN lr_attr ra USING (run_name))"""


_R = ", ".join(f"round({c}, 6) AS {c}" for c in MQ.DOUBLES) + ", n_rows, steps"
_BASE = S.with_(S.POSTS, PREPROCESSED, SPLIT)
_ALL = S.with_(*MQ.SWEEP_BASE)
_W = ", ".join(f"max(CASE WHEN s.c = {i} THEN s.w END) AS w1_{c}, max(CASE WHEN s.c = {i} THEN t.w END) AS w2_{c}" for i, c in enumerate(LABELS))

ORACLE = {
    "tfidf_vocabulary": f"{_BASE}, {_vocabulary(_REAL)} SELECT classifier, term, round(idf, 6) AS idf FROM lr_voc",
    "linear_first_steps": f"""{_BASE}, {_vocabulary(_REAL)}, {_training(2)}
      SELECT s.classifier, s.term, {_W} FROM st1 s JOIN st2 t USING (run_name, classifier, term, c) GROUP BY s.classifier, s.term""",
    "train_linear_classifier": f"""{_BASE}, {_vocabulary(_REAL)}, {_training(L.EPOCHS)}, {_scored()}
      SELECT classifier, epoch, {_R} FROM lr_bundle""",
    "linear_utility_sweep": f"""{_ALL}, {_vocabulary(f'{_REAL} UNION ALL {_SYNTH}')}, {_training(L.EPOCHS)}, {_scored()}
      SELECT run_name, classifier, epoch, {_R}, temp, generator, mode FROM lr_bundle""",
    "best_epoch": f"""{_ALL}, {_vocabulary(f'{_REAL} UNION ALL {_SYNTH}')}, {_training(L.EPOCHS)}, {_scored()}
      SELECT run_name, classifier, epoch, round(macro_f1, 6) AS macro_f1 FROM lr_best""",
}
