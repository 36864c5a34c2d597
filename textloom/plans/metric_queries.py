"""Registered queries: classification metrics, run results, sweeps, and CSV / JSON / partitioned I/O."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.config import CLASSIFIERS, DEFAULT
from textloom.operators import generation as gen
from textloom.operators import metrics as M
from textloom.operators import report, runs
from textloom.plans import model_queries
from textloom.plans import sqlparts as S
from textloom.plans.gen_queries import SYNTH
from textloom.plans.metrics_sql import metrics_sql
from textloom.session import scratch_path
from textloom.sources import csvio, csvsplit, results
from textloom.sources import tables as tb
from textloom.sources.datasets import read_named

C = tb.N_CLASSES


def _r6(df, cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else c for c in df.columns])


# ---- queries ------------------------------------------------------------------------
def q_argmax_pred(spark, sf):
    return M.with_pred(tb.logits(spark, sf)).select("vec_id", "label_id", "pred")


def q_softmax_probs(spark, sf):
    p = M.class_probs(tb.logits(spark, sf), ["vec_id"]).select("vec_id", "cls", "prob")
    return _r6(p, ["prob"])


def q_label_onehot(spark, sf):
    return tb.logits(spark, sf).select("vec_id", F.posexplode(M.one_hot(F.col("label_id"), C))
                                       .alias("cls", "onehot"))


def q_confusion_matrix(spark, sf):
    return M.confusion(tb.logits(spark, sf), [])


def q_per_class_metrics(spark, sf):
    pc = M.per_class(M.confusion(tb.logits(spark, sf), []), [])
    return _r6(pc, ["precision", "recall", "f1"])


def q_classification_report(spark, sf):
    pc = M.per_class(M.confusion(tb.logits(spark, sf), []), [])
    return _r6(M.report(pc, []), ["precision", "recall", "f1"])


def q_macro_metrics(spark, sf):
    pc = M.per_class(M.confusion(tb.logits(spark, sf), []), [])
    return _r6(M.macro(pc, []), ["macro_precision", "macro_recall", "macro_f1"])


def q_roc_auc_ovr(spark, sf):
    per = M.roc_auc_ovr(tb.logits(spark, sf), [])
    return _r6(M.macro_auc(per, []), ["macro_roc_auc_ovr"])


def q_log_loss(spark, sf):
    return _r6(M.loss_and_steps(tb.logits(spark, sf), [], DEFAULT.eval_batch).select("loss"), ["loss"])


def q_eval_steps(spark, sf):
    return M.loss_and_steps(tb.logits(spark, sf), [], DEFAULT.eval_batch).select("n_rows", "steps")


def bundle(spark, sf):
    return runs.run_attributes(model_queries.bundle(spark, sf))


def _long(spark, sf):
    b = bundle(spark, sf)
    return runs.results_long(runs.results_maps(b))


def q_results_long(spark, sf):
    return _r6(_long(spark, sf), ["value"])


TIMINGS = ("runtime", "samples_per_second", "steps_per_second")


def q_results_wide(spark, sf):
    w = runs.results_wide(_long(spark, sf)).drop(*TIMINGS)     # not measured here
    return _r6(w, [m for m in runs.METRICS if m not in TIMINGS])


def q_leaderboard(spark, sf):
    lb = runs.leaderboard(bundle(spark, sf))
    return _r6(lb.select("place", "mode", "temp", "generator", "classifier", "run_name", "macro_f1",
                         "macro_roc_auc_ovr"), ["macro_f1", "macro_roc_auc_ovr"])


def q_baseline_delta(spark, sf):
    d = runs.baseline_delta(bundle(spark, sf))
    return _r6(d, ["macro_f1", "base_f1", "delta_f1", "ratio_f1", "delta_auc"])


def q_results_json_scan(spark, sf):
    """Write every run's result document (original layout), then scan the folder back."""
    root = scratch_path(spark, "results-json")
    maps = runs.run_attributes(runs.results_maps(bundle(spark, sf)))
    results.write_results(maps, root)
    back = results.scan_results(spark, root)
    long = runs.results_long(back.select("run_name", *CLASSIFIERS)).join(
        back.select("run_name", "temp"), "run_name")
    return _r6(long.select("run_name", "temp", "classifier", "metric", "value"), ["value"])


def q_sweep_manifest(spark, sf):
    """Every stored sweep point with its run name and the rows under it."""
    d = model_queries.sweep_rows(spark, sf)
    return d.groupBy("dataset", "generator", "mode", "temp", "run_name").agg(F.count(F.lit(1)).alias("n_rows"))


SWEEP_SCHEMA = T.StructType([
    T.StructField("gen_id", T.LongType()), T.StructField("label", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("temp", T.DoubleType()),
    T.StructField("generator", T.StringType()), T.StructField("mode", T.StringType())])
SCAN_TEMP = 0.9


def q_sweep_partition_scan(spark, sf):
    """Write the sweep's training rows partitioned by (temp, generator, mode); read one temperature back."""
    out = model_queries.sweep_rows(spark, sf).select("gen_id", "label", "text", "temp", "generator", "mode")
    root = scratch_path(spark, "sweep")
    results.write_sweep(out, root)
    return results.scan_sweep(spark, root, SWEEP_SCHEMA, SCAN_TEMP)


POSTS_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("dataset", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("label", T.StringType())])


def q_csv_roundtrip(spark, sf):
    """Posts written as CSV and read back; pandas' NA strings come back as null."""
    path = scratch_path(spark, "posts-csv")
    csvio.write_csv(tb.posts(spark, sf).select("doc_id", "dataset", "text", "label"), path, rows_per_file=0)
    return csvsplit.read_csv(spark, path, POSTS_SCHEMA)


MISSING_SET = ("xx", "Not Generated")


def q_multi_dataset_union(spark, sf):
    """Named CSV datasets from separate folders, unioned with their name; a missing folder is skipped.

    The folders are written in one partitioned pass; the scan lists them by name and reads pandas' NA strings as null.
    """
    syn = gen.postprocess(tb.raw_gen(spark, sf))
    root = scratch_path(spark, "datasets")
    csvio.write_csv(syn.select("dataset", "gen_id", "label", "text"), root, partition_by="dataset", rows_per_file=0)
    named = {n: f"{root}/dataset={code}" for code, n in (*report.DATASET_NAMES, MISSING_SET)}
    return read_named(spark, named, NAMED_SCHEMA, csvsplit.read_csv)


NAMED_SCHEMA = T.StructType([T.StructField("gen_id", T.LongType()),
                             T.StructField("label", T.StringType()),
                             T.StructField("text", T.StringType())])


QUERIES = {
    "argmax_pred": q_argmax_pred,
    "softmax_probs": q_softmax_probs,
    "label_onehot": q_label_onehot,
    "confusion_matrix": q_confusion_matrix,
    "per_class_metrics": q_per_class_metrics,
    "classification_report": q_classification_report,
    "macro_metrics": q_macro_metrics,
    "roc_auc_ovr": q_roc_auc_ovr,
    "log_loss": q_log_loss,
    "eval_steps": q_eval_steps,
    "results_long": q_results_long,
    "results_wide": q_results_wide,
    "leaderboard": q_leaderboard,
    "baseline_delta": q_baseline_delta,
    "results_json_scan": q_results_json_scan,
    "sweep_manifest": q_sweep_manifest,
    "sweep_partition_scan": q_sweep_partition_scan,
    "csv_roundtrip": q_csv_roundtrip,
    "multi_dataset_union": q_multi_dataset_union,
}


# ---- oracle SQL ------------------------------------------------------------------------
_MET_COLS = ("loss", "macro_precision", "macro_recall", "macro_f1", "macro_roc_auc_ovr", "NULL", "NULL", "NULL", "epoch")
LONG = "results_long AS (" + " UNION ALL ".join(
    f"SELECT run_name, classifier, concat(classifier, '_', run_name, '_', {S.q(m)}) AS key, {S.q(m)} AS metric, "
    f"CAST({c} AS DOUBLE) AS value, temp FROM bundle"
    for m, c in zip(runs.METRICS, _MET_COLS)) + ")"

_LG = S.with_(S.LOGITS, metrics_sql("logits", [], "lg"))
_DS_NAME = "CASE dataset " + " ".join(f"WHEN {S.q(k)} THEN {S.q(v)}" for k, v in report.DATASET_NAMES) + " ELSE dataset END"
_NA = ", ".join(S.q(x) for x in csvio.NA_TOKENS)

ORACLE = {
    "argmax_pred": S.with_(S.LOGITS) + """SELECT vec_id, label_id,
        CAST(list_position(l, list_max(l)) - 1 AS INTEGER) AS pred FROM logits""",
    "softmax_probs": _LG + "SELECT vec_id, CAST(cls AS INTEGER) AS cls, round(score, 6) AS prob FROM (SELECT vec_id, unnest(pr) AS score, generate_subscripts(pr, 1) - 1 AS cls FROM (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS pr FROM (SELECT vec_id, list_transform(l, lambda x: exp(x - list_max(l))) AS e FROM logits)))",
    "label_onehot": S.with_(S.LOGITS) + f"""SELECT vec_id, CAST(c AS INTEGER) AS cls, CAST(c = label_id AS INTEGER) AS onehot
        FROM (SELECT vec_id, label_id, unnest(range(0, {C})) AS c FROM logits)""",
    "confusion_matrix": _LG + "SELECT label_id, pred, n FROM lg_conf",
    "per_class_metrics": _LG + """SELECT cls, round(precision, 6) AS precision, round(recall, 6) AS recall,
        round(f1, 6) AS f1, support, tp, predicted FROM lg_pc""",
    "classification_report": _LG + """SELECT CAST(cls AS VARCHAR) AS row, round(precision, 6) AS precision,
        round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM lg_pc
        UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM lg_pc
        UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
                         CAST(sum(support) AS BIGINT) FROM lg_pc
        UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
                         round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
                         CAST(sum(support) AS BIGINT) FROM lg_pc""",
    "macro_metrics": _LG + """SELECT round(macro_precision, 6) AS macro_precision, round(macro_recall, 6) AS macro_recall,
        round(macro_f1, 6) AS macro_f1 FROM lg_macro""",
    "roc_auc_ovr": _LG + "SELECT round(macro_roc_auc_ovr, 6) AS macro_roc_auc_ovr FROM lg_auc",
    "log_loss": _LG + "SELECT round(loss, 6) AS loss FROM lg_loss",
    "eval_steps": _LG + "SELECT n_rows, steps FROM lg_loss",
    "results_long": S.with_(*model_queries.BUNDLE, LONG) + "SELECT run_name, classifier, key, round(value, 6) AS value, metric FROM results_long",
    "results_wide": S.with_(*model_queries.BUNDLE, LONG) + "SELECT run_name, classifier, " + ", ".join(
        f"round(max(value) FILTER (WHERE metric = {S.q(m)}), 6) AS {m}" for m in runs.METRICS if m not in TIMINGS)
        + " FROM results_long GROUP BY run_name, classifier",
    "leaderboard": S.with_(*model_queries.BUNDLE) + """SELECT CAST(row_number() OVER (ORDER BY f1 DESC, mode, temp) AS INTEGER) AS place,
        mode, temp, generator, classifier, run_name, round(macro_f1, 6) AS macro_f1, round(macro_roc_auc_ovr, 6) AS macro_roc_auc_ovr FROM (
          SELECT *, row_number() OVER (PARTITION BY mode, temp ORDER BY f1 DESC, generator, classifier) AS r
          FROM (SELECT *, round(macro_f1, 9) AS f1 FROM bundle) WHERE mode IS NOT NULL) WHERE r = 1""",
    "baseline_delta": S.with_(*model_queries.BUNDLE) + f"""SELECT s.run_name, s.classifier, round(s.macro_f1, 6) AS macro_f1,
        round(b.macro_f1, 6) AS base_f1, round(s.macro_f1 - b.macro_f1, 6) AS delta_f1,
        round(CASE WHEN b.macro_f1 <> 0 THEN s.macro_f1 / b.macro_f1 END, 6) AS ratio_f1,
        round(s.macro_roc_auc_ovr - b.macro_roc_auc_ovr, 6) AS delta_auc
        FROM bundle s JOIN bundle b ON s.classifier = b.classifier AND b.run_name = {S.q(runs.BASELINE_RUN)}
        WHERE s.run_name <> {S.q(runs.BASELINE_RUN)}""",
    "results_json_scan": S.with_(*model_queries.BUNDLE, LONG) + "SELECT run_name, temp, classifier, metric, round(value, 6) AS value FROM results_long",
    "sweep_manifest": S.with_(*model_queries.SWEEP_BASE) + """SELECT dataset, generator, mode, temp, run_name, count(*) AS n_rows
        FROM sweep_rows GROUP BY ALL""",
    "sweep_partition_scan": S.with_(*model_queries.SWEEP_BASE) + f"""SELECT gen_id, label, text, temp, generator, mode
        FROM sweep_rows WHERE temp = CAST({SCAN_TEMP} AS DOUBLE)""",
    "csv_roundtrip": S.with_(S.POSTS) + f"""SELECT doc_id,
        CASE WHEN dataset IN ({_NA}) THEN NULL ELSE dataset END AS dataset,
        CASE WHEN text IN ({_NA}) THEN NULL ELSE text END AS text,
        CASE WHEN label IN ({_NA}) THEN NULL ELSE label END AS label FROM posts""",
    "multi_dataset_union": S.with_(S.POSTS, S.RAW_GEN, SYNTH) + f"""SELECT {_DS_NAME} AS dataset, gen_id,
        CASE WHEN label IN ({_NA}) THEN NULL ELSE label END AS label, CASE WHEN text IN ({_NA}) THEN NULL ELSE text END AS text
        FROM synthetic WHERE dataset IN ({", ".join(S.q(k) for k, _ in report.DATASET_NAMES)})""",
}
