"""DuckDB CTEs of the classification metrics, used by the oracles."""

from __future__ import annotations

from textloom.config import DEFAULT


def _k(keys, trail=True):
    if not keys:
        return ""
    return ", ".join(keys) + (", " if trail else "")


def metrics_sql(src: str, keys, p: str) -> str:
    """CTEs ``{p}_conf, {p}_pc, {p}_macro, {p}_auc, {p}_loss`` over ``src(keys.., label_id, l)``."""
    k = _k(keys)
    kg = f"GROUP BY {_k(keys, False)}" if keys else ""
    part = f"PARTITION BY {k}cls"
    return f"""{p}_pred AS (SELECT {k}label_id, CAST(list_position(l, list_max(l)) - 1 AS INTEGER) AS pred, l FROM {src}),
{p}_conf AS (SELECT {k}label_id, pred, count(*) AS n FROM {p}_pred GROUP BY {k}label_id, pred),
{p}_sides AS (
  SELECT {k}label_id AS cls, n AS support, 0 AS predicted, CASE WHEN label_id = pred THEN n ELSE 0 END AS tp FROM {p}_conf
  UNION ALL
  SELECT {k}pred AS cls, 0 AS support, n AS predicted, 0 AS tp FROM {p}_conf),
{p}_pc0 AS (SELECT {k}cls, CAST(sum(support) AS BIGINT) AS support, CAST(sum(predicted) AS BIGINT) AS predicted,
           CAST(sum(tp) AS BIGINT) AS tp FROM {p}_sides GROUP BY {k}cls),
{p}_pc AS (SELECT {k}CAST(cls AS INTEGER) AS cls,
           CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
           CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall,
           CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0.0 END AS f1,
           support, tp, predicted FROM {p}_pc0),
{p}_macro AS (SELECT {k}avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1
              FROM {p}_pc {kg}),
{p}_sm AS (SELECT {k}label_id, list_transform(l, lambda x: exp(x - list_max(l))) AS e FROM {src}),
{p}_pr AS (SELECT {k}label_id, list_transform(e, lambda x: x / list_sum(e)) AS pr FROM {p}_sm),
{p}_ex AS (SELECT {k}label_id, unnest(pr) AS score, generate_subscripts(pr, 1) - 1 AS cls FROM {p}_pr),
{p}_agg AS (SELECT {k}cls, score, sum(CASE WHEN label_id = cls THEN 1 ELSE 0 END) AS pos,
            sum(CASE WHEN label_id <> cls THEN 1 ELSE 0 END) AS neg FROM {p}_ex GROUP BY {k}cls, score),
{p}_below AS (SELECT *, coalesce(sum(neg) OVER ({part} ORDER BY score
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM {p}_agg),
{p}_aucc AS (SELECT {k}cls, CASE WHEN sum(pos) > 0 AND sum(neg) > 0
             THEN sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)) ELSE 'NaN'::DOUBLE END AS auc
             FROM {p}_below GROUP BY {k}cls),
{p}_auc AS (SELECT {k}avg(auc) AS macro_roc_auc_ovr FROM {p}_aucc {kg}),
{p}_loss AS (SELECT {k}avg(list_max(l) + ln(list_sum(list_transform(l, lambda x: exp(x - list_max(l)))))
             - l[label_id + 1]) AS loss, count(*) AS n_rows,
             CAST(ceil(count(*) / {DEFAULT.eval_batch}) AS BIGINT) AS steps FROM {src} {kg})"""
