"""Registry of all queries (name -> callable(spark, sf_dir)) and their DuckDB oracle SQL."""

from __future__ import annotations

import importlib

_GROUPS = [
    "textloom.plans.prep_queries",
    "textloom.plans.gen_queries",
    "textloom.plans.audit_queries",
    "textloom.plans.metric_queries",
    "textloom.plans.model_queries",
    "textloom.plans.linear_queries",
]


def _load():
    queries, oracle = {}, {}
    for mod_name in _GROUPS:
        mod = importlib.import_module(mod_name)
        queries.update(mod.QUERIES)
        oracle.update(getattr(mod, "ORACLE", {}))
    return queries, oracle


def queries():
    return _load()[0]


def oracle_sql():
    return _load()[1]
