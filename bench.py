"""Bench: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

Each query is executed in full with the ``noop`` sink (no collect to the driver).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from textloom.plans import catalog  # noqa: E402
from textloom.session import build_session  # noqa: E402

HEADLINE = [
    "preprocess",
    "stratified_split",
    "few_shot_sample",
    "prompt_list",
    "gen_postprocess",
    "completeness_rules",
    "pii_rules",
    "audit_summary",
    "roc_auc_ovr",
    "eval_bundle",
    "tfidf_top_terms",
    "train_eval_classifier",
    "utility_sweep",
    "train_linear_classifier",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = build_session()
    qs = catalog.queries()
    times = {}
    # warm up the JVM and the Python workers once, outside the timings (one-time start-up)
    qs["clean_text"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.range(8).mapInPandas(lambda it: it, "id long").write.format("noop").mode("overwrite").save()
    for name in names:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    n_docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").count()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "headline_total_wall", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir,
           "documents": n_docs, "documents_per_sec": {n: round(n_docs / t, 1) for n, t in times.items() if t},
           "cpus": int(os.environ.get("BENCH_CPUS", "8"))}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
