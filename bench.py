"""Benchmark: run the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query runs to completion through the ``noop`` sink (full execution,
nothing collected to the driver). One warm-up pass, then the median of
``BENCH_REPS`` (default 1) timed runs per query.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tessera.session import get_spark  # noqa: E402
from tessera.plans.catalog import queries  # noqa: E402

HEADLINE = [
    "class_report_ppl",
    "token_entropy",
    "word_mean_entropy",
    "sequence_scores",
    "segment_token_entropy",
    "segment_word_entropy",
    "roc_points",
    "auc_ap",
    "mwu",
    "qa_split_flat",
    "seeded_sample",
    "stratified_split",
    "similarity_auc",
    "perturb_join",
    "sentence_chunks",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = get_spark(f"local[{cpus}]", app="tessera-bench", **{"spark.sql.shuffle.partitions": cpus})
    qs = queries()

    def run(name: str) -> float:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    run("auc_ap")  # warm-up: JVM, codegen caches, file listing
    out = {}
    for name in names:
        out[name] = round(statistics.median(run(name) for _ in range(reps)), 3)
    total = round(sum(out.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": out, "sf": sf}))


if __name__ == "__main__":
    main()
