"""Summarise the physical plans of the headline queries.

    python scripts/plan_report.py [sf_dir]

Per query: shuffles by kind, broadcasts, joins, windows, Python evaluation
and whether every scan prunes columns (ReadSchema narrower than the file).
"""

from __future__ import annotations

import re
import sys

sys.path.insert(0, ".")

from bench import HEADLINE  # noqa: E402
from tessera.plans.catalog import queries  # noqa: E402
from tessera.session import get_spark  # noqa: E402

KINDS = {
    "hash": lambda n, a: n == "Exchange" and "hashpartitioning" in a,
    "range": lambda n, a: n == "Exchange" and "rangepartitioning" in a,
    "single": lambda n, a: n == "Exchange" and "SinglePartition" in a,
    "bcast": lambda n, a: n == "BroadcastExchange",
    "smj": lambda n, a: n == "SortMergeJoin",
    "bhj": lambda n, a: n == "BroadcastHashJoin",
    "bnlj": lambda n, a: n in ("BroadcastNestedLoopJoin", "CartesianProduct"),
    "window": lambda n, a: n == "Window",
    "python": lambda n, a: n in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas"),
}


def nodes(text: str) -> dict[int, tuple[str, str]]:
    """Unique plan nodes of a formatted explain: id -> (name, details)."""
    out = {}
    for block in text.split("\n\n"):
        m = re.match(r"\((\d+)\) ([A-Za-z]+)", block.strip())
        if m:
            out[int(m.group(1))] = (m.group(2), block)
    return out


def formatted(df) -> str:
    jvm = df.sparkSession._jvm
    mode = jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[8]")
    qs = queries()
    print(f"| query | {' | '.join(KINDS)} | subquery refs | scans (cols read) |")
    print("|" + " --- |" * (len(KINDS) + 3))
    for name in HEADLINE:
        text = formatted(qs[name](spark, sf))
        _, _, subs = text.partition("===== Subqueries =====")
        n_sub = len(set(re.findall(r"Subquery:(\d+)", subs)))
        ns = nodes(text).values()
        counts = [str(sum(1 for n, a in ns if f(n, a))) for f in KINDS.values()]
        schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
        cols = sorted({len(x.split(",")) if x else 0 for x in schemas})
        print(f"| {name} | {' | '.join(counts)} | {n_sub} | {len(schemas)} ({','.join(map(str, cols))}) |")


if __name__ == "__main__":
    main(sys.argv)
