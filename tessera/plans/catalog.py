"""Registry of the named queries and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


def _modules():
    from tessera.plans import evalsets, evaluators, files, perturb, qa, reports, samples, scoring, sequences, tokens, training

    return [tokens, reports, sequences, qa, samples, scoring, perturb, evalsets, evaluators, files, training]


def queries() -> dict[str, QueryFn]:
    out: dict[str, QueryFn] = {}
    for mod in _modules():
        for name, fn in mod.QUERIES.items():
            if name in out:
                raise RuntimeError(f"duplicate query {name}")
            out[name] = fn
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for mod in _modules():
        out.update(mod.oracle())
    return out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.plans import reports

    return reports.flagship(spark, sf_dir)
