"""Projections and filters around the evaluators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ok_rows(df: DataFrame) -> DataFrame:
    """Keep ``ok`` rows (a null ``ok`` drops the row). With ``ok`` stored
    as a real column the predicate reaches the parquet scan."""
    return df.where(F.col("ok"))


def usable(score: str) -> Column:
    """Ok, and a score that is a number (never null)."""
    s = F.col(score)
    return F.coalesce(F.col("ok") & s.isNotNull() & ~F.isnan(s), F.lit(False))


def scored_rows(df: DataFrame, score: str) -> tuple[DataFrame, DataFrame]:
    """Ok rows with a usable score, plus one row of counts ``kept,
    failed``. Where the rows are written anyway,
    :func:`tessera.sources.io.write_evaluated` counts in the same pass."""
    good = usable(score)
    counts = df.agg(F.count_if(good).alias("kept"), F.count_if(~good).alias("failed"))
    return df.where(good), counts


def to_judge_columns(df: DataFrame) -> DataFrame:
    """The judge library's column names."""
    return df.withColumnsRenamed({"question": "user_input", "answer": "response"})


def typed_eval_rows(df: DataFrame) -> DataFrame:
    """P5: typed evaluation rows; ``passage_id`` is normalised through an
    integer (``str(int(x))``), unparsable values become null and the row
    fails instead of the job (SURVEY Q15: a null answer -> ``ok = false``)."""
    pid = F.col("passage_id").cast("string").try_cast("long")
    out = df.withColumn(
        "passage_id", F.coalesce(pid.cast("string"), F.col("passage_id").cast("string"))
    ).withColumn("label", F.col("label").cast("int"))
    bad = F.col("answer").isNull() | F.col("question").isNull()
    return out.withColumn("ok", ~bad).withColumn(
        "error", F.when(bad, F.lit("ValueError: empty question or answer"))
    )


def drop_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Remove rows whose id is listed; a left-anti join, so the list
    may be as long as the table."""
    return df.join(ids.select(key).distinct(), key, "left_anti")


def with_score(df: DataFrame, score: Column, name: str = "score",
               keep: tuple[str, ...] = ("eval_id", "label")) -> DataFrame:
    """Append the computed score and project the result columns."""
    return df.select(*keep, score.alias(name))
