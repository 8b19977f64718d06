"""Metrics applied by name to segmented steps.

Input is the long shape ``eval_id, segment, pos, step``; every metric of the
registry, the word metric included, returns ``eval_id, segment, idx,
text_unit, value``. ``parted_scores`` folds them into one row per answer with
a column per segment, the layout of the scores file (K3).
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import metrics as M
from tessera.operators.words import word_places, word_units

SEGMENTS = ("instruct", "context", "question", "answer")


def _by_step(seg: DataFrame, fn: M.MetricFn) -> DataFrame:
    w = Window.partitionBy("eval_id", "segment").orderBy("pos")
    return seg.select(
        "eval_id", "segment",
        (F.row_number().over(w) - 1).cast("bigint").alias("idx"),
        F.col("step")[0]["decoded_token"].alias("text_unit"),
        fn(F.col("step")).alias("value"),
    )


def _by_sequence(seg: DataFrame, fn: M.MetricFn) -> DataFrame:
    # A segment's steps are the elements of one answer's row.
    steps = F.transform(F.array_sort(F.collect_list(F.struct("pos", "step"))), lambda x: x["step"])
    units = seg.groupBy("eval_id", "segment").agg(steps.alias("_steps")).select("eval_id", "segment", F.inline_outer(fn(F.col("_steps"))))
    return units.where(F.col("index").isNotNull()).select("eval_id", "segment", F.col("index").cast("bigint").alias("idx"), "text_unit", "value")


def _by_word(seg: DataFrame, fn: M.MetricFn) -> DataFrame:
    tokens = seg.select("eval_id", "segment", "pos", F.col("step")[0]["decoded_token"].alias("token"), fn(F.col("step")).alias("value"))
    return word_units(tokens, ["eval_id", "segment"]).select(
        "eval_id", "segment", F.col("index").cast("bigint").alias("idx"), "text_unit", "value"
    )


_FORMS = {"step": _by_step, "sequence": _by_sequence, "word": _by_word}


def apply_metric(seg: DataFrame, name: str) -> DataFrame:
    """One named metric over all segments; an unknown name is an error."""
    kind, fn = M.find_metric(name)
    return _FORMS[kind](seg, fn)


def apply_metrics(seg: DataFrame, names: Iterable[str]) -> DataFrame:
    """The units of :func:`apply_metric` for several names, with the column
    ``metric``. The steps are made and read once for all step and word
    metrics: a word's tokens give their own units and the word's."""
    found = {name: M.find_metric(name) for name in names}
    parts = [apply_metric(seg, n).withColumn("metric", F.lit(n)) for n, m in found.items() if m.kind == "sequence"]
    step, word = ({n: m.fn for n, m in found.items() if m.kind == kind} for kind in ("step", "word"))
    values = {fn: f"_v{k}" for k, fn in enumerate(dict.fromkeys([*step.values(), *word.values()]))}  # an expression is evaluated once
    if values:
        keys = ["eval_id", "segment"]
        tokens = seg.select(*keys, "pos", F.col("step")[0]["decoded_token"].alias("token"), *(fn(F.col("step")).alias(c) for fn, c in values.items()))
        listed = F.array_sort(F.collect_list(F.struct("_rn", "token", *values.values())))
        words = word_places(tokens, keys).groupBy(*keys, "_word").agg(listed.alias("_tokens"), *(F.avg(c).alias(c) for c in values.values()))
        words = words.withColumn("_text", F.array_join(F.transform("_tokens", lambda t: t["token"]), ""))

        def unit(name: str, idx: Column, text: Column, value: Column) -> Column:
            return F.struct(F.lit(name).alias("metric"), idx.cast("bigint").alias("idx"), text.alias("text_unit"), value.alias("value"))

        def of_tokens(name: str, c: str) -> Column:
            return F.transform("_tokens", lambda t: unit(name, t["_rn"], t["token"], t[c]))

        units = [of_tokens(n, values[fn]) for n, fn in step.items()]
        if word:
            own = F.array(*(unit(n, F.col("_word"), F.col("_text"), F.col(values[fn])) for n, fn in word.items()))
            units.append(F.filter(own, lambda u: u["text_unit"] != ""))
        one = words.select(*keys, F.inline_outer(F.concat(*units))).where(F.col("metric").isNotNull())
        parts.append(one)
    cols = ["metric", "eval_id", "segment", "idx", "text_unit", "value"]
    return reduce(DataFrame.unionByName, [p.select(*cols) for p in parts])


def apply_to_sequences(rows: DataFrame, name: str, key: str = "eval_id", steps: str = "steps") -> DataFrame:
    """The same metric over a table of step arrays: ``key, idx, text_unit, value``."""
    kind, _ = M.find_metric(name)
    if kind != "word":
        units = rows.select(key, F.inline_outer(M.get_metric(name)(F.col(steps)))).where(F.col("index").isNotNull())
        return units.select(key, F.col("index").cast("bigint").alias("idx"), "text_unit", "value")
    long = rows.select(F.col(key).alias("eval_id"), F.lit("").alias("segment"), F.posexplode_outer(steps).alias("pos", "step"))
    long = long.where(F.col("step").isNotNull() & (F.size("step") > 0))
    return apply_metric(long, name).select(F.col("eval_id").alias(key), "idx", "text_unit", "value")


def parted_scores(units: DataFrame) -> DataFrame:
    """``eval_id`` and four ordered unit lists (empty where a segment has none)."""
    kind = "array<struct<value:double,index:int,text_unit:string>>"
    unit = F.struct(F.col("idx").cast("int").alias("index"), "value", "text_unit")

    def column(segment: str):
        # A segment's units are the elements of one answer's row of the file.
        listed = F.array_sort(F.collect_list(F.when(F.col("segment") == segment, unit)))
        return F.transform(
            listed, lambda u: F.struct(u["value"].alias("value"), u["index"].alias("index"), u["text_unit"].alias("text_unit"))
        ).cast(kind).alias(segment)

    return units.groupBy("eval_id").agg(*(column(s) for s in SEGMENTS))
