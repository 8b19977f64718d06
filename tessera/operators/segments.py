"""Map prompt steps to the parts of the prompt.

Given the step list of a prompt + answer and ``prefix_length``, each prompt
token is assigned to ``instruct``, ``context`` or ``question`` by overlapping
its character range with the ``context: `` / ``question: `` markers in the
rebuilt prompt text; steps from ``prefix_length`` on form the ``answer``.

Shape: markers and the first and last token of context and question are
row-local (array shape, ``locate`` and a fold over the token lengths), so a
prompt is mapped in one pass without a shuffle, a sort or a window, however
long it is. Rows that share their ``eval_id`` are taken for one prompt: their
steps are ordered by position and their offsets are running sums of a window
partitioned by ``eval_id`` (long shape).

Decisions (SURVEY 8.2): original positions are used for every step (Q3); an
empty step counts as a null step (Q4); a row without a question token goes to
quarantine with ``error = 'question is empty tokens'`` (G10).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialize, spread

from tessera.functions.steps import SEQ

# Fixed values from the reference: prompt markers and the segment names.
CTX_MARKER = "context: "
Q_MARKER = "question: "
SEGMENTS = ("instruct", "context", "question", "answer")
EMPTY_QUESTION_ERROR = "question is empty tokens"


def _prefix_tokens(steps: Column, prefix_length: Column) -> Column:
    prefix = F.slice(steps, 1, F.greatest(prefix_length, F.lit(0)))
    return F.transform(prefix, lambda s: F.get(s, 0)["decoded_token"])


def prompt_markers(df: DataFrame, steps: str, prefix_length: str, question: str) -> DataFrame:
    """Row-local G2-G5: rebuilt prompt and marker positions (0-based, -1 = none)."""
    prompt = F.array_join(_prefix_tokens(F.col(steps), F.col(prefix_length)), "")
    d = df.withColumn("_prompt", prompt)
    cpos = F.locate(CTX_MARKER, F.col("_prompt")) - 1
    d = d.withColumn(
        "ctx_start", F.when(cpos >= 0, cpos + len(CTX_MARKER)).otherwise(F.lit(-1))
    )
    qfrom = F.when(F.col("ctx_start") >= 0, F.col("ctx_start")).otherwise(F.lit(0))
    d = d.withColumn("_qfrom", qfrom + 1)
    # locate with a per-row start position is only exposed through SQL.
    d = d.withColumn("_qpos", F.expr(f"locate('{Q_MARKER}', _prompt, _qfrom)") - 1)
    d = d.withColumn(
        "q_start",
        F.when(F.col("_qpos") >= 0, F.col("_qpos") + len(Q_MARKER)).otherwise(F.lit(-1)),
    )
    d = d.withColumn(
        "q_end",
        F.when(
            F.col("q_start") >= 0, F.col("q_start") + F.coalesce(F.char_length(question), F.lit(0))
        ).otherwise(F.lit(-1)),
    )
    d = d.withColumn(
        "ctx_end",
        F.when(
            F.col("ctx_start") >= 0,
            F.when(F.col("_qpos") >= 0, F.col("_qpos")).otherwise(F.char_length("_prompt")),
        ).otherwise(F.lit(-1)),
    )
    return d.drop("_prompt", "_qpos", "_qfrom")


def segment_steps(
    df: DataFrame,
    key: str = "eval_id",
    steps: str = "prompt_logprob",
    prefix_length: str = "prefix_length",
    question: str = "question",
    top_steps: str | None = None,
    clustered: bool = False,
) -> DataFrame:
    """Long table ``key, segment, pos, step`` for rows with a question token.

    Generated-answer steps (``top_steps``, optional, SURVEY P8/Q12) are
    appended after the prompt steps, so they follow the answer in order.
    ``clustered``: the caller's rows are already hash-partitioned by ``key``.
    """
    marked = prompt_markers(df, steps, prefix_length, question)
    n_prompt = F.size(F.col(steps))
    all_steps = F.col(steps)
    if top_steps is not None:
        all_steps = F.concat(all_steps, F.coalesce(F.col(top_steps), F.array().cast(SEQ)))
    # The bound is taken before the rows are exploded: an expression on the
    # array beside the generator would copy the whole array into every row.
    marked = marked.select(
        key, "ctx_start", "ctx_end", "q_start", "q_end",
        F.least(F.col(prefix_length), n_prompt).alias("_pl"), all_steps.alias("_steps"),
    )
    twice = repeated_keys(df, key)
    if twice is None:
        return _segments_of_rows(marked, key)
    same = twice["_key"].eqNullSafe(marked[key])
    several = marked.join(twice, same, "left_semi")
    return _segments_of_rows(marked.join(twice, same, "left_anti"), key).unionByName(
        _segments_of_keys(several if clustered else spread(several, key), key)
    )


def repeated_keys(df: DataFrame, key: str) -> DataFrame | None:
    """The keys of several rows as ``_key`` (a key is counted from the narrow
    rows, no step is made for it); None if there are none."""
    twice = materialize(df.groupBy(F.col(key).alias("_key")).count().where("count > 1").select("_key"))
    return None if twice.isEmpty() else twice


def _token_length(step: Column) -> Column:
    return F.char_length(F.get(step, 0)["decoded_token"])


def _exploded(marked: DataFrame, *kept: str) -> DataFrame:
    # outer form: no inferred size() filter re-evaluating the steps
    return marked.select(*kept, F.posexplode_outer("_steps").alias("pos", "step"))


def _overlaps(start: Column, length: Column, lo: Column, hi: Column) -> Column:
    """Whether a token has a character in ``[lo, hi)``; -1 is no range, and an
    empty one has no character that a token could hold."""
    return (lo >= 0) & (length > 0) & (hi > lo) & (start < hi) & (start + length > lo)


def _segments_of_rows(marked: DataFrame, key: str) -> DataFrame:
    """Segments of rows that are alone with their key. The tokens of a prompt
    follow one another, so those in a range of characters lie between a first
    and a last one: one fold over the lengths finds these, without a window."""
    lengths = F.transform(F.slice("_steps", 1, F.greatest(F.col("_pl"), F.lit(0))), lambda s: F.coalesce(_token_length(s), F.lit(0)))

    def step(a: Column, n: Column) -> Column:
        ctx = _overlaps(a["upto"], n, F.col("ctx_start"), F.col("ctx_end"))
        q = _overlaps(a["upto"], n, F.col("q_start"), F.col("q_end"))
        return F.struct(
            (a["i"] + 1).alias("i"), (a["upto"] + n).alias("upto"),
            F.when(ctx, F.coalesce(a["c0"], a["i"])).otherwise(a["c0"]).alias("c0"), F.when(ctx, a["i"]).otherwise(a["c1"]).alias("c1"),
            F.when(q, F.coalesce(a["q0"], a["i"])).otherwise(a["q0"]).alias("q0"), F.when(q, a["i"]).otherwise(a["q1"]).alias("q1"),
        )

    none = F.lit(None).cast("int")
    start = F.struct(
        F.lit(0).alias("i"), F.lit(0).alias("upto"), none.alias("c0"), none.alias("c1"), none.alias("q0"), none.alias("q1")
    )
    ex = _exploded(marked.select(key, "_pl", "_steps", F.aggregate(lengths, start, step).alias("_at")), key, "_pl", "_at")
    pos, at, held = F.col("pos"), F.col("_at"), _token_length(F.col("step")) > 0
    # The rows without a question go with the step's own filter: one on the fold alone would be pushed below it and fold twice.
    return _named(
        ex, key, at["q0"].isNotNull() & F.col("step").isNotNull() & (F.size("step") > 0), F.least(at["c0"], at["q0"]),
        held & pos.between(at["c0"], at["c1"]), held & pos.between(at["q0"], at["q1"]),
    )


def _segments_of_keys(marked: DataFrame, key: str) -> DataFrame:
    """Segments of keys, whose rows are taken for one prompt: its characters
    are counted over all their steps in order."""
    ex = _exploded(marked, key, "ctx_start", "ctx_end", "q_start", "q_end", "_pl").where(F.col("step").isNotNull() & (F.size("step") > 0))
    ex = ex.withColumn("_len", F.when(F.col("pos") < F.col("_pl"), _token_length(F.col("step"))).otherwise(F.lit(0)))
    w = Window.partitionBy(key).orderBy("pos")
    start = F.coalesce(F.sum("_len").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ex = ex.withColumn("_start", start)
    in_ctx, in_q = (_overlaps(F.col("_start"), F.col("_len"), F.col(f"{r}_start"), F.col(f"{r}_end")) for r in ("ctx", "q"))
    ex = ex.withColumn("_in_ctx", in_ctx).withColumn("_in_q", in_q)
    whole = Window.partitionBy(key)
    ex = ex.withColumns({
        "_fni": F.min(F.when(F.col("_in_ctx") | F.col("_in_q"), F.col("pos"))).over(whole),
        "_has_q": F.max(F.col("_in_q").cast("int")).over(whole),
    })
    return _named(ex, key, F.col("_has_q") == 1, F.col("_fni"), F.col("_in_ctx"), F.col("_in_q"))


def _named(ex: DataFrame, key: str, kept: Column, first: Column, in_ctx: Column, in_q: Column) -> DataFrame:
    seg = (
        F.when(~F.coalesce(kept, F.lit(False)), F.lit(None))
        .when(F.col("pos") >= F.col("_pl"), F.lit("answer"))
        .when(F.col("pos") < first, F.lit("instruct"))
        .when(in_ctx, F.lit("context"))
        .when(in_q, F.lit("question"))
    )
    return ex.select(key, seg.alias("segment"), "pos", "step").where(F.col("segment").isNotNull())


def segment_quarantine(
    df: DataFrame,
    key: str = "eval_id",
    steps: str = "prompt_logprob",
    prefix_length: str = "prefix_length",
    question: str = "question",
) -> DataFrame:
    """Keys whose question covers no prompt token, with the error text."""
    seg = segment_steps(df, key, steps, prefix_length, question)
    has_q = seg.where(F.col("segment") == "question").select(key).distinct()
    return (
        df.select(key)
        .join(has_q, key, "left_anti")
        .select(key, F.lit(False).alias("ok"), F.lit(EMPTY_QUESTION_ERROR).alias("error"))
    )


def parted_arrays(seg: DataFrame, key: str = "eval_id") -> DataFrame:
    """Back to the array shape: one row per key with the four step lists
    (the segmented-logprobs file of the reference)."""
    g = seg.groupBy(key).agg(
        *[
            F.transform(
                F.array_sort(
                    F.collect_list(F.when(F.col("segment") == s, F.struct("pos", "step")))
                ),
                lambda x: x["step"],
            ).alias(s)
            for s in SEGMENTS
        ]
    )
    return g
