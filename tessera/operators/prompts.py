"""Prompt columns and the passage lookup.

Model calls live outside the engine; this is the table work around them.
The passage lookup is a many-to-one left join: a missing passage fails only
that row (``ok = false``, ``error = 'KeyError: <id>'``), like the reference's
per-row ``KeyError``. Catalyst/AQE pick the join strategy from runtime sizes
(a broadcast only when the passage side is measured small).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values from the reference: prompt templates and the two embedding
# task descriptions.
CTX_TEMPLATE = ("context: ", "\nquestion: ")
NOCTX_PREFIX = "question: "
EMBED_INSTRUCT = "Instruct: {task}\nQuery:{text}"


def context_prompt(passage: Column, question: Column) -> Column:
    """``context: {passage}\\nquestion: {question}``."""
    return F.concat(F.lit(CTX_TEMPLATE[0]), passage, F.lit(CTX_TEMPLATE[1]), question)


def no_context_prompt(question: Column) -> Column:
    """``question: {question}``."""
    return F.concat(F.lit(NOCTX_PREFIX), question)


def embed_instruct(task: str, text: Column) -> Column:
    """Instruction-prefixed text for an embedding model."""
    head, tail = EMBED_INSTRUCT.split("{text}")
    return F.concat(F.lit(head.replace("{task}", task)), text, F.lit(tail))


def context_prompts(
    qa: DataFrame,
    passages: DataFrame,
    context_col: str | None = None,
) -> DataFrame:
    """E1/E3 + J1: join passages by ``passage_id``; build the prompt.

    With ``context_col`` (E3, perturbed sets) that column is the context and
    the passage is only the fallback when it is null (SURVEY Q7).
    """
    j = qa.join(passages, "passage_id", "left")
    ctx = F.col("passage") if context_col is None else F.coalesce(F.col(context_col), F.col("passage"))
    ok = ctx.isNotNull()
    return j.withColumn("ok", ok).withColumn(
        "error", F.when(~ok, F.concat(F.lit("KeyError: "), F.col("passage_id")))
    ).withColumn("prompt", F.when(ok, context_prompt(ctx, F.col("question"))))


def no_context_prompts(qa: DataFrame) -> DataFrame:
    return qa.withColumn("prompt", no_context_prompt(F.col("question")))


def passage_or_empty(qa: DataFrame, passages: DataFrame) -> DataFrame:
    """Lookup with default ``''``."""
    return qa.join(passages, "passage_id", "left").withColumn(
        "passage", F.coalesce(F.col("passage"), F.lit(""))
    )
