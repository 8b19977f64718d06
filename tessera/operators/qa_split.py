"""Build the evaluation set from reading items.

Per question: one correct answer becomes the reference, the other correct
answers are positive "generations", and as many wrong answers as positives
(or all, if fewer) are negative generations. Questions without a correct
answer are dropped; one with a single correct answer yields no flat row.

The reference draws with an order-dependent random stream; here every draw
is a hashed uniform of the row's own keys (SURVEY 7.3), so the result does
not depend on partitioning and a SQL oracle can repeat it.

Input: the answers in long form, one row per answer:
``passage_id, passage, question_idx, question, answer_idx, answer, label``
(nested items are exploded into this by :func:`explode_items`). Ranks inside a
question come from a range-partitioned global numbering, not from a window
over the question, so one question holding a large share of all answers is
still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.hashing import hash_u
from tessera.operators.ranking import group_rank

QKEY = ["passage_id", "question_idx"]


def explode_items(items: DataFrame) -> DataFrame:
    """Nested reading items (S1 schema) -> one row per answer."""
    q = items.select(
        F.col("idx").cast("string").alias("passage_id"),
        F.col("passage.text").alias("passage"),
        F.explode("passage.questions").alias("q"),
    )
    a = q.select(
        "passage_id", "passage",
        F.col("q.idx").alias("question_idx"), F.col("q.question").alias("question"),
        F.explode("q.answers").alias("a"),
    )
    return a.select(
        "passage_id", "passage", "question_idx", "question",
        F.col("a.idx").alias("answer_idx"), F.col("a.text").alias("answer"),
        F.col("a.label").alias("label"),
    )


def ranked_answers(answers: DataFrame, seed: int = 42) -> DataFrame:
    """Split per question and rank each side by a hashed draw.

    Adds ``is_correct``, ``n_correct``, ``n_wrong``, ``rank`` (1-based within
    the question and side; correct rank 1 is the reference) and ``_ref``
    (the reference answer). Ranks come from :func:`group_rank` and the
    per-question counts from an aggregate, so a question with a huge answer
    list is not sorted in one task.
    """
    correct = F.col("label") == 1
    draw = hash_u(F.lit(seed), F.when(correct, F.lit("c")).otherwise(F.lit("w")),
                  F.col("passage_id"), F.col("question_idx"), F.col("answer_idx"))
    a = answers.withColumn("is_correct", correct).withColumn("draw", draw)
    # group_rank materialises its layout; the per-question counts and the
    # reference are read from it rather than from the (recomputed) input.
    ranked = group_rank(a, [*QKEY, "is_correct"], ["draw", "answer_idx"])
    ref = F.when(
        F.col("is_correct") & (F.col("rank") == 1),
        F.struct(F.col("answer_idx").alias("idx"), F.col("answer").alias("text")),
    )
    per_q = ranked.groupBy(*QKEY).agg(
        F.count_if(F.col("is_correct")).cast("int").alias("n_correct"),
        F.count_if(~F.col("is_correct")).cast("int").alias("n_wrong"),
        F.max(ref).alias("_ref"),
    )
    return ranked.drop("group_size").join(per_q, QKEY, "inner")


def _with_reference(ranked: DataFrame) -> DataFrame:
    """Keep questions with a correct answer (the reference is attached
    by :func:`ranked_answers`)."""
    return ranked.where(F.col("n_correct") >= 1)


def flat_generations(answers: DataFrame, seed: int = 42) -> DataFrame:
    """One row per generation (label 1 positive, 0 negative); the
    reference is repeated on each row. Adds ``rank`` for ordering (D7)."""
    r = _with_reference(ranked_answers(answers, seed))
    need = F.col("n_correct") - 1
    keep = (F.col("is_correct") & (F.col("rank") > 1)) | (
        ~F.col("is_correct") & (F.col("rank") <= need)
    )
    return r.where(keep).select(
        "passage_id",
        "question_idx",
        "question",
        F.col("_ref.text").alias("reference"),
        F.col("_ref.idx").alias("reference_answer_idx"),
        "answer",
        "answer_idx",
        F.col("is_correct").cast("int").alias("label"),
        "rank",
    )


def nested_questions(answers: DataFrame, seed: int = 42) -> DataFrame:
    """One row per question with the reference and the two generation
    lists (each in draw order)."""
    r = _with_reference(ranked_answers(answers, seed))
    need = F.col("n_correct") - 1
    gen = F.struct(F.col("rank"), F.col("answer_idx").alias("idx"), F.col("answer").alias("text"))
    pos = F.when(F.col("is_correct") & (F.col("rank") > 1), gen)
    neg = F.when(~F.col("is_correct") & (F.col("rank") <= need), gen)

    def ordered(c):
        return F.transform(
            F.array_sort(F.collect_list(c)),
            lambda x: F.struct(x["idx"].alias("idx"), x["text"].alias("text")),
        )

    return r.groupBy(*QKEY).agg(
        F.first("passage").alias("passage"),
        F.first("question").alias("question"),
        F.first("_ref.idx").alias("reference_answer_idx"),
        F.first("_ref.text").alias("reference"),
        ordered(pos).alias("generation_correct"),
        ordered(neg).alias("generation_failed"),
    )


def flat_from_items(items: DataFrame, seed: int = 42) -> DataFrame:
    """Nested reading items (S1) in, flat generation rows out."""
    return flat_generations(explode_items(items), seed)


def class_balance(flat: DataFrame) -> DataFrame:
    """Rows per label."""
    return flat.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
