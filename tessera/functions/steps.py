"""Step data model: one decoding step = ordered list of alternatives.

Alternative: ``struct<decoded_token: string, logprob: double, rank: int>``.
Step: ``array<alternative>``; element 0 is the token actually chosen.
Sequence (array shape): ``array<step>``; a step may be null (no logprobs).

Raw files carry steps as JSON ``[null | {token_id: {decoded_token, logprob,
rank}}]`` where the object order is meaningful. ``from_json`` into a map keeps
that order, so ``map_values`` yields the alternatives in file order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALT = T.StructType(
    [
        T.StructField("decoded_token", T.StringType()),
        T.StructField("logprob", T.DoubleType()),
        T.StructField("rank", T.IntegerType()),
    ]
)
STEP = T.ArrayType(ALT)
SEQ = T.ArrayType(STEP)

# Raw JSON layouts.
RAW_PROMPT_STEPS = T.ArrayType(T.MapType(T.StringType(), ALT))
TOP_ALT = T.StructType(
    [T.StructField("token", T.StringType()), T.StructField("logprob", T.DoubleType())]
)
RAW_TOP_STEPS = T.ArrayType(
    T.StructType(
        [
            T.StructField("token", T.StringType()),
            T.StructField("logprob", T.DoubleType()),
            T.StructField("top_logprobs", T.ArrayType(TOP_ALT)),
        ]
    )
)

UNIT = T.StructType(
    [
        T.StructField("value", T.DoubleType()),
        T.StructField("index", T.IntegerType()),
        T.StructField("text_unit", T.StringType()),
    ]
)
UNITS = T.ArrayType(UNIT)


def chosen(step: Column) -> Column:
    """The chosen alternative of a step (null for a null or empty step)."""
    return F.get(step, 0)


def decode_prompt_steps(json_col: Column) -> Column:
    """JSON step list -> ``array<step>``.

    Null steps stay null; an empty object becomes null too (the reference
    cannot read one, see SURVEY Q4); alternatives keep the object order.
    """
    parsed = F.from_json(json_col, RAW_PROMPT_STEPS)
    return F.transform(
        parsed,
        lambda m: F.when(F.size(m) > 0, F.map_values(m)),
    )


def decode_top_steps(json_col: Column) -> Column:
    """Generated-answer steps: ``top_logprobs`` renamed to the step layout.

    As in the reference, alternative 0 of ``top_logprobs`` is taken as the
    chosen token (SURVEY Q11); ``rank`` is not present there and stays null.
    """
    parsed = F.from_json(json_col, RAW_TOP_STEPS)
    return F.transform(
        parsed,
        lambda s: F.transform(
            s["top_logprobs"],
            lambda a: F.struct(
                a["token"].alias("decoded_token"),
                a["logprob"].alias("logprob"),
                F.lit(None).cast("int").alias("rank"),
            ),
        ),
    )


def steps_valid(seq: Column) -> Column:
    """True when the JSON parsed and every alternative has a logprob.

    ``from_json`` turns bad text into null and accepts a null logprob where
    the reference's validator raises; rows failing this go to quarantine.
    """
    return seq.isNotNull() & F.forall(
        seq,
        lambda s: s.isNull() | F.forall(s, lambda a: a["logprob"].isNotNull()),
    )


def encode_steps(seq: Column) -> Column:
    """Inverse of :func:`decode_prompt_steps` for writers that need JSON (K1)."""
    return F.to_json(
        F.transform(
            seq,
            lambda s: F.when(
                s.isNotNull(),
                F.map_from_arrays(
                    F.transform(s, lambda a, i: i.cast("string")), s
                ),
            ),
        )
    )


def decode_units(json_col: Column) -> Column:
    """Text-unit metric JSON -> ``array<struct<value,index,text_unit>>``."""
    return F.from_json(json_col, UNITS)


def encode_units(units: Column) -> Column:
    return F.to_json(units)
