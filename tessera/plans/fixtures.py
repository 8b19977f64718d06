"""Derived inputs built from the shared tables (FIXTURES.md section C).

The reference ships no data, so each operator family is fed by a
deterministic derivation that a DuckDB oracle can rebuild: every random
value is a hashed draw of the row's own keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.hashing import hash32, hash_hex, hash_key
from tessera.functions.metrics import _let
from tessera.functions.steps import STEP
from tessera.session import spread
from tessera.sources.tables import read_table

# Fixed values of the fixtures (FIXTURES.md): alternatives per step and the
# logprob scale ``lp = -(0.1 + 8 * v / 16777216)`` with v = 6 hex digits.
N_ALTS = 5
LP_BASE = 0.1
LP_SPAN = 8.0
HEX6 = 16777216.0
END_MARKERS = " <end> <model>"
DOC_STRIDE = 8


def split_tokens(text: Column) -> Column:
    """Split on one blank; every token after the first keeps its blank."""
    return F.transform(
        F.split(text, " ", -1),
        lambda t, i: F.when(i == 0, t).otherwise(F.concat(F.lit(" "), t)),
    )


def _logprob(draw: Column) -> Column:
    return -(F.lit(LP_BASE) + F.lit(LP_SPAN) * draw / F.lit(HEX6))


def make_step(token: Column, n_alts: Column | int, *key_parts) -> Column:
    """One synthetic step: alternative 0 is the chosen token, the others are
    placeholders; logprobs are hashed from ``key_parts | k``.

    With a fixed ``n_alts`` the alternatives are written out and the key they
    share is joined once per step: an inner lambda costs about twice the hash.
    """
    if not isinstance(n_alts, Column):

        def alternatives(key: Column) -> Column:
            draws = [F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{k}"))), 1, 6), 16, 10).cast("bigint") for k in range(n_alts)]
            tokens = [token, *(F.lit(f"#{k}") for k in range(1, n_alts))]
            return F.array(*(
                F.struct(t.alias("decoded_token"), _logprob(u).alias("logprob"), F.lit(k + 1).alias("rank"))
                for k, (t, u) in enumerate(zip(tokens, draws))
            ))

        return _let(hash_key(*key_parts), alternatives)
    return F.transform(
        F.sequence(F.lit(0), n_alts - 1),
        lambda k: F.struct(
            F.when(k == 0, token).otherwise(F.concat(F.lit("#"), k.cast("string"))).alias(
                "decoded_token"
            ),
            _logprob(hash_hex(6, *key_parts, k)).alias("logprob"),
            (k + 1).alias("rank"),
        ),
    ).cast(STEP)


def f1_sequences(spark: SparkSession, sf_dir: str, mixed_k: bool = False) -> DataFrame:
    """one row per conversation turn, ``steps`` in array shape.

    ``eval_id = conv_id * 100 + turn``. With ``mixed_k`` the number of
    alternatives per step is ``1 + h('K', conv_id, turn, pos) % 5``.
    """
    conv = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")

    def step(tok: Column, pos: Column) -> Column:
        k = (
            (F.lit(1) + hash32(F.lit("K"), F.col("conv_id"), F.col("turn"), pos) % N_ALTS).cast("int")
            if mixed_k
            else F.lit(N_ALTS)
        )
        return make_step(tok, k, F.col("conv_id"), F.col("turn"), pos)

    # Hash-partition the narrow rows by eval_id before the CPU-heavy
    # expansion: the expansion runs in parallel even when the scan is a
    # single split, and later windows over eval_id reuse this partitioning.
    rows = conv.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("eval_id"), "conv_id", "turn", "text"
    )
    rows = spread(rows, "eval_id")
    return rows.select(
        "eval_id",
        "conv_id",
        "turn",
        F.transform(split_tokens(F.col("text")), step).alias("steps"),
    )


def f2_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question/answer pairs with a passage, prompt text and steps.

    Columns follow the logprobs file of the reference plus the prompt parts:
    ``eval_id, passage_id, label, question, answer, passage, ctx, prompt,
    prompt_logprob (array<step>), prefix_length, ok, error``.
    Steps: a null step at 0, then the tokens of ``prompt + ' <end> <model>'``,
    then the answer tokens; ``prefix_length`` = 1 + prompt tokens.
    """
    conv = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    n_docs = docs.select(F.count(F.lit(1))).scalar()

    q = conv.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("question")
    )
    a = conv.where(F.col("role") == "assistant").select(
        F.col("conv_id").alias("a_conv"), F.col("turn").alias("a_turn"), F.col("text").alias("answer")
    )
    qa = q.join(
        a, (a["a_conv"] == q["conv_id"]) & (a["a_turn"] == q["turn"] + 1), "inner"
    ).withColumn("doc_key", (F.col("conv_id") * DOC_STRIDE + F.col("turn")) % n_docs)
    d = docs.select(F.col("doc_id"), F.col("text").alias("passage"))
    qa = qa.join(d, qa["doc_key"] == d["doc_id"], "inner").join(labels, "doc_id", "left")

    ctx = F.col("passage")  # the whole passage
    prompt = F.concat(F.lit("context: "), F.col("ctx"), F.lit("\n"), F.lit("question: "), F.col("question"))
    eval_id = F.col("conv_id") * 100 + F.col("turn")
    ok = hash32(F.lit("ok"), F.col("conv_id"), F.col("turn")) % 20 != 0

    base = qa.select(
        eval_id.alias("eval_id"),
        F.col("doc_id").cast("string").alias("passage_id"),
        F.coalesce(F.col("quality"), F.lit(0)).cast("int").alias("label"),
        "question",
        "answer",
        "passage",
        ctx.alias("ctx"),
        ok.alias("ok"),
    ).withColumn("prompt", prompt)
    base = spread(base, "eval_id")

    # Split once: both the steps and the prefix length are taken from it.
    base = base.withColumn("prompt_toks", split_tokens(F.concat(F.col("prompt"), F.lit(END_MARKERS))))
    prompt_toks = F.col("prompt_toks")
    answer_toks = split_tokens(F.col("answer"))
    all_toks = F.concat(F.array(F.lit(None).cast("string")), prompt_toks, answer_toks)
    steps = F.transform(
        all_toks,
        lambda t, i: F.when(t.isNotNull(), make_step(t, N_ALTS, F.col("eval_id"), i)),
    )
    return base.select(
        "eval_id",
        "passage_id",
        "label",
        "question",
        "answer",
        "passage",
        "ctx",
        "prompt",
        F.when(F.col("ok"), steps).otherwise(F.array().cast("array<array<struct<decoded_token:string,logprob:double,rank:int>>>")).alias("prompt_logprob"),
        F.when(F.col("ok"), F.size(prompt_toks) + 1).otherwise(F.lit(0)).alias("prefix_length"),
        "ok",
        F.when(~F.col("ok"), F.lit("ScorerError: no logprobs")).alias("error"),
    )


def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turn + next assistant turn, with a passage key of which some do
    not exist: ``(conv_id * 37 + turn) % (n_docs + 50)`` (exercises J1)."""
    conv = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    n_docs = read_table(spark, sf_dir, "documents").select(F.count(F.lit(1))).scalar()
    q = conv.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    a = conv.where(F.col("role") == "assistant").select(
        F.col("conv_id").alias("a_conv"), F.col("turn").alias("a_turn"), F.col("text").alias("answer")
    )
    qa = q.join(a, (a["a_conv"] == q["conv_id"]) & (a["a_turn"] == q["turn"] + 1), "inner")
    return qa.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("eval_id"),
        ((F.col("conv_id") * 37 + F.col("turn")) % (n_docs + 50)).cast("string").alias("passage_id"),
        "question",
        "answer",
    )
