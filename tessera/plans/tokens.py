"""Token and word metric queries over the F1 fixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import spread

from tessera.functions import metrics as M
from tessera.operators.words import BLANK_CLASS, word_units
from tessera.plans.fixtures import f1_sequences


def _units_rows(seq: DataFrame, units_fn) -> DataFrame:
    """Array shape -> one row per unit; row-local, no shuffle."""
    # inline_outer: the plain generator makes Catalyst infer a size() > 0
    # filter that re-evaluates the whole metric expression below the
    # projection; the outer form does not, and empty inputs are dropped here.
    units = seq.select("eval_id", F.inline_outer(units_fn(F.col("steps")))).where(
        F.col("index").isNotNull()
    )
    return units.select(
        F.col("eval_id").cast("bigint").alias("eval_id"),
        F.col("index").cast("bigint").alias("idx"),
        "text_unit",
        F.round("value", 6).alias("value"),
    )


def q_token_ll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _units_rows(f1_sequences(spark, sf_dir), M.token_ll)


def q_token_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _units_rows(f1_sequences(spark, sf_dir), M.token_nll)


def q_token_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _units_rows(f1_sequences(spark, sf_dir), M.token_entropy)


def q_token_entropy_mixed_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4 with 1..5 alternatives per step: K = 1 gives 0.0."""
    return _units_rows(f1_sequences(spark, sf_dir, mixed_k=True), M.token_entropy)


def q_token_inflection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _units_rows(f1_sequences(spark, sf_dir), M.token_inflection)


def q_uncertain_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per sequence, how many tokens have entropy above the threshold."""
    t = _units_rows(f1_sequences(spark, sf_dir), M.token_entropy)
    return t.groupBy("eval_id").agg(
        F.count(F.lit(1)).alias("n_tokens"),
        F.count_if(M.uncertain(F.col("value"))).alias("n_uncertain"),
    )


def token_long(seq: DataFrame, value_fn=M.step_entropy, clustered: bool = False) -> DataFrame:
    """Array shape -> long shape ``(eval_id, pos, token, value)``.

    Unless the caller's rows are already hash-partitioned by ``eval_id``
    (``clustered``), repartition the (few, wide) sequence rows once; the
    exploded rows inherit that partitioning, so the word windows and the
    word aggregate add no further exchange.
    """
    src = seq if clustered else spread(seq, "eval_id")
    return (
        src
        .select("eval_id", F.posexplode_outer("steps").alias("pos", "step"))
        .where(F.col("step").isNotNull() & (F.size("step") > 0))
        .select(
            "eval_id",
            "pos",
            F.col("step")[0]["decoded_token"].alias("token"),
            value_fn(F.col("step")).alias("value"),
        )
    )


def q_word_mean_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = word_units(token_long(f1_sequences(spark, sf_dir), clustered=True), ["eval_id"])
    return words.select(
        F.col("eval_id").cast("bigint").alias("eval_id"),
        F.col("index").cast("bigint").alias("idx"),
        "text_unit",
        F.round("value", 6).alias("value"),
    )


# ------------------------------------------------------------------ oracle

F1_SQL = """
toks as (
  select conv_id, turn, conv_id * 100 + turn as eval_id,
         unnest(string_split(text, ' ')) as raw_tok,
         unnest(range(len(string_split(text, ' ')))) as pos
  from conversations
),
alts as (
  select eval_id, pos,
         case when pos = 0 then raw_tok else ' ' || raw_tok end as tok,
         r.k,
         -(0.1 + 8 * ('0x' || substr(md5(concat_ws('|', conv_id, turn, pos, r.k)), 1, 6))::BIGINT / 16777216.0) as lp,
         KSEL as kk
  from toks, range(5) r(k)
),
alts_k as (select * from alts where k < kk),
st as (
  select eval_id, pos, any_value(tok) as tok, count(*) as kn, max(lp) as m,
         max(lp) filter (where k = 0) as ll
  from alts_k group by eval_id, pos
),
lse as (
  select a.eval_id, a.pos, st.m + ln(sum(exp(a.lp - st.m))) as lse
  from alts_k a join st using (eval_id, pos) group by a.eval_id, a.pos, st.m
),
ent as (
  select a.eval_id, a.pos, st.tok, st.ll,
         case when st.kn <= 1 then 0.0
              else -sum(exp(a.lp - l.lse) * (a.lp - l.lse)) / ln(st.kn) end as h
  from alts_k a join st using (eval_id, pos) join lse l using (eval_id, pos)
  group by a.eval_id, a.pos, st.tok, st.ll, st.kn
)
"""


def _f1_sql(mixed_k: bool = False) -> str:
    ksel = (
        "1 + ('0x' || substr(md5(concat_ws('|', 'K', conv_id, turn, pos)), 1, 8))::BIGINT % 5"
        if mixed_k
        else "5"
    )
    return "with " + F1_SQL.replace("KSEL", ksel)


def oracle() -> dict[str, str]:
    base = _f1_sql()
    return {
        "token_ll": base
        + "select eval_id::BIGINT as eval_id, pos::BIGINT as idx, tok as text_unit, round(ll, 6) as value from ent",
        "token_nll": base
        + "select eval_id::BIGINT as eval_id, pos::BIGINT as idx, tok as text_unit, round(-ll, 6) as value from ent",
        "token_entropy": base
        + "select eval_id::BIGINT as eval_id, pos::BIGINT as idx, tok as text_unit, round(h, 6) as value from ent",
        "token_entropy_mixed_k": _f1_sql(True)
        + "select eval_id::BIGINT as eval_id, pos::BIGINT as idx, tok as text_unit, round(h, 6) as value from ent",
        "token_inflection": base
        + """select eval_id::BIGINT as eval_id, pos::BIGINT as idx, tok as text_unit,
                  round(ll - lag(ll) over (partition by eval_id order by pos), 6) as value from ent""",
        "uncertain_tokens": base
        + """select eval_id::BIGINT as eval_id, count(*)::BIGINT as n_tokens,
                  count(*) filter (where round(h, 6) > 0.8)::BIGINT as n_uncertain
             from ent group by eval_id""",
        "word_mean_entropy": base
        + r"""
, f as (
  select eval_id, pos, tok, h,
         left(tok, 1) in (' ', 'Ġ', chr(10), chr(9)) as cand,
         regexp_matches(tok, '[^BLANKS]') as nb
  from ent
),
g as (
  select *,
    max(case when nb then pos end) over (partition by eval_id order by pos rows between unbounded preceding and 1 preceding) as last_nb,
    coalesce(max(case when cand then pos end) over (partition by eval_id order by pos rows between unbounded preceding and 1 preceding), 0) as prev_cand
  from f
),
s as (
  select *, sum(case when cand and pos > 0 and coalesce(last_nb >= prev_cand, false) then 1 else 0 end)
            over (partition by eval_id order by pos rows between unbounded preceding and current row) as word
  from g
)
select eval_id::BIGINT as eval_id, word::BIGINT as idx,
       string_agg(tok, '' order by pos) as text_unit, round(avg(h), 6) as value
from s group by eval_id, word
having string_agg(tok, '' order by pos) <> ''
""".replace("BLANKS", BLANK_CLASS),
    }


QUERIES = {
    "token_ll": q_token_ll,
    "token_nll": q_token_nll,
    "token_entropy": q_token_entropy,
    "token_entropy_mixed_k": q_token_entropy_mixed_k,
    "token_inflection": q_token_inflection,
    "uncertain_tokens": q_uncertain_tokens,
    "word_mean_entropy": q_word_mean_entropy,
}
