"""External-score queries: similarity (E6-E8), NLI (E9, E10), judge verdict
aggregates (E12, E13) and the batch scorer contract (E4, E5, E11)."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.hashing import hash32
from tessera.operators import report as R
from tessera.operators import scoring as S
from tessera.plans.fixtures import qa_pairs
from tessera.plans.reports import round_doubles
from tessera.sources.tables import read_table

# Fixture values (FIXTURES F5): NLI label map and logit scale.
ID2LABEL = {0: "entailment", 1: "neutral", 2: "contradiction"}
LOGIT_SCALE = 10.0
VERDICT_KINDS = ("TP", "FP", "FN")
JUDGE_FAIL_MOD = 17


def f4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """answer vector a, reference vector b = a + 1, y = same label."""
    emb = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    pairs = emb.select(
        F.col("vec_id").alias("a_id"), (F.col("vec_id") + 1).alias("b_id"), F.col("label").alias("a_label")
    )
    blab = emb.select(F.col("vec_id").alias("b_id"), F.col("label").alias("b_label"))
    pairs = pairs.join(blab, "b_id", "left")
    scored = S.similarity_rows(pairs, emb, "a_id", "b_id", "vec_id", "embedding")
    return scored.select(
        "a_id", "b_id",
        (F.col("a_label") == F.col("b_label")).cast("int").alias("label"),
        "ok", "score", "error",
    )


def q_similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = f4_pairs(spark, sf_dir)
    return round_doubles(d.select(F.col("a_id").cast("bigint"), F.col("label").cast("bigint"), "ok", "score", "error"))


def q_similarity_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The similarity evaluator's report: ok rows -> AUC / AP."""
    d = f4_pairs(spark, sf_dir).where("ok")
    return round_doubles(R.auc_ap(R.score_table(d)))


def q_nli_entailment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5 + E9: three logits = 10 x the sums over every third embedding value."""
    emb = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    every_third = lambda k: F.aggregate(
        F.filter("embedding", lambda x, i: i % 3 == k), F.lit(0.0), lambda a, x: a + x.cast("double")
    )
    logits = F.array(*(every_third(k) * LOGIT_SCALE for k in range(3)))
    return round_doubles(
        emb.select(F.col("vec_id").cast("bigint"), S.entailment_prob(logits, ID2LABEL).alias("p_entail"))
    )


def f6_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """statements = non-empty pieces of an answer split on '.'."""
    qa = qa_pairs(spark, sf_dir)
    pieces = F.filter(F.split(F.col("answer"), "[.]", -1), lambda p: p != "")
    st = qa.select("eval_id", F.posexplode(pieces).alias("i", "statement"))
    kind = F.element_at(
        F.array(*[F.lit(k) for k in VERDICT_KINDS]),
        (hash32(F.lit("kind"), F.col("eval_id"), F.col("i")) % 3 + 1).cast("int"),
    )
    return st.select(
        "eval_id", "i", "statement",
        (hash32(F.lit("sup"), F.col("eval_id"), F.col("i")) % 3 > 0).alias("supported"),
        kind.alias("kind"),
    )


def q_faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = S.faithfulness(f6_verdicts(spark, sf_dir))
    return round_doubles(f.select(F.col("eval_id").cast("bigint"), F.col("n_statements").cast("bigint"), "faithfulness"))


def q_correctness(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.correctness_f1(f6_verdicts(spark, sf_dir))
    return round_doubles(c.select(
        F.col("eval_id").cast("bigint"), F.col("tp").cast("bigint"), F.col("fp").cast("bigint"),
        F.col("fn").cast("bigint"), "answer_correctness",
    ))


def judge_factory():
    """Stand-in judge (no network): a hashed score of the row id; every
    row whose hash is a multiple of 17 raises, like a refused call."""

    def judge(rec: dict) -> float:
        key = f"judge|{rec['eval_id']}".encode()
        h = int(hashlib.md5(key).hexdigest()[:8], 16)
        if h % JUDGE_FAIL_MOD == 0:
            raise ValueError("judge refused")
        return h / 4294967296.0

    return judge


def q_scorer_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-row external calls in Arrow batches, errors kept."""
    qa = qa_pairs(spark, sf_dir)
    out = S.score_with_function(qa, judge_factory, "eval_id", ["question", "answer"], "answer_accuracy")
    return round_doubles(out.select(F.col("eval_id").cast("bigint"), "ok", "answer_accuracy", "error"))


QUERIES = {
    "similarity_pairs": q_similarity_pairs,
    "similarity_auc": q_similarity_auc,
    "nli_entailment": q_nli_entailment,
    "faithfulness_from_verdicts": q_faithfulness,
    "correctness_from_verdicts": q_correctness,
    "scorer_batch": q_scorer_batch,
}

QA_SQL = """
qa as (
  select q.conv_id * 100 + q.turn as eval_id, q.text as question, a.text as answer
  from conversations q
  join conversations a on a.conv_id = q.conv_id and a.turn = q.turn + 1
       and q.role = 'user' and a.role = 'assistant'
)
"""

F6_SQL = QA_SQL + """,
pc as (select eval_id, list_filter(string_split(answer, '.'), lambda x: x <> '') as ps from qa),
st as (select eval_id, unnest(ps) as statement, unnest(range(len(ps))) as i from pc),
vd as (
  select eval_id, i, statement,
         ('0x' || substr(md5(concat_ws('|', 'sup', eval_id, i)), 1, 8))::BIGINT % 3 > 0 as supported,
         ['TP', 'FP', 'FN'][('0x' || substr(md5(concat_ws('|', 'kind', eval_id, i)), 1, 8))::BIGINT % 3 + 1] as kind
  from st
)
"""

F4_SQL = """
f4 as (
  select a.vec_id as a_id, (a.label = b.label)::INT as label, b.vec_id is not null as ok,
         case when b.vec_id is not null then
           (select sum(x.a::DOUBLE * x.b::DOUBLE) from (select unnest(a.embedding) as a, unnest(b.embedding) as b) x)
         end as score,
         case when b.vec_id is null then 'KeyError: missing vector' end as error
  from embeddings a left join embeddings b on b.vec_id = a.vec_id + 1
)
"""


def oracle() -> dict[str, str]:
    from tessera.plans.reports import _report_sql

    auc_sql = _report_sql("select score, label from f4 where ok")["auc_ap"]
    auc_sql = auc_sql.replace("with s as (", "with " + F4_SQL + ", s as (", 1)
    return {
        "similarity_pairs": "with " + F4_SQL + """
select a_id::BIGINT as a_id, label::BIGINT as label, ok, round(score, 6) as score, error from f4
""",
        "similarity_auc": auc_sql,
        "nli_entailment": """
with l as (select vec_id, [10.0 * list_sum([x::DOUBLE for x, i in embedding if (i - 1) % 3 = k]) for k in [0, 1, 2]] as lg from embeddings),
m as (select vec_id, lg, list_max(lg) as mx from l)
select vec_id::BIGINT as vec_id, round(exp(lg[1] - mx) / list_sum([exp(x - mx) for x in lg]), 6) as p_entail from m
""",
        "faithfulness_from_verdicts": "with " + F6_SQL + """
select eval_id::BIGINT as eval_id, count(*)::BIGINT as n_statements, round(avg(supported::INT::DOUBLE), 6) as faithfulness
from vd group by eval_id
""",
        "correctness_from_verdicts": "with " + F6_SQL + """
, c as (
  select eval_id, count(*) filter (where kind = 'TP') as tp, count(*) filter (where kind = 'FP') as fp,
         count(*) filter (where kind = 'FN') as fn from vd group by eval_id
)
select eval_id::BIGINT as eval_id, tp::BIGINT as tp, fp::BIGINT as fp, fn::BIGINT as fn,
       round(case when tp + (fp + fn) / 2.0 > 0 then tp / (tp + (fp + fn) / 2.0) end, 6) as answer_correctness
from c
""",
        "scorer_batch": "with " + QA_SQL + f""",
h as (select eval_id, ('0x' || substr(md5('judge|' || cast(eval_id as varchar)), 1, 8))::BIGINT as hv from qa)
select eval_id::BIGINT as eval_id, hv % {JUDGE_FAIL_MOD} <> 0 as ok,
       round(case when hv % {JUDGE_FAIL_MOD} <> 0 then hv / 4294967296.0 end, 6) as answer_accuracy,
       case when hv % {JUDGE_FAIL_MOD} = 0 then 'ValueError: judge refused' end as error
from h
""",
    }
