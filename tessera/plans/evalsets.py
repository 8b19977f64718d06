"""Evaluation-set plumbing queries: P2, P5, P6 and the NLI rows of E10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.hashing import hash_hex
from tessera.operators import filters as FL
from tessera.operators import prompts as PR
from tessera.operators import scoring as S
from tessera.operators.sampling import seeded_sample
from tessera.plans.fixtures import qa_pairs
from tessera.plans.reports import round_doubles
from tessera.plans.samples import SAMPLE_N, SEED
from tessera.plans.scoring import ID2LABEL, f4_pairs
from tessera.sources.tables import read_table


def q_scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2 on the similarity rows: how many rows are kept and failed."""
    _, counts = FL.scored_rows(f4_pairs(spark, sf_dir), "score")
    return counts.select(F.col("kept").cast("bigint"), F.col("failed").cast("bigint"))


def q_typed_eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5 + P3: typed rows in the judge's column names."""
    rows = FL.typed_eval_rows(qa_pairs(spark, sf_dir).withColumn("label", F.lit(1)))
    return FL.to_judge_columns(rows).select(
        F.col("eval_id").cast("bigint"), "passage_id", "user_input", "response", "ok"
    )


def q_drop_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders minus a listed id set (here: the seeded sample)."""
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice")
    listed = seeded_sample(orders, "id", SAMPLE_N, SEED)
    return FL.drop_ids(orders, listed, "id").select(F.col("id").cast("bigint"), F.round("o_totalprice", 6).alias("o_totalprice"))


def nli_logits(qa: DataFrame) -> DataFrame:
    """Stand-in NLI model output for (passage, answer): three hashed logits."""
    lg = F.array(*[
        (hash_hex(6, F.lit("nli"), F.col("eval_id"), F.lit(k)) / F.lit(16777216.0) * 8.0 - 4.0)
        for k in range(3)
    ])
    return qa.select("eval_id", lg.alias("logits"))


def q_nli_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """premise = passage, hypothesis = answer; a missing passage fails
    the row with the lookup error, the rest get the entailment probability."""
    qa = qa_pairs(spark, sf_dir)
    docs = read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("passage_id"), F.col("text").alias("passage")
    )
    rows = PR.context_prompts(qa, docs)
    scored = rows.join(nli_logits(qa), "eval_id", "left").withColumn(
        "entailment", F.when(F.col("ok"), S.entailment_prob(F.col("logits"), ID2LABEL))
    )
    return round_doubles(scored.select(F.col("eval_id").cast("bigint"), "ok", "error", "entailment"))


QUERIES = {
    "scored_rows": q_scored_rows,
    "typed_eval_rows": q_typed_eval_rows,
    "drop_ids": q_drop_ids,
    "nli_rows": q_nli_rows,
}


def oracle() -> dict[str, str]:
    from tessera.plans.scoring import F4_SQL, QA_SQL
    from tessera.plans.sequences import QA_SQL as QA_DOC_SQL

    u = "('0x' || substr(md5(concat_ws('|', '42', cast(o_orderkey as varchar))), 1, 8))::BIGINT / 4294967296.0"
    lg = "(('0x' || substr(md5(concat_ws('|', 'nli', eval_id, {k})), 1, 6))::BIGINT / 16777216.0 * 8.0 - 4.0)"
    return {
        "scored_rows": "with " + F4_SQL + """
select (count(*) filter (where ok and score is not null and not isnan(score)))::BIGINT as kept,
       (count(*) filter (where not (ok and score is not null and not isnan(score))))::BIGINT as failed
from f4
""",
        "typed_eval_rows": "with " + QA_DOC_SQL + """
select eval_id::BIGINT as eval_id, cast(cast(passage_id as BIGINT) as varchar) as passage_id,
       question as user_input, answer as response, (question is not null and answer is not null) as ok
from qa
""",
        "drop_ids": f"""
select o_orderkey::BIGINT as id, round(o_totalprice, 6) as o_totalprice from orders
where o_orderkey not in (select o_orderkey from orders order by {u}, o_orderkey limit {SAMPLE_N})
""",
        "nli_rows": "with " + QA_DOC_SQL + f""",
l as (select eval_id, [{lg.format(k=0)}, {lg.format(k=1)}, {lg.format(k=2)}] as lg from qa),
m as (select eval_id, lg, list_max(lg) as mx from l)
select qa.eval_id::BIGINT as eval_id, d.text is not null as ok,
       case when d.text is null then 'KeyError: ' || qa.passage_id end as error,
       case when d.text is not null then round(exp(m.lg[1] - m.mx) / list_sum([exp(x - m.mx) for x in m.lg]), 6) end as entailment
from qa left join documents d on cast(d.doc_id as varchar) = qa.passage_id
join m using (eval_id)
""",
    }
