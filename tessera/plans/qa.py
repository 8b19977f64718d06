"""QA-set construction queries (D1-D8) on the F3 fixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import qa_split as Q
from tessera.operators.ranking import global_row_number
from tessera.sources.tables import read_table

SEED = 42


def f3_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """passage = customer, question = order, answers = its lines.

    ``answer_idx`` numbers the lines of an order by all their columns;
    ``label = (l_returnflag = 'N')``; answer text = ``'p' || l_partkey``.
    """
    li = read_table(spark, sf_dir, "lineitem")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    w = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        "l_quantity", "l_discount", "l_tax", "l_shipdate",
    )
    lines = li.select(
        "l_orderkey", "l_partkey", "l_returnflag",
        F.row_number().over(w).alias("answer_idx"),
    )
    j = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(
        cust, orders["o_custkey"] == cust["c_custkey"]
    )
    return j.select(
        F.col("o_custkey").cast("string").alias("passage_id"),
        F.col("c_name").alias("passage"),
        F.col("l_orderkey").alias("question_idx"),
        F.concat(F.lit("order "), F.col("l_orderkey").cast("string"), F.lit(" "), F.col("o_orderpriority")).alias("question"),
        F.col("answer_idx").cast("int").alias("answer_idx"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("answer"),
        (F.col("l_returnflag") == "N").cast("int").alias("label"),
    )


def q_qa_split_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D6 + D7: flat generations with a dense row id."""
    flat = Q.flat_generations(f3_answers(spark, sf_dir), SEED).withColumn(
        "neg_label", -F.col("label")
    )
    ided = global_row_number(flat, ["passage_id", "question_idx", "neg_label", "rank"])
    return ided.select(
        F.col("row_id").cast("bigint").alias("id"),
        "passage_id",
        F.col("question_idx").cast("bigint").alias("question_idx"),
        "question", "reference",
        F.col("reference_answer_idx").cast("bigint").alias("reference_answer_idx"),
        "answer",
        F.col("answer_idx").cast("bigint").alias("answer_idx"),
        F.col("label").cast("bigint").alias("label"),
    )


def q_qa_split_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per question; generation lists as ordered idx strings."""
    n = Q.nested_questions(f3_answers(spark, sf_dir), SEED)
    return n.select(
        "passage_id",
        F.col("question_idx").cast("bigint").alias("question_idx"),
        F.col("reference_answer_idx").cast("bigint").alias("reference_answer_idx"),
        "reference",
        F.array_join(F.transform("generation_correct", lambda x: x["idx"].cast("string")), ",").alias("correct_idx"),
        F.array_join(F.transform("generation_failed", lambda x: x["idx"].cast("string")), ",").alias("failed_idx"),
        F.size("generation_correct").cast("bigint").alias("n_correct"),
        F.size("generation_failed").cast("bigint").alias("n_failed"),
    )


def q_class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per label of the flat set."""
    flat = Q.flat_generations(f3_answers(spark, sf_dir), SEED)
    return Q.class_balance(flat).select(
        F.col("label").cast("bigint").alias("label"), F.col("n").cast("bigint").alias("n")
    )


def q_qa_split_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D4 invariants: questions, dropped ones, positives and negatives."""
    r = Q.ranked_answers(f3_answers(spark, sf_dir), SEED)
    per_q = r.groupBy(*Q.QKEY).agg(
        F.first("n_correct").alias("c"), F.first("n_wrong").alias("w")
    )
    return per_q.agg(
        F.count(F.lit(1)).cast("bigint").alias("questions"),
        F.count_if(F.col("c") == 0).cast("bigint").alias("no_correct"),
        F.sum(F.when(F.col("c") >= 1, F.col("c") - 1).otherwise(0)).cast("bigint").alias("positives"),
        F.sum(F.when(F.col("c") >= 1, F.least(F.col("w"), F.col("c") - 1)).otherwise(0)).cast("bigint").alias("negatives"),
    )


QUERIES = {
    "qa_split_flat": q_qa_split_flat,
    "qa_split_nested": q_qa_split_nested,
    "class_balance": q_class_balance,
    "qa_split_stats": q_qa_split_stats,
}

F3_SQL = """
ans as (
  select cast(o.o_custkey as varchar) as passage_id, c.c_name as passage, l.l_orderkey as question_idx,
         'order ' || cast(l.l_orderkey as varchar) || ' ' || o.o_orderpriority as question,
         l.answer_idx, 'p' || cast(l.l_partkey as varchar) as answer, (l.l_returnflag = 'N')::INT as label
  from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey,
               l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) as answer_idx from lineitem) l
  join orders o on o.o_orderkey = l.l_orderkey
  join customer c on c.c_custkey = o.o_custkey
),
rk as (
  select *, row_number() over (partition by passage_id, question_idx, label = 1 order by
              ('0x' || substr(md5(concat_ws('|', '42', case when label = 1 then 'c' else 'w' end,
                 passage_id, cast(question_idx as varchar), cast(answer_idx as varchar))), 1, 8))::BIGINT / 4294967296.0,
              answer_idx) as rank,
         sum((label = 1)::INT) over (partition by passage_id, question_idx) as n_correct,
         sum((label <> 1)::INT) over (partition by passage_id, question_idx) as n_wrong
  from ans
),
refs as (
  select passage_id, question_idx, answer_idx as ref_idx, answer as ref_text
  from rk where label = 1 and rank = 1
),
flat as (
  select rk.passage_id, rk.question_idx, rk.question, refs.ref_text as reference, refs.ref_idx as reference_answer_idx,
         rk.answer, rk.answer_idx, rk.label, rk.rank
  from rk join refs using (passage_id, question_idx)
  where (rk.label = 1 and rk.rank > 1) or (rk.label <> 1 and rk.rank <= rk.n_correct - 1)
)
"""


def oracle() -> dict[str, str]:
    return {
        "qa_split_flat": "with " + F3_SQL + """
select (row_number() over (order by passage_id, question_idx, label desc, rank) - 1)::BIGINT as id,
       passage_id, question_idx::BIGINT as question_idx, question, reference,
       reference_answer_idx::BIGINT as reference_answer_idx, answer, answer_idx::BIGINT as answer_idx,
       label::BIGINT as label
from flat
""",
        "qa_split_nested": "with " + F3_SQL + """
select r.passage_id, r.question_idx::BIGINT as question_idx, r.ref_idx::BIGINT as reference_answer_idx,
       r.ref_text as reference,
       coalesce((select string_agg(cast(answer_idx as varchar), ',' order by rank) from flat f
                 where f.passage_id = r.passage_id and f.question_idx = r.question_idx and f.label = 1), '') as correct_idx,
       coalesce((select string_agg(cast(answer_idx as varchar), ',' order by rank) from flat f
                 where f.passage_id = r.passage_id and f.question_idx = r.question_idx and f.label = 0), '') as failed_idx,
       (select count(*) from flat f where f.passage_id = r.passage_id and f.question_idx = r.question_idx and f.label = 1)::BIGINT as n_correct,
       (select count(*) from flat f where f.passage_id = r.passage_id and f.question_idx = r.question_idx and f.label = 0)::BIGINT as n_failed
from refs r
""",
        "class_balance": "with " + F3_SQL + """
select label::BIGINT as label, count(*)::BIGINT as n from flat group by label
""",
        "qa_split_stats": "with " + F3_SQL + """
, pq as (select passage_id, question_idx, any_value(n_correct) as c, any_value(n_wrong) as w from rk group by passage_id, question_idx)
select count(*)::BIGINT as questions, (count(*) filter (where c = 0))::BIGINT as no_correct,
       sum(case when c >= 1 then c - 1 else 0 end)::BIGINT as positives,
       sum(case when c >= 1 then least(w, c - 1) else 0 end)::BIGINT as negatives
from pq
""",
    }
