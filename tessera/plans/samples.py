"""Sampling and split queries (P4, T1) on the F9 fixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.sampling import seeded_sample, stratified_split
from tessera.session import materialize
from tessera.sources.tables import read_table

SEED = 42
SAMPLE_N = 500
TEST_FRAC = 0.2
# More than any order has lines, so that ids are unique.
ID_STRIDE = 1_000_000

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def f9_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one training row per line item, ``id = l_orderkey * 1000000 +
    line number`` (lines numbered as in F3), features and ``Y``."""
    li = read_table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        "l_quantity", "l_discount", "l_tax", "l_shipdate",
    )
    return li.select(
        (F.col("l_orderkey") * ID_STRIDE + F.row_number().over(w)).alias("id"),
        *[F.col(c).cast("double").alias(c) for c in FEATURES],
        (F.col("l_returnflag") == "R").cast("int").alias("Y"),
    )


def q_seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    s = seeded_sample(orders, "o_orderkey", SAMPLE_N, SEED)
    return s.select(F.col("o_orderkey").cast("bigint"), F.round("o_totalprice", 6).alias("o_totalprice"))


def q_stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The split reads its input in three counting passes and one map; the
    # derived training rows are persisted once, like a training table file.
    rows = materialize(f9_rows(spark, sf_dir))
    split = stratified_split(rows, "id", "Y", TEST_FRAC, SEED)
    return split.where("is_test").select(F.col("id").cast("bigint"), F.col("Y").cast("bigint").alias("y"))


QUERIES = {
    "seeded_sample": q_seeded_sample,
    "stratified_split": q_stratified_split,
}

F9_SQL = f"""
f9 as (
  select l_orderkey * {ID_STRIDE} + row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey,
           l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) as id,
         l_quantity::DOUBLE as l_quantity, l_extendedprice::DOUBLE as l_extendedprice,
         l_discount::DOUBLE as l_discount, l_tax::DOUBLE as l_tax,
         (l_returnflag = 'R')::INT as Y
  from lineitem
)
"""


_U = "('0x' || substr(md5(concat_ws('|', '42', cast({c} as varchar))), 1, 8))::BIGINT / 4294967296.0"


def split_sql() -> str:
    """CTE ``split``: the test rows of F9."""
    return f""",
r as (
  select id, Y, row_number() over (partition by Y order by {_U.format(c='id')}, id) as rn,
         count(*) over (partition by Y) as n
  from f9
),
split as (select id, Y as y from r where rn <= floor(n * {TEST_FRAC} + 0.5))
"""


def oracle() -> dict[str, str]:
    u = _U
    return {
        "seeded_sample": f"""
select o_orderkey::BIGINT as o_orderkey, round(o_totalprice, 6) as o_totalprice
from orders order by {u.format(c='o_orderkey')}, o_orderkey limit {SAMPLE_N}
""",
        "stratified_split": "with " + F9_SQL + split_sql() + "select id::BIGINT as id, y::BIGINT as y from split",
    }
