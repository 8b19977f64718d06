from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators.ranking import global_row_number, group_rank


def test_group_rank_with_hot_group(spark):
    # one group holds half of all rows, the rest are small groups
    hot = spark.range(0, 6000).select(F.lit(0).alias("g"), (F.col("id") * 7919 % 6000).alias("o"))
    small = spark.range(0, 6000).select((F.col("id") % 1500 + 1).alias("g"), F.col("id").alias("o"))
    df = hot.unionByName(small)
    got = group_rank(df, ["g"], ["o"], n_parts=8)
    want = df.withColumn("want", F.row_number().over(Window.partitionBy("g").orderBy("o")))
    j = got.join(want, ["g", "o"])
    assert j.where(F.col("rank") != F.col("want")).count() == 0
    assert j.count() == 12000
    sizes = {r["g"]: r["group_size"] for r in got.select("g", "group_size").distinct().collect()}
    assert sizes[0] == 6000 and sizes[1] == 4


def test_global_row_number_dense_and_ordered(spark):
    df = spark.range(0, 5000).select((F.col("id") * 31 % 5000).alias("k"))
    ids = global_row_number(df, ["k"], n_parts=7).orderBy("k").collect()
    assert [r["row_id"] for r in ids] == list(range(5000))
    # the range layout spreads rows over several partitions before numbering
    laid = df.repartitionByRange(7, "k")
    assert laid.rdd.getNumPartitions() == 7
