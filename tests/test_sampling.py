from pyspark.sql import functions as F

from tessera.operators.sampling import seeded_sample, stratified_split


def test_exact_size_and_partition_free(spark):
    df = spark.range(0, 20000).withColumnRenamed("id", "rid")
    a = {r["rid"] for r in seeded_sample(df, "rid", 777).collect()}
    b = {r["rid"] for r in seeded_sample(df.repartition(13), "rid", 777).collect()}
    assert len(a) == 777 and a == b
    assert seeded_sample(df, "rid", 0).count() == 20000
    assert seeded_sample(df.limit(50), "rid", 100).count() == 50


def test_stratified_quotas(spark):
    df = spark.range(0, 5003).select(F.col("id"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    s = stratified_split(df, "id", "y", 0.2)
    counts = {(r["y"], r["is_test"]): r["count"] for r in s.groupBy("y", "is_test").count().collect()}
    n1 = 1668
    n0 = 5003 - n1
    assert counts[(1, True)] == int(n1 * 0.2 + 0.5)
    assert counts[(0, True)] == int(n0 * 0.2 + 0.5)


def test_rows_of_a_label_stay_with_many_tasks(spark):
    """Attaching the labels' cut points does not deal the rows out by label."""
    from tessera.session import materialize

    df = materialize(spark.range(0, 20000, 1, 8).select(F.col("id"), (F.col("id") % 4 == 0).cast("int").alias("y")))
    s = stratified_split(df, "id", "y", 0.2).withColumn("task", F.spark_partition_id())
    tasks = s.groupBy("y").agg(F.countDistinct("task").alias("n"), F.max("is_test").alias("t")).collect()
    assert sorted(r["y"] for r in tasks) == [0, 1] and all(r["n"] == 8 and r["t"] for r in tasks)
