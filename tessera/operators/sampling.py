"""Exact-size seeded samples and stratified splits.

A row's draw is ``u = hash_u(seed, id)`` (uniform, row-order free). The
sample is the ``quota`` rows with the smallest ``(u, id)`` per stratum,
found without a global sort and without a top-k in one task:

1. level 1: bucket ``floor(u * B)``; counts per (stratum, bucket) are a
   small table; a fold over its sorted buckets finds the bucket where the
   running count crosses the quota;
2. level 2: only rows of that boundary bucket are split again into B
   sub-buckets, same fold;
3. the rows of the boundary sub-bucket (about ``N / B^2``) are ranked by a
   window and trimmed to the remaining quota.

Everything is exact. Draws are uniform, so buckets stay balanced as long as
``id`` is unique (a row id). Per-stratum tables are materialised, their row
count is checked, and they are broadcast only below a fixed bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.hashing import hash_u
from tessera.session import materialize

BUCKETS = 4096
# Strata of a table that is sent to every task: a join by few strata would
# leave all rows of a stratum to one.
BROADCAST_STRATA = 10_000


def _join_small(big: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Attach a per-stratum table (one row per stratum).

    With strata it is an equi-join; a caller marks a table of few strata with
    :func:`_few`, else AQE picks the strategy from the bytes it measures. Without strata, the single row is attached as scalar
    subqueries, so no cross join appears in the plan.
    """
    if keys:
        return big.join(small, keys, "inner")
    one = small.select(F.struct(*small.columns).alias("_one")).scalar()
    return big.withColumn("_one", one).select("*", "_one.*").drop("_one")


def _few(small: DataFrame, n: int) -> DataFrame:
    """The table of ``n`` strata, marked for broadcast if these are few."""
    return F.broadcast(small) if n <= BROADCAST_STRATA else small


def _cut(counts: DataFrame, keys: list[str], bucket: str, quota: DataFrame) -> DataFrame:
    """Per stratum: the bucket where the running count reaches the quota,
    and how many rows precede it. ``k = B`` (beyond every bucket) when the
    stratum has fewer rows than its quota."""
    arr = counts.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(bucket).alias("b"), F.col("c")))).alias("arr")
    )
    j = _join_small(arr, quota, keys)

    def step(acc: Column, x: Column) -> Column:
        reach = (acc["k"] < 0) & (acc["cum"] + x["c"] >= F.col("quota"))
        return F.struct(
            (acc["cum"] + x["c"]).alias("cum"),
            F.when(reach, x["b"]).otherwise(acc["k"]).alias("k"),
            F.when(reach, acc["cum"]).otherwise(acc["before"]).alias("before"),
        )

    init = F.struct(F.lit(0).cast("long").alias("cum"), F.lit(-1).cast("long").alias("k"),
                    F.lit(0).cast("long").alias("before"))
    folded = j.select(*keys, "quota", F.aggregate("arr", init, step).alias("f"))
    return folded.select(
        *keys,
        "quota",
        F.when(F.col("f.k") < 0, F.lit(BUCKETS)).otherwise(F.col("f.k")).alias("k"),
        F.when(F.col("f.k") < 0, F.col("f.cum")).otherwise(F.col("f.before")).alias("before"),
    )


def hashed_flag(
    df: DataFrame,
    id_col: str,
    seed: int,
    n: int | None = None,
    frac: float | None = None,
    strata: list[str] | None = None,
) -> DataFrame:
    """Adds ``draw`` and ``taken``: whether the row is among the ``n`` (or
    ``round(frac * stratum size)``, half up) smallest ``(draw, id)`` of its
    stratum.

    Only small per-stratum tables are computed (bucket counts, cut points,
    and the ``(draw, id)`` threshold inside the boundary sub-bucket); the
    flag is then a column expression, so no row is joined back by id.
    """
    keys = list(strata or [])
    u = hash_u(F.lit(seed), F.col(id_col))
    x = (
        df.withColumn("_u", u)
        .withColumn("_b1", F.floor(F.col("_u") * BUCKETS).cast("long"))
        .withColumn("_b2", F.floor((F.col("_u") * BUCKETS - F.col("_b1")) * BUCKETS).cast("long"))
    )

    c1 = x.groupBy(*keys, "_b1").agg(F.count(F.lit(1)).alias("c"))
    sizes = c1.groupBy(*keys).agg(F.sum("c").alias("_n"))
    if n is not None:
        quota = sizes.select(*keys, F.lit(n).cast("long").alias("quota"))
    else:
        quota = sizes.select(*keys, F.floor(F.col("_n") * F.lit(frac) + F.lit(0.5)).cast("long").alias("quota"))
    # The per-stratum tables are tiny but read several times each: they are
    # materialised once (three passes over the input in total, then a map).
    cut1 = materialize(_cut(c1, keys, "_b1", quota).withColumnRenamed("k", "_k1")
                       .withColumnRenamed("before", "_before1"))

    n_strata = cut1.count() if keys else 1
    edge = _join_small(x, _few(cut1.drop("quota"), n_strata), keys).where(F.col("_b1") == F.col("_k1"))
    quota2 = cut1.select(*keys, (F.col("quota") - F.col("_before1")).alias("quota"))
    c2 = edge.groupBy(*keys, "_b2").agg(F.count(F.lit(1)).alias("c"))
    cut2 = materialize(_cut(c2, keys, "_b2", quota2).withColumnRenamed("k", "_k2")
                       .withColumnRenamed("before", "_before2").withColumnRenamed("quota", "_q2"))

    # Rows of the boundary sub-bucket (about N / B^2) are ranked; the last
    # winner's (draw, id) is the stratum's threshold.
    w = Window.partitionBy(*keys).orderBy("_u", id_col)
    last = _join_small(edge, _few(cut2, n_strata), keys).where(F.col("_b2") == F.col("_k2"))
    thr = materialize(
        last.withColumn("_rn", F.row_number().over(w))
        .where(F.col("_rn") <= F.col("_q2") - F.col("_before2"))
        .groupBy(*keys)
        .agg(F.max(F.struct("_u", F.col(id_col).alias("_id"))).alias("_thr"))
    )
    limits = _join_small(cut1.drop("quota"), cut2.drop("_q2", "_before2"), keys)
    if keys:
        limits = materialize(limits.join(thr, keys, "left"))
    else:
        limits = limits.withColumn("_thr", thr.select("_thr").scalar())
    y = _join_small(x, _few(limits, n_strata), keys)
    in_edge = F.struct(F.col("_u"), F.col(id_col).alias("_id")) <= F.col("_thr")
    taken = (F.col("_b1") < F.col("_k1")) | (
        (F.col("_b1") == F.col("_k1"))
        & ((F.col("_b2") < F.col("_k2")) | ((F.col("_b2") == F.col("_k2")) & F.coalesce(in_edge, F.lit(False))))
    )
    return y.withColumn("taken", taken).withColumnRenamed("_u", "draw").drop(
        "_b1", "_b2", "_k1", "_before1", "_k2", "_thr"
    )


def hashed_take(
    df: DataFrame,
    id_col: str,
    seed: int,
    n: int | None = None,
    frac: float | None = None,
    strata: list[str] | None = None,
) -> DataFrame:
    """Rows with the smallest ``(hash_u(seed, id), id)`` per stratum."""
    return hashed_flag(df, id_col, seed, n, frac, strata).where("taken").drop("taken")


def seeded_sample(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``min(n, rows)`` rows; with ``n <= 0`` the whole table."""
    if n <= 0:
        return df
    return hashed_take(df, id_col, seed, n=n).drop("draw")


def stratified_split(
    df: DataFrame, id_col: str, label_col: str, test_frac: float = 0.2, seed: int = 42
) -> DataFrame:
    """Adds ``is_test`` -- ``round(test_frac * n_label)`` rows per label
    with the smallest draws; the row id is kept. A map over the rows plus
    small per-label tables (no join by id)."""
    out = hashed_flag(df, id_col, seed, frac=test_frac, strata=[label_col])
    return out.withColumnRenamed("taken", "is_test").drop("draw")
