"""Global running sums over a sorted key without a single-partition window.

``Window.orderBy(x)`` with no partition key pulls every row into one task.
Every rank statistic here (ROC, PR, AUC, AP, Mann-Whitney, exact medians)
instead runs over the *distinct-score table* and splits it into quantile
buckets:

1. ``g``: one row per distinct score with the label counts (partial
   aggregation, so a score holding a third of all rows collapses map-side);
2. bucket cut points = ``percentile_approx`` over ``g`` (a scalar subquery,
   bounded by the number of buckets);
3. per-bucket totals -> running offsets, again one bounded scalar subquery;
4. inside a bucket a window partitioned by the bucket adds the local
   running sum to the bucket offset.

Ties never straddle a bucket because the bucket is a function of the score.
Everything is deterministic, so no checkpoint is needed between the steps.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def default_buckets(df: DataFrame) -> int:
    """Buckets for the distinct-score table: one per shuffle partition."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(1, n)


def bucket_of(bounds: Column, x: Column, n_bounds: int) -> Column:
    """Number of cut points strictly below ``x`` (binary search, O(log B))."""
    if n_bounds == 0:
        return F.lit(0)
    steps = max(1, math.ceil(math.log2(n_bounds + 1)) + 1)

    def step(acc: Column, _i: Column) -> Column:
        lo, hi = acc["lo"], acc["hi"]
        mid = F.floor((lo + hi) / 2).cast("int")
        go_right = F.element_at(bounds, mid + 1) < x
        return F.when(
            lo < hi,
            F.when(
                go_right, F.struct((mid + 1).alias("lo"), hi.alias("hi"))
            ).otherwise(F.struct(lo.alias("lo"), mid.alias("hi"))),
        ).otherwise(acc)

    init = F.struct(F.lit(0).alias("lo"), F.lit(n_bounds).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), init, step, lambda a: a["lo"])


def score_counts(
    scored: DataFrame, score: str = "score", label: str = "label", materialize: bool = True
) -> DataFrame:
    """Distinct-score table ``score, pos, neg`` (one shuffle, map-side partial
    aggregation, so a score holding a third of all rows collapses early).

    Every report statistic reads this table several times (cut points,
    offsets, the window, neighbours), so it is checkpointed once into the
    session's reliable checkpoint folder instead of re-running the upstream
    plan per scalar subquery. Non-finite scores are kept here (as their own
    groups) so callers can count them without another pass.
    """
    y = F.col(label).cast("long")
    g = scored.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.sum(y).alias("pos"), F.sum(F.lit(1) - y).alias("neg")
    )
    if not materialize:
        return g
    from tessera.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(scored.sparkSession)
    return g.checkpoint(eager=True)


def finite(g: DataFrame) -> DataFrame:
    s = F.col("score")
    return g.where(s.isNotNull() & ~F.isnan(s) & (F.abs(s) != F.lit(float("inf"))))


def prefix_table(g: DataFrame, n_buckets: int | None = None) -> DataFrame:
    """Running counts over a distinct-score table ``g(score, pos, neg)``.

    Output columns: ``score, pos, neg, bucket, below_pos, below_neg, P, N``
    where ``below_*`` count the rows with a strictly smaller score.
    """
    b = n_buckets or default_buckets(g)
    n_bounds = b - 1
    if n_bounds > 0:
        fractions = [i / b for i in range(1, b)]
        accuracy = max(10000, 20 * b)
        bounds = g.select(
            F.percentile_approx("score", fractions, accuracy)
        ).scalar()
        # Bind the subquery to a column first: Spark rejects subqueries
        # inside lambdas, but a lambda may read a column.
        gb = (
            g.withColumn("_bounds", bounds)
            .withColumn("bucket", bucket_of(F.col("_bounds"), F.col("score"), n_bounds))
            .drop("_bounds")
        )
    else:
        gb = g.withColumn("bucket", F.lit(0))

    # Per-bucket totals as one array with an entry for every bucket (size b,
    # bounded), then running offsets in one pass over it.
    zeros = g.sparkSession.range(b).select(
        F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg")
    )
    totals = gb.select(F.col("bucket").cast("int").alias("bucket"), "pos", "neg").unionByName(zeros)
    totals = totals.groupBy("bucket").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    tot = F.array_sort(F.collect_list(F.struct("bucket", "p", "n")))

    def running(field: str) -> Column:
        start = F.struct(F.array().cast("array<bigint>").alias("off"), F.lit(0).cast("long").alias("s"))
        return F.aggregate(
            tot, start,
            lambda acc, t: F.struct(F.array_append(acc["off"], acc["s"]).alias("off"), (acc["s"] + t[field]).alias("s")),
            lambda acc: acc["off"],
        )

    offsets = totals.select(
        F.struct(
            running("p").alias("off_pos"),
            running("n").alias("off_neg"),
            F.coalesce(F.sum("p"), F.lit(0)).cast("long").alias("P"),
            F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("N"),
        )
    ).scalar()

    w = (
        Window.partitionBy("bucket")
        .orderBy("score")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return gb.select(
        "score",
        "pos",
        "neg",
        "bucket",
        (
            F.element_at(offsets["off_pos"], F.col("bucket") + 1)
            + F.coalesce(F.sum("pos").over(w), F.lit(0))
        ).alias("below_pos"),
        (
            F.element_at(offsets["off_neg"], F.col("bucket") + 1)
            + F.coalesce(F.sum("neg").over(w), F.lit(0))
        ).alias("below_neg"),
        offsets["P"].alias("P"),
        offsets["N"].alias("N"),
    )


def with_lower_neighbor(pt: DataFrame) -> DataFrame:
    """Add ``dn_pos, dn_neg``: the label counts of the next *lower* score.

    Inside a bucket this is a ``lag``; across a bucket edge it is the highest
    score of the nearest lower non-empty bucket, which a join on the bucket
    brings (at most one row per bucket).
    """
    edges = pt.groupBy("bucket").agg(F.max_by(F.struct("pos", "neg"), F.col("score")).alias("top"))
    chain = F.array_sort(F.collect_list(F.struct("bucket", "top")))
    below = edges.select(
        F.inline(F.transform(chain, lambda e, k: F.struct(e["bucket"].alias("bucket"), F.get(chain, k - 1)["top"].alias("_below"))))
    )
    w = Window.partitionBy("bucket").orderBy("score")
    return (
        pt.join(below, "bucket")
        .withColumn("dn_pos", F.coalesce(F.lag("pos").over(w), F.col("_below.pos")))
        .withColumn("dn_neg", F.coalesce(F.lag("neg").over(w), F.col("_below.neg")))
        .drop("_below")
    )


def global_row_number(
    df: DataFrame, order_cols: list[str], n_parts: int | None = None
) -> DataFrame:
    """Dense 0-based ``row_id`` over a total order (``order_cols`` unique).

    Range-partition on the full composite key (so a hot leading value is
    split across partitions), sort inside partitions and checkpoint to the
    session's reliable checkpoint folder: range bounds come from a sample,
    so the layout must be fixed once before it is read twice. The local
    index and the partition id are then both inside
    ``monotonically_increasing_id`` (pid << 33 | index), and partition counts
    give the offsets through a bounded scalar subquery.
    """
    from tessera.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    b = n_parts or default_buckets(df)
    laid = (
        df.repartitionByRange(b, *order_cols)
        .sortWithinPartitions(*order_cols)
        .checkpoint(eager=True)
    )
    mid = F.monotonically_increasing_id()
    tagged = laid.withColumn("_pid", F.shiftright(mid, 33)).withColumn(
        "_local", mid.bitwiseAND(F.lit((1 << 33) - 1))
    )
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("c"))
    lst = F.collect_list(F.struct("_pid", "c"))
    offs = counts.select(
        F.transform(
            F.sequence(F.lit(0), F.lit(b - 1)),
            lambda k: F.aggregate(
                F.filter(lst, lambda t: t["_pid"] < k), F.lit(0).cast("long"),
                lambda s, t: s + t["c"],
            ),
        )
    ).scalar()
    return tagged.withColumn(
        "row_id", F.element_at(offs, F.col("_pid").cast("int") + 1) + F.col("_local")
    ).drop("_pid", "_local")


def group_rank(
    df: DataFrame, group_cols: list[str], order_cols: list[str], n_parts: int | None = None
) -> DataFrame:
    """1-based ``rank`` inside each group by ``order_cols`` (unique within a
    group), plus ``group_size``, without a window partitioned by the group.

    A window would sort a whole group in one task; here the rows get a dense
    global id over ``group_cols + order_cols`` (range partitioning splits a
    hot group across tasks), the group's first id and size come from an
    aggregate (partial, so a hot group collapses map-side), and the rank is
    ``row_id - first + 1``. The group table has one row per group; AQE
    broadcasts it when small and splits a skewed side of the join otherwise.
    """
    ided = global_row_number(df, group_cols + order_cols, n_parts)
    starts = ided.groupBy(*group_cols).agg(
        F.min("row_id").alias("_first"), F.count(F.lit(1)).alias("group_size")
    )
    return (
        ided.join(starts, group_cols, "inner")
        .withColumn("rank", (F.col("row_id") - F.col("_first") + 1).cast("int"))
        .drop("_first", "row_id")
    )


def grouped_prefix_table(
    g: DataFrame, group_cols: list[str], n_buckets: int | None = None, bucket: Column | None = None
) -> DataFrame:
    """:func:`prefix_table` for many score tables at once, keyed by
    ``group_cols`` (e.g. one per boosting iteration): ``g(group..., score,
    pos, neg)``. Cut points and offsets are per-group tables (one row per
    group) and per-(group, bucket) running offsets (a window over the small
    totals table), joined on the keys; the window over scores is
    partitioned by group and bucket. ``bucket``: a whole number that never
    falls as the score rises, in place of cut points searched for every row.
    """
    b = n_buckets or default_buckets(g)
    n_bounds = b - 1
    if bucket is not None:
        gb = g.withColumn("bucket", bucket)
    elif n_bounds > 0:
        fractions = [i / b for i in range(1, b)]
        bounds = g.groupBy(*group_cols).agg(
            F.percentile_approx("score", fractions, max(10000, 20 * b)).alias("_bounds")
        )
        gb = g.join(bounds, group_cols, "inner").withColumn(
            "bucket", bucket_of(F.col("_bounds"), F.col("score"), n_bounds)
        ).drop("_bounds")
    else:
        gb = g.withColumn("bucket", F.lit(0))
    # Offsets: a running sum over the small (group, bucket) totals table,
    # partitioned by group (B rows each), joined back on (group, bucket).
    totals = gb.groupBy(*group_cols, "bucket").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    run = Window.partitionBy(*group_cols).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group_cols)
    offsets = totals.select(
        *group_cols, "bucket",
        F.coalesce(F.sum("p").over(run), F.lit(0)).cast("long").alias("_off_pos"),
        F.coalesce(F.sum("n").over(run), F.lit(0)).cast("long").alias("_off_neg"),
        F.sum("p").over(whole).cast("long").alias("P"),
        F.sum("n").over(whole).cast("long").alias("N"),
    )
    w = Window.partitionBy(*group_cols, "bucket").orderBy("score").rowsBetween(
        Window.unboundedPreceding, -1
    )
    j = gb.join(offsets, [*group_cols, "bucket"], "inner")
    return j.select(
        *group_cols, "score", "pos", "neg", "bucket",
        (F.col("_off_pos") + F.coalesce(F.sum("pos").over(w), F.lit(0))).alias("below_pos"),
        (F.col("_off_neg") + F.coalesce(F.sum("neg").over(w), F.lit(0))).alias("below_neg"),
        "P", "N",
    )
