"""Binary evaluation report: ROC, PR, AUC, AP, Youden, class report,
confusion matrix, Mann-Whitney U, exact medians, histogram, KDE.

Input: the prefix table of distinct scores that :func:`score_table` writes
once from rows with a numeric ``score`` and a 0/1 ``label``: label counts,
the counts below, and the next lower score's counts. Curves are projections of
it, and every scalar is part of one aggregate over it (:func:`report_all`
takes them all together). Non-finite scores (e.g. +inf perplexity of an answer
without steps) are excluded and counted (SURVEY Q6), in one row without score.
A plain ``score, pos, neg`` table will do as input, too. No step sorts the
whole data set in one task; the outputs are small tidy tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranking import default_buckets, finite, prefix_table, score_counts, with_lower_neighbor

# Fixed values from the reference: class names of the report (0 = false,
# 1 = true) and the metric names of the per-class table.
CLASS_NAMES = {0: "Ложь", 1: "Истина"}
REPORT_METRICS = ("precision", "recall", "f1-score", "support")
KDE_POINTS = 500
HIST_BINS = 50
# Cells of the binned density per grid point.
KDE_CELLS = 16
# Bandwidths beyond which the kernel is taken as 0 (below 2e-14 of its peak).
KDE_REACH = 8
# Fixed value from the reference: bin width of the distribution plot.
BIN_SIZE = 0.01

INF = float("inf")


def score_table(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """The prefix table every report function reads, written once: ``score,
    pos, neg, below_pos, below_neg, P, N, dn_pos, dn_neg``."""
    from tessera.session import materialize

    g = score_counts(scored, score, label)
    bad = g.where(_nonfinite()).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return materialize(with_lower_neighbor(prefix_table(finite(g))).drop("bucket").unionByName(bad, allowMissingColumns=True))


def _nonfinite() -> Column:
    s = F.col("score")
    return s.isNull() | F.isnan(s) | (F.abs(s) == F.lit(INF))


def _prefix(g: DataFrame, neighbour: bool = False) -> DataFrame:
    """Finite scores with their running counts."""
    if "below_pos" in g.columns:
        return g.where(F.col("score").isNotNull())
    pt = prefix_table(finite(g))
    return with_lower_neighbor(pt) if neighbour else pt


def _div(a: Column, b: Column) -> Column:
    """a / b with 0 for a zero denominator (sklearn's zero_division=0)."""
    return F.when(b != 0, a.cast("double") / b).otherwise(F.lit(0.0))


def _counts_ge(pt: DataFrame) -> DataFrame:
    return pt.withColumn("tp", F.col("P") - F.col("below_pos")).withColumn(
        "fp", F.col("N") - F.col("below_neg")
    )


def roc_points(g: DataFrame) -> DataFrame:
    """``threshold, fpr, tpr`` like sklearn ``roc_curve`` (collinear
    intermediate points dropped, start point at +inf)."""
    pt = _counts_ge(_prefix(g, neighbour=True))
    is_top = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
    keep = (
        is_top
        | F.col("dn_pos").isNull()
        | (F.col("dn_pos") != F.col("pos"))
        | (F.col("dn_neg") != F.col("neg"))
    )
    pts = pt.where(keep).select(
        F.col("score").alias("threshold"),
        F.try_divide(F.col("fp").cast("double"), F.col("N")).alias("fpr"),
        F.try_divide(F.col("tp").cast("double"), F.col("P")).alias("tpr"),
    )
    start = pt.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(INF).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return start.unionByName(pts)


def pr_points(g: DataFrame) -> DataFrame:
    """``threshold, precision, recall`` per distinct score plus the end
    point (precision 1, recall 0, no threshold)."""
    pt = _counts_ge(_prefix(g))
    pts = pt.select(
        F.col("score").alias("threshold"),
        _div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        F.when(F.col("P") == 0, F.lit(1.0))
        .otherwise(F.col("tp").cast("double") / F.col("P"))
        .alias("recall"),
    )
    end = pt.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
    )
    return pts.unionByName(end)


# Scalars: a section is a list of aggregates over the prefix table (``tp`` and
# ``fp`` count the rows at or above the score) and what is read off them.


def _tp() -> Column:
    return F.col("P") - F.col("below_pos")


def _fp() -> Column:
    return F.col("N") - F.col("below_neg")


def _below() -> Column:
    return F.col("below_pos") + F.col("below_neg")


def _cnt() -> Column:
    return F.col("pos") + F.col("neg")


def _totals() -> list[Column]:
    return [F.max("P").alias("P"), F.max("N").alias("N")]


def _scalars(g: DataFrame, *aggregates: Column) -> DataFrame:
    """One row: the aggregates, and the label totals ``P, N``."""
    return _prefix(g).agg(*_totals(), *aggregates)


def _area() -> list[Column]:
    return [
        F.sum(F.col("pos") * (F.col("below_neg") + F.col("neg") / 2.0)).alias("auc_num"),
        F.sum(F.col("pos").cast("double") * _tp() / (_tp() + _fp())).alias("ap_num"),
    ]


def _auc() -> Column:
    return F.try_divide(F.col("auc_num"), F.col("P").cast("double") * F.col("N"))


def _ap() -> Column:
    return F.try_divide(F.col("ap_num"), F.col("P").cast("double"))


def _count_nonfinite(g: DataFrame) -> Column:
    return F.coalesce(g.where(_nonfinite()).agg(F.sum(F.col("pos") + F.col("neg"))).scalar(), F.lit(0))


def auc_ap(g: DataFrame) -> DataFrame:
    """One row ``n_rows, n_pos, n_neg, n_nonfinite, auc, ap``.

    AUC by the trapezoid rule equals ``sum(pos * (neg_below + neg / 2)) /
    (P N)``; AP = ``sum((R_n - R_{n-1}) P_n)`` = ``sum(pos * precision) / P``.
    """
    return _scalars(g, *_area()).select(
        (F.col("P") + F.col("N")).cast("bigint").alias("n_rows"),
        F.col("P").cast("bigint").alias("n_pos"),
        F.col("N").cast("bigint").alias("n_neg"),
        _count_nonfinite(g).cast("bigint").alias("n_nonfinite"),
        _auc().alias("auc"),
        _ap().alias("ap"),
    )


def _best() -> Column:
    """The Youden point with its counts: the largest ``(j, score)``."""
    tpr, fpr = _div(_tp(), F.col("P")), _div(_fp(), F.col("N"))
    return F.max(F.struct(
        (tpr - fpr).alias("j"), F.col("score").alias("t"), tpr.alias("tpr"), fpr.alias("fpr"),
        _tp().cast("bigint").alias("tp"), _fp().cast("bigint").alias("fp"),
    )).alias("best")


def _with_best(scalars: DataFrame) -> DataFrame:
    """The curve's start (threshold +inf, J = 0, nothing predicted) counts, too."""
    start = F.struct(
        F.lit(0.0).alias("j"), F.lit(INF).alias("t"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr"),
        F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("fp"),
    )
    rows = scalars.withColumn("best", F.greatest(F.coalesce("best", start), start))
    return rows.withColumns({"P": F.coalesce("P", F.lit(0)).cast("bigint"), "N": F.coalesce("N", F.lit(0)).cast("bigint")})


def youden(g: DataFrame) -> DataFrame:
    """R2: first maximum of tpr - fpr over thresholds in descending order
    (the largest threshold on a tie); the start point (+inf, J = 0) counts."""
    return _with_best(_scalars(g, _best())).select(
        F.col("best.t").alias("threshold"), "best.j", "best.tpr", "best.fpr"
    )


def youden_threshold(g: DataFrame) -> Column:
    """The Youden threshold as a scalar-subquery Column."""
    return youden(g).select("threshold").scalar()


def predict(scored: DataFrame, threshold: Column, score: str = "score") -> DataFrame:
    """``y_pred = score >= threshold`` for every row (threshold is a
    scalar, so this is a map, not a join)."""
    return scored.withColumn("y_pred", (F.col(score) >= threshold).cast("int"))


def _confusion_counts(scalars: DataFrame) -> DataFrame:
    """TP, FP, FN, TN at the Youden threshold: the counts of that point."""
    rows = _with_best(scalars).withColumns({"tp": F.col("best.tp"), "fp": F.col("best.fp")})
    return rows.withColumns({"fn": F.col("P") - F.col("tp"), "tn": F.col("N") - F.col("fp")})


def confusion(g: DataFrame) -> DataFrame:
    """Full 2x2 grid ``y_true, y_pred, n`` at the Youden threshold."""
    c = _confusion_counts(_scalars(g, _best()))
    return c.select(
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("y_true"), F.lit(0).alias("y_pred"), F.col("tn").alias("n")),
                F.struct(F.lit(0).alias("y_true"), F.lit(1).alias("y_pred"), F.col("fp").alias("n")),
                F.struct(F.lit(1).alias("y_true"), F.lit(0).alias("y_pred"), F.col("fn").alias("n")),
                F.struct(F.lit(1).alias("y_true"), F.lit(1).alias("y_pred"), F.col("tp").alias("n")),
            )
        )
    )


def class_report(g: DataFrame) -> DataFrame:
    """Tidy ``class_name, metric, value`` like sklearn's report dict.

    Rows per class (precision, recall, f1-score, support), ``accuracy`` once
    (not repeated as in the reference's table, SURVEY Q22), macro and
    weighted averages.
    """
    return _class_rows(_confusion_counts(_scalars(g, _best())))


def _class_rows(c: DataFrame, *carried: str) -> DataFrame:
    p1 = _div(F.col("tp"), F.col("tp") + F.col("fp"))
    r1 = _div(F.col("tp"), F.col("P"))
    p0 = _div(F.col("tn"), F.col("tn") + F.col("fn"))
    r0 = _div(F.col("tn"), F.col("N"))
    m = c.select(
        *carried, "P", "N", "tp", "tn",
        p1.alias("p1"), r1.alias("r1"), p0.alias("p0"), r0.alias("r0"),
    )
    m = m.withColumn("f1", _div(2 * F.col("p1") * F.col("r1"), F.col("p1") + F.col("r1")))
    m = m.withColumn("f0", _div(2 * F.col("p0") * F.col("r0"), F.col("p0") + F.col("r0")))
    tot = (F.col("P") + F.col("N")).cast("double")

    def row(cls: str, metric: str, v: Column) -> Column:
        return F.struct(F.lit(cls).alias("class_name"), F.lit(metric).alias("metric"),
                        v.cast("double").alias("value"))

    def wavg(a: str, b: str) -> Column:
        return _div(F.col(a) * F.col("N") + F.col(b) * F.col("P"), tot)

    c0, c1 = CLASS_NAMES[0], CLASS_NAMES[1]
    rows = [
        row(c0, "precision", F.col("p0")), row(c0, "recall", F.col("r0")),
        row(c0, "f1-score", F.col("f0")), row(c0, "support", F.col("N")),
        row(c1, "precision", F.col("p1")), row(c1, "recall", F.col("r1")),
        row(c1, "f1-score", F.col("f1")), row(c1, "support", F.col("P")),
        row("accuracy", "accuracy", _div(F.col("tp") + F.col("tn"), tot)),
        row("macro avg", "precision", (F.col("p0") + F.col("p1")) / 2),
        row("macro avg", "recall", (F.col("r0") + F.col("r1")) / 2),
        row("macro avg", "f1-score", (F.col("f0") + F.col("f1")) / 2),
        row("macro avg", "support", tot),
        row("weighted avg", "precision", wavg("p0", "p1")),
        row("weighted avg", "recall", wavg("r0", "r1")),
        row("weighted avg", "f1-score", wavg("f0", "f1")),
        row("weighted avg", "support", tot),
    ]
    return m.select(*carried, F.inline(F.array(*rows)))


def report_scalars(g: DataFrame, skip_support: bool = False) -> DataFrame:
    """``name, value`` = ``test_{class}_{metric}`` rounded to 3 digits
    for the two classes, plus ``best_roc_threshold`` rounded to 4."""
    rep = _class_rows(_confusion_counts(_scalars(g, _best())).withColumn("threshold", F.col("best.t")), "threshold")
    thr = rep.where((F.col("class_name") == "accuracy")).select(
        F.lit("best_roc_threshold").alias("name"), F.round("threshold", 4).alias("value")
    )
    rep = rep.where(F.col("class_name").isin(list(CLASS_NAMES.values())))
    if skip_support:
        rep = rep.where(F.col("metric") != "support")
    scal = rep.select(
        F.concat(
            F.lit("test_"), F.regexp_replace("class_name", " ", "_"), F.lit("_"), F.col("metric")
        ).alias("name"),
        F.round("value", 3).alias("value"),
    )
    return scal.unionByName(thr)


# Abramowitz-Stegun / Numerical Recipes ``erfcc`` (fractional error < 1.2e-7);
# Spark has no erf, and the DuckDB oracle repeats the same formula.
_ERFC_COEF = (
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
    0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
)


def erfc(x: Column) -> Column:
    z = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * z)
    poly = F.lit(_ERFC_COEF[-1])
    for c in reversed(_ERFC_COEF[:-1]):
        poly = F.lit(c) + t * poly
    ans = t * F.exp(-z * z + poly)
    return F.when(x >= 0, ans).otherwise(F.lit(2.0) - ans)


def mann_whitney_less(g: DataFrame) -> DataFrame:
    """Mann-Whitney U of label-1 scores vs label-0, alternative "less".

    Mid-rank sums come from the prefix table; normal approximation with tie
    and continuity correction: ``z = (n1 n0 - U1 - n1 n0 / 2 - 0.5) / s``,
    ``p = erfc(z / sqrt 2) / 2``.
    """
    n1, n0, u1, z = _rank_test()
    return _scalars(g, *_ranks()).select(
        n1.cast("bigint").alias("n1"), n0.cast("bigint").alias("n0"), u1.alias("u1"), z.alias("z"),
    ).withColumn("p_value", erfc(F.col("z") / F.lit(2.0 ** 0.5)) / 2)


def _ranks() -> list[Column]:
    t = _cnt().cast("double")  # t^3 passes the long range at two million ties
    return [F.sum(F.col("pos") * (_below() + (t + 1) / 2.0)).alias("R1"), F.sum(t * t * t - t).alias("ties")]


def _rank_test() -> tuple[Column, Column, Column, Column]:
    """n1, n0, U1 and z of the aggregated ranks."""
    n1, n0 = F.col("P").cast("double"), F.col("N").cast("double")
    n = n1 + n0
    u1 = F.col("R1") - n1 * (n1 + 1) / 2
    s = F.sqrt(n1 * n0 / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1))))
    return n1, n0, u1, F.try_divide(n1 * n0 - u1 - n1 * n0 / 2 - 0.5, s)


def median_by_label(g: DataFrame) -> DataFrame:
    """Exact median per label from the prefix table (no value list is
    gathered in one task): the k-th value is the score whose running count
    range covers k."""
    return _scalars(g, *_middles()).select(
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("label"), F.col("N").cast("bigint").alias("n"),
                         ((F.col("n_lo") + F.col("n_hi")) / 2).alias("median")),
                F.struct(F.lit(1).alias("label"), F.col("P").cast("bigint").alias("n"),
                         ((F.col("p_lo") + F.col("p_hi")) / 2).alias("median")),
            )
        )
    )


def _middles() -> list[Column]:
    def kth(cnt: str, below: str, k: Column) -> Column:
        hit = (F.col(below) < k) & (F.col(below) + F.col(cnt) >= k)
        return F.max(F.when(hit, F.col("score")))

    out = []
    for name, cnt, below, total in (("p", "pos", "below_pos", "P"), ("n", "neg", "below_neg", "N")):
        out.append(kth(cnt, below, F.floor((F.col(total) + 1) / 2)).alias(f"{name}_lo"))
        out.append(kth(cnt, below, F.ceil((F.col(total) + 1) / 2)).alias(f"{name}_hi"))
    return out


def score_box(g: DataFrame) -> DataFrame:
    """R13 box summary: ``n, min, q1, median, q3, max, mean`` of all finite
    scores; quartiles interpolate linearly between order statistics
    (position ``(n - 1) p``), read exactly off the prefix table."""
    return _scalars(g, *_quartiles()).select(
        (F.col("P") + F.col("N")).cast("bigint").alias("n"), "min", *(_quartile(q).alias(q) for q in QUARTILES), "max", "mean"
    )


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def _quartiles() -> list[Column]:
    n = F.col("P") + F.col("N")

    def at(rank: Column) -> Column:
        """Value of the 0-based order statistic ``rank``."""
        return F.max(F.when((_below() <= rank) & (_below() + _cnt() > rank), F.col("score")))

    out = [F.min("score").alias("min"), F.max("score").alias("max"), (F.sum(F.col("score") * _cnt()) / F.sum(_cnt())).alias("mean")]
    for name, p in QUARTILES.items():
        h = (n - 1) * p
        lo = F.floor(h)
        out += [at(lo).alias(f"_{name}_lo"), at(F.least(lo + 1, n - 1)).alias(f"_{name}_hi"), F.max(h - lo).alias(f"_{name}_f")]
    return out


def _quartile(name: str) -> Column:
    lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
    return lo + (hi - lo) * F.col(f"_{name}_f")


def _label_rows(g: DataFrame) -> DataFrame:
    """Distinct (label, score, cnt) rows from the score table."""
    return finite(g).select(
        "score",
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("label"), F.col("neg").alias("cnt")),
                F.struct(F.lit(1).alias("label"), F.col("pos").alias("cnt")),
            )
        ),
    ).where(F.col("cnt") > 0)


def score_hist(g: DataFrame, bins: int = HIST_BINS) -> DataFrame:
    """Equal-width histogram between the global min and max
    (``bin`` 1..bins, the max falls in the last bin) per label."""
    fin = _label_rows(g)
    mm = fin.agg(F.struct(F.min("score").alias("lo"), F.max("score").alias("hi"))).scalar()
    lo, hi = mm["lo"], mm["hi"]
    width = (hi - lo) / bins
    b = F.when(hi == lo, F.lit(1)).otherwise(
        F.least(F.floor((F.col("score") - lo) / width).cast("int") + 1, F.lit(bins))
    )
    return (
        fin.groupBy(b.alias("bin"), "label")
        .agg(F.sum("cnt").alias("n"))
        .select(
            F.col("bin").cast("bigint").alias("bin"),
            F.col("label").cast("bigint").alias("label"),
            (lo + (F.col("bin") - 1) * width).alias("bin_lo"),
            F.col("n").cast("bigint").alias("n"),
        )
    )


def score_kde(g: DataFrame, points: int = KDE_POINTS) -> DataFrame:
    """Gaussian KDE per label on ``points`` grid points over [min, max].

    Scott bandwidth ``std * n^(-1/5)`` (sample std per label, two-pass). The
    whole grid is summed per partition with numpy, so a task sends at most
    ``2 x points`` rows on, however many distinct scores it holds. A class of
    one row, or of equal scores only, has no bandwidth: its density is null.
    """
    rows = _label_rows(g)
    means = rows.groupBy("label").agg(
        (F.sum(F.col("cnt") * F.col("score")) / F.sum("cnt")).alias("mu"),
        F.sum("cnt").alias("n"),
    )
    spread = F.sum(F.col("cnt") * F.pow(F.col("score") - F.col("mu"), 2))
    stats = rows.join(means, "label").groupBy("label").agg(
        F.sqrt(F.try_divide(spread, F.first("n") - 1)).alias("sd"),
        F.first("n").alias("n"),
    )
    stats = stats.select(
        F.col("label").alias("_label"), "n", F.nullif(F.col("sd") * F.pow(F.col("n"), -0.2), F.lit(0.0)).alias("bw")
    )
    mm = rows.agg(F.struct(F.min("score").alias("lo"), F.max("score").alias("hi"))).scalar()
    x = rows.join(stats, rows["label"] == F.col("_label")).select(
        F.col("label").cast("int").alias("label"), F.col("score").cast("double").alias("score"),
        F.col("cnt").cast("double").alias("cnt"), "bw", mm["lo"].alias("lo"), mm["hi"].alias("hi"),
    )

    def sums(batches):
        import numpy as np
        import pyarrow as pa

        total = {}
        for batch in batches:
            label, score, cnt, bw, lo, hi = (
                batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in range(6)
            )
            for at in range(0, len(label), 512):
                part = slice(at, at + 512)
                grid = lo[0] + (hi[0] - lo[0]) * np.arange(points) / (points - 1)
                w = cnt[part, None] * np.exp(-(((grid - score[part, None]) / bw[part, None]) ** 2) / 2)
                for k in np.unique(label[part]):
                    total[int(k)] = total.get(int(k), 0.0) + w[label[part] == k].sum(axis=0)
        for k, w in total.items():
            yield pa.RecordBatch.from_pydict(
                {"label": pa.array([k] * points, pa.int32()), "i": pa.array(range(points), pa.int32()), "w": pa.array(w)}
            )

    summed = x.mapInArrow(sums, "label int, i int, w double").groupBy("label", "i").agg(F.sum("w").alias("w"))
    scale = F.col("n") * F.col("bw") * F.lit((2 * 3.141592653589793) ** 0.5)
    return summed.join(stats, summed["label"] == F.col("_label")).select(
        F.col("label").cast("bigint").alias("label"),
        F.col("i").cast("bigint").alias("i"),
        (mm["lo"] + (mm["hi"] - mm["lo"]) * F.col("i") / (points - 1)).alias("x"),
        (F.col("w") / scale).alias("density"),
    )


def report_all(g: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """Every scalar of the report as ``section, name, value``, from one
    aggregate over ``g`` (and one over ``raw``, the evaluator's own values,
    for rank test and medians, where that differs)."""

    def row(section: str, name: str, value: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), F.lit(name).alias("name"), value.cast("double").alias("value"))

    def rank_rows() -> list[Column]:
        n1, n0, u1, z = _rank_test()
        return [
            row("mwu", "n1", n1), row("mwu", "n0", n0), row("mwu", "u1", u1), row("mwu", "z", z),
            row("mwu", "p_value", erfc(z / F.lit(2.0 ** 0.5)) / 2),
            row("median", "0", (F.col("n_lo") + F.col("n_hi")) / 2), row("median", "1", (F.col("p_lo") + F.col("p_hi")) / 2),
        ]

    ranks = [*_ranks(), *_middles()]
    one = _scalars(g, *_area(), _best(), *_quartiles(), *([] if raw is not None else ranks))
    best = _confusion_counts(one)
    rows = [
        row("auc_ap", "n_rows", F.col("P") + F.col("N")), row("auc_ap", "n_pos", F.col("P")), row("auc_ap", "n_neg", F.col("N")),
        row("auc_ap", "auc", _auc()), row("auc_ap", "ap", _ap()),
        *(row("youden", n, F.col(f"best.{c}")) for n, c in (("threshold", "t"), ("j", "j"), ("tpr", "tpr"), ("fpr", "fpr"))),
        *(row("confusion", n, F.col(n)) for n in ("tn", "fp", "fn", "tp")),
        *(row("box", n, F.col(n)) for n in ("min", "max", "mean")), *(row("box", q, _quartile(q)) for q in QUARTILES),
        *([] if raw is not None else rank_rows()),
    ]
    out = _class_rows(best.withColumn("_rows", F.array(*rows)), "_rows")
    # The class rows and the others come from one row each way of the same aggregate.
    classes = F.array_sort(F.collect_list(F.struct(
        F.concat(F.lit("class:"), F.col("class_name")).alias("section"), F.col("metric").alias("name"), "value"
    )))
    out = out.groupBy().agg(classes.alias("c"), F.first("_rows").alias("r")).select(F.inline(F.concat("c", "r")))
    bad = g.where(_nonfinite()).agg(F.coalesce(F.sum(F.col("pos") + F.col("neg")), F.lit(0)).cast("double").alias("value"))
    out = out.unionByName(bad.select(F.lit("auc_ap").alias("section"), F.lit("n_nonfinite").alias("name"), "value"))
    if raw is not None:
        out = out.unionByName(_scalars(raw, *ranks).select(F.inline(F.array(*rank_rows()))))
    return out


def binned_kde(g: DataFrame, points: int = KDE_POINTS, cells: int = KDE_CELLS) -> DataFrame:
    """The density of :func:`score_kde` by linear binning.

    Every distinct score is split between the two nearest of ``cells *
    (points - 1) + 1`` equally spaced places, in one aggregate; then each grid
    point sums the truncated kernel over the places in its reach. The cost is
    that of the aggregate plus a constant, and all of it is expressions. With
    places ``d`` apart the error is at most ``(d / bandwidth)^2 / 8`` of the
    kernel's peak.
    """
    rows, last = _label_rows(g), cells * (points - 1)
    one = rows.agg(
        F.struct(F.min("score").alias("lo"), F.max("score").alias("hi"), *(
            F.sum(F.when(F.col("label") == k, F.col("cnt") * (F.col("score") if p else 1))).cast("double").alias(f"s{k}{p}")
            for k in (0, 1) for p in (0, 1)
        )).alias("x")
    ).scalar()
    rows = rows.withColumns({"lo": one["lo"], "hi": one["hi"]}).withColumn("mu", F.when(F.col("label") == 1, one["s11"] / one["s10"]).otherwise(one["s01"] / one["s00"]))
    at = F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")) * last).otherwise(0.0)
    rows = rows.withColumn("at", at).withColumn("cell", F.least(F.floor("at"), F.lit(last - 1)).cast("int"))
    share = F.col("at") - F.col("cell")
    # One shuffle of at most two rows a place and label from each task.
    halves = rows.select(
        "label", "lo", "hi", (F.col("cnt") * F.pow(F.col("score") - F.col("mu"), 2)).alias("q"), "cnt",
        F.inline(F.array(
            F.struct(F.col("cell").alias("j"), (F.col("cnt") * (1 - share)).alias("w"), F.lit(1).alias("first")),
            F.struct((F.col("cell") + 1).alias("j"), (F.col("cnt") * share).alias("w"), F.lit(0).alias("first")),
        )),
    )
    places = halves.groupBy("label", "j").agg(
        F.sum("w").alias("w"), F.sum(F.col("q") * F.col("first")).alias("q"), F.sum(F.col("cnt") * F.col("first")).alias("n"),
        F.first("lo").alias("lo"), F.first("hi").alias("hi"),
    )
    # At most one entry a place: a bounded array for each of two labels.
    labels = places.groupBy("label").agg(
        F.map_from_entries(F.collect_list(F.struct("j", "w"))).alias("ws"), F.sum("q").alias("q"), F.sum("n").alias("n"),
        F.first("lo").alias("lo"), F.first("hi").alias("hi"),
    )
    width = (F.col("hi") - F.col("lo")) / last
    bw = F.nullif(F.sqrt(F.try_divide(F.col("q"), F.col("n") - 1)) * F.pow(F.col("n"), F.lit(-0.2)), F.lit(0.0))
    labels = labels.select(
        "label", "n", "lo", "hi", width.alias("d"), bw.alias("bw"),
        F.transform(F.sequence(F.lit(0), F.lit(last)), lambda j: F.coalesce(F.try_element_at("ws", j), F.lit(0.0))).alias("w"),
    )
    reach = F.least(F.ceil(F.try_divide(F.lit(KDE_REACH) * F.col("bw"), F.col("d"))), F.lit(last)).cast("int")
    grid = labels.withColumn("reach", F.coalesce(reach, F.lit(0))).repartition(default_buckets(g)).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")
    ).repartition(default_buckets(g), "label", "i")
    here = F.col("i") * cells

    def near(s: Column, w: Column, k: Column) -> Column:
        return s + F.when(w == 0, 0.0).otherwise(w * F.exp(-F.pow((k + F.col("from") - here) * F.col("d") / F.col("bw"), 2) / 2))

    grid = grid.withColumn("from", F.greatest(here - F.col("reach"), F.lit(0)))
    window = F.slice("w", F.col("from") + 1, F.least(here + F.col("reach"), F.lit(last)) - F.col("from") + 1)
    summed = F.aggregate(
        F.transform(window, lambda w, k: near(F.lit(0.0), w, k)), F.lit(0.0), lambda s, x: s + x
    )
    scale = F.col("n") * F.col("bw") * F.lit((2 * 3.141592653589793) ** 0.5)
    return grid.select(
        F.col("label").cast("bigint").alias("label"), F.col("i").cast("bigint").alias("i"),
        (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (points - 1)).alias("x"),
        (summed / scale).alias("density"),
    )


def binned_hist(g: DataFrame, bin_size: float = BIN_SIZE) -> DataFrame:
    """Histogram with bins of ``bin_size`` from each label's least score,
    as probability density: ``label, bin, bin_lo, n, density``."""
    rows = _label_rows(g)
    lows = rows.agg(F.struct(*(F.min(F.when(F.col("label") == k, F.col("score"))).alias(f"l{k}") for k in (0, 1)), *(
        F.sum(F.when(F.col("label") == k, F.col("cnt"))).alias(f"n{k}") for k in (0, 1)
    ))).scalar()
    lo = F.when(F.col("label") == 1, lows["l1"]).otherwise(lows["l0"])
    total = F.when(F.col("label") == 1, lows["n1"]).otherwise(lows["n0"])
    rows = rows.withColumns({"lo": lo, "total": total}).withColumn("bin", F.floor((F.col("score") - F.col("lo")) / bin_size))
    return rows.groupBy("label", "bin").agg(F.sum("cnt").alias("n"), F.first("lo").alias("lo"), F.first("total").alias("total")).select(
        F.col("label").cast("bigint").alias("label"), F.col("bin").cast("bigint").alias("bin"),
        (F.col("lo") + F.col("bin") * bin_size).alias("bin_lo"), F.col("n").cast("bigint").alias("n"),
        (F.col("n") / (F.col("total") * bin_size)).alias("density"),
    )


def score_distplot(g: DataFrame, bin_size: float = BIN_SIZE) -> DataFrame:
    """What the distribution plot draws per label, as ``part`` (density,
    histogram), ``label, i, x, y``. The rug is :func:`score_rug`."""
    density = binned_kde(g).select(F.lit("density").alias("part"), "label", "i", "x", F.col("density").alias("y"))
    hist = binned_hist(g, bin_size).select(F.lit("histogram").alias("part"), "label", F.col("bin").alias("i"), F.col("bin_lo").alias("x"), F.col("density").alias("y"))
    return density.unionByName(hist)


def score_rug(scored: DataFrame, key: str = "eval_id", score: str = "score", label: str = "label") -> DataFrame:
    """The plot's rug, ``label, score, id`` of every finite score."""
    s = F.col(score)
    return scored.where(s.isNotNull() & ~F.isnan(s) & (F.abs(s) != F.lit(INF))).select(
        F.col(label).cast("bigint").alias("label"), s.cast("double").alias("score"), F.col(key).alias("id")
    )


def report_plan(
    scored: DataFrame, score: str = "score", label: str = "label", raw_score: str | None = None
) -> dict[str, DataFrame]:
    """The whole binary report for one scored set, as named tables.

    Ranks, medians and the raw histogram use ``raw_score`` (the evaluator's own
    value, small for right answers) where one is given; curves and the class
    report use ``score`` (the inverted value). The distinct-score tables are
    materialised once; every table below reads one. Write them together with :func:`tessera.sources.io.write_report`.
    """
    g = score_table(scored, score, label)
    raw = score_table(scored, raw_score, label) if raw_score else g
    return {
        "youden": youden(g),
        "class_report": class_report(g),
        "scalars": report_scalars(g),
        "roc": roc_points(g),
        "pr": pr_points(g),
        "auc_ap": auc_ap(g),
        "confusion": confusion(g),
        "mann_whitney": mann_whitney_less(raw),
        "medians": median_by_label(raw),
        "histogram": score_hist(g),
        "histogram_raw": score_hist(raw),
        "box": score_box(g),
        "kde": score_kde(g),
        "distplot": score_distplot(g),
        "scalars_all": report_all(g, raw if raw_score else None),
    }
