import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import report as R
from tessera.operators.ranking import prefix_table, score_counts, with_lower_neighbor


def brute(scores, labels):
    pos = [s for s, y in zip(scores, labels) if y == 1]
    neg = [s for s, y in zip(scores, labels) if y == 0]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    thr = sorted(set(scores), reverse=True)
    best = (0.0, math.inf)
    ap = 0.0
    for t in thr:
        tp = sum(1 for s in pos if s >= t)
        fp = sum(1 for s in neg if s >= t)
        j = tp / len(pos) - fp / len(neg)
        if j > best[0]:
            best = (j, t)
        npos = sum(1 for s in pos if s == t)
        ap += npos / len(pos) * tp / (tp + fp)
    allv = sorted(scores)
    ranks = {}
    i = 0
    while i < len(allv):
        j = i
        while j < len(allv) and allv[j] == allv[i]:
            j += 1
        ranks[allv[i]] = (i + 1 + j) / 2
        i = j
    u1 = sum(ranks[p] for p in pos) - len(pos) * (len(pos) + 1) / 2
    return auc, best[1], ap, u1


@pytest.mark.parametrize("buckets", [1, 3, 64])
def test_prefix_table_partition_free(spark, buckets):
    rng = random.Random(buckets)
    rows = [(float(rng.randint(0, 30)), rng.randint(0, 1)) for _ in range(500)]
    df = spark.createDataFrame(rows, "score double, label int")
    pt = prefix_table(score_counts(df, materialize=False), n_buckets=buckets).collect()
    for r in pt:
        assert r["below_pos"] == sum(1 for s, y in rows if s < r["score"] and y == 1)
        assert r["below_neg"] == sum(1 for s, y in rows if s < r["score"] and y == 0)


def test_report_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(round(rng.gauss(0, 1), 1), rng.randint(0, 1)) for _ in range(400)]
    rows += [(float("inf"), 1), (float("nan"), 0)]
    df = spark.createDataFrame(rows, "score double, label int")
    g = R.score_table(df)
    fin = [(s, y) for s, y in rows if math.isfinite(s)]
    auc, thr, ap, u1 = brute([s for s, _ in fin], [y for _, y in fin])
    a = R.auc_ap(g).first()
    assert a["auc"] == pytest.approx(auc) and a["ap"] == pytest.approx(ap)
    assert a["n_nonfinite"] == 2 and a["n_rows"] == len(fin)
    assert R.youden(g).first()["threshold"] == pytest.approx(thr)
    m = R.mann_whitney_less(g).first()
    assert m["u1"] == pytest.approx(u1)
    roc = R.roc_points(g).collect()
    assert max(r["tpr"] for r in roc) == 1.0 and max(r["fpr"] for r in roc) == 1.0
    assert any(r["threshold"] == math.inf for r in roc)


def test_youden_all_equal_and_perfect(spark):
    eq = spark.createDataFrame([(1.0, 0), (1.0, 1), (1.0, 1)], "score double, label int")
    assert R.youden(R.score_table(eq)).first()["threshold"] == math.inf
    perfect = spark.createDataFrame([(0.1, 0), (0.2, 0), (0.8, 1), (0.9, 1)], "score double, label int")
    y = R.youden(R.score_table(perfect)).first()
    assert y["threshold"] == 0.8 and y["j"] == 1.0
    cm = {(r["y_true"], r["y_pred"]): r["n"] for r in R.confusion(R.score_table(perfect)).collect()}
    assert cm == {(0, 0): 2, (0, 1): 0, (1, 0): 0, (1, 1): 2}


def test_median_exact(spark):
    rows = [(float(v), v % 2) for v in [5, 1, 9, 3, 3, 8, 2, 7, 4, 6]]
    df = spark.createDataFrame(rows, "score double, label int")
    got = {r["label"]: r["median"] for r in R.median_by_label(R.score_table(df)).collect()}
    import statistics
    assert got[1] == statistics.median([s for s, y in rows if y == 1])
    assert got[0] == statistics.median([s for s, y in rows if y == 0])


def test_auc_equals_u_over_n1n0(spark):
    from conftest import SF_MID
    import __spark_entry__ as E

    q = E.queries()
    for suffix in ["", "_docs", "_price"]:
        a = q["auc_ap" + suffix](spark, SF_MID).first()
        m = q["mwu" + suffix](spark, SF_MID).first()
        assert a["auc"] == pytest.approx(m["u1"] / (m["n1"] * m["n0"]), abs=2e-6)


def score_rows(spark, rows):
    return spark.createDataFrame(rows, "score double, pos long, neg long")


def test_statistics_at_large_counts(spark):
    n = 4_000_000_000
    g = score_rows(spark, [(1.0, 0, n), (2.0, n, 0)])
    a = R.auc_ap(g).first()
    assert a["auc"] == 1.0 and a["ap"] == 1.0
    tied = R.auc_ap(score_rows(spark, [(1.0, n, n)])).first()
    assert tied["auc"] == 0.5 and tied["ap"] == 0.5
    m = R.mann_whitney_less(score_rows(spark, [(1.0, 5_000_000, 5_000_000), (2.0, 1, 0)])).first()
    assert m["n1"] == 5_000_001 and 0.0 < m["p_value"] < 1.0


@pytest.mark.parametrize("shift", [-0.4, 0.0, 0.4])
def test_p_value_against_erfc(spark, shift):
    rng = random.Random(11)
    rows = [(round(rng.gauss(shift * y, 1), 2), y) for y in (0, 1) for _ in range(150)]
    m = R.mann_whitney_less(R.score_table(spark.createDataFrame(rows, "score double, label int"))).first()
    assert m["p_value"] == pytest.approx(math.erfc(m["z"] / math.sqrt(2)) / 2, rel=1e-6)


def test_kde_of_classes_without_spread(spark):
    for rows in ([(1.0, 3, 0), (1.0, 0, 0), (2.0, 0, 4), (3.0, 0, 4)], [(1.0, 1, 0), (2.0, 0, 4), (3.0, 0, 4)]):
        got = R.score_kde(score_rows(spark, rows)).collect()
        assert {r["label"] for r in got if r["density"] is None} == {1}
        area = sum(r["density"] for r in got if r["label"] == 0) * (2.0 / (R.KDE_POINTS - 1))
        assert 0.4 < area < 1.0


def test_lower_neighbour_across_empty_buckets(spark):
    rows = [(float(v), v % 3, 1) for v in (1, 2, 50, 51, 900)]
    pt = with_lower_neighbor(prefix_table(score_rows(spark, rows), n_buckets=16))
    got = {r["score"]: r["dn_pos"] for r in pt.collect()}
    assert got == {1.0: None, 2.0: 1, 50.0: 2, 51.0: 2, 900.0: 0}


def test_report_plan_uses_the_raw_score_for_ranks(spark):
    rows = [(float(-v), float(v), int(v < 3)) for v in range(1, 8)]
    df = spark.createDataFrame(rows, "score double, raw double, label int")
    plan = R.report_plan(df, raw_score="raw")
    assert {r["label"]: r["median"] for r in plan["medians"].collect()} == {0: 5.0, 1: 1.5}
    assert plan["mann_whitney"].first()["p_value"] < 0.1 and plan["auc_ap"].first()["auc"] == 1.0


def test_report_all_equals_the_single_reports(spark):
    rng = random.Random(8)
    rows = [(round(rng.gauss(y, 1), 1), y) for y in (0, 1) for _ in range(120)] + [(float("nan"), 1), (float("inf"), 0), (None, 1)]
    g = R.score_table(spark.createDataFrame(rows, "score double, label int"))
    got = {(r["section"], r["name"]): r["value"] for r in R.report_all(g).collect()}
    for section, op in (("auc_ap", R.auc_ap), ("youden", R.youden), ("box", R.score_box), ("mwu", R.mann_whitney_less)):
        for name, value in op(g).first().asDict().items():
            if section != "box" or name != "n":
                assert got[section, name] == pytest.approx(value, rel=1e-12), (section, name)
    assert {k[1]: v for k, v in got.items() if k[0] == "confusion"} == {
        {(0, 0): "tn", (0, 1): "fp", (1, 0): "fn", (1, 1): "tp"}[r["y_true"], r["y_pred"]]: r["n"] for r in R.confusion(g).collect()}
    for r in R.class_report(g).collect():
        assert got["class:" + r["class_name"], r["metric"]] == pytest.approx(r["value"], rel=1e-12)
    assert {r["label"]: r["median"] for r in R.median_by_label(g).collect()} == {int(n): v for (s, n), v in got.items() if s == "median"}
    assert got["auc_ap", "n_nonfinite"] == 3 and len(got) == 44


def test_report_of_no_finite_score(spark):
    g = R.score_table(spark.createDataFrame([(float("nan"), 1), (None, 0)], "score double, label int"))
    got = {(r["section"], r["name"]): r["value"] for r in R.report_all(g).collect()}
    assert got["auc_ap", "n_nonfinite"] == 2 and got["confusion", "tp"] == 0 and got["youden", "threshold"] == math.inf
    assert R.roc_points(g).count() == 1 and R.auc_ap(g).first()["n_nonfinite"] == 2


def test_scalars_are_one_aggregate(spark):
    g = R.score_table(spark.createDataFrame([(float(v), v % 2) for v in range(50)], "score double, label int"))
    plan = R.class_report(g)._jdf.queryExecution().executedPlan().toString()
    assert "Subquery" not in plan and "Join" not in plan and "Window" not in plan


def test_binned_density_is_near_the_exact_one(spark):
    rng = random.Random(4)
    rows = [(rng.gauss(2 * y, 1 + y), 1 - y, y) for y in (0, 1) for _ in range(300)] + [(0.5, 40, 40)]
    g = score_rows(spark, rows)
    exact = {(r["label"], r["i"]): r for r in R.score_kde(g).collect()}
    got = {(r["label"], r["i"]): r for r in R.binned_kde(g).collect()}
    assert got.keys() == exact.keys()
    for k, r in got.items():
        assert r["x"] == pytest.approx(exact[k]["x"])
        # places a sixteenth of a grid step apart: (d / bandwidth)^2 / 8 of the peak
        assert r["density"] == pytest.approx(exact[k]["density"], abs=2e-4)
    plan = R.score_distplot(g)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "Python" not in plan


def test_density_of_classes_without_spread(spark):
    g = score_rows(spark, [(1.0, 3, 0), (2.0, 0, 4), (3.0, 0, 4)])
    got = R.binned_kde(g).collect()
    assert {r["label"] for r in got if r["density"] is None} == {1} and len(got) == 2 * R.KDE_POINTS
    one = R.binned_kde(score_rows(spark, [(1.0, 3, 2)])).collect()
    assert all(r["density"] is None for r in one) and R.binned_kde(score_rows(spark, [(1.0, 3, 2)]).limit(0)).count() == 0


def test_histogram_of_width_and_rug(spark):
    g = score_rows(spark, [(0.5, 1, 0), (0.74, 2, 1), (1.1, 0, 5), (9.5, 1, 0)])
    got = {(r["label"], r["bin"]): (r["n"], r["bin_lo"], r["density"]) for r in R.binned_hist(g, 0.25).collect()}
    assert got == {(1, 0): (3, 0.5, 3.0), (1, 36): (1, 9.5, 1.0), (0, 0): (1, 0.74, pytest.approx(1 / 6 / 0.25)), (0, 1): (5, 0.99, pytest.approx(5 / 6 / 0.25))}
    df = spark.createDataFrame([(1, 0.5, 1), (2, None, 1), (3, float("inf"), 0)], "eval_id long, score double, label int")
    assert [tuple(r) for r in R.score_rug(df).collect()] == [(1, 0.5, 1)]
