import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tessera.operators import report as R
from tessera.operators import training as TR
from tessera.operators.ranking import grouped_prefix_table, prefix_table, score_counts
from tessera.operators.sampling import stratified_split
from tessera.plans.samples import FEATURES, f9_rows


def test_grouped_prefix_equals_per_group(spark):
    rng = random.Random(5)
    rows = [(k, float(rng.randint(0, 20)), rng.randint(0, 1)) for k in range(3) for _ in range(300)]
    df = spark.createDataFrame(rows, "k int, score double, label int")
    g = df.groupBy("k", "score").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    got = {(r["k"], r["score"]): (r["below_pos"], r["below_neg"]) for r in grouped_prefix_table(g, ["k"], 4).collect()}
    for k in range(3):
        one = prefix_table(score_counts(df.where(F.col("k") == k), materialize=False), 4).collect()
        for r in one:
            assert got[(k, r["score"])] == (r["below_pos"], r["below_neg"])


@pytest.fixture(scope="module")
def data(spark):
    rows = stratified_split(f9_rows(spark, SF_SMALL), "id", "Y", 0.2, 42)
    rows = TR.materialize(TR.assemble(rows, FEATURES, "Y"))
    return rows.where(~F.col("is_test")), rows.where(F.col("is_test"))


def test_rounds_of_both_parts(spark, data):
    train, test = data
    model = TR.train_gbt(train, max_iter=6, max_depth=3)
    rows = train.withColumn("part", F.lit("learn")).unionByName(test.withColumn("part", F.lit("test")))
    got = {(r["part"], r["iteration"]): r for r in TR.iteration_metrics(model, rows).collect()}
    assert sorted(got) == [(p, k) for p in ("learn", "test") for k in range(1, 7)]
    for part, df in (("learn", train), ("test", test)):
        # Spark's own loss is twice the mean negative log-likelihood.
        for k, loss in enumerate(model.evaluateEachIteration(df), 1):
            assert got[part, k]["logloss"] == pytest.approx(loss / 2, abs=1e-9)
        p = TR.predictions(model, df).select(F.col("proba_class_1").alias("score"), F.col("y_true").alias("label"))
        assert got[part, 6]["auc"] == pytest.approx(R.auc_ap(R.score_table(p)).first()["auc"], abs=1e-9)
        hit = p.selectExpr("count_if(score >= 0.5 and label = 1)", "count_if(score >= 0.5 and label = 0)", "count_if(score < 0.5 and label = 1)").first()
        assert got[part, 6]["f1"] == pytest.approx(2 * hit[0] / max(1, 2 * hit[0] + hit[1] + hit[2]))


def test_running_margins_walk_every_tree(spark, data):
    from pyspark.ml.functions import vector_to_array

    _, test = data
    model = TR.train_gbt(test, max_iter=3, max_depth=4)
    x = test.withColumn("x", vector_to_array("features"))
    rows = x.select("features", TR.running_margins(model, F.col("x")).alias("m")).limit(40).collect()
    for r in rows:
        want, total = [], 0.0
        for tree, w in zip(model.trees, model.treeWeights):
            total += w * tree.predict(r["features"])
            want.append(total)
        assert r["m"] == pytest.approx(want, abs=1e-12)


def test_eval_set_ends_the_rounds(spark, data):
    train, test = data
    model, best = TR.train_gbt_to_best(train, test, max_iter=12, patience=3, max_depth=2)
    losses = model.evaluateEachIteration(test)
    assert losses[best - 1] == min(losses) and (len(losses) == 12 or len(losses) - best >= 3)
    p = {r["eval_id"]: r for r in TR.predictions_at(model, best, test).collect()}
    loss = 0.0
    for r in p.values():
        assert r["proba_class_0"] + r["proba_class_1"] == pytest.approx(1.0)
        loss -= math.log(r["proba_class_1"] if r["y_true"] else r["proba_class_0"])
    assert loss / len(p) == pytest.approx(losses[best - 1] / 2, abs=1e-9)


def test_labelled_sample_keeps_the_shares(spark, data):
    train, _ = data
    took = TR.labelled_sample(train, bound=200)
    share = lambda df: df.agg(F.avg("label")).first()[0]
    assert abs(took.count() - 200) <= 1 and share(took) == pytest.approx(share(train), abs=0.01)
    assert TR.labelled_sample(train, bound=10**6).count() == train.count()


@pytest.fixture(scope="module")
def made(spark):
    """Train and test rows: two features of few values, two of many."""
    rng = random.Random(11)
    rows = []
    for k in range(2500):
        x = [float(rng.randint(1, 12)), float(rng.randint(0, 4)), rng.random(), rng.gauss(0, 2)]
        rows.append((k, *x, int(x[0] + 2 * x[1] + 5 * x[2] + rng.gauss(0, 3) > 12)))
    df = spark.createDataFrame(rows, "id bigint, " + ", ".join(f"{c} double" for c in FEATURES) + ", Y int")
    df = TR.materialize(TR.assemble(stratified_split(df, "id", "Y", 0.2, 42), FEATURES, "Y"))
    return df.where(~F.col("is_test")), df.where(F.col("is_test"))


def test_cells_learn_and_score_as_their_rows(spark, made):
    """Boosting on counted cells gives the rounds that boosting on the rows gives."""
    train, test = made
    borders = TR.feature_borders(train)
    learn, held = (TR.cells(TR.binned(df, borders), "label") for df in (train, test))
    assert learn.agg(F.sum("weight")).first()[0] == train.count() and learn.count() < train.count()
    by_rows, by_cells = TR.train_gbt(train, 4, max_depth=3), TR.train_gbt(learn, 4, max_depth=3, weight="weight")
    assert by_cells.evaluateEachIteration(held) == pytest.approx(by_rows.evaluateEachIteration(test), abs=1e-9)
    p = TR.predictions_at(by_cells, 4, held.dropDuplicates(["bins"]), "bins")
    got = {r["eval_id"]: r["proba_class_1"] for r in TR.score_cells(TR.binned(test, borders), p).collect()}
    want = {r["eval_id"]: r["proba_class_1"] for r in TR.predictions(by_rows, test).collect()}
    assert got == pytest.approx(want, abs=1e-9)
    rows = held.withColumn("part", F.lit("test"))
    plain = test.withColumn("part", F.lit("test"))
    got = [tuple(r)[1:] for r in TR.iteration_metrics(by_cells, rows, weight="weight").orderBy("iteration").collect()]
    want = [tuple(r)[1:] for r in TR.iteration_metrics(by_rows, plain).orderBy("iteration").collect()]
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=1e-9)


def test_borders_of_many_rows(spark, made, monkeypatch):
    """The rows that borders are found on are not those the split took away."""
    monkeypatch.setattr(TR, "BORDER_ROWS", 500)
    borders = TR.feature_borders(made[0])
    assert len(borders) == len(FEATURES) and borders[1] == [0.5, 1.5, 2.5, 3.5]
    assert [len(b) for b in borders[::2]] == [11, TR.MAX_BINS - 1] and all(b == sorted(b) for b in borders)


def test_missing_features_fall_in_the_last_bin(spark):
    rows = spark.createDataFrame([(k, float(k % 7), None if k % 5 == 0 else float(k), k % 2) for k in range(200)], "id int, a double, b double, Y int")
    rows = TR.assemble(rows, ["a", "b"])
    with pytest.raises(ValueError, match="40 of 200"):
        TR.feature_borders(rows)
    borders = TR.feature_borders(rows.where("b is not null"))
    assert borders[0] == [k + 0.5 for k in range(6)] and len(borders[1]) == TR.MAX_BINS - 1
    last = TR.binned(rows, borders).where("b is null").select(F.col("bins")[1].alias("n")).distinct().collect()
    assert [r["n"] for r in last] == [TR.MAX_BINS - 1]


def test_forest_is_scored_from_its_nodes(spark, made):
    """The same shares as the model's own, without the model in the plan."""
    train, test = made
    model = TR.train_random_forest(TR.labelled_sample(train, bound=300), n_trees=15, max_depth=12)
    p = TR.predictions(model, test)
    assert "MapInPandas" in p._jdf.queryExecution().toString()
    got = {r["eval_id"]: r["proba_class_1"] for r in p.collect()}
    for r in test.select("id", "features").limit(60).collect():
        assert got[r["id"]] == pytest.approx(model.predictProbability(r["features"])[1], abs=1e-12)


def test_cells_are_scored_by_several_tasks(spark, made):
    """Few narrow cells are not left to one task, and come once each."""
    train, test = made
    counted = TR.cells(TR.binned(test, TR.feature_borders(train)), "label")
    one = TR.distinct_cells(counted)
    tasks = one.select(F.spark_partition_id().alias("p"), "bins").toPandas()
    assert tasks["p"].nunique() > 1 and len(tasks) == counted.select("bins").distinct().count()


def test_rounds_of_a_batch_are_those_of_a_row(spark, made):
    """Rows walking the trees together get the margins that a row's own walk gives."""
    from pyspark.ml.functions import vector_to_array

    train, test = made
    model = TR.train_gbt(train, 4, max_depth=6)
    x = test.select("id", vector_to_array("features").alias("_x"))
    got = {r["id"]: r["margins"] for r in TR.with_margins(x, model).collect()}
    last = {r["id"]: r["margins"] for r in TR.with_margins(x, model, 3, last=True).collect()}
    want = {r["id"]: r["m"] for r in x.select("id", TR.running_margins(model, F.col("_x")).alias("m")).collect()}
    assert got == want and last == {k: [m[2]] for k, m in want.items()}


def test_given_buckets_count_as_cut_points(spark):
    rng = random.Random(6)
    rows = [(k, rng.randint(0, 400) / 400, rng.randint(0, 3), rng.randint(0, 3)) for k in range(3) for _ in range(300)]
    g = spark.createDataFrame(rows, "k int, score double, pos bigint, neg bigint").groupBy("k", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    keep = ("k", "score", "pos", "neg", "below_pos", "below_neg", "P", "N")
    got = grouped_prefix_table(g, ["k"], bucket=F.floor(F.col("score") * 7).cast("int")).select(*keep).collect()
    assert sorted(got) == sorted(grouped_prefix_table(g, ["k"], 4).select(*keep).collect())


def test_forest_does_not_depend_on_the_layout(spark, made):
    """The same rows in other partitions and another order give the same trees."""
    rows = made[0].where("id % 6 = 0")
    found = []
    for df in (rows.coalesce(1), rows.repartition(7, "l_tax").sortWithinPartitions(F.desc("id"))):
        dealt = TR.forest_rows(TR.materialize(df))
        assert dealt.rdd.getNumPartitions() == TR.FOREST_TASKS
        found.append(TR.train_random_forest(dealt, n_trees=5, max_depth=6).toDebugString.split("\n", 1)[1])
    assert found[0] == found[1]


def test_collected_trees_are_the_node_arrays(spark, made):
    import numpy as np

    model = TR.train_gbt(made[0], 3, max_depth=4)
    for rounds in (None, 2):
        got = TR._collected_trees(model, rounds)
        want = TR.node_arrays(model).orderBy("tree").collect()[:rounds]
        assert [t[0] for t in got] == [r["w"] for r in want]
        for (_, feature, threshold, children, value, share), r in zip(got, want, strict=True):
            inner = np.array(r["left"]) >= 0
            assert (feature[inner] == np.array(r["feature"])[inner]).all() and (threshold[inner] == np.array(r["threshold"], float)[inner]).all()
            assert (children[::2][inner] == np.array(r["right"])[inner]).all() and (children[1::2][inner] == np.array(r["left"])[inner]).all()
            assert (children[::2][~inner] == np.flatnonzero(~inner)).all() and list(value) == r["value"] and share.shape[1] == len(inner)


def test_forests_learn_from_every_row(spark, monkeypatch):
    """The cells that the forest's learner gets stand for all training rows."""
    from tessera.plans import training as P

    class Seen(Exception):
        pass

    def stop(learn, *_args, weight=None, **_kw):
        raise Seen(learn.agg(F.sum(weight) if weight else F.count("*")).first()[0])

    monkeypatch.setattr(TR, "train_random_forest", stop)
    monkeypatch.setattr(P, "_MODELS", {})
    train, _ = P._split(spark, SF_SMALL)
    n = train.count()
    assert n > 4000
    with pytest.raises(Seen) as seen:
        P.QUERIES["rf_predictions"](spark, SF_SMALL)
    assert seen.value.args == (n,)


def _fold(values, most=32):
    """Spark's rule for the split candidates of a feature, one value after the other."""
    counts = sorted({v: values.count(v) for v in values}.items())
    if len(counts) <= min(most, len(values)):
        return [(a + b) / 2 for (a, _), (b, _) in zip(counts, counts[1:])]
    stride = len(values) / min(most, len(values))
    cuts, upto, target = [], counts[0][1], stride
    for (last, _), (v, c) in zip(counts, counts[1:]):
        if abs(upto - target) < abs(upto + c - target):
            cuts.append((last + v) / 2)
            target += stride
        upto += c
    return cuts


def test_borders_on_all_rows_follow_the_fold(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(k, rng.gauss(0, 1), float(min(99, int(rng.expovariate(0.05)))), float(rng.choice([0, 0, 0, 7, rng.randint(0, 60)])), float(k % 5)) for k in range(1500)]
    df = TR.assemble(spark.createDataFrame(rows, "id bigint, a double, b double, c double, d double").withColumn("Y", F.lit(1)), list("abcd"))
    want = [_fold([r[k] for r in rows]) for k in range(1, 5)]
    assert TR.feature_borders(df) == want
    monkeypatch.setattr(TR, "BORDER_ROWS", 200)
    assert TR.feature_borders(df, rows=None) == want and TR.feature_borders(df) != want


@pytest.fixture(scope="module")
def counted(made):
    train, test = made
    borders = TR.feature_borders(train, rows=None)
    return [TR.cells(TR.binned(df, borders), "label") for df in (train, test)]


def test_a_tree_of_cells_is_the_tree_of_their_rows(spark, made, counted):
    """Without draws, a tree grown from counted cells gives every cell the shares of Spark's tree on the rows."""
    import numpy as np
    from pyspark.ml.classification import DecisionTreeClassifier

    rows = TR.as_features(TR.binned(made[0], TR.feature_borders(made[0], rows=None)))
    spark_tree = DecisionTreeClassifier(maxDepth=12).fit(rows)
    cells = {}
    for r in counted[0].collect():
        cells.setdefault(tuple(r["bins"]), [0, 0])[int(r["label"])] = int(r["weight"])
    x, w = np.array(list(cells)), np.array(list(cells.values()))
    grow, importance, pack = TR._tree_grower()
    feature, cut, count = grow(x.astype(np.uint8), w, [32] * 4, 4, 12, np.random.default_rng(0))
    assert (feature >= 0).sum() > 100 and abs(len(feature) - spark_tree.numNodes) <= 0.02 * len(feature)
    tree = TR._tree_reader()(pack(feature, cut, count), [np.arange(31) + 0.5] * 4)
    leaf = TR._leaf_finder()(x.astype(float).ravel(), 4, tree)
    got = tree[-1][1][leaf]
    want = np.array([spark_tree.predictProbability(v)[1] for v in map(_dense, x)])
    assert np.mean(np.abs(got - want) < 1e-12) > 0.98  # two splits may gain the same
    assert importance(feature, count, 4) == pytest.approx(spark_tree.featureImportances.toArray(), abs=0.01)


def _dense(v):
    from pyspark.ml.linalg import Vectors

    return Vectors.dense([float(e) for e in v])


def test_a_forest_of_cells_predicts_as_sparks(spark, made, counted):
    """Trees on counted cells see as many rows as Spark's and give nearly its shares, the same however the cells lie."""
    import numpy as np

    learn, held = counted
    model = TR.train_random_forest(learn, n_trees=120, weight="weight")
    assert model.getNumTrees == 120 and model.numFeatures == 4 and model.numClasses == 2
    roots = [np.frombuffer(zlib.decompress(r["nodes"]), np.int64, offset=2 * (len(zlib.decompress(r["nodes"])) // 18)).reshape(2, -1)[:, 0].sum() for r in model.trees.collect()]
    assert np.mean(roots) == pytest.approx(made[0].count(), rel=0.02) and len(set(roots)) > 50
    one = TR.distinct_cells(held)
    got = {tuple(r["eval_id"]): r["proba_class_1"] for r in TR.predictions(model, one, "bins").collect()}
    rows = TR.as_features(TR.binned(made[0], TR.feature_borders(made[0], rows=None)))
    theirs = TR.train_random_forest(TR.forest_rows(rows), n_trees=120)
    want = {tuple(r["eval_id"]): r["proba_class_1"] for r in TR.predictions(theirs, one, "bins").collect()}
    assert got.keys() == want.keys()
    a, b = (np.array([d[k] for k in want]) for d in (got, want))
    assert abs(a.mean() - b.mean()) < 0.01 and np.abs(a - b).mean() < 0.03 and np.corrcoef(a, b)[0, 1] > 0.98
    assert model.featureImportances.toArray() == pytest.approx(theirs.featureImportances.toArray(), abs=0.02)
    again = TR.train_random_forest(learn.repartition(5).sortWithinPartitions(F.desc("weight")), n_trees=3, weight="weight")
    first = TR.train_random_forest(learn, n_trees=3, weight="weight")
    assert sorted(map(tuple, again.trees.select("tree", "nodes").collect())) == sorted(map(tuple, first.trees.select("tree", "nodes").collect()))
