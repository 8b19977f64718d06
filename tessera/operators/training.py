"""Train tree ensembles on metric features and report on them.

Training runs on ``pyspark.ml`` (distributed tree induction); the reference's
boosted-tree library is not available, so ``GBTClassifier`` stands in: the
quality is compared (AUC), not the bits (SURVEY 7.6).

Spark's tree learners see a feature only by its bin, so rows whose features
fall in the same bins (a cell) are one row to them: ``feature_borders``,
``binned`` and ``cells`` count such rows, boosting learns from the counts as
weights, and a model scores each cell once. The number of cells is bounded by
the bins, not by the rows. Forests grow a tree per turn of a task from the
counts of all rows (``grow_forest``); no machine holds all their nodes.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.ml.classification import GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values from the reference: ensemble sizes, seed, test share.
N_TREES = 1000
N_ITERATIONS = 1000

# The deepest trees Spark grows (the reference's have no bound).
FOREST_DEPTH = 30
# Rows of a trial sample (:func:`labelled_sample`); no query learns from one.
FOREST_ROWS = 1000
# Partitions of a forest's rows, where Spark's learner takes rows: its nodes
# are split by so many tasks. Each keeps statistics of nearly all nodes, so
# more tasks take longer, not less.
FOREST_TASKS = 2
# Tasks that grow the trees of a forest of cells, or walk them.
TREE_TASKS = 100
# A leaf's share of class 1 is counted in so many parts, so that the sum over
# the trees is the same in any order.
VOTE_PARTS = 2**40
# Rounds without a better eval loss that end boosting.
PATIENCE = 25
# Bins of a feature and rows (taken by hash) that its borders are found on,
# as Spark's tree learners do by themselves.
MAX_BINS = 32
BORDER_ROWS = 10_000
# Cells a partition holds when a learner passes over them.
CELLS_PER_TASK = 10_000
# Equal parts of [0, 1] that the scores of one round are counted in.
SCORE_BUCKETS = 1024
SEED = 42
TEST_SHARE = 0.2


def segment_features(units: DataFrame, key: str = "eval_id", segment: str = "segment",
                     value: str = "value") -> DataFrame:
    """T0 (ours): per key and segment the count/mean/min/max/stddev of a
    unit metric, pivoted wide (one row per key, ``{segment}_{stat}``)."""
    segs = ("instruct", "context", "question", "answer")
    g = units.groupBy(key).pivot(segment, list(segs)).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.stddev_samp(value).alias("std"),
    )
    return g.fillna(0.0)


def assemble(df: DataFrame, features: list[str], label: str = "Y") -> DataFrame:
    """Every column but the label becomes the feature vector."""
    va = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    return va.transform(df).withColumn("label", F.col(label).cast("double"))


def materialize(df: DataFrame) -> DataFrame:
    """Tree learners pass over their input many times; cut the lineage once
    so the feature pipeline and the split are not recomputed per pass."""
    from tessera.session import materialize as _m

    return _m(df)


def labelled_sample(train: DataFrame, id_col: str = "id", bound: int = FOREST_ROWS, seed: int = SEED) -> DataFrame:
    """At most about ``bound`` rows (exact but for rounding per label) with
    the labels' shares kept; the whole table if it is no larger."""
    from tessera.operators.sampling import hashed_take

    n = train.count()
    if n <= bound:
        return train
    return hashed_take(train, id_col, seed, frac=bound / n, strata=["label"]).drop("draw")


def check_features(rows: DataFrame) -> int:
    """The number of rows; an error, as Spark's learners raise it, if a feature is missing or infinite."""
    unsound = F.exists(vector_to_array("features"), lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
    n, bad = rows.agg(F.count(F.lit(1)), F.count_if(unsound)).first()
    if bad:
        raise ValueError(f"vector values must not be NaN or infinite: {bad} of {n} rows")
    return n


def feature_borders(train: DataFrame, id_col: str = "id", seed: int = SEED, rows: int | None = -1) -> list[list[float]]:
    """The split candidates of every feature, by the rule of Spark's tree
    learners: between all distinct values, if these are few, else where equal
    shares of the rows end. They are found on at most about ``rows`` rows (as
    a default ``BORDER_ROWS``), taken by hash; None: on all. Only the borders
    and the values beside them come to the driver."""
    from tessera.functions.hashing import hash_u
    from tessera.operators.ranking import grouped_prefix_table

    n, rows = check_features(train), BORDER_ROWS if rows == -1 else rows
    draw = hash_u(F.lit("borders"), F.lit(seed), F.col(id_col))  # not the draw that split off the test rows
    took = train if rows is None or n <= rows else train.where(draw < rows / n)
    width = train.select(F.size(vector_to_array("features"))).first()[0]
    values = took.select(F.posexplode(vector_to_array("features")).alias("f", "score"))
    # Beside the rows, every distinct value counts one: the values below are a value's place.
    counts = materialize(values.groupBy("f", "score").agg(F.count(F.lit(1)).alias("pos")).withColumn("neg", F.lit(1).cast("bigint")))
    t = grouped_prefix_table(counts, ["f"]).select("f", F.col("score").alias("v"), F.col("below_neg").alias("place"), F.col("P").alias("n"), F.col("N").alias("m"),
                                                   (F.col("below_pos") + F.col("pos") / 2).alias("middle"))
    t = materialize(t)
    # A border goes below the first value whose rows lie for the greater part past an equal share; each value has one at most.
    shares = F.least(F.lit(MAX_BINS), F.col("n"))
    passed = F.when(F.col("m") <= shares, F.col("place")).otherwise(F.ceil(F.col("middle") * shares / F.col("n")) - 1)
    first = t.where("place > 0").groupBy("f", "m", passed.cast("int").alias("k")).agg(F.min("place").alias("place")).where("k > 0")
    at: dict[int, list[int]] = {k: [] for k in range(width)}
    found: dict[tuple[int, int], list] = {}
    for r in first.orderBy("f", "k").collect():  # at most MAX_BINS a feature
        found.setdefault((r["f"], r["m"]), []).append((r["k"], r["place"]))
    for (f, m), steps in found.items():
        done = 0
        for k, place in steps:
            for _ in range(k - done):  # one border per share
                here = max(place, at[f][-1] + 1 if at[f] else 1)
                if here < m:
                    at[f].append(here)
            done = k
    beside = F.lit(False)
    for f, places in at.items():
        if places:
            beside = beside | ((F.col("f") == f) & F.col("place").isin(sorted({p - d for p in places for d in (0, 1)})))
    value = {(r["f"], r["place"]): r["v"] for r in t.where(beside).select("f", "place", "v").collect()}
    return [[(value[f, p - 1] + value[f, p]) / 2 for p in at[f]] for f in range(width)]


def binned(rows: DataFrame, borders: list[list[float]]) -> DataFrame:
    """Adds ``bins``: by feature, the number of borders below its value (a
    missing value is above all, as trees send it right)."""
    x = rows.withColumn("_x", vector_to_array("features"))
    place = [sum(((F.col("_x")[k] > F.lit(b)).cast("int") for b in cuts), F.lit(0)) for k, cuts in enumerate(borders)]
    return x.withColumn("bins", F.array(*place)).drop("_x")


def as_features(rows: DataFrame) -> DataFrame:
    """The bins as the feature vector that a learner or a model takes."""
    return rows.withColumn("features", array_to_vector(F.col("bins").cast("array<double>")))


def cells(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows with ``bins``, counted: ``bins, keys, weight, features``."""
    g = materialize(rows.groupBy("bins", *keys).agg(F.count(F.lit(1)).cast("double").alias("weight")))
    tasks = min(g.sparkSession.sparkContext.defaultParallelism, 1 + g.count() // CELLS_PER_TASK)
    return materialize(as_features(g.repartition(tasks, "bins")))


def forest_rows(rows: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows dealt to a set number of partitions, ordered by id. Spark draws a
    tree's rows by partition and place, so the same rows give the same forest
    however they were dealt out before."""
    return rows.repartition(FOREST_TASKS, id_col).sortWithinPartitions(id_col)


def train_random_forest(train: DataFrame, n_trees: int = N_TREES, seed: int = SEED,
                        max_depth: int = FOREST_DEPTH, memory_mb: int = 512, weight: str | None = None):
    """``RandomForestClassifier`` with sqrt feature subsets. Node ids are
    cached per row and checkpointed every ten levels, so a deep level does
    not walk all trees from their roots; ``memory_mb`` bounds the statistics
    of the nodes that are split at once. Spark's learner takes rows and keeps
    all nodes on the driver; with ``weight``, the column that says how many
    rows a row stands for (see :func:`cells`), :func:`grow_forest` does it."""
    if weight:
        return grow_forest(train, weight, n_trees, seed, max_depth)
    rf = RandomForestClassifier(
        numTrees=n_trees, seed=seed, featureSubsetStrategy="sqrt", maxDepth=max_depth,
        cacheNodeIds=True, checkpointInterval=10, maxMemoryInMB=memory_mb,
        featuresCol="features", labelCol="label",
    )
    return rf.fit(materialize(train))


class CellForest:
    """A forest grown by :func:`grow_forest`. ``trees`` has a row per tree:
    ``tree, importance, nodes`` (packed; a tree's nodes level by level, the
    children of the k-th inner node at 2 k + 1 and 2 k + 2)."""

    def __init__(self, trees: DataFrame, thresholds: list[np.ndarray], n_trees: int, n_classes: int):
        from pyspark.ml.linalg import Vectors

        self.trees, self.thresholds = trees, thresholds
        self.getNumTrees, self.numFeatures, self.numClasses = n_trees, len(thresholds), n_classes
        sums = trees.select(*(F.sum(F.col("importance")[k]) for k in range(len(thresholds)))).first()
        whole = sum(sums)
        self.featureImportances = Vectors.dense([s / whole if whole else 0.0 for s in sums])


def _tree_grower():
    """``grow`` and ``pack``; tasks get them by value."""

    def grow(x: np.ndarray, w: np.ndarray, bins: list[int], take: int, max_depth: int, rng) -> tuple:
        """One tree by the rules of Spark's learner: Gini impurity, ``take``
        features drawn for every node, a node without a split that gains is a
        leaf, and two leaves of one class become their parent. ``x``: the bins
        of the cells; ``w``: their rows of either class. ``feature`` (-1: leaf),
        ``bin`` (at most: left) and ``count`` of every node, level by level."""
        rows = w.any(axis=1)
        x, w, total = x[rows], w[rows], w.sum(axis=0, dtype=float)[None]
        node, levels = np.zeros(len(x), np.int64), []
        for depth in range(max_depth + 1):
            feature, cut = np.full(len(total), -1, np.int8), np.zeros(len(total), np.uint8)
            levels.append([feature, cut, total])
            mixed = (total > 0).all(axis=1)
            if depth == max_depth or not mixed.any():
                break
            here = mixed[node]
            x, w, node, t = x[here], w[here], (np.cumsum(mixed) - 1)[node[here]], total[mixed]
            best, by, below, left = np.zeros(len(t)), np.full(len(t), -1), np.zeros(len(t), np.int64), np.zeros((len(t), 2))
            drawn = rng.random((len(t), x.shape[1])).argsort(axis=1) < take
            for f in np.flatnonzero(np.array(bins) > 1):
                some = np.flatnonzero(drawn[:, f])
                if not len(some):
                    continue
                of = drawn[node, f]
                at = (np.cumsum(drawn[:, f]) - 1)[node[of]] * bins[f] + x[of, f]
                l0, l1 = (np.bincount(at, w[of, c], len(some) * bins[f]).reshape(-1, bins[f]).cumsum(axis=1)[:, :-1] for c in (0, 1))
                r0, r1 = t[some, :1] - l0, t[some, 1:] - l1
                sides = (l0 + l1) * (r0 + r1)
                gain = np.where(sides > 0, (l1 * r0 - l0 * r1) ** 2 / np.maximum(sides, 1), 0.0)  # times 2 / count^2, exactly 0 without gain
                k = gain.argmax(axis=1)
                own = np.arange(len(some))
                more = gain[own, k] > best[some]
                won, k, own = some[more], k[more], own[more]
                best[won], by[won], below[won] = gain[own, k], f, k
                left[won, 0], left[won, 1] = l0[own, k], l1[own, k]
            split = by >= 0
            feature[mixed], cut[mixed] = by, below
            if not split.any():
                break
            total = np.stack([left[split], t[split] - left[split]], axis=1).reshape(-1, 2)
            here = split[node]
            x, w, node = x[here], w[here], node[here]
            right = x[np.arange(len(x)), by[node]] > below[node]
            node = 2 * (np.cumsum(split) - 1)[node] + right
        for level, under in zip(levels[-2::-1], levels[:0:-1]):
            leaf, one = under[0] < 0, under[2][:, 1] > under[2][:, 0]
            merge = leaf[::2] & leaf[1::2] & (one[::2] == one[1::2])
            inner = np.flatnonzero(level[0] >= 0)
            level[0][inner[merge]] = -1
            under[:] = [v[np.repeat(~merge, 2)] for v in under]
        return tuple(np.concatenate(v) for v in zip(*levels))

    def importance(feature: np.ndarray, count: np.ndarray, width: int) -> np.ndarray:
        """By feature, the impurity that a tree's nodes take away, as shares."""
        inner, n = feature >= 0, count.sum(axis=1)
        impure = 2 * count[:, 0] * count[:, 1] / n
        down = 2 * np.arange(inner.sum()) + 1
        gain = np.bincount(feature[inner], impure[inner] - impure[down] - impure[down + 1], width)
        return gain / gain.sum() if gain.sum() > 0 else gain

    def pack(feature: np.ndarray, cut: np.ndarray, count: np.ndarray) -> bytes:
        import zlib

        return zlib.compress(feature.tobytes() + cut.tobytes() + np.ascontiguousarray(count.T.astype(np.int64)).tobytes(), 1)

    return grow, importance, pack


def _tree_reader():
    """The packed nodes of a tree as :func:`_collected_trees` gives them."""

    def read(packed: bytes, thresholds: list[np.ndarray]) -> tuple:
        import zlib

        raw = zlib.decompress(packed)
        n = len(raw) // 18
        feature, cut = np.frombuffer(raw, np.int8, n).astype(np.int32), np.frombuffer(raw, np.uint8, n, n)
        count = np.frombuffer(raw, np.int64, 2 * n, 2 * n).reshape(2, n)
        inner, own = feature >= 0, np.arange(n)
        left = np.where(inner, 2 * np.cumsum(inner) - 1, own)
        threshold = np.zeros(n)
        for f, cuts in enumerate(thresholds):
            threshold[feature == f] = cuts[cut[feature == f]]
        children = np.stack([left + inner, left], axis=1).ravel().astype(np.int32)
        return 1.0, np.where(inner, feature, 0), threshold, children, (count[1] > count[0]).astype(float), count / count.sum(axis=0)

    return read


def grow_forest(train: DataFrame, weight: str, n_trees: int = N_TREES, seed: int = SEED, max_depth: int = FOREST_DEPTH) -> CellForest:
    """A forest on counted cells: every tree draws how often it sees the rows
    of a cell (a Poisson number with their count as its mean: the sum of the
    draws that Spark makes for each row) and is grown whole by one task, which
    holds the cells and one tree."""
    spark = train.sparkSession
    t = train.select(vector_to_array("features").alias("x"), "label", F.col(weight).cast("bigint").alias("n")).toArrow()  # the cells
    y = t["label"].to_numpy()
    if not np.isin(y, (0, 1)).all():
        raise ValueError("labels must be 0 or 1")
    x = t["x"].combine_chunks().flatten().to_numpy().reshape(len(y), -1)
    x, of = np.unique(x, axis=0, return_inverse=True)  # in an order of their own
    counts = np.zeros((len(x), 2), np.int64)
    np.add.at(counts, (of.ravel(), y.astype(int)), t["n"].to_numpy())
    values = [np.unique(c) for c in x.T]
    if max(map(len, values)) > 256:
        raise ValueError("a feature has more than 256 values: count cells of bins")
    codes = np.stack([np.searchsorted(v, c) for v, c in zip(values, x.T)], axis=1).astype(np.uint8)
    bins, take = [len(v) for v in values], int(np.ceil(np.sqrt(len(values))))
    sent, made = spark.sparkContext.broadcast((codes, counts)), _tree_grower()

    def trees(batches):
        import pyarrow as pa

        grow, importance, pack = made
        for b in batches:
            for k in b.column("id").to_pylist():
                codes, counts = sent.value
                rng = np.random.default_rng([seed, k])
                w = rng.poisson(counts)
                while not w.any():  # a tree sees a row at least
                    w = rng.poisson(counts)
                feature, cut, count = grow(codes, w, bins, take, max_depth, rng)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int64()), pa.array([importance(feature, count, len(bins)).tolist()], pa.list_(pa.float64())), pa.array([pack(feature, cut, count)], pa.binary())],
                    names=["tree", "importance", "nodes"],
                )

    grown = spark.range(0, n_trees, 1, min(n_trees, TREE_TASKS)).mapInArrow(trees, "tree bigint, importance array<double>, nodes binary")
    return CellForest(materialize(grown), [(v[1:] + v[:-1]) / 2 for v in values], n_trees, int(y.max(initial=0)) + 1)


def forest_votes(model: CellForest, rows: DataFrame) -> DataFrame:
    """``x, p1``: the mean share of class 1 over the trees for every distinct
    feature array of ``rows`` (cells: bounded by the bins). The cells go to the
    trees, not the trees to the cells: a task holds one tree at a time."""
    x = rows.select("x").distinct().toArrow()["x"].combine_chunks()
    sent, read, leaves, cuts, n_trees = rows.sparkSession.sparkContext.broadcast(x), _tree_reader(), _leaf_finder(), model.thresholds, model.getNumTrees

    def walk(batches):
        import pyarrow as pa

        flat, n = sent.value.flatten().to_numpy().astype(float), len(sent.value)
        votes = np.zeros(n, np.int64)
        for b in batches:
            for packed in b.column("nodes") if n else ():
                tree = read(packed.as_py(), cuts)
                votes += np.rint(tree[-1][1] * VOTE_PARTS).astype(np.int64).take(leaves(flat, len(cuts), tree))
        for k in range(0, n, 10_000):
            yield pa.RecordBatch.from_arrays([sent.value[k:k + 10_000], pa.array(votes[k:k + 10_000])], names=["x", "votes"])

    found = model.trees.select("nodes").mapInArrow(walk, "x array<double>, votes bigint").groupBy("x").agg(F.sum("votes").alias("votes"))
    return found.select("x", (F.col("votes") / F.lit(float(n_trees * VOTE_PARTS))).alias("p1"))


def train_gbt(train: DataFrame, max_iter: int = N_ITERATIONS, seed: int = SEED, max_depth: int = 5,
              weight: str | None = None):
    """Boosted trees (log-loss), ``max_iter`` rounds; ``weight``: the
    column that says how many rows a row stands for (see :func:`cells`)."""
    gbt = GBTClassifier(
        maxIter=max_iter, seed=seed, maxDepth=max_depth, featuresCol="features", labelCol="label",
        lossType="logistic", cacheNodeIds=True, checkpointInterval=10,
    )
    return (gbt.setWeightCol(weight) if weight else gbt).fit(materialize(train))


def train_gbt_to_best(train: DataFrame, eval_set: DataFrame, max_iter: int = N_ITERATIONS, patience: int = PATIENCE,
                      seed: int = SEED, max_depth: int = 5, weight: str | None = None):
    """T3 with an eval set (the reference takes its test rows): the model and
    its best round. Up to ``max_iter`` rounds, ended when the eval loss has
    not fallen for ``patience`` rounds. Spark's own stop is at the first
    round that is no better; here rounds are fitted in doubled runs (a longer
    run repeats the rounds of a shorter one), at most twice those needed."""
    train, rounds = materialize(train), min(max_iter, 2 * patience)
    while True:
        model = train_gbt(train, rounds, seed, max_depth, weight)
        losses = model.evaluateEachIteration(eval_set)
        best = min(range(rounds), key=lambda k: (losses[k], k)) + 1
        if rounds - best >= patience or rounds == max_iter:
            return model, best
        rounds = min(max_iter, 2 * rounds)


def predictions_at(model, best: int, test: DataFrame, id_col: str = "id") -> DataFrame:
    """T4 of the model's first ``best`` rounds."""
    m = with_margins(test.select(id_col, "label", vector_to_array("features").alias("_x")), model, best, last=True)
    m = m.withColumn("_p", F.lit(1.0) / (F.lit(1.0) + F.exp(-2.0 * F.get("margins", F.lit(0)))))
    return m.select(
        F.col(id_col).alias("eval_id"), (F.lit(1.0) - F.col("_p")).alias("proba_class_0"), F.col("_p").alias("proba_class_1"),
        F.col("label").cast("int").alias("y_true"),
    )


def predictions(model, test: DataFrame, id_col: str = "id") -> DataFrame:
    """T4 + K6: ``id, proba_class_0, proba_class_1, y_true`` of a model or a
    forest; the trees of Spark's forest go to the tasks as arrays of nodes, not
    as the model object inside a function of the plan."""
    if isinstance(model, CellForest):
        p = test.select(id_col, "label", vector_to_array("features").alias("x"))
        p = p.join(forest_votes(model, p), "x").withColumn("_p", F.array(F.lit(1.0) - F.col("p1"), F.col("p1")))
    elif isinstance(model, RandomForestClassificationModel):
        p = test.select(id_col, "label", vector_to_array("features").alias("x"))
        p = p.mapInPandas(forest_scorer(model), f"{p.schema[id_col].name} {p.schema[id_col].dataType.simpleString()}, label double, p0 double, p1 double")
        p = p.withColumn("_p", F.array("p0", "p1"))
    else:
        p = model.transform(test).withColumn("_p", vector_to_array("probability"))
    return p.select(
        F.col(id_col).alias("eval_id"),
        F.col("_p")[0].alias("proba_class_0"),
        F.col("_p")[1].alias("proba_class_1"),
        F.col("label").cast("int").alias("y_true"),
    )


def _collected_trees(model, rounds: int | None = None) -> list[tuple]:
    """``weight, feature, threshold, children, value, class shares`` of every
    tree, in order. ``children`` holds the right child of node ``n`` at ``2 n``
    and the left one at ``2 n + 1``; a leaf is its own child."""
    weights = list(map(float, model.treeWeights))
    saved = saved_nodes(model).where(F.col("tree") < (rounds or len(weights))).toArrow()
    col = {c: saved[c].to_numpy() for c in ("tree", "id", "feature", "threshold", "left", "right", "value")}
    order = np.lexsort((col["id"], col["tree"]))
    col = {c: v.take(order) for c, v in col.items()}
    stats = saved["stats"].combine_chunks().flatten().to_numpy().reshape(len(order), -1).take(order, axis=0)
    ends = np.searchsorted(col["tree"], np.arange(col["tree"][-1] + 2))
    out = []
    for k, (i, j) in enumerate(zip(ends[:-1], ends[1:])):
        feature, threshold, left, right, value = (col[c][i:j] for c in ("feature", "threshold", "left", "right", "value"))
        own, leaf = np.arange(j - i), left < 0
        children = np.stack([np.where(leaf, own, right), np.where(leaf, own, left)], axis=1).ravel().astype(np.int32)
        share = np.ascontiguousarray((stats[i:j] / stats[i:j].sum(axis=1, keepdims=True)).T)
        out.append((weights[k], np.where(leaf, 0, feature).astype(np.int32), np.where(leaf, 0.0, threshold), children, value, share))
    return out


# Levels that rows go down a tree before those at a leaf are set aside.
LEVELS_AT_ONCE = 4


def _leaf_finder():
    """``leaves(flat, width, tree)``: the leaf of every row in a tree; ``flat``
    holds the rows' features one after the other. All rows walk together, a
    missing value goes right. Tasks get it by value, with the function that uses it."""

    def leaves(flat: np.ndarray, width: int, tree: tuple) -> np.ndarray:
        _, feature, threshold, children, _, _ = tree
        n = len(flat) // width
        out, rows = np.zeros(n, np.int32), None
        base, at = np.arange(0, n * width, width), np.zeros(n, np.int32)
        while len(at):
            for _ in range(LEVELS_AT_ONCE):
                left = flat.take(base + feature.take(at)) <= threshold.take(at)
                at = children.take(2 * at + left)
            going = children.take(2 * at) != at
            if rows is None:
                out[:], rows = at, np.flatnonzero(going)
            else:
                out[rows], rows = at, rows[going]
            at, base = at[going], base[going]
        return out

    return leaves


def forest_scorer(model):
    """A ``mapInPandas`` function: the mean over the trees of the class shares
    in the leaf of every row's ``x``, two classes."""
    from tessera.session import get_spark

    sent, leaves = get_spark().sparkContext.broadcast(_collected_trees(model)), _leaf_finder()

    def score(batches):
        for d in batches:
            x = np.stack(d["x"].to_numpy()).astype(float) if len(d) else np.zeros((0, 1))
            votes = np.zeros((2, len(d)))
            for tree in sent.value:
                leaf = leaves(x.ravel(), x.shape[1], tree)
                votes[0] += tree[-1][0].take(leaf)
                votes[1] += tree[-1][1].take(leaf)
            votes /= votes.sum(axis=0)
            yield d.drop(columns="x").assign(p0=votes[0], p1=votes[1])

    return score


def with_margins(rows: DataFrame, model, rounds: int | None = None, last: bool = False) -> DataFrame:
    """Rows with the feature array ``_x`` get ``margins`` in its place: after
    each of the first ``rounds`` rounds (default: all), or after the ``last`` of
    them only. The trees' nodes are broadcast; rows of a batch walk a tree together."""
    from tessera.session import get_spark

    sent, leaves = get_spark().sparkContext.broadcast(_collected_trees(model, rounds)), _leaf_finder()
    kept = [c for c in rows.columns if c != "_x"]
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("margins", T.ArrayType(T.DoubleType()))])

    def walk(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        for b in batches:
            flat = b.column("_x").flatten().to_numpy(zero_copy_only=False)
            trees, n = sent.value, b.num_rows
            keep = 1 if last else len(trees)
            found, total = np.empty((n, keep)), np.zeros(n)
            for k, tree in enumerate(trees if n else []):
                total = total + tree[0] * tree[4].take(leaves(flat, len(flat) // n, tree))
                found[:, 0 if last else k] = total
            ends = pa.array(np.arange(0, (n + 1) * keep, keep, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in kept), pa.ListArray.from_arrays(ends, pa.array(found.ravel()))], schema=to_arrow_schema(schema)
            )

    return rows.select(*kept, "_x").mapInArrow(walk, schema)


def distinct_cells(counted: DataFrame) -> DataFrame:
    """One row per cell, over a set number of partitions: a model is asked for
    few narrow rows, which would otherwise be left to one task."""
    from tessera.session import spread

    return spread(counted, "bins").dropDuplicates(["bins"])


def score_cells(rows: DataFrame, scored: DataFrame, id_col: str = "id") -> DataFrame:
    """T4 of all rows from the predictions of their cells (``eval_id``: the bins)."""
    p = scored.select(F.col("eval_id").alias("bins"), "proba_class_0", "proba_class_1")
    return rows.select(id_col, "label", "bins").join(p, "bins").select(
        F.col(id_col).alias("eval_id"), "proba_class_0", "proba_class_1", F.col("label").cast("int").alias("y_true")
    )


def saved_nodes(model) -> DataFrame:
    """The nodes of an ensemble's trees, one row a node: ``tree, id, feature,
    threshold, left, right`` (-1 at a leaf), ``value`` and ``stats``. Read from
    the tables that Spark saves a model in; continuous features."""
    from tessera.session import ensure_checkpoint_dir, get_spark

    spark = get_spark()
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/model-{uuid.uuid4().hex}"
    model.write().save(path)
    return spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*").select(
        "tree", "id", F.col("split.featureIndex").alias("feature"), F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), F.col("prediction").alias("value"), F.col("impurityStats").alias("stats"),
    )


def node_arrays(model) -> DataFrame:
    """:func:`saved_nodes`, one row a tree: ``tree, w`` and the other columns
    as arrays in the order of the node ids."""
    nodes = saved_nodes(model)
    node = F.struct(*nodes.columns[1:])
    trees = nodes.groupBy("tree").agg(F.array_sort(F.collect_list(node)).alias("n"))  # the nodes of one tree
    weights = nodes.sparkSession.createDataFrame(list(enumerate(map(float, model.treeWeights))), "tree int, w double")
    return trees.join(weights, "tree").select("tree", "w", "n.feature", "n.threshold", "n.left", "n.right", "n.value", "n.stats")


_TREES = "array<struct<tree:int,w:double,feature:array<int>,threshold:array<double>,left:array<int>,right:array<int>,value:array<double>>>"


def running_margins(model, features: Column, rounds: int | None = None) -> Column:
    """Margins after each round (of the first ``rounds``) as an array: every tree is walked by index
    in the arrays of its nodes. The trees (at most rounds x 2^(depth + 1)
    nodes) are one constant of the plan."""
    trees = node_arrays(model).where(F.col("tree") < (rounds or len(model.trees))).agg(F.to_json(F.array_sort(F.collect_list(F.struct("tree", "w", "feature", "threshold", "left", "right", "value")))))
    trees = F.from_json(F.lit(trees.first()[0]), _TREES)
    depth = max(t.depth for t in model.trees)

    def leaf(t: Column) -> Column:
        def down(n: Column, _level: Column) -> Column:
            goes_left = F.get(features, F.get(t["feature"], n)) <= F.get(t["threshold"], n)
            return F.when(F.get(t["left"], n) < 0, n).when(goes_left, F.get(t["left"], n)).otherwise(F.get(t["right"], n))

        return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, depth))), F.lit(0), down)

    steps = F.transform(trees, lambda t: t["w"] * F.get(t["value"], leaf(t)))
    start = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("m"))
    return F.aggregate(
        steps, start,
        lambda a, c: F.struct((a["s"] + c).alias("s"), F.array_append(a["m"], a["s"] + c).alias("m")),
        lambda a: a["m"],
    )


def iteration_metrics(model, rows: DataFrame, part: str = "part", weight: str | None = None) -> DataFrame:
    """T5: ``part, iteration, logloss, auc, f1`` of every boosting round on
    every part of the rows (learn and test): scores are counted per part,
    round and value, and one pass over their running counts gives all three
    (F1 of class 1 at probability 0.5). ``weight``: the column that says how
    many rows a row stands for."""
    from tessera.operators.ranking import grouped_prefix_table
    from tessera.session import spread

    n = F.col(weight).cast("bigint") if weight else F.lit(1)
    y = F.col("label").cast("int")
    x = rows.select(part, vector_to_array("features").alias("_x"), (n * y).alias("pos"), (n * (F.lit(1) - y)).alias("neg"))
    x = spread(x, part, "_x").groupBy(part, "_x").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))  # these have the same margins
    long = with_margins(x, model).select(part, "pos", "neg", F.posexplode("margins").alias("k", "margin"))
    # Spark's logistic boosting: p = 1 / (1 + exp(-2 margin)).
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-2.0 * F.col("margin")))
    g = long.groupBy(part, (F.col("k") + 1).alias("iteration"), score.alias("score")).agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    place = F.floor(F.col("score") * SCORE_BUCKETS).cast("int")  # scores are probabilities
    pt = grouped_prefix_table(materialize(g), [part, "iteration"], bucket=place)
    p, pos, neg = F.col("score"), F.col("pos"), F.col("neg")
    hit = p >= 0.5
    sums = pt.groupBy(part, "iteration").agg(
        F.sum(-pos * F.ln(F.greatest(p, F.lit(1e-15))) - neg * F.ln(F.greatest(1 - p, F.lit(1e-15)))).alias("loss"),
        F.sum(pos * (F.col("below_neg") + neg / 2.0)).alias("u"),
        F.sum(F.when(hit, pos).otherwise(0)).alias("tp"), F.sum(F.when(hit, neg).otherwise(0)).alias("fp"),
        F.first("P").alias("P"), F.first("N").alias("N"),
    )
    found = F.col("tp") + F.col("fp") + F.col("P")
    return sums.select(
        part, "iteration", (F.col("loss") / (F.col("P") + F.col("N"))).alias("logloss"),
        F.try_divide(F.col("u"), F.col("P").cast("double") * F.col("N")).alias("auc"),
        F.when(found > 0, 2 * F.col("tp") / found).otherwise(0.0).alias("f1"),
    )


def model_facts(model, test: DataFrame, valid: DataFrame | None = None) -> DataFrame:
    """Tree count, feature and class counts, feature importances; for
    boosted trees with an eval set also the best iteration and its loss
    (``evaluateEachIteration`` on the eval rows)."""
    spark = test.sparkSession
    n_trees = model.getNumTrees if hasattr(model, "getNumTrees") else len(model.trees)
    rows = [
        ("trees", float(n_trees)),
        ("features", float(model.numFeatures)),
        ("classes", float(model.numClasses)),
    ]
    if valid is not None and hasattr(model, "evaluateEachIteration"):
        losses = model.evaluateEachIteration(valid)
        best = min(range(len(losses)), key=lambda i: (losses[i], i))
        rows += [("best_iteration", float(best + 1)), ("best_loss", float(losses[best]))]
    for i, v in enumerate(model.featureImportances.toArray()):
        rows.append((f"importance_{i}", float(v)))
    return spark.createDataFrame(rows, "name string, value double")
