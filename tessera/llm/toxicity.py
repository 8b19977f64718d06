"""Toxicity by classifier chains over character features.

Each category has a linear (logistic) model.  The chain predicts categories in
order; a later model sees the probabilities of the earlier ones, and learns
from out-of-fold probabilities, so it meets them in training as it will in
use.  Features are the presence of character n-grams inside words; which
n-grams count is decided by how unevenly words spread over each category, and
a category's threshold is the one with the best out-of-fold F1.

The models are fitted on a bounded sample of labelled rows (``SAMPLE``
documents, chosen by a hash of the id, with their whole texts); this and the
vocabulary of ``FEATURES`` n-grams have fixed sizes, so they may pass through
the driver.  Every document is scored, over its whole text, in one pass
without a shuffle.

Defined results: null or empty texts have no features and get the
probabilities of the intercepts; labels with a null id or value are not used,
several labels of a document count as their greatest; without labelled rows of
both kinds a category's probability is its share among the labels (0 without
labels); repeated rows are scored one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

SAMPLE = 10_000
FEATURES = 3_000
GRAMS = (4, 5, 6)
#: Documents of a category a gram must occur in, and the least z value it needs.
MIN_ROWS = 5
MIN_Z = 4.0
OUT_OF_FOLD = 3
ROUNDS = 300
RIDGE = 1e-3
CACHE_WORDS = 100_000

_STRIP = b".,;:!?\"'()[]"


def grams_of(word: bytes) -> set[str]:
    w = f" {word.strip(_STRIP).decode('utf-8', 'replace')} "
    return {w[k : k + n] for n in GRAMS for k in range(len(w) - n + 1)}


def words_of(text: bytes | None) -> set[bytes]:
    return set(text.lower().split()) if text else set()


class Features:
    """Feature ids of a text: the n-grams of the vocabulary in any of its words."""

    def __init__(self, vocabulary: list[str]):
        self.ids = {g: i for i, g in enumerate(vocabulary)}
        self._cache: dict[bytes, tuple] = {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        found: set[int] = set()
        cache, ids = self._cache, self.ids
        if len(cache) > CACHE_WORDS:
            cache.clear()
        for w in words_of(text):
            hit = cache.get(w)
            if hit is None:
                hit = cache[w] = tuple(ids[g] for g in grams_of(w) if g in ids)
            if hit:
                found.update(hit)
        return np.array(sorted(found), dtype=np.int32)


class Linear:
    """Logistic regression on sets of feature ids and a few dense columns, classes weighted evenly."""

    def __init__(self, n_features: int, n_dense: int):
        self.w, self.d, self.b = np.zeros(n_features), np.zeros(n_dense), 0.0
        self.constant: float | None = None

    def fit(self, rows: list[np.ndarray], dense: np.ndarray, y: np.ndarray) -> "Linear":
        if len(y) == 0 or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.0
            return self
        cols = np.concatenate(rows)
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
        params = np.zeros(len(self.w) + len(self.d) + 1)
        m, v, nf = np.zeros_like(params), np.zeros_like(params), len(self.w)
        for t in range(1, ROUNDS + 1):  # Adam over the whole sample
            z = np.bincount(owner, weights=params[cols], minlength=len(y)) + dense @ params[nf:-1] + params[-1]
            g = weight * (1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - y)
            grad = np.r_[np.bincount(cols, weights=g[owner], minlength=nf), dense.T @ g, g.sum()] + RIDGE * np.r_[params[:-1], 0.0]
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            params -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        self.w, self.d, self.b = params[:nf], params[nf:-1], float(params[-1])
        return self

    def predict(self, rows: list[np.ndarray], dense: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(rows), self.constant)
        z = np.array([self.w[r].sum() for r in rows]) + dense @ self.d + self.b
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Probability that parts the rows with the best F1, midway between its neighbours (0.5 without both kinds)."""
    if len(y) == 0 or y.min() == y.max():
        return 0.5
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[:-1] == p[1:]] = -1.0  # equal probabilities stay together
    k = int(np.argmax(f1))
    return float((p[k] + (p[k + 1] if k + 1 < len(p) else 0.0)) / 2)


class Chain:
    def __init__(self, categories: list[str], vocabulary: list[str]):
        self.categories, self.features = categories, Features(vocabulary)
        self.models: list[Linear] = []
        self.thresholds: list[float] = []

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, folds: np.ndarray) -> "Chain":
        n = len(self.features.ids)
        earlier = np.zeros((len(rows), 0))
        for k in range(len(self.categories)):
            y = labels[:, k].astype(float)
            self.models.append(Linear(n, k).fit(rows, earlier, y))
            out = np.zeros(len(rows))
            for fold in range(OUT_OF_FOLD):
                own = np.flatnonzero(folds == fold)
                rest = np.flatnonzero(folds != fold)
                model = Linear(n, k).fit([rows[i] for i in rest], earlier[rest], y[rest])
                out[own] = model.predict([rows[i] for i in own], earlier[own])
            self.thresholds.append(best_threshold(out, y))
            earlier = np.c_[earlier, out]
        return self

    def predict(self, rows: list[np.ndarray]) -> np.ndarray:
        earlier = np.zeros((len(rows), 0))
        for model in self.models:
            earlier = np.c_[earlier, model.predict(rows, earlier)]
        return earlier


def _word_grams(n: int):
    """Counts of words by category, turned into counts of their n-grams."""

    def run(batches):
        total: dict[str, np.ndarray] = {}

        def rows():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.string()), *(pa.array([v[k] for v in total.values()], pa.int64()) for k in range(n + 1))],
                ["gram", *(f"n{k}" for k in range(n + 1))],
            )

        for batch in batches:
            counts = np.stack([batch.column(k + 1).to_numpy(zero_copy_only=False) for k in range(n + 1)], axis=1)
            for word, c in zip(batch.column(0).to_pylist(), counts):
                for g in grams_of(word):
                    if g in total:
                        total[g] = total[g] + c
                    else:
                        total[g] = c
            if len(total) > CACHE_WORDS:
                yield rows()
                total = {}
        if total:
            yield rows()

    return run


def _words(batches):
    kind = pa.list_(pa.binary())
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            words = [sorted(words_of(t)) for t in part.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(words, kind), *part.columns[1:]], ["words", *part.schema.names[1:]])


def _featurize(shared, n: int):
    kind = pa.list_(pa.int32())

    def run(batches):
        features = Features(shared.value)
        for batch in batches:
            rows = [features(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, kind), *batch.columns[2 : 2 + n]], ["fold", "features", *(f"y{k}" for k in range(n))]
            )

    return run


def fit(
    docs: DataFrame, labels: DataFrame, categories: dict[str, str], id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE
) -> Chain:
    """Chain over ``categories`` (name: SQL condition on ``labels``, in chain order)."""
    spark, n = docs.sparkSession, len(categories)
    marks = labels.select(F.col("doc_id").cast("long").alias("_id"), *(F.expr(f"int({c})").alias(f"y{k}") for k, c in enumerate(categories.values())))
    marks = marks.dropna().groupBy("_id").agg(*(F.max(f"y{k}").alias(f"y{k}") for k in range(n)))
    size = marks.count()
    spot = F.pmod(F.xxhash64("_id"), F.lit(1 << 30))
    chosen = marks.filter(spot < int(min(1.0, sample / max(1, size)) * (1 << 30)) + 1).limit(2 * sample)
    rows = written(
        docs.select(F.col(id_col).cast("long").alias("_d"), F.col(text_col).cast("string").alias("text"))
        .join(F.broadcast(chosen), F.col("_d") == F.col("_id"))
        .select("_id", "text", *(f"y{k}" for k in range(n)))
    )
    # Uneven words first: counts per word, then sums over the n-grams of each word.
    long = ", ".join(f"y{k} int" for k in range(n))
    words = rows.select("text", *(f"y{k}" for k in range(n))).mapInArrow(_words, f"words array<binary>, {long}")
    by_word = words.select(F.explode("words").alias("word"), *(f"y{k}" for k in range(n))).groupBy("word").agg(
        F.count("*").alias("n0"), *(F.sum(f"y{k}").alias(f"n{k + 1}") for k in range(n))
    )
    schema = "gram string, " + ", ".join(f"n{k} long" for k in range(n + 1))
    grams = by_word.mapInArrow(_word_grams(n), schema).groupBy("gram").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in range(n + 1)))
    totals = words.agg(F.sum(F.size("words")), *(F.sum(F.size("words") * F.col(f"y{k}")) for k in range(n))).first()
    all_words = float(totals[0] or 0)
    grams = written(grams.filter(F.col("n0") >= MIN_ROWS))
    vocabulary: set[str] = set()
    for k in range(n):
        share = (totals[k + 1] or 0) / all_words if all_words else 0.0
        if 0 < share < 1:
            expected = F.col("n0") * share
            z = F.abs(F.col(f"n{k + 1}") - expected) / F.sqrt(expected * (1 - share))
            top = grams.withColumn("z", z).filter(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "gram").limit(FEATURES // n)
            vocabulary |= {r["gram"] for r in top.select("gram").collect()}
    vocabulary = sorted(vocabulary)
    shared = spark.sparkContext.broadcast(vocabulary)
    fold = F.pmod(F.xxhash64("_id", F.lit("fold")), F.lit(OUT_OF_FOLD)).cast("int").alias("fold")
    sets = rows.select(fold, "text", *(f"y{k}" for k in range(n))).mapInArrow(
        _featurize(shared, n), f"fold int, features array<int>, {long}"
    )
    table = sets.toArrow()  # the bounded sample
    features = [np.asarray(r, dtype=np.int32) for r in table.column("features").to_pylist()]
    y = np.stack([table.column(f"y{k}").to_numpy() for k in range(n)], axis=1)
    return Chain(list(categories), vocabulary).fit(features, y, table.column("fold").to_numpy())


def _predict(shared, text_at: int):
    def run(batches):
        chain: Chain = shared.value
        for batch in batches:
            rows = [chain.features(t) for t in batch.column(text_at).cast(pa.binary()).to_pylist()]
            p = chain.predict(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(p[:, k], pa.float64()) for k in range(p.shape[1]))],
                ["doc_id", *(f"p{k}" for k in range(p.shape[1]))],
            )

    return run


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and p_<category> for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = len(chain.categories)
    out = narrow.mapInArrow(_predict(shared, 1), "doc_id long, " + ", ".join(f"p{k} double" for k in range(n)))
    return out.toDF("doc_id", *(f"p_{c}" for c in chain.categories))


def keep_clean(docs: DataFrame, chain: Chain, category: str = "toxic", text_col: str = "text") -> DataFrame:
    """Documents, with all their columns, whose probability is below the category's threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    at = chain.categories.index(category)
    threshold = chain.thresholds[at]
    names = docs.columns

    def run(batches):
        chain: Chain = shared.value
        where = names.index(text_col)
        for batch in batches:
            rows = [chain.features(t) for t in batch.column(where).cast(pa.binary()).to_pylist()]
            yield batch.filter(pa.array(chain.predict(rows)[:, at] < threshold))

    return docs.mapInArrow(run, docs.schema)
