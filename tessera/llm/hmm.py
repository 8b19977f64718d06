"""Word-level hidden Markov language model, trained with Baum-Welch on Spark.

Every word of the training texts has emission probabilities of its own, so the
model grows with the vocabulary; it is a Spark table of expected counts by
word and state:

* counts of all words of all training texts: partial counts per batch, summed
  by a shuffle;
* the head of the vocabulary, at most ``HEAD`` words found by a histogram of
  counts, is broadcast with its emissions; all rarer words stay in Spark;
* each Baum-Welch round is one pass over all training texts, each as one whole
  sequence; expected counts are summed by word in a shuffle, and the driver
  sees the start, the transitions and the head only;
* up to the last round a rarer word emits its corpus count alike in every state,
  a factor that drops out of the state probabilities, so that no join is needed;
  the last round gathers the expected counts of all words, rarer ones too;
* the scaled forward recursion scores every whole text exactly, with the rarer
  words' own emissions, which one join by word brings to the texts.

With E_s(w) the expected count of a word in a state, p_s the share of tokens in
the state, N tokens and V words in training (the end of a text is a word),
P(w | s) = (E_s(w) / p_s + 0.1) / (N + 0.1 (V + 1)): over the states it comes to
the smoothed corpus count, and unseen words have the same mass in every state.

A pass holds about 80 bytes a token, of about ``TRAIN_TOKENS`` tokens or of one
longer text.

Defined results: null text counts as empty (one end token); a null id counts
as the empty string when its remainder is taken; repeated rows are rows of
their own; an empty table gives no rows; with no training text every count is
zero and the model is uniform.  Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

STATES = 6
ROUNDS = 5
HEAD = 300_000
#: Distinct words of a batch that are counted before partial counts go out.
BATCH_WORDS = 300_000
#: Tokens whose state probabilities a worker holds at a time.
TRAIN_TOKENS = 800_000
#: Tokens of a task in a pass, about: each task sends out the head's expected counts once.
TASK_TOKENS = 32_000_000
#: Tokens of the texts that are scored side by side.
SCORE_TOKENS = 2_000_000
FOLDS = 10
SMOOTH = 0.1
#: Ids: 0 is the end of a text, then head words, then the rarer words of each text by their place in its tail.
PACKED = "zstd"


def words_of(text: bytes | None) -> list[bytes]:
    """bytes.lower and bytes.split are ASCII only, as the contract's words are."""
    return text.lower().split() if text else []


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == 0


def _count(batches):
    def rows(counts):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"]
        )

    counts: Counter = Counter()
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            if not held_out(doc_id):
                counts.update(words_of(text))
                if len(counts) > BATCH_WORDS:
                    yield rows(counts)
                    counts = Counter()
    if counts:
        yield rows(counts)


class Vocabulary:
    """The head of the vocabulary: id and count of each frequent word."""

    def __init__(self, words: list[bytes], counts: list[int], ends: int):
        order = sorted(range(len(words)), key=lambda i: (-counts[i], words[i]))
        self.ids = {words[i]: k + 1 for k, i in enumerate(order)}
        self.counts = np.array([ends, *(counts[i] for i in order)], dtype=float)


def _encode(shared):
    kind = pa.list_(pa.struct([("w", pa.binary()), ("n", pa.int64())]))

    def run(batches):
        vocab: Vocabulary = shared.value
        logs = np.log10(vocab.counts + SMOOTH)
        known_end, first = int(vocab.counts[0] > 0), len(vocab.counts)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                out = {k: [] for k in ("held_out", "n_tokens", "n_known", "all_log", "ids", "tail")}
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                    words = words_of(text)
                    ids = np.zeros(len(words) + 1, dtype="<u4")
                    ids[:-1] = np.fromiter(map(vocab.ids.get, words, repeat(0)), dtype="<u4", count=len(words))
                    places, tail = {}, Counter()
                    for t in np.flatnonzero(ids[:-1] == 0).tolist():
                        w = words[t]
                        tail[w] += 1
                        ids[t] = first + places.setdefault(w, len(places))
                    head = ids[ids < first]
                    out["held_out"].append(held_out(doc_id))
                    out["n_tokens"].append(len(ids))
                    out["n_known"].append(len(head) - 1 + known_end)
                    out["all_log"].append(float(logs[head].sum()))
                    out["ids"].append(pa.compress(ids.tobytes(), codec=PACKED, asbytes=True))
                    out["tail"].append([{"w": w, "n": tail[w]} for w in places])
                types = [pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), kind]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(v, t) for v, t in zip(out.values(), types))], ["doc_id", *out]
                )

    return run


_ENCODED = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, all_log double, "
    "ids binary, tail array<struct<w:binary,n:long>>"
)


class Model:
    """Start (K), transitions (K x K) and emissions (words x K)."""

    def __init__(self, start, moves, emits):
        self.start, self.moves, self.emits = start, moves, emits

    def forward(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Natural log likelihood of each sequence, by the scaled recursion over all of them at once."""
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        loglik = np.zeros(len(starts))
        running = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), side="right")
        state = None
        for t, m in enumerate(running):
            seen = self.emits[flat[starts[:m] + t]]
            state = seen * self.start if t == 0 else (state[:m] @ self.moves) * seen
            scale = state.sum(axis=1)
            state /= scale[:, None]
            loglik[:m] += np.log(scale)
        out = np.empty(len(starts))
        out[order] = loglik
        return out

    def expect(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        """Expected start, transition and emission counts, and the log likelihood."""
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        k = len(self.start)
        start, moves, emits = (x.astype(np.float32, copy=False) for x in (self.start, self.moves, self.emits))
        running = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
        # Tokens by their place in the sequence, the longest sequences first: each step is one slice.
        begin = np.cumsum(running) - running
        place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        spot = begin[place]
        spot += np.repeat(np.arange(len(lengths)), lengths)
        place += np.repeat(starts, lengths)
        ids = np.empty(len(spot), dtype=np.int64)
        ids[spot] = flat[place]
        del place, spot
        seen = emits[ids]
        alpha = np.empty((len(ids), k), dtype=np.float32)
        scales = np.empty(len(ids), dtype=np.float32)
        ones, back = np.ones(k, dtype=np.float32), np.ascontiguousarray(moves.T)
        state = None
        for o, m in zip(begin.tolist(), running.tolist()):
            state = np.multiply(seen[o : o + m], start if state is None else state[:m] @ moves, out=alpha[o : o + m])
            scale = np.dot(state, ones, out=scales[o : o + m])
            state /= scale[:, None]
        seen /= scales[:, None]
        beta = np.ones((len(starts), k), dtype=np.float32)
        pair = np.zeros((k, k))
        for t in range(len(running) - 1, 0, -1):
            m, o, before = int(running[t]), int(begin[t]), int(begin[t - 1])
            ahead = seen[o : o + m]
            ahead *= beta[:m]
            pair += alpha[before : before + m].T @ ahead
            alpha[o : o + m] *= beta[:m]
            np.dot(ahead, back, out=beta[:m])
        alpha[: len(starts)] *= beta
        del seen
        sums = np.stack([np.bincount(ids, weights=alpha[:, j], minlength=len(emits)) for j in range(k)], axis=1)
        return alpha[: len(starts)].sum(axis=0, dtype=float), pair * self.moves, sums, float(np.log(scales).sum(dtype=float))


def _cut(arrays: list[np.ndarray], longest: int | None):
    """One flat array with starts and lengths, cut into stretches when asked."""
    flat = np.concatenate(arrays)
    sizes = np.array([len(a) for a in arrays])
    if longest is None:
        return flat, np.cumsum(sizes) - sizes, sizes
    parts = -(-sizes // longest)
    index = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    starts = np.repeat(np.cumsum(sizes) - sizes, parts) + index * longest
    return flat, starts, np.minimum(longest, np.repeat(sizes, parts) - index * longest)


class Weights:
    """What a pass broadcasts: start, transitions, and the head's expected counts by state."""

    def __init__(self, start, moves, head, occupied, n_all, n_words):
        self.start, self.moves, self.head = start, moves, head
        occupied = np.maximum(occupied, 1e-9)
        self.share = occupied / (n_all or occupied.sum())
        self.mass = n_all + SMOOTH * (n_words + 1)

    def emits(self, sums: np.ndarray) -> np.ndarray:
        return (sums / self.share + SMOOTH) / self.mass


def _unpack(n: int, packed: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, decompressed_size=4 * n, codec=PACKED), dtype="<u4")


def _texts(batches, states):
    """Row, ids, and places and expected counts of the rarer words, of every text; the row is all columns but the last two."""
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        ends = np.cumsum([n or 0 for n in lists.value_lengths().to_pylist()])
        flat = lists.flatten()
        places = flat.field(0).to_numpy(zero_copy_only=False)
        sums = np.stack([flat.field(1 + k).to_numpy(zero_copy_only=False) for k in range(states)], axis=1)
        columns = [c.to_pylist() for c in batch.columns[:-2]]
        sizes = batch.column("n_tokens").to_pylist()
        for r, (n, packed) in enumerate(zip(sizes, batch.column("ids").to_pylist())):
            own = slice(int(ends[r - 1]) if r else 0, int(ends[r]))
            yield tuple(c[r] for c in columns), _unpack(n, packed), places[own], sums[own]


def _groups(texts, tokens):
    """Runs of texts of about ``tokens`` tokens."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text[1])
        if size >= tokens:
            yield held
            held, size = [], 0
    if held:
        yield held


def _side_by_side(group, weights: Weights, head: np.ndarray):
    """The model of a group (head, then the tails of its texts) and its ids."""
    first, shift, arrays, spots = len(head), 0, [], []
    for _, ids, places, _ in group:
        arrays.append(np.where(ids >= first, ids + np.uint32(shift), ids))
        spots.append(places.astype(np.int64) + shift)
        shift += max(0, int(ids.max()) + 1 - first)
    sums = np.zeros((shift, head.shape[1]))
    sums[np.concatenate(spots)] = np.concatenate([t[3] for t in group])
    return Model(weights.start, weights.moves, np.concatenate([head, weights.emits(sums).astype(head.dtype)])), arrays


def _expect(shared, rarer: bool = False):
    """Expected counts of a partition by id; below 0: start, log likelihood, occupation, transitions.

    Texts come as row, n_tokens, ids and the rarer words in the order of their ids; with ``rarer`` the expected
    counts of those come out by word.
    """

    def rows(ids, words, sums):  # float is what they were computed in; Spark sums them in double
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), words, *(pa.array(sums[:, j].astype(np.float32)) for j in range(sums.shape[1]))],
            ["id", "word", *(f"s{j}" for j in range(sums.shape[1]))],
        )

    def texts(batches):
        for batch in batches:
            words = batch.column(3).to_pylist() if rarer else [None] * batch.num_rows
            for n, packed, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), words):
                yield own, _unpack(n, packed)

    def run(batches):
        weights: Weights = shared.value
        k, first = len(weights.start), len(weights.head)
        head = weights.emits(weights.head).astype(np.float32)
        alike = weights.emits(np.zeros((1, k))).astype(np.float32)
        total, fixed = np.zeros(head.shape), np.zeros((3 + k, k))
        for group in _groups(texts(batches), TRAIN_TOKENS):
            emits, arrays = np.concatenate([head, alike]), [np.minimum(ids, np.uint32(first)) for _, ids in group]
            if rarer:  # an id for each rarer word of the group
                words = pa.array([w for own, _ in group for w in own or ()], pa.binary()).dictionary_encode()
                codes, at = words.indices.to_numpy(zero_copy_only=False).astype(np.uint32) + np.uint32(first), 0
                emits = np.concatenate([head, np.repeat(alike, len(words.dictionary), axis=0)])
                for i, (own, ids) in enumerate(group):
                    names = codes[at : at + len(own or ())]
                    at += len(names)
                    far = ids >= first
                    arrays[i] = ids.copy()
                    arrays[i][far] = names[ids[far] - first]
            model = Model(weights.start, weights.moves, emits)
            start, pair, seen, loglik = model.expect(*_cut(arrays, None))
            total += seen[:first]
            del group, arrays
            fixed[0] += start
            fixed[1, 0] += loglik
            fixed[2] += seen.sum(axis=0)
            fixed[3:] += pair
            if rarer and len(words.dictionary):
                yield rows(np.full(len(seen) - first, first), words.dictionary, seen[first:])
        hit = np.flatnonzero(total.any(axis=1))
        ids = np.r_[-1 - np.arange(3 + k), hit]
        yield rows(ids, pa.nulls(len(ids), pa.binary()), np.concatenate([fixed, total[hit]]))

    return run


def train(
    texts: DataFrame, head_counts: np.ndarray, n_all: int, n_words: int, states: int = STATES, rounds: int = ROUNDS
) -> tuple[Weights, DataFrame, list[float]]:
    """Baum-Welch over all training texts (_row, n_tokens, ids, tail): weights, expected counts of the rarer words
    by word, and each round's log likelihood before its update (up to a term that no round changes)."""
    spark, names, history = texts.sparkSession, [f"s{j}" for j in range(states)], []
    # Corpus counts, for the head shaken differently (but always alike) for each state.
    shaken = np.exp(np.random.default_rng(20_240_501).normal(0.0, 1.0, (len(head_counts), states)))
    head = head_counts[:, None] * shaken / shaken.sum(axis=1, keepdims=True)
    moves = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 - 0.1 / max(1, states - 1))
    moves /= moves.sum(axis=1, keepdims=True)
    occupied = head.sum(axis=0) + (n_all - head_counts.sum()) / states
    weights = Weights(np.full(states, 1.0 / states), moves, head, occupied, n_all, n_words)
    schema = "id long, word binary, " + ", ".join(f"{n} float" for n in names)
    tail = spark.createDataFrame([], "word binary, " + ", ".join(f"{n} double" for n in names))
    for r in range(rounds if n_all else 0):
        shared = spark.sparkContext.broadcast(weights)
        parts = texts.mapInArrow(_expect(shared, rarer=r == rounds - 1), schema)
        sums = written(parts.groupBy("id", "word").agg(*(F.sum(n).alias(n) for n in names)))
        shared.unpersist()
        fixed = sums.filter(F.col("id") < len(head_counts)).toArrow()  # at most HEAD rows and the parameters
        ids = fixed.column("id").to_numpy()
        values = np.stack([fixed.column(n).to_numpy() for n in names], axis=1)
        small = np.zeros((3 + states, states))
        small[-1 - ids[ids < 0]] = values[ids < 0]
        head = np.zeros((len(head_counts), states))
        head[ids[ids >= 0]] = values[ids >= 0]
        history.append(float(small[1, 0]))
        start, pair = small[0] + 1e-3, small[3:] + 1e-3
        weights = Weights(start / start.sum(), pair / pair.sum(axis=1, keepdims=True), head, small[2], n_all, n_words)
        tail = sums.filter(F.col("id") >= len(head_counts)).select("word", *names)
    return weights, tail, history


def _score(shared):
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64()]
    names = ["doc_id", "held_out", "n_tokens", "n_known", "all_log"]

    def run(batches):
        weights: Weights = shared.value
        head = weights.emits(weights.head)
        for group in _groups(_texts(batches, len(weights.start)), SCORE_TOKENS):  # many texts side by side in one recursion
            model, arrays = _side_by_side(group, weights, head)
            loglik = model.forward(*_cut(arrays, None)) / math.log(10.0)
            columns = [pa.array(c, t) for c, t in zip(zip(*(t[0] for t in group)), kinds)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(loglik)], [*names, "score"])

    return run


def score_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = ROUNDS
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counts = written(narrow.mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")))
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))
    ends = narrow.select("doc_id").filter(fold != 0).count()

    # The head: a threshold on counts, from a histogram by powers of 2 ** (1 / 4).
    level = F.floor(F.log2("c") * 4).cast("int")
    # A row per count level (bounded) and per class: sums for the model.
    by_level = sorted(((r["l"], r["n"]) for r in counts.groupBy(level.alias("l")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, held = None, 0
    for lv, n in by_level:
        held += n
        if held > HEAD:
            break
        least = lv
    head = counts.limit(0) if least is None else counts.filter(level >= least)
    head = head.toArrow()  # at most HEAD rows
    vocab = Vocabulary(head.column("word").to_pylist(), head.column("c").to_pylist(), ends)
    del head
    n_all, n_words = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_all, n_words = n_all + ends, n_words + (ends > 0)

    shared = spark.sparkContext.broadcast(vocab)
    encoded = written(narrow.mapInArrow(_encode(shared), _ENCODED).withColumn("_row", F.monotonically_increasing_id()))
    n_tokens = encoded.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    side = spark.sparkContext.defaultParallelism
    # Each task of a round sends out the head once, so tasks are large; written files are dealt without a shuffle.
    texts = encoded.filter("not held_out").select("_row", "n_tokens", "ids", F.col("tail.w").alias("tail"))
    texts = texts.coalesce(side * max(1, -(-n_tokens // (side * TASK_TOKENS))))
    weights, sums, _ = train(texts, vocab.counts, n_all, n_words, states, rounds)
    scorer = spark.sparkContext.broadcast(weights)

    # Rarer words: one row per text and word, which meets the word's count and expected counts once.
    names = [f"s{j}" for j in range(states)]
    rare = encoded.select("_row", F.posexplode("tail").alias("place", "t")).select(
        "_row", "place", F.col("t.w").alias("word"), F.col("t.n").alias("n")
    )
    rarer = (counts if least is None else counts.filter(level < least)).select("word", "c").join(sums, "word", "left")
    seen = F.when(F.col("c") > 0, F.struct("place", *(F.coalesce(n, F.lit(0.0)).alias(n) for n in names)))
    tails = rare.join(rarer, "word", "left").groupBy("_row").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)).alias("_log"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("_known"),
        F.collect_list(seen).alias("tail"),  # no nulls
    )
    scored = encoded.drop("tail").join(tails, "_row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        (F.col("all_log") + F.coalesce("_log", F.lit(0.0))).alias("all_log"), "ids", "tail",
    ).mapInArrow(_score(scorer), "doc_id long, held_out boolean, n_tokens long, n_known long, all_log double, score double")
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("all_log") - F.col("n_tokens") * math.log10(n_all + SMOOTH * (n_words + 1))).alias("base_score"),
        "score",
    )
