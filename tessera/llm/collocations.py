"""Phrase collocations: phrases that occur more often than their parts would suggest, per language.

HAT-trie counting. Words have ids; a task counts phrases of one length in a shallow trie over word ids whose leaves
are hash containers, and a container that grows too large bursts into a node of containers. A trie over its bound
spills whole subtrees, the largest first, as sorted runs. A run goes to the partition of its prefix, where runs are
merged. Subtrees of very common first words are dealt by the whole phrase, so that no word fills a partition.

Phrases are counted by length, and a phrase only if both its shorter parts are frequent (no phrase is more frequent
than its parts), which a bitmap of a size fit to their number tells; a wrong bit there costs counting, never a
count. All counts are exact and over whole texts.

Defined results: a null text is empty, a null language ``und``. An empty table, or one without frequent phrases,
gives no rows. Repeated rows count as often as they occur. Ties in the ranking are broken by the phrase itself. A
text of any length is one unit of one task's work, cut into blocks whose phrases reach over the cuts. Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cores, numbered, ship, written

MAX_WORDS = 5
MIN_COUNT = 100
#: A candidate goes if a longer one that contains it has at least this share of its count, in percent.
COVER_PERCENT = 100
TOP = 2_000
#: Up to so many frequent words the dictionary is broadcast; beyond, words get their ids by a join.
DICTIONARY_WORDS = 1_000_000

BLOCK_IDS = 16_384  # ids of a stored row
COUNT_IDS = 1_000_000  # ids counted at once
CHUNK_BYTES = 8_000_000  # text cut into words at once
BURST = 16_384  # entries of a container
TRIE_ENTRIES = 1_000_000  # entries of a task's trie before it spills
MAX_BITS = 1 << 27

#: Piece ends become full stops, tabs blanks, A-Z lower case; no word holds any of them.
_FOLD = bytes(
    ord(".") if chr(b) in ".,;:!?\n\x0b\x0c\r" else ord(" ") if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256)
)


def _tokens(texts: list[bytes | None]) -> list[bytes]:
    """Words of all texts, with a full stop wherever a phrase cannot go on."""
    return b".".join(t or b"" for t in texts).translate(_FOLD).replace(b".", b" . ").split()


def _chunks(batch: pa.RecordBatch):
    """(language, some whole texts) of a batch of columns lang, text."""
    by: dict[str, list] = {}
    size: dict[str, int] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
        by.setdefault(lang, []).append(text)
        size[lang] = size.get(lang, 0) + len(text or b"")
        if size[lang] > CHUNK_BYTES:
            yield lang, by.pop(lang)
            size[lang] = 0
    yield from by.items()


def _word_counts(batches):
    def rows(counts: dict[str, dict[bytes, int]]):
        for lang, words in counts.items():
            # A row without a word: how many words there are.
            keys, n = [None, *words], [sum(words.values()), *words.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(n)), pa.array(keys, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())],
                ["lang", "word", "n"],
            )

    counts: dict[str, dict[bytes, int]] = {}
    for batch in batches:
        for lang, texts in _chunks(batch):
            mine = counts.setdefault(lang, {})
            get = mine.get
            for word in _tokens(texts):
                mine[word] = get(word, 0) + 1
            mine.pop(b".", None)
            if sum(map(len, counts.values())) > TRIE_ENTRIES:
                yield from rows(counts)
                counts = {}
    yield from rows(counts)


def _blocks(ids: np.ndarray):
    """Ids cut into rows: (bytes, how many of them may start a phrase); what follows those is there to end phrases."""
    same = np.zeros(len(ids), dtype=bool)
    same[1:] = (ids[1:] == 0) & (ids[:-1] == 0)
    ids = ids[~same]
    for at in range(0, len(ids), BLOCK_IDS):
        yield ids[at : at + BLOCK_IDS + MAX_WORDS - 1].tobytes(), min(BLOCK_IDS, len(ids) - at)


_BLOCK = pa.schema([("ids", pa.binary()), ("starts", pa.int32())])


def _encoder(shared):
    def run(batches):
        maps: dict[str, dict[bytes, int]] = {}
        for lang, words, ids in shared.value:
            maps[lang] = dict(zip(words.to_pylist(), ids.tolist()))
        for batch in batches:
            for lang, texts in _chunks(batch):
                get = maps.get(lang, {}).get
                tokens = _tokens(texts)
                ids = np.fromiter((get(w, 0) for w in tokens), dtype="<i4", count=len(tokens))
                got = list(_blocks(ids))
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.int32())], schema=_BLOCK)

    return run


def _regrouped(batches):
    """Ids of one text by place -> blocks."""
    for batch in batches:
        got = [b for ids in batch.column(0) for b in _blocks(np.asarray(ids.values, dtype="<i4"))]
        if got:
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.int32())], schema=_BLOCK)


def _words_of(batches):
    """Words of each text by place; 0 length: a cut."""
    for batch in batches:
        for row, (lang, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist())):
            words = _tokens([text])
            for at in range(0, len(words), BLOCK_IDS):
                part = words[at : at + BLOCK_IDS]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, 1).take(pa.array([0] * len(part))), pa.array(range(at, at + len(part)), pa.int32()),
                     pa.array([lang] * len(part)), pa.array(part, pa.binary()).cast(pa.string())],
                    ["row", "at", "lang", "word"],
                )


def encoded(texts: DataFrame, words: DataFrame, limit: int = DICTIONARY_WORDS) -> DataFrame:
    """Texts as blocks of word ids (0: a cut, or a word that no frequent phrase holds). ``words``: lang, word, id."""
    spark = texts.sparkSession
    if words.count() <= limit:
        got = words.select("lang", F.col("word").cast("binary").alias("word"), "id").toArrow()  # at most ``limit`` rows
        parts = []
        for lang in got.column("lang").unique().to_pylist():
            mine = got.filter(pc.equal(got.column("lang"), lang))
            parts.append((lang, mine.column("word").combine_chunks(), mine.column("id").to_numpy().astype(np.int32)))
        return texts.mapInArrow(_encoder(spark.sparkContext.broadcast(parts)), "ids binary, starts int")
    placed = texts.withColumn("row", F.monotonically_increasing_id()).select("row", "lang", "text")
    placed = written(placed.mapInArrow(_words_of, "row long, at int, lang string, word string"))
    whole = placed.join(words, ["lang", "word"], "left").groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("at", F.coalesce("id", F.lit(0)).cast("int").alias("id")))).alias("ids")
    )
    return whole.select("ids.id").mapInArrow(_regrouped, "ids binary, starts int")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def _hashes(columns: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of phrases given by word."""
    h = np.zeros(len(columns[0]), dtype=np.uint64)
    for c in columns:
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64))
    return h


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of ``keys`` (n x words), sorted, and the sums of their counts."""
    if not len(keys):
        return keys, np.zeros(0, dtype=np.int64)
    wide = keys.astype(np.uint64)
    packs = [(wide[:, j] << np.uint64(32)) | (wide[:, j + 1] if j + 1 < keys.shape[1] else np.uint64(0)) for j in range(0, keys.shape[1], 2)]
    order = np.lexsort(packs[::-1]) if len(packs) > 1 else np.argsort(packs[0], kind="stable")
    new = np.ones(len(keys), dtype=bool)
    new[1:] = False
    for p in packs:
        p = p[order]
        new[1:] |= p[1:] != p[:-1]
    at = np.flatnonzero(new)
    if counts is None:
        return keys[order[at]], np.diff(np.append(at, len(keys)))
    return keys[order[at]], np.add.reduceat(counts[order], at)


class HatTrie:
    """Counts of phrases of ``words`` ids: nodes by word id, under them hash containers of the other ids' bytes."""

    class Node(dict):
        """Child by word id: a Node or a container (a plain dict of bytes -> count)."""

    def __init__(self, words: int, burst: int = BURST):
        self.words, self.burst = words, burst
        self.root = HatTrie.Node()
        self.entries: dict[int, int] = {}  # by first word

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Distinct sorted phrases (n x words) with their counts."""
        keys = np.ascontiguousarray(keys, dtype=">u4")
        for word, lo, hi in self._runs(keys, 0, 0, len(keys)):
            self.entries[word] = self.entries.get(word, 0) + self._add(self.root, word, keys, counts, 0, lo, hi)

    @staticmethod
    def _runs(keys: np.ndarray, depth: int, lo: int, hi: int):
        column = keys[lo:hi, depth]
        at = np.flatnonzero(np.append(True, column[1:] != column[:-1])) if hi > lo else np.zeros(0, dtype=int)
        ends = np.append(at[1:], hi - lo)
        return zip(column[at].tolist(), (at + lo).tolist(), (ends + lo).tolist())

    def _add(self, node: Node, word: int, keys: np.ndarray, counts: np.ndarray, depth: int, lo: int, hi: int) -> int:
        """Number of entries that were new."""
        child = node.get(word)
        if isinstance(child, HatTrie.Node):
            return sum(self._add(child, w, keys, counts, depth + 1, a, b) for w, a, b in self._runs(keys, depth + 1, lo, hi))
        if child is None:
            child = node[word] = {}
        before, width = len(child), 4 * (self.words - depth - 1)
        rest = keys[lo:hi, depth + 1 :].tobytes()
        get = child.get
        for k, n in enumerate(counts[lo:hi].tolist()):
            key = rest[k * width : (k + 1) * width]
            child[key] = get(key, 0) + n
        added = len(child) - before
        if len(child) > self.burst and width > 4:
            node[word] = self._burst(child)
        return added

    @staticmethod
    def _burst(container: dict) -> Node:
        node = HatTrie.Node()
        for key, n in container.items():
            node.setdefault(int.from_bytes(key[:4], "big"), {})[key[4:]] = n
        return node

    def _walk(self, child, prefix: list[int]):
        if isinstance(child, HatTrie.Node):
            for word, below in child.items():
                yield from self._walk(below, [*prefix, word])
        else:
            keys = np.empty((len(child), self.words), dtype=np.uint32)
            keys[:, : len(prefix)] = prefix
            keys[:, len(prefix) :] = np.frombuffer(b"".join(child), dtype=">u4").reshape(len(child), -1)
            yield keys, np.fromiter(child.values(), dtype=np.int64, count=len(child))

    def size(self) -> int:
        return sum(self.entries.values())

    def spill(self, keep: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Takes whole subtrees out, the largest first, until at most ``keep`` entries remain."""
        out, left = [], self.size()
        for word in sorted(self.entries, key=self.entries.get, reverse=True):
            if left <= keep:
                break
            left -= self.entries.pop(word)
            out.extend(self._walk(self.root.pop(word), [word]))
        if not out:
            return np.empty((0, self.words), dtype=np.uint32), np.empty(0, dtype=np.int64)
        return np.concatenate([k for k, _ in out]), np.concatenate([n for _, n in out])


_RUN = pa.schema([("part", pa.int32()), ("phrases", pa.binary()), ("counts", pa.binary())])
RUN_ENTRIES = 65_536  # of a row


def _counter(words: int, parts: int, hot: np.ndarray, shared):
    """Blocks -> sorted runs of phrases of ``words`` words by prefix partition."""

    def runs(keys: np.ndarray, counts: np.ndarray):
        # A subtree goes to the partition of its first word; a hot word's entries are dealt one by one.
        first = [keys[:, 0]]
        part = (_hashes(first) % np.uint64(parts)).astype(np.int32)
        for_all = np.isin(keys[:, 0], hot)
        if for_all.any():
            part[for_all] = (_hashes(list(keys[for_all].T)) % np.uint64(parts)).astype(np.int32)
        wide = keys.astype(np.uint64)
        packs = [(wide[:, j] << np.uint64(32)) | (wide[:, j + 1] if j + 1 < words else np.uint64(0)) for j in range(0, words, 2)]
        order = np.lexsort([*packs[::-1], part])
        keys, counts, part = keys[order].astype(">u4"), counts[order].astype("<i8"), part[order]
        cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist() + [len(part)]
        rows = [(int(part[a]), i, min(i + RUN_ENTRIES, b)) for a, b in zip(cuts, cuts[1:]) for i in range(a, b, RUN_ENTRIES)]
        for at in range(0, len(rows), 256):
            some = rows[at : at + 256]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _, _ in some], pa.int32()), pa.array([keys[i:j].tobytes() for _, i, j in some], pa.binary()),
                 pa.array([counts[i:j].tobytes() for _, i, j in some], pa.binary())], schema=_RUN)

    def count(trie: HatTrie, blocks: list[tuple[bytes, int]]) -> None:
        size = sum(len(b) // 4 + MAX_WORDS for b, _ in blocks)
        ids, start, at = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=bool), 0
        for block, starts in blocks:
            ids[at : at + len(block) // 4] = np.frombuffer(block, dtype="<i4")
            start[at : at + starts] = True
            at += len(block) // 4 + MAX_WORDS
        known = ids > 0
        n = size - words + 1
        here = known[: size - words + 2].copy()  # a part of words - 1 words begins here
        for j in range(1, words - 1):
            here &= known[j : j + len(here)]
        if shared is not None:
            at = np.flatnonzero(here)
            spot = _hashes([ids[at + j] for j in range(words - 1)]) % np.uint64(len(shared.value) * 64)
            here[at] = (shared.value[spot >> np.uint64(6)] >> (spot & np.uint64(63))) & np.uint64(1) == 1
        at = np.flatnonzero(here[:n] & here[1 : n + 1] & start[:n])
        if len(at):
            trie.add(*_summed(np.stack([ids[at + j] for j in range(words)], axis=1).astype(np.uint32)))

    def run(batches):
        trie, blocks, size = HatTrie(words), [], 0
        for batch in batches:
            for block, starts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                blocks.append((block, starts))
                size += len(block) // 4
                if size >= COUNT_IDS:
                    count(trie, blocks)
                    blocks, size = [], 0
                    if trie.size() > TRIE_ENTRIES:
                        yield from runs(*trie.spill(TRIE_ENTRIES // 2))
        if blocks:
            count(trie, blocks)
        if trie.size():
            yield from runs(*trie.spill())

    return run


def _merger(words: int, least: int):
    """Runs in order of their partition -> phrases that occur often enough."""

    def merged(keys: list[bytes], counts: list[bytes]):
        phrases, n = _summed(
            np.frombuffer(b"".join(keys), dtype=">u4").reshape(-1, words).astype(np.uint32), np.frombuffer(b"".join(counts), dtype="<i8")
        )
        often = n >= least
        raw, width = phrases[often].astype(">u4").tobytes(), 4 * words
        return pa.RecordBatch.from_arrays(
            [pa.array([raw[i : i + width] for i in range(0, len(raw), width)], pa.binary()), pa.array(n[often], pa.int64())], ["phrase", "f"]
        )

    def run(batches):
        now, keys, counts = None, [], []
        for batch in batches:
            for part, k, c in zip(*(col.to_pylist() for col in batch.columns)):
                if part != now and keys:
                    yield merged(keys, counts)
                    keys, counts = [], []
                now = part
                keys.append(k)
                counts.append(c)
        if keys:
            yield merged(keys, counts)

    return run


def _bitmap(phrases: DataFrame, words: int, n: int):
    """Bits at the hashes of the phrases, of a size fit to their number: at most 16 MB."""
    bits = min(MAX_BITS, max(1 << 16, 1 << (32 * n - 1).bit_length()))

    def spots(batches):
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=">u4").reshape(-1, words)
            spot = _hashes(list(ids.T)) % np.uint64(bits)
            one = np.uint64(1) << (spot & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array((spot >> np.uint64(6)).astype(np.int64)), pa.array(one.view(np.int64))], ["w", "v"])

    got = phrases.select("phrase").mapInArrow(spots, "w long, v long").groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[got.column("w").to_numpy()] = got.column("v").to_numpy().view(np.uint64)
    return phrases.sparkSession.sparkContext.broadcast(out)


def count_phrases(blocks: DataFrame, hot: np.ndarray, most: int = MAX_WORDS, least: int = MIN_COUNT) -> list[DataFrame]:
    """By length from 2: ``phrase`` (four bytes a word id), ``f``, of all phrases with ``f >= least``."""
    parts = 4 * cores(blocks.sparkSession)
    out, shared = [], None
    for words in range(2, most + 1):
        runs = blocks.mapInArrow(_counter(words, parts, hot, shared), "part int, phrases binary, counts binary")
        runs = runs.repartition(cores(blocks.sparkSession), "part").sortWithinPartitions("part")
        found = written(runs.mapInArrow(_merger(words, least), "phrase binary, f long"))
        n = found.count()
        if not n:
            break
        out.append(found)
        shared = _bitmap(found, words, n) if words < most else None
    return out


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = MAX_WORDS, least: int = MIN_COUNT,
    top: int = TOP, dictionary: int = DICTIONARY_WORDS,
) -> DataFrame:
    """The first ``top`` phrases of every language: ``lang, rank, phrase, a, l, r, n, score``."""
    ship(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    counts = texts.mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("f"))
    counts = written(counts.filter((F.col("f") >= least) | F.col("word").isNull()))
    totals = counts.filter("word is null").select("lang", F.col("f").alias("n"))
    words = numbered(counts.filter("word is not null").withColumn("g", F.lit(0)), "g", ["lang", "word"])
    words = written(words.select("lang", "word", "f", (F.col("idx") + 1).cast("int").alias("id")))
    blocks = written(encoded(texts, words.select("lang", "word", "id"), dictionary))
    parts, all_words = 4 * cores(docs.sparkSession), totals.agg(F.sum("n")).first()[0] or 0
    often = words.filter(F.col("f") * parts > all_words).select("id").toArrow()  # fewer than ``parts`` words
    by_length = count_phrases(blocks, often.column("id").to_numpy(), most, least)
    one = words.select(F.unhex(F.lpad(F.hex("id"), 8, "0")).alias("phrase"), "f", "lang")
    found = one.select("phrase", "f", F.lit(None).cast("string").alias("lang")).limit(0)
    for phrases in by_length:
        found = found.unionByName(phrases.withColumn("lang", F.lit(None).cast("string")))
    return _ranked(found, one, words, totals, top)


def _ranked(found: DataFrame, one: DataFrame, words: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """Candidates scored at their weakest cut, without those that a longer one covers, in order."""
    parts = one.unionByName(found).withColumnRenamed("phrase", "part")
    size = F.expr("length(phrase) div 4")
    cuts = found.select("phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), (size - 1).cast("int"))).alias("k"))
    left = cuts.withColumn("part", F.expr("substring(phrase, 1, 4 * k)")).join(parts, "part").select(
        "phrase", "a", "k", F.col("f").alias("l"), "lang"
    )
    right = left.withColumn("part", F.expr("substring(phrase, 4 * k + 1)")).join(parts.drop("lang"), "part")
    whole = right.groupBy("phrase", "a").agg(
        F.max("lang").alias("lang"),  # known where the left part is one word
        F.collect_list(F.struct("k", "l", F.col("f").alias("r"))).alias("cuts"),  # fewer than the phrase has words
    )
    longer = found.filter(size > 2).select(
        F.explode(F.array(F.expr("substring(phrase, 5)"), F.expr("substring(phrase, 1, length(phrase) - 4)"))).alias("phrase"),
        F.col("f").alias("c"),
    ).groupBy("phrase").agg(F.max("c").alias("c"))  # a longer phrase is no more frequent than those between
    whole = whole.join(longer, "phrase", "left").filter(F.expr(f"c is null or 100 * c < {COVER_PERCENT} * a")).join(totals, "lang")
    # 37 digits hold any count times any count; the quotient is at most 1000 n.
    cut = F.array_min(F.expr(
        "transform(cuts, x -> named_struct('score', (cast(1000 * a as decimal(18,0)) * cast(n as decimal(18,0)))"
        " div (cast(x.l as decimal(18,0)) * cast(x.r as decimal(18,0))), 'k', x.k, 'l', x.l, 'r', x.r))"
    ))
    scored = whole.select("lang", "phrase", "a", "n", cut.alias("cut")).select("lang", F.col("phrase").alias("key"), "a", "n", "cut.score", "cut.l", "cut.r")
    ids = scored.select("key", F.posexplode(F.expr("transform(sequence(1, length(key) div 4), i -> substring(key, 4 * i - 3, 4))")).alias("at", "phrase"))
    named = words.select(F.unhex(F.lpad(F.hex("id"), 8, "0")).alias("phrase"), "word")
    texts = ids.join(named, "phrase").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
    rows = scored.join(texts.select("key", F.array_join("w.word", " ").alias("phrase")), "key")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The best of a language are among the best of its parts.
    part = F.pmod(F.xxhash64("key"), F.lit(cores(words.sparkSession)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).filter(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
