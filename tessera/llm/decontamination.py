"""Benchmark decontamination by Wu-Manber search over words.

Test items become windows of ``window`` consecutive words (a shorter item is
one window).  For each window length a shift table over blocks of two words
says how far the search may jump; a zero shift selects the bucket of windows
ending in that block, and each is compared word by word.

The benchmark is taken in blocks of about ``BLOCK_WORDS`` words: each block's
tables have a fixed size bound and are broadcast, and all documents are
scanned against every block.  One block needs no shuffle.

Words: A-Z are lower-cased; characters outside ASCII letters and digits end a
word, all others belong to words.  In UTF-8 this is a table over bytes.

Defined results: null or wordless texts have no words and no hits; null or
wordless items give no window; items without an id hit, but have no name in
``items``; repeated documents are judged row by row, and
items of equal text each count.  Other columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

WINDOW = 10
BLOCK_WORDS = 2_000_000

_TABLE = bytes(
    c if c >= 128 or chr(c).isalnum() and c < 128 and not 65 <= c <= 90 else c + 32 if 65 <= c <= 90 else 32
    for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


class Matcher:
    """Tables of one pattern length: shifts by block, windows by their last block."""

    def __init__(self, length: int, windows: dict[tuple, frozenset]):
        self.m, self.b = length, min(2, length)
        self.default = length - self.b + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, list[tuple[list, frozenset]]] = {}
        for win, items in windows.items():
            for end in range(self.b, length + 1):
                block = b" ".join(win[end - self.b : end])
                jump = length - end
                if jump < self.shift.get(block, self.default):
                    self.shift[block] = jump
                if not jump:
                    self.bucket.setdefault(block, []).append((list(win), items))

    def scan(self, words: list[bytes]):
        """(first word, items) of each occurrence."""
        m, shift, default, n = self.m, self.shift, self.default, len(words)
        i = m - 1
        while i < n:
            block = words[i - 1] + b" " + words[i] if m > 1 else words[i]
            jump = shift.get(block, default)
            if jump:
                i += jump
                continue
            here = words[i - m + 1 : i + 1]
            for win, items in self.bucket[block]:
                if win == here:
                    yield i - m + 1, items
                    break  # windows of one length are distinct
            i += 1


def matchers(items: list[tuple[str, bytes]], window: int = WINDOW) -> list[Matcher]:
    by_length: dict[int, dict[tuple, set]] = {}
    for item, text in items:
        words = words_of(text)
        size = min(window, len(words))
        for k in range(len(words) - size + 1 if size else 0):
            by_length.setdefault(size, {}).setdefault(tuple(words[k : k + size]), set()).add(item)
    return [Matcher(n, {w: frozenset(s) for w, s in wins.items()}) for n, wins in sorted(by_length.items())]


def search(words: list[bytes], tables: list[Matcher]) -> tuple[list[tuple[int, int]], set]:
    """Hit word ranges (merged, in order) and the items that occur."""
    found, items = [], set()
    for t in tables:
        for at, names in t.scan(words):
            found.append((at, at + t.m))
            items |= names
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged, items


_OUT = "doc_id long, _h long, n_words long, hits array<struct<a:long,b:long>>, items array<string>"


def _scanner(shared):
    def run(batches):
        tables = shared.value
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        for batch in batches:
            counts, hits, items = [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                words = words_of(text)
                ranges, names = search(words, tables)
                counts.append(len(words))
                hits.append([{"a": a, "b": b} for a, b in ranges])
                items.append(sorted(names - {None}))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()),
                 pa.array(hits, kind), pa.array(items, pa.list_(pa.string()))],
                ["doc_id", "_h", "n_words", "hits", "items"],
            )

    return run


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_words: int):
    """Number of blocks, and a function that broadcasts the tables of one."""
    tests = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("t"))
    tests = tests.filter("t is not null")
    size = tests.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-int(size) // (6 * block_words)))  # about six characters a word

    def tables(k: int):
        block = tests.filter(F.pmod(F.xxhash64(F.coalesce("item", "t")), F.lit(blocks)) == k)
        rows = [(r["item"], r["t"].encode()) for r in block.toLocalIterator()]
        return benchmark.sparkSession.sparkContext.broadcast(matchers(rows, window))

    return blocks, tables


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Per document: doc_id, n_words, hits (word ranges), items (sorted ids), n_hit, contaminated."""
    blocks, tables = _blocks(benchmark, item_col, item_text_col, window, block_words)
    narrow = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.xxhash64(text_col) if blocks > 1 else F.lit(0).cast("long")).alias("_h"),
        F.col(text_col).cast("string").alias("_t"),
    )
    scans = []
    for k in range(blocks):
        # The first scan keeps every row; the others only rows with hits, once each.
        source = narrow if not k else narrow.dropDuplicates(["doc_id", "_h"])
        scan = source.mapInArrow(_scanner(tables(k)), _OUT)
        scans.append(scan if not k else scan.filter("size(hits) > 0"))
    found = scans[0]
    if blocks > 1:
        more = scans[1]
        for s in scans[2:]:
            more = more.unionByName(s)
        more = more.groupBy(F.col("doc_id").alias("_d"), F.col("_h").alias("_g")).agg(
            F.flatten(F.collect_list("hits")).alias("_hits"), F.flatten(F.collect_list("items")).alias("_items")
        )
        found = found.join(more, found["doc_id"].eqNullSafe(more["_d"]) & (found["_h"] == more["_g"]), "left")
        found = found.withColumn("items", F.array_sort(F.concat("items", F.coalesce("_items", F.array().cast("array<string>")))))
        ranges = F.array_sort(F.concat("hits", F.coalesce("_hits", F.array().cast("array<struct<a:long,b:long>>"))))
        found = found.withColumn("hits", ranges)
    # Words under sorted, possibly overlapping ranges.
    covered = F.aggregate(
        "hits",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda s, r: F.struct(
            (s["n"] + F.greatest(F.lit(0).cast("long"), r["b"] - F.greatest(r["a"], s["to"]))).alias("n"),
            F.greatest(s["to"], r["b"]).alias("to"),
        ),
        lambda s: s["n"],
    )
    return found.select("doc_id", "n_words", "hits", "items", covered.alias("n_hit")).withColumn(
        "contaminated", F.col("n_hit") > 0
    )


#: Blocks searched in one task, one after the other; then the rows left are written.
CHAINED = 4


def remove_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Documents, with all their columns, that no benchmark window occurs in; no shuffle."""
    blocks, tables = _blocks(benchmark, item_col, item_text_col, window, block_words)
    where = docs.columns.index(text_col)

    def clean(shared):
        def run(batches):
            for batch in batches:
                texts = batch.column(where).cast(pa.binary()).to_pylist()
                free = [not any(True for t in shared.value for _ in t.scan(w)) for w in map(words_of, texts)]
                yield batch.filter(pa.array(free, pa.bool_()))

        return run

    for k in range(blocks):
        docs = docs.mapInArrow(clean(tables(k)), docs.schema)
        if k % CHAINED == CHAINED - 1 and k < blocks - 1:
            docs = written(docs)
    return docs
