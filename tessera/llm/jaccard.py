"""Exact Jaccard join on word shingles by T-occurrence search.

1. Every whole text becomes its set of 64-bit shingle hashes; equal sets are
   one node (64-bit fingerprint), so copies are never expanded.
2. In hash order, two linked sets share k of their first s - T + k members (T
   the least overlap a set of s members can have).  Those prefixes are the
   inverted lists; equal members inside a batch are merged before the shuffle,
   so a very common shingle sends one row a batch.  A set with fewer than k
   shared prefix members has no link and is done.
3. Of each set's prefix only the rarest lists stay, as many as leave k - 1
   out: linked sets still share one.  Inside a list, sets of one size are
   joined, and neighbouring sizes that are compatible; the components of these
   joints are clusters that hold both sides of every link.
4. Each cluster is searched exactly, in blocks of about ``BLOCK`` shingles and,
   for larger clusters, in all pairs of blocks.  A search sets the longest
   lists aside (DivideSkip), counts the members of the short ones in an array
   over the block (no heap merge), and probes the candidates for the long lists
   by binary search.  No list or cluster is capped.
5. Each link is found in exactly one block pair.  A search gives a spanning
   forest of its links and, for each set, the rows of the sets that it links
   with, so links are counted whole while rows stay linear in the sets.

Shingles and nodes are compared by 64-bit hashes.

Defined results: null or wordless texts have an empty set, link with nothing
and are their own component; repeated rows and ids stay rows of their own; a
component's id is its least document id (null only if it has none); an empty
table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.llm.common import Marks, written
from tessera.llm.components import components

SHINGLE = 5
PERCENT = 80
#: Shingles of a block: a work unit, not a limit.
BLOCK = 1_000_000
#: Lists this many times longer than the mean are set aside.
LONG = 4
CACHE_WORDS = 200_000

_ODD = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
     0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        self[word] = h
        return h


_WORDS = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes; bytes.lower and bytes.split are ASCII only, as the contract's words are."""
    words = text.lower().split() if text else []
    if len(_WORDS) > CACHE_WORDS:
        _WORDS.clear()
    n = len(words)
    h = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=n)
    width = min(size, n)
    if not n:
        return h
    total = np.full(n - width + 1, width, dtype=np.uint64)
    for j in range(width):
        factor = _ODD[j % 8] + np.uint64(2 * (j // 8))
        total += _mix(h[j : n - width + 1 + j] * factor)
    return np.unique(_mix(total))


def _node(s: np.ndarray) -> int | None:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64)) if len(s) else None


def least_overlap(n: int, percent: int = PERCENT) -> int:
    """What a set of n members shares at least with any set it links with."""
    return -(-n * percent // 100)


def spare(n: int) -> int:
    """k: prefix members a linked pair must share, by the smaller set's size."""
    return 1 + n // 10


def prefix_length(n: int, percent: int = PERCENT) -> int:
    t = least_overlap(n, percent)
    return n - t + min(spare(n), t)


def needed(n: int, percent: int = PERCENT) -> int:
    """Prefix members shared with the smallest set that a set of n members can link with."""
    t = least_overlap(n, percent)
    return min(spare(t), least_overlap(t, percent)) if n else 0


def _sets(percent: int, size: int):
    kind = pa.list_(pa.int64())

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                nodes, counts, prefixes = [], [], []
                for text in part.column(1).cast(pa.binary()).to_pylist():
                    s = shingle_set(text, size)
                    counts.append(len(s))
                    nodes.append(_node(s))
                    prefixes.append(s[: prefix_length(len(s), percent)].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(nodes, pa.int64()), pa.array(counts, pa.int64()), pa.array(prefixes, kind)],
                    ["doc_id", "node", "n", "prefix"],
                )

    return run


def _postings(batches):
    """(token, node, further nodes or null), one row a token and batch; copies of a node count once."""
    for batch in batches:
        nodes, first = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_index=True)
        lists = batch.column(1).take(pa.array(first))
        tokens = lists.flatten().to_numpy(zero_copy_only=False)
        owner = np.repeat(nodes, lists.value_lengths().to_numpy(zero_copy_only=False).astype(int))
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        new = np.r_[True, tokens[1:] != tokens[:-1]][: len(tokens)]
        starts = np.flatnonzero(new)
        ends = np.r_[starts[1:], len(tokens)].astype(int)[: len(starts)]
        more = np.full(len(starts), None, dtype=object)
        for k in np.flatnonzero(ends - starts > 1):
            more[k] = owner[starts[k] + 1 : ends[k]].astype("<i8").tobytes()
        yield pa.RecordBatch.from_arrays(
            [pa.array(tokens[starts], pa.int64()), pa.array(owner[starts], pa.int64()), pa.array(more, pa.binary())],
            ["token", "node", "more"],
        )


def _spread(batches):
    """(token, df, node) of every node of a posting."""
    for batch in batches:
        out = []
        for token, df, node, more in zip(*(c.to_pylist() for c in batch.columns)):
            out.append((token, df, node))
            if more is not None:
                out += [(token, df, int(x)) for x in np.frombuffer(more, "<i8")]
        cols = list(zip(*out)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["token", "df", "node"])


class Block:
    """Inverted lists over a few whole sets, searched by T-occurrence (DivideSkip)."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.sizes = sets, np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        tokens = np.concatenate(sets)
        order = np.argsort(tokens, kind="stable")  # owners stay in order inside a list
        self.owner, tokens = owner[order], tokens[order]
        self.tokens, first, self.held = np.unique(tokens, return_index=True, return_counts=True)
        self.first = first

    def search(self, query: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Other sets that share at least ``least`` members with ``query`` (a set of the block), and how many."""
        at = np.searchsorted(self.tokens, query)
        held = self.held[at]
        shared = held > 1
        at, held, query = at[shared], held[shared], query[shared]
        if not len(at):
            return np.array([], dtype=int), np.array([], dtype=int)
        # Set the long lists aside: a hit must occur least - aside times in the short ones.
        order = np.argsort(held, kind="stable")
        at, held, query = at[order], held[order], query[order]
        aside = min(least - 1, int((held > LONG * held.mean()).sum()))
        short = len(at) - aside
        begin, length = self.first[at[:short]], held[:short]
        ends = np.cumsum(length)
        # All short lists one after another, then merged by counting.
        spots = np.arange(ends[-1] if short else 0) + np.repeat(begin - (ends - length), length)
        counts = np.bincount(self.owner[spots], minlength=len(self.sets))
        found = np.flatnonzero(counts >= max(1, least - aside))
        counts = counts[found]
        if aside:
            long = np.sort(query[short:])
            for k, j in enumerate(found):
                held_by = self.sets[j]
                pos = np.minimum(np.searchsorted(held_by, long), len(held_by) - 1)
                counts[k] += int((held_by[pos] == long).sum())
        keep = counts >= least
        return found[keep], counts[keep]

    def links(self, percent: int, rows: np.ndarray, block: np.ndarray, inside: set) -> tuple[list[int], np.ndarray]:
        """The least linked index of each set, and the rows of the sets that it links with.

        Links between blocks count here; those inside one only if the block is in ``inside``.
        """
        root = list(range(len(self.sets)))
        linked = np.zeros(len(self.sets), dtype=np.int64)
        own = np.isin(block, list(inside))

        def top(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, s in enumerate(self.sets):
            found, shared = self.search(s, least_overlap(len(s), percent))
            union = len(s) + self.sizes[found] - shared
            hits = found[(100 * shared >= percent * union) & (found != i)]
            linked[i] = rows[hits[(block[hits] != block[i]) | own[i]]].sum()
            for j in hits.tolist():
                a, b = top(i), top(j)
                if a != b:
                    root[max(a, b)] = min(a, b)
        return [top(i) for i in range(len(self.sets))], linked


def _search(percent: int):
    """Rows sorted by (cluster, part): from each set to the first one of its component there, and its linked rows there."""

    def found(key, nodes, sets, rows, blocks):
        if len(sets) < 2:
            return []
        # Links inside block k are counted with the block after it (in a circle), so in one pair only.
        _, part, nb = key
        low, high = divmod(part, nb)
        inside = {k for k, o in ((low, high), (high, low)) if nb == 1 or o == (k + 1) % nb}
        least, linked = Block(sets).links(percent, np.array(rows), np.array(blocks), inside)
        return [(nodes[i], nodes[j], int(n)) for i, (j, n) in enumerate(zip(least, linked)) if i != j or n]

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in (0, 1, 2)], ["a", "b", "linked"])

    def run(batches):
        key, held = None, ([], [], [], [])
        for batch in batches:
            out = []
            arrays = batch.column(6)
            values = arrays.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(arrays.value_lengths().to_numpy(zero_copy_only=False))
            for r, (cluster, part, node, nb, rows, block) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(6)))):
                if (cluster, part, nb) != key:
                    if key:
                        out += found(key, *held)
                    key, held = (cluster, part, nb), ([], [], [], [])
                nodes, sets, copies, blocks = held
                if not nodes or nodes[-1] != node:  # copies of a node stand together
                    nodes.append(node)
                    sets.append(values[ends[r - 1] if r else 0 : ends[r]].copy())
                    copies.append(rows)
                    blocks.append(block)
            if out:
                yield batch_of(out)
        out = found(key, *held) if key else []
        if out:
            yield batch_of(out)

    return run


def _whole(marks: Marks, size: int):
    kind = pa.list_(pa.int64())

    def run(batches):
        for batch in batches:
            rows = batch.filter(pa.array(marks.hit(batch.column(1)))).column(0)
            for at in range(0, len(rows), 1000):
                nodes, sets = [], []
                for text in rows.slice(at, 1000).cast(pa.binary()).to_pylist():
                    s = shingle_set(text, size)
                    nodes.append(_node(s))
                    sets.append(np.sort(s.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, kind)], ["node", "shingles"])

    return run


def shingle_counts(docs: DataFrame, id_col="doc_id", text_col="text", percent=PERCENT, size=SHINGLE) -> DataFrame:
    """doc_id, node (fingerprint of the set; null if empty), n, prefix."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(_sets(percent, size), "doc_id long, node long, n long, prefix array<long>")


def clusters(sets: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Sets that can have a link (node, rep, n, copies), and their clusters (node, component)."""
    posted = sets.filter("n > 0").select("node", "prefix").mapInArrow(_postings, "token long, node long, more binary")
    by_token = Window.partitionBy("token")
    held = F.lit(1) + F.coalesce(F.length("more"), F.lit(0)) / 8
    listed = posted.select(
        "token", F.sum(held.cast("long")).over(by_token).alias("df"), "node", "more",
        ((F.min("node").over(by_token) < F.max("node").over(by_token)) | (F.count("more").over(by_token) > 0)).alias("_two"),
    )
    shared = listed.filter("_two").select("token", "df", "node", "more").mapInArrow(_spread, "token long, df long, node long")
    # Per set: its shared prefix members, at most its prefix length.
    members = shared.groupBy("node").agg(F.collect_set(F.struct("df", "token")).alias("members"))
    sizes = sets.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.count("*").alias("copies"))
    least = lambda n: F.ceil(n * percent / F.lit(100)).cast("long")
    need = F.least(F.floor(least(F.col("n")) / 10) + 1, least(least(F.col("n"))))
    left = written(
        members.join(sizes, "node").withColumn("need", need).filter(F.size("members") >= F.col("need")).select(
            "node", "rep", "n", "copies",
            F.slice(F.array_sort("members"), F.lit(1), (F.size("members") - F.col("need") + 1).cast("int")).alias("rare"),
        )
    )
    lists = left.select("node", "n", F.explode("rare").alias("m")).select("node", "n", F.col("m.token").alias("token"))
    # In a list, sets of one size meet at the least of them, and sizes (few) are chained in order.
    sizes_held = lists.groupBy("token", "n").agg(F.min("node").alias("first"))
    same = lists.join(sizes_held, ["token", "n"]).filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    by_size = Window.partitionBy("token").orderBy("n")
    chained = sizes_held.select("n", "first", F.lag("first").over(by_size).alias("prev"), F.lag("n").over(by_size).alias("pn"))
    near = chained.filter(F.col("pn") * 100 >= F.col("n") * percent).select(F.col("first").alias("a"), F.col("prev").alias("b"))
    joints = same.union(near)
    return left.select("node", "rep", "n", "copies"), components(joints)


def links(docs: DataFrame, sets: DataFrame, id_col="doc_id", text_col="text", percent=PERCENT, size=SHINGLE) -> DataFrame:
    """Edges (a, b) between nodes, whose components are those of all links (a = b: none), and linked rows of a."""
    left, named = clusters(sets, percent)
    named = named.unionByName(named.select(F.col("component").alias("node"), "component").distinct())
    wanted = written(left.join(named, "node"))
    narrow = docs.select(F.col(text_col).cast("string").alias("t"), Marks.spot(F.col(id_col).cast("long")).alias("s"))
    whole = narrow.mapInArrow(_whole(Marks(wanted.select("rep")), size), "node long, shingles array<long>")
    # Blocks of about BLOCK shingles; a cluster of several is searched in all pairs of blocks.
    blocks = wanted.groupBy("component").agg(F.ceil(F.sum("n") / BLOCK).alias("nb"))
    placed = wanted.join(blocks, "component").select("node", "component", "copies", "nb", F.pmod(F.xxhash64("node"), "nb").alias("k"))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("o")
    # The pair (k, k) is part of every pair with k, so it is searched alone only in clusters of one block.
    placed = placed.select("node", "component", "copies", "nb", "k", others).filter("nb = 1 or o <> k")
    part = F.least("k", "o") * F.col("nb") + F.greatest("k", "o")
    placed = placed.select("node", "component", part.alias("part"), "nb", "copies", "k")
    dealt = whole.filter("node is not null").join(placed, "node")
    dealt = dealt.repartition("component", "part").sortWithinPartitions("component", "part", "node")
    dealt = dealt.select("component", "part", "node", "nb", "copies", "k", "shingles")
    return dealt.mapInArrow(_search(percent), "a long, b long, linked long")


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, size: int = SHINGLE
) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (linked rows, copies with them) of every document."""
    return judged(docs, id_col, text_col, percent, size).drop("node", "component")


def judged(docs: DataFrame, id_col: str, text_col: str, percent: int, size: int) -> DataFrame:
    """The columns of ``jaccard_components``, and the set's node and its component's (null if empty)."""
    sets = written(shingle_counts(docs, id_col, text_col, percent, size))
    found = written(links(docs, sets, id_col, text_col, percent, size))
    named = components(found.filter("a <> b").select("a", "b"))
    linked = found.groupBy(F.col("a").alias("node")).agg(F.sum("linked").alias("linked"))
    members = sets.select("doc_id", "n", "node")
    least = members.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    group = least.join(named, "node", "left").join(linked, "node", "left").select(
        "node", "least", F.coalesce("component", "node").alias("component"),
        (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
    )
    ids = group.groupBy("component").agg(F.min("least").alias("component_id"))
    by_node = group.join(ids, "component").select("node", "component", "component_id", "n_links")
    return members.join(by_node, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "node", "component",
    )


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, size: int = SHINGLE
) -> DataFrame:
    """Documents, with all their columns, of which each component keeps its least id once.

    Rows that repeat an id are judged by id and set, so a text in another
    component stays.  Rows without an id cannot be told apart, so all of them
    stay.  Columns may have any names: they go by their place in here.
    """
    names = docs.columns
    docs = docs.toDF(*(f"c{k}" for k in range(len(names))))
    id_col, text_col = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    found = judged(docs, id_col, text_col, percent, size)
    named = written(found.select(F.col("doc_id").alias("_id"), "component_id", F.col("node").alias("_node"), F.col("component").alias("_component")))
    repeated = written(named.filter("_id is not null").groupBy("_id").count().filter("count > 1").select("_id"))
    gone = named.filter("component_id <> _id").select("_id").join(repeated, "_id", "left_anti")
    # Only documents whose mark is set meet the ids in a join; the others pass as they are.
    marked, others = Marks(gone).split(docs, id_col)
    rest = others.unionByName(marked.join(gone, F.col(id_col) == F.col("_id"), "left_anti"))
    if repeated.isEmpty():
        return rest.toDF(*names)
    marked, others = Marks(repeated).split(rest, id_col)
    single = marked.join(repeated, F.col(id_col) == F.col("_id"), "left_anti")
    where = docs.columns.index(text_col)

    def with_node(batches):
        for batch in batches:
            nodes = [_node(shingle_set(t, size)) for t in batch.column(where).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.int64())], [*batch.schema.names, "_set"])

    again = marked.join(repeated, F.col(id_col) == F.col("_id"), "left_semi")
    again = again.mapInArrow(with_node, StructType([*docs.schema.fields, StructField("_set", LongType())]))
    stay = named.join(repeated, "_id", "left_semi").filter("component_id = _id").select("_id", "_node", "_component").distinct()
    once = again.join(stay, (F.col(id_col) == F.col("_id")) & F.col("_set").eqNullSafe(F.col("_node")))
    once = once.dropDuplicates([id_col, "_component"]).select(*docs.columns)
    return others.unionByName(single).unionByName(once).toDF(*names)
