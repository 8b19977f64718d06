"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily.

NN-descent: rows that share a neighbour are likely neighbours. A round joins every node with a sample of its
neighbours and of the nodes it is a neighbour of, measures the pairs that involve a new link, and keeps the best
links of each node; rounds end when few links change. The first links come from blocks of rows that are close in
the order of their nearest pivots. A search keeps the best nodes found and opens their neighbours, all queries at a
time, until every kept node is opened.

Equal vectors are one node, so a vector held by very many rows costs no more than another: its least ids are
enough, for a result holds no more than ``top`` rows. No node gathers more than a bounded sample of links, however
many nodes point to it, and the sample is drawn before it is gathered.

Defined results: rows without id, and vectors that are null, empty, zero, of another length than most, or hold a
null or a number that is not finite, take no part, neither as query nor as candidate. Of rows of one id the one of
the least vector counts. A query with fewer candidates than ``top`` gets all of them; a table of one row gives none.
Ties go to the smaller id. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cores, ship, written

LINKS = 40  # neighbours of a node
SAMPLE = 12  # new links, and old ones, that a node joins in a round, in either direction
PIVOTS = 256
BLOCK = 512  # rows measured against each other at the start
ORDERS = 4  # times, each in another order
SETTLED = 0.12  # new links by node and place: fewer end the rounds
ROUNDS = 30
KEPT = 192  # best nodes of a query
OPENED = 32  # of which are opened at a time
WHOLE = 2_048  # up to so many rows are put in order by one task


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v`` of the rows that take part."""
    v = F.col("v")
    sound = F.col("id").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    some = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter(F.coalesce(sound, F.lit(False)))
    length = some.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return some.filter(F.size("v") == (length[0][0] if length else 0)).groupBy("id").agg(F.min("v").alias("v"))


def _matrix(column) -> np.ndarray:
    """An Arrow column of equally long lists."""
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _table(schema: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema.split())


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all of b."""
    d = (a * a).sum(-1)[..., :, None] + (b * b).sum(-1)[..., None, :] - 2 * a @ np.swapaxes(b, -1, -2)
    return np.maximum(d, 0)


def _coded(batches):
    """node, v -> node, the vector in one byte a component after its scale: what the rounds send about."""
    for batch in batches:
        v = _matrix(batch.column(1))
        if len(v):
            scale = (np.abs(v).max(1) / 127).astype("<f8")
            code = np.rint(v / np.maximum(scale, np.finfo(float).tiny)[:, None]).astype(np.int8)
            raw = [s.tobytes() + c.tobytes() for s, c in zip(scale, code)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["node", "code"])


def _decoded(column) -> np.ndarray:
    raw = column.to_pylist()
    if not raw:
        return np.zeros((0, 0))
    flat = np.frombuffer(b"".join(raw), dtype=np.uint8).reshape(len(raw), -1)
    return flat[:, 8:].view(np.int8) * np.ascontiguousarray(flat[:, :8]).view("<f8")


def _placed(pivots, seed: int, near: int):
    """Adds to node, v: the two nearest pivots of a sample of them, a projection, and the nearest of all pivots."""

    def run(batches):
        ids, at = pivots.value
        rng = np.random.default_rng(seed)
        some = rng.permutation(len(ids))[: max(1, len(ids) // 2)]
        line = rng.standard_normal(at.shape[1])
        for batch in batches:
            v = _matrix(batch.column(1))
            if not len(v):
                continue
            d = _squares(v, at)
            two = min(2, len(some))
            first = np.argpartition(d[:, some], two - 1, axis=1)[:, :two]
            best = np.argsort(d, axis=1)[:, :near] if near else np.zeros((len(v), 0), dtype=int)
            best_ids = [x.tolist() for x in ids[best]]
            best_d = [x.tolist() for x in np.take_along_axis(d, best, 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(first[:, 0].astype(np.int32)), pa.array(first[:, -1].astype(np.int32)),
                 pa.array(v @ line), pa.array(best_ids, pa.list_(pa.int64())), pa.array(best_d, pa.list_(pa.float64()))],
                ["node", "v", "c", "c2", "at", "pivots", "far"],
            )

    return run


def _blocks(links: int, block: int):
    """Rows in order -> the best links inside blocks of them, and those to pivots."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0

        def done(last: bool):
            nonlocal held, rows
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            end = rows if last else rows - rows % block - block  # the last block takes the rest
            held, rows = [table.slice(end)], rows - end
            ids, v = table.column(0).to_numpy()[:end], _matrix(table.column(1).slice(0, end))
            for a in range(0, end, block):
                b = end if last and end - a < 2 * block else min(a + block, end)
                d = _squares(v[a:b], v[a:b])
                np.fill_diagonal(d, np.inf)
                n = min(links, b - a - 1)
                best = np.argpartition(d, max(n - 1, 0), axis=1)[:, :n]
                yield _table("node id d", np.repeat(ids[a:b], best.shape[1]), ids[a:b][best].ravel(), np.take_along_axis(d, best, 1).ravel())
                if b == end:
                    break

        for batch in batches:
            if not batch.num_rows:
                continue
            n = pc.list_value_length(batch.column(5)).to_numpy()
            yield _table("node id d", np.repeat(batch.column(0).to_numpy(), n), batch.column(5).flatten().to_numpy(), batch.column(6).flatten().to_numpy())
            held.append(batch)
            rows += batch.num_rows
            if rows >= 8 * block:
                yield from done(False)
        if rows:
            yield from done(True)

    return run


def _joined(batches):
    """Members of each node, node by node -> links that are better than a member's worst: node, id, d."""
    rest = None
    for batch in batches:
        table = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        node = table.column(0).to_numpy()
        if not len(node):
            continue
        end = int(np.searchsorted(node == node[-1], True)) if node[0] != node[-1] else 0
        rest = table.slice(end)
        if end:
            yield from _pairs(table.slice(0, end))
    if rest is not None and rest.num_rows:
        yield from _pairs(rest)


def _pairs(table: pa.RecordBatch, groups: int = 128):
    node, ids = table.column(0).to_numpy(), table.column(1).to_numpy()
    new, worst = table.column(2).to_numpy(zero_copy_only=False), table.column(3).to_numpy()
    v = _decoded(table.column(4))
    start = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    size = np.diff(np.append(start, len(node)))
    for g in range(0, len(start), groups):
        s, n = start[g : g + groups], size[g : g + groups]
        width = np.arange(n.max())
        here = width[None, :] < n[:, None]
        at = np.where(here, s[:, None] + width[None, :], 0)
        d = _squares(v[at], v[at])
        ok = here[:, :, None] & here[:, None, :] & (new[at][:, :, None] | new[at][:, None, :])
        ok &= (d < worst[at][:, :, None]) & (ids[at][:, :, None] != ids[at][:, None, :])
        k, i, j = np.nonzero(ok)
        a, b, far = ids[at[k, i]], ids[at[k, j]], d[k, i, j]
        order = np.lexsort((b, a))
        a, b, far = a[order], b[order], far[order]
        once = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
        yield _table("node id d", a[once], b[once], far[once])


def _best(links: DataFrame, n: int) -> DataFrame:
    """The ``n`` nearest of each node: node, links (struct of d, id, new)."""
    near = F.row_number().over(Window.partitionBy("node").orderBy("d", "id"))
    kept = links.withColumn("_k", near).filter(F.col("_k") <= n)  # limited before it is shuffled, too
    return kept.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("d", "id", "new"))).alias("links"))


def _drawn(col: str, seed: int, *ids: str) -> Column:
    return F.xxhash64(F.lit(seed), *(F.col(c) for c in ids))


@dataclass
class Graph:
    """Distinct vectors as nodes, their links, and the rows of each node."""

    nodes: DataFrame  # node, v
    members: DataFrame  # node, id: the least ids that hold the vector
    links: DataFrame  # node, links
    pivots: object  # broadcast: ids, vectors
    top: int


def _ordered(rows: DataFrame, n: int) -> DataFrame:
    """Rows of like vectors beside each other, dealt by ranges."""
    keys = ["c", "c2", "at", "node"]
    dealt = rows.repartition(1) if n <= WHOLE else rows.repartitionByRange(min(cores(rows.sparkSession), n // (WHOLE // 2)), *keys)
    return dealt.sortWithinPartitions(*keys)


def build(rows: DataFrame, top: int = 10, links: int = LINKS, sample: int = SAMPLE, rounds: int = ROUNDS) -> Graph:
    """``rows``: id, v, one row an id, equally long vectors."""
    spark = rows.sparkSession
    ship(spark)
    same = Window.partitionBy("v").orderBy("id")
    members = rows.withColumn("_k", F.row_number().over(same)).filter(F.col("_k") <= top + 1)  # limited before it is shuffled, too
    members = written(members.withColumn("node", F.min("id").over(Window.partitionBy("v"))).select("node", "id", "v"))
    nodes = members.filter("node = id").select("node", "v")
    members = members.select("node", "id")
    n = nodes.count()
    some = nodes.orderBy(F.xxhash64(F.lit(0), "node"), "node").limit(PIVOTS).toArrow()  # a bounded sample
    at = some.column("v").combine_chunks()
    pivots = spark.sparkContext.broadcast((some.column("node").to_numpy(), _matrix(at)))
    first = None
    for seed in range(1, ORDERS + 1):
        placed = nodes.mapInArrow(_placed(pivots, seed, 2 if seed == 1 else 0), "node long, v " + nodes.schema["v"].dataType.simpleString() + ", c int, c2 int, at double, pivots array<long>, far array<double>")
        found = _ordered(written(placed), n).mapInArrow(_blocks(links, BLOCK), "node long, id long, d double")
        first = found if first is None else first.unionByName(found)
    first = first.filter("node <> id").groupBy("node", "id").agg(F.min("d").alias("d"), F.lit(True).alias("new"))
    graph = written(_best(first, links))
    codes = written(nodes.mapInArrow(_coded, "node long, code binary"))
    for k in range(rounds if n > links + 1 else 0):
        graph = written(_round(graph, codes, links, sample, k))
        changed = graph.select(F.sum(F.size(F.filter("links", lambda x: x["new"])))).first()[0] or 0
        if changed <= SETTLED * n * links:
            break
    return Graph(nodes, members, graph, pivots, top)


def _round(graph: DataFrame, codes: DataFrame, links: int, sample: int, k: int) -> DataFrame:
    """One round of NN-descent."""
    drawn = F.transform(F.col("links"), lambda x: F.struct(F.xxhash64(F.lit(k), "node", x["id"]).alias("r"), x["id"].alias("id"), x["d"].alias("d"), x["new"].alias("new")))

    def some(new: bool) -> Column:
        return F.slice(F.array_sort(F.filter(drawn, lambda x: x["new"] == new)), 1, sample)

    ahead = graph.select("node", F.explode(F.concat(some(True), some(False))).alias("x")).select("node", "x.id", "x.new", "x.r")
    behind = ahead.select(F.col("id").alias("node"), F.col("node").alias("id"), "new", "r")
    turn = F.row_number().over(Window.partitionBy("node", "new").orderBy("r", "id"))
    behind = behind.withColumn("_k", turn).filter(F.col("_k") <= sample)
    members = ahead.select("node", "id", "new").unionByName(behind.select("node", "id", "new")).groupBy("node", "id").agg(F.max("new").alias("new"))
    worst = F.when(F.size("links") < links, float("inf")).otherwise(F.element_at("links", -1)["d"])
    held = codes.join(graph.select("node", worst.alias("worst")), "node", "left").select(
        F.col("node").alias("id"), F.coalesce("worst", F.lit(float("inf"))).alias("worst"), "code"
    )
    near = members.join(held, "id").select("node", "id", "new", "worst", "code")
    near = near.repartition(cores(codes.sparkSession), "node").sortWithinPartitions("node")
    found = near.mapInArrow(_joined, "node long, id long, d double").withColumn("new", F.lit(True))
    # Links that took part are old from now on.
    used = F.transform(some(True), lambda x: x["id"])
    old = graph.select("node", F.explode("links").alias("x"), used.alias("used")).select(
        "node", "x.id", "x.d", (F.col("x.new") & ~F.array_contains("used", F.col("x.id"))).alias("new")
    )
    both = old.unionByName(found).groupBy("node", "id").agg(F.min("d").alias("d"), F.min("new").alias("new"))
    return _best(both, links)


def _measured(batches):
    """q, id, w, v -> q, id, squared distance."""
    for batch in batches:
        if batch.num_rows:
            d = _matrix(batch.column(2)) - _matrix(batch.column(3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((d * d).sum(1))], ["q", "id", "d"])


def _starts(pivots, n: int):
    def run(batches):
        ids, at = pivots.value
        for batch in batches:
            if batch.num_rows:
                best = np.argsort(_squares(_matrix(batch.column(1)), at), axis=1)[:, :n]
                yield _table("q id", np.repeat(batch.column(0).to_numpy(), best.shape[1]), ids[best].ravel())

    return run


def search(graph: Graph, queries: DataFrame, kept: int = KEPT, opened: int = OPENED) -> DataFrame:
    """``queries``: q, v, and a node ``start`` where known (else null). Returns q, id (a node), d (squared), the ``kept`` nearest found."""
    links = graph.links.select("node", F.explode("links.id").alias("id"))
    back = graph.links.select(F.explode("links").alias("x"), F.col("node").alias("id")).select(F.col("x.id").alias("node"), "id", "x.d")
    back = back.withColumn("_k", F.row_number().over(Window.partitionBy("node").orderBy("d", "id"))).filter(F.col("_k") <= LINKS)
    links = written(links.unionByName(back.select("node", "id")).groupBy("node").agg(F.collect_set("id").alias("ids")))
    asked = written(queries.select("q", F.col("v").alias("w"), "start"))

    def measured(pairs: DataFrame) -> DataFrame:
        near = pairs.join(graph.nodes.withColumnRenamed("node", "id"), "id").join(asked, "q").select("q", "id", "w", "v")
        return near.mapInArrow(_measured, "q long, id long, d double").withColumn("done", F.lit(False))

    starts = asked.select("q", "w").mapInArrow(_starts(graph.pivots, 2), "q long, id long")
    starts = starts.unionByName(asked.filter("start is not null").select("q", F.col("start").alias("id"))).distinct()
    found = measured(starts)
    order = Window.partitionBy("q").orderBy("d", "id")
    turn = F.row_number().over(Window.partitionBy("q").orderBy("done", "d", "id"))
    while True:
        found = found.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= kept).drop("_k")
        found = written(found.withColumn("now", ~F.col("done") & (turn <= opened)))
        if not found.filter("now").limit(1).count():
            return found.select("q", "id", "d")
        ahead = found.filter("now").select("q", F.col("id").alias("node")).join(links, "node").select("q", F.explode("ids").alias("id")).distinct()
        ahead = ahead.join(found.select("q", "id"), ["q", "id"], "left_anti")
        found = found.select("q", "id", "d", (F.col("done") | F.col("now")).alias("done")).unionByName(measured(ahead))


def nearest(rows: DataFrame, asked: Column, id_col: str = "vec_id", vector_col: str = "embedding", top: int = 10) -> DataFrame:
    """The ``top`` nearest rows of every row for which ``asked`` (on its id) holds: query_id, rank, id, score.

    Score is the Euclidean distance of the original vectors, in double precision.
    """
    ship(rows.sparkSession)
    held = written(usable(rows, id_col, vector_col))
    graph = build(held, top)
    queries = held.filter(asked).select(F.col("id").alias("query_id"), "v")
    queries = written(queries.join(graph.nodes, "v"))  # rows of one vector ask once
    found = search(graph, graph.nodes.join(queries.select("node").distinct(), "node").select(F.col("node").alias("q"), "v", F.col("node").alias("start")))
    v, w = (graph.nodes.select(F.col("node").alias(a), F.col("v").alias(b)) for a, b in (("id", "v"), ("q", "w")))
    sum_ = F.aggregate(F.zip_with("v", "w", lambda x, y: (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x * x)
    exact = found.join(v, "id").join(w, "q").select("q", F.col("id").alias("node"), F.sqrt(sum_).alias("score"))
    best = exact.join(graph.members, "node")
    first = Window.partitionBy("q").orderBy("score", "id")
    best = best.withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= top + 1).select(F.col("q").alias("node"), "id", "score")
    out = queries.select("query_id", "node").join(best, "node").filter("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", "rank", F.col("id").alias(id_col), "score")
