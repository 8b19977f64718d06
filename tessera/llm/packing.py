"""Best-fit packing of tokenized documents into fixed-length sequences.

Bounded-space online best fit: each task keeps a fixed number of open
sequences, indexed by free space in a bitset, places every piece where the
least space stays free, and closes the fullest sequence when too many are
open.  Sequences still open at the end of a task are packed once more, as
whole items, with those of neighbouring tasks, so that many small input
partitions waste no space.

Defined results: null text counts as empty (one end id); null ids and repeated
rows are kept as rows of their own; an empty table gives no rows.  Pieces of
one Arrow batch are placed largest first.  Only the id and text columns are
read, so further columns never clash.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cores, written
from tessera.llm.encode import default_vocabulary, encoder, u32

CAPACITY = 1024
OPEN_SEQUENCES = 256
#: Input partitions whose unfinished sequences are packed together.
MERGE_TASKS = 16
END_ID = 2

_PIECE_SCHEMA = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, "
    "sequence_id long, offset long, task int, unfinished boolean"
)


class BestFit:
    """Open sequences in stacks by free space; ``mask`` has bit f set if stack f has one."""

    def __init__(self, capacity: int, open_limit: int, first_id: int):
        self.capacity, self.limit, self.next = capacity, open_limit, first_id
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask, self.open = 0, 0

    def _take(self, free: int) -> int:
        seq = self.stacks[free].pop()
        if not self.stacks[free]:
            self.mask &= ~(1 << free)
        self.open -= 1
        return seq

    def place(self, size: int) -> tuple[int, int]:
        """Sequence and offset for an item of ``size`` (at most the capacity)."""
        fits = self.mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            seq = self._take(free)
        else:
            free, seq = self.capacity, self.next
            self.next += 1
        left = free - size
        if left:
            self.stacks[left].append(seq)
            self.mask |= 1 << left
            self.open += 1
            if self.open > self.limit:
                self._take((self.mask & -self.mask).bit_length() - 1)
        return seq, self.capacity - free

    def unfinished(self) -> set[int]:
        return {s for stack in self.stacks for s in stack}


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; the first takes the remainder."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    out = [(0, first)] if first else []
    return out + [(s, capacity) for s in range(first, n, capacity)]


def _packer(vocabulary: str, end_id: int, capacity: int, open_limit: int, with_ids: bool):
    def run(batches):
        enc, end = encoder(vocabulary), u32([end_id])
        task = TaskContext.get().partitionId()
        bins = BestFit(capacity, open_limit, task << 40)
        held: list[dict] = []  # rows of sequences that may still be open
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = enc.one(text or "") + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append([doc_id, k, start, length, zlib.crc32(part), None, None, part])
            for row in sorted(rows, key=lambda r: -r[3]):
                row[5], row[6] = bins.place(row[3])
            held += rows
            still = bins.unfinished()
            done = [r for r in held if r[5] not in still]
            held = [r for r in held if r[5] in still]
            if done:
                yield _rows(done, task, False, with_ids)
        if held:
            yield _rows(held, task, True, with_ids)

    return run


def _rows(rows, task, unfinished, with_ids):
    cols = list(zip(*rows))
    types = [pa.int64(), pa.int32()] + [pa.int64()] * 5
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    arrays = [pa.array(c, t) for c, t in zip(cols, types)]
    arrays += [pa.array([task] * len(rows), pa.int32()), pa.array([unfinished] * len(rows), pa.bool_())]
    names += ["task", "unfinished"]
    if with_ids:
        arrays.append(pa.array(cols[7], pa.binary()))
        names.append("ids")
    return pa.RecordBatch.from_arrays(arrays, names)


def _merger(capacity: int, open_limit: int):
    def run(batches):
        bins = BestFit(capacity, open_limit, (1 << 62) + (TaskContext.get().partitionId() << 40))
        for batch in batches:
            seqs, fills = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            placed = [bins.place(n) for n in fills]
            yield pa.RecordBatch.from_arrays(
                [pa.array(seqs, pa.int64()), pa.array([p[0] for p in placed], pa.int64()),
                 pa.array([p[1] for p in placed], pa.int64())],
                ["_seq", "_into", "_base"],
            )

    return run


def pack(
    docs: DataFrame,
    vocabulary: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    capacity: int = CAPACITY,
    open_sequences: int = OPEN_SEQUENCES,
    with_ids: bool = False,
) -> DataFrame:
    """Place every piece of every document.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset and,
    with ``with_ids``, the piece's ids as little-endian unsigned 32-bit bytes.
    """
    vocabulary = vocabulary or default_vocabulary()
    schema = _PIECE_SCHEMA + (", ids binary" if with_ids else "")
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = written(
        narrow.mapInArrow(_packer(vocabulary, end_id, capacity, open_sequences, with_ids), schema)
    )
    # One row per sequence left open by a task: at most OPEN_SEQUENCES each.
    left = (
        pieces.filter("unfinished")
        .groupBy("sequence_id", "task")
        .agg(F.sum("length").alias("_fill"))
        .withColumn("_group", F.floor(F.col("task") / MERGE_TASKS))
        .repartition(cores(docs.sparkSession), "_group")
        .sortWithinPartitions(F.desc("_fill"), "sequence_id")
        .select(F.col("sequence_id").alias("_seq"), "_fill")
    )
    moved = left.mapInArrow(_merger(capacity, open_sequences), "_seq long, _into long, _base long")
    out = pieces.join(moved, pieces["sequence_id"] == moved["_seq"], "left")
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return out.select(
        *kept,
        F.coalesce("_into", "sequence_id").alias("sequence_id"),
        (F.col("offset") + F.coalesce("_base", F.lit(0))).alias("offset"),
        *(["ids"] if with_ids else []),
    )


def assemble(pieces: DataFrame) -> DataFrame:
    """Sequences of ``pack(..., with_ids=True)``: id bytes and the offsets of their pieces.

    A group holds at most one sequence's capacity.
    """
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id", "piece")))
    return pieces.groupBy("sequence_id").agg(ordered.alias("_p")).select(
        "sequence_id",
        F.aggregate("_p", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"),
        F.transform("_p", lambda p: p["offset"]).alias("offsets"),
    )
