"""Token ids as a binary file set with a shared compression dictionary.

A file set is a folder with two Parquet tables:

* ``dictionary``: one row, the zstandard dictionary trained on serialized id
  arrays of a bounded hashed sample of documents, and its SHA-256.
* ``segments``: about ``SEGMENT_BYTES`` of concatenated frames per row.  Each
  document is one frame (little-endian unsigned 32-bit ids, compressed with
  the dictionary); ``offsets`` is the index into ``blob``, so one document is
  read by decompressing its own frame only.  Every segment carries the
  dictionary hash, which readers compare.

Spark commits both tables, so lost executors and retried tasks leave no
half-written files, and any store that Spark reaches will do.

Defined results: documents are in ascending (id, text hash) order, null ids
first; null text counts as empty (one end id); repeated rows are kept; an
empty table gives an empty file set.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.llm.common import cores
from tessera.llm.encode import default_vocabulary, encoder, u32

END_ID = 2
SEGMENT_BYTES = 4 << 20
SEGMENT_DOCS = 1 << 14
DICTIONARY_BYTES = 112_640
#: Documents that the dictionary is trained on.
SAMPLE_DOCS = 2_000
#: A short document: the dictionary serves these, since a longer one fills its own window.
SHORT_CHARS = 20_000
LEVEL = 3

_SEGMENTS = (
    "part int, seq int, first long, total long, dictionary string, min_id long, max_id long, "
    "doc_ids array<long>, n_tokens array<long>, offsets array<long>, blob binary"
)


def train_dictionary(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> bytes:
    """Dictionary from a hashed sample; empty bytes when there is too little to train on.

    Only this helper model sees a sample: SAMPLE_DOCS whole texts (at most four
    times as many when ids repeat) of at most SHORT_CHARS characters.
    """
    docs = docs.filter(F.coalesce(F.length("text"), F.lit(0)) <= SHORT_CHARS)
    n = docs.count()
    if not n:
        return b""
    share = min(1.0, SAMPLE_DOCS / n)
    rows = (
        docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
        .select(F.col("text").alias("t"))
        .limit(4 * SAMPLE_DOCS)
        .collect()
    )
    enc, end = encoder(vocabulary), u32([end_id])
    samples = [enc.one(r["t"] or "") + end for r in rows]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few or too small samples
        return b""


def _codec(dictionary: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


def _writer(vocabulary: str, end_id: int, shared):
    def run(batches):
        dictionary = shared.value
        digest = hashlib.sha256(dictionary).hexdigest()
        enc, end = encoder(vocabulary), u32([end_id])
        pack = zstandard.ZstdCompressor(level=LEVEL, **_codec(dictionary))
        part = TaskContext.get().partitionId()
        seq = first = size = 0
        ids, counts, frames = [], [], []

        def flush():
            offsets = [0]
            for f in frames:
                offsets.append(offsets[-1] + len(f))
            known = [i for i in ids if i is not None]
            row = {
                "part": part, "seq": seq, "first": first, "total": sum(counts), "dictionary": digest,
                "min_id": min(known, default=None), "max_id": max(known, default=None),
                "doc_ids": ids, "n_tokens": counts, "offsets": offsets, "blob": b"".join(frames),
            }
            return pa.RecordBatch.from_pylist([row], schema=_arrow_segments())

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = enc.one(text or "") + end
                frame = pack.compress(raw)
                ids.append(doc_id)
                counts.append(len(raw) // 4)
                frames.append(frame)
                size += len(frame)
                if size >= SEGMENT_BYTES or len(ids) >= SEGMENT_DOCS:
                    yield flush()
                    seq, first, size = seq + 1, first + sum(counts), 0
                    ids, counts, frames = [], [], []
        if ids:
            yield flush()

    return run


def _arrow_segments() -> pa.Schema:
    longs = pa.list_(pa.int64())
    return pa.schema([
        ("part", pa.int32()), ("seq", pa.int32()), ("first", pa.int64()), ("total", pa.int64()),
        ("dictionary", pa.string()), ("min_id", pa.int64()), ("max_id", pa.int64()),
        ("doc_ids", longs), ("n_tokens", longs), ("offsets", longs), ("blob", pa.binary()),
    ])


def write_tokens(
    docs: DataFrame,
    path: str,
    vocabulary: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
) -> None:
    """Write the file set of all whole texts, in ascending id order, to ``path``."""
    spark = docs.sparkSession
    vocabulary = vocabulary or default_vocabulary()
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dictionary = train_dictionary(narrow, vocabulary, end_id)
    spark.range(1).select(
        F.lit(hashlib.sha256(dictionary).hexdigest()).alias("hash"),
        F.lit(bytearray(dictionary)).cast("binary").alias("dictionary"),
    ).write.parquet(f"{path}/dictionary")
    # Ranges over (id, text hash): a repeated id does not fill one task.
    ordered = (
        narrow.withColumn("_h", F.xxhash64("text"))
        .repartitionByRange(cores(spark), "doc_id", "_h")
        .sortWithinPartitions("doc_id", "_h")
        .select("doc_id", "text")
    )
    shared = spark.sparkContext.broadcast(dictionary)
    ordered.mapInArrow(_writer(vocabulary, end_id, shared), _SEGMENTS).write.option(
        "compression", "zstd"
    ).parquet(f"{path}/segments")


def _dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(row["dictionary"]).hexdigest() != row["hash"]:
        raise ValueError("the dictionary does not match its hash")
    return row["hash"], bytes(row["dictionary"])


def _frames(shared, digest: str, wanted: frozenset | None):
    def run(batches):
        codec = zstandard.ZstdDecompressor(**_codec(shared.value))
        for batch in batches:
            for seg in batch.to_pylist():
                if seg["dictionary"] != digest:
                    raise ValueError("a segment was written with another dictionary")
                blob, at, before = seg["blob"], seg["offsets"], seg["first"] + seg["base"]
                out = []
                for k, (doc_id, n) in enumerate(zip(seg["doc_ids"], seg["n_tokens"])):
                    if wanted is None or doc_id in wanted:
                        ids = codec.decompress(blob[at[k] : at[k + 1]])
                        out.append((doc_id, before, len(ids) // 4, zlib.crc32(ids), ids if wanted is not None else None))
                    before += n
                if out:
                    cols = list(zip(*out))
                    types = [pa.int64()] * 4 + [pa.binary()]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return run


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, ids.

    ``ids`` is filled only when ``doc_ids`` names the documents to fetch; then
    only segments whose id range can hold one are read.
    """
    digest, dictionary = _dictionary(spark, path)
    segments = spark.read.parquet(f"{path}/segments")
    # One row per written partition: a bounded table.
    totals = segments.groupBy("part").agg(F.sum("total").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long").alias("base"))
    if doc_ids is not None:
        hit = F.lit(False)
        for i in doc_ids:
            hit = hit | ((F.col("min_id") <= i) & (F.col("max_id") >= i))
        segments = segments.filter(hit)
    wanted = None if doc_ids is None else frozenset(doc_ids)
    shared = spark.sparkContext.broadcast(dictionary)
    return (
        segments.join(bases, "part")
        .select("dictionary", "first", "base", "doc_ids", "n_tokens", "offsets", "blob")
        .mapInArrow(
            _frames(shared, digest, wanted),
            "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary",
        )
    )
