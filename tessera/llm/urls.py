"""URL rules in a sorted digest array.

A rule is a host and a path prefix.  The 64-bit xxhash of ``host/path`` of all
rules forms one sorted array in a file that workers memory-map.  For each url
the keys of all rules that could fit (every parent domain with every rule path
length) are looked up by one vectorised binary search per batch, and a
digest found counts only if the stored rule string is equal.

Up to ``ARRAY_RULES`` rules the array goes to every executor as a file; beyond
that bound the same keys meet the rules in a shuffle join.

Defined results: the host is what follows the first ``://`` up to ``/``,
``?``, ``#`` or the end, A-Z lower-cased; the path goes on up to ``?``, ``#``
or the end; a null url or one without ``://`` has neither.  The longest rule
wins, then the longer host; of rules equal in host and path the one that
blocks counts.  Urls that no rule fits get ``default``.  Null ids and repeated
rows are kept; other columns are not read.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

ARRAY_RULES = 5_000_000

_KINDS = ("allow", "block")


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path by the definition above."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min((k for k in map(tail.find, "?#") if k >= 0), default=len(tail))
    return host.encode().lower().decode(), tail[:end]


def suffixes(host: str) -> list[str]:
    out, at = [host] if host else [], 0
    while (at := host.find(".", at) + 1) > 0:
        if at < len(host):
            out.append(host[at:])
    return out


def build_array(rules: list[tuple[str, str, str]], folder: str) -> str:
    """Write the array file: digests sorted, then string offsets, then strings. Returns its path."""
    merged: dict[str, str] = {}
    for host, path, verdict in rules:
        key = host + path
        merged[key] = "block" if "block" in (verdict, merged.get(key)) else "allow"
    keys = sorted(merged, key=lambda k: (xxhash.xxh64_intdigest(k), k))
    digests = np.array([xxhash.xxh64_intdigest(k) for k in keys], dtype="<u8")
    raw = [k.encode() for k in keys]
    ends = np.cumsum([0, *map(len, raw)], dtype="<u8")
    verdicts = np.array([_KINDS.index(merged[k]) for k in keys], dtype="u1")
    lengths = sorted({len(p) for _, p, _ in rules})
    name = os.path.join(folder, f"rules-{uuid.uuid4().hex}")
    head = json.dumps({"n": len(keys), "lengths": lengths}).encode()
    with open(name, "wb") as f:
        f.write(len(head).to_bytes(8, "little") + head)
        f.write(digests.tobytes() + ends.tobytes() + verdicts.tobytes() + b"".join(raw))
    return name


class DigestArray:
    """Memory-mapped reader of ``build_array``'s file."""

    def __init__(self, name: str):
        mapped = np.memmap(name, dtype="u1", mode="r")
        size = int.from_bytes(mapped[:8].tobytes(), "little")
        head = json.loads(mapped[8 : 8 + size].tobytes())
        n, at = head["n"], 8 + size
        self.n, self.lengths = n, head["lengths"]
        self.digests = mapped[at : at + 8 * n].view("<u8") if at % 8 == 0 else np.frombuffer(mapped, "<u8", n, at)
        at += 8 * n
        self.ends = np.frombuffer(mapped, "<u8", n + 1, at)
        at += 8 * (n + 1)
        self.verdicts = np.frombuffer(mapped, "u1", n, at)
        self.strings = mapped[at + n :]

    def find(self, keys: list[str]) -> list[int]:
        """Index of each key in the array, or -1."""
        if not self.n or not keys:
            return [-1] * len(keys)
        probe = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), dtype="u8", count=len(keys))
        at = np.searchsorted(self.digests, probe)
        hit = np.flatnonzero(self.digests[np.minimum(at, self.n - 1)] == probe)
        out = [-1] * len(keys)
        for j in hit:
            k, want = int(at[j]), keys[j].encode()
            while k < self.n and self.digests[k] == probe[j]:  # equal digests stand together
                if self.strings[int(self.ends[k]) : int(self.ends[k + 1])].tobytes() == want:
                    out[j] = k
                    break
                k += 1
        return out


def candidates(host: str, path: str, lengths: list[int]) -> list[str]:
    """Keys of all rules that could fit, longest first, then the longer host."""
    out = [(len(h) + n, len(h), h + path[:n]) for h in suffixes(host) for n in lengths if n <= len(path)]
    return [k for _, _, k in sorted(out, key=lambda c: (-c[0], -c[1]))]


def _judge(file_name: str, default: str):
    def run(batches):
        table = DigestArray(SparkFiles.get(file_name))
        for batch in batches:
            hosts, paths, keys, owner = [], [], [], []
            for row, url in enumerate(batch.column(1).to_pylist()):
                host, path = split_url(url)
                hosts.append(host)
                paths.append(path)
                cands = candidates(host, path, table.lengths)
                keys += cands
                owner += [row] * len(cands)
            rule, verdict = [None] * len(hosts), [default] * len(hosts)
            for row, key, k in zip(owner, keys, table.find(keys)):
                if k >= 0 and rule[row] is None:
                    rule[row], verdict[row] = key, _KINDS[table.verdicts[k]]
            arrays = [batch.column(0), *(pa.array(c, pa.string()) for c in (hosts, paths, rule, verdict))]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "host", "path", "rule", "verdict"])

    return run


_OUT = "page_id long, host string, path string, rule string, verdict string"


def _keys(lengths: list[int]):
    kind = pa.list_(pa.string())

    def run(batches):
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            keys = [candidates(h, p, lengths) for h, p in parts]
            arrays = [batch.column(0), pa.array([p[0] for p in parts], pa.string()),
                      pa.array([p[1] for p in parts], pa.string()), pa.array(keys, kind)]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "host", "path", "_keys"])

    return run


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    array_rules: int = ARRAY_RULES,
) -> DataFrame:
    """page_id, host, path, rule, verdict of every url; ``rules`` has host, path, verdict."""
    spark = pages.sparkSession
    narrow = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rules = rules.select("host", "path", "verdict").filter("host is not null and path is not null")
    if rules.count() <= array_rules:
        rows = [tuple(r) for r in rules.collect()]
        file = build_array(rows, tempfile.mkdtemp(prefix="rules-"))
        spark.sparkContext.addFile(file)
        return narrow.mapInArrow(_judge(os.path.basename(file), default), _OUT)
    # Beyond the bound: keys and rules meet in a join on the digest, confirmed by the string.
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    merged = rules.groupBy(F.concat("host", "path").alias("_rule")).agg(F.max("verdict").alias("_verdict"))
    merged = merged.withColumn("_digest", F.xxhash64("_rule"))
    split = narrow.mapInArrow(_keys(lengths), "page_id long, host string, path string, _keys array<string>")
    split = written(split.withColumn("_row", F.monotonically_increasing_id()))  # one numbering for both uses
    distinct = split.select(F.explode("_keys").alias("_key")).distinct().withColumn("_digest", F.xxhash64("_key"))
    found = distinct.join(merged, "_digest").filter("_key = _rule").select("_key", "_verdict")
    hits = split.select("_row", F.posexplode("_keys").alias("_p", "_key")).join(found, "_key")
    best = hits.groupBy("_row").agg(F.min_by(F.struct("_key", "_verdict"), "_p").alias("_b"))
    return split.join(best, "_row", "left").select(
        "page_id", "host", "path", F.col("_b._key").alias("rule"),
        F.coalesce("_b._verdict", F.lit(default)).alias("verdict"),
    )
