"""Merkle manifest, neighbour search and phrase counting against brute force, with edge rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from tessera.llm import collocations, merkle, neighbours, queries
from tessera.llm.common import fold, ship

FIELDS = queries.LEAF_FIELDS


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def levels_of(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def path_of(levels, at):
    out = []
    for level in levels[:-1]:
        lo = at // 16 * 16
        out.append((level[lo:at], level[at + 1 : lo + 16]))
        at //= 16
    return out


def brute_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = levels_of([leaf(r) for r in groups[g]])
    top = levels_of([trees[g][-1][0] for g in names])
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            path = path_of(trees[g], i) + path_of(top, k)
            text = r[4]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = lower(text)
            now = leaf((*r[:4], text))
            for left, right in path:
                now = H(*left, now, *right)
            proof = H(*("".join(left + right) for left, right in path))
            yield (r[0], trees[g][0][i], trees[g][-1][0], top[-1][0], proof, now, now == top[-1][0])


def proofs(df):
    changed = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    now = F.when(changed, fold(F.col("text"))).otherwise(F.col("text"))
    return merkle.manifest(df, FIELDS, "doc_id", "source", {"text": now})


def test_merkle_manifest(spark):
    ship(spark)
    rows = [(i, "big", "en", i, f"Text {i} Ünï") for i in range(300)] + [(i, "run", None, None, f"T{i}") for i in range(17)]
    rows += [(1000, "one", "de", 1, "Alone"), (5, None, "x", 2, None), (None, "run", "x", 2, "No Id"), (7, "", "", 0, ""),
             (3, "run", None, None, "T3"), (3, "run", None, None, "other"), (8, "long", "en", 9, "Word " * 60_000)]
    rows += [(2000 + k, f"s{k:02d}", "en", k, "X") for k in range(20)]
    # Names that the operator uses inside, on top.
    df = spark.createDataFrame([(*r, "z", 1, "y") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, g string, idx int, h string")
    got = sorted(map(tuple, proofs(df).collect()), key=str)
    assert got == sorted(brute_manifest(rows), key=str) and not all(r[-1] for r in got)
    assert sorted(map(tuple, proofs(df.repartition(7)).collect()), key=str) == got
    assert proofs(df.limit(0)).collect() == []
    one = proofs(df.filter("source = 'one'")).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == H()


def test_merkle_paths_lead_to_the_root(spark):
    df = spark.range(100).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("part"), F.col("id").cast("string").alias("text"))
    for r in merkle.manifest(df, ["doc_id", "text"], "doc_id", "part", fanout=4, with_path=True).collect():
        h = r.leaf
        for s in r.path:
            h = H(s.left, h, s.right)
        assert h == r.root == r.folded_root and r.verified


def brute_phrases(rows, least, top, most=5):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        n[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, most + 1):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        covered = {q for p, a in often.items() for m in range(2, len(p)) for i in range(len(p) - m + 1)
                   if 100 * a >= 100 * often[q := p[i : i + m]]}
        scored = []
        for p, a in often.items():
            if p not in covered:
                score, _, l, r = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1):
            yield (lang, rank, p.decode(), -a, l, r, n[lang], -s)


EDGE_TEXTS = [
    ("en", "Big Apple pie. big apple tart, BIG  apple\tpie"), ("en", None), ("en", ""), (None, "der die das der die das"), ("und", "Der die das"),
    ("en", " \t\n.,;"), ("en", "a a a a a a a a"), ("fr", "été chaud\x0bété chaud\rété froid"), ("fr", "été chaud \x1c x \x00 y \x1c x"),
    ("en", "the quick brown fox " * 3_000), ("en", "Big Apple pie. big apple tart, BIG  apple\tpie"), ("", "solo word solo word solo word"),
]


@pytest.fixture()
def phrases(spark):
    ship(spark)
    return spark.createDataFrame([(l, t, "z", 0, 1) for l, t in EDGE_TEXTS], "lang string, text string, phrase string, n int, word int")


@pytest.mark.parametrize("dictionary", [1_000_000, 0])
def test_collocations(phrases, dictionary):
    got = collocations.collocations(phrases, least=3, top=6, dictionary=dictionary).collect()
    assert sorted(map(tuple, got)) == sorted(brute_phrases(EDGE_TEXTS, 3, 6))


def test_collocations_without_phrases(phrases):
    assert collocations.collocations(phrases.limit(0), least=2).collect() == []
    assert collocations.collocations(phrases, least=10**6).collect() == []


@pytest.mark.parametrize("words", [2, 5])
def test_hat_trie_bursts_and_spills(words):
    rng = np.random.default_rng(words)
    trie, want, got = collocations.HatTrie(words, burst=8), Counter(), Counter()
    for _ in range(20):
        keys = rng.integers(1, 6, (200, words)).astype(np.uint32)
        want.update(map(tuple, keys.tolist()))
        trie.add(*collocations._summed(keys))
        if trie.size() > 100:
            for k, n in zip(*trie.spill(50)):
                got[tuple(k.tolist())] += int(n)
            assert trie.size() <= 50
    assert words == 2 or any(isinstance(x, collocations.HatTrie.Node) for x in trie.root.values()) or not trie.root
    for k, n in zip(*trie.spill()):
        got[tuple(k.tolist())] += int(n)
    assert got == want and trie.size() == 0


def test_blocks_lose_no_phrase():
    ids = np.arange(1, 3 * collocations.BLOCK_IDS + 7).astype("<i4")
    ids[5:9] = 0
    out = [(np.frombuffer(b, dtype="<i4"), n) for b, n in collocations._blocks(ids)]
    starts = np.concatenate([b[:n] for b, n in out])
    assert starts.tolist() == np.delete(ids, [6, 7, 8]).tolist()  # cuts in a row are one
    assert all(b[n : n + 4].tolist() == c[:4].tolist() for (b, n), (c, _) in zip(out, out[1:]))


def brute_nearest(vectors, asked, top=10):
    for q, v in vectors.items():
        if asked(q):
            near = sorted((math.dist(v, w), i) for i, w in vectors.items() if i != q)[:top]
            for rank, (d, i) in enumerate(near, 1):
                yield q, rank, i, d


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, "z", 0.5, 1) for i, v in rows], "vec_id long, embedding array<float>, node string, d double, id int")


def test_neighbours_of_edge_rows(spark):
    rng = np.random.default_rng(3)
    good = {i: rng.standard_normal(4).astype(np.float32).tolist() for i in range(30)}
    good |= {i: [1.0, 2.0, 3.0, 4.0] for i in range(100, 160)}  # one vector held by most rows
    bad = [(200, None), (300, []), (400, [0.0] * 4), (500, [1.0, None, 1.0, 1.0]), (600, [float("nan")] * 4),
           (700, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (800, [1.0, 2.0])]
    rows = [*good.items(), *bad, (5, good[5])]  # a repeated row
    got = neighbours.nearest(vectors_of(spark, rows), F.col("id") % 10 == 0).collect()
    want = sorted(brute_nearest(good, lambda i: i % 10 == 0))
    assert [tuple(r)[:3] for r in sorted(got)] == [w[:3] for w in want]
    assert all(r.score == pytest.approx(w[3], abs=1e-12) for r, w in zip(sorted(got), want))
    assert neighbours.nearest(vectors_of(spark, rows).limit(0), F.col("id") % 10 == 0).collect() == []
    few = neighbours.nearest(vectors_of(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])]), F.col("id") == 0).collect()
    assert [(r.rank, r.vec_id) for r in sorted(few)] == [(1, 2), (2, 1)]
    assert neighbours.nearest(vectors_of(spark, [(0, [1.0])]), F.col("id") == 0).collect() == []


def test_neighbours_recall(spark):
    got = queries.q_neighbours(spark, SF_MID).collect()
    rows = spark.read.parquet(f"{SF_MID}/embeddings.parquet").collect()
    want = {(q, i) for q, _, i, _ in brute_nearest({r.vec_id: r.embedding for r in rows}, lambda i: i % 100 == 0)}
    assert len(got) == len(want) and len(want & {(r.query_id, r.vec_id) for r in got}) >= 0.9 * len(want)


def test_local_join_is_exact():
    """Of one group, every pair with a new member that beats the first one's worst link."""
    import pyarrow as pa

    rng = np.random.default_rng(0)
    v = rng.standard_normal((6, 3))
    coded = next(neighbours._coded([pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(v.tolist())], ["node", "v"])])).column(1)
    near = neighbours._decoded(coded)
    assert np.abs(near - v).max() < np.abs(v).max() / 200
    new, worst = [True, False, False, True, False, False], [9.0, 1.0, 9.0, 2.0, 0.0, float("inf")]
    batch = pa.RecordBatch.from_arrays([pa.array([7] * 6), pa.array(range(6)), pa.array(new), pa.array(worst), coded], ["node", "id", "new", "worst", "code"])
    got = {(a, b) for t in neighbours._joined([batch.slice(0, 4), batch.slice(4)]) for a, b in zip(t.column(0).to_pylist(), t.column(1).to_pylist())}
    want = {(a, b) for a in range(6) for b in range(6) if a != b and (new[a] or new[b]) and ((near[a] - near[b]) ** 2).sum() < worst[a]}
    assert got == want
