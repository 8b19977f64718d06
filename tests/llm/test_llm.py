"""The training-data operators against brute force, round trips and edge rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import chat, decontamination, encode, hmm, jaccard, packing, pii, quality, tokenfile, toxicity, urls
from tessera.llm.common import Marks, ship
from tessera.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
#: null and blank texts, ties, repeated rows, a null id, a very long text.
EDGE = [
    (1, "One two three four five six seven eight nine ten eleven."), (2, None), (3, ""), (4, " \t\n"), (5, "a"),
    (1, "One two three four five six seven eight nine ten eleven."), (None, "no id here"), (6, LONG),
    (7, "ONE two three four five six seven eight nine ten eleven."), (8, "Ünï cødé 日本 text"),
    (9, "an added token <|endoftext|> inside, and <|endoftext|>"),
]


def fold(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    rows = [(i, t, "extra", i) for i, t in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, words string, node long")  # names that operators use inside


@pytest.fixture(scope="module")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


def ids_of(text):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(encode.default_vocabulary())
    return tok.encode(text or "", add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("text", ["", "It's  a\n\ttest <|endoftext|> 12 x", "Éàß ſ×÷ naïve", "日本語 mixed é\x1c\x85 text", LONG[:5000]])
def test_encoder_equals_library(text):
    assert encode.encoder(encode.default_vocabulary()).one(text) + encode.u32([2]) == encode.u32(ids_of(text))


def test_best_fit_places_in_the_least_space():
    bins = packing.BestFit(10, 2, 0)
    assert [bins.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    bins = packing.BestFit(10, 1, 0)
    assert [bins.place(n) for n in (6, 7, 3)] == [(0, 0), (1, 0), (0, 6)]  # 1 is fuller and closed first
    assert packing.cut(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)] and packing.cut(2048, 1024)[0] == (0, 1024)


def test_packing(docs, empty):
    rows = packing.pack(docs, with_ids=True).collect()
    seqs, pieces = {}, Counter()
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        pieces[r.doc_id] += r.length
    for placed in seqs.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 1024
    want = Counter()
    for i, t in EDGE:
        want[i] += len(ids_of(t))
    assert pieces == want
    assert packing.pack(empty).count() == 0
    whole = packing.assemble(packing.pack(docs, with_ids=True)).collect()
    assert sum(len(r.ids) for r in whole) == 4 * sum(want.values())


def test_token_files(spark, docs, empty, tmp_path):
    tokenfile.write_tokens(docs.filter("doc_id is not null"), str(tmp_path / "t"))
    got = tokenfile.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    at = 0
    for (i, text), r in zip(sorted(((i, t) for i, t in EDGE if i is not None), key=lambda x: x[0]), got):
        raw = encode.u32(ids_of(text))
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(raw) // 4, zlib.crc32(raw))
        at += r.n_tokens
    one = tokenfile.read_tokens(spark, str(tmp_path / "t"), [8]).collect()
    assert [bytes(r.ids) for r in one] == [encode.u32(ids_of(dict(EDGE)[8]))]
    tokenfile.write_tokens(empty, str(tmp_path / "e"))
    assert tokenfile.read_tokens(spark, str(tmp_path / "e")).count() == 0


def base_rules(text):
    w = WORD.findall(text or "")
    grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    hit = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_quality(spark, docs, empty):
    extra = spark.createDataFrame(
        [(20, "a b c d e a b c d e x\n\nhome | about | contact\nx\nx\nAll rights reserved.", "", 1),
         (21, "a b a b a b a b a b a b", "", 1), (22, "*** $$$ ### word\n" * 20, "", 1),
         (25, "word next to word " * 2_000 + "See our privacy policy for more.", "", 1),
         (26, "Datenschutzerklärung\nTOUS DROITS RÉSERVÉS.\nAviso legal\nÜber uns | Kontakt\n" + "eins zwei drei vier fünf sechs sieben acht neun zehn elf", "", 1),
         (23, "home " * 100_000, "", 1), (24, "about us contact\n" + "home" * 100_000, "", 1)], docs.schema)
    for r in quality.clean(docs.unionByName(extra)).collect():
        text = dict(EDGE + [(x.doc_id, x.text) for x in extra.collect()])[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_rules(text)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and r.kept <= (not r.base_failed)
        if r.doc_id == 20:
            assert r.cleaned == "a b c d e a b c d e x\nx\nx" and r.n_failed_lines == 2
        if r.doc_id == 23:
            assert r.n_failed_lines == 0  # more words than a menu has
        if r.doc_id == 24:
            assert r.n_failed_lines == 2
        if r.doc_id == 1:
            assert r.kept
        if r.doc_id == 25:  # a phrase of a notice in a long text
            assert r.n_failed_lines == 0 and r.cleaned == text
        if r.doc_id == 26:
            assert r.n_failed_lines == 4 and r.cleaned.startswith("eins")
    assert quality.clean(empty).count() == 0


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "a\\b <s> [INST] x\n[/INST]"), (1, 1, "assistant", "ok </s> \\"), (1, 2, "weird\nrole<e>", "x"),
            (1, 3, None, None), (1, None, "assistant", ""), (2, 0, "[INST]role", "\\\\n\\s<\\s>"), (2, 1, "assistant", "plain\\text"),
            (3, 0, "ro\\nle\n\\\n", "<s"), (3, 1, "user", "s>"), (3, 1, "user", "s>"), (None, 0, "user", "<e>"),
            (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert all(r.identical for r in out.values()) and len(out) == 5
    for r in chat.digest(chat.format_conversations(df)).collect():
        turns = sorted((x[1:] for x in rows if x[0] == r.conv_id), key=lambda x: (x[0] is not None, x[0] or 0))
        turns = [(a or "", b or "") for _, a, b in turns]
        loss = "".join(t for a, t in turns if a == "assistant")
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in turns).encode()).hexdigest()
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == len(out[r.conv_id].formatted)
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_urls(spark):
    rules = spark.createDataFrame(
        [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")],
        "host string, path string, verdict string")
    cases = [("http://A.Example.COM/en/x?q", "example.com/en/", "block"), ("https://www.example.com/en/", "www.example.com/en/", "allow"),
             ("http://x.com/a", "com/", "allow"), ("http://x.com", None, "allow"), ("http://badexample.com/en/", "com/", "allow"),
             ("http://net/es/", "net/es/", "block"), ("http://a.net/esx", None, "allow"), (None, None, "allow"), ("x.net/es/", None, "allow"),
             ("http://", None, "allow"), ("http://.com./", None, "allow")]
    pages = spark.createDataFrame([(i, u, 1) for i, (u, _, _) in enumerate(cases)], "page_id long, url string, host int")
    for limit in (10, 0):  # the array, and the join beyond its bound
        got = {r.page_id: r for r in urls.judge_urls(pages, rules, array_rules=limit).collect()}
        assert [(got[i].rule, got[i].verdict) for i in range(len(cases))] == [(r, v) for _, r, v in cases]
    assert urls.split_url("x://H.A/p/q#z?y") == ("h.a", "/p/q")
    assert urls.judge_urls(pages, rules.limit(0)).filter("rule is not null").count() == 0


def test_digest_array_confirms_strings(tmp_path):
    name = urls.build_array([("a.b", "/", "block"), ("c", "/x", "allow")], str(tmp_path))
    array = urls.DigestArray(name)
    assert [k >= 0 for k in array.find(["a.b/", "c/x", "c/y"])] == [True, True, False]
    array.digests = np.repeat(array.digests[:1], 2)  # every key collides: the strings decide
    assert array.find(["zzz"]) == [-1]


def test_decontamination(spark, docs, empty):
    items = [(1, "two THREE four five six, seven eight nine ten eleven"), (2, "three-four"), (3, None), (4, "..."), (5, "日本"), (6, "no id here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t or ""))
    for block_words in (1_000_000, 5):  # one block, and many
        for r in decontamination.find_contamination(docs, bench, block_words=block_words).collect():
            w, hit, found = words(dict(EDGE)[r.doc_id]), set(), set()
            for item, text in items:
                p = words(text)
                m = min(10, len(p))
                for a in range(len(p) - m + 1 if m else 0):
                    for k in range(len(w) - m + 1):
                        if w[k : k + m] == p[a : a + m]:
                            hit |= set(range(k, k + m))
                            found.add(str(item))
            assert (r.n_words, r.n_hit, list(r["items"])) == (len(w), len(hit), sorted(found))
        kept = decontamination.remove_contaminated(docs, bench, block_words=block_words)
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {2, 3, 4, 5, 6, 9}
    assert decontamination.find_contamination(empty, bench).count() == 0
    assert decontamination.find_contamination(docs, bench.limit(0)).filter("contaminated").count() == 0


def jaccard_truth(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall(fold(t or ""))
        m = min(5, len(w))
        sets.append({tuple(w[k : k + m]) for k in range(len(w) - m + 1)} if m else set())
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 80 * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted((str(d), len(s), least.get(top(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def test_jaccard_join(spark, docs, empty, monkeypatch):
    rng = np.random.default_rng(3)
    base = [f"t{k}" for k in range(60)]
    rows = list(EDGE)
    for i in range(60):  # a family around the threshold, sharing a passage with others
        w = list(base)
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(0, 60))] = f"z{int(rng.integers(0, 99))}"
        rows.append((100 + i, " ".join(w)))
        rows.append((300 + i, " ".join([f"q{i}_{k}" for k in range(30)] + base[:30])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    truth = jaccard_truth(rows)
    for block in (1_000_000, 500):  # one block a cluster, and pairs of blocks
        monkeypatch.setattr(jaccard, "BLOCK", block)
        got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect())
        assert got == truth
    assert jaccard.jaccard_components(empty).count() == 0
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 4, 5, 6, 8, 9, None])


def test_jaccard_counts_every_link_once(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(50):  # near copies of one text, some of them twice, and rows without a link
        w = [f"t{k}" for k in range(60)]
        for _ in range(int(rng.integers(0, 3))):
            w[int(rng.integers(0, 60))] = f"z{int(rng.integers(0, 99))}"
        rows += [(i, " ".join(w))] * (1 + i % 2)
    rows += [(100, None), (101, "alone here"), (None, rows[0][1])]
    sets = []
    for _, t in rows:
        w = WORD.findall(t or "")
        m = min(5, len(w))
        sets.append({tuple(w[k : k + m]) for k in range(len(w) - m + 1)} if m else set())
    want = Counter(
        (str(d), sum(1 for j, t in enumerate(sets) if j != i and s and 100 * len(s & t) >= 80 * len(s | t)))
        for i, ((d, _), s) in enumerate(zip(rows, sets))
    )
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (1_000_000, 1000, 300):  # one block, two or three, and many
        monkeypatch.setattr(jaccard, "BLOCK", block)
        assert Counter((str(r.doc_id), r.n_links) for r in jaccard.jaccard_components(df).collect()) == want


def test_t_occurrence_equals_counting():
    rng = np.random.default_rng(5)
    common = np.arange(40)
    sets = [np.unique(np.r_[common[rng.random(40) < 0.9], rng.integers(100, 400, 30)]) for _ in range(50)]
    block = jaccard.Block(sets)
    for i, s in enumerate(sets):  # the other sets; members of this set alone are not counted
        found, shared = block.search(s, 30)
        want = {j: len(np.intersect1d(s, t)) for j, t in enumerate(sets) if j != i}
        got = {j: n for j, n in zip(found.tolist(), shared.tolist()) if j != i}
        assert got == {j: n for j, n in want.items() if n >= 30}


def test_components_and_marks(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (50, 70)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(2, 41)}, 100: 50, 70: 50}
    marked, others = Marks(spark.range(5).select("id")).split(spark.range(50).select("id"), "id")
    assert {r.id for r in marked.collect()} >= set(range(5)) and marked.count() + others.count() == 50


def test_hmm_forward_is_exact_likelihood():
    rng = np.random.default_rng(1)
    k, c = 3, 5
    norm = lambda x, a: x / x.sum(axis=a, keepdims=True)
    model = hmm.Model(norm(rng.random(k), 0), norm(rng.random((k, k)), 1), norm(rng.random((c, k)), 0))
    seqs = [np.array(s, dtype="<u2") for s in ([0, 1, 2, 4], [3], [2, 2, 0])]
    flat, starts, lengths = hmm._cut(seqs, None)
    got = model.forward(flat, starts, lengths)
    for s, value in zip(seqs, got):
        total = 0.0  # over all state paths
        for path in np.ndindex(*[k] * len(s)):
            p = model.start[path[0]] * model.emits[s[0], path[0]]
            for t in range(1, len(s)):
                p *= model.moves[path[t - 1], path[t]] * model.emits[s[t], path[t]]
            total += p
        assert math.isclose(value, math.log(total), rel_tol=1e-9)
    start, pair, seen, loglik = model.expect(flat, starts, lengths)
    assert np.isclose(start.sum(), 3) and np.isclose(pair.sum(), 5, rtol=1e-4) and np.isclose(seen.sum(), 8, rtol=1e-4)
    assert np.isclose(loglik, got.sum(), rtol=1e-4)


def test_hmm_scores(spark, empty):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(120):  # two languages: latent states pay
        words = [f"a{k}" for k in range(20)] if i % 2 else [f"b{k}" for k in range(20)]
        rows.append((i, " ".join(rng.choice(words, 40))))
    rows += [r for r in EDGE if r[0] != 6]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    counts = Counter()
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    for i, t in rows:
        if not out(i):
            counts.update(WORD.findall(fold(t or "")) + [None])
    n, v = sum(counts.values()), len(counts)
    got = hmm.score_documents(df, states=2).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, t in rows:
        toks = WORD.findall(fold(t or "")) + [None]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks)
        want[(i, out(i), len(toks), sum(counts[w] > 0 for w in toks), n, round(base, 6))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id >= 20]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert hmm.score_documents(empty).count() == 0


def test_hmm_words_emit_for_themselves(spark, monkeypatch):
    """Two kinds of text that differ in rare words only, against one recursion over plain lists."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{k}" for k in rng.integers(0, 1500, 60))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r.doc_id: r for r in hmm.score_documents(df, states=2).collect()}
    monkeypatch.setattr(hmm, "HEAD", 700)  # now most words are joined
    for r in hmm.score_documents(df, states=2).collect():
        assert math.isclose(r.base_score, whole[r.doc_id].base_score, rel_tol=1e-9)
    held = [r for r in whole.values() if r.held_out]
    gain = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    assert gain > 0.1  # decimal digits a token; classes of hashed words gave less
    # Probabilities of all words and one unseen word sum to 1 in every state, and the shares give the corpus counts back.
    sums = rng.random((40, 3)) * 9
    n = sums.sum()
    weights = hmm.Weights(None, None, sums, sums.sum(axis=0), n, 40)
    emits = weights.emits(np.concatenate([sums, np.zeros((1, 3))]))
    assert np.allclose(emits.sum(axis=0), 1) and np.allclose(emits[:40] @ weights.share, (sums.sum(axis=1) + 0.1) / (n + 4.1))
    assert np.allclose(emits[40], 0.1 / (n + 4.1))


def test_hmm_counts_starts_of_texts_only():
    weights = hmm.Weights(np.full(2, 0.5), np.full((2, 2), 0.5), np.ones((2, 2)), np.full(2, 2.0), 4, 2)
    shared = type("Shared", (), {"value": weights})
    ids = np.r_[np.ones(1500), 0].astype("<u4").tobytes()
    kind = pa.list_(pa.struct([("place", pa.int32()), ("id", pa.int64()), ("s0", pa.float64()), ("s1", pa.float64())]))
    batch = pa.RecordBatch.from_arrays(
        [pa.array([1, 2]), pa.array([1501, 1501]), pa.array([pa.compress(ids, codec="zstd", asbytes=True)] * 2), pa.array([None, []], kind)],
        ["_row", "n_tokens", "ids", "tail"])
    out = {r["id"]: r for b in hmm._expect(shared)([batch]) for r in b.to_pylist()}
    assert math.isclose(out[-1]["s0"] + out[-1]["s1"], 2, rel_tol=1e-4)  # one start a text, however long
    moves = sum(out[k][c] for k in (-4, -5) for c in ("s0", "s1"))
    assert math.isclose(moves, 3000, rel_tol=1e-4)


def test_near_duplicates_and_leaks_on_repeated_and_null_ids(spark):
    text = lambda c: " ".join(f"{c}{k}" for k in range(30))
    rows = [(1, text("a")), (5, text("a") + " more"), (5, text("b")), (5, text("b")), (5, text("c")), (7, text("c")),
            (8, text("d")), (8, ""), (9, text("b"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = Counter((r.doc_id, r.text) for r in jaccard.keep_one(df).collect())
    assert kept == Counter([(1, text("a")), (5, text("b")), (5, text("c")), (8, text("d")), (8, "")])  # least id of each component
    bench = spark.createDataFrame([(None, text("b")), (None, text("d")), (3, text("c")), (4, text("b"))], "item_id long, text string")
    for block_words in (1_000_000, 5):
        left = {(r.doc_id, r.text) for r in decontamination.remove_contaminated(df, bench, block_words=block_words).collect()}
        assert left == {(1, text("a")), (5, text("a") + " more"), (8, "")}
        single = df.filter("doc_id in (1, 7, 9)").unionByName(df.filter("doc_id = 8 and text <> ''"))
        got = {r.doc_id: (r.n_hit, list(r["items"])) for r in decontamination.find_contamination(single, bench, block_words=block_words).collect()}
        assert got == {1: (0, []), 7: (30, ["3"]), 8: (30, []), 9: (30, ["4"])}


def test_toxicity_chain(spark, docs, empty):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(300):
        words = [f"calm{k}" for k in rng.integers(0, 60, 30)]
        if i % 5 == 0:
            words[3] = "vilescum"
        rows.append((1000 + i, " ".join(words)))
        labels.append((1000 + i, 1, int(i % 5 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels[:200] + [(None, 1, 1), (1001, None, 0)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(df, marks, {"low_quality": "quality = 0", "toxic": "toxic = 1"})
    kept = {r.doc_id for r in toxicity.keep_clean(df, chain).collect()}
    assert kept == {d for d, _, t in labels if not t}  # held-out rows too
    assert toxicity.score(docs, chain).count() == len(EDGE) and toxicity.score(empty, chain).count() == 0
    none = toxicity.fit(df, marks.limit(0), {"toxic": "toxic = 1"})
    assert toxicity.keep_clean(docs, none).count() == len(EDGE)
    assert toxicity.keep_clean(docs, chain).columns == docs.columns


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def pattern_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                    "card": 13 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append((k, m.start(), m.end()))
    return out


def test_pii_base_spans():
    alphabet = list("a1.@+- ()45") + ["4111 1111 1111 1111", "10.0.0.255", "x@y.co", "+49 (30) 1234567"]
    rng = np.random.default_rng(6)
    for _ in range(3000):
        text = "".join(rng.choice(alphabet, int(rng.integers(1, 25))))
        assert pii.base_spans(text) == pattern_spans(text), text
    assert len(pii.base_spans("9" * 200_000 + "a@" * 50_000)) == 0  # linear on long runs


def test_pii_field_spreads_labels(spark, docs, empty):
    rows = [(i, f"call +49 30 55501{i:02d}7 or write u{i}@mail.example.com from 10.0.0.{i}. Room {i} of 12, bill 4512.") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    field = pii.fit(df)
    assert field.trained
    found = pii.find(df, field).collect()
    for r in found:
        base = [(s.kind, s.start, s.end) for s in r.base]
        assert base == [(pii.KINDS[k], a, b) for k, a, b in pattern_spans(rows[r.doc_id][1])]
        assert set(base) <= {(s.kind, s.start, s.end) for s in r.spans}
    assert pii.find(docs, field).count() == len(EDGE) and pii.find(empty, pii.fit(empty)).count() == 0
    masked = {r.doc_id: r for r in pii.mask(df, field).collect()}
    assert "<EMAIL>" in masked[3].text and "@" not in masked[3].text and masked[3].text.endswith("bill 4512.")


def exact_beliefs(field, g):
    """Marginals by summing over all labellings of units and hubs."""
    import itertools

    n = len(g.spans)
    score = field.scores(g.features)
    out = np.zeros((n, pii.LABELS))
    for y in itertools.product(range(pii.LABELS), repeat=n + g.hubs):
        e = sum(score[i, y[i]] if not g.labels[i] else pii.EVIDENCE * (1 if y[i] == g.labels[i] else -1) for i in range(n))
        e += sum(field.pairs[0][y[a], y[b]] for a, b in g.chain) + sum(field.pairs[1][y[n + h], y[i]] for h, i in g.skip)
        out[range(n), y[:n]] += np.exp(e - 40)
    return out / out.sum(axis=1, keepdims=True)


def test_pii_beliefs_match_exact_sums():
    rng = np.random.default_rng(3)
    field = pii.Field()
    field.unary = rng.normal(size=field.unary.shape)
    field.pairs = [rng.normal(size=(5, 5)), 2 * rng.normal(size=(5, 5))]
    for text in ("x a1@b.co y A1@b.co z", "4111 1111 1111 1111 or 4111.1111.1111.1111 7", "77 88 99 word 5", "nothing"):
        g = pii.Graph()
        g.add(0, text, pii.base_spans(text))
        if g.spans:  # no loops: message passing is exact
            assert np.abs(field.beliefs(g) - exact_beliefs(field, g)).max() < 0.01, text
    # A loop (two keys, two units): the most likely labels agree.
    g = pii.Graph()
    text = "+49 30 5550107 or 49/305550107"
    g.add(0, text, pii.base_spans(text))
    assert g.hubs == 2 and len(g.skip) == 4
    assert (field.beliefs(g).argmax(axis=1) == exact_beliefs(field, g).argmax(axis=1)).all()


def test_pii_field_finds_rewritten_repeats(spark):
    rng = np.random.default_rng(11)

    def card():
        d = [int(x) for x in rng.integers(0, 10, 15)]
        return next(s for s in ("".join(map(str, [*d, c])) for c in range(10)) if pii.luhn(s))

    def text(repeat, others=True):
        c, tail = card(), int(rng.integers(1_000_000, 9_999_999))
        ip = ".".join(str(x) for x in rng.integers(11, 250, 4))
        name = f"max{int(rng.integers(10, 99))}@mail.example.com"
        parts = [f"paid with {c[:4]} {c[4:8]} {c[8:12]} {c[12:]} on day {int(rng.integers(1, 29))}", f"call +49 30 {tail}",
                 f"from {ip} at 10:45", f"write {name} now", "words " * int(rng.integers(5, 300))]
        new = [f"{c[:4]}.{c[4:8]}.{c[8:12]}.{c[12:]}", f"030/{tail}", ip.replace(".", "-"), name.replace("@", "(at)")] if repeat else []
        other = card()
        decoys = ["1-2-3-4", "2024-05-06"]
        if others:  # the same writing of other numbers
            decoys += [f"{other[:4]}.{other[4:8]}.{other[8:12]}.{other[12:]}", f"030/{(tail + 1234567) % 9999999}"]
        order = [*parts, *new, *decoys]
        return " and then ".join(order[k] for k in rng.permutation(len(order))), new

    train = spark.createDataFrame([(i, text(False, False)[0]) for i in range(300)], "doc_id long, text string")
    field = pii.fit(train)
    told = [text(i % 2 == 0) for i in range(300)]
    base, spans = pii.all_spans([t for t, _ in told], field)
    found = planted = wrong = 0
    for (t, new), b, s in zip(told, base, spans):
        assert set(b) <= set(s)
        added = [t[x:y] for _, x, y in set(s) - set(b)]
        found += sum(any(n == w for w in added) for n in new)
        wrong += sum(w not in new for w in added)
        planted += len(new)
    assert found >= 0.9 * planted and wrong <= 0.01 * planted, (found, planted, wrong)
    # Evidence reaches every repeat, however many there are.
    t, new = told[0]
    many = t + (" word word " + new[0]) * 40
    assert sum(many[x:y] == new[0] for _, x, y in pii.all_spans([many], field)[1][0]) >= 41


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, sf)
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == before.columns and 0 < docs.count() <= before.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "packing"]
    assert docs.count() >= 1


def test_keep_one_with_any_column_names(spark):
    ship(spark)
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, 7, "x", 3, "y"), (2, text, 7, "x", 3, "z"), (3, "other words here that no one else has", 7, "x", 3, "y"),
            (3, text + " but not the same at all as before this", 7, "x", 3, "y"), (None, text, 1, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id long, _set string, _mark_spot int, c0 string")
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns and kept.dtypes == df.dtypes
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted((rows[0], *rows[2:]), key=str)
