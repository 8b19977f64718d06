import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import perturb as B


def n_words(text):
    """Words counted sentence by sentence (a sentence ends with its full stop)."""
    *closed, rest = text.split(".")
    return sum(len(f"{s}.".split()) for s in closed) + len(rest.split())


def chunks_of(spark, texts):
    df = spark.createDataFrame(texts, "k int, masked_text string")
    out = {}
    for r in B.sentence_chunks(df, "k").orderBy("k", "chunk_no").collect():
        assert r["n_masks"] == r["text"].count("<mask>")
        out.setdefault(r["k"], []).append(r["text"])
    return out


def test_chunks_by_hand(spark):
    w = lambda n: " ".join(["w"] * n)
    got = chunks_of(spark, [
        (1, f"{w(100)}. {w(98)}. {w(5)}."),        # 198 words stay below 200, the next sentence does not fit
        (2, f"{w(100)}. {w(100)}."),               # 200 is not below 200
        (3, f"{w(250)}. a <mask>."),               # a long sentence stands alone
        (4, w(300)),                               # no full stop
        (5, ""),
        (6, "a.b.c"),
    ])
    assert got[1] == [f"{w(100)}. {w(98)}.", f" {w(5)}."]
    assert got[2] == [f"{w(100)}.", f" {w(100)}."]
    assert got[3] == [f"{w(250)}.", " a <mask>."]
    assert got[4] == [w(300)] and 5 not in got and got[6] == ["a.b.c"]


def test_chunk_properties(spark):
    rng = random.Random(1)
    texts = []
    for i in range(60):
        parts = [" ".join("w" for _ in range(rng.randint(0, 70))) + rng.choice([".", ". ", "", "<mask>."]) for _ in range(rng.randint(0, 40))]
        texts.append((i, "".join(parts)))
    got = chunks_of(spark, texts)
    for k, text in texts:
        pieces = got.get(k, [])
        assert "".join(pieces) == text
        for here, after in zip(pieces, pieces[1:]):
            one_sentence = "." not in here[:-1]
            first_after = after[: after.index(".") + 1] if "." in after else after
            assert here.endswith(".") and (n_words(here) < 200 or one_sentence)
            assert n_words(here) + n_words(first_after) >= 200  # it was full


def test_draw_edge_cases(spark):
    rows = [
        # all blank -> the first candidate, stripped
        (1, 0, 0, "  ", 0.5), (1, 0, 1, "\t", 0.5),
        # all scores 1.0 -> uniform over non-blank
        (2, 0, 0, " a", 1.0), (2, 0, 1, "b ", 1.0), (2, 0, 2, " ", 1.0),
        # one candidate only
        (3, 0, 0, " only ", 0.2),
    ]
    c = spark.createDataFrame(rows, "k int, mask_no int, cand_no int, token_str string, score double")
    d = {r["k"]: r["draw"] for r in B.inverse_prob_draws(c, "k").collect()}
    assert d[1] == "" and d[3] == "only" and d[2] in {"a", "b"}


def test_masking_and_apply(spark):
    units = [(1, i, t, v) for i, (t, v) in enumerate([("A", 0.1), (" b", 0.9), (" c", 0.9), (" d", 0.5)])]
    u = spark.createDataFrame(units, "k int, index int, text_unit string, value double")
    ranked = B.rank_units(u, "k", 2)
    t = B.masked_texts(ranked, "k").first()
    assert t["masked_text"] == "A<mask><mask> d" and t["masked_idx"] == [1, 2]
    asc = B.masked_texts(B.rank_units(u, "k", 1, ascending=True), "k").first()
    assert asc["masked_text"] == "<mask> b c d"
    cands = spark.createDataFrame([(1, 0, 0, " X", 0.1)], "k int, mask_no int, cand_no int, token_str string, score double")
    out = B.apply_draws(ranked, B.inverse_prob_draws(cands, "k"), "k").first()
    # the second mask has no draw and stays
    assert out["context"] == "AX<mask> d" and dict(out["change_set"]) == {1: "X"}
    kept = B.perturb(u, cands, "k", 2).first()
    assert kept["context"] == "AX<mask> d"  # partly drawn: kept, with the mask that has no draw
    assert B.perturb(u, cands.limit(0), "k", 2).first()["context"] == "A<mask><mask> d"  # no candidates, but no failure either
    failed = spark.createDataFrame([(1, False, "x")], "k int, ok boolean, error string")
    assert B.perturb(u, cands, "k", 2, status=failed).count() == 0


def test_chain_from_units_to_context(spark):
    long = [(" w" if i else "w") + f"{i}" + ("." if i % 120 == 119 else "") for i in range(400)]
    texts = {1: (["A", " b", " c.", " d"], [0, 2]), 2: (long, [1, 300]), 3: (["x", " y"], []), 4: (["no", " luck", " at", " all"], [1, 2]), 5: (long, [5, 250, 251])}
    units = [(k, i, t, 1.0 if i in m else 0.0) for k, (ts, m) in texts.items() for i, t in enumerate(ts)]
    u = spark.createDataFrame(units, "k int, index int, text_unit string, value double").where("k != 3 or index >= 0")
    seen = spark.sparkContext.accumulator(0)

    def factory():
        def fn(rec):
            seen.add(1)
            n = rec["text"].count(B.MASK)
            assert n > 0
            if "luck" in rec["text"] or "no" in rec["text"]:
                raise OSError("model is gone")
            return [[(f" <{j}>", 0.5), ("  ", 0.1)] for j in range(min(n, 1))]  # never more than one answer a chunk

        return fn

    def chain(keys, n):
        part = u.where(F.col("k").isin(keys))
        ptb, status = B.perturb_with_model(part, lambda c: B.fill_with_function(c, factory, "k"), "k", n)
        return {r["k"]: r for r in ptb.collect()}, {r["k"]: r for r in status.collect()}

    out, status = chain([1, 2, 4], 2)
    assert out[1]["context"] == "<0> b<mask> d" and dict(out[1]["change_set"]) == {0: "<0>"}  # partly drawn
    # Two chunks, a mask in each: masks are numbered over the whole text.
    assert dict(out[2]["change_set"]) == {1: "<0>", 300: "<0>"} and B.MASK not in out[2]["context"]
    assert 4 not in out and not status[4]["ok"] and status[4]["error"] == "OSError: model is gone" and status[1]["ok"]
    out, _ = chain([5], 3)
    assert dict(out[5]["change_set"]) == {5: "<0>", 250: "<0>"} and out[5]["context"].count(B.MASK) == 1
    out, status = chain([3], 0)  # nothing masked: no call, the text as it was
    assert out[3]["context"] == "x y" and status == {} and out[3]["change_set"] == {}


def test_only_chunks_with_masks_are_calls(spark):
    words = [(" w" if i else "w") + ("." if i % 50 == 49 else "") for i in range(1000)]
    u = spark.createDataFrame([(1, i, t, float(i == 990)) for i, t in enumerate(words)], "k int, index int, text_unit string, value double")
    ranked = B.rank_units(u, "k", 1)
    chunks = B.sentence_chunks(B.masked_texts(ranked, "k"), "k")
    calls = B.mask_calls(ranked, "k").collect()
    assert chunks.count() > 4 and len(calls) == 1 and calls[0]["n_masks"] == 1 and calls[0]["first_mask"] == 0
    text = calls[0]["text"]
    cache = spark.createDataFrame([(text, [[("t", 1.0)]]), ("other", [])], f"text string, masks {B.MASKS_TYPE}")
    hit = B.fill_with_table(B.mask_calls(ranked, "k"), cache, "k").first()
    assert hit["ok"] and hit["masks"][0][0]["token_str"] == "t"
    miss = B.fill_with_table(B.mask_calls(ranked, "k"), cache.where("text = 'other'"), "k").first()
    assert not miss["ok"] and miss["error"].startswith("KeyError")


def test_draw_frequencies_follow_inverse_weights(spark):
    # scores 0.1 / 0.3 / 0.6 -> weights 0.9 / 0.7 / 0.4 over 2.0
    base = spark.range(0, 20000).select(F.col("id").alias("k"))
    c = base.select(
        "k", F.lit(0).alias("mask_no"),
        F.explode(F.array(*[F.struct(F.lit(i).alias("cand_no"), F.lit(f" t{i}").alias("token_str"),
                                      F.lit(s).alias("score")) for i, s in enumerate([0.1, 0.3, 0.6])])).alias("c"),
    ).select("k", "mask_no", "c.*")
    d = B.inverse_prob_draws(c, "k")
    freq = {r["draw"]: r["count"] / 20000 for r in d.groupBy("draw").count().collect()}
    assert freq["t0"] == pytest.approx(0.45, abs=0.015)
    assert freq["t1"] == pytest.approx(0.35, abs=0.015)
    assert freq["t2"] == pytest.approx(0.20, abs=0.015)
