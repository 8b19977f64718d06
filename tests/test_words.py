import random

import pytest

from tessera.operators.words import word_units

ALPHABET = ["a", "b", " ", "  ", "Ġx", "\n", "\t", " c", "", "　", "\x1c", "é", "😀", " \n"]


def units(spark, seqs):
    rows = [(i, p, t, float(p)) for i, toks in enumerate(seqs) for p, t in enumerate(toks)]
    df = spark.createDataFrame(rows, "k int, pos int, token string, value double")
    out = {}
    for r in word_units(df, ["k"]).orderBy("k", "index").collect():
        out.setdefault(r["k"], []).append((r["text_unit"], r["value"]))
    return [out.get(i, []) for i in range(len(seqs))]


def test_words_by_hand(spark):
    got = units(spark, [
        ["a", "b", " c", "d"],         # a blank starts a word
        [" ", " a", "b"],              # a blank run does not end a word before it has text
        ["a", " ", " ", "b"],          # the second blank joins the run
        ["a", "Ġb", "\n", "c", "\td"],  # the other word starts
        ["", "a", "", " "],
        [" ", "\n"],
        [],
    ])
    assert got == [
        [("ab", 0.5), (" cd", 2.5)],
        [("  ab", 1.0)],
        [("a", 0.0), ("  b", 2.0)],
        [("a", 0.0), ("Ġb", 1.0), ("\nc", 2.5), ("\td", 4.0)],
        [("a", 1.0), (" ", 3.0)],
        [(" \n", 0.5)],
        [],
    ]


def test_word_properties(spark):
    rng = random.Random(7)
    seqs = [[rng.choice(ALPHABET) for _ in range(rng.randint(0, 12))] for _ in range(300)]
    for toks, words in zip(seqs, units(spark, seqs)):
        assert "".join(w for w, _ in words) == "".join(toks)
        assert all(w.strip() for w, _ in words[:-1])  # only the last word may be blank
        assert all(w[0] in " Ġ\n\t" for w, _ in words[1:])
        if words and len(words) == 1:
            assert words[0][1] == pytest.approx((len(toks) - 1) / 2)


def test_several_metrics_in_one_pass(spark):
    """The units of every metric as by name, from steps that the plan makes and explodes once."""
    import __spark_entry__ as E
    from conftest import SF_SMALL, step
    from tessera.functions.steps import STEP
    from tessera.operators.by_name import apply_metric, apply_metrics
    from tessera.plans.evaluators import NAMED

    toks = [" a", "b", " ", "", "\n", "c ", "d", " e", "", " "]
    rows = [(k, s, p, step(-0.1 * (p + k + 1), -1.0, -2.5, tok=t)) for k in (1, 2) for s in ("context", "answer") for p, t in enumerate(toks[k:])]
    rows += [(3, "answer", 0, step(-0.5, tok="")), (None, "answer", 4, step(-0.5, -0.7, tok="x"))]
    seg = spark.createDataFrame(rows, f"eval_id int, segment string, pos int, step {STEP.simpleString()}")
    cols = ["metric", "eval_id", "segment", "idx", "text_unit"]
    got = {tuple(r[c] for c in cols): r["value"] for r in apply_metrics(seg, NAMED).collect()}
    want = {(n, *(r[c] for c in cols[1:])): r["value"] for n in NAMED for r in apply_metric(seg, n).collect()}
    assert got.keys() == want.keys() and len(want) > 3 * len(rows)
    for k, v in want.items():
        assert abs(got[k] - v) < 1e-12, k
    plan = E.queries()["scores_by_metric"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate posexplode") == 1
