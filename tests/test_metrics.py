import math

import pytest
from pyspark.sql import functions as F

from conftest import step
from tessera.functions import metrics as M
from tessera.functions.steps import SEQ


SEQS = [
    [step(-0.1, -2.0, -3.0), step(-1.0), step(-9999.0, -0.5), None, [], step(-0.2, -0.2, -0.2, -0.2)],
    [step(-9999.0, -9999.0)],
    [],
]


@pytest.fixture(scope="module")
def seqs(spark):
    rows = [(i, s) for i, s in enumerate(SEQS)]
    return spark.createDataFrame(rows, f"id int, steps {SEQ.simpleString()}")


def test_token_entropy_closed_forms(spark, seqs):
    got = {r["id"]: [u["value"] for u in r["u"]] for r in seqs.select("id", M.token_entropy(F.col("steps")).alias("u")).collect()}
    # four equal alternatives: 1; a sure one: 0; one alternative: exactly 0; null and empty steps are dropped
    assert len(got[0]) == 4 and got[0][1] == 0.0 and got[0][2] == pytest.approx(0.0, abs=1e-12) and got[0][3] == pytest.approx(1.0)
    assert got[1] == pytest.approx([1.0]) and got[2] == []
    half = spark.createDataFrame([(0, [step(math.log(0.75), math.log(0.25)), step(math.log(0.075), math.log(0.025))])], f"id int, steps {SEQ.simpleString()}")
    h = 2.0 - 0.75 * math.log2(3.0)  # entropy of (3/4, 1/4) in bits; scaling all alternatives changes nothing
    assert [u["value"] for u in half.select(M.token_entropy(F.col("steps")).alias("u")).first()["u"]] == pytest.approx([h, h])


def test_token_ll_nll_inflection(seqs):
    r = seqs.where("id = 0").select(
        M.token_ll(F.col("steps")).alias("ll"), M.token_nll(F.col("steps")).alias("nll"),
        M.token_inflection(F.col("steps")).alias("inf"),
    ).first()
    ll = [u["value"] for u in r["ll"]]
    assert ll == [-0.1, -1.0, -9999.0, -0.2]
    assert [u["value"] for u in r["nll"]] == [0.1, 1.0, 9999.0, 0.2]
    inf = [u["value"] for u in r["inf"]]
    assert inf[0] is None and inf[1:] == pytest.approx([-0.9, -9998.0, 9998.8])
    assert [u["index"] for u in r["ll"]] == [0, 1, 2, 3]


def test_sequence_values_by_hand(spark, seqs):
    def values(prefix, df=seqs):
        rows = df.select(
            "id", M.sequence_ppl(F.col("steps"), F.lit(prefix)).alias("ppl"), M.sequence_cme(F.col("steps"), F.lit(prefix)).alias("cme")
        ).collect()
        return {r["id"]: (r["ppl"], r["cme"]) for r in rows}

    # only the last step of row 0 counts: logprob -0.2, four equal alternatives
    assert values(5)[0] == pytest.approx((math.exp(0.2), math.log(4)))
    assert values(3)[0] == pytest.approx((math.exp(0.2), math.log(4)))  # null and empty steps count for nothing
    assert values(2)[0][0] == math.inf  # exp of 9999.2 / 2
    assert values(6)[0] == (math.inf, math.inf) and values(0)[2] == (math.inf, math.inf)
    # halves and quarters: geometric mean of probabilities, mean entropy
    two = spark.createDataFrame(
        [(7, [step(math.log(0.5), math.log(0.5)), step(math.log(0.125), *[math.log(0.125)] * 7)])], f"id int, steps {SEQ.simpleString()}"
    )
    assert values(0, two)[7] == pytest.approx((4.0, (math.log(2) + math.log(8)) / 2))


def test_registry_rejects_duplicates():
    with pytest.raises(RuntimeError):
        M.register("token_ll", M.token_ll)
    with pytest.raises(ValueError):
        M.register("other", M.step_ll, kind="page")
    with pytest.raises(KeyError):
        M.get_metric("none")
    assert set(M.METRICS) >= {"token_ll", "token_nll", "token_entropy", "word_mean_entropy"}


@pytest.fixture()
def user_metrics():
    M.register("alternatives", lambda step: F.size(step).cast("double"))
    M.register("rise", M.token_inflection, kind="sequence")
    M.register("word_alternatives", lambda step: F.size(step).cast("double"), kind="word")
    yield
    for name in ("alternatives", "rise", "word_alternatives"):
        del M.METRICS[name]


def test_user_metric_in_every_form(spark, user_metrics):
    from tessera.operators.by_name import apply_metric, apply_to_sequences, parted_scores

    steps = [step(-1.0, -2.0, tok="a"), step(-3.0, tok="b"), None, [], step(-0.5, -1.0, -2.0, tok=" c")]
    rows = spark.createDataFrame([(1, steps), (2, [])], f"eval_id long, steps {SEQ.simpleString()}")
    seg = spark.createDataFrame(
        [(1, "context", i, s) for i, s in enumerate(steps) if s] + [(1, "answer", 9, step(-2.0, tok="z"))],
        f"eval_id long, segment string, pos int, step {SEQ.simpleString()[6:-1]}",
    )
    want = {
        "alternatives": [("a", 2.0), ("b", 1.0), (" c", 3.0)],
        "rise": [("a", None), ("b", -2.0), (" c", 2.5)],
        "word_alternatives": [("ab", 1.5), (" c", 3.0)],
        "token_ll": [("a", -1.0), ("b", -3.0), (" c", -0.5)],
    }
    for name, units in want.items():
        from_rows = [(r["text_unit"], r["value"]) for r in apply_to_sequences(rows, name).orderBy("idx").collect()]
        by_segment = apply_metric(seg, name)
        got = [(r["text_unit"], r["value"]) for r in by_segment.where("segment = 'context'").orderBy("idx").collect()]
        assert from_rows == units and got == units, name
        wide = parted_scores(by_segment).first()
        assert [(u["text_unit"], u["value"]) for u in wide["context"]] == units and len(wide["answer"]) == 1
