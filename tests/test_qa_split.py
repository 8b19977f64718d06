from pyspark.sql import functions as F

from conftest import SF_MID
from tessera.operators import qa_split as Q
from tessera.plans.qa import f3_answers


def test_split_invariants(spark):
    ans = f3_answers(spark, SF_MID)
    flat = Q.flat_generations(ans)
    per_q = ans.groupBy(*Q.QKEY).agg(
        F.sum(F.col("label")).alias("c"), F.sum(1 - F.col("label")).alias("w")
    )
    got = flat.groupBy(*Q.QKEY).agg(
        F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"),
        F.max(F.col("answer_idx") == F.col("reference_answer_idx")).alias("ref_in"),
    )
    j = per_q.join(got, Q.QKEY, "left").collect()
    for r in j:
        if r["c"] <= 1:
            assert r["p"] is None
        else:
            assert r["p"] == r["c"] - 1 and r["n"] == min(r["w"], r["c"] - 1) and not r["ref_in"]
    assert flat.count() == 16135


def test_explode_items(spark):
    item = {"idx": 7, "passage": {"text": "P", "questions": [
        {"idx": 1, "question": "q", "answers": [
            {"idx": 1, "text": "a", "label": 1}, {"idx": 2, "text": "b", "label": 1},
            {"idx": 3, "text": "c", "label": 0}, {"idx": 4, "text": "d", "label": 0}]},
        {"idx": 2, "question": "r", "answers": [{"idx": 1, "text": "x", "label": 0}]},
    ]}}
    from tessera.sources.io import ITEM
    df = spark.createDataFrame([(item["idx"], item["passage"], None)], ITEM)
    flat = Q.flat_generations(Q.explode_items(df)).collect()
    assert sorted(r["label"] for r in flat) == [0, 1]
    nested = Q.nested_questions(Q.explode_items(df)).collect()
    assert len(nested) == 1 and len(nested[0]["generation_correct"]) == 1


def test_items_file_to_flat_rows(spark, tmp_path):
    import json

    from tessera.sources import io

    p = tmp_path / "items.jsonl"
    item = {"idx": 3, "passage": {"text": "P", "questions": [{"idx": 1, "question": "q", "answers": [
        {"idx": i, "text": f"a{i}", "label": int(i < 3)} for i in range(6)]}]}}
    p.write_text(json.dumps(item) + "\n")
    items, bad = io.read_items(spark, str(p))
    flat = Q.flat_from_items(items).collect()
    assert bad.count() == 0
    assert sorted(r["label"] for r in flat) == [0, 0, 1, 1]
    ref = {r["reference_answer_idx"] for r in flat}
    assert len(ref) == 1 and ref.pop() not in {r["answer_idx"] for r in flat}


def test_embed_instruct(spark):
    from pyspark.sql import functions as F

    from tessera.operators.prompts import embed_instruct

    r = spark.createDataFrame([("hello",)], "t string").select(embed_instruct("Find answers", F.col("t")).alias("x")).first()
    assert r["x"] == "Instruct: Find answers\nQuery:hello"
