import json
import os
import tempfile

from pyspark.sql import functions as F

from conftest import step
from tessera.functions.steps import SEQ, decode_prompt_steps, encode_steps, steps_valid
from tessera.sources import io


def test_steps_json_roundtrip_keeps_order_and_nulls(spark):
    raw = json.dumps([None, {}, {"9": {"decoded_token": "b", "logprob": -1.0, "rank": 2},
                                  "3": {"decoded_token": "a", "logprob": -0.5, "rank": 1}}])
    df = spark.createDataFrame([(raw,), ("not json",), ('[{"1": {"decoded_token": "x", "logprob": null, "rank": 1}}]',)], "j string")
    r = df.select(decode_prompt_steps(F.col("j")).alias("s")).withColumn("ok", steps_valid(F.col("s"))).collect()
    assert r[0]["s"][0] is None and r[0]["s"][1] is None
    assert [a["decoded_token"] for a in r[0]["s"][2]] == ["b", "a"]
    assert [x["ok"] for x in r] == [True, False, False]
    back = df.limit(1).select(encode_steps(decode_prompt_steps(F.col("j"))).alias("e")).first()["e"]
    again = df.sparkSession.createDataFrame([(back,)], "j string").select(decode_prompt_steps(F.col("j")).alias("s")).first()
    assert [a["logprob"] for a in again["s"][2]] == [-1.0, -0.5]


def test_items_quarantine_and_passages(spark):
    d = tempfile.mkdtemp(prefix="tessera-io-")
    with open(os.path.join(d, "items.jsonl"), "w") as f:
        f.write(json.dumps({"idx": 1, "passage": {"text": "t", "questions": []}}) + "\n")
        f.write("{broken\n")
        f.write(json.dumps({"idx": None, "passage": {"text": "kept whole", "questions": []}}) + "\n")
    items, bad = io.read_items(spark, os.path.join(d, "items.jsonl"))
    assert items.count() == 1 and items.columns == ["idx", "passage"]
    lines = {r["_corrupt_record"]: r["faults"] for r in bad.collect()}
    assert len(lines) == 2 and lines["{broken"] == ["line: malformed"] and any("kept whole" in x for x in lines)
    with open(os.path.join(d, "passages.json"), "w") as f:
        json.dump({"1": "one", "2": "two"}, f)
    p = {r["passage_id"]: r["passage"] for r in io.read_passages(spark, os.path.join(d, "passages.json")).collect()}
    assert p == {"1": "one", "2": "two"}


def test_logprobs_write_read(spark):
    d = tempfile.mkdtemp(prefix="tessera-io-")
    df = spark.createDataFrame(
        [(1, "p", 1, "q", "a", [None, step(-0.1, -2.0)], 1, True, None)],
        f"eval_id long, passage_id string, label int, question string, answer string, prompt_logprob {SEQ.simpleString()}, prefix_length int, ok boolean, error string",
    )
    io.write_logprobs(df, os.path.join(d, "lp"))
    back = io.read_logprobs(spark, os.path.join(d, "lp"), ["eval_id", "prompt_logprob", "prefix_length", "ok"]).first()
    assert back["prompt_logprob"][0] is None and back["prompt_logprob"][1][1]["logprob"] == -2.0
    assert back["steps_ok"]


def test_steps_with_function(spark):
    import time

    from tessera.operators.scoring import steps_with_function

    def factory():
        def fn(rec):
            if rec["x"] == "boom":
                raise ValueError("refused")
            if rec["x"] == "slow":
                time.sleep(1.5)
            return [None, [("a", -0.5, 1), ("b", -2.0, 2)]], 1

        return fn

    df = spark.createDataFrame([(1, "ok"), (2, "boom"), (3, "slow")], "eval_id long, x string")
    got = {r["eval_id"]: r for r in steps_with_function(df.coalesce(1), factory, "eval_id", ["x"], timeout=0.5).collect()}
    assert got[1]["ok"] and got[1]["prompt_logprob"][0] is None and got[1]["prompt_logprob"][1][1]["logprob"] == -2.0
    assert got[2]["error"] == "ValueError: refused" and got[3]["error"].startswith("TimeoutError") and got[3]["prefix_length"] == 0

    def batch_factory():
        return lambda recs: [([], 0) for r in recs]

    assert steps_with_function(df, batch_factory, "eval_id", ["x"], batch=True).where("ok").count() == 3
    out = tempfile.mkdtemp(prefix="tessera-io-") + "/lp"
    rows = spark.createDataFrame([(1, "p", 1, "q", "a")], "eval_id long, passage_id string, label int, question string, answer string")
    scored = steps_with_function(rows.withColumn("x", F.lit("ok")), factory, "eval_id", ["x"])
    io.write_logprobs(rows.join(scored, "eval_id"), out)
    assert io.read_logprobs(spark, out, ["eval_id", "prompt_logprob"]).first()["steps_ok"]


def test_a_hung_call_delays_no_other():
    import threading
    import time

    from tessera.operators.scoring import calls_in_flight

    free = threading.Event()

    def fn(x):
        if x == "hung":
            free.wait()
        if x == "slow":
            time.sleep(0.25)
        if x == "bad":
            raise KeyError(x)
        return x

    items = ["hung", "slow", "bad", *range(40)]
    t0, order, late = time.monotonic(), [], {}
    for item, value, error in calls_in_flight(fn, iter(items), 2, 1.0):
        order.append(item)
        late[item] = time.monotonic() - t0, value, error
    free.set()
    assert sorted(map(str, order)) == sorted(map(str, items))
    assert order[-1] == "hung" and late["hung"][2].startswith("TimeoutError") and late["hung"][0] < 1.5
    assert late[39][0] < 0.9 and late[39][1:] == (39, None) and late["bad"][2] == "KeyError: 'bad'"
    # Each call has its own time: the second hung call starts when the first one's place is free.
    free.clear()
    t0 = time.monotonic()
    got = [(i, round(time.monotonic() - t0, 1)) for i, _, e in calls_in_flight(fn, ["hung", "hung"], 1, 0.3) if e]
    free.set()
    assert [g[0] for g in got] == ["hung", "hung"] and 0.5 <= got[1][1] <= 0.9
    assert list(calls_in_flight(fn, [], 3, None)) == []


def test_results_of_any_type_by_two_keys(spark):
    from tessera.operators.scoring import results_with_function

    def factory():
        return lambda r: [[("x", 0.5)], []] if r["b"] else 1 / 0

    df = spark.createDataFrame([(1, "p", 1), (2, "q", 0)], "a long, k string, b int")
    out = results_with_function(df, factory, ["a", "k"], ["b"], "m array<array<struct<t:string,s:double>>>",
                                lambda v: {"m": [[{"t": t, "s": s} for t, s in x] for x in v]})
    got = {r["a"]: r for r in out.collect()}
    assert got[1]["m"][0][0]["s"] == 0.5 and got[1]["m"][1] == [] and got[1]["ok"] and got[1]["k"] == "p"
    assert got[2]["m"] is None and not got[2]["ok"] and got[2]["error"].startswith("ZeroDivisionError")


def test_faults_inside_items(spark, tmp_path):
    def item(**answer):
        return {"idx": 1, "passage": {"text": "t", "questions": [{"idx": 0, "question": "q", "answers": [{"idx": 0, "text": "a", "label": 1}, {"idx": 1, "text": "b", **answer}]}]}}

    at = "passage.questions[0].answers[1]"
    cases = [
        (item(label=0), None), (item(label=None), None), (item(), None), (item(label=2), [f"{at}.label: not 1, 0 or null"]),
        (item(label="yes"), ["line: malformed"]), (item(text=None, idx=None), [f"{at}.idx: missing", f"{at}.text: missing"]),
        ({"idx": 1, "passage": {"text": None, "questions": [None]}}, ["passage.text: missing", "passage.questions[0]: missing"]),
        ({"idx": 1, "passage": {"text": "t", "questions": [{"idx": 2, "question": None, "answers": None}]}},
         ["passage.questions[0].question: missing", "passage.questions[0].answers: missing"]),
        ({"idx": 1, "passage": {"text": "t"}}, ["passage.questions: missing"]), ({"passage": None}, ["idx: missing", "passage: missing"]),
    ]
    lines = [json.dumps(c) for c, _ in cases]
    (tmp_path / "items.jsonl").write_text("\n".join(lines) + "\n\n")
    items, bad = io.read_items(spark, str(tmp_path / "items.jsonl"))
    assert items.count() == sum(f is None for _, f in cases)
    assert {r["_corrupt_record"]: r["faults"] for r in bad.collect()} == {line: f for line, (_, f) in zip(lines, cases) if f}


def test_evaluated_rows_in_one_pass(spark, tmp_path):
    rows = [(1, 1, True, 0.5, None), (2, 0, True, float("nan"), None), (3, 1, True, None, None), (4, 0, False, 0.1, 'bad "line"\nnext, line'), (5, 0, None, 0.2, "")]
    passes = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame(rows, "eval_id long, label int, ok boolean, score double, error string").repartition(1)
    counted = df.rdd.map(lambda r: (passes.add(1), r)[1])
    df = spark.createDataFrame(counted, df.schema)
    got = io.write_evaluated(df, "score", str(tmp_path / "kept"), str(tmp_path / "failed"))
    assert got == {"kept": 1, "failed": 4, "ok_rows": 3} and passes.value == len(rows)
    assert [r["eval_id"] for r in io.read_evaluated(spark, str(tmp_path / "kept")).collect()] == [1]
    back = {r["eval_id"]: r for r in io.read_failed(spark, str(tmp_path / "failed"), "eval_id long, label int, ok boolean, score double, error string").collect()}
    assert set(back) == {2, 3, 4, 5} and back[4]["error"] == 'bad "line"\nnext, line' and back[3]["score"] is None


def test_segment_files_round_trip_and_faults(spark, tmp_path):
    steps = [step(-0.1, -2.0, tok="a"), step(-0.3, tok=" é")]
    seq = f"{SEQ.simpleString()}"
    df = spark.createDataFrame([(1, steps, [], steps, steps)], "eval_id long, " + ", ".join(f"{c} {seq}" for c in io.SEGMENTS))
    io.write_parted(df, str(tmp_path / "parted"))
    good, bad = io.read_parted(spark, str(tmp_path / "parted"))
    assert good.first().asDict(recursive=True) == df.first().asDict(recursive=True) and bad.count() == 0
    units = "array<struct<value:double,index:int,text_unit:string>>"
    scores = spark.createDataFrame([(1, [(0.5, 0, "a")], [], [], [(None, 0, "b")])], "eval_id long, " + ", ".join(f"{c} {units}" for c in io.SEGMENTS))
    io.write_scores(scores, str(tmp_path / "scores"))
    good, bad = io.read_scores(spark, str(tmp_path / "scores"))
    assert good.first().asDict(recursive=True) == scores.first().asDict(recursive=True) and bad.count() == 0
    raw = spark.createDataFrame([(1, "[]", "{oops", "[]", None)], "eval_id long, " + ", ".join(f"{c} string" for c in io.SEGMENTS))
    raw.write.parquet(str(tmp_path / "raw"))
    good, bad = io.read_parted(spark, str(tmp_path / "raw"))
    row = bad.first()
    assert good.count() == 0 and row["error"] == "context: no list of steps; answer: no list of steps" and row["context"] == "{oops"


def test_training_and_prediction_files(spark, tmp_path):
    import pytest

    spark.range(3).select(F.col("id").cast("double").alias("x"), F.lit(1).alias("Y")).write.parquet(str(tmp_path / "train"))
    assert io.read_training(spark, str(tmp_path / "train")).count() == 3
    spark.range(1).select(F.lit("a").alias("x"), F.lit(1).alias("Y")).write.parquet(str(tmp_path / "odd"))
    for path in ("train", "odd"):
        with pytest.raises(ValueError):
            io.read_training(spark, str(tmp_path / path), "x" if path == "odd" else "Z")
    pred = spark.createDataFrame([(1, 0.25, 0.75, 1)], "eval_id long, proba_class_0 double, proba_class_1 double, y_true int")
    io.write_predictions(pred, str(tmp_path / "pred"))
    assert io.read_predictions(spark, str(tmp_path / "pred")).collect() == pred.collect()


def test_step_files_have_short_row_groups(spark, tmp_path):
    """Spark reads thousands of rows at a time but never past a row group, so these must end by bytes."""
    import glob

    import pyarrow.parquet as pq

    steps = F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda i: F.array(F.struct(
        F.lit(" t").alias("decoded_token"), (-F.abs(F.xxhash64("id", i)) / 1e18).alias("logprob"), F.lit(1).alias("rank"))))
    rows = spark.range(500).coalesce(1).select(
        F.col("id").alias("eval_id"), F.lit("p").alias("passage_id"), F.lit(1).alias("label"), F.lit("q").alias("question"),
        F.lit("a").alias("answer"), steps.alias("prompt_logprob"), F.lit(3).alias("prefix_length"), F.lit(True).alias("ok"), F.lit(None).alias("error"))
    parted = rows.select("eval_id", *(F.col("prompt_logprob").alias(s) for s in io.SEGMENTS))
    for write, df in ((io.write_logprobs, rows), (io.write_parted, parted)):
        path = str(tmp_path / write.__name__)
        write(df, path)
        (name,) = glob.glob(f"{path}/*.parquet")
        meta = pq.read_metadata(name)
        groups = [meta.row_group(k) for k in range(meta.num_row_groups)]
        assert len(groups) > 1 and sum(g.num_rows for g in groups) == 500
        assert max(sum(g.column(c).total_uncompressed_size for c in range(g.num_columns)) for g in groups) < 64 << 20


def test_decoded_steps_are_not_written_again(spark, monkeypatch):
    """The mapping reads each prompt's JSON once: no checkpoint holds the decoded steps of all prompts."""
    from conftest import SF_SMALL
    from tessera.plans import files

    def stop(_df):
        raise AssertionError("decoded steps are checkpointed")

    monkeypatch.setattr(files, "materialize", stop)
    out = files.QUERIES["optional_top_logprob"](spark, SF_SMALL)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 2 and "Window" not in plan
