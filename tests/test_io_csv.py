import os
import tempfile

from pyspark.sql import functions as F

from tessera.operators import scoring as S
from tessera.sources import io


def test_qa_csv_roundtrip_multiline(spark):
    d = tempfile.mkdtemp(prefix="tessera-csv-")
    rows = [(0, "7", 1, 'q "quoted"\nsecond line', "ref, with comma", 2, "ans", 3, 1, "ctx", {5: "w"})]
    df = spark.createDataFrame(
        rows,
        "id long, passage_id string, question_idx int, question string, reference string, "
        "reference_answer_idx int, answer string, answer_idx int, label int, context string, change_set map<int,string>",
    )
    io.write_qa_csv(df, os.path.join(d, "qa"))
    back = io.read_qa_csv(spark, os.path.join(d, "qa"), perturbed=True).first()
    assert back["question"] == 'q "quoted"\nsecond line' and back["reference"] == "ref, with comma"
    assert back["change_set"] == '{"5":"w"}' and back["id"] == 0


def test_report_writer_and_failed_rows(spark):
    d = tempfile.mkdtemp(prefix="tessera-rep-")
    t1 = spark.createDataFrame([("Ложь", "precision", 0.5)], "class_name string, metric string, value double")
    t2 = spark.createDataFrame([(1.0, 0.25)], "threshold double, j double")
    io.write_report({"class_report": t1, "youden": t2}, os.path.join(d, "rep"))
    got = {(r["title"], r["name"]): r["value"] for r in spark.read.parquet(os.path.join(d, "rep")).collect()}
    assert got[("class_report", "Ложь|precision:value")] == 0.5 and got[("youden", ":j")] == 0.25
    rows = spark.createDataFrame([(1, True, None), (2, False, "ValueError: x")], "eval_id int, ok boolean, error string")
    io.write_failed(rows, os.path.join(d, "failed"))
    assert spark.read.option("header", True).csv(os.path.join(d, "failed")).count() == 1


def test_scorer_progress_accumulator(spark):
    acc = spark.sparkContext.accumulator(0)
    rows = spark.range(0, 300).select(F.col("id").alias("eval_id"), F.lit("q").alias("question"))

    def factory():
        def fn(rec):
            if rec["eval_id"] % 50 == 0:
                raise RuntimeError("boom")
            return rec["eval_id"] / 10

        return fn

    out = S.score_with_function(rows, factory, "eval_id", ["question"], progress=acc).collect()
    assert acc.value == 300
    bad = [r for r in out if not r["ok"]]
    assert len(bad) == 6 and bad[0]["error"] == "RuntimeError: boom"


def test_report_plan_bundle(spark):
    from tessera.operators.report import report_plan

    d = tempfile.mkdtemp(prefix="tessera-plan-")
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (float("inf"), 1)], "score double, label int")
    tables = report_plan(df)
    io.write_report(tables, os.path.join(d, "rep"))
    out = spark.read.parquet(os.path.join(d, "rep"))
    titles = {r["title"] for r in out.select("title").distinct().collect()}
    assert titles == set(tables)
    auc = out.where("title = 'auc_ap' and name = ':auc'").first()["value"]
    assert auc == 0.75
