"""Training queries (T1-T7) on the F9 fixture. The models are trained on
Spark, not reproduced in SQL: SQL checks which rows are scored, with which
labels, and that every row has one distribution over the two classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import report as R
from tessera.operators import training as TR
from tessera.operators.sampling import stratified_split
from tessera.plans.reports import round_doubles
from tessera.plans.samples import F9_SQL, FEATURES, f9_rows, split_sql

_MODELS: dict[tuple[str, str, str], tuple] = {}
_SCORED: dict[tuple[str, str, str], DataFrame] = {}  # the models' scores of all test cells


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = stratified_split(TR.materialize(f9_rows(spark, sf_dir)), "id", "Y", TR.TEST_SHARE, TR.SEED)
    data = TR.materialize(TR.assemble(rows, FEATURES, "Y"))
    return data.where(~F.col("is_test")), data.where(F.col("is_test"))


def _fitted(spark: SparkSession, sf_dir: str, kind: str) -> tuple:
    """``model, best round, cells of train and test, test``: one fit per session and folder serves all queries of a model."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _MODELS:
        train, test = _split(spark, sf_dir)
        borders = TR.feature_borders(train, rows=None) if kind == "rf" else TR.feature_borders(train)
        learn, test = TR.cells(TR.binned(train, borders), "label"), TR.materialize(TR.binned(test, borders))
        test_cells = TR.cells(test, "label")
        if kind == "rf":
            found = TR.train_random_forest(learn, weight="weight"), None, None
        else:
            TR.check_features(test)
            found = *TR.train_gbt_to_best(learn, test_cells, weight="weight"), learn
        _MODELS[key] = *found, test_cells, test
    return _MODELS[key]


def _scored(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    model, best, _, test_cells, test = _fitted(spark, sf_dir, kind)
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _SCORED:
        one = TR.distinct_cells(test_cells)
        found = TR.predictions(model, one, "bins") if best is None else TR.predictions_at(model, best, one, "bins")
        _SCORED[key] = TR.materialize(found)
    return TR.score_cells(test, _SCORED[key])


def _predictions(kind: str):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        """T4: class probabilities of the test rows."""
        return round_doubles(_scored(spark, sf_dir, kind))

    return q


def _checked(kind: str):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        """T4: the scored rows, their labels, and whether their probabilities are a distribution."""
        p0, p1 = F.col("proba_class_0"), F.col("proba_class_1")
        sound = p0.between(0, 1) & p1.between(0, 1) & (F.abs(p0 + p1 - 1) < 1e-9)
        return _scored(spark, sf_dir, kind).select(
            F.col("eval_id").cast("bigint"), F.col("y_true").cast("bigint").alias("y_true"), sound.alias("sound")
        )

    return q


def _report(kind: str):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The whole report on the test predictions."""
        p = _scored(spark, sf_dir, kind).select(F.col("proba_class_1").alias("score"), F.col("y_true").alias("label"))
        return round_doubles(R.report_all(R.score_table(p)))

    return q


def _facts(kind: str):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        """For boosting also the best round on the eval set and its loss."""
        model, _, _, test, _ = _fitted(spark, sf_dir, kind)
        return round_doubles(TR.model_facts(model, test, valid=test if kind == "gbt" else None))

    return q


def q_gbt_iterations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: log-loss, AUC and F1 of learn and test rows after each boosting round."""
    model, _, train, test, _ = _fitted(spark, sf_dir, "gbt")
    rows = train.withColumn("part", F.lit("learn")).unionByName(test.withColumn("part", F.lit("test")))
    return round_doubles(TR.iteration_metrics(model, rows, weight="weight"))


QUERIES = {
    "rf_predictions": _predictions("rf"),
    "gbt_predictions": _predictions("gbt"),
    "rf_scored_rows": _checked("rf"),
    "gbt_scored_rows": _checked("gbt"),
    "gbt_iterations": q_gbt_iterations,
    "rf_report": _report("rf"),
    "gbt_report": _report("gbt"),
    "model_facts": _facts("rf"),
    "gbt_facts": _facts("gbt"),
}


def oracle() -> dict[str, str]:
    scored = "with " + F9_SQL + split_sql() + "select id::BIGINT as eval_id, y::BIGINT as y_true, true as sound from split"
    return {"rf_scored_rows": scored, "gbt_scored_rows": scored}
