"""Fixture derivations agree with the counts stated in FIXTURES.md (sf0.01)."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_MID, SF_SMALL
from tessera.functions import metrics as M
from tessera.plans.fixtures import f1_sequences, f2_prompts


def test_stated_counts(spark):
    q = E.queries()
    n_tokens = f1_sequences(spark, SF_MID).select(F.sum(F.size("steps"))).first()[0]
    assert n_tokens == 45948
    assert f2_prompts(spark, SF_MID).count() == 233
    st = q["qa_split_stats"](spark, SF_MID).first()
    assert (st["questions"], st["no_correct"], st["positives"], st["negatives"]) == (14743, 3681, 8864, 7271)
    assert q["similarity_pairs"](spark, SF_MID).where("ok").count() == 499
    assert q["auc_ap"](spark, SF_MID).first()["auc"] == pytest.approx(0.49899, abs=5e-6)


def test_prompt_is_split_once(spark):
    plan = f2_prompts(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<end> <model>") == 1


def test_answer_values_are_taken_once(spark):
    for metric in (M.sequence_ppl, M.sequence_mean_ll, M.sequence_cme):
        assert str(metric(F.col("steps"), F.col("n"))).count("slice(") == 1
