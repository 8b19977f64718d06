import __spark_entry__ as E
from conftest import SF_SMALL


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 17
    assert set(df.columns) == {"class_name", "metric", "value"}


def test_registry_consistent():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 70


def test_queries_run_on_smallest_sf(spark):
    q = E.queries()
    for name in ["token_entropy", "segment_tokens", "qa_split_flat", "perturb_join", "sentence_chunks", "auc_ap", "seeded_sample"]:
        q[name](spark, SF_SMALL).count()
