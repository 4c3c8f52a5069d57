import os

from lever.functions import store
from lever.plans import registry


def _left(folder):
    return [f for f in os.listdir(folder) if f.startswith("lever-")]


def test_written_rows_are_pruned_and_freed(spark):
    df = store.written(spark.range(100).selectExpr("id", "id * 2 AS twice"), "test")
    plan = df.select("twice")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<twice:bigint>" in plan and df.count() == 100
    folder = store.ensure_checkpoint_dir(spark).removeprefix("file:")
    assert _left(folder)
    assert store.release(spark) > 0 and not _left(folder)
    assert store.release(spark) == 0


def test_nothing_is_left_after_a_query(spark):
    """What the preparation and the ranking write goes once their rows have been read."""
    store.release(spark)
    folder = store.ensure_checkpoint_dir(spark).removeprefix("file:")
    for name in ("prepare_training_keyed", "segment_summary", "quantile_trim"):
        assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    assert _left(folder)
    store.release(spark)
    assert not _left(folder)
