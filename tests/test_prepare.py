"""The one-aggregate preparation job against the rules applied one after the other."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lever.operators import prep as P
from lever.plans import jobs as E
from lever.schema import SeriesSchema

SCHEMA = SeriesSchema(keys=("k",), time_col="t", product_col="prod", feature_cols=("y", "a", "b", "c"))
FEATS = list(SCHEMA.feature_cols)


def stepwise(df, codes, start, end, lo, hi, threshold):
    d = P.product_filter(P.forward_fill(df, SCHEMA), codes, "prod")
    d = P.drop_sparse_columns(d, ["k"], FEATS, threshold)
    d = P.end_date(P.start_date(d, start, "t"), end, "t")
    d = P.drop_zero_variance(d, ["k"], FEATS)
    kept = d.groupBy("k").agg(F.count("y").alias("n")).where("n > 0").select(F.col("k").alias("kk"))
    d = d.join(kept, d.k.eqNullSafe(kept.kk)).drop("kk")
    d = P.max_target(P.min_target(d, ["k"], "y", lo), ["k"], "y", hi)
    return P.drop_null_rows(d, FEATS, ["k"]).select("k", "t", *FEATS)


def test_equals_the_rules_one_by_one(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k in ["one", "two", "three", "four", "five", None]:
        for t in range(80):
            y = {"three": 500.0, "four": 3.0}.get(k, float(rng.integers(0, 100)))
            y = float(rng.integers(0, 9)) if k == "five" else y + (0 if k == "four" else rng.random())
            rows.append((k, t, "PQ"[t % 2], y, float(rng.random()) if t > (70 if k == "one" else 3) else None,
                         7.0 if k == "two" else float(rng.random()), None if k == "three" else float(t % 5)))
    df = spark.createDataFrame(rows, "k string, t int, prod string, y double, a double, b double, c double")
    for lo, hi in ((10.0, 90.0), (10.0, 50.0), (1000.0, -5.0)):
        args = (["P"], 5, 75, lo, hi, 0.3)
        want = stepwise(df, *args)
        got = E.prepare_training(df, SCHEMA, ["P"], "y", start=5, end=75, min_target=lo, max_target=hi)
        assert got.columns == ["k", "t", *FEATS]
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        out, report = E.prepare_training_with_report(df, SCHEMA, ["P"], "y", start=5, end=75, min_target=lo, max_target=hi,
                                                     exclude=["c"])
        seen = {(r.k, r.step): r for r in report.collect()}
        assert len(seen) == 6 * len(E.STEPS) and out.columns == ["k", "t", "y", "a", "b"]
        kept = {r.k: r.n for r in want.groupBy("k").agg(F.count("*").alias("n")).collect()}
        for k in ["one", "two", "three", "four", "five", None]:
            rows = [seen[k, step].n_rows for step in E.STEPS]
            assert rows[:4] == [40, 40, 35, 35] and rows[6] == rows[7] == kept.get(k, 0) and rows[4] >= rows[5] >= rows[6]
            cols = [seen[k, step].n_cols for step in E.STEPS]
            assert cols[0] == 4 and cols[1] == 4 - (k == "one") - (k == "three") and cols[6] - cols[7] == (k != "three")
            assert seen[k, "complete rows"].status == ("ok" if kept.get(k) else "no data")
        assert {r.k for r in got.select("k").distinct().collect()} >= {"one", "two", None}


def test_reads_the_source_twice_at_most(spark, tmp_path):
    pdf = pd.DataFrame({"k": ["a"] * 50, "t": range(50), "prod": "P", "y": np.arange(50.0), "a": np.arange(50.0), "b": 1.0, "c": 2.0})
    spark.createDataFrame(pdf).write.parquet(str(tmp_path / "s"))
    out = E.prepare_training(spark.read.parquet(str(tmp_path / "s")), SCHEMA, ["P"], "y", min_target=3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    # the source itself is not read again, only the filled rows as written, pruned to the columns in use
    assert "pytest-of" not in plan and plan.count("FileScan") <= 2 and plan.count("Exchange") <= 4
    assert out.count() == 47
