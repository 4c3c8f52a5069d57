import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lever.operators import quantiles as Q

PROBS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.99, 1.0]


def frame(seed=0):
    r = np.random.default_rng(seed)
    parts = {"big": r.lognormal(0, 3, 9000), "ties": r.integers(0, 4, 5000).astype(float), "one": np.array([2.5]),
             "two": np.array([-1.0, 4.0]), "same": np.full(3000, 7.0), "neg": -r.normal(size=1100) * 1e9, None: r.normal(size=1500)}
    return pd.concat([pd.DataFrame({"k": k, "x": v, "z": r.permutation(v)}) for k, v in parts.items()], ignore_index=True)


def expected(pdf, col):
    out = {}
    for k, part in pdf.groupby(pdf.k.fillna("none")):
        for p, q in zip(PROBS, np.quantile(part[col], PROBS)):
            out[None if k == "none" else k, col, p] = q
    return out


@pytest.mark.parametrize("few", [200_000, 4000, 600, 20])
def test_exact_quantiles(spark, monkeypatch, few):
    """Counted values, and brackets narrowed once or several times, give the quantiles of the sorted values."""
    monkeypatch.setattr(Q, "FEW", few)
    pdf = frame()
    df = spark.createDataFrame(pdf).withColumn("k", F.when(F.col("k") != "NaN", F.col("k")))
    got = {(r.k, r.column, r.prob): r.quantile for r in Q.exact_quantiles(df, ["k"], ["x", "z"], PROBS).collect()}
    want = expected(pdf, "x") | expected(pdf, "z")
    assert set(got) == set(want)
    assert all(np.isclose(got[at], want[at], rtol=1e-12, atol=0) for at in want)


def test_nulls_empty_groups_and_no_keys(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 2.0), ("b", None)], "k string, x double")
    assert [tuple(r) for r in Q.quantiles_long(df, ["k"], "x", [0.5]).collect()] == [("a", 0.5, 1.5)]
    assert [tuple(r) for r in Q.quantiles_long(df, [], "x", [0.5]).collect()] == [(0.5, 1.5)]
    assert Q.quantiles_long(df.limit(0), ["k"], "x", [0.5]).collect() == []
    near = Q.quantiles_long(spark.range(10_001).selectExpr("cast(id as double) AS x"), [], "x", [0.5], "approx").first()
    assert abs(near.quantile - 5000) < 5


def test_a_row_in_every_partitioning(spark):
    df = spark.range(30_000).selectExpr("id % 3 AS k", "cast((id * 7919) % 10007 as double) AS x")
    one, many = (sorted(map(tuple, Q.quantiles_long(df.repartition(n), ["k"], "x", [0.05, 0.99]).collect())) for n in (1, 13))
    assert one == many


def test_no_window_over_rows(spark):
    """Rows are never sorted: only the counted values of the brackets are."""
    rows = spark.range(1000).selectExpr("id % 3 AS k", "cast(id as double) AS x")
    assert "Window" not in Q.exact_quantiles(rows, ["k"], ["x"], [0.5])._jdf.queryExecution().optimizedPlan().toString()
    plan = Q._selected(rows.withColumnRenamed("x", "_x0"), ["k"], ["x"], [0.5]) \
        ._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window"):]
    assert plan.count("Window") == 1 and "Aggregate" in window
