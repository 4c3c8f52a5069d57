import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lever.functions import nan_to_null
from lever.operators import prep as P
from lever.operators import quantiles


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 1.0), (3, None)], "t int, x double")
    out = nan_to_null(df)
    assert out.where(F.col("x").isNull()).count() == 2
    assert out.agg(F.max("x")).first()[0] == 1.0


def test_sparse_rule_threshold_and_empty(spark):
    df = spark.createDataFrame([(i, float(i) if i < 3 else None, float(i)) for i in range(10)],
                               "t int, a double, b double")
    kept = P.drop_sparse_columns(df, [], ["a", "b"]).columns
    assert kept == ["t", "b"]  # 3 of 10 present is not more than 30 %
    empty = df.where("t < 0")
    assert P.drop_sparse_columns(empty, [], ["t", "a", "b"]).columns == []


def test_sparse_rule_per_key_blanks_only_that_key(spark):
    rows = [("m1", i, float(i)) for i in range(10)] + [("m2", i, float(i) if i == 0 else None) for i in range(10)]
    df = spark.createDataFrame(rows, "k string, t int, a double")
    out = P.drop_sparse_columns(df, ["k"], ["a"]).toPandas()
    assert out[out.k == "m1"].a.notna().all() and out[out.k == "m2"].a.isna().all()
    # the blanked column does not drop the key's rows
    kept = P.drop_null_rows(P.drop_sparse_columns(df, ["k"], ["a"]), ["a"], ["k"])
    assert kept.where("k = 'm2'").count() == 10


def test_zero_variance_and_all_zero(spark):
    df = spark.createDataFrame([(1.0, 0.0, 2.0, None), (1.0, 0.0, 3.0, 0.0)], "c double, z double, v double, n double")
    assert P.drop_zero_variance(df, [], ["c", "z", "v", "n"]).columns == ["v"]
    # a missing value counts as non-zero, as (x != 0).any() does with NaN
    assert P.drop_all_zero(df, [], ["c", "z", "v", "n"]).columns == ["c", "v", "n"]


def test_target_guards(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 5.0), ("b", 10.0), ("b", 20.0)], "k string, y double")
    out = P.min_target(df, ["k"], "y", 8.0).toPandas()
    # key a: 8 > max 5 -> guard rejects, rows kept unfiltered; key b filtered
    assert sorted(out[out.k == "a"].y) == [1.0, 5.0] and sorted(out[out.k == "b"].y) == [10.0, 20.0]
    out = P.max_target(df, ["k"], "y", 10.0, inclusive=False).toPandas()
    assert sorted(out[out.k == "a"].y) == [1.0, 5.0] and sorted(out[out.k == "b"].y) == [10.0, 20.0]
    out = P.max_target(df, ["k"], "y", 15.0).toPandas()
    assert sorted(out[out.k == "b"].y) == [10.0]


@pytest.mark.parametrize("few", [200_000, 100])
def test_quantile_trim_matches_pandas(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "FEW", few)
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"a": rng.normal(size=500), "b": rng.exponential(size=500)})
    pdf.loc[3, "a"] = np.nan
    df = nan_to_null(spark.createDataFrame(pdf))
    clean = pdf.dropna()
    mask = np.ones(len(clean), bool)
    for c in ["a", "b"]:
        lo, hi = clean[c].quantile(0.05), clean[c].quantile(0.99)
        mask &= (clean[c] >= lo).to_numpy() & (clean[c] <= hi).to_numpy()
    assert P.quantile_trim(df, [], ["a", "b"]).count() == mask.sum()


def test_minmax_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0), (5.0, 2.0)], "x double, c double")
    out = P.minmax_normalize(df, [], ["x", "c"]).toPandas()
    assert out.x.tolist() == [0.0, 0.5, 1.0] and out.c.isna().all()


def test_sample_adequacy(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 2.0), ("b", 3.0, 4.0), ("b", 5.0, 6.0)],
                               "k string, x double, y double")
    out = {r.k: r.status for r in P.sample_adequacy(df, ["k"]).collect()}
    assert out == {"a": "not enough data", "b": "ok"}
    assert P.sample_adequacy(df.where("k = 'z'")).first().status == "no data"


def test_product_counts_drop_null_codes(spark):
    df = spark.createDataFrame([("A", 1), ("A", 2), (None, 3), ("B", None)], "prod_code string, time_bucket_local int")
    out = [(r.prod_code, r.n_points) for r in P.product_counts(df).collect()]
    assert out == [("A", 2), ("B", 0)]


def test_null_rule_by_key_joins_only_where_a_key_lacks_a_column(spark):
    """A column that a key lacks is ignored for it; the rows meet keys only if some key lacks one."""
    from lever.operators.prep import drop_null_rows_sized
    data = [(None, 1.0, 1.0), (None, None, 2.0), ("a", 1.0, None), ("a", 2.0, 3.0), ("b", None, 4.0), ("b", None, None)]
    df = spark.createDataFrame(data, "k string, x double, y double")
    full = df.where("k IS NULL OR k = 'a'")
    out, most = drop_null_rows_sized(full, ["x", "y"], ["k"])
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString() and most == 2
    assert sorted((r.k or "", r.x, r.y) for r in out.collect()) == [("", 1.0, 1.0), ("a", 2.0, 3.0)]
    out, _ = drop_null_rows_sized(df, ["x", "y"], ["k"])
    assert sorted((r.k or "", r.x or -1, r.y) for r in out.collect()) == [("", 1.0, 1.0), ("a", 2.0, 3.0), ("b", -1, 4.0)]
    assert out.columns == df.columns and drop_null_rows_sized(df.where("false"), ["x"], ["k"])[1] == 0
