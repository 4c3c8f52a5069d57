"""A row without a key is a group like any other, in every keyed operator."""
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lever.operators import models as M
from lever.operators import profile as H
from lever.operators import splits as B
from lever.plans import jobs as E


@pytest.fixture(scope="module")
def rows(spark):
    data = [(m, i, float(i % 20), 5.0 if i % 20 >= 10 else 1.0) for m in (None, "a") for i in range(40)]
    return spark.createDataFrame(data, "machine string, t int, x double, y double")


def by_machine(df):
    return {m or None: g for m, g in df.toPandas().assign(machine=lambda d: d["machine"].fillna("")).groupby("machine")}


def same(df):
    got = by_machine(df)
    assert set(got) == {None, "a"}
    a, b = (g.drop(columns="machine").reset_index(drop=True) for g in (got[None], got["a"]))
    a, b = (g.sort_values([c for c in g.columns if g[c].dtype != object], ignore_index=True) for g in (a, b))
    pd.testing.assert_frame_equal(a, b)
    return got[None]


def test_histograms(rows):
    assert same(H.histogram(rows, ["x"], ["machine"], 10))["n"].sum() == 40
    peaked = rows.union(rows.filter("x = 7"))
    same(H.histogram_peaks(peaked, ["x"], ["machine"], 10))


def test_splits_and_segments(rows):
    splits = B.tree_splits(rows, ["machine"], ["x"], "y", 2)
    assert same(splits)["threshold"].tolist() == [9.5]
    assert len(same(B.segment_rows(rows, ["machine"], ["x"], "y", splits))) == 40
    assert same(B.segment_summary(rows, ["machine"], ["x"], "y", splits, exact_scale=6))["n"].tolist() == [20, 20]
    assert same(B.segment_boxstats(rows, ["machine"], ["x"], "y", splits))["n"].sum() == 40
    same(H.histogram_with_splits(rows, ["x"], splits, ["machine"], 10))


def test_drill_down_peaks_finds_the_split(rows):
    assert same(E.drill_down_peaks(rows, ["machine"], "y", ["x"]))["status"].tolist() == ["ok", "ok"]


def test_model_choice(rows):
    scores = M.cv_scores(rows, ["machine"], ["x"], "y", M.LINEAR_ONLY, hash_cols=["t"])
    assert len(same(scores)) == 3
    chosen = M.select_model(scores, ["machine"], list(M.LINEAR_ONLY))
    assert len(same(M.dispatch_importance(rows, ["machine"], ["t"], ["x"], "y", chosen))) == 1


def test_segment_mean_of_large_values(spark):
    rows = spark.createDataFrame([("a", float(i), 1e12 + i) for i in range(40)], "machine string, x double, y double")
    splits = spark.createDataFrame([("a", "x", 19.5)], "machine string, variable string, threshold double")
    out = B.segment_summary(rows, ["machine"], ["x"], "y", splits, exact_scale=6).orderBy("segment").collect()
    assert [r.mean_target for r in out] == [1e12 + 9.5, 1e12 + 29.5]


def test_holdout_share_with_signed_hashes(spark):
    flags = M.holdout_split(spark.range(20_000).withColumn("h", F.xxhash64("id")), "h").groupBy("in_train").count().collect()
    share = {r.in_train: r["count"] / 20_000 for r in flags}
    assert abs(share[True] - 0.8) < 0.01
