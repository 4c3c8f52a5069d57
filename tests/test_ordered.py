import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lever.operators.ordered import contiguous_folds, forward_fill, ordered_scan, rolling_mean

ORDER = ["time_bucket_local", "l_orderkey", "l_partkey", "l_linenumber"]


def test_blocks_change_nothing_on_f2(spark, f2_small):
    res = {}
    for n in (1, 5, 40):
        d = ordered_scan(f2_small, ["machine"], ORDER, fill=["sparse20"], cumsum={"cq": "l_quantity"},
                         index="rn", count="n", num_blocks=n)
        res[n] = d.select("machine", *ORDER, "sparse20", "cq", "rn", "n").toPandas() \
            .sort_values(["machine", *ORDER]).reset_index(drop=True)
    pd.testing.assert_frame_equal(res[1], res[5])
    pd.testing.assert_frame_equal(res[1], res[40])


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz", "string", "double", "decimal(10,2)"])
def test_order_columns_of_any_kind(spark, kind):
    t = "cast(date_add(date'2024-01-01', cast(id as int)) as %s)" % kind if "d" not in kind[:2] or kind == "date" else f"cast(id as {kind})"
    df = spark.range(300).selectExpr("id", f"{t} AS t").unionByName(spark.range(1000, 1001).selectExpr("id", f"cast(null as {kind}) AS t"))
    out = ordered_scan(df, [], ["t"], index="rn", num_blocks=7).orderBy("rn").toPandas()
    assert out.id.tolist() == [1000, *range(300)] and out.rn.tolist() == list(range(301))


def test_range_splits_a_hot_key(spark):
    # one key holds every row: the range plan must still use many blocks
    df = spark.range(0, 5000).select(F.lit("hot").alias("k"), F.col("id").alias("t"),
                                     F.when(F.col("id") % 7 == 0, F.col("id").cast("double")).alias("x"))
    out = ordered_scan(df, ["k"], ["t"], fill=["x"], index="rn", num_blocks=8)
    blocks = out.select(F.spark_partition_id()).distinct().count()
    pdf = out.toPandas().sort_values("t")
    assert (pdf.rn.to_numpy() == np.arange(5000)).all()
    expect = pd.Series(np.where(np.arange(5000) % 7 == 0, np.arange(5000), np.nan)).ffill()
    assert np.allclose(pdf.x.to_numpy(), expect.to_numpy(), equal_nan=True)
    assert blocks > 1


def test_forward_fill_leading_gap(spark):
    df = spark.createDataFrame([(1, None, None), (2, 1.0, None), (3, None, 5.0), (4, None, None)],
                               "t int, a double, b double")
    out = forward_fill(df, [], ["t"], num_blocks=3).orderBy("t").toPandas()
    assert out.a.isna().tolist() == [True, False, False, False]
    assert out.b.tolist()[2:] == [5.0, 5.0] and out.b.isna().tolist()[:2] == [True, True]


def test_forward_fill_is_idempotent(spark, f2_small):
    once = forward_fill(f2_small.select("machine", *ORDER, "sparse20"), ["machine"], ORDER)
    twice = forward_fill(once, ["machine"], ORDER)
    assert once.exceptAll(twice).count() == 0


@pytest.mark.parametrize("n, blocks", [(130, 1), (130, 4), (9000, 5)])
def test_rolling_mean_matches_pandas(spark, n, blocks):
    rng = np.random.default_rng(0)
    x = rng.normal(size=n)
    x[70] = np.nan
    df = spark.createDataFrame(pd.DataFrame({"t": np.arange(n), "x": x})).withColumn(
        "x", F.nanvl("x", F.lit(None).cast("double")))
    out = rolling_mean(df, [], ["t"], "x", 48, name="m", num_blocks=blocks).orderBy("t").toPandas()
    expect = pd.Series(x).rolling(48).mean()
    assert np.allclose(out.m.to_numpy(), expect.to_numpy(), equal_nan=True)


@pytest.mark.parametrize("n", [10, 23, 101, 1007])
def test_contiguous_folds_match_unshuffled_kfold(spark, n):
    df = spark.range(n).withColumnRenamed("id", "t")
    out = contiguous_folds(df, [], ["t"], 10, num_blocks=3).orderBy("t").toPandas()
    expect = np.concatenate([np.full(len(c), i) for i, c in enumerate(np.array_split(np.arange(n), 10))])
    assert (out.fold.to_numpy() == expect).all()


def test_a_hot_key_with_one_common_value(spark):
    """90 % equal values on one key: blocks stay balanced, as equal values are one row before ordering."""
    from lever.operators.ordered import BLK, _block
    from lever.operators.quantiles import quantiles_long
    from lever.operators.splits import tree_splits
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"k": ["hot"] * 9000 + ["cold"] * 100, "x": np.round(rng.uniform(0, 10, 9100), 2)})
    pdf.loc[:8100, "x"] = 0.0
    pdf["y"] = np.where(pdf.x < 4, 1.0, 3.0) + rng.normal(0, 0.1, 9100)
    df = spark.createDataFrame(pdf)
    counts = df.groupBy("k", "x").count()
    sizes = [r["count"] for r in counts.withColumn(BLK, _block(counts, ["x"], 8)).groupBy(BLK).count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 1.5 * sum(sizes) / 8
    got = quantiles_long(df, ["k"], "x", [0.05, 0.5, 0.99]).toPandas()
    for k, part in pdf.groupby("k"):
        assert np.allclose(got[got.k == k].sort_values("prob")["quantile"].to_numpy(),
                           part.x.quantile([0.05, 0.5, 0.99]).to_numpy())
    one, many = (sorted((r.k, r.threshold) for r in tree_splits(df, ["k"], ["x"], "y", 2, num_blocks=n).collect())
                 for n in (1, 9))
    assert one == many


def test_nothing_stays_persisted(spark):
    import __spark_entry__ as se
    spark.catalog.clearCache()
    before = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    for name in ("segment_summary", "quantile_trim", "forward_fill"):
        se.queries()[name](spark, "/root/testdata/sf0.001").count()
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == before


@pytest.mark.parametrize("kind", ["string", "timestamp", "int"])
def test_two_order_values_and_a_tie_column_give_even_blocks(spark, kind):
    """The cuts use the whole order tuple: with two times only, the tie-breaker cuts on."""
    from lever.operators.ordered import BLK, _block
    t = {"string": "if(id % 2 = 0, '2024-01', '2024-02')", "timestamp": "if(id % 2 = 0, timestamp'2024-01-01', timestamp'2024-01-02')",
         "int": "cast(id % 2 as int)"}[kind]
    df = spark.range(20_000).selectExpr("id", f"{t} AS t", "CASE WHEN id % 1000 = 0 THEN 1.5 * id END AS x")
    sizes = [r["count"] for r in df.withColumn(BLK, _block(df, ["t", "id"], 8)).groupBy(BLK).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 4500 and min(sizes) > 1000
    for n in (None, 8):
        out = ordered_scan(df, [], ["t", "id"], fill=["x"], index="rn", num_blocks=n).orderBy("rn").toPandas()
        assert out.rn.tolist() == list(range(20_000)) and out.id.tolist() == [*range(0, 20_000, 2), *range(1, 20_000, 2)]
        assert out.x.tolist()[-1] == 1.5 * 19_000


def test_blocks_follow_the_rows_not_the_session(spark):
    from lever.operators import ordered
    before, conf = ordered.BLOCK_ROWS, spark.conf.get("spark.sql.shuffle.partitions")
    try:
        ordered.BLOCK_ROWS = 500
        df = spark.range(10_000).withColumnRenamed("id", "t")
        for partitions in ("2", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            sizes = df.withColumn("b", ordered._block(df, ["t"], None)).groupBy("b").count().toPandas()["count"]
            assert len(sizes) == 20 and sizes.max() < 1500
    finally:
        ordered.BLOCK_ROWS = before
        spark.conf.set("spark.sql.shuffle.partitions", conf)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_small_keys_are_not_cut(spark, monkeypatch):
    from lever.operators import ordered
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 500)
    df = spark.range(10_000).selectExpr("id % 50 AS k", "id AS t", "if(id % 3 = 0, double(id), null) AS x")
    for out in (ordered_scan(df, ["k"], ["t"], fill=["x"], cumsum={"c": "t"}, index="rn", count="n"),
                rolling_mean(df, ["k"], ["t"], "x", 2), contiguous_folds(df, ["k"], ["t"])):
        assert "Join" not in _plan(out) and "lambda" not in _plan(out)
    cut = ordered_scan(df, ["k"], ["t"], fill=["x"], cumsum={"c": "t"}, index="rn", count="n", num_blocks=20)
    whole = ordered_scan(df, ["k"], ["t"], fill=["x"], cumsum={"c": "t"}, index="rn", count="n")
    assert cut.exceptAll(whole).isEmpty() and cut.dtypes == whole.dtypes


def test_a_large_key_is_cut_where_its_rows_are(spark, monkeypatch):
    """Cuts follow the keys too, so groups are about the keys and the blocks, and the search array is a constant."""
    from lever.operators import ordered
    monkeypatch.setattr(ordered, "BLOCK_ROWS", 500)
    df = spark.range(20_000).selectExpr("if(id % 2 = 0, null, id % 200) AS k", "id AS t", "double(id) AS x")
    out = ordered_scan(df, ["k"], ["t"], fill=["x"], index="rn", count="n")
    assert "Join" in _plan(out) and "array_sort" not in _plan(out) and "from_json" not in _plan(out)
    groups = df.withColumn(ordered.BLK, ordered._block(df, ["k", "t"], None)).groupBy("k", ordered.BLK).count().toPandas()
    assert len(groups) <= 101 + 40 and groups["count"].max() < 1500
    got = out.toPandas().sort_values("t")
    for k, part in got.groupby("k", dropna=False):
        assert part.rn.tolist() == list(range(len(part))) and set(part.n) == {len(part)}
