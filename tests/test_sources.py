import pytest
from pyspark.sql import functions as F

from lever.operators import prep as P
from lever.schema import SeriesSchema
from lever.sources import catalog as C
from lever.sources.series import load_machine_tables, load_series, series_table_name

SCHEMA = SeriesSchema(keys=("site", "machine"), product_col=None)
PAIRS = [("north", f"press_{i}") for i in range(12)] + [("south", "oven")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A Parquet table a machine, one of them partitioned, one with another feature."""
    root = tmp_path_factory.mktemp("tables")
    spark.sql("CREATE DATABASE IF NOT EXISTS plant")
    for i, (site, machine) in enumerate(PAIRS):
        rows = spark.range(5).select((F.timestamp_seconds(F.col("id") * 1800)).alias("time_bucket_local"), (F.col("id") + i).alias("temp"))
        if i == 3:
            rows = rows.withColumn("pressure", F.lit(2.5))
        writer = rows.withColumn("day", F.lit("d1")).write.partitionBy("day") if i == 4 else rows.write
        name = series_table_name(site, machine, "plant")
        writer.mode("overwrite").option("path", str(root / name.split(".")[1])).saveAsTable(name)
    yield
    spark.sql("DROP DATABASE plant CASCADE")


def test_table_names():
    assert series_table_name("north", "press_1") == "north_press_1_timeseries"
    assert series_table_name("north", "press_1", "plant") == "plant.north_press_1_timeseries"


def test_all_tables_in_one_scan(spark, tables):
    df = load_machine_tables(spark, [p for p in PAIRS if p[1] != "press_4"], "plant", SCHEMA)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Union" not in plan
    df = load_machine_tables(spark, PAIRS, "plant", SCHEMA)  # with the partitioned one
    rows = df.groupBy("site", "machine").agg(F.count("*").alias("n"), F.sum("temp").alias("t"), F.count("pressure").alias("p")).collect()
    assert {(r.site, r.machine): (r.n, r.t, r.p) for r in rows} == {
        pair: (5, 10.0 + 5 * i, 5 if i == 3 else 0) for i, pair in enumerate(PAIRS)}
    assert dict(df.dtypes)["temp"] == "double"


def test_views_are_united(spark, tables):
    spark.table("plant.south_oven_timeseries").createOrReplaceTempView("east_oven_timeseries")
    spark.table("plant.south_oven_timeseries").drop("temp").createOrReplaceTempView("east_saw_timeseries")
    df = load_machine_tables(spark, [("east", "oven"), ("east", "saw")], schema=SCHEMA)
    assert {(r.machine, r.temp) for r in df.collect()} == {("oven", 12.0 + i) for i in range(5)} | {("saw", None)}
    with pytest.raises(ValueError):
        load_machine_tables(spark, [], "plant", SCHEMA)


def test_a_site_filter_prunes_partitions(spark, tables, tmp_path):
    """The layout for all machines in one table: folders by site and machine; a chosen site reads its folders only."""
    path = str(tmp_path / "series")
    load_machine_tables(spark, PAIRS, "plant", SCHEMA).write.partitionBy("site", "machine").parquet(path)
    df = load_series(spark, path, schema=SCHEMA)
    south = df.where("site = 'south'")
    assert len(south.select("_metadata.file_path").distinct().collect()) < len(df.inputFiles()) and south.count() == 5
    plan = south._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(site" in plan and "(site" in plan
    dim = C.machines_of_site(C.site_machine_dim(df), "north")
    assert dim.count() == 12
    from_map = C.site_machine_dim_from_map(spark, {"north": ["a", "b"], "south": ["c"]})
    assert sorted(map(tuple, from_map.collect())) == [("north", "a"), ("north", "b"), ("south", "c")]


def test_text_times_follow_time(spark):
    """ISO text in several spellings is ordered and filtered as time; what is no time is NULL."""
    rows = [("2024-01-02T00:30:00", 1.0), ("2024-01-02 00:00:00", 2.0), ("2024-01-01", 3.0), ("soon", 4.0), (None, 5.0)]
    df = spark.createDataFrame(rows, "time_bucket_local string, x double")
    out = load_series(df, schema=SeriesSchema(product_col=None))
    assert dict(out.dtypes)["time_bucket_local"] == "timestamp_ntz"
    assert [r.x for r in P.sort_time(out.dropna(), SeriesSchema(product_col=None)).collect()] == [3.0, 2.0, 1.0]
    for source in (df, out):
        assert sorted(r.x for r in P.start_date(source, "2024-01-02").collect()) == [1.0, 2.0]
        assert sorted(r.x for r in P.end_date(source, "2024-01-02").collect()) == [2.0, 3.0]
