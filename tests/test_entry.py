import duckdb

from tests.conftest import SF001


def test_entry_runs_with_stable_schema(spark):
    import __spark_entry__ as se
    df = se.entry(spark)
    assert df.count() > 0
    assert {"machine", "variable", "segment", "label", "n", "mean_target"} <= set(df.columns)


def test_every_oracle_has_a_query():
    import __spark_entry__ as se
    assert set(se.oracle_sql()) <= set(se.queries())
    assert len(se.queries()) >= 60


def test_sample_of_queries_match_duckdb_on_sf0001(spark):
    import __spark_entry__ as se
    from tools.oracle_check import digest
    con = duckdb.connect()
    for t in ["lineitem", "part", "events"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    for name in ["best_split", "histogram_peaks", "forward_fill", "cv_scores", "segment_summary"]:
        got = se.queries()[name](spark, SF001).toPandas()
        want = con.execute(se.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns), name
        assert len(got) == len(want) and digest(got) == digest(want), name
