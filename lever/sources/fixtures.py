"""Machine series derived from the driver's tables (see FIXTURES.md).

F1: ``events`` -> 30-minute buckets, one column per event type (average value).
F2: ``lineitem`` joined to ``part`` -> one series per supplier.
Both are plain DataFrame plans over the parquet tables, so their cost grows
with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lever.schema import SeriesSchema
from lever.sources.series import load_series

# Event types of the events table, in natural (alphabetical) order.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")

F1_SCHEMA = SeriesSchema(keys=(), time_col="time_bucket_local", product_col="prod_code",
                         meta_cols=("time_bucket_utc",), feature_cols=EVENT_TYPES)
F1_KEYED_SCHEMA = SeriesSchema(keys=("site", "machine"), time_col="time_bucket_local",
                               product_col="prod_code", meta_cols=("time_bucket_utc",),
                               feature_cols=EVENT_TYPES)
F2_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "p_size", "p_retailprice",
               "sparse20", "const1", "zero0", "net")
F2_SCHEMA = SeriesSchema(keys=("machine",), time_col="time_bucket_local",
                         tie_cols=("l_orderkey", "l_partkey", "l_linenumber"),
                         product_col="prod_code", meta_cols=("_h",), feature_cols=F2_FEATURES)


def events_series(spark: SparkSession, sf_dir: str, keyed: bool = False) -> DataFrame:
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    bucket = F.window("ts", "30 minutes").start
    keys = []
    if keyed:
        ev = ev.withColumns({"site": F.concat(F.lit("s"), (F.col("user_id") % 2).cast("string")),
                             "machine": F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string"))})
        keys = ["site", "machine"]
    aggs = [F.avg(F.when(F.col("event_type") == e, F.col("value"))).alias(e) for e in EVENT_TYPES]
    g = ev.groupBy(*keys, bucket.alias("time_bucket_local")).agg(*aggs)
    out = g.select(*keys,
                   F.concat(F.lit("P"), F.floor(F.hour("time_bucket_local") / 6).cast("string"))
                   .alias("prod_code"),
                   F.col("time_bucket_local").alias("time_bucket_utc"),
                   "time_bucket_local", *EVENT_TYPES)
    return load_series(out, schema=F1_KEYED_SCHEMA if keyed else F1_SCHEMA)


def lineitem_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    j = li.join(part, li.l_partkey == part.p_partkey)
    out = j.select(
        F.col("l_suppkey").alias("machine"),
        F.col("l_shipdate").alias("time_bucket_local"),
        "l_orderkey", "l_partkey", "l_linenumber",
        F.col("l_returnflag").alias("prod_code"),
        "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        F.col("p_size").cast("double").alias("p_size"), "p_retailprice",
        F.when(F.col("l_orderkey") % 10 < 2, F.col("l_quantity")).alias("sparse20"),
        F.lit(1.0).alias("const1"), F.lit(0.0).alias("zero0"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("net"),
        ((F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729 + F.col("l_linenumber") * 31 + 7)
         % 1000).alias("_h"),
    )
    return load_series(out, schema=F2_SCHEMA)
