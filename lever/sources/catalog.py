"""Dimensions, value lists, shape and feature catalog of a series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _q(c):
    return F.col(f"`{c}`")


def site_machine_dim(df: DataFrame, site_col: str = "site", machine_col: str = "machine") -> DataFrame:
    """(site, machines) pairs present in the data."""
    return df.select(_q(site_col).alias("site"), _q(machine_col).alias("machines")).distinct()


def site_machine_dim_from_map(spark: SparkSession, mapping: dict) -> DataFrame:
    """S2 from a configured ``{site: [machine, ...]}`` map: explode to rows."""
    m = spark.createDataFrame([(mapping,)], "m map<string,array<string>>")
    return m.select(F.explode("m").alias("site", "ms")).select(
        "site", F.explode("ms").alias("machines"))


def machines_of_site(dim: DataFrame, site: str) -> DataFrame:
    """S3: machines of the selected site."""
    return dim.where(F.col("site") == F.lit(site))


def distinct_values(df: DataFrame, col: str, order, keys=()) -> DataFrame:
    """Distinct values of ``col`` (NULL included) in first-seen order per key.

    One aggregate (first-seen position per value), then a per-key ordinal over
    the distinct values only.
    """
    keys = list(keys)
    first = F.min(F.struct(*[_q(o) for o in order]))
    agg = df.groupBy(*[_q(k) for k in keys], _q(col)).agg(first.alias("_first"))
    w = Window.partitionBy(*[_q(k) for k in keys]).orderBy("_first")
    return agg.select(*[_q(k) for k in keys], _q(col).alias("value"),
                      F.col(f"_first.`{order[0]}`").alias("first_seen"),
                      F.row_number().over(w).cast("bigint").alias("ordinal"))


def shape_report(df: DataFrame, keys=(), step: str = "") -> DataFrame:
    """Rows and columns (keys excluded) per key after a step."""
    keys = list(keys)
    ncols = len([c for c in df.columns if c not in keys])
    g = df.groupBy(*[_q(k) for k in keys]) if keys else df.groupBy()
    return g.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows")).withColumns(
        {"n_cols": F.lit(ncols).cast("bigint"), "step": F.lit(step)})


def feature_catalog(df: DataFrame, features, keys=(), exclude=()) -> DataFrame:
    """Feature names with ordinal and non-null count per key (target excluded
    via ``exclude``)."""
    keys = list(keys)
    feats = [f for f in features if f not in set(exclude)]
    g = df.groupBy(*[_q(k) for k in keys]) if keys else df.groupBy()
    counts = g.agg(*[F.count(_q(f)).alias(f"_n{i}") for i, f in enumerate(feats)])
    entries = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(i).cast("bigint").alias("ordinal"),
                                 F.col(f"_n{i}").cast("bigint").alias("non_null"))
                        for i, f in enumerate(feats)])
    return counts.select(*[_q(k) for k in keys], F.inline(entries))
