"""Load machine series (one DataFrame with key columns for many machines)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from lever.functions.columns import nan_to_null
from lever.schema import SeriesSchema


def series_table_name(site: str, machine: str, database: str | None = None) -> str:
    """``<database>.<site>_<machine>_timeseries`` -- one table per machine."""
    name = "_".join([site, machine, "timeseries"])
    return ".".join([database, name]) if database else name


def load_series(df_or_spark, source: str | None = None, *, schema: SeriesSchema | None = None,
                fmt: str = "parquet") -> DataFrame:
    """Read a series (table name or path) and normalise it once.

    Numeric feature columns become double and NaN becomes NULL, so counts,
    fills and range filters treat NaN as missing the way pandas does.  A time column
    of ISO text becomes a timestamp without zone (NULL where the text is none), so
    order and filters follow time (F7).  Only the
    read is lazy; column pruning and filters later reach the parquet scan.
    """
    if isinstance(df_or_spark, DataFrame):
        df = df_or_spark
    else:
        spark: SparkSession = df_or_spark
        df = spark.table(source) if fmt == "table" else spark.read.format(fmt).load(source)
    schema = schema or SeriesSchema()
    feats = set(schema.features(df))
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in feats and isinstance(f.dataType, NumericType):
            c = c.cast("double").alias(f.name)
        elif f.name == schema.time_col and isinstance(f.dataType, StringType):
            c = c.try_cast("timestamp_ntz").alias(f.name)
        cols.append(c)
    return nan_to_null(df.select(*cols), feats)


def _location(spark: SparkSession, name: str) -> str | None:
    """Where a Parquet table of the catalog lies; None for views, partitioned tables and other formats."""
    about = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
    plain = (about.get("Provider") or "").lower() == "parquet" and "# Partition Information" not in about
    return about.get("Location") if plain else None


def _united(frames: list[DataFrame]) -> DataFrame:
    """The union by name, as a balanced tree: a plan of a thousand frames is ten unions deep."""
    while len(frames) > 1:
        frames = [a[0].unionByName(a[1], allowMissingColumns=True) if len(a) > 1 else a[0]
                  for a in (frames[i:i + 2] for i in range(0, len(frames), 2))]
    return frames[0]


def load_machine_tables(spark: SparkSession, pairs, database: str | None = None,
                        schema: SeriesSchema | None = None) -> DataFrame:
    """One keyed frame (site, machine columns added) of the per-machine tables of ``pairs`` (site, machine).

    Parquet tables of the catalog are read by one scan over all their locations, and a row's keys follow from the
    folder its file lies in, so the plan does not grow with the machines.  Views, partitioned tables and tables of
    other formats are united.  Tables may differ in feature columns; missing ones become NULL.
    """
    names = {series_table_name(site, machine, database): (site, machine) for site, machine in pairs}
    if not names:
        raise ValueError("no machines given")
    places = {name: _location(spark, name) for name in names}
    folders = {name: place.rstrip("/").rsplit("/", 1)[1] for name, place in places.items() if place}
    if len(set(folders.values())) < len(folders):  # folders that do not tell the tables apart
        folders = {}
    frames = [spark.table(name).withColumns({"site": F.lit(site), "machine": F.lit(machine)})
              for name, (site, machine) in names.items() if name not in folders]
    if folders:
        owners = spark.createDataFrame([(folder, *names[name]) for name, folder in folders.items()],
                                       "_folder string, site string, machine string")
        folder = F.element_at(F.split("_metadata.file_path", "/"), -2)
        rows = spark.read.option("mergeSchema", "true").parquet(*[places[name] for name in folders]).withColumn("_folder", folder)
        frames.append(rows.join(F.broadcast(owners), "_folder").drop("_folder"))  # a row for each table named by the caller
    return load_series(_united(frames), schema=schema)
