"""Intermediate results written once and read by several later steps.

They go as Parquet into the folder named by ``spark.checkpoint.dir`` (which driver
and executors share), so later steps neither recompute them nor carry their plan,
read only the columns they need, and survive a lost executor.  They are deleted when
the application ends, or earlier by :func:`release` once their readers have run.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lever.session import ensure_checkpoint_dir

_WRITTEN: dict[str, list[str]] = {}


def _hadoop_path(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/lever-{name}-{uuid.uuid4().hex}"
    hadoop, fs = _hadoop_path(spark, path)
    fs.deleteOnExit(hadoop)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete what this application has written so far; nothing that reads it may still have to run."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        hadoop, fs = _hadoop_path(spark, path)
        fs.delete(hadoop, True)
    return len(paths)
