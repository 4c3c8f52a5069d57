"""Joining per-key summaries back to the data, and cutting lineage.

Per-key tables (one row per machine) are small, but their row count grows with
the number of keys, so no broadcast is forced on them.  The size check happens
at run time: adaptive execution measures the materialised summary and turns the
join into a broadcast join only below ``spark.sql.adaptive.autoBroadcastJoinThreshold``;
above it the join stays a shuffle join whose skewed partitions (a hot key on
the data side) AQE splits.  Nothing is persisted: what several steps read is
written once, as Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lever.functions.columns import join_on
from lever.functions.store import written


def join_per_key(big: DataFrame, small: DataFrame, keys, how: str = "inner") -> DataFrame:
    """``big`` joined to ``small`` on ``keys`` (NULL-safe); small's key columns dropped.

    With no keys ``small`` must hold one row (a global aggregate), which is a
    proven bound, so it is broadcast directly.
    """
    keys = list(keys)
    return join_on(big, small, keys, how) if keys else big.crossJoin(F.broadcast(small))


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Compute a result that several later steps read once, and cut its lineage:
    Parquet in the shared folder (:mod:`lever.functions.store`), so a step reads only
    the columns it needs and a lost executor does not trigger a recomputation.  Fails
    on a cluster that names no such folder.
    """
    return written(df, name)
