"""Column-expression helpers shared by the operators (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def nan_to_null(df: DataFrame, cols=None) -> DataFrame:
    """NaN -> NULL for floating columns, once at load.

    Pandas treats NaN as missing; Spark counts it, sorts it above +inf and lets
    it win ``max``.  Normalising here keeps counts, fills and filters right.
    """
    cols = set(cols) if cols is not None else None
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (DoubleType, FloatType)) and (cols is None or f.name in cols):
            out.append(F.nanvl(c, F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def fold_of_index(rn: Column, n: Column, k: int) -> Column:
    """0-based contiguous fold of 0-based row ``rn`` among ``n`` rows, ``k`` folds.

    The first ``n mod k`` folds hold one row more, as unshuffled K-fold and
    ``ntile(k)`` do.
    """
    q = F.floor(n / k)
    r = n - q * k
    big = r * (q + 1)
    return (F.when(rn < big, F.floor(rn / (q + 1)))
            .otherwise(r + F.floor((rn - big) / F.greatest(q, F.lit(1))))).cast("bigint")


def join_on(left: DataFrame, right: DataFrame, cols, how: str = "inner") -> DataFrame:
    """Join on equal ``cols``, NULL equal to NULL: a row without a key is a group
    like any other.  The left side's columns are kept."""
    cols = list(cols)
    renamed = right.select(*[F.col(f"`{c}`").alias(f"_on_{i}") for i, c in enumerate(cols)],
                           *[F.col(f"`{c}`") for c in right.columns if c not in cols])
    cond = F.lit(True)
    for i, c in enumerate(cols):
        cond = cond & left[f"`{c}`"].eqNullSafe(renamed[f"_on_{i}"])
    return left.join(renamed, cond, how).drop(*[f"_on_{i}" for i in range(len(cols))])
