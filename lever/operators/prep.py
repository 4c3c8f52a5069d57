"""Preparation: filters (P1-P15), per-column aggregates (A1-A3), ordering and
forward fill (W1-W2).

Column-dropping rules (sparse, zero variance, all zero) are decided per key.
With no keys the columns are dropped from the frame, exactly as a one-machine
run does.  With keys, a column dropped for one machine is blanked (NULL) for
that machine only -- the wide frame keeps one schema, and later steps treat a
column that is NULL throughout a key as absent for that key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, TimestampNTZType, TimestampType

from lever.functions.columns import join_on
from lever.functions.sizing import join_per_key, materialize
from lever.operators.ordered import forward_fill as _ffill
from lever.operators.quantiles import quantiles_wide
from lever.schema import SeriesSchema


def _q(c):
    return F.col(f"`{c}`")


def _grouped(df, keys):
    return df.groupBy(*[_q(k) for k in keys]) if keys else df.groupBy()


# --------------------------------------------------------------- W1, W2
def sort_time(df: DataFrame, schema: SeriesSchema) -> DataFrame:
    """Rows in time order per key (explicit tie-breakers; a global sort)."""
    return df.orderBy(*[_q(k) for k in schema.keys], *[_q(o) for o in schema.order])


def forward_fill(df: DataFrame, schema: SeriesSchema, cols=None, **kw) -> DataFrame:
    """Every non-key column carries its last non-missing value forward in
    time order, before any product or date filter; leading gaps stay NULL."""
    return _ffill(df, schema.keys, schema.order, cols, **kw)


# --------------------------------------------------------------- P1-P5
def product_filter(df: DataFrame, codes, col: str = "prod_code") -> DataFrame:
    """Keep rows whose product code is in ``codes``."""
    return df.where(_q(col).isin(list(codes)))


def series_projection(df: DataFrame, schema: SeriesSchema, codes) -> DataFrame:
    """Product filter, then drop metadata (product code, meta columns) by name."""
    drop = [c for c in [schema.product_col, *schema.meta_cols] if c]
    return product_filter(df, codes, schema.product_col).drop(*drop)


def _time(df: DataFrame, col: str):
    """the time column, ISO text read as a timestamp (NULL where it is none)."""
    return _q(col).try_cast("timestamp_ntz") if isinstance(df.schema[col].dataType, StringType) else _q(col)


def _time_lit(df: DataFrame, col: str, value):
    dt = df.schema[col].dataType
    lit = value if isinstance(value, Column) else F.lit(value)
    if isinstance(dt, (TimestampNTZType, TimestampType, DateType)):
        return lit.cast(dt)
    if isinstance(dt, StringType):
        return lit.cast("timestamp_ntz")
    return lit


def start_date(df: DataFrame, start, time_col: str = "time_bucket_local") -> DataFrame:
    """``time >= start`` (a bare date means its midnight)."""
    return df.where(_time(df, time_col) >= _time_lit(df, time_col, start))


def end_date(df: DataFrame, end, time_col: str = "time_bucket_local") -> DataFrame:
    """``time <= end``; a bare date means midnight, so later buckets of that
    day are excluded."""
    return df.where(_time(df, time_col) <= _time_lit(df, time_col, end))


def trailing_months(df: DataFrame, n_months: int, as_of=None,
                    time_col: str = "time_bucket_local") -> DataFrame:
    """P5: rows from the last ``n_months`` months before ``as_of`` (default today).

    Month arithmetic clips to month end (Mar 31 - 1 month = Feb 28/29).
    """
    base = F.current_date() if as_of is None else F.lit(as_of).cast("date")
    since = F.add_months(base, -int(n_months))
    return df.where(_time(df, time_col) >= _time_lit(df, time_col, since))


# --------------------------------------------------------------- column rules
def _keep_mask(df: DataFrame, keys, report: DataFrame, cols) -> DataFrame:
    """Apply a (keys, column, kept) report: drop (no keys) or blank per key."""
    keys = list(keys)
    if not keys:
        kept = {r["column"] for r in report.where("kept").select("column").collect()}
        return df.select(*[_q(c) for c in df.columns if c not in set(cols) or c in kept])
    wide = report.groupBy(*[_q(k) for k in keys]).agg(
        *[F.max(F.when(F.col("column") == c, F.col("kept"))).alias(f"_keep{i}")
          for i, c in enumerate(cols)])
    j = join_per_key(df, wide, keys)
    out = [F.when(F.col(f"_keep{cols.index(c)}"), _q(c)).alias(c) if c in cols else _q(c)
           for c in df.columns]
    return j.select(*out)


def sparse_column_report(df: DataFrame, keys=(), cols=None, threshold: float = 0.3) -> DataFrame:
    """P6 decision: (keys, column, non_null, n_rows, kept); kept iff
    non_null > threshold * n_rows (0 rows => nothing kept)."""
    keys = list(keys)
    cols = [c for c in (cols or df.columns) if c not in keys]
    agg = _grouped(df, keys).agg(F.count(F.lit(1)).alias("n_rows"),
                                 *[F.count(_q(c)).alias(f"_n{i}") for i, c in enumerate(cols)])
    long = agg.select(*[_q(k) for k in keys], "n_rows", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"_n{i}").alias("non_null")) for i, c in enumerate(cols)])))
    return long.select(*[_q(k) for k in keys], "column", F.col("non_null").cast("bigint").alias("non_null"),
                       F.col("n_rows").cast("bigint").alias("n_rows"),
                       (F.col("non_null") > F.col("n_rows") * F.lit(float(threshold))).alias("kept"))


def drop_sparse_columns(df: DataFrame, keys=(), cols=None, threshold: float = 0.3) -> DataFrame:
    """Drop columns with at most ``threshold`` of values present."""
    cols = [c for c in (cols or df.columns) if c not in set(keys)]
    return _keep_mask(df, keys, sparse_column_report(df, keys, cols, threshold), cols)


def column_min_max(df: DataFrame, keys=(), cols=()) -> DataFrame:
    """A2: (keys, column, min_value, max_value) per column, NULLs ignored."""
    keys, cols = list(keys), list(cols)
    agg = _grouped(df, keys).agg(*[F.min(_q(c)).alias(f"_lo{i}") for i, c in enumerate(cols)],
                                 *[F.max(_q(c)).alias(f"_hi{i}") for i, c in enumerate(cols)])
    return agg.select(*[_q(k) for k in keys], F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"_lo{i}").cast("double").alias("min_value"),
                 F.col(f"_hi{i}").cast("double").alias("max_value")) for i, c in enumerate(cols)])))


def zero_variance_report(df: DataFrame, keys=(), cols=()) -> DataFrame:
    """P8 decision: kept iff max > min (variance > 0, NULLs ignored); an all-NULL
    column is dropped."""
    mm = column_min_max(df, keys, cols)
    return mm.withColumn("kept", F.coalesce(F.col("max_value") > F.col("min_value"), F.lit(False)))


def drop_zero_variance(df: DataFrame, keys=(), cols=()) -> DataFrame:
    """Drop constant columns."""
    return _keep_mask(df, keys, zero_variance_report(df, keys, cols), list(cols))


def all_zero_report(df: DataFrame, keys=(), cols=()) -> DataFrame:
    """P9 decision: kept iff some value differs from 0 (a missing value counts as
    different, as ``(x != 0).any()`` does with NaN)."""
    keys, cols = list(keys), list(cols)
    agg = _grouped(df, keys).agg(*[F.max(F.when(_q(c).isNull() | (_q(c) != 0), 1).otherwise(0))
                                   .alias(f"_z{i}") for i, c in enumerate(cols)])
    return agg.select(*[_q(k) for k in keys], F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), (F.coalesce(F.col(f"_z{i}"), F.lit(0)) == 1).alias("kept"))
        for i, c in enumerate(cols)])))


def drop_all_zero(df: DataFrame, keys=(), cols=()) -> DataFrame:
    """Drop columns that are 0 everywhere."""
    return _keep_mask(df, keys, all_zero_report(df, keys, cols), list(cols))


def drop_metadata(df: DataFrame, schema: SeriesSchema) -> DataFrame:
    """Keys + order + features only."""
    feats = schema.features(df)
    keep = [*schema.keys, *schema.order, *feats]
    return df.select(*[_q(c) for c in df.columns if c in keep])


# --------------------------------------------------------------- target range
def target_guard(df: DataFrame, keys, target: str, min_target=None, max_target=None) -> DataFrame:
    """P10/P11 guards per key: (keys, target_min, target_max, min_ok, max_ok).

    min_ok is false when ``min_target > max(target)`` (would remove all data);
    max_ok is false when ``max_target <= min(target)``.
    """
    keys = list(keys)
    g = _grouped(df, keys).agg(F.min(_q(target)).alias("target_min"), F.max(_q(target)).alias("target_max"))
    cols = {"min_ok": F.lit(True), "max_ok": F.lit(True)}
    if min_target is not None:
        cols["min_ok"] = F.coalesce(~(F.lit(float(min_target)) > F.col("target_max")), F.lit(True))
    if max_target is not None:
        cols["max_ok"] = F.coalesce(~(F.lit(float(max_target)) <= F.col("target_min")), F.lit(True))
    return g.withColumns(cols)


def min_target(df: DataFrame, keys, target: str, value: float) -> DataFrame:
    """P10: ``target >= value`` per key; a key whose max is below ``value`` is
    rejected by the guard and left unfiltered."""
    guard = target_guard(df, keys, target, min_target=value).select(*keys, "min_ok")
    j = join_per_key(df, guard, keys)
    return j.where(~F.col("min_ok") | (_q(target) >= F.lit(float(value)))).drop("min_ok")


def max_target(df: DataFrame, keys, target: str, value: float, inclusive: bool = True) -> DataFrame:
    """``target <= value`` (``<`` with ``inclusive=False``, the series-view
    form); a key whose min is at or above ``value`` is left unfiltered."""
    guard = target_guard(df, keys, target, max_target=value).select(*keys, "max_ok")
    j = join_per_key(df, guard, keys)
    cmp = _q(target) <= F.lit(float(value)) if inclusive else _q(target) < F.lit(float(value))
    return j.where(~F.col("max_ok") | cmp).drop("max_ok")


def drop_null_rows(df: DataFrame, cols, keys=()) -> DataFrame:
    """Drop rows with a NULL in any of ``cols``.

    With keys, a column that is NULL throughout a key (dropped for that key) is
    ignored for that key's rows.
    """
    return drop_null_rows_sized(df, cols, keys)[0] if keys else df.dropna(how="any", subset=list(cols))


def drop_null_rows_sized(df: DataFrame, cols, keys) -> tuple[DataFrame, int]:
    """:func:`drop_null_rows` with keys, and how many rows the largest key held before.

    One aggregate, computed when the plan is built, tells which columns each key has.  Only keys that lack one are
    joined to the rows; mostly there are none, and then no row is shuffled or joined.
    """
    keys, cols = list(keys), list(cols)
    found = materialize(_grouped(df, keys).agg(F.count(F.lit(1)).alias("_n"),
                                               *[(F.count(_q(c)) > 0).alias(f"_p{i}") for i, c in enumerate(cols)]), "present")
    lacks = F.lit(False)
    for i in range(len(cols)):
        lacks = lacks | ~F.col(f"_p{i}")
    most, lacking = found.agg(F.max("_n"), F.count_if(lacks)).first()
    if not lacking:
        return _where_all(df, [_q(c).isNotNull() for c in cols]), most or 0
    j = join_on(df, found.where(lacks).drop("_n"), keys, "left")
    kept = _where_all(j, [(F.col(f"_p{i}") == F.lit(False)) | _q(c).isNotNull() for i, c in enumerate(cols)])
    return kept.drop(*[f"_p{i}" for i in range(len(cols))]), most


def _where_all(df: DataFrame, conditions) -> DataFrame:
    cond = F.lit(True)
    for c in conditions:
        cond = cond & c
    return df.where(cond)


def exclude_variables(variables, remove) -> list:
    """P13 on the variable list: remove chosen names (empty = remove nothing)."""
    remove = set(remove or ())
    return [v for v in variables if v not in remove]


def drop_variables(df: DataFrame, remove) -> DataFrame:
    """P13 on a frame: drop the chosen columns."""
    return df.drop(*list(remove or ()))


def quantile_trim(df: DataFrame, keys=(), cols=(), lower: float = 0.05, upper: float = 0.99,
                  method: str = "exact") -> DataFrame:
    """Drop rows with a NULL, then keep a row only if every column lies in
    its own [q_lower, q_upper]; all bounds come from the same (null-free) data."""
    keys, cols = list(keys), list(cols)
    clean = df.dropna(how="any", subset=cols)
    bounds = quantiles_wide(clean, keys, cols, [lower, upper], method)
    j = join_per_key(clean, bounds, keys)
    cond = F.lit(True)
    for i, c in enumerate(cols):
        cond = cond & (_q(c) >= F.col(f"q{i}_0")) & (_q(c) <= F.col(f"q{i}_1"))
    return j.where(cond).drop(*[f"q{i}_{k}" for i in range(len(cols)) for k in (0, 1)])


def sample_adequacy(df: DataFrame, keys=(), step: str = "") -> DataFrame:
    """(keys, n_rows, n_cols, status) with status 'no data' (0 rows),
    'not enough data' (rows < columns) or 'ok'."""
    keys = list(keys)
    ncols = len([c for c in df.columns if c not in keys])
    g = _grouped(df, keys).agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))
    return g.withColumns({"n_cols": F.lit(ncols).cast("bigint"), "step": F.lit(step)}).withColumn("status", adequacy())


def adequacy() -> Column:
    """P15's status from ``n_rows`` and ``n_cols``."""
    return F.when(F.col("n_rows") == 0, "no data").when(F.col("n_rows") < F.col("n_cols"), "not enough data").otherwise("ok")


# --------------------------------------------------------------- A1, A3
def product_counts(df: DataFrame, keys=(), product_col: str = "prod_code",
                   time_col: str = "time_bucket_local") -> DataFrame:
    """A1: non-null time count per product code (NULL codes dropped), largest first."""
    keys = list(keys)
    g = df.where(_q(product_col).isNotNull()).groupBy(*[_q(k) for k in keys], _q(product_col)) \
        .agg(F.count(_q(time_col)).cast("bigint").alias("n_points"))
    return g.orderBy(*[_q(k) for k in keys], F.desc("n_points"), _q(product_col))


def minmax_normalize(df: DataFrame, keys=(), cols=()) -> DataFrame:
    """A3: ``(x - min) / (max - min)`` per key on every listed column; a constant
    column has no scale and becomes NULL (dropped for that key)."""
    keys, cols = list(keys), list(cols)
    agg = _grouped(df, keys).agg(*[F.min(_q(c)).alias(f"_lo{i}") for i, c in enumerate(cols)],
                                 *[F.max(_q(c)).alias(f"_hi{i}") for i, c in enumerate(cols)])
    j = join_per_key(df, agg, keys)
    out = []
    for c in df.columns:
        if c in cols:
            i = cols.index(c)
            lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
            out.append(F.when(hi > lo, (_q(c) - lo) / (hi - lo)).alias(c))
        else:
            out.append(_q(c))
    return j.select(*out)
