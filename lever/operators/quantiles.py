"""Exact quantiles (linear interpolation, as pandas/NumPy default) without ordering a group.

Keys of up to ``FEW`` rows: Spark's exact percentile, which counts a group's distinct
values in one aggregate, so its memory is bounded by ``FEW``.

Larger ones: selection by narrowing brackets.  One aggregate gives, for all groups and
columns at once, a grid of approximate quantiles with a guaranteed rank error; the grid values two
steps beyond a wanted rank on both sides bracket it for certain.  The rows inside a
bracket, a fortieth of a group, are sketched again while any group's bracket may hold
more than ``FEW`` rows, and at last their distinct values are counted; all rows beyond
the bracket on its nearer side become one count on the way.  Only those few counts are
put in order.  So the number of aggregates follows the logarithm of the largest group,
equal values are one row before any ordering, and no group is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lever.functions.sizing import join_per_key, materialize

GRID = 256
ACCURACY = 16 * GRID
#: Groups up to this size need no bracket; ranks are rounded on smaller ones.
SMALL = 4 * GRID
#: Rows of a group, or of a bracket, whose values are counted.
FEW = 200_000


def _q(c):
    return F.col(f"`{c}`")


def unpivot(df: DataFrame, keys, cols, var: str = "column", val: str = "value") -> DataFrame:
    keys = list(keys)
    return df.select(*[_q(k) for k in keys], F.inline(F.array(*[
        F.struct(F.lit(c).alias(var), _q(c).cast("double").alias(val)) for c in cols])))


def _grid(x):
    return F.percentile_approx(x, [i / GRID for i in range(GRID + 1)], ACCURACY)


def _bracketed(rows: DataFrame, first, last, n) -> DataFrame:
    """``rows`` with a grid over ``n`` values as ``_grid``: _lo and _hi around the ranks first..last; NULL: open, or
    as it was before."""
    low = (F.floor(first / n * GRID) - 2).cast("int")
    high = (F.ceil((last + 1) / n * GRID) + 2).cast("int")
    known = F.col("_grid").isNotNull() & (n > SMALL)
    return rows.withColumn("_lo", F.when(known & (low > 0), F.get("_grid", low)).otherwise(F.col("_lo"))) \
        .withColumn("_hi", F.when(known & (high < GRID), F.get("_grid", high)).otherwise(F.col("_hi"))).drop("_grid")


def _inside(data: DataFrame, keys, cols, probs, brackets: DataFrame) -> DataFrame:
    """(keys, _at, _z): for each wanted quantile the rows in its bracket, and as NULL those beyond it on the side that
    it is nearer to (below for the lower half)."""
    held = brackets.groupBy(*[_q(k) for k in keys]).agg(F.sort_array(F.collect_list(F.struct("_at", "_lo", "_hi"))).alias("_b"))
    rows = join_per_key(data, held, keys)
    found = []
    for j in range(len(cols)):
        for i, p in enumerate(probs):
            at = j * len(probs) + i
            x, lo, hi = F.col(f"_x{j}"), F.get("_b", F.lit(at))["_lo"], F.get("_b", F.lit(at))["_hi"]
            under, over = F.coalesce(x < lo, F.lit(False)), F.coalesce(x > hi, F.lit(False))
            keep, gone = (~over, under) if p <= 0.5 else (~under, over)
            found.append(F.struct(F.lit(at).alias("_at"), F.when(~gone, x).alias("_z"), (keep & x.isNotNull()).alias("_keep")))
    rows = rows.select(*[_q(k) for k in keys], F.inline(F.filter(F.array(*found), lambda s: s["_keep"])))
    return rows.drop("_keep")


def exact_quantiles(df: DataFrame, keys, cols, probs) -> DataFrame:
    """(keys, column, prob, quantile) of the non-null values of each column, per key."""
    keys, cols, probs = list(keys), list(cols), [float(p) for p in probs]
    data = df.select(*[_q(k).alias(k) for k in keys], *[_q(c).cast("double").alias(f"_x{j}") for j, c in enumerate(cols)])
    sizes = data.groupBy(*[_q(k) for k in keys]).agg((F.count(F.lit(1)) > FEW).alias("_large"))
    sizes = materialize(sizes, "sizes")
    if sizes.where("_large").isEmpty():
        return _counted(data, keys, cols, probs)
    held = join_per_key(data, sizes, keys)
    return _counted(held.where("NOT _large").drop("_large"), keys, cols, probs) \
        .unionByName(_selected(held.where("_large").drop("_large"), keys, cols, probs))


def _counted(data: DataFrame, keys, cols, probs) -> DataFrame:
    wide = data.groupBy(*[_q(k) for k in keys]).agg(*[F.percentile(f"_x{j}", probs).alias(f"_g{j}") for j in range(len(cols))])
    return _long(wide, keys, cols, probs)


def _long(wide: DataFrame, keys, cols, probs) -> DataFrame:
    return wide.select(*[_q(k) for k in keys], F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(p).alias("prob"), F.get(f"_g{j}", F.lit(i)).alias("quantile"))
        for j, c in enumerate(cols) for i, p in enumerate(probs)]))).where("quantile IS NOT NULL")


def _selected(data: DataFrame, keys, cols, probs) -> DataFrame:
    wide = data.groupBy(*[_q(k) for k in keys]).agg(*[f for j in range(len(cols)) for f in (
        F.count(f"_x{j}").alias(f"_n{j}"), _grid(F.col(f"_x{j}")).alias(f"_g{j}"))])
    none = F.lit(None).cast("double")
    wanted = wide.select(*[_q(k) for k in keys], F.inline(F.array(*[
        F.struct(F.lit(j * len(probs) + i).alias("_at"), F.lit(p).alias("prob"), F.col(f"_n{j}").alias("_n"), F.col(f"_g{j}").alias("_grid"))
        for j in range(len(cols)) for i, p in enumerate(probs)]))).where("_n > 0")
    h = (F.col("_n") - 1) * F.col("prob")
    wanted = wanted.withColumns({"_i": F.floor(h), "_j": F.least(F.floor(h) + 1, F.col("_n") - 1), "_part": h - F.floor(h),
                                 "_lo": none, "_hi": none})
    brackets = materialize(_bracketed(wanted, F.col("_i"), F.col("_j"), F.col("_n")), "brackets")
    by = [*keys, "_at"]
    most = (brackets.agg(F.max("_n")).first()[0] or 0) * 6 / GRID
    while most > FEW:
        rows = _inside(data, keys, cols, probs, brackets)
        again = rows.groupBy(*[_q(c) for c in by]).agg(F.count("_z").alias("_m"), F.count(F.lit(1)).alias("_all"),
                                                      _grid(F.col("_z")).alias("_grid"))
        met = join_per_key(brackets, again, by)
        under = F.when(F.col("prob") <= 0.5, F.col("_all") - F.col("_m")).otherwise(F.col("_n") - F.col("_all"))
        narrowed = _bracketed(met, F.col("_i") - under, F.col("_j") - under, F.col("_m"))
        brackets = materialize(narrowed.drop("_m", "_all"), "brackets")
        most = most * 6 / GRID
    counts = _inside(data, keys, cols, probs, brackets).groupBy(*[_q(c) for c in by], "_z").agg(F.count(F.lit(1)).alias("_c"))
    met = join_per_key(counts, brackets, by)
    upper = F.col("prob") > 0.5  # counted from the top
    order = Window.partitionBy(*[_q(c) for c in by]).orderBy(F.col("_z").isNotNull(), F.when(upper, -F.col("_z")).otherwise(F.col("_z")))
    met = met.withColumn("_upto", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)))

    def value(at):
        rank = F.when(upper, F.col("_n") - 1 - at).otherwise(at)
        return F.max(F.when((F.col("_upto") - F.col("_c") <= rank) & (rank < F.col("_upto")), F.col("_z")))

    found = met.groupBy(*[_q(c) for c in by]).agg(F.max("prob").alias("prob"), F.max("_part").alias("_part"),
                                                 value(F.col("_i")).alias("_a"), value(F.col("_j")).alias("_b"))
    names = F.array(*[F.lit(c) for c in cols])
    return found.select(*[_q(k) for k in keys], F.get(names, F.floor(F.col("_at") / len(probs)).cast("int")).alias("column"), "prob",
                        (F.col("_a") + F.col("_part") * (F.col("_b") - F.col("_a"))).alias("quantile"))


def approximate_quantiles(df: DataFrame, keys, cols, probs, accuracy: int = 100_000) -> DataFrame:
    """Like :func:`exact_quantiles`, from Spark's bounded sketch alone."""
    keys, probs = list(keys), [float(p) for p in probs]
    wide = df.groupBy(*[_q(k) for k in keys]).agg(*[
        F.percentile_approx(_q(c).cast("double"), probs, accuracy).alias(f"_g{j}") for j, c in enumerate(cols)])
    return _long(wide, keys, cols, probs)


def quantiles_long(long: DataFrame, group, value: str, probs, method: str = "exact") -> DataFrame:
    """Per ``group``: rows ``(group..., prob, quantile)`` of non-null ``value``."""
    find = exact_quantiles if method == "exact" else approximate_quantiles
    return find(long, group, [value], probs).drop("column")


def quantiles_wide(df: DataFrame, keys, cols, probs, method: str = "exact") -> DataFrame:
    """One row per key: ``q{i}_{k}`` is quantile ``probs[k]`` of column i."""
    keys = list(keys)
    find = exact_quantiles if method == "exact" else approximate_quantiles
    found = find(df, keys, cols, probs)
    return found.groupBy(*[_q(k) for k in keys]).agg(*[
        F.max(F.when((F.col("column") == c) & (F.col("prob") == float(p)), F.col("quantile"))).alias(f"q{i}_{k}")
        for i, c in enumerate(cols) for k, p in enumerate(probs)])
