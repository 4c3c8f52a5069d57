"""Distribution profiling: equal-width histograms (H1, H2), histogram peaks
(H3), rolling mean (W3) and evenly spaced ticks (W4).

Histograms are computed for many variables and keys at once on the long form
``(keys, variable, x)``: one aggregate for the ranges, one partial-aggregated
``groupBy(bin)`` for the counts.  Bin edges follow NumPy's equal-width rule
(edge_i = lo + i*width, last edge = hi, last bin closed; a constant column gets
the range [v-0.5, v+0.5]) so bin membership is the same as ``np.histogram``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lever.functions.columns import join_on
from lever.functions.sizing import join_per_key, materialize
from lever.operators.ordered import ordered_scan, rolling_mean
from lever.operators.quantiles import unpivot


def _q(c):
    return F.col(f"`{c}`")


def _edge(lo, hi, width, i, bins):
    return F.when(i >= bins, hi).otherwise(lo + i * width)


def bin_index(x, lo, hi, bins: int):
    """0-based bin of ``x`` in ``bins`` equal-width bins over [lo, hi]."""
    width = (hi - lo) / F.lit(bins)
    i0 = F.least(F.floor((x - lo) * (F.lit(bins) / (hi - lo))), F.lit(bins - 1))
    return (F.when(x < _edge(lo, hi, width, i0, bins), i0 - 1)
            .when((x >= _edge(lo, hi, width, i0 + 1, bins)) & (i0 != bins - 1), i0 + 1)
            .otherwise(i0)).cast("bigint")


def histogram(df: DataFrame, cols, keys=(), bins: int = 100) -> DataFrame:
    """H1: 100-bin histogram of each column per key: (keys, variable, bin, bin_lo, bin_hi, n), empty bins included
    with ``n = 0``.  NULLs are ignored.  A key's ranges travel as one row, so rows meet them before they are unpivoted."""
    keys, cols = list(keys), list(cols)
    group = [*keys, "variable"]
    rng = unpivot(df, keys, cols, "variable", "_x").where("_x IS NOT NULL").groupBy(*[_q(g) for g in group]).agg(
        F.min("_x").alias("_mn"), F.max("_x").alias("_mx"))
    rng = rng.select(*[_q(g) for g in group],
                     F.when(F.col("_mn") == F.col("_mx"), F.col("_mn") - 0.5).otherwise(F.col("_mn")).alias("_lo"),
                     F.when(F.col("_mn") == F.col("_mx"), F.col("_mx") + 0.5).otherwise(F.col("_mx")).alias("_hi"))
    held = rng.groupBy(*[_q(k) for k in keys]).agg(F.array(*[
        F.max(F.when(F.col("variable") == c, F.struct("_lo", "_hi"))) for c in cols]).alias("_r"))
    met = join_per_key(df.select(*[_q(c) for c in dict.fromkeys([*keys, *cols])]), held, keys)
    long = met.select(*[_q(k) for k in keys], F.inline(F.array(*[
        F.struct(F.lit(c).alias("variable"), _q(c).cast("double").alias("_x"), F.get("_r", F.lit(j)).alias("_at"))
        for j, c in enumerate(cols)]))).where("_x IS NOT NULL")
    counts = long.groupBy(*[_q(g) for g in group], bin_index(F.col("_x"), F.col("_at._lo"), F.col("_at._hi"), bins).alias("bin")) \
        .agg(F.count(F.lit(1)).alias("_n"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    grid = rng.select(*[_q(g) for g in group], "_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    grid = grid.select(*[_q(g) for g in group], F.col("bin").cast("bigint").alias("bin"),
                       _edge(F.col("_lo"), F.col("_hi"), width, F.col("bin"), bins).alias("bin_lo"),
                       _edge(F.col("_lo"), F.col("_hi"), width, F.col("bin") + 1, bins).alias("bin_hi"))
    out = join_on(grid, counts, [*group, "bin"], "left")
    return out.select(*[_q(g) for g in group], "bin", "bin_lo", "bin_hi", F.coalesce(F.col("_n"), F.lit(0)).cast("bigint").alias("n"))


def histogram_with_splits(df: DataFrame, cols, splits: DataFrame, keys=(), bins: int = 100) -> DataFrame:
    """H2: H1 plus ``has_split``: a split value falls in the bin ([lo, hi), last bin closed).

    ``splits`` holds (keys, variable, threshold) rows.
    """
    keys = list(keys)
    h = histogram(df, cols, keys, bins)
    arr = splits.groupBy(*[_q(k) for k in keys], "variable").agg(
        F.collect_list("threshold").alias("_splits"))
    j = join_on(h, arr, [*keys, "variable"], "left")
    last = F.col("bin") == bins - 1
    mark = F.exists(F.coalesce(F.col("_splits"), F.array().cast("array<double>")),
                    lambda s: (s >= F.col("bin_lo")) & ((s < F.col("bin_hi")) | (last & (s <= F.col("bin_hi")))))
    return j.withColumn("has_split", mark).drop("_splits")


def histogram_peaks(df: DataFrame, cols, keys=(), bins: int = 10, min_share: float = 0.1) -> DataFrame:
    """H3: peaks of a ``bins``-bin histogram: interior local maxima (a flat top
    counts once, at its middle bin rounded down) whose height lies in
    [min_share*N, N].  Returns (keys, variable, bin, peak) with ``peak`` the
    right edge of the peak bin.  Runs of equal counts are found with
    gaps-and-islands over the (bounded) bins of each group.
    """
    keys = list(keys)
    group = [*keys, "variable"]
    h = materialize(histogram(df, cols, keys, bins))  # bins rows per group, read three times
    n_tot = h.groupBy(*[_q(g) for g in group]).agg(F.sum("n").alias("_N"))
    w = Window.partitionBy(*[_q(g) for g in group]).orderBy("bin")
    h = h.withColumn("_chg", F.when(F.lag("n").over(w) == F.col("n"), 0).otherwise(1))
    h = h.withColumn("_run", F.sum("_chg").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = h.groupBy(*[_q(g) for g in group], "_run").agg(
        F.min("bin").alias("_s"), F.max("bin").alias("_e"), F.max("n").alias("_h"),
        F.max_by("bin_hi", "bin").alias("_edge_last"))
    wr = Window.partitionBy(*[_q(g) for g in group]).orderBy("_run")
    runs = runs.withColumns({"_prev": F.lag("_h").over(wr), "_next": F.lead("_h").over(wr)})
    peaks = runs.where((F.col("_s") >= 1) & (F.col("_e") <= bins - 2)
                       & (F.col("_prev") < F.col("_h")) & (F.col("_next") < F.col("_h")))
    peaks = peaks.withColumn("bin", F.floor((F.col("_s") + F.col("_e")) / 2).cast("bigint"))
    peaks = join_on(peaks, n_tot, group)
    peaks = peaks.where((F.col("_h") >= F.col("_N") * F.lit(min_share)) & (F.col("_h") <= F.col("_N")))
    edges = h.select(*[_q(g) for g in group], "bin", F.col("bin_hi").alias("peak"))
    return join_on(peaks.select(*[_q(g) for g in group], "bin"), edges, [*group, "bin"])


def rolling_mean_48(df: DataFrame, keys, order, col: str, size: int = 48, **kw) -> DataFrame:
    """``col`` and its mean over the last ``size`` rows (24 h of 30-minute buckets)."""
    return rolling_mean(df, keys, order, col, size, name=f"{col}_moving_avg", **kw)


def tick_sample(df: DataFrame, keys, order, n_ticks: int = 8, **kw) -> DataFrame:
    """Every n-th row per key, n = rows // n_ticks (at least 1), starting at the first."""
    d = ordered_scan(df, keys, order, index="_t_rn", count="_t_n", **kw)
    step = F.greatest(F.floor(F.col("_t_n") / n_ticks), F.lit(1))
    return d.where(F.col("_t_rn") % step == 0).withColumn("tick", (F.col("_t_rn") / step).cast("bigint")) \
        .drop("_t_rn", "_t_n")
