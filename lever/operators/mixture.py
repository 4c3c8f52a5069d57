"""Gaussian mixtures of one variable (H4, H5).

Spark counts the distinct values of each (keys, variable) group, in units of the
group's standard deviation about its median, and EM for k = 1..3 runs on them; the
component count with the smallest BIC wins, and a constant variable has one.

Groups of up to ``local_values`` distinct values are fitted inside tasks, many groups a
call.  Larger groups are first summarised to about ``max_bins`` bins (equal numbers of
neighbouring values, never across two orders of distance from the median, so outliers
stay apart) and fitted there; that only gives EM its starting point.  It then goes on
over all values: an iteration is one aggregate that sums the responsibilities of every
component of every k and group, until the mean log likelihood of each has settled, and
the BIC is that of all values.
k = 1 needs no EM: its parameters and BIC are closed form (``gmm_single``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lever.functions.em1d import bic, fit_gmm_1d_batch
from lever.functions.runs import starts
from lever.functions.sizing import join_per_key, materialize
from lever.operators.ordered import ordered_scan
from lever.operators.quantiles import unpivot

REG_COVAR = 1e-6
#: Distinct values of a group that one task fits.
LOCAL_VALUES = 1 << 18
#: Cells (groups x bins) that one NumPy call works on.
CELLS = 1 << 19
#: Bins that a task gathers before it fits their groups.
HELD_ROWS = 1 << 17


def _q(c):
    return F.col(f"`{c}`")


def gmm_single(df: DataFrame, cols, keys=(), reg_covar: float = REG_COVAR) -> DataFrame:
    """H4 for k = 1, closed form: (keys, variable, n, mean, variance, bic_1).

    variance = population variance + reg_covar; bic = -2 logL + 2 ln n.
    """
    keys = list(keys)
    long = unpivot(df, keys, cols, "variable", "x").where(F.col("x").isNotNull())
    g = long.groupBy(*[_q(k) for k in keys], "variable").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("_v"))
    var = F.col("_v") + F.lit(reg_covar)
    ll = -0.5 * F.col("n") * (F.log(2 * F.lit(np.pi) * var) + F.col("_v") / var)
    return g.select(*[_q(k) for k in keys], "variable", F.col("n").cast("bigint").alias("n"), "mean",
                    var.alias("variance"), (-2 * ll + 2 * F.log(F.col("n"))).alias("bic_1"))


def compress(df: DataFrame, cols, keys=(), max_bins: int = 4096, local_values: int = LOCAL_VALUES,
             **kw) -> tuple[DataFrame, DataFrame]:
    """(keys, variable, bin, n, m, v, centre, scale): ``n`` values whose mean is centre + scale * m and whose mean
    squared deviation is scale^2 * v; every distinct value its own bin in groups of up to ``local_values``.  And
    (keys, variable, z, n, scale), the counted values of the larger groups."""
    keys = list(keys)
    g = [*keys, "variable"]
    gc = [_q(c) for c in g]
    long = unpivot(df, keys, cols, "variable", "x").where(F.col("x").isNotNull())
    values = materialize(long.groupBy(*gc, "x").agg(F.count(F.lit(1)).alias("n")))
    scan = materialize(ordered_scan(values, g, ["x"], cumsum={"cn": "n"}, index="rn", **kw))
    total = scan.groupBy(*gc).agg(F.sum("n").alias("nt"), F.count(F.lit(1)).alias("n_x"))
    scan = join_per_key(scan, total, g)
    centre = scan.where(F.col("cn") * 2 >= F.col("nt")).groupBy(*gc).agg(F.min("x").alias("centre"))
    scan = join_per_key(scan, centre, g)
    off = F.col("x") - F.col("centre")
    scale = scan.groupBy(*gc).agg(F.sqrt(F.sum(F.col("n") * off * off) / F.max("nt")).alias("scale"))
    scan = join_per_key(scan, scale, g).withColumn("scale", F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0))
    z = off / F.col("scale")
    few = F.col("n_x") <= local_values
    rank = F.when(few, F.col("rn")).otherwise(F.floor((F.col("cn") - F.col("n")) * max_bins / F.col("nt")))
    order = F.when(few | (off == 0), F.lit(0)).otherwise(F.signum(off) * (F.floor(F.log2(F.abs(off))) + 2000))
    scan = scan.withColumns({"z": z, "bin": F.struct(rank.cast("bigint").alias("rank"), order.cast("int").alias("order"))})
    bins = scan.groupBy(*gc, "bin").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("z")) / F.sum("n")).alias("m"),
                                        F.min("z").alias("z0"), F.max("z").alias("z1"),
                                        F.max("centre").alias("centre"), F.max("scale").alias("scale"))
    # a bin of one value has no spread; else squares about the bin's own mean
    spread = join_per_key(scan.where(~few), bins.select(*gc, "bin", F.col("m").alias("bm")), [*g, "bin"]) \
        .groupBy(*gc, "bin").agg((F.sum(F.col("n") * (F.col("z") - F.col("bm")) ** 2) / F.sum("n")).alias("v"))
    bins = join_per_key(bins, spread, [*g, "bin"], "left").select(
        *gc, "bin", F.col("n").cast("double").alias("n"), "m", F.coalesce("v", F.lit(0.0)).alias("v"), "centre", "scale")
    return bins, scan.where(~few).select(*gc, "z", F.col("n").cast("double").alias("n"))


def _local_fits(bins: DataFrame, g, k_max: int, reg_covar: float, max_iter: int, tol: float) -> DataFrame:
    """(g, centre, scale, total, k, weights, means, variances, ll, converged): EM on the bins, for every k that a
    group has values for; means and variances in the group's units, ``ll`` that of its values in them."""
    rows = bins.select(*[_q(c) for c in g], "bin", "n", "m", "v", F.col("centre").alias("_centre"), F.col("scale").alias("_scale"))
    rows = rows.repartition(*[_q(c) for c in g]).sortWithinPartitions(*[_q(c) for c in g], "bin").drop("bin")
    own = rows.select(*[_q(c) for c in g], "_centre", "_scale").schema
    arrow = list(to_arrow_schema(own))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in own.fields] + [
        "_total double, _k int, _w array<double>, _mu array<double>, _var array<double>, _like double, converged boolean"])

    def run(batches):
        held, size = [], 0  # rows of groups not fitted yet: some, and those of one group at most beyond that
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= HELD_ROWS:
                table = pa.Table.from_batches(held)
                start = starts(table.select(g))
                if len(start) > 1:
                    yield from fitted(table, start)
                    held = table.slice(start[-1]).combine_chunks().to_batches()
                    size = table.num_rows - start[-1]
        if size:
            table = pa.Table.from_batches(held)
            start = starts(table.select(g))
            yield from fitted(table, np.append(start, size))

    def fitted(table, start):
        """Groups that begin at ``start``, which ends with an end, some of about CELLS cells at a time."""
        sizes = np.diff(start)
        at = 0
        while at < len(sizes):
            most = np.maximum.accumulate(sizes[at:at + CELLS])
            end = at + max(1, int(np.searchsorted(most * np.arange(1, len(most) + 1), CELLS, "right")))
            yield from fits_of(table.slice(start[at], start[end] - start[at]), sizes[at:end])
            at = end

    def fits_of(table, sizes):
        G, B = len(sizes), int(sizes.max())
        filled = np.arange(B)[None, :] < sizes[:, None]
        n, m, v = (np.zeros((G, B)) for _ in range(3))
        for a, c in ((n, "n"), (m, "m"), (v, "v")):
            a[filled] = table.column(c).to_numpy()
        first = table.select([f.name for f in arrow]).take(pa.array(np.cumsum(sizes) - sizes)).combine_chunks()
        scale = first.column("_scale").to_numpy()
        for k in range(1, k_max + 1):
            wt, mu, var, ll, done = fit_gmm_1d_batch(n, m, v, k, reg_covar / scale ** 2, max_iter, tol)
            row = np.flatnonzero((k <= sizes) & ((sizes > 1) | (k == 1)))
            if not len(row):
                continue
            own = first.take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays(own.column(f.name).chunks) for f in arrow]
                + [pa.array(n.sum(1)[row]), pa.array(np.full(len(row), k, np.int32)), *(pa.array(list(a[row]), pa.list_(pa.float64())) for a in (wt, mu, var)),
                   pa.array(ll[row]), pa.array(done[row])],
                names=[*[f.name for f in arrow], "_total", "_k", "_w", "_mu", "_var", "_like", "converged"])

    return materialize(rows.mapInArrow(run, schema), "mixtures")


def _settled_fits(values: DataFrame, fits: DataFrame, g, k_max: int, reg_covar: float, max_iter: int, tol: float) -> DataFrame:
    """``fits`` of the groups in ``values`` (g, z, n), carried on over all values until they settle."""
    by = [*g, "_k"]
    state = fits.withColumn("_like", F.lit(None).cast("double")).withColumn("converged", F.lit(False))
    for _ in range(max_iter):
        state = materialize(state, "em")
        going = state.where("NOT converged")
        if going.isEmpty():
            break
        each = join_per_key(values, going.select(*[_q(c) for c in g], "_k", "_w", "_mu", "_var"), g)
        logs = F.transform(F.arrays_zip("_w", "_mu", "_var"), lambda c: F.log(c["_w"]) - 0.5 * (
            F.log(2 * F.lit(np.pi) * c["_var"]) + (F.col("z") - c["_mu"]) ** 2 / c["_var"]))
        each = each.withColumn("_l", logs).withColumn("_top", F.array_max("_l"))
        each = each.withColumn("_lse", F.col("_top") + F.log(F.aggregate("_l", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_top")))))
        sums = [F.sum(F.col("n") * F.col("_lse")).alias("_ll")]
        for c in range(k_max):
            share = F.col("n") * F.exp(F.get("_l", F.lit(c)) - F.col("_lse"))
            off = F.col("z") - F.get("_mu", F.lit(c))
            sums += [F.sum(share).alias(f"_s{c}"), F.sum(share * off).alias(f"_x{c}"), F.sum(share * off * off).alias(f"_q{c}")]
        met = join_per_key(going, each.groupBy(*[_q(c) for c in by]).agg(*sums), by)
        done = F.coalesce(F.abs(F.col("_ll") - F.col("_like")) / F.col("_total") < tol, F.lit(False))
        parts = [(F.col(f"_s{c}"), F.col(f"_x{c}") / F.col(f"_s{c}"), F.col(f"_q{c}") / F.col(f"_s{c}")) for c in range(k_max)]
        new = {"_w": [s / F.col("_total") for s, _, _ in parts],
               "_mu": [F.get("_mu", F.lit(c)) + x for c, (_, x, _) in enumerate(parts)],
               "_var": [q - x * x + reg_covar / (F.col("_scale") * F.col("_scale")) for _, x, q in parts]}
        moved = {name: F.when(done, F.col(name)).otherwise(F.slice(F.array(*cells), F.lit(1), F.col("_k"))) for name, cells in new.items()}
        met = met.select(*[_q(c) for c in fits.columns if c not in (*new, "_like", "converged")],
                         *[e.alias(name) for name, e in moved.items()], F.col("_ll").alias("_like"), done.alias("converged"))
        state = state.where("converged").unionByName(met)
    return state


def gmm_fit(df: DataFrame, cols, keys=(), k_max: int = 3, max_bins: int = 4096, reg_covar: float = REG_COVAR,
            max_iter: int = 1000, tol: float = 1e-3, local_values: int = LOCAL_VALUES, **kw) -> DataFrame:
    """H4: per (keys, variable) the best component count and its components.

    Returns (keys, variable, n_components, component, weight, mean, variance, bic,
    converged) -- one row per component of the chosen mixture, sorted by mean;
    ``converged`` says whether EM of every count tried stopped by itself within
    ``max_iter`` steps: its mean log likelihood changed by less than ``tol``.
    """
    keys = list(keys)
    g = [*keys, "variable"]
    bins, values = compress(df, cols, keys, max_bins, local_values, **kw)
    fits = _local_fits(bins, g, k_max, reg_covar, max_iter, tol)
    large = values.select(*[_q(c) for c in g]).distinct()
    if not values.isEmpty():
        started = join_per_key(fits, large, g, "left_semi")
        fits = join_per_key(fits, large, g, "left_anti").unionByName(_settled_fits(values, started, g, k_max, reg_covar, max_iter, tol))
    n = F.col("_total")
    bic = -2 * (F.col("_like") - n * F.log("_scale")) + (3 * F.col("_k") - 1) * F.log(n)
    best = fits.withColumn("bic", bic).groupBy(*[_q(c) for c in g]).agg(
        F.min_by(F.struct("_k", "_w", "_mu", "_var", "bic", "_centre", "_scale"), F.struct("bic", "_k")).alias("b"),
        F.min("converged").alias("converged"), F.max("_k").alias("tried"))
    parts = F.array_sort(F.transform(F.arrays_zip("b._w", "b._mu", "b._var"),
                                     lambda c: F.struct(c["_mu"].alias("m"), c["_w"].alias("w"), c["_var"].alias("v"))))
    out = best.select(*[_q(c) for c in g], F.col("b._k").alias("n_components"), F.posexplode(parts).alias("component", "c"),
                      "b.bic", "b._centre", "b._scale", "converged", "tried")
    return materialize(out.select(
        *[_q(c) for c in g], "n_components", "component", F.col("c.w").alias("weight"),
        (F.col("_centre") + F.col("_scale") * F.col("c.m")).alias("mean"), (F.col("_scale") * F.col("_scale") * F.col("c.v")).alias("variance"),
        F.when(F.col("tried") > 1, F.col("bic")).alias("bic"), "converged"), "mixtures")


def gmm_components(df: DataFrame, cols, keys=(), **kw) -> DataFrame:
    """H4: (keys, variable, n_components)."""
    keys = list(keys)
    fit = gmm_fit(df, cols, keys, **kw)
    return fit.groupBy(*[_q(k) for k in keys], "variable").agg(F.max("n_components").alias("n_components"))


def gmm_splits_from_params(params: DataFrame, keys=()) -> DataFrame:
    """H5 formula on a component table (keys, variable, weight, mean):
    one component -> its mean; else between neighbours sorted by mean,
    ``m_i + (m_{i+1} - m_i) * w_i / (w_i + w_{i+1})``."""
    keys = list(keys)
    g = [*keys, "variable"]
    w = Window.partitionBy(*[_q(c) for c in g]).orderBy("mean")
    p = params.withColumns({"_nm": F.lead("mean").over(w), "_nw": F.lead("weight").over(w),
                            "_k": F.count(F.lit(1)).over(Window.partitionBy(*[_q(c) for c in g])),
                            "_i": F.row_number().over(w) - 1})
    split = F.when(F.col("_k") == 1, F.col("mean")).otherwise(
        F.col("mean") + (F.col("_nm") - F.col("mean")) * F.col("weight") / (F.col("weight") + F.col("_nw")))
    out = p.where((F.col("_k") == 1) | F.col("_nm").isNotNull())
    return out.select(*[_q(c) for c in g], F.col("_i").cast("bigint").alias("split_index"),
                      split.alias("threshold"))


def gmm_splits(df: DataFrame, cols, keys=(), **kw) -> DataFrame:
    """H5: mixture split points per (keys, variable)."""
    return gmm_splits_from_params(gmm_fit(df, cols, keys, **kw), keys)
