"""Exact one-variable regression-tree splits (B1) and segment summaries (B2-B4,
A5, A6, J1).

Best split search without fitting a tree on one machine:

1. long form ``(keys, variable, x, y)``,
2. aggregate to distinct x: n, mean and variance of y (partial aggregation), and
   from these the sums about the group's mean,
3. running sums over x (blocked ordered scan -- hot groups stay parallel),
4. the squared-error gain of cutting after each distinct x,
   ``sl^2/nl + sr^2/nr - st^2/nt``, is one column expression; the best cut is
   an aggregate (ties -> smallest x), the threshold is the midpoint to the next
   distinct x.

Depth 2 reuses the same running sums: the children of the root are x-ranges,
so their sums are differences of running sums -- no second pass over the data.
A node is split only when it has at least ``ceil(min_samples_split * N)`` and
2 rows, a non-zero variance and two distinct x values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lever.functions.columns import join_on
from lever.functions.sizing import join_per_key, materialize
from lever.operators.ordered import ordered_scan
from lever.operators.quantiles import FEW, quantiles_wide

REL_EPS = 1e-12


def _q(c):
    return F.col(f"`{c}`")


def xy_long(df: DataFrame, keys, variables, target: str) -> DataFrame:
    """(keys, variable, x, y) for every chosen variable; rows with a NULL dropped."""
    keys = list(keys)
    long = df.select(*[_q(k) for k in keys], _q(target).cast("double").alias("y"), F.inline(F.array(*[
        F.struct(F.lit(v).alias("variable"), _q(v).cast("double").alias("x")) for v in variables])))
    return long.where(F.col("x").isNotNull() & F.col("y").isNotNull())


def _gain(nl, sl, nn, sn):
    nr, sr = nn - nl, sn - sl
    return sl * sl / nl + sr * sr / nr - sn * sn / nn


def tree_splits(df: DataFrame, keys, variables, target: str, depth=1,
                min_samples_split: float = 0.2, nonneg_only: bool = False, **kw) -> DataFrame:
    """B1: thresholds of a squared-error regression tree on one variable.

    ``depth`` is 1, 2, or a DataFrame ``(keys, variable, depth)`` choosing it per
    group (B1a/B1b).  Returns (keys, variable, node, threshold, gain, n_left,
    n_right), node in root/left/right; the thresholds sorted are the tree's.
    ``nonneg_only`` drops negative thresholds like the original filter did.
    """
    keys = list(keys)
    g = [*keys, "variable"]
    # distinct-x summaries (bounded by distinct values, not rows), written once: the totals, the
    # cuts of the running sums and the running sums all read them
    per_x = materialize(xy_long(df, keys, variables, target).groupBy(*[_q(c) for c in g], "x").agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("_m"), F.var_pop("y").alias("_v")))
    ybar = per_x.groupBy(*[_q(c) for c in g]).agg((F.sum(F.col("n") * F.col("_m")) / F.sum("n")).alias("_ybar"))
    off = F.col("_m") - F.col("_ybar")
    per_x = join_per_key(per_x, ybar, g).withColumns({
        "s": F.col("n") * off, "q": F.col("n") * (F.col("_v") + off * off)}).drop("_m", "_v", "_ybar")
    scan = materialize(ordered_scan(per_x, g, ["x"], cumsum={"cn": "n", "cs": "s", "cq": "q"}, index="rn", **kw))

    tot = per_x.groupBy(*[_q(c) for c in g]).agg(
        F.sum("n").alias("nt"), F.sum("s").alias("st"), F.sum("q").alias("qt"), F.count(F.lit(1)).alias("n_x"))
    if isinstance(depth, DataFrame):
        tot = join_on(tot, depth.select(*[_q(c) for c in g], F.col("depth").cast("int").alias("depth")), g, "left")
        tot = tot.withColumn("depth", F.coalesce("depth", F.lit(2)))
    else:
        tot = tot.withColumn("depth", F.lit(int(depth)))
    tot = tot.withColumn("min_split", F.greatest(F.ceil(F.col("nt") * F.lit(min_samples_split)), F.lit(2)))
    tot = tot.withColumn("var_tol", F.lit(REL_EPS) * F.greatest(F.col("qt") / F.col("nt"), F.lit(1e-300)))
    s = join_per_key(scan, tot, g)

    def splittable(nn, sn, qn):
        imp = qn / nn - (sn / nn) * (sn / nn)
        return (nn >= F.col("min_split")) & (imp > F.col("var_tol"))

    def best(frame, gain_col, extra_group):
        keyed = frame.groupBy(*[_q(c) for c in g], *extra_group).agg(
            F.min_by(F.struct("x", "rn", "cn", "cs", "cq", F.col(gain_col).alias("gain")),
                     F.struct((-F.col(gain_col)).alias("ng"), F.col("x"))).alias("b"))
        return keyed.select(*[_q(c) for c in g], *extra_group, "b.*")

    root_c = s.where((F.col("cn") < F.col("nt")) & splittable(F.col("nt"), F.col("st"), F.col("qt")))
    root_c = root_c.withColumn("_g", _gain(F.col("cn"), F.col("cs"), F.col("nt"), F.col("st")))
    root = best(root_c, "_g", [])
    root = root.select(*[_q(c) for c in g], F.lit("root").alias("node"), "x", "rn", "gain",
                       F.col("cn").alias("n_left"), "cn", "cs", "cq")

    # depth 2: children of the root, from the same running sums
    r2 = root.select(*[_q(c) for c in g], F.col("rn").alias("_rrn"), F.col("cn").alias("_rn_"),
                     F.col("cs").alias("_rs"), F.col("cq").alias("_rq"))
    s2 = join_on(s.where(F.col("depth") >= 2), r2, g)
    left = s2.where((F.col("rn") < F.col("_rrn")) & splittable(F.col("_rn_"), F.col("_rs"), F.col("_rq")))
    left = left.withColumn("_g", _gain(F.col("cn"), F.col("cs"), F.col("_rn_"), F.col("_rs")))
    rn_node, rs_node, rq_node = F.col("nt") - F.col("_rn_"), F.col("st") - F.col("_rs"), F.col("qt") - F.col("_rq")
    right = s2.where((F.col("rn") > F.col("_rrn")) & (F.col("cn") < F.col("nt"))
                     & splittable(rn_node, rs_node, rq_node))
    right = right.withColumn("_g", _gain(F.col("cn") - F.col("_rn_"), F.col("cs") - F.col("_rs"),
                                         rn_node, rs_node)) \
        .withColumn("_nl", F.col("cn") - F.col("_rn_"))
    bl = best(left, "_g", []).select(*[_q(c) for c in g], F.lit("left").alias("node"), "x", "rn", "gain",
                                     F.col("cn").alias("n_left"), "cn", "cs", "cq")
    br = best(right.withColumn("cn", F.col("_nl")), "_g", []).select(
        *[_q(c) for c in g], F.lit("right").alias("node"), "x", "rn", "gain",
        F.col("cn").alias("n_left"), "cn", "cs", "cq")
    nodes = root.unionByName(bl).unionByName(br)
    # threshold = midpoint to the next distinct x (row rn + 1)
    nxt = scan.select(*[_q(c) for c in g], (F.col("rn") - 1).alias("rn"), F.col("x").alias("_x_next"))
    out = join_on(nodes, nxt, [*g, "rn"])
    thr = F.col("x") / 2.0 + F.col("_x_next") / 2.0
    thr = F.when((thr == F.col("_x_next")), F.col("x")).otherwise(thr)
    out = out.select(*[_q(c) for c in g], "node", thr.alias("threshold"), F.col("gain").alias("gain"),
                     F.col("n_left").cast("bigint").alias("n_left"))
    if nonneg_only:
        out = out.where(F.col("threshold") >= 0)
    # a few rows per group, read by every later step (segments, histograms, boxes)
    return materialize(out)


def split_arrays(splits: DataFrame, keys) -> DataFrame:
    """(keys, variable, splits array<double> sorted)."""
    keys = list(keys)
    return splits.groupBy(*[_q(k) for k in keys], "variable").agg(
        F.array_sort(F.collect_list("threshold")).alias("splits"))


def label_number(x):
    """Two-decimal text of a threshold, rounded half away from zero on the double
    (identical in every SQL engine): 0.065 -> '0.07', -1.5 -> '-1.50'."""
    r = F.floor(F.abs(x) * 100 + 0.5).cast("bigint")
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, F.floor(r / 100).cast("bigint").cast("string"), F.lit("."),
                    F.lpad((r % 100).cast("string"), 2, "0"))


def _with_segment(df: DataFrame, keys, variables, target: str, splits: DataFrame) -> DataFrame:
    """(keys, variable, x, y, splits, segment): as :func:`xy_long`, with the variable's splits and the segment of x; no
    rows for a variable without splits.  A key's splits travel as one row, so rows meet them before they are unpivoted."""
    keys = list(keys)
    held = split_arrays(splits, keys).groupBy(*[_q(k) for k in keys]).agg(F.array(*[
        F.max(F.when(F.col("variable") == v, F.col("splits"))) for v in variables]).alias("_splits"))
    names = dict.fromkeys([*keys, *variables, target])
    met = join_per_key(df.select(*[_q(c) for c in names]).where(_q(target).isNotNull()), held, keys)
    long = met.select(*[_q(k) for k in keys], _q(target).cast("double").alias("y"), F.inline(F.array(*[
        F.struct(F.lit(v).alias("variable"), _q(v).cast("double").alias("x"), F.get("_splits", F.lit(j)).alias("splits"))
        for j, v in enumerate(variables)])))
    long = long.where("x IS NOT NULL AND y IS NOT NULL AND splits IS NOT NULL")
    return long.withColumn("segment", F.size(F.filter("splits", lambda s: s <= F.col("x"))).cast("bigint"))


def _bounds():
    m = F.size("splits")
    return {"seg_lo": F.when(F.col("segment") > 0, F.element_at("splits", F.col("segment").cast("int"))),
            "seg_hi": F.when(F.col("segment") < m, F.element_at("splits", (F.col("segment") + 1).cast("int")))}


def _label(seg_lo, seg_hi, n_splits, outlier):
    single = n_splits == 1
    lab = (F.when(seg_lo.isNull(), F.concat(F.lit("<"), label_number(seg_hi)))
           .when(seg_hi.isNull(), F.concat(F.when(single, F.lit(">=")).otherwise(F.lit(">")), label_number(seg_lo)))
           .otherwise(F.concat(label_number(seg_lo), F.lit("-"), label_number(seg_hi))))
    return F.concat(lab, F.when(outlier, F.lit(" (Outlier)")).otherwise(F.lit("")))


def _segments(counts: DataFrame, keys, splits: DataFrame, outlier_share: float) -> DataFrame:
    """Every segment of every variable, empty ones too: bounds, share, outlier flag, label and the columns of
    ``counts`` (keys, variable, segment, n, ...), of which there is one row per segment."""
    g = [*keys, "variable"]
    cats = split_arrays(splits, keys)
    cats = cats.select(*[_q(c) for c in g], "splits", F.explode(F.sequence(F.lit(0), F.size("splits"))).alias("segment"))
    cats = cats.withColumn("segment", F.col("segment").cast("bigint")).withColumns(_bounds())
    out = join_on(cats, counts, [*g, "segment"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))
    total = F.sum("n").over(Window.partitionBy(*[_q(c) for c in g]))  # a few segments per variable
    out = out.withColumn("share", F.when(total > 0, F.col("n") / total).otherwise(0.0))
    out = out.withColumn("is_outlier", (F.size("splits") >= 2) & (F.col("share") < F.lit(outlier_share)))
    label = _label(F.col("seg_lo"), F.col("seg_hi"), F.size("splits"), F.col("is_outlier"))
    return out.withColumn("label", label).drop("splits")


def segment_rows(df: DataFrame, keys, variables, target: str, splits: DataFrame,
                 outlier_share: float = 0.1) -> DataFrame:
    """B2 (+A6): each row's segment of the variable's split list.

    One split s: ``x < s`` / ``x >= s``.  Splits s0 < ... < sm: ``x < s0``,
    ``s[i-1] <= x < s[i]``, and ``x >= sm`` for the last (a row equal to the
    last split belongs to it).  With two or more splits a segment holding
    under ``outlier_share`` of the rows is labelled ``(Outlier)``.
    Returns (keys, variable, x, y, segment, seg_lo, seg_hi, label, share, is_outlier).
    """
    keys = list(keys)
    g = [*keys, "variable"]
    rows = _with_segment(df, keys, variables, target, splits)
    counts = rows.groupBy(*[_q(c) for c in g], "segment").agg(F.count(F.lit(1)).alias("n"))
    info = _segments(counts, keys, splits, outlier_share)
    # each variable's few segments travel as one array, so rows meet them in one per-key join
    packed = info.groupBy(*[_q(c) for c in g]).agg(F.array_sort(F.collect_list(
        F.struct("segment", "seg_lo", "seg_hi", "label", "share", "is_outlier"))).alias("_segs"))
    rows = join_per_key(rows, packed, g)
    return rows.withColumn("_s", F.element_at("_segs", (F.col("segment") + 1).cast("int"))).select(
        *[_q(k) for k in keys], "variable", "x", "y", "segment", "_s.seg_lo", "_s.seg_hi", "_s.label", "_s.share",
        "_s.is_outlier")


def segment_summary(df: DataFrame, keys, variables, target: str, splits: DataFrame,
                    outlier_share: float = 0.1, exact_scale: int | None = None) -> DataFrame:
    """B3 (+A5, J1): mean target per segment in split order; empty segments kept
    with n = 0 and a NULL mean.  (keys, variable, segment, label, n, share, mean_target).

    Rows are aggregated to segments at once; share and label come from the few
    segment rows.  ``exact_scale`` computes the mean as an exact fixed-point average
    rounded to that many decimals (reproducible under any partitioning)."""
    keys = list(keys)
    g = [*keys, "variable"]
    if exact_scale is None:
        mean = F.avg("y")
    else:
        # units of 10^-scale as decimals: a bigint sum would overflow from about 1e13 units a row on.  The
        # quotient and rest of whole numbers round half up without dividing decimals
        units = F.sum(F.round(F.col("y") * F.lit(10.0 ** exact_scale)).cast("decimal(28,0)"))
        cnt = F.count("y").cast("decimal(20,0)")
        rest = F.pmod(units, cnt)
        low = ((units - rest) / cnt).cast("decimal(38,0)")
        q = F.when(cnt > 0, low + F.when(2 * rest >= cnt, 1).otherwise(0))
        mean = q.cast("double") / F.lit(10.0 ** exact_scale)
    rows = _with_segment(df, keys, variables, target, splits)
    agg = rows.groupBy(*[_q(c) for c in g], "segment").agg(F.count(F.lit(1)).alias("n"), mean.alias("mean_target"))
    return _segments(agg, keys, splits, outlier_share).select(
        *[_q(c) for c in g], "segment", "seg_lo", "seg_hi", "label", "n", "share", "mean_target")


def segment_boxstats(df: DataFrame, keys, variables, target: str, splits: DataFrame,
                     whis: float = 1.5) -> DataFrame:
    """Box-plot numbers per segment: q1, median, q3 (linear interpolation),
    whiskers = most extreme values within ``whis`` * IQR of the box, outlier count.

    The values of a segment of up to ``FEW`` rows are put in order in one aggregate, which gives them all; larger
    ones take quartiles by selection (no ordering), then one aggregate for the rest."""
    keys = list(keys)
    gs = [*keys, "variable", "segment"]
    rows = _with_segment(df, keys, variables, target, splits).select(*[_q(c) for c in gs], "y")
    found = df.groupBy(*[_q(k) for k in keys]).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > FEW)
    if found.isEmpty():  # no key is large, so no segment is
        agg = _ordered_boxes(rows, gs, whis)
    else:
        sizes = materialize(rows.groupBy(*[_q(c) for c in gs]).agg((F.count(F.lit(1)) > FEW).alias("_large")), "sizes")
        held = join_per_key(rows, sizes, gs)
        agg = _ordered_boxes(held.where("NOT _large").drop("_large"), gs, whis) \
            .unionByName(_selected_boxes(held.where("_large").drop("_large"), gs, whis))
    return _segments(agg, keys, splits, 0.1).where("n > 0").select(
        *[_q(c) for c in gs], "label", "n", "q1", "median", "q3", "whisker_lo", "whisker_hi", "n_outliers")


def _ordered_boxes(rows: DataFrame, gs, whis: float) -> DataFrame:
    """Box numbers of groups of few ``y``, from their values in order."""
    held = rows.groupBy(*[_q(c) for c in gs]).agg(F.sort_array(F.collect_list("y")).alias("_y")).withColumn("_n", F.size("_y"))

    def quantile(p):  # as Spark's percentile puts it
        at = (F.col("_n") - 1) * F.lit(p)
        low, high = F.get("_y", F.floor(at).cast("int")), F.get("_y", F.ceil(at).cast("int"))
        return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

    held = held.withColumns({"q1": quantile(0.25), "median": quantile(0.5), "q3": quantile(0.75)})
    reach = whis * (F.col("q3") - F.col("q1"))
    held = held.withColumns({"_lim_lo": F.col("q1") - reach, "_lim_hi": F.col("q3") + reach})
    held = held.withColumns({"_low": F.size(F.filter("_y", lambda y: y < F.col("_lim_lo"))),
                             "_high": F.size(F.filter("_y", lambda y: y > F.col("_lim_hi")))})
    return held.select(*[_q(c) for c in gs], F.col("_n").cast("bigint").alias("n"), "q1", "median", "q3",
                       F.get("_y", F.col("_low")).alias("whisker_lo"),
                       F.get("_y", F.col("_n") - 1 - F.col("_high")).alias("whisker_hi"),
                       (F.col("_low") + F.col("_high")).cast("bigint").alias("n_outliers"))


def _selected_boxes(rows: DataFrame, gs, whis: float) -> DataFrame:
    """Box numbers of groups of any size."""
    box = quantiles_wide(rows, gs, ["y"], [0.25, 0.5, 0.75]).toDF(*gs, "q1", "median", "q3")
    reach = whis * (F.col("q3") - F.col("q1"))
    j = join_per_key(rows, box.withColumns({"_lim_lo": F.col("q1") - reach, "_lim_hi": F.col("q3") + reach}), gs)
    low, high = F.col("y") < F.col("_lim_lo"), F.col("y") > F.col("_lim_hi")
    return j.groupBy(*[_q(c) for c in gs]).agg(
        F.count(F.lit(1)).alias("n"), F.max("q1").alias("q1"), F.max("median").alias("median"), F.max("q3").alias("q3"),
        F.min(F.when(~low, F.col("y"))).alias("whisker_lo"), F.max(F.when(~high, F.col("y"))).alias("whisker_hi"),
        F.count(F.when(low | high, 1)).alias("n_outliers"))


def depth_from_count(counts: DataFrame, keys, count_col: str, one_means_depth1: bool = True) -> DataFrame:
    """B1a/B1b rule: depth 1 when exactly one component/peak, else 2."""
    keys = list(keys)
    return counts.select(*[_q(k) for k in keys], "variable",
                         F.when(F.col(count_col) == 1, 1).otherwise(2).alias("depth"))
