"""End-to-end jobs (E1-E5): the analysis flow as lazy Spark plans over every
machine at once.  Filled rows, decisions and fits that several steps read are
written once; everything else stays one DataFrame plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lever.functions.columns import join_on
from lever.functions.sizing import join_per_key, materialize
from lever.operators import mixture as G
from lever.operators import models as M
from lever.operators import prep as P
from lever.operators import profile as H
from lever.operators import splits as B
from lever.schema import SeriesSchema


def _q(c):
    return F.col(f"`{c}`")


#: E1's steps in order, as its report names them.
STEPS = ("filled, product filter", "sparse columns", "dates", "constant columns", "min target", "max target", "complete rows",
         "excluded variables")


def prepare_training(df: DataFrame, schema: SeriesSchema, codes, target: str, *, start=None, end=None,
                     min_target=None, max_target=None, exclude=(), sparse_threshold: float = 0.3,
                     **kw) -> DataFrame:
    """Fill -> product filter -> sparse columns (P6) -> dates -> features only
    -> zero variance (P8) -> target range with guards (P10, P11) -> complete rows
    (P12) -> exclusions.  Keeps keys and order columns plus features.

    The filled rows are written once.  One conditional aggregate per key then
    yields every decision, and one join and one filter apply them.  With keys, a
    column pruned for a key is NULL there, and a key whose target is pruned has no
    rows; without keys pruned columns are dropped and a pruned target is an error.
    """
    return _prepared(df, schema, codes, target, start, end, min_target, max_target, exclude, sparse_threshold, **kw)[0]


def prepare_training_with_report(df: DataFrame, schema: SeriesSchema, codes, target: str, *, start=None, end=None,
                                 min_target=None, max_target=None, exclude=(), sparse_threshold: float = 0.3,
                                 **kw) -> tuple[DataFrame, DataFrame]:
    """E1 with its status along the way (S5, P15): the prepared rows, and (keys, step_no, step, n_rows, n_cols, status).

    ``n_cols`` counts the feature columns that are left for the key; status is that of P15.  Both read the filled rows
    that were written once, the report only by the decisions' aggregate and one count: the source is not read again.
    """
    return _prepared(df, schema, codes, target, start, end, min_target, max_target, exclude, sparse_threshold, **kw)


def _prepared(df, schema, codes, target, start, end, min_target, max_target, exclude, sparse_threshold, **kw):
    keys = list(schema.keys)
    feats = schema.features(df)
    if target not in feats:
        raise ValueError(f"target {target!r} is not a feature")
    names = [*keys, *schema.order, *feats]
    d = P.forward_fill(df, schema, **kw)
    if codes:
        d = P.product_filter(d, codes, schema.product_col)
    dated = F.lit(True)
    if start is not None:
        dated = dated & (P._time(d, schema.time_col) >= P._time_lit(d, schema.time_col, start))
    if end is not None:
        dated = dated & (P._time(d, schema.time_col) <= P._time_lit(d, schema.time_col, end))
    d = materialize(d.select(*[_q(c) for c in dict.fromkeys(names)], F.coalesce(dated, F.lit(False)).alias("_in")))

    y = _q(target)
    over = F.lit(True) if min_target is None else y >= F.lit(float(min_target))
    under = F.lit(True) if max_target is None else y <= F.lit(float(max_target))
    inside = {(a, b): F.col("_in") & (over if a else F.lit(True)) & (under if b else F.lit(True))
              for a in (0, 1) for b in (0, 1)}
    aggs = [F.count(F.lit(1)).alias("_n"), F.max(F.when(F.col("_in"), y)).alias("_tmax"),
            F.min(F.when(F.col("_in"), y)).alias("_tmin0"), F.min(F.when(F.col("_in") & over, y)).alias("_tmin1")]
    for i, c in enumerate(feats):
        aggs += [F.count(_q(c)).alias(f"_nn{i}"),
                 (F.max(F.when(F.col("_in"), _q(c))) > F.min(F.when(F.col("_in"), _q(c)))).alias(f"_var{i}")]
        aggs += [F.count(F.when(cond, _q(c))).alias(f"_c{i}_{a}{b}") for (a, b), cond in inside.items()]
    aggs += [F.count_if(cond).alias(f"_r{a}{b}") for (a, b), cond in inside.items()]
    found = (d.groupBy(*[_q(k) for k in keys]) if keys else d.groupBy()).agg(*aggs)
    dense = [F.col(f"_nn{i}") > F.col("_n") * F.lit(float(sparse_threshold)) for i in range(len(feats))]
    keep = [F.coalesce(d6 & F.col(f"_var{i}"), F.lit(False)) for i, d6 in enumerate(dense)]
    min_ok = F.lit(False) if min_target is None else F.coalesce(F.lit(float(min_target)) <= F.col("_tmax"), F.lit(True))
    found = found.select(*[_q(k) for k in keys], "_n", "_tmin0", "_tmin1", min_ok.alias("_a"), "_r00", "_r01", "_r10", "_r11",
                         sum(d6.cast("bigint") for d6 in dense).alias("_dense"),
                         *[k.alias(f"_keep{i}") for i, k in enumerate(keep)],
                         *[f"_c{i}_{a}{b}" for i in range(len(feats)) for a, b in inside])
    low = F.when(F.col("_a"), F.col("_tmin1")).otherwise(F.col("_tmin0"))
    max_ok = F.lit(False) if max_target is None else F.coalesce(F.lit(float(max_target)) > low, F.lit(True))
    found = found.withColumn("_b", max_ok)
    held = [F.when(F.col("_a") & F.col("_b"), F.col(f"_c{i}_11")).when(F.col("_a"), F.col(f"_c{i}_10"))
            .when(F.col("_b"), F.col(f"_c{i}_01")).otherwise(F.col(f"_c{i}_00")) for i in range(len(feats))]
    decided = found.select(*[_q(k) for k in keys], "_a", "_b", *[f"_keep{i}" for i in range(len(feats))],
                           *[(F.col(f"_keep{i}") & (h > 0)).alias(f"_has{i}") for i, h in enumerate(held)])
    kept = feats
    if not keys:
        row = decided.first()  # one row: which columns there are
        kept = [c for i, c in enumerate(feats) if row[f"_keep{i}"]]
        if target not in kept:
            raise ValueError(f"target {target!r} was pruned (sparse or constant)")
    rows = join_per_key(d.where("_in"), decided, keys)
    cond = F.col(f"_keep{feats.index(target)}") & (~F.col("_a") | over) & (~F.col("_b") | under)
    for i, c in enumerate(feats):
        cond = cond & (~F.col(f"_has{i}") | _q(c).isNotNull())
    rows = rows.where(cond)
    gone = {c for c in exclude if c != target}
    out = rows.select(*[_q(c) for c in dict.fromkeys([*keys, *schema.order])],
                      *[F.when(F.col(f"_keep{feats.index(c)}"), _q(c)).alias(c) for c in kept if c not in gone])
    return out, _report(found, rows, keys, feats, target, gone)


def _report(found: DataFrame, rows: DataFrame, keys, feats, target, gone) -> DataFrame:
    """(keys, step_no, step, n_rows, n_cols, status) from the decisions and the rows that E1 keeps."""
    complete = (rows.groupBy(*[_q(k) for k in keys]) if keys else rows.groupBy()).agg(F.count(F.lit(1)).alias("_complete"))
    there = F.col(f"_keep{feats.index(target)}")  # a key whose target is pruned goes

    def left(n):
        return F.when(there, n).otherwise(0)

    varied = sum(F.col(f"_keep{i}").cast("bigint") for i in range(len(feats)))
    used = sum((F.col(f"_keep{i}").cast("bigint") for i, c in enumerate(feats) if c not in gone), F.lit(0).cast("bigint"))
    low = F.when(F.col("_a"), F.col("_r10")).otherwise(F.col("_r00"))
    both = F.when(F.col("_a") & F.col("_b"), F.col("_r11")).when(F.col("_b"), F.col("_r01")).otherwise(low)
    last = F.coalesce("_complete", F.lit(0))
    counts = [(F.col("_n"), F.lit(len(feats))), (F.col("_n"), F.col("_dense")), (F.col("_r00"), F.col("_dense")),
              (F.col("_r00"), varied), (left(low), varied), (left(both), varied), (last, varied), (last, used)]
    steps = F.array(*[F.struct(F.lit(i + 1).alias("step_no"), F.lit(step).alias("step"), n.cast("bigint").alias("n_rows"),
                               c.cast("bigint").alias("n_cols")) for i, (step, (n, c)) in enumerate(zip(STEPS, counts))])
    report = join_per_key(found, complete, keys, "left").select(*[_q(k) for k in keys], F.inline(steps))
    return report.withColumn("status", P.adequacy())


def _variables(df, schema, target, variables):
    if variables:
        return list(variables)
    return [c for c in schema.features(df) if c != target]


def rank_drivers(prepared: DataFrame, schema: SeriesSchema, target: str, variables=None, models=None,
                 hash_cols=None, top_n: int = 10, forest_kw=None, **kw) -> DataFrame:
    """CV-rank the models per key, take each key's best, compute that
    model's importance, keep the top ``top_n`` features."""
    keys = list(schema.keys)
    variables = _variables(prepared, schema, target, variables)
    models = models or M.RANKING_MODELS
    data = materialize(prepared)  # read by the scoring and the importance passes
    scores = M.cv_scores(data, keys, variables, target, models, hash_cols=hash_cols or [*keys, *schema.order],
                         forest_kw=forest_kw, order=schema.order)
    selected = M.select_model(scores, keys, list(models))
    imp = M.dispatch_importance(data, keys, schema.order, variables, target, selected, forest_kw=forest_kw, **kw)
    return M.top_features(imp, keys, top_n)


def _met(prepared: DataFrame, keys, target: str, variables) -> DataFrame:
    """The columns of a drill-down written once, the rows of a key beside each other (a large key in several tasks):
    every step reads few columns, and its aggregates by key are nearly done before they shuffle."""
    rows = prepared.select(*[_q(c) for c in dict.fromkeys([*keys, *variables, target])])
    return materialize(rows.hint("rebalance", *[_q(k) for k in keys]) if keys else rows, "rows")


def drill_down_outputs(prepared: DataFrame, keys, target: str, variables, choose: str = "mixture", exact_scale=None,
                       **kw) -> dict[str, DataFrame]:
    """E3 (``choose="mixture"``) and E4 (``"peaks"``), every output: per variable the component or peak count
    decides the tree's depth; then ``splits`` (of the tree), ``mixture_splits`` (E3 only), ``histogram`` (100 bins,
    marked where a split falls), ``boxes`` and ``summary`` per segment.  The columns they read are written once."""
    keys = list(keys)
    prepared = _met(prepared, keys, target, variables)
    if choose == "mixture":
        fit = G.gmm_fit(prepared, variables, keys)
        counts = fit.groupBy(*[_q(k) for k in keys], "variable").agg(F.max("n_components").alias("n_found"))
        out = {"mixture_splits": G.gmm_splits_from_params(fit, keys)}
    else:
        peaks = H.histogram_peaks(prepared, variables, keys)
        counts = peaks.groupBy(*[_q(k) for k in keys], "variable").agg(F.count(F.lit(1)).alias("n_found"))
        out = {}
    splits = B.tree_splits(prepared, keys, variables, target, B.depth_from_count(counts, keys, "n_found"), **kw)
    return out | {"splits": splits, "histogram": H.histogram_with_splits(prepared, variables, splits, keys),
                  "boxes": B.segment_boxstats(prepared, keys, variables, target, splits),
                  "summary": _summary_or_unavailable(prepared, keys, variables, target, splits, exact_scale)}


def drill_down(prepared: DataFrame, keys, target: str, variables, exact_scale=None, **kw) -> DataFrame:
    """E3's segment summary.  A variable without splits (constant) gets one row with status 'unavailable'."""
    keys = list(keys)
    comps = G.gmm_components(prepared, variables, keys)
    splits = B.tree_splits(prepared, keys, variables, target, B.depth_from_count(comps, keys, "n_components"), **kw)
    return _summary_or_unavailable(prepared, keys, variables, target, splits, exact_scale)


def drill_down_peaks(prepared: DataFrame, keys, target: str, variables, exact_scale=None,
                     **kw) -> DataFrame:
    """E4's segment summary: like E3 with the depth chosen by histogram peaks (one peak -> 1)."""
    keys = list(keys)
    prepared = _met(prepared, keys, target, variables)
    peaks = H.histogram_peaks(prepared, variables, keys)
    counts = peaks.groupBy(*[_q(k) for k in keys], "variable").agg(F.count(F.lit(1)).alias("n_peaks"))
    splits = B.tree_splits(prepared, keys, variables, target, B.depth_from_count(counts, keys, "n_peaks"), **kw)
    return _summary_or_unavailable(prepared, keys, variables, target, splits, exact_scale)


def _summary_or_unavailable(prepared, keys, variables, target, splits, exact_scale=None):
    summary = B.segment_summary(prepared, keys, variables, target, splits, exact_scale=exact_scale) \
        .withColumn("status", F.lit("ok"))
    present = B.xy_long(prepared, keys, variables, target).select(*keys, "variable").distinct()
    missing = join_on(present, splits.select(*keys, "variable").distinct(), [*keys, "variable"], "left_anti")
    unavailable = missing.select(*keys, "variable", F.lit(None).cast("bigint").alias("segment"),
                                 F.lit(None).cast("double").alias("seg_lo"),
                                 F.lit(None).cast("double").alias("seg_hi"),
                                 F.lit(None).cast("string").alias("label"), F.lit(0).cast("bigint").alias("n"),
                                 F.lit(None).cast("double").alias("share"),
                                 F.lit(None).cast("double").alias("mean_target"),
                                 F.lit("unavailable").alias("status"))
    return summary.unionByName(unavailable)


def target_profile(series: DataFrame, keys, target: str, min_target=None, max_target=None,
                   bins: int = 100) -> DataFrame:
    """E5: histogram of the target before and after clipping to
    [min_target, max_target) -- (stage, keys, variable, bin, bin_lo, bin_hi, n).
    The rolling view of the same target is :func:`target_rolling`."""
    keys = list(keys)
    raw = H.histogram(series, [target], keys, bins).withColumn("stage", F.lit("raw"))
    clipped = _clipped(series, target, min_target, max_target)
    cl = H.histogram(clipped, [target], keys, bins).withColumn("stage", F.lit("clipped"))
    return raw.unionByName(cl)


def _clipped(series, target, min_target, max_target):
    if min_target is not None:
        series = series.where(_q(target) >= F.lit(float(min_target)))
    if max_target is not None:
        series = series.where(_q(target) < F.lit(float(max_target)))
    return series


def target_rolling(series: DataFrame, keys, order, target: str, min_target=None, max_target=None, size: int = 48,
                   **kw) -> DataFrame:
    """E5's rolling view: the target and its mean over the last ``size`` rows before and after clipping to
    [min_target, max_target) -- (stage, keys, order, target, <target>_moving_avg)."""
    names = [_q(c) for c in dict.fromkeys([*keys, *order, target])]
    stages = {"raw": series, "clipped": _clipped(series, target, min_target, max_target)}
    raw, clipped = [H.rolling_mean_48(d.select(*names), keys, order, target, size, **kw).withColumn("stage", F.lit(stage))
                    for stage, d in stages.items()]
    return raw.unionByName(clipped)
