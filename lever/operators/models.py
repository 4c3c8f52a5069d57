"""Model ranking and feature importance.

Linear family (ordinary least squares, ridge, lasso): one pass of moments per
(key, fold) gives all refits (:mod:`lever.operators.gram`).  Scoring the
held-out folds (MAPE needs every prediction) is one more pass joined to the
coefficients on (key, fold).

The random forest is that of :mod:`lever.operators.forest`: all keys, folds and
trees in jobs whose number depends on the depth only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lever.functions.columns import join_on
from lever.functions.sizing import join_per_key, materialize
from lever.operators import forest
from lever.operators.forest import Forest
from lever.operators.gram import coefficients_long, fold_moments, solve_folds
from lever.operators.ordered import BLOCK_ROWS, contiguous_folds, with_row_index
from lever.operators.prep import drop_null_rows, drop_null_rows_sized

# The ranking registry (name -> solver, penalty) in registry order,
# and the penalties used for importance on min-max scaled data.
RANKING_MODELS = {
    "LinearRegression": ("ols", 0.0),
    "Ridge": ("ridge", 1.0),
    "Lasso": ("lasso", 1.0),
    "RandomForestRegressor": ("forest", None),
}
IMPORTANCE_MODELS = {
    "LinearRegression": ("ols", 0.0),
    "Ridge": ("ridge", 0.01),
    "Lasso": ("lasso", 0.01),
}
LINEAR_ONLY = {k: v for k, v in RANKING_MODELS.items() if v[0] != "forest"}
EPS = float(np.finfo(np.float64).eps)


def _q(c):
    return F.col(f"`{c}`")


# --------------------------------------------------------------- M1, M2
def holdout_split(df: DataFrame, hash_col: str | None = None, cols=None, share: float = 0.8,
                  seed: int = 42, name: str = "in_train") -> DataFrame:
    """M1: repeatable train/holdout flag from a row hash in [0, 1000).

    ``hash_col`` names a precomputed hash; otherwise ``xxhash64(cols, seed)``.
    Unlike ``randomSplit`` the flag does not depend on partitioning.
    """
    h = _q(hash_col) if hash_col else F.xxhash64(F.lit(seed), *[_q(c) for c in cols])
    return df.withColumn(name, F.pmod(h, F.lit(1000)) < F.lit(int(round(share * 1000))))


def shuffled_folds(df: DataFrame, k: int = 5, hash_col: str | None = None, cols=None, seed: int = 7,
                   name: str = "fold") -> DataFrame:
    """M2: fold = hash mod k (shuffled K-fold without a global sort)."""
    h = _q(hash_col) if hash_col else F.xxhash64(F.lit(seed), *[_q(c) for c in cols])
    return df.withColumn(name, F.pmod(h, F.lit(k)).cast("bigint"))


def holdout_exact(df: DataFrame, keys, order, share: float = 0.8, name: str = "in_train", **kw) -> DataFrame:
    """M1 with the exact share: per key all but the last ceil((1 - share) n) rows in ``order``, which starts with a
    hash (a shuffle that does not depend on partitioning) and ends with tie-breakers."""
    held = with_row_index(df, keys, order, "_hx_i", "_hx_n", **kw)
    out = F.ceil(F.round(F.col("_hx_n") * F.lit(1.0 - share), 9))
    return held.withColumn(name, F.col("_hx_i") < F.col("_hx_n") - out).drop("_hx_i", "_hx_n")


def folds_exact(df: DataFrame, keys, order, k: int = 5, name: str = "fold", **kw) -> DataFrame:
    """M2 with exact sizes: per key ``k`` folds of ``order`` (a hash, then tie-breakers) that differ by one row at most."""
    return contiguous_folds(df, keys, order, k, name, **kw)


# --------------------------------------------------------------- importance
def _prepare(df, keys, order, variables, target):
    """The complete rows, and options for the ordered scans over them."""
    cols = [*keys, *order, *variables, target]
    return _complete(df.select(*[_q(c) for c in dict.fromkeys(cols)]), list(keys), [*variables, target])


def _complete(data, keys, cols):
    if not keys:
        return drop_null_rows(data, cols), {}
    rows, most = drop_null_rows_sized(data, cols, keys)
    # no key is large, so the scans need not count again; if one is, they count the rows that are left
    return rows, {"num_blocks": 1} if most <= BLOCK_ROWS else {}


def linear_fold_coefficients(df: DataFrame, keys, order, variables, target: str, models=None,
                             k: int = 10, normalize: bool = True, **kw) -> DataFrame:
    """Per-fold coefficients of the linear importance models: min-max scale
    every column per key (A3), cut ``k`` contiguous folds in time order (W5),
    fit on the other folds.  (keys, fold, model, feature, coefficient)."""
    keys = list(keys)
    models = models or IMPORTANCE_MODELS
    data, how = _prepare(df, keys, order, variables, target)
    how = {**how, **kw}
    folded = contiguous_folds(data.where(_q(target).isNotNull()), keys, order, k, name="fold", **how)
    moments = fold_moments(folded, keys, "fold", variables, target, in_order=how.get("num_blocks") == 1)
    return coefficients_long(solve_folds(moments, keys, "fold", variables, models, normalize), keys, "fold", variables)


def fold_mean_importance(per_fold: DataFrame, keys, value: str = "feature_importance",
                         extra=()) -> DataFrame:
    """A4: mean over folds per feature (and of any ``extra`` columns)."""
    keys = list(keys)
    return per_fold.groupBy(*[_q(k) for k in keys], "model", "feature").agg(
        F.avg(value).alias(value), *[F.avg(e).alias(e) for e in extra])


def linear_importance_all(df: DataFrame, keys, order, variables, target: str, models=None,
                          k: int = 10, **kw) -> DataFrame:
    """M5-M7 together (one data pass): (keys, model, feature, feature_importance, index),
    importance = mean |coefficient| over folds, index = -importance."""
    keys = list(keys)
    coef = linear_fold_coefficients(df, keys, order, variables, target, models, k, **kw)
    per_fold = coef.withColumn("feature_importance", F.abs("coefficient"))
    imp = fold_mean_importance(per_fold, keys)
    return imp.withColumn("index", -F.col("feature_importance"))


def _one(df, keys, order, variables, target, name, k=10, **kw):
    m = {name: IMPORTANCE_MODELS[name]}
    return linear_importance_all(df, keys, order, variables, target, m, k, **kw).drop("model")


def linear_importance(df, keys, order, variables, target, k=10, **kw):
    """M5: ordinary least squares importance."""
    return _one(df, keys, order, variables, target, "LinearRegression", k, **kw)


def ridge_importance(df, keys, order, variables, target, k=10, **kw):
    """M6: ridge (alpha 0.01) importance."""
    return _one(df, keys, order, variables, target, "Ridge", k, **kw)


def lasso_importance(df, keys, order, variables, target, k=10, **kw):
    """M7: lasso (alpha 0.01) importance."""
    return _one(df, keys, order, variables, target, "Lasso", k, **kw)


def rank_features(per_fold: DataFrame, keys, fold_col: str = "fold",
                  value: str = "feature_importance") -> DataFrame:
    """0-based rank by importance within each fold (ties by feature name)."""
    keys = list(keys)
    part = [*keys, "model"] if "model" in per_fold.columns else keys
    w = Window.partitionBy(*[_q(c) for c in part], _q(fold_col)).orderBy(F.desc(value), "feature")
    return per_fold.withColumn("index", (F.row_number().over(w) - 1).cast("bigint"))


# --------------------------------------------------------------- forest
def forest_trees(df: DataFrame, keys, order, variables, target: str, k: int = 10, how: Forest | None = None,
                 **options) -> tuple[DataFrame, DataFrame]:
    """The packed rows and the trees of M8: for every key and each of ``k`` contiguous folds, grown on the others."""
    keys, how = list(keys), forest.with_options(how, **options)
    blocks = _fold_blocks(df, keys, order, variables, target, k, how)
    return blocks, forest.grow_forests(blocks, keys, k, how)


def _fold_blocks(df, keys, order, variables, target, k, how):
    data, scan = _prepare(df, keys, order, variables, target)
    folded = contiguous_folds(data, keys, order, k, name="fold", **scan)
    return forest.forest_blocks(folded, keys, variables, target, [*keys, *order], "fold", how)


def forest_importance(df: DataFrame, keys, order, variables, target: str, k: int = 10, how: Forest | None = None,
                      **options) -> DataFrame:
    """M8: random-forest impurity importance on ``k`` contiguous folds (un-normalised, only ``variables``);
    per fold rank by importance, then the mean importance and mean rank per feature.
    (keys, feature, feature_importance, index); options as in :func:`forest.with_options`."""
    keys, how = list(keys), forest.with_options(how, **options)
    blocks = _fold_blocks(df, keys, order, variables, target, k, how)
    ranked = rank_features(forest.grown_importances(blocks, keys, k, variables, how), keys)
    return ranked.groupBy(*[_q(c) for c in keys], "feature").agg(
        F.avg("feature_importance").alias("feature_importance"), F.avg("index").alias("index"))


# --------------------------------------------------------------- M3, M4, M9
def cv_scores(df: DataFrame, keys, variables, target: str, models=None, k: int = 5,
              hash_col: str | None = None, hash_cols=None, share: float = 0.8,
              forest_kw=None, order=None) -> DataFrame:
    """M3: per key and model, mean over ``k`` shuffled folds (of the training
    share) of MAPE x 100 and of RMSE, on un-normalised data.
    (keys, model, abs_mape_pct, abs_rmse).

    With ``order`` (columns that tell a key's rows apart) the training share and the folds have their exact sizes,
    shuffled by the hash; without it each row's hash alone decides, and they have them about.
    """
    keys = list(keys)
    models = dict(models or RANKING_MODELS)
    linear = {m: v for m, v in models.items() if v[0] != "forest"}
    data = df.select(*[_q(c) for c in dict.fromkeys([*keys, *variables, target, *([hash_col] if hash_col else []), *(hash_cols or []), *(order or [])])])
    data, scan = _complete(data, keys, [*variables, target])
    if order:
        for seed, cut in ((42, lambda d, by: holdout_exact(d, keys, by, share, **scan).where("in_train").drop("in_train")),
                          (7, lambda d, by: folds_exact(d, keys, by, k, **scan))):
            shuffle = F.xxhash64(F.lit(seed), *[_q(c) for c in ([hash_col] if hash_col else hash_cols)], *[_q(c) for c in order])
            data = cut(data.withColumn("_shuffle", shuffle), ["_shuffle", *order]).drop("_shuffle")
    else:
        data = holdout_split(data, hash_col, hash_cols, share).where("in_train").drop("in_train")
        data = shuffled_folds(data, k, hash_col, hash_cols, name="fold")
    out = None
    if linear:
        together = bool(order) and scan.get("num_blocks") == 1
        solutions = solve_folds(fold_moments(data, keys, "fold", variables, target, in_order=together), keys, "fold", variables, linear)
        wide = solutions.groupBy(*[_q(c) for c in keys], "fold").agg(*[F.max(F.when(F.col("model") == m, F.struct("intercept", "weights")))
                                                                     .alias(f"fit__{m}") for m in linear])
        scored = join_per_key(data, wide, [*keys, "fold"])
        y = _q(target)
        aggs = []
        for m in linear:
            pred = F.col(f"fit__{m}.intercept")
            for j, c in enumerate(variables):
                pred = pred + F.coalesce(F.get(f"fit__{m}.weights", F.lit(j)) * _q(c), F.lit(0.0))
            err = y - pred
            aggs.append(F.avg(F.abs(err) / F.greatest(F.abs(y), F.lit(EPS))).alias(f"mape__{m}"))
            aggs.append(F.sqrt(F.avg(err * err)).alias(f"rmse__{m}"))
        per_fold = scored.groupBy(*[_q(c) for c in keys], "fold").agg(*aggs)
        mean = per_fold.groupBy(*[_q(c) for c in keys]).agg(
            *[F.avg(f"mape__{m}").alias(f"mape__{m}") for m in linear],
            *[F.avg(f"rmse__{m}").alias(f"rmse__{m}") for m in linear])
        out = mean.select(*[_q(c) for c in keys], F.inline(F.array(*[
            F.struct(F.lit(m).alias("model"), (F.col(f"mape__{m}") * 100).alias("abs_mape_pct"),
                     F.col(f"rmse__{m}").alias("abs_rmse")) for m in linear])))
    for m, (kind, _) in models.items():
        if kind == "forest":
            scored = _forest_cv(data, keys, variables, target, k, m, [hash_col] if hash_col else list(hash_cols), forest_kw)
            out = scored if out is None else out.unionByName(scored)
    return out


def _forest_cv(data, keys, variables, target, k, name, draw_cols, options):
    how = forest.with_options(Forest(trees=100), **(options or {}))
    blocks = forest.forest_blocks(data, keys, variables, target, [*keys, *draw_cols], "fold", how)
    per_fold = forest.grown_errors(blocks, keys, k, how)
    return per_fold.groupBy(*[_q(c) for c in keys]).agg(
        (F.avg("mape") * 100).alias("abs_mape_pct"), F.avg("rmse").alias("abs_rmse")) \
        .select(*[_q(c) for c in keys], F.lit(name).alias("model"), "abs_mape_pct", "abs_rmse")


def select_model(scores: DataFrame, keys, registry=None) -> DataFrame:
    """M4/K2: the model with the smallest MAPE per key (ties: registry order)."""
    keys = list(keys)
    registry = list(registry or RANKING_MODELS)
    pos = F.element_at(F.map_from_arrays(F.array(*[F.lit(m) for m in registry]),
                                         F.array(*[F.lit(i) for i in range(len(registry))])), F.col("model"))
    g = scores.groupBy(*[_q(k) for k in keys]) if keys else scores.groupBy()
    return g.agg(F.min_by("model", F.struct("abs_mape_pct", pos)).alias("model"),
                 F.min("abs_mape_pct").alias("abs_mape_pct"))


def dispatch_importance(df: DataFrame, keys, order, variables, target: str, selected: DataFrame,
                        k: int = 10, forest_kw=None, **kw) -> DataFrame:
    """M9: per key, the importance table of that key's selected model."""
    keys = list(keys)
    lin = linear_importance_all(df, keys, order, variables, target, IMPORTANCE_MODELS, k, **kw)
    selected = materialize(selected.select(*[_q(c) for c in keys], "model"))  # read three times below
    out = join_on(lin, selected, [*keys, "model"])
    needs_forest = selected.where(F.col("model") == "RandomForestRegressor")
    if needs_forest.limit(1).count():
        fkeys = needs_forest.select(*[_q(c) for c in keys])
        sub = join_on(df, fkeys, keys, "left_semi") if keys else df
        fr = forest_importance(sub, keys, order, variables, target, k, **(forest_kw or {}))
        out = out.unionByName(fr.withColumn("model", F.lit("RandomForestRegressor")))
    return out


def top_features(importance: DataFrame, keys, n: int = 10) -> DataFrame:
    """K1: the first ``n`` features by ``index`` (ascending) per key, with the
    bar length ``max(index over the n) - index``."""
    keys = list(keys)
    w = Window.partitionBy(*[_q(c) for c in keys]).orderBy("index", "feature")
    top = importance.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= n)
    wk = Window.partitionBy(*[_q(c) for c in keys])
    return top.withColumn("bar", F.max("index").over(wk) - F.col("index"))
