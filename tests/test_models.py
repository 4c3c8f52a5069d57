import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lever.functions import linalg
from lever.operators import gram as G
from lever.operators import models as M


def _frame(spark, n=240, seed=0):
    rng = np.random.default_rng(seed)
    x1, x2, x3 = rng.normal(size=n), rng.uniform(size=n), rng.normal(size=n)
    y = 3 * x1 - 2 * x2 + 0.1 * rng.normal(size=n) + 5
    pdf = pd.DataFrame({"k": np.where(np.arange(n) < n // 2, "a", "b"), "t": np.arange(n),
                        "x1": x1, "x2": x2, "x3": x3, "y": y})
    return spark.createDataFrame(pdf), pdf


def _direct(kind, X, y, alpha):
    Xc, yc = X - X.mean(0), y - y.mean()
    if kind == "ols":
        return np.linalg.lstsq(Xc, yc, rcond=None)[0]
    if kind == "ridge":
        return np.linalg.solve(Xc.T @ Xc + alpha * np.eye(X.shape[1]), Xc.T @ yc)
    w = np.zeros(X.shape[1])  # lasso: plain coordinate descent on the data
    for _ in range(5000):
        for j in range(len(w)):
            r = yc - Xc @ w + Xc[:, j] * w[j]
            rho = Xc[:, j] @ r / len(y)
            w[j] = np.sign(rho) * max(abs(rho) - alpha, 0) / (Xc[:, j] @ Xc[:, j] / len(y))
    return w


def test_fold_gram_importance_equals_direct_refits(spark):
    df, pdf = _frame(spark)
    feats = ["x1", "x2", "x3"]
    imp = M.linear_importance_all(df, ["k"], ["t"], feats, "y").toPandas()
    for k, part in pdf.groupby("k"):
        part = part.sort_values("t")
        cols = feats + ["y"]
        z = (part[cols] - part[cols].min()) / (part[cols].max() - part[cols].min())
        folds = np.array_split(np.arange(len(z)), 10)
        for name, (kind, alpha) in M.IMPORTANCE_MODELS.items():
            coefs = []
            for f in folds:
                train = np.setdiff1d(np.arange(len(z)), f)
                coefs.append(np.abs(_direct(kind, z[feats].to_numpy()[train], z["y"].to_numpy()[train], alpha)))
            expect = np.mean(coefs, axis=0)
            got = imp[(imp.k == k) & (imp.model == name)].set_index("feature").loc[feats, "feature_importance"]
            assert np.allclose(got.to_numpy(), expect, atol=1e-7), name


def test_cv_scores_match_numpy(spark):
    df, pdf = _frame(spark, seed=2)
    pdf["h"] = (pdf.t * 7919 + 7) % 1000
    df = spark.createDataFrame(pdf)
    out = M.cv_scores(df, [], ["x1", "x2"], "y", M.LINEAR_ONLY, hash_col="h").toPandas().set_index("model")
    d = pdf[pdf.h % 1000 < 800]
    fold = d.h % 5
    for name, (kind, alpha) in M.LINEAR_ONLY.items():
        mapes, rmses = [], []
        for f in range(5):
            tr, te = d[fold != f], d[fold == f]
            X, y = tr[["x1", "x2"]].to_numpy(), tr.y.to_numpy()
            w = _direct(kind, X, y, alpha)
            b = y.mean() - X.mean(0) @ w
            pred = b + te[["x1", "x2"]].to_numpy() @ w
            mapes.append(np.mean(np.abs(te.y - pred) / np.maximum(np.abs(te.y), np.finfo(float).eps)))
            rmses.append(np.sqrt(np.mean((te.y - pred) ** 2)))
        assert np.isclose(out.loc[name, "abs_mape_pct"], 100 * np.mean(mapes), rtol=1e-6)
        assert np.isclose(out.loc[name, "abs_rmse"], np.mean(rmses), rtol=1e-6)


def test_select_model_ties_follow_registry_order(spark):
    scores = spark.createDataFrame([("Lasso", 1.0, 2.0), ("Ridge", 1.0, 3.0), ("LinearRegression", 2.0, 1.0)],
                                   "model string, abs_mape_pct double, abs_rmse double")
    assert M.select_model(scores, []).first().model == "Ridge"


def test_top_features_bar(spark):
    imp = spark.createDataFrame([(f"f{i}", float(i), -float(i)) for i in range(12)],
                                "feature string, feature_importance double, index double")
    top = M.top_features(imp, [], 10).orderBy("rank").toPandas()
    assert len(top) == 10 and top.feature.iloc[0] == "f11" and top.bar.iloc[-1] == 0.0


def test_lasso_coordinate_descent():
    one = dict(N=np.array([10.0]), SX=np.zeros((1, 1)), SY=np.zeros(1), SXX=np.array([[[4.0]]]), SXY=np.array([[3.0]]),
               active=np.ones((1, 1), bool))
    assert np.isclose(linalg.fit_batch("lasso", **one, alpha=0.1)[1][0, 0], (3.0 - 1.0) / 4.0)
    assert linalg.fit_batch("lasso", **one, alpha=0.5)[1][0, 0] == 0.0


def _direct_rmse(X, y, fold, alpha=None):
    out = []
    for f in sorted(set(fold)):
        tr, te = fold != f, fold == f
        mx, my = X[tr].mean(0), y[tr].mean()
        Xc, yc = X[tr] - mx, y[tr] - my
        sd = Xc.std(0)
        w = np.linalg.lstsq(Xc / sd, yc, rcond=None)[0] / sd if alpha is None else \
            np.linalg.solve(Xc.T @ Xc + alpha * np.eye(X.shape[1]), Xc.T @ yc)
        out.append(np.sqrt(np.mean((y[te] - (X[te] - mx) @ w - my) ** 2)))
    return np.mean(out)


def test_cv_scores_of_large_and_uneven_columns(spark):
    rng = np.random.default_rng(0)
    n = 600
    x = 1e8 + rng.normal(size=n)
    a, b = 1e6 * rng.normal(size=n), 1e-3 * rng.normal(size=n)
    pdf = pd.DataFrame({"h": np.arange(n) * 7919 % 1000, "x": x, "a": a, "b": b, "y": 3 * (x - 1e8) + rng.normal(size=n) * 2,
                        "z": 2e-6 * a + 5e3 * b})
    df = spark.createDataFrame(pdf)
    train = (pdf.h % 1000 < 800).to_numpy()
    fold = (pdf.h % 5).to_numpy()[train]
    for cols, target in ((["x"], "y"), (["a", "b"], "z")):
        got = {r.model: r.abs_rmse for r in M.cv_scores(df, [], cols, target, M.LINEAR_ONLY, hash_col="h").collect()}
        X, y = pdf[cols].to_numpy()[train], pdf[target].to_numpy()[train]
        assert np.isclose(got["LinearRegression"], _direct_rmse(X, y, fold), rtol=1e-6, atol=1e-6)
        assert np.isclose(got["Ridge"], _direct_rmse(X, y, fold, 1.0), rtol=1e-5, atol=1e-6)


def test_forest_importance_ranks_the_driver_first(spark):
    rng = np.random.default_rng(5)
    n = 300
    pdf = pd.DataFrame({"t": np.arange(n), "a": rng.normal(size=n), "b": rng.normal(size=n)})
    pdf["y"] = 4 * pdf.a + 0.1 * rng.normal(size=n)
    imp = M.forest_importance(spark.createDataFrame(pdf), [], ["t"], ["a", "b"], "y", k=3, num_trees=10,
                              max_depth=4).orderBy("index").toPandas()
    assert imp.feature.tolist() == ["a", "b"] and imp["index"].tolist() == [0.0, 1.0]


@pytest.mark.parametrize("p, n", [(6, 400), (120, 2000)])
def test_wide_tables(spark, p, n):
    """Any number of features in one pass: least squares and ridge equal direct refits."""
    rng = np.random.default_rng(p)
    x = rng.normal(size=(n, p)) * rng.uniform(0.1, 50, p) + rng.uniform(-1e4, 1e4, p)
    y = x @ (rng.normal(size=p) * (rng.uniform(size=p) < 0.2)) + rng.normal(size=n)
    names = [f"f{j}" for j in range(p)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(t=np.arange(n), y=y))
    models = {m: M.IMPORTANCE_MODELS[m] for m in ("LinearRegression", "Ridge")}
    got = M.linear_importance_all(df, [], ["t"], names, "y", models).toPandas()
    z, v = (x - x.min(0)) / (x.max(0) - x.min(0)), (y - y.min()) / (y.max() - y.min())
    for name, (kind, alpha) in models.items():
        want = np.mean([np.abs(_direct(kind, np.delete(z, f, 0), np.delete(v, f), alpha))
                        for f in np.array_split(np.arange(n), 10)], axis=0)
        mine = got[got.model == name].set_index("feature").loc[names, "feature_importance"].to_numpy()
        assert np.allclose(mine, want, rtol=1e-6, atol=1e-9)


def test_five_hundred_features(spark):
    rng = np.random.default_rng(1)
    n, p = 1500, 500
    x = rng.normal(size=(n, p))
    df = spark.createDataFrame(pd.DataFrame({"t": np.arange(n), "v": list(x), "y": 5 * x[:, 17] - 2 * x[:, 3]})) \
        .select("t", "y", *[F.col("v")[j].alias(f"f{j}") for j in range(p)])
    got = M.linear_importance_all(df, [], ["t"], [f"f{j}" for j in range(p)], "y", {"Ridge": ("ridge", 0.01)}).orderBy("index").limit(2).collect()
    assert [r.feature for r in got] == ["f17", "f3"]


def test_moments_merge_exactly(spark):
    """Large offsets do not cancel, however the rows are spread; a key's missing column stays out."""
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": np.repeat(["a", "b"], 300), "f": np.tile(np.arange(600) % 3, 1), "x": 1e9 + rng.normal(size=600),
                        "z": rng.normal(size=600)})
    pdf["y"] = 2 * (pdf.x - 1e9) + pdf.z
    df = spark.createDataFrame(pdf).withColumn("z", F.when(F.col("k") == "a", F.col("z")))
    for parts in (1, 40):
        found = G.solve_folds(G.fold_moments(df.repartition(parts), ["k"], "f", ["x", "z"], "y"), ["k"], "f", ["x", "z"], {"o": ("ols", 0)})
        for r in found.collect():
            assert abs(r.weights[0] - 2) < (0.3 if r.k == "b" else 1e-5)
            assert r.weights[1] is None if r.k == "b" else abs(r.weights[1] - 1) < 1e-5


def test_exact_shares_and_folds(spark):
    """The training share and the folds have the sizes of the reference's split, whatever the hash and the blocks."""
    df = spark.range(1003).selectExpr("id", "if(id < 7, 'a', 'b') AS k", "pmod(xxhash64(id), 5) AS h")
    for blocks in (1, 6):
        n = {r.k: (r.n, r.t) for r in M.holdout_exact(df, ["k"], ["h", "id"], num_blocks=blocks).groupBy("k")
             .agg(F.count("*").alias("n"), F.count_if("in_train").alias("t")).collect()}
        assert n == {"a": (7, 5), "b": (996, 796)}
        sizes = M.folds_exact(df, ["k"], ["h", "id"], 5, num_blocks=blocks).groupBy("k", "fold").count().collect()
        assert sorted(r["count"] for r in sizes if r.k == "b") == [199, 199, 199, 199, 200]
        assert sorted(r["count"] for r in sizes if r.k == "a") == [1, 1, 1, 2, 2]


def test_cv_scores_with_exact_folds(spark):
    df, pdf = _frame(spark, seed=4)
    rough = M.cv_scores(df, ["k"], ["x1", "x2"], "y", M.LINEAR_ONLY, hash_cols=["t"]).toPandas()
    exact = M.cv_scores(df, ["k"], ["x1", "x2"], "y", M.LINEAR_ONLY, hash_cols=["t"], order=["t"]).toPandas()
    assert len(exact) == 6 and np.allclose(np.sort(exact.abs_rmse), np.sort(rough.abs_rmse), rtol=0.5)


def test_moments_of_many_groups_equal_numpy(spark):
    """Groups meet in order and stream: batches end inside groups, and a NULL key is a key."""
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": rng.integers(0, 40, 3000), "fold": rng.integers(0, 3, 3000), "x": rng.normal(1e6, 1, 3000), "y": rng.normal(size=3000)})
    df = spark.createDataFrame(pdf).withColumn("k", F.when(F.col("k") > 0, F.col("k")))
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    try:
        spark.conf.set(conf, "7")
        plan = G.fold_moments(df, ["k"], "fold", ["x"], "y")
        got = {(r["k"] or 0, r["fold"]): G.Moments.unpacked(bytes(r["_m"]), 2) for r in plan.collect()}
    finally:
        spark.conf.set(conf, before)
    assert len(got) == len(pdf.groupby(["k", "fold"]))
    for mark, part in pdf.groupby(["k", "fold"]):
        z, m = part[["y", "x"]].to_numpy(), got[mark]
        c = z - z.mean(0)
        assert m.n == len(z) and np.allclose(m.mean, z.mean(0), rtol=1e-14) and np.allclose(m.cross, c.T @ c, atol=1e-6)
        assert np.array_equal(m.low, z.min(0)) and np.array_equal(m.high, z.max(0))


def test_a_task_holds_one_group_of_moments():
    """Memory follows a batch, not the number of keys: each batch's groups are done in one go."""
    z = np.arange(20_000.0).reshape(-1, 2)
    start = np.arange(0, 10_000, 2)
    parts = G.groups_of(z, start)
    assert parts.shape == (5_000, 1 + 4 * 2 + 4) and np.allclose(parts[:, 9:], 2.0)
    whole = G.merged(parts, np.zeros(1, np.int64), 2)[0]
    assert np.allclose(whole, G.groups_of(z, np.zeros(1, np.int64))[0])


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_linear_refits_shuffle_the_rows_once(spark, monkeypatch):
    """Small keys without missing columns: no join for the null rule, no second meeting of the rows for the moments,
    and no list of a key's folds for the solver."""
    df, _ = _frame(spark)
    expect = M.linear_fold_coefficients(df, ["k"], ["t"], ["x1", "x2"], "y")
    monkeypatch.setattr(G, "materialize", lambda frame, name: frame)
    out = M.linear_fold_coefficients(df, ["k"], ["t"], ["x1", "x2"], "y")
    plan = _plan(out)
    assert not any(word in plan for word in ("Join", "Rebalance", "collect_list")) and plan.count("Repartition") == 2
    rounded = [d.withColumn("coefficient", F.round("coefficient", 9)) for d in (out, expect)]
    assert rounded[0].exceptAll(rounded[1]).isEmpty() and out.count() == expect.count() == 2 * 10 * 3 * 2


def test_moments_need_no_order(spark):
    rows = spark.createDataFrame([(k, i % 3, float(i * i % 7), float(i)) for i in range(60) for k in ("a", None)],
                                 "k string, fold int, x double, y double")
    found = []
    for in_order in (False, True):
        cells = G.fold_moments(rows.repartition(3), ["k"], "fold", ["x"], "y", in_order=in_order).collect()
        assert len(cells) == 6
        found.append({(r.k, r.fold): np.frombuffer(bytes(r._m)) for r in cells})
    assert all(np.allclose(found[0][at], found[1][at]) for at in found[0])


@pytest.mark.parametrize("normalize", [True, False])
def test_refits_of_many_keys_solved_some_at_a_time(spark, monkeypatch, normalize):
    """Keys that several batches and stacks cut, a missing key, a constant target and a missing column."""
    rng = np.random.default_rng(4)
    data = [(None if k == 7 else k, i % 5, float(rng.normal()), None if k == 3 else float(rng.normal()), 2.0 if k == 5 else float(rng.normal()))
            for k in range(40) for i in range(25)]
    df = spark.createDataFrame(data, "k int, fold int, a double, b double, y double")
    moments = G.fold_moments(df, ["k"], "fold", ["a", "b"], "y")
    whole = G.solve_folds(moments, ["k"], "fold", ["a", "b"], M.LINEAR_ONLY, normalize).toPandas()
    monkeypatch.setattr(G, "HELD", 8 * 9 * 12)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        cut = G.solve_folds(moments, ["k"], "fold", ["a", "b"], M.LINEAR_ONLY, normalize).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(whole) == len(cut) == (39 if normalize else 40) * 5 * 3
    by = ["k", "fold", "model"]
    whole, cut = (d.sort_values(by, ignore_index=True) for d in (whole, cut))
    assert np.allclose(np.stack(whole.weights).astype(float), np.stack(cut.weights).astype(float), equal_nan=True)
    a, b, y = (np.array([r[i] for r in data if r[0] == 11]) for i in (2, 3, 4))
    if not normalize:
        train = np.arange(25) % 5 != 2
        got = whole[(whole.k == 11) & (whole.fold == 2) & (whole.model == "LinearRegression")].weights.iloc[0]
        assert np.allclose(got, _direct("ols", np.column_stack([a, b])[train], y[train], 0))
        assert np.isnan(np.stack(whole[whole.k == 3].weights).astype(float)[:, 1]).all()


def test_select_model_query_ranks_the_forest_too(spark, tmp_path):
    """One machine is linear in the price, the other a product that only a forest fits; folds and share are exact."""
    from lever.plans import registry
    rng = np.random.default_rng(12)
    n = 400
    rows = []
    for machine in (1, 2):
        for i in range(n):
            price, discount = (float(rng.uniform(1000, 2000)), 0.0) if machine == 1 else (float(rng.choice([1e4, 1e5])), float(rng.choice([0, 0.99])))
            rows.append((machine * n + i, i % 5, machine, i % 7, float(rng.integers(1, 50)), price, discount, 0.0, "N",
                         pd.Timestamp("1996-01-01") + pd.Timedelta(days=i)))
    names = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate"]
    spark.createDataFrame(pd.DataFrame(rows, columns=names)).write.parquet(f"{tmp_path}/lineitem.parquet")
    part = pd.DataFrame({"p_partkey": range(5), "p_size": [1, 2, 3, 4, 5], "p_retailprice": [9.0, 8.0, 7.0, 6.0, 5.0]})
    spark.createDataFrame(part).write.parquet(f"{tmp_path}/part.parquet")
    found = registry.QUERIES["select_model"](spark, str(tmp_path)).toPandas().set_index("machine")
    assert found.model.to_dict() == {1: "LinearRegression", 2: "RandomForestRegressor"}
    d = registry.f2(spark, str(tmp_path))
    scores = M.cv_scores(d, ["machine"], registry._P6, "net", hash_cols=["machine", *registry.F2O], order=registry.F2O).toPandas()
    assert len(scores) == 8 and set(scores.model) == set(M.RANKING_MODELS)
    best = scores.groupby("machine").abs_mape_pct.min()
    assert np.allclose(found.abs_mape_pct.sort_index(), best.sort_index(), atol=1e-6)
