import numpy as np
import pandas as pd

from lever.operators import mixture as G


def test_single_component_closed_form(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(3, 2, 1000)
    out = G.gmm_single(spark.createDataFrame(pd.DataFrame({"x": x})), ["x"]).first()
    var = x.var() + 1e-6
    ll = -0.5 * len(x) * (np.log(2 * np.pi * var) + x.var() / var)
    assert np.isclose(out.mean, x.mean()) and np.isclose(out.variance, var)
    assert np.isclose(out.bic_1, -2 * ll + 2 * np.log(len(x)))


def test_two_bumps_give_two_components_and_a_split_between(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, 3000), rng.normal(10, 1, 1000)])
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    comps = G.gmm_fit(df, ["x"]).orderBy("component").toPandas()
    assert comps.n_components.iloc[0] == 2
    assert np.allclose(comps["mean"], [0, 10], atol=0.2) and np.allclose(comps.weight, [0.75, 0.25], atol=0.03)
    split = G.gmm_splits(df, ["x"]).first().threshold
    m, w = comps["mean"].to_numpy(), comps.weight.to_numpy()
    assert np.isclose(split, m[0] + (m[1] - m[0]) * w[0] / (w[0] + w[1]))


def test_constant_variable_is_one_component(spark):
    df = spark.createDataFrame(pd.DataFrame({"x": [4.0] * 30}))
    assert G.gmm_components(df, ["x"]).first().n_components == 1
    assert G.gmm_splits(df, ["x"]).first().threshold == 4.0


def _bic_of(x, comps):
    """BIC of the raw values under the fitted components."""
    w, m, v = (comps[c].to_numpy()[None, :] for c in ("weight", "mean", "variance"))
    dens = (w * np.exp(-0.5 * (x[:, None] - m) ** 2 / v) / np.sqrt(2 * np.pi * v)).sum(1)
    return -2 * np.log(dens).sum() + (3 * len(comps) - 1) * np.log(len(x))


def test_outliers_do_not_hide_bumps(spark):
    rng = np.random.default_rng(2)
    bumps = np.concatenate([rng.normal(0, 1, 1000), rng.normal(10, 1, 1000)])
    for far, bins in ((1e5, 4096), (1e7, 4096), (1e7, 256)):
        x = np.append(bumps, far)
        comps = G.gmm_fit(spark.createDataFrame(pd.DataFrame({"x": x})), ["x"], max_bins=bins, local_values=10**6 if bins > 256 else 500).orderBy("component").toPandas()
        assert len(comps) == 3 and comps.converged.all()
        assert np.allclose(comps["mean"][:2], [0, 10], atol=0.2) and np.isclose(comps["mean"][2], far)


def test_large_offset_changes_nothing(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, 800), rng.normal(10, 1, 800)])
    near = G.gmm_fit(spark.createDataFrame(pd.DataFrame({"x": x})), ["x"]).orderBy("component").toPandas()
    far = G.gmm_fit(spark.createDataFrame(pd.DataFrame({"x": x + 1e9})), ["x"]).orderBy("component").toPandas()
    assert np.allclose(near["mean"], far["mean"] - 1e9, atol=1e-4) and np.allclose(near.bic, far.bic, atol=0.5)
    assert np.isclose(near.bic[0], _bic_of(x, near), rtol=1e-6)


def test_few_distinct_values_are_kept(spark):
    x = np.repeat([1.0, 2.0, 3.0, 50.0, 51.0], [30, 40, 30, 20, 20])
    bins = G.compress(spark.createDataFrame(pd.DataFrame({"x": x})), ["x"])[0].toPandas()
    assert len(bins) == 5 and sorted(bins.n) == [20, 20, 30, 30, 40] and (bins.v == 0).all()


def test_groups_and_null_keys(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"k": ["a", None] * 400, "x": np.repeat(rng.normal(0, 1, 400), 2)})
    comps = G.gmm_fit(spark.createDataFrame(pdf), ["x"], ["k"]).toPandas()
    a, b = comps[comps.k == "a"], comps[comps.k.isna()]
    assert len(a) == len(b) > 0 and np.allclose(a["mean"].sort_values(), b["mean"].sort_values())


def _numpy_em(x, k, reg, tol, steps):
    """EM on the raw values, from the start that the batch fit takes."""
    from lever.functions.em1d import fit_gmm_1d_batch
    wt, mu, var, ll, done = fit_gmm_1d_batch(np.ones((1, len(x))), x[None, :], np.zeros((1, len(x))), k, reg, steps, tol)
    order = np.argsort(mu[0])
    return wt[0][order], mu[0][order], var[0][order], ll[0]


def test_a_hundred_thousand_distinct_values(spark):
    """Fitted in one task, and by iterations over all values from 64 or 1,000 bins: what EM on the raw values gives."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 1, 60_000), rng.normal(6, 2, 40_000)])
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    w, m, v, ll = _numpy_em(x, 2, 1e-6, 1e-10, 5000)
    for options in (dict(), dict(local_values=1000, max_bins=64), dict(local_values=1000, max_bins=1000)):
        comps = G.gmm_fit(df, ["x"], k_max=2, tol=1e-8, max_iter=300, **options).orderBy("component").toPandas()
        assert len(comps) == 2 and comps.converged.all()
        assert np.allclose(comps["mean"], m, atol=5e-3) and np.allclose(comps.weight, w, atol=2e-3)
        assert np.allclose(comps.variance, v, rtol=1e-2) and np.isclose(comps.bic[0], -2 * ll + 5 * np.log(len(x)), rtol=1e-7)


def test_large_and_small_groups_together(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"k": ["a"] * 3000 + [None] * 3000 + ["c"] * 50,
                        "x": np.concatenate([rng.normal(0, 1, 1500), rng.normal(9, 1, 1500), rng.normal(5, 1, 3000), np.full(50, 2.0)])})
    df = spark.createDataFrame(pdf)
    want = G.gmm_fit(df, ["x"], ["k"], tol=1e-4).toPandas()
    got = G.gmm_fit(df, ["x"], ["k"], tol=1e-4, local_values=100, max_bins=200).toPandas()
    for k in ("a", None, "c"):
        one, two = (d[d.k.isna() if k is None else d.k == k].sort_values("component") for d in (want, got))
        assert len(one) == len(two) and np.allclose(one["mean"], two["mean"], atol=0.1)
    assert want[want.k == "a"].n_components.iloc[0] == 2 and want[want.k == "c"].bic.isna().all()


def test_groups_stream_through_the_fit(spark, monkeypatch):
    """Groups are fitted a few at a time as their bins come; batches that end inside a group change nothing."""
    from lever.operators import mixture as X
    df = spark.range(3000).selectExpr("id % 30 AS k", "if(id % 2 = 0, 0.0, 50.0) + sin(id) AS x", "double(id % 7) AS z")
    want = X.gmm_fit(df, ["x", "z"], ["k"]).orderBy("k", "variable", "component").toPandas()
    monkeypatch.setattr(X, "HELD_ROWS", 50)
    monkeypatch.setattr(X, "CELLS", 300)
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    try:
        spark.conf.set(conf, "9")
        fit = X.gmm_fit(df, ["x", "z"], ["k"])
        got = fit.orderBy("k", "variable", "component").toPandas()
    finally:
        spark.conf.set(conf, before)
    assert len(got) == len(want) and (got.n_components == want.n_components).all() and abs(got["mean"] - want["mean"]).max() < 1e-9
