import math

import numpy as np
import pandas as pd
import pytest

from lever.operators import splits as B


def _best(x, y, idx):
    xs, ys = x[idx], y[idx]
    order = np.argsort(xs, kind="stable")
    xs, ys = xs[order], ys[order]
    ux = np.unique(xs)
    if len(ux) < 2:
        return None
    best = None
    tot_n, tot_s = len(ys), ys.sum()
    for i in range(len(ux) - 1):
        left = xs <= ux[i]
        nl, sl = left.sum(), ys[left].sum()
        g = sl * sl / nl + (tot_s - sl) ** 2 / (tot_n - nl) - tot_s ** 2 / tot_n
        if best is None or g > best[0] + 1e-9 * abs(best[0]):
            best = (g, (ux[i] + ux[i + 1]) / 2)
    return best[1]


def brute_tree(x, y, depth, frac=0.2):
    """Squared-error tree on one variable: thresholds of split nodes."""
    min_split = max(math.ceil(frac * len(x)), 2)
    out = []

    def grow(idx, d):
        if d >= depth or len(idx) < min_split or np.var(y[idx]) <= 1e-12 * max(np.var(y), 1e-300):
            return
        t = _best(x, y, idx)
        if t is None:
            return
        out.append(t)
        grow(idx[x[idx] <= t], d + 1)
        grow(idx[x[idx] > t], d + 1)

    grow(np.arange(len(x)), 0)
    return sorted(out)


@pytest.mark.parametrize("seed,depth", [(0, 1), (1, 2), (2, 2), (3, 1), (4, 2)])
def test_tree_splits_match_brute_force(spark, seed, depth):
    rng = np.random.default_rng(seed)
    n = 400
    x = np.round(rng.uniform(-5, 5, n), 1)  # ties and negative values
    y = np.where(x < -1, 10.0, np.where(x < 2.5, 20.0, 5.0)) + rng.normal(0, 1, n)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    for blocks in (1, 4):
        out = B.tree_splits(df, [], ["x"], "y", depth, num_blocks=blocks)
        got = sorted(r.threshold for r in out.collect())
        assert np.allclose(got, brute_tree(x, y, depth)), blocks


def test_constant_variable_has_no_split(spark):
    df = spark.createDataFrame(pd.DataFrame({"x": [1.0] * 50, "y": np.arange(50.0)}))
    assert B.tree_splits(df, [], ["x"], "y", 2).count() == 0


def test_nonneg_only_reproduces_the_filter(spark):
    x = np.repeat([-3.0, -1.0, 1.0], 30)
    y = np.repeat([0.0, 5.0, 9.0], 30)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    all_t = sorted(r.threshold for r in B.tree_splits(df, [], ["x"], "y", 2).collect())
    assert all_t == [-2.0, 0.0]
    nonneg = [r.threshold for r in B.tree_splits(df, [], ["x"], "y", 2, nonneg_only=True).collect()]
    assert nonneg == [0.0]


def test_segments_edges_labels_and_empty(spark):
    df = spark.createDataFrame(pd.DataFrame({"x": [0.0, 1.0, 2.0, 3.0, 3.0, 9.0] * 5,
                                             "y": [1.0, 2.0, 3.0, 4.0, 4.0, 5.0] * 5}))
    splits = spark.createDataFrame([("x", 0.5), ("x", 3.0), ("x", 5.0)], "variable string, threshold double")
    rows = B.segment_rows(df, [], ["x"], "y", splits).toPandas()
    # x equal to a split belongs to the segment starting there
    assert set(rows[rows.x == 3.0].segment) == {2}
    summ = B.segment_summary(df, [], ["x"], "y", splits).orderBy("segment").toPandas()
    assert summ.n.tolist() == [5, 10, 10, 5]
    assert summ.label.tolist() == ["<0.50", "0.50-3.00", "3.00-5.00", ">5.00"]
    one = spark.createDataFrame([("x", 2.675)], "variable string, threshold double")
    lab = B.segment_summary(df, [], ["x"], "y", one).orderBy("segment").toPandas().label.tolist()
    assert lab == ["<2.68", ">=2.68"]
    # an empty middle segment is kept with n = 0 and no mean
    gap = spark.createDataFrame([("x", 4.0), ("x", 6.0)], "variable string, threshold double")
    g = B.segment_summary(df, [], ["x"], "y", gap).orderBy("segment").toPandas()
    assert g.n.tolist() == [25, 0, 5] and np.isnan(g.mean_target[1]) and g.label[1].endswith("(Outlier)")


def test_boxstats_match_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 10, 300)
    y = rng.standard_t(3, 300)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    splits = spark.createDataFrame([("x", 5.0)], "variable string, threshold double")
    out = B.segment_boxstats(df, [], ["x"], "y", splits).orderBy("segment").toPandas()
    for seg, sel in enumerate([x < 5.0, x >= 5.0]):
        v = y[sel]
        q1, med, q3 = np.percentile(v, [25, 50, 75])
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        r = out.iloc[seg]
        assert np.allclose([r["q1"], r["median"], r["q3"]], [q1, med, q3])
        assert r.whisker_lo == v[v >= lo].min() and r.whisker_hi == v[v <= hi].max()
        assert r.n_outliers == ((v < lo) | (v > hi)).sum()


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_boxes_of_few_and_of_many_values(spark, monkeypatch):
    """Small segments need one aggregate, without joining their rows to it; those above ``FEW`` rows go by selection."""
    rng = np.random.default_rng(8)
    data = [(k, float(v), float(w), None if i % 50 == 0 else float(np.round(y, 1)))
            for k, n in ((None, 40), ("a", 300), ("b", 7), ("c", 1))
            for i, (v, w, y) in enumerate(zip(rng.integers(0, 9, n), rng.uniform(0, 1, n), rng.standard_t(2, n)))]
    df = spark.createDataFrame(data, "k string, v double, w double, y double")
    splits = spark.createDataFrame([(None, "v", 4.5), ("a", "v", 2.5), ("a", "v", 6.5), ("a", "w", 0.5), ("b", "w", 0.25)],
                                   "k string, variable string, threshold double")
    few = B.segment_boxstats(df, ["k"], ["v", "w"], "y", splits)
    assert "percentile" not in _plan(few)
    few = sorted(few.collect(), key=str)
    monkeypatch.setattr(B, "FEW", 60)
    some = sorted(B.segment_boxstats(df, ["k"], ["v", "w"], "y", splits).collect(), key=str)
    assert few == some and {(r.k, r.variable) for r in few} == {(None, "v"), ("a", "v"), ("a", "w"), ("b", "w")}
    assert min(r.n for r in few) <= 60 < max(r.n for r in few)
    for r in few:
        y = [d[3] for d in data if d[0] == r.k and d[3] is not None and (
            r.variable == "w" or r.k is None) and (d[1] >= 4.5 if r.variable == "v" else d[2] >= (0.5 if r.k == "a" else 0.25)) == (r.segment == 1)]
        if r.k != "a" or r.variable == "w":
            assert r.n == len(y) and np.allclose([r.q1, r.median, r.q3], np.percentile(y, [25, 50, 75]))


def test_rows_meet_splits_and_ranges_before_they_are_unpivoted(spark):
    from lever.operators import profile as H
    df = spark.createDataFrame([(k, float(i), float(i % 5), float(i % 3)) for k in (None, "a") for i in range(30)],
                               "k string, v double, w double, y double")
    splits = spark.createDataFrame([(k, v, 2.5) for k in (None, "a") for v in "vw"], "k string, variable string, threshold double")
    for plan in (_plan(B._with_segment(df, ["k"], ["v", "w"], "y", splits)), _plan(H.histogram(df, ["v", "w"], ["k"], 10))):
        last = plan.rindex("Join")  # of the rows
        assert "Generate" in plan[:last] and plan.count("Join") <= 2
    assert B.segment_summary(df, ["k"], ["v", "w"], "y", splits).toPandas().n.sum() == 120


def test_drill_down_reads_the_prepared_rows_once(spark):
    from lever.plans import jobs as E
    df = spark.range(400).selectExpr("if(id % 2 = 0, null, id % 4) AS k", "double(id % 20) AS x", "if(id % 20 < 10, 1.0D, 5.0D) AS y", "id AS t")
    out = E.drill_down_outputs(df, ["k"], "y", ["x"], "peaks", exact_scale=6)
    assert set(out) == {"splits", "histogram", "boxes", "summary"}
    assert not any("Range (" in _plan(d) for d in out.values())
    assert out["boxes"].toPandas().n.sum() == 400 and out["histogram"].toPandas().n.sum() == 400
