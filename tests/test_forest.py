"""Forests against a plain recursive tree with the same draws."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lever.functions import trees as T
from lever.operators import forest as R
from lever.operators import models as M

VARS = ["a", "b", "c"]


def plain_tree(x, y, w, cuts, depth):
    """Nested (feature, cut value, gain, left, right) or a leaf's mean, by trying every cut of every feature."""
    n, mean = w.sum(), (w * y).sum() / w.sum()
    best = None
    if depth and n > 1:
        for j, c in enumerate(cuts):
            for t in c:
                left = x[:, j] <= t
                nl, nr = w[left].sum(), w[~left].sum()
                if not nl or not nr:
                    continue
                gap = abs((w * y)[left].sum() / nl - (w * y)[~left].sum() / nr)
                gain = nl * nr / n * gap ** 2
                if gain > 1e-9 and (best is None or gain > best[2] * (1 + 1e-12)):
                    best = (j, t, gain, left)
    if best is None:
        return mean
    j, t, gain, left = best
    keep = w > 0
    return (j, t, gain, plain_tree(x[left & keep], y[left & keep], w[left & keep], cuts, depth - 1),
            plain_tree(x[~left & keep], y[~left & keep], w[~left & keep], cuts, depth - 1))


def shares(tree, p):
    out = np.zeros(p)

    def visit(t):
        if isinstance(t, tuple):
            out[t[0]] += t[2]
            visit(t[3])
            visit(t[4])
    visit(tree)
    return out / out.sum() if out.sum() else out


def guess(tree, row):
    while isinstance(tree, tuple):
        tree = tree[3] if row[tree[0]] <= tree[1] else tree[4]
    return tree


def series(n=160, seed=1, keys=("k1", "k2", None)):
    r = np.random.default_rng(seed)
    rows = []
    for i, key in enumerate(keys):
        a, b, c = r.normal(size=n), r.integers(0, 5, n).astype(float), r.normal(size=n).round(1)
        y = (3 * (a > 0.2) + i * b + 0.1 * r.normal(size=n)) if i < 2 else np.full(n, 7.0)  # the last key: a constant target
        rows += [(key, t, *map(float, v)) for t, v in enumerate(zip(a, b, c, y))]
    return rows


SCHEMA = "k string, t int, a double, b double, c double, y double"


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(series(), SCHEMA)


def unpacked(blocks):
    out = {}
    for row in blocks.collect():
        x = row.asDict()
        out.setdefault(row.k, []).append((R._Part(x), x))
    return out


def test_forest_equals_plain_trees(frame):
    how = R.Forest(trees=4, max_depth=3, bins=16, task_trees=3)
    blocks, groves = M.forest_trees(frame, ["k"], ["t"], VARS, "y", k=4, how=how)
    got = {(r.k, r.fold, r.feature): r.feature_importance for r in R.fold_importances(groves, ["k"], VARS).collect()}
    errors = {(r.k, r.fold): (r.mape, r.rmse) for r in R.fold_errors(blocks, groves, ["k"], how).collect()}
    data = unpacked(blocks)
    assert set(data) == {"k1", "k2", None}
    rows = pd.DataFrame(series(), columns=["k", "t", *VARS, "y"])
    for key, [(part, x)] in data.items():
        own = rows[rows.k.isna() if key is None else rows.k == key].sort_values("t")
        # the block's rows in the order of their time, by their bins, target and fold
        fold = np.repeat(np.arange(4), 40)
        cuts = [np.array(c) for c in x["_cuts"]]
        bins = np.stack([np.minimum(np.searchsorted(c, own[v].to_numpy(), "left"), 15) for c, v in zip(cuts, VARS)])
        place = {}
        for i in range(part.n):
            place.setdefault((*part.bins[:, i].tolist(), int(part.y[i]), int(part.fold[i])), []).append(i)
        y = T.as_integers(own.y.to_numpy(), x["_low"], x["_high"])
        order = [place[(*bins[:, i].tolist(), int(y[i]), int(fold[i]))].pop() for i in range(len(own))]
        for f in range(4):
            total, predicted = np.zeros(3), 0.0
            for t in range(4):
                w = np.where(fold == f, 0, T.bootstrap(part.draw[order], how.seed, f * 4 + t))
                use = w > 0
                tree = plain_tree(bins.T[use].astype(float), y[use], w[use], [np.arange(16)] * 3, 3)
                total += shares(tree, 3)
                predicted = predicted + np.array([guess(tree, row) for row in bins.T[fold == f]])
            want = total / total.sum() if total.sum() else total
            assert np.allclose([got[key, f, v] for v in VARS], want, atol=1e-9)
            guessed = T.from_integers(predicted / 4, x["_low"], x["_high"])
            real = own.y.to_numpy()[fold == f]
            assert np.isclose(errors[key, f][1], np.sqrt(np.mean((guessed - real) ** 2)), atol=1e-6)
            assert np.isclose(errors[key, f][0], np.mean(np.abs(guessed - real) / np.maximum(np.abs(real), R.EPS)), rtol=1e-5)


def test_parts_and_batches_change_nothing(frame):
    def nodes(**options):
        how = R.Forest(trees=5, max_depth=4, bins=32, **options)
        blocks, groves = M.forest_trees(frame, ["k"], ["t"], VARS, "y", k=3, how=how)
        parts = blocks.groupBy("k").count().agg(F.max("count")).first()[0]
        found = R.forest_nodes(groves, blocks, ["k"], VARS, how).select("k", "fold", "tree", "feature", "threshold", "value", "gain")
        importance = R.fold_importances(groves, ["k"], VARS).collect()
        return parts, sorted(map(tuple, found.collect()), key=str), sorted(map(tuple, importance), key=str)

    one, many, single = nodes(), nodes(part_rows=25, task_trees=2), nodes(task_trees=1)
    assert one[0] == 1 and many[0] > 4
    assert one[1] == many[1] == single[1]
    assert all(a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-12 for a, b in zip(one[2], many[2]))


def test_more_keys_than_any_driver_loop_would_take(spark):
    """A hundred keys and all folds; the number of jobs does not follow them."""
    r = np.random.default_rng(3)
    rows = [(f"m{m}", t, float(a), float(b), 0.0, float(a if m % 2 else b)) for m in range(100)
            for t, (a, b) in enumerate(r.normal(size=(40, 2)))]
    df = spark.createDataFrame(rows, SCHEMA)
    imp = M.forest_importance(df, ["k"], ["t"], VARS, "y", num_trees=10, max_depth=3).toPandas()
    first = imp[imp["index"] == 0].set_index("k").feature
    assert len(first) == 100 and all(first[f"m{m}"] == ("a" if m % 2 else "b") for m in range(100))
    assert (imp[imp.feature == "c"].feature_importance == 0).all()


def test_constant_target_missing_feature_and_no_keys(spark, frame):
    gone = frame.withColumn("b", F.when(F.col("k") == "k1", F.lit(None).cast("double")).otherwise(F.col("b")))
    imp = M.forest_importance(gone, ["k"], ["t"], VARS, "y", k=3, num_trees=4, max_depth=3).toPandas()
    assert (imp[(imp.k == "k1") & (imp.feature == "b")].feature_importance == 0).all()
    assert (imp[imp.k.isna()].feature_importance == 0).all() and len(imp) == 9
    alone = M.forest_importance(frame.where("k = 'k1'"), [], ["t"], VARS, "y", k=3, num_trees=6, max_depth=4).toPandas()
    assert alone.set_index("feature").loc["a", "index"] == 0.0
    assert M.forest_importance(frame.limit(0), ["k"], ["t"], VARS, "y", k=3).count() == 0


def test_cv_scores_rank_the_forest_where_it_fits_best(spark):
    r = np.random.default_rng(8)
    rows = [("s", t, float(a), float(b), 0.0, float(10 + 5 * (a > 0) * (b > 0))) for t, (a, b) in enumerate(r.normal(size=(600, 2)))]
    df = spark.createDataFrame(rows, SCHEMA)
    scores = M.cv_scores(df, ["k"], ["a", "b"], "y", hash_cols=["t"], forest_kw={"num_trees": 20})
    assert scores.count() == 4 and M.select_model(scores, ["k"]).first().model == "RandomForestRegressor"


def test_poisson_draws():
    w = T.bootstrap(np.arange(200_000), 7, 3)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert not np.array_equal(w, T.bootstrap(np.arange(200_000), 7, 4))
    assert T.bootstrap(np.arange(5), 1, 1).tolist() == T.bootstrap(np.arange(9), 1, 1)[:5].tolist()


def test_small_keys_are_grown_and_used_in_one_task(spark, monkeypatch):
    """Their trees are neither written nor moved, and give what written ones give."""
    from pyspark.sql import functions as F
    from lever.operators import forest as R
    keys = 4 * spark.sparkContext.defaultParallelism + 1
    rows = spark.range(40 * keys).select((F.col("id") % keys).alias("k"), F.col("id"), (F.col("id") * 7 % 11).cast("double").alias("a"),
                                         (F.col("id") * 5 % 13).cast("double").alias("b"), (F.col("id") * 3 % 17).cast("double").alias("y"),
                                         (F.col("id") % 2).alias("fold"))
    how = R.Forest(trees=3, max_depth=3, task_trees=2)
    names, write = [], R.written
    monkeypatch.setattr(R, "written", lambda df, name: names.append(name) or write(df, name))
    blocks = R.forest_blocks(rows, ["k"], ["a", "b"], "y", ["id"], "fold", how)
    found = [R.grown_importances(blocks, ["k"], 2, ["a", "b"], how).orderBy("k", "fold", "feature").toPandas(),
             R.grown_errors(blocks, ["k"], 2, how).orderBy("k", "fold").toPandas()]
    assert names == ["forest-bounds", "forest-blocks"] and len(found[1]) == 2 * keys
    trees = R.grow_forests(blocks, ["k"], 2, how)
    told = [R.fold_importances(trees, ["k"], ["a", "b"]).orderBy("k", "fold", "feature").toPandas(),
            R.fold_errors(blocks, trees, ["k"], how).orderBy("k", "fold").toPandas()]
    for a, b in zip(found, told):
        assert (a.drop(columns=a.columns[-1]) == b.drop(columns=b.columns[-1])).all().all() and abs(a.iloc[:, -1] - b.iloc[:, -1]).max() < 1e-12


def wide(n, keys, seed=5):
    """Rows of ``keys`` keys, one of them null, with ties, few and many values, a heavy tail and a key of one row."""
    r = np.random.default_rng(seed)
    a, b, c = r.normal(size=n), r.integers(0, 4, n).astype(float), np.exp(3 * r.normal(size=n))
    k = [None if x == 0 else f"k{x}" for x in r.integers(0, keys, n)]
    y = np.round(a + b * (c > 1) + 0.3 * r.normal(size=n), 1)
    return [*zip(k, range(n), a.tolist(), b.tolist(), c.tolist(), y.tolist()), ("alone", n, 1.0, 2.0, 3.0, 4.0)]


@pytest.mark.parametrize("n,keys,options", [
    (2500, 3, {"trees": 7, "max_depth": 9, "bins": 256, "task_trees": 3}), (4000, 60, {"trees": 4, "max_depth": 5}),
    (900, 2, {"trees": 2, "max_depth": 40, "bins": 8, "bootstrap": False}), (30000, 1, {"trees": 2, "max_depth": 8, "seed": -3})])
def test_the_java_function_grows_the_same_trees(spark, n, keys, options):
    how = R.Forest(**options)
    blocks = M._fold_blocks(spark.createDataFrame(wide(n, keys), SCHEMA), ["k"], ["t"], VARS, "y", 3, how)
    trees = R.grow_forests(blocks, ["k"], 3, how)
    by = ["k", "fold", "feature"]
    pairs = [(R.grown_importances(blocks, ["k"], 3, VARS, how), R.fold_importances(trees, ["k"], VARS), by),
             (R.grown_errors(blocks, ["k"], 3, how), R.fold_errors(blocks, trees, ["k"], how), by[:2])]
    for got, want, by in pairs:
        got, want = (x.toPandas().sort_values(by).reset_index(drop=True) for x in (got, want))
        assert len(got) == len(want) > 0 and got.dtypes.equals(want.dtypes)
        assert got[by].fillna("").equals(want[by].fillna(""))
        for c in got.columns.difference(by):
            assert np.allclose(got[c], want[c], rtol=1e-12, atol=1e-14)


def test_keys_of_one_part_leave_the_trees_to_the_jvm(spark, frame):
    """No Python worker takes part once the rows are packed, and no tree is written."""
    how = R.Forest(trees=3, max_depth=3)
    blocks = M._fold_blocks(frame, ["k"], ["t"], VARS, "y", 4, how)
    for found in (R.grown_importances(blocks, ["k"], 4, VARS, how), R.grown_errors(blocks, ["k"], 4, how)):
        plan = found._jdf.queryExecution().toString()
        assert "lever_forest" in plan and "InArrow" not in plan and "Python" not in plan
