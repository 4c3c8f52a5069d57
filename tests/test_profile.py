import numpy as np
import pandas as pd
import pytest

from lever.operators import profile as H


def _np_peaks(counts, n, share=0.1):
    """Interior local maxima (flat tops at their middle, rounded down) with height in [share*n, n]."""
    out, i, m = [], 1, len(counts) - 1
    while i < m:
        if counts[i - 1] < counts[i]:
            j = i + 1
            while j < m and counts[j] == counts[i]:
                j += 1
            if counts[j] < counts[i]:
                mid = (i + j - 1) // 2
                if share * n <= counts[mid] <= n:
                    out.append(mid)
                i = j
        i += 1
    return out


@pytest.mark.parametrize("values", [
    np.random.default_rng(0).normal(size=997),
    np.array([3.0] * 20),
    np.array([0.0, 0.1, 0.2, 0.3, 1.0]),
    np.random.default_rng(1).integers(0, 7, size=300).astype(float),
])
def test_histogram_matches_numpy(spark, values):
    df = spark.createDataFrame(pd.DataFrame({"x": values}))
    out = H.histogram(df, ["x"], [], 100).orderBy("bin").toPandas()
    counts, edges = np.histogram(values, 100)
    assert out.n.tolist() == counts.tolist()
    assert np.allclose(out.bin_lo.to_numpy(), edges[:-1]) and np.allclose(out.bin_hi.to_numpy(), edges[1:])


@pytest.mark.parametrize("seed", range(6))
def test_peaks_match_reference_loop(spark, seed):
    rng = np.random.default_rng(seed)
    values = np.concatenate([rng.normal(0, 1, 400), rng.normal(6, 1, 300), rng.uniform(-2, 8, 50)])
    if seed == 5:  # plateau: equal counts in bins 4-6
        values = np.repeat(np.arange(10.0), [1, 2, 3, 5, 9, 9, 9, 4, 2, 1])
    df = spark.createDataFrame(pd.DataFrame({"x": values}))
    out = H.histogram_peaks(df, ["x"], [], 10).orderBy("bin").toPandas()
    counts, edges = np.histogram(values, 10)
    expect = _np_peaks(counts, len(values))
    assert out.bin.tolist() == expect
    assert np.allclose(out.peak.to_numpy(), edges[1:][expect])


def test_histogram_with_splits_marks_the_bin(spark):
    df = spark.createDataFrame(pd.DataFrame({"x": np.linspace(0, 10, 101)}))
    splits = spark.createDataFrame([("x", 2.55), ("x", 10.0)], "variable string, threshold double")
    out = H.histogram_with_splits(df, ["x"], splits, [], 100).where("has_split").orderBy("bin").toPandas()
    assert out.bin.tolist() == [25, 99]


def test_tick_sample_every_nth_row(spark):
    df = spark.range(83).withColumnRenamed("id", "t")
    out = H.tick_sample(df, [], ["t"], 8).orderBy("t").toPandas()
    assert out.t.tolist() == list(range(0, 83, 10))
