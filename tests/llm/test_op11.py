import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from lever.llm import op11_vector_codes as op11

VECTOR = "vec_id bigint, embedding array<float>, label int"


def brute(rows, parts=8, entries=16, rounds=6):
    """Plain integer k-means over parts; rows (id, vector, label), ids unique."""
    kept = [(i, [math.floor(4096 * np.float64(np.float32(x))) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    width = len(kept[0][1]) // parts
    cut = [[v[k * width:(k + 1) * width] for k in range(parts)] for _, v, _ in kept]
    books = [[list(c[k]) for c in cut[:entries]] for k in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for k in range(parts):
            groups: dict = {}
            for c in cut:
                groups.setdefault(near(c[k], books[k])[1], []).append(c[k])
            for e, own in groups.items():
                books[k][e] = [sum(x) // len(own) for x in zip(*own)]
    out = {}
    for (i, _, label), c in zip(kept, cut):
        best = [near(c[k], books[k]) for k in range(parts)]
        out[i] = ("".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), label)
    listed = ",".join(str(x) for b in books for e in b for x in e)
    totals: dict = {}
    for _, error, label in out.values():
        totals[label] = totals.get(label, 0) + error
    return {i: (code, error, totals[label]) for i, (code, error, label) in out.items()}, listed


def found(spark, rows, **kw):
    out = op11.label_errors(op11.vector_codes(spark.createDataFrame(rows, VECTOR), **kw)).collect()
    return {r.vec_id: (r.code, r.error, r.label_error) for r in out}, (out[0].codebooks if out else "")


@pytest.mark.parametrize("m", [1, 2, 4, 8, 16, 32])
def test_transform(m):
    h = op11.sequency_matrix(m)
    assert (h @ h.T == m * np.eye(m, dtype=int)).all()
    assert (np.diff(h, axis=1) != 0).sum(axis=1).tolist() == list(range(m))  # sequency order
    x = np.arange(3 * m).reshape(3, m)[:, :max(1, m - 1)]
    t = op11.transformed(x)
    assert (op11.restored(t, x.shape[1]) == x).all()
    assert ((t * t).sum(axis=1) == op11.padded_size(x.shape[1]) * (x * x).sum(axis=1)).all()


small = st.integers(-3, 3)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(small, min_size=8, max_size=8), min_size=1, max_size=30),
       st.lists(st.lists(small, min_size=8, max_size=8), min_size=1, max_size=16), st.sampled_from([1, 10 ** 12]))
def test_nearest_is_exact_with_ties(rows, entries, factor):
    x, e = (op11.transformed(np.array(a, object) * factor) for a in (rows, entries))
    if factor == 1:
        x, e = x.astype(np.int64), e.astype(np.int64)
    code, scaled = op11.nearest(x, e)
    for r, c, d in zip(rows, code.tolist(), scaled.tolist()):
        want = min((sum((a - b) ** 2 for a, b in zip(r, y)) * factor ** 2, i) for i, y in enumerate(entries))
        assert (d // 8, c) == want and d % 8 == 0


def test_equals_plain_arithmetic(spark):
    r = np.random.default_rng(4)
    centres = r.normal(0, 0.3, (9, 24))
    rows = [(1000 - i, [float(np.float32(x)) for x in centres[i % 9] + r.normal(0, 0.05, 24)], i % 4 or None) for i in range(300)]
    rows += [(2000 + i, rows[i][1], 1) for i in range(40)]  # equal vectors
    want, books = brute(rows)  # parts of 3 components, padded to 4
    got, listed = found(spark, rows)
    assert got == want and listed == books


def test_dropped_and_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float((i * 7 + j) % 5 - 2) for j in range(16)], i % 2) for i in range(5)]
    bad = [(-1, None, 0), (-2, [None] + [0.0] * 15, 0), (-3, [nan] * 16, 1), (-4, [inf] + [0.0] * 15, 1), (9, [1.0] * 8, 0), (8, [], 0)]
    rows = good + bad + [(None, good[0][1], None)]
    source = spark.createDataFrame(rows, VECTOR).selectExpr("*", "1 AS code", "2 AS `a.b`", "'x' AS id")
    out = op11.vector_codes(source)
    assert out.columns == ["vec_id", "label", "code", "error", "codebooks"]
    want, _ = brute(good + [rows[-1]])
    assert {r.vec_id: (r.code, r.error, r.label_error) for r in op11.label_errors(out).collect()} == want


def test_large_components_stay_exact(spark):
    rows = [(i, [float((-1) ** i * (60_000 + 13 * i + j)) for j in range(8)], 0) for i in range(20)]
    got, listed = found(spark, rows)
    assert (got, listed) == brute(rows)
    with pytest.raises(Exception, match="too large"):
        found(spark, [(1, [1e30] * 8, 0)])


def test_empty_table(spark):
    assert found(spark, []) == ({}, "")
    assert op11.digested(op11.label_errors(op11.vector_codes(spark.createDataFrame([(1, None, 1)], VECTOR)))).collect() == []


def test_repeated_rows_and_ids(spark):
    row = (1, [0.5] * 16, 3)
    coded = op11.label_errors(op11.vector_codes(spark.createDataFrame([row, row, (1, [-0.5] * 16, 3)], VECTOR))).collect()
    assert len(coded) == 3 and {r.error for r in coded} == {0} and {r.label_error for r in coded} == {0}
    assert len({r.code for r in coded}) == 2
