"""Refits of linear models on all folds of all keys from one pass of moments.

A task has its rows in the order of (key, fold) and streams them: of each group the
row count and the columns' counts, means, extremes and centred cross products, all
groups of a batch in one go and one group held from batch to batch, so memory does not
grow with the keys.  Groups are added by the update that merges samples about their own
means, so nothing cancels and no pass for a pilot mean is needed.  Only these dense
blocks are shuffled (p x p numbers for each key, fold and task that met it).  "Train on every fold but f" is the total less
fold f; min-max scaling is an affine map of the moments.  So the pass over the rows, the
plan and its number of columns do not grow with the number of models, folds or features.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, StringType, StructField, StructType

from lever.functions import linalg
from lever.functions.runs import starts
from lever.functions.sizing import materialize

#: Bytes of stacked problems solved at a time.
HELD = 64 << 20


def _q(c):
    return F.col(f"`{c}`")


class Moments:
    """Of some rows of width w (first column: the target): n, counts, means, lows, highs, centred cross products."""

    def __init__(self, n, count, mean, low, high, cross):
        self.n, self.count, self.mean, self.low, self.high, self.cross = n, count, mean, low, high, cross

    @classmethod
    def of(cls, z: np.ndarray) -> "Moments":
        return cls.unpacked(groups_of(z, np.zeros(1, np.int64))[0], z.shape[1])

    def __add__(self, other: "Moments") -> "Moments":
        return Moments.unpacked(merged(np.stack([self.numbers(), other.numbers()]), np.zeros(1, np.int64), len(self.count))[0], len(self.count))

    def numbers(self) -> np.ndarray:
        return np.concatenate([[self.n], self.count, self.mean, self.low, self.high, self.cross.reshape(-1)])

    def packed(self) -> bytes:
        return self.numbers().tobytes()

    @classmethod
    def unpacked(cls, raw, w: int) -> "Moments":
        a = np.frombuffer(raw) if isinstance(raw, bytes) else raw
        return cls(a[0], *(a[1 + i * w:1 + (i + 1) * w] for i in range(4)), a[1 + 4 * w:].reshape(w, w))


def _crossed(scaled: np.ndarray, plain: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each group of rows the sums of the products of two columns, flat: w numbers of a row at a time."""
    return np.concatenate([np.add.reduceat(scaled[:, i:i + 1] * plain, start, axis=0) for i in range(plain.shape[1])], axis=1)


def groups_of(z: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A row of packed moments for each group of rows of ``z``, which begin at ``start``."""
    sizes = np.diff(start, append=len(z))
    there = ~np.isnan(z)
    count = np.add.reduceat(there.astype(float), start, axis=0)
    mean = np.add.reduceat(np.where(there, z, 0.0), start, axis=0) / np.maximum(count, 1)
    centred = np.where(there, z - np.repeat(mean, sizes, axis=0), 0.0)
    low = np.minimum.reduceat(np.where(there, z, np.inf), start, axis=0)
    high = np.maximum.reduceat(np.where(there, z, -np.inf), start, axis=0)
    return np.concatenate([sizes[:, None].astype(float), count, mean, low, high, _crossed(centred, centred, start)], axis=1)


def merged(m: np.ndarray, start: np.ndarray, w: int) -> np.ndarray:
    """A row of packed moments for each group of rows of packed moments, which begin at ``start``."""
    if len(start) == len(m):
        return m
    sizes = np.diff(start, append=len(m))
    n, count, mean, low, high, cross = m[:, :1], *(m[:, 1 + i * w:1 + (i + 1) * w] for i in range(4)), m[:, 1 + 4 * w:]
    counts = np.add.reduceat(count, start, axis=0)
    # about one of the means, so that adding them loses nothing
    first = np.repeat(np.where(count > 0, mean, 0.0)[start], sizes, axis=0)
    off = np.where(count > 0, mean - first, 0.0)
    middle = np.add.reduceat(count * off, start, axis=0) / np.maximum(counts, 1)
    gap = np.where(count > 0, off - np.repeat(middle, sizes, axis=0), 0.0)
    return np.concatenate([np.add.reduceat(n, start, axis=0), counts, first[start] + middle, np.minimum.reduceat(low, start, axis=0),
                           np.maximum.reduceat(high, start, axis=0),
                           np.add.reduceat(cross, start, axis=0) + _crossed(n * gap, gap, start)], axis=1)


def _fields(m: np.ndarray, w: int):
    """n, counts, means, lows, highs and centred cross products of rows of packed moments."""
    return m[:, 0], *(m[:, 1 + i * w:1 + (i + 1) * w] for i in range(4)), m[:, 1 + 4 * w:].reshape(-1, w, w)


def _packed(m: np.ndarray) -> pa.Array:
    """Rows of numbers as binary cells."""
    width = 8 * m.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(np.arange(len(m) + 1, dtype=np.int32) * width),
                                                      pa.py_buffer(np.ascontiguousarray(m).tobytes())])


def _unpacked(cells: pa.Array, numbers: int) -> np.ndarray:
    return np.frombuffer(b"".join(cells.to_pylist())).reshape(-1, numbers)


def _summed(rows: DataFrame, by, schema: StructType, w: int, read) -> DataFrame:
    """Moments of rows that come in the order of ``by``, a row each time that a batch ends or ``by`` changes, and those
    of two batches put together: ``read(batch, start)`` gives a batch's, group by group."""
    arrow = to_arrow_schema(schema)

    def run(batches):
        held = None  # the last group's mark and moments: the next batch may go on with it
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = pa.Table.from_batches([batch.select(by)])
            start = starts(marks)
            m = read(batch, start)
            marks = marks.take(pa.array(start))
            if held is not None:
                marks, m = pa.concat_tables([held[0], marks]), np.concatenate([held[1], m])
                if len(starts(marks.slice(0, 2))) == 1:
                    marks, m = marks.slice(1), np.concatenate([merged(m[:2], np.zeros(1, np.int64), w), m[2:]])
            held = marks.slice(len(m) - 1), m[-1:].copy()
            if len(m) > 1:
                yield done(marks.slice(0, len(m) - 1), m[:-1])
        if held is not None:
            yield done(*held)

    def done(marks, m):
        return pa.RecordBatch.from_arrays([*(pa.concat_arrays(c.chunks) for c in marks.columns), _packed(m)], schema=arrow)

    return rows.mapInArrow(run, schema)


def fold_moments(df: DataFrame, keys, fold_col: str, xcols, y: str, in_order: bool = False) -> DataFrame:
    """(keys, fold, _m): the packed :class:`Moments` of (y, x...) of every key and fold; rows without y are left out.

    ``in_order``: a task's rows of a key and fold come one after another, as a window by key leaves them, so they need
    not meet first.  Rows that do not are only more work: their moments are put together all the same.
    """
    keys, w = list(keys), len(xcols) + 1
    numbers = 1 + 4 * w + w * w
    by = [*keys, fold_col]
    rows = df.where(_q(y).isNotNull()).select(*[_q(c).alias(c) for c in by], F.array(*[_q(c).cast("double") for c in (y, *xcols)]).alias("_v"))
    schema = StructType([rows.schema[c] for c in by] + [StructField("_m", BinaryType())])

    def of_rows(batch, start):
        z = batch.column("_v").flatten().to_numpy(zero_copy_only=False).reshape(-1, w)
        return groups_of(z, start)

    def of_moments(batch, start):
        return merged(_unpacked(batch.column("_m"), numbers), start, w)

    if not in_order:
        # rows of a group meet, and adaptive execution cuts a group that is large: a row of moments for each group and task
        rows = rows.hint("rebalance", *[_q(c) for c in by]).sortWithinPartitions(*[_q(c) for c in by])
    parts = _summed(rows, by, schema, w, of_rows).repartition(*[_q(c) for c in by]).sortWithinPartitions(*[_q(c) for c in by])
    return materialize(_summed(parts, by, schema, w, of_moments), "moments")


def solve_folds(moments: DataFrame, keys, fold_col: str, xcols, models: dict, normalize: bool = False) -> DataFrame:
    """(keys, fold, model, intercept, weights): every model (name -> (solver, alpha)) fitted on all folds but the row's.

    ``normalize``: on columns scaled to [0, 1] per key, target included, as the weights are then; a constant column
    has no weight and a constant target no rows.  Otherwise weights are in the columns' own units, while the solver
    sees columns of equal spread.  A column without values for a key has a NULL weight.
    """
    keys, w, names = list(keys), len(xcols) + 1, list(models)
    by, numbers = [*keys, fold_col], 1 + 4 * w + w * w
    schema = StructType([moments.schema[c] for c in by] + [
        StructField("model", StringType()), StructField("intercept", DoubleType()), StructField("weights", ArrayType(DoubleType()))])
    arrow = to_arrow_schema(schema)
    together = max(1, HELD // (8 * w * w))  # problems stacked at a time

    def solved(rows):
        marks, m = rows.select(by), _unpacked(pa.concat_arrays(rows.column("_m").chunks), numbers)
        start = _keys_start(rows)
        total = np.repeat(merged(m, start, w), np.diff(start, append=len(m)), axis=0)
        t_n, t_count, t_mean, t_low, t_high, t_cross = _fields(total, w)
        if normalize:
            spread = np.where(t_count > 0, t_high - t_low, 0.0)
        else:
            spread = np.sqrt(np.diagonal(t_cross, axis1=1, axis2=2) / t_n[:, None])
            spread = np.where(spread > 0, spread, 1.0)
            spread[:, 0] = 1.0
        n, count, mean, _, _, cross = _fields(m, w)
        shift = np.where(count > 0, n[:, None] * (mean - t_mean), 0.0)
        ss = t_cross - cross - shift[:, :, None] * shift[:, None, :] / n[:, None, None]
        n, s, centre, active = t_n - n, -shift, t_mean, (t_count > 0) & (spread > 0)
        varied = spread[:, 0] > 0
        if not varied.all():
            marks = marks.filter(pa.array(varied))
            n, s, ss, spread, centre, active = (a[varied] for a in (n, s, ss, spread, centre, active))
        if not len(n):
            return
        safe = np.where(spread > 0, spread, 1.0)
        s, ss = s / safe, ss / (safe[:, :, None] * safe[:, None, :])
        columns = [pa.concat_arrays(c.chunks) for c in marks.columns]
        for name in names:
            kind, alpha = models[name]
            b0, weights = linalg.fit_batch(kind, n, s[:, 1:], s[:, 0], ss[:, 1:, 1:], ss[:, 1:, 0], active[:, 1:], alpha,
                                           None if normalize else safe[:, 1:])
            if not normalize:
                weights = weights / safe[:, 1:]
                b0 = b0 + centre[:, 0] - np.nansum(weights * centre[:, 1:], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * (w - 1)),
                                             pa.array(weights.reshape(-1), from_pandas=True))
            yield pa.RecordBatch.from_arrays([*columns, pa.array([name] * len(n)), pa.array(b0, from_pandas=True), lists], schema=arrow)

    def _keys_start(rows):
        return starts(rows.select(keys)) if keys else np.zeros(min(rows.num_rows, 1), np.int64)

    def run(batches):
        held = None  # whole keys that wait for company, and the last one: the next batch may go on with it
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            if held.num_rows < together:
                continue
            start, done = _keys_start(held), 0
            for until in start[1:]:
                if until - done >= together or until == start[-1]:
                    yield from solved(held.slice(done, until - done))
                    done = until
            held = held.slice(done)
        if held is not None and held.num_rows:
            yield from solved(held)

    met = moments.repartition(*[_q(c) for c in keys]) if keys else moments.repartition(1)  # without keys k rows in all
    return materialize(met.sortWithinPartitions(*[_q(c) for c in by]).mapInArrow(run, schema), "coefficients")


def coefficients_long(solutions: DataFrame, keys, fold_col: str, xcols) -> DataFrame:
    """(keys, fold, model, feature, coefficient); none for features without a weight."""
    names = F.array(*[F.lit(c) for c in xcols])
    pairs = F.arrays_zip(names.alias("feature"), F.col("weights").alias("coefficient"))
    return solutions.select(*[_q(k) for k in keys], _q(fold_col), "model", F.inline(pairs)).where("coefficient IS NOT NULL")
