"""Vector codes by exact integer arithmetic in the Walsh-Hadamard domain.

Components become integers, floor(scale * x).  Vectors are cut in equal parts, a
part is padded with zeros to a power of two m, and its Walsh-Hadamard transform
is kept in sequency order (by sign changes), slow components first.  The
transform H is symmetric and H H = m I, so squared distances of transforms are m
times those of the parts, and a sum of transforms is the transform of the sum:
all work stays on transforms, in integers.

A part's nearest entry is found by adding squared differences in sequency order,
in ranges that double.  The entry that leads after the first range is measured in
full; from then on an entry whose sum exceeds that bound is eliminated.  An entry
as far as the nearest is never eliminated, so the lowest index wins ties, exactly.

A codebook's first entries are the parts of the smallest kept ids.  Each round is
one pass that sums, inside each task, the transforms of the parts of every entry;
only those sums are shuffled.  An entry becomes floor(sum / count), componentwise.

Dropped are rows whose vector is null, holds a null or non-finite component, or has
not as many components as that of the smallest kept id.  A count of components that
``parts`` does not divide is filled up with zeros.  Null ids come last, repeated rows
count each; of equal ids the vector with the smaller transform comes first.  With
fewer rows than entries there are so many entries.  Integers from 2^48 up are an
error, as their distances fit no long.  Empty tables give an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lever.llm.common import col, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
_TOO_LARGE = float(1 << 48)


# ------------------------------------------------------------------ transform
def sequency_matrix(m: int) -> np.ndarray:
    """The Walsh-Hadamard matrix of order m (a power of two), rows by their number of sign changes."""
    h = np.ones((1, 1), np.int64)
    while len(h) < m:
        h = np.block([[h, h], [h, -h]])
    return h[np.argsort((np.diff(h, axis=1) != 0).sum(axis=1), kind="stable")]


def padded_size(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def _safe(top: int, m: int) -> bool:
    """Do m squared differences of transforms of integers up to ``top`` fit 64 bits?"""
    return 4 * m ** 3 * top ** 2 < 1 << 62


def transformed(parts: np.ndarray) -> np.ndarray:
    """(..., width) integers to (..., m) transforms."""
    width = parts.shape[-1]
    m = padded_size(width)
    return parts @ sequency_matrix(m)[:, :width].T.astype(parts.dtype)


def restored(transforms: np.ndarray, width: int) -> np.ndarray:
    """The inverse, exact: H rows in any order are orthogonal with squared norm m."""
    m = transforms.shape[-1]
    return (transforms @ sequency_matrix(m).astype(transforms.dtype) // m)[..., :width]


# ------------------------------------------------------------------ search
def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, m times the squared distance) of the nearest of ``entries`` (E, m) for each of ``rows`` (n, m)."""
    n, m = rows.shape
    first = rows[:, None, :1] - entries[None, :, :1]
    partial = first[:, :, 0] * first[:, :, 0]
    lead = np.argmin(partial, axis=1)
    rest = rows - entries[lead]
    bound = (rest * rest).sum(axis=1)
    row, entry = np.nonzero(partial <= bound[:, None])
    total = partial[row, entry]
    a = 1
    while a < m:
        b = 2 * a
        diff = rows[row, a:b] - entries[entry, a:b]
        total = total + (diff * diff).sum(axis=1)
        alive = total <= bound[row]
        row, entry, total = row[alive], entry[alive], total[alive]
        a = b
    starts = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    least = np.minimum.reduceat(total, starts) if len(row) else total
    counts = np.diff(np.append(starts, len(row)))
    best = np.flatnonzero(total == np.repeat(least, counts))
    _, keep = np.unique(row[best], return_index=True)  # entries rise within a row
    return entry[best[keep]], least


def assigned(transforms: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, errors times m): the nearest entry of each part of (n, parts, m) transforms."""
    codes, errors = [], []
    for k, book in enumerate(books):
        code, error = nearest(transforms[:, k], book)
        codes.append(code)
        errors.append(error)
    return np.stack(codes, axis=1), np.stack(errors, axis=1)


# ------------------------------------------------------------------ Spark
def _blocks(batches, parts: int, rows: int = 4096):
    """(first row, batch, transforms (n, parts, m)) of bounded runs of rows; Python integers where 64 bits are too few."""
    for batch in batches:
        if not batch.num_rows:
            continue
        flat = batch.column("transform").flatten().to_numpy(zero_copy_only=False)
        own = flat.reshape(batch.num_rows, parts, -1)
        for a in range(0, batch.num_rows, rows):
            yield a, batch, own[a:a + rows]


def _fitting(own: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    m = own.shape[2]
    top = max([int(np.abs(own).max(initial=0)), *(int(np.abs(b).max(initial=0)) for b in books)])
    if _safe(-(-top // m), m):
        return own, [b.astype(np.int64) for b in books]
    return own.astype(object), [b.astype(object) for b in books]


def _kept(vectors: DataFrame, parts: int, scale: int) -> DataFrame:
    """(id, label, size, transform) of the rows that are kept."""
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("id", "label")}

    def run(batches):
        for batch in batches:
            vector = batch.column("vector")
            values = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
            starts, ends = vector.offsets.to_numpy()[:-1], vector.offsets.to_numpy()[1:]
            sizes = np.where(vector.is_valid().to_numpy(zero_copy_only=False), ends - starts, -1)
            for size in np.unique(sizes[sizes >= 0]).tolist():
                own = np.flatnonzero(sizes == size)
                x = values[starts[own][:, None] + np.arange(size)]
                whole = np.isfinite(x).all(axis=1)
                own, x = own[whole], np.floor(x[whole] * scale)
                if (np.abs(x) >= _TOO_LARGE).any():
                    raise ValueError("a component is too large for exact distances in 64 bits")
                width = -(-size // parts)
                cut = np.zeros((len(own), parts * width), np.int64)
                cut[:, :size] = x
                flat = (transformed(cut.reshape(len(own), parts, width)) if width else np.zeros((len(own), parts), np.int64)).reshape(-1)
                ends_out = np.arange(len(own) + 1, dtype=np.int32) * (len(flat) // max(1, len(own)))
                rows = batch.take(pa.array(own, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("id"), rows.column("label"), pa.array(np.full(len(own), size, np.int32)),
                     pa.ListArray.from_arrays(pa.array(ends_out), pa.array(flat))], names=["id", "label", "size", "transform"])

    return vectors.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, size int, transform array<bigint>")


def _sums(kept: DataFrame, books: list[np.ndarray], parts: int) -> dict:
    """(part, entry) -> (count, sums of the transforms) of the parts nearest to each entry; bounded by the codebooks."""
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        sums = [np.zeros(b.shape, object) for b in shared.value]
        counts = [np.zeros(len(b), np.int64) for b in shared.value]
        for _, _, block in _blocks(batches, parts):
            own, books = _fitting(block, shared.value)
            codes, _ = assigned(own, books)
            for k in range(parts):
                order = np.argsort(codes[:, k], kind="stable")
                used, starts = np.unique(codes[order, k], return_index=True)
                sums[k][used] += np.add.reduceat(own[order, k], starts, axis=0).astype(object)
                counts[k][used] += np.diff(np.append(starts, len(order)))
        rows = [(k, int(e), i, int(counts[k][e]), Decimal(int(x)))
                for k in range(parts) for e in np.flatnonzero(counts[k]) for i, x in enumerate(sums[k][e])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5, (pa.int32(), pa.int32(), pa.int32(), pa.int64(),
                                                                        pa.decimal128(38, 0)))],
            names=["part", "entry", "place", "n", "total"])

    found = kept.select("transform").mapInArrow(run, "part int, entry int, place int, n bigint, total decimal(38,0)") \
        .groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
    out: dict = {}
    for r in sorted(found, key=lambda r: r["place"]):
        out.setdefault((r["part"], r["entry"]), (r["n"], []))[1].append(int(r["total"]))
    return out


def codebooks(kept: DataFrame, size: int, parts: int, entries: int, rounds: int) -> list[np.ndarray]:
    """The entries of each part position after the rounds, as integers (entries, width)."""
    width = -(-size // parts)
    first = kept.orderBy(F.asc_nulls_last("id"), "transform").select("transform").limit(entries).collect()
    start = np.array([r[0] for r in first], object).reshape(len(first), parts, -1)
    books = [start[:, k] for k in range(parts)]
    for _ in range(rounds):
        for (k, e), (n, total) in _sums(kept, books, parts).items():
            mean = restored(np.array(total, object), width) // n
            books[k] = books[k].copy()
            books[k][e] = transformed(mean) if width else books[k][e]
    return books


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(id, label, code, error, codebooks) of every kept row: two hex digits a part, the squared distance summed over
    the parts, and all final entries as text (part, entry, place), the same for every row."""
    if entries > 256:
        raise ValueError("a code has two hex digits a part")
    source = vectors.select(col(id_col).alias("id"), col(label_col).alias("label"), col(vector_col).alias("vector"))
    kept = written(_kept(source, parts, scale), "transforms")
    first = kept.orderBy(F.asc_nulls_last("id"), "transform").select("size").first()
    names = dict(id=id_col, label=label_col)
    if first is None:
        return kept.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
                           F.lit("").alias("codebooks")).withColumnsRenamed(names)
    kept = kept.filter(F.col("size") == first["size"])
    books = codebooks(kept, first["size"], parts, entries, rounds)
    width = -(-first["size"] // parts)
    listed = ",".join(str(int(x)) for b in books for e in b for x in restored(e, width).tolist())
    shared = kept.sparkSession.sparkContext.broadcast(books)
    schema = kept.select("id", "label").schema.add("code", "string").add("error", "long")
    arrow = to_arrow_schema(schema)

    def run(batches):
        for a, batch, block in _blocks(batches, parts):
            own, books = _fitting(block, shared.value)
            codes, errors = assigned(own, books)
            text = ["".join(f"{c:02x}" for c in row) for row in codes.tolist()]
            error = [int(x) for x in errors.sum(axis=1) // own.shape[2]]
            part = batch.slice(a, len(own))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), pa.array(text), pa.array(error, pa.int64())],
                                             schema=arrow)

    return kept.select("id", "label", "transform").mapInArrow(run, schema) \
        .withColumn("codebooks", F.lit(listed)).withColumnsRenamed(names)


def label_errors(coded: DataFrame, label_col: str = "label") -> DataFrame:
    """``coded`` with ``label_error``: the error summed over rows of an equal label, nulls together."""
    coded = written(coded, "coded")
    sums = written(coded.groupBy(col(label_col).alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    return coded.join(sums, col(label_col).eqNullSafe(F.col("_label"))).drop("_label")


def digested(coded: DataFrame) -> DataFrame:
    """``codebooks`` replaced by ``codebooks_sha256``."""
    first = coded.select("codebooks").first()
    digest = hashlib.sha256((first[0] if first else "").encode()).hexdigest()
    return coded.drop("codebooks").withColumn("codebooks_sha256", F.lit(digest))
