"""Harmonic packing of documents into sequences of bounded length.

Piece lengths fall into reciprocal-capacity classes: class k takes lengths in
(C/(k+1), C/k], and each of its sequences takes exactly k pieces.  Every task
fills its own sequences, with no shuffle and no shared state.

Documents may be cut freely, so they are cut to fill the classes: full pieces
of C, then halves, quarters and so on down to C/16, whose classes fill without
a gap, and one rest below C/16, whose class wastes little.  When a task ends,
the pieces of its unfilled classes (a bounded number) go, longest first, each
into the first sequence with room, so that about one sequence a task stays
part-filled.

Each id lies in one piece.  Null and empty texts yield the end id alone.
Repeated rows are packed each on its own.  Extra columns are ignored.  A task
that is run again packs its rows the same way, as sequence numbers depend on
its partition and row order only.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from lever.llm.common import col, text_blocks, tidied
from lever.llm.word_tokens import default_path, loaded


def cuts(n: int, capacity: int, smallest: int) -> list[int]:
    """Lengths of the pieces of a document of n ids."""
    out = [capacity] * (n // capacity)
    rest, size = n % capacity, capacity // 2
    while size >= smallest:
        if rest >= size:
            out.append(size)
            rest -= size
        size //= 2
    return out + [rest] * (rest > 0)


class Packer:
    """The sequences of one task.  Pieces are (length, payload); full sequences come out at once."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next = capacity, first
        self.open: dict[int, list] = {}

    def add(self, length: int, payload) -> list | None:
        """The pieces of the sequence that this one fills, if any."""
        k = self.capacity // length
        pieces = self.open.setdefault(k, [])
        pieces.append((length, payload))
        if len(pieces) == k:
            return self._numbered(self.open.pop(k))
        return None

    def _numbered(self, pieces: list) -> list:
        number, offset, out = self.next, 0, []
        self.next += 1
        for length, payload in pieces:
            out.append((payload, number, offset))
            offset += length
        return out

    def finish(self) -> list:
        """What is left, first fit by falling length; bounded by the classes, not by the input."""
        left = sorted((p for pieces in self.open.values() for p in pieces), key=lambda p: -p[0])
        self.open = {}
        bins: list[tuple[list, list]] = []
        room: list[int] = []
        for piece in left:
            at = next((i for i, r in enumerate(room) if r >= piece[0]), None)
            if at is None:
                bins.append([])
                room.append(self.capacity)
                at = len(bins) - 1
            bins[at].append(piece)
            room[at] -= piece[0]
        return [x for pieces in bins for x in self._numbered(pieces)]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
         capacity: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and its ids).

    ``capacity`` is a power of two; ``tokenizer`` a file as in :mod:`word_tokens`.
    """
    path = tokenizer or default_path()
    source = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    id_type = to_arrow_schema(source.schema)[0].type
    smallest = max(1, capacity // 16)
    kinds = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
             ("sequence_id", pa.int64()), ("offset", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids
    end = np.array([end_id], "<u4").tobytes()

    def batch(rows: list) -> pa.RecordBatch:
        columns = list(zip(*[(p[0], p[1], p[2], p[3], p[4], number, offset, *p[5:]) for p, number, offset in rows]))
        arrays = [pa.array(c, t) for c, t in zip(columns[:7], [id_type] + [t for _, t in kinds])]
        if with_ids:
            flat = np.frombuffer(b"".join(columns[7]), "<u4").astype(np.int32)
            ends = np.cumsum([0] + [len(x) >> 2 for x in columns[7]], dtype=np.int32)
            arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
        return pa.RecordBatch.from_arrays(arrays, names=["id", *[k for k, _ in kinds]])

    def run(batches):
        words = loaded(path)
        packer = Packer(capacity, TaskContext.get().partitionId() << 40)
        rows: list = []
        for ids, texts in text_blocks(batches, "id", "text", 1 << 19):
            for key, text in zip(ids, texts):
                data = words.text(text) + end
                total, start = len(data) >> 2, 0
                for length in cuts(total, capacity, smallest):
                    part = data[4 * start:4 * (start + length)]
                    payload = (key, start, length, zlib.crc32(part), total) + ((part,) if with_ids else ())
                    rows += packer.add(length, payload) or ()
                    start += length
            if len(rows) >= (250 if with_ids else 2000):
                yield batch(rows)
                rows = []
        rows += packer.finish()
        if rows:
            yield batch(rows)

    schema = f"id {source.schema['id'].dataType.simpleString()}, " + ", ".join(
        f"{k} " + ("array<int>" if k == "ids" else "bigint") for k, _ in kinds)
    return source.mapInArrow(tidied(run, keep_caches=True), schema).withColumnRenamed("id", id_col)
