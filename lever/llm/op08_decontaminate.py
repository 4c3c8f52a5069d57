"""Benchmark decontamination by a generalised suffix automaton.

The normalised words of the test items form one automaton per block of items.
Training words stream through it; at each word it knows the longest run of
words ending there that occurs in some item.  A run that holds a window (ten
consecutive item words, or a whole shorter item) is a hit.

Only stretches of a document whose neighbouring words are neighbours in some
item can hold a window, so the automaton reads just those stretches that are
long enough; numpy finds them.  That skips no window.

Items are collected in blocks of at most ``block_words`` words (one longer item
is a block of its own), so the driver and the broadcast hold one bounded block
at a time however many items there are; each block is one pass over the texts.

Null and empty texts have no words and no hits.  Null or empty items have no
windows; items without an id hit words but are not listed.  Repeated document
rows are each judged; equal item ids count once.  No table has to be non-empty.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lever.llm.common import byte_values, col, normal_words, text_blocks, tidied

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


class ItemAutomaton:
    """Suffix automaton of several word sequences, with the items of each window."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.edges: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        put = self.vocabulary.setdefault
        coded = [(key, [put(w, len(self.vocabulary)) for w in words]) for key, words in items if words]
        pairs = set()
        for _, ids in coded:
            last = 0
            for c in ids:
                last = self._extend(last, c)
            pairs.update(zip(ids, ids[1:]))
        self.least = min((min(len(ids), window) for _, ids in coded), default=0)
        size = max(1, len(self.vocabulary))
        self.size = size
        self.pairs = np.array(sorted(a * size + b for a, b in pairs), np.int64)
        self._mark(coded)

    def _extend(self, last: int, c: int) -> int:
        edges, link, length = self.edges, self.link, self.length
        q = edges[last].get(c)
        if q is not None and length[q] == length[last] + 1:
            return q
        if q is not None:
            return self._split(last, c, q)
        new = self._state({}, length[last] + 1, 0)
        p = last
        while p != -1 and c not in edges[p]:
            edges[p][c] = new
            p = link[p]
        if p != -1:
            q = edges[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return new

    def _state(self, edges: dict[int, int], length: int, link: int) -> int:
        self.edges.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.edges) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        copy = self._state(dict(self.edges[q]), self.length[p] + 1, self.link[q])
        self.link[q] = copy
        while p != -1 and self.edges[p].get(c) == q:
            self.edges[p][c] = copy
            p = self.link[p]
        return copy

    def _mark(self, coded) -> None:
        """Items by the state of each window; for every state, the nearest one that ends a window."""
        full: dict[int, set] = {}
        short: dict[int, list] = {}
        for key, ids in coded:
            state = 0
            for n, c in enumerate(ids, 1):
                state = self.edges[state][c]
                if n >= self.window:
                    full.setdefault(self._shrunk(state), set()).add(key)
            if len(ids) < self.window:
                short.setdefault(self._shrunk(state, len(ids)), []).append((len(ids), key))
        self.full = full
        #: state -> (length, item) of the short items that end with what the state has read
        self.short: dict[int, list] = {}
        if short:
            for state in sorted(range(len(self.link)), key=self.length.__getitem__):
                own = short.get(state, []) + (self.short.get(self.link[state], []) if state else [])
                if own:
                    self.short[state] = own

    def _shrunk(self, state: int, n: int | None = None) -> int:
        n = n or self.window
        while self.length[self.link[state]] >= n if state else False:
            state = self.link[state]
        return state

    def stream(self, ids: list[int]) -> Iterator[tuple[int, int, set]]:
        """(end, words, items): the longest window-holding match after each word, with the items of its windows."""
        state = matched = 0
        for i, c in enumerate(ids):
            while state and c not in self.edges[state]:
                state = self.link[state]
                matched = self.length[state]
            if c in self.edges[state]:
                state, matched = self.edges[state][c], matched + 1
            else:
                matched = 0
            found, reach = set(), 0
            if matched >= self.window:
                found |= self.full[self._shrunk(state)]
                reach = self.window
            for n, key in self.short.get(state, ()):
                if n <= matched:
                    found.add(key)
                    reach = max(reach, n)
            if reach:
                yield i + 1, matched, reach, found

    def stretches(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of neighbours known from items, long enough for a window."""
        known = ids >= 0
        joined = np.zeros(len(ids), bool)  # word i goes with word i + 1
        if len(ids) > 1 and len(self.pairs):
            both = np.flatnonzero(known[:-1] & known[1:])
            key = ids[both] * self.size + ids[both + 1]
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            joined[both[self.pairs[at] == key]] = True
        inner = bounds[1:-1]
        joined[inner[(inner > 0) & (inner <= len(ids))] - 1] = False
        before = np.zeros(len(ids), bool)
        before[1:] = joined[:-1]
        starts, ends = np.flatnonzero(known & ~before), np.flatnonzero(known & ~joined) + 1
        enough = ends - starts >= max(1, self.least)
        return starts[enough], ends[enough]


def find_hits(automaton: ItemAutomaton, texts: list[bytes | None]):
    """Per text: (words, merged hit spans [(start, end)], items, longest match)."""
    words = [normal_words(t) if t else [] for t in texts]
    bounds = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=bounds[1:])
    get = automaton.vocabulary.get
    ids = np.fromiter((x for w in words for x in map(get, w, repeat(-1))), np.int64, bounds[-1])
    out = [(len(w), [], set(), 0) for w in words]
    if not automaton.least:
        return out
    starts, ends = automaton.stretches(ids, bounds)
    owners = np.searchsorted(bounds, starts, "right") - 1
    for start, end, owner in zip(starts.tolist(), ends.tolist(), owners.tolist()):
        n, spans, items, longest = out[owner]
        base = start - int(bounds[owner])
        for stop, matched, reach, found in automaton.stream(ids[start:end].tolist()):
            a, b = base + stop - reach, base + stop
            while spans and spans[-1][1] >= a:
                a = min(a, spans.pop()[0])
            spans.append((a, b))
            items |= found
            longest = max(longest, matched)
        out[owner] = (n, spans, items, longest)
    return out


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list]:
    """Items as (id, words), streamed to the driver in blocks of bounded size."""
    block, size = [], 0
    rows = items.select(col(id_col).cast("string").alias("id"), col(text_col).cast("string").alias("text"))
    for row in rows.toLocalIterator():
        words = normal_words((row.text or "").encode())
        if block and size + len(words) > block_words:
            yield block
            block, size = [], 0
        if words:
            block.append((row.id, words))
            size += len(words)
    if block:
        yield block


_FOUND = "n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>, longest_match bigint"


def _found(batch: pa.RecordBatch, text: str, automaton: ItemAutomaton) -> list[tuple]:
    """(words, spans, items, longest match) of each row, with what earlier blocks found, if the batch has it."""
    texts = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows)), batch.column(text)], ["id", "text"])
    found = [x for _, block in text_blocks([texts], "id", "text", 1 << 19) for x in find_hits(automaton, block)]
    if "spans" not in batch.schema.names:
        return found
    old = zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(),
              batch.column("longest_match").to_pylist())
    return [(n, _merged(spans + [(s["start"], s["end"]) for s in o[0]]), items | set(o[1]), max(longest, o[2]))
            for (n, spans, items, longest), o in zip(found, old)]


def _scan(docs: DataFrame, block: list, text: str, window: int) -> DataFrame:
    """``docs`` with what it has found merged with what this block finds (columns of _FOUND)."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    names = [c for c in docs.columns if c not in ("n_words", "spans", "items", "longest_match")]
    schema = docs.select(*[col(c) for c in names])
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema.schema.fields] + [_FOUND])
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        automaton = ItemAutomaton(shared.value, window)
        for batch in batches:
            found = _found(batch, text, automaton)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names]
                + [pa.array([f[0] for f in found], pa.int64()),
                   pa.array([[{"start": a, "end": b} for a, b in f[1]] for f in found], span_type),
                   pa.array([sorted(i for i in f[2] if i is not None) for f in found], pa.list_(pa.string())),
                   pa.array([f[3] for f in found], pa.int64())],
                names=names + ["n_words", "spans", "items", "longest_match"])

    return docs.mapInArrow(tidied(run), fields)


def _merged(spans: list) -> list:
    out: list = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = 10,
                  block_words: int = 100_000) -> DataFrame:
    """(id, n_words, spans of hit words, items, longest_match) of every document row."""
    out = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    blocks = list(item_blocks(items, item_id, item_text, block_words)) or [[]]
    for block in blocks:
        out = _scan(out, block, "text", window)
    return out.drop("text").withColumnRenamed("id", id_col)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The per-document figures of :func:`contamination`'s spans and items."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    listed = F.array_join(F.array_sort("items"), ",")
    return found.select(col(id_col), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(listed.cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
                        "longest_match")


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars",
                  item_id: str = "item_id", item_text: str = "text", window: int = 10,
                  least_span: int = 1, max_hit_percent: int = 50, block_words: int = 100_000) -> DataFrame:
    """``docs`` without benchmark passages, with the same columns.

    Hit spans of at least ``least_span`` words are cut out of the text; a
    document of whose words more than ``max_hit_percent`` are hit is dropped.
    ``chars_col``, if there, is counted anew where text was cut.
    """
    schema, names = docs.schema, docs.columns
    arrow = to_arrow_schema(schema)
    place = names.index(text_col)
    spare = [f"c{i}" for i in range(len(names))]
    out = docs.toDF(*spare)
    *blocks, last = list(item_blocks(items, item_id, item_text, block_words)) or [[]]
    for block in blocks:
        out = _scan(out, block, spare[place], window)
    shared = docs.sparkSession.sparkContext.broadcast(last)
    chars = names.index(chars_col) if chars_col in names else None

    def run(batches):  # the last block's scan also cuts
        automaton = ItemAutomaton(shared.value, window)
        for batch in batches:
            keep, cut = [], []
            for text, (n, hits, _, _) in zip(byte_values(batch, spare[place]), _found(batch, spare[place], automaton)):
                keep.append(100 * sum(b - a for a, b in hits) <= max_hit_percent * n)
                hits = [(a, b) for a, b in hits if b - a >= least_span]
                cut.append(without(text, hits).decode("utf-8", "replace") if hits else None)
            columns = [batch.column(c) for c in spare]
            if any(c is not None for c in cut):
                old = columns[place].to_pylist()
                columns[place] = pa.array([o if c is None else c for o, c in zip(old, cut)], arrow[place].type)
                if chars is not None:
                    was = columns[chars].to_pylist()
                    columns[chars] = pa.array([o if c is None else len(c) for o, c in zip(was, cut)],
                                              arrow[chars].type)
            yield pa.RecordBatch.from_arrays(columns, schema=arrow).filter(pa.array(keep, pa.bool_()))

    return out.mapInArrow(tidied(run), schema)


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without these spans of words and what stands between their words."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:places[a][0]])
        at = places[b - 1][1]
    return b"".join(out) + text[at:]


def listed_digest(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
