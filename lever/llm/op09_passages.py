"""Repeated passages across documents, by paragraph MinHash banding.

Paragraphs are lines.  A line of at least ``banded_words`` words gets a MinHash
signature over its five-word shingles, cut in bands tuned for high recall;
paragraphs that collide in a band are joined and verified by exact Jaccard
similarity of at least 0.8; classes are the components of verified links.

Of each class the document with the least id keeps its paragraphs; those elsewhere
are cut out.

In what is left, a passage of at least ``least_words`` words that stands in several
documents is found wherever it stands, in one line or over many: every
``least_words`` words in a row are a window, a window that several documents have
is kept in the one with the least id, and words in windows kept elsewhere are cut.
A word is only cut where an earlier document keeps it, as windows do not reach
into paragraphs that are cut.  To find such windows without shuffling all, each
gives the least hash of its runs of ``print_words`` words; only windows whose print
several documents have are compared.  Equal windows have equal prints, so none is missed.

Null and empty texts have no paragraphs.  Rows with the same id and text are one
document: their passages do not repeat by that alone.  Rows without an id keep
nothing that a row with one has.  Words are normalised (letters, digits, A-Z lower-cased).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lever.llm.common import byte_values, col, normal_words, text_blocks, tidied, written
from lever.llm.hashing import WordHashes, mixed, odd_factors, shingles, span_hashes
from lever.llm.linking import classes, maybe_in
from lever.llm.op08_decontaminate import without

WIDTH, THRESHOLD = 5, 0.8


@dataclass(frozen=True)
class Passages:
    banded_words: int = 20
    band_rows: int = 3
    missed: float = 5e-4  # how many pairs just at the threshold the bands may miss
    least_words: int = 50
    print_words: int = 26
    gap_words: int = 3

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.missed) / math.log(1 - THRESHOLD ** self.band_rows))


def paragraphs(texts: list[bytes | None], how: Passages):
    """Of a block of texts: (owner, start, n, h1, h2, keys) of each line of at least ``banded_words`` words; starts
    count words in the text."""
    words = WordHashes(texts)
    hashes, n = words.hashes, len(words.hashes)
    if not n:
        return None
    newline = np.flatnonzero(np.frombuffer(words.data, np.uint8) == 10)
    first = np.flatnonzero(np.diff(np.searchsorted(newline, words.starts), prepend=-1))
    starts, ends = first, np.append(first[1:], n)
    keep = ends - starts >= how.banded_words
    starts, ends = starts[keep], ends[keep]
    doc = np.searchsorted(words.bounds, starts, "right") - 1
    return (doc, starts - words.bounds[doc], ends - starts, span_hashes(hashes, starts, ends, 11),
            span_hashes(hashes, starts, ends, 23), _band_keys(hashes, starts, ends, how))


def windows(texts: list[bytes | None], cuts: list, how: Passages):
    """Of a block of texts: (owner, start, print, at, hashes) of each run of ``least_words`` words outside the text's
    ``cuts``; ``at`` counts words in the block, as ``hashes`` has them."""
    words = WordHashes(texts)
    n, bounds = len(words.hashes), words.bounds
    if n < how.least_words:
        return None
    stop = np.repeat(bounds[1:], np.diff(bounds))  # where the stretch ends that a word is in; 0 if it is cut
    for i, spans in enumerate(cuts):
        for x in spans or ():
            start, end = bounds[i] + x["start"], bounds[i] + x["end"]
            stop[bounds[i]:start] = np.minimum(stop[bounds[i]:start], start)
            stop[start:end] = 0
    at = np.flatnonzero(stop - np.arange(n) >= how.least_words)
    if not len(at):
        return None
    starts = np.arange(n - how.print_words + 1)
    prints = span_hashes(words.hashes, starts, starts + how.print_words, 31)
    least = np.lib.stride_tricks.sliding_window_view(prints, how.least_words - how.print_words + 1).min(axis=1)
    owner = np.searchsorted(bounds, at, "right") - 1
    return owner, at - bounds[owner], least[at], at, words.hashes


def _band_keys(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, how: Passages) -> np.ndarray:
    """One key a band for each span; spans do not overlap and rise."""
    if not len(starts):
        return np.zeros((0, how.bands), np.uint64)
    sizes = ends - starts
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    values, bounds = shingles(hashes[at], np.concatenate([[0], np.cumsum(sizes)]), WIDTH)
    factors = odd_factors(how.bands * how.band_rows, 41)
    mix, out = odd_factors(how.band_rows, 43), []
    for band in range(how.bands):
        key = np.full(len(starts), band, np.uint64)
        for row in range(how.band_rows):
            least = np.minimum.reduceat(values * factors[band * how.band_rows + row], bounds[:-1])
            key = mixed(key + least * mix[row])
        out.append(key)
    return np.column_stack(out)


def similar(a: bytes, b: bytes) -> bool:
    """Is the Jaccard similarity of the texts' shingles at least the threshold?"""
    x, y = ({tuple(w[i:i + WIDTH]) for i in range(max(1, len(w) - WIDTH + 1))} for w in map(normal_words, (a, b)))
    if min(len(x), len(y)) < THRESHOLD * max(len(x), len(y)):
        return False
    common = len(x & y)
    return common >= THRESHOLD * (len(x) + len(y) - common) - 1e-9


def line_tokens(lines: list[bytes | None]) -> list[np.ndarray]:
    """The sorted hashes of each line's distinct shingles."""
    words = WordHashes(lines)
    values, bounds = shingles(words.hashes, words.bounds, WIDTH)
    return [np.unique(values[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def _numbered(batches, *columns: str):
    """Blocks of texts: (place of each row in the batch, texts, values of ``columns`` in the whole batch)."""
    for batch in batches:
        values = [batch.column(c).to_pylist() for c in columns]
        numbered = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows)), batch.column("text")], ["id", "text"])
        for rows, texts in text_blocks([numbered], "id", "text", 1 << 19):
            yield rows, texts, values


def _units(source: DataFrame, how: Passages) -> DataFrame:
    """(id, tkey, start, n, h1, h2, keys) of the paragraphs of ``source`` (id, tkey, text)."""
    id_type = to_arrow_schema(source.schema).field("id").type

    def run(batches):
        for rows, texts, (ids, tkeys) in _numbered(batches, "id", "tkey"):
            found = paragraphs(texts, how)
            if found is None:
                continue
            doc, start, n, h1, h2, keys = found
            doc = doc + rows[0]
            ends = (np.arange(len(doc) + 1) * how.bands).astype(np.int32)
            key_lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[d] for d in doc.tolist()], id_type), pa.array([tkeys[d] for d in doc.tolist()], pa.int64()),
                 pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(h1.view(np.int64)),
                 pa.array(h2.view(np.int64)), key_lists],
                names=["id", "tkey", "start", "n", "h1", "h2", "keys"])

    return source.mapInArrow(tidied(run), f"id {source.schema['id'].dataType.simpleString()}, tkey bigint, start int, n int, "
                                  "h1 bigint, h2 bigint, keys array<bigint>")


def _prints(source: DataFrame, how: Passages) -> DataFrame:
    """(id, tkey, print) of the windows of ``source`` (id, tkey, text, cuts), each print once a text."""
    id_type = to_arrow_schema(source.schema).field("id").type

    def run(batches):
        for rows, texts, (ids, tkeys, cuts) in _numbered(batches, "id", "tkey", "cuts"):
            found = windows(texts, cuts[rows[0]:rows[-1] + 1], how)
            if found is None:
                continue
            owner, _, prints, _, _ = found
            order = np.lexsort((prints, owner))
            owner, prints = owner[order], prints[order]
            new = np.append(True, (owner[1:] != owner[:-1]) | (prints[1:] != prints[:-1]))
            doc = (owner[new] + rows[0]).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[d] for d in doc], id_type), pa.array([tkeys[d] for d in doc], pa.int64()),
                 pa.array(prints[new].view(np.int64))], names=["id", "tkey", "print"])

    return source.mapInArrow(tidied(run), f"id {source.schema['id'].dataType.simpleString()}, tkey bigint, print bigint")


def _windows(source: DataFrame, how: Passages) -> DataFrame:
    """(id, tkey, start, n, h1, h2) of the windows of ``source`` (id, tkey, text, cuts, prints) with one of the prints."""
    id_type = to_arrow_schema(source.schema).field("id").type

    def run(batches):
        for rows, texts, (ids, tkeys, cuts, prints) in _numbered(batches, "id", "tkey", "cuts", "prints"):
            found = windows(texts, cuts[rows[0]:rows[-1] + 1], how)
            if found is None:
                continue
            owner, start, own, at, hashes = found
            edges = np.searchsorted(owner, np.arange(len(rows) + 1))
            keep = np.concatenate([np.isin(own[a:b].view(np.int64), np.array(prints[r], np.int64))
                                   for r, a, b in zip(rows, edges[:-1].tolist(), edges[1:].tolist())])
            doc, start, at = (owner[keep] + rows[0]).tolist(), start[keep], at[keep]
            h1, h2 = (span_hashes(hashes, at, at + how.least_words, seed) for seed in (11, 23))
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[d] for d in doc], id_type), pa.array([tkeys[d] for d in doc], pa.int64()),
                 pa.array(start.astype(np.int32)), pa.array(np.full(len(doc), how.least_words, np.int32)),
                 pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))],
                names=["id", "tkey", "start", "n", "h1", "h2"])

    return source.mapInArrow(tidied(run), f"id {source.schema['id'].dataType.simpleString()}, tkey bigint, start int, n int, "
                                  "h1 bigint, h2 bigint")


def _paragraphs(source: DataFrame, how: Passages) -> DataFrame:
    """(h1, h2, content) of the banded paragraphs."""
    def run(batches):
        for _, texts in text_blocks(batches, "id", "text", 1 << 19):
            lines = [x for t in texts for x in (t or b"").split(b"\n")]
            words = WordHashes(lines)
            starts, ends = words.bounds[:-1], words.bounds[1:]
            keep = ends - starts >= how.banded_words
            starts, ends = starts[keep], ends[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(span_hashes(words.hashes, starts, ends, 11).view(np.int64)),
                 pa.array(span_hashes(words.hashes, starts, ends, 23).view(np.int64)),
                 pa.array([x for x, k in zip(lines, keep.tolist()) if k], pa.binary())],
                names=["h1", "h2", "content"])

    return source.mapInArrow(tidied(run), "h1 bigint, h2 bigint, content binary")


def _spanning(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, keep_id) of the groups of ``rows`` (id, tkey and ``by``) that several documents have."""
    # a struct's min is not map-side cheap for many rows, two plain ones are: least id, then least text of that id
    return rows.groupBy(*by).agg(F.min("id").alias("keep_id"), F.min("tkey").alias("t0"), F.max("tkey").alias("t1"),
                                 F.max("id").alias("i1")) \
        .filter("t0 <> t1 OR keep_id <> i1").select(*by, "keep_id")


def _kept(rows: DataFrame, by: list[str]) -> DataFrame:
    """(id, tkey, start, end, own, keep_id): the members of classes that several documents have; are they kept here?"""
    kept = rows.join(_spanning(rows, by), by)
    first = kept.filter(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy(*by).agg(F.min("tkey").alias("keep_tkey"))
    own = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("tkey") == F.col("keep_tkey"))
    return kept.join(first, by).select("id", "tkey", "start", (F.col("start") + F.col("n")).alias("end"),
                                       own.alias("own"), "keep_id")


def _repeated_paragraphs(source: DataFrame, how: Passages) -> DataFrame:
    """The paragraphs that are equal or similar to those of other documents, as ``_kept`` gives them."""
    banded = written(_units(source, how), "units")
    nodes = written(banded.groupBy("h1", "h2").agg(F.first("keys").alias("keys"), F.count("*").alias("copies"))
                    .withColumn("node", F.monotonically_increasing_id()), "paragraphs")

    def contents(ids: DataFrame) -> DataFrame:
        wanted = written(nodes.join(ids, nodes["node"] == ids["id"]).select("h1", "h2", "node"), "wanted")
        owners, _ = maybe_in(banded.select("h1", "h2", "tkey"), "h1", wanted.select("h1"))
        owners = owners.join(wanted, ["h1", "h2"]).groupBy("node").agg(F.min("tkey").alias("tkey"))
        texts, _ = maybe_in(source, "tkey", owners.select("tkey"))
        rows, _ = maybe_in(_paragraphs(texts, how), "h1", wanted.select("h1"))
        return rows.join(wanted, ["h1", "h2"]).groupBy("node").agg(F.first("content").alias("content")) \
            .select(F.col("node").alias("id"), "content")

    root = classes(nodes.select(F.col("node").alias("id"), "keys"), contents, similar, 1, line_tokens, round(100 * THRESHOLD))
    linked = nodes.join(root, nodes["node"] == root["id"], "left").filter("copies > 1 OR root IS NOT NULL")
    linked = written(linked.select("h1", "h2", F.coalesce("root", "node").alias("class")), "linked")
    maybe, _ = maybe_in(banded.drop("keys"), "h1", linked.select("h1"))
    members = written(maybe.join(linked, ["h1", "h2"]).select("id", "tkey", "start", "n", "class"), "members")
    return written(_kept(members, ["class"]), "repeated-paragraphs")


def _with(source: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """``source`` joined with ``found`` (id, tkey and others), of which there is one row a document."""
    found = found.withColumnRenamed("id", "_id").withColumnRenamed("tkey", "_tkey")
    on = (F.col("tkey") == F.col("_tkey")) & F.col("id").eqNullSafe(F.col("_id"))
    return source.join(found, on, how).drop("_id", "_tkey")


def _repeated_windows(source: DataFrame, lines: DataFrame, how: Passages) -> DataFrame:
    """The windows that several documents have outside the paragraphs that are cut there, as ``_kept`` gives them."""
    cuts = written(lines.filter("NOT own").groupBy("id", "tkey")
                   .agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("cuts")), "line-cuts")
    maybe, surely = maybe_in(source, "tkey", cuts.select("tkey"))
    none = F.lit(None).cast(cuts.schema["cuts"].dataType)
    left = _with(maybe, cuts, "left").unionByName(surely.withColumn("cuts", none))
    prints = written(_prints(left, how), "prints")
    several = written(_spanning(prints, ["print"]).select("print"), "repeated-prints")
    maybe, _ = maybe_in(prints, "print", several)
    marks = written(maybe.join(several, "print").groupBy("id", "tkey").agg(F.collect_set("print").alias("prints")), "marks")
    wanted, _ = maybe_in(left, "tkey", marks.select("tkey"))
    return _kept(written(_windows(_with(wanted, marks, "inner"), how), "windows"), ["h1", "h2"])


def _runs(source: DataFrame, how: Passages) -> DataFrame:
    """The paragraphs and windows that lie in repeated passages, with their ``run`` and ``own`` (kept here)."""
    lines = _repeated_paragraphs(source, how)
    rows = lines.unionByName(_repeated_windows(source, lines, how))
    rows = rows.groupBy("id", "tkey", "start", "end").agg(F.min("own").alias("own"), F.min("keep_id").alias("keep_id"))
    w = Window.partitionBy("id", "tkey").orderBy("start", "end")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)

    def fresh(before):
        return F.greatest(F.lit(0), F.col("end") - F.greatest("start", before))

    rows = rows.withColumn("before", F.coalesce(F.max("end").over(earlier), F.lit(-1 - how.gap_words))) \
        .withColumn("cut_before", F.coalesce(F.max(F.when(~F.col("own"), F.col("end"))).over(earlier), F.lit(0)))
    return rows.withColumn("fresh", fresh("before")) \
        .withColumn("cut", F.when(F.col("own"), 0).otherwise(fresh("cut_before"))) \
        .withColumn("run", F.sum((F.col("start") - F.col("before") > how.gap_words).cast("int")).over(w))


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = col(text_col).cast("string")
    return docs.select(col(id_col).alias("id"), F.xxhash64(text).alias("tkey"), text.alias("text")) \
        .filter("text IS NOT NULL")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      how: Passages = Passages()) -> DataFrame:
    """One row per repeated passage of a document: id, start and end word, words in members of classes, words to cut,
    and the least id that keeps one of its classes."""
    runs = _runs(_source(docs, id_col, text_col), how)
    return runs.groupBy("id", "tkey", "run").agg(
        F.min("start").cast("long").alias("start_word"), F.max("end").cast("long").alias("end_word"),
        F.sum("fresh").alias("n_words"), F.sum("cut").alias("cut_words"), F.min("keep_id").alias("keep_id")) \
        .select(F.col("id").alias(id_col), "start_word", "end_word", "n_words", "cut_words", "keep_id")


def without_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars",
                     how: Passages = Passages(), least_left: int = 1) -> DataFrame:
    """``docs`` with repeated passages cut where their class is not kept, same columns.

    Documents of fewer than ``least_left`` words afterwards go.  Only rows that
    may have something to cut are shuffled.  ``chars_col`` is counted anew.
    """
    cuts = _runs(_source(docs, id_col, text_col), how).filter("NOT own") \
        .groupBy("id", "tkey").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    cuts = written(cuts, "cuts")
    schema, names = docs.schema, docs.columns
    arrow = to_arrow_schema(schema)
    spare = [f"c{i}" for i in range(len(names))]
    key, place = names.index(id_col), names.index(text_col)
    chars = names.index(chars_col) if chars_col in names else None
    rows = docs.toDF(*spare).withColumn("tkey", F.xxhash64(F.col(spare[place]).cast("string")))
    maybe, surely = maybe_in(rows, "tkey", cuts.select("tkey"))
    cuts = cuts.withColumnRenamed("id", "_id").withColumnRenamed("tkey", "_tkey")
    joined = maybe.join(cuts, (F.col("tkey") == F.col("_tkey")) & F.col(spare[key]).eqNullSafe(F.col("_id")), "left")

    def run(batches):
        for batch in batches:
            texts, old = byte_values(batch, spare[place]), batch.column(spare[place]).to_pylist()
            new, keep = [], []
            for text, was, spans in zip(texts, old, batch.column("cuts").to_pylist()):
                if spans:
                    left = without(text, merged([(s["start"], s["end"]) for s in spans]))
                    keep.append(len(normal_words(left)) >= least_left)
                    new.append(left.decode("utf-8", "replace"))
                else:
                    keep.append(True)
                    new.append(was)
            columns = [batch.column(c) for c in spare]
            columns[place] = pa.array(new, arrow[place].type)
            if chars is not None:
                columns[chars] = pa.array([len(x) if s else c for x, c, s in zip(
                    new, columns[chars].to_pylist(), batch.column("cuts").to_pylist())], arrow[chars].type)
            yield pa.RecordBatch.from_arrays(columns, schema=arrow).filter(pa.array(keep, pa.bool_()))

    changed = joined.select(*spare, "cuts").mapInArrow(tidied(run), schema)
    return changed.unionByName(surely.select(*spare).toDF(*names)) if len(set(names)) == len(names) \
        else changed.union(surely.select(*spare))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
