"""Near-duplicate documents by Order MinHash.

A text's k-mers are its runs of five normalised words, each labelled with its
occurrence number, so that repeats count.  For each of several hash functions
the sketch holds the ``ell`` k-mers with the least hashes in their text order;
two texts agree in a sketch only if they share those k-mers in that order, so
agreement follows edit similarity, not just overlap.  Texts that agree in a
sketch are candidates.

Candidates are verified by banded alignment of their k-mer sequences: with a
k-mers aligned in order, texts of n and m k-mers are similar when
a / (n + m - a) is at least 0.8.  The band is as wide as that threshold allows,
so it drops no similar pair.  Classes are the components of verified links.

Equal texts collapse first, so copies cost nothing further.  Texts of few
k-mers use smaller sketches, as larger ones would miss them.  Of texts that agree in four
sketches with texts of other classes, once leaders have been compared, all pairs are
found that share enough labelled k-mers, whether or not they agree with each other.

Null texts are in no class but their own.  Empty texts equal each other.  Texts
without a normalised word are alike only when equal.  Repeated rows are copies.
Rows without an id get the class of their text, if others have it.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lever.llm.common import col, emptied_at_end, normal_words, text_blocks, tidied, written
from lever.llm.hashing import WordHashes, mixed, occurrences, odd_factors, shingles
from lever.llm.linking import classes, maybe_in

WIDTH, THRESHOLD = 5, 0.8
#: (fewest k-mers, most k-mers, sketches, k-mers in each); ranges overlap by the threshold, so that any two similar
#: texts have a family in common.  At similarity 0.8 a pair agrees nowhere with probability below 1e-4.
FAMILIES = ((1, 40, 32, 3), (32, None, 48, 6))
#: sketches that a pair has to agree in; at similarity 0.8 fewer than one pair in a thousand agrees in fewer
AGREE = 4


def sketch_keys(texts: list[bytes | None]) -> list[np.ndarray]:
    """The bucket keys of each text: one a sketch."""
    words = WordHashes(texts)
    values, bounds = shingles(words.hashes, words.bounds, WIDTH)
    labelled = mixed(values + occurrences(values, bounds) * np.uint64(0x9E3779B97F4A7C15))
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        own, keys = labelled[a:b], []
        for family, (least, most, count, ell) in enumerate(FAMILIES):
            if len(own) >= least and (most is None or len(own) <= most):
                keys.append(_sketches(own, count, min(ell, len(own)), family))
        out.append(np.concatenate(keys) if keys else np.zeros(0, np.uint64))
    return out


def _sketches(own: np.ndarray, count: int, ell: int, family: int) -> np.ndarray:
    factors = odd_factors(count, 77 + family)
    step = count if len(own) <= 50_000 else 1  # long texts: one function at a time
    picked = []
    for i in range(0, count, step):
        ranks = own[None, :] * factors[i:i + step, None]
        if ell < len(own):
            at = np.argpartition(ranks, ell - 1, axis=1)[:, :ell]
            at.sort(axis=1)
        else:
            at = np.broadcast_to(np.arange(ell), (len(ranks), ell))
        picked.append(own[at])
    order = odd_factors(ell, 5)
    return mixed((np.concatenate(picked) * order).sum(axis=1, dtype=np.uint64) + factors)


@lru_cache(maxsize=64)
def _kept(text: bytes) -> tuple[list, frozenset]:
    found = kmers(normal_words(text))
    return found, frozenset(found)


emptied_at_end(_kept.cache_clear)


def _kmers_of(text: bytes) -> tuple[list, frozenset]:
    """k-mers of a text and their set; kept for a while, within a task, if the text is short, as leaders come again and
    again: 64 texts of 16 KB are some 20 MB of k-mers."""
    return _kept(text) if len(text) < 1 << 14 else _kept.__wrapped__(text)


def labelled_kmers(texts: list[bytes | None]) -> list[np.ndarray]:
    """The sorted hashes of each text's occurrence-labelled k-mers; aligned ones are a part of the shared ones."""
    words = WordHashes(texts)
    values, bounds = shingles(words.hashes, words.bounds, WIDTH)
    labelled = mixed(values + occurrences(values, bounds) * np.uint64(0x9E3779B97F4A7C15))
    return [np.unique(labelled[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def aligned(a: list, b: list, band: int) -> int:
    """Longest common subsequence of a and b over places at most ``band`` apart, by one bit a place."""
    low, high = 0, min(len(a), len(b))
    while low < high and a[low] == b[low]:
        low += 1
    same = low
    enda, endb = len(a), len(b)
    while enda > low and endb > low and a[enda - 1] == b[endb - 1]:
        enda, endb = enda - 1, endb - 1
        same += 1
    a, b = a[low:enda], b[low:endb]
    if not a or not b:
        return same
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    window = (1 << (2 * band + 1)) - 1
    state = full
    for j, x in enumerate(b):
        mask = places.get(x)
        if mask:
            mask &= window << (j - band) if j >= band else window >> (band - j)
            hit = state & mask
            if hit:
                state = ((state + hit) | (state - hit)) & full
    return same + len(a) - state.bit_count()


def kmers(words: list[bytes], width: int = WIDTH) -> list[bytes]:
    if len(words) < width:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i:i + width]) for i in range(len(words) - width + 1)]


def similar(a: bytes, b: bytes, threshold: float = THRESHOLD) -> bool:
    """Are the texts similar by banded alignment of their k-mers?"""
    (x, xs), (y, ys) = _kmers_of(a), _kmers_of(b)
    if not x or not y:
        return a == b
    n, m = len(x), len(y)
    need = threshold * (n + m) / (1 + threshold)
    if min(n, m) < need - 1e-9:
        return False
    shared = len(xs & ys)  # k-mers of one text only cannot be aligned
    if min(n - len(xs) + shared, m - len(ys) + shared) < need - 1e-9:
        return False
    common = aligned(x, y, int(n + m - 2 * need) + 1)
    return common >= threshold * (n + m - common) - 1e-9


def duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(digest, first_id, n_rows, root, keep_id, keep_digest) of every text: its own first id, and of its class the
    node, the least id and the text that has it."""
    texts = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    texts = texts.withColumn("digest", F.unhex(F.md5("text")))

    id_type = to_arrow_schema(texts.schema).field("id").type

    def sketch(batches):
        for batch in batches:
            digests = batch.column("digest").to_pylist()
            for ids, block in text_blocks([batch], "id", "text", 1 << 19):
                keys = sketch_keys(block)
                ends = np.cumsum([0] + [len(k) for k in keys], dtype=np.int32)
                flat = np.concatenate(keys)
                own, digests = digests[:len(ids)], digests[len(ids):]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, id_type), pa.array(own, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))], names=["id", "digest", "keys"])

    kind = texts.schema["id"].dataType.simpleString()
    sketched = texts.mapInArrow(tidied(sketch), f"id {kind}, digest binary, keys array<bigint>")
    groups = written(sketched.groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("n_rows"),
                                                    F.first("keys").alias("keys"))
                     .withColumn("node", F.monotonically_increasing_id()), "texts")

    def contents(ids: DataFrame) -> DataFrame:
        wanted = written(groups.join(ids, groups["node"] == ids["id"]).select("digest", "node"), "wanted")
        rows, _ = maybe_in(texts.select("digest", "text"), "digest", wanted.select("digest"))
        return rows.join(wanted, "digest").groupBy("node").agg(F.first("text").alias("content")) \
            .select(F.col("node").alias("id"), "content")

    root = classes(groups.select(F.col("node").alias("id"), "keys"), contents, similar, AGREE, labelled_kmers, round(100 * THRESHOLD))
    groups = groups.join(root, groups["node"] == root["id"], "left") \
        .select("digest", "first_id", "n_rows", F.coalesce("root", "node").alias("root"))
    first = groups.groupBy("root").agg(F.min_by(F.struct(F.col("first_id").alias("keep_id"),
                                                         F.col("digest").alias("keep_digest")),
                                                F.struct(F.col("first_id").isNull(), "first_id", "digest")).alias("k"),
                                       F.sum("n_rows").alias("class_rows"))
    return groups.join(first.select("root", "k.*", "class_rows"), "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, copy_of, class_rows) of every row: the least id of its class, of the texts equal to its own,
    and the rows of its class."""
    found = duplicate_classes(docs, id_col, text_col) \
        .select("digest", F.col("keep_id").alias("class_id"), F.col("first_id").alias("copy_of"), "class_rows")
    rows = docs.select(col(id_col).alias("id"), F.unhex(F.md5(col(text_col).cast("string"))).alias("digest"))
    return rows.join(found, "digest", "left").select(
        F.col("id").alias(id_col), F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("copy_of")).alias("copy_of"),
        F.coalesce("class_rows", F.lit(1)).alias("class_rows"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, that with the least id; rows and columns otherwise as they were.

    Only rows that may be in a class of several rows are shuffled.
    """
    several = written(duplicate_classes(docs, id_col, text_col).filter("class_rows > 1")
                      .select("digest", "keep_id", "keep_digest"), "several")
    spare = [f"c{i}" for i in range(len(docs.columns))]
    key, text = (spare[docs.columns.index(c)] for c in (id_col, text_col))
    rows = docs.toDF(*spare).withColumn("digest", F.unhex(F.md5(F.col(text).cast("string"))))
    maybe, surely = maybe_in(rows, "digest", several.select("digest"))
    joined = maybe.join(several, "digest", "left")
    alone = joined.filter("keep_digest IS NULL")
    kept = joined.filter((F.col("digest") == F.col("keep_digest")) & F.col(key).eqNullSafe(F.col("keep_id"))) \
        .dropDuplicates(["digest"])
    return surely.select(*spare).unionByName(alone.select(*spare)).unionByName(kept.select(*spare)).toDF(*docs.columns)
