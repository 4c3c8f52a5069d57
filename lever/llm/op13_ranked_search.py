"""Ranked lexical search by Block-Max MaxScore.

Documents are read once into an index of shards.  A shard holds some thousand
documents in the order of their ids and, for each query term, its postings in
blocks of 128, packed as tightly as the block's numbers allow, with the block's
last document and its best (occurrences, length) pairs.  A posting's score rises
with the occurrences and falls with the length, so those pairs give the block's
exact maximum once the corpus's totals are known, without unpacking it.

Every shard then answers every query by Block-Max MaxScore.  Terms stand in the
order of their greatest score in the shard.  Those at the low end that together
cannot lift a document over the threshold, the score of the last place so far,
are non-essential: their lists bring in no candidates.  Documents are taken from
the essential lists in runs; then each non-essential list, from its high end,
first rejects candidates by the bound of the lists still to come and by the
maximum of the block they would stand in, and unpacks only blocks that some
candidate left needs.  As documents come in the order of their ids, a later one
of the same score never displaces an earlier one, so rejecting at equality is
exact.  The shards' heaps are merged by Spark, in two steps.

The queries come in blocks of at most about ``block_terms`` terms; the index
holds the lists those need, one pass over the documents a block.

Score of a document for a query, in whole numbers (``div`` rounds down): a term's
weight w is floor(1000 ln((2N+2)/(2df+1))); m is 75 + (25 n N) div L; the sum over
the query's terms, repeats included, of w ((10^9 tf) div (1000 tf + 12 m)).

Null and empty texts, and those without a term, are no documents of the corpus and
match nothing; such queries return nothing.  Every query row is ranked by itself,
repeated ids too; every document row is ranked, repeated rows too.  Equal scores
stand by id, nulls last.  Very long texts are read whole.  Other columns are not
read, whatever their names.  Without documents or queries the result is empty.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lever.llm.common import byte_values, col, normal_words, text_blocks, written

BLOCK = 128
#: Documents and postings of a shard, so that a task holds a bounded part of the index.
SHARD_DOCS, SHARD_POSTINGS = 1 << 14, 1 << 21
#: Documents scored at a time.
RUN = 4096
_WIDTHS = (np.uint8, np.uint16, np.uint32, np.int64)


# ------------------------------------------------------------------ postings
def _narrow(values: np.ndarray) -> tuple[int, bytes]:
    top = int(values.max(initial=0))
    code = 0 if top < 1 << 8 else 1 if top < 1 << 16 else 2 if top < 1 << 32 else 3
    return code, values.astype(_WIDTHS[code]).tobytes()


def pack_list(docs: np.ndarray, tfs: np.ndarray, lengths: np.ndarray) -> tuple[bytes, list, list, list, list, list]:
    """A term's postings: (payload, last document, end in the payload, and the pairs' tfs, lengths, ends a block)."""
    payload, last, ends, best_tf, best_n, best_ends = [], [], [], [], [], []
    size = 0
    for a in range(0, len(docs), BLOCK):
        own, tf = docs[a:a + BLOCK], tfs[a:a + BLOCK]
        gaps, occ = _narrow(np.diff(own, prepend=own[0])), _narrow(tf)
        part = bytes([gaps[0], occ[0], len(own) - 1]) + int(own[0]).to_bytes(4, "little") + gaps[1] + occ[1]
        payload.append(part)
        size += len(part)
        last.append(int(own[-1]))
        ends.append(size)
        # of equal occurrences only the shortest document counts, and a longer one only if it has more of them
        n = lengths[own]
        order = np.lexsort((n, -tf))
        short = np.minimum.accumulate(n[order])
        keep = np.flatnonzero(np.append(True, n[order][1:] < short[:-1]))
        best_tf += tf[order][keep].tolist()
        best_n += n[order][keep].tolist()
        best_ends.append(len(best_tf))
    return b"".join(payload), last, ends, best_tf, best_n, best_ends


def unpack_block(payload: bytes, start: int) -> tuple[np.ndarray, np.ndarray]:
    gap_code, tf_code, count = payload[start], payload[start + 1], payload[start + 2] + 1
    first = int.from_bytes(payload[start + 3:start + 7], "little")
    gaps = np.frombuffer(payload, _WIDTHS[gap_code], count, start + 7)
    tf = np.frombuffer(payload, _WIDTHS[tf_code], count, start + 7 + gaps.nbytes)
    return first + np.cumsum(gaps.astype(np.int64)), tf.astype(np.int64)


_LIST = pa.struct([("term", pa.int32()), ("df", pa.int64()), ("payload", pa.binary()), ("last", pa.list_(pa.int32())),
                   ("ends", pa.list_(pa.int32())), ("best_tf", pa.list_(pa.int64())), ("best_n", pa.list_(pa.int64())),
                   ("best_ends", pa.list_(pa.int32()))])
_LIST_DDL = ("array<struct<term:int,df:bigint,payload:binary,last:array<int>,ends:array<int>,best_tf:array<bigint>,"
             "best_n:array<bigint>,best_ends:array<int>>>")


def index_shards(docs: DataFrame, terms: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """(docs, terms, ids, lengths, lists), one row a shard: documents and terms in all, and the documents that hold
    one of ``terms``, which number the lists."""
    source = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    shared = source.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})
    id_type = to_arrow_schema(source.schema).field("id").type
    names = ["docs", "terms", "ids", "lengths", "lists"]

    def shard(ids, lengths, owner, term, tf, n_docs, n_terms):
        at = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0))
        place = np.empty(len(ids), np.int64)
        place[at] = np.arange(len(ids))
        lengths = np.array(lengths, np.int64)[at]
        owner = place[np.concatenate(owner)] if owner else np.zeros(0, np.int64)
        term, tf = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (term, tf))
        order = np.lexsort((owner, term))
        owner, term, tf = owner[order], term[order], tf[order]
        edges = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
        lists = []
        for a, b in zip(edges.tolist(), np.append(edges[1:], len(term)).tolist()):
            packed = pack_list(owner[a:b], tf[a:b], lengths)
            lists.append(dict(zip(("term", "df", "payload", "last", "ends", "best_tf", "best_n", "best_ends"),
                                  (int(term[a]), b - a, *packed))))
        return pa.RecordBatch.from_arrays(
            [pa.array([n_docs], pa.int64()), pa.array([n_terms], pa.int64()), pa.array([[ids[i] for i in at]], pa.list_(id_type)),
             pa.array([lengths.tolist()], pa.list_(pa.int64())), pa.array([lists], pa.list_(_LIST))], names=names)

    def run(batches):
        get, size = shared.value.get, max(1, len(shared.value))
        ids, lengths, owner, term, tf = [], [], [], [], []
        n_docs = n_terms = postings = 0
        for own, texts in text_blocks(batches, "id", "text"):
            words = [normal_words(t) for t in texts]
            counts = np.array([len(w) for w in words], np.int64)
            n_docs, n_terms = n_docs + int((counts > 0).sum()), n_terms + int(counts.sum())
            found = np.fromiter((x for w in words for x in map(get, w, repeat(-1))), np.int64, counts.sum())
            row = np.repeat(np.arange(len(texts)), counts)
            pair, times = np.unique((row * size + found)[found >= 0], return_counts=True)
            rows, inverse = np.unique(pair // size, return_inverse=True)
            owner.append(len(ids) + inverse)
            term.append(pair % size)
            tf.append(times.astype(np.int64))
            ids += [own[r] for r in rows.tolist()]
            lengths += counts[rows].tolist()
            postings += len(pair)
            if len(ids) >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                yield shard(ids, lengths, owner, term, tf, n_docs, n_terms)
                ids, lengths, owner, term, tf = [], [], [], [], []
                n_docs = n_terms = postings = 0
        if n_docs:
            yield shard(ids, lengths, owner, term, tf, n_docs, n_terms)

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"docs bigint, terms bigint, ids array<{kind}>, lengths array<bigint>, lists {_LIST_DDL}")


# ------------------------------------------------------------------ ranking
def part_score(tf, m):
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class PostingList:
    """A term's list in one shard: block maxima at once, postings when a block is unpacked."""

    def __init__(self, packed: dict, m: np.ndarray, m_of: dict[int, int]):
        self.payload, self.m = packed["payload"], m
        self.last = np.array(packed["last"], np.int64)
        self.starts = [0, *packed["ends"][:-1]]
        best = part_score(np.array(packed["best_tf"], np.int64), np.array([m_of[n] for n in packed["best_n"]], np.int64))
        self.maxima = np.maximum.reduceat(best, np.append(0, packed["best_ends"][:-1]).astype(np.int64))
        self.top = int(self.maxima.max())
        self.docs = np.empty(packed["df"], np.int64)
        self.scores = np.empty(packed["df"], np.int64)
        self.ready = np.zeros(len(self.last), bool)

    def unpack(self, blocks) -> None:
        for b in blocks:
            if not self.ready[b]:
                docs, tf = unpack_block(self.payload, self.starts[b])
                a = b * BLOCK
                self.docs[a:a + len(docs)] = docs
                self.scores[a:a + len(docs)] = part_score(tf, self.m[docs])
                self.ready[b] = True

    def between(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents low..high-1 and their scores."""
        a, b = np.searchsorted(self.last, [low, high - 1])
        b = min(b + 1, len(self.last))
        self.unpack(range(a, b))
        docs = self.docs[a * BLOCK:b * BLOCK]
        x, y = np.searchsorted(docs, [low, high])
        return docs[x:y], self.scores[a * BLOCK:b * BLOCK][x:y]

    def lookup(self, docs: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Scores of these documents, each in the block where it would stand."""
        wanted = np.unique(blocks).tolist()
        self.unpack(wanted)
        own = np.concatenate([self.docs[b * BLOCK:(b + 1) * BLOCK] for b in wanted])
        scores = np.concatenate([self.scores[b * BLOCK:(b + 1) * BLOCK] for b in wanted])
        at = np.minimum(np.searchsorted(own, docs), len(own) - 1)
        return np.where(own[at] == docs, scores[at], 0)


def best_of_shard(lists: dict[int, PostingList], n_docs: int, query: list[tuple[int, int]], k: int,
                  run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the ``k`` best, by score and document; ``query`` has (term, weight)."""
    own = sorted(((w * lists[t].top, t, w) for t, w in query if t in lists and w > 0 and lists[t].top > 0))
    reach = np.concatenate([[0], np.cumsum([b for b, _, _ in own])]).astype(np.int64)  # of the first terms together
    docs, scores, threshold = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for low in range(0, n_docs, run):
        high = min(low + run, n_docs)
        first = int(np.searchsorted(reach, threshold, "right")) - 1  # so many terms are non-essential
        if first >= len(own):
            break
        total = np.zeros(high - low, np.int64)
        for _, t, w in own[first:]:
            at, score = lists[t].between(low, high)
            total[at - low] += w * score
        found = np.flatnonzero(total)
        score = total[found]
        found = found + low
        for i in range(first - 1, -1, -1):
            _, t, w = own[i]
            keep = score + reach[i + 1] > threshold
            found, score = found[keep], score[keep]
            block = np.searchsorted(lists[t].last, found)
            inside = block < len(lists[t].last)
            bound = np.where(inside, w * lists[t].maxima[np.minimum(block, len(lists[t].last) - 1)], 0)
            keep = score + bound + reach[i] > threshold
            found, score, block, inside = found[keep], score[keep], block[keep], inside[keep]
            if inside.any():
                score[inside] += w * lists[t].lookup(found[inside], block[inside])
        keep = score > threshold
        docs, scores = np.concatenate([docs, found[keep]]), np.concatenate([scores, score[keep]])
        order = np.lexsort((docs, -scores))[:k]
        docs, scores = docs[order], scores[order]
        if len(docs) == k:
            threshold = int(scores[-1])
    return docs, scores


def _ranked(index: DataFrame, queries: dict[int, list[tuple[int, int]]], n_corpus: int, all_terms: int, k: int) -> DataFrame:
    """(query, id, score): the best of each shard."""
    shared = index.sparkSession.sparkContext.broadcast(queries)
    kind = index.schema["ids"].dataType.elementType.simpleString()
    id_type = to_arrow_schema(index.schema).field("ids").type.value_type

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                ids = batch.column("ids")[r].as_py()
                lengths = batch.column("lengths")[r].as_py()
                m_of = {n: 75 + 25 * n * n_corpus // all_terms for n in set(lengths)}
                m = np.array([m_of[n] for n in lengths], np.int64)
                lists = {x["term"]: PostingList(x, m, m_of) for x in batch.column("lists")[r].as_py()}
                owner, found, score = [], [], []
                for key, query in shared.value.items():
                    docs, scores = best_of_shard(lists, len(ids), query, k)
                    owner += [key] * len(docs)
                    found += [ids[d] for d in docs.tolist()]
                    score += scores.tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(owner, pa.int64()), pa.array(found, id_type), pa.array(score, pa.int64())],
                    names=["query", "id", "score"])

    return index.select("ids", "lengths", "lists").mapInArrow(run, f"query bigint, id {kind}, score bigint")


def _top(rows: DataFrame, by: list, k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def weights(query: list[tuple[int, int]], df: dict[int, int], n_corpus: int) -> list[tuple[int, int]]:
    """(term, weight times repeats) of a query's terms that the corpus has."""
    return [(t, c * math.floor(1000 * math.log((2 * n_corpus + 2) / (2 * df[t] + 1)))) for t, c in query if t in df]


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text",
                  query_id: str = "item_id", query_text: str = "text", block_terms: int = 100_000) -> DataFrame:
    """(query id, rank, id, score): the ``k`` best documents of each query with a score above 0."""
    spark = docs.sparkSession
    asked = queries.select(F.monotonically_increasing_id().alias("query"), col(query_id).alias("_query_id"),
                           col(query_text).cast("string").alias("text"))

    def counted(batches):
        for batch in batches:
            found = [Counter(normal_words(t)) if t else {} for t in byte_values(batch, "text")]
            terms = pa.array([[{"term": t, "count": c} for t, c in f.items()] for f in found],
                             pa.list_(pa.struct([("term", pa.binary()), ("count", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("_query_id"), terms],
                                             names=["query", "_query_id", "terms"])

    kind = asked.schema["_query_id"].dataType.simpleString()
    asked = written(asked.mapInArrow(counted, f"query bigint, _query_id {kind}, terms array<struct<term:binary,count:bigint>>"),
                    "queries")
    asked = asked.filter("size(terms) > 0")
    size = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = -(-size // block_terms)
    found = None
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).select("query", "terms").collect()
        terms = sorted({bytes(x["term"]) for r in rows for x in r["terms"]})
        number = {t: i for i, t in enumerate(terms)}
        index = written(index_shards(docs, terms, id_col, text_col), "lexical-index")
        n_corpus, all_terms = index.agg(F.sum("docs"), F.sum("terms")).first()
        if not all_terms:
            continue
        df = dict(index.select(F.explode("lists").alias("x")).groupBy("x.term").agg(F.sum("x.df")).collect())
        coded = {r["query"]: weights([(number[bytes(x["term"])], x["count"]) for x in r["terms"]], df, n_corpus) for r in rows}
        best = _ranked(index, coded, n_corpus, all_terms, k)
        found = best if found is None else found.unionByName(best)
    if found is None:
        kind = docs.select(col(id_col)).schema[0].dataType.simpleString()
        found = spark.createDataFrame([], f"query bigint, id {kind}, score bigint")
    salted = found.withColumn("salt", F.spark_partition_id() % 64)
    merged = _top(_top(salted, ["query", "salt"], k).drop("rank"), ["query"], k)
    return merged.join(asked.select("query", "_query_id"), "query") \
        .select(F.col("_query_id").alias(query_id), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
