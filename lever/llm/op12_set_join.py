"""Exact n-gram Jaccard join with set-relation skipping.

A document's set holds the hashes of its distinct four-word shingles.  Two sets link
when 100 |x and y| >= 85 |x or y|.  Classes are the components of the links.

1. *Prefixes.*  x's prefix is its first |x| - need(x) + asked(x) hashes, where need(x) =
   ceil(0.85 |x|) and asked(x) = 12 + |x| div 16; that is over a fifth of its shingles.  Of
   the hashes that x and y share, the first k = min(asked(x), asked(y)) lie in both
   prefixes if the two link, and as y then has need(x) shingles or more, k is at least
   asked(need(x)).  Only sets with so many hashes that other prefixes have go on.
2. *Index.*  Among those, shingles are ordered by how many sets hold them, rare ones
   first.  x puts the shingles of its first |x| - need(x) + 1 places into the index,
   with its size and the place; those that no other set has need no entry, they only
   push the others back.  A list is cut in blocks of equal size and place.  For the
   first shingle that x and y share, at places i and j, at most min(|x| - i, |y| - j)
   can be shared; block pairs whose sizes and places cannot reach the threshold are
   skipped whole, before any member is looked at.
3. *Relations.*  Each member of a list first meets the list's leaders, those with the
   earliest place, as an original has among its copies.  Members that link with a
   leader join its class, and what the rounds of leaders put into one class is never
   compared again: block pairs within a list's main class are skipped as well.
   A member that is highly similar to its leader remembers it, with the shingles
   that only one of the two has.
4. *Answers.*  The pairs of different classes that are left are answered by
   derivation: all members related to one leader are grouped, the leader's overlap
   with the other set is computed once, and each member's follows from the few
   shingles in which it differs.  So every link between different classes is found.

Equal texts collapse first, so copies cost nothing further.

Words lie between ASCII white space, A-Z lower-cased.  With fewer than four words the
whole sequence is one shingle.  Null texts and those without words have empty sets and
are linked with nothing, not with each other either; their component is their own id.
Repeated rows and ties are copies.  Rows without an id get the component of their
text, and none gives its null to others unless all ids are null.  Texts are read
whole, however long.  Empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lever.llm.common import col, text_blocks, tidied, written
from lever.llm.hashing import SPACED, WordHashes, shingles
from lever.llm.linking import components, maybe_in
from lever.llm.set_index import block_pairs, index_lists, leader_pairs, needed, rooted

WIDTH = 4
#: Percent of the union that linked sets share, and that a set shares with the leader it is derived from.
LINKED, RELATED = 85, 90
#: Prefix shingles that linked sets must share to go on: so many, and one for each ``EACH`` shingles.
SHARED, EACH = 12, 16
#: Members whose answers are derived together.
GROUP = 64
#: Rounds of leaders.
ROUNDS = 3


# ------------------------------------------------------------------ sets
def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = WordHashes(texts, SPACED)
    values, bounds = shingles(words.hashes, words.bounds, WIDTH)
    return [np.unique(values[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def need(n):
    """Shingles that a set of ``n`` must share with any set it links with."""
    return -(-LINKED * n // 100)


def asked(n):
    return SHARED + n // EACH


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0] + [len(a) for a in arrays], dtype=np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _prefixes(texts: DataFrame) -> DataFrame:
    """(id, digest, n, prefix) of every text (id, digest, text)."""
    id_type = to_arrow_schema(texts.schema).field("id").type

    def run(batches):
        for batch in batches:
            digests = batch.column("digest").to_pylist()
            for ids, block in text_blocks([batch], "id", "text", 1 << 19):
                sets = shingle_sets(block)
                own, digests = digests[:len(ids)], digests[len(ids):]
                heads = [s[:len(s) - need(len(s)) + asked(len(s))] for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, id_type), pa.array(own, pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                     _lists(heads)], names=["id", "digest", "n", "prefix"])

    return texts.mapInArrow(tidied(run), f"id {texts.schema['id'].dataType.simpleString()}, digest binary, n bigint, prefix array<bigint>")


def _whole_sets(texts: DataFrame) -> DataFrame:
    """(node, n, tokens) of texts (node, text)."""
    def run(batches):
        for nodes, block in text_blocks(batches, "node", "text", 1 << 19):
            sets = shingle_sets(block)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), _lists(sets)],
                                             names=["node", "n", "tokens"])

    return texts.mapInArrow(tidied(run), "node bigint, n bigint, tokens array<bigint>")


def _candidates(nodes: DataFrame) -> DataFrame:
    """The ``nodes`` with enough prefix shingles that other prefixes have."""
    rows = nodes.select("node", F.explode("prefix").alias("token"))
    several = written(rows.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1").select("token"), "shared-tokens")
    maybe, _ = maybe_in(rows, "token", several)
    shared = maybe.join(several, "token").groupBy("node").agg(F.count("*").alias("c"))
    least = needed(F.col("n"), LINKED)
    return nodes.drop("prefix").join(shared, "node").filter(F.col("c") >= F.least(least, SHARED + F.floor(least / EACH)))


# ------------------------------------------------------------------ answers
_DIFF = "minus array<bigint>, plus array<bigint>"


def linked(common: int, n: int, m: int, percent: int = LINKED) -> bool:
    return 100 * common >= percent * (n + m - common)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the sorted ``a`` are in the sorted ``b``?"""
    if not len(b):
        return np.zeros(len(a), bool)
    return b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a


def _grouped(pairs: DataFrame, related: DataFrame | None) -> DataFrame:
    """(anchor, v, members): pairs by the set they are derived from, in bounded groups."""
    if related is None:
        known = pairs.select("u", "v", F.col("u").alias("anchor"), F.lit(None).cast("array<bigint>").alias("minus"),
                             F.lit(None).cast("array<bigint>").alias("plus"))
    else:
        left = related.select(F.col("node").alias("u"), "leader", "minus", "plus")
        right = related.select(F.col("node").alias("v"), F.col("leader").alias("leader2"), F.col("minus").alias("minus2"),
                               F.col("plus").alias("plus2"))
        both = pairs.join(left, "u", "left").join(right, "v", "left")
        turn = F.col("leader").isNull() & F.col("leader2").isNotNull()
        known = both.select(F.when(turn, F.col("v")).otherwise(F.col("u")).alias("u"),
                            F.when(turn, F.col("u")).otherwise(F.col("v")).alias("v"),
                            F.coalesce("leader", "leader2", "u").alias("anchor"),
                            F.when(turn, F.col("minus2")).otherwise(F.col("minus")).alias("minus"),
                            F.when(turn, F.col("plus2")).otherwise(F.col("plus")).alias("plus"))
    known = written(known, "derivable")
    sizes = known.groupBy("anchor", "v").agg(F.count("*").alias("c"))
    part = F.pmod(F.xxhash64("u"), F.ceil(F.col("c") / GROUP)).alias("part")
    return known.join(sizes, ["anchor", "v"]).groupBy("anchor", "v", part) \
        .agg(F.collect_list(F.struct("u", "minus", "plus")).alias("members")).drop("part")


def answers(pairs: DataFrame, sets: DataFrame, related: DataFrame | None = None) -> DataFrame:
    """(u, v, common, minus, plus) of the pairs that link.

    Members of ``related`` (node, leader, minus, plus) are answered from their leader's
    overlap with v: less what v shares with ``minus``, which only the leader has, more
    what it shares with ``plus``, which only the member has.  For a member answered by
    itself that is highly similar to v, minus and plus tell it from v.
    """
    whole = sets.select("node", "tokens")
    rows = _grouped(pairs, related) \
        .join(whole.select(F.col("node").alias("anchor"), F.col("tokens").alias("a")), "anchor") \
        .join(whole.select(F.col("node").alias("v"), F.col("tokens").alias("b")), "v").select("v", "members", "a", "b")

    def values(scalar) -> np.ndarray:
        return scalar.values.to_numpy().view(np.uint64) if scalar.is_valid else np.zeros(0, np.uint64)

    def run(batches):
        for batch in batches:
            out = []
            for v, members, a, b in zip(*(batch.column(c) for c in ("v", "members", "a", "b"))):
                a, b, v = values(a), values(b), v.as_py()
                shared = _common(a, b)
                for x in members.values:
                    minus, plus = values(x["minus"]), values(x["plus"])
                    common = int(shared.sum()) - int(_common(minus, b).sum()) + int(_common(plus, b).sum())
                    n = len(a) - len(minus) + len(plus)
                    if linked(common, n, len(b)):
                        near = not x["minus"].is_valid and linked(common, n, len(b), RELATED)
                        out.append((x["u"].as_py(), v, common, b[~_common(b, a)].view(np.int64).tolist() if near else None,
                                    a[~shared].view(np.int64).tolist() if near else None))
            columns = list(zip(*out)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                             names=["u", "v", "common", "minus", "plus"])

    return rows.mapInArrow(tidied(run), f"u bigint, v bigint, common bigint, {_DIFF}")


def _relations(links: DataFrame) -> DataFrame:
    """(node, leader, minus, plus): of each highly similar u the leader that most others have."""
    near = links.filter("minus IS NOT NULL")
    hubs = near.groupBy("v").agg(F.count("*").alias("followers"))
    return near.join(hubs, "v").groupBy(F.col("u").alias("node")) \
        .agg(F.max_by(F.struct(F.col("v").alias("leader"), "minus", "plus"), F.struct("followers", "common", "v")).alias("x")) \
        .select("node", "x.*")


def set_links(sets: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """Of ``sets`` (node, n, tokens): links (u, v) enough to join every class, and (id, root) of the sets that have one."""
    entries = written(index_lists(sets, LINKED), "index")
    links = tested = roots = related = None
    for step in range(ROUNDS + 1):
        held = rooted(entries, roots)
        pairs = leader_pairs(held, LINKED) if step < ROUNDS else block_pairs(held, LINKED)
        if tested is not None:
            pairs = pairs.join(tested, ["u", "v"], "left_anti")
        pairs = written(pairs, "pairs")
        if pairs.isEmpty():
            continue
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = written(answers(pairs, sets, related), "links")
        if found.isEmpty():
            continue
        edges = found.select("u", "v")
        links = edges if links is None else links.unionByName(edges)
        if step < ROUNDS:
            near = _relations(found)
            if related is not None:  # a member keeps its first leader
                near = related.unionByName(near.join(related, "node", "left_anti"))
            related = written(near, "related")
        roots = written(components(edges if roots is None else edges.unionByName(
            roots.select(F.col("id").alias("u"), F.col("root").alias("v")))), "classes")
    return links, roots


# ------------------------------------------------------------------ documents
def linked_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every document row: its set's size and the least id that links reach."""
    texts = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text")) \
        .withColumn("digest", F.unhex(F.md5("text"))).filter("text IS NOT NULL")
    nodes = written(_prefixes(texts.select("id", "digest", "text")).filter("n > 0").groupBy("digest")
                    .agg(F.min("id").alias("first_id"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
                    .withColumn("node", F.monotonically_increasing_id()), "nodes")
    place = F.xxhash64("first_id", "digest").alias("place")
    some = written(_candidates(nodes).select("node", "first_id", F.col("digest").alias("own"), place), "candidates")
    maybe, _ = maybe_in(texts.withColumn("place", F.xxhash64("id", "digest")), "place", some.select("place"))
    found = maybe.join(some, "place").filter((F.col("digest") == F.col("own")) & F.col("id").eqNullSafe(F.col("first_id"))) \
        .groupBy("place", "node").agg(F.first("text").alias("text"))
    sets = written(_whole_sets(found.select("node", "text")), "sets")
    _, roots = set_links(sets)
    owned = nodes.select("digest", "n", "first_id", "node")
    if roots is not None:
        several = owned.join(roots, owned["node"] == roots["id"], "left").withColumn("root", F.coalesce("root", "node"))
        least = several.groupBy("root").agg(F.min("first_id").alias("least"))
        owned = several.join(least, "root").select("digest", "n", "least")
    else:
        owned = owned.select("digest", "n", F.col("first_id").alias("least"))
    rows = docs.select(col(id_col).alias("id"), F.unhex(F.md5(col(text_col).cast("string"))).alias("digest"))
    return rows.join(written(owned, "components"), "digest", "left").select(
        F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"),
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))
