"""From bucket keys to verified links to classes, for near-duplicate operators.

Items that share a bucket key are candidates.  First every member of a bucket
meets the bucket's leaders: the first members by four orders of the ids that hold
for all buckets, and the member that shares its buckets with most others, as an
original does among its copies.  The links found are closed to classes.

What then lies in buckets that still hold several classes is settled exactly.  Where
an item has tokens whose Jaccard similarity a link presupposes (its shingles), these
items go into a set index (``set_index``): its block pairs give every pair of different
classes that can reach the threshold, and none that sizes and places rule out, so large
groups of items that resemble an original but not each other cost little.  Otherwise new
leaders are elected as long as each round leaves much less apart, and at the end all
pairs of a bucket that are still in different classes are made and checked.  Either
way no candidate is left out.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lever.llm.common import text_blocks, tidied, written
from lever.llm.set_index import block_pairs, index_lists, rooted

#: Bits of the filter that says which ids may be wanted: 8 MB, whatever the input.
FILTER_BITS = 1 << 26
_BUCKET_BITS = 32768  # of one bitmap of bitmap_construct_agg


def _sized(df: DataFrame, rows: int, name: str) -> DataFrame:
    """``df``, known to have about ``rows`` rows, written in as few files as that takes."""
    return written(df.coalesce(1 + rows // 500_000), name)


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id of ``edges`` (u, v longs): the least id of its component.

    Alternates large-star and small-star steps until every edge leads to a root;
    each step groups by node with map-side sums and writes its edges.
    """
    edges = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                    .distinct(), "edges")
    rows = edges.count()
    while rows:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = _sized(large.filter("u <> v").distinct(), rows, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = _sized(small.filter("u <> v").distinct(), 2 * rows, "small-star")
        # done when every node has one parent at most, and no parent has one
        ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")) \
            .union(edges.select("v", F.lit(0), F.lit(1))).groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if ends.filter("up > 1 OR (up = 1 AND down = 1)").isEmpty():
            break
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).union(roots)


def maybe_in(df: DataFrame, column: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``df`` split in rows whose ``column`` may be among the values of ``wanted``'s only column, and rows for
    which it surely is not.  The filter is a bitmap of hashes, so its size does not grow with the input; it only
    saves shuffling the rest, an exact join has to follow.
    """
    def slot(c):
        return F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)) + 1

    bitmaps = written(wanted.select(slot(F.col(wanted.columns[0])).alias("h"))
                      .groupBy(F.bitmap_bucket_number("h").alias("_bucket"))
                      .agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("_bits")), "filter")
    marked = df.withColumn("_slot", slot(F.col(column))).withColumn("_bucket", F.bitmap_bucket_number("_slot"))
    marked = marked.join(F.broadcast(bitmaps), "_bucket", "left")  # at most 2,048 rows of 4 KB
    bit = F.bitmap_bit_position("_slot").cast("int")
    byte = F.conv(F.hex(F.col("_bits").substr((F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, bit % 8) == 1, F.lit(False))
    marked = marked.withColumn("_hit", hit)
    return (marked.filter("_hit").select(*df.columns), marked.filter("NOT _hit").select(*df.columns))


def checked(pairs: DataFrame, contents: DataFrame, similar: Callable[[bytes, bytes], bool]) -> DataFrame:
    """The pairs (u, v) whose contents (id, content) are similar."""
    left = contents.select(F.col("id").alias("u"), F.col("content").alias("a"))
    right = contents.select(F.col("id").alias("v"), F.col("content").alias("b"))
    both = pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b")

    def run(batches):
        for batch in batches:
            a, b = (batch.column(c).cast(pa.binary()).to_pylist() for c in ("a", "b"))
            keep = pa.array([similar(x, y) for x, y in zip(a, b)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(keep)

    return both.mapInArrow(tidied(run), "u bigint, v bigint")


#: Orders of ids: by the id with these bits turned, turned back afterwards; -1 is the falling order.
_LEADERS = (0, -1, 0x5555555555555555, 0x3333333333333333)
#: Pairs for each row of a bucket that are made without a further round of leaders.
_FEW = 2
_SALTED = 512  # members of a bucket that one task pairs with others


def _leader_pairs(members: DataFrame) -> DataFrame:
    """(id, other): every member with its bucket's leaders."""
    firsts = [F.min(F.col("id").bitwiseXOR(F.lit(o))).alias(f"l{i}") for i, o in enumerate(_LEADERS)]
    leaders = members.groupBy("key").agg(*firsts, F.max_by("id", "shared").alias("most"))
    met = F.array(*[F.col(f"l{i}").bitwiseXOR(F.lit(o)) for i, o in enumerate(_LEADERS)], F.col("most"))
    return members.join(leaders, "key").select("id", F.explode(F.array_distinct(met)).alias("other")).filter("id <> other")


def _open_buckets(members: DataFrame, root: DataFrame) -> DataFrame:
    """(key, id, shared, root, main, n, apart) of buckets that hold several classes: the largest one and the pairs apart."""
    held = members.join(root, "id", "left").select("key", "id", "shared", F.coalesce("root", "id").alias("root"))
    parts = held.groupBy("key", "root").agg(F.count("*").alias("c"))
    several = parts.groupBy("key").agg(F.count("*").alias("k"), F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("q"),
                                       F.max_by("root", "c").alias("main")).filter("k > 1") \
        .select("key", "n", "main", ((F.col("n") * F.col("n") - F.col("q")) / 2).cast("long").alias("apart"))
    return written(held.join(several, "key"), "open")


def _next_pairs(held: DataFrame, step: int) -> DataFrame:
    """(id, other): members with new leaders from outside the largest class, of other classes than theirs."""
    outside = F.col("root") != F.col("main")
    draw = F.when(outside, F.xxhash64("id", F.lit(step)))
    leaders = held.groupBy("key").agg(F.max_by("id", F.when(outside, F.col("shared"))).alias("a"), F.max_by("id", draw).alias("b"),
                                      F.min_by("id", draw).alias("c"), F.max_by("id", F.xxhash64("id", F.lit(-step))).alias("d"))
    leaders = leaders.select("key", F.explode(F.array_distinct(F.array("a", "b", "c", "d"))).alias("other"))
    return held.join(leaders, "key").select("id", "other").filter("id <> other")


def _all_pairs(held: DataFrame) -> DataFrame:
    """(id, other): all pairs of a bucket in different classes, once in each bucket."""
    salts = F.ceil(F.col("n") / _SALTED).cast("int")
    some = held.filter("root <> main").select("key", "id", "root", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    others = held.select("key", F.col("id").alias("other"), F.col("root").alias("other_root"),
                         F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt"), (F.col("root") == F.col("main")).alias("is_main"))
    return some.join(others, ["key", "salt"]).filter("root <> other_root AND (is_main OR id < other)").select("id", "other")


def _token_sets(texts: DataFrame, tokens: Callable[[list[bytes]], list[np.ndarray]]) -> DataFrame:
    """(node, n, tokens) of contents (id, content)."""
    def run(batches):
        for ids, block in text_blocks(batches, "id", "content", 1 << 19):
            sets = tokens(block)
            ends = np.cumsum([0] + [len(x) for x in sets], dtype=np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(np.diff(ends).astype(np.int64)),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))], names=["node", "n", "tokens"])

    return texts.mapInArrow(tidied(run), "node bigint, n bigint, tokens array<bigint>")


def _index_pairs(held: DataFrame, root: DataFrame, contents, tokens, percent: int, agree: int) -> DataFrame:
    """(id, other): pairs of different classes, among the items with ``agree`` open buckets, that can reach ``percent``."""
    ids = written(held.groupBy("id").agg(F.count("*").alias("c")).filter(F.col("c") >= agree).select("id"), "candidates")
    sets = written(_token_sets(contents(ids), tokens), "token-sets")
    entries = written(index_lists(sets, percent), "index")
    return block_pairs(rooted(entries, root), percent).select(F.col("u").alias("id"), F.col("v").alias("other"))


def classes(keyed: DataFrame, contents: Callable[[DataFrame], DataFrame],
            similar: Callable[[bytes, bytes], bool], agree: int = 1,
            tokens: Callable[[list[bytes]], list[np.ndarray]] | None = None, percent: int = 80) -> DataFrame:
    """(id, root) for the ids of ``keyed`` (id, keys: distinct longs) that have a similar partner.

    ``tokens`` gives the sorted distinct 64-bit tokens of each content; then similar
    contents must share ``percent`` of the union of theirs.

    ``contents`` gives (id, content) for a frame of ids.  Contents are compared
    of pairs that share at least ``agree`` keys; all those, but where links found
    before have joined the two.
    """
    rows = keyed.select("id", F.explode("keys").alias("key"))
    buckets = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = written(rows.join(buckets, "key"), "buckets")
    shared = members.groupBy("id").agg(F.sum("n").alias("shared"))
    members = written(members.select("key", "id").join(shared, "id"), "members")
    rows = members.count()
    root = members.limit(0).select("id", F.col("id").alias("root"))
    tested, apart, step, last = None, None, 0, False
    while True:
        if step == 0:
            pairs = _leader_pairs(members)
        else:
            held = _open_buckets(members, root)
            before = apart
            apart = held.select("key", "apart").distinct().agg(F.sum("apart")).first()[0] or 0
            if not apart:
                return root
            # another round only while each leaves much less than the one before
            last = bool(tokens) or apart <= _FEW * rows or (before is not None and apart > 0.7 * before)
            pairs = _index_pairs(held, root, contents, tokens, percent, agree) if tokens else \
                _all_pairs(held) if last else _next_pairs(held, step)
        pairs = pairs.select(F.greatest("id", "other").alias("u"), F.least("id", "other").alias("v")) \
            .groupBy("u", "v").count()
        # similar items share many buckets; what shares one with a leader meets others in the rest.  The last step
        # makes a pair in every bucket that it shares
        pairs = pairs.filter(F.col("count") >= (1 if last and tokens else agree if last else min(agree, 2))).drop("count")
        if tested is not None:
            pairs = pairs.join(tested, ["u", "v"], "left_anti")
        pairs = written(pairs, "pairs")
        tested = pairs if tested is None else tested.union(pairs)
        if agree > 1 and not last:
            left, right = (keyed.select(F.col("id").alias(c), F.col("keys").alias(f"{c}_keys")) for c in "uv")
            both = pairs.join(left, "u").join(right, "v")
            pairs = written(both.filter(F.size(F.array_intersect("u_keys", "v_keys")) >= agree).select("u", "v"), "likely")
        if not pairs.isEmpty():
            ids = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
            # the classes so far stand for the links they came from
            links = checked(pairs, written(contents(ids), "contents"), similar).union(root)
            root = written(components(links), "classes")
        if last:
            return root
        step += 1
