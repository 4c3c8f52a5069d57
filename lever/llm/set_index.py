"""An index of sets for exact Jaccard joins: shingles in the order of how many sets hold them.

A set's entries are the shingles in its first |x| - need + 1 places that other sets have
too, need being ``percent`` of |x|, with its size and the place.  A list is cut in blocks
of equal size and place; block pairs that cannot reach the threshold are skipped whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Members of an index block, about.
BLOCK = 256


def needed(n: Column, percent: int) -> Column:
    """Shingles that a set of ``n`` must share with any set it links with."""
    return F.ceil(n * percent / 100)


def index_lists(sets: DataFrame, percent: int) -> DataFrame:
    """(token, node, n, place): the shingles in a set's first |x| - need(x) + 1 places that other sets have too."""
    rows = sets.select("node", F.explode("tokens").alias("token"))
    held = rows.groupBy("token").agg(F.count("*").alias("held")).filter("held > 1")
    own = rows.join(held, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("held", "token"))).alias("own"))
    own = own.join(sets.select("node", "n"), "node")
    alone = F.col("n") - F.size("own")  # these come first
    room = F.col("n") - needed(F.col("n"), percent) + 1 - alone
    return own.select("node", "n", alone.alias("alone"), F.posexplode(F.slice("own", 1, F.greatest(room, F.lit(0)).cast("int")))) \
        .select("col.token", "node", "n", (F.col("alone") + F.col("pos")).alias("place"))


def _reachable(n, place, other_n, other_place, percent: int) -> Column:
    """Can sets whose first common shingle stands at these places link?"""
    most = F.least(F.col(n) - F.col(place), F.col(other_n) - F.col(other_place))
    return (100 + percent) * most >= percent * (F.col(n) + F.col(other_n))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def leader_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """(u, v): members of lists with the list's earliest member, and with the earliest outside its main class."""
    classes = entries.groupBy("token", "root").agg(F.count("*").alias("c"))
    main = classes.groupBy("token").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("classes")) \
        .filter("classes > 1")
    held = entries.join(main, "token")
    at = F.struct("place", "node")
    who = F.struct(F.col("node").alias("leader"), F.col("n").alias("leader_n"), F.col("place").alias("leader_place"),
                   F.col("root").alias("leader_root"))
    out = F.col("root") != F.col("main")
    leaders = held.groupBy("token").agg(F.min_by(who, at).alias("a"), F.min_by(who, F.when(out, at)).alias("b"),
                                        F.max_by(who, F.when(out, F.xxhash64("node"))).alias("c"))
    leaders = leaders.select("token", F.inline(F.array_distinct(F.array("a", "b", "c"))))
    met = held.join(leaders, "token").filter((F.col("root") != F.col("leader_root"))
                                             & _reachable("n", "place", "leader_n", "leader_place", percent))
    return _ordered(met.select(F.col("node").alias("u"), F.col("leader").alias("v")))


def block_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """(u, v): all pairs of different classes in block pairs of a list that cannot be skipped."""
    classes = entries.groupBy("token", "root").agg(F.count("*").alias("c"))
    lists = classes.groupBy("token").agg(F.sum("c").alias("entries"), F.count("*").alias("classes"),
                                         F.max_by("root", F.struct("c", "root")).alias("main")).filter("classes > 1")
    held = entries.join(lists, "token") \
        .withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("entries") / BLOCK)).cast("int")) \
        .withColumn("is_main", F.col("root") == F.col("main"))
    blocks = held.groupBy("token", "n", "place", "part", "is_main").agg(F.collect_list(F.struct("node", "root")).alias("members"))
    name = F.struct("n", "place", "part", "is_main")
    a = blocks.select("token", "n", "place", "is_main", "members", name.alias("name"))
    b = blocks.select("token", F.col("n").alias("n2"), F.col("place").alias("place2"), F.col("is_main").alias("main2"),
                      F.col("members").alias("members2"), name.alias("name2"))
    both = a.join(b, "token").filter((F.col("name") <= F.col("name2")) & ~(F.col("is_main") & F.col("main2"))
                                     & _reachable("n", "place", "n2", "place2", percent))
    same = F.col("name") == F.col("name2")
    pairs = F.flatten(F.transform("members", lambda x: F.transform(
        F.filter("members2", lambda y: (x["root"] != y["root"]) & (~same | (x["node"] < y["node"]))),
        lambda y: F.struct(x["node"].alias("u"), y["node"].alias("v")))))
    return _ordered(both.select(F.inline(pairs)))


def rooted(entries: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return entries.withColumn("root", F.col("node"))
    renamed = roots.select(F.col("id").alias("node"), "root")
    return entries.join(renamed, "node", "left").withColumn("root", F.coalesce("root", "node"))
