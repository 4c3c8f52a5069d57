"""Random forests for every key and fold at once (M8, and the forest in M3 and E2).

A row's part in a tree is decided by a hash of the row, of the seed and of the tree
(Poisson bootstrap), so nothing about a forest depends on how rows are spread.

1. One aggregate per key gives its row count, the target's range and each feature's
   cuts (at most ``bins`` - 1 values, all distinct ones if they are few).
2. Rows are packed, per key, into parts of about ``part_rows`` rows: binned features
   (a byte each), target, fold and hash, in one cell a part.
3. Parts meet groves of ``task_trees`` trees of a fold.  The trees of fold f skip the
   rows of fold f.
4. Where only shares or errors are wanted, a key of one part is grown, weighed and scored
   where its rows are, by the Java function of ``functions/Forest.java``: all folds in one
   task if there are many keys and this one is small, else a fold a task.  Its trees go no
   further.  Where the trees are wanted, NumPy grows them, all groves of a small key in one
   task, else a grove a task.  The parts of a larger key give each level's histograms,
   which are summed per grove before the level's splits are chosen, one job a level.  Sums
   are exact integers, so all ways give the same trees.
5. Scoring joins parts with their key's groves, a row a fold, and runs every held-out
   row through its fold's trees in one pass.

The number of jobs depends on the depth only; no key, fold or tree has a job or a
loop of its own.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from lever.functions import jvm
from lever.functions.columns import join_on
from lever.functions.sizing import join_per_key
from lever.functions.store import written
from lever.functions.trees import POISSON, TARGET_BITS, Grove, as_integers, bootstrap, from_integers, grown, pairs

EPS = float(np.finfo(np.float64).eps)
#: Rows times trees of a task, and of one that grows them in Java; rows of a block that Java takes (18 bits of weight).
_VISITS, _VISITS_JAVA, _ROWS_JAVA = 10_000_000, 100_000_000, 200_000


@dataclass(frozen=True)
class Forest:
    trees: int = 50
    max_depth: int = 8
    #: histogram bins of a feature, 256 at most; values beyond as many cuts share one
    bins: int = 64
    seed: int = 7
    #: False: every row once in every tree
    bootstrap: bool = True
    #: rows of a key that one task holds, and trees that it grows on them
    part_rows: int = 200_000
    task_trees: int = 10


def _q(name):
    return F.col("`" + name.replace("`", "``") + "`")


def _keyed(df: DataFrame, keys) -> list:
    return [df.schema[k] for k in keys]


def _bounds(data: DataFrame, keys, variables, target: str, how: Forest) -> DataFrame:
    """Per key: _parts, _low, _high of the target, and _cuts, an array for each feature."""
    many = 4 * how.bins  # tries to see all values of a feature that has few
    aggs = [F.ceil(F.count(F.lit(1)) / how.part_rows).cast("int").alias("_parts"),
            F.min(_q(target).cast("double")).alias("_low"), F.max(_q(target).cast("double")).alias("_high")]
    aggs += [F.percentile_approx(_q(v).cast("double"), [i / many for i in range(many + 1)], 40 * many).alias(f"_p{j}")
             for j, v in enumerate(variables)]
    found = data.groupBy(*[_q(k) for k in keys]).agg(*aggs)
    cuts = []
    for j in range(len(variables)):
        p = F.coalesce(F.col(f"_p{j}"), F.array().cast("array<double>"))
        thin = F.array_distinct(F.filter(p, lambda x, i: i % 4 == 0))
        every = F.array_distinct(p)
        cuts.append(F.slice(F.when(F.size(every) <= how.bins, every).otherwise(thin), 1, how.bins))
    return found.select(*[_q(k) for k in keys], "_parts", "_low", "_high", F.array(*cuts).alias("_cuts"))


_BLOCK = [StructField("_part", IntegerType()), StructField("_parts", IntegerType()), StructField("_low", DoubleType()),
          StructField("_high", DoubleType()), StructField("_cuts", ArrayType(ArrayType(DoubleType()))),
          StructField("_n", LongType())] + [StructField(c, BinaryType()) for c in ("_bins", "_y", "_fold", "_draw")]
_GROVE = [StructField("fold", IntegerType()), StructField("grove", IntegerType())] + \
    [StructField(c, ArrayType(DoubleType() if c in ("value", "gain") else IntegerType())) for c in Grove.FIELDS]


def forest_blocks(data: DataFrame, keys, variables, target: str, draw_cols, fold_col: str = "fold",
                  how: Forest = Forest()) -> DataFrame:
    """One row per (keys, part) with the part's packed rows (binned features, target, fold, hash)."""
    keys, variables = list(keys), list(variables)
    if how.bins > 256 or not variables:
        raise ValueError("a forest takes 1 feature or more and 256 bins at most")
    draws = F.xxhash64(*[_q(c) for c in draw_cols])
    rows = data.select(*[_q(k) for k in keys], _q(fold_col).cast("int").alias("_f"), draws.alias("_d"),
                       _q(target).cast("double").alias("_t"), *[_q(v).cast("double").alias(f"_x{j}") for j, v in enumerate(variables)]) \
        .where("_t IS NOT NULL")
    bounds = written(_bounds(data.where(_q(target).isNotNull()), keys, variables, target, how), "forest-bounds")
    parts = bounds.select(*[_q(k).alias(k) for k in keys], F.col("_parts").alias("_deal"))
    rows = join_per_key(rows, parts, keys).withColumn("_part", F.pmod(F.xxhash64("_d", F.lit(how.seed)), F.col("_deal")).cast("int"))
    each = bounds.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    schema = StructType(_keyed(data, keys) + _BLOCK)
    arrow = to_arrow_schema(schema)
    p = len(variables)

    def pack(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return arrow.empty_table()
        one = right.slice(0, 1).to_pylist()[0]
        y = as_integers(left.column(at["_t"]).to_numpy(), one["_low"], one["_high"])
        bins = np.zeros((p, left.num_rows), np.uint8)
        for j, cuts in enumerate(one["_cuts"]):
            x = left.column(at[f"_x{j}"]).to_numpy(zero_copy_only=False).astype(float)
            bins[j] = np.minimum(np.searchsorted(np.array(cuts, float), x, "left"), how.bins - 1)
        packed = one | {"_n": left.num_rows, "_bins": bins.tobytes(), "_y": y.astype(np.int32).tobytes(),
                        "_fold": left.column(at["_f"]).to_numpy().astype(np.int32).tobytes(),
                        "_draw": left.column(at["_d"]).to_numpy().astype(np.int64).tobytes()}
        return pa.Table.from_pylist([{f.name: packed[f.name] for f in arrow}], arrow)

    by = [*keys, "_part"]
    rows = rows.drop("_deal").toDF(*[f"_r{i}" for i in range(len(rows.columns) - 1)])  # both sides stem from the bounds
    at = {c: f"_r{i}" for i, c in enumerate([*keys, "_f", "_d", "_t", *[f"_x{j}" for j in range(p)], "_part"])}
    blocks = rows.groupBy(*[at[c] for c in by]).cogroup(each.groupBy(*[_q(c) for c in by])).applyInArrow(pack, schema)
    return written(blocks, "forest-blocks")


class _Part:
    """A block's rows, unpacked."""

    def __init__(self, row: dict):
        self.n = row["_n"]
        self.bins = np.frombuffer(row["_bins"], np.uint8).reshape(-1, self.n)
        self.y = np.frombuffer(row["_y"], np.int32).astype(float)
        self.fold = np.frombuffer(row["_fold"], np.int32)
        self.draw = np.frombuffer(row["_draw"], np.int64)

    def weights(self, fold: int, grove: int, how: Forest) -> np.ndarray:
        """(trees, rows): how often each tree of the grove draws each row."""
        first = fold * how.trees + grove * how.task_trees
        out = np.zeros((min(how.task_trees, how.trees - grove * how.task_trees), self.n))
        inside = self.fold != fold
        for i in range(len(out)):
            out[i, inside] = bootstrap(self.draw[inside], how.seed, first + i) if how.bootstrap else 1.0
        return out


def _batch(own: dict, grove: Grove | None, arrow: pa.Schema) -> pa.RecordBatch:
    """One row: ``own`` and the grove's arrays."""
    return _batch_of([(own, grove)], arrow)


def _batch_of(rows: list, arrow: pa.Schema) -> pa.RecordBatch:
    """A row for each (own, grove)."""
    found = [own if grove is None else own | {c: getattr(grove, c) if c in ("value", "gain") else getattr(grove, c).astype(np.int32)
                                              for c in Grove.FIELDS} for own, grove in rows]
    return pa.RecordBatch.from_arrays([pa.array([x[f.name] for x in found], f.type) for f in arrow], schema=arrow)


def _grove_of(row: dict) -> Grove:
    return Grove(**{c: row[c] for c in Grove.FIELDS})


def _rows(batches):
    for batch in batches:
        names, columns = batch.schema.names, batch.columns
        for i in range(batch.num_rows):  # one row's cells at a time: a block is large
            yield {c: _cell(x[i]) for c, x in zip(names, columns)}


def _cell(x: pa.Scalar):
    """A value as Python has it, but an array of numbers as NumPy's: a grove has thousands of nodes."""
    if not isinstance(x, pa.ListScalar) or not x.is_valid:
        return x.as_py()
    flat = isinstance(x.values, (pa.IntegerArray, pa.FloatingPointArray))
    return x.values.to_numpy(zero_copy_only=False) if flat else x.as_py()


def _with_groves(blocks: DataFrame, folds: int, how: Forest) -> DataFrame:
    """Every block with every fold and grove, dealt evenly over tasks."""
    groves = -(-how.trees // how.task_trees)
    each = blocks.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))) \
        .withColumn("grove", F.explode(F.sequence(F.lit(0), F.lit(groves - 1))))
    return _dealt(each, blocks, folds * groves, folds * how.trees)


def _parted(blocks: DataFrame, folds: int, how: Forest) -> tuple[DataFrame | None, DataFrame]:
    """Blocks that a task takes whole, dealt over tasks (None if they are too few to keep the cores busy), and the others."""
    trees = folds * how.trees
    small = F.col("_n") * trees <= _VISITS
    count, rows = blocks.where(small).agg(F.count(F.lit(1)), F.sum("_n")).first()
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    if count < 4 * cores:
        return None, blocks
    tasks = max(4 * cores, rows * trees // _VISITS)
    return blocks.where(small).repartition(min(count, tasks)), blocks.where(~small)


def _dealt(each: DataFrame, blocks: DataFrame, times: int, trees: int) -> DataFrame:
    """``each`` (``times`` rows a block) spread evenly: some ten million row visits a task, all cores busy at least."""
    sizes = blocks.agg(F.count(F.lit(1)), F.sum("_n")).first()
    tasks = max(2 * each.sparkSession.sparkContext.defaultParallelism, (sizes[1] or 0) * trees // _VISITS)
    return each.repartition(max(1, min(sizes[0] * times, tasks)))


def _local_groves(blocks: DataFrame, keys, folds: int, schema: StructType, how: Forest) -> DataFrame:
    arrow = to_arrow_schema(schema)

    def run(batches):
        for row in _rows(batches):
            part = _Part(row)
            yield _batch(row, one(part, row["fold"], row["grove"]), arrow)

    def one(part, fold, g):
        return _ended(grown(part.bins, how.bins, part.y, part.weights(fold, g, how), how.max_depth))

    small, rest = _parted(blocks, folds, how)
    out = _with_groves(rest, folds, how).mapInArrow(run, schema)
    return out if small is None else out.unionByName(_in_task(small, folds, how, schema, lambda row, part, groves: [
        (row | {"grove": g}, _ended(grove)) for g, grove in enumerate(groves)]))


def _ended(grove: Grove) -> Grove:
    grove.open = grove.open[:0]
    return grove


def _in_task(blocks: DataFrame, folds: int, how: Forest, schema: StructType, made) -> DataFrame:
    """For every block and fold the rows that ``made(row, part, groves)`` gives, as :func:`_batch_of` takes them, of the
    groves that leave the fold (in ``row``) out; they are grown where the block is and go no further."""
    arrow = to_arrow_schema(schema)

    def run(batches):
        for row in _rows(batches):
            part = _Part(row)
            for fold in range(folds):
                groves = (grown(part.bins, how.bins, part.y, part.weights(fold, g, how), how.max_depth)
                          for g in range(-(-how.trees // how.task_trees)))
                found = made(row | {"fold": fold}, part, groves)
                if found:
                    yield _batch_of(found, arrow)

    return blocks.mapInArrow(run, schema)


def _apart(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks that hold their whole key and that Java takes, and the others."""
    small = (F.col("_parts") == 1) & (F.col("_n") <= _ROWS_JAVA)
    return blocks.where(small), blocks.where(~small)


def _in_java(blocks: DataFrame, keys, folds: int, how: Forest, errors: bool) -> DataFrame:
    """(keys, fold, _found) of blocks that hold their whole key: the features' shares added up over the trees that leave the
    fold out, or number and sums of errors of the fold's rows; grown where the block is and gone no further."""
    spark, trees = blocks.sparkSession, folds * how.trees
    options = (int(errors), how.trees, how.max_depth, how.task_trees, int(how.bootstrap), how.seed)
    name = "lever_forest_" + "_".join(map(str, options)).replace("-", "m")
    jvm.register(spark, "Forest", name, ArrayType(ArrayType(DoubleType())), errors, how.trees, how.max_depth, how.task_trees,
                 how.bootstrap, how.seed, POISSON.tobytes())
    count, rows = blocks.agg(F.count(F.lit(1)), F.sum("_n")).first()
    cores = spark.sparkContext.defaultParallelism
    # a task takes a small key whole if that keeps the cores busy
    whole = F.lit(count >= 4 * cores) & (F.col("_n") * trees <= _VISITS_JAVA)
    each = blocks.withColumn("_from", F.explode(F.when(whole, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(folds - 1)))))
    tasks = max(4 * cores, (rows or 0) * trees // _VISITS_JAVA)
    each = each.repartition(max(1, min(count * folds, tasks)))
    found = F.call_udf(name, "_bins", "_y", "_fold", "_draw", "_low", "_high", "_from",
                       F.when(whole, F.lit(folds)).otherwise(F.col("_from") + 1))
    return each.select(*[_q(k) for k in keys], "_from", F.posexplode(found).alias("_at", "_found")) \
        .select(*[_q(k) for k in keys], (F.col("_from") + F.col("_at")).alias("fold"), "_found")


def _shared_groves(blocks: DataFrame, keys, folds: int, schema: StructType, how: Forest) -> DataFrame:
    """The groves of keys of several parts, level by level."""
    by = [*keys, "fold", "grove"]
    arrow = to_arrow_schema(schema)
    each = written(_with_groves(blocks, folds, how), "forest-parts")

    def planted(batches):
        for row in _rows(batches):
            yield _batch(row, Grove.planted(min(how.task_trees, how.trees - row["grove"] * how.task_trees)), arrow)

    groves = each.where("_part = 0").select(*[_q(c) for c in by]).mapInArrow(planted, schema)
    sums_schema = StructType([each.schema[c] for c in by] + [StructField("_part", IntegerType()), StructField("_sums", BinaryType())])
    sums_arrow = to_arrow_schema(sums_schema)

    def measure(batches):
        for row in _rows(batches):
            part, grove = _Part(row), _grove_of(row)
            trees, rows, weight = pairs(part.weights(row["fold"], row["grove"], how))
            sums = grove.histograms(part.bins, how.bins, rows, grove.leaves(part.bins, rows, trees), weight, part.y)
            yield _batch(row | {"_sums": sums.tobytes()}, None, sums_arrow)

    def advance(batches):
        own = grove = total = None
        for row in _rows(batches):
            mark = {c: row[c] for c in by}
            if grove is None or own != mark:
                if grove is not None:
                    grove.split(total)
                    yield _batch(own, grove, arrow)
                own, grove, total = mark, _grove_of(row), 0.0
            total = total + np.frombuffer(row["_sums"]).reshape(2, len(grove.open), -1, how.bins)
        if grove is not None:
            grove.split(total)
            yield _batch(own, grove, arrow)

    for _ in range(how.max_depth):
        groves = written(groves, "forest-level")
        growing = groves.where(F.size("open") > 0)
        if growing.isEmpty():
            break
        sums = join_on(each, growing, by).mapInArrow(measure, sums_schema)
        met = join_on(sums, growing, by).repartition(*[_q(c) for c in by]).sortWithinPartitions(*[_q(c) for c in [*by, "_part"]])
        groves = groves.where(F.size("open") == 0).unionByName(met.drop("_part").mapInArrow(advance, schema))
    return groves


def grow_forests(blocks: DataFrame, keys, folds: int, how: Forest = Forest()) -> DataFrame:
    """(keys, fold, grove, tree, feature, cut, left, value, gain): the trees that leave each fold out, some a row."""
    keys = list(keys)
    schema = StructType(_keyed(blocks, keys) + _GROVE)
    out = _local_groves(blocks.where("_parts = 1"), keys, folds, schema, how)
    large = blocks.where("_parts > 1")
    if not large.isEmpty():
        out = out.unionByName(_shared_groves(large, keys, folds, schema, how))
    return written(out.drop("open"), "forest-trees")


def fold_importances(groves: DataFrame, keys, variables) -> DataFrame:
    """(keys, fold, feature, feature_importance): each tree's shares of the fall of the squared error, averaged over
    the trees that split at all; shares of one fold add up to 1, or are all 0."""
    p = len(variables)
    schema = StructType(_keyed(groves, keys) + [StructField("fold", IntegerType()), StructField("_found", ArrayType(DoubleType()))])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for row in _rows(batches):
            shares = _grove_of(row | {"open": []}).importances(p).sum(axis=0)
            yield _batch(row | {"_found": shares}, None, arrow)

    return _averaged(groves.mapInArrow(run, schema), keys, variables)


def grown_importances(blocks: DataFrame, keys, folds: int, variables, how: Forest = Forest()) -> DataFrame:
    """:func:`fold_importances` of the forests of ``blocks``; the trees of a key of one part are not written."""
    small, large = _apart(blocks)
    out = _averaged(_in_java(small, keys, folds, how, False), keys, variables)
    return out if large.isEmpty() else out.unionByName(fold_importances(grow_forests(large, keys, folds, how), keys, variables))


def _averaged(shares: DataFrame, keys, variables) -> DataFrame:
    keys, names, p = list(keys), list(variables), len(variables)
    sums = shares.groupBy(*[_q(k) for k in keys], "fold").agg(*[F.sum(F.col("_found")[j]).alias(f"_s{j}") for j in range(p)])
    total = sum((F.col(f"_s{j}") for j in range(p)), F.lit(0.0))
    entries = [F.struct(F.lit(v).alias("feature"), F.when(total > 0, F.col(f"_s{j}") / total).otherwise(F.lit(0.0))
                        .alias("feature_importance")) for j, v in enumerate(names)]
    return sums.select(*[_q(k) for k in keys], F.col("fold").cast("bigint").alias("fold"), F.inline(F.array(*entries)))


def forest_nodes(groves: DataFrame, blocks: DataFrame, keys, variables, how: Forest = Forest()) -> DataFrame:
    """(keys, fold, tree, node, feature, threshold, left, value, gain): every node, numbered within its grove, roots
    first; inner ones send x <= threshold to ``left`` and the rest to the node after it."""
    keys = list(keys)
    cuts = blocks.where("_part = 0").select(*[_q(k).alias(k) for k in keys], "_low", "_high", "_cuts")
    flat = groves.select(*[_q(k) for k in keys], "fold", "grove", F.posexplode(F.arrays_zip(*[c for c in Grove.FIELDS if c != "open"]))
                         .alias("node", "x"))
    x = join_per_key(flat, cuts, keys)
    half, inner = (F.col("_high") - F.col("_low")) / 2, F.col("x.left") >= 0
    feature = F.col("x.feature").cast("int")
    return x.select(
        *[_q(k) for k in keys], F.col("fold").cast("bigint").alias("fold"),
        (F.col("grove") * how.task_trees + F.col("x.tree")).cast("bigint").alias("tree"), F.col("node").cast("bigint").alias("node"),
        F.when(inner, F.get(F.array(*[F.lit(v) for v in variables]), feature)).alias("feature"),
        F.when(inner, F.get(F.get("_cuts", feature), F.col("x.cut").cast("int"))).alias("threshold"),
        F.when(inner, F.col("x.left").cast("bigint")).alias("left"),
        (F.col("x.value") * 2.0 ** -TARGET_BITS * half + F.col("_low") + half).alias("value"),
        (F.col("x.gain") * (half * 2.0 ** -TARGET_BITS) * (half * 2.0 ** -TARGET_BITS)).alias("gain"))


def fold_errors(blocks: DataFrame, groves: DataFrame, keys, how: Forest = Forest()) -> DataFrame:
    """(keys, fold, mape, rmse): each fold's rows predicted by the mean of its trees."""
    keys = list(keys)
    packed = groves.groupBy(*[_q(k) for k in keys], "fold") \
        .agg(F.collect_list(F.struct("grove", *[c for c in Grove.FIELDS if c != "open"])).alias("_groves"))
    schema = StructType(_keyed(blocks, keys) + [StructField("fold", IntegerType()), StructField("_found", ArrayType(DoubleType()))])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for row in _rows(batches):
            part, guess = _Part(row), 0.0
            held = np.flatnonzero(part.fold == row["fold"])
            if not len(held):
                continue
            for grove in sorted(row["_groves"], key=lambda x: x["grove"]):
                grove = _grove_of(grove | {"open": []})
                trees = int(grove.tree.max()) + 1
                at = grove.leaves(part.bins, np.tile(held, trees), np.repeat(np.arange(trees), len(held)))
                guess = guess + grove.value[at].reshape(trees, -1).sum(axis=0)
            guess = from_integers(guess / how.trees, row["_low"], row["_high"])
            y = from_integers(part.y[held], row["_low"], row["_high"])
            err = np.abs(y - guess)
            # added up in the rows' order, as in Java
            sums = [float(len(held)), float(np.cumsum(err / np.maximum(np.abs(y), EPS))[-1]), float(np.cumsum(err * err)[-1])]
            yield _batch(row | {"_found": sums}, None, arrow)

    met = join_on(packed, blocks, keys) if keys else packed.crossJoin(blocks)  # a fold's groves with each part of its key
    folds = groves.agg(F.max("fold")).first()[0] or 0
    return _of_sums(_dealt(met, blocks, folds + 1, how.trees).mapInArrow(run, schema), keys)


def grown_errors(blocks: DataFrame, keys, folds: int, how: Forest = Forest()) -> DataFrame:
    """:func:`fold_errors` of the forests of ``blocks``; a key of one part is scored where it is grown, its trees are not written."""
    small, large = _apart(blocks)
    out = _of_sums(_in_java(small, keys, folds, how, True), keys)
    return out if large.isEmpty() else out.unionByName(fold_errors(large, grow_forests(large, keys, folds, how), keys, how))


def _of_sums(sums: DataFrame, keys) -> DataFrame:
    m, ape, se = (F.sum(F.col("_found")[i]) for i in range(3))
    return sums.where(F.col("_found")[0] > 0).groupBy(*[_q(k) for k in keys], "fold").agg((ape / m).alias("mape"), F.sqrt(se / m).alias("rmse"))


def with_options(how: Forest | None = None, **options) -> Forest:
    """``how`` with options by the names ``num_trees``, ``max_depth``, ``bins``, ``seed``, ``bootstrap``, ``part_rows``, ``task_trees``."""
    if "num_trees" in options:
        options["trees"] = options.pop("num_trees")
    return replace(how or Forest(), **options)
