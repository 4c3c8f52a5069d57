"""Order-dependent running operators that stay parallel when one key is huge.

A window ``partitionBy(keys).orderBy(t)`` sends every row of a key to one task.
That is what runs while no key holds more than ``BLOCK_ROWS`` rows, which one
aggregate tells when the plan is built.  Otherwise a machine holding a third of
the table would run in one task, so rows are cut into blocks along the key and
order columns; the window runs inside each ``(keys, block)`` and a carry from the
earlier blocks of the same key is added:

* row index  = local row number + rows in earlier blocks
* running sum = local running sum + sum of earlier blocks
* forward fill = local last non-null, else last non-null of earlier blocks

The number of blocks follows from the number of rows, ``BLOCK_ROWS`` each.  The cuts
are evenly spaced tuples of the keys and the whole order (first column and
tie-breakers, any types), from a sample that a hash of these values draws, taken when
the plan is built, as a range partitioning samples its bounds.  So a key is cut about
as often as it holds ``BLOCK_ROWS`` rows, and there are hardly more (keys, block) groups
than keys and blocks.  The cuts are one sorted array literal of the plan and a row finds
its block by binary search in it, so every branch and every retry sees the same blocks
and nothing has to be cached.  The carry comes from a per-(keys, block) summary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from lever.functions.columns import fold_of_index, join_on

BLK = "_lever_blk"
#: Rows of a block, about, whatever the session's partitioning; so many blocks at most, then they grow.
BLOCK_ROWS, _MOST_BLOCKS = 250_000, 16_384
#: Sampled rows a block that cuts are chosen from.
_PER_BLOCK = 16


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _drawn(df: DataFrame, order, rows: int, blocks: int) -> list[str]:
    """Order tuples (as JSON) of a sample of some ``_PER_BLOCK`` rows a block, in the order of what the JSON reads as."""
    few = max(1, rows // (blocks * _PER_BLOCK))  # one row in so many
    who = [_q(o).alias(f"c{i}") for i, o in enumerate(order)]
    sample = df.select(*who).where(F.pmod(F.xxhash64(*[f"c{i}" for i in range(len(order))]), F.lit(few)) == 0)
    found = sample.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("t")).orderBy(F.from_json("t", sample.schema))
    return [r["t"] for r in found.collect()]  # bounded by the number of blocks, which is bounded


def _block(df: DataFrame, order, num_blocks: int | None) -> Column:
    """The block of a row: how many cuts lie at or below its order tuple (NULLs first)."""
    rows = df.select(*[_q(o) for o in order]).count()
    n = min(num_blocks or -(-rows // BLOCK_ROWS), _MOST_BLOCKS)
    drawn = _drawn(df, order, rows, n) if n > 1 else []
    chosen = [drawn[i * len(drawn) // n] for i in range(1, n)] if len(drawn) > 1 else []
    if not chosen:
        return F.lit(0)
    own = F.struct(*[_q(o).alias(f"c{i}") for i, o in enumerate(order)])
    kind = df.select(own.alias("t")).schema["t"].dataType
    # a cut need not be a value of the data, so what JSON rounds off does no harm.  The array is a constant, in order
    # as it is read: sorting it here would sort it again for every row and every step of the search
    cuts = F.from_json(F.lit("[" + ",".join(chosen) + "]"), ArrayType(kind))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(chosen).bit_length()))])
    size = F.lit(len(chosen))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        (at + step <= size) & (F.get(cuts, at + step - 1) <= own), at + step).otherwise(at))


def _whole(df: DataFrame, keys, num_blocks: int | None) -> bool:
    """Whether every key's rows may meet in one task: none holds more than ``BLOCK_ROWS``."""
    if num_blocks is not None:
        return num_blocks == 1
    return df.groupBy(*[_q(k) for k in keys]).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > BLOCK_ROWS).isEmpty()


def _scan_whole(df: DataFrame, keys, order, fill, cumsum, index, count) -> DataFrame:
    """:func:`ordered_scan` by one window a key."""
    part = Window.partitionBy(*[_q(k) for k in keys])
    ordered = part.orderBy(*[_q(o).asc_nulls_first() for o in order])
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    out = {c: F.last(_q(c), ignorenulls=True).over(upto) for c in fill}
    out.update({o: F.coalesce(F.sum(_q(c)).over(upto), F.lit(0)) for o, c in cumsum.items()})
    if index:
        out[index] = (F.row_number().over(ordered) - 1).cast("bigint")
    if count:
        out[count] = F.count(F.lit(1)).over(part).cast("bigint")
    result = df.withColumns(out)
    return result.select(*[_q(c) for c in df.columns], *[_q(c) for c in out if c not in df.columns])


def ordered_scan(df: DataFrame, keys, order, *, fill=(), cumsum=None, index: str | None = None,
                 count: str | None = None, num_blocks: int | None = None) -> DataFrame:
    """Running operators along ``order`` within ``keys``.

    fill   -- columns replaced by their last non-null value at or before the row
    cumsum -- ``{out_name: column_name}`` inclusive running sums (NULLs add 0)
    index  -- name of a 0-based row index column to add
    count  -- name of a rows-per-key column to add
    ``order`` must be unique within a key (give tie-breakers).
    """
    keys, order, fill = list(keys), list(order), list(fill)
    cumsum = dict(cumsum or {})
    if _whole(df, keys, num_blocks):
        return _scan_whole(df, keys, order, fill, cumsum, index, count)
    blocked = df.withColumn(BLK, _block(df, [*keys, *order], num_blocks))
    group = [*keys, BLK]
    local_part = Window.partitionBy(*[_q(k) for k in group]).orderBy(*[_q(o).asc_nulls_first() for o in order])
    wr = local_part.rowsBetween(Window.unboundedPreceding, 0)
    local_cols = {f"_lf_{i}": F.last(_q(c), ignorenulls=True).over(wr) for i, c in enumerate(fill)}
    local_cols.update({f"_ls_{i}": F.coalesce(F.sum(_q(c)).over(wr), F.lit(0))
                       for i, c in enumerate(cumsum.values())})
    if index:
        local_cols["_li"] = F.row_number().over(local_part) - 1
    local = blocked.withColumns(local_cols)

    ordstruct = F.struct(*[_q(o) for o in order])
    aggs = [F.count(F.lit(1)).alias("_cn")]
    aggs += [F.max_by(_q(c), F.when(_q(c).isNotNull(), ordstruct)).alias(f"_cf_{i}")
             for i, c in enumerate(fill)]
    aggs += [F.coalesce(F.sum(_q(c)), F.lit(0)).alias(f"_cs_{i}") for i, c in enumerate(cumsum.values())]
    summary = blocked.groupBy(*[_q(k) for k in group]).agg(*aggs)
    whole = Window.partitionBy(*[_q(k) for k in keys])
    prev = whole.orderBy(_q(BLK)).rowsBetween(Window.unboundedPreceding, -1)
    carry_cols = [*[_q(k) for k in group], F.coalesce(F.sum("_cn").over(prev), F.lit(0)).alias("_c_off")]
    if count:
        carry_cols.append(F.sum("_cn").over(whole).alias("_c_tot"))
    carry_cols += [F.last(f"_cf_{i}", ignorenulls=True).over(prev).alias(f"_c_f_{i}")
                   for i in range(len(fill))]
    carry_cols += [F.coalesce(F.sum(f"_cs_{i}").over(prev), F.lit(0)).alias(f"_c_s_{i}")
                   for i in range(len(cumsum))]
    joined = join_on(local, summary.select(*carry_cols), group)
    out = {c: F.coalesce(F.col(f"_lf_{i}"), F.col(f"_c_f_{i}")) for i, c in enumerate(fill)}
    out.update({o: F.col(f"_ls_{i}") + F.col(f"_c_s_{i}") for i, o in enumerate(cumsum)})
    if index:
        out[index] = (F.col("_li") + F.col("_c_off")).cast("bigint")
    if count:
        out[count] = F.col("_c_tot").cast("bigint")
    result = joined.withColumns(out)
    return result.select(*[_q(c) for c in df.columns], *[_q(c) for c in out if c not in df.columns])


def forward_fill(df: DataFrame, keys, order, cols=None, **kw) -> DataFrame:
    """Every column (or ``cols``) takes its last non-null value in time order.

    Leading gaps stay NULL.  Key and order columns are never filled.
    """
    skip = set(keys) | set(order)
    cols = [c for c in (cols if cols is not None else df.columns) if c not in skip]
    return ordered_scan(df, keys, order, fill=cols, **kw)


def with_row_index(df: DataFrame, keys, order, name: str = "row_index",
                   count: str | None = None, **kw) -> DataFrame:
    return ordered_scan(df, keys, order, index=name, count=count, **kw)


def contiguous_folds(df: DataFrame, keys, order, k: int = 10, name: str = "fold", **kw) -> DataFrame:
    """``k`` consecutive blocks in time order, the first ``n mod k`` one row longer.

    Same assignment as unshuffled K-fold and as ``ntile(k) - 1``.
    """
    d = ordered_scan(df, keys, order, index="_fold_rn", count="_fold_n", **kw)
    return d.withColumn(name, fold_of_index(F.col("_fold_rn"), F.col("_fold_n"), k)) \
        .drop("_fold_rn", "_fold_n")


def rolling_mean(df: DataFrame, keys, order, col: str, size: int = 48,
                 name: str | None = None, **kw) -> DataFrame:
    """Mean of the last ``size`` rows; NULL until ``size`` rows exist and
    whenever the frame holds a NULL (pandas ``rolling(size).mean()``).

    When a key is large, rows are cut into blocks of thousands by row index; each block
    gets a copy of the ``size - 1`` rows before it, so every frame lies inside one
    ``(key, block)`` group -- no such key lands in one task, and few rows are copied.
    """
    name = name or f"{col}_rolling_{size}"
    if _whole(df, keys, kw.get("num_blocks")):
        w = Window.partitionBy(*[_q(k) for k in keys]).orderBy(*[_q(o).asc_nulls_first() for o in order]).rowsBetween(-(size - 1), 0)
        mean = F.when(F.count(_q(col)).over(w) == size, F.avg(_q(col)).over(w))
        return df.select(*[_q(c) for c in df.columns], mean.alias(name))
    block = max(4096, 8 * size)
    d = ordered_scan(df, keys, order, index="_rm_rn", **kw).withColumn(
        "_rm_b", F.floor(F.col("_rm_rn") / block))
    again = F.col("_rm_rn") % block > block - size
    both = d.withColumn("_rm_at", F.explode(F.when(again, F.array("_rm_b", F.col("_rm_b") + 1)).otherwise(F.array("_rm_b"))))
    w = Window.partitionBy(*[_q(k) for k in keys], F.col("_rm_at")).orderBy("_rm_rn") \
        .rowsBetween(-(size - 1), 0)
    res = both.withColumn(name, F.when(F.count(_q(col)).over(w) == size, F.avg(_q(col)).over(w)))
    return res.where("_rm_at = _rm_b").select(*[_q(c) for c in df.columns], F.col(name))
