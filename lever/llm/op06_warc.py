"""WARC archives: written with Spark's text writer, read back by boundary chains.

Reading.  Archives are read in splits, cut at every occurrence of the record
magic, also at those inside payloads.  Each cut is a candidate start; with the
length in its header it names its successor's offset.  Only candidates that the
chain from the file's start reaches are records.  Each split first follows its
candidates to where they leave the split; then pointer jumping over those exits
(a few per split) doubles the distance each round, until every split knows the
one entry that the file's start reaches.  Magic inside a payload is in no chain
from the start, so it stays part of the payload.

Records that hold no magic lie in one piece and are finished where they are
read; only the others' pieces are shuffled to be joined.

Writing.  A record is one row of text; the record separator is the writer's
line separator.  Of pages with equal payloads, that with the largest id is the
``response``; the others are ``revisit`` records without payload.  Payloads
shorter than ``least_revisit`` bytes are all responses.

Null payloads are empty.  Repeated rows are one record each; equal ids with
equal payloads all count as the response.  Empty tables give empty archives.
Characters below space in a URL are percent-escaped, so that a header is one line.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lever.llm.common import col, scratch, written
from lever.llm.linking import maybe_in

MAGIC = "WARC/1.1\r\n"
_END = "\r\n\r\n"
#: A record's id is a name made of the page's id and its payload's digest.
_NAME = "urn:lever:page:"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary or text column: five hex digits are four of base 32."""
    digits = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", least_revisit: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """One record per row of ``pages``, as text files of records under ``path``."""
    payload = F.coalesce(col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(col(id_col).cast("string").alias("id"), col(id_col).alias("order"),
                        col(url_col).cast("string").alias("url"), payload.alias("payload"))
    sized = rows.withColumn("bytes", F.octet_length("payload")).withColumn("digest", base32_sha1(F.col("payload")))
    # who refers to whom: the revisits only, which may be few; the planner sees how many once they are written
    keys = written(sized.select("id", "order", "digest", "bytes").filter(F.col("bytes") >= least_revisit), "digests")
    largest = keys.groupBy("digest").agg(F.max("order").alias("refers"), F.count("*").alias("n")).filter("n > 1")
    revisits = keys.join(largest, "digest").filter(F.col("order") < F.col("refers")) \
        .select(F.col("id").alias("rid"), F.col("digest").alias("rdigest"), F.col("refers").cast("string")).distinct()
    revisits = written(revisits, "revisits")
    # a page's id and digest together say which record it is, even where ids repeat
    joined = sized.join(revisits, (F.col("id") == F.col("rid")) & (F.col("digest") == F.col("rdigest")), "left")
    name = lambda i, d: F.concat(F.lit(f"<{_NAME}"), i, F.lit(":"), d, F.lit(">"))
    revisit = F.col("refers").isNotNull()
    safe_url = F.regexp_replace(F.coalesce("url", F.lit("")), "[\\x00-\\x1F]", "%00")
    length = F.when(revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string")
    lines = [F.lit(MAGIC), F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
             F.lit("\r\nWARC-Record-ID: "), name(F.coalesce("id", F.lit("")), F.col("digest")),
             F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), safe_url,
             F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
             F.lit("\r\nWARC-Payload-Length: "), F.col("bytes").cast("string"),
             F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-"
                                            "digest\r\nWARC-Refers-To: "), name(F.col("refers"), F.col("digest"))))
             .otherwise(""),
             F.lit("\r\nContent-Type: text/html;charset=utf-8\r\nContent-Length: "), length, F.lit(_END),
             F.when(revisit, "").otherwise(F.col("payload"))]
    joined.select(F.concat(*lines).alias("value")).write.option("lineSep", _END).text(path)


def _header(name: str, head: Column) -> Column:
    """A header's value, null if it is not there."""
    found = F.regexp_extract(head, f"(?im)^{name}:[ \\t]*([^\\r\\n]*)", 1)
    return F.when(head.rlike(f"(?im)^{name}:"), found)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, seq, at, piece): the text between magics, in file order; ``at`` its offset in the block's pieces."""
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                       F.monotonically_increasing_id().alias("seq"), F.col("value").alias("piece"))


def _exits(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one block's candidates: where each one's chain leaves the block."""
    start, succ = rows["start"].to_numpy(), rows["succ"].to_numpy()
    order = np.argsort(start)
    start, succ = start[order], succ[order]
    n = len(start)
    exits = np.empty(n, np.int64)
    at = np.searchsorted(start, succ)
    last = rows["block_end"].iloc[0]
    for i in range(n - 1, -1, -1):
        j = at[i]
        if succ[i] >= last or succ[i] <= start[i]:
            exits[i] = succ[i] if succ[i] >= last else -1
        else:
            exits[i] = exits[j] if j < n and start[j] == succ[i] else -1
    return pd.DataFrame({"file": rows["file"].iloc[0], "block": rows["block"].iloc[0], "start": start, "exit": exits})


def _walk(rows: pd.DataFrame) -> pd.DataFrame:
    """The block's candidates that its entry reaches."""
    rows = rows.sort_values("start", ignore_index=True)
    start, succ = rows["start"].to_numpy(), rows["succ"].to_numpy()
    keep, at, n = np.zeros(len(rows), bool), rows["entry"].iloc[0], len(rows)
    while True:
        i = np.searchsorted(start, at)
        if i >= n or start[i] != at:
            break
        keep[i] = True
        if succ[i] <= at:
            break
        at = succ[i]
    return rows.loc[keep, ["file", "block", "start", "succ"]]


def record_starts(candidates: DataFrame) -> DataFrame:
    """(file, block, start, succ) of the ``candidates`` (file, block, block_end, start, succ) that are records.

    A group is one split's candidates, bounded by the split's size.  Between
    splits only exits travel.
    """
    exits = written(candidates.groupBy("file", "block").applyInPandas(
        _exits, "file string, block bigint, start bigint, exit bigint"), "exits")
    # entries: the file's start, and every start that some exit of another block hits
    hit = exits.filter("exit >= 0").select("file", F.col("exit").alias("start")).distinct()
    begin = exits.groupBy("file").agg(F.min("start").alias("start"))
    nodes = exits.join(hit.union(begin).distinct(), ["file", "start"]) \
        .select("file", "block", "start", F.col("exit").alias("next"))
    nodes = written(nodes, "entries")
    reached = begin.withColumn("reached", F.lit(True))
    jumps = nodes
    while True:
        # whoever is reached, reaches its jump; then every jump doubles
        step = jumps.join(reached.filter("reached"), ["file", "start"]).select("file", F.col("next").alias("start"))
        new = step.join(nodes.select("file", "start"), ["file", "start"], "left_semi").distinct() \
            .join(reached, ["file", "start"], "left_anti").withColumn("reached", F.lit(True))
        new = written(new, "reached")
        ahead = jumps.select("file", F.col("start").alias("next"), F.col("next").alias("far"))
        jumps = written(jumps.join(ahead, ["file", "next"]).select("file", "block", "start", F.col("far").alias("next")),
                        "jumps")
        reached = written(reached.union(new), "reached")
        if jumps.isEmpty():
            break
    entry = nodes.join(reached, ["file", "start"]).groupBy("file", "block").agg(F.min("start").alias("entry"))
    return candidates.join(entry, ["file", "block"]).groupBy("file", "block").applyInPandas(
        _walk, "file string, block bigint, start bigint, succ bigint")


_FIELDS = {"type": "WARC-Type", "record_id": "WARC-Record-ID", "url": "WARC-Target-URI",
           "stated_digest": "WARC-Payload-Digest", "stated_length": "WARC-Payload-Length", "refers_to": "WARC-Refers-To"}


@contextmanager
def _fixed_splits(spark: SparkSession):
    """While it holds, how files are split does not depend on how many executors there are just now."""
    key = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "1")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _parsed(rows: DataFrame, keep: list[str], with_payload: bool) -> DataFrame:
    """Of rows with ``piece``, the text of a whole record after its magic: its fields and its payload's own figures."""
    head = F.substring_index("piece", _END, 1)
    length = _header("Content-Length", F.col("head")).cast("int")
    payload = F.col("piece").cast("binary").substr(F.octet_length("head") + len(_END) + 1, length)
    out = rows.withColumn("head", head).withColumn("payload", payload)
    return out.select(*keep, *[_header(h, F.col("head")).alias(n) for n, h in _FIELDS.items()],
                      F.octet_length("payload").cast("long").alias("payload_bytes"),
                      base32_sha1(F.col("payload")).alias("payload_digest"), *(["payload"] if with_payload else []))


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record: file, start, type, record_id, url, stated digest and length, refers_to, its payload's own
    bytes and digest, and the payload itself if asked for."""
    with _fixed_splits(spark):
        return _read(spark, path, with_payload)


def _read(spark: SparkSession, path: str, with_payload: bool) -> DataFrame:
    where = ["file", "block", "seq"]
    pieces = _pieces(spark, path)
    head = F.substring_index("piece", _END, 1)
    rows = pieces.withColumn("head_bytes", F.octet_length(head).cast("long")) \
        .withColumn("headed", F.col("piece").contains(_END)) \
        .withColumn("length", _header("Content-Length", head).cast("long")) \
        .withColumn("size", F.octet_length("piece").cast("long") + len(MAGIC))
    # what a piece is if it is a record and holds all of it
    complete = F.col("headed") & (F.col("length") >= 0) \
        & (F.col("size") == len(MAGIC) + F.col("head_bytes") + F.col("length") + 2 * len(_END))
    rows = rows.withColumn("complete", F.coalesce(complete, F.lit(False)))
    kept = [*where, "head_bytes", "headed", "length", "size", "complete"]
    read = written(_parsed(rows, kept, with_payload), "pieces")

    # offsets: sums over a file's blocks, then inside a block; both bounded, by file and split size
    sized = read.select(*kept)
    blocks = sized.groupBy("file", "block").agg(F.sum("size").alias("total"))
    in_file = Window.partitionBy("file").orderBy("block")
    blocks = blocks.withColumn("base", F.sum("total").over(in_file) - F.col("total"))
    in_block = Window.partitionBy("file", "block").orderBy("seq")
    placed = sized.join(blocks, ["file", "block"]) \
        .withColumn("start", F.col("base") + F.sum("size").over(in_block) - F.col("size") - len(MAGIC)) \
        .withColumn("block_end", F.col("base") + F.col("total") - len(MAGIC))
    placed = written(placed.drop("base", "total"), "offsets")
    succ = F.col("start") + len(MAGIC) + F.col("head_bytes") + F.col("length") + 2 * len(_END)
    candidates = placed.filter("start >= 0 AND headed AND length >= 0") \
        .select("file", "block", "block_end", "start", succ.alias("succ"))
    starts = written(record_starts(candidates), "starts")

    # the record of each piece: the last start in its block so far, or the last of an earlier block
    marked = placed.join(starts, ["file", "block", "start"], "left")
    own = F.when(F.col("succ").isNotNull(), F.struct("start", "succ", "complete"))
    marked = marked.withColumn("here", F.last(own, ignorenulls=True).over(in_block))
    tails = marked.groupBy("file", "block").agg(F.max(own).alias("tail"))
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    tails = tails.select("file", "block", F.last("tail", ignorenulls=True).over(before).alias("open"))
    marked = marked.join(tails, ["file", "block"]).withColumn("record", F.coalesce("here", "open")) \
        .filter("start < record.succ").select(*where, "start", "record")
    marked = written(marked, "marked")

    fields = [c for c in read.columns if c not in kept]
    ones = read.join(marked.filter("record.complete"), where).select("file", "start", *fields)
    parts = written(marked.filter("NOT record.complete"), "parts")
    n_parts = parts.count()
    if not n_parts:
        return ones
    wanted, _ = maybe_in(pieces, "seq", parts.select("seq"))
    texts = written(wanted.join(parts, where).select("file", "start", "record", "piece"), "texts")
    if texts.count() != n_parts:
        raise RuntimeError(f"{path} changed while it was read")
    joined = texts.groupBy("file", F.col("record.start").alias("at")) \
        .agg(F.array_sort(F.collect_list(F.struct("start", "piece"))).alias("p")) \
        .select("file", F.col("at").alias("start"), F.array_join("p.piece", MAGIC).alias("piece"))
    return ones.unionByName(_parsed(joined, ["file", "start"], with_payload))


def page_records(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the records of ``write_archives``.

    A revisit has no payload of its own; its full payload's figures are those stated in its header.
    """
    def page(c):
        return F.regexp_extract(c, f"<{_NAME}(-?\\d*):", 1).try_cast("long")

    revisit = F.col("type") == "revisit"
    return records.select(
        page(F.col("record_id")).alias("page_id"),
        F.when(revisit, F.col("stated_length").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("stated_digest", "^sha1:", "")).otherwise(F.col("payload_digest"))
        .alias("payload_digest"),
        F.col("type").alias("record_type"), F.when(revisit, page(F.col("refers_to"))).alias("refers_to"))
