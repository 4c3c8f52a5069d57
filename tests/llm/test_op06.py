import base64
import hashlib

from lever.llm import op06_warc as op06
from lever.llm.common import scratch
from tests.llm.helpers import rng, words

PAGES = "page_id bigint, url string, html string, bytes string, digest int"


def fake(i):
    """A payload that looks like records."""
    inner = f"{op06.MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:lever:page:{900 + i}:X>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    return inner * 3 + op06.MAGIC + op06.MAGIC + "Content-Length: 999999\r\n\r\n" + "tail " * 40


def want(pages, least=0):
    out, top = [], {}
    for p in pages:
        body = (p[2] or "").encode()
        if len(body) >= least:
            top[body] = max(top.get(body, p[0]), p[0])
    for p in pages:
        body = (p[2] or "").encode()
        refers = top.get(body) if top.get(body, p[0]) != p[0] else None
        out.append((p[0], len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(),
                    "response" if refers is None else "revisit", refers))
    return sorted(out)


def pages_of(r):
    pages = [(i, f"http://h/{i}\r\nX: y", " ".join(words(r, r.choice([0, 3, 400, 4000])))) for i in range(60)]
    pages += [(100 + i, "http://fake/", fake(i)) for i in range(30)]
    pages += [(200 + i, None, "same " * 50) for i in range(25)] + [(300, "u", None), (301, "u", ""), (302, "ü", "é" * 3000)]
    pages += [(400, "u", op06.MAGIC), (401, "u", "\r\n\r\n"), (402, "u", "x" * 300_000 + fake(1) + "y" * 200_000)]
    return pages


def test_round_trip_over_small_splits(spark):
    pages = pages_of(rng())
    frame = spark.createDataFrame([(*p, "c", 1) for p in pages], PAGES).repartition(3)
    path = scratch(spark, "warc-test")
    op06.write_archives(frame, path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        records = op06.read_archives(spark, path).persist()
        got = sorted(tuple(x) for x in op06.page_records(records).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == want(pages)
    payloads = {x.record_id.split(":")[3]: bytes(x.payload) for x in records.filter("type = 'response'").collect()}
    for p in pages:
        if str(p[0]) in payloads:
            assert payloads[str(p[0])] == (p[2] or "").encode()


def test_small_payloads_are_all_responses(spark):
    pages = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")]
    path = scratch(spark, "warc-test")
    op06.write_archives(spark.createDataFrame(pages, "page_id bigint, url string, html string"), path, least_revisit=5)
    got = sorted(tuple(x) for x in op06.page_records(op06.read_archives(spark, path, False)).collect())
    assert got == want(pages, 5)


def test_repeated_rows_and_empty_table(spark):
    path = scratch(spark, "warc-test")
    rows = [(1, "u", "a"), (1, "u", "a"), (1, "u", "b")]
    op06.write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string"), path)
    assert op06.page_records(op06.read_archives(spark, path)).filter("record_type = 'response'").count() == 3
    path = scratch(spark, "warc-test")
    op06.write_archives(spark.createDataFrame([], "page_id bigint, url string, html string"), path)
    assert op06.read_archives(spark, path).count() == 0
