import tempfile

from pyspark.sql import functions as F

from lever.sources.fixtures import EVENT_TYPES
from lever.streaming import bucket_stream
from tests.conftest import SF001


def test_stream_buckets_equal_batch_buckets(spark):
    batch = spark.read.parquet(f"{SF001}/events.parquet")
    ev = batch.withColumn("ts", F.col("ts").cast("timestamp"))
    src = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(SF001) \
        .withColumn("ts", F.col("ts").cast("timestamp"))
    out = bucket_stream(src, EVENT_TYPES, watermark="0 seconds")
    ckpt = tempfile.mkdtemp(prefix="lever-stream-")
    q = out.writeStream.outputMode("append").format("memory").queryName("buckets") \
        .option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("buckets")
    want = bucket_stream(ev, EVENT_TYPES)
    # append mode emits every bucket closed by the watermark: all but the last
    assert got.count() == want.count() - 1
    assert got.exceptAll(want).count() == 0
