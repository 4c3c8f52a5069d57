"""Helpers shared by the operators of this subpackage.

Intermediate results that are read more than once are written as Parquet under
the folder named by ``spark.checkpoint.dir``, which driver and executors share,
and read back: that cuts the lineage, survives lost executors and gives the
planner real sizes.  The folders go when the application ends.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: space and \x09-\x0D, just what ``bytes.split()`` cuts at.
SPACE = r"[\x20\x09-\x0D]"
#: Lower-cases A-Z, keeps a-z, 0-9 and every byte above ASCII, blanks the rest.
_WORD_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256))
_LOWER_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def normal_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return text.translate(_WORD_TABLE).split()


def lower_ascii(text: bytes) -> bytes:
    return text.translate(_LOWER_TABLE)


def tuned(spark: SparkSession) -> SparkSession:
    """Bound what one Arrow batch holds: rows may be whole documents of any length."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``; a local one only where none is set (tests)."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="lever-shared-")
        sc.setCheckpointDir(folder)
        folder = sc.getCheckpointDir()
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/lever-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def byte_values(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(name).cast(pa.binary()).to_pylist()


def col(name: str) -> Column:
    """The column of this very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_blocks(batches: Iterable[pa.RecordBatch], id_col: str, text_col: str,
                max_bytes: int = 1 << 21) -> Iterator[tuple[list, list[bytes | None]]]:
    """Runs of (ids, texts) whose texts together hold about ``max_bytes``, or one longer text."""
    for batch in batches:
        ids, texts = batch.column(id_col).to_pylist(), byte_values(batch, text_col)
        start = size = 0
        for i, t in enumerate(texts):
            n = len(t) if t else 0
            if i > start and size + n > max_bytes:
                yield ids[start:i], texts[start:i]
                start, size = i, 0
            size += n
        if start < len(texts):
            yield ids[start:], texts[start:]


#: What to call when a task ends: caches of this worker that it need not keep.
_CACHES: list[Callable[[], None]] = []


def emptied_at_end(clear: Callable[[], None]) -> None:
    _CACHES.append(clear)


def tidied(run, keep_caches: bool = False):
    """``run`` of a ``mapInArrow``, after which the worker gives its memory back: workers stay for the next tasks and
    stages, and what each still held would add up."""
    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            _give_back(keep_caches)
    return tidy


def _give_back(keep_caches: bool) -> None:
    for clear in () if keep_caches else _CACHES:
        clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        pass
