"""Token-count totals by source, language and tokenizer version, kept by deltas.

A batch of events says which documents are there with how many tokens
(``insert``, ``revise``) or no longer there (``delete``).  Each event becomes
signed rows: what the document counted before, taken away, and what it counts
now.  Signed rows only ever add up, so a batch touches its own documents, never
the corpus, and totals are the sums of all committed batches.

The store is a folder: ``log/batch=N`` has the signed rows per document,
``totals/batch=N`` their sums, ``commits/N`` says that both are whole and is
written last.  A batch that is committed again changes nothing; one that broke
off is written anew.  One writer at a time; any number of readers, who see
committed batches only.

Within a batch the event with the largest ``seq`` decides for a document and
tokenizer; of equals, a delete, then the larger count.  Inserting what is there
is a revision; deleting what is not there does nothing.  Events without an id or
tokenizer are ignored; null counts are 0, null kinds insert; null sources and
languages are groups of their own.  A batch may be empty.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lever.llm.common import byte_values, col, written
from lever.llm.linking import maybe_in
from lever.llm.word_tokens import default_path, loaded

KEYS = ["source", "lang", "tokenizer"]
_LOG = "doc_id bigint, source string, lang string, tokenizer string, d_docs bigint, d_tokens bigint"
_TOTALS = "source string, lang string, tokenizer string, d_docs bigint, d_tokens bigint"


class TokenRollup:
    """The totals kept under ``path``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hadoop

    def committed(self) -> list[int]:
        fs, folder = self._fs(f"{self.path}/commits")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(folder)) if fs.exists(folder) else []

    def _read(self, kind: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{kind}/batch={n}" for n in self.committed()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def commit(self, batch: int, events: DataFrame) -> bool:
        """Apply ``events`` (doc_id, tokenizer, source, lang, n_tokens, kind, seq); False if the batch was before."""
        if batch in self.committed():
            return False
        ids = ["doc_id", "tokenizer"]
        delete = F.coalesce(F.col("kind") == "delete", F.lit(False))
        now = events.filter("doc_id IS NOT NULL AND tokenizer IS NOT NULL").select(
            F.col("doc_id").cast("bigint").alias("doc_id"), F.col("tokenizer").cast("string").alias("tokenizer"),
            F.struct(F.col("seq").alias("seq"), delete.alias("gone"), F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n"),
                     "source", "lang").alias("e"))
        now = written(now.groupBy(*ids).agg(F.max("e").alias("e")).select(*ids, "e.*"), "events")
        before, _ = maybe_in(self._read("log", _LOG), "doc_id", now.select("doc_id"))
        before = before.join(now.select(*ids), ids, "left_semi").groupBy("doc_id", *KEYS) \
            .agg(F.sum("d_docs").alias("docs"), F.sum("d_tokens").alias("tokens"))
        signed = before.select("doc_id", *KEYS, (-F.col("docs")).alias("d_docs"), (-F.col("tokens")).alias("d_tokens"))
        signed = signed.unionByName(now.filter("NOT gone").select(
            "doc_id", *KEYS, F.lit(1).cast("bigint").alias("d_docs"), F.col("n").alias("d_tokens")))
        signed = signed.groupBy("doc_id", *KEYS).agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens")) \
            .filter("d_docs <> 0 OR d_tokens <> 0")
        log = f"{self.path}/log/batch={batch}"
        signed.write.mode("overwrite").parquet(log)
        sums = self.spark.read.schema(_LOG).parquet(log).groupBy(*KEYS) \
            .agg(F.sum("d_docs").alias("d_docs"), F.sum("d_tokens").alias("d_tokens"))
        sums.write.mode("overwrite").parquet(f"{self.path}/totals/batch={batch}")
        fs, marker = self._fs(f"{self.path}/commits/{batch}")
        fs.mkdirs(marker.getParent())
        return fs.createNewFile(marker)

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) over all committed batches; groups without documents go."""
        return self._read("totals", _TOTALS).groupBy(*KEYS) \
            .agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens")).filter("n_docs <> 0 OR n_tokens <> 0")


def count_words(text: bytes) -> int:
    return len(text.split())


def count_words_of_distinct_lines(text: bytes) -> int:
    """Words of the text's lines, equal lines once."""
    return sum(len(line.split()) for line in dict.fromkeys(text.split(b"\n")))


def token_counts(docs: DataFrame, tokenizers: Iterable[str] = ("words-1", "words-2", "word_bpe_49k"),
                 id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
                 bpe_path: str | None = None) -> DataFrame:
    """(doc_id, source, lang, digest, counts): the counts of each text in the order of ``tokenizers``.

    ``words-1`` counts words between white space, ``words-2`` those of distinct
    lines; any other name is the ids of the tokenizer file.  Null texts have no
    tokens and no digest.
    """
    names, path = list(tokenizers), bpe_path or default_path()
    text = col(text_col).cast("string")
    source = docs.select(col(id_col).cast("bigint").alias("doc_id"), col(source_col).cast("string").alias("source"),
                         col(lang_col).cast("string").alias("lang"), F.unhex(F.md5(text)).alias("digest"), text.alias("text"))

    def run(batches):
        ways = [{"words-1": count_words, "words-2": count_words_of_distinct_lines}.get(n) or loaded(path).count
                for n in names]
        for batch in batches:
            counts = [[way(t or b"") for way in ways] for t in byte_values(batch, "text")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(counts, pa.list_(pa.int64()))],
                                             names=["doc_id", "source", "lang", "digest", "counts"])

    return source.mapInArrow(run, "doc_id bigint, source string, lang string, digest binary, counts array<bigint>")


def events(counts: DataFrame, tokenizers: list[str], kind: str, seq: int = 0, place: dict[str, int] | None = None) -> DataFrame:
    """Events of one kind from ``token_counts`` rows; ``place`` maps a tokenizer to the count it takes."""
    place = place or {t: i for i, t in enumerate(tokenizers)}
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("tokenizer"), F.col("counts")[i].alias("n_tokens"))
                               for t, i in place.items()]))
    return counts.select("doc_id", "source", "lang", each.alias("e")) \
        .select("doc_id", "source", "lang", "e.*", F.lit(kind).alias("kind"), F.lit(seq).alias("seq"))
