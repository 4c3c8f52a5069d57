"""From raw documents to packed training sequences, one operator a stage.

Every stage works on all that the one before kept; its result is written as
Parquet in the shared folder and read again by the next.

1. quality_rules: documents that repeat themselves too much, or have too few words, go.
2. near_dedup: of each class of near-duplicate documents that with the least id stays.
3. substring_dedup: passages that repeat across documents stay in the first only.
4. decontaminate: benchmark passages are cut out; documents that are mostly benchmark go.
5. packing: the rest, cut and packed into sequences of at most 2048 tokens, with their ids.

Null texts are rejected by the first stage.  Extra columns pass through stages 1 to 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lever.llm import op01_order_minhash as op01
from lever.llm import op07_packing as op07
from lever.llm import op08_decontaminate as op08
from lever.llm import op09_passages as op09
from lever.llm import op10_repetition as op10
from lever.llm.common import table, tuned, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tuned(spark)
    return op10.quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tuned(spark)
    return op01.deduplicated(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tuned(spark)
    return op09.without_passages(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tuned(spark)
    return op08.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tuned(spark)
    return op07.pack(docs, with_ids=True)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup),
          ("decontaminate", decontaminate), ("packing", packing)]

#: SQL has no sketches, alignments, chunk boundaries or tokenizer: the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
