"""Quality rules from each document's suffix array.

Longest-common-prefix intervals of the array over a document's words give its
maximal repeated substrings.  The union of their spans and the longest of them
are limited: ``covered_words`` counts words in repeats of at least
``least_repeat`` words, ``longest_repeat`` is the longest repeat in words.

Documents are handled in blocks inside tasks, whole texts, no shuffle.  A block
holds about 2 MB of text, or one longer text.

Nulls and empty texts have no words, zero counts, and fail the base rule.
Repeated rows are judged alike, each on its own; an empty table gives an empty
one.  The measures carry the id only; the filter keeps every column as it was,
whatever its name (dots, or the names of measures).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lever.llm.common import col, text_blocks, tidied
from lever.llm.suffix import RepeatArray, word_ids

_SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class Limits:
    #: base rules
    least_words: int = 20
    repeat_window: int = 8
    max_repeat_percent: int = 30
    #: the method's: repeats of so many words count, the share they may cover, the longest allowed
    least_repeat: int = 6
    max_covered_percent: int = 40
    max_longest_percent: int = 30
    #: a longest repeat of up to so many words is always allowed
    free_longest: int = 32


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")


def measure(texts: list[bytes | None], limits: Limits = Limits()) -> dict[str, np.ndarray]:
    """The measures of each text of a block."""
    words = [(t or b"").split() for t in texts]
    ids, bounds = word_ids(words)
    array = RepeatArray(ids, bounds)
    best = array.longest()

    def per_doc(values: np.ndarray) -> np.ndarray:
        total = np.zeros(len(values) + 1, np.int64)
        np.cumsum(values, out=total[1:])
        return total[bounds[1:]] - total[bounds[:-1]]

    window = limits.repeat_window
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, array.doc, best)
    out = {
        "n_words": np.diff(bounds),
        "n_repeat_words": per_doc(array.covered(best, window, window)),
        "covered_words": per_doc(array.covered(best, limits.least_repeat)),
        "longest_repeat": longest,
    }
    chars, symbols, dup_lines = [], [], []
    for text, w in zip(texts, words):
        text = text or b""
        chars.append(len(b"".join(w).translate(None, _CONTINUATION)))
        symbols.append(len(text) - len(text.translate(None, _SYMBOLS)))
        lines = [x for x in text.split(b"\n") if x.strip()]
        dup_lines.append(len(lines) - len(set(lines)))
    return out | {"word_chars": np.array(chars, np.int64), "n_symbols": np.array(symbols, np.int64),
                  "n_dup_lines": np.array(dup_lines, np.int64)}


def repetition_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        limits: Limits = Limits()) -> DataFrame:
    """(id, measures) of every row."""
    source = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))

    id_type = to_arrow_schema(source.schema).field("id").type

    def run(batches):
        for ids, texts in text_blocks(batches, "id", "text"):
            found = measure(texts, limits)
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), *(pa.array(found[m]) for m in MEASURES)],
                                             names=["id", *MEASURES])

    out = source.mapInArrow(tidied(run), f"id {source.schema['id'].dataType.simpleString()}, "
                            + ", ".join(f"{m} bigint" for m in MEASURES))
    return out.withColumnRenamed("id", id_col)


def judged(measures: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """With ``base_failed`` and ``kept``."""
    n = F.col("n_words")
    base_failed = (n < limits.least_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * n)
    long_repeat = ((F.col("longest_repeat") > limits.free_longest)
                   & (100 * F.col("longest_repeat") > limits.max_longest_percent * n))
    rejected = (100 * F.col("covered_words") > limits.max_covered_percent * n) | long_repeat
    return measures.withColumn("base_failed", base_failed).withColumn("kept", ~base_failed & ~rejected)


def quality_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns as they were.

    Rows are judged where they lie: the verdict comes from the text alone, so
    one pass suffices and no id has to be unique.
    """
    place = docs.columns.index(text_col)
    schema = docs.schema
    arrow = to_arrow_schema(schema)
    spare = [f"c{i}" for i in range(len(docs.columns))]  # names may hold dots or clash

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keep: list[bool] = []
            texts = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows)), batch.column(place)], ["id", "text"])
            for _, block in text_blocks([texts], "id", "text", 1 << 19):
                keep += kept_rows(measure(block, limits), limits).tolist()
            yield pa.RecordBatch.from_arrays(batch.columns, schema=arrow).filter(pa.array(keep))

    return docs.toDF(*spare).mapInArrow(tidied(run), schema)


def kept_rows(found: dict[str, np.ndarray], limits: Limits = Limits()) -> np.ndarray:
    n = found["n_words"]
    failed = (n < limits.least_words) | (100 * found["n_repeat_words"] > limits.max_repeat_percent * n)
    long_repeat = ((found["longest_repeat"] > limits.free_longest)
                   & (100 * found["longest_repeat"] > limits.max_longest_percent * n))
    return ~(failed | long_repeat | (100 * found["covered_words"] > limits.max_covered_percent * n))
