"""Chat formatting by compiled templates, and reading formatted text back.

The template marks turns with control strings; inside roles and texts those are
escaped, reversibly, by a backslash after their first character (one more if
there are some already), so no text can end a turn or start another.

Rows are brought together by conversation, sorted by turn, and streamed through
the template, so a task holds one turn at a time, however long a conversation.
Output is cut in pieces of whole segments, each with the spans under the loss
mask.  A conversation's digests follow its order, so one task reads it whole.

Null texts and roles are empty.  Rows of one turn number come in order of role,
then text; null numbers first.  Rows without an id are one conversation.
Repeated rows are turns of their own.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from lever.llm.common import col
from lever.llm.template import Compiler, TemplateError

START, MIDDLE, STOP = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROLS = (START, MIDDLE, STOP, "<s>", "</s>", "[INST]", "[/INST]")
TEMPLATE = ("<s>{% for turn in turns %}" + START + "{{ turn.role|escape }}" + MIDDLE
            + "{% if turn.role == 'assistant' %}{% generation %}{{ turn.text|escape }}{% endgeneration %}"
            "{% else %}{{ turn.text|escape }}{% endif %}" + STOP + "\n{% endfor %}</s>")
_PIECE = 1 << 18


class Escaper:
    """Hides control strings.  Their first characters occur in them nowhere else, so matches never overlap."""

    def __init__(self, controls: Iterable[str]):
        controls = sorted(controls, key=len, reverse=True)
        openers = {c[0] for c in controls}
        if any(len(c) < 2 or openers & set(c[1:]) or "\\" in c for c in controls):
            raise TemplateError("a control string holds the first character of one, or a backslash")
        self.openers = "".join(openers)
        self.plain = re.compile("|".join(map(re.escape, controls)))
        self.any = re.compile("|".join(rf"({re.escape(c[0])})(\\*)({re.escape(c[1:])})" for c in controls))

    def _moved(self, text: str, change) -> str:
        def put(m):
            opener, slashes, rest = (g for g in m.groups() if g is not None)
            return opener + change(slashes) + rest
        return self.any.sub(put, text) if any(o in text for o in self.openers) else text

    def escape(self, text: str) -> str:
        return self._moved(text, lambda slashes: slashes + "\\")

    def unescape(self, text: str) -> str:
        return self._moved(text, lambda slashes: slashes[1:])


def _turn_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("id", "role", "text")))


def format_conversations(conversations: DataFrame, template: str = TEMPLATE, controls: Iterable[str] = CONTROLS,
                         id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text") -> DataFrame:
    """(id, piece, start, text, loss) of every conversation's pieces in order: the offset of the piece in the formatted
    text and the spans of it under the loss mask, in code points."""
    rows = conversations.select(col(id_col).alias("id"), col(turn_col).alias("turn"),
                                col(role_col).cast("string").alias("role"), col(text_col).cast("string").alias("text"))
    id_type = to_arrow_schema(rows.schema)[0].type
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    names = ["id", "piece", "start", "text", "loss"]

    def run(batches):
        render = Compiler({"escape": Escaper(controls).escape}).template(template)
        out: list = []
        size = 0
        for key, turns in groupby(_turn_rows(batches), itemgetter(0)):
            env = {"turns": ({"role": role or "", "text": text or ""} for _, role, text in turns)}
            number = start = length = 0
            parts, loss = [], []
            for text, generated in render(env):
                if generated and text:
                    loss.append({"start": length, "end": length + len(text)})
                parts.append(text)
                length += len(text)
                if length >= _PIECE:
                    out.append((key, number, start, "".join(parts), loss))
                    yield batch(out)
                    out, size = [], 0
                    number, start, length, parts, loss = number + 1, start + length, 0, [], []
            if parts:
                out.append((key, number, start, "".join(parts), loss))
                size += length
            if size >= _PIECE or len(out) >= 1000:
                yield batch(out)
                out, size = [], 0
        if out:
            yield batch(out)

    def batch(out):
        types = [id_type, pa.int64(), pa.int64(), pa.string(), span]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    ordered = rows.repartition("id").sortWithinPartitions("id", "turn", "role", "text")
    return ordered.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, piece bigint, start bigint, "
                                   "text string, loss array<struct<start:bigint,end:bigint>>").withColumnRenamed("id", id_col)


def read_back(formatted: DataFrame, id_col: str = "conv_id", controls: Iterable[str] = CONTROLS) -> DataFrame:
    """What the formatted pieces say, one row per conversation: n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars.  The pieces of a conversation lie in one partition in order, as ``format_conversations`` leaves
    them."""
    id_type = to_arrow_schema(formatted.schema).field(id_col).type
    kind = formatted.schema[id_col].dataType.simpleString()

    def pieces(batches):
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in (id_col, "text", "loss")))

    def run(batches):
        escaper = Escaper(controls)
        out: list = []
        for key, parts in groupby(pieces(batches), itemgetter(0)):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n_turns = loss_chars = chars = 0
            open_text = ""
            for _, text, spans in parts:
                chars += len(text)
                for s in spans:
                    masked = escaper.unescape(text[s["start"]:s["end"]])
                    loss.update(masked.encode())
                    loss_chars += len(masked)
                *whole, open_text = (open_text + text).split(STOP)
                for turn in whole:
                    role, said = turn[turn.index(START) + len(START):].split(MIDDLE)
                    turns.update(f"{escaper.unescape(role)}\n{escaper.unescape(said)}\n".encode())
                    n_turns += 1
            out.append((key, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(out) >= 1000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    def batch(out):
        types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), types)],
            names=[id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, f"`{id_col}` {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, "
                                     "loss_sha256 string, formatted_chars bigint")
