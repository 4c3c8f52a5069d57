import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from lever.llm import op07_packing as op07
from lever.llm.word_tokens import default_path, loaded
from tests.llm.helpers import DOC, frame, rng, words

ODD = ["It's I'M <|endoftext|>. x<|startoftext|>y Ünïcode.” don't, 'sfoo.'t 12,3.4 a.b. ́x é. \x85z 　q ΣΑΣ. İ.",
       "A..B.,C", " ", "H̱ello T̈. ÉCOLE, <|ENDOFTEXT|> ÀB", "İSTANBUL ŒUVRE. DON'T I'LL 'S", "\x1cx\x1fy", "x" * 5000]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(default_path())


def ids(tokenizer, text):
    return tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_cached_ids_equal_the_tokenizers(tokenizer, text):
    assert np.frombuffer(loaded(default_path()).text(text.encode()), "<u4").tolist() == ids(tokenizer, text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_cached_ids_equal_the_tokenizers_for_any_text(text):
    tokenizer = Tokenizer.from_file(default_path()) if not hasattr(test_cached_ids_equal_the_tokenizers, "t") \
        else test_cached_ids_equal_the_tokenizers.t
    test_cached_ids_equal_the_tokenizers.t = tokenizer
    text = text.encode("utf-8", "ignore").decode()
    assert np.frombuffer(loaded(default_path()).text(text.encode()), "<u4").tolist() == ids(tokenizer, text)


def test_pieces_hold_every_id_once(spark, tokenizer):
    r = rng()
    texts = [" ".join(words(r, r.choice([0, 1, 5, 80, 700, 3000]))) for _ in range(120)] + ODD + ["", None]
    docs = frame(spark, texts).selectExpr("*", "doc_id AS id", "1 AS start", "'z' AS offset")
    rows = op07.pack(docs.unionByName(docs.filter("doc_id = 3")), with_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for x in rows:
        assert x.length == len(x.ids) and x.ids_crc32 == zlib.crc32(np.array(x.ids, "<u4").tobytes())
        by_doc[x.doc_id].append(x)
        by_sequence[x.sequence_id].append(x)
    for i, text in enumerate(texts):
        want = ids(tokenizer, text or "") + [1]
        copies = 2 if i == 3 else 1
        pieces = sorted(by_doc[i], key=lambda x: x.start)
        assert sum(x.length for x in pieces) == len(want) * copies
        for x in pieces:
            assert x.ids == want[x.start:x.start + x.length] and x.doc_tokens == len(want)
    total = padded = 0
    for pieces in by_sequence.values():
        at = 0
        for x in sorted(pieces, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at <= 2048
        total += at
        padded += at if at & (at - 1) == 0 else 2048
    tasks = len({s >> 40 for s in by_sequence})
    assert padded <= 1.03 * total + 2048 * tasks


def test_classes_take_a_fixed_count():
    packer = op07.Packer(2048, 0)
    full = [packer.add(90, i) for i in range(22)]  # 2048 // 90 == 22
    assert [f for f in full if f] == [full[-1]] and len(full[-1]) == 22 and packer.finish() == []


def test_empty_table(spark):
    assert op07.pack(spark.createDataFrame([], DOC)).count() == 0
