"""Token ids of texts, by a public tokenizer file, through a bounded word cache.

Holds for tokenizers that split at white space and drop it, with tokens inside
words only (``word_bpe_49k.json``): then the ids of a text are those of its
space-separated words, one after the other.
"""

from __future__ import annotations

from unicodedata import is_normalized

import numpy as np

from lever.llm.common import emptied_at_end

_ENDS = frozenset(b".,")
_LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")

#: How byte-level tokenizers write bytes: printable ones as themselves, the others from U+0100 on, in order.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARS = {b: b for b in _PRINTABLE} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class WordIds(dict):
    """word -> its ids as little-endian unsigned 32-bit bytes; emptied when it holds ``most`` words."""

    def __init__(self, path: str, most: int = 200_000, longest: int = 64):
        super().__init__()
        from tokenizers import Tokenizer
        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._most, self._longest = most, longest

    def _encoded(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        low = text.lower()
        # Latin letters only: one piece, and nothing to normalise but the case, so the merges do alone
        if low.isalpha() and max(low) < "\u0250" and len(low) == len(text) and is_normalized("NFC", text):
            ids = [t.id for t in self._model.tokenize(low.encode().decode("latin-1").translate(_BYTE_CHARS))]
        else:
            ids = self._tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        if len(word) > self._longest:
            return self._encoded(word)
        # a stop after a letter is a piece of its own: not kept, as its parts are
        if len(word) > 1 and word[-1] in _ENDS and word[-2] in _LETTERS:
            return self[word[:-1]] + self[word[-1:]]
        if len(self) >= self._most:
            self.clear()
        ids = self[word] = self._encoded(word)
        return ids

    def text(self, text: bytes | None) -> bytes:
        if not text:
            return b""
        # the tokenizer lower-cases anyhow; special tokens are matched before that, and letters compose with
        # combining marks (U+0300 to U+036F) before that
        if b"<|" not in text and b"\xcc" not in text and b"\xcd" not in text:
            text = text.lower()
        return b"".join(map(self.__getitem__, text.split()))

    def count(self, text: bytes | None) -> int:
        return len(self.text(text)) >> 2


_LOADED: dict[str, WordIds] = {}
emptied_at_end(_LOADED.clear)  # by tasks of other operators that this worker runs later


def loaded(path: str) -> WordIds:
    """The cache of this worker process."""
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")
