"""Word and shingle hashes of blocks of texts, in numpy."""

from __future__ import annotations

import numpy as np

_WORDS = np.frombuffer(bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0
    for c in range(256)), np.uint8)
#: Words between ASCII white space, A-Z lower-cased; codes from 1, as byte 0 may stand in a word.
SPACED = np.array([0 if c == 0x20 or 0x09 <= c <= 0x0D else 1 + (c + 32 if 0x41 <= c <= 0x5A else c) for c in range(256)],
                  np.uint16)
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of the normalised words of a block of texts, or of those of another ``table`` (0: no part of a word).

    ``hashes[bounds[i]:bounds[i + 1]]`` are those of text i; ``starts`` and
    ``ends`` give each word's bytes within the block, ``offsets`` each text's.
    A word's hash is its polynomial hash, from prefix sums over the block.
    """

    def __init__(self, texts: list[bytes | None], table: np.ndarray = _WORDS):
        joined = b"\n".join(t or b"" for t in texts) + b"\n"
        self.data = joined
        raw = np.frombuffer(joined, np.uint8)
        code = table[raw]
        inside = code != 0
        edge = np.diff(inside.astype(np.int8), prepend=0)
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        n = len(code)
        powers = np.ones(n, np.uint64)
        powers[1:] = _BASE
        np.cumprod(powers, out=powers)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(code * powers, out=total[1:])
        back = np.ones(n, np.uint64)
        back[1:] = _INVERSE
        np.cumprod(back, out=back)
        span = (self.ends - self.starts).astype(np.uint64)
        self.hashes = mixed((total[self.ends] - total[self.starts]) * back[self.starts] + (span << np.uint64(56)))
        sizes = np.array([len(t) if t else 0 for t in texts], np.int64) + 1
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        self.bounds = np.searchsorted(self.starts, self.offsets)


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, bounds): ``width`` words in a row; a sequence of fewer, but not none, is one shingle."""
    n, counts = len(hashes), np.diff(bounds)
    sums = np.zeros(n, np.uint64)
    factors = np.array([pow(0xD1342543DE82EF95, j + 1, 1 << 64) for j in range(width)], np.uint64)
    for j in range(min(width, n)):
        sums[:n - j] += hashes[j:] * factors[j]
    place = np.arange(n) - np.repeat(bounds[:-1], counts)
    whole = place <= np.repeat(counts, counts) - width
    short = (counts > 0) & (counts < width)
    out = mixed(sums)
    for i in np.flatnonzero(short).tolist():
        a, b = bounds[i], bounds[i + 1]
        out[a] = mixed((hashes[a:b] * factors[:b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))[0]
        whole[a] = True
    kept = np.concatenate([[0], np.cumsum(whole)])
    return out[whole], kept[bounds]


def occurrences(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """0 for the first of equal values of one sequence, 1 for the second, and so on."""
    if not len(values):
        return np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(bounds))
    key = mixed(values + owner * _BASE)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    first = np.empty(len(ranked), bool)
    first[0] = True
    np.not_equal(ranked[1:], ranked[:-1], out=first[1:])
    place = np.arange(len(ranked))
    out = np.empty(len(ranked), np.uint64)
    out[order] = (place - np.maximum.accumulate(np.where(first, place, 0))).astype(np.uint64)
    return out


def odd_factors(n: int, seed: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(seed)) | np.uint64(1)


def span_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of the word sequences hashes[starts[i]:ends[i]]."""
    base = int(odd_factors(1, seed)[0])
    n = len(hashes)
    powers, back = np.ones(n + 1, np.uint64), np.ones(n + 1, np.uint64)
    powers[1:], back[1:] = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
    np.cumprod(powers, out=powers)
    np.cumprod(back, out=back)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mixed(hashes ^ np.uint64(seed)) * powers[:-1], out=total[1:])
    return mixed((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def valleys(values: np.ndarray, reach: int) -> np.ndarray:
    """Places whose value is the least of all within ``reach``, the leftmost of equal ones; none near the ends."""
    n = len(values)
    if n < 2 * reach + 1:
        return np.zeros(0, np.int64)
    left = np.lib.stride_tricks.sliding_window_view(values, reach).min(axis=1)  # left[i]: values[i:i + reach]
    at = np.arange(reach, n - reach)
    return at[(values[at] < left[at - reach]) & (values[at] <= left[at + 1])]
