"""Suffix arrays over blocks of word sequences, in numpy."""

from __future__ import annotations

import numpy as np


def word_ids(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds): equal words of one block get equal ids; document i has ids[bounds[i]:bounds[i + 1]]."""
    seen: dict[bytes, int] = {}
    bounds = np.zeros(len(docs) + 1, np.int64)
    np.cumsum([len(d) for d in docs], out=bounds[1:])
    put = seen.setdefault
    ids = np.fromiter((put(w, len(seen)) for d in docs for w in d), np.int64, bounds[-1])
    return ids, bounds


class RepeatArray:
    """Suffix array of a block of sequences, by prefix doubling, with common-prefix lengths.

    Ranks start from (document, word), so no common prefix crosses documents.
    A doubling round sorts only positions whose rank is still shared, so text
    that hardly repeats costs two or three sorts.  ``levels[k]`` ranks prefixes
    of 2**k words; common prefixes of neighbours follow from the levels.
    """

    def __init__(self, ids: np.ndarray, bounds: np.ndarray):
        n = len(ids)
        self.n, self.bounds = n, bounds
        self.doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        self.end = bounds[1:][self.doc] if n else np.zeros(0, np.int64)
        first = self.doc * (int(ids.max()) + 1 if n else 1) + ids
        rank, active = self._refine(np.zeros(n, np.int64), np.arange(n), first)
        self.levels = [rank.astype(np.int32)]
        width = 1
        while len(active):
            ahead = active + width
            inside = ahead < self.end[active]
            second = np.zeros(len(active), np.int64)
            second[inside] = rank[ahead[inside]] + 1
            rank, active = self._refine(rank, active, rank[active] * (n + 1) + second)
            self.levels.append(rank.astype(np.int32))
            width *= 2
        self.order = np.empty(n, np.int64)
        self.order[rank] = np.arange(n)

    @staticmethod
    def _refine(rank: np.ndarray, active: np.ndarray, key: np.ndarray):
        """Ranks after sorting each group of equal ranks by ``key``, which orders groups as ranks do."""
        if not len(active):
            return rank, active
        by = np.argsort(key, kind="stable")
        at, key = active[by], key[by]
        old = rank[at]
        place = np.arange(len(at))
        new_group = np.empty(len(at), bool)
        new_group[0] = True
        old_group = new_group.copy()
        np.not_equal(old[1:], old[:-1], out=old_group[1:])
        np.not_equal(key[1:], key[:-1], out=new_group[1:])
        base = np.maximum.accumulate(np.where(old_group, place, 0))
        start = np.maximum.accumulate(np.where(new_group, place, 0))
        out = rank.copy()
        out[at] = old + start - base
        last = np.append(new_group[1:], True)
        return out, np.sort(at[~(new_group & last)])

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the suffixes at i and j share at their start."""
        i, j = i.copy(), j.copy()
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            rank = self.levels[k]
            ok = (i < self.n) & (j < self.n)
            ii, jj = np.where(ok, i, 0), np.where(ok, j, 0)
            same = ok & (rank[ii] == rank[jj]) & (i != j)
            out[same] += 1 << k
            i[same] += 1 << k
            j[same] += 1 << k
        return out

    def longest(self) -> np.ndarray:
        """For each position: words of the longest run starting there that occurs twice in its document."""
        best = np.zeros(self.n, np.int64)
        if self.n > 1:
            a, b = self.order[:-1], self.order[1:]
            near = np.flatnonzero(self.levels[0][a] == self.levels[0][b])
            a, b = a[near], b[near]
            lcp = self.common(a, b)
            np.maximum.at(best, a, lcp)
            np.maximum.at(best, b, lcp)
        return best

    def covered(self, best: np.ndarray, least: int, width: int | None = None) -> np.ndarray:
        """Per position: does it lie in a repeated run of at least ``least`` words?  With ``width``
        only the first ``width`` words of each run count (windows found twice)."""
        reach = np.where(best >= least, np.arange(self.n) + (best if width is None else width), 0)
        return np.maximum.accumulate(reach) > np.arange(self.n)
