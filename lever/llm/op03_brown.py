"""Language-model scores from a Brown class-based bigram model.

Every training word has one class.  The most frequent ``exchange_words`` words
get theirs by exchange clustering: a word moves to the class where the mutual
information of neighbouring classes grows most, until no word moves.  All other
words, however rare, then get theirs by one exchange step against these: the
class that best explains the classes of frequent words that they follow.

    P(word | word before) = P(class | class of the word before) * P(word | class)

Transitions count every two neighbouring training words, frequent or not, and
are smoothed towards class frequencies; emission is a word's share of its class.
The end of a text is a class of its own, which is also what a text starts after.
An unknown word has the share that words seen once have after the same class,
times the probability of its spelling (byte bigrams of the words seen once), so
all words that could stand there share that mass.  After an unknown word the
class frequencies alone count.

Counts cover all training words.  What tasks hold is bounded: the frequent
words' pair counts (``exchange_words`` squared), and the ``broadcast_words``
most frequent words; all other words are looked up by a join, so the limits
change where a word is looked up, never its score.

Null and empty texts have the end token alone.  Repeated rows count and are
scored each on its own.  With no training text, every token is unknown.  Texts
are read in blocks of a megabyte, a longer one as a whole.  Columns other than
the id, the text and ``extra`` are ignored, whatever their names.
Tokens are lower-cased (A-Z) words between ASCII white space.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lever.llm.common import byte_values, col, lower_ascii, text_blocks, tidied, written

END = b""  # no word is empty
_BYTES = 250  # that a word can hold: all but the white space


@dataclass(frozen=True)
class Brown:
    exchange_words: int = 1000
    classes: int = 32
    rounds: int = 20
    broadcast_words: int = 200_000
    #: weight, in tokens, of class frequencies in a history's transitions
    smoothing: float = 50.0
    flush: int = 400_000  # entries that a task counts before it passes them on


def tokens(text: bytes | None) -> list[bytes]:
    return lower_ascii(text).split() if text else []


def _counts(docs: DataFrame, how: Brown) -> DataFrame:
    """(word, c) of the training texts (id, text); the end token is the empty word."""
    def run(batches):
        found: Counter = Counter()
        for batch in batches:
            texts = byte_values(batch, "text")
            found[END] += len(texts)
            for text in texts:
                found.update(tokens(text))
                if len(found) > how.flush:
                    yield _rows(found)
                    found = Counter()
        if found:
            yield _rows(found)

    def _rows(found):
        return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())],
                                          names=["word", "c"])

    return docs.mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def _coded(texts: list[bytes | None], place: dict[bytes, int]):
    """(words, ids, bounds, ends): ids of the words (-1: none), the texts' bounds."""
    words = [tokens(t) for t in texts]
    bounds = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=bounds[1:])
    ids = np.fromiter((x for w in words for x in map(place.get, w, repeat(-1))), np.int32, bounds[-1])
    return words, ids, bounds


def _pairs(docs: DataFrame, frequent: list[bytes]) -> DataFrame:
    """(a, b, n): how often frequent word b is the next frequent one after a; a = len(frequent): none before b."""
    m = len(frequent)
    place = {w: i for i, w in enumerate(frequent)}

    def run(batches):
        total = np.zeros((m + 1) * m, np.int64)
        for _, texts in text_blocks(batches, "id", "text"):
            _, ids, bounds = _coded(texts, place)
            at = np.flatnonzero(ids >= 0)
            if not len(at):
                continue
            doc = np.searchsorted(bounds, at, "right")
            before = np.full(len(at), m, np.int64)
            same = doc[1:] == doc[:-1]
            before[1:][same] = ids[at[:-1]][same]
            total += np.bincount(before * m + ids[at], minlength=len(total))
        seen = np.flatnonzero(total)
        for part in np.array_split(seen, len(seen) // 10_000 + 1):
            yield pa.RecordBatch.from_arrays([pa.array(part // max(m, 1)), pa.array(part % max(m, 1)),
                                              pa.array(total[part])], names=["a", "b", "n"])

    return docs.mapInArrow(run, "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))


def exchange(pairs: np.ndarray, classes: int, rounds: int) -> np.ndarray:
    """Classes of m words by exchange clustering; ``pairs`` (m + 1, m) counts followers, the last row the starts.

    Maximises the sum over class pairs of N(g, h) log N(g, h) less the margins'
    terms, moving one word at a time, most frequent first.
    """
    m = pairs.shape[1]
    k = min(classes, m)
    if not m:
        return np.zeros(0, np.int64)
    counts = pairs[:m].astype(np.float64)
    cls = np.arange(m) % k
    starts = pairs[m].astype(np.float64)

    def xlogx(x):
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)

    def table():
        one = np.zeros((m, k))
        one[np.arange(m), cls] = 1
        return one.T @ counts @ one, np.array([starts[cls == g].sum() for g in range(k)])

    both, begun = table()
    for _ in range(rounds):
        moved = 0
        for w in range(m):
            g = cls[w]
            out = np.bincount(cls, weights=counts[w], minlength=k)  # classes that follow w
            into = np.bincount(cls, weights=counts[:, w], minlength=k)
            loop = counts[w, w]
            out[g] -= loop
            into[g] -= loop
            base = both.copy()
            base[g] -= out
            base[:, g] -= into
            base[g, g] -= loop
            start = begun.copy()
            start[g] -= starts[w]
            rows, cols = base.sum(axis=1), base.sum(axis=0) + start
            # what changes when w joins class j: row j, column j, cell (j, j), the margins
            inner = xlogx(base + out[None, :]).sum(axis=1) - xlogx(base).sum(axis=1) \
                + xlogx(base + into[:, None]).sum(axis=0) - xlogx(base).sum(axis=0)
            d = np.diag(base)
            inner += xlogx(d) - xlogx(d + out) - xlogx(d + into) + xlogx(d + out + into + loop)
            inner += xlogx(start + starts[w]) - xlogx(start)
            leave, enter = out.sum() + loop, into.sum() + loop + starts[w]
            margins = xlogx(rows + leave) - xlogx(rows) + xlogx(cols + enter) - xlogx(cols)
            gain = inner - margins
            best = int(np.argmax(gain))
            if gain[best] > gain[g] + 1e-6:
                cls[w] = best
                moved += 1
            else:
                best = g
            both, begun = base, start
            both[best] += out
            both[:, best] += into
            both[best, best] += loop
            begun[best] += starts[w]
        if not moved:
            break
    return cls


def _histories(ids: np.ndarray, bounds: np.ndarray, cls: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """History of each word and of each text's end: a class, or len(classes) before any frequent word."""
    none = int(cls.max()) + 1 if len(cls) else 0
    n = len(ids)
    frequent = (ids >= 0) & (ids < m)
    last = np.maximum.accumulate(np.where(frequent, np.arange(n), -1)) if n else np.zeros(0, np.int64)
    reach = np.concatenate([[-1], last])  # reach[i]: the last frequent word before place i

    def of(at, first):
        r = reach[at]
        ok = r >= first
        out = np.full(len(at), none, np.int64)
        out[ok] = cls[ids[r[ok]]]
        return out

    return of(np.arange(n), np.repeat(bounds[:-1], np.diff(bounds))), of(bounds[1:], bounds[:-1])


def _contexts(docs: DataFrame, top: list[tuple[bytes, int]], cls: np.ndarray, how: Brown) -> DataFrame:
    """(word, h, n): how often each but the frequent words, and the end, follows histories h (arrays, a row per task and
    word, or more).  ``top`` starts with the frequent words, whose classes ``cls`` are."""
    spark = docs.sparkSession
    m, k = len(cls), int(cls.max()) + 1 if len(cls) else 0
    shared = spark.sparkContext.broadcast([w for w, _ in top])

    def rows(words, sizes, h, n):
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(h, pa.int32())),
             pa.ListArray.from_arrays(offsets, pa.array(n, pa.int64()))], names=["word", "h", "n"])

    def single(found):
        words, histories = zip(*found)
        return rows(words, np.ones(len(words), np.int64), histories, list(found.values()))

    def run(batches):
        names = shared.value
        place = {w: i for i, w in enumerate(names)}
        listed = np.zeros(len(names) * (k + 1), np.int32)  # by word and history
        found: Counter = Counter()
        for _, texts in text_blocks(batches, "id", "text", 1 << 20):
            words, ids, bounds = _coded(texts, place)
            inner, ends = _histories(ids, bounds, cls, m)
            at = np.flatnonzero(ids >= m)
            np.add.at(listed, ids[at].astype(np.int64) * (k + 1) + inner[at], 1)
            rest = np.flatnonzero(ids < 0)
            flat = [w for ws in words for w in ws]
            found.update(zip(map(flat.__getitem__, rest.tolist()), inner[rest].tolist()))
            found.update(zip(repeat(END), ends.tolist()))
            if len(found) > how.flush:
                yield single(found)
                found = Counter()
        if found:
            yield single(found)
        for start in range(0, len(listed), 10_000 * (k + 1)):
            cells = np.flatnonzero(listed[start:start + 10_000 * (k + 1)]) + start
            if len(cells):
                word, first = np.unique(cells // (k + 1), return_index=True)
                yield rows([names[i] for i in word], np.diff(np.append(first, len(cells))), cells % (k + 1), listed[cells])

    return docs.mapInArrow(tidied(run), "word binary, h array<int>, n array<bigint>")


def _assigned(contexts: DataFrame, follow: np.ndarray) -> DataFrame:
    """(word, cls, c) of each word of ``contexts``: the best class of one exchange step; the end has class k."""
    k = follow.shape[1]
    share = follow.sum(axis=0) + 0.5
    weight = np.log((follow + 0.5) / share[None, :])  # log P(history | class), up to a constant
    weight -= np.log((follow + 0.5).sum(axis=0) / share)[None, :]

    def part(words, sizes, h, n):
        word = np.array(words, object)
        fresh = np.concatenate([[True], word[1:] != word[:-1]])
        first, which = np.flatnonzero(fresh), np.repeat(np.cumsum(fresh) - 1, sizes)
        c = np.bincount(which, n, len(first)).astype(np.int64)
        score = np.zeros((len(first), k))
        for j in range(k):
            score[:, j] = np.bincount(which, n * weight[h, j], len(first))
        cls = score.argmax(axis=1)
        cls[word[first] == END] = k
        return pa.RecordBatch.from_arrays([pa.array(word[first], pa.binary()), pa.array(cls.astype(np.int32)), pa.array(c)],
                                          names=["word", "cls", "c"])

    def run(batches):
        none = np.zeros(0, np.int64)
        held: tuple = ([], none, none, none)  # the last word's rows: the next batch may go on with them
        for batch in batches:
            if not batch.num_rows:
                continue
            words = held[0] + byte_values(batch, "word")
            lists = batch.column("h")
            sizes = np.concatenate([held[1], np.diff(lists.offsets.to_numpy())])
            h = np.concatenate([held[2], lists.flatten().to_numpy()]).astype(np.int64)
            n = np.concatenate([held[3], batch.column("n").flatten().to_numpy()]).astype(np.int64)
            cut = len(words) - 1
            while cut and words[cut - 1] == words[-1]:
                cut -= 1
            at = int(sizes[:cut].sum())
            if cut:
                yield part(words[:cut], sizes[:cut], h[:at], n[:at])
            held = _summed(words[-1], h[at:], n[at:], len(follow))
        if held[0]:
            yield part(*held)

    sorted_rows = contexts.repartition("word").sortWithinPartitions("word")
    return sorted_rows.mapInArrow(run, "word binary, cls int, c bigint")


def _summed(word: bytes, h: np.ndarray, n: np.ndarray, size: int) -> tuple:
    total = np.bincount(h, n, size).astype(np.int64)
    at = np.flatnonzero(total)
    return [word], np.array([len(at)]), at, total[at]


def _steps(ids: np.ndarray, bounds: np.ndarray, cls: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, history, text) of all words and ends in order; -1 where a word is not listed, so a join has to tell.
    A text starts after class k, that of the end before it."""
    size = len(bounds) - 1
    own = np.full(len(ids) + size, k, np.int64)
    doc = np.repeat(np.arange(size), np.diff(bounds) + 1)
    word = np.ones(len(own), bool)
    word[bounds[1:] + np.arange(size)] = False
    own[word] = np.where(ids >= 0, cls[ids] if len(cls) else -1, -1)
    return own, np.concatenate([[k], own[:-1]]), doc


def _looked_up(rest: DataFrame, words: DataFrame, unknown: int) -> DataFrame:
    """``rest`` (row, pos, word, before, after, ...) with c, its class g (or ``unknown``) and its history h: ``before``,
    or where that is -1 the class of the unlisted word directly before it."""
    found = rest.join(words, "word", "left") \
        .withColumn("g", F.when(F.col("c").isNotNull(), F.col("cls")).otherwise(unknown))
    last = F.lag("g").over(Window.partitionBy("row").orderBy("pos"))
    return found.withColumn("h", F.when(F.col("before") >= 0, F.col("before")).otherwise(last))


def _transitions(docs: DataFrame, words: DataFrame, top: list, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of (class before, class) over all neighbouring words, and how often a word seen once follows each class."""
    shared = docs.sparkSession.sparkContext.broadcast(top)

    def rows(cells, n, once, rest=None):
        r = rest or ([], [], [], [], [])
        pad = len(r[0])
        return pa.RecordBatch.from_arrays(
            [pa.array([*cells.tolist(), *[None] * pad], pa.int32()), pa.array([*n.tolist(), *[0] * pad], pa.int64()),
             pa.array([*once.tolist(), *[0] * pad], pa.int64())]
            + [pa.array([*[None] * len(cells), *x], t) for x, t in zip(r, (pa.int64(), pa.int32(), pa.binary(), pa.int32(),
                                                                            pa.int32()))],
            names=["cell", "n", "seen_once", "row", "pos", "word", "before", "after"])

    def run(batches):
        place = {w: i for i, (w, _, _) in enumerate(shared.value)}
        cls = np.array([g for _, g, _ in shared.value], np.int64)
        rare = np.array([c == 1 for _, _, c in shared.value], bool)
        total, once = np.zeros((k + 1) ** 2, np.int64), np.zeros((k + 1) ** 2, np.int64)
        none = np.zeros(0, np.int64)
        number = TaskContext.get().partitionId() << 40
        for _, texts in text_blocks(batches, "id", "text", 1 << 20):
            words, ids, bounds = _coded(texts, place)
            own, before, doc = _steps(ids, bounds, cls, k)
            cell = before * (k + 1) + own
            told = (own >= 0) & (before >= 0)
            total += np.bincount(cell[told], minlength=len(total))
            if rare.any():
                seen = np.zeros(len(own), bool)
                seen[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), np.diff(bounds))] = (ids >= 0) & rare[ids]
                once += np.bincount(cell[told & seen], minlength=len(total))
            at = np.flatnonzero(own < 0)
            if len(at):
                flat = [w for ws in words for w in ws]
                yield rows(none, none, none, ((doc[at] + number).tolist(), at.tolist(),
                                              [flat[i] for i in np.flatnonzero(ids < 0)], before[at].tolist(),
                                              own[at + 1].tolist()))
            number += len(texts)
        cells = np.flatnonzero(total)
        yield rows(cells, total[cells], once[cells])

    found = written(docs.mapInArrow(tidied(run), "cell int, n bigint, seen_once bigint, row bigint, pos int, word binary, "
                                                 "before int, after int"), "steps")
    told = found.filter("cell IS NOT NULL").select((F.col("cell") / (k + 1)).cast("int").alias("h"),
                                                   (F.col("cell") % (k + 1)).alias("g"), "n", "seen_once")
    rest = _looked_up(found.filter("cell IS NULL").select("row", "pos", "word", "before", "after"), words, k)
    one = F.lit(1).cast("long")
    rest = rest.select(F.inline(F.array(
        F.struct("h", "g", one.alias("n"), (F.col("c") == 1).cast("long").alias("seen_once")),
        F.struct(F.col("g").alias("h"), F.col("after").alias("g"), one.alias("n"), F.lit(0).cast("long").alias("seen_once"))))) \
        .filter("g >= 0")
    sums, once = np.zeros((k + 1, k + 1), np.int64), np.zeros(k + 1, np.int64)
    for r in told.unionByName(rest).groupBy("h", "g").agg(F.sum("n").alias("n"), F.sum("seen_once").alias("o")).collect():
        sums[r.h, r.g] += r.n
        once[r.h] += r.o
    return sums, once


def _spelling(counts: DataFrame) -> np.ndarray:
    """log10 P(byte | byte before) of the words seen once; the space stands before and after a word."""
    def run(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            words = byte_values(batch, "word")
            if words:
                read = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.int64)
                total += np.bincount(read[:-1] << 8 | read[1:], minlength=1 << 16)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    once = counts.filter((F.col("c") == 1) & (F.col("word") != F.lit(END))).select("word")
    table = np.zeros((256, 256))
    for r in once.mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        table[r.pair >> 8, r.pair & 255] = r.n  # at most 2^16 rows
    options = np.full((256, 1), _BYTES + 1.0)
    options[32] = _BYTES  # no word is empty
    return np.log10((table + 0.5) / (table.sum(axis=1, keepdims=True) + 0.5 * options))


def _spelt(words: list[bytes], letters: np.ndarray) -> np.ndarray:
    if not words:
        return np.zeros(0)
    read = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    return np.add.reduceat(letters[read[:-1], read[1:]], np.concatenate([[0], np.cumsum(sizes)[:-1]]))


@dataclass
class Model:
    """What scoring needs: the words' table, and bounded arrays."""
    words: DataFrame  # (word, cls, c) of all but the frequent words
    top: list  # (word, cls, c) of the most frequent words, the exchange words first
    exchange_words: int
    transitions: np.ndarray  # log10 P(class | class before); the last row and column: an unknown word
    letters: np.ndarray  # log10 P(byte | byte before) of an unknown word
    class_tokens: np.ndarray
    tokens: int
    distinct: int
    ends: int


def _most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """At most ``most`` words, most frequent first, and no less frequent word than any left out.

    A histogram of log counts (some thousand bins at most) says from which count
    on; so the driver gets these words only, not so many from every task.
    """
    level = F.floor(F.log2("c") * 64)
    total, least = 0, None
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r.level):
        total += r["count"]
        if total > most:
            break
        least = r.level
    if least is None:
        return []
    return sorted(((bytes(r.word), r.c) for r in counts.filter(level >= least).collect()), key=lambda x: (-x[1], x[0]))


def train(docs: DataFrame, how: Brown = Brown()) -> Model:
    """The model of ``docs`` (id, text)."""
    counts = written(_counts(docs, how), "word-counts")
    total = counts.agg(F.sum("c"), F.count("*"), F.sum(F.when(F.col("word") == F.lit(END), F.col("c")))).first()
    n_tokens, distinct, ends = total[0] or 0, total[1], total[2] or 0
    top = _most_frequent(counts.filter(F.col("word") != F.lit(END)), how.broadcast_words)
    frequent = [w for w, _ in top[:how.exchange_words]]
    m = len(frequent)
    pairs = np.zeros((m + 1, m), np.int64)
    for r in _pairs(docs, frequent).toLocalIterator():
        pairs[r.a, r.b] = r.n
    cls = exchange(pairs, how.classes, how.rounds)
    k = int(cls.max()) + 1 if m else 1
    one = np.zeros((m, k), np.int64)
    one[np.arange(m), cls] = 1
    # from a class, or from none, to a class: frequent words
    follow = np.vstack([one.T @ pairs[:m] @ one, (pairs[m] @ one)[None, :]]) if m else np.zeros((1, 1), np.int64)

    words = written(_assigned(_contexts(docs, top, cls, how), follow.astype(np.float64)), "word-classes")
    table = dict(zip(frequent, cls.tolist()))
    rest = [w for w, _ in top[m:]]
    if rest:
        spark = docs.sparkSession
        names = spark.createDataFrame([(bytearray(w),) for w in rest], "word binary")  # at most broadcast_words
        table |= {bytes(r.word): r.cls for r in words.join(names, "word").select("word", "cls").collect()}
    listed = [(w, table[w], c) for w, c in top]
    sums, once = _transitions(docs, words, listed, k)
    of_class, of_history = sums.sum(axis=0), np.append(sums.sum(axis=1), 0)
    sums, once = np.vstack([sums, np.zeros((1, k + 1), np.int64)]), np.append(once, 0)
    class_p = (of_class + 0.1) / (of_class.sum() + 0.1 * len(of_class))
    unknown = (once.sum() + 0.5) / (n_tokens + 1)
    unknown = (once + how.smoothing * unknown) / (of_history + how.smoothing)
    unknown = np.clip(unknown, 1e-9, 0.5)
    p = (sums + how.smoothing * class_p[None, :]) / (of_history + how.smoothing)[:, None]
    transitions = np.log10(np.column_stack([p * (1 - unknown)[:, None], unknown]))
    if not ends:
        transitions[:, k] = transitions[:, -1]
    return Model(words, listed, m, transitions, _spelling(counts), of_class, n_tokens, distinct, ends)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", extra: tuple = ()) -> DataFrame:
    """(id, extra, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``."""
    spark = docs.sparkSession
    source = docs.select(col(id_col).alias("id"), *[col(c) for c in extra], col(text_col).cast("string").alias("text"))
    arrow = to_arrow_schema(source.schema)
    shared = spark.sparkContext.broadcast((model.top, model.transitions, model.letters, model.class_tokens))
    k = len(model.class_tokens) - 1
    n, v, ends = model.tokens, model.distinct, model.ends
    floor = np.log10(n + 0.1 * (v + 1))
    carried = ["id", *extra]

    def run(batches):
        top, transitions, letters, class_tokens = shared.value
        place = {w: i for i, (w, _, _) in enumerate(top)}
        cls = np.array([c for _, c, _ in top], np.int64)
        count = np.array([c for _, _, c in top], np.float64)
        emit = np.log10(count / class_tokens[cls]) if len(top) else count
        base = np.log10(count + 0.1)
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            numbered = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows)), batch.column("text")], ["id", "text"])
            for rows, texts in text_blocks([numbered], "id", "text", 1 << 20):
                words, ids, bounds = _coded(texts, place)
                size = len(texts)
                own, before, doc = _steps(ids, bounds, cls, k)
                told = np.flatnonzero((own >= 0) & (before >= 0))
                s = np.bincount(doc[told], transitions[before[told], own[told]], size).astype(np.float64)
                known = np.flatnonzero(ids >= 0)
                i, d = ids[known], np.repeat(np.arange(size), np.diff(bounds))[known]
                b = np.zeros(size)
                if len(i):
                    s = s + np.bincount(d, emit[i], size)
                    b = np.bincount(d, base[i], size)
                b = b + np.log10(ends + 0.1) - (np.diff(bounds) + 1) * floor
                at = np.flatnonzero(own < 0)
                rest = np.flatnonzero(ids < 0)
                flat = [w for ws in words for w in ws]
                rest_words = [flat[j] for j in rest]
                offsets = pa.array(np.searchsorted(rest, bounds).astype(np.int32))
                part = batch.slice(rows[0], size)

                def lists(values, kind):
                    return pa.ListArray.from_arrays(offsets, pa.array(values, kind))

                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in carried]
                    + [pa.array(np.arange(number, number + size)), pa.array(np.diff(bounds) + 1),
                       pa.array(np.bincount(d, minlength=size) + int(ends > 0)), pa.array(b), pa.array(s),
                       lists(rest_words, pa.binary()), lists(before[at], pa.int32()), lists(own[at + 1], pa.int32()),
                       lists(_spelt(rest_words, letters), pa.float64())],
                    names=[*carried, "row", "n_tokens", "n_known", "base_part", "score_part", "word", "before", "after",
                           "spelt"])
                number += size

    fields = ", ".join([f"`{f.name}` {source.schema[f.name].dataType.simpleString()}" for f in arrow if f.name != "text"]
                       + ["row bigint, n_tokens bigint, n_known bigint, base_part double, score_part double, "
                          "word array<binary>, before array<int>, after array<int>, spelt array<double>"])
    parts = written(source.mapInArrow(tidied(run), fields), "scored")

    # the rest, by a join with the counts
    cells = F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in model.transitions])
    class_logs = F.array(*[F.lit(float(np.log10(max(x, 1)))) for x in model.class_tokens])
    rest = parts.filter("size(word) > 0").select("row", F.posexplode(F.arrays_zip("word", "before", "after", "spelt"))) \
        .select("row", "pos", "col.*")
    rest = _looked_up(rest, model.words, k + 1)

    def step(h, g):
        return F.element_at(F.element_at(cells, F.col(h) + 1), F.col(g) + 1)

    emit = F.when(F.col("c").isNotNull(), F.log10(F.col("c").cast("double"))
                  - F.element_at(class_logs, F.coalesce("cls", F.lit(0)) + 1)).otherwise(F.col("spelt"))
    after = F.when(F.col("after") >= 0, F.element_at(F.element_at(cells, F.col("g") + 1), F.greatest("after", F.lit(0)) + 1))
    more = rest.groupBy("row").agg(
        F.count("c").alias("more_known"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("more_base"),
        F.sum(step("h", "g") + emit + F.coalesce(after, F.lit(0.0))).alias("more_score"))
    zero = F.lit(0.0)
    return parts.drop("word", "before", "after", "spelt").join(more, "row", "left").select(
        F.col("id").alias(id_col), *[F.col(c) for c in extra], "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_part") + F.coalesce("more_base", zero)).alias("base_score"),
        (F.col("score_part") + F.coalesce("more_score", zero)).alias("score"))


def held_out(id_column: Column) -> Column:
    """The folds of the query: every tenth, by the CRC-32 of the id as text."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 10 == 0, F.lit(False))
