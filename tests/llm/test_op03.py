import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lever.llm import op03_brown as op03
from tests.llm.helpers import DOC, frame, rng, words

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(r, n):
    """Two languages, with word pairs that follow each other."""
    texts = []
    for i in range(n):
        lang = i % 2
        w = []
        for _ in range(r.randrange(5, 80)):
            w.append(f"{'AB'[lang]}{int(r.paretovariate(0.6)) % 3000}{r.choice(['', '', ',', '.'])}")
            if r.random() < 0.3:
                w.append(f"{'ab'[lang]}pair")
        texts.append(" ".join(w))
    return texts


def scored(spark, texts, how):
    docs = frame(spark, texts).withColumn("held_out", op03.held_out(F.col("doc_id")))
    model = op03.train(docs.filter("NOT held_out").select(F.col("doc_id").alias("id"), "text"), how)
    return model, {x.doc_id: x for x in op03.score(docs, model, extra=("held_out",)).collect()}


def test_base_equals_brute_force_and_classes_help(spark):
    texts = corpus(rng(), 600) + ["", None, "\x0b\x1c É\xa0x"]
    how = op03.Brown(exchange_words=60, classes=6, broadcast_words=200, flush=50)
    model, got = scored(spark, texts, how)
    tokens = [re.findall("[^\x20\x09-\x0D]+", (t or "").translate(LOW)) + [None] for t in texts]
    count = Counter()
    for i, t in enumerate(tokens):
        if zlib.crc32(str(i).encode()) % 10:
            count.update(t)
    n, v = sum(count.values()), len(count)
    for i, t in enumerate(tokens):
        x = got[i]
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        assert abs(x.base_score - base) < 1e-9 * max(1, abs(base))
        assert (x.n_tokens, x.n_known, x.train_tokens) == (len(t), sum(count[w] > 0 for w in t), n)
        assert x.held_out == (zlib.crc32(str(i).encode()) % 10 == 0)
    held = [x for x in got.values() if x.held_out]
    assert sum(x.score for x in held) > sum(x.base_score for x in held)
    # where a word is looked up does not change its score
    _, again = scored(spark, texts, op03.Brown(exchange_words=60, classes=6, broadcast_words=100_000))
    assert all(abs(again[i].score - got[i].score) < 1e-7 for i in got)


def test_probabilities_add_up(spark):
    texts = corpus(rng(3), 200)
    model, _ = scored(spark, texts, op03.Brown(exchange_words=40, classes=5, broadcast_words=100))
    total = Counter()
    for w, cls, c in model.top[:model.exchange_words]:
        total[cls] += c
    for r in model.words.collect():
        total[r.cls] += r.c
    assert [total[k] for k in range(len(model.class_tokens))] == model.class_tokens.tolist()
    assert model.class_tokens.sum() == model.tokens
    assert np.allclose((10 ** model.transitions).sum(axis=1), 1)


def brute_scores(model, texts, train):
    """Every token's probability from the classes and plain counts of neighbours in the training texts."""
    cls = {bytes(r.word): r.cls for r in model.words.collect()} | {w: g for w, g, _ in model.top}
    k = len(model.class_tokens) - 1
    seqs = [[w.encode() for w in re.findall("[^\x20\x09-\x0D]+", (t or "").translate(LOW))] for t in texts]
    learnt = [seqs[i] for i in train]
    count = Counter(w for s in learnt for w in s)
    steps, of, once = Counter(), Counter(), Counter()
    for s in learnt:
        for a, b in zip([None, *s], [*s, None]):
            g, h = (k if x is None else cls[x] for x in (a, b))
            steps[g, h] += 1
            of[g] += 1
            once[g] += b is not None and count[b] == 1
    n, v = sum(steps.values()), len(count) + 1
    size = Counter()
    for (g, h), c in steps.items():
        size[h] += c
    p_class = [(size[h] + 0.1) / (n + 0.1 * (k + 1)) for h in range(k + 1)]
    share = (sum(once.values()) + 0.5) / (n + 1)
    pairs, out_of = Counter(), Counter()
    for w in (w for w in count if count[w] == 1):
        for a, b in zip(b" " + w, w + b" "):
            pairs[a, b] += 1
            out_of[a] += 1

    def spelt(w):
        return sum(math.log10((pairs[a, b] + 0.5) / (out_of[a] + 0.5 * (250 if a == 32 else 251))) for a, b in zip(b" " + w, w + b" "))

    scores = []
    for s in seqs:
        total, g = 0.0, k
        for w in [*s, None]:
            unknown = (once[g] + 50 * share) / (of[g] + 50)
            if w is not None and w not in count:
                total, g = total + math.log10(unknown) + spelt(w), k + 1
                continue
            h = k if w is None else cls[w]
            emit = 0.0 if w is None else math.log10(count[w] / size[h])
            total += math.log10((steps[g, h] + 50 * p_class[h]) / (of[g] + 50) * (1 - unknown)) + emit
            g = h
        scores.append(total)
    return scores


def test_scores_equal_brute_force(spark):
    texts = corpus(rng(5), 300) + ["", None, "zz yy A1 xx B2 ww", "A1 qq rr B2"] + corpus(rng(6), 2) * 2
    train = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 10]
    for broadcast in (60, 150, 100_000):  # words looked up by a join, in runs too
        model, got = scored(spark, texts, op03.Brown(exchange_words=50, classes=5, broadcast_words=broadcast, flush=70))
        want = brute_scores(model, texts, train)
        assert all(abs(got[i].score - want[i]) < 1e-7 * max(1, abs(want[i])) for i in got)
        assert len(got) == len(texts)


def test_spelling_adds_up(spark):
    model, _ = scored(spark, corpus(rng(4), 60), op03.Brown(exchange_words=20, classes=4))
    p = 10 ** model.letters
    inside = [b for b in range(256) if b not in (9, 10, 11, 12, 13)]
    assert np.allclose(p[:, inside].sum(axis=1)[[97, 200]], 1)
    assert abs(p[32, [b for b in inside if b != 32]].sum() - 1) < 1e-9


def test_noise_scores_below_shuffled_words_below_text(spark):
    r = rng(8)
    nouns, verbs, ends = ([f"{x}{a}{b}" for a in "aeiou" for b in "lmnrst"] for x in ("kor", "vel", "dim"))
    texts = [" ".join(f"the {r.choice(nouns)} {r.choice(verbs)} a {r.choice(ends)}" for _ in range(30)) for _ in range(200)]
    mixed, noise = texts[0].split(), texts[0].split()
    r.shuffle(mixed)
    noise = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in w) for w in noise]
    model = op03.train(frame(spark, texts[5:]).select(F.col("doc_id").alias("id"), "text"), op03.Brown(classes=6))
    got = {x.doc_id: x.score for x in op03.score(frame(spark, [texts[0], " ".join(mixed), " ".join(noise)]), model).collect()}
    assert got[0] > got[1] > got[2]


def test_repeated_rows_and_other_columns(spark):
    texts = corpus(rng(9), 30)
    docs = frame(spark, [*enumerate(texts), (3, texts[3]), (3, texts[3])]).selectExpr(
        "*", "1 AS word", "'x' AS c", "2 AS `a.b`", "3 AS row", "4 AS id")
    model = op03.train(docs.select(F.col("doc_id").alias("id"), "text"), op03.Brown(exchange_words=20, classes=3))
    rows = op03.score(docs, model).collect()
    assert len(rows) == 32 and len({x.score for x in rows if x.doc_id == 3}) == 1


def test_exchange_finds_planted_classes():
    r = np.random.default_rng(1)
    group = np.arange(30) % 3
    pairs = np.zeros((31, 30), np.int64)
    for a in range(30):
        for b in range(30):
            pairs[a, b] = r.poisson(40 if group[b] == (group[a] + 1) % 3 else 1)
    cls = op03.exchange(pairs, 3, 20)
    assert len({(g, c) for g, c in zip(group, cls)}) == 3


def test_nothing_to_learn_from(spark):
    docs = frame(spark, ["a b", None])
    empty = spark.createDataFrame([], DOC).select(F.col("doc_id").alias("id"), "text")
    model = op03.train(empty)
    rows = op03.score(docs, model).collect()
    assert [(x.n_tokens, x.n_known, x.train_tokens, x.base_score) for x in rows] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert all(math.isfinite(x.score) for x in rows)
    assert op03.score(spark.createDataFrame([], DOC), model).count() == 0


def test_long_text(spark):
    r = rng()
    model, got = scored(spark, [" ".join(words(r, 100_000, 500)), "a"], op03.Brown(exchange_words=20, classes=4))
    assert got[0].n_tokens == 100_001
