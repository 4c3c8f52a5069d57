"""Small documents for the tests."""
import random

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def frame(spark, texts, start=0):
    """documents with these texts (ids from ``start``), or (id, text) pairs."""
    rows = [t if isinstance(t, tuple) else (start + i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], DOC)


def edited(rng, text, changes):
    w = text.split()
    for at in rng.sample(range(len(w)), changes):
        w[at] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def rng(seed=7):
    return random.Random(seed)
