import math
from collections import Counter

import numpy as np
from hypothesis import given, settings, strategies as st

from lever.llm import op13_ranked_search as op13
from lever.llm.common import normal_words
from tests.llm.helpers import DOC, frame, rng, words

ITEM = "item_id bigint, text string"


def brute(docs, items, k=20):
    """Every document scored for every item, by the formula alone."""
    bags = [(i, Counter(normal_words((t or "").encode()))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_all, l_all = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for key, text in items:
        asked = normal_words((text or "").encode())
        scored = []
        for i, bag, n in bags:
            m = 100 - 25 + (25 * n * n_all) // l_all
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (10 ** 9 * bag[t] // (1000 * bag[t] + 12 * m))
                    for t in asked if bag[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(key, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return out


def found(spark, rows, items, **kw):
    got = op13.ranked_search(frame(spark, rows), spark.createDataFrame(items, ITEM), **kw).collect()
    return sorted(map(tuple, got), key=str)


def test_equals_brute_force(spark):
    r = rng()
    texts = [" ".join(words(r, r.choice([1, 5, 40, 300]), 120)) for _ in range(400)]
    texts += texts[:60]  # equal texts tie
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    items = [(i, " ".join(words(r, 12, 140) + ["w1", "w1"])) for i in range(15)]
    want = sorted(brute(rows, items), key=str)
    assert found(spark, rows, items) == want
    assert found(spark, rows, items, block_terms=30) == want  # many query blocks, one index each
    assert found(spark, rows, items, k=3) == sorted(brute(rows, items, 3), key=str)


def test_hard_rows(spark):
    r = rng(3)
    long = " ".join(words(r, 30_000, 9_000)) + " Needle"
    rows = [(1, None), (2, ""), (3, "-- !!"), (4, long), (5, "needle"), (5, "needle"), (None, "needle x"), (7, "É é needle2 NEEDLE_x")]
    items = [(1, "needle!"), (1, "needle!"), (2, None), (3, ""), (4, "absent"), (None, "needle x X é")]
    docs = frame(spark, rows).selectExpr("*", "1 AS term", "2 AS `a.b`", "'q' AS query")
    bench = spark.createDataFrame(items, ITEM).selectExpr("*", "1 AS rank", "'x' AS `c.d`", "3 AS score")
    out = op13.ranked_search(docs, bench)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(brute(rows, items), key=str)


def test_empty_tables(spark):
    no_docs, no_items = spark.createDataFrame([], DOC), spark.createDataFrame([], ITEM)
    some = frame(spark, ["a b"])
    assert op13.ranked_search(no_docs, spark.createDataFrame([(1, "a")], ITEM)).collect() == []
    assert op13.ranked_search(some, no_items).collect() == []
    assert op13.ranked_search(frame(spark, [None, ""]), spark.createDataFrame([(1, "a")], ITEM)).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(1, 400), st.integers(0, 70_000)), min_size=1, max_size=400))
def test_lists_survive_packing(postings):
    docs = np.cumsum([gap + 1 + 60_000 * (n % 5 == 0) for gap, _, n in postings])
    tf = np.array([t for _, t, _ in postings], np.int64)
    lengths = np.ones(int(docs[-1]) + 1, np.int64)
    lengths[docs] = [max(t, n) for _, t, n in postings]
    payload, last, ends, best_tf, best_n, best_ends = op13.pack_list(docs, tf, lengths)
    m = 75 + lengths
    own = op13.PostingList(dict(payload=payload, last=last, ends=ends, best_tf=best_tf, best_n=best_n, best_ends=best_ends,
                                df=len(docs)), m, {n: 75 + n for n in best_n})
    got, scores = own.between(0, len(lengths))
    want = op13.part_score(tf, m[docs])
    assert got.tolist() == docs.tolist() and scores.tolist() == want.tolist()
    for b, top in enumerate(own.maxima.tolist()):
        assert top == want[b * op13.BLOCK:(b + 1) * op13.BLOCK].max()  # the block maximum is exact


def test_blocks_are_rejected_unopened():
    """A common term's blocks without a candidate stay packed, and the answer is that of full scoring."""
    r = np.random.default_rng(5)
    n = 20_000
    lengths = r.integers(20, 60, n)
    m = 75 + lengths
    m_of = {int(x): 75 + int(x) for x in lengths}
    lists, weights = {}, [(0, 5), (1, 9000)]
    for t, docs in enumerate((np.arange(n), np.sort(r.choice(n, 60, False)))):
        tf = r.integers(1, 4, len(docs))
        keys = ("payload", "last", "ends", "best_tf", "best_n", "best_ends")
        lists[t] = op13.PostingList(dict(zip(keys, op13.pack_list(docs, tf, lengths)), df=len(docs)), m, m_of)
    full = np.zeros(n, np.int64)
    docs, scores = op13.best_of_shard(lists, n, weights, 20)
    opened = lists[0].ready.mean()
    for t, w in weights:
        d, s = lists[t].between(0, n)
        full[d] += w * s
    want = np.lexsort((np.arange(n), -full))[:20]
    assert docs.tolist() == want.tolist() and scores.tolist() == full[want].tolist()
    assert opened < 0.6
