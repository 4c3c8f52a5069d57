import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lever.llm import op12_set_join as op12
from lever.llm.common import lower_ascii
from tests.llm.helpers import DOC, edited, frame, rng, words


def shingled(text):
    w = lower_ascii((text or "").encode()).split()
    return {tuple(w[i:i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def joined(x, y):
    return bool(x) and bool(y) and 100 * len(x & y) >= 85 * len(x | y)


def brute(rows):
    """(id, set size, least id of the component) of every row, by comparing all pairs of sets."""
    sets = [shingled(t) for _, t in rows]
    own = [{i} for i in range(len(rows))]
    for i in range(len(rows)):
        for j in range(i):
            if own[i] is not own[j] and joined(sets[i], sets[j]):
                own[i] |= own[j]
                for k in own[j]:
                    own[k] = own[i]
    out = []
    for i, (key, _) in enumerate(rows):
        ids = [rows[j][0] for j in own[i] if rows[j][0] is not None] if sets[i] else []
        out.append((key, len(sets[i]), key if not sets[i] else min(ids) if ids else None))
    return sorted(out, key=str)


def found(docs):
    return sorted(map(tuple, op12.linked_documents(docs).collect()), key=str)


def test_equals_brute_force_around_the_threshold(spark):
    r = rng(11)
    rows = []
    for n in (4, 5, 7, 12, 30, 90, 250):
        for _ in range(5):
            base = " ".join(words(r, n))
            rows += [base, base.upper(), base + " " + " ".join(words(r, max(1, n // 8)))]
            rows += [edited(r, base, c) for c in range(1, max(2, n // 16))]
            rows += [" ".join(base.split()[:n - max(1, n // 7)]), " ".join(base.split()[max(1, n // 8):])]
    r.shuffle(rows)
    rows = [(5000 - 3 * i, t) for i, t in enumerate(rows)]
    assert found(frame(spark, rows)) == brute(rows)


def test_copies_unlike_each_other_and_chains(spark):
    """Copies of one original that do not link with each other; a chain whose ends are far apart; a common line."""
    r = rng(5)
    line = " ".join(words(r, 12, 10**6))
    base = words(r, 120, 10**6)
    rows = [" ".join(base)] + [edited(r, " ".join(base), 2) for _ in range(150)]
    w = words(r, 60, 10**6)
    for _ in range(40):
        rows.append(" ".join(w))
        w = w[2:] + words(r, 2, 10**6)
    rows += [line + "\n" + " ".join(words(r, r.randrange(3, 60), 10**6)) for _ in range(150)]
    r.shuffle(rows)
    rows = list(enumerate(rows))
    assert found(frame(spark, rows)) == brute(rows)


def test_hard_rows(spark):
    r = rng(2)
    long = " ".join(words(r, 30_000, 10**6))
    same = "one two three four five six"
    rows = [(1, None), (2, None), (3, ""), (4, " \n\t"), (5, "a b"), (6, "A  b"), (6, "A  b"), (7, "b a"), (None, same), (9, same),
            (None, "only null"), (10, long), (11, long + " tail"), (12, "nul\x00byte of text"), (13, "nul byte of text"), (14, "..."), (15, "...")]
    docs = frame(spark, rows).selectExpr("*", "1 AS node", "2 AS `a.b`", "'q' AS digest", "3 AS n", "4 AS id")
    out = op12.linked_documents(docs)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, out.collect()), key=str) == brute(rows)


def test_empty_tables(spark):
    assert found(spark.createDataFrame([], DOC)) == []
    assert found(frame(spark, [None, ""])) == [(0, 0, 0), (1, 0, 1)]


def test_derived_answers_equal_direct_ones(spark):
    """Members answered from their leader's overlap give what comparing the whole sets gives."""
    r = np.random.default_rng(3)
    base = np.unique(r.integers(0, 1 << 60, 200))
    sets, relations = {0: base}, []
    for i in range(1, 40):
        gone = r.choice(len(base), int(r.integers(0, 9)), False)
        more = np.unique(r.integers(0, 1 << 60, int(r.integers(0, 9))))
        own = np.unique(np.append(np.delete(base, gone), more))
        sets[i] = own
        if i % 2:
            relations.append((i, 0, np.setdiff1d(base, own).tolist(), np.setdiff1d(own, base).tolist()))
    held = spark.createDataFrame([(i, len(s), [int(x) for x in s]) for i, s in sets.items()], "node long, n long, tokens array<long>")
    related = spark.createDataFrame(relations, "node long, leader long, minus array<long>, plus array<long>")
    pairs = spark.createDataFrame([(i, j) for i in sets for j in range(i)], "u long, v long")
    direct = op12.answers(pairs, held).select("u", "v", "common")
    derived = op12.answers(pairs, held, related).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), "common")
    want = {(i, j, len(np.intersect1d(sets[i], sets[j]))) for i in sets for j in range(i)
            if op12.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))}
    assert {tuple(x) for x in direct.collect()} == {tuple(x) for x in derived.collect()} == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=25), min_size=2, max_size=2))
def test_index_place_never_rules_out_a_link(pair):
    """For any order, a linked pair passes the test of sizes and places at its first common shingle."""
    x, y = (sorted(set(p)) for p in pair)
    common = sorted(set(x) & set(y))
    if common and op12.linked(len(common), len(x), len(y)):
        i, j = x.index(common[0]), y.index(common[0])
        assert i <= len(x) - op12.need(len(x)) and j <= len(y) - op12.need(len(y))
        assert 185 * min(len(x) - i, len(y) - j) >= 85 * (len(x) + len(y))
