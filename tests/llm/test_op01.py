from collections import defaultdict

from hypothesis import given, settings, strategies as st

from lever.llm import op01_order_minhash as op01
from lever.llm.common import normal_words
from lever.llm.linking import classes, components
from tests.llm.helpers import DOC, edited, frame, rng, words


def brute(rows):
    """doc id -> least id of its class, by checking every pair that shares a shingle."""
    first = {}
    for i, t in sorted(rows):
        first.setdefault(t, i)
    shared, pairs = defaultdict(list), set()
    for t, i in first.items():
        for k in set(op01.kmers(normal_words(t.encode()))):
            shared[k].append(i)
    for v in shared.values():
        pairs |= {(a, b) for a in v for b in v if a < b}
    parent = {i: i for i in first.values()}
    text = {i: t.encode() for t, i in first.items()}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in sorted(pairs):
        if op01.similar(text[a], text[b]):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {i: find(first[t]) for i, t in rows}


def lcs(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, best[j + 1] = best[j + 1], before + 1 if x == y else max(best[j + 1], best[j])
    return best[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abcd", max_size=30), st.text("abcd", max_size=30))
def test_alignment_is_the_longest_common_subsequence(a, b):
    assert op01.aligned(list(a), list(b), 60) == lcs(a, b)


def test_classes_equal_brute_force(spark):
    r = rng()
    rows = []
    passage = " ".join(words(r, 40))
    for _ in range(40):  # families around the threshold, of all lengths
        base = " ".join(words(r, r.choice([6, 9, 20, 38, 60, 200, 500])))
        rows.append(base)
        for _ in range(r.randrange(4)):
            rows.append(edited(r, base, min(len(base.split()), r.choice([0, 1, 1, 2, 3, 8]))))
    rows += [passage + " " + " ".join(words(r, 80)) for _ in range(60)]  # share a passage, not more
    big = " ".join(words(r, 120))
    rows += [big] * 30 + [edited(r, big, 1) for _ in range(80)]
    rows = list(enumerate(rows))
    r.shuffle(rows)
    got = {x.doc_id: x.class_id for x in op01.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_original_with_copies_unlike_each_other(spark):
    r = rng()
    base = " ".join(words(r, 120, 10**6))
    texts = [edited(r, base, 2) for _ in range(1000)]
    texts.insert(500, base)  # neither the least nor the greatest id
    alike = [i for i, t in enumerate(texts) if op01.similar(base.encode(), t.encode())]
    assert len(alike) > 900  # edits that lie close together take fewer k-mers, those far apart just what the threshold allows
    got = {x.doc_id: x.class_id for x in op01.near_duplicates(frame(spark, texts)).collect()}
    # a pair at the threshold agrees in fewer than AGREE sketches once in a thousand times
    assert sum(got[i] != got[500] for i in alike) <= 3


def test_every_candidate_pair_is_checked(spark):
    # one bucket, six stars: leaves are like their centre only, which no order of the ids puts first
    r, ids = rng(), [i * 7919 for i in range(1, 601)]
    r.shuffle(ids)
    star = {i: n % 6 for n, i in enumerate(ids)}
    centre = {s: next(i for i in ids[300:] if star[i] == s) for s in range(6)}
    keyed = spark.createDataFrame([(i, [5]) for i in ids], "id bigint, keys array<bigint>")

    def contents(wanted):
        return wanted.selectExpr("id", "cast(cast(id as string) as binary) AS content")

    def similar(a, b):
        a, b = int(a), int(b)
        return star[a] == star[b] and centre[star[a]] in (a, b)

    got = {x.id: x.root for x in classes(keyed, contents, similar).collect()}
    least = {s: min(i for i in ids if star[i] == s) for s in range(6)}
    assert got == {i: least[star[i]] for i in ids}


def test_order_counts(spark):
    r = rng()
    blocks = [" ".join(words(r, 50)) for _ in range(4)]
    a, b = " ".join(blocks), " ".join(blocks[2:] + blocks[:2])  # the same shingles, moved
    assert not op01.similar(a.encode(), b.encode())
    assert op01.similar(a.encode(), a.upper().encode())


def test_odd_rows(spark):
    r = rng()
    text, long = " ".join(words(r, 50)), " ".join(words(r, 60_000, 10**6))
    rows = [(5, text), (5, text), (9, text.upper()), (1, None), (2, None), (3, ""), (4, ""), (6, "!!"), (7, "??"),
            (None, text), (None, "all alone here"), (8, long), (10, edited(r, long, 3)), (5, "another text of the same id")]
    docs = frame(spark, rows).selectExpr("*", "'d' AS digest", "1 AS id", "2 AS `_slot`", "3 AS `c0`")
    got = defaultdict(set)
    for x in op01.near_duplicates(docs).collect():
        got[x.doc_id].add(x.class_id)
    assert got == {5: {5}, 9: {5}, 1: {1}, 2: {2}, 3: {3}, 4: {3}, 6: {6}, 7: {7}, None: {5, None}, 8: {8}, 10: {8}}
    kept = op01.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(((x.doc_id or 0, (x.text or "")[:20]) for x in kept.collect())) == sorted(
        [(5, text[:20]), (1, ""), (2, ""), (3, ""), (6, "!!"), (7, "??"), (0, "all alone here"), (8, long[:20]),
         (5, "another text of the ")])


def test_components(spark):
    r = rng()
    edges = [(i, i + 1) for i in range(300)] + [(1000, x) for x in range(1001, 1300)] + [(5000, 5000)]
    r.shuffle(edges)
    found = {x.id: x.root for x in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert found == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1300)}


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOC)
    assert op01.near_duplicates(docs).count() == 0 and op01.deduplicated(docs).count() == 0
