import hashlib

from hypothesis import given, settings, strategies as st

from lever.llm import op08_decontaminate as op08
from lever.llm.common import normal_words
from tests.llm.helpers import DOC, frame, rng, words

ITEM = "item_id bigint, text string"


def brute(doc, items, window):
    hit, found = set(), set()
    for key, item in items:
        size = min(window, len(item))
        for i in range(len(item) - size + 1 if item else 0):
            for j in range(len(doc) - size + 1):
                if doc[j:j + size] == item[i:i + size]:
                    hit |= set(range(j, j + size))
                    found.add(key)
    return hit, found


word = st.sampled_from([b"a", b"b", b"c", b"d"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(word, max_size=9), max_size=4), st.lists(st.lists(word, max_size=30), max_size=3))
def test_automaton_equals_brute_force(items, docs):
    items = [(str(i), w) for i, w in enumerate(items)]
    found = op08.find_hits(op08.ItemAutomaton(items, 4), [b" ".join(d) for d in docs])
    for d, (n, spans, names, longest) in zip(docs, found):
        hit, want = brute(d, items, 4)
        assert n == len(d) and names == want
        assert {p for a, b in spans for p in range(a, b)} == hit


def test_blocks_change_nothing(spark):
    r = rng()
    items = [(i, " ".join(words(r, r.choice([3, 12, 40]), 300))) for i in range(25)]
    texts = [" ".join(words(r, 50) + items[i % 25][1].split()[:15] + words(r, 20)) for i in range(40)]
    docs, bench = frame(spark, texts), spark.createDataFrame(items, ITEM)
    one = op08.digests(op08.contamination(docs, bench)).orderBy("doc_id").collect()
    many = op08.digests(op08.contamination(docs, bench, block_words=60)).orderBy("doc_id").collect()
    assert [x[:6] for x in one] == [x[:6] for x in many]
    coded = [(str(i), normal_words(t.encode())) for i, t in items]
    for row, text in zip(one, texts):
        hit, found = brute(normal_words(text.encode()), coded, 10)
        assert (row.n_hit, row.n_items, row.items_sha256) == (len(hit), len(found), op08.listed_digest(found))
        assert row.contaminated == bool(hit)


def test_cuts_passages_and_keeps_the_rest(spark):
    r = rng()
    item = " ".join(words(r, 30))
    before, after = " ".join(words(r, 80)), " ".join(words(r, 80))
    rows = [(1, f"{before}. {item.upper()}! {after}"), (2, before), (3, item), (4, None), (5, ""), (2, before), (None, item)]
    docs = frame(spark, rows).selectExpr("*", "1 AS n_words", "'q' AS items", "2 AS `x.y`")
    out = op08.decontaminate(docs, spark.createDataFrame([(1, item), (2, None), (3, "")], ITEM))
    assert out.columns == docs.columns
    got = sorted(((x.doc_id, x.text, x.n_chars) for x in out.collect()), key=str)
    cut = f"{before}. ! {after}"
    assert got == sorted([(1, cut, len(cut)), (2, before, len(before)), (2, before, len(before)), (4, None, None),
                          (5, "", 0)], key=str)


def test_empty_tables(spark):
    docs, bench = frame(spark, ["a b c"]), spark.createDataFrame([], ITEM)
    row = op08.digests(op08.contamination(docs, bench)).first()
    assert (row.n_words, row.n_hit, row.items_sha256) == (3, 0, hashlib.sha256(b"").hexdigest())
    assert op08.decontaminate(spark.createDataFrame([], DOC), bench).count() == 0


def test_text_positions():
    assert op08.without("é b, c d".encode(), [(1, 3)]) == "é  d".encode()


def test_cutting_in_blocks(spark):
    r = rng(9)
    items = [(i, " ".join(words(r, 20, 300))) for i in range(12)]
    docs = frame(spark, [" ".join(words(r, 60)) + " " + items[i % 12][1] + " " + " ".join(words(r, 60)) for i in range(24)])
    bench = spark.createDataFrame(items, ITEM)
    one, many = (op08.decontaminate(docs, bench, block_words=n).orderBy("doc_id").collect() for n in (10**5, 50))
    assert one == many and all(items[x.doc_id % 12][1] not in x.text for x in one) and len(one) == 24
