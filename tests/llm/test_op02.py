from collections import Counter

from lever.llm import op02_token_rollup as op02
from lever.llm.common import scratch
from tests.llm.helpers import frame, rng

EVENTS = "doc_id bigint, tokenizer string, source string, lang string, n_tokens bigint, kind string, seq int"


def totals(store):
    return {(x.source, x.lang, x.tokenizer): (x.n_docs, x.n_tokens) for x in store.totals().collect()}


def apply(state, batch):
    last = {}
    for doc, tok, source, lang, n, kind, seq in batch:
        if doc is not None and tok is not None:
            e = (seq, kind == "delete", n or 0, source, lang)
            key = (doc, tok)
            if key not in last or (e[0], e[1], e[2], e[3] or "", e[4] or "") > (*last[key][:3], last[key][3] or "", last[key][4] or ""):
                last[key] = e
    for key, (_, gone, n, source, lang) in last.items():
        state.pop(key, None)
        if not gone:
            state[key] = (source, lang, n)


def summed(state):
    docs, tokens = Counter(), Counter()
    for (_, tok), (source, lang, n) in state.items():
        docs[source, lang, tok] += 1
        tokens[source, lang, tok] += n
    return {k: (docs[k], tokens[k]) for k in docs}


def test_batches_equal_a_recount(spark):
    r = rng()
    store, state = op02.TokenRollup(spark, scratch(spark, "rollup-test")), {}
    assert totals(store) == {}
    for number in (1, 2, 7):
        batch = [(r.choice([*range(40), None]), r.choice(["t1", "t2"]), r.choice(["a", "a", "b", None]), r.choice(["en", None]),
                  r.choice([0, 5, 90, None]), r.choice(["insert", "revise", "delete", None]), r.randrange(3)) for _ in range(120)]
        frame_ = spark.createDataFrame(batch, EVENTS)
        assert store.commit(number, frame_)
        apply(state, batch)
        assert totals(store) == summed(state)
        assert not store.commit(number, spark.createDataFrame(batch[:3], EVENTS))
        assert totals(store) == summed(state)
    store.commit(8, spark.createDataFrame([], EVENTS))
    assert totals(store) == summed(state) and store.committed() == [1, 2, 7, 8]


def test_a_broken_commit_is_not_seen_and_can_be_repeated(spark):
    path = scratch(spark, "rollup-test")
    store = op02.TokenRollup(spark, path)
    one = spark.createDataFrame([(1, "t", "a", "en", 4, "insert", 0)], EVENTS)
    two = spark.createDataFrame([(1, "t", "b", "en", 9, "revise", 0), (2, "t", "a", "en", 1, "delete", 0)], EVENTS)
    store.commit(1, one)
    # as if a writer had died before its marker
    one.selectExpr("1L AS doc_id", "'x' AS source", "'x' AS lang", "'t' AS tokenizer", "5L AS d_docs", "5L AS d_tokens") \
        .write.parquet(f"{path}/log/batch=2")
    assert totals(store) == {("a", "en", "t"): (1, 4)}
    assert store.commit(2, two)
    assert totals(store) == {("b", "en", "t"): (1, 9)}


def test_counts(spark):
    docs = frame(spark, ["a b\nc\na b\n", "", None])
    got = {x.doc_id: x.counts for x in op02.token_counts(docs, ["words-1", "words-2"]).collect()}
    assert got == {0: [5, 3], 1: [0, 0], 2: [0, 0]}


def test_query_equals_brute_force(spark):
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    from lever.llm.queries import QUERIES
    from lever.llm.word_tokens import default_path

    got = {(x.source, x.lang, x.tokenizer): (x.n_docs, x.n_tokens)
           for x in QUERIES["op2_token_rollup"](spark, "/root/testdata/sf0.001").collect()}
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    tokenizer, first, docs, tokens = Tokenizer.from_file(default_path()), set(), Counter(), Counter()
    for d in sorted(t, key=lambda d: d["doc_id"]):
        if d["text"] in first:
            continue
        first.add(d["text"])
        counts = {"words-1": sum(len(x.encode().split()) for x in dict.fromkeys(d["text"].split("\n"))),
                  "word_bpe_49k": len(tokenizer.encode(d["text"], add_special_tokens=False).ids)}
        for name, n in counts.items():
            docs[d["source"], d["lang"], name] += 1
            tokens[d["source"], d["lang"], name] += n
    assert got == {k: (docs[k], tokens[k]) for k in docs}
