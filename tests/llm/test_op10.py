from hypothesis import given, settings, strategies as st

from lever.llm import op10_repetition as op10
from tests.llm.helpers import DOC, frame, rng, words


def brute(text, limits):
    w = (text or "").split(" ") if text else []
    w = [x for x in w if x]
    n = len(w)

    def covered(size):
        seen = {}
        for i in range(n - size + 1):
            seen.setdefault(tuple(w[i:i + size]), []).append(i)
        return {p for v in seen.values() if len(v) > 1 for i in v for p in range(i, i + size)}

    longest = next((k for k in range(n, 0, -1) if covered(k)), 0)
    return n, len(covered(limits.repeat_window)), len(covered(limits.least_repeat)), longest


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab c d".split()), max_size=60), max_size=5))
def test_measures_equal_brute_force(docs):
    limits = op10.Limits(repeat_window=3, least_repeat=2)
    texts = [" ".join(d) for d in docs]
    found = op10.measure([t.encode() for t in texts], limits)
    for i, t in enumerate(texts):
        got = tuple(int(found[k][i]) for k in ("n_words", "n_repeat_words", "covered_words", "longest_repeat"))
        assert got == brute(t, limits)


def test_characters_symbols_and_lines():
    text = "é#a $\nx\n \nx\x0b\nx\n"
    found = op10.measure([text.encode(), None, b""])
    assert [int(v) for v in found["word_chars"]] == [7, 0, 0]
    assert [int(v) for v in found["n_symbols"]] == [2, 0, 0]
    assert [int(v) for v in found["n_dup_lines"]] == [1, 0, 0]  # "x" twice; "x\x0b" is another line


def test_filter_keeps_clean_rows_as_they_were(spark):
    r = rng()
    clean = " ".join(words(r, 200))
    passage = " ".join(words(r, 60))
    rows = [(1, clean), (1, clean), (2, None), (3, ""), (4, "spam " * 300), (None, clean + " tail"), (5, "few words"),
            (6, passage + " " + " ".join(words(r, 30)) + " " + passage), (7, " ".join(words(r, 30_000, 10**6)))]
    docs = frame(spark, rows).selectExpr("*", "doc_id AS id", "'x' AS kept", "lang AS `a.b`")
    out = op10.quality_filter(docs)
    assert out.columns == docs.columns
    assert sorted(x.doc_id or 0 for x in out.collect()) == [0, 1, 1, 7]
    judged = op10.judged(op10.repetition_measures(docs)).collect()
    assert len(judged) == 9 and sum(x.kept for x in judged) == 4


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOC)
    assert op10.quality_filter(docs).count() == 0
    assert op10.judged(op10.repetition_measures(docs)).count() == 0
