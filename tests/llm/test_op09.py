from lever.llm import op09_passages as op09
from lever.llm.common import normal_words
from tests.llm.helpers import DOC, edited, frame, rng, words


def test_planted_passages(spark):
    r = rng()
    passages = [" ".join(words(r, r.choice([51, 60, 90, 150]))) for _ in range(12)]
    texts, owner = [], {}
    for i in range(150):
        lines = [" ".join(words(r, r.choice([15, 40, 120]))) for _ in range(4)]
        if i % 3 == 0:
            p = (i // 3) % 12
            owner[i] = p
            if i % 2:
                lines.insert(2, passages[p])  # a line of its own
            else:
                at = lines[2].split()
                lines[2] = " ".join(at[:7] + [passages[p]] + at[7:])  # inside a line
        texts.append("\n".join(lines))
    rows = op09.repeated_passages(frame(spark, texts)).collect()
    assert {x.doc_id for x in rows} == set(owner)
    first = {p: min(i for i in owner if owner[i] == p) for p in owner.values()}
    for x in rows:
        assert x.keep_id == first[owner[x.doc_id]] and (x.cut_words > 0) == (x.doc_id != x.keep_id)
    out = {x.doc_id: x for x in op09.without_passages(frame(spark, texts)).collect()}
    for i, text in enumerate(texts):
        if i in owner and first[owner[i]] != i:
            assert passages[owner[i]] not in out[i].text and out[i].n_chars == len(out[i].text)
            left, all_words = normal_words(out[i].text.encode()), normal_words(text.encode())
            assert len(all_words) - len(left) >= 20 and len(left) >= len(all_words) - len(passages[owner[i]].split())
        else:
            assert out[i].text == text


def test_similar_paragraphs_and_verification(spark):
    r = rng()
    line = " ".join(words(r, 60))
    near = edited(r, line, 1)
    assert op09.similar(line.encode(), near.encode()) and not op09.similar(line.encode(), edited(r, line, 9).encode())
    texts = ["\n".join([" ".join(words(r, 40)), x]) for x in (line, near, edited(r, line, 12))]
    got = {(x.doc_id, x.keep_id) for x in op09.repeated_passages(frame(spark, texts)).collect()}
    assert {(0, 0), (1, 0)} <= got


def test_passage_that_is_a_line_here_and_inside_a_line_there(spark):
    r = rng()
    p = " ".join(words(r, 51, 10**6))
    far = [" ".join(words(r, n, 10**6)) for n in (70, 80, 30, 15, 8, 7)]
    texts = ["\n".join([far[2], p]), f"{far[0]} {p} {far[1]}", f"{far[3]} {p}", f"{p} {far[4]} {far[5]}"]
    out = {x.doc_id: x.text.split() for x in op09.without_passages(frame(spark, texts)).collect()}
    assert out == {0: texts[0].split(), 1: (far[0] + " " + far[1]).split(), 2: far[3].split(), 3: (far[4] + " " + far[5]).split()}


def test_passage_wrapped_at_other_places(spark):
    r = rng()
    p = words(r, 90, 10**6)

    def wrapped(n):
        return "\n".join(" ".join(p[i:i + n]) for i in range(0, len(p), n))

    texts = [" ".join(words(r, 30)) + "\n" + wrapped(n) + "\n" + " ".join(words(r, 30)) for n in (12, 2, 11, 90)]
    out = {x.doc_id: x.text.split() for x in op09.without_passages(frame(spark, texts)).collect()}
    assert out == {i: t.split() if i == 0 else t.split()[:30] + t.split()[-30:] for i, t in enumerate(texts)}


def test_common_short_lines_are_no_passage(spark):
    r = rng()
    common = [" ".join(words(r, n, 10**6)) for n in [4] * 20 + [9] * 12]
    texts = ["\n".join([" ".join(words(r, 30)), x]) for x in common]
    texts.append("\n".join([" ".join(words(r, 30))] + common))
    assert op09.repeated_passages(frame(spark, texts)).count() == 0


def test_no_passage_vanishes_from_all_documents(spark):
    r = rng()
    p, s, a, b = (" ".join(words(r, n, 10**6)) for n in (400, 50, 60, 70))
    out = {x.doc_id: x.text for x in op09.without_passages(frame(spark, [p, f"{p} {s}", f"{a} {s} {b}"], 1)).collect()}
    assert out[1] == p and out[3] == f"{a} {s} {b}" and 2 not in out


def test_odd_rows(spark):
    r = rng()
    line = " ".join(words(r, 60))
    short = "licensed under something here"
    long = " ".join(words(r, 50_000, 10**6))
    rows = [(1, line), (1, line), (2, None), (3, ""), (4, short + "\n" + " ".join(words(r, 30))),
            (5, short + "\n" + " ".join(words(r, 30))), (6, long), (7, long + "\n" + line), (None, line)]
    docs = frame(spark, rows).selectExpr("*", "1 AS tkey", "2 AS cuts", "'k' AS `_id`")
    got = sorted((x.doc_id or 0, x.keep_id, x.n_words, x.cut_words) for x in op09.repeated_passages(docs).collect())
    assert [g[:2] for g in got] == [(0, 1), (1, 1), (6, 6), (7, 1)]
    out = op09.without_passages(docs)
    assert out.columns == docs.columns
    left = sorted((x.doc_id or 0, x.text) for x in out.collect() if x.text is not None)
    assert [i for i, _ in left] == [1, 1, 3, 4, 5, 6]  # all of 7's and the last row's words were cut
    assert dict(left)[6] == long


def test_bands_are_tuned():
    how = op09.Passages()
    assert (1 - op09.THRESHOLD ** how.band_rows) ** how.bands <= how.missed


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOC)
    assert op09.repeated_passages(docs).count() == 0 and op09.without_passages(docs).count() == 0
