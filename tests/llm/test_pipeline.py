from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from lever.llm.common import written
from lever.llm.word_tokens import default_path
from tests.llm.helpers import edited, frame, rng, words


def test_planted_cases_through_all_stages(spark, tmp_path):
    r = rng()
    item, passage = " ".join(words(r, 40)), " ".join(words(r, 70))
    clean = {i: " ".join(words(r, r.choice([40, 200, 900]), 10**5)) for i in range(40)}
    rows = list(clean.items())
    rows += [(100, clean[0]), (101, edited(r, clean[1], 1)), (101, edited(r, clean[1], 1)), (102, clean[2].upper())]
    rows += [(200 + i, " ".join(words(r, 60)) + f"\n{passage}\n" + " ".join(words(r, 60))) for i in range(5)]
    rows += [(300, " ".join(words(r, 90)) + " " + item + " " + " ".join(words(r, 90))), (301, item)]
    rows += [(400, "junk " * 500), (401, "too short"), (402, None), (403, ""), (None, " ".join(words(r, 50)))]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, at = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == columns
        at.append({x.doc_id: x for x in docs.collect()})
    ids = [sorted(i for i in x if i is not None) for x in at]
    assert ids[0] == [*range(40), 100, 101, 102, *range(200, 205), 300, 301]
    assert ids[1] == [*range(40), *range(200, 205), 300, 301]
    assert ids[2] == ids[1] and ids[3] == [*range(40), *range(200, 205), 300] and None in at[3]
    for i, text in clean.items():
        assert at[3][i].text == text
    assert passage in at[3][200].text and not any(passage in at[3][i].text for i in range(201, 205))
    assert item not in at[3][300].text and at[3][300].n_chars == len(at[3][300].text)
    pieces = defaultdict(dict)
    for x in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect():
        pieces[x.doc_id][x.start] = x.ids
    tokenizer = Tokenizer.from_file(default_path())
    for i, row in at[3].items():
        got = np.concatenate([v for _, v in sorted(pieces[i].items())]).tolist()
        assert got == tokenizer.encode(row.text, add_special_tokens=False).ids + [1]


def test_run_and_registration(spark):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert {q.split("_")[0] for q in entry.queries() if q.startswith("op")} >= {f"op{n}" for n in range(1, 11)}
