"""The registered queries of the subpackage and their DuckDB formulations.

Each applies one operator, with its production parameters, to whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lever.llm import op01_order_minhash as op01
from lever.llm import op02_token_rollup as op02
from lever.llm import op03_brown as op03
from lever.llm import op04_url_rules as op04
from lever.llm import op05_chat as op05
from lever.llm import op06_warc as op06
from lever.llm import op07_packing as op07
from lever.llm import op08_decontaminate as op08
from lever.llm import op09_passages as op09
from lever.llm import op10_repetition as op10
from lever.llm import op11_vector_codes as op11
from lever.llm import op12_set_join as op12
from lever.llm import op13_ranked_search as op13
from lever.llm.common import scratch, table, tuned, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(tuned(spark), sf_dir)
        if sql:
            ORACLE[name] = sql
        return f
    return add


# DuckDB: words of a text are what lies between runs of ASCII white space
_WORDS10 = r"""w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
  n AS (SELECT *, len(ws) AS n, greatest(33, 30 * len(ws) // 100 + 1) AS g FROM w)"""


def _grams(size: str, name: str) -> str:
    """Per row: positions where a run of ``size`` words starts that occurs twice in the text."""
    return f"""{name} AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM
    (SELECT r, i, array_to_string(list_slice(ws, i, i + {size} - 1), ' ') AS g FROM
      (SELECT r, n, ws, g, unnest(range(1, n - {size} + 2)) AS i FROM n))) WHERE c > 1)"""


def _cover(grams: str, size: int, name: str) -> str:
    return f"""{name} AS (SELECT r, count(DISTINCT p) AS k FROM
    (SELECT r, unnest(range(i, i + {size})) AS p FROM {grams}) GROUP BY r)"""


OP10_SQL = f"""WITH {_WORDS10}, {_grams("8", "g8")}, {_grams("6", "g6")}, {_grams("g", "gl")},
  {_cover("g8", 8, "c8")}, {_cover("g6", 6, "c6")}, l AS (SELECT DISTINCT r FROM gl),
  dup AS (SELECT r, count(*) - count(DISTINCT line) AS d FROM
    (SELECT r, unnest(string_split(text, chr(10))) AS line FROM n)
    WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
  m AS (SELECT n.doc_id, n.n, length(array_to_string(n.ws, '')) AS chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS sym, coalesce(d, 0) AS d,
    coalesce(c8.k, 0) AS k8, coalesce(c6.k, 0) AS k6, l.r IS NOT NULL AS far
    FROM n LEFT JOIN dup USING (r) LEFT JOIN c8 USING (r) LEFT JOIN c6 USING (r) LEFT JOIN l USING (r))
SELECT doc_id, n AS n_words, CAST(chars AS BIGINT) AS word_chars, CAST(sym AS BIGINT) AS n_symbols,
  CAST(d AS BIGINT) AS n_dup_lines, CAST(k8 AS BIGINT) AS n_repeat_words, CAST(k6 AS BIGINT) AS covered_words,
  n < 20 OR 100 * k8 > 30 * n AS base_failed,
  NOT (n < 20 OR 100 * k8 > 30 * n) AND NOT (100 * k6 > 40 * n OR far) AS kept FROM m"""


@query("op10_repetition", OP10_SQL)
def op10_repetition(spark, sf_dir):
    found = op10.judged(op10.repetition_measures(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        "covered_words", "base_failed", "kept")


@query("op7_packing")
def op7_packing(spark, sf_dir):
    return op07.pack(table(spark, sf_dir, "documents"))


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS8 = r"""regexp_extract_all(translate(coalesce(text, ''), """ + _AZ + r"""),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP8_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS8} AS ws FROM documents),
  b AS (SELECT item_id, {_WORDS8} AS ws FROM benchmark),
  win AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS g FROM
    (SELECT item_id, ws, least(10, len(ws)) AS k, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i
     FROM b WHERE len(ws) > 0)),
  ks AS (SELECT DISTINCT k FROM win),
  grams AS (SELECT r, k, i, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS g FROM
    (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, ks WHERE len(ws) >= k)),
  hits AS (SELECT DISTINCT r, k, i, item_id FROM grams JOIN win USING (k, g)),
  n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r),
  it AS (SELECT r, count(DISTINCT item_id) AS n_items,
    array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS l FROM hits GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN it USING (r)"""


@query("op8_decontaminate", OP8_SQL)
def op8_decontaminate(spark, sf_dir):
    found = op08.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return op08.digests(found).drop("longest_match")


@query("op1_order_minhash")
def op1_order_minhash(spark, sf_dir):
    return op01.near_duplicates(table(spark, sf_dir, "documents"))


@query("op9_passages")
def op9_passages(spark, sf_dir):
    return op09.repeated_passages(table(spark, sf_dir, "documents"))


@query("op3_brown_lm")
def op3_brown_lm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("held_out", op03.held_out(F.col("doc_id")))
    model = op03.train(docs.filter("NOT held_out").select(F.col("doc_id").alias("id"), "text"))
    return op03.score(docs, model, extra=("held_out",))


OP6_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
  d AS (SELECT page_id, strlen(t) AS n, unhex(sha1(t)) AS h, sha1(t) AS x FROM p),
  m AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS top FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((('0x' || substr(x, 1 + 5 * (i // 4), 5))::INTEGER >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1), '' ORDER BY i)
    FROM range(32) r(i)) AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to FROM m"""


@query("op6_warc", OP6_SQL)
def op6_warc(spark, sf_dir):
    path = scratch(spark, "archives")
    op06.write_archives(table(spark, sf_dir, "pages"), path)
    return op06.page_records(op06.read_archives(spark, path, with_payload=False))


def _escaped5(value: str) -> str:
    for opener, rest in (("<", r"\|im_start\|>|\|im_sep\|>|\|im_end\|>|s>|/s>"), (r"\[", r"INST\]|/INST\]")):
        value = rf"regexp_replace({value}, '({opener})(\\*)({rest})', '\1\\\2\3', 'g')"
    return value


OP5_SQL = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
  e AS (SELECT *, length({_escaped5("role")}) + length({_escaped5("text")}) + 33 AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(n) + 7 AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id"""


@query("op5_chat_format", OP5_SQL)
def op5_chat_format(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)],
                                  "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return op05.read_back(op05.format_conversations(turns))


@query("op4_url_rules")
def op4_url_rules(spark, sf_dir):
    return op04.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


@query("op2_token_rollup")
def op2_token_rollup(spark, sf_dir):
    """Three batches over all documents: their counts; copies of a text deleted but for the least id; word counts
    revised to those of distinct lines where they differ.  The second is sent twice."""
    counts = written(op02.token_counts(table(spark, sf_dir, "documents")), "counts")
    store = op02.TokenRollup(spark, scratch(spark, "rollup"))
    names = ["words-1", "word_bpe_49k"]
    place = {"words-1": 0, "word_bpe_49k": 2}
    store.commit(1, op02.events(counts, names, "insert", place=place))
    first = counts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    copies = counts.join(first, "digest").filter("doc_id > first")
    for _ in range(2):
        store.commit(2, op02.events(copies, names, "delete", place=place))
    revised = counts.join(first.select("digest", "first"), "digest", "left") \
        .filter("(first IS NULL OR doc_id = first) AND counts[0] <> counts[1]")
    store.commit(3, op02.events(revised, names, "revise", place={"words-1": 1}))
    return store.totals()


def _op11_sql(parts=8, width=8, entries=16, rounds=6) -> str:
    """Every round spelled out; the tables' vectors have parts * width components."""
    floor = "(s - ((s % n) + n) % n) // n"  # rounds down whatever the sign
    dist = "list_sum(list_transform(range(1, {w} + 1), lambda i: (p.x[i] - c.x[i]) * (p.x[i] - c.x[i])))".format(w=width)
    ctes = [f"""v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label,
        list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
            f"""p AS MATERIALIZED (SELECT r, k, list_slice(x, k * {width} + 1, k * {width} + {width}) AS x
      FROM v, (SELECT unnest(range({parts})) AS k))""",
            f"c0 AS MATERIALIZED (SELECT k, r - 1 AS e, x FROM p WHERE r <= {entries})"]
    for t in range(rounds + 1):
        ctes.append(f"""a{t} AS MATERIALIZED (SELECT r, k, min(struct_pack(d := d, e := e)) AS b FROM
      (SELECT p.r, p.k, c.e, {dist} AS d FROM p JOIN c{t} c USING (k)) GROUP BY r, k)""")
        if t < rounds:
            ctes.append(f"""c{t + 1} AS MATERIALIZED (SELECT c.k, c.e, coalesce(m.x, c.x) AS x FROM c{t} c LEFT JOIN
      (SELECT k, e, list(CAST({floor} AS BIGINT) ORDER BY i) AS x FROM
        (SELECT a.k, a.b.e AS e, u.i, CAST(sum(p.x[u.i]) AS BIGINT) AS s, count(*) AS n FROM a{t} a JOIN p USING (r, k),
          (SELECT unnest(range(1, {width} + 1)) AS i) u GROUP BY a.k, a.b.e, u.i) GROUP BY k, e) m USING (k, e))""")
    return "WITH " + ", ".join(ctes) + f""", h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY k, e)) AS h FROM c{rounds}),
  s AS (SELECT r, string_agg(printf('%02x', b.e), '' ORDER BY k) AS code, CAST(sum(b.d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM v JOIN s USING (r), h"""


@query("op11_vector_codes", _op11_sql())
def op11_vector_codes(spark, sf_dir):
    coded = op11.digested(op11.label_errors(op11.vector_codes(table(spark, sf_dir, "embeddings"))))
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


OP13_SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS8} AS ws FROM documents),
  q AS (SELECT row_number() OVER () AS q, item_id, {_WORDS8} AS ws FROM benchmark),
  qt AS (SELECT q, item_id, term, count(*) AS c FROM (SELECT q, item_id, unnest(ws) AS term FROM q) GROUP BY ALL),
  a AS (SELECT count(*) AS n_all, CAST(sum(len(ws)) AS BIGINT) AS l_all FROM d WHERE len(ws) > 0),
  tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(ws) AS n, unnest(ws) AS term FROM d)
    WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
  w AS (SELECT term, CAST(floor(1000 * ln((2 * n_all + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, a GROUP BY term, n_all),
  f AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_all) // l_all))) AS f
    FROM tf JOIN w USING (term), a),
  s AS (SELECT q, item_id, r, doc_id, CAST(sum(c * f) AS BIGINT) AS score FROM qt JOIN f USING (term) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM
  (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
WHERE rank <= 20"""


@query("op13_ranked_search", OP13_SQL)
def op13_ranked_search(spark, sf_dir):
    return op13.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), """ + _AZ + r"""), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
    FROM documents),
  s AS MATERIALIZED (SELECT r, doc_id, CASE WHEN len(ws) = 0 THEN [] ELSE list_distinct(list_transform(
    range(1, greatest(len(ws) - 3, 1) + 1), lambda i: array_to_string(list_slice(ws, i, i + 3), ' '))) END AS gs FROM w),
  t AS MATERIALIZED (SELECT gs, min(r) AS t, min(doc_id) AS least FROM (SELECT r, doc_id, list_sort(gs) AS gs FROM s) GROUP BY gs),
  g AS MATERIALIZED (SELECT t, len(gs) AS n, unnest(gs) AS g FROM t),
  l AS MATERIALIZED (SELECT a.t AS u, b.t AS v FROM g a JOIN g b ON a.g = b.g AND a.t <> b.t GROUP BY a.t, b.t, a.n, b.n
    HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
  c AS (SELECT t AS u, t AS v FROM t UNION SELECT c.u, l.v FROM c JOIN l ON c.v = l.u),
  m AS (SELECT c.u AS t, min(t.least) AS least FROM c JOIN t ON t.t = c.v GROUP BY c.u)
SELECT doc_id, CAST(len(s.gs) AS BIGINT) AS n_shingles, CASE WHEN len(s.gs) = 0 THEN doc_id ELSE m.least END AS component_id
FROM s JOIN t ON t.gs = list_sort(s.gs) JOIN m USING (t)"""


@query("op12_set_join", OP12_SQL)
def op12_set_join(spark, sf_dir):
    return op12.linked_documents(table(spark, sf_dir, "documents"))
