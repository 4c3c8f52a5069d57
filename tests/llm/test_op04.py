import math
import re
from itertools import combinations

from lever.llm import op04_url_rules as op04
from lever.llm.queries import QUERIES
from tests.llm.helpers import rng

PAGES, LABELS = "page_id bigint, url string, tokens string, row int", "doc_id bigint, quality int, toxic int"


def split(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")


def given(host, path):
    best = None
    for says, rule in op04.GIVEN:
        at = rule.index("/")
        h, p = rule[:at], rule[at:]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(rule) > len(best[1])):
            best = says, rule
    return best or (None, None)


def test_given_rules(spark):
    urls = ["http://a.com/x", "https://EXAMPLE.com/en/1", "http://www.example.com/en/?q", "http://x.www.example.com/en/a",
            "http://example.com/fr/", "http://b.net/es/a", "http://net/fr/", "http://b.net/esx", "http://bcom/", "http://com/",
            "http://a.com", "http://a.com?x=/", "nothing", "", None, "://", "ftp://u@a.com:80/", "http://É.com/En/", "x://y://z.com/"]
    pages = spark.createDataFrame([(i, u, "t", 1) for i, u in enumerate(urls)], PAGES)
    found = {x.page_id: x for x in op04.judge(pages, spark.createDataFrame([], LABELS)).collect()}
    for i, u in enumerate(urls):
        host, path = split(u)
        says, rule = given(host, path)
        x = found[i]
        assert (x.host, x.path, x.rule, x.verdict) == (host, path, rule, says or "allow"), u


def test_mined_rules_equal_brute_force(spark):
    r = rng()
    pages, labels = [], []
    for i in range(900):
        host, seg, query = r.choice(["one", "two", "three"]), r.choice(["a", "b", "c", "d"]), r.choice(["x=1", "x=2"])
        bad = r.random() < (0.9 if (host, seg) == ("one", "b") else 0.7 if query == "x=2" and seg == "d" else 0.05)
        pages.append((i, f"http://{host}.org/{seg}/{i}?{query}", "t", 1))
        if i < 800:
            labels.append((i, 1, int(bad)) if i % 2 else (i, int(not bad), None))
    how = op04.Mining(min_rows=9, min_confidence=0.5)
    out = op04.judge(spark.createDataFrame(pages + pages[:5], PAGES), spark.createDataFrame(labels, LABELS), how=how).collect()
    assert len(out) == 905

    def tokens(url):
        host, path = split(url)
        q = url.split("?")[1]
        return {*("host:" + h for h in host.split(".")), *("path:" + p for p in path.split("/") if p), "query:" + q, "name:x",
                "scheme:http"}

    bag = {p[0]: tokens(p[1]) for p in pages}
    bad = {i for i, q, t in labels if t == 1 or q == 0}
    rows = [i for i, *_ in labels] + [i for i, *_ in labels if i < 5]  # five pages are there twice
    common = {t for t in set().union(*bag.values()) if sum(t in bag[i] for i in rows) >= 5}
    base = sum(i in bad for i in rows) / len(rows)

    def least(k, n, z=2.58):
        p = k / n
        return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)

    rules = {}
    for size in range(1, 8):
        for c in combinations(sorted(common), size):
            inside = [i for i in rows if bag[i].issuperset(c)]
            hits = sum(i in bad for i in inside)
            if hits >= 9 and hits >= 0.5 * len(inside) and least(hits, len(inside)) > base:
                rules[frozenset(c)] = hits / len(inside)
    assert rules
    for x in out:
        fit = any(rule <= bag[x.page_id] for rule in rules)
        assert x.verdict == ("block" if fit else "allow")
        if fit:
            assert abs(x.confidence - max(c for rule, c in rules.items() if rule <= bag[x.page_id])) < 1e-9


def test_query_mines_rules_from_few_labels(spark, tmp_path):
    """The registered query's own parameters: 60 labelled pages, of which six of one host are bad."""
    pages = [(i, f"http://{'spam' if i % 10 == 3 else 'fine'}.org/{i}", "t", 1) for i in range(200)]
    spark.createDataFrame(pages, PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(i, int(i % 10 != 3), 0) for i in range(60)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    out = {x.page_id: x for x in QUERIES["op4_url_rules"](spark, str(tmp_path)).collect()}
    assert {i for i, x in out.items() if x.verdict == "block"} == set(range(3, 200, 10))
    assert {x.mined_tokens for x in out.values()} == {None, "host:spam"}


def test_long_urls_and_no_pages(spark):
    labels = spark.createDataFrame([(i, 0, 0) for i in range(8)] + [(i, 1, 0) for i in range(8, 40)], LABELS)
    long = "http://bad.org/" + "/".join(f"p{j}" for j in range(5000))
    pages = [(i, f"http://{'bad' if i < 8 else 'ok'}.org/{i}", "t", 1) for i in range(40)] + [(99, long, "t", 1)]
    out = {x.page_id: x for x in op04.judge(spark.createDataFrame(pages, PAGES), labels).collect()}
    assert (out[99].verdict, out[20].verdict) == ("block", "allow") and len(out[99].path) == len(long) - 14
    assert op04.judge(spark.createDataFrame([], PAGES), labels).count() == 0
