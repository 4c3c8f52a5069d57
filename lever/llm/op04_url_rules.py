"""URL filtering by given host rules and by mined association rules.

Given rules (``allow com/``, ``block example.com/en/``) fit a host and all its
subdomains when the path starts with the rule's; the longest that fits decides.

For all other URLs, rules are mined: Spark's FP-growth finds the combinations of
URL tokens that at least ``min_rows`` labelled bad URLs share, a number of rows
whatever the size of the table.  A combination becomes a blocking rule when its
confidence reaches ``min_confidence``, the Wilson lower bound of its confidence
lies above the share of bad rows among all labelled ones times ``min_lift``, and
no shorter rule is as sure.  Rules match by an inverted index: each rule stands
under its rarest token, a URL looks up its own tokens and then checks the rule's
other tokens.

Null URLs and those without ``://`` have an empty host and path, fit no given
rule, have no tokens and are allowed.  Without labelled rows nothing is mined.
Repeated rows are judged each on its own; labels that differ for one id count as
rows of their own; null labels are not bad.  Rules as sure as each other: the
least rule id is named.  An empty table of pages gives no rows; URLs of any
length are taken whole; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lever.llm.common import col, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BAD = "label:bad"  # URL tokens start otherwise

GIVEN = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
         ("block", "net/fr/"))


@dataclass(frozen=True)
class Mining:
    min_rows: int = 5  # bad rows that a rule rests on at least
    min_confidence: float = 0.5
    min_lift: float = 1.0  # lower bound of the confidence over the share of all bad rows
    z: float = 2.58  # of the lower bound, in standard deviations


def lower_bound(hits: Column, rows: Column, z: float) -> Column:
    """Wilson's lower bound of a share of ``hits`` among ``rows``."""
    p = hits / rows
    spread = F.sqrt(p * (1 - p) / rows + z * z / (4 * rows * rows))
    return (p + z * z / (2 * rows) - z * spread) / (1 + z * z / rows)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    rest = _after_scheme(F.coalesce(url, F.lit("")))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), "^[^/?#]*([^?#]*)", 1)


def given_rule(host: Column, path: Column, rules=GIVEN) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        at = text.index("/")
        fits = ((host == text[:at]) | host.endswith("." + text[:at])) & path.startswith(text[at:])
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column) -> Column:
    """Distinct tokens: host labels, path parts, query parts and their names, fragment, scheme."""
    url = F.translate(F.coalesce(url, F.lit("")), _UPPER, _LOWER)
    rest = _after_scheme(url)

    def named(prefix, parts):
        return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(prefix), x))

    query = F.split(F.regexp_extract(rest, r"\?([^#]*)", 1), "&")
    names = F.transform(query, lambda x: F.regexp_extract(x, "^([^=]*)", 1))
    tokens = F.concat(named("host:", F.split(F.regexp_extract(rest, "^([^/?#]*)", 1), r"\.")),
                      named("path:", F.split(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), r"[/.]")),
                      named("query:", query), named("name:", names),
                      named("mark:", F.array(F.regexp_extract(rest, "#(.*)$", 1))),
                      named("scheme:", F.array(F.regexp_extract(url, "^([^:/?#]*)://", 1))))
    return F.array_distinct(F.when(rest != "", tokens).otherwise(F.array().cast("array<string>")))


def mine(labelled: DataFrame, how: Mining = Mining()) -> DataFrame:
    """Rules (rule, tokens, anchor, confidence, support) of ``labelled`` (tokens array<string>, bad boolean)."""
    spark = labelled.sparkSession
    empty = "rule bigint, tokens array<string>, anchor string, confidence double, support double"
    items = written(labelled.select(F.when(F.coalesce("bad", F.lit(False)), F.concat("tokens", F.array(F.lit(_BAD))))
                                    .otherwise(F.col("tokens")).alias("items")).filter("size(items) > 0"), "transactions")
    total, bad = items.agg(F.count("*"), F.count_if(F.array_contains("items", _BAD))).first()
    if bad < how.min_rows:
        return spark.createDataFrame([], empty)
    support = (how.min_rows - 0.5) / total  # rounded up to min_rows by the miner
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=1.0).fit(items)
    sets = model.freqItemsets.select(F.array_sort("items").alias("items"), "freq")
    sets = written(sets, "itemsets")
    with_bad = sets.filter(F.array_contains("items", _BAD) & (F.size("items") > 1)) \
        .select(F.array_remove("items", _BAD).alias("items"), F.col("freq").alias("bad"))
    sure = lower_bound(F.col("bad"), F.col("freq"), how.z) > how.min_lift * bad / total
    rules = with_bad.join(sets, "items").filter(sure & (F.col("bad") >= how.min_confidence * F.col("freq"))).select(
        F.col("items").alias("tokens"), (F.col("bad") / F.col("freq")).alias("confidence"),
        (F.col("bad") / F.lit(total)).alias("support"))
    # a rule says nothing new if leaving out one of its tokens gives a rule as sure
    rules = written(rules.withColumn("rule", F.monotonically_increasing_id()), "rules")
    shorter = rules.filter("size(tokens) > 1").select("rule", "tokens", "confidence", F.explode("tokens").alias("t")) \
        .select("rule", F.col("confidence").alias("own"), F.array_remove("tokens", F.col("t")).alias("tokens"))
    idle = shorter.join(rules.select("tokens", "confidence"), "tokens").filter("confidence >= own").select("rule").distinct()
    rules = rules.join(idle, "rule", "left_anti")
    single = sets.filter("size(items) = 1").select(F.col("items")[0].alias("t"), "freq")
    anchors = rules.select("rule", F.explode("tokens").alias("t")).join(single, "t") \
        .groupBy("rule").agg(F.min_by("t", F.struct("freq", "t")).alias("anchor"))
    return written(rules.join(anchors, "rule").select("rule", "tokens", "anchor", "confidence", "support"), "rules")


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(row, rule, confidence): for each of ``urls`` (row, tokens) that a rule fits, the surest rule, least id of ties."""
    looked = urls.select("row", "tokens", F.explode("tokens").alias("anchor"))
    index = rules.select("rule", F.col("tokens").alias("needed"), "anchor", "confidence")
    fit = looked.join(index, "anchor").filter(F.size(F.array_except("needed", "tokens")) == 0)
    best = F.max(F.struct("confidence", (-F.col("rule")).alias("back")))
    return fit.groupBy("row").agg(best.alias("b")) \
        .select("row", (-F.col("b.back")).alias("mined_rule"), F.col("b.confidence").alias("confidence"))


def judge(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id",
          toxic_col: str = "toxic", quality_col: str = "quality", rules=GIVEN, how: Mining = Mining()) -> DataFrame:
    """(id, host, path, rule, verdict, mined_tokens, confidence) of every row of ``pages``.

    A label is bad if toxic is 1 or quality 0.  Mining takes all labelled rows.
    """
    url = col(url_col).cast("string")
    host, path = host_of(url), path_of(url)
    rows = pages.select(col(id_col).alias("id"), url.alias("url"), host.alias("host"), path.alias("path"),
                        url_tokens(url).alias("tokens"))
    rule, verdict = given_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("given", verdict).withColumn("row", F.monotonically_increasing_id())
    rows = written(rows, "urls")
    bad = F.coalesce(col(toxic_col) == 1, F.lit(False)) | F.coalesce(col(quality_col) == 0, F.lit(False))
    marks = labels.select(col(label_id).alias("label_id"), bad.alias("bad"))
    labelled = rows.join(marks, F.col("id") == F.col("label_id")).select("tokens", "bad")
    mined = mine(labelled, how)
    found = matches(rows.filter("given IS NULL").select("row", "tokens"), mined) \
        .join(mined.select(F.col("rule").alias("mined_rule"), F.array_join("tokens", " ").alias("mined_tokens")), "mined_rule")
    return rows.join(found, "row", "left").select(
        F.col("id").alias(id_col), "host", "path", "rule",
        F.coalesce("given", F.when(F.col("mined_tokens").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        "mined_tokens", "confidence")
