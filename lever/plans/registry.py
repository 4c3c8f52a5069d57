"""Registered queries: one per operator of the inventory, each paired (where
the result is SQL-expressible) with an independent DuckDB formulation.

Every query reads the driver's tables (``sf_dir``) through the F1/F2 series
fixtures and runs over all rows and all machines.  Doubles produced by
different summation orders are rounded identically on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lever.operators import forest as R
from lever.operators import models as M
from lever.operators import prep as P
from lever.operators import profile as H
from lever.operators import splits as B
from lever.operators import mixture as G
from lever.operators.ordered import contiguous_folds, with_row_index
from lever.plans import jobs as E
from lever.plans import sqlgen as S
from lever.session import tune_session
from lever.sources import catalog as C
from lever.sources.series import load_machine_tables, load_series, series_table_name
from lever.sources.fixtures import (F1_KEYED_SCHEMA, F1_SCHEMA, F2_FEATURES, F2_SCHEMA, events_series,
                                    lineitem_series)

QUERIES: dict = {}
ORACLE: dict = {}

F2K = ["machine"]
F2O = F2_SCHEMA.order
F2_NONKEY = [c for c in S.F2_COLS if c != "machine"]


def query(name, sql=None):
    def deco(fn):
        def run(spark, sf_dir, _fn=fn):
            tune_session(spark)
            return _fn(spark, sf_dir)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def rnd(df: DataFrame, digits: dict) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), d) for c, d in digits.items()})


def f2(spark, sf):
    return lineitem_series(spark, sf)


def f1(spark, sf):
    return events_series(spark, sf)


def f1k(spark, sf):
    return events_series(spark, sf, keyed=True)


W = S.with_
F2C = S.F2
ORD = S.F2_ORDER

# ============================================================== S: sources
@query("load_series", W(F2C) + "SELECT * FROM f2")
def q_load_series(spark, sf):
    return f2(spark, sf)


@query("load_machine_tables", W(S.F1K) + "SELECT * FROM f1k")
def q_load_machine_tables(spark, sf):
    """A table for each machine, united again: views over the keyed series, named as the per-machine tables are."""
    d = f1k(spark, sf)
    pairs = [tuple(r) for r in C.site_machine_dim(d).collect()]
    for site, machine in pairs:
        d.where((F.col("site") == site) & (F.col("machine") == machine)).drop("site", "machine") \
            .createOrReplaceTempView(series_table_name(site, machine))
    return load_machine_tables(spark, pairs, schema=F1_KEYED_SCHEMA).select(*d.columns)


@query("site_machine_dim", W(S.F1K) + "SELECT DISTINCT site, machine AS machines FROM f1k")
def q_site_machine_dim(spark, sf):
    return C.site_machine_dim(f1k(spark, sf))


@query("machines_of_site", W(S.F1K) + "SELECT DISTINCT site, machine AS machines FROM f1k WHERE site = 's1'")
def q_machines_of_site(spark, sf):
    return C.machines_of_site(C.site_machine_dim(f1k(spark, sf)), "s1")


@query("distinct_values", W(F2C, f"""r AS (SELECT machine, prod_code AS value, {ORD},
  row_number() OVER (PARTITION BY machine, prod_code ORDER BY {ORD}) AS rn FROM f2)""") + f"""
SELECT machine, value, time_bucket_local AS first_seen,
       row_number() OVER (PARTITION BY machine ORDER BY {ORD}) AS ordinal FROM r WHERE rn = 1""")
def q_distinct_values(spark, sf):
    return C.distinct_values(f2(spark, sf), "prod_code", F2O, F2K)


@query("shape_report", W(F2C) + """SELECT machine, count(*) AS n_rows, CAST(16 AS BIGINT) AS n_cols,
  'product_filter' AS step FROM f2 WHERE prod_code IN ('N', 'R') GROUP BY machine""")
def q_shape_report(spark, sf):
    return C.shape_report(P.product_filter(f2(spark, sf), ["N", "R"]), F2K, "product_filter")


_CAT = [c for c in F2_FEATURES if c != "net"]


@query("feature_catalog", W(F2C) + " UNION ALL ".join(
    f"SELECT machine, '{c}' AS feature, CAST({i} AS BIGINT) AS ordinal, count({c}) AS non_null FROM f2 GROUP BY machine"
    for i, c in enumerate(_CAT)))
def q_feature_catalog(spark, sf):
    return C.feature_catalog(f2(spark, sf), F2_FEATURES, F2K, exclude=["net"])


# ============================================================== P: filters, pruning
@query("product_filter", W(F2C) + "SELECT * FROM f2 WHERE prod_code IN ('A', 'R')")
def q_product_filter(spark, sf):
    return P.product_filter(f2(spark, sf), ["A", "R"])


@query("series_projection", W(S.F1K) + """SELECT site, machine, time_bucket_local, click, error, purchase,
  signup, view FROM f1k WHERE prod_code IN ('P1', 'P2')""")
def q_series_projection(spark, sf):
    return P.series_projection(f1k(spark, sf), F1_KEYED_SCHEMA, ["P1", "P2"])


@query("start_date", W(F2C) + "SELECT * FROM f2 WHERE time_bucket_local >= TIMESTAMP '1997-01-01'")
def q_start_date(spark, sf):
    return P.start_date(f2(spark, sf), "1997-01-01")


@query("end_date", W(F2C) + "SELECT * FROM f2 WHERE time_bucket_local <= TIMESTAMP '1999-06-30'")
def q_end_date(spark, sf):
    return P.end_date(f2(spark, sf), "1999-06-30")


@query("trailing_months", W(F2C) + """SELECT * FROM f2
  WHERE time_bucket_local >= CAST(DATE '2001-11-04' - INTERVAL 18 MONTH AS TIMESTAMP)""")
def q_trailing_months(spark, sf):
    return P.trailing_months(f2(spark, sf), 18, as_of="2001-11-04")


def _sparse_sql():
    parts = " UNION ALL ".join(
        f"SELECT machine, '{c}' AS \"column\", count({c}) AS non_null, count(*) AS n_rows FROM f2 GROUP BY machine"
        for c in F2_NONKEY)
    return W(F2C) + f"""SELECT machine, "column", non_null, n_rows,
  non_null > n_rows * CAST(0.3 AS DOUBLE) AS kept FROM ({parts})"""


@query("sparse_column_report", _sparse_sql())
def q_sparse_report(spark, sf):
    return P.sparse_column_report(f2(spark, sf), F2K)


def _mask_sql():
    kept = ", ".join(f"count({c}) > count(*) * CAST(0.3 AS DOUBLE) AS k_{c}" for c in F2_NONKEY)
    sel = ", ".join(f"CASE WHEN k_{c} THEN f2.{c} END AS {c}" for c in F2_NONKEY)
    return W(F2C, f"k AS (SELECT machine, {kept} FROM f2 GROUP BY machine)") + \
        f"SELECT f2.machine, {sel} FROM f2 JOIN k USING (machine)"


@query("drop_sparse_columns", _mask_sql())
def q_drop_sparse(spark, sf):
    return P.drop_sparse_columns(f2(spark, sf), F2K)


@query("drop_metadata", W(F2C) + f"SELECT machine, {ORD}, {', '.join(F2_FEATURES)} FROM f2")
def q_drop_metadata(spark, sf):
    return P.drop_metadata(f2(spark, sf), F2_SCHEMA)


@query("zero_variance_report", W(F2C) + " UNION ALL ".join(
    f"""SELECT machine, '{c}' AS column, min({c}) AS min_value, max({c}) AS max_value,
        coalesce(max({c}) > min({c}), false) AS kept FROM f2 GROUP BY machine""" for c in F2_FEATURES))
def q_zero_variance(spark, sf):
    return P.zero_variance_report(f2(spark, sf), F2K, F2_FEATURES)


@query("column_min_max", W(F2C) + " UNION ALL ".join(
    f"""SELECT machine, '{c}' AS column, min({c}) AS min_value, max({c}) AS max_value
        FROM f2 GROUP BY machine""" for c in F2_FEATURES))
def q_column_min_max(spark, sf):
    return P.column_min_max(f2(spark, sf), F2K, F2_FEATURES)


@query("drop_all_zero", W(F2C) + " UNION ALL ".join(
    f"""SELECT machine, '{c}' AS column,
        coalesce(max(CASE WHEN {c} IS NULL OR {c} <> 0 THEN 1 ELSE 0 END), 0) = 1 AS kept
        FROM f2 GROUP BY machine""" for c in F2_FEATURES))
def q_drop_all_zero(spark, sf):
    return P.all_zero_report(f2(spark, sf), F2K, F2_FEATURES)


@query("without_all_zero_columns", W(F2C) + "SELECT * EXCLUDE (zero0) FROM f2")
def q_without_all_zero(spark, sf):
    """P9 as it drops: without keys, a column that is 0 on every row goes."""
    return P.drop_all_zero(f2(spark, sf), (), F2_FEATURES)


@query("target_guard", W(F2C) + """SELECT machine, min(net) AS target_min, max(net) AS target_max,
  coalesce(NOT (CAST(110000 AS DOUBLE) > max(net)), true) AS min_ok,
  coalesce(NOT (CAST(1300 AS DOUBLE) <= min(net)), true) AS max_ok FROM f2 GROUP BY machine""")
def q_target_guard(spark, sf):
    return P.target_guard(f2(spark, sf), F2K, "net", 110000, 1300)


@query("min_target", W(F2C, "g AS (SELECT machine, max(net) AS mx FROM f2 GROUP BY machine)") +
       """SELECT f2.* FROM f2 JOIN g USING (machine)
  WHERE (CAST(110000 AS DOUBLE) > g.mx) OR net >= CAST(110000 AS DOUBLE)""")
def q_min_target(spark, sf):
    return P.min_target(f2(spark, sf), F2K, "net", 110000)


@query("max_target", W(F2C, "g AS (SELECT machine, min(net) AS mn FROM f2 GROUP BY machine)") +
       """SELECT f2.* FROM f2 JOIN g USING (machine)
  WHERE (CAST(1300 AS DOUBLE) <= g.mn) OR net <= CAST(1300 AS DOUBLE)""")
def q_max_target(spark, sf):
    return P.max_target(f2(spark, sf), F2K, "net", 1300)


@query("drop_null_rows", W(F2C, """c AS (SELECT machine, count(l_quantity) AS a, count(sparse20) AS b,
  count(net) AS d FROM f2 GROUP BY machine)""") + """SELECT f2.* FROM f2 JOIN c USING (machine)
  WHERE (a = 0 OR l_quantity IS NOT NULL) AND (b = 0 OR sparse20 IS NOT NULL) AND (d = 0 OR net IS NOT NULL)""")
def q_drop_null_rows(spark, sf):
    return P.drop_null_rows(f2(spark, sf), ["l_quantity", "sparse20", "net"], F2K)


@query("exclude_variables", W(F2C) + "SELECT * EXCLUDE (p_size, p_retailprice) FROM f2")
def q_exclude_variables(spark, sf):
    return P.drop_variables(f2(spark, sf), ["p_size", "p_retailprice"])


_TRIM = ["l_quantity", "l_extendedprice", "net"]


@query("quantile_trim", W(F2C, f"""c AS (SELECT * FROM f2 WHERE {' AND '.join(f'{x} IS NOT NULL' for x in _TRIM)})""",
                          "q AS (SELECT machine, " + ", ".join(
                              f"quantile_cont({x}, 0.05) AS lo{i}, quantile_cont({x}, 0.99) AS hi{i}"
                              for i, x in enumerate(_TRIM)) + " FROM c GROUP BY machine)") +
       "SELECT c.* FROM c JOIN q USING (machine) WHERE " +
       " AND ".join(f"{x} >= lo{i} AND {x} <= hi{i}" for i, x in enumerate(_TRIM)))
def q_quantile_trim(spark, sf):
    return P.quantile_trim(f2(spark, sf), F2K, _TRIM)


@query("sample_adequacy", W(F2C) + """SELECT machine, count(*) AS n_rows, CAST(16 AS BIGINT) AS n_cols,
  'min_target' AS step, CASE WHEN count(*) = 0 THEN 'no data' WHEN count(*) < 16 THEN 'not enough data'
  ELSE 'ok' END AS status FROM f2 WHERE net >= CAST(95000 AS DOUBLE) GROUP BY machine""")
def q_sample_adequacy(spark, sf):
    d = f2(spark, sf).where(F.col("net") >= 95000.0)
    return P.sample_adequacy(d, F2K, "min_target")


# ============================================================== A: aggregates
@query("product_counts", W(F2C) + """SELECT machine, prod_code, count(time_bucket_local) AS n_points
  FROM f2 WHERE prod_code IS NOT NULL GROUP BY ALL""")
def q_product_counts(spark, sf):
    return P.product_counts(f2(spark, sf), F2K)


_NORM = ["l_quantity", "l_extendedprice", "net", "const1"]


@query("minmax_normalize", W(F2C, "m AS (SELECT machine, " + ", ".join(
    f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in _NORM) + " FROM f2 GROUP BY machine)") +
    "SELECT " + ", ".join(f"CASE WHEN hi_{c} > lo_{c} THEN ({c} - lo_{c}) / (hi_{c} - lo_{c}) END AS {c}"
                          if c in _NORM else f"f2.{c}" for c in S.F2_COLS) +
    " FROM f2 JOIN m USING (machine)")
def q_minmax_normalize(spark, sf):
    return P.minmax_normalize(f2(spark, sf), F2K, _NORM)


# ============================================================== W: ordered
@query("sort_time", W(F2C) + f"""SELECT machine, {ORD},
  row_number() OVER (PARTITION BY machine ORDER BY {ORD}) - 1 AS position FROM f2""")
def q_sort_time(spark, sf):
    d = f2(spark, sf).select("machine", *F2O)
    return with_row_index(d, F2K, F2O, "position")


@query("sorted_series", W(F2C) + f"SELECT machine, {ORD}, net FROM f2")
def q_sorted_series(spark, sf):
    return P.sort_time(f2(spark, sf).select("machine", *F2O, "net"), F2_SCHEMA)


@query("text_times", W(S.F1) + """SELECT time_bucket_local, click, view FROM f1
  WHERE time_bucket_local >= TIMESTAMP '2024-01-05 00:30:00' AND time_bucket_local <= TIMESTAMP '2024-01-20'""")
def q_text_times(spark, sf):
    """a series whose times are ISO text, loaded, and filtered by dates before and after loading."""
    text = f1(spark, sf).select(F.date_format("time_bucket_local", "yyyy-MM-dd'T'HH:mm:ss").alias("time_bucket_local"), "click", "view")
    return P.end_date(load_series(P.start_date(text, "2024-01-05 00:30:00"), schema=F1_SCHEMA), "2024-01-20")


def _ffill_sql():
    w = "PARTITION BY site, machine ORDER BY time_bucket_local ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    cols = ["prod_code", "time_bucket_utc", *S.EVENTS]
    return W(S.F1K) + "SELECT site, machine, time_bucket_local, " + ", ".join(
        f"last_value({c} IGNORE NULLS) OVER ({w}) AS {c}" for c in cols) + " FROM f1k"


@query("forward_fill", _ffill_sql())
def q_forward_fill(spark, sf):
    return P.forward_fill(f1k(spark, sf), F1_KEYED_SCHEMA)


@query("rolling_mean_48", W(S.F1, """ff AS (SELECT time_bucket_local, last_value(purchase IGNORE NULLS) OVER
  (ORDER BY time_bucket_local ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS purchase FROM f1)""") +
       """SELECT time_bucket_local, purchase, round(CASE WHEN count(purchase) OVER w = 48
  THEN avg(purchase) OVER w END, 9) AS purchase_moving_avg FROM ff
  WINDOW w AS (ORDER BY time_bucket_local ROWS BETWEEN 47 PRECEDING AND CURRENT ROW)""")
def q_rolling_mean(spark, sf):
    d = P.forward_fill(f1(spark, sf).select("time_bucket_local", "purchase"), F1_SCHEMA)
    return rnd(H.rolling_mean_48(d, [], ["time_bucket_local"], "purchase"), {"purchase_moving_avg": 9})


@query("tick_sample", W(F2C, f"""r AS (SELECT machine, {ORD}, row_number() OVER (PARTITION BY machine ORDER BY {ORD}) - 1 AS rn,
  count(*) OVER (PARTITION BY machine) AS n FROM f2)""") +
       f"""SELECT machine, {ORD}, CAST(rn // greatest(n // 8, 1) AS BIGINT) AS tick FROM r
  WHERE rn % greatest(n // 8, 1) = 0""")
def q_tick_sample(spark, sf):
    return H.tick_sample(f2(spark, sf).select("machine", *F2O), F2K, F2O)


@query("contiguous_folds", W(F2C) + f"""SELECT machine, {ORD},
  CAST(ntile(10) OVER (PARTITION BY machine ORDER BY {ORD}) - 1 AS BIGINT) AS fold FROM f2""")
def q_contiguous_folds(spark, sf):
    return contiguous_folds(f2(spark, sf).select("machine", *F2O), F2K, F2O, 10)


# ============================================================== H: profiling
K = ["machine"]
_HV = ["l_discount", "l_quantity"]


@query("histogram_100", W(F2C, S.long_xy("lx", "f2", K, _HV), *S.hist_ctes("h_", "lx", K, 100)) +
       "SELECT machine, variable, bin, round(bin_lo, 9) AS bin_lo, round(bin_hi, 9) AS bin_hi, n FROM h_h")
def q_histogram(spark, sf):
    return rnd(H.histogram(f2(spark, sf), _HV, K, 100), {"bin_lo": 9, "bin_hi": 9})


@query("histogram_with_splits", W(F2C, S.long_xy("lx", "f2", K, ["l_discount"]),
                                  S.long_xy("lxy", "f2", K, ["l_discount"], y="net"),
                                  *S.tree_ctes("t_", "lxy", K, "1"), *S.hist_ctes("h_", "lx", K, 100)) + """
SELECT machine, variable, bin, round(bin_lo, 9) AS bin_lo, round(bin_hi, 9) AS bin_hi, n,
  coalesce(bool_or(t.threshold >= bin_lo AND (t.threshold < bin_hi OR (bin = 99 AND t.threshold <= bin_hi))),
           false) AS has_split
FROM h_h LEFT JOIN t_nodes t USING (machine, variable) GROUP BY ALL""")
def q_histogram_splits(spark, sf):
    d = f2(spark, sf)
    splits = B.tree_splits(d, K, ["l_discount"], "net", 1)
    return rnd(H.histogram_with_splits(d, ["l_discount"], splits, K, 100), {"bin_lo": 9, "bin_hi": 9})


_PV = ["l_quantity", "l_discount", "p_size"]


@query("histogram_peaks", W(F2C, S.long_xy("lx", "f2", K, _PV), *S.hist_ctes("h_", "lx", K, 10),
                            *S.peak_ctes("h_", K, 10)) +
       "SELECT machine, variable, bin, round(peak, 9) AS peak FROM h_peaks")
def q_histogram_peaks(spark, sf):
    return rnd(H.histogram_peaks(f2(spark, sf), _PV, K, 10), {"peak": 9})


_GV = ["l_quantity", "l_discount", "l_tax"]
_GSQL = """SELECT machine, variable, count(*) AS n, round(avg(x), 9) AS mean,
  round(var_pop(x) + 1e-6, 9) AS variance,
  round(-2 * (-0.5 * count(*) * (ln(2 * pi() * (var_pop(x) + 1e-6)) + var_pop(x) / (var_pop(x) + 1e-6)))
        + 2 * ln(count(*)), 6) AS bic_1 FROM lx GROUP BY ALL"""


@query("gmm_single", W(F2C, S.long_xy("lx", "f2", K, _GV)) + _GSQL)
def q_gmm_single(spark, sf):
    return rnd(G.gmm_single(f2(spark, sf), _GV, K), {"mean": 9, "variance": 9, "bic_1": 6})


@query("gmm_splits_k1", W(F2C, S.long_xy("lx", "f2", K, _GV)) + """SELECT machine, variable,
  CAST(0 AS BIGINT) AS split_index, round(avg(x), 9) AS threshold FROM lx GROUP BY ALL""")
def q_gmm_splits_k1(spark, sf):
    params = G.gmm_single(f2(spark, sf), _GV, K).select(*K, "variable", F.lit(1.0).alias("weight"), "mean")
    return rnd(G.gmm_splits_from_params(params, K), {"threshold": 9})


@query("gmm_components")
def q_gmm_components(spark, sf):
    return G.gmm_components(f2(spark, sf), _GV, K)


@query("gmm_splits")
def q_gmm_splits(spark, sf):
    return rnd(G.gmm_splits(f2(spark, sf), _GV, K), {"threshold": 9})


@query("rolling_mean_48_keyed", W(S.F1K, """ff AS (SELECT site, machine, time_bucket_local,
  last_value(purchase IGNORE NULLS) OVER (PARTITION BY site, machine ORDER BY time_bucket_local
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS purchase FROM f1k)""") +
       """SELECT site, machine, time_bucket_local, purchase, round(CASE WHEN count(purchase) OVER w = 48
  THEN avg(purchase) OVER w END, 9) AS purchase_moving_avg FROM ff
  WINDOW w AS (PARTITION BY site, machine ORDER BY time_bucket_local ROWS BETWEEN 47 PRECEDING AND CURRENT ROW)""")
def q_rolling_keyed(spark, sf):
    d = P.forward_fill(f1k(spark, sf), F1_KEYED_SCHEMA)
    return rnd(H.rolling_mean_48(d.select("site", "machine", "time_bucket_local", "purchase"),
                                 ["site", "machine"], ["time_bucket_local"], "purchase"),
               {"purchase_moving_avg": 9})


# ============================================================== B: splits and segments
_BV = ["l_discount", "l_tax", "l_quantity"]
_NODE_SQL = "SELECT machine, variable, node, round(threshold, 9) AS threshold, n_left FROM t_nodes"


def _nodes(df):
    return rnd(df.select(*K, "variable", "node", "threshold", "n_left"), {"threshold": 9})


@query("best_split", W(F2C, S.long_xy("lxy", "f2", K, _BV, y="net"), *S.tree_ctes("t_", "lxy", K, "1")) + _NODE_SQL)
def q_best_split(spark, sf):
    return _nodes(B.tree_splits(f2(spark, sf), K, _BV, "net", 1))


@query("tree_splits", W(F2C, S.long_xy("lxy", "f2", K, _BV, y="net"), *S.tree_ctes("t_", "lxy", K, "2")) + _NODE_SQL)
def q_tree_splits(spark, sf):
    return _nodes(B.tree_splits(f2(spark, sf), K, _BV, "net", 2))


@query("sorted_thresholds", W(F2C, S.long_xy("lxy", "f2", K, _BV, y="net"), *S.tree_ctes("t_", "lxy", K, "2")) +
       """SELECT machine, variable, CAST(row_number() OVER (PARTITION BY machine, variable ORDER BY threshold) - 1
  AS BIGINT) AS position, round(threshold, 9) AS threshold FROM t_nodes""")
def q_sorted_thresholds(spark, sf):
    from pyspark.sql import Window
    t = B.tree_splits(f2(spark, sf), K, _BV, "net", 2)
    w = Window.partitionBy(*K, "variable").orderBy("threshold")
    return rnd(t.select(*K, "variable", (F.row_number().over(w) - 1).cast("bigint").alias("position"),
                        "threshold"), {"threshold": 9})


_PKV = ["l_quantity", "l_discount"]


def _peak_depth_ctes():
    return [S.long_xy("lx", "f2", K, _PKV), S.long_xy("lxy", "f2", K, _PKV, y="net"),
            *S.hist_ctes("h_", "lx", K, 10), *S.peak_ctes("h_", K, 10),
            """dp AS (SELECT machine, variable, CASE WHEN count(p.bin) = 1 THEN 1 ELSE 2 END AS depth
              FROM (SELECT DISTINCT machine, variable FROM lx) v LEFT JOIN h_peaks p USING (machine, variable)
              GROUP BY ALL)""",
            *S.tree_ctes("t_", "lxy", K, "coalesce(dp.depth, 2)", depth_join="dp")]


def _peak_splits(d):
    peaks = H.histogram_peaks(d, _PKV, K, 10)
    counts = peaks.groupBy(*K, "variable").agg(F.count(F.lit(1)).alias("n_peaks"))
    return B.tree_splits(d, K, _PKV, "net", B.depth_from_count(counts, K, "n_peaks"))


@query("peak_tree_splits", W(F2C, *_peak_depth_ctes()) + _NODE_SQL)
def q_peak_tree_splits(spark, sf):
    return _nodes(_peak_splits(f2(spark, sf)))


@query("gmm_tree_splits")
def q_gmm_tree_splits(spark, sf):
    d = f2(spark, sf)
    comps = G.gmm_components(d, _BV, K)
    return _nodes(B.tree_splits(d, K, _BV, "net", B.depth_from_count(comps, K, "n_components")))


_SV = ["l_discount", "l_tax"]


def _seg_ctes():
    return [S.long_xy("lxy", "f2", K, _SV, y="net"), *S.tree_ctes("t_", "lxy", K, "2"),
            *S.segment_ctes("s_", "lxy", K, "t_nodes", exact_scale=6)]


def _seg_splits(d):
    return B.tree_splits(d, K, _SV, "net", 2)


@query("segment_rows", W(F2C, *_seg_ctes()) + """SELECT machine, variable, x, y, segment,
  round(seg_lo, 9) AS seg_lo, round(seg_hi, 9) AS seg_hi, label, round(share, 9) AS share, is_outlier FROM s_rows""")
def q_segment_rows(spark, sf):
    d = f2(spark, sf)
    return rnd(B.segment_rows(d, K, _SV, "net", _seg_splits(d)), {"seg_lo": 9, "seg_hi": 9, "share": 9})


_SUMSQL = """SELECT machine, variable, segment, round(seg_lo, 9) AS seg_lo, round(seg_hi, 9) AS seg_hi, label, n,
  round(share, 9) AS share, round(mean_target, 6) AS mean_target FROM s_summary"""


def _summary_round(df):
    return rnd(df, {"seg_lo": 9, "seg_hi": 9, "share": 9, "mean_target": 6})


@query("segment_summary", W(F2C, *_seg_ctes()) + _SUMSQL)
def q_segment_summary(spark, sf):
    d = f2(spark, sf)
    return _summary_round(B.segment_summary(d, K, _SV, "net", _seg_splits(d), exact_scale=6))


_BOX_CTE = """bx AS (SELECT machine, variable, segment, max(label) AS label,
  count(*) AS n, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.5) AS median, quantile_cont(y, 0.75) AS q3
  FROM s_rows GROUP BY ALL)"""
_BOX_SQL = """SELECT machine, variable, segment, bx.label, bx.n, round(q1, 8) AS q1,
  round(median, 8) AS median, round(q3, 8) AS q3,
  min(CASE WHEN y >= q1 - 1.5 * (q3 - q1) THEN y END) AS whisker_lo,
  max(CASE WHEN y <= q3 + 1.5 * (q3 - q1) THEN y END) AS whisker_hi,
  count(CASE WHEN y < q1 - 1.5 * (q3 - q1) OR y > q3 + 1.5 * (q3 - q1) THEN 1 END) AS n_outliers
FROM s_rows JOIN bx USING (machine, variable, segment)
GROUP BY machine, variable, segment, bx.label, bx.n, q1, median, q3"""


@query("segment_boxstats", W(F2C, *_seg_ctes(), _BOX_CTE) + _BOX_SQL)
def q_segment_boxstats(spark, sf):
    d = f2(spark, sf)
    return rnd(B.segment_boxstats(d, K, _SV, "net", _seg_splits(d)),
               {"q1": 8, "median": 8, "q3": 8})


# ============================================================== M: models
@query("holdout_split", W(F2C) + f"SELECT machine, {ORD}, _h % 1000 < 800 AS in_train FROM f2")
def q_holdout(spark, sf):
    return M.holdout_split(f2(spark, sf).select(*K, *F2O, "_h"), hash_col="_h").drop("_h")


@query("shuffled_folds", W(F2C) + f"SELECT machine, {ORD}, CAST(_h % 5 AS BIGINT) AS fold FROM f2")
def q_shuffled_folds(spark, sf):
    return M.shuffled_folds(f2(spark, sf).select(*K, *F2O, "_h"), 5, hash_col="_h").drop("_h")


_BY_HASH = f"row_number() OVER (PARTITION BY machine ORDER BY _h, {ORD})"


@query("holdout_exact", W(F2C) + f"""SELECT machine, {ORD},
  {_BY_HASH} <= n - CAST(ceil(n * 2 / 10.0) AS BIGINT) AS in_train FROM (SELECT *, count(*) OVER (PARTITION BY machine) AS n FROM f2)""")
def q_holdout_exact(spark, sf):
    return M.holdout_exact(f2(spark, sf).select(*K, *F2O, "_h"), K, ["_h", *F2O]).drop("_h")


@query("folds_exact", W(F2C) + f"""SELECT machine, {ORD},
  CAST(ntile(5) OVER (PARTITION BY machine ORDER BY _h, {ORD}) - 1 AS BIGINT) AS fold FROM f2""")
def q_folds_exact(spark, sf):
    return M.folds_exact(f2(spark, sf).select(*K, *F2O, "_h"), K, ["_h", *F2O]).drop("_h")


EPS_SQL = "2.220446049250313e-16"


def _cv_ctes(p=""):
    """M3 oracle: 5 hash folds of the 80 % share, leave-one-fold-out closed forms (p = 1)."""
    return [
        f"""{p}d AS (SELECT machine, l_extendedprice AS x, net AS y, _h % 5 AS fold FROM f2
          WHERE _h % 1000 < 800 AND l_extendedprice IS NOT NULL AND net IS NOT NULL)""",
        f"""{p}fs AS (SELECT machine, fold, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx,
          sum(x * y) AS sxy FROM {p}d GROUP BY ALL)""",
        f"""{p}tr AS (SELECT f.machine, f.fold, t.n - f.n AS n, t.sx - f.sx AS sx, t.sy - f.sy AS sy,
          t.sxx - f.sxx AS sxx, t.sxy - f.sxy AS sxy FROM {p}fs f JOIN (SELECT machine, sum(n) AS n,
          sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM {p}fs GROUP BY machine) t
          USING (machine))""",
        f"""{p}cf AS (SELECT machine, fold, n, sx / n AS mx, sy / n AS my, sxx - n * (sx / n) * (sx / n) AS gxx,
          sxy - n * (sx / n) * (sy / n) AS gxy FROM {p}tr)""",
        f"""{p}co AS (SELECT machine, fold, 'LinearRegression' AS model, gxy / gxx AS w, mx, my FROM {p}cf
          UNION ALL SELECT machine, fold, 'Ridge', gxy / (gxx + 1.0), mx, my FROM {p}cf
          UNION ALL SELECT machine, fold, 'Lasso', sign(gxy) * greatest(abs(gxy) - n * 1.0, 0) / gxx, mx, my
          FROM {p}cf)""",
        f"""{p}pf AS (SELECT machine, model, fold,
          avg(abs(y - ((my - w * mx) + w * x)) / greatest(abs(y), {EPS_SQL})) AS mape,
          sqrt(avg((y - ((my - w * mx) + w * x)) * (y - ((my - w * mx) + w * x)))) AS rmse
          FROM {p}d JOIN {p}co USING (machine, fold) GROUP BY ALL)""",
        f"""{p}sc AS (SELECT machine, model, avg(mape) * 100 AS abs_mape_pct, avg(rmse) AS abs_rmse
          FROM {p}pf GROUP BY ALL)""",
    ]


def _sel_sql(p=""):
    return f"""{p}sel AS (SELECT machine, arg_min(model, abs_mape_pct) AS model,
      min(abs_mape_pct) AS abs_mape_pct FROM {p}sc GROUP BY machine)"""


_CV_CTES = _cv_ctes()


def _cv(d):
    return M.cv_scores(d, K, ["l_extendedprice"], "net", M.LINEAR_ONLY, hash_col="_h")


@query("cv_scores", W(F2C, *_CV_CTES) +
       "SELECT machine, model, round(abs_mape_pct, 6) AS abs_mape_pct, round(abs_rmse, 4) AS abs_rmse FROM sc")
def q_cv_scores(spark, sf):
    return rnd(_cv(f2(spark, sf)), {"abs_mape_pct": 6, "abs_rmse": 4})



@query("select_model")
def q_select_model(spark, sf):
    """All four models, the forest too, on every feature, in an exact training share and exact folds."""
    scores = M.cv_scores(f2(spark, sf), K, _P6, "net", M.RANKING_MODELS, hash_cols=[*K, *F2O], order=F2O)
    return rnd(M.select_model(scores, K), {"abs_mape_pct": 6})


def _imp_ctes(cols, models):
    """Leave-one-fold-out closed forms on min-max scaled data, p = len(cols) <= 2."""
    allc = [*cols, "net"]
    mm = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in allc)
    nz = ", ".join(f"CASE WHEN hi_{c} > lo_{c} THEN ({c} - lo_{c}) / (hi_{c} - lo_{c}) END AS {c}" for c in allc)
    notnull = " AND ".join(f"{c} IS NOT NULL" for c in allc)
    p = len(cols)
    sums = ["count(*) AS n", "sum(net) AS sy"]
    sums += [f"sum(x{i}) AS s{i}" for i in range(p)] + [f"sum(x{i} * net) AS s{i}y" for i in range(p)]
    sums += [f"sum(x{i} * x{j}) AS s{i}{j}" for i in range(p) for j in range(i, p)]
    stat = ["n", "sy"] + [f"s{i}" for i in range(p)] + [f"s{i}y" for i in range(p)] + \
        [f"s{i}{j}" for i in range(p) for j in range(i, p)]
    xs = ", ".join(f"{c} AS x{i}" for i, c in enumerate(cols))
    ctes = [
        f"""base AS (SELECT machine, {ORD}, {', '.join(allc)} FROM f2 WHERE {notnull})""",
        f"""mm AS (SELECT machine, {mm} FROM base GROUP BY machine)""",
        f"""nz AS (SELECT machine, {ORD}, {nz} FROM base JOIN mm USING (machine))""",
        f"""fo AS (SELECT machine, {xs}, net, ntile(10) OVER (PARTITION BY machine ORDER BY {ORD}) - 1 AS fold
            FROM nz WHERE net IS NOT NULL)""",
        f"""fs AS (SELECT machine, fold, {', '.join(sums)} FROM fo GROUP BY ALL)""",
        f"""tot AS (SELECT machine, {', '.join(f'sum({c}) AS t_{c}' for c in stat)} FROM fs GROUP BY machine)""",
        f"""tr AS (SELECT machine, fold, {', '.join(f't_{c} - {c} AS {c}' for c in stat)} FROM fs JOIN tot USING (machine))""",
    ]
    if p == 1:
        ctes.append("""cg AS (SELECT machine, fold, n, s00 - n * (s0 / n) * (s0 / n) AS a,
            s0y - n * (s0 / n) * (sy / n) AS c0 FROM tr)""")
        sel = []
        for m, (kind, alpha) in models.items():
            if kind == "ols":
                w = "c0 / a"
            elif kind == "ridge":
                w = f"c0 / (a + {alpha})"
            else:
                w = f"sign(c0) * greatest(abs(c0) - n * {alpha}, 0) / a"
            sel.append(f"SELECT machine, fold, '{m}' AS model, '{cols[0]}' AS feature, {w} AS coefficient FROM cg")
    else:
        ctes.append("""cg AS (SELECT machine, fold, n, s00 - n * (s0 / n) * (s0 / n) AS a,
            s01 - n * (s0 / n) * (s1 / n) AS b, s11 - n * (s1 / n) * (s1 / n) AS dd,
            s0y - n * (s0 / n) * (sy / n) AS c0, s1y - n * (s1 / n) * (sy / n) AS c1 FROM tr)""")
        sel = []
        for m, (kind, alpha) in models.items():
            r = "0" if kind == "ols" else str(alpha)
            det = f"((a + {r}) * (dd + {r}) - b * b)"
            sel.append(f"SELECT machine, fold, '{m}' AS model, '{cols[0]}' AS feature, "
                       f"((dd + {r}) * c0 - b * c1) / {det} AS coefficient FROM cg")
            sel.append(f"SELECT machine, fold, '{m}' AS model, '{cols[1]}' AS feature, "
                       f"((a + {r}) * c1 - b * c0) / {det} AS coefficient FROM cg")
    ctes.append(f"coef AS ({' UNION ALL '.join(sel)})")
    ctes.append("""imp AS (SELECT machine, model, feature, avg(abs(coefficient)) AS feature_importance
        FROM coef GROUP BY ALL)""")
    return ctes


_IMP_SQL = """SELECT machine, feature, round(feature_importance, 6) AS feature_importance,
  round(-feature_importance, 6) AS index FROM imp"""
_P2 = ["l_extendedprice", "l_discount"]


def _imp(df):
    return rnd(df, {"feature_importance": 6, "index": 6})


def _only(name):
    return {name: M.IMPORTANCE_MODELS[name]}


@query("linear_importance", W(F2C, *_imp_ctes(_P2, _only("LinearRegression"))) + _IMP_SQL)
def q_linear_importance(spark, sf):
    return _imp(M.linear_importance(f2(spark, sf), K, F2O, _P2, "net"))


@query("ridge_importance", W(F2C, *_imp_ctes(_P2, _only("Ridge"))) + _IMP_SQL)
def q_ridge_importance(spark, sf):
    return _imp(M.ridge_importance(f2(spark, sf), K, F2O, _P2, "net"))


@query("lasso_importance", W(F2C, *_imp_ctes(["l_extendedprice"], _only("Lasso"))) + _IMP_SQL)
def q_lasso_importance(spark, sf):
    return _imp(M.lasso_importance(f2(spark, sf), K, F2O, ["l_extendedprice"], "net"))


_TWO = {m: M.IMPORTANCE_MODELS[m] for m in ("LinearRegression", "Ridge")}


@query("fold_mean_importance", W(F2C, *_imp_ctes(_P2, _TWO)) +
       "SELECT machine, model, feature, round(feature_importance, 6) AS feature_importance FROM imp")
def q_fold_mean_importance(spark, sf):
    coef = M.linear_fold_coefficients(f2(spark, sf), K, F2O, _P2, "net", _TWO)
    imp = M.fold_mean_importance(coef.withColumn("feature_importance", F.abs("coefficient")), K)
    return rnd(imp, {"feature_importance": 6})


@query("rank_features", W(F2C, *_imp_ctes(_P2, _only("LinearRegression"))) + """SELECT machine, model,
  CAST(fold AS BIGINT) AS fold, feature, round(abs(coefficient), 6) AS feature_importance,
  CAST(row_number() OVER (PARTITION BY machine, model, fold ORDER BY abs(coefficient) DESC, feature) - 1 AS BIGINT)
  AS index FROM coef""")
def q_rank_features(spark, sf):
    coef = M.linear_fold_coefficients(f2(spark, sf), K, F2O, _P2, "net", _only("LinearRegression"))
    ranked = M.rank_features(coef.withColumn("feature_importance", F.abs("coefficient")), K)
    return rnd(ranked.drop("coefficient"), {"feature_importance": 6})


@query("top10_features", W(F2C, *_imp_ctes(_P2, _only("LinearRegression")),
                           """t AS (SELECT machine, feature, feature_importance, -feature_importance AS index,
  CAST(row_number() OVER (PARTITION BY machine ORDER BY -feature_importance, feature) AS BIGINT) AS rank FROM imp)""") +
       """SELECT machine, feature, round(feature_importance, 6) AS feature_importance, round(index, 6) AS index, rank,
  round(max(index) OVER (PARTITION BY machine) - index, 6) AS bar FROM t WHERE rank <= 10""")
def q_top10(spark, sf):
    imp = M.linear_importance(f2(spark, sf), K, F2O, _P2, "net")
    return rnd(M.top_features(imp, K, 10), {"feature_importance": 6, "index": 6, "bar": 6})


@query("dispatch_importance", W(F2C, *_cv_ctes("cv_"), _sel_sql("cv_"),
                                *_imp_ctes(["l_extendedprice"], M.IMPORTANCE_MODELS)) +
       """SELECT machine, model, feature, round(feature_importance, 6) AS feature_importance,
  round(-feature_importance, 6) AS index FROM imp JOIN cv_sel USING (machine, model)""")
def q_dispatch(spark, sf):
    d = f2(spark, sf)
    selected = M.select_model(_cv(d), K, list(M.LINEAR_ONLY))
    return _imp(M.dispatch_importance(d, K, F2O, ["l_extendedprice"], "net", selected))


def _elimination(name, src, p, models):
    """CTEs up to ``{name}(machine, fold, model, w0, ..., b0)``: least squares with a ridge per model (name -> alpha)
    from the sums in ``src`` (n, sy, s_i, s_iy, s_i_j), by Gauss elimination written out step by step."""
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    out = [f"{name}g AS (SELECT machine, fold, n, sy, " + ", ".join(
        [f"s_{i} AS s{i}" for i in range(p)] + [f"s_{i}y - s_{i} * sy / n AS c{i}" for i in range(p)]
        + [f"s_{i}_{j} - s_{i} * s_{j} / n AS g{i}_{j}" for i, j in pairs]) + f" FROM {src})"]
    keep = "machine, fold, model, n, sy, " + ", ".join(f"s{i}" for i in range(p))
    out.append(f"{name}e0 AS (" + " UNION ALL ".join(
        f"SELECT machine, fold, '{m}' AS model, n, sy, " + ", ".join(
            [f"s{i}" for i in range(p)] + [f"c{i}" for i in range(p)]
            + [f"g{i}_{j}{f' + {alpha}' if i == j else ''} AS g{i}_{j}" for i, j in pairs]) + f" FROM {name}g"
        for m, alpha in models.items()) + ")")
    for k in range(p - 1):
        cols = [f"c{i}" if i <= k else f"c{i} - g{k}_{i} / g{k}_{k} * c{k} AS c{i}" for i in range(p)]
        cols += [f"g{i}_{j}" if i <= k else f"g{i}_{j} - g{k}_{i} / g{k}_{k} * g{k}_{j} AS g{i}_{j}" for i, j in pairs]
        out.append(f"{name}e{k + 1} AS (SELECT {keep}, {', '.join(cols)} FROM {name}e{k})")
    last = f"{name}e{p - 1}"
    for i in reversed(range(p)):
        done = "".join(f" - g{i}_{j} * w{j}" for j in range(i + 1, p))
        out.append(f"{name}b{i} AS (SELECT *, (c{i}{done}) / g{i}_{i} AS w{i} FROM {last})")
        last = f"{name}b{i}"
    out.append(f"{name} AS (SELECT *, (sy{''.join(f' - w{i} * s{i}' for i in range(p))}) / n AS b0 FROM {last})")
    return out


def _sums(p, y):
    cols = {"n": "count(*)", "sy": f"sum({y})"}
    cols |= {f"s_{i}": f"sum(x{i})" for i in range(p)} | {f"s_{i}y": f"sum(x{i} * {y})" for i in range(p)}
    return cols | {f"s_{i}_{j}": f"sum(x{i} * x{j})" for i in range(p) for j in range(i, p)}


def _fold_sums(name, src, p, y):
    """``{name}(machine, fold, ...)``: the sums of ``src`` over all other folds."""
    cols = _sums(p, y)
    return [f"{name}f AS (SELECT machine, fold, {', '.join(f'{e} AS {c}' for c, e in cols.items())} FROM {src} GROUP BY ALL)",
            f"""{name} AS (SELECT machine, fold, {', '.join(f'sum({c}) OVER w - {c} AS {c}' for c in cols)} FROM {name}f
  WINDOW w AS (PARTITION BY machine))"""]


_P6 = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "p_size", "p_retailprice"]
_LS = {m: M.IMPORTANCE_MODELS[m] for m in ("LinearRegression", "Ridge")}


def _imp6_ctes():
    allc = [*_P6, "net"]
    return [
        f"""mm AS (SELECT machine, {', '.join(f'min({c}) AS lo_{c}, max({c}) AS hi_{c}' for c in allc)} FROM f2 GROUP BY machine)""",
        f"""fo AS (SELECT machine, {', '.join(f'({c} - lo_{c}) / (hi_{c} - lo_{c}) AS x{i}' for i, c in enumerate(_P6))},
  (net - lo_net) / (hi_net - lo_net) AS y, ntile(10) OVER (PARTITION BY machine ORDER BY {ORD}) - 1 AS fold
  FROM f2 JOIN mm USING (machine))""",
        *_fold_sums("tr", "fo", 6, "y"), *_elimination("sv", "tr", 6, {m: a for m, (_, a) in _LS.items()}),
        "imp AS (" + " UNION ALL ".join(
            f"SELECT machine, model, '{c}' AS feature, avg(abs(w{i})) AS feature_importance FROM sv GROUP BY ALL"
            for i, c in enumerate(_P6)) + ")"]


@query("least_squares_importance_all_features", W(F2C, *_imp6_ctes()) + """SELECT machine, model, feature,
  round(feature_importance, 6) AS feature_importance, round(-feature_importance, 6) AS index FROM imp""")
def q_least_squares_all(spark, sf):
    return _imp(M.linear_importance_all(f2(spark, sf), K, F2O, _P6, "net", _LS))


_LS_CV = {m: M.RANKING_MODELS[m] for m in _LS}


def _rank_linear_sql():
    pred = "b0 + " + " + ".join(f"w{i} * x{i}" for i in range(6))
    return W(F2C, *_imp6_ctes(),
             f"""cd AS (SELECT machine, {', '.join(f'{c} AS x{i}' for i, c in enumerate(_P6))}, net AS y, _h % 5 AS fold
  FROM f2 WHERE _h % 1000 < 800)""",
             "cm AS (SELECT machine, " + ", ".join(f"avg(x{i}) AS m{i}" for i in range(6)) + ", avg(y) AS my FROM cd GROUP BY machine)",
             "cz AS (SELECT machine, fold, " + ", ".join(f"x{i} - m{i} AS x{i}" for i in range(6))
             + ", y - my AS z, y FROM cd JOIN cm USING (machine))",
             *_fold_sums("ct", "cz", 6, "z"), *_elimination("cv", "ct", 6, {m: a for m, (_, a) in _LS_CV.items()}),
             f"""pf AS (SELECT machine, model, fold, avg(abs(z - ({pred})) / greatest(abs(y), {EPS_SQL})) AS mape
  FROM cz JOIN cv USING (machine, fold) GROUP BY ALL)""",
             "sc AS (SELECT machine, model, avg(mape) * 100 AS abs_mape_pct FROM pf GROUP BY ALL)", _sel_sql(),
             """rk AS (SELECT machine, model, feature, feature_importance, -feature_importance AS index,
  row_number() OVER (PARTITION BY machine ORDER BY -feature_importance, feature) AS rank FROM imp JOIN sel USING (machine, model))""") + \
        """SELECT machine, model, feature, round(feature_importance, 6) AS feature_importance, round(index, 6) AS index, rank,
  round(max(index) OVER (PARTITION BY machine) - index, 6) AS bar FROM rk WHERE rank <= 10"""


@query("rank_drivers_linear", _rank_linear_sql())
def q_rank_drivers_linear(spark, sf):
    d = f2(spark, sf)
    scores = M.cv_scores(d, K, _P6, "net", _LS_CV, hash_col="_h")
    selected = M.select_model(scores, K, list(_LS_CV))
    imp = M.dispatch_importance(d, K, F2O, _P6, "net", selected)
    return rnd(M.top_features(imp, K, 10), {"feature_importance": 6, "index": 6, "bar": 6})


@query("forest_importance")
def q_forest(spark, sf):
    return rnd(M.forest_importance(f2(spark, sf), K, F2O, _P6, "net"), {"feature_importance": 9, "index": 6})


_STUMP = ["l_discount", "l_tax"]  # few values each, so every value is a cut


@query("forest_stumps", W(F2C, "o AS (" + " UNION ALL ".join(
    f"""SELECT machine, '{v}' AS feature, {i} AS place, {v} AS x, net AS y,
  ntile(10) OVER (PARTITION BY machine ORDER BY {ORD}) - 1 AS fold FROM f2""" for i, v in enumerate(_STUMP)) + ")",
    "g AS (SELECT unnest(range(10)) AS f)",
    """s AS (SELECT machine, f AS fold, feature, place, x, count(*) AS n, sum(y) AS sy FROM o, g WHERE fold <> f GROUP BY ALL)""",
    """r AS (SELECT *, sum(n) OVER a AS nl, sum(sy) OVER a AS sl, sum(n) OVER t AS nt, sum(sy) OVER t AS st FROM s
  WINDOW a AS (PARTITION BY machine, fold, feature ORDER BY x ROWS UNBOUNDED PRECEDING), t AS (PARTITION BY machine, fold, feature))""",
    """b AS (SELECT *, row_number() OVER (PARTITION BY machine, fold
    ORDER BY nl * (nt - nl) / nt * (sl / nl - (st - sl) / (nt - nl)) * (sl / nl - (st - sl) / (nt - nl)) DESC, place, x) AS rn
  FROM r WHERE nl < nt)""") + "SELECT machine, CAST(fold AS BIGINT) AS fold, feature, x AS threshold FROM b WHERE rn = 1")
def q_forest_stumps(spark, sf):
    """The forest's first split, for every machine and fold: one tree of one level over all rows."""
    how = R.Forest(trees=1, max_depth=1, bootstrap=False)
    blocks, trees = M.forest_trees(f2(spark, sf), K, F2O, _STUMP, "net", how=how)
    return R.forest_nodes(trees, blocks, K, _STUMP, how).where("feature IS NOT NULL").select(*K, "fold", "feature", "threshold")


@query("cv_scores_all_models")
def q_cv_all(spark, sf):
    return rnd(M.cv_scores(f2(spark, sf), K, _P6, "net", M.RANKING_MODELS, hash_col="_h"), {"abs_mape_pct": 6, "abs_rmse": 4})


@query("linear_importance_all_features")
def q_linear_all(spark, sf):
    feats = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "p_size", "p_retailprice"]
    return _imp(M.linear_importance_all(f2(spark, sf), K, F2O, feats, "net"))


# ============================================================== E: jobs
_E1 = dict(codes=["P1", "P2", "P3"], start="2024-01-03", end="2024-01-28", min_target=5.0, max_target=45.0)


def _e1(spark, sf):
    return E.prepare_training(f1(spark, sf), F1_SCHEMA, target="purchase", **_E1)


@query("prepare_training", W(S.F1, """ff AS (SELECT time_bucket_local, """ + ", ".join(
    f"last_value({c} IGNORE NULLS) OVER w AS {c}" for c in ["prod_code", *S.EVENTS]) +
    """ FROM f1 WINDOW w AS (ORDER BY time_bucket_local ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""") +
       """SELECT time_bucket_local, click, error, purchase, signup, view FROM ff
  WHERE prod_code IN ('P1', 'P2', 'P3') AND time_bucket_local >= TIMESTAMP '2024-01-03'
    AND time_bucket_local <= TIMESTAMP '2024-01-28' AND purchase >= 5 AND purchase <= 45
    AND click IS NOT NULL AND error IS NOT NULL AND signup IS NOT NULL AND view IS NOT NULL""")
def q_prepare_training(spark, sf):
    return _e1(spark, sf)


_E1K = dict(codes=["A", "R"], start="1993-06-01", end="1998-03-31", min_target=2000.0, max_target=90000.0,
            sparse_threshold=0.998)
_E1F = list(F2_FEATURES)


def _e1_keyed_sql(result=None):
    """Step by step, one rule after the other (the job decides all at once); ``result`` selects something else."""
    carried = [c for c in ["prod_code", *_E1F]]
    order = "machine, time_bucket_local, l_orderkey, l_partkey, l_linenumber"
    return W(F2C,
             f"""ff AS (SELECT {order}, {", ".join(f"last_value({c} IGNORE NULLS) OVER w AS {c}" for c in carried)} FROM f2
  WINDOW w AS (PARTITION BY machine ORDER BY {ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
             "pf AS (SELECT * FROM ff WHERE prod_code IN ('A', 'R'))",
             f"p6 AS (SELECT machine, {', '.join(f'count({c}) > count(*) * 0.998 AS k_{c}' for c in _E1F)} FROM pf GROUP BY machine)",
             f"""a6 AS (SELECT {order}, {", ".join(f"CASE WHEN k_{c} THEN {c} END AS {c}" for c in _E1F)}
  FROM pf JOIN p6 USING (machine)
  WHERE time_bucket_local >= TIMESTAMP '1993-06-01' AND time_bucket_local <= TIMESTAMP '1998-03-31')""",
             f"p8 AS (SELECT machine, {', '.join(f'coalesce(var_pop({c}) > 0, false) AS v_{c}' for c in _E1F)} FROM a6 GROUP BY machine)",
             f"""a8 AS (SELECT {order}, {", ".join(f"CASE WHEN v_{c} THEN {c} END AS {c}" for c in _E1F)}
  FROM a6 JOIN p8 USING (machine) WHERE v_net)""",
             "g10 AS (SELECT machine, max(net) AS hi FROM a8 GROUP BY machine)",
             f"a10 AS (SELECT a8.* FROM a8 JOIN g10 USING (machine) WHERE hi < 2000 OR net >= 2000)",
             "g11 AS (SELECT machine, min(net) AS lo FROM a10 GROUP BY machine)",
             f"a11 AS (SELECT a10.* FROM a10 JOIN g11 USING (machine) WHERE lo >= 90000 OR net <= 90000)",
             f"p12 AS (SELECT machine, {', '.join(f'count({c}) > 0 AS h_{c}' for c in _E1F)} FROM a11 GROUP BY machine)") + \
        (result or f"SELECT {order}, {', '.join(_E1F)} FROM a11 JOIN p12 USING (machine) WHERE {_E1_COMPLETE}")


_E1_COMPLETE = " AND ".join(f"(NOT h_{c} OR {c} IS NOT NULL)" for c in _E1F)


def _e1_report_sql():
    """Rows by counting each step's table, columns by its rules' flags."""
    dense = " + ".join(f"CAST(k_{c} AS INT)" for c in _E1F)
    varied = " + ".join(f"CAST(k_{c} AND v_{c} AS INT)" for c in _E1F)
    gone = " + ".join(f"CAST(k_{c} AND v_{c} AS INT)" for c in _E1F if c not in _E1_EXCLUDE)
    complete = f"(SELECT a11.* FROM a11 JOIN p12 USING (machine) WHERE {_E1_COMPLETE})"
    # (rows of, columns) of each step
    steps = [("pf", str(len(_E1F))), ("pf", dense), ("a6", dense), ("a6", varied), ("a10", varied), ("a11", varied),
             (complete, varied), (complete, gone)]
    parts = [f"""SELECT p6.machine, {i} AS step_no, '{E.STEPS[i - 1]}' AS step,
  (SELECT count(*) FROM {rows} x WHERE x.machine = p6.machine) AS n_rows, CAST({cols} AS BIGINT) AS n_cols
FROM p6 LEFT JOIN p8 USING (machine)""" for i, (rows, cols) in enumerate(steps, 1)]
    return _e1_keyed_sql("SELECT *, CASE WHEN n_rows = 0 THEN 'no data' WHEN n_rows < n_cols THEN 'not enough data' "
                         "ELSE 'ok' END AS status FROM (" + " UNION ALL ".join(parts) + ")")


@query("prepare_training_keyed", _e1_keyed_sql())
def q_prepare_training_keyed(spark, sf):
    return E.prepare_training(f2(spark, sf), F2_SCHEMA, target="net", **_E1K)


_E1_EXCLUDE = ["p_size"]


@query("prepare_training_report", _e1_report_sql())
def q_prepare_training_report(spark, sf):
    """S5 and P15 after every step of E1, for every machine."""
    return E.prepare_training_with_report(f2(spark, sf), F2_SCHEMA, target="net", exclude=_E1_EXCLUDE, **_E1K)[1]


@query("rank_drivers")
def q_rank_drivers(spark, sf):
    """All machines, all four models, every feature that the preparation leaves."""
    prepared = E.prepare_training(f2(spark, sf), F2_SCHEMA, target="net", **_E1K)
    return rnd(E.rank_drivers(prepared, F2_SCHEMA, "net"), {"feature_importance": 6, "index": 6, "bar": 6})


@query("drill_down")
def q_drill_down(spark, sf):
    return _summary_round(E.drill_down(_e1(spark, sf), [], "purchase", ["click", "view"]))


@query("drill_down_peaks", W(F2C, *_peak_depth_ctes(), *S.segment_ctes("s_", "lxy", K, "t_nodes", exact_scale=6))
       + _SUMSQL)
def q_drill_down_peaks(spark, sf):
    d = f2(spark, sf)
    out = E.drill_down_peaks(d, K, "net", _PKV, exact_scale=6)
    return _summary_round(out.drop("status"))


@query("drill_down_peaks_histogram", W(F2C, *_peak_depth_ctes(), *S.hist_ctes("g_", "lx", K, 100)) + """
SELECT machine, variable, bin, round(bin_lo, 9) AS bin_lo, round(bin_hi, 9) AS bin_hi, n,
  coalesce(bool_or(t.threshold >= bin_lo AND (t.threshold < bin_hi OR (bin = 99 AND t.threshold <= bin_hi))),
           false) AS has_split
FROM g_h LEFT JOIN t_nodes t USING (machine, variable) GROUP BY ALL""")
def q_drill_down_peaks_histogram(spark, sf):
    out = E.drill_down_outputs(f2(spark, sf), K, "net", _PKV, "peaks")["histogram"]
    return rnd(out, {"bin_lo": 9, "bin_hi": 9})


@query("drill_down_peaks_boxes", W(F2C, *_peak_depth_ctes(), *S.segment_ctes("s_", "lxy", K, "t_nodes", exact_scale=6),
                                   _BOX_CTE) + _BOX_SQL)
def q_drill_down_peaks_boxes(spark, sf):
    out = E.drill_down_outputs(f2(spark, sf), K, "net", _PKV, "peaks")["boxes"]
    return rnd(out, {"q1": 8, "median": 8, "q3": 8})


@query("drill_down_mixture_splits")
def q_drill_down_mixture_splits(spark, sf):
    out = E.drill_down_outputs(f2(spark, sf), K, "net", _PKV, "mixture")["mixture_splits"]
    return rnd(out, {"threshold": 6})


def _e5_sql():
    ff = """ff AS (SELECT time_bucket_local, last_value(purchase IGNORE NULLS) OVER (ORDER BY time_bucket_local
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS purchase FROM f1)"""
    raw = "lr AS (SELECT 'purchase' AS variable, purchase AS x FROM ff WHERE purchase IS NOT NULL)"
    cl = "lc AS (SELECT 'purchase' AS variable, purchase AS x FROM ff WHERE purchase >= 5 AND purchase < 45)"
    return W(S.F1, ff, raw, cl, *_nokey_hist("r_", "lr"), *_nokey_hist("c_", "lc")) + """
SELECT 'raw' AS stage, variable, bin, round(bin_lo, 9) AS bin_lo, round(bin_hi, 9) AS bin_hi, n FROM r_h
UNION ALL SELECT 'clipped', variable, bin, round(bin_lo, 9), round(bin_hi, 9), n FROM c_h"""


def _nokey_hist(p, long):
    return S.hist_ctes(p, long, [], 100)


@query("target_profile", _e5_sql())
def q_target_profile(spark, sf):
    d = P.forward_fill(f1(spark, sf).select("time_bucket_local", "purchase"), F1_SCHEMA)
    return rnd(E.target_profile(d, [], "purchase", 5.0, 45.0), {"bin_lo": 9, "bin_hi": 9})


@query("target_profile_rolling", W(F2C, """st AS (SELECT 'raw' AS stage, * FROM f2 UNION ALL
  SELECT 'clipped', * FROM f2 WHERE net >= 2000 AND net < 90000)""") + f"""
SELECT stage, machine, {ORD}, net, round(CASE WHEN count(net) OVER w = 48 THEN avg(net) OVER w END, 8) AS net_moving_avg
FROM st WINDOW w AS (PARTITION BY stage, machine ORDER BY {ORD} ROWS BETWEEN 47 PRECEDING AND CURRENT ROW)""")
def q_target_profile_rolling(spark, sf):
    """E5's rolling view of every machine's target; eight digits, as sums of four decimals over 48 have no ties there."""
    out = E.target_rolling(f2(spark, sf), K, F2_SCHEMA.order, "net", 2000.0, 90000.0)
    return rnd(out, {"net_moving_avg": 8})
