"""DuckDB oracle SQL for the registered queries.

The oracle is an independent formulation of each operator in plain SQL
(windows, aggregates, joins); the helpers below only assemble repeated CTE
text.  Doubles that come out of different summation orders are rounded the
same way on both sides.
"""

from __future__ import annotations

F2 = """f2 AS (
  SELECT l.l_suppkey AS machine, l.l_shipdate AS time_bucket_local, l.l_orderkey, l.l_partkey,
         l.l_linenumber, l.l_returnflag AS prod_code, l.l_quantity, l.l_extendedprice, l.l_discount,
         l.l_tax, CAST(p.p_size AS DOUBLE) AS p_size, p.p_retailprice,
         CASE WHEN l.l_orderkey % 10 < 2 THEN l.l_quantity END AS sparse20,
         CAST(1.0 AS DOUBLE) AS const1, CAST(0.0 AS DOUBLE) AS zero0,
         l.l_extendedprice * (1 - l.l_discount) * (1 + l.l_tax) AS net,
         (l.l_orderkey * 7919 + l.l_partkey * 104729 + l.l_linenumber * 31 + 7) % 1000 AS _h
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)"""

F2_ORDER = "time_bucket_local, l_orderkey, l_partkey, l_linenumber"
F2_COLS = ["machine", "time_bucket_local", "l_orderkey", "l_partkey", "l_linenumber", "prod_code",
           "l_quantity", "l_extendedprice", "l_discount", "l_tax", "p_size", "p_retailprice",
           "sparse20", "const1", "zero0", "net", "_h"]
F2_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "p_size", "p_retailprice",
               "sparse20", "const1", "zero0", "net"]
EVENTS = ["click", "error", "purchase", "signup", "view"]


def _ev_aggs():
    return ", ".join(f"avg(CASE WHEN event_type = '{e}' THEN value END) AS {e}" for e in EVENTS)


F1 = f"""f1 AS (
  SELECT 'P' || CAST(floor(hour(b) / 6) AS BIGINT) AS prod_code, b AS time_bucket_utc,
         b AS time_bucket_local, {", ".join(EVENTS)}
  FROM (SELECT time_bucket(INTERVAL 30 MINUTES, ts) AS b, {_ev_aggs()} FROM events GROUP BY 1))"""

F1K = f"""f1k AS (
  SELECT site, machine, 'P' || CAST(floor(hour(b) / 6) AS BIGINT) AS prod_code, b AS time_bucket_utc,
         b AS time_bucket_local, {", ".join(EVENTS)}
  FROM (SELECT 's' || CAST(user_id % 2 AS VARCHAR) AS site, 'm' || CAST(user_id % 3 AS VARCHAR) AS machine,
               time_bucket(INTERVAL 30 MINUTES, ts) AS b, {_ev_aggs()}
        FROM events GROUP BY 1, 2, 3))"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def klist(keys, prefix=""):
    return ", ".join(f"{prefix}{k}" for k in keys)


def gcols(keys, prefix=""):
    """Group columns: keys then variable."""
    return ", ".join(f"{prefix}{k}" for k in [*keys, "variable"])


def kjoin(a, b, keys):
    return " AND ".join(f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in [*keys, "variable"])


def long_xy(name, src, keys, cols, y=None):
    """(keys, variable, x[, y]) with NULLs dropped."""
    parts = []
    for c in cols:
        ysel = f", {y} AS y" if y else ""
        ycond = f" AND {y} IS NOT NULL" if y else ""
        parts.append(f"SELECT {klist(keys)}, '{c}' AS variable, CAST({c} AS DOUBLE) AS x{ysel} "
                     f"FROM {src} WHERE {c} IS NOT NULL{ycond}")
    return f"{name} AS ({' UNION ALL '.join(parts)})"


def hist_ctes(p, long, keys, bins):
    """{p}h: (keys, variable, bin, bin_lo, bin_hi, n) -- NumPy's equal-width bins."""
    g = gcols(keys)
    B = f"CAST({bins} AS DOUBLE)"

    def edge(i):
        return f"(CASE WHEN {i} >= {bins} THEN hi ELSE lo + {i} * ((hi - lo) / {B}) END)"
    return [
        f"""{p}rng AS (SELECT {g}, CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
              CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi FROM {long} GROUP BY ALL)""",
        f"""{p}b0 AS (SELECT l.*, r.lo, r.hi, least(floor((l.x - r.lo) * ({B} / (r.hi - r.lo))), {bins - 1}) AS i0
              FROM {long} l JOIN {p}rng r USING ({g}))""",
        f"""{p}b1 AS (SELECT {g}, CAST(CASE WHEN x < {edge('i0')} THEN i0 - 1
              WHEN x >= {edge('(i0 + 1)')} AND i0 <> {bins - 1} THEN i0 + 1 ELSE i0 END AS BIGINT) AS bin
              FROM {p}b0)""",
        f"""{p}cnt AS (SELECT {g}, bin, count(*) AS n FROM {p}b1 GROUP BY ALL)""",
        f"""{p}grid AS (SELECT {g}, CAST(t.bin AS BIGINT) AS bin, lo, hi FROM {p}rng, range({bins}) t(bin))""",
        f"""{p}h AS (SELECT {g}, bin, {edge('bin')} AS bin_lo, {edge('(bin + 1)')} AS bin_hi,
              CAST(coalesce(n, 0) AS BIGINT) AS n
              FROM {p}grid LEFT JOIN {p}cnt USING ({g}, bin))""",
    ]


def peak_ctes(p, keys, bins=10, share=0.1):
    """{p}peaks: (keys, variable, bin, peak) from {p}h."""
    g = gcols(keys)
    return [
        f"""{p}h1 AS (SELECT *, CASE WHEN lag(n) OVER (PARTITION BY {g} ORDER BY bin) = n THEN 0 ELSE 1 END AS chg
              FROM {p}h)""",
        f"""{p}h2 AS (SELECT *, sum(chg) OVER (PARTITION BY {g} ORDER BY bin
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM {p}h1)""",
        f"""{p}runs AS (SELECT {g}, run, min(bin) AS s, max(bin) AS e, max(n) AS hgt FROM {p}h2 GROUP BY ALL)""",
        f"""{p}runs2 AS (SELECT *, lag(hgt) OVER (PARTITION BY {g} ORDER BY run) AS prv,
              lead(hgt) OVER (PARTITION BY {g} ORDER BY run) AS nxt FROM {p}runs)""",
        f"""{p}ntot AS (SELECT {g}, sum(n) AS ntot FROM {p}h GROUP BY ALL)""",
        f"""{p}pk AS (SELECT {gcols(keys, 'r.')}, CAST(floor((s + e) / 2) AS BIGINT) AS bin
              FROM {p}runs2 r JOIN {p}ntot USING ({g})
              WHERE s >= 1 AND e <= {bins - 2} AND prv < hgt AND nxt < hgt
                AND hgt >= ntot * CAST({share} AS DOUBLE) AND hgt <= ntot)""",
        f"""{p}peaks AS (SELECT {g}, bin, h.bin_hi AS peak FROM {p}pk JOIN {p}h h USING ({g}, bin))""",
    ]


def tree_ctes(p, long, keys, depth_sql="1", depth_join=None, min_split=0.2):
    """{p}nodes: (keys, variable, node, threshold, n_left) -- exact best splits.

    ``depth_sql`` is an expression over ``{p}tot`` (and ``depth_join``'s columns).
    """
    g = gcols(keys)
    w = f"PARTITION BY {g} ORDER BY x"
    run = f"OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    dj = f" LEFT JOIN {depth_join} USING ({g})" if depth_join else ""
    return [
        f"""{p}gm AS (SELECT {g}, avg(y) AS ybar FROM {long} GROUP BY ALL)""",
        f"""{p}px AS (SELECT {g}, x, count(*) AS n, sum(y - ybar) AS s, sum((y - ybar) * (y - ybar)) AS q
              FROM {long} JOIN {p}gm USING ({g}) GROUP BY ALL)""",
        f"""{p}sc AS (SELECT *, sum(n) {run} AS cn, sum(s) {run} AS cs, sum(q) {run} AS cq,
              row_number() OVER ({w}) - 1 AS rn FROM {p}px)""",
        f"""{p}tot AS (SELECT {g}, sum(n) AS nt, sum(s) AS st, sum(q) AS qt FROM {p}px GROUP BY ALL)""",
        f"""{p}t2 AS (SELECT {p}tot.*, {depth_sql} AS depth,
              greatest(ceil(nt * CAST({min_split} AS DOUBLE)), 2) AS min_split,
              1e-12 * greatest(qt / nt, 1e-300) AS var_tol FROM {p}tot{dj})""",
        f"""{p}s AS (SELECT * FROM {p}sc JOIN {p}t2 USING ({g}))""",
        f"""{p}root AS (SELECT *, cs * cs / cn + (st - cs) * (st - cs) / (nt - cn) - st * st / nt AS g
              FROM {p}s WHERE cn < nt AND nt >= min_split AND qt / nt - (st / nt) * (st / nt) > var_tol)""",
        f"""{p}rootb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY g DESC, x) AS pick
              FROM {p}root) WHERE pick = 1)""",
        f"""{p}s2 AS (SELECT {p}s.*, r.rn AS rrn, r.cn AS rcn, r.cs AS rcs, r.cq AS rcq
              FROM {p}s JOIN (SELECT {g}, rn, cn, cs, cq FROM {p}rootb) r USING ({g}) WHERE depth >= 2)""",
        f"""{p}lc AS (SELECT {g}, 'left' AS node, x, rn, cn AS nl,
              cs * cs / cn + (rcs - cs) * (rcs - cs) / (rcn - cn) - rcs * rcs / rcn AS g FROM {p}s2
              WHERE rn < rrn AND rcn >= min_split AND rcq / rcn - (rcs / rcn) * (rcs / rcn) > var_tol)""",
        f"""{p}rc AS (SELECT {g}, 'right' AS node, x, rn, cn - rcn AS nl,
              (cs - rcs) * (cs - rcs) / (cn - rcn)
              + ((st - rcs) - (cs - rcs)) * ((st - rcs) - (cs - rcs)) / ((nt - rcn) - (cn - rcn))
              - (st - rcs) * (st - rcs) / (nt - rcn) AS g FROM {p}s2
              WHERE rn > rrn AND cn < nt AND (nt - rcn) >= min_split
                AND (qt - rcq) / (nt - rcn) - ((st - rcs) / (nt - rcn)) * ((st - rcs) / (nt - rcn)) > var_tol)""",
        f"""{p}best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {g}, node ORDER BY g DESC, x) AS pick
              FROM (SELECT {g}, 'root' AS node, x, rn, cn AS nl, g FROM {p}rootb
                    UNION ALL SELECT * FROM {p}lc UNION ALL SELECT * FROM {p}rc)) WHERE pick = 1)""",
        f"""{p}nodes AS (SELECT {gcols(keys, 'b.')}, b.node,
              CASE WHEN b.x / 2.0 + n.x / 2.0 = n.x THEN b.x ELSE b.x / 2.0 + n.x / 2.0 END AS threshold,
              CAST(b.nl AS BIGINT) AS n_left
              FROM {p}best b JOIN {p}sc n ON ({kjoin('b', 'n', keys)} AND n.rn = b.rn + 1))""",
    ]


def label_sql(x):
    r = f"CAST(floor(abs({x}) * 100 + 0.5) AS BIGINT)"
    return (f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || CAST(CAST(floor({r} / 100) AS BIGINT) AS VARCHAR)"
            f" || '.' || lpad(CAST({r} % 100 AS VARCHAR), 2, '0'))")


def segment_ctes(p, long, keys, splits, share=0.1, exact_scale=None):
    """{p}rows: (keys, variable, x, y, segment, seg_lo, seg_hi, label, share, is_outlier)
    from ``splits`` (keys, variable, threshold)."""
    g = gcols(keys)
    if exact_scale is None:
        mean = "avg(y)"
    else:
        u = f"sum(CAST(round(y * 1e{exact_scale}) AS HUGEINT))"
        mean = f"CAST((2 * {u} + count(y)) // (2 * count(y)) AS DOUBLE) / 1e{exact_scale}"
    lab_lo = label_sql("seg_lo")
    lab_hi = label_sql("seg_hi")

    def label(outlier):
        return (f"(CASE WHEN seg_lo IS NULL THEN '<' || {lab_hi} "
                f"WHEN seg_hi IS NULL THEN (CASE WHEN m = 1 THEN '>=' ELSE '>' END) || {lab_lo} "
                f"ELSE {lab_lo} || '-' || {lab_hi} END) || (CASE WHEN {outlier} THEN ' (Outlier)' ELSE '' END)")
    return [
        f"""{p}arr AS (SELECT {g}, list_sort(list(threshold)) AS splits FROM {splits} GROUP BY ALL)""",
        f"""{p}seg0 AS (SELECT l.*, a.splits, len(a.splits) AS m,
              CAST(len(list_filter(a.splits, lambda s: s <= l.x)) AS BIGINT) AS segment
              FROM {long} l JOIN {p}arr a USING ({g}))""",
        f"""{p}seg1 AS (SELECT *, CASE WHEN segment > 0 THEN splits[segment] END AS seg_lo,
              CASE WHEN segment < m THEN splits[segment + 1] END AS seg_hi FROM {p}seg0)""",
        f"""{p}segn AS (SELECT {g}, segment, count(*) AS sn FROM {p}seg1 GROUP BY ALL)""",
        f"""{p}segs AS (SELECT {g}, segment, sn / sum(sn) OVER (PARTITION BY {g}) AS share FROM {p}segn)""",
        f"""{p}seg2 AS (SELECT s.*, sh.share, (m >= 2 AND sh.share < {share}) AS is_outlier
              FROM {p}seg1 s JOIN {p}segs sh USING ({g}, segment))""",
        f"""{p}rows AS (SELECT {g}, x, y, segment, seg_lo, seg_hi, {label('is_outlier')} AS label, share, is_outlier
              FROM {p}seg2)""",
        f"""{p}cats AS (SELECT {g}, a.splits, len(a.splits) AS m, CAST(t.segment AS BIGINT) AS segment
              FROM {p}arr a, LATERAL (SELECT unnest(range(len(a.splits) + 1)) AS segment) t)""",
        f"""{p}cats2 AS (SELECT *, CASE WHEN segment > 0 THEN splits[segment] END AS seg_lo,
              CASE WHEN segment < m THEN splits[segment + 1] END AS seg_hi FROM {p}cats)""",
        f"""{p}summary AS (SELECT {g}, segment, seg_lo, seg_hi,
              coalesce(a.label, {label('m >= 2')}) AS label,
              CAST(coalesce(a.n, 0) AS BIGINT) AS n, coalesce(a.share, 0.0) AS share, a.mean_target
              FROM {p}cats2 LEFT JOIN (SELECT {g}, segment, count(*) AS n, {mean} AS mean_target,
                                                max(label) AS label, max(share) AS share
                                         FROM {p}rows GROUP BY ALL) a USING ({g}, segment))""",
    ]
