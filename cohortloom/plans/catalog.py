"""Named queries over the driver's tables, each with the SQL that gives the same rows.

Doubles are rounded alike in both engines, counts are BIGINT, every column is named.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.functions import dates, dialysis, numeric
from cohortloom.operators import compare, prepare, profile, series, survival

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query of (read), where read(table) is the table's frame."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, integers as BIGINT, by the columns' types."""
    out = {c: F.round(c, places) if t == "double" else F.col(c).cast("long") for c, t in df.dtypes if t in ("double", "int", "bigint")}
    return df.withColumns(out)


# ---- target attainment, profiles, missing data -------------------------------------------------------------------------


@query("target_attainment", """
SELECT coalesce(l_returnflag, '(all)') AS level, count(l_quantity)::BIGINT AS n, count(*) FILTER (l_quantity >= 10 AND l_quantity < 40)::BIGINT AS achieved,
  round(count(*) FILTER (l_quantity >= 10 AND l_quantity < 40) / count(l_quantity)::DOUBLE, 6) AS rate,
  count(*) FILTER (l_quantity = 10)::BIGINT AS at_low, count(*) FILTER (l_quantity = 40)::BIGINT AS at_high
FROM lineitem GROUP BY GROUPING SETS ((), (l_returnflag))
""")  # fmt: skip
def _attainment(read):
    return rounded(compare.attainment(read("lineitem"), "l_quantity", 10, 40, "l_returnflag", high_closed=False))


_ORDER_COLUMNS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


@query("column_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*)::BIGINT AS n, (count(*) - count({c}))::BIGINT AS n_null, count(DISTINCT {c})::BIGINT AS n_distinct, "
    f"round(count(DISTINCT {c}) / count({c})::DOUBLE, 6) AS unique_ratio, round((SELECT max(k) FROM (SELECT count(*) AS k FROM orders GROUP BY {c})) / count({c})::DOUBLE, 6) AS top_share FROM orders"
    for c in _ORDER_COLUMNS
))
def _profile(read):
    return rounded(profile.column_profile(read("orders"), _ORDER_COLUMNS))


def _holes(read):
    """events with values missing by a fixed rule."""
    e = read("events")
    return e.select("event_id", "event_type", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 5 != 0, F.col("user_id")).alias("user_id"), F.when(F.col("event_id") % 35 != 1, F.col("props")).alias("props"))


_HOLES = "WITH h AS (SELECT event_id, event_type, CASE WHEN event_id % 7 <> 0 THEN value END AS value, CASE WHEN event_id % 5 <> 0 THEN user_id END AS user_id, CASE WHEN event_id % 35 <> 1 THEN props END AS props FROM events) "


@query("missing_summary", _HOLES + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {i}::BIGINT AS ordinal, (count(*) - count({c}))::BIGINT AS n_missing, round((count(*) - count({c})) / count(*)::DOUBLE, 6) AS rate FROM h"
    for i, c in enumerate(("event_type", "value", "user_id", "props"))
))
def _missing(read):
    return rounded(profile.missing_summary(_holes(read), ["event_type", "value", "user_id", "props"]))


@query("missing_distribution", _HOLES + "SELECT ((value IS NULL)::INT + (user_id IS NULL)::INT + (props IS NULL)::INT)::BIGINT AS n_missing, count(*)::BIGINT AS rows FROM h GROUP BY 1")
def _missing_distribution(read):
    return rounded(profile.missing_distribution(_holes(read), ["value", "user_id", "props"]))


@query("missing_patterns", _HOLES + "SELECT (value IS NULL)::INT::VARCHAR || (user_id IS NULL)::INT::VARCHAR || (props IS NULL)::INT::VARCHAR AS pattern, count(*)::BIGINT AS rows FROM h GROUP BY 1 ORDER BY rows DESC, pattern LIMIT 20")
def _patterns(read):
    return profile.missing_patterns(_holes(read), ["value", "user_id", "props"])


@query("missing_by_group", _HOLES + "SELECT event_type, round(avg((value IS NULL)::INT), 6) AS value, round(avg((user_id IS NULL)::INT), 6) AS user_id FROM h GROUP BY 1")
def _missing_by_group(read):
    return rounded(profile.missing_by_group(_holes(read), "event_type", ["value", "user_id"]))


# ---- outliers ----------------------------------------------------------------------------------------------------------


@query("limits_iqr", "SELECT round(a - 1.5 * (b - a), 4) AS low, round(b + 1.5 * (b - a), 4) AS high FROM (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem)")
def _iqr(read):
    return rounded(profile.iqr_limits(read("lineitem"), "l_extendedprice"), 4)


@query("limits_mad", "WITH m AS (SELECT median(l_extendedprice) AS m FROM lineitem), d AS (SELECT median(abs(l_extendedprice - m)) AS d FROM lineitem, m) SELECT round(m - d * 1.4826 * 3, 4) AS low, round(m + d * 1.4826 * 3, 4) AS high FROM m, d")
def _mad(read):
    return rounded(profile.mad_limits(read("lineitem"), "l_extendedprice"), 4)


@query("limits_quantile", "SELECT round(quantile_cont(l_extendedprice, 0.01), 4) AS low, round(quantile_cont(l_extendedprice, 0.99), 4) AS high FROM lineitem")
def _quantile(read):
    return rounded(profile.quantile_limits(read("lineitem"), "l_extendedprice"), 4)


_LIMITS = "WITH q AS (SELECT c_mktsegment, quantile_cont(c_acctbal, 0.25) AS a, quantile_cont(c_acctbal, 0.75) AS b FROM customer GROUP BY 1)"


@query("outlier_flags_by_group", _LIMITS + " SELECT c_custkey, (c_acctbal < a - 0.25 * (b - a) OR c_acctbal > b + 0.25 * (b - a))::BIGINT AS flag FROM customer JOIN q USING (c_mktsegment)")
def _flags(read):
    df = read("customer")
    out = profile.flag_outliers(df, "c_acctbal", profile.iqr_limits(df, "c_acctbal", ["c_mktsegment"], fold=0.25), ["c_mktsegment"])
    return out.select("c_custkey", F.col("c_acctbal__outlier").cast("long").alias("flag"))


@query("winsorized", "WITH q AS (SELECT quantile_cont(value, 0.05) AS a, quantile_cont(value, 0.95) AS b FROM events) SELECT event_id, round(least(greatest(value, a), b), 6) AS value FROM events, q")
def _winsorized(read):
    df = read("events")
    return rounded(profile.flag_outliers(df, "value", profile.quantile_limits(df, "value", low=0.05, high=0.95), action="winsorize").select("event_id", "value"))


@query("robust_z", "WITH m AS (SELECT median(p_retailprice) AS m FROM part), d AS (SELECT median(abs(p_retailprice - m)) AS d FROM part, m) SELECT p_partkey, round((p_retailprice - m) / (1.4826 * d), 5) AS robust_z FROM part, m, d")
def _robust(read):
    return rounded(profile.robust_z(read("part"), "p_retailprice").select("p_partkey", "robust_z"), 5)


@query("entry_suspects", """
WITH x AS (SELECT event_id, CASE WHEN event_id = 100 THEN value * 1000 + 100000 ELSE value END AS v FROM events), m AS (SELECT median(v) AS m FROM x),
d AS (SELECT median(abs(v - m)) AS d FROM x, m), z AS (SELECT event_id, v, (v - m) / (1.4826 * d) AS z FROM x, m, d),
r AS (SELECT *, row_number() OVER (ORDER BY z DESC, event_id) AS k, lead(z) OVER (ORDER BY z DESC, event_id) AS nz, lead(v) OVER (ORDER BY z DESC, event_id) AS nv FROM z)
SELECT 'high' AS side, k::BIGINT AS rank, event_id AS row, round(v, 4) AS value, round(nv, 4) AS next_value FROM r
WHERE k <= (SELECT coalesce(max(k), 0) FROM r WHERE k <= 5 AND z >= 10 AND z / greatest(nz, 1) >= 3)
""")  # fmt: skip
def _suspects(read):
    df = read("events").withColumn("v", F.when(F.col("event_id") == 100, F.col("value") * 1000 + 100000).otherwise(F.col("value")))
    return rounded(profile.entry_suspects(df, "v", "event_id").select("side", "rank", "row", "value", "next_value"), 4)


# ---- comparison --------------------------------------------------------------------------------------------------------


@query("group_moments", "SELECT l_linestatus, count(l_quantity)::BIGINT AS n, round(avg(l_quantity), 6) AS mean, round(var_samp(l_quantity), 6) AS var FROM lineitem GROUP BY 1")
def _moments(read):
    return rounded(compare.moments(read("lineitem"), "l_quantity", "l_linestatus"))


@query("rank_sums", "SELECT c_mktsegment, count(*)::BIGINT AS n, round(sum(k), 2) AS rank_sum FROM (SELECT c_mktsegment, rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0 AS k FROM customer) GROUP BY 1")
def _rank_sums(read):
    return rounded(compare.rank_sums(read("customer"), "c_acctbal", "c_mktsegment"), 2)


@query("chi2_cramers_v", """
WITH t AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2), r AS (SELECT a, sum(n) AS ra FROM t GROUP BY 1), c AS (SELECT b, sum(n) AS cb FROM t GROUP BY 1),
s AS (SELECT sum(n * n / (ra * cb)) AS s, sum(n) AS n, count(DISTINCT a)::DOUBLE AS r, count(DISTINCT b)::DOUBLE AS k FROM t JOIN r USING (a) JOIN c USING (b))
SELECT round(n * (s - 1), 4) AS chi2, n::BIGINT AS n, r::BIGINT AS rows, k::BIGINT AS columns,
  round(sqrt(greatest(s - 1 - (k - 1) * (r - 1) / (n - 1), 0) / (least(r - (r - 1) * (r - 1) / (n - 1), k - (k - 1) * (k - 1) / (n - 1)) - 1)), 4) AS v FROM s
""")  # fmt: skip
def _chi2(read):
    return rounded(compare.chi_square(read("orders"), "o_orderstatus", "o_orderpriority"), 4)


@query("eta_squared", "WITH g AS (SELECT count(*) AS n, avg(c_acctbal) AS m FROM customer GROUP BY c_mktsegment), t AS (SELECT count(*) AS nn, avg(c_acctbal) AS mm, var_pop(c_acctbal) AS v FROM customer) SELECT round(sum(n * (m - mm) * (m - mm)) / max(nn * v), 8) AS eta_squared FROM g, t")
def _eta(read):
    return rounded(compare.eta_squared(read("customer"), "c_acctbal", "c_mktsegment"), 8)


@query("pearson_corr", "SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, count(*)::BIGINT AS n, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', count(*), round(corr(l_quantity, l_discount), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', count(*), round(corr(l_extendedprice, l_discount), 6) FROM lineitem")
def _pearson(read):
    return rounded(compare.pearson(read("lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


@query("spearman_corr", "SELECT count(*)::BIGINT AS n, round(corr(x, y), 6) AS rho FROM (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS x, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS y FROM lineitem)")
def _spearman(read):
    return rounded(compare.spearman(read("lineitem"), "l_quantity", "l_extendedprice"))


@query("univariate_auc", "WITH x AS (SELECT n_chars, quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS k FROM documents JOIN labels USING (doc_id)) SELECT count(*)::BIGINT AS n, round((sum(k) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2.0) / (count(*) FILTER (quality = 1) * count(*) FILTER (quality = 0)), 6) AS auc FROM x")
def _auc(read):
    return rounded(compare.auc(read("documents").select("doc_id", "n_chars").join(read("labels"), "doc_id"), "n_chars", "quality"))


@query("paired_values", """
WITH f AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS k FROM events WHERE value IS NOT NULL AND event_type IN ('click', 'view'))
SELECT x.user_id, x.value AS a, y.value AS b FROM f x JOIN f y ON x.user_id = y.user_id AND x.k = 1 AND y.k = 1 AND x.event_type = 'click' AND y.event_type = 'view'
""")  # fmt: skip
def _paired(read):
    return series.paired(read("events"), "event_type", "user_id", "value", "click", "view", ["ts", "event_id"])


# ---- rows, spellings ---------------------------------------------------------------------------------------------------


@query("censored_numbers", """
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber,
  round(CASE WHEN l_linenumber = 1 THEN l_quantity / 2 WHEN l_linenumber = 4 THEN NULL ELSE l_quantity END, 6) AS value,
  (l_linenumber = 1)::BIGINT AS low, (l_linenumber = 2)::BIGINT AS high FROM lineitem
""")  # fmt: skip
def _censored(read):
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("string")
    s = F.when(n == 1, F.concat(F.lit("＜"), q)).when(n == 2, F.concat(q, F.lit(" 以上"))).when(n == 3, F.concat(q, F.lit(" mg/dL"))).when(n == 4, F.lit("ー")).otherwise(q)
    return rounded(read("lineitem").select("l_orderkey", "l_linenumber", numeric.censored(s).alias("x")).select("l_orderkey", "l_linenumber", F.col("x.value").alias("value"), F.col("x.low").alias("low"), F.col("x.high").alias("high")))


@query("unit_rescaled", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity AS value FROM lineitem")
def _rescaled(read):
    mixed = F.when(F.col("l_linenumber") == 1, F.col("l_quantity") * 100).otherwise(F.col("l_quantity"))
    return rounded(read("lineitem").select("l_orderkey", "l_linenumber", numeric.rescaled(mixed, 0.5, 99, [100, 0.01]).alias("value")))


@query("date_notations", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def _dates(read):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    s = F.when(k == 0, F.date_format(d, "yyyy/M/d")).when(k == 1, F.date_format(d, "yyyyMMdd")).when(k == 2, F.date_format(d, "yyyy年MM月dd日")).otherwise(F.datediff(d, F.lit("1899-12-30").cast("date")).cast("string"))
    df = read("orders").select("o_orderkey", s.alias("s"))
    return df.select("o_orderkey", dates.read_dates(df, ["s"])[0].expr.cast("string").alias("day"))


@query("clock_hours", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(l_quantity::INT % 24 + (l_orderkey % 60) / 60.0, 6) AS hours FROM lineitem")
def _clock(read):
    h, m = (F.col("l_quantity").cast("int") % 24), F.col("l_orderkey") % 60
    s = F.when(F.col("l_linenumber") % 2 == 0, F.format_string("%d:%02d", h, m)).otherwise(F.format_string("%d時%d分", h, m))
    return rounded(read("lineitem").select("l_orderkey", "l_linenumber", dates.to_hours(s).alias("hours")))


@query("dialysis_indices", """
WITH x AS (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity + 20 AS pre, (l_quantity + 20) * 0.35 AS post, 3.0 + l_discount * 10 AS td, 60 + l_tax * 100 AS wpre, 58 + l_tax * 100 AS wpost FROM lineitem),
k AS (SELECT *, -ln(post / pre - 0.008 * td) + (4 - 3.5 * post / pre) * (wpre - wpost) / wpost AS ktv FROM x)
SELECT l_orderkey, l_linenumber, round(100 * (1 - post / pre), 6) AS urr, round(ktv, 6) AS ktv, round(0.0136 * ktv * (pre + post) / 2 + 0.251, 6) AS npcr, round((post + pre) / 2, 6) AS tac FROM k
""")  # fmt: skip
def _dialysis(read):
    q = F.col("l_quantity") + 20
    x = read("lineitem").select("l_orderkey", "l_linenumber", q.alias("pre"), (q * 0.35).alias("post"), (F.col("l_discount") * 10 + 3.0).alias("td"), (F.col("l_tax") * 100 + 60).alias("wpre"), (F.col("l_tax") * 100 + 58).alias("wpost"))
    c = F.col
    x = x.withColumn("ktv", dialysis.sp_ktv(c("pre"), c("post"), c("td"), c("wpre"), c("wpost")))
    return rounded(x.select("l_orderkey", "l_linenumber", dialysis.urr(c("pre"), c("post")).alias("urr"), "ktv", dialysis.npcr(c("ktv"), c("pre"), c("post")).alias("npcr"), dialysis.tac_simple(c("post"), c("pre")).alias("tac")))


@query("nutrition_indices", """
WITH x AS (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, 2 + l_discount * 30 AS alb, 40 + l_quantity AS w, 150 + l_tax * 300 AS h, 8 + l_discount * 10 AS ca FROM lineitem)
SELECT l_orderkey, l_linenumber, round(w / (h / 100) / (h / 100), 6) AS bmi, round(14.89 * alb + 41.7 * least(w / (22 * h / 100 * h / 100), 1), 6) AS gnri, round(CASE WHEN alb < 4 THEN ca + 4 - alb ELSE ca END, 6) AS cca FROM x
""")  # fmt: skip
def _nutrition(read):
    alb, w, h, ca = F.col("l_discount") * 30 + 2, F.col("l_quantity") + 40, F.col("l_tax") * 300 + 150, F.col("l_discount") * 10 + 8
    return rounded(read("lineitem").select("l_orderkey", "l_linenumber", dialysis.bmi(w, h).alias("bmi"), dialysis.gnri(alb, w, h).alias("gnri"), dialysis.corrected_ca(ca, alb).alias("cca")))


@query("trapezoid_tac", """
WITH x AS (SELECT user_id, epoch(ts) / 3600.0 AS t, value AS c FROM events WHERE value >= 0), o AS (SELECT *, lead(t) OVER w - t AS dt, c + lead(c) OVER w AS cc FROM x WINDOW w AS (PARTITION BY user_id ORDER BY t, c))
SELECT user_id, round(CASE WHEN max(t) > min(t) AND count(*) FILTER (dt = 0) = 0 THEN sum(cc / 2 * dt) / (max(t) - min(t)) END, 4) AS tac, count(*)::BIGINT AS points FROM o GROUP BY 1
""")  # fmt: skip
def _tac(read):
    # timestamps without a zone: hours since the first moment of 1970, without leaving the JVM
    t = F.expr("CAST(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) AS DOUBLE) / 3600e6")
    return rounded(series.tac_trapezoid(read("events").withColumn("t", t), "user_id", "t", "value").select("user_id", "tac", "points"), 4)


# ---- survival ----------------------------------------------------------------------------------------------------------

_SURV = "WITH s AS (SELECT o_orderkey, o_orderpriority AS g, date_diff('day', o_orderdate::DATE, min(l_shipdate)::DATE)::DOUBLE AS t, (o_orderstatus = 'F')::INT AS e FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority, o_orderdate, o_orderstatus HAVING date_diff('day', o_orderdate::DATE, min(l_shipdate)::DATE) > 0) "
_TABLE = _SURV + ", c AS (SELECT g, t, sum(e) AS d, count(*) AS c FROM s GROUP BY 1, 2), r AS (SELECT g, t, d, sum(c) OVER (PARTITION BY g ORDER BY t DESC) AS n FROM c) "
_CURVE = _TABLE + ", k AS (SELECT g, t, n, d, exp(sum(CASE WHEN d < n THEN ln(1 - d / n::DOUBLE) ELSE -1e9 END) OVER (PARTITION BY g ORDER BY t)) AS s FROM r) "


def _surv(read):
    first = read("lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("ship"))
    df = read("orders").join(first, F.col("o_orderkey") == F.col("l_orderkey"))
    return df.select("o_orderkey", F.col("o_orderpriority").alias("g"), F.datediff(F.col("ship").cast("date"), F.col("o_orderdate").cast("date")).cast("double").alias("t"), (F.col("o_orderstatus") == "F").cast("int").alias("e")).filter("t > 0")


@query("km_curve", _CURVE + "SELECT g, t, n::BIGINT AS at_risk, d::BIGINT AS d, round(s, 6) AS survival FROM k")
def _km(read):
    return rounded(survival.km(_surv(read), "t", "e", "g").select("g", "t", "at_risk", "d", "survival"))


@query("km_median", _CURVE + "SELECT g, max(n)::BIGINT AS n, sum(d)::BIGINT AS events, min(t) FILTER (s <= 0.5) AS median FROM k GROUP BY 1")
def _km_median(read):
    return rounded(survival.km_median(_surv(read), "t", "e", "g").select("g", "n", "events", "median"))


@query("rmst", _CURVE + ", n AS (SELECT g, t, s, coalesce(lead(t) OVER (PARTITION BY g ORDER BY t), 60) AS u FROM k WHERE t <= 60) SELECT g, round(min(t) + sum(s * (u - t)), 5) AS rmst FROM n GROUP BY 1")
def _rmst(read):
    return rounded(survival.rmst(_surv(read), "t", "e", "g", tau=60.0), 5)


@query("logrank_oe", _TABLE + """, ev AS (SELECT t, sum(d) AS d FROM r GROUP BY 1 HAVING sum(d) > 0), lv AS (SELECT DISTINCT g FROM r),
p AS (SELECT ev.t, ev.d, lv.g, (SELECT coalesce(sum(c), 0) FROM c WHERE c.g = lv.g AND c.t >= ev.t) AS ng, (SELECT coalesce(sum(d), 0) FROM c WHERE c.g = lv.g AND c.t = ev.t) AS dg FROM ev, lv), q AS (SELECT *, sum(ng) OVER (PARTITION BY t) AS n FROM p)
SELECT g, sum(dg)::BIGINT AS observed, round(sum(d * ng / n::DOUBLE), 4) AS expected FROM q GROUP BY 1
""")  # fmt: skip
def _logrank(read):
    parts = survival.logrank_parts(_surv(read), "t", "e", "g")
    return rounded(parts.groupBy("g").agg(F.sum("d_g").alias("observed"), F.sum(F.col("d") * F.col("n_g") / F.col("n")).alias("expected")), 4)


@query("at_risk_ticks", _SURV + " SELECT g, k::DOUBLE AS tick, count(*) FILTER (t >= k)::BIGINT AS at_risk, count(*) FILTER (t <= k AND e = 1)::BIGINT AS events, count(*) FILTER (t <= k AND e = 0)::BIGINT AS censored FROM s, (VALUES (0), (30), (60), (90)) v(k) GROUP BY 1, 2")
def _ticks(read):
    return survival.at_ticks(_surv(read), "t", "e", [0, 30, 60, 90], "g")


@query("binary_at", _SURV + " SELECT o_orderkey, (CASE WHEN e = 1 AND t <= 30 THEN 1 WHEN t >= 30 THEN 0 END)::BIGINT AS y FROM s")
def _binary_at(read):
    return rounded(_surv(read).select("o_orderkey", survival.binary_at(F.col("t"), F.col("e"), 30.0).alias("y")))


@query("survival_reasons", "SELECT CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 3 = 0 THEN 'both dates' WHEN o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0 THEN 'no end date' WHEN o_orderkey % 7 = 0 THEN 'reversed' ELSE 'ok' END AS reason, count(*)::BIGINT AS n, round(sum(CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 3 = 0 OR o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0 OR o_orderkey % 7 = 0 THEN NULL ELSE 10 END)::DOUBLE, 2) AS days FROM orders GROUP BY 1")
def _reasons(read):
    k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    end = F.date_add(d, F.when(k % 7 == 0, -10).otherwise(10).cast("int"))
    out = survival.build_survival(read("orders"), d, F.when(k % 5 == 0, end), F.when(k % 3 == 0, end), F.lit("2100-01-01").cast("date"))
    return rounded(out.groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum("duration").alias("days")), 2)


# ---- splits and preparation --------------------------------------------------------------------------------------------


@query("time_split", "SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) <= greatest(1, round((SELECT count(*) FROM orders) * 0.25)) THEN 'test' ELSE 'train' END AS \"_split\" FROM orders")
def _time_split(read):
    return prepare.split_time(read("orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey").select("o_orderkey", "_split")


@query("smd_balance", "SELECT 'l_quantity' AS \"column\", round((avg(l_quantity) FILTER (s) - avg(l_quantity) FILTER (NOT s)) / sqrt((var_samp(l_quantity) FILTER (s) + var_samp(l_quantity) FILTER (NOT s)) / 2), 6) AS smd FROM (SELECT *, l_linestatus = 'O' AS s FROM lineitem)")
def _balance(read):
    return rounded(prepare.balance(read("lineitem").withColumn("_split", F.when(F.col("l_linestatus") == "O", "train").otherwise("test")), ["l_quantity"]))


@query("prepared_numeric", _HOLES + """, q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM h WHERE event_id % 4 <> 0),
c AS (SELECT event_id, CASE WHEN value IS NOT NULL THEN least(greatest(value, a - 1.5 * (b - a)), b + 1.5 * (b - a)) END AS x FROM h, q), m AS (SELECT median(x) AS m FROM c WHERE event_id % 4 <> 0),
f AS (SELECT event_id, coalesce(x, m) AS x FROM c, m), s AS (SELECT avg(x) AS mu, stddev_pop(x) AS sd FROM f WHERE event_id % 4 <> 0)
SELECT event_id, round((x - mu) / sd, 5) AS value FROM f, s
""")  # fmt: skip
def _prepared(read):
    df = _holes(read)
    p = prepare.Preparation(numeric=["value"]).fit(prepare.SplitFrame(df.filter("event_id % 4 <> 0"), "train"))
    return rounded(p.transform(df, ["event_id"]), 5)


@query("one_hot_rare", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, (l_shipmode = 'FOB')::BIGINT AS \"mode=FOB\", (l_shipmode NOT IN ('AIR', 'FOB'))::BIGINT AS \"mode=(rare)\" FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <= 2 THEN 'AIR' WHEN l_linenumber <= 4 THEN 'FOB' ELSE 'SHIP' || l_quantity::INT END AS l_shipmode FROM lineitem)")
def _one_hot(read):
    # two levels with a quarter of the rows and more each at every scale, and fifty rare ones
    n = F.col("l_linenumber")
    df = read("lineitem").withColumn("mode", F.when(n <= 2, "AIR").when(n <= 4, "FOB").otherwise(F.concat(F.lit("SHIP"), F.col("l_quantity").cast("int").cast("string"))))
    p = prepare.Preparation(nominal=["mode"], policy={"encode": {"min_frequency": 0.1}})
    return rounded(p.fit(prepare.SplitFrame(df, "train")).transform(df, ["l_orderkey", "l_linenumber"]))


from cohortloom.plans import catalog_cells, catalog_checks, catalog_groups  # noqa: E402, F401 (they register more queries)
