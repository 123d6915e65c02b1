"""Named queries of group comparison, association, survival and preparation, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions import dist
from cohortloom.operators import compare, figures, multivariate, prepare, profile, survival
from cohortloom.plans.catalog import _CURVE, _HOLES, _SURV, _TABLE, _holes, _surv, query, rounded

_PAIR = "WITH g AS (SELECT c_mktsegment AS s, count(c_acctbal)::DOUBLE AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM customer GROUP BY 1), x AS (SELECT a.n AS n1, a.m AS m1, a.v AS v1, b.n AS n2, b.m AS m2, b.v AS v2 FROM g a, g b WHERE a.s = 'BUILDING' AND b.s = 'MACHINERY') "
_RANKS = "WITH r AS (SELECT c_mktsegment AS s, c_acctbal AS v, rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0 AS k FROM customer{where}), t AS (SELECT coalesce(sum(c * c * c - c), 0)::DOUBLE AS t FROM (SELECT count(*) AS c FROM r GROUP BY v)), g AS (SELECT s, count(*)::DOUBLE AS n, sum(k)::DOUBLE AS w FROM r GROUP BY 1), n AS (SELECT sum(n) AS n, count(*)::DOUBLE AS k FROM g) "
_TWO = " WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')"


def table(read, rows: list[dict], schema: str, places: int = 6) -> DataFrame:
    """Results that reached the driver as a frame."""
    return rounded(read("region").sparkSession.createDataFrame([tuple(r[c.split()[0].strip("`")] for c in schema.split(", ")) for r in rows], schema), places)


def _customers(read):
    return read("customer"), "c_acctbal", "c_mktsegment"


@query("hedges_g", _PAIR + "SELECT round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) * (1 - 3 / (4 * (n1 + n2) - 9)), 6) AS g FROM x")
def _hedges(read):
    return table(read, [{"g": compare.hedges_g(*_customers(read), "BUILDING", "MACHINERY")}], "g double")


@query("smd_two_groups", _PAIR + "SELECT round((m1 - m2) / sqrt((v1 + v2) / 2), 6) AS smd FROM x")
def _smd(read):
    return table(read, [{"smd": compare.smd(*_customers(read), "BUILDING", "MACHINERY")}], "smd double")


@query("max_pairwise_smd", "WITH g AS (SELECT c_mktsegment AS s, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM customer GROUP BY 1) SELECT a.s AS a, b.s AS b, round((a.m - b.m) / sqrt((a.v + b.v) / 2), 6) AS smd FROM g a JOIN g b ON a.s < b.s ORDER BY abs((a.m - b.m) / sqrt((a.v + b.v) / 2)) DESC LIMIT 1")
def _max_smd(read):
    return table(read, [compare.max_pairwise_smd(*_customers(read))], "a string, b string, smd double")


@query("welch_t", _PAIR + "SELECT round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t, round((v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)), 4) AS df FROM x")
def _welch(read):
    r = compare.welch(*_customers(read), "BUILDING", "MACHINERY")
    return table(read, [r], "t double, df double").withColumn("df", F.round("df", 4))


@query("mann_whitney_u", _RANKS.format(where=_TWO) + "SELECT round(a.w - a.n * (a.n + 1) / 2, 2) AS u, round(2 * (a.w - a.n * (a.n + 1) / 2) / (a.n * b.n) - 1, 6) AS delta FROM g a, g b WHERE a.s = 'BUILDING' AND b.s = 'MACHINERY'")
def _mann(read):
    return table(read, [compare.mann_whitney(*_customers(read), "BUILDING", "MACHINERY")], "u double, delta double")


@query("kruskal_h", _RANKS.format(where="") + ", h AS (SELECT (12 / (n * (n + 1)) * (SELECT sum(w * w / n) FROM g) - 3 * (n + 1)) / (1 - t / (n * n * n - n)) AS h, n, k FROM n, t) SELECT round(h, 5) AS h, round(least(greatest((h - k + 1) / (n - k), 0), 1), 8) AS epsilon_squared FROM h")
def _kruskal(read):
    return table(read, [compare.kruskal(*_customers(read))], "h double, epsilon_squared double", 8).withColumn("h", F.round("h", 5))


@query("dunn_pairs", _RANKS.format(where="") + "SELECT a.s AS a, b.s AS b, round((a.w / a.n - b.w / b.n) / sqrt((n.n * (n.n + 1) / 12 - t / (12 * (n.n - 1))) * (1 / a.n + 1 / b.n)), 6) AS z FROM g a JOIN g b ON a.s < b.s, n, t")
def _dunn(read):
    return table(read, compare.dunn(*_customers(read)), "a string, b string, z double")


@query("anova_f", "WITH g AS (SELECT c_mktsegment, count(*)::DOUBLE AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM customer GROUP BY 1), t AS (SELECT sum(n) AS n, count(*)::DOUBLE AS k, sum(n * m) / sum(n) AS mm FROM g) SELECT round((sum(g.n * (m - mm) ** 2) / max(k - 1)) / (sum((g.n - 1) * v) / max(t.n - k)), 6) AS f, max(k - 1)::BIGINT AS df1, max(t.n - k)::BIGINT AS df2 FROM g, t")
def _anova(read):
    return table(read, [compare.anova(*_customers(read))], "f double, df1 long, df2 long")


@query("tukey_q", "WITH g AS (SELECT c_mktsegment AS s, count(*)::DOUBLE AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM customer GROUP BY 1), w AS (SELECT sum((n - 1) * v) / (sum(n) - count(*)) AS w FROM g) SELECT a.s AS a, b.s AS b, round(abs(a.m - b.m) / sqrt(w / 2 * (1 / a.n + 1 / b.n)), 6) AS q FROM g a JOIN g b ON a.s < b.s, w")
def _tukey(read):
    return table(read, compare.tukey(*_customers(read)), "a string, b string, q double")


@query("smd_two_levels", "WITH p AS (SELECT l_returnflag AS g, avg((l_linestatus = 'F')::INT) AS p FROM lineitem GROUP BY 1) SELECT round(sqrt((a.p - b.p) ** 2 / ((a.p * (1 - a.p) + b.p * (1 - b.p)) / 2)), 6) AS smd FROM p a, p b WHERE a.g = 'A' AND b.g = 'N'")
def _smd_levels(read):
    return table(read, [{"smd": compare.smd_categorical(read("lineitem"), "l_linestatus", "l_returnflag", "A", "N")}], "smd double")


@query("chi2_yates", """
WITH t AS (SELECT (l_quantity > 25)::VARCHAR AS a, l_linestatus AS b, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT a, sum(n) AS ra FROM t GROUP BY 1), c AS (SELECT b, sum(n) AS cb FROM t GROUP BY 1), s AS (SELECT sum(n) AS n FROM t)
SELECT 'chi2' AS test, round(sum(greatest(abs(t.n - ra * cb / s.n) - 0.5, 0) ** 2 / (ra * cb / s.n)), 6) AS chi2, 1::BIGINT AS df FROM t JOIN r USING (a) JOIN c USING (b), s
""")  # fmt: skip
def _yates(read):
    return table(read, [compare.categorical_test(read("lineitem").withColumn("a", (F.col("l_quantity") > 25).cast("string")), "a", "l_linestatus")], "test string, chi2 double, df long")


_DIFF = "WITH f AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS k FROM events WHERE value IS NOT NULL AND event_type IN ('click', 'view')), p AS (SELECT x.value AS a, y.value AS b FROM f x JOIN f y ON x.user_id = y.user_id AND x.k = 1 AND y.k = 1 AND x.event_type = 'click' AND y.event_type = 'view') "


def _pairs(read):
    from cohortloom.operators import series

    return series.paired(read("events"), "event_type", "user_id", "value", "click", "view", ["ts", "event_id"])


@query("paired_t", _DIFF + "SELECT count(*)::BIGINT AS n, round(avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))), 6) AS t FROM p")
def _paired_t(read):
    return table(read, [compare.paired_t(_pairs(read))], "n long, t double")


@query("wilcoxon_w", _DIFF + ", d AS (SELECT a - b AS d FROM p WHERE a <> b), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS k FROM d) SELECT count(*)::BIGINT AS n, round(least(sum(k) FILTER (d > 0), sum(k) FILTER (d < 0))::DOUBLE, 2) AS w FROM r")
def _wilcoxon(read):
    return table(read, [compare.wilcoxon(_pairs(read))], "n long, w double")


@query("adjusted_p", """
WITH p AS (SELECT s_suppkey AS i, (s_suppkey * 37 % 101 + 1) / 2000.0 AS p FROM supplier), r AS (SELECT *, row_number() OVER (ORDER BY p, i) AS k, count(*) OVER () AS m FROM p)
SELECT i::BIGINT AS i, round(least(1, min(p * m / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 8) AS bh, round(max(least(1, p * (m - k + 1))) OVER (ORDER BY k), 8) AS holm, round(least(1, p * m), 8) AS bonferroni FROM r
""")  # fmt: skip
def _adjusted(read):
    # a list of p-values is a driver-side object: one for each test that was made
    rows = read("supplier").select(F.col("s_suppkey").alias("i"), ((F.col("s_suppkey") * 37 % 101 + 1) / 2000.0).alias("p")).orderBy("p", "i").collect()
    p = [float(r.p) for r in rows]
    bh, holm, bonferroni = (dist.adjusted(p, m) for m in ("bh", "holm", "bonferroni"))
    return table(read, [{"i": r.i, "bh": a, "holm": b, "bonferroni": c} for r, a, b, c in zip(rows, bh, holm, bonferroni)], "i long, bh double, holm double, bonferroni double", 8)


@query("shape_of_values", "SELECT count(p_retailprice)::BIGINT AS n, round(skewness(p_retailprice), 5) AS skew, round(kurtosis(p_retailprice), 5) AS kurtosis FROM part")
def _shape(read):
    return table(read, [compare.normality(read("part"), "p_retailprice")], "n long, skew double, kurtosis double", 5)


@query("association_mixed", """
WITH x AS (SELECT l_quantity AS q, l_extendedprice AS e, l_returnflag AS f, l_linestatus AS s FROM lineitem), rk AS (SELECT rank() OVER (ORDER BY q) + (count(*) OVER (PARTITION BY q) - 1) / 2.0 AS a, rank() OVER (ORDER BY e) + (count(*) OVER (PARTITION BY e) - 1) / 2.0 AS b FROM x),
t AS (SELECT f AS a, s AS b, count(*)::DOUBLE AS n FROM x GROUP BY 1, 2), r AS (SELECT a, sum(n) AS ra FROM t GROUP BY 1), c AS (SELECT b, sum(n) AS cb FROM t GROUP BY 1), z AS (SELECT sum(n * n / (ra * cb)) AS z, sum(n) AS n, count(DISTINCT a)::DOUBLE AS r, count(DISTINCT b)::DOUBLE AS k FROM t JOIN r USING (a) JOIN c USING (b)),
eta AS (SELECT 'q' AS n, 'f' AS g, sum(k * (m - mm) ** 2) / max(kk * v) AS e FROM (SELECT f, count(*) AS k, avg(q) AS m FROM x GROUP BY 1), (SELECT count(*) AS kk, avg(q) AS mm, var_pop(q) AS v FROM x)
  UNION ALL SELECT 'q', 's', sum(k * (m - mm) ** 2) / max(kk * v) FROM (SELECT s, count(*) AS k, avg(q) AS m FROM x GROUP BY 1), (SELECT count(*) AS kk, avg(q) AS mm, var_pop(q) AS v FROM x)
  UNION ALL SELECT 'e', 'f', sum(k * (m - mm) ** 2) / max(kk * v) FROM (SELECT f, count(*) AS k, avg(e) AS m FROM x GROUP BY 1), (SELECT count(*) AS kk, avg(e) AS mm, var_pop(e) AS v FROM x)
  UNION ALL SELECT 'e', 's', sum(k * (m - mm) ** 2) / max(kk * v) FROM (SELECT s, count(*) AS k, avg(e) AS m FROM x GROUP BY 1), (SELECT count(*) AS kk, avg(e) AS mm, var_pop(e) AS v FROM x))
SELECT 'q' AS a, 'e' AS b, 'rho' AS kind, round(abs(corr(a, b)), 5) AS value FROM rk UNION ALL SELECT n, g, 'eta_squared', round(e, 5) FROM eta
UNION ALL SELECT 'f', 's', 'v', round(sqrt(greatest(z - 1 - (k - 1) * (r - 1) / (n - 1), 0) / (least(r - (r - 1) * (r - 1) / (n - 1), k - (k - 1) * (k - 1) / (n - 1)) - 1)), 5) FROM z
""")  # fmt: skip
def _association(read):
    df = read("lineitem").select(F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("e"), F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s"))
    return table(read, compare.association(df, ["q", "e"], ["f", "s"]), "a string, b string, kind string, value double", 5)


@query("table_one_cells", """
WITH x AS (SELECT l_linestatus AS g, l_returnflag AS f FROM lineitem), o AS (SELECT 'Overall' AS g, f FROM x UNION ALL SELECT g, f FROM x), n AS (SELECT g, count(*) AS n FROM o GROUP BY 1)
SELECT 'n' AS "row", max(n::VARCHAR) FILTER (g = 'Overall') AS "Overall", max(n::VARCHAR) FILTER (g = 'F') AS "F", max(n::VARCHAR) FILTER (g = 'O') AS "O" FROM n
UNION ALL SELECT 'l_returnflag = ' || v, max(c) FILTER (g = 'Overall'), max(c) FILTER (g = 'F'), max(c) FILTER (g = 'O') FROM (
  SELECT l.g, v, k || ' (' || printf('%.1f', 100.0 * k / n) || '%)' AS c FROM (SELECT n.g, n.n, v.v, (SELECT count(*) FROM o WHERE o.g = n.g AND o.f = v.v) AS k FROM n, (SELECT DISTINCT f AS v FROM x) v) l) GROUP BY v
""")  # fmt: skip
def _table_one(read):
    rows = compare.table_one(read("lineitem"), ["l_returnflag"], set(), "l_linestatus")
    return table(read, rows, "row string, Overall string, F string, O string")


@query("publication_table", """
WITH x AS (SELECT l_linestatus AS g, l_quantity AS q, l_returnflag AS f FROM lineitem)
SELECT 'l_quantity' AS "row", printf('%.0f', avg(q)) || ' ± ' || printf('%.0f', stddev_samp(q)) || ' [' || printf('%.0f', min(q)) || ', ' || printf('%.0f', max(q)) || ']' AS "all" FROM x
UNION ALL SELECT 'l_returnflag = ' || f, k || ' (' || CASE WHEN 100.0 * k / n < 10 THEN printf('%.2g', 100.0 * k / n) ELSE printf('%.1f', 100.0 * k / n) END || '%)' FROM (SELECT f, count(*) AS k FROM x GROUP BY 1), (SELECT count(*) AS n FROM x)
""")  # fmt: skip
def _publication(read):
    return table(read, compare.publication_table(read("lineitem"), ["l_quantity", "l_returnflag"], {"l_quantity"}), "row string, all string")


@query("compare_effects", """
WITH x AS (SELECT c_mktsegment AS s, c_acctbal AS v FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')), g AS (SELECT s, avg(v) AS m, var_samp(v) AS va FROM x GROUP BY 1)
SELECT 'c_acctbal' AS "column", 0::BIGINT AS n_missing, round((a.m - b.m) / sqrt((a.va + b.va) / 2), 6) AS smd FROM g a, g b WHERE a.s = 'BUILDING' AND b.s = 'MACHINERY'
""")  # fmt: skip
def _compare(read):
    return table(read, compare.compare_groups(read("customer").filter("c_mktsegment IN ('BUILDING', 'MACHINERY')"), "c_mktsegment", ["c_acctbal"], {"c_acctbal"}), "`column` string, n_missing long, smd double")


# ---- several columns at once -------------------------------------------------------------------------------------------


@query("principal_shares", "SELECT round((1 + abs(r)) / 2, 6) AS first, round((1 - abs(r)) / 2, 6) AS second FROM (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem)")
def _pca(read):
    a, b = multivariate.principal_components(read("lineitem"), ["l_quantity", "l_extendedprice"])["explained"]
    return table(read, [{"first": a, "second": b}], "first double, second double")


@query("mahalanobis_flags", """
WITH m AS (SELECT avg(l_quantity) AS a, avg(l_extendedprice) AS b, var_samp(l_quantity) AS va, var_samp(l_extendedprice) AS vb, covar_samp(l_quantity, l_extendedprice) AS c FROM lineitem)
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round((vb * (l_quantity - a) ** 2 - 2 * c * (l_quantity - a) * (l_extendedprice - b) + va * (l_extendedprice - b) ** 2) / (va * vb - c * c), 4) AS d2 FROM lineitem, m
""")  # fmt: skip
def _mahalanobis(read):
    return rounded(multivariate.mahalanobis(read("lineitem"), ["l_quantity", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "d2"), 4)


@query("nullity_corr", _HOLES + "SELECT 'value' AS a, 'user_id' AS b, count(*)::BIGINT AS n, round(corr((value IS NULL)::INT, (user_id IS NULL)::INT), 6) AS r FROM h")
def _nullity(read):
    return rounded(figures.nullity_correlation(_holes(read), ["value", "user_id"]))


@query("histogram_bins", "WITH m AS (SELECT min(l_quantity) AS a, (max(l_quantity) - min(l_quantity)) / 30 AS w FROM lineitem) SELECT l_linestatus AS g, least(floor((l_quantity - a) / w), 29)::BIGINT AS bin, count(*)::BIGINT AS n FROM lineitem, m GROUP BY 1, 2")
def _histogram(read):
    return figures.histogram(read("lineitem"), "l_quantity", by="l_linestatus").select("g", "bin", "n")


@query("top_levels", "SELECT o_orderpriority AS level, count(*)::BIGINT AS n FROM orders GROUP BY 1 ORDER BY n DESC, level LIMIT 3")
def _levels(read):
    return figures.level_counts(read("orders"), "o_orderpriority", 3)


@query("folded_levels", "WITH t AS (SELECT o_orderpriority AS v FROM orders GROUP BY 1 ORDER BY count(*) DESC, v LIMIT 2) SELECT CASE WHEN o_orderpriority IN (SELECT v FROM t) THEN o_orderpriority ELSE 'その他' END AS level, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def _folded(read):
    return figures.fold_levels(read("orders"), "o_orderpriority", 3).groupBy(F.col("o_orderpriority").alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query("running_medians", "WITH e AS (" + " UNION ALL ".join(f"SELECT {k} AS bin, quantile_cont(l_quantity, {k / 12!r}) AS a, quantile_cont(l_quantity, {(k + 1) / 12!r}) AS b FROM lineitem" for k in range(12)) + ") SELECT bin::BIGINT AS bin, round(median(l_quantity), 5) AS x, round(median(l_extendedprice), 5) AS y, count(*)::BIGINT AS n FROM lineitem JOIN e ON l_quantity BETWEEN a AND b GROUP BY 1 HAVING count(*) >= 3")
def _running(read):
    return rounded(figures.running_median(read("lineitem"), "l_quantity", "l_extendedprice"), 5)


@query("display_decimals", "SELECT 'l_quantity' AS \"column\", 0::BIGINT AS decimals UNION ALL SELECT 'l_discount', least(4, greatest(2, ceil(-log10(min(abs(l_discount)) FILTER (l_discount <> 0)))))::BIGINT FROM lineitem")
def _decimals(read):
    return table(read, [{"column": c, "decimals": n} for c, n in figures.display_decimals(read("lineitem"), ["l_quantity", "l_discount"]).items()], "`column` string, decimals long")


@query("mcar_pairs", "SELECT 'lost' AS \"column\", 'l_quantity' AS other, round(avg((l_quantity > 40)::INT), 6) AS rate FROM lineitem")
def _mcar(read):
    df = read("lineitem").select(F.when(F.col("l_quantity") <= 40, 1.0).alias("lost"), "l_quantity")
    return table(read, multivariate.mcar_signals(df, ["lost", "l_quantity"], {"l_quantity", "lost"}), "`column` string, other string, rate double")


@query("outliers_by_mad", "WITH m AS (SELECT c_mktsegment, median(c_acctbal) AS m FROM customer GROUP BY 1), d AS (SELECT c_mktsegment, median(abs(c_acctbal - m)) AS d FROM customer JOIN m USING (c_mktsegment) GROUP BY 1) SELECT c_custkey, (abs(c_acctbal - m) > 1.1 * 1.4826 * d)::BIGINT AS flag FROM customer JOIN m USING (c_mktsegment) JOIN d USING (c_mktsegment)")
def _by_mad(read):
    return profile.detect(read("customer"), ["c_acctbal"], "mad", ["c_mktsegment"], z=1.1).select("c_custkey", F.col("n_outliers").cast("long").alias("flag"))


@query("winsorized_by_group", "WITH q AS (SELECT c_mktsegment, quantile_cont(c_acctbal, 0.05) AS a, quantile_cont(c_acctbal, 0.95) AS b FROM customer GROUP BY 1) SELECT c_custkey, round(least(greatest(c_acctbal, a), b), 5) AS c_acctbal FROM customer JOIN q USING (c_mktsegment)")
def _by_group(read):
    df = read("customer")
    limits = profile.quantile_limits(df, "c_acctbal", ["c_mktsegment"], 0.05, 0.95)
    return rounded(profile.flag_outliers(df, "c_acctbal", limits, ["c_mktsegment"], "winsorize").select("c_custkey", "c_acctbal"), 5)


# ---- survival ----------------------------------------------------------------------------------------------------------

_TWO_GROUPS = _TABLE.replace("FROM s GROUP BY 1, 2)", "FROM s WHERE g IN ('1-URGENT', '5-LOW') GROUP BY 1, 2)")
_AT = """, ev AS (SELECT t, sum(d) AS d FROM r GROUP BY 1 HAVING sum(d) > 0), lv AS (SELECT DISTINCT g FROM r),
p AS (SELECT ev.t, ev.d, lv.g, (SELECT coalesce(sum(c), 0) FROM c WHERE c.g = lv.g AND c.t >= ev.t) AS ng, (SELECT coalesce(sum(d), 0) FROM c WHERE c.g = lv.g AND c.t = ev.t) AS dg FROM ev, lv), q AS (SELECT *, sum(ng) OVER (PARTITION BY t) AS n FROM p) """


@query("logrank_chi2", _TWO_GROUPS + _AT + "SELECT round((sum(dg) - sum(d * ng / n::DOUBLE)) ** 2 / sum(CASE WHEN n > 1 THEN d * (ng / n::DOUBLE) * (1 - ng / n::DOUBLE) * (n - d) / (n - 1) ELSE 0 END), 5) AS chi2, 1::BIGINT AS df FROM q WHERE g = '1-URGENT'")
def _logrank_chi2(read):
    return table(read, [survival.logrank(_surv(read).filter("g IN ('1-URGENT', '5-LOW')"), "t", "e", "g")], "chi2 double, df long", 5)


@query("logrank_pairwise", _TABLE + _AT.replace("lv AS (SELECT DISTINCT g FROM r)", "lv AS (SELECT DISTINCT g FROM r), pr AS (SELECT a.g AS ga, b.g AS gb FROM lv a JOIN lv b ON a.g < b.g)") + """,
e2 AS (SELECT pr.ga, pr.gb, t, sum(d) AS d FROM pr JOIN r ON r.g IN (pr.ga, pr.gb) GROUP BY 1, 2, 3 HAVING sum(d) > 0),
z AS (SELECT e2.*, (SELECT coalesce(sum(c), 0) FROM c WHERE c.g = ga AND c.t >= e2.t)::DOUBLE AS na, (SELECT coalesce(sum(c), 0) FROM c WHERE c.g = gb AND c.t >= e2.t)::DOUBLE AS nb, (SELECT coalesce(sum(d), 0) FROM c WHERE c.g = ga AND c.t = e2.t)::DOUBLE AS da FROM e2)
SELECT ga AS a, gb AS b, round((sum(da) - sum(d * na / (na + nb))) ** 2 / sum(CASE WHEN na + nb > 1 THEN d * na / (na + nb) * (1 - na / (na + nb)) * (na + nb - d) / (na + nb - 1) ELSE 0 END), 4) AS chi2 FROM z GROUP BY 1, 2
""")  # fmt: skip
def _logrank_pairs(read):
    return table(read, survival.logrank_pairwise(_surv(read), "t", "e", "g"), "a string, b string, chi2 double", 4)


@query("logrank_trend", _TABLE + _AT + """, s2 AS (SELECT t, max(d)::DOUBLE AS d, max(n)::DOUBLE AS n, sum(left(g, 1)::DOUBLE * dg) AS o, sum(left(g, 1)::DOUBLE * ng) AS sn, sum(left(g, 1)::DOUBLE ** 2 * ng) AS ssn FROM q GROUP BY 1)
SELECT round(sum(o - d * sn / n) ** 2 / sum(CASE WHEN n > 1 THEN d * (n - d) / (n - 1) * (ssn / n - (sn / n) ** 2) ELSE 0 END), 5) AS chi2 FROM s2
""")  # fmt: skip
def _trend(read):
    df = _surv(read)
    levels = [r.g for r in df.select("g").distinct().limit(100).collect()]
    return table(read, [survival.logrank_trend(df, "t", "e", "g", {g: float(g[0]) for g in levels})], "chi2 double", 5)


@query("survival_follow_up", _SURV + ", c AS (SELECT g, t, sum(1 - e) AS d, count(*) AS c FROM s GROUP BY 1, 2), r AS (SELECT g, t, d, sum(c) OVER (PARTITION BY g ORDER BY t DESC) AS n FROM c), k AS (SELECT g, t, exp(sum(CASE WHEN d < n THEN ln(1 - d / n::DOUBLE) ELSE -1e9 END) OVER (PARTITION BY g ORDER BY t)) AS s FROM r) SELECT g, min(t) FILTER (s <= 0.5) AS follow_up FROM k GROUP BY 1")
def _follow_up(read):
    return survival.km_median(_surv(read), "t", "e", "g").select("g", "follow_up")


@query("survival_summary", _SURV + "SELECT count(*)::BIGINT AS n, sum(e)::BIGINT AS events, round(avg(e), 6) AS rate, min(t) AS shortest, max(t) AS longest FROM s")
def _summary(read):
    return rounded(survival.summary(_surv(read), "t", "e").select("n", "events", "rate", "shortest", "longest"))


@query("survival_rates", _CURVE + ", x AS (SELECT g, max(t) AS last FROM k GROUP BY 1) SELECT x.g, v.m::DOUBLE AS at, CASE WHEN v.m <= last THEN coalesce((SELECT round(min(s), 6) FROM k WHERE k.g = x.g AND k.t <= v.m), 1.0) END AS survival FROM x, (VALUES (30), (90), (1000)) v(m)")
def _rates(read):
    return rounded(survival.km_at(_surv(read), "t", "e", [30, 90, 1000], "g"))


@query("rmst_late_group", "SELECT g, (CASE g WHEN 'early' THEN 2 ELSE 5 END)::DOUBLE AS rmst FROM (VALUES ('early'), ('late')) v(g)")
def _late(read):
    # deaths at 1 and 3; a group whose first time is after tau keeps all of tau
    df = read("region").sparkSession.createDataFrame([("early", 1.0, 1), ("early", 3.0, 1), ("late", 10.0, 1), ("late", 12.0, 1)], "g string, t double, e int")
    return rounded(survival.rmst(df, "t", "e", "g", tau=5.0))


@query("survival_forms", "SELECT 'A' AS form, count(*)::BIGINT AS n, sum((o_orderstatus = 'F')::INT)::BIGINT AS events, round(sum(o_orderkey % 9)::DOUBLE + count(*) FILTER (o_orderkey % 9 = 0) * 0.5, 2) AS days FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 'B', count(*), sum((o_orderstatus = 'F')::INT), round(count(*) * 10.0, 2) FROM orders WHERE o_orderstatus <> 'P'")
def _forms(read):
    event = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0).otherwise(2)
    start = F.col("o_orderdate").cast("date")
    a = survival.from_durations(read("orders"), F.col("o_orderkey") % 9, event)
    b = survival.from_dates(read("orders"), start, F.date_add(start, 10), event, F.lit("2100-01-01").cast("date"))
    told = [df.filter("reason IS NULL").agg(F.lit(k).alias("form"), F.count(F.lit(1)).alias("n"), F.sum("event").cast("long").alias("events"), F.sum("duration").alias("days")) for k, df in (("A", a), ("B", b))]
    return rounded(told[0].unionByName(told[1]), 2)


@query("cox_score_test", "SELECT 0::DOUBLE AS null_score")
def _cox(read):
    # the partial likelihood is flat at its maximum: after the Newton steps the score of every covariate is 0
    df = _surv(read).withColumn("urgent", (F.col("g") == "1-URGENT").cast("int"))
    return table(read, [{"null_score": abs(survival.cox(df, "t", "e", ["urgent"])["score"])}], "null_score double", 5)


# ---- splits and preparation --------------------------------------------------------------------------------------------


@query("group_split_sizes", "SELECT count(DISTINCT o_custkey)::BIGINT AS entities, 0::BIGINT AS overlap, true AS near FROM orders")
def _group_sizes(read):
    df = prepare.split_group(read("orders"), "o_custkey")
    both = prepare.entity_overlap(df, "o_custkey").agg(F.count(F.lit(1)).alias("overlap"))
    return df.agg(F.count_distinct("o_custkey").alias("entities"), (F.abs(F.avg((F.col("_split") == "test").cast("double")) - 0.25) < 0.1).alias("near")).join(F.broadcast(both), F.lit(True)).select("entities", "overlap", "near")


@query("random_split_sizes", "SELECT o_orderstatus, round(count(*) * 0.25)::BIGINT AS test FROM orders GROUP BY 1")
def _random_sizes(read):
    return prepare.split_random(read("orders"), "o_orderkey", stratify="o_orderstatus").groupBy("o_orderstatus").agg(F.count_if(F.col("_split") == "test").alias("test"))


@query("fold_rates", "SELECT (o_orderkey % 5)::BIGINT AS \"_fold\", count(*)::BIGINT AS n, round(avg((o_orderstatus = 'F')::INT), 6) AS rate FROM orders GROUP BY 1")
def _folds(read):
    return rounded(prepare.fold_summary(read("orders").select((F.col("o_orderkey") % 5).alias("_fold"), (F.col("o_orderstatus") == "F").alias("y")), "y"))


@query("levels_only_in_test", "SELECT DISTINCT o_orderdate::DATE::VARCHAR AS day FROM orders WHERE o_orderkey % 4 = 0 AND o_orderdate NOT IN (SELECT o_orderdate FROM orders WHERE o_orderkey % 4 <> 0)")
def _only_test(read):
    df = read("orders").select(F.col("o_orderdate").cast("date").cast("string").alias("day"), F.when(F.col("o_orderkey") % 4 == 0, "test").otherwise("train").alias("_split"))
    return prepare.only_in_test(df, "day")


_ORDINAL = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]


def _prepared(read, **kinds):
    df = read("orders")
    return df, prepare.Preparation(**kinds).fit(prepare.SplitFrame(df, "train"))


@query("ordinal_places", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 3 END::BIGINT AS o_orderpriority FROM orders")
def _ordinal(read):
    df, p = _prepared(read, ordinal={"o_orderpriority": _ORDINAL})
    return rounded(p.transform(df, ["o_orderkey"]))


@query("binary_codes", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END::BIGINT AS o_orderstatus FROM orders")
def _binary(read):
    df, p = _prepared(read, binary={"o_orderstatus": (["F"], ["o"])})
    return rounded(p.transform(df, ["o_orderkey"]))


@query("clip_shift", "WITH q AS (SELECT quantile_cont(l_quantity, 0.25) AS a, quantile_cont(l_quantity, 0.75) AS b FROM lineitem WHERE l_linenumber > 2), t AS (SELECT avg((l_quantity * 3 < a - 1.5 * (b - a) OR l_quantity * 3 > b + 1.5 * (b - a))::INT) AS r FROM lineitem, q WHERE l_linenumber <= 2) SELECT 'l_quantity' AS \"column\", round(r, 6) AS rate FROM t")
def _shift(read):
    df = read("lineitem")
    p = prepare.Preparation(numeric=["l_quantity"]).fit(prepare.SplitFrame(df.filter("l_linenumber > 2"), "train"))
    return table(read, p.clip_shift(df.filter("l_linenumber <= 2").withColumn("l_quantity", F.col("l_quantity") * 3)), "`column` string, rate double")


@query("leak_counts", "SELECT * FROM (VALUES ('rows on both sides', 0), ('outcome among features', 1), ('id among features', 0), ('entities on both sides', (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey % 4 = 0) > 1)))) v(\"check\", found)")
def _leaks(read):
    df = read("orders").withColumn("_split", F.when(F.col("o_orderkey") % 4 == 0, "test").otherwise("train"))
    return table(read, prepare.leak_check(df, "o_orderkey", ["o_totalprice", "o_orderstatus"], "o_orderstatus", "o_custkey"), "check string, found long")


@query("imputation_rates", "SELECT 'value' AS \"column\", 'median' AS method, round(avg((value IS NULL)::INT) FILTER (event_id % 4 <> 0), 6) AS train, round(avg((value IS NULL)::INT) FILTER (event_id % 4 = 0), 6) AS test FROM (" + _HOLES + "SELECT * FROM h)")
def _imputed(read):
    df = _holes(read)
    train, test = df.filter("event_id % 4 <> 0"), df.filter("event_id % 4 = 0")
    p = prepare.Preparation(numeric=["value"]).fit(prepare.SplitFrame(train, "train"))
    return table(read, multivariate.imputation_table(train, test, p.fitted), "`column` string, method string, train double, test double")


@query("reference_levels", "SELECT * FROM (VALUES ('o_orderpriority', '1-URGENT'), ('o_orderstatus', 'O')) v(\"column\", reference)")
def _reference(read):
    _, p = _prepared(read, nominal=["o_orderpriority"], binary={"o_orderstatus": (["F"], ["O"])})
    return table(read, p.reference_levels(), "`column` string, reference string")


@query("overlap_guard", "SELECT (count(*) FILTER (o_orderkey % 3 = 0 AND o_orderkey % 2 = 0))::BIGINT AS overlap, count(*) FILTER (o_orderkey % 2 = 0)::BIGINT AS n FROM orders")
def _overlap(read):
    df = read("orders")
    return table(read, [prepare.row_overlap(df.filter("o_orderkey % 3 = 0"), df.filter("o_orderkey % 2 = 0"), "o_orderkey")], "overlap long, n long")


# ---- regression design, forests, outcome -------------------------------------------------------------------------------


@query("cox_design", "SELECT 'g=' || g AS covariate, count(*)::BIGINT AS n FROM (" + _SURV + "SELECT g FROM s) x WHERE g <> (SELECT g FROM (" + _SURV + "SELECT g, count(*) AS c FROM s GROUP BY 1 ORDER BY c DESC, g LIMIT 1)) GROUP BY 1")
def _design(read):
    df, names, _, _ = survival.design(_surv(read).withColumn("same", F.lit(1.0)), ["g", "same", "gone"])
    return df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("covariate"), F.col(f"`{n}`").alias("x")) for n in names])).alias("v")).groupBy("v.covariate").agg(F.sum("v.x").cast("long").alias("n"))


@query("covariate_fill", _HOLES + "SELECT event_id, round(coalesce(value, (SELECT median(value) FROM h)), 6) AS value, coalesce(props, (SELECT props FROM h WHERE props IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, props LIMIT 1)) AS props FROM h")
def _fill(read):
    df, _ = survival.impute(_holes(read), ["value", "props"])
    return rounded(df.select("event_id", "value", "props"))


@query("cox_strata_score", "SELECT 0::DOUBLE AS null_score, 1::BIGINT AS covariates")
def _strata(read):
    df = _surv(read).withColumn("early", (F.col("o_orderkey") % 2).cast("double"))
    fit = survival.cox(df, "t", "e", ["early"], strata="g")
    return table(read, [{"null_score": abs(fit["score"]), "covariates": len(survival.check_ph(df, "t", "e", ["early"], fit, "g"))}], "null_score double, covariates long", 5)


@query("smd_forest", "SELECT c AS \"column\", round(s, 6) AS smd, abs(s) >= 0.1 AS \"over\" FROM (SELECT 'l_quantity' AS c, (avg(l_quantity) FILTER (t) - avg(l_quantity) FILTER (NOT t)) / sqrt((var_samp(l_quantity) FILTER (t) + var_samp(l_quantity) FILTER (NOT t)) / 2) AS s FROM (SELECT *, l_linestatus = 'O' AS t FROM lineitem) UNION ALL SELECT 'l_discount', (avg(l_discount) FILTER (t) - avg(l_discount) FILTER (NOT t)) / sqrt((var_samp(l_discount) FILTER (t) + var_samp(l_discount) FILTER (NOT t)) / 2) FROM (SELECT *, l_linestatus = 'O' AS t FROM lineitem))")
def _forest(read):
    return rounded(figures.smd_forest(read("lineitem").withColumn("_split", F.when(F.col("l_linestatus") == "O", "train").otherwise("test")), ["l_quantity", "l_discount"]))


@query("outcome_histograms", "WITH m AS (SELECT min(l_quantity) AS a, (max(l_quantity) - min(l_quantity)) / 25 AS w FROM lineitem) SELECT l_linestatus AS g, least(floor((l_quantity - a) / w), 24)::BIGINT AS bin, count(*)::BIGINT AS n FROM lineitem, m GROUP BY 1, 2")
def _outcome(read):
    return figures.outcome_relations(read("lineitem"), "l_linestatus", "l_quantity").select("g", "bin", "n")


@query("achievement_bars", "SELECT 'Hb' AS item, coalesce(l_linestatus, '(all)') AS level, count(*)::BIGINT AS n, round(count(*) FILTER (l_quantity >= 10 AND l_quantity < 12) / count(*)::DOUBLE, 6) AS rate FROM lineitem GROUP BY GROUPING SETS ((), (l_linestatus))")
def _bars(read):
    return rounded(figures.achievement_bars(read("lineitem").select(F.col("l_quantity").alias("Hb"), "l_linestatus"), "l_linestatus"))


@query("isolated_rows", "SELECT greatest(1, count(*) FILTER (p_partkey % 200 = 7))::BIGINT AS planted, true AS found FROM part")
def _isolated(read):
    far = F.when(F.col("p_partkey") % 200 == 7, 1e4).otherwise(0.0)
    df = read("part").select("p_partkey", (F.col("p_size") + far).alias("a"), (F.col("p_retailprice") + far * 3).alias("b"))
    out = multivariate.isolation_forest(df, ["a", "b"], "p_partkey")
    hit = (F.col("p_partkey") % 200 == 7)
    return out.agg(F.greatest(F.lit(1), F.count_if(hit)).cast("long").alias("planted"), (F.coalesce(F.min(F.when(hit, F.col("score"))), F.lit(9.0)) > F.max(F.when(~hit, F.col("score")))).alias("found"))


@query("horizon_choice", "SELECT true AS within, true AS balanced")
def _horizon(read):
    # the chosen day leaves at most a fifth undetermined and no other candidate has a larger smaller class
    df = _surv(read)
    best = survival.choose_horizon(df, "t", "e", 10.0)
    n, ones = df.agg(F.count(F.lit(1)), F.count_if((F.col("e") == 1) & (F.col("t") <= best["tau"]))).first()
    return table(read, [{"within": best["undetermined"] <= 0.2 or best["ones"] == ones, "balanced": best["ones"] == ones and best["ones"] + best["zeros"] <= n}], "within boolean, balanced boolean")
