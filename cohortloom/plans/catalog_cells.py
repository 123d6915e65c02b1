"""Named queries of cells: written numbers, dates and clocks, indices and derived columns, cleaning; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions import dates, dialysis, numeric
from cohortloom.operators import clean, derived, series
from cohortloom.plans import dictionary
from cohortloom.plans.catalog import _holes, query, rounded

c = F.col
_KEYS = ("l_orderkey", "l_linenumber")
_SQL_KEYS = "l_orderkey, l_linenumber::BIGINT AS l_linenumber"


def lines(read, *columns):
    return rounded(read("lineitem").select(*_KEYS, *columns))


# ---- numbers -----------------------------------------------------------------------------------------------------------


@query("wide_numbers", f"SELECT {_SQL_KEYS}, l_quantity + 0.5 AS value FROM lineitem")
def _wide(read):
    s = F.translate((c("l_quantity") + 0.5).cast("string"), "0123456789.", "０１２３４５６７８９．")
    return lines(read, numeric.censored(F.concat(s, F.lit(" ㎎"))).getField("value").alias("value"))


@query("folded_names", "SELECT * FROM (VALUES (0, 'アルブミン'), (1, 'ガンマgtp'), (2, 'パa1'), (3, 'hba1c'), (4, NULL)) v(k, name)")
def _folded(read):
    df = read("region").sparkSession.createDataFrame([(0, "ｱﾙﾌﾞﾐﾝ"), (1, "ガンマ ＧＴＰ"), (2, "ﾊﾟ　Ａ１"), (3, " Hb A1c"), (4, None)], "k int, s string")
    return rounded(df.select("k", numeric.folded(c("s")).alias("name")))


@query("plausible_values", f"SELECT {_SQL_KEYS}, CASE WHEN l_quantity BETWEEN 5 AND 40 THEN l_quantity END AS value FROM lineitem")
def _plausible(read):
    return lines(read, numeric.plausible(c("l_quantity"), 5, 40).alias("value"))


@query("number_share", "SELECT round(avg((l_linenumber <> 3)::INT), 6) AS share FROM lineitem")
def _share(read):
    n, q = c("l_linenumber"), c("l_quantity").cast("string")
    s = F.when(n == 1, F.concat(F.lit("<"), q)).when(n == 2, F.concat(q, F.lit(" mg/dL"))).when(n == 3, F.concat(F.lit("P"), q)).otherwise(q)
    return rounded(read("lineitem").agg(F.avg(numeric.numberlike(s).cast("double")).alias("share")))


@query("blank_cells", "SELECT count(*) FILTER (event_id % 3 < 2)::BIGINT AS blank, count(*) FILTER (event_id % 3 = 2)::BIGINT AS filled FROM events")
def _blank(read):
    x = F.when(c("event_id") % 3 == 0, F.lit(" 　 ")).when(c("event_id") % 3 == 2, F.lit(" a"))
    return read("events").agg(F.count_if(numeric.blank(x)).alias("blank"), F.count_if(~numeric.blank(x)).alias("filled"))


@query("intervals", "SELECT k, low::DOUBLE AS low, high::DOUBLE AS high FROM (VALUES (0, 1.0, 2.0), (1, NULL, 5.0), (2, 0.5, NULL), (3, NULL, NULL)) v(k, low, high)")
def _intervals(read):
    def read_one(spec):
        try:
            return numeric.interval(spec)
        except ValueError:
            return None, None

    rows = [(k, *read_one(spec)) for k, spec in enumerate(([1, 2], {"upper": 5}, (0.5, None), [3, 3]))]
    return rounded(read("region").sparkSession.createDataFrame(rows, "k int, low double, high double"))


# ---- dates and clocks --------------------------------------------------------------------------------------------------

def ordered():
    """The day of an order; made in the query, since a column needs a running session and importing has none."""
    return c("o_orderdate").cast("date")


def days(read, expr, order="auto"):
    df = read("orders").select("o_orderkey", expr.alias("s"))
    return df, dates.read_dates(df, ["s"], order)[0]


@query("date_eras", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def _eras(read):
    y = F.year(ordered()) - 1988
    name = F.when(c("o_orderkey") % 2 == 0, F.lit("平成")).otherwise(F.lit("H"))
    df, d = days(read, F.concat(name, F.when(y == 1, "元").otherwise(y.cast("string")), F.lit("年"), F.month(ordered()).cast("string"), F.lit("月"), F.dayofmonth(ordered()).cast("string"), F.lit("日")))
    return df.select("o_orderkey", d.expr.cast("string").alias("day"))


@query("date_separators", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def _separators(read):
    k = c("o_orderkey") % 4
    s = F.when(k == 0, F.date_format(ordered(), "yyyy M d")).when(k == 1, F.date_format(ordered(), "yyyy.MM.dd 10:30")).when(k == 2, F.date_format(ordered(), "[yyyy-M-d]")).otherwise(F.date_format(ordered(), "yyyy / M / d"))
    df, d = days(read, s)
    return df.select("o_orderkey", d.expr.cast("string").alias("day"))


@query("date_day_first", "SELECT 'dmy' AS \"order\", count(*)::BIGINT AS n_total, count(*) FILTER (o_orderkey % 10 = 0)::BIGINT AS n_null, count(*) FILTER (o_orderkey % 10 > 1)::BIGINT AS n_parsed, count(*) FILTER (o_orderkey % 10 = 1)::BIGINT AS n_failed, count(DISTINCT CASE WHEN o_orderkey % 10 > 1 THEN o_orderdate::DATE END)::BIGINT AS days FROM orders")
def _day_first(read):
    k = c("o_orderkey") % 10
    df, d = days(read, F.when(k == 0, F.lit("未測定")).when(k == 1, F.lit("late")).otherwise(F.date_format(ordered(), "d-M-yyyy")))
    told = [F.lit(d.order).alias("order"), *[F.lit(getattr(d, x)).cast("long").alias(x) for x in ("n_total", "n_null", "n_parsed", "n_failed")]]
    return df.agg(F.count_distinct(d.expr).alias("days")).select(*told, "days")


@query("date_failures", "SELECT 'late ' || (o_orderkey % 3) AS value, count(*)::BIGINT AS n FROM orders WHERE o_orderkey % 7 = 0 GROUP BY 1")
def _failures(read):
    df, d = days(read, F.when(c("o_orderkey") % 7 == 0, F.concat(F.lit("late "), (c("o_orderkey") % 3).cast("string"))).otherwise(F.date_format(ordered(), "yyyy-MM-dd")))
    return d.failures(df)


@query("date_ambiguous", "SELECT 'ambiguous_dmy_mdy' AS \"order\", 0::BIGINT AS days FROM (SELECT 1)")
def _ambiguous(read):
    df, d = days(read, F.concat(F.lit("3/"), F.month(ordered()).cast("string"), F.lit("/"), F.year(ordered()).cast("string")))
    return df.agg(F.lit(d.order).alias("order"), F.count(d.expr).alias("days"))


@query("date_two_digits", "SELECT * FROM (VALUES ('69-01-02', '2069-01-02'), ('70-01-02', '1970-01-02'), ('00-02-30', NULL)) v(s, day)")
def _two_digits(read):
    df = read("region").sparkSession.createDataFrame([("69-01-02",), ("70-01-02",), ("00-02-30",)], "s string")
    return df.select("s", dates.read_dates(df, ["s"], "ymd")[0].expr.cast("string").alias("day"))


@query("year_months", "SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS day FROM orders")
def _year_months(read):
    df = read("orders").select("o_orderkey", F.date_format(ordered(), "yyyy年M月").alias("s"))
    return df.select("o_orderkey", dates.read_dates(df, ["s"], allow_year_month=True)[0].expr.cast("string").alias("day"))


@query("clock_text", f"SELECT {_SQL_KEYS}, printf('%02d:%02d', l_quantity::INT, (l_linenumber * 7)::INT) AS at FROM lineitem")
def _clock_text(read):
    return lines(read, dates.hhmm(c("l_quantity").cast("int") + c("l_linenumber") * 7 / F.lit(60.0)).alias("at"))


@query("clock_pairs", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, printf('%02d:30', 10 + l_linenumber::INT) AS a, printf('%02d:30', CASE WHEN l_quantity::INT % 24 < 10 + l_linenumber OR (l_quantity::INT % 24 = 10 + l_linenumber AND false) THEN l_quantity::INT % 24 + 24 ELSE l_quantity::INT % 24 END) AS b FROM lineitem")
def _clock_pairs(read):
    a, b = F.format_string("%d時30分", c("l_linenumber").cast("int") + 10), F.format_string("%d:30", c("l_quantity").cast("int") % 24)
    return rounded(clean.normalize_times(read("lineitem").select(*_KEYS, a.alias("a"), b.alias("b")), "a", "b"))


@query("session_lengths", f"SELECT {_SQL_KEYS}, CASE WHEN d > 0 AND d <= 12 THEN d END AS hours FROM (SELECT *, CASE WHEN e < s THEN e - s + 24 ELSE e - s END AS d FROM (SELECT *, (l_quantity::INT % 24)::DOUBLE AS s, (l_linenumber * 3)::DOUBLE AS e FROM lineitem))")
def _sessions(read):
    return lines(read, dates.session_hours((c("l_quantity").cast("int") % 24).cast("double"), (c("l_linenumber") * 3).cast("double")).alias("hours"))


@query("vintage_years", "SELECT o_orderkey, floor(date_diff('day', DATE '1990-05-05', o_orderdate::DATE) / 365.25)::BIGINT AS years FROM orders")
def _vintage(read):
    return rounded(read("orders").select("o_orderkey", dates.years_between(F.lit("1990-05-05").cast("date"), ordered()).cast("long").alias("years")))


# ---- indices -----------------------------------------------------------------------------------------------------------


@query("percent_cgr", """
WITH x AS (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, (l_linenumber % 2 = 0) AS male, 40 + l_linenumber::DOUBLE AS age, 50 + l_quantity AS b1, (50 + l_quantity) * 0.3 AS b2, 8 + l_discount * 10 AS c1, (8 + l_discount * 10) * 0.35 AS c2, 62.0 AS w1, 60.0 AS w2, 4.0 AS h FROM lineitem),
k AS (SELECT *, -ln(b2 / b1 - 0.008 * h) + (4 - 3.5 * b2 / b1) * (w1 - w2) / w2 AS ktv, (ln(c2 / c1) * -81.622 / (h * 60) + 0.942) * c2 AS cc FROM x),
n AS (SELECT *, ktv * 0.0136 * (b1 + b2) / 2 + 0.251 AS npcr, ln(cc / c1) AS lg FROM k),
d AS (SELECT *, (h * 0.019 + 0.999) * lg - (h * 0.00367 - 0.0219) AS d FROM n),
a AS (SELECT *, 3864.0 + (h * 7.8 + 411) * lg - h * 1.5 - 1449.0 / d AS a FROM d),
g AS (SELECT *, c1 * (7056.0 / a + (w1 - w2) / w2 * 240 / (72 - h)) - (npcr * npcr * 7.79 - npcr * 7.91 + 1.93) AS gi, CASE WHEN male THEN 23.53 - 0.15 * age ELSE 19.58 - 0.12 * age END AS gr FROM a)
SELECT l_orderkey, l_linenumber, round(CASE WHEN gr > 0 AND gi >= 0 THEN gi / gr * 100 END, 5) AS value FROM g
""")  # fmt: skip
def _cgr(read):
    b, k = c("l_quantity") + 50, c("l_discount") * 10 + 8
    x = read("lineitem").select(*_KEYS, (c("l_linenumber") % 2 == 0).alias("male"), (c("l_linenumber") + F.lit(40.0)).alias("age"), b.alias("b1"), (b * 0.3).alias("b2"), k.alias("c1"), (k * 0.35).alias("c2"))
    f = dialysis.percent_cgr(c("male"), c("age"), c("b1"), c("b2"), c("c1"), c("c2"), F.lit(62.0), F.lit(60.0), F.lit(4.0))
    return rounded(x.select(*_KEYS, f.getField("value").alias("value")), 5)


@query("percent_cgr_example", "SELECT 116.446461::DOUBLE AS value")
def _cgr_example(read):
    # the published example
    f = dialysis.percent_cgr(F.lit(True), *[F.lit(float(v)) for v in (60, 60, 20, 12, 4, 63, 60, 4)])
    return rounded(read("region").limit(1).select(f.getField("value").alias("value")))


@query("clear_space", f"SELECT {_SQL_KEYS}, round((1000 + l_quantity) / ((30 + l_quantity) * 10), 6) AS a, round((1000 + l_quantity) / ((30 + l_quantity) * 10) / 33 * 100, 6) AS percent, round((30 + l_quantity) * l_linenumber * 10, 4) AS mass FROM lineitem")
def _clear(read):
    f = dialysis.clear_space(c("l_quantity") + 1000, c("l_quantity") + 30, F.lit(33.0))
    return lines(read, f.getField("a").alias("a"), f.getField("percent").alias("percent"), F.round(dialysis.removed_mass(c("l_quantity") + 30, c("l_linenumber").cast("double")), 4).alias("mass"))


@query("clear_space_estimates", f"SELECT {_SQL_KEYS}, round((35.0 / 33 - p2 / p1 + 500.0 * 4 / (10 * p1 * 33)) * 100, 5) AS estimated, round((1 + 2.0 / 33 - p2 / p1) * 100, 5) AS by_weight FROM (SELECT *, 50 + l_quantity AS p1, 15 + l_quantity / 5 AS p2 FROM lineitem)")
def _clear_estimates(read):
    p1, p2 = c("l_quantity") + 50, c("l_quantity") / 5 + 15
    e = dialysis.clear_space_estimated(F.lit(35.0), F.lit(33.0), p1, p2, F.lit(500.0), F.lit(4.0))
    return rounded(read("lineitem").select(*_KEYS, e.alias("estimated"), dialysis.clear_space_by_weight(F.lit(2.0), F.lit(33.0), p1, p2).alias("by_weight")), 5)


@query("salt_and_iron", f"SELECT {_SQL_KEYS}, round(l_quantity / 10 * 140 / 17 / 2, 6) AS salt, round(CASE WHEN l_linenumber <> 3 THEN l_quantity / (200 + l_linenumber) * 100 END, 6) AS tsat, CASE WHEN l_linenumber % 3 = 0 THEN 'dry' ELSE 'post' END AS source FROM lineitem")
def _salt(read):
    n = c("l_linenumber")
    tibc = F.when(n == 3, 0).otherwise(n + 200)
    return lines(read, dialysis.salt_intake(c("l_quantity") / 10, F.lit(140.0)).alias("salt"), dialysis.tsat(c("l_quantity"), tibc).alias("tsat"), dialysis.weight_for_gnri(F.when(n % 3 == 0, c("l_quantity")), c("l_quantity")).getField("source").alias("source"))


@query("urea_units", f"SELECT {_SQL_KEYS}, round(l_quantity * 60 / 28, 6) AS urea, round(l_quantity * 28 / 60, 6) AS bun, round(l_quantity / 2.8, 6) AS mmol, CASE WHEN 48 > l_linenumber * 10 THEN (48 - l_linenumber * 10)::DOUBLE END AS gap FROM lineitem")
def _units(read):
    q = c("l_quantity")
    return lines(read, dialysis.urea_from_bun(q).alias("urea"), dialysis.bun_from_urea(q).alias("bun"), dialysis.mmol_from_bun(q).alias("mmol"), dialysis.interdialytic_hours(F.lit(48.0), (c("l_linenumber") * 10).cast("double")).alias("gap"))


@query("tac_weighted", "SELECT l_orderkey, round(sum((l_quantity + 50 + l_quantity + 10) / 2 * 4 + (l_quantity + 10 + l_quantity + 45) / 2 * 44) / sum(48), 5) AS tac, (count(*) * 48)::DOUBLE AS hours FROM lineitem GROUP BY 1")
def _weighted(read):
    q = c("l_quantity")
    df = read("lineitem").select("l_orderkey", (q + 50).alias("pre"), (q + 10).alias("post"), (q + 45).alias("then"), F.lit(4.0).alias("td"), F.lit(44.0).alias("ti"))
    return rounded(series.tac_weighted(df, "l_orderkey", "pre", "post", "then", "td", "ti"), 5)


@query("tac_input_warnings", "SELECT count(*) FILTER (l_quantity < 20)::BIGINT AS low, count(*) FILTER (l_quantity > 120)::BIGINT AS high FROM lineitem")
def _warnings(read):
    told = derived.check_simple_inputs(read("lineitem").select(F.lit(20.0).alias("post"), c("l_quantity").alias("next")), "post", "next")
    n = {"under": 0, "6 times": 0} | {k: int(m.split()[0]) for m in told for k in ("under", "6 times") if k in m}
    return read("region").sparkSession.createDataFrame([(n["under"], n["6 times"])], "low long, high long")


_DERIVED_SQL = f"""
WITH x AS (SELECT {_SQL_KEYS}, 60 + l_tax * 100 AS wpre, 58 + l_tax * 100 AS wpost, 40 + l_quantity AS b1, (40 + l_quantity) * 0.3 AS b2, l_quantity + 50 AS fe, 250.0 AS tibc, 8 + l_discount * 10 AS ca, CASE WHEN l_linenumber <> 2 THEN 3 + l_discount * 20 END AS alb, 5.0 AS p FROM lineitem),
y AS (SELECT *, round(wpre - wpost, 2) AS uf, round(CASE WHEN alb < 4 THEN ca + 4 - alb WHEN alb >= 4 THEN ca END, 2) AS cca FROM x)
SELECT l_orderkey, l_linenumber, 4.5::DOUBLE AS hours, uf, round((b1 - b2) / b1 * 100, 2) AS urr, round(-ln(b2 / b1 - 0.008 * 4.5) + (4 - 3.5 * (b2 / b1)) * uf / wpost, 3) AS ktv, round(fe / tibc * 100, 2) AS tsat, cca, round(cca * p, 2) AS ccap FROM y
"""


@query("derived_columns", _DERIVED_SQL)
def _derived(read):
    b, t = c("l_quantity") + 40, c("l_tax") * 100
    df = read("lineitem").select(*_KEYS, F.lit("9:00").alias("透析開始時刻"), F.lit("13:30").alias("透析終了時刻"), (t + 60).alias("透析前体重"), (t + 58).alias("透析後体重"), b.alias("透析前BUN"), (b * 0.3).alias("透析後BUN"), (c("l_quantity") + 50).alias("Fe"), F.lit(250.0).alias("TIBC"), (c("l_discount") * 10 + 8).alias("Ca"), F.when(c("l_linenumber") != 2, c("l_discount") * 20 + 3).alias("Alb"), F.lit(5.0).alias("P"))
    names = {"hours": derived.HOURS, "uf": derived.LOSS, "urr": derived.URR, "ktv": derived.KTV, "tsat": derived.TSAT, "cca": derived.CCA, "ccap": derived.CCAP}
    out, _ = derived.derive(df)
    return out.select(c("l_orderkey"), c("l_linenumber").cast("long").alias("l_linenumber"), *[F.col(f"`{v}`").alias(k) for k, v in names.items()])


@query("derived_bmi", "SELECT p_partkey, round((40 + p_size) / (((150 + p_size) / 100.0) * ((150 + p_size) / 100.0)), 2) AS bmi FROM part")
def _derived_bmi(read):
    out, _ = derived.derive(read("part").select("p_partkey", (c("p_size") + F.lit(150.0)).alias("身長(cm)"), (c("p_size") + F.lit(40.0)).alias("体重")))
    return out.select("p_partkey", c(derived.BMI).alias("bmi"))


# ---- cleaning ----------------------------------------------------------------------------------------------------------

_WRITTEN = f"SELECT {_SQL_KEYS}, CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN NULL WHEN l_linenumber = 3 THEN NULL WHEN l_linenumber = 4 THEN (5 + l_discount * 10) / 2 ELSE 5 + l_discount * 10 END AS hb FROM lineitem"


def _messy(read):
    """Haemoglobin with words, codes, censoring, impossible values and values in g/L."""
    n, v = c("l_linenumber"), c("l_discount") * 10 + 5
    s = F.when(n == 1, F.lit("未測定")).when(n == 2, F.lit("9999")).when(n == 3, F.lit("0.2")).when(n == 4, F.concat(F.lit("<"), v.cast("string"))).when(n == 5, (v * 10).cast("string")).otherwise(v.cast("string"))
    return read("lineitem").select(*_KEYS, s.alias("Hb"))


@query("cleaned_numbers", f"SELECT l_orderkey, l_linenumber, round(hb, 6) AS hb FROM ({_WRITTEN})")
def _cleaned(read):
    df, _ = clean.clean_numeric(_messy(read))
    return rounded(df.select(*_KEYS, c("Hb").alias("hb")))


@query("cleaning_actions", "SELECT 'says missing' AS action, count(*) FILTER (l_linenumber = 1)::BIGINT AS n FROM lineitem UNION ALL SELECT 'missing code', count(*) FILTER (l_linenumber = 2) FROM lineitem UNION ALL SELECT 'outside the possible range', count(*) FILTER (l_linenumber IN (2, 3) OR l_linenumber = 5 AND (5 + l_discount * 10) * 10 > 25) FROM lineitem UNION ALL SELECT 'censored low', count(*) FILTER (l_linenumber = 4) FROM lineitem")
def _actions(read):
    _, report = clean.clean_numeric(_messy(read))
    return read("region").sparkSession.createDataFrame([(a["action"], a["count"]) for a in report.actions], "action string, n long")


@query("frequent_codes", "SELECT CASE WHEN l_linenumber = 1 THEN NULL ELSE l_quantity * 10 END AS ferritin, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")
def _codes(read):
    # 9999 is a possible ferritin: it counts as a code because it is frequent and far over the other values
    df, _ = clean.clean_numeric(read("lineitem").select(F.when(c("l_linenumber") == 1, F.lit(9999.0)).otherwise(c("l_quantity") * 10).alias("フェリチン")), fix_units=False)
    return df.groupBy(c("フェリチン").alias("ferritin")).agg(F.count(F.lit(1)).alias("n"))


@query("mixed_scales", "SELECT true AS found, count(*) FILTER (l_quantity > 0)::BIGINT AS n FROM lineitem")
def _scales(read):
    df = read("lineitem").select(F.when(c("l_linenumber") % 2 == 0, c("l_quantity") / 5 + 10).otherwise((c("l_quantity") / 5 + 10) * 1000).alias("v"))
    gap = clean.two_scales(df, "v")
    ok = gap is not None and 18 < gap["low"] < 30 and 7000 < gap["high"] <= 10_200
    return df.agg(F.lit(ok).alias("found"), F.count("v").alias("n"))


@query("range_violations", "SELECT 'l_quantity' AS \"column\", l_orderkey || '-' || l_linenumber AS \"row\", l_quantity AS value FROM lineitem WHERE l_quantity > 45 OR l_quantity < 3")
def _ranges(read):
    df = read("lineitem").select("l_quantity", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("k"))
    _, bad, _ = clean.apply_ranges(df, {"l_quantity": [3, 45], "nothing": [1, 2], "k": [5, 1]}, "k")
    return bad


@query("ranged_values", "SELECT count(*)::BIGINT AS n, count(*) FILTER (l_quantity BETWEEN 3 AND 45)::BIGINT AS kept, 2::BIGINT AS problems FROM lineitem")
def _ranged(read):
    df, _, problems = clean.apply_ranges(read("lineitem").select("l_quantity"), {"l_quantity": {"low": 3, "upper": 45}, "nothing": [1, 2], "l_tax": [5, 1]})
    return df.agg(F.count(F.lit(1)).alias("n"), F.count("l_quantity").alias("kept"), F.lit(len(problems)).cast("long").alias("problems"))


@query("binary_spellings", f"SELECT {_SQL_KEYS}, CASE WHEN l_linenumber % 4 = 0 THEN 1 WHEN l_linenumber % 4 = 1 THEN 0 WHEN l_linenumber % 4 = 2 THEN 1 END::BIGINT AS value FROM lineitem")
def _spellings(read):
    n = c("l_linenumber") % 4
    s = F.when(n == 0, F.lit("Ｙes")).when(n == 1, F.lit(" no ")).when(n == 2, F.lit("YES")).otherwise(F.lit("?"))
    return rounded(read("lineitem").select(*_KEYS, numeric.binary(s, ["yes"], ["no"]).alias("value")))


@query("encoded_binaries", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END::BIGINT AS o_orderstatus, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P')::BIGINT AS unread FROM orders")
def _encoded(read):
    df, told = clean.encode_binaries(read("orders").select("o_orderkey", "o_orderstatus"), {"o_orderstatus": (["F"], ["O"])})
    return rounded(df.withColumn("unread", F.lit(told[0]["unread"])))


@query("excluded_rows", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 AND o_orderstatus = 'P' THEN 'dear／open' WHEN o_totalprice > 300000 THEN 'dear' ELSE 'open' END AS exclude_reason FROM orders WHERE o_totalprice > 300000 OR o_orderstatus = 'P'")
def _excluded(read):
    df = clean.mark_exclusions(read("orders"), {"dear": c("o_totalprice") > 300000, "open": c("o_orderstatus") == "P"})
    return clean.excluded_cases(df, ["o_orderkey"])


@query("reasons_by_id", "SELECT o_orderkey, CASE WHEN o_custkey % 6 = 0 THEN 'left／moved' WHEN o_custkey % 2 = 0 THEN 'left' WHEN o_custkey % 3 = 0 THEN 'moved' END AS reason FROM orders")
def _reasons(read):
    cust = read("customer").select(c("c_custkey").alias("o_custkey"))
    told = cust.filter("o_custkey % 2 = 0").withColumn("reason", F.lit("left")).unionByName(cust.filter("o_custkey % 3 = 0").withColumn("reason", F.lit("moved")))
    return clean.reasons_by_id(read("orders").select("o_orderkey", "o_custkey"), told, "o_custkey").select("o_orderkey", "reason")


@query("rows_with_outcome", "SELECT count(*)::BIGINT AS \"rows\", count(*) FILTER (event_id % 7 <> 0)::BIGINT AS kept, count(*) FILTER (event_id % 7 = 0)::BIGINT AS dropped FROM events")
def _outcome(read):
    df, told = clean.without_missing_outcome(_holes(read).withColumn("value", F.when(c("event_id") % 7 != 0, F.lit(1.0))), "value")
    return df.agg(F.lit(told["rows"]).alias("rows"), F.count(F.lit(1)).alias("kept"), F.lit(told["dropped"]).alias("dropped"))


@query("rows_without_outcome", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 3 = 0 THEN 'no outcome／no survival' WHEN o_orderkey % 5 = 0 THEN 'no outcome' ELSE 'no survival' END AS reason FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 3 = 0")
def _no_outcome(read):
    return clean.without_outcome(read("orders"), "o_orderkey", {"no outcome": c("o_orderkey") % 5 == 0, "no survival": c("o_orderkey") % 3 == 0})


@query("model_rows", "SELECT (o_orderkey % 2)::BIGINT AS y, o_totalprice, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END::BIGINT AS o_orderstatus, (left(o_orderpriority, 1)::INT - 1)::BIGINT AS o_orderpriority, (o_custkey % 3 = 1)::BIGINT AS \"k=1\", (o_custkey % 3 = 2)::BIGINT AS \"k=2\" FROM orders WHERE o_orderkey % 3 <> 0")
def _model(read):
    df = read("orders").withColumns({"y": F.when(c("o_orderkey") % 3 != 0, c("o_orderkey") % 2), "k": c("o_custkey") % 3})
    levels = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    return rounded(clean.model_frame(df, "y", ["o_totalprice"], {"o_orderstatus": (["F"], ["O"])}, {"o_orderpriority": levels}, ["k"]))


@query("removals", "SELECT * FROM (VALUES (0, 'row', 'orders', 3), (1, 'value', 'Hb', 9), (2, 'column', 'note', 1)) v(place, kind, target, n)")
def _removals(read):
    rows = clean.removal_ledger([("column", "note", 1, "left out", "text", "roles"), ("value", "Hb", 9, "set missing", "code", "clean"), ("value", "P", 0, "set missing", "code", "clean"), ("row", "orders", 3, "deleted", "blank", "load")])
    return rounded(read("region").sparkSession.createDataFrame([(i, r["kind"], r["target"], r["count"]) for i, r in enumerate(rows)], "place int, kind string, target string, n int"))


@query("timing_values", "SELECT l_linenumber::BIGINT AS k, CASE l_linenumber WHEN 1 THEN 'pre' WHEN 2 THEN 'post' WHEN 3 THEN 'pre' WHEN 4 THEN 'post' END AS timing FROM (SELECT DISTINCT l_linenumber FROM lineitem)")
def _timing_values(read):
    n = c("l_linenumber")
    s = F.when(n == 1, F.lit("透析前")).when(n == 2, F.lit("ＰＯＳＴ")).when(n == 3, F.lit(" Before")).when(n == 4, F.lit("2")).otherwise(F.lit("later"))
    return read("lineitem").select(n).distinct().select(n.cast("long").alias("k"), dictionary.timing_value(s).alias("timing"))
