"""Named queries of audit checks, roles, the dictionary, whole rows and runs, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.operators import audit, clean, compare, roles
from cohortloom.plans import dictionary, labels, orchestrate
from cohortloom.plans.catalog import query, rounded
from cohortloom.plans.catalog_groups import table
from cohortloom.sources import reader, sheets

c = F.col
FOUND = "check string, severity string, count long"


def findings(read, found: list[dict]):
    return table(read, found, FOUND)


# ---- whole rows --------------------------------------------------------------------------------------------------------


@query("duplicate_rows", "SELECT 'duplicate rows' AS \"check\", 'error' AS severity, count(*) FILTER (n_nationkey % 2 = 0)::BIGINT AS count FROM nation UNION ALL SELECT 'duplicate ids', 'error', count(*) FILTER (n_nationkey % 2 = 0) FROM nation")
def _duplicates(read):
    df = read("nation")
    return findings(read, audit.duplicates(df.unionByName(df.filter("n_nationkey % 2 = 0")), "n_nationkey"))


@query("copied_texts", "SELECT (count(*) - count(DISTINCT coalesce(text, '-')))::BIGINT AS extra FROM documents")
def _copies(read):
    found = audit.duplicates(read("documents").select(F.coalesce("text", F.lit("-")).alias("text")))
    return table(read, [{"extra": sum(f["count"] for f in found)}], "extra long")


@query("blank_rows", "SELECT n_nationkey FROM nation WHERE n_nationkey % 3 <> 0")
def _blank_rows(read):
    blank = c("n_nationkey") % 3 == 0
    kept, _ = clean.drop_blank_rows(read("nation").select(F.when(~blank, c("n_nationkey")).alias("n_nationkey"), F.when(blank, "　 ").otherwise(c("n_name")).alias("n_name")))
    return kept.select("n_nationkey")


@query("trailing_blank_rows", "SELECT n_nationkey AS _row_id FROM nation WHERE n_nationkey <= 20")
def _trailing(read):
    name = F.when((c("n_nationkey") <= 20) & (c("n_nationkey") != 7), c("n_name"))
    return reader.drop_trailing_blank(read("nation").select(c("n_nationkey").alias("_row_id"), name.alias("name"))).select("_row_id")


@query("same_rows", "SELECT true AS same, false AS other")
def _same(read):
    df = read("nation")
    moved = df.repartition(5)
    return table(read, [{"same": reader.same_rows(df, moved), "other": reader.same_rows(df, moved.filter("n_nationkey > 0"))}], "same boolean, other boolean")


@query("days_of_moments", "SELECT ts::DATE::VARCHAR AS day, count(*)::BIGINT AS n FROM events GROUP BY 1")
def _moments(read):
    return sheets.date_only(read("events").select("ts")).groupBy(c("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("column_names", "SELECT * FROM (VALUES (0, 'id'), (1, 'a,b'), (2, 'column2'), (3, 'id.1')) v(place, name)")
def _names(read):
    rows = [["", "title", "", ""], ["id", "a,b", "", "id"], ["1", "x", "y", "z"]]
    names, _ = reader.column_names(rows[reader.header_row(rows)])
    return table(read, [{"place": i, "name": n} for i, n in enumerate(names)], "place long, name string")


@query("column_coverage", "SELECT * FROM (VALUES ('gone', 'not in the data'), ('n_comment', 'not in the schema')) v(\"column\", problem)")
def _coverage(read):
    s = roles.infer(read("nation").drop("n_comment").withColumn("gone", F.lit(1)))
    return table(read, s.coverage(["n_nationkey", "n_name", "n_regionkey", "n_comment"]), "`column` string, problem string")


# ---- audit -------------------------------------------------------------------------------------------------------------


@query("audit_missing", "SELECT 'missing' AS \"check\", CASE WHEN k >= 0.5 * n THEN 'warn' ELSE 'info' END AS severity, k::BIGINT AS count FROM (SELECT count(*) FILTER (event_id % 5 = 0) AS k, count(*) AS n FROM events UNION ALL SELECT count(*) FILTER (event_id % 3 > 0), count(*) FROM events) WHERE k >= 0.2 * n")
def _missing(read):
    e = c("event_id")
    return findings(read, audit.missing(read("events").select(e, F.when(e % 5 != 0, e).alias("a"), F.when(e % 3 == 0, e).alias("b"))))


@query("audit_collinear", "SELECT 'collinear' AS \"check\", 'info' AS severity, 0::BIGINT AS count")
def _collinear(read):
    q = c("l_quantity")
    return findings(read, audit.collinear(read("lineitem").select(q, (q * 2 + 1).alias("twice"), c("l_discount")), ["l_quantity", "twice", "l_discount"]))


@query("audit_outcome", "SELECT 'outcome' AS \"check\", CASE WHEN count(*) FILTER (o_orderstatus = 'P') >= 0.2 * count(*) THEN 'error' ELSE 'warn' END AS severity, (count(*) FILTER (o_orderstatus = 'P'))::BIGINT AS count FROM orders UNION ALL SELECT 'outcome', 'error', 4")
def _audit_outcome(read):
    y = F.when(c("o_orderstatus") != "P", F.when(c("rare") <= 4, 1).otherwise(0))
    first = read("orders").filter("o_orderstatus <> 'P'").orderBy("o_orderkey").limit(4).select("o_orderkey", F.lit(1).alias("rare"))
    return findings(read, audit.outcome(read("orders").join(F.broadcast(first), "o_orderkey", "left").withColumn("y", F.coalesce(y, F.when(c("o_orderstatus") != "P", 0))).select("o_orderkey", "y"), "y"))


@query("audit_leakage", "SELECT 'leakage' AS \"check\", 'error' AS severity, 0::BIGINT AS count")
def _leakage(read):
    q = c("l_quantity")
    return findings(read, audit.leakage(read("lineitem").select(q, (q * 3).alias("copy"), c("l_discount")), ["copy", "l_discount"], "l_quantity"))


@query("audit_groups", "SELECT 'groups' AS \"check\", 'warn' AS severity, count(*)::BIGINT AS count FROM (SELECT s_nationkey FROM supplier WHERE s_suppkey < 90 GROUP BY 1 HAVING count(*) < 10) HAVING count(*) > 0 UNION ALL SELECT 'groups', 'warn', count(DISTINCT s_nationkey) FROM supplier WHERE s_suppkey < 90 HAVING count(DISTINCT s_nationkey) > 20")
def _groups(read):
    return findings(read, audit.groups(read("supplier").filter("s_suppkey < 90"), "s_nationkey"))


@query("spelling_variants", "SELECT 's' AS \"column\", 'o' AS folded, 2::BIGINT AS variants")
def _variants(read):
    s = F.when(c("o_orderstatus") == "O", F.when(c("o_orderkey") % 2 == 0, "O").otherwise(" ｏ")).otherwise(c("o_orderstatus"))
    return audit.spelling_variants(read("orders").select(s.alias("s")), ["s"]).select("column", "folded", "variants")


@query("audit_pre_post", "SELECT 'pre and post' AS \"check\", CASE WHEN count(*) FILTER (l_linenumber <= 2) > 0.5 * count(*) THEN 'error' ELSE 'warn' END AS severity, count(*) FILTER (l_linenumber <= 2)::BIGINT AS count FROM lineitem")
def _pre_post(read):
    q = c("l_quantity") + 20
    return findings(read, audit.pre_post(read("lineitem").select(q.alias("透析前BUN"), F.when(c("l_linenumber") <= 2, q + 1).otherwise(q - 1).alias("透析後BUN"))))


@query("audit_cross_items", "SELECT 'cross items' AS \"check\", 'error' AS severity, count(*) FILTER (l_quantity > 40)::BIGINT AS count FROM lineitem UNION ALL SELECT 'cross items', 'error', count(*) FILTER (l_quantity <= 10) FROM lineitem UNION ALL SELECT 'cross items', 'warn', count(*) FILTER (l_quantity < 10) FROM lineitem")
def _cross(read):
    q = c("l_quantity")
    return findings(read, audit.cross_items(read("lineitem").select(q.alias("Fe"), F.lit(40.0).alias("TIBC"), q.alias("SBP"), F.lit(10.0).alias("DBP"), q.alias("BMI"))))


@query("audit_composition", "SELECT 'cross items' AS \"check\", 'warn' AS severity, count(*) FILTER (abs(l_quantity - 25) > 3)::BIGINT AS count FROM lineitem")
def _composition(read):
    q = c("l_quantity")
    return findings(read, audit.cross_items(read("lineitem").select((q + 35).alias("好中球"), F.lit(10.0).alias("好酸球"), F.lit(10.0).alias("好塩基球"), F.lit(10.0).alias("単球"), F.lit(10.0).alias("リンパ球"))))


@query("audit_survival_dates", "SELECT 'survival dates' AS \"check\", v.s AS severity, v.n::BIGINT AS count FROM (SELECT 'error' AS s, count(*) FILTER (o_orderkey % 5 = 0 AND o_orderkey % 3 = 0) AS n FROM orders UNION ALL SELECT 'error', count(*) FILTER (o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0) FROM orders UNION ALL SELECT 'warn', count(*) FILTER (o_orderkey % 7 = 0 AND (o_orderkey % 5 = 0 OR o_orderkey % 3 = 0)) FROM orders) v WHERE v.n > 0")
def _dates(read):
    k, d = c("o_orderkey"), c("o_orderdate").cast("date")
    end = F.when(k % 7 == 0, d).otherwise(F.date_add(d, 9))
    return findings(read, audit.survival_dates(read("orders").select(d.alias("s"), F.when(k % 5 == 0, end).alias("e"), F.when(k % 3 == 0, end).alias("x")), "s", "e", "x"))


@query("audit_dates", "SELECT 'dates' AS \"check\", 'error' AS severity, count(*) FILTER (o_orderdate > DATE '1998-06-30')::BIGINT AS count FROM orders UNION ALL SELECT 'dates', 'warn', count(*) FILTER (o_orderkey % 4 = 0) FROM orders")
def _date_checks(read):
    s = F.when(c("o_orderkey") % 4 == 0, "later").otherwise(F.date_format("o_orderdate", "yyyy/MM/dd"))
    full = F.date_format("o_orderdate", "yyyy-MM-dd")
    return findings(read, audit.date_checks(read("orders").select(full.alias("a")), ["a"], "1998-06-30") + audit.date_checks(read("orders").select(s.alias("b")), ["b"], "2100-01-01"))


@query("audit_method_step", "SELECT 'method change' AS \"check\", 'error' AS severity, 0::BIGINT AS count UNION ALL SELECT 'method change', 'info', 0")
def _step(read):
    d = c("o_orderdate").cast("date")
    df = read("orders").select(d.alias("day"), F.when(d >= F.lit("1998-01-01").cast("date"), c("o_totalprice") / 3).otherwise(c("o_totalprice")).alias("ALP"), c("o_totalprice").alias("LDH"))
    return findings(read, audit.method_step(df, "day", "ALP", "1998-01-01") + audit.method_step(df, "day", "LDH", "1998-01-01"))


@query("audit_ids", "SELECT 'id candidates' AS \"check\", 'warn' AS severity, 0::BIGINT AS count FROM (VALUES (1), (2))")
def _ids(read):
    return findings(read, audit.id_candidates(read("customer").select("c_custkey", c("c_custkey").cast("string").alias("text"), "c_nationkey", c("c_custkey").alias("BUN"))))


@query("audit_timings", "SELECT * FROM (VALUES ('timing', 'warn', 0::BIGINT), ('timing', 'info', 0)) v(\"check\", severity, count)")
def _timings(read):
    return findings(read, audit.timings(read("region").select(F.lit(1.0).alias("BUN"), F.lit(1.0).alias("透析前Cr"), F.lit(1.0).alias("透析前K"), F.lit(1.0).alias("透析後K"))))


@query("audit_in_order", "SELECT row_number() OVER (ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END, \"check\")::BIGINT AS place, \"check\", severity FROM (VALUES ('duplicate rows', 'error'), ('id candidates', 'warn'), ('missing', 'warn'), ('collinear', 'info')) v(\"check\", severity)")
def _order(read):
    key = c("c_custkey")
    df = read("customer").filter(key <= 40).select(key.cast("string").alias("code"), F.when(key > 30, 1.0).alias("hole"), key.cast("double").alias("x"), (key * 2.0).alias("y"))
    again = df.filter(c("x") == 1).withColumn("code", F.lit(None).cast("string"))
    found = audit.audit(df.unionByName(again).unionByName(again))
    return table(read, [f | {"place": i} for i, f in enumerate(found, 1)], "place long, check string, severity string")


# ---- roles and the dictionary ------------------------------------------------------------------------------------------

_ROLES = [("o_orderkey", "numeric"), ("患者番号", "id"), ("o_orderstatus", "nominal"), ("o_orderdate", "datetime"), ("sex", "binary"), ("stage", "ordinal"), ("same", "constant"), ("y", "outcome")]


def _typed(read):
    k = c("o_orderkey")
    stage = F.concat(F.lit("T"), (k % 5).cast("string"))
    return read("orders").select((k % 5000 * 1.5).alias("o_orderkey"), k.cast("string").alias("患者番号"), "o_orderstatus", "o_orderdate", F.when(k % 2 == 0, "男").otherwise("女").alias("sex"), stage.alias("stage"), F.lit("x").alias("same"), (k % 3 == 0).cast("int").alias("y"))


@query("roles_inferred", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _ROLES) + ") v(\"column\", role)")
def _inferred(read):
    s = roles.Schema.from_yaml(roles.infer(_typed(read), "y").to_yaml())
    return table(read, [{"column": k, "role": v.role} for k, v in s.columns.items()], "`column` string, role string")


@query("roles_edited", "SELECT * FROM (VALUES ('same', 'role', 'constant', 'nominal'), ('same', 'action', 'drop', 'keep'), ('o_orderkey', 'dict_key', NULL, 'P')) v(\"column\", field, was, now)")
def _edited(read):
    a = roles.infer(_typed(read), "y")
    b = roles.Schema.from_yaml(a.to_yaml()).override({"same": {"role": "nominal", "unit": None}, "o_orderkey": {"dict_key": "P"}})
    return table(read, a.diff(b), "`column` string, field string, was string, now string")


@query("roles_refused", "SELECT 2::BIGINT AS problems")
def _refused(read):
    try:
        roles.Schema.from_yaml("columns:\n  a: {name: a, role: wrong, reason: x, action: keep}\n  b: {name: b, role: id, reason: x, action: burn}\n")
    except ValueError as e:
        return table(read, [{"problems": len(str(e).split("; "))}], "problems long")
    raise AssertionError("a wrong schema was read")


_NAMES = [("透析前BUN", "BUN", "pre"), ("BUN(透析後)", "BUN", "post"), ("post_weight", "weight", "post"), ("Kt/V", "KtV", "unknown"), ("前回日", None, "unknown"), ("ｱﾙﾌﾞﾐﾝ", "Alb", "unknown"), ("血糖値_前", "GLU", "pre"), ("present", None, "pre"), ("意味不明", None, "unknown"), ("PT-INR", "PT_INR", "unknown")]


@query("named_columns", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', {'NULL' if b is None else repr(b)}, '{t}')" for a, b, t in _NAMES) + ") v(name, item, timing)")
def _named(read):
    return table(read, [{"name": n, "item": dictionary.item_of(n), "timing": dictionary.timing(n)[0]} for n, _, _ in _NAMES], "name string, item string, timing string")


@query("stripped_names", "SELECT * FROM (VALUES ('BUN(透析後)', 'bun'), ('透析前_Cr', 'cr'), ('K [post]', 'k'), ('(透析前)', '')) v(name, rest)")
def _stripped(read):
    return table(read, [{"name": n, "rest": dictionary.timing(n)[1]} for n in ("BUN(透析後)", "透析前_Cr", "K [post]", "(透析前)")], "name string, rest string")


@query("index_requirements", "SELECT * FROM (VALUES ('URR', true, 0), ('spKt/V', false, 1), ('nPCR', false, 1), ('%CGR', false, 5), ('クリアスペース率A/V(推算)', false, 1), ('推定塩分量', false, 2), ('TAC-BUN(簡便式)', false, 1), ('TAC-BUN(時間加重)', false, 3), ('補正Ca', true, 0), ('iCa(mg/dL)', true, 0), ('TSAT', false, 1), ('GNRI', false, 1), ('BMI', false, 1)) v(\"index\", ready, missing)")
def _requirements(read):
    rows = dictionary.requirements(["透析前BUN", "透析後BUN", "透析前体重", "透析後体重", "Ca", "Alb", "Fe"])
    return table(read, [r | {"missing": len(r["missing"])} for r in rows], "index string, ready boolean, missing long")


@query("timing_pairs", "SELECT * FROM (VALUES ('BUN', '透析前BUN', 'BUN後'), ('Cr', 'pre Cr', 'post Cr')) v(item, pre, post)")
def _pairs(read):
    t = dictionary.Timings.infer(["透析前BUN", "BUN(透析後)", "BUN後", "pre Cr", "post Cr", "透析前K"])
    return table(read, [{"item": k, "pre": a, "post": b.replace("BUN(透析後)", "BUN後")} for k, (a, b) in t.pairs().items()], "item string, pre string, post string")


@query("picked_columns", "SELECT * FROM (VALUES ('BUN', 'pre', '透析前BUN', false), ('Cr', 'post', 'Cr', true), ('K', 'pre', NULL, false)) v(item, timing, \"column\", assumed)")
def _picked(read):
    columns = ["BUN", "透析前BUN", "Cr", "透析後K"]
    rows = [(i, t, *dictionary.pick(columns, i, t)) for i, t in (("BUN", "pre"), ("Cr", "post"), ("K", "pre"))]
    return table(read, [dict(zip(("item", "timing", "column", "assumed"), r)) for r in rows], "item string, timing string, `column` string, assumed boolean")


@query("achieved_targets", "SELECT 'P' AS item, '(all)' AS level, count(*)::BIGINT AS n, count(*) FILTER (l_quantity / 5 >= 3.5 AND l_quantity / 5 < 5.5)::BIGINT AS achieved, round(count(*) FILTER (l_quantity / 5 >= 3.5 AND l_quantity / 5 < 5.5) / count(*)::DOUBLE, 6) AS rate FROM lineitem UNION ALL SELECT 'Hb', '(all)', count(*), count(*) FILTER (l_quantity >= 10 AND l_quantity < 12), round(count(*) FILTER (l_quantity >= 10 AND l_quantity < 12) / count(*)::DOUBLE, 6) FROM lineitem")
def _achieved(read):
    return rounded(compare.achievement(read("lineitem").select((c("l_quantity") / 5).alias("透析前P"), c("l_quantity").alias("血色素量"))).select("item", "level", "n", "achieved", "rate"))


@query("orchestrated_run", "SELECT count(*) FILTER (o_orderkey % 5 <> 0)::BIGINT AS with_outcome, count(*)::BIGINT AS n, 0::BIGINT AS leaks FROM orders")
def _run(read):
    k = c("o_orderkey")
    df = read("orders").select(k.alias("_row_id"), c("o_totalprice").alias("price"), "o_orderstatus", F.when(k % 5 != 0, (k % 3 == 0).cast("int")).alias("y"))
    got = orchestrate.run(df, "y")
    both = got.books["train"].unionByName(got.books["test"])
    return both.agg(F.count(F.lit(1)).alias("with_outcome"), F.lit(df.count()).alias("n"), F.lit(sum(x["found"] for x in got.leaks)).cast("long").alias("leaks"))


# ---- names and texts ---------------------------------------------------------------------------------------------------

_ENGLISH = [("透析前BUN", "Pre-dialysis blood urea nitrogen", "透析前BUN [mg/dL]（透析前）"), ("年齢", "Age", "年齢 [歳]"), ("謎の列", "謎の列", "謎の列"), ("GNRI", "Geriatric nutritional risk index", "GNRI")]


def values(rows: list[tuple], names: str) -> str:
    """Rows as SQL values."""
    cell = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") v({names})"


@query("english_columns", values(_ENGLISH, 'name, english, label'))
def _english(read):
    return table(read, [{"name": n, "english": labels.column_en(n), "label": labels.label(n)} for n, _, _ in _ENGLISH], "name string, english string, label string")


_LEVELS = [("A院", "Hospital A"), ("男", "Male"), ("なし", "No"), ("京都病院", "京都病院"), ("Ｂクリニック", "Clinic B")]


@query("english_levels", values(_LEVELS, "level, english"))
def _english_levels(read):
    return table(read, [{"level": v, "english": labels.level_en(v)} for v, _ in _LEVELS], "level string, english string")


@query("binary_names", values([("性別", "男性"), ("糖尿病", "糖尿病"), ("転帰", "死亡")], "name, out"))
def _binary_names(read):
    return table(read, [{"name": c, "out": labels.binary_name(c, ones)} for c, ones in (("性別", ["男"]), ("糖尿病", ["あり"]), ("転帰", ["死亡"]))], "name string, out string")


@query("target_texts", values([("P", "3.5 ≤ P < 5.5"), ("KtV", "1.4 ≤ KtV"), ("iPTH", "iPTH < 240")], "item, text"))
def _targets(read):
    return table(read, [{"item": k, "text": labels.target_text(k)} for k in ("P", "KtV", "iPTH")], "item string, text string")


@query("text_tables", values([("列     n|年齢   5|P     12",)], "text"))
def _text_table(read):
    return table(read, [{"text": labels.text_table([{"列": "年齢", "n": 5}, {"列": "P", "n": 12}]).replace("\n", "|")}], "text string")


@query("masked_messages", values([("v: 1 values may be entry errors (e.g. [...]); the farthest has a robust z of 12", 1, 1)], "text, mark, crlf"))
def _masked(read):
    said = labels.entry_messages([{"row": 7, "value": 990.0, "z": 12.0}], "v")
    sent = labels.attention(said)
    return table(read, [{"text": labels.masked(said[0]), "mark": int(sent.startswith(b"\xef\xbb\xbf")), "crlf": int(sent.endswith(b"\r\n"))}], "text string, mark long, crlf long")


@query("resolved_settings", values([("test", "0.25"), ("seed", "3"), ("told", "1")], "name, value"))
def _settings(read):
    out, told = orchestrate.resolved({"seed": 3, "old": 1}, {"seed": 5, "test": 0.25})
    return table(read, [{"name": "test", "value": str(out["test"])}, {"name": "seed", "value": str(out["seed"])}, {"name": "told", "value": str(len(told))}], "name string, value string")


@query("synthetic_cohort", "SELECT 600::BIGINT AS n, 33::BIGINT AS columns, true AS swapped, true AS censored")
def _cohort(read):
    from cohortloom.sources.cohort import cohort

    df = cohort(read("region").sparkSession)
    wrong = F.avg(F.when(c("施設") == "D院", (c("透析後BUN").try_cast("double") > c("透析前BUN").try_cast("double")).cast("double")))
    return df.agg(F.count(F.lit(1)).alias("n"), F.lit(len(df.columns)).cast("long").alias("columns"), (wrong == 1).alias("swapped"), (F.count_if(c("CRP") == "<0.05") > 20).alias("censored"))
