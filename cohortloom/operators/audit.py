"""Audit checks: findings with a severity, from a few fused aggregates; the data stays as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.dates import read_dates
from cohortloom.functions.numeric import folded
from cohortloom.operators.compare import mann_whitney, pearson
from cohortloom.operators.places import quantiles
from cohortloom.operators.profile import column_profile, long_form
from cohortloom.plans.dictionary import DECREASES, INCREASES, Timings, item_of, timing

SEVERITY = {"error": 0, "warn": 1, "info": 2}


def finding(check: str, severity: str, message: str, count: int = 0) -> dict:
    return {"check": check, "severity": severity, "message": message, "count": count}


def duplicates(df: DataFrame, entity: str | None = None) -> list[dict]:
    out = []
    extra = df.groupBy(F.xxhash64(*df.columns).alias("h"), *df.columns).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0))).first()[0]
    if extra:
        out.append(finding("duplicate rows", "error", f"{extra} rows repeat another one", extra))
    if entity:
        ids = df.filter(F.col(entity).isNotNull()).groupBy(entity).count().filter("count > 1").count()
        if ids:
            out.append(finding("duplicate ids", "error", f"{ids} ids occur more than once", ids))
    return out


def missing(df: DataFrame, profile: list | None = None) -> list[dict]:
    """profile: the rows of column_profile(df), where they are known."""
    out = []
    for r in column_profile(df).collect() if profile is None else profile:
        rate = r["n_null"] / r["n"] if r["n"] else 0
        if rate >= 0.2:
            out.append(finding("missing", "warn" if rate >= 0.5 else "info", f"{r['column']}: {rate:.0%} missing", r["n_null"]))
    return out


def outcome(df: DataFrame, y: str) -> list[dict]:
    # at most eleven values come to the driver: with more of them y is no class
    counts = {r[0]: r[1] for r in df.filter(F.col(y).isNotNull()).groupBy(y).count().limit(11).collect()}
    n, kept = df.agg(F.count(F.lit(1)), F.count(F.col(y))).first()
    lost = n - kept
    out = [finding("outcome", "error" if lost >= 0.2 * n else "warn", f"{lost} rows without an outcome", lost)] if lost else []
    if len(counts) <= 1:
        out.append(finding("outcome", "error", "one value or none"))
    elif len(counts) <= 10:
        small, large = min(counts.values()), max(counts.values())
        if small < 10:
            out.append(finding("outcome", "error", f"the rarest class has {small} rows", small))
        elif large / small >= 9:
            out.append(finding("outcome", "warn", f"classes are {large / small:.0f} to 1"))
    return out


def collinear(df: DataFrame, columns: list[str]) -> list[dict]:
    if len(columns) < 2:
        return []
    rows = pearson(df, columns).filter("abs(r) >= 0.95").collect()
    return [finding("collinear", "info" if abs(r.r) >= 0.999 else "warn", f"{r.a} and {r.b}: r = {r.r:.3f}") for r in rows]


def leakage(df: DataFrame, columns: list[str], y: str) -> list[dict]:
    rows = pearson(df, [y, *columns]).filter((F.col("a") == y) & (F.abs("r") >= 0.99)).collect()
    return [finding("leakage", "error", f"{r.b} gives away {y}: r = {r.r:.3f}") for r in rows]


def groups(df: DataFrame, by: str) -> list[dict]:
    counts = df.filter(F.col(by).isNotNull()).groupBy(by).count()
    small, levels = counts.filter("count < 10").count(), counts.count()
    out = [finding("groups", "warn", f"{small} levels of {by} have fewer than 10 rows", small)] if small else []
    return out + ([finding("groups", "warn", f"{by} has {levels} levels", levels)] if levels > 20 else [])


def spelling_variants(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, folded, variants: spellings that differ only in case, width or spaces."""
    rows = long_form(df, columns).filter("value IS NOT NULL").distinct().withColumn("folded", folded(F.col("value")))
    return rows.groupBy("column", "folded").agg(F.count(F.lit(1)).alias("variants"), F.min("value").alias("example")).filter("variants > 1")


def pre_post(df: DataFrame) -> list[dict]:
    """Pairs of columns before and after a session whose difference has the wrong sign too often."""
    pairs: dict[str, dict[str, str]] = {}
    for c in df.columns:
        if (k := item_of(c)) in (*DECREASES, *INCREASES) and timing(c)[0] != "unknown":
            pairs.setdefault(k, {})[timing(c)[0]] = c
    pairs = {k: v for k, v in pairs.items() if len(v) == 2}
    if not pairs:
        return []
    aggs = []
    for k, v in pairs.items():
        d = F.col(v["post"]).try_cast("double") - F.col(v["pre"]).try_cast("double")
        aggs += [F.count(d), F.count_if(d > 0 if k in DECREASES else d < 0)]
    r, out = df.agg(*aggs).first(), []
    for i, k in enumerate(pairs):
        n, bad = r[2 * i], r[2 * i + 1]
        if n >= 10 and bad > 0.1 * n:
            out.append(finding("pre and post", "error" if bad > 0.5 * n else "warn", f"{k}: {bad} of {n} pairs go the wrong way", bad))
    return out


def cross_items(df: DataFrame) -> list[dict]:
    by = {item_of(c): F.col(f"`{c}`").try_cast("double") for c in df.columns if item_of(c)}
    rules = {"Fe over TIBC": ("error", ("Fe", "TIBC"), lambda a, b: a > b), "SBP not over DBP": ("error", ("SBP", "DBP"), lambda a, b: a <= b), "BMI outside 10 to 60": ("warn", ("BMI",), lambda a: (a < 10) | (a > 60)), "differential not 100 +- 3": ("warn", ("Neutro", "Eosino", "Baso", "Mono", "Lympho"), lambda *x: F.abs(sum(x[1:], x[0]) - 100) > 3)}
    rules = {k: v for k, v in rules.items() if all(i in by for i in v[1])}
    if not rules:
        return []
    r = df.agg(*[F.count_if(f(*[by[i] for i in items])) for _, items, f in rules.values()]).first()
    return [finding("cross items", v[0], k, n) for (k, v), n in zip(rules.items(), r) if n]


def survival_dates(df: DataFrame, start: str, event: str, censor: str) -> list[dict]:
    s, e, c = (F.col(x) for x in (start, event, censor))
    end = F.coalesce(e, c)
    tests = {"both an event and a censor date": ("error", e.isNotNull() & c.isNotNull()), "neither date": ("error", end.isNull()), "no start": ("error", s.isNull()), "end before start": ("error", end < s), "zero days": ("warn", end == s), "over 60 years": ("warn", F.datediff(end, s) > 60 * 365.25)}
    r = df.agg(*[F.count_if(t) for _, t in tests.values()], F.count(e)).first()
    out = [finding("survival dates", sev, k, n) for (k, (sev, _)), n in zip(tests.items(), r) if n]
    return out + ([finding("survival dates", "error" if not r[-1] else "warn", f"{r[-1]} events", r[-1])] if r[-1] < 10 else [])


def method_step(df: DataFrame, day: str, value: str, change: str) -> list[dict]:
    """A step of a measurement at a dated change of method: at least 20 values each side, ratio of medians off by 15 %, p < .001."""
    rows = df.filter(F.col(day).isNotNull() & F.col(value).isNotNull()).withColumn("__side", (F.col(day) >= F.lit(change).cast("date")).cast("int"))
    m = {r["__side"]: (r.n, r.q[0]) for r in quantiles(rows, value, [0.5], ["__side"], few=True).collect()}
    if len(m) < 2 or min(m[0][0], m[1][0]) < 20 or not m[0][1]:
        return [finding("method change", "info", f"{value}: too few values around {change}")]
    # ranks are asked for where the medians differ
    ratio = m[1][1] / m[0][1]
    if abs(ratio - 1) > 0.15 and mann_whitney(rows, value, "__side", 0, 1)["p"] < 0.001:
        return [finding("method change", "error", f"{value}: medians change by {ratio:.2f} at {change}")]
    return [finding("method change", "info", f"{value}: no step at {change}")]


def id_candidates(df: DataFrame, profile: list | None = None) -> list[dict]:
    """Columns that could name rows where no id is given: whole numbers or text, at least 20 values, all different, no dictionary item.

    profile: the rows of column_profile(df), where they are known.
    """
    kinds = dict(df.dtypes)
    able = [c for c in df.columns if kinds[c] in ("string", "int", "bigint", "smallint", "tinyint") and not item_of(c)]
    if not able:
        return []
    rows = column_profile(df, able).collect() if profile is None else [r for r in profile if r["column"] in able]
    found = [r["column"] for r in rows if r["n_distinct"] >= 20 and (r["n_distinct"] == r["n"] - r["n_null"])]
    return [finding("id candidates", "warn", f"{c} is different in every row") for c in sorted(found)]


def date_checks(df: DataFrame, columns: list[str], as_of: str) -> list[dict]:
    """Ambiguous order, cells that are no date, dates after as_of and before 1900."""
    out = []
    read = read_dates(df, columns) if columns else []
    limits = [x for d in read for x in (F.count_if(d.expr > F.lit(as_of).cast("date")), F.count_if(d.expr < F.lit("1900-01-01").cast("date")))]
    late = df.agg(*limits).first() if limits else []
    for i, d in enumerate(read):
        if d.order.startswith("ambiguous"):
            out.append(finding("dates", "error", f"{d.column}: the order of day and month is {d.order}"))
        elif d.n_failed:
            out.append(finding("dates", "warn", f"{d.column}: {d.n_failed} cells are no date", d.n_failed))
        if late[2 * i]:
            out.append(finding("dates", "error", f"{d.column}: {late[2 * i]} dates are after {as_of}", late[2 * i]))
        if late[2 * i + 1]:
            out.append(finding("dates", "warn", f"{d.column}: {late[2 * i + 1]} dates are before 1900", late[2 * i + 1]))
    return out


def timings(df: DataFrame) -> list[dict]:
    """Columns that should say before or after the session and don't, and items with one side only."""
    t = Timings.infer(df.columns)
    return [finding("timing", "warn", f"{c} does not say its timing") for c in t.unknown()] + [finding("timing", "info", f"{k} has one side of the session only") for k in t.one_sided()]


def audit(df: DataFrame, entity: str | None = None, y: str | None = None, by: str | None = None, days: list[str] = [], survival: tuple[str, str, str] | None = None, changes: dict[str, tuple[str, str]] = {}, as_of: str | None = None) -> list[dict]:  # noqa: B006
    """All checks that apply, worst first.

    days are columns of dates, held against as_of; survival names start, event and censor date; changes are measurements with
    (column of days, date of the change).
    """
    numbers = [c for c, t in df.dtypes if t in ("int", "bigint", "double", "float") and c not in (entity, y)]
    profile = column_profile(df).collect()
    out = duplicates(df, entity) + missing(df, profile) + collinear(df, numbers) + pre_post(df) + cross_items(df)
    out += timings(df) + ([] if entity else id_candidates(df, profile))
    if days and as_of:
        out += date_checks(df, days, as_of)
    if survival:
        out += survival_dates(df, *survival)
    for value, (day, change) in changes.items():
        out += method_step(df, day, value, change)
    if y:
        out += outcome(df, y) + (leakage(df, numbers, y) if dict(df.dtypes)[y] != "string" else [])
    if by:
        out += groups(df, by)
    words = [c for c, t in df.dtypes if t == "string" and c != entity]
    if words:
        out += [finding("spelling", "warn", f"{r['column']}: {r['variants']} spellings of {r['example']}", r["variants"]) for r in spelling_variants(df, words).collect()]
    return sorted(out, key=lambda f: (SEVERITY[f["severity"]], f["check"]))
