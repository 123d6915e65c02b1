"""Dictionary-driven cleaning of whole tables: one profile job decides, one projection cleans; every action is reported."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions import dates, numeric
from cohortloom.operators.places import quantiles_of, value_at
from cohortloom.session import sized_join
from cohortloom.plans.dictionary import ITEMS, MISSING_CODES, TEXT_MISSING, UNIT_FACTORS, folded_name, item_of


@dataclass
class CleanReport:
    actions: list[dict] = field(default_factory=list)
    unmatched: list[str] = field(default_factory=list)


def clean_numeric(df: DataFrame, policy: str = "half", fix_units: bool = True, apply_plausible: bool = True) -> tuple[DataFrame, CleanReport]:
    """Matched columns become doubles: text to number, missing codes, mixed units, impossible values, in that order.

    A code is missing if it is over the possible range, or if it occurs at least 3 times, is at least 999 and lies over the
    99 % point of the other values.  Censored values get flag columns <c>__low and <c>__high where there are any.
    """
    report = CleanReport()
    match = {c: k for c in df.columns if (k := item_of(c))}
    report.unmatched = [c for c in df.columns if c not in match]
    if not match:
        return df, report
    kinds = dict(df.dtypes)
    read = {c: numeric.measured(F.col(f"`{c}`"), kinds[c], policy) for c in match}
    words = {c: F.lit(False) if kinds[c] in numeric.NUMBERS else says_missing(F.col(f"`{c}`")) for c in match}
    held = df.select(*[x.alias(f"s{i}") for i, x in enumerate(read.values())], *[x.alias(f"m{i}") for i, x in enumerate(words.values())])
    aggs = []
    for i, (c, k) in enumerate(match.items()):
        _, low, high, _ = ITEMS[k]
        v = F.col(f"s{i}.value")
        aggs.append(F.count_if(f"m{i}").alias(f"m{i}"))
        aggs += [F.sum(f"s{i}.low").alias(f"lo{i}"), F.sum(f"s{i}.high").alias(f"hi{i}"), F.count_if(~numeric.between(v, low, high)).alias(f"out{i}")]
        for j, code in enumerate(MISSING_CODES):
            aggs.append(F.count_if(v == code).alias(f"c{i}_{j}"))
    r = held.agg(*aggs).first()
    # only a code that occurs often enough inside the possible range is held against the 99 % point of the other values
    asked = {f"{i}_{j}": F.when(F.col(f"s{i}.value") != code, F.col(f"s{i}.value")) for i, k in enumerate(match.values()) for j, code in enumerate(MISSING_CODES) if 999 <= code <= ITEMS[k][2] and r[f"c{i}_{j}"] >= 3}
    most = {c: value_at(q[0]) for c, (_, q) in quantiles_of(held, asked, [0.99]).items()}
    # each step is a projection of its own, so that no step repeats the one before it
    steps: list[dict] = [{f"__s{i}": x for i, x in enumerate(read.values())}, {}, {}, {}]
    for i, (c, k) in enumerate(match.items()):
        _, low, high, _ = ITEMS[k]
        hit = []
        if r[f"m{i}"]:
            report.actions.append({"column": c, "action": "says missing", "value": None, "count": r[f"m{i}"]})
        for j, code in enumerate(MISSING_CODES):
            n, q = r[f"c{i}_{j}"], most.get(f"{i}_{j}")
            if n and (code > high or (code < low and code < 0) or (n >= 3 and code >= 999 and q is not None and q < code)):
                hit.append(code)
                report.actions.append({"column": c, "action": "missing code", "value": code, "count": n})
        v = F.col(f"__s{i}.value")
        steps[1][f"__v{i}"] = F.when(~v.isin(hit), v) if hit else v
        v = F.col(f"__v{i}")
        steps[2][f"__r{i}"] = numeric.rescaled(v, low, high, UNIT_FACTORS[k]) if fix_units and k in UNIT_FACTORS else v
        v = F.col(f"__r{i}")
        steps[3][c] = numeric.plausible(v, low, high) if apply_plausible else v
        if r[f"out{i}"]:
            report.actions.append({"column": c, "action": "outside the possible range", "value": [low, high], "count": r[f"out{i}"]})
        for side, name in (("lo", "low"), ("hi", "high")):
            if r[f"{side}{i}"]:
                steps[3][f"{c}__{name}"] = F.col(f"__s{i}.{name}")
                report.actions.append({"column": c, "action": f"censored {name}", "value": None, "count": r[f"{side}{i}"]})
    for step in steps:
        df = df.withColumns(step)
    return df.drop(*steps[0], *steps[1], *steps[2]), report


def says_missing(x) -> Column:
    """Does a cell say in words that there is no value?  False for NULL."""
    said = F.coalesce(numeric.folded(x).isin([folded_name(t) for t in TEXT_MISSING]), F.lit(False))
    return F.when(numeric.plain(x.cast("string")), F.lit(False)).otherwise(said)


def two_scales(df: DataFrame, column: str, rows: int = 30, decades: float = 0.7) -> dict | None:
    """low, high: the ends of a gap of at least `decades` powers of ten inside the positive values, a sign of mixed units.

    None for fewer than `rows` values or a range under 0.8 decades; the widest gap of a histogram of six bins a decade.
    """
    x = F.log10(F.when(F.col(f"`{column}`").try_cast("double") > 0, F.col(f"`{column}`").try_cast("double")))
    n, lo, hi = df.agg(F.count(x), F.min(x), F.max(x)).first()
    if n < rows or hi - lo < 0.8:
        return None
    bins = max(8, int(6 * (hi - lo)))
    width = (hi - lo) / bins
    full = sorted(r.b for r in df.filter(x.isNotNull()).select(F.least(F.floor((x - lo) / width), F.lit(bins - 1)).alias("b")).distinct().collect())
    gaps = [(b - a - 1, a) for a, b in zip(full, full[1:])]
    size, a = max(gaps, default=(0, 0))
    return {"low": 10 ** (lo + (a + 1) * width), "high": 10 ** (lo + (a + 1 + size) * width)} if size * width >= decades else None


def apply_ranges(df: DataFrame, ranges: dict, row: str | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Human ranges, ends included: (cleaned, violations (column, row as text, value), problems as messages)."""
    problems, out, bad = [], {}, None
    for c, spec in ranges.items():
        try:
            low, high = numeric.interval(spec)
        except (ValueError, TypeError, AttributeError) as e:
            problems.append(f"{c}: {e}")
            continue
        if c not in df.columns:
            problems.append(f"{c}: no such column")
            continue
        x = F.col(f"`{c}`").try_cast("double")
        wrong = F.coalesce(~numeric.between(x, low, high), F.lit(False))
        out[c] = F.when(~wrong, F.col(f"`{c}`"))
        rows = df.filter(wrong).select(F.lit(c).alias("column"), (F.col(f"`{row}`").cast("string") if row else F.lit(None).cast("string")).alias("row"), x.alias("value"))
        bad = rows if bad is None else bad.unionByName(rows)
    if bad is None:
        bad = df.sparkSession.createDataFrame([], "column string, row string, value double")
    return df.withColumns(out), bad, problems


def drop_blank_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with something in them, the blank ones)."""
    empty = F.lit(True)
    for c in df.columns:
        empty = empty & numeric.blank(F.col(f"`{c}`"))
    return df.filter(~empty), df.filter(empty)


def normalize_times(df: DataFrame, start: str, end: str) -> DataFrame:
    """Clock columns as HH:MM; an end before the start goes past 24; unreadable cells stay as they are."""
    a, b = dates.to_hours(F.col(start)), dates.to_hours(F.col(end))
    late = F.when((b < a) & (b < 24), b + 24).otherwise(b)
    return df.withColumns({start: F.coalesce(dates.hhmm(a), F.col(start).cast("string")), end: F.coalesce(dates.hhmm(late), F.col(end).cast("string"))})


def mark_exclusions(df: DataFrame, reasons: dict) -> DataFrame:
    """df with exclude (0/1) and exclude_reason, the named conditions that hold joined by a slash; no row is removed."""
    why = F.concat_ws("／", F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in reasons.items()])))
    return df.withColumns({"exclude": (why != "").cast("int"), "exclude_reason": why})


def excluded_cases(df: DataFrame, marks: list[str]) -> DataFrame:
    """The marked rows, with the columns that name and date them and the reason."""
    return df.filter("exclude = 1").select(*marks, "exclude_reason")


def reasons_by_id(df: DataFrame, told: DataFrame, entity: str) -> DataFrame:
    """df with the reasons that a list of (entity, reason) gives for its row's entity, sorted and joined; NULL where it gives none."""
    one = told.groupBy(F.col(entity).alias("__e")).agg(F.concat_ws("／", F.sort_array(F.collect_set("reason"))).alias("reason"))
    return sized_join(df, one.withColumnRenamed("__e", entity), [entity], "left")


def without_missing_outcome(df: DataFrame, y: str) -> tuple[DataFrame, dict]:
    """(rows with an outcome, counts of all, kept and dropped rows)."""
    if y not in df.columns:
        raise ValueError(f"no column {y}")
    n, kept = df.agg(F.count(F.lit(1)), F.count(F.col(f"`{y}`"))).first()
    return df.filter(F.col(f"`{y}`").isNotNull()), {"rows": n, "kept": kept, "dropped": n - kept}


def model_frame(df: DataFrame, y: str, numbers: list[str], binary: dict[str, tuple[list[str], list[str]]] = {}, ordered: dict[str, list[str]] = {}, nominal: list[str] = [], most: int = 50) -> DataFrame:  # noqa: B006
    """Rows with an outcome as numbers: binaries 0/1, ordinals by place, nominal levels as dummies without the first one.

    NULL stays NULL; nothing is split, scaled or filled.  A nominal column of over `most` levels is refused.
    """
    out = [F.col(f"`{c}`").cast("double").alias(c) for c in numbers]
    out += [numeric.binary(F.col(f"`{c}`"), *m).alias(c) for c, m in binary.items()] + [numeric.ordinal(F.col(f"`{c}`"), v).alias(c) for c, v in ordered.items()]
    for c in nominal:
        x = F.col(f"`{c}`").cast("string")
        levels = [r.v for r in df.select(x.alias("v")).filter("v IS NOT NULL").distinct().orderBy("v").limit(most + 1).collect()]
        if len(levels) > most:
            raise ValueError(f"{c} has over {most} levels")
        out += [(x == v).cast("int").alias(f"{c}={v}") for v in levels[1:]]
    return df.filter(F.col(f"`{y}`").isNotNull()).select(F.col(f"`{y}`").alias(y), *out)


def encode_binaries(df: DataFrame, maps: dict[str, tuple[list[str], list[str]]]) -> tuple[DataFrame, list[dict]]:
    """df with binary columns as 0/1 in place, and how many cells of each fit neither side."""
    unread = df.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & numeric.binary(F.col(f"`{c}`"), *m).isNull()) for c, m in maps.items()]).first() if maps else []
    told = [{"column": c, "ones": "/".join(one), "zeros": "/".join(zero), "unread": n} for (c, (one, zero)), n in zip(maps.items(), unread)]
    return df.select(*[numeric.binary(F.col(f"`{c}`"), *maps[c]).alias(c) if c in maps else F.col(f"`{c}`") for c in df.columns]), told


def without_outcome(df: DataFrame, row: str, reasons: dict) -> DataFrame:
    """row, reason: rows that books with an outcome leave out, and why (named conditions, joined)."""
    marked = mark_exclusions(df, reasons)
    return marked.filter("exclude = 1").select(row, F.col("exclude_reason").alias("reason"))


def removal_ledger(rows: list[tuple[str, str, int, str, str, str]]) -> list[dict]:
    """(kind, target, count, action, reason, stage) in order: deleted rows first, then by count."""
    out = [dict(zip(("kind", "target", "count", "action", "reason", "stage"), r)) for r in rows if r[2]]
    return sorted(out, key=lambda r: (not (r["kind"] == "row" and r["action"] == "deleted"), -r["count"], r["target"]))
