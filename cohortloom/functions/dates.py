"""Dates and clock times in many notations.  The order of day and month is decided per column from aggregates, never guessed."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.numeric import groups, let, narrow

# fixed values: first year of each era, and spellings of "no date"
ERAS = {"明治": 1868, "大正": 1912, "昭和": 1926, "平成": 1989, "令和": 2019, "M": 1868, "T": 1912, "S": 1926, "H": 1989, "R": 2019}
NO_DATE = ["", "-", "ー", "―", "‐", ".", "・", "なし", "無", "無し", "未実施", "未測定", "不明", "na", "n/a", "nan", "none", "null", "nat", "#n/a", "#value!", "9999", "99999999", "0", "00000000"]
# three numbers with anything but digits between them; what follows (a clock time) is ignored
TRIPLE = r"^\D*?(\d{1,4})\D+(\d{1,2})\D+(\d{1,4})(?!\d).*$"
EIGHT = r"^(\d{4})(\d{2})(\d{2})$"
ERA = r"^(明治|大正|昭和|平成|令和|[MTSHRmtshr])\s*\.?(元|\d{1,2})\D+(\d{1,2})\D+(\d{1,2}).*$"
YEAR_MONTH = r"^(\d{4})\D+(\d{1,2})\D*$"


def cleaned(x: Column) -> Column:
    return F.trim(F.regexp_replace(narrow(x.cast("string")), "[\\[\\](){}'\"「」]", ""))


def year_month_day(y: Column, m: Column, d: Column) -> Column:
    """A date, NULL if there is no such day; two-digit years up to 69 are 20xx, else 19xx."""
    y = F.when(y < 100, F.when(y <= 69, y + 2000).otherwise(y + 1900)).otherwise(y)
    return F.format_string("%04d-%02d-%02d", y, m, d).try_cast("date")


def _int(x: Column) -> Column:
    return F.when(x != "", x).try_cast("int")


def parts(x: Column) -> Column:
    """struct of what a cell holds: token of no date, era date, serial date, or three numbers.  One expression per notation."""
    return let(cleaned(x), lambda s: let(F.struct(s.alias("s"), groups(s, ERA, 4).alias("era"), F.coalesce(groups(s, EIGHT, 3), groups(s, TRIPLE, 3)).alias("three"), groups(s, YEAR_MONTH, 2).alias("ym")), _parts))


def _parts(g: Column) -> Column:
    s, e, t = g["s"], g["era"], g["three"]
    none = s.isNull() | F.lower(s).isin(NO_DATE)
    base = F.create_map(*[F.lit(v) for kv in ERAS.items() for v in kv])
    era = F.when(e.isNotNull(), year_month_day(F.try_element_at(base, F.upper(e[1])) + F.when(e[2] == "元", 1).otherwise(_int(e[2])) - 1, _int(e[3]), _int(e[4])))
    v = F.when(s.rlike(r"^\d{5}(\.\d+)?$"), s).try_cast("double")
    serial = F.when((v >= 25569) & (v <= 73051), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(v).cast("int")))
    triple = ~none & e.isNull() & t.isNotNull()
    month = F.when(t.isNull() & e.isNull() & g["ym"].isNotNull(), year_month_day(_int(g["ym"][1]), _int(g["ym"][2]), F.lit(1)))
    return F.struct(none.alias("none"), F.when(~none, era).alias("era"), F.when(~none, serial).alias("serial"), F.when(~none, month).alias("month"), *[F.when(triple, _int(t[k])).alias(c) for k, c in enumerate("abc", 1)])


@dataclass
class DateColumn:
    """How one column was read; `expr` gives its dates."""

    column: str
    order: str
    n_total: int
    n_null: int
    n_parsed: int
    n_failed: int
    expr: Column = field(repr=False)

    def failures(self, df: DataFrame, most: int = 50) -> DataFrame:
        """value, n: cells that hold something but no date, most frequent first."""
        x = F.col(f"`{self.column}`")
        return df.filter(self.expr.isNull() & ~parts(x)["none"]).groupBy(x.cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(most)


ORDERS = {"ymd": "abc", "dmy": "cba", "mdy": "cab"}  # places of year, month and day


def read_dates(df: DataFrame, columns: list[str], order: str = "auto", allow_year_month: bool = False) -> list[DateColumn]:
    """Decide the order of each column from one aggregate over all columns, then give the expressions that read them.

    first >= 1000 throughout: ymd; third >= 1000 throughout: dmy if a first number is over 12, mdy if a second one is, else
    ambiguous; three-number cells of an ambiguous column stay NULL.  The same aggregate counts what each order would read.
    """
    p = {c: F.col(f"p{i}") for i, c in enumerate(columns)}
    held = df.select(*[parts(F.col(f"`{c}`")).alias(f"p{i}") for i, c in enumerate(columns)])
    aggs = []
    for i, x in enumerate(p.values()):
        aggs += [F.count(F.lit(1)).alias(f"n{i}"), F.count_if(x["none"]).alias(f"z{i}"), F.count(x["a"]).alias(f"t{i}"), F.bool_and(x["a"] >= 1000).alias(f"ymd{i}"), F.bool_and(x["c"] >= 1000).alias(f"last{i}"), F.bool_or(x["a"] > 12).alias(f"d1{i}"), F.bool_or(x["b"] > 12).alias(f"d2{i}"), F.bool_or(x["a"] >= 1000).alias(f"some{i}")]
        aggs += [F.count(_reader(places, allow_year_month)(x)).alias(f"r{places}{i}") for places in ("", *ORDERS.values())]
    r = held.agg(*aggs).first()
    out = []
    for i, c in enumerate(columns):
        if order != "auto":
            how = order
        elif not r[f"t{i}"]:
            how = "none"
        elif r[f"ymd{i}"]:
            how = "ymd"
        elif r[f"last{i}"]:
            how = "dmy" if r[f"d1{i}"] else "mdy" if r[f"d2{i}"] else "ambiguous_dmy_mdy"
        else:
            how = "ymd" if r[f"some{i}"] else "ambiguous"
        places = ORDERS.get(how, "")
        n, none, read = r[f"n{i}"], r[f"z{i}"], r[f"r{places}{i}"]
        out.append(DateColumn(c, how, n, none, read, n - none - read, let(parts(F.col(f"`{c}`")), _reader(places, allow_year_month))))
    return out


def _reader(order: str, allow_year_month: bool = False):
    """What reads the parts of a cell; order names the three numbers' places, empty for an ambiguous column."""

    def read(p: Column) -> Column:
        triple = year_month_day(*[p[k] for k in order]) if order else F.lit(None).cast("date")
        return F.coalesce(p["era"], triple, p["serial"], *([p["month"]] if allow_year_month else []))

    return read


def to_hours(x: Column) -> Column:
    """A clock time in hours, 0 to under 48: H:MM, H時MM分, fractions of a day and plain hours."""
    return let(F.trim(narrow(x.cast("string"))), lambda s: let(F.struct(groups(s, CLOCK, 2).alias("g"), s.try_cast("double").alias("v")), _hours))


CLOCK = r"^(\d{1,2})\s*(?::|時)\s*(\d{1,2})?\s*分?(?::\d{1,2})?$"


def _hours(p: Column) -> Column:
    h, m, v = _int(p["g"][1]), F.coalesce(_int(p["g"][2]), F.lit(0)), p["v"]
    clock = F.when((h < 48) & (m < 60), h + m / F.lit(60.0))
    return F.coalesce(clock, F.when((v >= 0) & (v < 1), v * 24).when((v >= 1) & (v < 24), v))


def hhmm(hours: Column) -> Column:
    """Hours as HH:MM, over 24 as well."""
    minutes = F.bround(hours * 60).cast("long")
    return F.when(hours.isNotNull(), F.format_string("%02d:%02d", F.floor(minutes / 60).cast("long"), minutes % 60))


def session_hours(start: Column, end: Column, most: float = 12.0) -> Column:
    """Length of a session that may cross midnight; NULL if not in (0, most]."""
    d = F.when(end < start, end - start + 24).otherwise(end - start)
    return F.when((d > 0) & (d <= most), d)


def years_between(start: Column, end: Column) -> Column:
    """Full years of 365.25 days, NULL if negative."""
    d = F.floor(F.datediff(end, start) / F.lit(365.25))
    return F.when(d >= 0, d)
