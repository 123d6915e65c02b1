"""Numbers written by people: censored values, missing codes, mixed units, impossible values.  All pure Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# characters whose compatibility form is one other character (full-width ASCII, half-width kana, circled digits ...), by rule
_ONE = [(chr(c), n) for c in range(0x80, 0xFFFF) if not 0xD800 <= c < 0xE000 and not 0x2E80 <= c < 0x3000 and not 0xF900 <= c < 0xFB00 and len(n := unicodedata.normalize("NFKC", chr(c))) == 1 and n != chr(c)]
WIDE = "".join(a for a, _ in _ONE) + "≦≧"
NARROW = "".join(b for _, b in _ONE) + "≤≥"
# kana that take a voice mark, with what comes of both; the marks are what their half-width forms become
_VOICED = [(chr(c) + m, n) for m in "\u3099\u309a" for c in range(0x30A6, 0x30FE) if len(n := unicodedata.normalize("NFKC", chr(c) + m)) == 1]
NUMBER = r"([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def no_nan(x: Column) -> Column:
    """NULL is the only missing value: NaN becomes NULL."""
    return F.when(~F.isnan(x), x)


def narrow(x: Column) -> Column:
    """The compatibility form of each character, and kana joined with their voice marks; all on the JVM.

    Characters that fall apart into several (such as squared units) stay as they are.
    """
    s = F.translate(x, WIDE, NARROW)
    joined = s
    for pair, one in _VOICED:
        joined = F.replace(joined, F.lit(pair), F.lit(one))
    # a cell of one byte a character has nothing to narrow
    return F.when(F.octet_length(x) == F.length(x), x).otherwise(F.when(s.rlike("[\u3099\u309a]"), joined).otherwise(s))


def let(x: Column, f) -> Column:
    """f(x) with x computed once."""
    return F.transform(F.array(x), f)[0]


def groups(x: Column, pattern: str, n: int) -> Column:
    """Array of the n groups of a pattern that matches the whole cell, found by one regular expression; NULL without a match."""
    marked = F.regexp_replace(x, pattern, "".join(f"\u0001${k}" for k in range(1, n + 1)))
    return F.when(marked.startswith("\u0001"), F.split(marked, "\u0001"))


def folded(x: Column) -> Column:
    """The form in which names and codes are compared: narrow, lower case, without spaces."""
    return F.lower(F.regexp_replace(narrow(x.cast("string")), r"\s+", ""))


def number(x: Column) -> Column:
    """A string as double; NULL where it isn't one."""
    return no_nan(F.expr("NULL").cast("double") if x is None else x.try_cast("double"))


def censored(x: Column, policy: str = "half") -> Column:
    """struct(value, low, high) of a written number: '<0.1' is low, '>500' is high; policy half, lod or null for low ones."""
    if policy not in ("half", "lod", "null"):
        raise ValueError(f"policy {policy!r}")
    s = x.cast("string")
    # most cells are a number and nothing else, which needs no groups
    bare = F.struct(s.try_cast("double").alias("value"), F.lit(0).alias("low"), F.lit(0).alias("high"))
    return F.when(plain(s), bare).otherwise(let(groups(F.trim(F.replace(narrow(s), F.lit(","), F.lit(""))), _WRITTEN, 3), lambda g: let(_measured(g), lambda m: _by_policy(m, policy))))


NUMBERS = ("tinyint", "smallint", "int", "bigint", "double")


def plain(s: Column) -> Column:
    """Is a text a decimal number and nothing else?  False for NULL."""
    return F.coalesce(s.rlike(r"^[+-]?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?$"), F.lit(False))


def measured(x: Column, kind: str, policy: str = "half") -> Column:
    """censored(x) of a column of a known type: numbers aren't written out to be read again; NaN and infinities are NULL."""
    if kind not in NUMBERS:
        return censored(x, policy)
    x = x.cast("double")
    return F.struct(F.when(F.abs(x) < F.lit(float("inf")), x).alias("value"), F.lit(0).alias("low"), F.lit(0).alias("high"))


_WRITTEN = rf"^(<|>|≤|≥|以下|以上|未満)?\s*{NUMBER}\s*(.*)$"


UNIT_LENGTH = 12  # characters that may follow a number before the cell counts as text


def numberlike(x: Column) -> Column:
    """Does the cell hold a number, with no more than a unit behind it?"""
    return let(groups(F.trim(F.replace(narrow(x.cast("string")), F.lit(","), F.lit(""))), _WRITTEN, 3), lambda g: F.coalesce(_measured(g)["value"].isNotNull() & (F.length(g[3]) <= UNIT_LENGTH), F.lit(False)))


def _measured(g: Column) -> Column:
    """struct(value, mark) of the groups of a written number; the mark stands before or after it."""
    value = F.when(~g[3].rlike(r"^\.|\d"), no_nan(F.when(g[2] != "", g[2]).try_cast("double")))
    return F.struct(value.alias("value"), F.when(g[1] != "", g[1]).otherwise(F.regexp_extract(g[3], "(以下|以上|未満)", 1)).alias("mark"))


def _by_policy(m: Column, policy: str) -> Column:
    value, low, high = m["value"], m["mark"].isin("<", "未満", "≤", "以下"), m["mark"].isin(">", "以上", "≥")
    kept = {"half": value / 2, "lod": value, "null": F.lit(None).cast("double")}[policy]
    known = value.isNotNull()
    return F.struct(F.when(low, kept).otherwise(value).alias("value"), F.coalesce((low & known).cast("int"), F.lit(0)).alias("low"), F.coalesce((high & known).cast("int"), F.lit(0)).alias("high"))


def rescaled(x: Column, low: float | None, high: float | None, factors: list[float]) -> Column:
    """Values outside [low, high] times the first factor, by distance from one, that brings them inside."""
    import math

    inside = between(x, low, high)
    out = F.when(x.isNull() | inside, x)
    for f in sorted((f for f in factors if f), key=lambda f: abs(math.log10(abs(f)))):
        out = out.when(between(x * F.lit(float(f)), low, high), x * F.lit(float(f)))
    return out.otherwise(x)


def between(x: Column, low: float | None, high: float | None, low_closed: bool = True, high_closed: bool = True) -> Column:
    """Three-valued membership of an interval with optional, open or closed ends."""
    tests = []
    if low is not None:
        tests.append(x >= F.lit(float(low)) if low_closed else x > F.lit(float(low)))
    if high is not None:
        tests.append(x <= F.lit(float(high)) if high_closed else x < F.lit(float(high)))
    out = F.when(x.isNotNull(), F.lit(True))
    for t in tests:
        out = out & t
    return out


def plausible(x: Column, low: float | None, high: float | None) -> Column:
    """The value if it is possible, NULL if not: an input error is never clipped."""
    return F.when(between(x, low, high), x)


def blank(x: Column) -> Column:
    """Null, or a string of spaces, full-width ones too."""
    return x.isNull() | (F.trim(F.translate(x.cast("string"), "　\t\r\n", "    ")) == "")


def interval(spec) -> tuple[float | None, float | None]:
    """[low, high], (low, high) or a dict with low/lower and high/upper; one side may be open."""
    low, high = (spec.get("low", spec.get("lower")), spec.get("high", spec.get("upper"))) if isinstance(spec, dict) else spec
    for v in (low, high):
        if isinstance(v, bool) or not (v is None or isinstance(v, (int, float))):
            raise ValueError(f"not a range: {spec!r}")
    low, high = (None if v is None or v != v else float(v) for v in (low, high))
    if (low is None and high is None) or (low is not None and high is not None and low >= high):
        raise ValueError(f"not a range: {spec!r}")
    return low, high


def binary(x: Column, ones: list[str], zeros: list[str]) -> Column:
    """1 and 0 by spelling, NULL for anything else."""
    s = folded(x)
    return F.when(s.isin([v.lower() for v in ones]), 1).when(s.isin([v.lower() for v in zeros]), 0)


def ordinal(x: Column, levels: list[str]) -> Column:
    """The place of a level in its order, NULL for an unknown one."""
    s = F.trim(x.cast("string"))
    out = None
    for k, level in enumerate(levels):
        out = F.when(s == str(level), k) if out is None else out.when(s == str(level), k)
    return out
