"""The data behind figures, as DataFrames: no plotting library is needed or used."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.operators.places import quantiles


def histogram(df: DataFrame, column: str, bins: int = 30, by: str | None = None) -> DataFrame:
    """g, bin (0-based), low, high, n; bins of equal width over the range of all rows, the last one closed."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    g = F.col(by).cast("string") if by else F.lit("all")
    if lo is None:
        return df.limit(0).select(g.alias("g"), F.lit(0).cast("long").alias("bin"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high"), F.lit(0).cast("long").alias("n"))
    width = (float(hi) - float(lo)) / bins or 1.0
    b = F.least(F.floor((F.col(column) - float(lo)) / width), F.lit(bins - 1)).cast("long")
    rows = df.filter(F.col(column).isNotNull()).groupBy(g.alias("g"), b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("g", "bin", (F.col("bin") * width + float(lo)).alias("low"), ((F.col("bin") + 1) * width + float(lo)).alias("high"), "n")


def level_counts(df: DataFrame, column: str, top: int = 12) -> DataFrame:
    """level, n: the most frequent levels, ties by name."""
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("level")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "level").limit(top)


def fold_levels(df: DataFrame, column: str, cap: int, other: str = "その他") -> DataFrame:
    """df with all but the cap - 1 most frequent levels of a column as one."""
    if df.select(column).distinct().filter(F.col(column).isNotNull()).limit(cap + 1).count() <= cap:
        return df
    kept = [r["level"] for r in level_counts(df, column, cap - 1).collect()]
    return df.withColumn(column, F.when(F.col(column).isNotNull(), F.when(F.col(column).cast("string").isin(kept), F.col(column).cast("string")).otherwise(other)))


ROWS_FOR_BINS = 36


def running_median(df: DataFrame, x: str, y: str, bins: int = 12, least: int = 3) -> DataFrame:
    """bin, x, y medians and n inside quantile bins of x, both ends included; bins of fewer than `least` rows are
    left out, and all of them where there are fewer than ROWS_FOR_BINS rows."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    # edges and bins of x need the counts of its values alone
    values = rows.groupBy(F.col(x).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("__n"))
    found = quantiles(values, "x", [k / bins for k in range(bins + 1)], weight="__n").first()
    edges = found.q
    if found.n < ROWS_FOR_BINS:
        return rows.limit(0).select(F.lit(0).alias("bin"), F.col(x).alias("x"), F.col(y).alias("y"), F.lit(0).alias("n"))
    # edges ascend, so the bins with a value follow each other
    first = sum((F.col("x") > b).cast("int") for b in edges[1:])
    last = sum((F.col("x") >= a).cast("int") for a in edges[:-1]) - 1
    inside = lambda told: told.withColumn("bin", F.explode(F.when(first <= last, F.sequence(first, last))))
    mx = quantiles(inside(values), "x", [0.5], ["bin"], "__n", few=True).select("bin", F.col("q")[0].alias("x"), "n")
    told = inside(rows.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))
    my = quantiles(told, "y", [0.5], ["bin"], few=True).select("bin", F.col("q")[0].alias("y"))
    return mx.join(my, "bin").select("bin", "x", "y", "n").filter(F.col("n") >= least)


def nullity_correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, n, r of the null masks of columns."""
    from cohortloom.operators.compare import pearson

    return pearson(df.select(*[F.col(f"`{c}`").isNull().cast("int").alias(c) for c in columns]), columns)


def display_decimals(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """0 for whole numbers, else by the smallest non-zero size, from 2 to 4."""
    import math

    r = df.agg(*[v for c in columns for v in (F.count_if(F.col(c) != F.floor(c)), F.min(F.when(F.col(c) != 0, F.abs(c))))]).first()
    return {c: 0 if not r[2 * i] else min(4, max(2, math.ceil(-math.log10(r[2 * i + 1])))) for i, c in enumerate(columns)}


def smd_forest(df: DataFrame, columns: list[str], threshold: float = 0.1) -> DataFrame:
    """column, smd, over: standardised differences of train and test, largest first."""
    from cohortloom.operators.prepare import balance

    return balance(df, columns).withColumn("over", F.abs("smd") >= threshold).orderBy(F.desc(F.abs("smd")), "column")


def outcome_relations(df: DataFrame, y: str, column: str, classes: int = 3, bins: int = 25) -> DataFrame:
    """What shows a column against the outcome: histograms by class (g, bin, low, high, n), or running medians (bin, x, y, n)
    of an outcome of more than `classes` values."""
    few = df.select(y).filter(F.col(y).isNotNull()).distinct().limit(classes + 1).count() <= classes
    return histogram(df.filter(F.col(y).isNotNull()), column, bins, y) if few else running_median(df, column, y)


def achievement_bars(df: DataFrame, by: str | None = None) -> DataFrame:
    """item, level, n, rate of dictionary targets, overall and by group, without the counts on the limits."""
    from cohortloom.operators.compare import achievement

    return achievement(df, by).select("item", "level", "n", "rate")


# fixed values: colours that differ for most eyes, in order of use
COLOURS = ["#0072B2", "#E69F00", "#009E73", "#CC79A7", "#56B4E9", "#D55E00", "#F0E442", "#999999"]


def colours(levels: list[str]) -> dict[str, str]:
    """A colour for each level, the same in all figures; more than eight levels are refused rather than given one twice."""
    if len(levels) > len(COLOURS):
        raise ValueError(f"over {len(COLOURS)} levels: fold the rarer ones")
    return dict(zip(levels, COLOURS))
