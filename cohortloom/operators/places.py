"""Exact ranks and quantiles in which no step sees all values.

Equal values are counted first.  The distinct values are then cut into ranges of values (bounds from an approximate quantile
sketch of fixed size; they needn't be exact), counts are summed inside each range, and the ranges, few in each group, are summed
up before them.  So every window covers one range of one group, and a place is known exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cumulated(df: DataFrame, column: str | Column, by: list[str] = [], weight: str | None = None, also: dict[str, Column] = {}, near=None) -> DataFrame:  # noqa: B006
    """by..., value, ties (rows with it), upto (rows with a value up to it), n (rows of the group with a value).

    A null group is a group; rows without a value are left out.  A row stands for `weight` rows where that column is named;
    also are counts of some of the rows of a value, which stand beside it.
    near gives places (from 0) from a group's n: only ranges of values that hold one of them are ordered and returned.
    """
    rows, sums, g = _ranges(df, column, by, weight, also)
    if near:
        sums = sums.filter(_holding(near(F.col("n"))))
    return _placed(rows, sums, by, g, list(also))


def _ranges(df: DataFrame, column: str | Column, by: list[str], weight: str | None = None, also: dict[str, Column] = {}) -> tuple[DataFrame, DataFrame, list[str]]:  # noqa: B006
    """(distinct values with their range, ranges of each group with the rows before them, names of the group columns)."""
    parts = min(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4), 400)
    x = F.col(column) if isinstance(column, str) else column
    g = [f"__g{i}" for i in range(len(by))]
    counts = df.withColumns({**{a: F.col(c) for a, c in zip(g, by)}, "__value": x, "__weight": F.col(weight) if weight else F.lit(1)}).filter("__value IS NOT NULL")
    counts = counts.groupBy(*g, F.col("__value").alias("value")).agg((F.sum("__weight") if weight else F.count(F.lit(1))).alias("ties"), *[f.alias(a) for a, f in also.items()])
    # the bounds ask for all columns of the counts, so that the plan has one exchange of counts and df is read once
    every = F.lit(True)
    for c in ("ties", *also):
        every = every & (F.col(c) >= 0)
    bounds = counts.filter(every).agg(F.percentile_approx("value", [k / parts for k in range(1, parts)], 1000).alias("__bounds"))
    rows = counts.join(F.broadcast(bounds), F.lit(True))  # one row
    rows = rows.withColumn("__part", _below("__bounds", F.col("value"), parts - 1)).drop("__bounds")
    sums = rows.groupBy(*g, "__part").agg(F.sum("ties").alias("__sum"))
    group = W.partitionBy(*g) if g else W.partitionBy(F.lit(1))  # at most `parts` rows in each
    before = F.sum("__sum").over(group.orderBy("__part")) - F.col("__sum")
    return rows, sums.select(*[F.col(c).alias(f"{c}r") for c in g], F.col("__part").alias("__partr"), "__sum", before.alias("__before"), F.sum("__sum").over(group).alias("n")), g


def _holding(places: list[Column]) -> Column:
    held = F.lit(False)
    for k in places:
        held = held | ((F.col("__before") <= k) & (F.col("__before") + F.col("__sum") > k))
    return held


def _below(bounds: str, x: Column, most: int) -> Column:
    """How many of at most `most` ascending bounds are under x, by halving."""
    steps = [1 << k for k in reversed(range(most.bit_length()))]
    found = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) < x, at + step).otherwise(at))
    return F.coalesce(found, F.lit(0))


def _placed(rows: DataFrame, sums: DataFrame, by: list[str], g: list[str], also: list[str]) -> DataFrame:
    same = rows["__part"] == sums["__partr"]
    for c in g:
        same = same & rows[c].eqNullSafe(sums[f"{c}r"])
    inside = W.partitionBy(*g, "__part").orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow)
    out = rows.join(sums, same).withColumn("upto", F.col("__before") + F.sum("ties").over(inside))
    return out.select(*[F.col(f"__g{i}").alias(c) for i, c in enumerate(by)], "value", "ties", "upto", "n", *also)


def neighbours(df: DataFrame, column: str | Column, ps: list[float], by: list[str] = [], weight: str | None = None, few: bool = False) -> DataFrame:  # noqa: B006
    """by..., n, and for each p a struct q<i>(low, high, part): the values beside the place p * (n - 1), and how far it is from the first.

    Only ranges that hold one of these places are ordered; few says that the groups are, so that other ranges go unshuffled.
    """
    rows, sums, g = _ranges(df, column, by, weight)
    sums = sums.filter(_holding([f(F.lit(p) * (F.col("n") - 1)) for p in ps for f in (F.floor, F.ceil)]))
    rows = _placed(rows, F.broadcast(sums) if few or not by else sums, by, g, [])
    aggs = []
    for i, p in enumerate(ps):
        at = F.lit(p) * (F.col("n") - 1)
        lies = lambda k: (F.col("upto") > k) & (F.col("upto") - F.col("ties") <= k)
        low, high = (F.max(F.when(lies(k), F.col("value"))) for k in (F.floor(at), F.ceil(at)))
        aggs.append(F.struct(low.alias("low"), high.alias("high"), F.max(at - F.floor(at)).alias("part")).alias(f"q{i}"))
    return rows.groupBy(*by).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), *aggs)


def between(q: Column) -> Column:
    """The quantile, by linear interpolation between its neighbours."""
    return q["low"] + (q["high"] - q["low"]) * q["part"]


def quantiles(df: DataFrame, column: str | Column, ps: list[float], by: list[str] = [], weight: str | None = None, few: bool = False) -> DataFrame:  # noqa: B006
    """by..., n, q (array): exact quantiles; a group without values has no row, without groups
    n is then 0 and the quantiles are NULL."""
    found = neighbours(df, column, ps, by, weight, few)
    return found.select(*by, "n", F.array(*[between(F.col(f"q{i}")) for i in range(len(ps))]).alias("q"))


def quantiles_of(df: DataFrame, columns: dict[str, Column], ps: list[float]) -> dict[str, tuple[int, list]]:
    """name -> (n, neighbours of each quantile) of several columns from one job; names without values are left out."""
    if not columns:
        return {}
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), x.cast("double").alias("v")) for c, x in columns.items()])).alias("x")).select("x.*")
    return {r.c: (r.n, [r[f"q{i}"] for i in range(len(ps))]) for r in neighbours(long, "v", ps, ["c"], few=True).collect()}


def value_at(q) -> float:
    """The quantile of a collected struct of neighbours."""
    return q.low + (q.high - q.low) * q.part
