"""One-pass profiles of all columns, limits for outliers, missing data: aggregates that the rest of the engine decides from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortloom.operators.places import cumulated, quantiles
from cohortloom.session import sized_join


def long_form(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) rows, so that one job profiles all columns."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, n, n_null, n_distinct, unique_ratio, top_share; exact, by counting values once for all columns."""
    columns = columns or df.columns
    values = long_form(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    out = values.groupBy("column").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_null"), F.count("value").alias("n_distinct"), F.max(F.when(F.col("value").isNotNull(), F.col("n"))).alias("top"))
    filled = F.col("n") - F.col("n_null")
    return out.select("column", "n", "n_null", "n_distinct", F.when(filled > 0, F.col("n_distinct") / filled).otherwise(0.0).alias("unique_ratio"), F.when(filled > 0, F.col("top") / filled).otherwise(1.0).alias("top_share"))


def missing_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, ordinal, n_missing, rate; most missing first, ties in column order."""
    r = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(i).alias("ordinal"), F.count_if(F.col(f"`{c}`").isNull()).alias("n_missing")) for i, c in enumerate(columns)])
    rows = df.agg(r.alias("x"), F.count(F.lit(1)).alias("n")).select(F.explode("x").alias("x"), "n")
    return rows.select("x.column", "x.ordinal", "x.n_missing", F.try_divide("x.n_missing", "n").alias("rate")).orderBy(F.desc("n_missing"), "ordinal")


def missing_distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """n_missing (columns null in a row), rows."""
    total = sum((F.col(f"`{c}`").isNull().cast("int") for c in columns), F.lit(0))
    return df.groupBy(total.alias("n_missing")).agg(F.count(F.lit(1)).alias("rows"))


def missing_patterns(df: DataFrame, columns: list[str], top: int = 20) -> DataFrame:
    """pattern (1 = missing, in column order), rows; the top most frequent."""
    bits = F.concat(*[F.col(f"`{c}`").isNull().cast("int").cast("string") for c in columns])
    return df.groupBy(bits.alias("pattern")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "pattern").limit(top)


def missing_by_group(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """group, and the rate of nulls of each column in it."""
    return df.groupBy(group).agg(*[F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(c) for c in columns])


def _limited(q: Column, low: Column, high: Column, spread: Column, n: Column) -> list[Column]:
    ok = (n >= 4) & (spread > 0)
    inf = F.lit(float("inf"))
    return [F.when(ok, low).otherwise(-inf).alias("low"), F.when(ok, high).otherwise(inf).alias("high")]


def iqr_limits(df: DataFrame, column: str, by: list[str] = [], fold: float = 1.5) -> DataFrame:  # noqa: B006
    """by..., low, high: quartiles -+ fold * IQR; infinite for fewer than 4 values or no spread."""
    g = quantiles(df, F.col(column).cast("double"), [0.25, 0.75], by)
    spread = F.col("q")[1] - F.col("q")[0]
    return g.select(*by, *_limited(F.col("q"), F.col("q")[0] - spread * fold, F.col("q")[1] + spread * fold, spread, F.col("n")))


def quantile_limits(df: DataFrame, column: str, by: list[str] = [], low: float = 0.01, high: float = 0.99) -> DataFrame:  # noqa: B006
    g = quantiles(df, F.col(column).cast("double"), [low, high], by)
    return g.select(*by, *_limited(F.col("q"), F.col("q")[0], F.col("q")[1], F.lit(1.0), F.col("n")))


def mad_limits(df: DataFrame, column: str, by: list[str] = [], z: float = 3.0) -> DataFrame:  # noqa: B006
    """by..., low, high: median -+ z * 1.4826 * MAD; the medians are joined back to the rows for the second pass."""
    rows = df.select(*by, F.col(column).cast("double").alias("__x")).filter("__x IS NOT NULL")
    m = quantiles(rows, "__x", [0.5], by).select(*by, F.col("q")[0].alias("__m"), F.col("n").alias("__n"))
    far = beside(rows, m, by).withColumn("__far", F.abs(F.col("__x") - F.col("__m")))
    g = quantiles(far, "__far", [0.5], by).select(*by, F.col("q")[0].alias("__d"))
    g = beside(g, m, by)
    s = F.col("__d") * 1.4826 * z
    return g.select(*by, *_limited(F.col("__d"), F.col("__m") - s, F.col("__m") + s, F.col("__d"), F.col("__n")))


def beside(df: DataFrame, told: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """df with the columns of the one row of its group; told is counted before it is broadcast.  Without groups it is one row."""
    return sized_join(df, told, by, how) if by else df.join(F.broadcast(told), F.lit(True), how)


def flag_outliers(df: DataFrame, column: str, limits: DataFrame, by: list[str] = [], action: str = "flag") -> DataFrame:  # noqa: B006
    """flag adds <column>__outlier; nan sets NULL; winsorize clips to the limits of the row's group; drop removes the rows.

    Rows of a group without limits stay as they are.
    """
    told = limits.select(*by, F.col("low").alias("__low"), F.col("high").alias("__high"))
    out = beside(df, told, by, "left")
    x = F.col(f"`{column}`")
    odd = F.coalesce((x < F.col("__low")) | (x > F.col("__high")), F.lit(False))
    if action == "flag":
        out = out.withColumn(f"{column}__outlier", odd.cast("int"))
    elif action == "nan":
        out = out.withColumn(column, F.when(~odd, x))
    elif action == "winsorize":
        out = out.withColumn(column, F.when(x.isNotNull(), F.least(F.greatest(x, F.coalesce("__low", x)), F.coalesce("__high", x))))
    elif action == "drop":
        out = out.filter(~odd)
    else:
        raise ValueError(f"no action {action!r}")
    return out.drop("__low", "__high")


def detect(df: DataFrame, columns: list[str], method: str = "iqr", by: list[str] = [], **options) -> DataFrame:  # noqa: B006
    """df with a flag for each column, and n_outliers, how many of a row's values are out; limits by iqr, mad or quantile."""
    make = {"iqr": iqr_limits, "mad": mad_limits, "quantile": quantile_limits}[method]
    out = df
    for c in columns:
        out = flag_outliers(out, c, make(df, c, by, **options), by)
    return out.withColumn("n_outliers", sum((F.col(f"`{c}__outlier`") for c in columns), F.lit(0)))


def robust_z(df: DataFrame, column: str) -> DataFrame:
    """df with robust_z: by the MAD, by the mean absolute deviation where that is 0; NULL if both are or n < 4."""
    found = quantiles(df, F.col(column).cast("double"), [0.5]).first()
    if found is None or found.n < 4:
        return df.withColumn("robust_z", F.lit(None).cast("double"))
    m = found.q[0]
    d = F.abs(F.col(column).cast("double") - F.lit(m))
    mad, mean = quantiles(df, d, [0.5]).first().q[0], df.agg(F.avg(d)).first()[0]
    scale = 1.4826 * mad if mad > 0 else 1.2533 * mean
    return df.withColumn("robust_z", (F.col(column) - F.lit(m)) / F.lit(scale) if scale > 0 else F.lit(None).cast("double"))


def entry_suspects(df: DataFrame, column: str, row: str, z: float = 10.0, ratio: float = 3.0, most: int | None = None) -> DataFrame:
    """side, rank, row, value, z, next_value of values far out beyond a gap: the largest k with z_k >= z and z_k / z_(k+1) >= ratio.

    k is at most max(1, min(5, 1 % of the rows)); only the ends of each side are ranked, by top-k selection.
    """
    import math

    scored = robust_z(df.filter(F.col(column).isNotNull()), column).select(F.col(row).alias("row"), F.col(column).cast("double").alias("value"), F.col("robust_z").alias("s"))
    k = max(1, min(5, most or math.ceil(0.01 * df.count())))
    out = None
    for side, sign in (("high", 1), ("low", -1)):
        top = scored.withColumn("z", F.col("s") * sign).filter("z IS NOT NULL").orderBy(F.desc("z"), "row").limit(k + 1)
        w = W.orderBy(F.desc("z"), "row")
        top = top.withColumns({"rank": F.row_number().over(w), "next_z": F.lead("z").over(w), "next_value": F.lead("value").over(w)})
        hit = (F.col("rank") <= k) & (F.col("z") >= z) & (F.col("z") / F.greatest(F.col("next_z"), F.lit(1.0)) >= ratio)
        top = top.withColumn("cut", F.max(F.when(hit, F.col("rank"))).over(W.partitionBy(F.lit(1)))).filter("rank <= cut")
        top = top.select(F.lit(side).alias("side"), "rank", "row", "value", "z", "next_value")
        out = top if out is None else out.unionByName(top)
    return out


def average_ranks(df: DataFrame, column: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """by..., value, ties, rank: average ranks on the table of distinct values, summed range by range."""
    ranked = cumulated(df, F.col(column).cast("double"), by)
    return ranked.select(*by, "value", "ties", (F.col("upto") - (F.col("ties") - 1) / 2).alias("rank"))
