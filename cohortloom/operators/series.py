"""Operators over ordered rows of an entity: time-averaged concentrations and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def tac_trapezoid(df: DataFrame, entity: str, time: str, value: str) -> DataFrame:
    """entity, tac, span, points: area under the line through the points over its span.  Negative values are missing.

    Times must increase strictly: an entity with a repeated time gets a NULL and rises `repeated`.
    """
    rows = df.select(F.col(entity), F.col(time).cast("double").alias("t"), F.when(F.col(value) >= 0, F.col(value).cast("double")).alias("c")).filter("t IS NOT NULL AND c IS NOT NULL")
    w = W.partitionBy(entity).orderBy("t", "c")
    rows = rows.withColumns({"dt": F.lead("t").over(w) - F.col("t"), "cc": F.col("c") + F.lead("c").over(w)})
    out = rows.groupBy(entity).agg(F.sum(F.col("cc") / 2 * F.col("dt")).alias("area"), (F.max("t") - F.min("t")).alias("span"), F.count(F.lit(1)).alias("points"), F.count_if(F.col("dt") == 0).alias("repeated"))
    return out.select(entity, F.when((F.col("span") > 0) & (F.col("repeated") == 0), F.col("area") / F.col("span")).alias("tac"), "span", "points", "repeated")


def tac_weighted(df: DataFrame, entity: str, pre: str, post: str, next_pre: str, session: str, gap: str) -> DataFrame:
    """entity, tac: mean of session and gap means, weighted by their hours."""
    td, ti = F.col(session), F.col(gap)
    ok = (F.col(pre) >= 0) & (F.col(post) >= 0) & (F.col(next_pre) >= 0) & (td > 0) & (ti > 0)
    area = (F.col(pre) + F.col(post)) / 2 * td + (F.col(post) + F.col(next_pre)) / 2 * ti
    return df.filter(ok).groupBy(entity).agg((F.sum(area) / F.sum(td + ti)).alias("tac"), F.sum(td + ti).alias("hours"))


def paired(df: DataFrame, group: str, entity: str, value: str, first: str, second: str, order: list[str]) -> DataFrame:
    """entity, a, b: for entities in both groups, the first non-null value of each by `order`."""
    w = W.partitionBy(group, entity).orderBy(*order)
    rows = df.filter(F.col(value).isNotNull() & F.col(group).isin(first, second)).withColumn("__k", F.row_number().over(w)).filter("__k = 1")
    out = rows.groupBy(entity).agg(F.max(F.when(F.col(group) == first, F.col(value))).alias("a"), F.max(F.when(F.col(group) == second, F.col(value))).alias("b"))
    return out.filter("a IS NOT NULL AND b IS NOT NULL")
