"""Group comparison: effect sizes, association, tests and tables, from grouped aggregates; only small results reach the driver."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions import dist
from cohortloom.operators.places import cumulated, quantiles
from cohortloom.operators.profile import average_ranks


MOST_CELLS = 10_000  # of a table of counts that comes to the driver


def few(counts: DataFrame, what: str) -> list:
    """The rows of a small table; a larger one is refused."""
    rows = counts.limit(MOST_CELLS + 1).collect()
    if len(rows) > MOST_CELLS:
        raise ValueError(f"{what} has over {MOST_CELLS} levels")
    return rows


def moments(df: DataFrame, column: str, by: str) -> DataFrame:
    """by, n, mean, var (sample)."""
    return df.filter(F.col(column).isNotNull() & F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(column).alias("mean"), F.var_samp(column).alias("var"))


def _two(df, column, by, a, b):
    m = {r[by]: r for r in moments(df.filter(F.col(by).isin(a, b)), column, by).collect()}
    return m.get(a), m.get(b)


def hedges_g(df: DataFrame, column: str, by: str, a, b) -> float | None:
    x, y = _two(df, column, by, a, b)
    if not x or not y or x.n < 2 or y.n < 2:
        return None
    pooled = ((x.n - 1) * x["var"] + (y.n - 1) * y["var"]) / (x.n + y.n - 2)
    return 0.0 if pooled <= 0 else (x["mean"] - y["mean"]) / math.sqrt(pooled) * (1 - 3 / (4 * (x.n + y.n) - 9))


def smd(df: DataFrame, column: str, by: str, a, b) -> float | None:
    x, y = _two(df, column, by, a, b)
    if not x or not y or x["var"] is None or y["var"] is None or (s := (x["var"] + y["var"]) / 2) <= 0:
        return None
    return (x["mean"] - y["mean"]) / math.sqrt(s)


def max_pairwise_smd(df: DataFrame, column: str, by: str) -> dict | None:
    """The pair of groups (in order) whose standardised difference is largest in size, with its sign; one aggregate."""
    m = sorted((r for r in moments(df, column, by).collect() if r["var"] is not None), key=lambda r: str(r[by]))
    pairs = [(x, y, (x["var"] + y["var"]) / 2) for i, x in enumerate(m) for y in m[i + 1 :]]
    found = [{"a": x[by], "b": y[by], "smd": (x["mean"] - y["mean"]) / math.sqrt(v)} for x, y, v in pairs if v > 0]
    return max(found, key=lambda r: abs(r["smd"]), default=None)


def smd_categorical(df: DataFrame, column: str, by: str, a, b) -> float | None:
    """Multi-level standardised difference; the last level in order is left out, nulls count in the denominators."""
    import numpy as np

    rows = few(df.filter(F.col(by).isin(a, b)).groupBy(by, column).count(), column)
    levels = sorted({r[column] for r in rows if r[column] is not None}, key=str)[:-1]
    n = {g: sum(r["count"] for r in rows if r[by] == g) for g in (a, b)}
    if not levels or not all(n.values()):
        return None
    p, q = (np.array([next((r["count"] for r in rows if r[by] == g and r[column] == v), 0) / n[g] for v in levels]) for g in (a, b))
    cov = lambda v: np.diag(v) - np.outer(v, v)
    d = p - q
    return float(math.sqrt(max(d @ np.linalg.pinv((cov(p) + cov(q)) / 2) @ d, 0.0)))


def eta_squared(df: DataFrame, column: str, by: str) -> DataFrame:
    """One row: eta_squared = between / total sum of squares, 0 without spread."""
    m = moments(df, column, by)
    t = df.filter(F.col(by).isNotNull()).agg(F.count(column).alias("all_n"), F.avg(column).alias("all_mean"), F.var_pop(column).alias("all_var"))
    return m.join(F.broadcast(t), F.lit(True)).groupBy("all_n", "all_var").agg(F.sum(F.col("n") * (F.col("mean") - F.col("all_mean")) * (F.col("mean") - F.col("all_mean"))).alias("between")).select(F.coalesce(F.try_divide("between", F.col("all_n") * F.col("all_var")), F.lit(0.0)).alias("eta_squared"))


def rank_sums(df: DataFrame, column: str, by: str) -> DataFrame:
    """by, n, rank_sum over all groups together."""
    rows = df.filter(F.col(column).isNotNull() & F.col(by).isNotNull())
    ranks = average_ranks(rows, column)
    return rows.groupBy(by, F.col(column).cast("double").alias("value")).count().join(ranks.select("value", "rank"), "value").groupBy(by).agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("rank")).alias("rank_sum"))


def tie_term(df: DataFrame, column: str, by: str) -> int:
    r = average_ranks(df.filter(F.col(column).isNotNull() & F.col(by).isNotNull()), column)
    return int(r.agg(F.coalesce(F.sum(F.col("ties").cast("decimal(38,0)") * (F.col("ties") * F.col("ties") - 1)), F.lit(0))).first()[0])


def mann_whitney(df: DataFrame, column: str, by: str, a, b) -> dict | None:
    """u of a, p (normal, tie and continuity corrected), Cliff's delta; one job, which reads df once."""
    rows = df.filter(F.col(by).isin(a, b) & F.col(column).isNotNull())
    t, ties = cumulated(rows, F.col(column).cast("double"), also={"mine": F.count_if(F.col(by) == a)}), F.col("ties")
    rank = F.col("upto") - (ties - 1) / 2
    n1, n, rank_sum, tied = t.agg(F.sum("mine"), F.sum("ties"), F.sum(F.col("mine") * rank), F.sum(ties.cast("decimal(38,0)") * (ties * ties - 1))).first()
    if not n1 or n1 == n:
        return None
    n2 = n - n1
    u = rank_sum - n1 * (n1 + 1) / 2
    var = n1 * n2 / 12 * ((n + 1) - int(tied) / (n * (n - 1)))
    z = (abs(u - n1 * n2 / 2) - 0.5) / math.sqrt(var) if var > 0 else 0.0
    return {"u": u, "p": min(1.0, 2 * dist.normal_sf(z)), "delta": 2 * u / (n1 * n2) - 1}


def welch(df: DataFrame, column: str, by: str, a, b) -> dict | None:
    x, y = _two(df, column, by, a, b)
    if not x or not y or x.n < 2 or y.n < 2:
        return None
    vx, vy = x["var"] / x.n, y["var"] / y.n
    if vx + vy <= 0:
        return None
    t, df_ = (x["mean"] - y["mean"]) / math.sqrt(vx + vy), (vx + vy) ** 2 / (vx**2 / (x.n - 1) + vy**2 / (y.n - 1))
    return {"t": t, "df": df_, "p": dist.t_two_sided(t, df_)}


def anova(df: DataFrame, column: str, by: str) -> dict | None:
    m = [r for r in moments(df, column, by).collect() if r.n >= 2]
    n, k = sum(r.n for r in m), len(m)
    if k < 2 or n <= k:
        return None
    grand = sum(r.n * r["mean"] for r in m) / n
    between, within = sum(r.n * (r["mean"] - grand) ** 2 for r in m), sum((r.n - 1) * r["var"] for r in m)
    if within <= 0:
        return None
    f = between / (k - 1) / (within / (n - k))
    return {"f": f, "df1": k - 1, "df2": n - k, "p": dist.f_sf(f, k - 1, n - k)}


def kruskal(df: DataFrame, column: str, by: str) -> dict | None:
    """h with tie correction, p, epsilon squared."""
    r = rank_sums(df, column, by).collect()
    n, k = sum(x.n for x in r), len(r)
    if k < 2:
        return None
    h = 12 / (n * (n + 1)) * sum(x.rank_sum**2 / x.n for x in r) - 3 * (n + 1)
    fix = 1 - tie_term(df, column, by) / (n**3 - n)
    h = h / fix if fix > 0 else 0.0
    return {"h": h, "p": dist.chi2_sf(h, k - 1), "epsilon_squared": min(1.0, max(0.0, (h - k + 1) / (n - k))) if n > k else None}


def dunn(df: DataFrame, column: str, by: str, correction: str = "holm") -> list[dict]:
    r = sorted(rank_sums(df, column, by).collect(), key=lambda x: str(x[by]))
    n = sum(x.n for x in r)
    sigma = n * (n + 1) / 12 - tie_term(df, column, by) / (12 * (n - 1)) if n > 1 else 0
    out = []
    for i, x in enumerate(r):
        for y in r[i + 1 :]:
            z = (x.rank_sum / x.n - y.rank_sum / y.n) / math.sqrt(sigma * (1 / x.n + 1 / y.n)) if sigma > 0 else 0.0
            out.append({"a": x[by], "b": y[by], "z": z, "p": dist.two_sided(z)})
    for row, q in zip(out, dist.adjusted([o["p"] for o in out], correction)):
        row["p_adjusted"] = q
    return out


def tukey(df: DataFrame, column: str, by: str) -> list[dict]:
    m = sorted((r for r in moments(df, column, by).collect() if r.n >= 2), key=lambda r: str(r[by]))
    n, k = sum(r.n for r in m), len(m)
    within = sum((r.n - 1) * r["var"] for r in m) / (n - k) if n > k else 0.0
    out = []
    for i, x in enumerate(m):
        for y in m[i + 1 :]:
            q = abs(x["mean"] - y["mean"]) / math.sqrt(within / 2 * (1 / x.n + 1 / y.n)) if within > 0 else 0.0
            out.append({"a": x[by], "b": y[by], "q": q, "p": dist.studentized_range_sf(q, k, n - k)})
    return out


def paired_t(pairs: DataFrame) -> dict | None:
    """Pairs (a, b): t of the differences; pairs come from series.paired."""
    d = F.col("a") - F.col("b")
    n, mean, sd = pairs.agg(F.count(d), F.avg(d), F.stddev_samp(d)).first()
    if n < 2 or not sd:
        return None
    t = mean / (sd / math.sqrt(n))
    return {"n": n, "t": t, "p": dist.t_two_sided(t, n - 1)}


def wilcoxon(pairs: DataFrame) -> dict | None:
    """Signed ranks of non-zero differences; normal approximation with tie correction."""
    d = pairs.select((F.col("a") - F.col("b")).alias("d")).filter("d <> 0").withColumns({"m": F.abs("d"), "up": F.col("d") > 0})
    n = d.count()
    if not n:
        return None
    r = {x.up: x.rank_sum for x in rank_sums(d, "m", "up").collect()}
    var = n * (n + 1) * (2 * n + 1) / 24 - tie_term(d, "m", "up") / 48
    z = (min(r.get(True, 0.0), r.get(False, 0.0)) - n * (n + 1) / 4) / math.sqrt(var)
    return {"n": n, "w": min(r.get(True, 0.0), r.get(False, 0.0)), "p": dist.two_sided(z)}


def normality(df: DataFrame, column: str, alpha: float = 0.05, skew_limit: float = 0.5, kurt_limit: float = 1.0) -> dict:
    """Bias-corrected shape, and Shapiro-Wilk up to 5000 values; normal unless rejected and misshapen."""
    x = F.col(column)
    n, sd, g1, g2 = df.agg(F.count(x), F.stddev_samp(x), F.when(F.stddev_samp(x) > 0, F.skewness(x)), F.when(F.stddev_samp(x) > 0, F.kurtosis(x))).first()
    if n < 3 or not sd:
        return {"n": n, "normal": True}
    skew = g1 * math.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6) if n > 3 else 0.0
    odd = abs(skew) >= skew_limit or kurt >= kurt_limit
    if n < 20:
        return {"n": n, "skew": skew, "kurtosis": kurt, "normal": not odd}
    if n <= 5000:
        _, p = dist.shapiro_wilk([r[0] for r in df.filter(x.isNotNull()).select(x.cast("double").alias("v")).orderBy("v").collect()])
    else:
        p = anderson_p(df, column)
    return {"n": n, "skew": skew, "kurtosis": kurt, "p": p, "normal": not (p < alpha and odd)}


def anderson_p(df: DataFrame, column: str) -> float:
    """.01 or .20: whether the Anderson-Darling statistic passes its 5 % value; ranks come from distinct values."""
    x = F.col(column)
    n, mean, sd = df.agg(F.count(x), F.avg(x), F.stddev_samp(x)).first()
    z = (F.col("value") - mean) / sd
    # logistic-free normal CDF from the error function's series is not in Spark: a 7.5e-8 rational approximation
    t = F.lit(1.0) / (F.abs(z) * 0.2316419 + 1)
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * (t * (t * (t * (t * (t * 1.330274429 - 1.821255978) + 1.781477937) - 0.356563782) + 0.31938153))
    cdf = F.least(F.greatest(F.when(z >= 0, 1 - tail).otherwise(tail), F.lit(1e-15)), F.lit(1 - 1e-15))
    r = average_ranks(df, column)
    first = F.col("rank") - (F.col("ties") - 1) / 2  # ranks first .. last share the value: sums of 2i - 1 and its mirror
    s1 = F.col("ties") * (2 * first + F.col("ties") - 2)
    s2 = F.col("ties") * (2 * n) - s1
    a2 = -n - r.agg(F.sum(s1 * F.ln(cdf) + s2 * F.ln(1 - cdf))).first()[0] / n
    return 0.01 if a2 > 0.787 / (1 + 0.75 / n + 2.25 / n**2) else 0.20


def crosstab(df: DataFrame, a: str, b: str, null_as_level: bool = False) -> DataFrame:
    """a, b, n as strings; null pairs are left out unless they count as a level."""
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("nan")) if null_as_level else F.col(c).cast("string")
    return df.select(s(a).alias("a"), s(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: chi2 (no continuity correction), n, rows, columns, v (bias-corrected Cramer's V; NULL under 2 x 2)."""
    t = crosstab(df, a, b)
    ra, cb = t.groupBy("a").agg(F.sum("n").alias("ra")), t.groupBy("b").agg(F.sum("n").alias("cb"))
    seen = t.join(ra, "a").join(cb, "b").agg(F.sum(F.col("n") * F.col("n") / (F.col("ra") * F.col("cb"))).alias("s"), F.sum("n").alias("n"), F.count_distinct("a").alias("r"), F.count_distinct("b").alias("k"))
    n, r, k = (F.col(c).cast("double") for c in ("n", "r", "k"))
    phi = F.greatest(F.col("s") - 1 - (k - 1) * (r - 1) / (n - 1), F.lit(0.0))
    rr, kk = r - (r - 1) * (r - 1) / (n - 1), k - (k - 1) * (k - 1) / (n - 1)
    v = F.when((r >= 2) & (k >= 2) & (F.least(rr, kk) - 1 > 0), F.sqrt(phi / (F.least(rr, kk) - 1)))
    return seen.select((F.col("n") * (F.col("s") - 1)).alias("chi2"), F.col("n"), F.col("r").alias("rows"), F.col("k").alias("columns"), v.alias("v"))


def categorical_test(df: DataFrame, a: str, b: str) -> dict | None:
    """Chi-square (Yates for 2 x 2); Fisher's exact test for a 2 x 2 table where over 20 % of expected counts are under 5."""
    cells = {(r.a, r.b): r.n for r in few(crosstab(df, a, b), f"{a} by {b}")}
    rows, cols = sorted({x for x, _ in cells}), sorted({y for _, y in cells})
    if len(rows) < 2 or len(cols) < 2:
        return None
    n = sum(cells.values())
    ra, cb = {x: sum(cells.get((x, y), 0) for y in cols) for x in rows}, {y: sum(cells.get((x, y), 0) for x in rows) for y in cols}
    expected = {(x, y): ra[x] * cb[y] / n for x in rows for y in cols}
    sparse = sum(e < 5 for e in expected.values()) > 0.2 * len(expected)
    small = len(rows) == len(cols) == 2
    if small and sparse:
        return {"test": "fisher", "p": dist.fisher_2x2(*(cells.get((x, y), 0) for x in rows for y in cols))}
    yates = 0.5 if small else 0.0
    chi2 = sum(max(abs(cells.get(xy, 0) - e) - yates, 0) ** 2 / e for xy, e in expected.items())
    dof = (len(rows) - 1) * (len(cols) - 1)
    return {"test": "chi2", "chi2": chi2, "df": dof, "p": dist.chi2_sf(chi2, dof), "caveat": sparse}


def pearson(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, n, r of all pairs of columns, pairwise complete, in one aggregate; NULL without spread."""
    out = []
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            ok = F.col(a).isNotNull() & F.col(b).isNotNull()
            x, y = F.when(ok, F.col(a).cast("double")), F.when(ok, F.col(b).cast("double"))
            r = F.try_divide(F.covar_samp(x, y), F.sqrt(F.var_samp(x) * F.var_samp(y)))
            out.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count_if(ok).alias("n"), r.alias("r")))
    if not out:
        return df.sparkSession.createDataFrame([], "a string, b string, n long, r double")
    return df.agg(F.array(*out).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
    rx, ry = (average_ranks(rows, c).select(F.col("value").alias(c), F.col("rank").alias(f"r{c}")) for c in ("x", "y"))
    return pearson(rows.join(rx, "x").join(ry, "y"), ["rx", "ry"]).select("n", F.col("r").alias("rho"))


def auc(df: DataFrame, column: str, label: str) -> DataFrame:
    """One row: n, auc of a numeric column for a 0/1 label, from rank sums."""
    r = rank_sums(df, column, label)
    p, q = F.sum(F.when(F.col(label) == 1, F.col("n"))), F.sum(F.when(F.col(label) == 0, F.col("n")))
    s = F.sum(F.when(F.col(label) == 1, F.col("rank_sum")))
    return r.agg((p + q).alias("n"), F.try_divide(s - p * (p + 1) / 2, (p * q).cast("double")).alias("auc"))


def attainment(df: DataFrame, column: str, low: float | None, high: float | None, by: str | None = None, low_closed: bool = True, high_closed: bool = True) -> DataFrame:
    """level (NULL: all), n, achieved, rate, at_low, at_high: share inside a target interval, and rows on its ends."""
    from cohortloom.functions.numeric import between

    x = F.col(column)
    level = F.col(by).cast("string") if by else F.lit(None).cast("string")
    rows = df.select(level.alias("g"), x.cast("double").alias("x"), between(x, low, high, low_closed, high_closed).alias("ok"))
    edge = lambda v: F.count_if(F.col("x") == v) if v is not None else F.lit(0).cast("long")
    aggs = [F.count("x").alias("n"), F.count_if("ok").alias("achieved"), edge(low).alias("at_low"), edge(high).alias("at_high")]
    g = rows.cube("g").agg(*aggs, F.grouping("g").alias("total")) if by else rows.agg(*aggs, F.lit(1).alias("total")).withColumn("g", F.lit(None).cast("string"))
    return g.select(F.when(F.col("total") == 1, F.lit("(all)")).otherwise(F.coalesce("g", F.lit("(null)"))).alias("level"), "n", "achieved", F.try_divide("achieved", "n").alias("rate"), "at_low", "at_high")


def compare_groups(df: DataFrame, by: str, columns: list[str], numeric: set[str], correction: str = "bh", paired_by: str | None = None, posthoc: bool = False, alpha: float = 0.05) -> list[dict]:
    """One row for each column: test, p, q and effect, chosen by type, normality, number of groups and pairing.

    With paired_by, two groups are compared on the differences of entities in both; without any such entity they are
    compared as if unpaired.  With posthoc, columns of several groups that differ get their pairs (Tukey or Dunn).
    """
    levels = sorted((r[0] for r in few(df.select(by).filter(F.col(by).isNotNull()).distinct(), by)), key=str)
    out = []
    for c in columns:
        row = {"column": c, "n_missing": df.filter(F.col(c).isNull()).count(), "smd": None}
        pairs = None
        if c in numeric and paired_by and len(levels) == 2:
            from cohortloom.operators.series import paired

            pairs = paired(df, by, paired_by, c, *levels, [paired_by, c])
        if c in numeric and pairs is not None and not pairs.isEmpty():
            normal = normality(pairs.select((F.col("a") - F.col("b")).alias("d")), "d")["normal"]
            got = paired_t(pairs) if normal else wilcoxon(pairs)
            row |= {"test": "paired_t" if normal else "wilcoxon", "effect": None, "smd": smd(df, c, by, *levels)}
        elif c in numeric:
            normal = all(normality(df.filter(F.col(by) == g), c)["normal"] for g in levels)
            if len(levels) == 2:
                a, b = levels
                got = welch(df, c, by, a, b) if normal else mann_whitney(df, c, by, a, b)
                row |= {"test": "welch" if normal else "mann_whitney", "effect": hedges_g(df, c, by, a, b) if normal else (got or {}).get("delta"), "smd": smd(df, c, by, a, b)}
            else:
                got = anova(df, c, by) if normal else kruskal(df, c, by)
                row |= {"test": "anova" if normal else "kruskal", "effect": eta_squared(df, c, by).first()[0] if normal else (got or {}).get("epsilon_squared"), "smd": (max_pairwise_smd(df, c, by) or {}).get("smd")}
                if posthoc and got and got["p"] < alpha:
                    row["posthoc"] = tukey(df, c, by) if normal else dunn(df, c, by)
        else:
            got = categorical_test(df, c, by)
            row |= {"test": (got or {}).get("test"), "effect": chi_square(df, c, by).first()["v"]}
        out.append(row | {"p": (got or {}).get("p")})
    for row, q in zip(out, dist.adjusted([r["p"] for r in out], correction)):
        row["q"] = q
    return out


def table_one(df: DataFrame, columns: list[str], numeric: set[str], by: str | None = None, max_levels: int = 20) -> list[dict]:
    """Rows of a publication table: mean (SD) or median [Q1, Q3]; n (%) of each level, folded beyond max_levels."""
    groups = [None] + (sorted((r[0] for r in few(df.select(by).filter(F.col(by).isNotNull()).distinct(), by)), key=str) if by else [])
    part = lambda g: df if g is None else df.filter(F.col(by) == g)
    name = lambda g: "Overall" if g is None else str(g)
    out = [{"row": "n"} | {name(g): str(part(g).count()) for g in groups}]
    for c in columns:
        if c in numeric:
            mean = normality(df, c)["normal"]
            cells = {}
            for g in groups:
                m, s = part(g).agg(F.avg(c), F.stddev_samp(c)).first()
                q = None if m is None or mean else quantiles(part(g), F.col(c).cast("double"), [0.25, 0.5, 0.75]).first().q
                cells[name(g)] = "" if m is None else f"{m:.1f} ({s or 0:.1f})" if mean else f"{q[1]:.1f} [{q[0]:.1f}, {q[2]:.1f}]"
            out.append({"row": f"{c}, {'mean (SD)' if mean else 'median [IQR]'}"} | cells)
        else:
            found = df.filter(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(max_levels + 1).collect()
            if len(found) > max_levels:
                out.append({"row": f"{c}: over {max_levels} levels"})
                continue
            tall = {name(g): dict(part(g).filter(F.col(c).isNotNull()).groupBy(c).count().collect()) for g in groups}
            for level in sorted((r[0] for r in found), key=str):
                out.append({"row": f"{c} = {level}"} | {g: f"{n.get(level, 0)} ({100 * n.get(level, 0) / max(sum(n.values()), 1):.1f}%)" for g, n in tall.items()})
    return out


def association(df: DataFrame, numbers: list[str], levels: list[str]) -> list[dict]:
    """a, b, kind, value of all pairs: size of the rank correlation, share of variance between levels, or Cramer's V."""
    out = []
    for i, a in enumerate(numbers):
        out += [{"a": a, "b": b, "kind": "rho", "value": r if (r := spearman(df, a, b).first()["rho"]) is None else abs(r)} for b in numbers[i + 1 :]]
        out += [{"a": a, "b": g, "kind": "eta_squared", "value": eta_squared(df.filter(F.col(a).isNotNull()), a, g).first()[0]} for g in levels]
    return out + [{"a": a, "b": b, "kind": "v", "value": chi_square(df, a, b).first()["v"]} for i, a in enumerate(levels) for b in levels[i + 1 :]]


def percent(k: int, n: int) -> str:
    """A share for print: two significant digits under 10 %, else one decimal."""
    v = 100.0 * k / n if n else 0.0
    return f"{v:.2g}" if v < 10 else f"{v:.1f}"


def publication_table(df: DataFrame, columns: list[str], numeric: set[str], by: str | None = None, max_levels: int = 10) -> list[dict]:
    """Rows for print: mean ± SD [min, max] or n (%), for all rows, or for each group without an overall column.

    Numbers show no decimals if all are whole, two if their median size is under 1, else one; beyond max_levels the rarer
    levels are one row.
    """
    groups = {"all": df} if by is None else {str(g): df.filter(F.col(by) == g) for g in sorted((r[0] for r in few(df.select(by).filter(F.col(by).isNotNull()).distinct(), by)), key=str)}
    out = []
    for c in columns:
        if c in numeric:
            x = F.col(c).cast("double")
            found = quantiles(df, F.abs(x), [0.5]).first()
            whole = not df.filter(x != F.floor(x)).limit(1).count()
            d = 0 if whole else 2 if found.n and found.q[0] < 1 else 1
            row = {"row": c}
            for g, rows in groups.items():
                mean, sd, lo, hi = rows.agg(F.avg(x), F.stddev_samp(x), F.min(x), F.max(x)).first()
                row[g] = "" if mean is None else f"{mean:.{d}f} ± {sd or 0:.{d}f} [{lo:.{d}f}, {hi:.{d}f}]"
            out.append(row)
            continue
        counts = {g: {str(r[0]): r[1] for r in few(rows.filter(F.col(c).isNotNull()).groupBy(c).count(), c)} for g, rows in groups.items()}
        total: dict[str, int] = {}
        for n in counts.values():
            for level, k in n.items():
                total[level] = total.get(level, 0) + k
        often = sorted(total, key=lambda v: (-total[v], v))[: max_levels if len(total) <= max_levels else max_levels - 1]
        cell = lambda n, k: f"{k} ({percent(k, sum(n.values()))}%)"
        out += [{"row": f"{c} = {level}"} | {g: cell(n, n.get(level, 0)) for g, n in counts.items()} for level in sorted(often)]
        if len(often) < len(total):
            out.append({"row": f"{c}: other"} | {g: cell(n, sum(k for v, k in n.items() if v not in often)) for g, n in counts.items()})
    return out


def achievement(df: DataFrame, by: str | None = None) -> DataFrame:
    """item and the columns of `attainment`, for every dictionary item with a target that some column holds; the first column counts."""
    from cohortloom.plans.dictionary import TARGETS, Timings

    t, out = Timings.infer(df.columns), None
    for item, (low, low_closed, high, high_closed) in TARGETS.items():
        if columns := t.get(item):
            part = attainment(df.withColumn("__x", F.col(f"`{columns[0]}`").try_cast("double")), "__x", low, high, by, low_closed, high_closed).select(F.lit(item).alias("item"), "*")
            out = part if out is None else out.unionByName(part)
    return out if out is not None else df.sparkSession.createDataFrame([], "item string, level string, n long, achieved long, rate double, at_low long, at_high long")
