"""Survival analysis over the event table (group, time, deaths, leaving): one aggregate, then window sums over distinct times."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortloom.functions import dist
from cohortloom.operators.places import quantiles, quantiles_of, value_at
from cohortloom.session import release, stage

UNIT_DAYS = {"days": 1.0, "weeks": 7.0, "months": 30.4375, "years": 365.25}


def build_survival(df: DataFrame, start: Column, event_date: Column, censor_date: Column, as_of: Column, unit: str = "days", zero: str = "half", inclusive: bool = False, max_years: float = 60.0) -> DataFrame:
    """df with duration, event and reason; the first failing rule gives the reason and leaves duration NULL.

    Exactly one of event and censor date must be there; zero days become half a day, go, stay or fail by `zero`.
    """
    end = F.coalesce(event_date, censor_date)
    days = F.datediff(end, start) + (1 if inclusive else 0)
    reason = (
        F.when(event_date.isNotNull() & censor_date.isNotNull(), "both dates")
        .when(end.isNull(), "no end date")
        .when(start.isNull(), "no start date")
        .when(end < start, "reversed")
        .when(end > as_of, "in the future")
        .when(days > max_years * 365.25, "too long")
    )
    if zero == "drop":
        reason = reason.when(days == 0, "zero days")
    length = F.when(days == 0, 0.5).otherwise(days.cast("double")) if zero == "half" else days.cast("double")
    out = df.withColumns({"reason": reason, "duration": F.when(reason.isNull(), length / UNIT_DAYS[unit]), "event": F.when(reason.isNull(), event_date.isNotNull().cast("int"))})
    if zero == "raise" and out.filter("duration = 0").limit(1).count():
        raise ValueError("rows of zero duration")
    return out


def _checked(df: DataFrame, reason: Column, length: Column, event: Column, unit: str, zero: str, max_years: float) -> DataFrame:
    days = length * UNIT_DAYS[unit]
    reason = reason.when(days > max_years * 365.25, "too long").when(~event.isin(0, 1), "event is not 0 or 1").when(event.isNull(), "no event")
    if zero == "drop":
        reason = reason.when(days == 0, "zero days")
    value = F.when(days == 0, 0.5 / UNIT_DAYS[unit]).otherwise(length) if zero == "half" else length
    out = df.withColumns({"reason": reason, "duration": F.when(reason.isNull(), value.cast("double")), "event": F.when(reason.isNull(), event.cast("int"))})
    if zero == "raise" and out.filter("duration = 0").limit(1).count():
        raise ValueError("rows of zero duration")
    return out


def from_durations(df: DataFrame, duration: Column, event: Column, unit: str = "days", zero: str = "half", max_years: float = 60.0) -> DataFrame:
    """df with duration, event and reason, from a length and a 0/1 event; rules as in `build_survival`."""
    x = duration.cast("double")
    return _checked(df, F.when(x.isNull(), "no duration").when(x < 0, "reversed"), x, event, unit, zero, max_years)


def from_dates(df: DataFrame, start: Column, end: Column, event: Column, as_of: Column, unit: str = "days", zero: str = "half", inclusive: bool = False, max_years: float = 60.0) -> DataFrame:
    """df with duration, event and reason, from a start, an end and a 0/1 event; rules as in `build_survival`."""
    reason = F.when(start.isNull(), "no start date").when(end.isNull(), "no end date").when(end < start, "reversed").when(end > as_of, "in the future")
    return _checked(df, reason, (F.datediff(end, start) + (1 if inclusive else 0)) / UNIT_DAYS[unit], event, unit, zero, max_years)


def summary(df: DataFrame, duration: str, event: str) -> DataFrame:
    """One row: n, events, rate, median time to the event and of follow-up, shortest and longest time."""
    ok = df.filter(F.col(duration).isNotNull() & F.col(event).isNotNull())
    one = ok.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(event).cast("long")).alias("events"), F.avg(F.col(event).cast("double")).alias("rate"), F.min(duration).alias("shortest"), F.max(duration).alias("longest"))
    return one.join(F.broadcast(km_median(ok, duration, event).select("median", "follow_up")), F.lit(True), "left")


def km_at(df: DataFrame, duration: str, event: str, times: list[float], by: str | None = None) -> DataFrame:
    """g, at, survival: 1 before the first time, NULL after the last one of the group."""
    c = km(df, duration, event, by)
    s = [F.struct(F.lit(float(x)).alias("at"), F.when(F.max("t") >= x, F.coalesce(F.min(F.when(F.col("t") <= x, F.col("survival"))), F.lit(1.0))).alias("survival")) for x in times]
    return c.groupBy("g").agg(F.array(*s).alias("x")).select("g", F.explode("x").alias("x")).select("g", "x.*")


def event_table(df: DataFrame, duration: str, event: str, by: str | None = None) -> DataFrame:
    """g, t, d (events), c (all that leave at t), at_risk."""
    g = F.col(by) if by else F.lit("all")
    rows = df.filter(F.col(duration).isNotNull() & F.col(event).isNotNull()).groupBy(g.alias("g"), F.col(duration).cast("double").alias("t")).agg(F.sum(F.col(event).cast("long")).alias("d"), F.count(F.lit(1)).alias("c"))
    return rows.withColumn("at_risk", F.sum("c").over(W.partitionBy("g").orderBy(F.desc("t"))))


def km(df: DataFrame, duration: str, event: str, by: str | None = None, alpha: float = 0.05) -> DataFrame:
    """g, t, at_risk, d, survival, low, high: the product over event times with log-log Greenwood limits."""
    e = event_table(df, duration, event, by)
    w = W.partitionBy("g").orderBy("t")
    gone = F.col("d") == F.col("at_risk")
    step = F.sum(F.when(~gone, F.log1p(-F.col("d") / F.col("at_risk")))).over(w)
    var = F.sum(F.when(~gone, F.col("d") / (F.col("at_risk") * (F.col("at_risk") - F.col("d"))))).over(w)
    zero = F.max(gone.cast("int")).over(w) == 1
    z = dist.normal_ppf(1 - alpha / 2)
    e = e.withColumns({"survival": F.when(zero, 0.0).otherwise(F.exp(F.coalesce(step, F.lit(0.0)))), "v": var})
    inside = (F.col("survival") > 0) & (F.col("survival") < 1)
    s = F.when(inside, F.ln(F.col("survival")))
    spread = F.sqrt("v") * z / s
    return e.select("g", "t", "at_risk", "d", "survival", F.when(inside, F.exp(s * F.exp(-spread))).alias("low"), F.when(inside, F.exp(s * F.exp(spread))).alias("high"))


def km_median(df: DataFrame, duration: str, event: str, by: str | None = None) -> DataFrame:
    """g, n, events, median (NULL: not reached), follow_up (median of the reversed curve)."""
    curve = lambda ev: km(df.withColumn("__e", ev), duration, "__e", by)
    half = F.min(F.when(F.col("survival") <= 0.5, F.col("t")))
    a = curve(F.col(event)).groupBy("g").agg(F.max("at_risk").alias("n"), F.sum("d").alias("events"), half.alias("median"))
    b = curve(1 - F.col(event)).groupBy("g").agg(half.alias("follow_up"))
    return a.join(b, "g")


def at_ticks(df: DataFrame, duration: str, event: str, ticks: list[float], by: str | None = None) -> DataFrame:
    """g, tick, at_risk, events, censored (both up to the tick)."""
    g = F.col(by) if by else F.lit("all")
    t = F.col(duration)
    aggs = [F.struct(F.lit(float(x)).alias("tick"), F.count_if(t >= x).alias("at_risk"), F.count_if((t <= x) & (F.col(event) == 1)).alias("events"), F.count_if((t <= x) & (F.col(event) == 0)).alias("censored")) for x in ticks]
    return df.groupBy(g.alias("g")).agg(F.array(*aggs).alias("x")).select("g", F.explode("x").alias("x")).select("g", "x.*")


def rmst(df: DataFrame, duration: str, event: str, by: str | None = None, tau: float | None = None) -> DataFrame:
    """g, rmst: area under the curve up to tau, the largest time of all where none is given.

    The curve is 1 from 0 to a group's first time, or to tau if that comes first; a group whose curve ends before tau keeps
    its last value.
    """
    if tau is None:
        tau = df.agg(F.max(duration)).first()[0]
    c = km(df, duration, event, by)
    c = c.withColumn("next", F.lead("t").over(W.partitionBy("g").orderBy("t")))
    end = F.least(F.coalesce("next", F.lit(float(tau))), F.lit(float(tau)))
    area = F.when(F.col("t") < tau, F.col("survival") * (end - F.col("t"))).otherwise(0.0)
    return c.groupBy("g").agg((F.least(F.min("t"), F.lit(float(tau))) + F.sum(area)).alias("rmst"))


def logrank_parts(df: DataFrame, duration: str, event: str, by: str) -> DataFrame:
    """t, g, n_g, d_g, n, d for every event time and group: numbers at risk of groups without a row there are filled in."""
    e = event_table(df, duration, event, by)
    times = e.filter("d > 0").groupBy("t").agg(F.sum("d").alias("d"))
    groups = e.select("g").distinct()
    # every event time meets every group: distinct times x groups (few), by explode rather than a join of rows
    levels = sorted((r[0] for r in groups.collect()), key=str)
    grid = times.withColumn("g", F.explode(F.array(*[F.lit(x) for x in levels])))
    w = W.partitionBy("g").orderBy(F.desc("t")).rangeBetween(W.unboundedPreceding, W.currentRow)
    both = e.select("g", "t", F.col("c"), F.col("d").alias("d_g"), F.lit(None).cast("long").alias("d")).unionByName(grid.select("g", "t", F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("d_g"), "d"))
    summed = both.groupBy("g", "t").agg(F.sum("c").alias("c"), F.sum("d_g").alias("d_g"), F.max("d").alias("d"))
    rows = summed.withColumn("n_g", F.sum("c").over(w)).filter("d IS NOT NULL")
    return rows.withColumn("n", F.sum("n_g").over(W.partitionBy("t"))).select("t", "g", "n_g", "d_g", "n", "d")


def logrank(df: DataFrame, duration: str, event: str, by: str) -> dict:
    """observed, expected by group, chi2, p; the covariance matrix is summed by Spark, solved on the driver."""
    parts = logrank_parts(df, duration, event, by)
    first = parts.groupBy("g").agg(F.sum("d_g").alias("o"), F.sum(F.col("d") * F.col("n_g") / F.col("n")).alias("e")).collect()
    levels = sorted((r.g for r in first), key=str)
    f = F.when(F.col("n") > 1, F.col("d") * (F.col("n") - F.col("d")) / (F.col("n") - 1)).otherwise(0.0)
    wide = parts.groupBy("t", "n", "d").agg(*[F.coalesce(F.sum(F.when(F.col("g") == g, F.col("n_g"))), F.lit(0)).alias(f"x{i}") for i, g in enumerate(levels)])
    p = [F.col(f"x{i}") / F.col("n") for i in range(len(levels))]
    k = len(levels) - 1
    v = wide.agg(*[F.sum(f * (p[i] * (float(i == j)) - p[i] * p[j])) for i in range(k) for j in range(k)]).first()
    o, e = ({r.g: r[c] for r in first} for c in ("o", "e"))
    u = np.array([o[g] - e[g] for g in levels[:k]])
    chi2 = float(u @ np.linalg.pinv(np.array(v, dtype=float).reshape(k, k)) @ u) if k else 0.0
    return {"levels": levels, "observed": o, "expected": e, "chi2": chi2, "df": k, "p": dist.chi2_sf(chi2, k) if k else 1.0}


def logrank_pairwise(df: DataFrame, duration: str, event: str, by: str, correction: str = "holm") -> list[dict]:
    """a, b, chi2, p, q of every pair of groups, from one table of events that is staged once."""
    g = F.col(by).cast("string")
    rows = stage(df.filter(F.col(duration).isNotNull() & F.col(event).isNotNull() & g.isNotNull()).groupBy(g.alias("g"), F.col(duration).cast("double").alias("t"), F.col(event).cast("int").alias("e")).agg(F.count(F.lit(1)).alias("c")))
    levels = sorted(r.g for r in rows.select("g").distinct().limit(51).collect())
    if len(levels) > 50:
        raise ValueError(f"{by} has over 50 groups")
    out = []
    for i, a in enumerate(levels):
        for b in levels[i + 1 :]:
            # at each time of the pair: deaths, and numbers at risk from sums backwards over distinct times
            t = rows.filter(F.col("g").isin(a, b)).groupBy("t").agg(*[F.coalesce(F.sum(F.when(F.col("g") == x, F.col("c") * (F.col("e") if died else 1))), F.lit(0)).alias(n) for x, n, died in ((a, "da", True), (b, "db", True), (a, "ca", False), (b, "cb", False))])
            w = W.orderBy(F.desc("t"))
            t = t.withColumns({"na": F.sum("ca").over(w).cast("double"), "nb": F.sum("cb").over(w).cast("double")}).filter("da + db > 0")
            n, d = F.col("na") + F.col("nb"), F.col("da") + F.col("db")
            v = F.when(n > 1, d * F.col("na") / n * (F.col("nb") / n) * (n - d) / (n - 1)).otherwise(0.0)
            o, var = t.agg(F.sum(F.col("da") - d * F.col("na") / n), F.sum(v)).first()
            chi2 = o * o / var if var else None
            out.append({"a": a, "b": b, "chi2": chi2, "p": dist.chi2_sf(chi2, 1) if chi2 is not None else None})
    release(rows)
    for row, q in zip(out, dist.adjusted([r["p"] for r in out], correction)):
        row["q"] = q
    return out


def logrank_trend(df: DataFrame, duration: str, event: str, by: str, scores: dict) -> dict:
    """chi2 of a trend over scored groups, with the hypergeometric variance."""
    parts = logrank_parts(df, duration, event, by)
    s = F.lit(None).cast("double")
    for g, x in scores.items():
        s = F.when(F.col("g") == F.lit(g), float(x)).otherwise(s)
    t = parts.withColumn("s", s).groupBy("t", "n", "d").agg(F.sum(F.col("s") * F.col("d_g")).alias("o"), F.sum(F.col("s") * F.col("n_g")).alias("sn"), F.sum(F.col("s") * F.col("s") * F.col("n_g")).alias("ssn"))
    var = F.when(F.col("n") > 1, F.col("d") * (F.col("n") - F.col("d")) / (F.col("n") - 1) * (F.col("ssn") / F.col("n") - F.col("sn") / F.col("n") * F.col("sn") / F.col("n"))).otherwise(0.0)
    u, v = t.agg(F.sum(F.col("o") - F.col("d") * F.col("sn") / F.col("n")), F.sum(var)).first()
    return {"chi2": u * u / v if v and v > 0 else None, "p": dist.chi2_sf(u * u / v, 1) if v and v > 0 else None}


MOST_LEVELS = 10  # of a covariate that becomes dummies


def impute(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[dict]]:
    """df with missing covariates filled: the median of numbers of over two values, else the most frequent value (ties by value).

    Columns without a missing value, or with nothing else, stay as they are.
    """
    kinds = dict(df.dtypes)
    counts = df.agg(F.count(F.lit(1)), *[F.count(F.col(f"`{c}`")) for c in columns]).first()
    holes = [c for c, n in zip(columns, counts[1:]) if 0 < n < counts[0]]
    many = {c for c in holes if kinds[c] not in ("string", "boolean") and df.filter(F.col(f"`{c}`").isNotNull()).select(F.col(f"`{c}`")).distinct().limit(3).count() > 2}
    at = quantiles_of(df, {c: F.col(f"`{c}`") for c in holes if c in many}, [0.5])
    out, told = {}, []
    for c in holes:
        x = F.col(f"`{c}`")
        if c in many:
            value, method = value_at(at[c][1][0]), "median"
        else:
            value, method = df.filter(x.isNotNull()).groupBy(x.alias("v")).count().orderBy(F.desc("count"), "v").first().v, "most frequent"
        out[c] = F.coalesce(x.cast("double") if c in many else x, F.lit(value))
        told.append({"column": c, "method": method, "value": str(value), "missing": counts[0] - counts[1 + columns.index(c)]})
    return df.withColumns(out), told


def design(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str], dict[str, str], list[str]]:
    """(df with numeric covariates, their names, reference level of each category, what was left out and why).

    A category becomes dummies against its most frequent level (ties by name); missing stays missing.  Left out are columns
    that aren't there, with one value, without spread, or of over MOST_LEVELS levels.
    """
    kinds, names, reference, dropped, out = dict(df.dtypes), [], {}, [], {}
    for c in columns:
        x = F.col(f"`{c}`")
        if c not in kinds:
            dropped.append(f"{c}: no such column")
        elif kinds[c] in ("string", "boolean"):
            levels = df.filter(x.isNotNull()).groupBy(x.cast("string").alias("v")).count().orderBy(F.desc("count"), "v").limit(MOST_LEVELS + 1).collect()
            if len(levels) < 2 or len(levels) > MOST_LEVELS:
                dropped.append(f"{c}: {'one value' if len(levels) < 2 else f'over {MOST_LEVELS} levels'}")
                continue
            reference[c] = levels[0].v
            for v in sorted(r.v for r in levels[1:]):
                out[f"{c}={v}"] = (x.cast("string") == v).cast("double")
                names.append(f"{c}={v}")
        else:
            low, high = df.agg(F.min(x.cast("double")), F.max(x.cast("double"))).first()
            if low is None or low == high:
                dropped.append(f"{c}: one value")
            else:
                names.append(c)
    return df.withColumns(out), names, reference, dropped


def _risk_sets(rows: DataFrame, beta: np.ndarray) -> tuple[DataFrame, dict[str, Column]]:
    """One row for each tied death of each time (l = 0, 1, ...), and the Efron sums of its risk set as columns."""
    k = len(beta)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    r = F.exp(sum((F.col(f"x{i}") * float(b) for i, b in enumerate(beta)), F.lit(0.0)))
    term = {"s0": r} | {f"s1_{i}": r * F.col(f"x{i}") for i in range(k)} | {f"s2_{i}_{j}": r * F.col(f"x{i}") * F.col(f"x{j}") for i, j in pairs}
    died = F.col("e") == 1
    by_t = rows.groupBy("s", "t").agg(F.sum("e").alias("d"), *[F.sum(v).alias(c) for c, v in term.items()], *[F.coalesce(F.sum(F.when(died, v)), F.lit(0.0)).alias(f"e_{c}") for c, v in term.items()], *[F.coalesce(F.sum(F.when(died, F.col(f"x{i}"))), F.lit(0.0)).alias(f"z{i}") for i in range(k)])
    w = W.partitionBy("s").orderBy(F.desc("t"))  # over distinct times of a stratum
    risk = by_t.select("s", "t", "d", *[F.sum(c).over(w).alias(c) for c in term], *[f"e_{c}" for c in term], *[f"z{i}" for i in range(k)]).filter("d > 0")
    tied = risk.withColumn("l", F.explode(F.sequence(F.lit(0), F.col("d").cast("int") - 1)))
    return tied, {c: F.col(c) - F.col("l") / F.col("d") * F.col(f"e_{c}") for c in term}


def _covariates(df: DataFrame, duration: str, event: str, covariates: list[str], strata: str | None) -> tuple[DataFrame, int, int]:
    """Complete rows as s, t, e, x0 ... with centred covariates; their number and that of their events."""
    s = F.col(f"`{strata}`").cast("string") if strata else F.lit("all")
    rows = df.select(s.alias("s"), F.col(duration).cast("double").alias("t"), F.col(event).cast("int").alias("e"), *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(covariates)]).dropna()
    n, events, *means = rows.agg(F.count(F.lit(1)), F.sum("e"), *[F.avg(f"x{i}") for i in range(len(covariates))]).first()
    return rows.select("s", "t", "e", *[(F.col(f"x{i}") - F.lit(m)).alias(f"x{i}") for i, m in enumerate(means)]), n, events or 0


def cox(df: DataFrame, duration: str, event: str, covariates: list[str], penalizer: float = 0.0, rounds: int = 25, strata: str | None = None) -> dict:
    """Efron partial likelihood by Newton steps; each step is one distributed aggregate by time and one over the event table."""
    k = len(covariates)
    rows, n, events = _covariates(df, duration, event, covariates, strata)
    beta, pairs, loglik = np.zeros(k), [(i, j) for i in range(k) for j in range(i, k)], -math.inf
    for _ in range(rounds):
        tied, a = _risk_sets(rows, beta)
        score = [F.sum(F.when(F.col("l") == 0, F.col(f"z{i}")).otherwise(0.0) - a[f"s1_{i}"] / a["s0"]) for i in range(k)]
        info = [F.sum(a[f"s2_{i}_{j}"] / a["s0"] - a[f"s1_{i}"] / a["s0"] * a[f"s1_{j}"] / a["s0"]) for i, j in pairs]
        eta = sum((F.col(f"z{i}") * float(b) for i, b in enumerate(beta)), F.lit(0.0))
        got = tied.agg(*score, *info, F.sum(F.when(F.col("l") == 0, eta).otherwise(0.0) - F.ln(a["s0"]))).first()
        u = np.array(got[:k]) - penalizer * beta
        h = np.zeros((k, k))
        for (i, j), v in zip(pairs, got[k : k + len(pairs)]):
            h[i, j] = h[j, i] = v
        h += penalizer * np.eye(k)
        step = np.linalg.solve(h, u)
        loglik = got[-1]
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    cov = np.linalg.inv(h)
    se = np.sqrt(np.diag(cov))
    table = [{"covariate": c, "coef": b, "hr": math.exp(b), "se": s, "p": dist.two_sided(b / s), "low": math.exp(b - 1.959963985 * s), "high": math.exp(b + 1.959963985 * s)} for c, b, s in zip(covariates, beta.tolist(), se.tolist())]
    return {"n": n, "events": events, "loglik": loglik, "score": float(np.abs(u).max()), "table": table, "few_events": events < 10 * k, "beta": beta.tolist(), "cov": cov.tolist()}


def check_ph(df: DataFrame, duration: str, event: str, covariates: list[str], fit: dict, strata: str | None = None) -> list[dict]:
    """covariate, chi2, p, violated: scaled Schoenfeld residuals against the rank of time, one degree of freedom each.

    Residuals of tied deaths are summed and share their average rank, so one row for each distinct time suffices.
    """
    k, beta, cov = len(covariates), np.array(fit["beta"]), np.array(fit["cov"])
    rows, _, _ = _covariates(df, duration, event, covariates, strata)
    tied, a = _risk_sets(rows, beta)
    left = [(F.sum(F.when(F.col("l") == 0, F.col(f"z{i}")).otherwise(0.0) - a[f"s1_{i}"] / a["s0"])).alias(f"u{i}") for i in range(k)]
    times = tied.groupBy("t").agg(F.count(F.lit(1)).alias("d"), *left)
    times = times.withColumn("g", F.sum("d").over(W.orderBy("t")) - (F.col("d") - 1) / 2)  # over distinct times
    n, mean, square, *gu = times.agg(F.sum("d"), F.sum(F.col("d") * F.col("g")) / F.sum("d"), F.sum(F.col("d") * F.col("g") * F.col("g")), *[F.sum(F.col("g") * F.col(f"u{i}")) for i in range(k)], *[F.sum(f"u{i}") for i in range(k)]).first()
    u = np.array(gu[:k]) - mean * np.array(gu[k:])
    spread = square - n * mean * mean
    out = []
    for i, c in enumerate(covariates):
        chi2 = float(n * (cov[i] @ u) ** 2 / (cov[i, i] * spread)) if spread > 0 else 0.0
        p = dist.chi2_sf(chi2, 1)
        out.append({"covariate": c, "chi2": chi2, "p": p, "violated": p < 0.05})
    return out


def cox_model(df: DataFrame, duration: str, event: str, columns: list[str], strata: str | None = None, screen_p: float | None = 0.1, penalizer: float = 0.0, fill: bool = True) -> dict:
    """Fill, make dummies, keep covariates whose own model has p < screen_p (all if none has), fit the rest together.

    Says what was filled, left out and screened, how many rows and events complete cases lost, and checks hazards.
    """
    known = df.filter(F.col(duration).isNotNull() & F.col(event).isNotNull())
    filled, told = impute(known, [c for c in columns if c in df.columns]) if fill else (known, [])
    wide, names, reference, dropped = design(filled, columns)
    alone = {c: cox(wide, duration, event, [c], penalizer, strata=strata)["table"][0]["p"] for c in names} if screen_p is not None and len(names) > 1 else {}
    kept = [c for c in names if alone.get(c, 0.0) < screen_p] or names if alone else names
    if not kept:
        return {"table": [], "reference": reference, "dropped": dropped, "imputed": told}
    fit = cox(wide, duration, event, kept, penalizer, strata=strata)
    n, events = known.agg(F.count(F.lit(1)), F.sum(F.col(event).cast("long"))).first()
    return fit | {"reference": reference, "dropped": dropped, "imputed": told, "screened": alone, "lost_rows": n - fit["n"], "lost_events": events - fit["events"], "wide": [r["covariate"] for r in fit["table"] if r["high"] / r["low"] > 100], "ph": check_ph(wide, duration, event, kept, fit, strata)}


def binary_at(duration: Column, event: Column, tau: float) -> Column:
    """Event within tau: 1; known to be free of it at tau: 0; else NULL."""
    return F.when(event.isNull() | duration.isNull(), None).when((event == 1) & (duration <= tau), 1).when(duration >= tau, 0)


def choose_horizon(df: DataFrame, duration: str, event: str, grid: float, most_undetermined: float = 0.2) -> dict | None:
    """tau among 5-95 % quantiles rounded to the grid, up to the median follow-up: most in the smaller class, then most determined, then early."""
    found = quantiles(df, F.col(duration).cast("double"), [x / 100 for x in range(5, 100, 5)] + [0.5]).first()
    if not found.n:
        return None
    *q, middle = found.q
    upper = km_median(df, duration, event).first()["follow_up"]
    taus = sorted({round(x / grid) * grid for x in q if round(x / grid) > 0 and (upper is None or round(x / grid) * grid <= upper)})
    if not taus:
        taus = [middle]
    n = df.count()
    b = [binary_at(F.col(duration), F.col(event), t) for t in taus]
    got = df.agg(*[x for c in b for x in (F.count_if(c == 1), F.count_if(c == 0))]).first()
    rows = [{"tau": t, "ones": got[2 * i], "zeros": got[2 * i + 1], "undetermined": 1 - (got[2 * i] + got[2 * i + 1]) / n} for i, t in enumerate(taus)]
    rows.sort(key=lambda r: (r["undetermined"] > most_undetermined, -min(r["ones"], r["zeros"]), r["undetermined"], r["tau"]))
    return rows[0] if rows else None
