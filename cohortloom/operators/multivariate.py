"""Operators over several columns at once: Mahalanobis distance, principal components, signals of missingness."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions import dist
from cohortloom.operators.compare import categorical_test, mann_whitney
from cohortloom.operators.places import quantiles, quantiles_of, value_at
from cohortloom.session import stage


def covariance(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """n, means and sample covariance of complete rows, from one aggregate."""
    k = len(columns)
    x = [F.col(c).cast("double") for c in columns]
    rows = df.select(*[v.alias(f"x{i}") for i, v in enumerate(x)]).dropna()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    r = rows.agg(F.count(F.lit(1)), *[F.avg(f"x{i}") for i in range(k)], *[F.covar_samp(f"x{i}", f"x{j}") for i, j in pairs]).first()
    cov = np.zeros((k, k))
    for (i, j), v in zip(pairs, r[1 + k :]):
        cov[i, j] = cov[j, i] = v or 0.0
    return r[0], np.array([v or 0.0 for v in r[1 : 1 + k]]), cov


def mahalanobis(df: DataFrame, columns: list[str], alpha: float = 0.001) -> DataFrame:
    """df with d2 and d2__outlier for complete rows; NULL without p >= 2 columns and n >= p + 2 rows."""
    n, mean, cov = covariance(df, columns)
    p = len(columns)
    if p < 2 or n < p + 2:
        return df.withColumns({"d2": F.lit(None).cast("double"), "d2__outlier": F.lit(None).cast("int")})
    inverse, cut = np.linalg.pinv(cov), dist.chi2_ppf(1 - alpha, p)
    d = [F.col(c).cast("double") - float(m) for c, m in zip(columns, mean)]
    d2 = sum((d[i] * d[j] * float(inverse[i, j]) for i in range(p) for j in range(p)), F.lit(0.0))
    return df.withColumn("d2", d2).withColumn("d2__outlier", (F.col("d2") > cut).cast("int"))


def isolation_forest(df: DataFrame, columns: list[str], row: str, contamination: float = 0.02, trees: int = 100, sample: int = 256, seed: int = 0) -> DataFrame:
    """row, score, outlier of complete rows: how early random cuts isolate a row; the highest `contamination` are outliers.

    Each tree is grown on the driver from a bounded sample, dealt by a hash of the row; a score is a plain expression, so all
    rows are scored on the JVM without a shuffle.  Fewer than 20 rows give no rows.
    """
    rows = df.select(F.col(f"`{row}`").alias(row), *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)]).dropna()
    n = rows.count()
    if n < 20:
        return rows.limit(0).select(row, F.lit(0.0).alias("score"), F.lit(0).alias("outlier"))
    take = rows.withColumn("__h", F.pmod(F.xxhash64(F.lit(seed), row), F.lit(1 << 30))).filter(F.col("__h") < (1 << 30) * min(1.0, 1.2 * trees * sample / n))
    points = np.array([r[1:-1] for r in take.orderBy("__h").limit(trees * sample).collect()], dtype=float)
    rng = np.random.default_rng(seed)
    size = min(sample, len(points))
    deepest = int(np.ceil(np.log2(max(size, 2))))
    usual = lambda m: 0.0 if m < 2 else 1.0 if m == 2 else 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m

    def grown(x: np.ndarray, depth: int):
        if depth >= deepest or len(x) < 2 or not (np.ptp(x, axis=0) > 0).any():
            return depth + usual(len(x))
        j = int(rng.choice(np.flatnonzero(np.ptp(x, axis=0) > 0)))
        cut = float(rng.uniform(x[:, j].min(), x[:, j].max()))
        left = x[:, j] < cut
        return j, cut, grown(x[left], depth + 1), grown(x[~left], depth + 1)

    forest = [grown(points[rng.choice(len(points), size, replace=False)], 0) for _ in range(trees)]

    def flat(tree) -> tuple[list, list, list, list, list]:
        """A tree as arrays: cut column (-1 in a leaf), cut, places of both sides, length."""
        column, cut, left, right, length = [], [], [], [], []

        def put(t) -> int:
            at = len(column)
            for a, v in ((column, -1), (cut, 0.0), (left, 0), (right, 0), (length, 0.0)):
                a.append(v)
            if isinstance(t, tuple):
                column[at], cut[at] = t[0], t[1]
                left[at], right[at] = put(t[2]), put(t[3])
            else:
                length[at] = float(t)
            return at

        put(tree)
        return column, cut, left, right, length

    arrays = [tuple(np.array(a) for a in flat(t)) for t in forest]
    shared = df.sparkSession.sparkContext.broadcast(arrays)
    typical, k = usual(size), len(columns)

    def scored(batches):
        import pyarrow as pa

        for batch in batches:
            x = np.column_stack([batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(k)]) if len(batch) else np.zeros((0, k))
            total = np.zeros(len(x))
            for column, cut, left, right, length in shared.value:
                at = np.zeros(len(x), dtype=int)
                while (go := np.flatnonzero(column[at] >= 0)).size:
                    p = at[go]
                    at[go] = np.where(x[go, column[p]] < cut[p], left[p], right[p])
                total += length[at]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(2.0 ** (-total / len(shared.value) / typical))], [row, "score"])

    out = stage(rows.mapInArrow(scored, f"`{row}` {dict(df.dtypes)[row]}, score double"))
    found = quantiles(out, "score", [1 - contamination]).first()
    return out.withColumn("outlier", (F.col("score") > F.lit(found.q[0])).cast("int"))


def principal_components(df: DataFrame, columns: list[str], most: int = 10) -> dict:
    """Components of the correlation matrix after median imputation: explained shares and loadings."""
    at = quantiles_of(df, {c: F.col(f"`{c}`") for c in columns}, [0.5])
    medians = [value_at(at[c][1][0]) if c in at else None for c in columns]
    filled = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(m)).alias(c) for c, m in zip(columns, medians)])
    _, _, cov = covariance(filled, columns)
    s = np.sqrt(np.diag(cov))
    keep = s > 0
    value, vector = np.linalg.eigh(cov[np.ix_(keep, keep)] / np.outer(s[keep], s[keep]))
    order = np.argsort(-value)[:most]
    names = [c for c, k in zip(columns, keep) if k]
    return {"explained": (value[order] / value.sum()).tolist(), "loadings": [dict(zip(names, vector[:, i].tolist())) for i in order]}


def leaf_order(r: np.ndarray, names: list[str]) -> list[str]:
    """Columns in the order of average-linkage clusters of 1 - |r|; a small matrix, on the driver."""
    d = 1 - np.abs(r)
    clusters = [[i] for i in range(len(names))]
    while len(clusters) > 1:
        _, a, b = min((float(d[np.ix_(x, y)].mean()), i, j) for i, x in enumerate(clusters) for j, y in enumerate(clusters) if i < j)
        clusters = [*(c for k, c in enumerate(clusters) if k not in (a, b)), clusters[a] + clusters[b]]
    return [names[i] for i in clusters[0]] if clusters else []


def mcar_signals(df: DataFrame, columns: list[str], numeric: set[str], alpha: float = 0.001, least: float = 0.02) -> list[dict]:
    """Columns whose missingness goes with another column: Mann-Whitney for numbers, chi-square for levels (null is one); BH over all."""
    n = df.count()
    counts = df.agg(*[F.count(c) for c in columns]).first()
    out = []
    for c, filled in zip(columns, counts):
        rate = 1 - filled / n if n else 0
        if not least < rate < 1 - least:
            continue
        rows = df.withColumn("__lost", F.col(c).isNull().cast("int"))
        for other in columns:
            if other == c:
                continue
            if other in numeric:
                side = {r[0]: r[1] for r in rows.filter(F.col(other).isNotNull()).groupBy("__lost").count().collect()}
                got = mann_whitney(rows, other, "__lost", 0, 1) if min(side.get(0, 0), side.get(1, 0)) >= 5 else None
            else:
                few = rows.select(other).distinct().limit(21).count() <= 20
                got = categorical_test(rows.withColumn("__v", F.coalesce(F.col(other).cast("string"), F.lit("nan"))), "__lost", "__v") if few else None
            if got:
                out.append({"column": c, "other": other, "rate": rate, "p": got["p"]})
    for row, q in zip(out, dist.adjusted([r["p"] for r in out], "bh")):
        row["q"] = q
    return sorted((r for r in out if r["q"] < alpha), key=lambda r: (r["q"], r["column"], r["other"]))


def imputation_table(train: DataFrame, test: DataFrame, fitted: dict) -> list[dict]:
    """column, method, value, and missing rates on both sides, most missing in train first."""
    fills = {c: ("median" if fitted["policy"]["missing"]["numeric"] == "median" else "mean", s["fill"]) for c, s in fitted["numeric"].items()} | {c: ("most frequent", v) for c, v in fitted["mode"].items()}
    rate = lambda df: df.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("double")) for c in fills]).first()
    a, b = rate(train), rate(test)
    out = [{"column": c, "method": m, "value": v, "train": x, "test": y} for (c, (m, v)), x, y in zip(fills.items(), a, b)]
    return sorted(out, key=lambda r: -(r["train"] or 0))
