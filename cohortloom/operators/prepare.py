"""Splitting and leak-proof preparation: statistics are learnt on train rows only; a fitted preparation is one projection."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from cohortloom.functions.numeric import binary, ordinal
from cohortloom.operators.places import cumulated, quantiles_of, value_at
from cohortloom.operators.profile import beside

MOST_LEVELS = 10_000  # of a category


class LeakageError(RuntimeError):
    """Something would have been learnt from rows that must not be seen."""


@dataclass(frozen=True)
class SplitFrame:
    """A frame that knows which side of a split it is."""

    df: DataFrame
    kind: str


def split_random(df: DataFrame, row: str, test: float = 0.25, stratify: str | None = None, seed: int = 0) -> DataFrame:
    """df with _split: in each stratum the round(n * test) rows that come first by a seeded hash of their id are test.

    The last hash that is still test is found by counting, stratum by stratum; rows that repeat an id stay together.
    """
    keys, h = [stratify] if stratify else [], F.xxhash64(F.lit(seed), F.col(row))
    taken = F.round(F.col("n") * test)
    ranked = cumulated(df, h, keys, near=lambda n: [F.greatest(F.round(n * test) - 1, F.lit(0.0))])
    last = ranked.groupBy(*keys).agg(F.max(F.when(F.col("upto") - F.col("ties") < taken, F.col("value"))).alias("__last"))
    out = beside(df, last, keys, "left")
    return out.withColumn("_split", F.when(h <= F.col("__last"), "test").otherwise("train")).drop("__last")


def split_group(df: DataFrame, group: str, test: float = 0.25, seed: int = 0) -> DataFrame:
    """df with _split: whole groups go to test by a seeded hash; no group is on both sides."""
    part = F.pmod(F.xxhash64(F.lit(seed), F.col(group)), F.lit(1_000_000))
    return df.withColumn("_split", F.when(part < int(test * 1_000_000), "test").otherwise("train"))


def split_time(df: DataFrame, time: str, row: str, test: float = 0.25) -> DataFrame:
    """df with _split: the last round(n * test) rows by time are test, at least one; rows without a time count as last."""
    # the border is found by counting times, and inside the border's time by counting ids; nothing is sorted as a whole
    kind = dict(df.dtypes)[time]
    at = F.unix_date(time).cast("long") if kind == "date" else F.unix_micros(F.col(time).cast("timestamp")) if kind.startswith("timestamp") else F.col(time).cast("double")
    early = F.coalesce(-at, F.lit(-(2**62)).cast(("double" if kind not in ("date",) and not kind.startswith("timestamp") else "long")))
    late = F.greatest(F.lit(1), F.round(F.col("n") * test))
    border = cumulated(df, early).filter(F.col("upto") - F.col("ties") < late).orderBy(F.desc("upto")).limit(1).select("value", (late - F.col("upto") + F.col("ties")).alias("rest")).first()
    if border is None:
        return df.withColumn("_split", F.lit("train"))
    inside = df.filter(early == F.lit(border.value))
    if dict(df.dtypes)[row] in ("tinyint", "smallint", "int", "bigint", "double", "float"):
        last = cumulated(inside, -F.col(row)).filter(F.col("upto") - F.col("ties") < border.rest).agg(F.max("value")).first()[0]
        first = -F.col(row) <= F.lit(last)
    else:
        last = inside.select(row).orderBy(F.desc(row)).limit(int(border.rest)).agg(F.min(row)).first()[0]
        first = F.col(row) >= F.lit(last)
    return df.withColumn("_split", F.when((early < F.lit(border.value)) | ((early == F.lit(border.value)) & first), "test").otherwise("train"))


def folds(df: DataFrame, key: str, k: int = 5, seed: int = 0) -> DataFrame:
    """df with _fold 0 .. k - 1, by a hash of key: rows of one key share a fold."""
    return df.withColumn("_fold", F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(k)).cast("int"))


def fold_summary(df: DataFrame, outcome: str, fold: str = "_fold") -> DataFrame:
    return df.groupBy(fold).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(outcome).cast("double")).alias("rate")).orderBy(fold)


def sides(df: DataFrame) -> tuple[SplitFrame, SplitFrame]:
    return tuple(SplitFrame(df.filter(F.col("_split") == k).drop("_split"), k) for k in ("train", "test"))


def entity_overlap(df: DataFrame, entity: str) -> DataFrame:
    """Entities that are on both sides."""
    return df.groupBy(entity).agg(F.count_distinct("_split").alias("s")).filter("s > 1").select(entity)


def only_in_test(df: DataFrame, column: str) -> DataFrame:
    """Levels of a column that train rows don't have."""
    t = lambda k: df.filter((F.col("_split") == k) & F.col(column).isNotNull()).select(column).distinct()
    return t("test").join(t("train"), column, "left_anti")


def balance(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, smd of train - test for numeric columns, in one aggregate."""
    train = F.col("_split") == "train"
    out = []
    for c in columns:
        x = F.col(c).cast("double")
        a, b = F.when(train, x), F.when(~train, x)
        out.append(F.struct(F.lit(c).alias("column"), F.try_divide(F.avg(a) - F.avg(b), F.sqrt((F.var_samp(a) + F.var_samp(b)) / 2)).alias("smd")))
    return df.agg(F.array(*out).alias("x")).select(F.explode("x").alias("x")).select("x.*")


POLICY = {
    "outlier": {"method": "iqr", "fold": 1.5, "z": 3.0, "low": 0.01, "high": 0.99},
    "missing": {"numeric": "median", "indicator": False},
    "encode": {"min_frequency": 0.01},
    "scale": "standard",
}


def merged(base: dict, over: dict | None) -> dict:
    """Deep merge: a setting that isn't named keeps its default."""
    return {k: merged(v, (over or {}).get(k)) if isinstance(v, dict) else (over or {}).get(k, v) for k, v in base.items()} | {k: v for k, v in (over or {}).items() if k not in base}


@dataclass
class Preparation:
    """Numeric columns: clip, impute, scale; ordinal: impute, index; binary: map, impute; nominal: impute, one-hot, first level left out."""

    numeric: list[str] = field(default_factory=list)
    ordinal: dict[str, list[str]] = field(default_factory=dict)
    binary: dict[str, tuple[list[str], list[str]]] = field(default_factory=dict)
    nominal: list[str] = field(default_factory=list)
    policy: dict = field(default_factory=dict)
    fitted: dict | None = None

    def fit(self, frame: SplitFrame) -> Preparation:
        """Two jobs for all numeric columns (three for the MAD), one count of levels for each other column; never on test
        or streaming rows.  A column of over MOST_LEVELS levels is refused."""
        if frame.kind != "train":
            raise LeakageError(f"fit on {frame.kind} rows")
        if frame.df.isStreaming:
            raise LeakageError("fit needs a bounded frame")
        df, p = frame.df, merged(POLICY, self.policy)
        if lost := {*self.numeric, *self.ordinal, *self.binary, *self.nominal} - {*df.columns}:
            raise ValueError(f"no columns {sorted(lost)}")
        out: dict = {"numeric": {}, "mode": {}, "levels": {}, "policy": p}
        o = p["outlier"]
        # one job for the places of all numeric columns (a second one for the MAD), one for their moments
        x = {c: F.col(c).cast("double") for c in self.numeric}
        at = quantiles_of(df, x, [0.25, 0.5, 0.75, o["low"], o["high"]])
        limits = {c: (float("-inf"), float("inf")) for c in x}
        far = quantiles_of(df, {c: F.abs(x[c] - F.lit(value_at(at[c][1][1]))) for c in at}, [0.5]) if o["method"] == "mad" else {}
        for c, (n, q) in at.items():
            a, m, b, low, high = map(value_at, q)
            d = 1.4826 * o["z"] * value_at(far[c][1][0]) if far else 0.0
            found = {"iqr": (a - o["fold"] * (b - a), b + o["fold"] * (b - a), b - a), "mad": (m - d, m + d, d), "quantile": (low, high, 1.0)}.get(o["method"])
            if found and n >= 4 and found[2] > 0:
                limits[c] = found[:2]
        aggs = [f for c in x for f in moments_of(clip(x[c], *limits[c]), x[c])]
        first = df.agg(F.count(F.lit(1)), *aggs).first() if aggs else [0]
        for i, c in enumerate(self.numeric):
            n, mean, var, lo, hi, clipped = first[1 + 6 * i : 7 + 6 * i]
            # clipping keeps the order, so quantiles of clipped values come from clipped neighbours
            q = [value_at(Row(low=held(v.low, *limits[c]), high=held(v.high, *limits[c]), part=v.part)) for v in at[c][1][:3]] if c in at else [None] * 3
            fill = q[1] if p["missing"]["numeric"] == "median" else mean
            total, lost = first[0], first[0] - n
            centre, width = 0.0, 1.0
            if n:
                both = (n * mean + lost * fill) / total
                spread = (n * (var + (mean - both) ** 2) + lost * (fill - both) ** 2) / total
                centre, width = {"standard": (both, math.sqrt(max(spread, 0.0))), "robust": (q[1], q[2] - q[0]), "minmax": (lo, hi - lo), "none": (0.0, 1.0)}[p["scale"]]
            out["numeric"][c] = {"low": limits[c][0], "high": limits[c][1], "fill": fill, "centre": centre or 0.0, "width": width or 1.0, "clipped": clipped / n if n else 0.0}
        for c in [*self.ordinal, *self.binary, *self.nominal]:
            counts = df.filter(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).count().orderBy(F.desc("count"), "v").limit(MOST_LEVELS + 1).collect()
            if len(counts) > MOST_LEVELS:
                raise ValueError(f"{c} has over {MOST_LEVELS} levels")
            out["mode"][c] = counts[0].v if counts else None
            if c in self.nominal:
                total = sum(r["count"] for r in counts) or 1
                often = sorted(r.v for r in counts if r["count"] / total >= p["encode"]["min_frequency"])
                out["levels"][c] = {"kept": often, "rare": len(often) < len(counts)}
        self.fitted = out
        return self

    def transform(self, df: DataFrame | SplitFrame, keep: list[str] = []) -> DataFrame:  # noqa: B006
        """One projection, so it runs on streaming frames as well."""
        if self.fitted is None:
            raise LeakageError("transform before fit")
        df = df.df if isinstance(df, SplitFrame) else df
        f, cols = self.fitted, [F.col(c) for c in keep]
        for c in self.numeric:
            s = f["numeric"][c]
            x = F.coalesce(clip(F.col(c).cast("double"), s["low"], s["high"]), F.lit(s["fill"]).cast("double"))
            cols.append(((x - F.lit(s["centre"])) / F.lit(s["width"])).alias(c))
            if f["policy"]["missing"]["indicator"]:
                cols.append(F.col(c).isNull().cast("int").alias(f"{c}__missing"))
        filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(f["mode"][c]))
        cols += [ordinal(filled(c), levels).alias(c) for c, levels in self.ordinal.items()]
        cols += [binary(filled(c), *m).alias(c) for c, m in self.binary.items()]
        for c in self.nominal:
            kept, rare = f["levels"][c]["kept"], f["levels"][c]["rare"]
            for level in kept[1:]:
                cols.append((filled(c) == level).cast("int").alias(f"{c}={level}"))
            if rare:
                cols.append((~filled(c).isin(kept)).cast("int").alias(f"{c}=(rare)"))
        return df.select(*cols)

    def clip_shift(self, df: DataFrame) -> list[dict]:
        """column, rate of clipped values, rate in train; most clipped first."""
        s = self.fitted["numeric"]
        r = df.agg(*[x for c, v in s.items() for x in (F.count(c), F.count_if((F.col(c) < v["low"]) | (F.col(c) > v["high"])))]).first()
        rows = [{"column": c, "rate": r[2 * i + 1] / r[2 * i] if r[2 * i] else 0.0, "train": v["clipped"]} for i, (c, v) in enumerate(s.items())]
        return sorted((x for x in rows if x["rate"] > 0), key=lambda x: -x["rate"])

    def reference_levels(self) -> list[dict]:
        """column, reference: the level that stands for 0 of a binary column, or that one-hot coding leaves out."""
        out = [{"column": c, "reference": (zeros[0] if zeros else None)} for c, (_, zeros) in self.binary.items()]
        return out + [{"column": c, "reference": self.fitted["levels"][c]["kept"][0] if self.fitted["levels"][c]["kept"] else None} for c in self.nominal]

    def to_json(self) -> str:
        return json.dumps(self.__dict__, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Preparation:
        return cls(**json.loads(text))


def held(x: float, low: float, high: float) -> float:
    return min(max(x, low), high)


def moments_of(x: Column, raw: Column) -> list[Column]:
    """count, mean, variance, least and greatest of clipped values, and how many were clipped."""
    return [F.count(x), F.avg(x), F.var_pop(x), F.min(x), F.max(x), F.count_if(raw != x)]


def clip(x: Column, low: float, high: float) -> Column:
    """Limits that let NULL pass."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def row_overlap(fitted: DataFrame, df: DataFrame, row: str) -> dict:
    """overlap, n: rows of df that the preparation was fitted on; all or none is fine, a part of them is a warning."""
    overlap, n = df.join(fitted.select(row).distinct(), row, "left_semi").count(), df.count()
    return {"overlap": overlap, "n": n, "warning": f"{overlap} of {n} rows were fitted on" if 0 < overlap < n else None}


def leak_check(df: DataFrame, row: str, features: list[str], outcome: str, entity: str | None = None) -> list[dict]:
    """What could leak, with its count: each row should be 0."""
    both = df.groupBy(row).agg(F.count_distinct("_split").alias("s")).filter("s > 1").count()
    out = [{"check": "rows on both sides", "found": both}, {"check": "outcome among features", "found": int(outcome in features)}, {"check": "id among features", "found": int(row in features)}]
    if entity:
        out.append({"check": "entities on both sides", "found": entity_overlap(df, entity).count()})
    return out
