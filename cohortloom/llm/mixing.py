"""Mixing sources to target weights by cube-method balanced sampling.

Every document of a source is wanted r = target / size of the source times: floor(r) whole copies, and one more with
probability p = r - floor(r).  Which documents get the extra copy is decided by the cube method: the vector of
probabilities moves at random inside the null space of the balancing constraints (number of documents, number of words)
until all but a few entries are 0 or 1, so both totals of every source stay what they were.  The few units left, and HELD
units of all sizes that are kept out of a source's last flight, are landed by the subset whose word total is nearest:
a source's total is met closely, but those few units (at most HELD + 2 a source) don't keep their probability.

Distribution: rows are dealt to blocks of about BLOCK units inside each source, so a hot source is many tasks; a block
leaves at most FEW undecided units, which meet in the next, 128 times smaller level until a source is one block.  Only
(doc_id, size, source index) is shuffled, never the text.

Odd rows: a null text has size 0 and is never taken; a null source is a source of its own, last in order; repeated rows
are separate units; an empty table gives an empty result; extra columns are ignored by `mix` and kept by `mix_documents`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortloom.session import ship, sized_join, stage

WORD = r"[^\x20\x09-\x0D]+"
CAP = 3  # a source's target is at most CAP times its size
BLOCK = 1024
FEW = 6  # units a block leaves undecided, at most
HELD = 12  # units of all sizes kept out of a source's last flight, for the landing
UNITS = "src long, block long, blocks long, doc_id long, occ int, size long, copies long, p double"


def word_count(text):
    """Number of words of a text column, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def flight(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move p at random, keeping sum(p) and sum(p * size), until at most two entries lie strictly between 0 and 1."""
    p = p.copy()
    free = [i for i in range(len(p)) if 0.0 < p[i] < 1.0]
    if len(free) < 3:
        return p
    draw = iter(rng.random(len(free) * 2 + 8))
    s, q = size.tolist(), p.tolist()
    window, rest = free[:3], iter(free[3:])
    while len(window) == 3:
        a, b, c = window
        u = (s[c] - s[b], s[a] - s[c], s[b] - s[a])  # orthogonal to (1, 1, 1) and to the sizes
        if not any(u):
            u = (1, -1, 0)
        up = min((1 - q[k]) / v if v > 0 else q[k] / -v for k, v in zip(window, u) if v)
        down = min(q[k] / v if v > 0 else (1 - q[k]) / -v for k, v in zip(window, u) if v)
        step = up if next(draw) * (up + down) < down else -down
        left = []
        for k, v in zip(window, u):
            x = q[k] + step * v
            q[k] = 0.0 if x < 1e-9 else 1.0 if x > 1 - 1e-9 else x
            if 0.0 < q[k] < 1.0:
                left.append(k)
        if len(left) == 3:  # rounding only: fix the entry that is nearest to an end
            k = min(left, key=lambda i: min(q[i], 1 - q[i]))
            q[k] = float(round(q[k]))
            left.remove(k)
        window = left
        while len(window) < 3 and (k := next(rest, None)) is not None:
            window.append(k)
    return np.array(q)


def land(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decide the last few units: of all subsets the one nearest in words, then in number, then drawn."""
    p = p.copy()
    free = np.flatnonzero((p > 0) & (p < 1))
    if len(free):
        sets = (np.arange(1 << len(free))[:, None] >> np.arange(len(free))) & 1
        words = np.abs(sets @ size[free] - p[free] @ size[free])
        number = np.abs(sets.sum(1) - p[free].sum())
        p[free] = sets[np.lexsort((rng.random(len(sets)), number, words))[0]]
    return p


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x1234567) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _fly(seed: int, level: int):
    def run(table: pa.Table) -> pa.Table:
        src, block, blocks = (table[c][0].as_py() for c in ("src", "block", "blocks"))
        ids = table["doc_id"].fill_null(-1).to_numpy()
        occ, size, p = (table[c].to_numpy() for c in ("occ", "size", "p"))
        order = np.lexsort((occ, ids, _mixed(ids, seed), -size))
        rng = np.random.default_rng([seed, level, src, block])
        s, q = size[order], p[order]
        free = np.flatnonzero((q > 0) & (q < 1))
        held = np.unique(np.linspace(0, len(free) - 1, HELD if blocks == 1 else FEW - 2).astype(int)) if len(free) else free
        fly = np.delete(free, held)
        q[fly] = flight(s[fly], q[fly], rng)
        if blocks == 1:
            q = land(s, q, rng)
        back = np.empty_like(q)
        back[order] = q
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(back))

    return run


def source_targets(units: DataFrame) -> DataFrame:
    """(source, size) -> one row per source: src, source, source_size, n_docs, weight, num, den, target, capped.

    Weights 1, 2, 3 repeat over the sources by code point, null last.  num / den is the target as an exact fraction.
    """
    spark = units.sparkSession
    sums = units.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    ranked = sums.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex().map(lambda x: (x[1], x[0][0], x[0][1], x[0][2], x[1] % 3 + 1))
    table = stage(spark.createDataFrame(ranked, "src long, source string, source_size long, n_docs long, weight long"))
    big = lambda c: F.col(c).cast("decimal(38,0)")
    total, left_w = table.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    rest, over = total, F.lit(False)
    while left_w:
        over = big("source_size") * F.lit(CAP * left_w).cast("decimal(19,0)") <= F.lit(rest).cast("decimal(19,0)") * F.col("weight").cast("decimal(10,0)")
        used, w = table.agg(F.coalesce(F.sum(F.when(over, CAP * F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))).first()
        if w == left_w:
            break
        rest, left_w = total - used, w
    return table.withColumns({
        "capped": over,
        "num": F.when(over, CAP * F.col("source_size")).otherwise(F.lit(rest) * F.col("weight")),
        "den": F.when(over, F.lit(1)).otherwise(F.lit(max(left_w, 1))).cast("long"),
    }).withColumn("target", F.col("num").cast("double") / F.col("den").cast("double"))


def mix(units: DataFrame, seed: int = 7) -> DataFrame:
    """(doc_id, source, size[, occ]) -> doc_id, occ, source, size, source_size, target, copies, taken."""
    spark = units.sparkSession
    ship(spark)
    if "occ" not in units.columns:
        units = units.withColumn("occ", F.lit(0))
    sources = stage(source_targets(units))
    n = sources.agg(F.coalesce(F.max("n_docs"), F.lit(0))).first()[0]
    per = F.when(F.col("source_size") > 0, (F.col("num") / (F.col("den") * F.col("source_size"))).cast("double")).otherwise(0.0)
    whole = F.when(F.col("capped"), F.lit(CAP)).when(F.col("source_size") > 0, F.floor(per)).otherwise(0).cast("long")
    plan = sources.select("src", "source", "source_size", "target", F.ceil(F.col("n_docs") / BLOCK).alias("blocks"), whole.alias("copies"), F.when(F.col("capped") | (F.col("source_size") == 0), 0.0).otherwise(per - F.floor(per)).alias("p"))
    rows = sized_join(units.select("doc_id", "occ", "source", "size"), plan.select("source", "src", "blocks", "copies", "p"), ["source"])
    rows = rows.withColumns({"p": F.when(F.col("size") > 0, F.col("p")).otherwise(0.0), "copies": F.when(F.col("size") > 0, F.col("copies")).otherwise(F.lit(0).cast("long"))})
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.col("doc_id"), F.col("occ"), F.lit(seed)), F.col("blocks")))
    rows, done, level, most = rows.select(*[x.split()[0] for x in UNITS.split(", ")]), [], 0, -(-n // BLOCK)
    while True:
        flown = stage(rows.groupBy("src", "block").applyInArrow(_fly(seed, level), UNITS))
        done.append(flown.filter((F.col("p") == 0) | (F.col("p") == 1)))
        if most <= 1:
            break
        half = BLOCK // (FEW + 2)
        rows = flown.filter((F.col("p") > 0) & (F.col("p") < 1)).withColumns({"block": F.floor(F.col("block") / half), "blocks": F.ceil(F.col("blocks") / half)})
        most, level = -(-most // half), level + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    out = out.select("src", "doc_id", "occ", "size", (F.col("copies") + F.col("p").cast("long")).alias("copies"))
    out = sized_join(out, plan.select("src", "source", "source_size", "target"), ["src"])
    return out.select("doc_id", "occ", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; the columns stay as they are."""
    if {"__size", "__occ", "__n"} & set(docs.columns):
        raise ValueError("columns __size, __occ and __n are reserved")
    full = docs.withColumn("__size", word_count(F.col("text")))
    n, ids = docs.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    if n == ids:
        full = full.withColumn("__occ", F.lit(0))
    else:  # repeated ids: tell their rows apart, whatever partition they come from
        full = full.withColumn("__occ", F.row_number().over(W.partitionBy("doc_id").orderBy(F.xxhash64("source", "text"), *docs.columns)).cast("int"))
    units = full.select("doc_id", F.col("__occ").alias("occ"), "source", F.col("__size").alias("size"))
    taken = mix(units, seed).filter("copies > 0").select(F.col("doc_id").alias("__id"), F.col("occ").alias("__o"), F.col("copies").alias("__n"))
    out = full.join(taken, full["doc_id"].eqNullSafe(taken["__id"]) & (full["__occ"] == taken["__o"]))
    return out.withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n")))).select(*docs.columns)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = mix(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies", "source")
