"""Embedding near-duplicates with randomised-rotation binary codes and stored correction factors.

A unit vector x is rotated by m seeded random orthogonal matrices; its code s holds the sign of each coordinate of each rotation,
and the stored correction factor is F = <s, rotated x>.  The other vector y of a pair stays as it is: with z = s rotated back
and summed over the rotations, <z, y> / F is an unbiased estimate of the cosine.  Its error comes only from the part of y that
is orthogonal to x, which a random rotation turns anywhere: at cosine c the standard error is sqrt(1 - c * c) * S with the
second stored number S = sqrt(sum(1 - f_k ** 2) / (d - 1)) / sum(f_k), f_k being the factor of rotation k alone.  Only pairs
whose estimate reaches the threshold less SURE standard errors at the threshold are computed again, exactly, in double precision.

Candidates: a table keys a vector by some bits of its code; vectors at cosine 0.95 agree in a bit with probability 0.9.
There are as many rotations as it takes that no bit serves two tables, so also in few dimensions; `tables` raises bits
and tables with the number of vectors, so that buckets stay short and a pair at the threshold shares no key with probability MISS.
A pair is worked on only in the first table it shares.

Equal vectors are one class from the start.  A bucket is worked off in blocks of BLOCK members; a block gives one row for
each member that has links: how many vectors it links to, and the smallest member it is connected to inside the
block.  So a dense group of n vectors makes rows in proportion to n (and, in its buckets, to its blocks), not n * n pairs.

Odd rows: a vector that is null, zero, empty or holds a null or non-finite component links with nothing; so does one of
another length than its partner; a null vec_id has a null component and is kept; repeated rows are vectors of their own and
count as links; where one vec_id has different vectors, each links on its own and its row has that vector's links; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm.shingles import components, linked_rows
from cohortloom.session import lean, ship, stage

AGREE = 0.9  # that two vectors agree in a bit, hardly ever less at the threshold 0.95
MISS = 2e-4
LEAST_BITS = 14
BLOCK = 512
SURE = 5.0  # standard errors of the confidence bound
COSINE = 0.95


def tables(n: int) -> tuple[int, int]:
    """How many tables of how many bits for n vectors."""
    bits = max(LEAST_BITS, math.ceil(math.log2(max(n, 1))) - 2)
    return math.ceil(math.log(MISS) / math.log1p(-(AGREE**bits))), bits


@functools.cache
def rotations(d: int, count: int) -> np.ndarray:
    """count random orthogonal d x d matrices, one below the other."""
    out = []
    for k in range(count):
        q, r = np.linalg.qr(np.random.default_rng([4711, d, k]).standard_normal((d, d)))
        out.append(q * np.sign(np.diag(r)))
    return np.vstack(out)


def turns(d: int, shape: tuple[int, int]) -> int:
    return -(-shape[0] * shape[1] // d)


@functools.cache
def sampled_bits(d: int, shape: tuple[int, int]) -> np.ndarray:
    """The bits of a code that key each table."""
    return np.random.default_rng(99 + d).permutation(turns(d, shape) * d)[: shape[0] * shape[1]].reshape(shape)


def coded(x: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of unit vectors -> sign bits of m rotations (bool), the correction factors and the errors S."""
    d = x.shape[1]
    y = x @ rotations(d, m).T
    f = np.abs(y).reshape(len(x), m, d).sum(2) / math.sqrt(d)
    return y > 0, f.sum(1) * math.sqrt(d), np.sqrt(np.maximum(1 - f * f, 0).sum(1) / max(d - 1, 1)) / f.sum(1)


def estimates(bit: np.ndarray, factor: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated cosines of each coded vector with each row of y."""
    d = y.shape[1]
    z = (2.0 * bit - 1) @ rotations(d, bit.shape[1] // d)
    return (z / factor[:, None]) @ y.T


def floor(error: np.ndarray, cosine: float) -> np.ndarray:
    """What an estimate must reach for its pair to be computed again."""
    return cosine - SURE * math.sqrt(1 - cosine * cosine) * error


def unit(v) -> np.ndarray | None:
    """The vector at length one, in double precision; None if it can't link."""
    a = v.values.to_numpy(zero_copy_only=False).astype(np.float64) if v.is_valid else np.zeros(0)
    if not len(a) or not np.isfinite(a).all() or not (most := np.abs(a).max()) > 0:
        return None
    a = a / most
    return a / np.linalg.norm(a)


def _classes(batches):
    """Digest and unit vector of each row that can link."""
    for batch in batches:
        ids, n = batch.column(0), len(batch)
        d, digest, vector = [None] * n, [None] * n, [None] * n
        for k, v in enumerate(batch.column(1)):
            if ids[k].is_valid and (a := unit(v)) is not None:
                d[k], vector[k] = len(a), a.tobytes()
                digest[k] = hashlib.blake2b(v.values.to_numpy(zero_copy_only=False).tobytes(), digest_size=16).digest()
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(v, t) for v, t in ((d, pa.int32()), (digest, pa.binary()), (vector, pa.binary())))], ["vec_id", "d", "digest", "vector"])


def _read(vectors: list[bytes], d: int) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), dtype=np.float64).reshape(len(vectors), d)


def _keyed(shape: tuple[int, int]):
    def run(batches):
        for batch in batches:
            d, vectors, reps = (batch.column(c) for c in ("d", "vector", "rep"))
            d, vectors = d.to_numpy(), vectors.to_pylist()
            for size in np.unique(d).tolist():
                at = np.flatnonzero(d == size)
                bit, _, _ = coded(_read([vectors[k] for k in at], size), turns(size, shape))
                key = np.concatenate([bit[:, cols] @ (1 << np.arange(len(cols))) for cols in sampled_bits(size, shape)])
                t = np.repeat(np.arange(shape[0], dtype=np.int32), len(at))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), size, np.int32)), pa.array(t), pa.array(key), reps.take(pa.array(np.tile(at, shape[0])))], ["d", "t", "key", "rep"])

    return run


def _linked(cosine: float, shape: tuple[int, int]):
    """Rows sorted by (d, t, key, i, j) -> rep, linked, to: one row for each member of a block that has links."""

    def worked(at, rep, block, size, x):
        d, t, _, i, j = at
        bit, factor, error = coded(x, turns(d, shape))
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        ok = estimates(bit[left], factor[left], x[right]) >= floor(error[left], cosine)[:, None]
        if i == j:
            ok &= np.triu(np.ones(ok.shape, dtype=bool), 1)
        a, b = np.nonzero(ok)
        a, b = left[a], right[b]
        for cols in sampled_bits(d, shape)[:t]:  # leave pairs that an earlier table has
            if not len(a):
                break
            new = (bit[a][:, cols] != bit[b][:, cols]).any(1)
            a, b = a[new], b[new]
        near = np.concatenate([(x[a[k : k + 4096]] * x[b[k : k + 4096]]).sum(1) >= cosine for k in range(0, len(a), 4096)]) if len(a) else np.zeros(0, dtype=bool)
        checked = len(a)
        return *linked_rows(rep, size, a[near], b[near]), checked

    def run(batches):
        rows, at = [], None

        def flush():
            if len(rows) > 1:
                got = worked(at, *(np.array([r[c] for r in rows]) for c in ("rep", "block", "size")), _read([r["vector"] for r in rows], at[0]))
                if len(got[0]):
                    checked = np.zeros(len(got[0]), dtype=np.int64)
                    checked[0] = got[3]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*got[:3], checked)], ["rep", "linked", "to", "checked"])

        for batch in batches:
            for r in batch.to_pylist():
                if at != (k := (r["d"], r["t"], r["key"], r["i"], r["j"])):
                    yield from flush()
                    rows, at = [], k
                rows.append(r)
        yield from flush()

    return run


def block_links(classes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(rep, d, size, vector) -> rep, linked, to, checked; a staged table.  `checked` sums to the pairs computed exactly."""
    ship(classes.sparkSession)
    shape = tables(classes.count())
    keyed = classes.select("d", "vector", "rep").mapInArrow(lean(_keyed(shape)), "d int, t int, key long, rep long")
    sizes = keyed.groupBy("d", "t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = keyed.join(sizes, ["d", "t", "key"]).withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("t", "key", "rep", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).join(classes, "rep")
    order = ["d", "t", "key", "i", "j"]
    return stage(rows.repartition(*order).sortWithinPartitions(*order, "rep").mapInArrow(lean(_linked(cosine, shape)), "rep long, linked long, to long, checked long"))


def numbered(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id, embedding) -> the rows with their digests, and the classes of equal vectors, numbered."""
    ship(vectors.sparkSession)
    vectors = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    made = stage(vectors.mapInArrow(lean(_classes), "vec_id long, d int, digest binary, vector binary"))
    equal = made.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("size"), F.min("d").alias("d"), F.min("vector").alias("vector"))
    return made, stage(equal.withColumn("rep", F.monotonically_increasing_id()))


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, embedding) -> vec_id, n_links, component_id, kept; one row for each row of vectors."""
    made, classes = numbered(vectors)
    links = block_links(classes.select("rep", "d", "size", "vector"), cosine)
    each = links.groupBy("rep").agg(F.sum("linked").alias("linked"))
    labels = components(links.filter("rep <> to").select(F.col("rep").alias("a"), F.col("to").alias("b")))
    told = classes.select("digest", "rep", "low", "size").join(each, "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    told = told.select("digest", "low", (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("label", "rep").alias("label"))
    lowest = told.groupBy("label").agg(F.min("low").alias("component_id"))
    told = told.join(lowest, "label").select("digest", "n_links", "component_id")
    out = made.select("vec_id", "digest").join(told, "digest", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP10_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
    AND len(list_filter(embedding, lambda v: v <> 0)) > 0
), pairs AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM good x JOIN good y ON x.vec_id < y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.95
), links AS (
  SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reach AS (
  SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.r
), tops AS (
  SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id
), counts AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, component_id = e.vec_id AS kept
FROM embeddings e JOIN tops USING (vec_id) LEFT JOIN counts ON a = e.vec_id
"""
