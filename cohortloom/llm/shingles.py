"""Sets of hashed word shingles of whole texts, and connected components of links; used by the near-duplicate operators."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.session import release, stage

WORDS = 5
SALT = 8
_rng = np.random.default_rng(20240517)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(0, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_JOIN = _rng.integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def scrambled(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word, letters A-Z in lower case."""
    code = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)  # bytes: A-Z only
    space = _SPACE[code]
    inside = np.flatnonzero(~space)
    if not len(inside):
        return np.zeros(0, dtype=np.uint64)
    first = np.flatnonzero(np.r_[True, np.diff(inside) > 1])
    length = np.diff(np.r_[first, len(inside)])
    at = np.arange(len(inside)) - np.repeat(first, length)
    value = _BYTE[code[inside]] * _PLACE[at & 4095] + (at >> 12).astype(np.uint64)
    return scrambled(np.add.reduceat(value, first) + length.astype(np.uint64))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of all runs of `words` words; of the whole sequence if it is shorter; empty without words."""
    w = word_hashes(text)
    if not len(w):
        return w
    n, k = max(len(w) - words + 1, 1), min(words, len(w))
    h = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        h = h + w[i : i + n] * _JOIN[i]
    return np.unique(scrambled(h))


def digest(found: np.ndarray) -> bytes:
    """128 bits of a whole set: equal for equal sets."""
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _least(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the smallest one that the links a - b connect it to."""
    top = np.arange(n)
    while True:
        low = np.minimum(top[a], top[b])
        new = top.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == top).all():
            return top
        top = new


def linked_rows(rep: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links a - b between members of a block (sorted by rep) -> of each member with links: rep, how many rows it links to
    by the sizes of its partners, and the smallest member it is connected to."""
    linked = np.bincount(a, size[b], len(rep)) + np.bincount(b, size[a], len(rep))
    used = np.flatnonzero(linked)
    return rep[used], linked[used].astype(np.int64), rep[_least(len(rep), a, b)[used]]


def components(links: DataFrame) -> DataFrame:
    """(a, b) links -> node, label: the smallest node that links reach from it.  Large-star and small-star rounds, all distributed."""
    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())

    def mark(df):
        return df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()

    def salted(many, one):
        """many joined with the one row of its u; a hub's rows are dealt over SALT tasks."""
        dealt = many.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALT)))
        return dealt.join(one.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long")))), ["u", "s"]).drop("s")

    was = mark(edges)
    while was[0]:
        before = edges
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        edges = salted(both.filter("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = stage(edges)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        near = salted(large, least)
        edges = stage(near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        release(before, large)
        now = mark(edges)
        if now == was:
            break
        was = now
    tops = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    out = stage(edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(tops))
    release(edges)
    return out
