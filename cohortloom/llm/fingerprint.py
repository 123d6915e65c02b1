"""Document fingerprints by a randomised embedding of edit distance into Hamming distance.

All texts walk under the same random bits: at step j on character c the walk writes c and moves on if the shared bit of
(c, j) is 1, else it writes c again.  (Characters share bits in CLASSES hashed classes, and bits repeat after PERIOD steps.)  Two
texts that differ by an edit fall into step again soon after it, so the written strings differ in few places.  A
fingerprint samples SLOTS places of the written string: each place belongs to a slot and
has a shared random rank, and a slot keeps the symbol (8 bits of a hash of the 3 characters there) of its best ranked place
within the string, so texts of nearly the same length keep nearly the same places.  Likeness is the share of slots with equal
symbols among those that either text fills, corrected for chance.

Bit-sampled banding finds near fingerprints: BANDS keys of WIDTH sampled symbols each; members of a band are verified against
each other on their whole fingerprints, that is by the Hamming distance that stands for their edit distance.  Equal fingerprints
are one class from the start; a band is worked off in blocks of BLOCK members, a pair in the first band it shares, and a
block gives one row for each member with links (how many documents, and the smallest member it is connected to), so common
bands don't make all their pairs.

Distribution: texts, compressed, go through one range shuffle by doc_id that brings each document next to its successor; rows
stream in order and only the last row of each partition waits for the first of the next one, found by a join of two rows a
partition.  Bands shuffle two numbers a key; fingerprints go only where a band has two members.

Odd rows: a null text is empty; an empty text fills no slot (likeness 1 to another empty text, else 0) and links with nothing;
null doc_ids sort first, equal doc_ids by a hash of the text; a table of one row has itself as the next document; repeated
rows are rows of their own and link with each other; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortloom.llm.shingles import components, linked_rows
from cohortloom.session import lean, ship, sized_join, stage

SLOTS = 128
CLASSES, PERIOD = 64, 4096
CONTEXT = 3
BANDS, WIDTH = 16, 4
BLOCK = 512
CUT = 0.8  # likeness of near fingerprints
EMPTY = ".."


def _steps() -> list[bytes]:
    """By class of character and step (mod PERIOD): how many symbols are written before the walk moves on."""
    bit = np.random.default_rng(8086).random((CLASSES, PERIOD)) < 0.5
    out = []
    for row in bit:
        ones = np.flatnonzero(np.r_[row, row])
        at = np.arange(PERIOD)
        out.append((ones[np.searchsorted(ones, at)] - at + 1).astype(np.uint8).tobytes())
    return out


STEPS = _steps()


def _hash(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Places:
    """For each slot the places that are its best ranked one in some longer and longer string, in order."""

    def __init__(self):
        self.upto, self.place, self.slot = 0, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.best = np.full(SLOTS, np.iinfo(np.uint64).max, dtype=np.uint64)

    def chosen(self, length: int) -> np.ndarray:
        while self.upto < length:
            h = _hash(np.arange(self.upto, self.upto + (1 << 16), dtype=np.uint64) + np.uint64(0x51ED270B))
            slot, rank = (h % np.uint64(SLOTS)).astype(np.int64), h >> np.uint64(7)
            found = []
            for s in range(SLOTS):
                at = np.flatnonzero(slot == s)
                low = np.minimum.accumulate(np.r_[self.best[s], rank[at]])
                found.append(at[low[1:] < low[:-1]])
                self.best[s] = low[-1]
            new = np.sort(np.concatenate(found))
            self.place, self.slot = np.r_[self.place, new + self.upto], np.r_[self.slot, slot[new]]
            self.upto += 1 << 16
        out = np.full(SLOTS, -1, dtype=np.int64)
        k = np.searchsorted(self.place, length)
        out[self.slot[:k]] = self.place[:k]  # the last one of a slot stays
        return out


PLACES = _Places()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def walk(code: np.ndarray, start: int = 0) -> tuple[list[int], int]:
    """Where in the written string each character begins, and where the string ends."""
    t, out, steps, mask = start, [], STEPS, PERIOD - 1
    put = out.append
    for c in (_hash(code.astype(np.uint64)) & np.uint64(CLASSES - 1)).astype(np.uint8).tobytes():
        put(t)
        t += steps[c][t & mask]
    return out, t


def sampled(code: np.ndarray, begins: np.ndarray, end: int) -> np.ndarray:
    """The symbol of each slot, -1 where the string has no place for it."""
    place = PLACES.chosen(end)
    filled = place >= 0
    out = np.full(SLOTS, -1, dtype=np.int16)
    if filled.any():
        at = np.searchsorted(begins, place[filled], side="right") - 1
        padded = np.r_[code, np.zeros(CONTEXT, dtype=np.uint32)].astype(np.uint64)
        h = np.zeros(len(at), dtype=np.uint64)
        for i in range(CONTEXT):
            h = h * np.uint64(0x100000001B3) + padded[at + i] + np.uint64(1)
        out[filled] = (_hash(h) >> np.uint64(56)).astype(np.int16)
    return out


def shown(symbols: np.ndarray) -> str:
    return "".join(EMPTY if s < 0 else f"{s:02x}" for s in symbols.tolist())


def read(shown: str) -> np.ndarray:
    return np.array([-1 if shown[i : i + 2] == EMPTY else int(shown[i : i + 2], 16) for i in range(0, len(shown), 2)], dtype=np.int16)


def fingerprint(text: str | None) -> str:
    code = code_points(text or "")
    begins, end = walk(code)
    return shown(sampled(code, np.array(begins), end))


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    used = (x >= 0) | (y >= 0)
    n = int(used.sum())
    if not n:
        return 1.0
    same = int((x == y)[used].sum())
    return max(0.0, (same / n - 1 / 256) / (1 - 1 / 256))


class _Document:
    """A document with what its successor's head must be put to."""

    def __init__(self, doc_id, text: str | None):
        self.doc_id, self.text = doc_id, text or ""
        self.code = code_points(self.text)
        begins, self.end = walk(self.code)
        self.begins = np.array(begins, dtype=np.int64)
        self.symbols = sampled(self.code, self.begins, self.end)

    def beside(self, following: _Document) -> tuple:
        n = len(self.text)
        m = n // 4
        if m:
            stay = n - m
            text = self.text[:stay] + following.text[:m]
            code = code_points(text)
            more, end = walk(code[stay:], int(self.begins[stay]))
            edited = sampled(code, np.r_[self.begins[:stay], np.array(more, dtype=np.int64)], end)
        else:
            text, edited = self.text, self.symbols
        digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
        return self.doc_id, n, digest, shown(self.symbols), shown(edited), likeness(self.symbols, edited), likeness(self.symbols, following.symbols)


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names)


def _stream(batches):
    """Rows in order -> finished rows, and the first (part 0) and last (part 1) row of the partition with their texts."""
    names, kinds = [*NAMES, "part", "pid", "text"], [*KINDS, pa.int32(), pa.int32(), pa.string()]
    pid, before, out, blank = TaskContext.get().partitionId(), None, [], (None,) * len(NAMES[1:])
    open_ = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for doc_id, packed in zip(batch.column("doc_id").to_pylist(), batch.column("packed").to_pylist()):
            now = _Document(doc_id, open_(packed).decode("utf-8", "surrogatepass"))
            out.append((*before.beside(now), None, None, None) if before else (doc_id, *blank, 0, pid, now.text))
            before = now
        yield _batch(out, names, kinds)
        out = []
    if before:
        yield _batch([(before.doc_id, *blank, 1, pid, before.text)], names, kinds)


def _finish(batches):
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "following")))
        yield _batch([_Document(i, t).beside(_Document(None, f)) for i, t, f in rows], NAMES, KINDS)


def _packed(batches):
    press = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        packed = [press((t or "").encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(packed, pa.binary())], ["doc_id", "h", "packed"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> the fingerprint of each text and of its edit by the next document, and their likenesses."""
    ship(docs.sparkSession)
    packed = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(lean(_packed), "doc_id long, h long, packed binary")
    ordered = packed.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "h", "packed").select("doc_id", "packed")
    made = stage(ordered.mapInArrow(lean(_stream), f"{COLUMNS}, part int, pid int, text string"))
    ends = made.filter("part IS NOT NULL").select("doc_id", "part", "pid", "text")
    # two rows a partition, without texts: which partition comes next; after the last one the first
    order = ends.filter("part = 0").select("pid")
    every = W.orderBy("pid").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    following = order.select("pid", F.coalesce(F.lead("pid").over(W.orderBy("pid")), F.min("pid").over(every)).alias("then"))
    heads = ends.filter("part = 0").select(F.col("pid").alias("then"), F.col("text").alias("following"))
    tails = ends.filter("part = 1").join(following, "pid").join(heads, "then").select("doc_id", "text", "following")
    return made.filter("part IS NULL").select(*NAMES).unionByName(tails.mapInArrow(lean(_finish), COLUMNS))


def symbols(shown: list[str]) -> np.ndarray:
    """Fingerprints as a matrix of symbols, -1 for unfilled slots."""
    code = np.frombuffer("".join(shown).encode(), dtype=np.uint8).astype(np.int16).reshape(len(shown), SLOTS, 2)
    digit = np.where(code >= 97, code - 87, code - 48)
    return np.where(code[:, :, 0] == ord(EMPTY[0]), -1, digit[:, :, 0] * 16 + digit[:, :, 1]).astype(np.int16)


def likenesses(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each row of symbols in x with each in y."""
    same = np.zeros((len(x), len(y)), dtype=np.int16)
    for a, b in zip(x.T, np.where(y < 0, -2, y).T):
        same += a[:, None] == b[None, :]
    fx, fy = (x >= 0).astype(np.float32), (y >= 0).astype(np.float32)
    used = fx.sum(1)[:, None] + fy.sum(1)[None, :] - fx @ fy.T
    return np.where(used > 0, np.maximum((same / np.maximum(used, 1) - 1 / 256) / (1 - 1 / 256), 0), 1.0)


def sampled_slots() -> np.ndarray:
    """The slots of each band."""
    return np.random.default_rng(77).permutation(SLOTS)[: BANDS * WIDTH].reshape(BANDS, WIDTH)


def _banded(batches):
    slots = sampled_slots()
    for batch in batches:
        if not len(batch):
            continue
        x = symbols(batch.column("fingerprint").to_pylist())
        keys, at = [], []
        for band, cols in enumerate(slots):
            part = x[:, cols]
            use = np.flatnonzero((part >= 0).any(1))
            h = np.full(len(use), band + 1, dtype=np.uint64)
            for c in part[use].T:
                h = _hash(h * np.uint64(0x9E3779B97F4A7C15) + (c + 2).astype(np.uint64))
            # the band is in the key's upper bits, so a key belongs to one band
            keys.append(((h >> np.uint64(6)) | np.uint64(band) << np.uint64(58)).view(np.int64))
            at.append(use)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), batch.column("rep").take(pa.array(np.concatenate(at)))], ["key", "rep"])


def _band_links(cut: float):
    """Rows sorted by (key, i, j) -> rep, linked, to, checked: one row for each member of a block that has links."""
    slots = sampled_slots()

    def worked(key, i, j, rep, block, size, x):
        band = key >> 58
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        ok = likenesses(x[left], x[right]) >= cut
        if i == j:
            ok &= np.triu(np.ones(ok.shape, dtype=bool), 1)
        a, b = np.nonzero(ok)
        a, b = left[a], right[b]
        for cols in slots[:band]:  # leave pairs that an earlier band has
            if not len(a):
                break
            p, q = x[a][:, cols], x[b][:, cols]
            new = (p != q).any(1) | (p < 0).all(1)
            a, b = a[new], b[new]
        return linked_rows(rep, size, a, b)

    def run(batches):
        rows, at = [], None

        def flush():
            if len(rows) > 1:
                got = worked(*at, *(np.array([r[c] for r in rows]) for c in ("rep", "block", "size")), symbols([r["fingerprint"] for r in rows]))
                if len(got[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], ["rep", "linked", "to"])

        for batch in batches:
            for r in batch.to_pylist():
                if at != (k := (r["key"], r["i"], r["j"])):
                    yield from flush()
                    rows, at = [], k
                rows.append(r)
        yield from flush()

    return run


def near_classes(prints: DataFrame, cut: float = CUT) -> DataFrame:
    """(doc_id, fingerprint) -> a, b (hashes of a fingerprint), near_links, near_class; only for fingerprints with links.

    near_links counts the other documents with a near or equal fingerprint, near_class is the smallest doc_id that links reach.
    """
    ship(prints.sparkSession)
    a, b = F.xxhash64("fingerprint"), F.xxhash64("fingerprint", F.lit(1))
    some = prints.filter(F.col("doc_id").isNotNull() & (F.col("fingerprint") != EMPTY * SLOTS))
    equal = some.groupBy(a.alias("a"), b.alias("b")).agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("size"), F.min("fingerprint").alias("fingerprint"))
    classes = stage(equal.withColumn("rep", F.monotonically_increasing_id()))
    banded = classes.select("rep", "fingerprint").mapInArrow(lean(_banded), "key long, rep long")
    sizes = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = banded.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("key", "rep", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).join(classes.select("rep", "size", "fingerprint"), "rep")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")
    links = stage(rows.mapInArrow(lean(_band_links(cut)), "rep long, linked long, to long"))
    each = links.groupBy("rep").agg(F.sum("linked").alias("linked"))
    labels = components(links.filter("rep <> to").select(F.col("rep").alias("a"), F.col("to").alias("b")))
    told = classes.select("a", "b", "rep", "low", "size").join(each, "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    told = told.select("a", "b", "low", (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("near_links"), F.coalesce("label", "rep").alias("label"))
    lowest = told.groupBy("label").agg(F.min("low").alias("near_class"))
    return stage(told.filter("near_links > 0").join(lowest, "label").select("a", "b", "near_links", "near_class"))


def with_near(prints: DataFrame, cut: float = CUT) -> DataFrame:
    """prints with near_links (0 if none) and near_class (its own doc_id if none)."""
    told = near_classes(prints, cut)
    alone = F.col("doc_id").isNull() | (F.col("fingerprint") == EMPTY * SLOTS)
    keyed = prints.withColumns({"a": F.when(~alone, F.xxhash64("fingerprint")), "b": F.when(~alone, F.xxhash64("fingerprint", F.lit(1)))})
    out = sized_join(keyed, told, ["a", "b"], "left").drop("a", "b")
    return out.withColumns({"near_links": F.coalesce("near_links", F.lit(0)).cast("long"), "near_class": F.coalesce("near_class", "doc_id")})


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_near(fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")))
