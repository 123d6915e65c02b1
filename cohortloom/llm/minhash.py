"""MinHash near-duplicates with bottom-k sketches from one hash function.

A document's sketch is the K smallest hashes of its shingle set (the whole set if it is smaller).  Inverted lists are keyed
by runs of neighbouring retained values (5 of them; 3 in small sets): two sets of the wanted likeness share such a run with
near certainty (all but 1e-8 of the pairs right at 0.85, every pair of sets of up to K shingles), while sets that share just
a common passage mostly don't, so lists stay short.  Overlapping sets are filtered by the estimate from the union of both
sketches and verified by exact Jaccard on their full sets.

The aim is components, so a list is not expanded: each set is first verified against one pivot, the smallest id of its
lists; then, in lists that still hold several components, each component's best estimated pair with another one, again
and again while they find links; at last every remaining pair of different components that passes the estimate.  A pair is
verified once, and a component without a pair that passes in a list leaves it, since merged components leave it fewer pairs.  Long
lists around one class are gathered to one list, since near copies share many; a long list is worked off in blocks of BLOCK
members or, beyond SIDES of them, in SIDES blocks, so it makes rows in proportion to its members.  Equal sets are one class from the start, by digest, so thousands of copies are one member of one list.

Distribution: one pass over the texts makes sketches (about 0.8 kB a document); lists are formed by a hash aggregate with
partial sums and an equi-join (adaptive skew handling), full sets are fetched only for sets in candidate pairs.

Odd rows: a null, empty or blank text has 0 shingles and is its own component; so is a row with a null doc_id (component
null, kept); equal rows that repeat a doc_id are copies; where one doc_id has different texts, each text links on its own
and its row has that text's component; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm.shingles import components, digest, scrambled, shingle_set
from cohortloom.session import lean, release, settle, ship, sized_join, stage

SKETCH = 256  # retained values of a set
K = 96  # of these, those that key inverted lists
SMALL, MIDDLE = 32, 24  # sets up to SMALL key short runs, sets from MIDDLE on key long runs
BLOCK = 512
SIDES = 16  # blocks of a list at most: each member is sent that often, larger blocks are compared BLOCK by BLOCK
COLUMNS = 2048  # shared values compared at once: the memory of a block
PARTNERS = 64  # pairs of a class that one copy of its set serves
PERCENT = 85


def runs(percent: int) -> tuple[int, int]:
    """Lengths of long and short runs, so that sets of this likeness share one."""
    return (5, 3) if percent >= 85 else (4, 2)


def run_keys(sketch: np.ndarray, n: int, percent: int) -> np.ndarray:
    """The inverted lists that a set of n shingles is in, sorted as the signed numbers they travel as."""
    out = []
    for size, use in zip(runs(percent), (n >= MIDDLE, n <= SMALL)):
        if use:
            size = min(size, len(sketch))
            h = np.full(len(sketch) - size + 1, size, dtype=np.uint64)
            for i in range(size):
                h = h * np.uint64(0x9E3779B97F4A7C15) + sketch[i : i + len(h)]
            out.append(scrambled(h))
    return np.unique(np.concatenate(out).view(np.int64))


def union_estimate(x: np.ndarray, nx: int, y: np.ndarray, ny: int) -> float:
    """Jaccard of two sets from the part of their sketches up to where both are complete."""
    top = min(int(s[-1]) if n > len(s) else 2**32 for s, n in ((x, nx), (y, ny)))
    x, y = x[x <= top], y[y <= top]
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def retained(found: np.ndarray, k: int = SKETCH) -> np.ndarray:
    """The k smallest hashes of a sorted set, by their upper halves."""
    return (found[:k] >> np.uint64(32)).astype(np.uint32)


def _sketches(k: int):
    def run(batches):
        for batch in batches:
            n, d, s = [], [], []
            for t in batch.column("text").to_pylist():
                found = shingle_set(t)
                n.append(len(found))
                d.append(digest(found))
                s.append(retained(found, k).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(d, pa.binary()), pa.array(s, pa.binary())], ["doc_id", "text_hash", "n", "digest", "sketch"])

    return run


def _keys(percent: int):
    def run(batches):
        for batch in batches:
            keys, which = [], []
            for rep, n, s in zip(*(batch.column(c).to_pylist() for c in ("rep", "n", "sketch"))):
                keys.append(run_keys(np.frombuffer(s, dtype=np.uint32)[:K].astype(np.uint64), n, percent))
                which.append(np.full(len(keys[-1]), rep, dtype=np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(which))], ["key", "rep"])

    return run


def _sets(batches):
    for batch in batches:
        reps, chunks, sets = [], [], []
        for t, d, r, c in zip(*(batch.column(c).to_pylist() for c in ("text", "digest", "rep", "chunks"))):
            found = shingle_set(t)
            if digest(found) == d:
                reps.append(r)
                chunks.append(c)
                sets.append(found.view(np.int64))
        if reps:
            offsets = np.cumsum([0] + [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(chunks, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(sets)))], ["rep", "chunks", "shingles"])


def shared(sketches: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many values each sketch of left shares with each of right: products of membership matrices, COLUMNS values at once."""
    value, seen = np.unique(np.concatenate(sketches), return_inverse=True)
    common = np.bincount(seen) > 1
    column = np.cumsum(common) - 1
    row = np.repeat(np.arange(len(sketches), dtype=np.int32), [len(s) for s in sketches])[common[seen]]
    column = column[seen[common[seen]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(left), len(right)), dtype=np.float32)
    for lo in range(0, int(common.sum()), COLUMNS):
        at = slice(*np.searchsorted(column, (lo, lo + COLUMNS)))
        grid = np.zeros((len(sketches), COLUMNS), dtype=np.float32)
        grid[row[at], column[at] - lo] = 1
        both += grid[left] @ grid[right].T
    return both


def compared(sketches: list[np.ndarray], n: np.ndarray, left: np.ndarray, right: np.ndarray, ok: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in left and right of the pairs among ok whose estimate passes, and the estimates.

    The estimate is `union_estimate`, for all pairs at once: shared values stand in both sketches up to where both are
    complete, so only the values of either up to there are left to count.  Whole sets (up to SKETCH values) pass at
    the likeness itself, larger ones 5.5 standard errors under it.
    """
    t = percent / 100
    lengths = np.array([len(s) for s in sketches])
    whole = lengths == n
    top = np.array([2**32 - 1 if w else s[-1] for w, s in zip(whole, sketches)], dtype=np.uint32)
    upto = np.empty((len(sketches), len(sketches)), dtype=np.int16)  # values of each up to each top
    for k, s in enumerate(sketches):
        upto[k] = np.searchsorted(s, top, side="right")
    lengths = lengths.astype(np.int16)
    x, y = (np.minimum(lengths[p][:, None], upto[np.ix_(p, q)]) for p, q in ((left, right), (right, left)))
    both = shared(sketches, left, right)
    both /= x + y.T - both
    like = both
    i, j = np.nonzero(ok & (like >= np.where(whole[left][:, None] & whole[right][None, :], t - 1e-4, t - 5.5 * np.sqrt(t * (1 - t) / SKETCH))))
    return i, j, like[i, j]


def _pairs(percent: int, best: bool):
    """Rows sorted by (key, i, j) -> key and pairs of different components that pass; with best, one for each component of a list."""

    def tile(rows, left, right):
        rep, comp, n = (np.array([r[c] for r in rows]) for c in ("rep", "comp", "n"))
        ok = (comp[left][:, None] != comp[right][None, :]) & (100 * np.minimum(n[left][:, None], n[right][None, :]) >= percent * np.maximum(n[left][:, None], n[right][None, :]))
        if left is right:
            ok &= np.triu(np.ones(ok.shape, dtype=bool), 1)
        if not ok.any():
            return None
        sketches = [np.frombuffer(r["sketch"], dtype=np.uint32) for r in rows]
        a, b, e = compared(sketches, n, left, right, ok, percent)
        a, b = left[a], right[b]
        if len(a) and not rows[0].get("gathered"):
            # a pair belongs to the smallest list it shares; of lists with the same members the smallest one is left, so it is
            # there; a pair of gathered lists is told wherever it is met
            used, at = np.unique(np.r_[a, b], return_inverse=True)
            before = [k[: np.searchsorted(k, rows[0]["key"])] for k in (run_keys(sketches[m][:K].astype(np.uint64), int(n[m]), percent) for m in used)]
            x, y = at[: len(a)], at[len(a) :]
            p, q = np.unique(x), np.unique(y)
            own = shared(before, p, q)[np.searchsorted(p, x), np.searchsorted(q, y)] == 0
            a, b, e = a[own], b[own], e[own]
        if best and len(a):
            own, other = np.r_[comp[a], comp[b]], np.r_[comp[b], comp[a]]
            pair = np.r_[np.arange(len(a)), np.arange(len(a))]
            order = np.lexsort((pair, other, -np.r_[e, e], own))
            pick = np.unique(pair[order[np.r_[True, np.diff(own[order]) != 0]]])
            a, b = a[pick], b[pick]
        x, y = rep[a], rep[b]
        return np.minimum(x, y), np.maximum(x, y)

    def worked(rows):
        i, j = rows[0]["i"], rows[0]["j"]
        left, right = ([x[k : k + BLOCK] for k in range(0, len(x), BLOCK)] for x in ([r for r in rows if r["block"] == k] for k in (i, j)))
        for p, x in enumerate(left):
            if i == j:
                yield tile(x, at := np.arange(len(x)), at)
            for y in right[p + 1 if i == j else 0 :]:
                yield tile(x + y, np.arange(len(x)), np.arange(len(x), len(x) + len(y)))

    def run(batches):
        rows, at = [], None

        def flush():
            for found in worked(rows) if len(rows) > 1 else ():
                if found and len(found[0]):
                    found = (np.full(len(found[0]), at[0], dtype=np.int64), *found)
                    for k in range(0, len(found[0]), 50_000):
                        yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 50_000]) for x in found], ["key", "a", "b"])

        for batch in batches:
            for r in batch.to_pylist():
                if at != (k := (r["key"], r["i"], r["j"])):
                    yield from flush()
                    rows, at = [], k
                rows.append(r)
        yield from flush()

    return run


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets reach the likeness.

    A class in many pairs has its set copied once for every PARTNERS of them, and its pairs are dealt over the copies.
    Sets are the bulk of what moves: they are dealt once, by class and copy, and both joins read them there.
    """
    ends = pairs.select(F.col("a").alias("rep"), F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(pairs.select(F.col("b").alias("rep"), F.lit(0).alias("x"), F.lit(1).alias("y")))
    ids = ends.groupBy("rep").agg(F.ceil(F.greatest(F.sum("x"), F.sum("y")) / PARTNERS).cast("int").alias("chunks"))
    ids = stage(ids.join(classes.select("rep", F.col("low").alias("doc_id"), "digest"), "rep"))
    texts = sized_join(docs, ids, ["doc_id"], limit=24 << 20)
    sets = texts.mapInArrow(lean(_sets), "rep long, chunks int, shingles array<long>")
    sets = sets.select("rep", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("part"), "shingles").dropDuplicates(["rep", "part"])
    many = ids.filter("chunks > 1").select("rep", "chunks")  # few: a class with more than PARTNERS pairs
    dealt = pairs
    for end, other, part in (("a", "b", "pa"), ("b", "a", "pb")):
        dealt = sized_join(dealt, many.select(F.col("rep").alias(end), F.col("chunks").alias(part)), [end], "left")
        dealt = dealt.withColumn(part, F.coalesce(F.pmod(F.xxhash64(other), F.col(part)), F.lit(0)).cast("int"))
    x, y = (sets.select(F.col("rep").alias(end), F.col("part").alias(part), F.col("shingles").alias(name)) for end, part, name in (("b", "pb", "x"), ("a", "pa", "y")))
    both = F.size(F.array_intersect("x", "y")).cast("long")
    found = dealt.join(x, ["b", "pb"]).join(y, ["a", "pa"]).select("a", "b", both.alias("both"), (F.size("x") + F.size("y")).cast("long").alias("all"))
    out = stage(found.filter(100 * F.col("both") >= percent * (F.col("all") - F.col("both"))).select("a", "b"))
    release(ids)
    settle(docs.sparkSession)
    return out


def among(sketches: DataFrame, live: DataFrame, limit: int = 8 << 20) -> DataFrame:
    """The sketches of classes in live, picked by a broadcast of up to limit bytes; beyond that all of them, for the join that follows."""
    reps = live.select("rep").distinct()
    return sketches.join(F.broadcast(reps), "rep", "left_semi") if reps.count() * 16 <= limit else sketches


def gathered(members: DataFrame) -> DataFrame:
    """Staged (key, rep, size, ...) of lists -> staged key, rep, size, gathered in their place: long lists around one class are one list.

    Near copies share many runs, so they meet in many long lists with much the same members.  Each long list goes to its
    hub, the class that is in most long lists; the lists of a hub become their union where that has no more pairs than
    they have together.  The union holds every pair of its lists, so none is lost.
    """
    members = members.select("key", "rep", "size", F.lit(False).alias("gathered"))
    long = members.filter(F.col("size") > BLOCK)
    if long.isEmpty():
        return members
    central = long.groupBy("rep").agg(F.count(F.lit(1)).alias("lists"))
    hubs = long.join(central, "rep").groupBy("key").agg(F.max("size").alias("size"), F.max(F.struct("lists", (-F.col("rep")).alias("rep"))).alias("m"))
    hubs = stage(hubs.select("key", "size", (-F.col("m.rep")).alias("hub")))
    unions = stage(sized_join(long.select("key", "rep"), hubs.select("key", "hub"), ["key"]).select("hub", "rep").distinct())
    apart = hubs.groupBy("hub").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("lists"), F.sum(F.col("size") * F.col("size")).alias("pairs"))
    sizes = unions.groupBy("hub").agg(F.count(F.lit(1)).alias("size"))
    worth = stage(apart.join(sizes, "hub").filter("lists > 1 AND size * size <= pairs").select("hub", "key", "size"))
    gone = hubs.join(worth.select("hub"), "hub").select("key", F.lit(True).alias("gone"))
    left = sized_join(members, gone, ["key"], "left").filter("gone IS NULL").drop("gone")
    out = stage(left.unionByName(sized_join(unions, worth, ["hub"]).select("key", "rep", "size", F.lit(True).alias("gathered"))))
    release(hubs, unions, worth, members)
    return out


def still_open(live: DataFrame, pairs: DataFrame) -> DataFrame:
    """Staged (key, rep, size, gathered): of each list in live, the components with a pair that passes, counted anew.

    Each of them has its best pair in pairs; the others found nothing there, and merged components leave them fewer pairs.
    """
    ends = pairs.select("key", F.explode(F.array("a", "b")).alias("rep")).distinct()
    found = live.join(ends, ["key", "rep"]).select("key", "comp").distinct()
    kept = stage(sized_join(live.select("key", "rep", "comp", "gathered"), found, ["key", "comp"], "left_semi").select("key", "rep", "gathered"))
    out = stage(sized_join(kept, kept.groupBy("key").agg(F.count(F.lit(1)).alias("size")), ["key"]).select("key", "rep", "size", "gathered"))
    release(kept)
    return out


def classified(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, text_hash, label, component_id; one row for each row of docs.

    label numbers the component (null for rows that link with nothing), component_id is the smallest doc_id in it and
    text_hash tells rows of one doc_id apart.
    """
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    hashed = docs.withColumn("text_hash", F.xxhash64("text"))
    made = stage(hashed.mapInArrow(lean(_sketches(SKETCH)), "doc_id long, text_hash long, n long, digest binary, sketch binary"))
    firsts = made.filter("n > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min(F.struct("doc_id", "n", "sketch")).alias("m"))
    # classes are numbered, not named by a doc_id: one doc_id may have several texts
    classes = stage(firsts.select(F.monotonically_increasing_id().alias("rep"), "digest", F.col("m.doc_id").alias("low"), F.col("m.n").alias("n"), F.col("m.sketch").alias("sketch")))
    postings = classes.select("rep", "n", "sketch").mapInArrow(lean(_keys(percent)), "key long, rep long")
    lists = postings.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("pivot"), F.bit_xor(F.xxhash64("rep")).alias("h"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("g")).filter("size > 1")
    # lists with the same members (by size, smallest one and 128 bits of their hashes) are worked off once
    lists = lists.groupBy("size", "pivot", "h", "g").agg(F.min("key").alias("key")).select("key", "size", "pivot")
    members = stage(postings.join(lists, "key"))
    settle(docs.sparkSession)
    first = stage(members.filter("rep <> pivot").groupBy(F.col("rep").alias("b")).agg(F.min("pivot").alias("a")).select("a", "b"))
    links = verified(first, docs, classes, percent)
    members = gathered(members)
    best, labels, tested = True, components(links), first
    while True:
        told = stage(members.join(labels, members["rep"] == labels["node"], "left").select("key", "rep", "size", "gathered", F.coalesce("label", "rep").alias("comp")))
        mixed = told.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
        live = stage(told.join(mixed, "key"))
        left = live.join(among(classes.select("rep", "n", "sketch"), live), "rep")
        blocks = F.least(F.ceil(F.col("size") / BLOCK), F.lit(SIDES)).cast("int")
        left = left.withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        left = left.select("key", "rep", "comp", "n", "sketch", "gathered", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        left = left.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        pairs = stage(left.mapInArrow(lean(_pairs(percent, best)), "key long, a long, b long").distinct())
        if pairs.isEmpty():
            release(told, live, pairs)
            break
        settle(docs.sparkSession)
        fresh = stage(pairs.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"))
        found = 0
        if not fresh.isEmpty():
            more = verified(fresh, docs, classes, percent)
            if found := more.count():
                links = stage(links.unionByName(more).distinct())
                labels = components(links)
        if not best:
            release(told, live, pairs, fresh)
            break
        best = found > 0
        over = members, tested, fresh
        members = still_open(live, pairs)
        tested = stage(tested.unionByName(fresh))
        release(told, live, pairs, *over)
    release(members, tested)
    settle(docs.sparkSession)
    told = classes.join(labels, classes["rep"] == labels["node"], "left").select("digest", "low", F.coalesce("label", "rep").alias("label"))
    lowest = told.groupBy("label").agg(F.min("low").alias("component_id"))
    told = told.join(lowest, "label").select("digest", "label", "component_id")
    alone = F.col("doc_id").isNull() | (F.col("n") == 0)
    out = made.select("doc_id", "text_hash", "n", "digest").join(told, "digest", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), "text_hash", F.when(~alone, F.col("label")).alias("label"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, component_id, kept; one row for each row of docs."""
    return classified(docs, percent).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs with the smallest doc_id of each component (of several texts of that doc_id in it, the one with the
    smallest hash); rows that link with nothing all stay.  Equal rows count as one; all columns stay."""
    found = stage(classified(docs, percent))
    n, ids = found.agg(F.count("doc_id"), F.count_distinct("doc_id")).first()
    if n == ids:  # null doc_ids have no label
        drop = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("__id"))
        return docs.join(drop, docs["doc_id"] == drop["__id"], "left_anti")
    first = found.filter("label IS NOT NULL").groupBy("label").agg(F.min(F.struct("doc_id", "text_hash")).alias("m")).select("m.*")
    stay = first.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    hashed = docs.withColumn("__text", F.xxhash64("text"))
    some = hashed.join(stay, (hashed["doc_id"] == stay["__id"]) & (hashed["__text"] == stay["__hash"]), "left_semi").dropDuplicates(["doc_id", "__text"])
    lone = found.filter("label IS NULL").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    rest = hashed.join(lone, hashed["doc_id"].eqNullSafe(lone["__id"]) & (hashed["__text"] == lone["__hash"]), "left_semi")
    return some.unionByName(rest).drop("__text")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM words
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), ranked AS (
  SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY f, x) AS k, x
  FROM (SELECT doc_id, n, x, count(*) OVER (PARTITION BY x) AS f FROM items)
), prefix AS (
  SELECT doc_id, n, x FROM ranked WHERE k <= n - ((85 * n + 99) // 100) + 1
), near AS (
  SELECT DISTINCT p.doc_id AS a, q.doc_id AS b FROM prefix p JOIN prefix q ON p.x = q.x AND p.doc_id < q.doc_id
  WHERE 100 * least(p.n, q.n) >= 85 * greatest(p.n, q.n)
), shared AS (
  SELECT a, b, len(list_intersect(s.s, t.s)) AS c, len(s.s) + len(t.s) AS m FROM near JOIN sets s ON s.doc_id = a JOIN sets t ON t.doc_id = b
), links AS (
  SELECT a, b FROM shared WHERE 100 * c >= 85 * (m - c) UNION ALL SELECT b, a FROM shared WHERE 100 * c >= 85 * (m - c)
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, (SELECT min(r) FROM reach WHERE reach.doc_id = sets.doc_id) AS component_id,
  (SELECT min(r) FROM reach WHERE reach.doc_id = sets.doc_id) = doc_id AS kept FROM sets
"""
