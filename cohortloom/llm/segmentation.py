"""SentencePiece encoding and decoding by Gumbel top-k sampling without replacement over the segmentation lattice.

The lattice of a text has an edge for every piece of the vocabulary that fits (and one of byte pieces for a character that no
piece covers); a piece of rank r weighs as 1 / (r + 1).  Backward sums make every partial segmentation's probability exact.
The search keeps a queue of disjoint sets of segmentations, each with a perturbed log-probability (a Gumbel at the log of its
mass, truncated by the set it came from).  The best set is opened: its own best segmentation is drawn and emitted, and
what is left of it falls into one set for each edge along that path.  So segmentations come out distinct, in the order of
their perturbed values, and the next value in the queue gives the threshold for inclusion scores
log(1 - exp(-exp(log_prob - threshold))).  Random numbers are seeded by the row key.

Pieces do not cross from a letter into a following space, so a lattice node depends on the rest of its word only.  Texts go
through in groups of a bounded number of characters: the distinct words of a group get their lattices at once, as flat
arrays (edges by position, longest first), by one walk of a hashed trie and one backward pass by distance from the word's
end; all words of all texts of the group are drawn in step.  A draw's random number hashes the row key, the sample and the
place in the text, so samples don't depend on the grouping.  One pass without a shuffle over whole texts; the vocabulary, of
fixed size, is the only thing sent to executors.

Odd rows: null and empty texts have one segmentation, without pieces; texts with fewer than k segmentations give them all;
a null key counts as 0; equal rows with equal keys give equal samples; an empty table gives an empty result; extra columns
are ignored by `segment`.
"""

from __future__ import annotations

import ctypes
import hashlib
import heapq
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from cohortloom.session import lean, ship

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
SEED = 29
GROUP = 40_000  # characters of texts worked on at once, so that arrays stay in a core's cache; a longer text is a group of its own
BYTE_COST = 14.0  # of one byte piece, in nats
_WORD = re.compile(r"\n| *[^ \n]+| +")
_STOP = chr(0x10FFFF)  # between words; no piece has it
MOST_NOISE = 38.0  # of a Gumbel made of 53 random bits
_SLOTS = 18  # bits of the trie's hash table
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CLASSES = 12  # bits of a character's class in a key of the trie


class Vocabulary:
    """Pieces with spaces for their marks, and a trie of them as a hash table from (node, character) to node."""

    def __init__(self, model: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        piece: dict[str, int] = {}
        self.bytes: list[bytes] = []
        self.byte_id = [0] * 256
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.bytes.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes.append(b"")
            else:
                p = p.replace("\u2581", " ")
                piece[p] = i
                self.bytes.append(p.encode())
        self.weight = np.array([-math.log(1 - sp.get_score(i)) for i in range(sp.get_piece_size())])
        self.byte_of = np.array(self.byte_id, np.int32)
        self.kind = np.zeros(0x110000, np.int32)  # class of each character; 0: in no piece
        inside = sorted({ord(c) for p in piece for c in p})
        if len(inside) >= 1 << _CLASSES:
            raise ValueError(f"a vocabulary with {len(inside)} characters needs more bits than {_CLASSES}")
        self.kind[inside] = np.arange(1, len(inside) + 1)
        node, step = {"": 0}, []
        for p in piece:
            for n in range(1, len(p) + 1):
                if p[:n] not in node:
                    node[p[:n]] = len(node)
                    step.append(node[p[: n - 1]] << _CLASSES | int(self.kind[ord(p[n - 1])]))
        if len(node) >> 31 - _CLASSES:
            raise ValueError(f"a trie of {len(node)} nodes is too large")
        self.ends = np.full(len(node), -1, np.int32)  # by node, the piece that ends there
        for p, i in piece.items():
            self.ends[node[p]] = i
        self.slots = max(_SLOTS, (4 * len(node)).bit_length())
        self.key, self.to = np.full(1 << self.slots, -1, np.int32), np.zeros(1 << self.slots, np.int32)
        for i, (k, h) in enumerate(zip(step, self._slot(np.array(step, np.int32)).tolist()), 1):
            while self.key[h] >= 0:
                h = (h + 1) % len(self.key)
            self.key[h], self.to[h] = k, i

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.slots)

    def follow(self, node: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the trie goes on from nodes by classes of characters: (indices, nodes)."""
        key = (node << _CLASSES) | kind
        slot = self._slot(key)
        found = self.key[slot]
        good = found == key
        ask = np.flatnonzero(~good & (found >= 0))
        while len(ask):
            slot[ask] = (slot[ask] + 1) % len(self.key)
            found = self.key[slot[ask]]
            good[ask] = hit = found == key[ask]
            ask = ask[~hit & (found >= 0)]
        i = np.flatnonzero(good)
        return i, self.to[slot[i]]

    def ids(self, edges: np.ndarray) -> np.ndarray:
        """Edges as ids: an edge below 0 is a character in bytes."""
        if not len(edges) or (least := edges.min()) >= 0:
            return edges
        if least >= -0x80:
            return np.where(edges < 0, self.byte_of[-1 - np.minimum(edges, -1)], edges)
        out: list[int] = []
        for e in edges.tolist():
            if e < 0:
                out += [self.byte_id[b] for b in chr(-1 - e).encode("utf-8", "surrogatepass")]
            else:
                out.append(e)
        return np.array(out, np.int32)

    def decode(self, ids) -> str:
        """The text of a sequence of ids."""
        table = self.bytes
        return b"".join([table[i] for i in ids]).decode("utf-8", "surrogatepass")[1:]

    def samples(self, text: str | None, key: int, k: int = SAMPLES, seed: int = SEED) -> list[tuple[np.ndarray, float, float]]:
        """Up to k distinct segmentations: (ids, log_prob, log_inclusion), in the order they come out."""
        return sample_texts(self, [text], [key], k, seed)[0]


class Lattice:
    """Edges of the lattices of some words, by position, longest first; a word's positions lie side by side."""

    def __init__(self, v: Vocabulary, words: list[str]):
        self.length = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer(_STOP.join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(chars)
        kind = np.append(v.kind[chars], np.zeros(1, np.int32))
        self.start = np.cumsum(self.length + 1) - self.length - 1
        self.end = self.start + self.length
        inner = np.ones(n + 1, bool)
        inner[self.end] = False
        at = np.flatnonzero(inner).astype(np.int32)
        width, count, found = 0, np.zeros(n + 2, np.int64), []
        node = np.zeros(len(at), np.int32)
        while len(at):
            i, node = v.follow(node, kind[at + width])
            width += 1
            if width == 1:  # a character that is no piece is in bytes
                edge = -1 - chars[at].astype(np.int32)
                edge[i] = np.where(v.ends[node] >= 0, v.ends[node], edge[i])
                c = -1 - edge
                w = np.where(edge >= 0, v.weight[edge.clip(0)], -BYTE_COST * (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)))
                found.append((at, width, edge, w))
                at = at[i]
            else:
                at = at[i]
                edge = v.ends[node]
                has = np.flatnonzero(edge >= 0)
                edge = edge[has]
                found.append((at[has], width, edge, v.weight[edge]))
            count[found[-1][0] + 1] += 1
        self.first = np.cumsum(count)
        total = int(self.first[-1])
        self.edge, self.size = np.zeros(total, np.int32), np.zeros(total, np.int32)
        weight, to, put = np.zeros(total), np.zeros(total, np.int64), self.first[1:].copy()
        for at, width, edge, w in found:
            put[at] -= 1
            i = put[at]
            self.edge[i], self.size[i], weight[i], to[i] = edge, width, w, at + width
        mass = np.zeros(n + 1)  # log of the mass from a position to its word's end
        order = np.argsort(-self.length, kind="stable")
        ends, longest = self.end[order], self.length[order]
        for back in range(1, int(longest[0]) + 1 if len(order) else 1):
            here = ends[: np.searchsorted(-longest, -back, side="right")] - back
            lo, m = self.first[here], self.first[here + 1] - self.first[here]
            cut = np.cumsum(m) - m
            i = np.arange(int(m.sum())) + np.repeat(lo - cut, m)
            x = weight[i] + mass[to[i]]
            top = np.maximum.reduceat(x, cut)
            mass[here] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, m)), cut))
        self.share = weight + mass[to] - np.repeat(mass[: n + 1], self.first[1:] - self.first[:-1])
        self.gate = np.exp(self.share)
        self.gate[self.first[1:][inner] - 1] = 2.0  # whatever is left of a draw goes to the last edge


def _uniform(row: np.ndarray, at: np.ndarray, kind: int) -> np.ndarray:
    """A number in (0, 1) for each row seed, place and kind of draw."""
    x = row + at.astype(np.uint64) * _MIX + np.uint64(kind * 0xD1B54A32D192ED03 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def sample_texts(v: Vocabulary, texts: list, keys: list, k: int = SAMPLES, seed: int = SEED) -> list[list[tuple[np.ndarray, float, float]]]:
    """The samples of each text; see `Vocabulary.samples`."""
    number: dict[str, int] = {}
    told, rows = [], []  # numbers of the words of all texts; words in each text
    for text in texts:
        found = _WORD.findall(" " + text) if text else []
        rows.append(len(found))
        told += [number.setdefault(w, len(number)) for w in found]
    if not told:
        return [[(np.zeros(0, np.int32), 0.0, 0.0)] for _ in texts]
    net = Lattice(v, list(number))
    word = np.array(told, np.int64)
    of = np.repeat(np.arange(len(texts)), rows)  # the text of each word
    spread = net.length[word]
    place = np.cumsum(spread) - spread  # of each word in all texts
    words_before = np.cumsum([0, *rows])
    base = np.append(place, int(spread.sum()))[words_before]  # where each text begins, and the end
    seeds = np.array([xxhash.xxh3_64_intdigest(f"{seed}:{i}".encode()) for i in keys], np.uint64)
    chosen: list[np.ndarray] = []  # by sample, the edge taken at each place, or -1
    queues: list[list] = [[] for _ in texts]
    out: list[list] = [[] for _ in texts]
    for t, text in enumerate(texts):  # sets: (-perturbed value, order, sample it came from, place it leaves that path at, barred edges)
        if text:
            g = -math.log(-math.log(float(_uniform(seeds[t : t + 1], np.zeros(1), 0)[0])))
            queues[t].append((-g, 0, -1, -1, ()))
        else:
            out[t].append((np.zeros(0, np.int32), 0.0, 0.0))
    for r in range(k):
        open_ = [(t, heapq.heappop(q)) for t, q in enumerate(queues) if q]
        if not open_:
            break
        take = np.full(int(base[-1]), -1, np.int32)
        fresh = np.zeros(len(texts), np.int64) + len(word)  # the first word that is drawn whole
        begun: list[tuple] = []
        for t, (_, _, parent, at, barred) in open_:
            if parent < 0:
                fresh[t] = words_before[t]
                continue
            take[base[t] : at] = chosen[parent][base[t] : at]
            w = int(np.searchsorted(place, at, side="right")) - 1
            fresh[t] = w + 1
            p = int(net.start[word[w]] + at - place[w])
            left = [e for e in range(net.first[p], net.first[p + 1]) if e not in barred]
            u = float(_uniform(seeds[t : t + 1], np.array([at - base[t]]), 2 * r + 1)[0]) * math.fsum(math.exp(net.share[e]) for e in left)
            for e in left:
                u -= math.exp(net.share[e])
                if u <= 0:
                    break
            take[at] = e
            n = int(net.size[e])
            if p + n < net.end[word[w]]:
                begun.append((p + n, net.end[word[w]], at + n, t))
        whole = np.flatnonzero(np.arange(len(word)) >= fresh[of])
        p, end, at, t = (np.concatenate([a, np.array(b, np.int64)]) for a, b in zip((net.start[word[whole]], net.end[word[whole]], place[whole], of[whole]), zip(*begun) if begun else [()] * 4))
        row, offset = seeds[t], base[t]
        while len(p):
            u = _uniform(row, at - offset, 2 * r + 1)
            e = net.first[p]
            u -= net.gate[e]
            go = np.flatnonzero(u > 0)
            while len(go):
                e[go] += 1
                u[go] -= net.gate[e[go]]
                go = go[u[go] > 0]
            take[at] = e
            n = net.size[e]
            p, at = p + n, at + n
            live = np.flatnonzero(p < end)
            p, end, at, row, offset = p[live], end[live], at[live], row[live], offset[live]
        chosen.append(take)
        _emit(v, net, word, place, base, seeds, take, open_, queues, out, r, k)
    for t, found in enumerate(out):
        bar = -queues[t][0][0] if queues[t] else None
        for n, (ids, log_prob, _) in enumerate(found):
            x = math.inf if bar is None else log_prob - bar
            inclusion = 0.0 if x > 700 else math.log(-math.expm1(-math.exp(x))) if x > -30 else x
            found[n] = (ids, round(log_prob, 9), round(inclusion, 9))
    return out


def _emit(v, net, word, place, base, seeds, take, opened, queues, out, r, k):
    """Emit the path just drawn of each opened set, and queue what is left of it: one set for each edge of its path from the
    set's own place on; only the best can come up."""
    at = np.flatnonzero(take >= 0)
    edges = take[at]
    share = net.share[edges]
    cut = np.searchsorted(at, base)
    ids = net.edge[edges]
    for t, (g, _, _, since, barred) in opened:
        lo, hi = int(cut[t]), int(cut[t + 1])
        run = np.cumsum(share[lo:hi])
        out[t].append((v.ids(ids[lo:hi]), float(run[-1]), -g))
        skip, own = 0, ()
        if barred:
            skip = int(np.searchsorted(at[lo:hi], since))
            own = (*barred, int(edges[lo + skip]))
        before = run - share[lo:hi]  # never grows along the path, so values are at most that much plus MOST_NOISE
        need, i, n, best = k - r, skip, 64, []
        while i < hi - lo and (len(best) < need or best[-1][0] < before[i] + MOST_NOISE):
            j = min(i + n, hi - lo)
            with np.errstate(divide="ignore"):
                mass = before[i:j] + np.log(-np.expm1(np.minimum(share[lo + i : lo + j], 0.0)))
            if own and i == skip:
                w = int(np.searchsorted(place, since, side="right")) - 1
                p = int(net.start[word[w]] + since - place[w])
                rest = math.fsum(math.exp(net.share[e]) for e in range(net.first[p], net.first[p + 1]) if e not in own)
                mass[0] = before[i] + math.log(rest) if rest > 0 else -math.inf
            some = np.flatnonzero(np.isfinite(mass))
            noise = np.log(-np.log(_uniform(np.repeat(seeds[t], len(some)), at[lo + i + some] - base[t], 2 * r + 2)))
            value = -np.logaddexp(g, noise - mass[some])
            top = np.argsort(-value, kind="stable")[:need]
            best = sorted([*best, *zip(value[top].tolist(), (some[top] + i).tolist())], key=_first, reverse=True)[:need]
            i, n = j, 2 * n
        for value, i in best:
            heapq.heappush(queues[t], (-value, (r, i), r, int(at[lo + i]), own if own and i == skip else (int(edges[lo + i]),)))


def _first(pair: tuple) -> float:
    return pair[0]


def _keep_memory() -> None:
    """Have the C library keep what arrays free for the next ones: fresh pages cost more than the work on them."""
    tune = getattr(ctypes.CDLL(None), "mallopt", None)
    if tune:
        for what, size in ((-3, 1 << 25), (-1, 1 << 26), (-2, 1 << 24)):  # threshold of mapping, of trimming, padding
            tune(what, size)


def _groups(batch, k: int, v: Vocabulary, seed: int = SEED):
    """Rows of (doc_id, text) with their samples, in groups of about GROUP characters."""
    _keep_memory()
    group, size = [], 0
    for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        n = len(row[1] or "")
        if group and size + n > GROUP:
            yield from zip(group, sample_texts(v, [x for _, x in group], [i or 0 for i, _ in group], k, seed))
            group, size = [], 0
        group.append(row)
        size += n
    if group:
        yield from zip(group, sample_texts(v, [x for _, x in group], [i or 0 for i, _ in group], k, seed))


def segment(docs: DataFrame, k: int = SAMPLES, model: str = MODEL, seed: int = SEED) -> DataFrame:
    """(doc_id, text) -> doc_id, sample (0 to k - 1), ids, log_prob, log_inclusion; up to k rows for each row of docs."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(Vocabulary(model))

    def run(batches):
        for batch in batches:
            rows, size = [], 0
            for (i, _), found in _groups(batch, k, shared.value, seed):
                for n, (ids, p, inclusion) in enumerate(found):
                    rows.append((i, n, ids, p, inclusion))
                    size += len(ids)
                if size > 2_000_000:
                    yield _rows(rows)
                    rows, size = [], 0
            yield _rows(rows)

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, sample int, ids array<int>, log_prob double, log_inclusion double")


def _rows(rows):
    i, n, ids, p, q = zip(*rows) if rows else [()] * 5
    offsets = np.cumsum([0, *map(len, ids)])
    flat = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)))
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(n, pa.int32()), flat, pa.array(p, pa.float64()), pa.array(q, pa.float64())], ["doc_id", "sample", "ids", "log_prob", "log_inclusion"])


def decode(segmented: DataFrame, model: str = MODEL) -> DataFrame:
    """Replace ids by text, the text that they spell."""
    spark = segmented.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(Vocabulary(model))
    schema = segmented.schema
    at = schema.fieldNames().index("ids")
    columns = ", ".join(f"`{f.name}` {'string' if f.name == 'ids' else f.dataType.simpleString()}" for f in schema)

    def run(batches):
        for batch in batches:
            texts = [None if x is None else shared.value.decode(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(batch.columns)], batch.schema.names)

    return segmented.mapInArrow(lean(run), columns).withColumnRenamed("ids", "text")


def op8_segment(spark: SparkSession, sf_dir: str, k: int = SAMPLES, model: str = MODEL) -> DataFrame:
    """doc_id, sample, n_pieces, ids_sha256, log_prob, log_inclusion, round_trip of every whole text of documents."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    shared = spark.sparkContext.broadcast(Vocabulary(model))

    def run(batches):
        v = shared.value
        table = pa.array(v.bytes, pa.binary())
        for batch in batches:
            rows = []
            for (i, text), found in _groups(batch, k, v):
                spelt = (" " + text if text else "").encode("utf-8", "surrogatepass")
                for n, (ids, p, inclusion) in enumerate(found):
                    back = table.take(pa.array(ids, pa.int32())).buffers()[2]
                    rows.append((i, n, len(ids), hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(), p, inclusion, (back.to_pybytes() if back else b"") == spelt))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, kinds)], ["doc_id", "sample", "n_pieces", "ids_sha256", "log_prob", "log_inclusion", "round_trip"])

    return docs.mapInArrow(lean(run), "doc_id long, sample int, n_pieces long, ids_sha256 string, log_prob double, log_inclusion double, round_trip boolean")
