"""Toxicity by multiple-instance learning: sentence scores under a noisy-or, trained from document labels alone.

A text is lower-cased and cut into sentences at . ! ? and line breaks.  A sentence's features are the hashed runs of 4 and of
7 characters that lie inside it; its score is sigmoid(bias + sum of the weights of its features), or 0 if it has no feature that
was kept, so that length alone adds nothing; a document's score is 1 - prod(1 - sentence score).  The bias is fixed: BASE,
and 3 more while learning, where gradients would else vanish; the weights are scaled by the ratio of the two.  The gradient of the document likelihood flows back to the sentences, so weights come from
document labels, and the sentences that carry a document's score are the offending ones (`locate`).  Weights are not
negative: a harmless sentence can't excuse another one.

Bounds: fitting takes at most about ROWS labelled rows and CHARS characters to the driver, and KEPT features (those whose
document rates differ most).  Scoring is one pass without a shuffle; texts are worked through whole, in pieces of rows.

Odd rows: a null or empty text scores 0; repeated rows score alike; a null doc_id is never held out or learnt from; an empty
table gives an empty result; without labels of both kinds every score is 0; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm.training import labelled, remainder, sigmoid
from cohortloom.session import lean, ship

GRAMS = (4, 7)
BITS = 20
KEPT = 4096
ROWS = 6000
CHARS = 8_000_000
LEAST = 3  # documents a feature must be in
BASE = -9.0  # bias of a sentence without features
PIECE = 1 << 18  # characters worked on at once
ENDS = np.array([ord(c) for c in ".!?\n"], dtype=np.uint32)


def lowered(text: str | None) -> str:
    """The text in lower case, character for character."""
    x = (text or "").lower()
    return x if text is None or len(x) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def sentences(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts laid end to end: features by position, sentence by position (-1: no feature there), and by sentence the document and the start within it."""
    joined = "\n".join(texts) + "\n"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    doc_start = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    end = np.isin(code, ENDS)
    number = np.cumsum(end) - end  # an end belongs to the sentence before it
    starts = np.r_[0, np.flatnonzero(end)[:-1] + 1]
    doc = np.searchsorted(doc_start, starts, side="right") - 1
    found, place = [], []
    for gram in GRAMS:
        n = max(len(code) - gram + 1, 0)
        h = np.full(n, gram, dtype=np.uint64)
        for i in range(gram):
            h = h * np.uint64(0x9E3779B1) + code[i : i + n]
        within = number[:n].copy()
        within[number[:n] != number[len(number) - n :]] = -1
        found.append(((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32))
        place.append(within)
    return np.concatenate(found), np.concatenate(place), doc, starts - doc_start[doc]


def pieces(texts: list[str]):
    """Neighbouring texts of about PIECE characters together, with the place of the first."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > PIECE:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t) + 1
    if texts:
        yield start, texts[start:]


class Model:
    def __init__(self):
        self.weight = np.zeros(1 << BITS, dtype=np.float32)

    def __getstate__(self):
        at = np.flatnonzero(self.weight)
        return {"at": at, "w": self.weight[at]}

    def __setstate__(self, state):
        self.__init__()
        self.weight[state["at"]] = state["w"]

    def by_sentence(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, start, log(1 - score)) of each sentence that has a weighty feature."""
        h, sentence, doc, start = sentences(texts)
        w = self.weight[h]
        at = np.flatnonzero((w != 0) & (sentence >= 0))
        which, back = np.unique(sentence[at], return_inverse=True)
        # a feature counts once in a sentence
        pairs = np.unique(back.astype(np.int64) << BITS | h[at])
        z = BASE + np.bincount(pairs >> BITS, self.weight[pairs & ((1 << BITS) - 1)], minlength=len(which))
        return doc[which], start[which], -np.logaddexp(0, z)

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts))
        for first, some in pieces(texts):
            doc, _, safe = self.by_sentence(some)
            out[first : first + len(some)] = 1 - np.exp(np.bincount(doc, safe, minlength=len(some)))
        return np.clip(out, 0, 1)


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS, chars: int = CHARS) -> Model:
    """Fit on rows whose crc32(doc_id) mod 5 isn't 0."""
    got = labelled(docs, labels, "toxic", max_rows=rows, max_chars=chars).select("text", "y", F.xxhash64("doc_id", "text").alias("k")).toPandas().sort_values("k")
    texts, y = [lowered(t) for t in got["text"]], got["y"].to_numpy(dtype=float)
    model = Model()
    if not 0 < y.sum() < len(y):
        return model
    df = np.zeros((2, 1 << BITS), dtype=np.int32)
    for first, some in pieces(texts):
        h, sentence, doc, _ = sentences(some)
        ok = sentence >= 0
        pair = np.unique(doc[sentence[ok]].astype(np.int64) << BITS | h[ok])
        np.add.at(df, (y[first + (pair >> BITS)].astype(int), pair & ((1 << BITS) - 1)), 1)
    n0, n1 = len(y) - y.sum(), y.sum()
    p1, p0 = (df[1] + 0.5) / (n1 + 1), (df[0] + 0.5) / (n0 + 1)
    gain = np.where((df[1] >= LEAST) & (p1 > 4 * p0), df[1] * np.log(p1 / p0), 0)
    kept = np.sort(np.argsort(-gain, kind="stable")[:KEPT])
    kept = kept[gain[kept] > 0]
    if not len(kept):
        return model
    place = np.full(1 << BITS, -1, dtype=np.int32)
    place[kept] = np.arange(len(kept))
    bag, sent, feat, base = [], [], [], 0
    for first, some in pieces(texts):
        h, sentence, doc, _ = sentences(some)
        at = np.flatnonzero((place[h] >= 0) & (sentence >= 0))
        which, back = np.unique(sentence[at], return_inverse=True)
        pair = np.unique(back.astype(np.int64) << 32 | place[h[at]])
        bag.append(first + doc[which])
        sent.append(base + (pair >> 32))
        feat.append(pair & 0xFFFFFFFF)
        base += len(which)
    bag, sent, feat = (np.concatenate(x) for x in (bag, sent, feat))
    w, m, v = np.zeros(len(kept)), np.zeros(len(kept)), np.zeros(len(kept))
    prior = np.where(y == 1, len(y) / 2 / n1, len(y) / 2 / n0)
    for t in range(1, 301):
        z = BASE + 3 + np.bincount(sent, w[feat], minlength=base)  # a softer bias while learning
        p = sigmoid(z)
        safe = np.bincount(bag, np.log1p(-np.clip(p, 0, 1 - 1e-12)), minlength=len(y))
        whole = np.clip(1 - np.exp(safe), 1e-9, 1)
        pull = np.where(y == 1, (1 - whole) / whole, -1.0) * prior
        g = np.bincount(feat, (p * pull[bag])[sent], minlength=len(kept)) - 0.02 * w - 0.02
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = np.maximum(w + 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8), 0)
    w[w < 0.05] = 0
    model.weight[kept] = w * (abs(BASE) / abs(BASE + 3))  # the same sentences stay above 1/2
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row, of its whole text."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = [lowered(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(texts))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, score double")


def locate(docs: DataFrame, model: Model, cut: float = 0.5) -> DataFrame:
    """doc_id, start, sentence, score of each sentence that scores at least cut; start is its first code point in the text."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            out = []
            for first, some in pieces([lowered(t) for t in texts]):
                for d, start, safe in zip(*shared.value.by_sentence(some)):
                    if (p := float(1 - np.exp(safe))) >= cut:
                        text = texts[first + d]
                        ends = [k for c in ".!?\n" if (k := text.find(c, start)) >= 0]
                        out.append((ids[first + d], int(start), text[start : min(ends, default=len(text))].strip(), p))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.string(), pa.float64()))], ["doc_id", "start", "sentence", "score"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, start long, sentence string, score double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", (F.coalesce(remainder("doc_id", 5), F.lit(1)) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
