"""Quality classifier by compression: which labelled text shortens this text more?

Two Zstandard dictionaries are built from pieces of good and of bad labelled texts.  A text is cut into blocks of BLOCK
bytes, each block is compressed with either dictionary, and the sizes are summed over the whole text.  The difference
(bad - good), normalised by the text's bytes, is the only input of an isotonic calibration fitted on labelled rows the
dictionaries haven't seen: shares of good rows that never fall as the difference grows, joined by straight lines.  (Normalised by the compressed sizes it ranks worse: junk that repeats itself shrinks under any
dictionary, and what little is left of it weighs as much as a text.)

Bounds of the fit, all parameters: a sample of about ROWS labelled rows.  The dictionaries take one piece of PIECE characters,
whole, from each of its texts in hash order until ROOM bytes are full (some 500 texts a label), both of them equally
long, so that neither shortens texts just by holding more.  For the calibration the sample is cut in FOLDS, and each part
is measured by dictionaries made of the other ones.  The driver gets those pieces and four numbers for each row of the
sample.  Scoring is one pass over whole texts without a shuffle.

Odd rows: a null or empty text has sizes 0 and gets the share of good rows as its score; a null doc_id is never held out or
learnt from; repeated rows score alike; an empty table gives an empty result; with one class of labels or none the score
is the share of good labels (1/2 without any); extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm.training import labelled, remainder
from cohortloom.session import lean, ship, stage

BLOCK = 256
LEVEL = 9
ROOM = 112 << 10  # bytes of a dictionary
PIECE = 200  # characters that a dictionary takes of a text
ROWS = 8000  # labelled rows of the fit
FOLDS = 4
CUT = 0.3


class Model:
    """Two dictionaries and a calibration; pickles as plain bytes and numbers."""

    def __init__(self, good: bytes, bad: bytes, prior: float):
        self.good, self.bad, self.prior, self.fit = good, bad, prior, None
        self._made = None

    def __getstate__(self):
        return self.__dict__ | {"_made": None}

    def sizes(self, text: bytes) -> tuple[int, int]:
        if self._made is None:
            self._made = []
            for content in (self.good, self.bad):
                d = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                self._made.append(zs.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        good, bad = self._made
        g = b = 0
        for i in range(0, len(text), BLOCK):
            x = text[i : i + BLOCK]
            g += len(good(x))
            b += len(bad(x))
        return g, b

    def scores(self, n: np.ndarray, g: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.fit is None:
            return np.full(len(n), self.prior)
        return np.where(n > 0, np.interp(difference(n, g, b), *self.fit), self.prior)


def difference(n: np.ndarray, g: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The normalised difference of compressed sizes: positive where good texts shorten a text more."""
    return (b - g) / np.maximum(n, 1)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the weighted mean x and the share of y of each pool, both growing."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # weight, weight * x, weight * y
    for a, b, w in zip(x[order].tolist(), y[order].tolist(), weight[order].tolist()):
        pools.append([w, w * a, w * b])
        while len(pools) > 1 and pools[-2][2] * pools[-1][0] >= pools[-1][2] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    return np.array([p[1] / p[0] for p in pools]), np.array([p[2] / p[0] for p in pools])


def _measured(model: Model):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            sizes, n = [], []
            for t in texts:
                x = (t or "").encode("utf-8", "surrogatepass")
                n.append(len(x))
                sizes.append(model.sizes(x))
            a = np.array(sizes, dtype=float).reshape(-1, 2)
            yield ids, np.array(n, dtype=float), a[:, 0], a[:, 1], batch

    return run


def built(pieces, room: int = ROOM) -> bytes:
    """A dictionary's content: whole pieces, in order, as long as they fit."""
    out = []
    for x in pieces:
        x = x.encode("utf-8", "surrogatepass") + b"\n"
        if len(x) > room:
            break
        out.append(x)
        room -= len(x)
    return b"".join(out)


def contents(pieces: list[tuple[int, str]]) -> list[bytes]:
    """The dictionaries of good and of bad pieces (label, piece), equally long up to one piece."""
    found = [[x for label, x in pieces if label == y] for y in (1, 0)]
    room = min(ROOM, *(len(built(x)) for x in found))
    return [built(x, room) for x in found]


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Model:
    """Fit on rows whose crc32(doc_id) mod 5 isn't 0: dictionaries of all pieces, a calibration from folds."""
    spark = docs.sparkSession
    ship(spark)
    sample = stage(labelled(docs, labels, "quality", max_rows=rows).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(FOLDS)).cast("int")))
    at = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.greatest(F.length("text") - PIECE, F.lit(0)) + 1) + 1
    counts = dict(sample.groupBy("y").count().collect())
    prior = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    found = sample.filter(F.length("text") > 0).select("y", "fold", F.substring("text", at.cast("int"), F.lit(PIECE)).alias("x"), F.xxhash64("doc_id").alias("h")).orderBy("h", "x").collect()
    model = Model(*contents([(p.y, p.x) for p in found]), prior)
    parts = [Model(*contents([(p.y, p.x) for p in found if p.fold != k]), prior) for k in range(FOLDS)]
    if all(len(c) >= 8 for m in (model, *parts) for c in (m.good, m.bad)) and all(counts.get(y) for y in (0, 1)):
        shared = spark.sparkContext.broadcast(parts)

        def run(batches):
            models = shared.value
            for batch in batches:
                y, n, g, b = [], [], [], []
                for label, fold, text in zip(*(batch.column(c).to_pylist() for c in ("y", "fold", "text"))):
                    if x := (text or "").encode("utf-8", "surrogatepass"):
                        good, bad = models[fold].sizes(x)
                        y.append(label)
                        n.append(float(len(x)))
                        g.append(float(good))
                        b.append(float(bad))
                yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), *(pa.array(v, pa.float64()) for v in (n, g, b))], ["y", "n", "g", "b"])

        got = np.array(sample.mapInArrow(lean(run), "y int, n double, g double, b double").collect(), dtype=float).reshape(-1, 4)
        y = got[:, 0]
        if 0 < y.sum() < len(y):
            # the sample has equal room for both labels: weigh it back to their shares among all labels
            share = dict(labels.filter(F.col("quality").isin(0, 1) & (remainder("doc_id", 5) != 0)).groupBy(F.col("quality").cast("int").alias("y")).count().collect())
            model.prior = share[1] / (share[0] + share[1])
            weight = np.where(y == 1, model.prior / y.mean(), (1 - model.prior) / (1 - y.mean()))
            model.fit = isotonic(difference(*got[:, 1:].T), y, weight)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, text, score of every row, of its whole text."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for ids, n, g, b, batch in _measured(model)(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(model.scores(n, g, b))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of docs that score at least cut; all columns stay."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(train(docs, labels))

    def run(batches):
        model = shared.value
        for _, n, g, b, batch in _measured(model)(batches):
            yield batch.filter(pa.array(model.scores(n, g, b) >= cut))

    return docs.mapInArrow(lean(run), docs.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", (F.coalesce(remainder("doc_id", 5), F.lit(1)) == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
