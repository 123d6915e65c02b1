"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed runs of 1 to 3 characters of the lower-cased text; a weight is log(1 + count) * idf, vectors have length
one.  Training is follow-the-regularised-leader with an elastic net (per-coordinate steps, exact zeros), softmax over the
languages of the sample; a temperature fitted on a held-back quarter of the sample calibrates the probabilities.

Bounds: fitting takes at most about ROWS rows and CHARS characters of labelled documents to the driver, equal room for each
language.  Scoring is one pass over whole texts without a shuffle.

Odd rows: a null text, or one without a letter, is `und` with score 0; so is every row when there is nothing to learn from;
a null lang is never learnt; repeated rows score alike; a null doc_id is not held out, and is not learnt from; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm.training import remainder, sampled
from cohortloom.session import lean, ship

BITS = 15
ROWS = 4000
CHARS = 8_000_000
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.02
EPOCHS = 3


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and how often each is in the text."""
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    h, all_h = np.zeros(len(code), dtype=np.uint64), []
    for n in range(1, 4):
        h = h[: len(code) - n + 1] * np.uint64(0x01000193) + code[n - 1 :] + np.uint64(n)
        all_h.append(((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64))
    full = np.bincount(np.concatenate(all_h), minlength=1 << BITS)
    at = np.flatnonzero(full)
    return at, full[at]


class Model:
    def __init__(self, langs: list[str], idf: np.ndarray):
        self.langs, self.idf = langs, idf
        self.w, self.bias, self.temperature = np.zeros((1 << BITS, len(langs))), np.zeros(len(langs)), 1.0

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        at, n = counts(text)
        x = np.log1p(n) * self.idf[at]
        return at, x / (np.sqrt(x @ x) or 1.0)

    def logits(self, text: str) -> np.ndarray:
        at, x = self.vector(text)
        return x @ self.w[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not any(c.isalpha() for c in text):
            return "und", 0.0
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return self.langs[k], float(p[k] / p.sum())


def train(docs: DataFrame, rows: int = ROWS, chars: int = CHARS) -> Model:
    """Fit on text and lang of rows whose crc32(doc_id) mod 3 isn't 1."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder("doc_id", 3) != 1)).select("doc_id", "text", "lang", F.length("text").alias("chars"))
    got = sampled(known, "doc_id", "chars", rows, chars, by="lang").select("text", "lang", F.xxhash64("doc_id", "text").alias("k")).toPandas().sort_values("k")
    langs = sorted(got["lang"].unique())
    y = got["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(dtype=int)
    rows_x, df = [], np.zeros(1 << BITS)
    for t in got["text"]:
        at, n = counts(t)
        rows_x.append((at.astype(np.uint16), n.astype(np.uint16 if len(n) == 0 or n.max() < 1 << 16 else np.uint32)))
        df[at] += 1
    model = Model(langs, np.log((1 + len(y)) / (1 + df)) + 1)
    if len(langs) < 2:
        return model
    vectors = []
    for at, n in rows_x:
        x = np.log1p(n) * model.idf[at]
        vectors.append((at.astype(np.int64), (x / (np.sqrt(x @ x) or 1.0)).astype(np.float32)))
    k = len(langs)
    z, s = np.zeros((1 << BITS, k)), np.zeros((1 << BITS, k))
    hot = np.eye(k)
    fit = [i for i in range(len(y)) if i % 4] or list(range(len(y)))
    rng = np.random.default_rng(17)

    def weights(at):
        zz = z[at]
        return np.where(np.abs(zz) > L1, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(s[at])) / ALPHA + L2), 0.0)

    for _ in range(EPOCHS):
        for i in rng.permutation(fit):
            at, x = vectors[i]
            w = weights(at)
            o = x @ w + model.bias
            p = np.exp(o - o.max())
            d = p / p.sum() - hot[y[i]]
            g = x[:, None] * d
            sigma = (np.sqrt(s[at] + g * g) - np.sqrt(s[at])) / ALPHA
            z[at] += g - sigma * w
            s[at] += g * g
            model.bias -= 0.01 * d
    model.w = weights(np.arange(1 << BITS))
    held = [i for i in range(len(y)) if i % 4 == 0]
    out = np.array([vectors[i][1] @ model.w[vectors[i][0]] + model.bias for i in held]).reshape(-1, k)

    def loss(t):
        o = out / t
        return np.mean(np.log(np.exp(o - o.max(1, keepdims=True)).sum(1)) + o.max(1) - o[np.arange(len(o)), y[held]]) if len(o) else 0.0

    model.temperature = float(min(np.geomspace(0.05, 5, 80), key=loss))
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    spark = docs.sparkSession
    ship(spark)
    model.w = model.w.astype(np.float32)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found = [shared.value.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, lang_pred string, score double")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs)).select("doc_id", (F.coalesce(remainder("doc_id", 3), F.lit(0)) == 1).alias("held_out"), "lang_pred", "score")
