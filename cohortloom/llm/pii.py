"""PII: information-theoretic sanitisation.

Base patterns find e-mail addresses, IP addresses, payment cards (Luhn) and phone numbers; to these comes a kind of the
method's own, `secret`: an unbroken run of letters and digits that carries at least SECRET_BITS bits by the entropy of its own
characters and changes between letters and digits at least SWITCHES times (keys, tokens, hashes; no word and no number does).
Each value is a protected entity, and so is each kind as a whole: a term that gives away that a card number stands beside it
is judged even where every number is used once.

Corpus co-occurrence estimates how strongly a term reveals an entity e.  With co(t, e) the documents in which t stands within
WINDOW words of e, df(t) the documents with t, df(e) those with e and N all documents, the posterior backs off to how common
the entity is: p = (co + PRIOR * df(e) / N) / (df(t) + PRIOR), and the disclosure is log2(p * N / df(e)) bits.  Terms
seen with an entity in at least SUPPORT different contexts (so that copies of a text prove nothing; KIND_SUPPORT for a kind)
and at least BITS bits are generalised from a posterior of GENERAL on, removed from REMOVE on.

Distribution: one pass emits (entity, term, context) of documents with entities, and each entity once for its df, counted
with partial sums; one pass counts df of the terms that a Bloom filter of fixed size lets through, and a join drops those
it let through wrongly; one pass marks spans.  Revealing terms go to executors as two flat arrays of at most SLICE
terms (9 bytes each); more of them go in slices, each one more step of the same pass.  Terms and entities travel as
64-bit hashes.

Odd rows: a null text counts as empty and stays null when sanitised; repeated rows are documents of their own; null doc_ids
pass through; an empty table gives an empty result; extra columns are kept by `sanitise` (`__terms` is reserved, an error)
and ignored by `find`.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.session import lean, release, ship, stage

KINDS = ("email", "ip", "card", "phone")
WINDOW = 8
SUPPORT, KIND_SUPPORT = 2, 8
BITS = 4.0
PRIOR = 1.0
GENERAL, REMOVE = 0.65, 0.9
SECRET_BITS, SWITCHES = 60.0, 4
SLICE = 4_000_000
BLOOM_BITS = 25  # a filter of 2 ** 25 bits, 4 MB

_AT = re.compile("@")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile("[0-9]")
# a failing run of digits fails from each of its digits, so only its first one is tried
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")
_TERM = re.compile(r"[^\W\d_]{2,}")
# a run of letters and digits with a digit in it, from its start; short ones are let go at once
_RUN = re.compile(r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])[A-Za-z0-9]{16,}+")
_SWITCH = re.compile("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])")
_ALL_KINDS = (*KINDS, "secret")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by kind as listed, then start."""
    out: list[tuple[str, int, int]] = []
    if not text:
        return out
    done = 0
    for m in _AT.finditer(text):
        at = m.start()
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (end := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, end.end()))
            done = end.end()
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(x := p.lstrip("0")) <= 3 and int(x or "0") <= 255 for p in m.groups()):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def secret_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Runs of letters and digits that carry more information than words and numbers do."""
    out: list[tuple[str, int, int]] = []
    if not text or not _DIGIT.search(text):
        return out
    for m in _RUN.finditer(text):
        run = m[0]
        if len(_SWITCH.findall(run)) >= SWITCHES:
            n = len(run)
            if -sum(c * math.log2(c / n) for c in Counter(run).values()) >= SECRET_BITS:
                out.append(("secret", *m.span()))
    return out


def every_span(text: str | None) -> list[tuple[str, int, int]]:
    """All entities of a text, by kind as listed, then start."""
    return base_spans(text) + secret_spans(text)


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _key(x: str) -> int:
    return xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63)


def entity(kind: str, value: str) -> int:
    return _key(f"{kind}:{value.lower() if kind in ('email', 'ip', 'secret') else _NOT_DIGIT.sub('', value)}")


KIND_CLASS = {k: _key(f"kind {k}") for k in _ALL_KINDS}


def contexts(text: str) -> list[tuple[int, int | None, int | None]]:
    """(class, term, context) of a text, once for each class (an entity or a kind) and term; (class, None, None) for each class."""
    spans = every_span(text)
    if not spans:
        return []
    words = [m.span() for m in _TERM.finditer(text)]
    starts, ends = [a for a, _ in words], [b for _, b in words]
    inside = sorted((a, b) for _, a, b in spans)
    free, k = [], 0  # words that are no part of an entity
    for a, b in words:
        while k < len(inside) and inside[k][1] <= a:
            k += 1
        free.append(not (k < len(inside) and inside[k][0] < b))
    out: dict[tuple[int, int | None], int | None] = {}
    for kind, start, end in spans:
        i, j = bisect_right(ends, start), bisect_left(starts, end)
        near = [range(max(0, i - WINDOW), i), range(j, min(j + WINDOW, len(words)))]
        before, after = ([text[slice(*words[k])].lower() for k in side if free[k]] for side in near)
        where = _key("\n".join([*before, "", *after]))
        for e in (entity(kind, text[start:end]), KIND_CLASS[kind]):
            out[e, None] = None
            for w in {*before, *after}:
                out.setdefault((e, _key(w)), where)
    return [(e, t, c) for (e, t), c in out.items()]


def _contexts(batches):
    for batch in batches:
        rows = [r for t in batch.column(0).to_pylist() if t for r in contexts(t)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["e", "t", "c"])


def _places(t: np.ndarray) -> list[np.ndarray]:
    """Bits of a Bloom filter for term hashes: three parts of the hash."""
    u = t.view(np.uint64)
    return [((u >> np.uint64(s)) & np.uint64((1 << BLOOM_BITS) - 1)).astype(np.int64) for s in (0, 19, 38)]


def _bloom(batches):
    """Filters of a part of the terms each, as (word, bits) rows."""
    bit = np.zeros(1 << BLOOM_BITS, dtype=bool)
    for batch in batches:
        for at in _places(batch.column(0).to_numpy()):
            bit[at] = True
    words = np.packbits(bit).view(np.int64)
    at = np.flatnonzero(words)
    for k in range(0, len(at), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(at[k : k + 100_000]), pa.array(words[at[k : k + 100_000]])], ["word", "bits"])


def bloom(terms: DataFrame) -> np.ndarray:
    """The filter of a column of term hashes: 4 MB however many there are (a full one lets everything through)."""
    rows = terms.mapInArrow(lean(_bloom), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros((1 << BLOOM_BITS) // 64, dtype=np.int64)
    words[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return words.view(np.uint8)


def passes(known: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Which term hashes a filter lets through: all that were put in, and some more."""
    return np.logical_and.reduce([(known[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1 for at in _places(t)])


def _hashes(words) -> np.ndarray:
    return np.array([_key(w) for w in words], dtype=np.int64)


def _frequency(shared):
    def run(batches):
        known, found = shared.value, Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text and len(t := _hashes(set(_TERM.findall(text.lower())))):
                    found.update(t[passes(known, t)].tolist())
            if len(found) > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["t", "n"])
                found.clear()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["t", "n"])

    return run


def revealing_terms(docs: DataFrame) -> DataFrame:
    """t (hash of a term), p (posterior of the class that it gives away best), bits; a staged table."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select("text")
    seen = texts.mapInArrow(lean(_contexts), "e long, t long, c long").groupBy("e", "t", "c").agg(F.count(F.lit(1)).alias("n"))
    enough = F.when(F.col("e").isin(*KIND_CLASS.values()), KIND_SUPPORT).otherwise(SUPPORT)
    counted = stage(seen.groupBy("e", "t").agg(F.sum("n").alias("co"), F.count(F.lit(1)).alias("support")).filter(F.col("t").isNull() | (F.col("support") >= enough)))
    pairs, entities = counted.filter("t IS NOT NULL"), counted.filter("t IS NULL").select("e", F.col("co").alias("de"))
    shared = spark.sparkContext.broadcast(bloom(pairs.select("t")))
    df = texts.mapInArrow(lean(_frequency(shared)), "t long, n long").groupBy("t").agg(F.sum("n").alias("df"))
    prior = PRIOR * F.col("de") / F.lit(float(max(docs.count(), 1)))
    told = pairs.join(df, "t").join(entities, "e").withColumn("p", F.least((F.col("co") + prior) / (F.col("df") + PRIOR), F.lit(1.0)))
    told = told.withColumn("bits", F.log2(F.col("p") * PRIOR / prior))
    out = stage(told.filter((F.col("p") >= GENERAL) & (F.col("bits") >= BITS)).groupBy("t").agg(F.max("p").alias("p"), F.max("bits").alias("bits")))
    release(counted)
    return out


class Terms:
    """A slice of revealing terms: sorted hashes, and which of them are removed."""

    def __init__(self, t: np.ndarray, remove: np.ndarray):
        order = np.argsort(t)
        self.t, self.remove = t[order], remove[order]

    def among(self, text: str) -> dict[str, bool]:
        """The terms of a text, in lower case: are they removed?"""
        words = list(set(_TERM.findall(text.lower()))) if len(self.t) else []
        if not words:
            return {}
        h = _hashes(words)
        at = np.minimum(np.searchsorted(self.t, h), len(self.t) - 1)
        return {words[k]: bool(self.remove[at[k]]) for k in np.flatnonzero(self.t[at] == h)}


def slices(terms: DataFrame) -> list:
    """Broadcasts of the terms, at most about SLICE in each; one at least."""
    spark = terms.sparkSession
    n = max(1, -(-terms.count() // SLICE))
    out = []
    for k in range(n):
        got = terms.filter(F.pmod(F.xxhash64("t"), F.lit(n)) == k).select("t", (F.col("p") >= REMOVE).alias("remove")).toArrow()
        out.append(spark.sparkContext.broadcast(Terms(got["t"].to_numpy(), got["remove"].to_numpy(zero_copy_only=False).astype(bool))))
    return out


def term_spans(text: str, terms: Terms, found: list[tuple[str, int, int]]) -> list[tuple[int, int, bool]]:
    """(start, end, is removed) of the terms of one slice outside the entities."""
    hit = terms.among(text)
    if not hit:
        return []
    taken = sorted((a, b) for _, a, b in found)
    out, k = [], 0
    for m in _TERM.finditer(text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if (w := m[0].lower()) in hit and not (k < len(taken) and taken[k][0] < m.end()):
            out.append((*m.span(), hit[w]))
    return out


TERMS = "array<struct<start: long, end: long, remove: boolean>>"


def _marked(shared):
    def run(batches):
        for batch in batches:
            i = batch.schema.get_field_index("__terms")
            found = batch.column(i).to_pylist()
            for k, t in enumerate(batch.column("text").to_pylist()):
                if t and (new := term_spans(t, shared.value, every_span(t))):
                    found[k] = [*(found[k] or []), *({"start": a, "end": b, "remove": r} for a, b, r in new)]
            yield batch.set_column(i, batch.schema.field(i), pa.array(found, batch.schema.field(i).type))

    return run


def with_terms(docs: DataFrame) -> tuple[DataFrame, object]:
    """docs with one more column, __terms (the spans of revealing terms of all slices but the last), and the last slice.

    Whoever finishes the rows marks the last slice, so in the usual case of one slice texts go to Python once.
    """
    if "__terms" in docs.columns:
        raise ValueError("column __terms is reserved")
    out = docs.withColumn("__terms", F.lit(None).cast(TERMS))
    *first, last = slices(revealing_terms(docs))
    for part in first:
        out = out.mapInArrow(lean(_marked(part)), out.schema)
    return out, last


def found_in(text: str | None, before: list[dict] | None, last: Terms) -> tuple[list, list]:
    """Entities of a text, and its revealing terms by start as (start, end, is removed)."""
    if not text:
        return [], []
    found = every_span(text)
    return found, sorted([*((x["start"], x["end"], x["remove"]) for x in before or []), *term_spans(text, last, found)])


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, their digest, all spans, and counts of secrets, revealing terms and all spans."""
    marked, last = with_terms(docs.select("doc_id", "text"))
    base = len(KINDS)

    def run(batches):
        for batch in batches:
            rows = []
            for i, text, before in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "__terms"))):
                found, terms = found_in(text, before, last.value)
                n = Counter(k for k, _, _ in found)
                every = [*found, *(("term", a, b) for a, b, _ in terms)]
                digest = hashlib.sha256(joined(x for x in found if x[0] != "secret").encode()).hexdigest()
                rows.append((i, *(n[k] for k in KINDS), digest, joined(every), n["secret"], len(terms), len(every)))
            kinds = [pa.int64()] * (base + 1) + [pa.string()] * 2 + [pa.int64()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names)

    counts = [f"n_{k}" for k in KINDS]
    names = ["doc_id", *counts, "base_sha256", "spans", "n_secret", "n_term", "n_private"]
    return marked.mapInArrow(lean(run), ", ".join(f"{c} {'string' if c in ('base_sha256', 'spans') else 'long'}" for c in names))


def sanitised(text: str, found: list, terms: list) -> str:
    """The text with entities replaced by their kind and terms generalised or removed; overlapping spans fall together."""
    spans = [(a, b, f"[{k.upper()}]") for k, a, b in found] + [(a, b, "" if remove else "[TERM]") for a, b, remove in terms]
    out, at = [], 0
    for a, b, put in sorted(spans):
        if a >= at:
            out += [text[at:a], put]
        at = max(at, b)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with sanitised texts; n_chars, where it is a column, follows the text."""
    columns, schema = docs.columns, docs.schema
    marked, last = with_terms(docs)

    def run(batches):
        for batch in batches:
            texts = [t and sanitised(t, *found_in(t, x, last.value)) for t, x in zip(batch.column("text").to_pylist(), batch.column("__terms").to_pylist())]
            out = batch.select(columns)
            yield out.set_column(columns.index("text"), out.schema.field("text"), pa.array(texts, out.schema.field("text").type))

    out = marked.mapInArrow(lean(run), schema)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(schema["n_chars"].dataType)) if "n_chars" in columns else out


def op2_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
