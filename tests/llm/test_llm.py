"""The training-data operators: brute force on small fixtures, odd rows, exact round trips, held-out accuracy."""

import collections
import hashlib
import itertools
import json
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cohortloom import session
from cohortloom.llm import catalog, chat, embeddings, fingerprint, language, minhash, mixing, pii, quality, segmentation, shingles, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def words():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(800)]
    return lambda n, seed: [random.Random(seed * 1000 + k).choice(vocabulary) for k in range(n)]


def odd_rows(words):
    return [(1, None, "a"), (2, "", "a"), (3, " \n", None), (4, "one", "a"), (5, "one", "b"), (5, "one", "b"), (None, "two words", "b"), (6, "x" * 200_000, "c"), (7, " ".join(words(30_000, 9)), "c")]


# ---- mixing


def test_mix_targets_and_balance(spark, words):
    rng = random.Random(1)
    rows = [(i, " ".join(words(rng.randint(1, 60), i)), s) for i, s in enumerate(["a"] * 900 + ["b"] * 300 + [None] * 60 + ["z"] * 3)]
    units = documents(spark, rows).select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    got = mixing.mix(units).toPandas()
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    order = ["a", "b", "z", None]
    weight, total = {s: k % 3 + 1 for k, s in enumerate(order)}, sum(size.values())
    capped: dict = {}
    while True:
        left = [s for s in order if s not in capped]
        share = {s: (total - sum(capped.values())) * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 3 * size[s]]
        if not over:
            break
        capped |= {s: 3 * size[s] for s in over}
    target = {**share, **capped}
    for s in order:
        part = got[got.source.isna() if s is None else got.source == s]
        assert part.target.iloc[0] == pytest.approx(target[s], rel=1e-12) and part.source_size.iloc[0] == size[s]
        assert abs(part.taken.sum() - target[s]) <= max(3, 0.002 * target[s])
    assert (got.taken <= 3 * got["size"]).all() and len(got) == len(rows)
    again = mixing.mix(units.repartition(5)).toPandas()
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()


def test_flight_keeps_totals():
    rng = np.random.default_rng(0)
    size, p = rng.integers(1, 500, 300), np.full(300, 0.37)
    q = mixing.flight(size, p, rng)
    assert ((q > 0) & (q < 1)).sum() <= 2 and q.sum() == pytest.approx(p.sum()) and q @ size == pytest.approx(p @ size)


def test_mix_odd_rows(spark, words):
    df = documents(spark, odd_rows(words)).withColumn("taken", F.lit(1))
    out = mixing.mix_documents(df)
    assert out.columns == df.columns and not out.filter("text IS NULL OR text = ''").count()
    assert mixing.mix_documents(df.limit(0)).count() == 0


# ---- near-duplicates


def brute_components(texts, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    top = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = top[i], top[j]
            top = [min(x, y) if v in (x, y) else v for v in top]
    return [len(s) for s in sets], top


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates_against_brute_force(spark, words, percent):
    rng, texts = random.Random(7), []
    for g in range(12):
        base = words(rng.choice([7, 20, 60, 250, 700]), g)
        for k in range(rng.choice([1, 4, 12])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    passage = " ".join(words(55, 77))
    texts += [" ".join(words(60, 100 + k)) + " " + passage for k in range(30)] + ["", None, "A b", "a B", texts[0].upper()]
    n, top = brute_components(texts, percent)
    got = {r.doc_id: r for r in minhash.near_duplicates(documents(spark, [(i, t, "s") for i, t in enumerate(texts)]), percent).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == n
    assert [got[i].component_id for i in range(len(texts))] == top


def test_every_near_pair_is_compared_in_one_list():
    # without a pivot: all pairs of a list that pass, each from one of its shared lists
    rng, lists, sketches = np.random.default_rng(3), collections.defaultdict(list), []
    for g in range(150):
        n = int(rng.integers(8, 90))
        base = rng.integers(0, 2**32, n, dtype=np.uint64)
        for k in range(3):
            s = base.copy()
            s[: k * (n // 30)] = rng.integers(0, 2**32, k * (n // 30), dtype=np.uint64)
            sketches.append(np.unique(s))
    for rep, s in enumerate(sketches):
        keys = minhash.run_keys(s[: minhash.K], len(s), 85)
        assert (keys[1:] > keys[:-1]).all()
        for key in keys.tolist():
            lists[key].append({"key": key, "i": 0, "j": 0, "rep": rep, "comp": rep, "n": len(s), "block": 0, "sketch": s.astype(np.uint32).tobytes()})
    rows = [r for _, members in sorted(lists.items()) if len(members) > 1 for r in members]
    want = set()
    for i, j in itertools.combinations(range(len(sketches)), 2):
        both = len(np.intersect1d(sketches[i], sketches[j]))
        if i // 3 == j // 3 and 100 * both >= 85 * (len(sketches[i]) + len(sketches[j]) - both):
            want.add((i, j))
    got = [(r["a"], r["b"]) for out in minhash._pairs(85, False)([pa.RecordBatch.from_pylist(rows)]) for r in out.to_pylist()]
    assert len(want) > 200 and set(got) == want and len(got) == len(want), (len(set(got)), len(want))


def test_a_pair_is_verified_once(spark, words, monkeypatch):
    # texts just under the likeness pass the estimate and fail on full sets: later rounds must not fetch these sets again
    rng, base = random.Random(4), words(1500, 3)
    texts = []
    for changed in (0, 2, 2, 2, 28, 27, 28, 29, 27, 28):
        w = list(base)
        for k in rng.sample(range(0, 1500, 6), changed):
            w[k] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    seen, verified = [], minhash.verified

    def spied(pairs, *more):
        seen.extend(map(tuple, pairs.collect()))
        return verified(pairs, *more)

    monkeypatch.setattr(minhash, "verified", spied)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts, 85)[1]
    assert len(seen) > len(set(got.values())) > 1 and len(seen) == len(set(seen)), sorted(seen)


def counting(monkeypatch, folder):
    """Let the step on pairs leave its number of rows in folder; the function tells them all."""
    made = minhash._pairs

    def spied(*args):
        run = made(*args)

        def counted(batches):
            seen = []
            yield from run(seen.append(b.num_rows) or b for b in batches)
            with open(f"{folder}/{os.getpid()}-{random.random()}", "w") as f:
                f.write(str(sum(seen)))

        return counted

    monkeypatch.setattr(minhash, "_pairs", spied)
    return lambda: sum(int(p.read_text()) for p in folder.iterdir())


def test_long_lists_of_near_copies_make_rows_in_proportion(spark, words, monkeypatch, tmp_path):
    # copies with few to many edits meet in many long lists: each list sent all its members to all its blocks
    rng, base, texts = random.Random(8), words(60, 6), []
    for _ in range(250):
        w = list(base)
        for k in rng.sample(range(60), rng.randint(1, 5)):
            w[k] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rows = counting(monkeypatch, tmp_path)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    want = brute_components(texts, 85)[1]
    assert [got[i] for i in range(250)] == want and len(set(want)) < 250
    assert rows() < 14_000, rows()  # 19,537 when each long list was on its own


def test_components_without_a_pair_leave_their_list(spark):
    # list 1 has a pair of components 1 and 3: 5 leaves it, 2 and 4 stay with theirs; list 2 has no pair
    live = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (1, 3, 3), (1, 4, 3), (1, 5, 5), (2, 1, 1), (2, 5, 5)], "key long, rep long, comp long")
    live = live.withColumn("size", F.lit(9).cast("long")).withColumn("gathered", F.col("key") == 1)
    pairs = spark.createDataFrame([(1, 2, 3)], "key long, a long, b long")
    got = sorted(map(tuple, minhash.still_open(live, pairs).select("key", "rep", "size", "gathered").collect()))
    assert got == [(1, 1, 4, True), (1, 2, 4, True), (1, 3, 4, True), (1, 4, 4, True)]


def test_blocks_are_compared_piece_by_piece(monkeypatch):
    # blocks of a very long list are larger than what is compared at once: the pairs stay the same
    rng, base = np.random.default_rng(6), np.random.default_rng(7).integers(0, 2**32, 60, dtype=np.uint64)
    rows = []
    for rep in range(50):
        s = base.copy()
        s[: rep % 7] = rng.integers(0, 2**32, rep % 7, dtype=np.uint64)
        rows.append({"rep": rep, "comp": rep // 2, "n": 60, "sketch": np.unique(s).astype(np.uint32).tobytes(), "gathered": True})
    blocks = [[r | {"key": 5, "i": i, "j": j, "block": r["rep"] % 2} for r in rows if r["rep"] % 2 in (i, j)] for i, j in ((0, 0), (0, 1), (1, 1))]

    def pairs(best):
        return sorted((r["a"], r["b"]) for b in blocks for out in minhash._pairs(85, best)([pa.RecordBatch.from_pylist(b)]) for r in out.to_pylist())

    whole, few = pairs(False), set(pairs(True))
    monkeypatch.setattr(minhash, "BLOCK", 4)
    assert len(whole) > 200 and pairs(False) == whole and len(set(whole)) == len(whole)
    assert few <= set(whole) and {r // 2 for x in pairs(True) for r in x} == {r // 2 for x in whole for r in x}


def test_texts_are_read_and_staged_in_bounded_pieces(spark):
    # a task of long texts must not hold row groups of 128 MB nor vectors of 4096 texts
    text = F.expr("concat_ws('', transform(sequence(1, 150), i -> sha2(concat(id, '-', i), 256)))")
    made = session.stage(spark.range(0, 5000, 1, 1).select("id", text.alias("text")))
    groups = [m.row_group(k).total_byte_size for f in made.inputFiles() for m in [pq.ParquetFile(f.removeprefix("file://")).metadata] for k in range(m.num_row_groups)]
    assert sum(groups) > 40e6 and max(groups) < 24e6, groups
    session.release(made)
    name = "spark.sql.parquet.columnarReaderBatchSize"
    was = spark.conf.get(name)
    try:
        spark.conf.unset(name)
        session.ship(spark)
        assert int(spark.conf.get(name)) <= 512
        spark.conf.set(name, "1000")
        session.ship(spark)
        assert spark.conf.get(name) == "1000"
    finally:
        spark.conf.set(name, was)


def test_near_duplicates_odd_rows(spark, words):
    df = documents(spark, odd_rows(words)).withColumn("rep", F.lit(1))
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()}
    assert got[(1, 0)] == (1, True) and got[(4, 1)] == (4, True) and got[(5, 1)] == (4, False) and got[(None, 1)] == (None, True)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_texts_of_one_id_link_on_their_own(spark, words):
    a, b = words(60, 1), words(60, 2)
    rows = [(5, " ".join(a), "s"), (5, " ".join(b), "s"), (2, " ".join([*a, "x"]), "s"), (3, " ".join([*b, "y"]), "s"), (5, " ".join(a), "t"), (4, None, "s"), (4, "", "s")]
    df = documents(spark, rows)
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect())
    assert got == [(2, 2, True), (3, 3, True), (4, 4, True), (4, 4, True), (5, 2, False), (5, 2, False), (5, 3, False)]
    assert sorted((r.doc_id, r.text) for r in minhash.one_of_each(df).filter("length(text) > 0").collect()) == [(2, rows[2][1]), (3, rows[3][1])]
    alone = documents(spark, [(1, " ".join(a), "s"), (1, " ".join(b), "s"), (1, " ".join(b), "t"), (None, "", "s")])
    assert sorted(str(r.text) for r in minhash.one_of_each(alone).collect()) == sorted([" ".join(a), " ".join(b), ""])


def test_estimates_of_all_pairs_are_union_estimates():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**32, n, dtype=np.uint64)).astype(np.uint32) for n in (5, 200, 256, 300, 2000)]
    sets += [np.unique(np.r_[s[: len(s) * 9 // 10], rng.integers(0, 2**32, len(s) // 10, dtype=np.uint64).astype(np.uint32)]) for s in sets]
    n, sketches = np.array([len(s) for s in sets]), [s[: minhash.SKETCH] for s in sets]
    k = np.arange(len(sets))
    i, j, e = minhash.compared(sketches, n, k, k, ~np.eye(len(k), dtype=bool), 1)
    want = {(a, b): minhash.union_estimate(sketches[a], n[a], sketches[b], n[b]) for a in k for b in k}
    assert all(want[a, b] == pytest.approx(x, abs=1e-6) for a, b, x in zip(i, j, e)) and len(i) >= 10


def test_shared_values_in_slices(monkeypatch):
    monkeypatch.setattr(minhash, "COLUMNS", 7)
    rng = np.random.default_rng(0)
    x = [np.unique(rng.integers(0, 200, 60)).astype(np.uint32) for _ in range(9)]
    got = minhash.shared(x, np.arange(4), np.arange(4, 9))
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in x[4:]] for a in x[:4]]


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(100, 40), (40, 70)], "a long, b long")
    got = dict(shingles.components(links).collect())
    assert all(got[k] == 0 for k in range(21)) and got[100] == got[70] == got[40] == 40


# ---- personal data


def brute_base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda d: sum(int(c) if k % 2 == 0 else (int(c) * 2) // 10 + (int(c) * 2) % 10 for k, c in enumerate(d[::-1])) % 10 == 0
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]


def test_base_spans_against_plain_patterns():
    rng = random.Random(11)
    pieces = ["a@b.c", "x.y@mail1.example.com", "@@", "a@b", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111", "12 34", "+1 (168) 555-5254", "+44", "+", " ", "-", ".", "é", "9", "word", "a.b@c.d@e.f", "0001.2.3.004"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 9)))
        assert pii.base_spans(text) == brute_base(text), text
    assert pii.base_spans("1" * 50_000 + ".1.1.1") == [] and pii.base_spans("a" * 100_000) == []


def test_revealing_terms(spark, words):
    rows = [(i, " ".join([*words(20, i), "blorptag", f"ann@mail.example.com", *words(20, 500 + i)]), "s") for i in range(8)] + [(50 + i, " ".join(words(60, 900 + i)), "s") for i in range(140)] + [(300 + i, "filler", "s") for i in range(200)]
    rows.append((200, "only blorptag here", "s"))
    df = documents(spark, rows)
    got = {r.doc_id: r for r in pii.find(df).collect()}
    assert got[0].n_email == 1 and "term:" in got[0].spans and got[200].spans == "term:5:13"
    assert got[0].base_sha256 == hashlib.sha256(pii.joined(pii.base_spans(rows[0][1])).encode()).hexdigest()
    assert sum("term" in got[50 + i].spans for i in range(140)) == 0
    clean = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert "@" not in clean[0].text and "[EMAIL]" in clean[0].text and "blorptag" not in clean[200].text and clean[50].text == rows[8][1]
    assert clean[0].n_chars == len(clean[0].text)


def test_entity_frequency_is_of_the_corpus(spark, words):
    footer = "kindly send every question about this monthly letter straight from your own friendly office hot@mail.example.com"
    rows = [(i, f"{' '.join(words(20, i))} {footer}", "s") for i in range(100)] + [(100 + i, " ".join(words(20, i)), "s") for i in range(200)]
    rows += [(300 + i, f"{' '.join(words(9, 700 + i))} oddword hot@mail.example.com", "s") for i in range(4)] + [(400, "hot@mail.example.com", "s")]
    assert pii.revealing_terms(documents(spark, rows)).filter(F.col("t") == pii._key("oddword")).count() == 0


def test_terms_of_two_contexts_and_whole_words(spark, words):
    rows = [(i, f"{' '.join(words(12, i))} zq blorptag ann@mail.example.com {' '.join(words(12, 40 + i))}", "s") for i in range(2)]
    rows += [(10 + i, f"{' '.join(words(9, 5))} copytag bob@mail.example.com", "s") for i in range(2)]
    rows += [(100 + i, " ".join(words(60, 100 + i)), "s") for i in range(200)]
    got = {r.t for r in pii.revealing_terms(documents(spark, rows)).collect()}
    assert {pii._key("zq"), pii._key("blorptag")} <= got and pii._key("copytag") not in got
    long = [c * 50 for c in "bcdefghijk"]
    text = f"{' '.join(long)} ann@mail.example.com {' '.join(long)}"
    assert {t for _, t, _ in pii.contexts(text)} == {None, *map(pii._key, long)}


def brute_terms(texts):
    """Posterior and bits of every term and class by plain counting, without hashes, filters or joins."""
    low = [[w.lower() for w in re.findall(r"[^\W\d_]{2,}", t or "")] for t in texts]
    df = collections.Counter(w for ws in low for w in set(ws))
    co, support, de = collections.Counter(), collections.defaultdict(set), collections.Counter()
    for t in texts:
        spans = pii.base_spans(t) + pii.secret_spans(t)
        seen, first = set(), {}
        for kind, a, b in spans:
            inside = lambda m: any(x < m.end() and m.start() < y for _, x, y in spans)
            ms = list(re.finditer(r"[^\W\d_]{2,}", t))
            before = [m[0].lower() for m in [m for m in ms if m.end() <= a][-pii.WINDOW :] if not inside(m)]
            after = [m[0].lower() for m in [m for m in ms if m.start() >= b][: pii.WINDOW] if not inside(m)]
            for e in ((kind, re.sub("[^0-9]", "", t[a:b]) if kind in ("card", "phone") else t[a:b].lower()), kind):
                seen.add(e)
                for w in {*before, *after}:
                    first.setdefault((e, w), (tuple(before), tuple(after)))
        de.update(seen)
        for (e, w), where in first.items():
            co[e, w] += 1
            support[e, w].add(where)
    out = {}
    for (e, w), c in co.items():
        prior = de[e] / len(texts)
        p = (c + prior) / (df[w] + 1)
        if len(support[e, w]) >= (8 if isinstance(e, str) else 2) and p >= pii.GENERAL and math.log2(p / prior) >= pii.BITS:
            out[w] = max(p, out.get(w, 0))
    return out


def test_terms_against_brute_force(spark, words):
    rng, texts = random.Random(3), []
    mail = [f"{a}@mail{k}.example.com" for k, a in enumerate(("ann", "bob", "cyd"))]
    for i in range(400):
        w = words(rng.randint(5, 60), i)
        if i % 21 == 0:
            w.insert(rng.randrange(len(w)), f"close{rng.choice('xyz')} {rng.choice(mail)} lives")
        if i % 29 == 0:
            w.insert(rng.randrange(len(w)), f'token = "{rng.getrandbits(160):040x}"')
        if i % 13 == 0:
            w.insert(rng.randrange(len(w)), "+1 (168) 555-5254")
        texts.append(" ".join(w))
    texts += [None, "", "lives here", "9233801234567890123 AB12"]
    df = documents(spark, [(i, t, "s") for i, t in enumerate(texts)])
    want = brute_terms(texts)
    got = {r.t: r.p for r in pii.revealing_terms(df).collect()}
    assert {"token", "lives"} <= set(want) and got == {pii._key(w): pytest.approx(p) for w, p in want.items()}
    for r in pii.find(df).collect():
        t = texts[r.doc_id] or ""
        found = pii.every_span(t)
        spans = [m.span() for m in re.finditer(r"[^\W\d_]{2,}", t) if m[0].lower() in want and not any(a < m.end() and m.start() < b for _, a, b in found)]
        assert r.spans == pii.joined([*found, *(("term", *x) for x in spans)]) and r.n_term == len(spans) and r.n_private == len(found) + len(spans)
        assert r.n_secret == len(re.findall('"[0-9a-f]{40}"', t))


def test_slices_and_reserved_names(spark, words, monkeypatch):
    rows = [(i, " ".join([*words(12, i), "qtag", "ztag", "ann@mail.example.com", *words(12, 50 + i)]), "s") for i in range(6)] + [(100 + i, " ".join(words(60, 100 + i)), "s") for i in range(200)]
    df = documents(spark, rows)
    whole = sorted(pii.find(df).collect())
    monkeypatch.setattr(pii, "SLICE", 1)
    assert len(pii.slices(pii.revealing_terms(df))) > 1 and sorted(pii.find(df).collect()) == whole
    with pytest.raises(ValueError):
        pii.sanitise(df.withColumn("__terms", F.lit(1)))


def test_pii_odd_rows(spark, words):
    df = documents(spark, odd_rows(words)).withColumn("t", F.lit(1))
    assert pii.find(df).count() == df.count() and pii.sanitise(df).columns == df.columns and pii.find(df.limit(0)).count() == 0
    assert pii.sanitise(df).filter("doc_id = 1 AND text IS NULL").count() == 1


# ---- classifiers


def labelled_corpus(spark, words):
    docs, labels, rng = [], [], random.Random(2)
    for i in range(500):
        w = words(rng.randint(5, 80), i)
        bad, toxic = i % 6 == 0, i % 7 == 0
        if bad:
            w = [x + rng.choice(["###", "$$$", "%%%"]) for x in w]
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["zzidiotzz", "wwscumww"])
        docs.append((i, " ".join(w[: len(w) // 2]) + ". " + " ".join(w[len(w) // 2 :]) + ".", "s"))
        labels.append((i, int(not bad), int(toxic)))
    return documents(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_and_toxicity_held_out(spark, words):
    docs, labels = labelled_corpus(spark, words)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    truth = {r.doc_id: r for r in labels.collect()}
    q = {r.doc_id: r.score for r in quality.score(docs, quality.train(docs, labels)).collect()}
    assert np.mean([(q[i] >= 0.3) == truth[i].quality for i in q if held(i)]) >= 0.95
    model = toxicity.train(docs, labels)
    t = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert np.mean([(t[i] >= 0.5) == truth[i].toxic for i in t if held(i)]) >= 0.95
    found = toxicity.locate(docs, model).collect()
    assert found and all("idiot" in r.sentence or "scum" in r.sentence for r in found)
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(text[r.doc_id][r.start :].lstrip().startswith(r.sentence) for r in found)
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_classifiers_odd_rows(spark, words):
    df, none = documents(spark, odd_rows(words)).withColumn("score", F.lit(1)), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for got in (quality.score(df, quality.train(df, none)), toxicity.score(df, toxicity.train(df, none))):
        assert got.count() == df.count() and got.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    got = {r.doc_id: r.lang_pred for r in language.identify(df, language.train(df)).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[4] == "en"
    empty = df.limit(0)
    assert language.identify(empty, language.train(empty)).count() == 0 and quality.score(empty, quality.train(empty, none)).count() == 0


def test_quality_scores_against_plain_compression(spark, words):
    import zstandard

    docs, labels = labelled_corpus(spark, words)
    model = quality.train(docs, labels)
    coder = [zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False) for c in (model.good, model.bad)]
    at, share = model.fit
    for r in docs.join(quality.score(docs, model), "doc_id").limit(60).collect():
        x = r.text.encode()
        g, b = (sum(len(c.compress(x[i : i + quality.BLOCK])) for i in range(0, len(x), quality.BLOCK)) for c in coder)
        d = (b - g) / len(x)
        k = sum(v <= d for v in at)
        want = share[0] if k == 0 else share[-1] if k == len(at) else share[k - 1] + (share[k] - share[k - 1]) * (d - at[k - 1]) / (at[k] - at[k - 1])
        assert r.score == pytest.approx(want, abs=1e-12)
    assert (np.diff(at) > 0).all() and (np.diff(share) > 0).all() and len(model.good) == pytest.approx(len(model.bad), rel=0.02)
    assert quality.built(["a" * 100] * 5000).count(b"\n") == quality.ROOM // 101 and quality.built([]) == b""


def test_isotonic_against_brute_force():
    rng = np.random.default_rng(0)
    x = rng.normal(size=12).round(1)
    y, w = (rng.random(12) < 0.5).astype(float), rng.random(12) + 0.1
    at, share = quality.isotonic(x, y, w)
    order = np.argsort(x, kind="stable")
    # the fitted share of each row is the largest, over starts, of the smallest mean over ends
    mean = lambda i, j: (w[order][i:j] * y[order][i:j]).sum() / w[order][i:j].sum()
    fit = [max(min(mean(i, j) for j in range(k + 1, 13)) for i in range(k + 1)) for k in range(12)]
    assert sorted({round(float(v), 9) for v in fit}) == [round(float(v), 9) for v in share] and (np.diff(at) > 0).all()


def test_language_held_out(spark):
    syllables = {"xx": ["ka", "to", "mi"], "yy": ["bre", "zul", "fen"], "zz": ["eau", "oir", "ment"]}
    rng, rows = random.Random(4), []
    for i in range(300):
        lang = rng.choice(list(syllables))
        rows.append((i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(rng.randint(3, 30))), lang, "s", 0))
    df = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in language.identify(df, language.train(df)).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]) >= 0.98
    assert all(0 <= r.score <= 1 for r in got.values())


# ---- chat


def test_template_language():
    run = lambda s, **v: chat.compile_template(s)(**v)[0]
    assert run("a {{- ' b' + 'c' }} {# no #}{% if 1 == 2 %}x{% elif true %}y{% else %}z{% endif %}") == "a bc y"
    assert run("{% for m in xs %}{{ loop.index }}{{ m.k | upper }}{% if not loop.last %},{% endif %}{% endfor %}", xs=[{"k": "a"}, {"k": "b"}]) == "1A,2B"
    assert chat.fold(chat.parse("a{{ 'b' ~ 1 }}{% if false %}q{% endif %}c")) == [("output", ("constant", "ab1c"))]
    assert run("{{ x.__class__ }}{{ x['__class__'] }}{{ nothing.at.all }}", x="s") == ""
    for bad in ("{{ x() }}", "{% for %}{% endfor %}", "{{ x | eval }}", "{% if x %}", "{{ 1 +", "{% import os %}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)
    text, spans = chat.compile_template("u:{% generation %}{{ t }}{% endgeneration %};")(t="é!")
    assert text == "u:é!;" and spans == [(2, 4)]


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "\\<\\[\\\\", "<\\s>", "", None, "a</s><s>b", "[\\[", "日本<"]
    assert all(chat.unescape(chat.escape(t or "")) == (t or "") for t in hard)
    rows = [(k, n, "assistant" if n % 2 else "user", t) for k in range(3) for n, t in enumerate(hard)] + [(None, 0, None, "x"), (9, None, "<s>", "y"), (9, 1, "assistant", "z"), (9, 1, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    made = {r.conv_id: r for r in chat.format_conversations(df.repartition(4)).collect()}
    assert chat.read_back(made[0].formatted) == [(r or "", t or "") for _, _, r, t in rows[:8]]
    got = {r.conv_id: r for r in chat.digest_conversations(chat.format_conversations(df)).collect()}
    loss = "".join(t or "" for _, _, r, t in rows[:8] if r == "assistant")
    assert got[0].loss_chars == len(loss) and got[0].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and got[9].n_turns == 3 and got[None].n_turns == 1
    assert chat.format_conversations(df.limit(0)).count() == 0


# ---- segmentations


@pytest.fixture(scope="module")
def vocabulary():
    return segmentation.Vocabulary()


def test_segmentations_are_distinct_exact_and_decode(vocabulary):
    for text in ("then", "a  b\n", "▁x 日本", "", "aaaa", " \n \n", "x" * 500):
        out = vocabulary.samples(text, 3, 5)
        assert len({tuple(i) for i, _, _ in out}) == len(out) and all(vocabulary.decode(i) == text for i, _, _ in out)
    every = vocabulary.samples("then", 0, 1000)
    assert sum(math.exp(p) for _, p, _ in every) == pytest.approx(1) and all(q == 0 for _, _, q in every)
    first = collections.Counter(tuple(vocabulary.samples("then", k, 1)[0][0]) for k in range(4000))
    for ids, p, _ in every[:3]:
        assert first[tuple(ids)] / 4000 == pytest.approx(math.exp(p), abs=0.03)


def test_samples_do_not_depend_on_grouping(vocabulary):
    texts = ["then we met", None, "", "日本 x\n\n  y", "then we met", "q" * 900]
    together = segmentation.sample_texts(vocabulary, texts, [1, 2, 3, 4, 1, 6], 3)
    for text, key, found in zip(texts, [1, 2, 3, 4, 1, 6], together):
        alone = vocabulary.samples(text, key, 3)
        assert [(a.tolist(), b, c) for a, b, c in alone] == [(a.tolist(), b, c) for a, b, c in found]


def test_lattice_mass_matches_plain_recursion(vocabulary):
    """Probabilities of sampled paths against a plain recursion over all pieces of a word."""
    piece = {vocabulary.bytes[i].decode(): i for i in range(len(vocabulary.bytes)) if i not in vocabulary.byte_id and vocabulary.bytes[i]}
    word = " thennow"
    mass = [0.0] * len(word) + [1.0]
    for a in range(len(word) - 1, -1, -1):
        mass[a] = sum(math.exp(vocabulary.weight[piece[word[a:b]]]) * mass[b] for b in range(a + 1, len(word) + 1) if word[a:b] in piece)
    for ids, p, _ in vocabulary.samples(word[1:], 5, 6):
        assert p == pytest.approx(sum(vocabulary.weight[i] for i in ids) - math.log(mass[0]), abs=1e-8)


def test_inclusion_scores_match_frequencies(vocabulary):
    """Horvitz-Thompson: sum of p / inclusion over a sample estimates 1 without bias."""
    totals = [sum(math.exp(p - q) for _, p, q in vocabulary.samples("thenab", k, 3)) for k in range(3000)]
    assert np.mean(totals) == pytest.approx(1, abs=0.05)


def test_segment_odd_rows(spark, words):
    df = documents(spark, odd_rows(words)).withColumn("ids", F.lit(1))
    out = segmentation.segment(df)
    assert out.filter("doc_id = 1").collect()[0].ids == []
    back = segmentation.decode(out.filter("doc_id = 7")).collect()
    assert all(r.text == odd_rows(words)[-1][1] for r in back) and len(back) == 2
    a, b = (sorted(map(str, x.filter("doc_id = 5").collect())) for x in (out, segmentation.segment(df.repartition(3))))
    assert a == b and segmentation.segment(df.limit(0)).count() == 0


# ---- fingerprints


def test_fingerprints_against_brute_force(spark, words):
    texts = [" ".join(words(n, n)) for n in (1, 2, 40, 300, 301)] + ["", None, "abc", "äöü" * 50, " ".join(words(300, 300))]
    df = documents(spark, [(i, t, "s") for i, t in enumerate(texts)]).withColumn("pid", F.lit(1))
    got = {r.doc_id: r for r in fingerprint.fingerprints(df.repartition(6)).collect()}
    clean = [t or "" for t in texts]
    for i, t in enumerate(clean):
        following = clean[(i + 1) % len(clean)]
        m = len(t) // 4
        edited = t[: len(t) - m] + following[:m] if m else t
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == fingerprint.fingerprint(t) and r.edited_fingerprint == fingerprint.fingerprint(edited)
        assert r.near_next == pytest.approx(fingerprint.likeness(fingerprint.read(r.fingerprint), fingerprint.read(fingerprint.fingerprint(following))))
    assert got[3].fingerprint == got[9].fingerprint
    assert fingerprint.fingerprints(df.limit(0)).count() == 0 and fingerprint.fingerprints(df.limit(1)).count() == 1


def plain_fingerprint(text):
    """The walk character by character, and each slot's best place by a scan of all places."""
    bit = np.random.default_rng(8086).random((fingerprint.CLASSES, fingerprint.PERIOD)) < 0.5
    one = lambda x: int(fingerprint._hash(np.array([x % 2**64], dtype=np.uint64))[0])
    written, j = [], 0
    for at, c in enumerate(text):
        while True:
            written.append(at)
            j += 1
            if bit[one(ord(c)) % fingerprint.CLASSES, (j - 1) % fingerprint.PERIOD]:
                break
    best = {}
    for place in range(len(written)):
        h = one(place + 0x51ED270B)
        slot, rank = h % fingerprint.SLOTS, h >> 7
        if slot not in best or rank < best[slot][0]:
            best[slot] = rank, place
    out = []
    for slot in range(fingerprint.SLOTS):
        if slot in best:
            at, h = written[best[slot][1]], 0
            for i in range(3):
                h = (h * 0x100000001B3 + (ord(text[at + i]) if at + i < len(text) else 0) + 1) % 2**64
            out.append(f"{one(h) >> 56:02x}")
        else:
            out.append("..")
    return "".join(out)


def test_fingerprints_against_the_plain_walk(words):
    for text in ("", "a", "äöü 日本", " ".join(words(30, 1)), " ".join(words(400, 2))):
        assert fingerprint.fingerprint(text) == plain_fingerprint(text)


def test_near_fingerprints_against_brute_force(spark, words):
    rng, texts = random.Random(8), []
    for g in range(25):
        base = list(" ".join(words(rng.choice([30, 120, 400]), g)))
        for k in range(rng.choice([1, 3, 9])):
            t = list(base)
            for _ in range(rng.choice([0, 1, 2, 5])):
                t[rng.randrange(len(t))] = rng.choice("xyz")
            texts.append("".join(t))
    texts += ["", None, texts[0], texts[0]]
    prints = [fingerprint.fingerprint(t) for t in texts]
    rows = [(i, p) for i, p in enumerate(prints)] + [(None, prints[0])]
    got = {r.doc_id: r for r in fingerprint.with_near(spark.createDataFrame(rows, "doc_id long, fingerprint string").withColumn("rep", F.lit(1))).collect()}
    near = fingerprint.likenesses(fingerprint.symbols(prints), fingerprint.symbols(prints))
    x = fingerprint.symbols(prints)
    assert near[3, 7] == pytest.approx(fingerprint.likeness(x[3], x[7])) and near[3, 4] == pytest.approx(fingerprint.likeness(x[3], x[4]))
    top = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if texts[i] and texts[j] and near[i, j] >= fingerprint.CUT:
            low = min(top[i], top[j])
            top = [low if v in (top[i], top[j]) else v for v in top]
    links = [sum(bool(texts[i] and texts[j] and i != j and near[i, j] >= fingerprint.CUT) for j in range(len(texts))) for i in range(len(texts))]
    assert [got[i].near_links for i in range(len(texts))] == links and sum(links) > 50
    assert [got[i].near_class for i in range(len(texts))] == top and got[None].near_class is None


def test_edits_stay_near(words):
    t = " ".join(words(400, 8))
    near = lambda x: fingerprint.likeness(fingerprint.read(fingerprint.fingerprint(t)), fingerprint.read(fingerprint.fingerprint(x)))
    assert near(t[:300] + "inserted " + t[300:]) > 0.8 and near(t[:1000] + t[1010:]) > 0.8 and near(" ".join(words(400, 99))) < 0.1


# ---- embeddings


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(60, 32))
    x = np.r_[base, base[:30] + rng.normal(0, 0.05, (30, 32)), base[:5], base[5:15] + rng.normal(0, 0.28, (10, 32))]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(500, None), (501, []), (502, [0.0] * 32), (503, [float("nan")] * 32), (504, [1.0, None] * 16), (None, [1.0] * 32), (505, [1.0] * 8), (506, [float("inf")] + [0.0] * 31)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rep", F.lit(1))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    got = {r.vec_id: r for r in embeddings.near_vectors(df).collect()}
    assert [got[i].n_links for i in range(len(x))] == near.sum(1).tolist()
    assert all(got[i].n_links == 0 and got[i].kept for i in (500, 501, 502, 503, 504, None, 505, 506)) and len(got) == len(rows)
    assert got[60].component_id == 0 and not got[60].kept
    assert embeddings.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("true", [0.5, 0.8, 0.95])
def test_estimates_are_unbiased(true):
    rng, d, m = np.random.default_rng(1), 64, 7
    x = rng.normal(size=(3000, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    e = rng.normal(size=x.shape)
    e -= (e * x).sum(1, keepdims=True) * x
    y = true * x + math.sqrt(1 - true * true) * e / np.linalg.norm(e, axis=1, keepdims=True)
    bit, factor, error = embeddings.coded(x, m)
    got = np.array([embeddings.estimates(bit[k : k + 1], factor[k : k + 1], y[k : k + 1])[0, 0] for k in range(len(x))])
    assert abs(got.mean() - true) < 0.005
    z = (got - true) / (error * math.sqrt(1 - true * true))
    assert 0.85 < z.std() < 1.15 and np.abs(z).max() < embeddings.SURE


@pytest.mark.parametrize("d", [8, 32, 64, 384])
def test_pairs_at_the_threshold_share_a_key(d):
    rng, shape, n = np.random.default_rng(2), embeddings.tables(50_000), 20_000 if d < 100 else 4000
    x = rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    e = rng.normal(size=x.shape)
    e -= (e * x).sum(1, keepdims=True) * x
    y = 0.95 * x + math.sqrt(1 - 0.95**2) * e / np.linalg.norm(e, axis=1, keepdims=True)
    a, b = (embeddings.coded(v, embeddings.turns(d, shape))[0] for v in (x, y))
    missed = np.ones(n, dtype=bool)
    for cols in embeddings.sampled_bits(d, shape):
        missed &= (a[:, cols] != b[:, cols]).any(1)
    assert missed.mean() < 2e-3


def test_a_dense_group_makes_rows_in_proportion(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1, 64)) + rng.normal(0, 0.05, (1500, 64))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    _, classes = embeddings.numbered(df)
    rows = embeddings.block_links(classes.select("rep", "d", "size", "vector"))
    shape = embeddings.tables(1500)
    assert rows.count() <= 1500 * shape[0] * 3
    got = embeddings.near_vectors(df).collect()
    assert all(r.n_links == 1499 and r.component_id == 0 for r in got)


def test_different_vectors_of_one_id(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (3, [0.0, 1.0, 0.01]), (2, [1.0, 0.0, 0.01]), (0, [0.0, 0.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(df).collect())
    assert got == [(0, 0, 0, True), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]


# ---- pipeline


def test_pipeline_against_its_operators(spark, words, tmp_path):
    import corpus_pipeline

    docs, labels = labelled_corpus(spark, words)
    extra = documents(spark, [(1000, docs.filter("doc_id = 1").first().text, "s"), (1001, "mail ann@mail.example.com now", "t"), (1002, None, "t")])
    docs.unionByName(extra).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    sf, found, d = str(tmp_path), {}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, d, sf).write.parquet(str(tmp_path / str(k)))
        before, d = d, spark.read.parquet(str(tmp_path / str(k)))
        found[name] = d
        if k < 4:
            assert d.columns == before.columns
    good = {r.doc_id for r in found["quality classifier"].collect()}
    assert np.mean([(i in good) == bool(i % 6) for i in range(500)]) > 0.95
    one = found["near-duplicates"]
    assert one.count() == one.select("doc_id").distinct().count() and not one.filter("doc_id = 1000").count()
    texts = {r.doc_id: r.text for r in found["personal data"].collect()}
    assert all("@" not in (t or "") for t in texts.values())
    want = collections.Counter(r.doc_id for r in found["source mix"].collect())
    got = collections.Counter(r.doc_id for r in found["encoding"].filter("sample = 0").collect())
    assert want == got
    back = segmentation.decode(found["encoding"]).collect()
    assert all(r.text == texts[r.doc_id] for r in back)


def test_catalog_is_whole():
    names = [n for n in catalog.QUERIES if n.startswith("op")]
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in names] == list(range(1, 11)) and "pipeline" in catalog.QUERIES
    assert json.dumps(sorted(catalog.ORACLE_SQL))
