"""Divergence of sources, periodic runs and Merkle fingerprints against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtrack.llm import divergence, merkle, runs

WORDS = "[^\\x20\\x09-\\x0D]+"


# ---- source divergence


def plain_divergence(rows, ranks=200):
    """Straight from the definition: every group gives every kept term."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for _, _, ts in mine for t in set(ts))
        kept = sorted(t for t, n in df.items() if n >= 3)
        sources = sorted({d[1] for d in mine})

        def shares(texts):
            n = Counter(t for ts in texts for t in ts if df[t] >= 3)
            total = sum(n.values())
            return n, {t: 1 + 10**9 * (n[t] + 1) // (total + len(kept)) for t in kept}

        _, whole = shares([ts for _, _, ts in mine])
        by = {s: shares([ts for _, x, ts in mine if x == s]) for s in sources}
        for s in sources:
            n, p = by[s]
            pairs = sorted(((-sum((p[t] - by[o][1][t]) ** 2 // by[o][1][t] for t in kept), o) for o in sources if o != s), key=lambda x: (x[0], x[1].encode()))
            terms = sorted(((-((p[t] - whole[t]) ** 2 // whole[t]), t) for t in kept if n[t] and p[t] > whole[t]), key=lambda x: (x[0], x[1].encode()))[:ranks]
            out |= {(lang, s, part, item, -v, k) for part, found in (("pair", pairs), ("term", terms)) for k, (v, item) in enumerate(found, 1)}
    return out


def audit(spark, rows):
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumn("term", F.lit("clash")).withColumn("n", F.lit(1))
    out = [(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in divergence.source_divergence(docs).collect()]
    assert len(out) == len(set(out))
    return set(out)


@pytest.mark.parametrize("small", [False, True])
def test_divergence_against_brute_force(spark, monkeypatch, small):
    if small:  # many blocks of terms, several deals of sources, parts of texts, counts handed on often
        for name, value in (("BLOCK", 8), ("SOURCES", 2), ("HELD", 50), ("PIECE", 16)):
            monkeypatch.setattr(divergence, name, value)
    rng = random.Random(3)
    vocabulary = [f"{a}{b}" for a in ("Ab", "é", "zÜ", "日", "x") for b in ("a", "b", "C", "ñ", "q", "Z")]
    rows = []
    for k in range(120):
        words = rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(len(vocabulary))], k=rng.randrange(0, 40))
        rows.append((rng.choice(["en", "de"]), f"s{rng.randrange(7)}", rng.choice([" ", ", ", "1", "_\n"]).join(words)))
    rows += [rows[0], rows[0], (None, None, "Ab Ab"), (None, "x", None), ("en", None, ""), ("fr", "only", "une deux"), ("en", "s0", "ab " * 5000), ("en", "bare", "12 34")]
    assert audit(spark, rows) == plain_divergence(rows)


def test_divergence_of_nothing(spark):
    assert audit(spark, []) == set()
    rows = [("en", "a", "one"), ("en", "b", "one two")]  # no term in three documents
    assert audit(spark, rows) == plain_divergence(rows) == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}


def test_shares_beyond_a_long(spark):
    row = spark.range(1).select(divergence._share(F.lit(10**11), F.lit(3 * 10**11), F.lit(7)).alias("p")).first()
    assert row.p == 1 + 10**9 * (10**11 + 1) // (3 * 10**11 + 7)


# ---- periodic runs


def plain_runs(x):
    """Every period, every maximal stretch, kept where no smaller period fits."""
    n, out = len(x), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            s, e = i, j + q
            if j > i and e - s >= max(12, 2 * q) and not any(all(x[k] == x[k + d] for k in range(s, e - d)) for d in range(1, q)):
                out.append((s, e - s, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(rng, n, m):
    x = list(rng.integers(0, m, n))
    if n > 14 and rng.random() < 0.7:
        a = int(rng.integers(0, n - 10))
        p = int(rng.integers(1, max(2, (n - a) // 2)))
        x = x[:a] + [x[a + i % p] for i in range(n - a)]
        if rng.random() < 0.5:
            x += list(rng.integers(0, m, 20))
    return [int(v) for v in x]


@pytest.mark.parametrize("seed", range(60))
def test_runs_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    texts = [planted(rng, int(rng.choice([0, 5, 12, 13, 30, 60, 120, 250])), int(rng.choice([1, 2, 3, 8, 1000]))) for _ in range(rng.integers(1, 7))]
    ends = np.cumsum([len(t) for t in texts])
    want, before = [], 0
    for t in texts:
        want += [(s + before, n, q) for s, n, q in plain_runs(t)]
        before += len(t)
    assert [tuple(r) for r in runs.find_runs(np.array(sum(texts, []), np.int64), ends).tolist()] == want


def test_transform_is_exact():
    rng = np.random.default_rng(0)
    for size in (8, 64, 1024):
        a, b = rng.integers(0, runs.PRIME, (2, 2, size))
        product = runs.inverse(runs.transform(a.astype(np.uint64)) * runs.transform(b.astype(np.uint64)) % np.uint64(runs.PRIME))
        k = int(rng.integers(size))
        want = sum(int(a[0, i]) * int(b[0, (k - i) % size]) for i in range(size)) % runs.PRIME
        assert int(product[0, k]) == want and (runs.inverse(runs.transform(a.astype(np.uint64))) == a).all()


def test_sums_that_are_multiples_of_the_prime(monkeypatch):
    """With a tiny prime most seeds are false; extensions refute them."""
    monkeypatch.setattr(runs, "PRIME", 193)
    monkeypatch.setattr(runs, "_scales", lambda longest: iter((2, 4, 8)))
    def twiddles(size, inverse):
        root = pow(5, 192 // size, 193)  # 5 generates the group
        root = pow(root, 191, 193) if inverse else root
        powers = np.array([pow(root, k, 193) for k in range(max(1, size // 2))], np.uint64)
        out = []
        while size > 1:
            out.append(powers)
            powers, size = powers[::2], size // 2
        return out

    monkeypatch.setattr(runs, "_twiddles", twiddles)
    x = np.random.default_rng(5).integers(0, 400, 60).tolist()
    x = x[:20] + x[20:31] * 4 + x[31:]
    assert [tuple(r) for r in runs.find_runs(np.array(x, np.int64), np.array([len(x)])).tolist()] == plain_runs(x)


def plain_row(doc_id, text):
    words = re.findall(WORDS, text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    first = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (len(found), *first, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_runs_of_documents(spark):
    rng = np.random.default_rng(9)
    rows = [(k, " ".join(rng.choice(["a", "é", "B", "日", "c\x1cd", "x\x85"], int(rng.integers(0, 90)))), "clash") for k in range(80)]
    rows += [(100, None, ""), (101, "", ""), (102, " \n", ""), (None, "ab cd\t" * 12, ""), (3, rows[3][1], ""), (103, "x " * 30000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, period string")
    key = lambda r: tuple(str(v) for v in r)
    got = [tuple(r) for r in runs.periodic_runs(docs, plant=True).collect()]
    assert sorted((r for r in got if r[0] != 103), key=key) == sorted(((i, *plain_row(i, t)) for i, t, _ in rows if i != 103), key=key)
    assert [r[1:5] for r in got if r[0] == 103] == [(1, 0, 30000, 1)]
    assert runs.periodic_runs(docs.limit(0)).count() == 0
    text_ids = docs.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text")
    assert runs.periodic_runs(text_ids, plant=True).count() == len(rows)
    with pytest.raises(TypeError):
        runs.periodic_runs(docs.select(F.col("doc_id").cast("double").alias("doc_id"), "text"), plant=True)


# ---- Merkle fingerprints

ODD = [None, "", " ", "\n", "a", "abcdefg", "A b c d e f.\n\nG h i\n", "x" * 5000, "no spaces日本語" * 40, "w " * 4000, "same line\n" * 70, "a\r\nb\tc", "|:;.,0f", "0f0f0f0f.0f0f0f"]


def prose(rng, n):
    return "".join(rng.choice(["lorem ", "ipsum, ", "dolor. ", "sit\n", "amet " + str(rng.randrange(9999)) + " "]) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    return ODD + [prose(rng, rng.randrange(3, 400)) for _ in range(60)]


def plain_fingerprint_leaves(text):
    """Pieces (or bits) cut with plain loops over the same patterns."""
    cut = lambda t, p: [x for x in re.findall(p, t) if x]
    paragraphs = [p for p in re.split(r"(?<=\n)", text) if p]
    pieces = [h for p in paragraphs for h in (hashlib.sha256(x.encode()).hexdigest()[:6] for x in cut(p, merkle._PIECE))]
    bits = [hashlib.sha256(x.encode()).hexdigest()[:6] for x in cut(text, merkle._BIT)]
    return (pieces if len(text) >= 300 else [], bits if len(text) < 600 else [])


def test_fingerprints_and_edits_against_brute_force(spark, texts):
    rows = [(10 * k - 50, t, "clash") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string").repartition(7)
    got = {r.doc_id: r for r in merkle.edits_and_fingerprints(docs).collect()}
    assert len(got) == len(rows)
    seen = {}
    for k, (i, t, _) in enumerate(rows):
        t, following = t or "", texts[(k + 1) % len(texts)] or ""
        take = len(t) // 4
        edited = t[: len(t) - take] + following[:take]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        for fingerprint, of in ((r.fingerprint, t), (r.edited_fingerprint, edited)):
            assert seen.setdefault(of, fingerprint) == fingerprint
        for near, other in ((r.near_edited, edited), (r.near_next, following)):
            (p1, b1), (p2, b2) = plain_fingerprint_leaves(t), plain_fingerprint_leaves(other)
            a, b = (Counter(b1), Counter(b2)) if b1 and b2 else (Counter(p1), Counter(p2))
            want = 1.0 if t == other else 2 * (a & b).total() / (a.total() + b.total()) if a or b else 0.0
            assert near == pytest.approx(want, abs=1e-12), (t[:50], other[:50])
        if len(t) > 40 and set(t) - {"x"}:
            assert r.near_edited >= 0.4
    assert len({merkle_root for merkle_root in (f.split("|")[0] for f in seen.values())}) == len(seen)


def test_fingerprints_of_repeated_rows_and_nothing(spark):
    rows = [(2, "a b c d e f g h"), (None, "first of all, a null id"), (2, "a b c d e f g h"), (2, "z y x w v u t s"), (1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = merkle.edits_and_fingerprints(docs).collect()
    assert len(got) == 5 and len({tuple(r) for r in got if r.doc_id == 2}) == 2
    alone = merkle.edits_and_fingerprints(docs.limit(1)).first()
    assert alone.near_next == 1.0 and merkle.edits_and_fingerprints(docs.limit(0)).count() == 0
    named = docs.select(F.concat(F.lit("d"), "doc_id").alias("key"), F.col("text").alias("body"))
    assert merkle.edits_and_fingerprints(named, "key", "body").count() == 5


def test_differences_locate_edits(spark):
    lines = [f"Line number {k} says something of its own.\n" for k in range(100)]
    changed = lines[:37] + ["Another line.\n"] + lines[38:70] + ["New.\n"] + lines[70:]
    df = spark.createDataFrame([("".join(lines), "".join(changed))], "a string, b string")
    df = merkle.add_fingerprint(merkle.add_fingerprint(df, "a", "fa"), "b", "fb")
    df = merkle.add_differences(merkle.add_differences(merkle.add_differences(df, "fa", "fb", "gone"), "fb", "fa", "new"), "fa", "fa", "same")
    row = df.first()
    assert [tuple(x) for x in row.gone] == [(2, 5)] and [tuple(x) for x in row.new] == [(2, 5), (4, 6)] and row.same == []


def test_fingerprints_run_without_python_workers(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plan = merkle.edits_and_fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
