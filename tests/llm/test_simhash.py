"""SimHash links against brute force over all pairs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from loomtrack.llm import simhash

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("key", T.StringType())])


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, distance=4):
    fps = np.array(sorted(set(fps)), np.int64)
    root = np.arange(len(fps))
    near = np.array([[bin((a ^ b) & (2**64 - 1)).count("1") <= distance for b in fps.tolist()] for a in fps.tolist()]).reshape(len(fps), len(fps))
    while True:
        new = np.where(near, root[None, :], len(fps)).min(axis=1)
        if (new == root).all():
            return dict(zip(fps.tolist(), fps[root].tolist()))
        root = new


@pytest.mark.parametrize("text", ["", "one", "One TWO three", "a b c d e f g a b c d", "É ÀB\tc\x0bd e f", "x " * 9000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("block", [2048, 16])
def test_components_find_every_link(spark, block):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {b ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(7))}) for b in base for _ in range(30)}
    fps |= {base[0] ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(i)}  # a hot group that no one member spans
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = {r.fp: r.component for r in simhash.components(spark.createDataFrame([(f,) for f in fps], "fp long"), block=block).collect()}
    assert found == plain_components(fps)


@pytest.mark.parametrize("block", [2048, 16])
def test_links_over_the_sign_bit(spark, block):
    """Pairs that differ in bit 63 and up to three more bits, with no other chain between them, and a hot group of such links."""
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = set(base)
    for k, b in enumerate(base):
        fps.add(b ^ (1 << 63) ^ sum(1 << bit for bit in rng.sample(range(63), k % 5)))  # five bits in all are too far
    fps |= {base[0] ^ (1 << 63) ^ (1 << i) for i in range(40)}
    want = {}
    for f in sorted(fps, key=lambda f: f - (f >> 63 << 64)):  # as signed longs, so the first of a component is its smallest
        reached = [] if f in want else [f]
        while reached:
            at = reached.pop()
            want[at] = f
            reached += [g for g in fps if g not in want and bin(at ^ g).count("1") <= 4]
    signed = {f - (f >> 63 << 64): c - (c >> 63 << 64) for f, c in want.items()}
    found = {r.fp: r.component for r in simhash.components(spark.createDataFrame([(f,) for f in signed], "fp long"), block=block).collect()}
    assert found == signed


def test_whole_query(spark):
    text = " ".join(f"w{k}" for k in range(200))
    rows = [(3, text, "x", "y"), (1, text.upper(), None, None), (2, text.replace("w100 ", "v100 "), "", ""), (9, None, None, None), (8, "", None, None), (None, text, None, None), (5, "word " * 20000, None, None), (5, "word " * 20000, None, None)]
    out = sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect())
    assert len(out) == len(rows)
    by_id = {d: (f, c) for d, f, c in out}
    assert by_id[9] == ("0" * 16, 8) and by_id[8] == ("0" * 16, 8)
    assert by_id[3][1] == by_id[1][1] == by_id[-1][1] == 1
    assert all(f == f"{plain_fingerprint(t):016x}" for d, t, *_ in rows if d is not None for f in [by_id[d][0]])
    kept = sorted((r.doc_id, r.key) for r in simhash.keep_first(spark.createDataFrame(rows, DOCS)).collect())
    assert [d for d, _ in kept] == sorted({c for _, _, c in out})


def test_keep_first_of_ties_and_clashing_columns(spark):
    """Rows of one id and text: the same one stays in every order; any column name goes."""
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(1, text, k, "a", None, "x.y", 1) for k in range(6)] + [(1, text, None, "a", 0, "", 1), (2, text, 0, "a", None, "x.y", 1), (3, "other words here at all", 0, "b", 1, "", 2), (3, "other words here at all", 0, "b", 1, "", 2), (None, None, 1, "", 1, "", 3)]
    names = "doc_id long, text string, __id long, __hash string, row long, `a.b` string, n int"
    found = []
    for order in (rows, rows[::-1], rows[5:] + rows[:5]):
        kept = simhash.keep_first(spark.createDataFrame(order, names).repartition(3))
        assert kept.columns == ["doc_id", "text", "__id", "__hash", "row", "a.b", "n"]
        found.append(sorted(map(str, kept.collect())))
    assert len(found[0]) == 3 and found[0] == found[1] == found[2]


def test_empty(spark):
    empty = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_first(empty).count() == 0
