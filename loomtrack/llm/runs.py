"""Maximal periodic runs of words, found by block convolution at dyadic scales.

A run of period q has at least q words that recur q words on. At scale B, which serves
periods 2B-1 to 4B-2, any such stretch holds a whole block of B words that starts at a multiple of B, so every run of
those periods shows as a block whose squared differences from the words q further on sum to
zero. The sums of all distances of a block come from one correlation, by a number-theoretic
transform in exact integer arithmetic modulo a prime. A sum that is zero modulo the prime seeds an extension
to both sides, word by word, which also refutes a sum that is only a multiple of the prime.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtrack.llm.common import small_batches

#: 15 * 2**27 + 1, whose group has the root 31: transforms of up to 2**27 numbers, products within 62 bits.
PRIME, ROOT = 2013265921, 31
#: Shortest run, and numbers in one batch of transforms at most (a single longer block makes a batch of its own).
LEAST, BATCH = 12, 1 << 19


@cache
def _twiddles(size: int, inverse: bool) -> list[np.ndarray]:
    """Powers of the root of unity for each pass of a transform of ``size`` numbers, widest pass first."""
    root = pow(ROOT, (PRIME - 1) // size, PRIME)
    if inverse:
        root = pow(root, PRIME - 2, PRIME)
    powers = np.ones(max(1, size // 2), np.uint64)
    step, known = root, 1
    while known < len(powers):  # doubles the known powers
        powers[known : 2 * known] = powers[:known] * np.uint64(step) % PRIME
        step, known = step * step % PRIME, 2 * known
    out = []
    while size > 1:
        out.append(powers)
        powers, size = powers[::2], size // 2
    return out


def transform(rows: np.ndarray) -> np.ndarray:
    """The transform of each row (a power of two of residues), in bit-reversed order."""
    n, size = rows.shape
    for w in _twiddles(size, False):
        half = len(w)
        x = rows.reshape(n, -1, 2, half)
        a, b = x[:, :, 0], x[:, :, 1]
        rows = np.empty_like(x)
        total = a + b
        rows[:, :, 0] = np.minimum(total, total - PRIME)  # unsigned: below zero wraps to a huge number
        diff = a + (PRIME - b)
        rows[:, :, 1] = diff * w % PRIME
    return rows.reshape(n, size)


def inverse(rows: np.ndarray) -> np.ndarray:
    """The rows whose ``transform`` is ``rows``."""
    n, size = rows.shape
    for w in reversed(_twiddles(size, True)):
        half = len(w)
        x = rows.reshape(n, -1, 2, half)
        a, b = x[:, :, 0], x[:, :, 1] * w % PRIME
        rows = np.empty_like(x)
        total, diff = a + b, a + (PRIME - b)
        rows[:, :, 0] = np.minimum(total, total - PRIME)
        rows[:, :, 1] = np.minimum(diff, diff - PRIME)
    return rows.reshape(n, size) * np.uint64(pow(size, PRIME - 2, PRIME)) % PRIME


def _distances(block: int) -> tuple[int, int]:
    """The first and last period that scale ``block`` serves; the smallest scale serves those below, too."""
    return (1 if block == 2 else 2 * block - 1), 4 * block - 2


def matches(x: np.ndarray, starts: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance) of the blocks at ``starts`` whose squared differences from the words that distance on sum to zero modulo the prime.

    ``x``: residues, followed by at least 5 * block others.
    """
    (first, last), size = _distances(block), 4 * block
    lags = last - first + 1
    squares = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * x % PRIME, dtype=np.uint64)])
    found_at, found_by = [], []
    for part in np.array_split(starts, max(1, len(starts) * size // BATCH)):
        padded = np.zeros((len(part), size), np.uint64)
        padded[:, :block] = x[part[:, None] + np.arange(block - 1, -1, -1)]  # reversed: a product of polynomials is then a correlation
        windows = x[part[:, None] + first + np.arange(size)]
        windows[:, lags + block - 1 :] = 0
        crossed = inverse(transform(padded) * transform(windows) % PRIME)[:, block - 1 : block - 1 + lags]
        own = (squares[part + block] - squares[part])[:, None]
        at = part[:, None] + first + np.arange(lags)
        other = squares[at + block] - squares[at]
        row, lag = np.nonzero((own + other) % PRIME == 2 * crossed % PRIME)
        found_at.append(part[row]), found_by.append(lag + first)
    return np.concatenate(found_at), np.concatenate(found_by)


def _agreeing(x: np.ndarray, at: int, q: int, end: int, step: int) -> int:
    """How many words from ``at`` on (backwards for step -1), before ``end``, equal those q further on."""
    n, most, chunk = 0, (end - q - at if step > 0 else at - end + 1), 32
    while n < most:
        k = min(chunk, most - n)
        lo = at + n if step > 0 else at - n - k + 1
        unequal = np.flatnonzero(x[lo : lo + k] != x[lo + q : lo + q + k])
        if len(unequal):
            return n + int(unequal[0] if step > 0 else k - 1 - unequal[-1])
        n, chunk = n + k, min(4 * chunk, 1 << 16)
    return n


class _Known:
    """The runs found so far, by period; those of one period overlap by less than the period, so starts and ends both ascend."""

    def __init__(self) -> None:
        self.by_period: dict[int, tuple[list[int], list[int]]] = {}

    def add(self, period: int, runs: list[tuple[int, int]]) -> None:
        self.by_period[period] = ([a for a, _ in runs], [b for _, b in runs])

    def covers(self, starts: np.ndarray, distances: np.ndarray, block: int) -> np.ndarray:
        """Whether a known run, whose period divides the distance, holds the block and its occurrence: it is then what an extension would find."""
        covered = np.zeros(len(starts), bool)
        for period, (begin, end) in self.by_period.items():
            at = np.flatnonzero((distances % period == 0) & ~covered)
            if len(at):
                k = np.searchsorted(begin, starts[at], side="right") - 1
                covered[at] = (k >= 0) & (np.asarray(end)[k] >= starts[at] + distances[at] + block)
        return covered


def _scales(longest: int) -> Iterator[int]:
    block = 2
    while block == 2 or 2 * (2 * block - 1) <= longest:
        yield block
        block *= 2


def find_runs(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(start, length, period) of every maximal run of at least ``LEAST`` words and two periods, by start, then period.

    ``words``: numbers that are equal where words are; ``ends``: where each text in turn ends. No run
    crosses an end.
    """
    n = len(words)
    lengths = np.diff(ends, prepend=0)
    longest = int(lengths.max(initial=0))
    if longest < LEAST:
        return np.zeros((0, 3), np.int64)
    end_of = np.repeat(ends, lengths)  # of each word's text
    # how far on each word recurs in its text: a block with a word that does not within reach needs no transform
    order = np.argsort(words, kind="stable")
    again = np.full(n, n + 1, np.int64)
    later, earlier = order[1:], order[:-1]
    same = (words[later] == words[earlier]) & (end_of[later] == end_of[earlier])
    again[earlier[same]] = (later - earlier)[same]
    largest = 2
    while 2 * (2 * largest - 1) <= longest:
        largest *= 2
    x = np.concatenate([words % PRIME, np.zeros(6 * largest, words.dtype)]).astype(np.uint64)
    known, found = _Known(), []
    for block in _scales(longest):
        first, last = _distances(block)
        reach = np.maximum.reduceat(again, np.arange(0, n, block))[: n // block]  # of whole blocks
        starts = np.flatnonzero(reach <= last) * block
        starts = starts[starts + first + block <= end_of[starts]]
        if not len(starts):
            continue
        at, by = matches(x, starts, block)
        inside = at + by + block <= end_of[at]
        at, by = at[inside], by[inside]
        order = np.lexsort((at, by))
        at, by = at[order], by[order]
        new = ~known.covers(at, by, block)
        at, by = at[new], by[new]
        for period in np.unique(by):
            q = int(period)
            seeds = at[by == period]
            if block == 2 or q == 2 * first:  # multiples of periods of this very scale
                seeds = seeds[~known.covers(seeds, np.full(len(seeds), q), block)]
            runs, done = [], -1
            for seed in map(int, seeds):
                if seed + block <= done:  # within the stretch just extended
                    continue
                end = int(end_of[seed])
                begin = end - int(lengths[np.searchsorted(ends, seed, side="right")])
                a = seed - _agreeing(words, seed - 1, q, begin, -1) if seed > begin else seed
                done = seed + _agreeing(words, seed, q, end, 1)
                if done - a >= q and done + q - a >= LEAST:
                    runs.append((a, done + q))
            if runs:
                known.add(q, runs)
                found.extend((a, b - a, q) for a, b in runs)
    found.sort(key=lambda r: (r[0], r[2]))
    return np.array(found, np.int64).reshape(-1, 3)


def planted_words(n: int, doc_id: int | None) -> np.ndarray | None:
    """Which of its ``n`` words stands at each place of a document that gets a periodic end; None for the others."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    at = np.arange(n)
    at[a:] = a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return at


DIGEST = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _digest(words: list[bytes], runs: np.ndarray) -> tuple:
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    keep = np.cumsum(change)[:-1] == 0
    text = "".join(f"{s},{n},{p}\n" for s, n, p in runs.tolist())
    kept = b" ".join(words if keep.all() else [words[i] for i in np.flatnonzero(keep)])
    best = min(runs.tolist(), key=lambda r: (-r[1], r[0], r[2]), default=None)
    largest = (None,) * 4 if best is None else (best[0], best[1], best[2], 1000 * best[1] // best[2])
    return len(runs), *largest, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", plant: bool = False) -> DataFrame:
    """One row per row of ``docs``: its id, the number of maximal periodic runs of words, the longest run, and digests.

    Words are what ASCII white space parts. A run is a stretch with smallest period q and at least max(12, 2 * q)
    words that no neighbouring word extends. ``runs_sha256`` is of all runs, ``collapsed_sha256`` of the words that no
    run contains after its first q words. A null or empty text has no words and no run (four nulls). Repeated rows and
    null ids are rows like any other; an empty table gives an empty result. ``plant``: first give every tenth
    document, by its id's checksum, a periodic end (``planted_words``; none for null ids).
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            numbers: dict[bytes, int] = defaultdict(count().__next__)
            texts, parts = [], []
            for name, t in zip(ids, batch.column(1).to_pylist()):
                words = (t or b"").split()
                texts.append(words)
                part = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
                at = planted_words(len(words), name) if plant else None
                if at is not None:
                    part, texts[-1] = part[at], [words[i] for i in at.tolist()]
                parts.append(part)
            ends = np.cumsum([len(p) for p in parts])
            found = find_runs(np.concatenate(parts) if parts else np.zeros(0, np.int64), ends)
            owner = np.searchsorted(ends, found[:, 0], side="right")
            found[:, 0] -= ends[owner] - np.array([len(p) for p in parts], np.int64)[owner]
            edges = np.searchsorted(owner, np.arange(len(ids) + 1))
            rows = [_digest(texts[i], found[edges[i] : edges[i + 1]]) for i in range(len(ids))]
            columns = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:5]), *(pa.array(c, pa.string()) for c in columns[5:])], [doc_id, *(c.split()[0] for c in DIGEST.split(", "))])

    kind = docs.schema[doc_id].dataType
    if plant and not isinstance(kind, (T.IntegralType, T.StringType)):
        raise TypeError(f"planting needs whole or text ids, not {kind.simpleString()}")
    return docs.select(F.col(doc_id), F.encode(F.col(text), "UTF-8")).mapInArrow(run, f"`{doc_id}` {kind.simpleString()}, {DIGEST}")
