"""Packing token sequences by exact-complement hashing, then best fit.

Every step works on the histogram of piece lengths, which has at most ``capacity``
entries whatever the corpus size, so the plan is made on the driver. It is a list of
patterns (lengths that share a sequence, and how often); Spark then gives every piece
its place by its rank among the pieces of equal length.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtrack.functions.shared import written
from loomtrack.llm.common import small_batches

CAPACITY = 4096
END_ID = 1
#: Words whose ids a worker remembers at most.
MEMORY = 1_000_000

PIECES = "piece int, start long, length long, ids_crc32 long, task int, rank long"


def tokenizer_json(path: str | None = None) -> str:
    """The vocabulary file's text; read by the driver and broadcast (1.7 MB)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


class WordEncoder:
    """Token ids of whole texts as little-endian 32-bit bytes, equal to the tokenizer's.

    The vocabulary merges within words only, so words are cut out here, by the tokenizer's
    own pattern, and their ids remembered. That is done for characters whose case, class and
    normal form are settled (printable ASCII and Latin letters); a space-separated part with
    any other character, or with a special token's name, goes through the whole tokenizer.
    """

    WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
    OTHER = regex.compile(r"[^\t\n\x0b\x0c\r\x20-\x7e\xa1-\u012f\u0131-\u024f]|<\|(?:start|end)oftext\|>")

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.model = self.tokenizer.model
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level BPE shows other bytes as letters from U+0100 on
        self.letters = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        settled = self.OTHER.search(text) is None
        parts = text.lower().split() if settled else text.replace("\n", " ").split(" ")
        known = self.parts
        try:
            return b"".join(map(known.__getitem__, parts))
        except KeyError:
            if len(known) > MEMORY:
                known.clear()
            for part in set(parts).difference(known):
                known[part] = self.part(part, settled)
            return b"".join(map(known.__getitem__, parts))

    def part(self, part: str, settled: bool) -> bytes:
        if not settled and self.OTHER.search(part):
            return array("I", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()
        if part.isalpha():
            return self.word(part.lower())
        return b"".join(map(self.word, self.WORD.findall(part.lower())))

    def word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            if len(self.words) > MEMORY:
                self.words.clear()
            shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            found = self.words[word] = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        return found


def token_pieces(docs: DataFrame, spec: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, rank): each document's ids plus the end id, cut only where longer than ``capacity``.

    ``rank`` numbers the pieces of equal length within ``task``, the Spark task that made them.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = WordEncoder(shared.value), np.array([END_ID], "<u4").tobytes()
        task, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            rows, pieces, starts, lengths, sums, ranks = [], [], [], [], [], []
            for row, t in enumerate(batch.column(1).to_pylist()):
                ids = encode(t or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    length = len(part) // 4
                    rows.append(row), pieces.append(k), starts.append(at // 4), lengths.append(length), sums.append(zlib.crc32(part)), ranks.append(seen[length])
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums)), pa.array([task] * len(rows), pa.int32()), pa.array(ranks, pa.int64())],
                [doc_id, "piece", "start", "length", "ids_crc32", "task", "rank"],
            )

    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, {PIECES}")


class SumIndex:
    """Which combinations of one, two or three available lengths have which sum.

    ``pair_at[s]`` is the smaller length of a pair with sum s, ``triple_at[s]`` the largest of a
    triple. Lengths are only ever used up, so a combination that is not available now
    never will be, and every entry only moves on: all look-ups of a plan together take as
    many steps as there are pairs of lengths, not that many each.
    """

    def __init__(self, counts: list[int]):
        self.counts = counts
        self.top = len(counts) - 1  # longer lengths have been dealt with
        self.pair_at = [s // 2 for s in range(len(counts))]
        self.triple_at = [s - 2 for s in range(len(counts))]

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if 0 < gap <= self.top and self.counts[gap] > 0 else None

    def pair(self, gap: int, taken: int = 0) -> tuple[int, ...] | None:
        """Two available lengths with sum ``gap``, where one piece of length ``taken`` is spoken for.

        The entry moves past pairs that are used up, not past those that only lack the piece spoken for.
        """
        counts, small, gone = self.counts, self.pair_at[gap], True
        while small > 0 and gap - small <= self.top:
            large, twice = gap - small, 2 * small == gap
            if counts[small] > twice and counts[large] > 0:
                if counts[small] - (small == taken) > twice and counts[large] - (large == taken) > 0:
                    if gone:
                        self.pair_at[gap] = small
                    return large, small
                if gone:
                    self.pair_at[gap], gone = small, False
            small -= 1
        if gone:
            self.pair_at[gap] = 0
        return None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        large = min(self.triple_at[gap], self.top)
        while large * 3 >= gap:
            two = self.pair(gap - large, large) if self.counts[large] > 0 else None
            if two:
                self.triple_at[gap] = large
                return large, *two
            large -= 1
        self.triple_at[gap] = large
        return None


def plan_patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in one sequence) with how many sequences follow each: the plan by exact complements, or best fit alone where that needs fewer.

    Lengths go from the longest down. For each, the gap it leaves is looked up in the index
    of single lengths, pair sums and triple sums; a combination found is consumed as often as
    the counts of its lengths allow. What no combination fills exactly is packed best-fit:
    every piece into the fullest open sequence it fits.
    """
    plans = [_plan(histogram, capacity, exact) for exact in (True, False)]
    return min(plans, key=lambda patterns: sum(n for _, n in patterns))


def _plan(histogram: dict[int, int], capacity: int, exact: bool) -> list[tuple[tuple[int, ...], int]]:
    left = [0] * (capacity + 1)
    for length, n in histogram.items():
        left[length] = n
    patterns: list[tuple[tuple[int, ...], int]] = []
    index = SumIndex(left)
    for large in range(capacity, 0, -1) if exact else ():
        index.top = large
        while left[large] > 0:
            gap = capacity - large
            left[large] -= 1  # the piece in hand is not available to its own gap
            found = () if gap == 0 else index.single(gap) or index.pair(gap) or index.triple(gap)
            left[large] += 1
            if found is None:
                break
            lengths = (large, *found)
            n = min(left[x] // lengths.count(x) for x in lengths)
            for x in lengths:
                left[x] -= n
            patterns.append((tuple(sorted(lengths, reverse=True)), n))
    # best fit of what is left, longest first; open sequences of one content are kept as one group
    room: list[int] = []
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(content: tuple[int, ...], n: int) -> None:
        free = capacity - sum(content)
        if free not in groups:
            insort(room, free)
        groups.setdefault(free, []).append((content, n))

    for length in map(int, np.flatnonzero(left)[::-1]):
        n = left[length]
        while n > 0:
            at = bisect_left(room, length)
            if at == len(room):
                fits = capacity // length
                if n >= fits:
                    put((length,) * fits, n // fits)
                    n -= n // fits * fits
                if n:
                    put((length,) * n, 1)
                    n = 0
                break
            free = room[at]
            content, m = groups[free].pop()
            fits = min(free // length, n)
            used = min(m, n // fits)
            if m > used:
                groups[free].append((content, m - used))
            elif not groups[free]:
                del groups[free]
                room.pop(at)
            put(content + (length,) * fits, used)
            n -= used * fits
    for found in groups.values():
        patterns.extend((tuple(sorted(c, reverse=True)), m) for c, m in found)
    return patterns


def _slots(patterns: list[tuple[tuple[int, ...], int]], capacity: int) -> tuple[np.ndarray, ...]:
    """For each run of equal places: length, first rank, first sequence, offset; sorted by (length, rank)."""
    taken = np.zeros(capacity + 1, np.int64)
    rows, first = [], 0
    for lengths, n in patterns:
        offset = 0
        for length in lengths:
            rows.append((length, int(taken[length]), first, offset))
            taken[length] += n
            offset += length
        first += n
    rows.sort()
    return tuple(np.array(rows, np.int64).reshape(-1, 4).T)


def assign(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Replaces ``task`` and ``rank`` of written ``pieces`` by ``sequence_id`` and ``offset``.

    A piece's rank among all equal lengths is its rank within its task plus the counts of
    the tasks before, so that no length, however frequent, meets in one task.
    """
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    slots = pieces.sparkSession.sparkContext.broadcast(_slots(plan_patterns(histogram, capacity), capacity))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = pieces.join(counts.select("task", "length", before.alias("before")).hint("merge"), ["task", "length"])
    kept = [c for c in pieces.columns if c not in ("task", "rank")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, ranks, firsts, offsets = slots.value
        index = lengths * (1 << 48) + ranks
        for batch in batches:
            rank = batch.column(len(kept)).to_numpy()
            at = np.searchsorted(index, batch.column(kept.index("length")).to_numpy() * (1 << 48) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(kept))), pa.array(firsts[at] + rank - ranks[at]), pa.array(offsets[at])], [*kept, "sequence_id", "offset"]
            )

    schema = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in kept)
    return ranked.select(*kept, (F.col("before") + F.col("rank")).alias("rank")).mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, spec: str | None = None, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece.

    A null or empty text is the end id alone. Rows with a null or repeated doc_id are packed
    like any other. An empty table gives an empty result. Sequences hold at most ``capacity``
    tokens, without gaps.
    """
    pieces = written(token_pieces(docs, spec or tokenizer_json(), capacity, doc_id, text), "packing-pieces")
    return assign(pieces, capacity)
