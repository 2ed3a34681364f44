"""Toxicity by a subsequence string kernel and a support vector machine.

The kernel compares words by the three-letter subsequences they share, each weighted by
DECAY to the power of the stretch it spans, so a letter put in, a mark between letters or
a doubled letter weakens an insult but does not hide it. A text is a bag of words, and the
label of a text says no more than whether one of them is an insult, so the machine is trained
on bags: the words that speak loudest for a toxic text are its witnesses, and the loudest
words of other texts are what they must be told from; machine and witnesses are found in
turns. Words are mapped to landmarks (Nyström), a linear machine is trained there, and, as
the kernel is a dot product of subsequence weights, the trained machine folds into one table
with a weight for each three-letter subsequence. A text scores by how loud its loudest
words are, and how many, for its length.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrack.functions.shared import written
from loomtrack.llm.common import keep_texts, map_texts, small_batches
from loomtrack.llm.quality import labelled_sample

#: At most so many labelled toxic and other documents, the first by hash of their id, are used to fit.
TRAIN_TOXIC, TRAIN_CLEAN = 3_000, 6_000
DECAY = 0.7
#: Longest stretch of a subsequence; its weight would be below 0.03 beyond.
STRETCH = 9
#: Longer words are read through windows of this length, one every STEP codes, so that a stretch of 25 lies whole in one.
WINDOW, STEP = 32, 8
#: Codes: 0 for a mark inside a word, then plain and accented Latin letters, HASHED ones that all other letters share, and two for the word's ends.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâäçèéêëíîïñóôöùúûüß"
HASHED = 46
FIRST, LAST = len(LETTERS) + HASHED + 1, len(LETTERS) + HASHED + 2
CODES = len(LETTERS) + HASHED + 3
#: Words whose margins a worker remembers at most.
MEMORY = 500_000
#: Landmarks of each kind (witnesses, loud and other words of clean texts), rounds of training, and words of clean texts that all rounds see.
LANDMARKS, ROUNDS, OTHERS = 64, 4, 8_000
#: A first witness stands in so many different places of toxic texts at least and is so much likelier there; later ones are so much likelier to be loud there.
SUPPORT, LIKELIER, LOUDER = 3, 10.0, 3.0
#: Loudest words of a text that a round looks at.
LOUD = 5
#: A text's score rests on its loudest word places, by rank from 0.
RANKS = (0, 1, 2, 4, 7)


@lru_cache(maxsize=100_000)
def _code(c: str) -> int:
    at = LETTERS.find(unicodedata.normalize("NFKC", c).lower()[:1] or " ")
    return at + 1 if at >= 0 else len(LETTERS) + 1 + ord(c) % HASHED if c.isalpha() else 0


def encode(word: str) -> list[list[int]]:
    """Code lists of a word without the marks around it: one, or its windows where it is long; none without a letter."""
    codes = [_code(c) for c in word]
    letters = [k for k, c in enumerate(codes) if c]
    if not letters:
        return []
    codes = [FIRST, *codes[letters[0] : letters[-1] + 1], LAST]
    if len(codes) <= WINDOW:
        return [codes]
    starts = [*range(0, len(codes) - WINDOW, STEP), len(codes) - WINDOW]
    return [codes[k : k + WINDOW] for k in starts]


def units(text: str) -> list[str]:
    """The words of a text, lower-cased, and each run of three or more single letters as one word."""
    words = text.lower().split()
    spaces = np.flatnonzero(np.frombuffer(text.encode("latin-1", "replace"), np.uint8) <= 32)
    short = np.diff(spaces, prepend=-1, append=len(text)) == 2
    if len(short) > 2 and (short[:-2] & short[1:-1] & short[2:]).any():
        run: list[str] = []
        for word in [*words, ".."]:
            if len(word) == 1 and word.isalpha():
                run.append(word)
            else:
                if len(run) > 2:
                    words.append("".join(run))
                run = []
    return words


@lru_cache(maxsize=64)
def _triples(length: int) -> tuple[np.ndarray, ...]:
    found = [(i, j, k) for i in range(length) for j in range(i + 1, length) for k in range(j + 1, min(length, i + STRETCH))]
    i, j, k = np.array(found, np.int64).reshape(-1, 3).T
    return i, j, k, (DECAY ** (k - i + 1)).astype(np.float32)


def _subsequences(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words of one length: subsequence numbers and weights; weight 0 where a mark takes part."""
    i, j, k, weight = _triples(codes.shape[1])
    a, b, c = codes[:, i], codes[:, j], codes[:, k]
    return (a * CODES + b) * CODES + c, np.where((a > 0) & (b > 0) & (c > 0), weight, np.float32(0))


def _norms(number: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Square roots of the kernel of each word with itself."""
    key = (np.arange(len(number), dtype=np.int64)[:, None] * CODES**3 + number).ravel()
    seen, at = np.unique(key, return_inverse=True)
    return np.sqrt(np.bincount(seen // CODES**3, np.bincount(at, weight.ravel()) ** 2, len(number))) + 1e-12


def _by_length(coded: list[list[int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, code matrix) for the coded words of each length, in blocks."""
    groups = defaultdict(list)
    for at, codes in enumerate(coded):
        groups[len(codes)].append(at)
    for places in groups.values():
        for k in range(0, len(places), 1_000):
            block = places[k : k + 1_000]
            yield np.array(block), np.array([coded[x] for x in block], np.int32)


def features(coded: list[list[int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Normalised subsequence weights of each coded word, as (numbers, weights)."""
    out: list = [None] * len(coded)
    for places, codes in _by_length(coded):
        number, weight = _subsequences(codes)
        weight = weight / _norms(number, weight)[:, None]
        for place, n, w in zip(places, number, weight):
            out[place] = (n, w)
    return out


@dataclass
class Machine:
    """``table``: weight of each subsequence; the machine takes a word for an insult where slope * margin + shift > 0.

    ``weights`` (the last one constant) go with the standardised statistics of a text, see ``Reader``.
    """

    table: np.ndarray
    slope: float
    shift: float
    centre: np.ndarray = field(default_factory=lambda: np.zeros(len(RANKS) + 1))
    scale: np.ndarray = field(default_factory=lambda: np.ones(len(RANKS) + 1))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(RANKS) + 2))

    def margins(self, words: list[str]) -> np.ndarray:
        """Of each word, its largest window's value; 0 where nothing speaks for an insult."""
        coded, owner = [], []
        for at, word in enumerate(words):
            for codes in encode(word):
                coded.append(codes)
                owner.append(at)
        best = np.zeros(len(words))
        owners = np.array(owner, np.int64)
        for places, codes in _by_length(coded):
            number, weight = _subsequences(codes)
            value = (self.table[number] * weight).sum(axis=1)
            up = np.flatnonzero(value > 0)
            if len(up):
                np.maximum.at(best, owners[places[up]], value[up] / _norms(number[up], weight[up]))
        return best

    def probability(self, statistics: np.ndarray) -> np.ndarray:
        z = (statistics - self.centre) / self.scale @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Reader:
    """Statistics of texts: the margins of their loudest word places, by RANKS (0 for none), and how dense loud words are. Words seen so far are remembered."""

    def __init__(self, machine: Machine):
        self.machine, self.known = machine, {}

    def _learn(self, found: list[list[str]]) -> None:
        if len(self.known) > MEMORY:
            self.known.clear()
        new = list({w for words in found for w in set(words).difference(self.known)})
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            self.known.update(zip(part, self.machine.margins(part).tolist()))

    def __call__(self, texts: list[str]) -> np.ndarray:
        found = [units(t) for t in texts]
        self._learn(found)
        out, many = np.zeros((len(texts), len(RANKS) + 1)), RANKS[-1] + 1
        for at, words in enumerate(found):
            margins = np.fromiter(map(self.known.__getitem__, words), np.float64, len(words))
            top = np.zeros(many)
            loud = margins[margins > 0]
            dense = float((loud**4).sum()) / (len(words) + 20)
            loud = np.sort(np.partition(loud, len(loud) - many)[-many:] if len(loud) > many else loud)[::-1]
            top[: len(loud)] = loud
            out[at, :-1], out[at, -1] = top[list(RANKS)], dense
        return out

    def loudest(self, text: str, many: int) -> list[tuple[str, float]]:
        """Up to ``many`` different words with the largest margins above 0, ties in the order of the words."""
        words = set(units(text))
        self._learn([list(words)])
        return sorted(((w, m) for w in words if (m := self.known[w]) > 0), key=lambda x: (-x[1], x[0]))[:many]


def _pairs(sample: DataFrame) -> DataFrame:
    """(word, before, toxic, doc): the different words and left neighbours of each sampled document."""
    small_batches(sample.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, lefts, labels, docs = [], [], [], []
            for text, label, doc in zip(*(batch.column(k).to_pylist() for k in range(3))):
                found = [w.strip(".,;:!?\"'()*#$%&|") for w in units(text or "")]
                pairs = {(w, x) for w, x in zip(found, ["", *found]) if w}
                words += [w for w, _ in pairs]
                lefts += [x for _, x in pairs]
                labels += [label] * len(pairs)
                docs += [doc] * len(pairs)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(lefts, pa.string()), pa.array(labels, pa.int32()), pa.array(docs, pa.int64())], ["word", "before", "toxic", "doc"])

    return sample.select("text", F.col("label").cast("int").alias("label"), F.xxhash64("__id").alias("doc")).mapInArrow(run, "word string, before string, toxic int, doc long")


class Landmarks:
    """Subsequence weights of the landmarks, one column each, in rows for the subsequences that stand in any of them."""

    def __init__(self, landmarks: list[list[int]]):
        found = features(landmarks)
        self.numbers = np.unique(np.concatenate([n for n, _ in found]))
        self.row = np.full(CODES**3, len(self.numbers), np.int32)
        self.row[self.numbers] = np.arange(len(self.numbers))
        self.dense = np.zeros((len(self.numbers) + 1, len(found)), np.float32)  # the last row stands for all other subsequences
        for at, (number, weight) in enumerate(found):
            np.add.at(self.dense[:, at], self.row[number], weight)

    def kernel(self, words: list[list[int]]) -> np.ndarray:
        """Kernel values of words and landmarks."""
        out = np.zeros((len(words), self.dense.shape[1]))
        for at in range(0, len(words), 1_000):
            for k, (number, weight) in enumerate(features(words[at : at + 1_000])):
                out[at + k] = weight.astype(np.float32) @ self.dense[self.row[number]]
        return out

    def table(self, w: np.ndarray) -> np.ndarray:
        """Weight of every subsequence where the landmarks weigh ``w``."""
        out = np.zeros(CODES**3, np.float32)
        out[self.numbers] = self.dense[:-1] @ w.astype(np.float32)
        return out


def _svm(x: np.ndarray, y: np.ndarray, mass: np.ndarray, reg: float = 1e-4) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss by Newton steps; ``mass`` weighs the rows, both classes weigh the same."""
    weight = mass * np.where(y > 0, 0.5 / max(mass[y > 0].sum(), 1e-9), 0.5 / max(mass[y < 0].sum(), 1e-9))
    w = np.zeros(x.shape[1])
    for _ in range(30):
        active = y * (x @ w) < 1
        xa, ca = x[active], weight[active]
        new = np.linalg.solve(xa.T @ (xa * ca[:, None]) + reg * np.eye(x.shape[1]), xa.T @ (ca * y[active]))
        if np.abs(new - w).max() < 1e-8:
            break
        w = new
    return w


def fit_words(witnesses: dict[str, float], loud: dict[str, float], others: list[str], landmarks: int = LANDMARKS) -> tuple[np.ndarray, float]:
    """The folded table, and the constant, of a machine that tells ``witnesses`` (with their masses) from ``loud`` and ``others``."""
    first = lambda words: [(w, c[0]) for w in words if (c := encode(w))]
    good = first(sorted(witnesses, key=lambda w: (-witnesses[w], w)))
    hard, rest = first(sorted(w for w in loud if w not in witnesses)), first(w for w in others if w not in witnesses and w not in loud)
    if not good:
        return np.zeros(CODES**3, np.float32), -1.0
    chosen = [c for _, c in [*good[:landmarks], *hard[:: max(1, len(hard) // landmarks)][:landmarks], *rest[:: max(1, len(rest) // landmarks)][:landmarks]]]
    coded = [c for _, c in [*good, *hard, *rest]]
    y = np.array([1.0] * len(good) + [-1.0] * (len(hard) + len(rest)))
    mass = np.array([witnesses[w] for w, _ in good] + [loud[w] for w, _ in hard] + [1.0] * len(rest))
    marks = Landmarks(chosen)
    kernel, own = marks.kernel(coded), marks.kernel(chosen)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    kept = values > 1e-6 * values.max()
    root = vectors[:, kept] / np.sqrt(values[kept])
    w = _svm(np.hstack([kernel @ root, np.ones((len(y), 1))]), y, mass)
    return marks.table(root @ w[:-1]), float(w[-1])


def _loudest(sample: DataFrame, machine: Machine) -> dict[int, dict[str, float]]:
    """By label: the loudest words of the sampled texts, each with the number of texts it is loud in (collected: a few words for each sampled text)."""
    shared = sample.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(shared.value)
        for batch in batches:
            rows = [(label, word) for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for word, _ in read.loudest(text or "", LOUD)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string())], ["label", "word"])

    found = sample.select("text", (F.col("label") > 0).cast("int").alias("label")).mapInArrow(run, "label int, word string").groupBy("label", "word").agg(F.count("*").alias("n")).toArrow()
    out: dict[int, dict[str, float]] = {0: {}, 1: {}}
    for label, word, n in zip(*(found[c].to_pylist() for c in ("label", "word", "n"))):
        out[label][word] = float(n)
    shared.unpersist()
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, train: Column, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", rows: tuple[int, int] = (TRAIN_TOXIC, TRAIN_CLEAN)) -> Machine:
    """A machine fitted to the bounded sample of rows where ``train`` holds. Only the text is an input.

    Several labels of an id count as the largest, rows of one id as one with the smallest text, so that the sample is
    bounded by ``rows``; copies of a toxic text in the same surroundings count once. Ids may be of any type. Null texts are empty. Without a
    toxic document every text scores low, with nothing but toxic ones high.
    """
    labels = labels.where(F.col(label).isNotNull()).groupBy(doc_id).agg(F.max(label).alias(label))
    sample = labelled_sample(docs, labels.where(F.col(label) > 0), label, train, rows[0], doc_id, text).unionByName(labelled_sample(docs, labels.where(F.col(label) == 0), label, train, rows[1], doc_id, text))
    sample = written(sample.groupBy("__id", "label").agg(F.min("text").alias("text")), "toxicity-sample")
    pairs = written(_pairs(sample), "toxicity-pairs")
    # places: neither one long text nor copies of one text count more than once
    toxic = F.least(F.count_distinct(F.when(F.col("toxic") == 1, F.col("doc"))), F.count_distinct(F.when(F.col("toxic") == 1, F.col("before"))))
    clean = F.count_distinct(F.when(F.col("toxic") == 0, F.col("doc")))
    support = written(pairs.groupBy("word").agg(toxic.alias("toxic"), clean.alias("clean")), "toxicity-words")
    n_toxic, n_clean = (max(1, n) for n in sample.agg(F.count_if(F.col("label") > 0), F.count_if(F.col("label") == 0)).first())
    likelier = F.col("toxic") / n_toxic > LIKELIER * (F.col("clean") + 0.5) / n_clean
    start = support.where((F.col("toxic") >= SUPPORT) & likelier).orderBy(F.desc("toxic"), "word").limit(OTHERS).collect()
    start = start or support.where("toxic > 0 AND clean = 0").orderBy(F.desc("toxic"), "word").limit(100).collect()
    of_clean = support.where("clean > 0")
    others = [r["word"] for r in of_clean.orderBy(F.desc("clean"), "word").limit(OTHERS // 2).union(of_clean.orderBy(F.xxhash64("word"), "word").limit(OTHERS // 2)).select("word").distinct().orderBy("word").collect()]
    witnesses, loud, before = {r["word"]: float(r["toxic"]) for r in start}, {}, {}
    for left in range(ROUNDS - 1, -1, -1):
        table, constant = fit_words(witnesses, before | loud, others)
        machine = Machine(table, 1.0, constant)
        if left and witnesses:
            found = _loudest(sample, machine)
            before, loud = loud, found[0]
            witnesses = {w: n for w, n in found[1].items() if n / n_toxic > LOUDER * (loud.get(w, 0.0) + 0.5) / n_clean} or witnesses
    seen = _statistics(sample, machine, "__id", "text", "label").orderBy("__id").toArrow()
    x = np.array(seen["statistics"].to_pylist(), np.float64).reshape(seen.num_rows, len(RANKS) + 1)
    machine.centre, machine.scale, machine.weights = _logistic(x, (np.array(seen["label"].to_pylist(), np.float64) > 0).astype(np.float64))
    return machine


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centre, scale, weights) of a logistic regression; without both classes the weights say the base rate alone."""
    if not len(y) or y.min() == y.max():
        weights = np.zeros(x.shape[1] + 1)
        weights[-1] = np.log((y.sum() + 0.25) / (len(y) - y.sum() + 0.5))
        return np.zeros(x.shape[1]), np.ones(x.shape[1]), weights
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack([(x - centre) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-6)[:, None]) + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return centre, scale, w


def _statistics(docs: DataFrame, machine: Machine, doc_id: str, text: str, *more: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def make():
        read = Reader(shared.value)
        return lambda texts: {"statistics": pa.array(list(read(texts)), pa.list_(pa.float64()))}

    return map_texts(docs, make, "statistics array<double>", text, (doc_id, *more))


def score_toxicity(docs: DataFrame, machine: Machine, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for every row; a null or empty text has no word that speaks for an insult.

    Repeated rows come back as often as they come, an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def make():
        read = Reader(shared.value)
        return lambda texts: {"score": pa.array(shared.value.probability(read(texts)))}

    return map_texts(docs, make, "score double", text, (doc_id,))


def keep_clean(docs: DataFrame, machine: Machine, text: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``limit``: repeated rows each, null and empty texts by their (low) score; empty tables give empty results."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def make():
        read = Reader(shared.value)
        return lambda texts: pa.array(shared.value.probability(read(texts)) < limit)

    return keep_texts(docs, make, text)
