"""Language-model scores by a log-bilinear model trained with noise-contrastive estimation.

Word counts cover the whole training corpus and stay distributed. The model predicts a word
from the vectors of the words before it in two steps, each a normalised softmax: its class
(ranges of the most frequent words, groups of the others by their endings, the end of the
text), then the word within its class. The number of words with vectors of their own grows with the
corpus; within a group of other words a word has its smoothed share. Training passes over all
training tokens: each task follows the tokens of its own documents and the tasks' parameters
are averaged, round by round.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil, isqrt
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrack.functions.shared import written
from loomtrack.llm.common import small_batches

#: Words with vectors of their own: FACTOR times the training tokens to the power POWER. Groups of other words by their ending.
FACTOR, POWER, ENDINGS = 1, 0.4, 31
#: Words before a token that predict it, length of vectors, noise classes and noise words in a class that the tokens of a step share, learning rate, rounds of averaging.
ORDER, DIMENSIONS, NOISE, NOISE_WORDS, RATE, ROUNDS = 3, 24, 16, 4, 0.1, 3
#: Tokens of a step: FIRST at the start of a task, then a share (PACE) of those it has followed, up to BATCH. The same for any corpus.
FIRST, PACE, BATCH = 512, 16, 8192
#: Words, the most frequent ones, whose counts every worker holds (a few MB); the others' counts are joined.
HEAD = 200_000
SMOOTH = 0.1
#: Distinct words a task counts before it hands them on, and endings of words a worker remembers; tokens scored at once.
MEMORY, SCORED = 500_000, 65_536
END = b""


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def ending(word: bytes) -> int:
    return crc32(word.rstrip(b".,;:!?|*#$%&\"')")[-3:]) % ENDINGS


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all rows, the end of each text included; counted within tasks before the shuffle."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                counts.update(words_of(t))
                counts[END] += 1
                if len(counts) > MEMORY:
                    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
                    counts.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    return docs.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class _Codes(dict):
    """Head words to their rank; any other word to -1 - its ending, remembered within bounds."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > HEAD + MEMORY:
            for other in [w for w, code in self.items() if code < 0]:
                del self[other]
        self[word] = code = -1 - ending(word)
        return code


@dataclass
class Vocabulary:
    """The head words by count, how many of them have vectors of their own, and the corpus totals.

    A token's number is its rank for an own word, then ``own`` + ending, then ``own`` + ENDINGS for the end.
    """

    words: list[bytes]
    counts: np.ndarray
    n: int
    v: int
    ends: int
    own: int
    _codes: _Codes | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_codes": None}

    @property
    def codes(self) -> _Codes:
        if self._codes is None:
            self._codes = _Codes(zip(self.words, range(len(self.words))))
        return self._codes

    @property
    def numbers(self) -> np.ndarray:
        """Token number of each head word."""
        return np.array([k if k < self.own else self.own + ending(w) for k, w in enumerate(self.words)], np.int64)

    def tokens(self, found: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Token numbers of a text's codes, the end included."""
        known = numbers[np.maximum(found, 0)] if len(numbers) else 0
        return np.append(np.where(found >= 0, known, self.own - 1 - found), self.own + ENDINGS)


def _contexts(tokens: np.ndarray, end: int) -> np.ndarray:
    """The ORDER tokens before each token of a text, the nearest first; ends before its start."""
    out = np.full((len(tokens), ORDER), end, np.int64)
    for k in range(ORDER):
        out[k + 1 :, k] = tokens[: max(len(tokens) - k - 1, 0)]
    return out


class Net:
    """The log-bilinear model.

    ``context``: vectors of the tokens before; ``position``: how each dimension weighs at each
    distance; ``outer`` and ``inner``: vectors, with the bias as the last column, of the classes and of
    the own words within their class (rows beyond the last own word are not in use).
    """

    def __init__(self, shares: np.ndarray, own: int):
        """``shares``: the smoothed share of each token number."""
        rng = np.random.default_rng(7)
        self.own = own
        self.width = max(1, isqrt(max(own - 1, 0)) + 1)
        self.classes = ceil(own / self.width)
        outcome = self.outcomes(np.arange(len(shares)))
        self.outer_share = np.bincount(outcome, shares, self.classes + ENDINGS + 1)
        self.inner_share = np.append(shares[:own], np.zeros(self.classes * self.width - own)).reshape(self.classes, self.width)
        self.inner_share = self.inner_share / np.maximum(self.inner_share.sum(axis=1, keepdims=True), 1e-300)
        normal = lambda n: rng.normal(0, 0.1, (n, DIMENSIONS)).astype(np.float32)
        bias = lambda p: np.log(np.maximum(p, 1e-30)).astype(np.float32)[:, None]
        self.context = normal(len(shares))
        self.position = np.repeat(1 / np.arange(1, ORDER + 1, dtype=np.float32)[:, None], DIMENSIONS, axis=1)
        self.outer = np.hstack((normal(len(self.outer_share)), bias(self.outer_share)))
        self.inner = np.hstack((normal(self.inner_share.size), bias(self.inner_share.ravel())))

    def outcomes(self, tokens: np.ndarray) -> np.ndarray:
        """Class of each token: own words by ranges of rank, then endings, then the end."""
        return np.where(tokens < self.own, tokens // self.width, self.classes + tokens - self.own)

    def _by_class(self, outcome: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(class, places) of the own words among a batch's outcomes."""
        order = np.argsort(outcome, kind="stable")
        cuts = np.searchsorted(outcome[order], np.arange(self.classes + 1))
        for k in range(self.classes):
            if cuts[k] < cuts[k + 1]:
                yield k, order[cuts[k] : cuts[k + 1]]

    def log10(self, contexts: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Normalised log10 probability of each token number after its context."""
        out = np.empty(len(tokens))
        for at in range(0, len(tokens), SCORED):
            t = tokens[at : at + SCORED]
            q = np.einsum("nod,od->nd", self.context[contexts[at : at + SCORED]], self.position)
            outcome = self.outcomes(t)
            found = _log_softmax(q @ self.outer[:, :-1].T + self.outer[:, -1], outcome)
            for k, places in self._by_class(outcome):
                rows = self.inner[k * self.width : min((k + 1) * self.width, self.own)]
                found[places] += _log_softmax(q[places] @ rows[:, :-1].T + rows[:, -1], t[places] - k * self.width)
            out[at : at + SCORED] = found
        return out / np.log(10)

    def parameters(self) -> np.ndarray:
        """All parameters as one matrix; the last column is zero where there is no bias."""
        return np.vstack([np.pad(x, ((0, 0), (0, 1))) for x in (self.context, self.position)] + [self.outer, self.inner])

    def take(self, parameters: np.ndarray) -> None:
        a, b = len(self.context), len(self.context) + ORDER
        c = b + len(self.outer)
        self.context, self.position = (np.ascontiguousarray(x, np.float32) for x in (parameters[:a, :-1], parameters[a:b, :-1]))
        self.outer, self.inner = parameters[b:c].astype(np.float32), parameters[c:].astype(np.float32)


def _log_softmax(scores: np.ndarray, target: np.ndarray) -> np.ndarray:
    scores -= scores.max(axis=1, keepdims=True)
    chosen = scores[np.arange(len(target)), target].astype(np.float64)
    return chosen - np.log(np.exp(scores, out=scores).sum(axis=1))


def _contrast(scores: np.ndarray, expected: np.ndarray, is_data: bool) -> np.ndarray:
    """Gradient, by score, of the log likelihood that tokens (``is_data``) and noise samples are told apart.

    ``expected``: the number of noise samples with this outcome that go with a token.
    """
    data = 1 / (1 + np.exp(np.minimum(np.log(expected) - scores, 60)))
    return 1 - data if is_data else -data


class Trainer:
    """Gradient steps on a net by noise-contrastive estimation, each parameter's step scaled by its own past gradients."""

    def __init__(self, net: Net):
        self.net, self.rng = net, np.random.default_rng(11)
        self.squares = [np.full_like(x, 1e-3) for x in (net.context, net.position, net.outer, net.inner)]
        self.outer_noise = (NOISE * np.maximum(net.outer_share, 1e-12)).astype(np.float32)
        self.inner_noise = (NOISE_WORDS * np.maximum(net.inner_share, 1e-12)).ravel().astype(np.float32)
        self.outer_sum, self.inner_sum = np.cumsum(net.outer_share), np.cumsum(net.inner_share, axis=1)

    def step(self, contexts: np.ndarray, tokens: np.ndarray, rate: float) -> None:
        net, n = self.net, np.float32(len(tokens))
        order = np.argsort(tokens, kind="stable")  # own words first, by class; so sums by word and class are sums of runs
        tokens, contexts = tokens[order], contexts[order]
        before = [net.context[c] for c in contexts.T]
        q = sum(v * p for v, p in zip(before, net.position))
        outcome = net.outcomes(tokens)
        context, position, outer, inner = (np.zeros_like(x) for x in (net.context, net.position, net.outer, net.inner))

        def towards(rows: np.ndarray, out: np.ndarray, places: np.ndarray, expected: np.ndarray, q: np.ndarray) -> np.ndarray:
            """Adds the gradient of the tokens' own rows (sorted ``places``) and returns theirs by q."""
            own = rows[places]
            g = _contrast(np.einsum("nd,nd->n", q, own[:, :-1]) + own[:, -1], expected[places], True)[:, None]
            first = _starts(places)
            out[places[first], :-1] += np.add.reduceat(g * q, first, axis=0)
            out[places[first], -1] += np.add.reduceat(g[:, 0], first)
            return g * own[:, :-1]

        up = towards(net.outer, outer, outcome, self.outer_noise, q)
        noise = np.minimum(np.searchsorted(self.outer_sum, self.rng.random(NOISE) * self.outer_sum[-1], side="right"), len(net.outer) - 1)
        rows = net.outer[noise]
        g = _contrast(q @ rows[:, :-1].T + rows[:, -1], self.outer_noise[noise], False)
        np.add.at(outer, noise, np.hstack((g.T @ q, g.sum(axis=0)[:, None])))
        up += g @ rows[:, :-1]
        many = int(np.searchsorted(tokens, net.own))
        if many:
            up[:many] += towards(net.inner, inner, tokens[:many], self.inner_noise, q[:many])
            cuts = np.searchsorted(outcome[:many], np.arange(net.classes + 1))
            runs = [(k, int(cuts[k]), int(cuts[k + 1])) for k in range(net.classes) if cuts[k] < cuts[k + 1]]
            draws = self.rng.random((net.classes, NOISE_WORDS)) * self.inner_sum[:, -1:]
            noise = np.minimum((self.inner_sum[:, None, :] <= draws[:, :, None]).sum(axis=2), net.width - 1) + np.arange(net.classes)[:, None] * net.width
            rows, scores = net.inner[noise], np.empty((many, NOISE_WORDS), np.float32)
            for k, i, j in runs:
                scores[i:j] = q[i:j] @ rows[k, :, :-1].T
            of = outcome[:many]
            g = _contrast(scores + rows[of, :, -1], self.inner_noise[noise][of], False)
            for k, i, j in runs:
                up[i:j] += g[i:j] @ rows[k, :, :-1]
                np.add.at(inner, noise[k], np.hstack((g[i:j].T @ q[i:j], g[i:j].sum(axis=0)[:, None])))
        for k in range(ORDER):
            position[k] = (up * before[k]).sum(axis=0)
            order = np.argsort(contexts[:, k], kind="stable")
            words = contexts[order, k]
            first = _starts(words)
            context[words[first]] += np.add.reduceat(up[order], first, axis=0) * net.position[k]
        for value, square, gradient in zip((net.context, net.position, net.outer, net.inner), self.squares, (context, position, outer, inner)):
            gradient /= n
            square += gradient * gradient
            value += rate * gradient / np.sqrt(square + np.float32(1e-8))


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where another value starts."""
    return np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))


def _texts_tokens(texts: list[str | None], vocabulary: Vocabulary, codes: _Codes, numbers: np.ndarray) -> Iterator[np.ndarray]:
    for t in texts:
        words = words_of(t)
        yield vocabulary.tokens(np.fromiter(map(codes.__getitem__, words), np.int64, len(words)), numbers)


def step_size(followed: int) -> int:
    """Tokens of a task's next step after ``followed`` tokens."""
    return min(BATCH, max(FIRST, followed // PACE))


def _trained(docs: DataFrame, vocabulary: Vocabulary, net: Net, rate: float, text: str) -> np.ndarray | None:
    """The parameters after every task has followed its documents, averaged by tokens; none without documents."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, net))
    columns = [f"v{k}" for k in range(DIMENSIONS + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, net = shared.value
        codes, numbers, end = vocabulary.codes, vocabulary.numbers, vocabulary.own + ENDINGS
        net = Net.__new__(Net)
        net.__dict__.update({k: v.copy() if isinstance(v, np.ndarray) else v for k, v in shared.value[1].__dict__.items()})
        trainer, seen, held, waiting = Trainer(net), 0, [], 0

        def follow(parts: list[np.ndarray]) -> None:
            contexts, tokens = np.concatenate([_contexts(t, end) for t in parts]), np.concatenate(parts)
            steps = max(1, len(tokens) // step_size(seen - len(tokens)))
            for c, t in zip(np.array_split(contexts, steps), np.array_split(tokens, steps)):
                trainer.step(c, t, rate)

        for batch in batches:
            for t in _texts_tokens(batch.column(0).to_pylist(), vocabulary, codes, numbers):
                held.append(t)
                waiting += len(t)
                seen += len(t)
                if waiting >= 8 * step_size(seen - waiting):
                    follow(held)
                    held, waiting = [], 0
        if held:
            follow(held)
        if seen:
            found = net.parameters().astype(np.float64) * seen
            for at in range(0, len(found), 50_000):
                part = found[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part), dtype=np.int32)), pa.array(np.full(len(part), seen)), *(pa.array(x) for x in part.T)], ["row", "n", *columns])

    found = docs.select(text).mapInArrow(run, ", ".join(["row int", "n long", *(f"{c} double" for c in columns)])).groupBy("row").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in columns)).toArrow().sort_by("row")  # one row for each vector
    shared.unpersist()
    if not found.num_rows:
        return None
    return np.stack([found[c].to_numpy() for c in columns], axis=1) / found["n"].to_numpy()[:, None]


@dataclass
class Model:
    vocabulary: Vocabulary
    net: Net
    totals: np.ndarray  # log10 of each ending's smoothed total

    @property
    def base_total(self) -> float:
        return float(np.log10(self.vocabulary.n + SMOOTH * (self.vocabulary.v + 1)))


def _head(counts: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """The most frequent words, at most HEAD: those above the least count that leaves so few. A histogram of counts finds it."""
    place = F.floor(F.log2("n") * 16)
    words = counts.where(F.length("word") > 0)
    least, held = 0, 0
    for r in words.groupBy(place.alias("place")).agg(F.count("*").alias("many")).orderBy(F.desc("place")).collect():  # at most 16 * 63 rows
        held += r["many"]
        if held > HEAD:
            least = r["place"] + 1
            break
    found = words.where(place >= least).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    return found["word"].to_pylist(), np.array(found["n"].to_pylist(), np.int64)


def fit(docs: DataFrame, text: str = "text") -> tuple[Model, DataFrame]:
    """The model of ``docs`` and their written word counts.

    Null texts count as empty; repeated rows count as often as they come. Without rows every
    token is unknown and all have the same share.
    """
    counts = written(word_counts(docs, text), "lm-counts")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = (counts.where(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("n"), F.lit(0))).first())[0]
    words, word_n = _head(counts)
    own = min(len(words), int(FACTOR * max(n, 1) ** POWER))
    vocabulary = Vocabulary(words, word_n, n, v, ends, own)
    others, kinds = np.zeros(ENDINGS, np.int64), np.zeros(ENDINGS, np.int64)
    for r in counts.mapInArrow(_ending_totals(words[:own]), "ending int, n long, v long").groupBy("ending").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():  # at most ENDINGS rows
        others[r["ending"]], kinds[r["ending"]] = r["n"], r["v"]
    totals = np.log10(others + SMOOTH * (kinds + 1))
    shares = np.concatenate((word_n[:own], others, [ends])) + 0.5
    net = Net(shares / shares.sum(), own)
    for part in range(ROUNDS):
        some = docs.where(F.pmod(F.xxhash64(text), F.lit(ROUNDS)) == part)
        parameters = _trained(some, vocabulary, net, RATE / (1 + part), text)
        if parameters is not None:
            net.take(parameters)
    return Model(vocabulary, net, totals), counts


def _ending_totals(own_words: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total, many = set(own_words), np.zeros(ENDINGS, np.int64), np.zeros(ENDINGS, np.int64)
        for batch in batches:
            for word, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if word and word not in own:
                    e = ending(word)
                    total[e] += k
                    many[e] += 1
        seen = np.flatnonzero(many)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen]), pa.array(many[seen])], ["ending", "n", "v"])

    return run


def score(docs: DataFrame, model: Model, counts: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score), one row per document.

    Head words are looked up where the text is read; the others are joined with their counts
    and summed by document. Null texts count as empty (the end alone); rows with null or
    repeated ids, repeated rows included, each come back once.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        vocabulary, base_total = m.vocabulary, m.base_total
        codes, numbers, end = vocabulary.codes, vocabulary.numbers, vocabulary.own + ENDINGS
        base = np.log10(vocabulary.counts + SMOOTH) - base_total
        within = np.where(np.arange(len(numbers)) < vocabulary.own, 0.0, np.log10(vocabulary.counts + SMOOTH) - m.totals[np.maximum(numbers - vocabulary.own, 0)]) if len(numbers) else np.zeros(0)
        end_base = np.log10(vocabulary.ends + SMOOTH) - base_total
        for batch in batches:
            texts = batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                first, held, parts, all_words = at, 0, [], []
                while at < len(texts) and held < SCORED:
                    words = words_of(texts[at])
                    parts.append(np.fromiter(map(codes.__getitem__, words), np.int64, len(words)))
                    all_words.append(words)
                    held += len(words) + 1
                    at += 1
                tokens = [vocabulary.tokens(found, numbers) for found in parts]
                each = m.net.log10(np.concatenate([_contexts(t, end) for t in tokens]), np.concatenate(tokens))
                chains = np.add.reduceat(each, np.concatenate(([0], np.cumsum([len(t) for t in tokens])[:-1])))
                rows, keys, words_out, times, total, n_tokens, known, bases, models, docs_out = [], [], [], [], [], [], [], [], [], []
                for k, (words, found, chain) in enumerate(zip(all_words, parts, chains.tolist())):
                    key = xxhash.xxh64_intdigest((texts[first + k] or "").encode("utf-8", "surrogatepass"), 42) - (1 << 63)
                    head = found[found >= 0]
                    rows.append(first + k), keys.append(key), words_out.append(b" " + key.to_bytes(9, "big", signed=True)), times.append(0), total.append(0.0)
                    n_tokens.append(len(words) + 1), known.append(len(head) + (vocabulary.ends > 0)), docs_out.append(1)
                    bases.append(float(base[head].sum() + end_base)), models.append(chain + float(within[head].sum()))
                    if len(head) < len(words):
                        rare = Counter(words[k] for k in np.flatnonzero(found < 0).tolist())
                        for word, many in rare.items():
                            rows.append(first + k), keys.append(key), words_out.append(word), times.append(many), total.append(m.totals[-1 - codes[word]])
                            n_tokens.append(0), known.append(0), docs_out.append(0), bases.append(0.0), models.append(0.0)
                yield _rows(batch, rows, keys, words_out, times, total, n_tokens, known, bases, models, docs_out)

    def _rows(batch, rows, keys, words_out, times, total, tokens, known, bases, models, docs_out) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
        values = (keys, words_out, times, total, tokens, known, bases, models, docs_out)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(v, k) for v, k in zip(values, kinds))], ["id", "key", "word", "times", "total", "tokens", "known", "base", "model", "rows"])

    kind = docs.schema[doc_id].dataType.simpleString()
    parts = docs.select(doc_id, text).mapInArrow(run, f"id {kind}, key long, word binary, times long, total double, tokens long, known long, base double, model double, rows long")
    c = F.coalesce("n", F.lit(0))
    smoothed = F.log10(c + F.lit(SMOOTH))
    joined = parts.join(counts.hint("merge"), "word", "left").select(
        "id", "key", "rows", "tokens",
        (F.col("known") + F.when(c > 0, F.col("times")).otherwise(0)).alias("known"),
        (F.col("base") + F.col("times") * (smoothed - F.lit(model.base_total))).alias("base"),
        (F.col("model") + F.col("times") * (smoothed - F.col("total"))).alias("model"),
    )
    summed = joined.groupBy("id", "key").agg(*(F.sum(x).alias(x) for x in ("rows", "tokens", "known", "base", "model")))
    each: dict[str, Column] = {x: (F.col(x) / F.col("rows")) for x in ("tokens", "known", "base", "model")}
    # as many rows as came: in two steps, so that no array is long where many rows are equal
    many = F.ceil(F.col("rows") / F.lit(1024)).cast("int")
    parted = summed.select("*", F.explode(F.sequence(F.lit(0), many - 1)).alias("part")).withColumn("here", F.least(F.lit(1024), F.col("rows") - F.col("part") * 1024).cast("int"))
    return parted.select("*", F.explode(F.array_repeat(F.lit(1), F.col("here"))).alias("one")).select(
        F.col("id").alias(doc_id), each["tokens"].cast("long").alias("n_tokens"), each["known"].cast("long").alias("n_known"), F.lit(model.vocabulary.n).cast("long").alias("train_tokens"), each["base"].alias("base_score"), each["model"].alias("score")
    )
