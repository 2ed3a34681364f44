"""Quality scores: boosted trees over statistics of the whole text."""

from __future__ import annotations

from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrack.llm import gbdt
from loomtrack.llm.common import keep_texts, map_texts

#: At most so many labelled rows, the first by hash of their id, are used to fit.
TRAIN_ROWS = 20_000

STATISTICS = (
    "log_bytes", "log_words", "mean_word", "longest_word", "upper", "digits", "exclamation", "symbols", "bars", "stops", "other_marks",
    "high_bytes", "distinct_words", "repeated_words", "log_lines", "distinct_lines", "line_words", "full_lines", "symbols_a_word", "stops_a_word",
)


def _class(characters: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(characters, np.uint8), minlength=256) > 0


_UPPER, _DIGIT, _SYMBOL = _class(bytes(range(65, 91))), _class(b"0123456789"), _class(b"#$%&*@^~_=+<>\\{}[]/")
_STOP, _OTHER = _class(b".,;:?"), _class(b"\"'()-`")


def statistics(text: str) -> list[float]:
    """The values named in STATISTICS; every share is 0 for an empty text."""
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = raw.split(), raw.split(b"\n")
    n, w = max(len(raw), 1), max(len(words), 1)
    symbols, stops = int(counts[_SYMBOL].sum()), int(counts[_STOP].sum())
    return [
        np.log1p(len(raw)), np.log1p(len(words)), sum(map(len, words)) / w, max(map(len, words), default=0),
        counts[_UPPER].sum() / n, counts[_DIGIT].sum() / n, counts[33] / n, symbols / n, counts[124] / n, stops / n, counts[_OTHER].sum() / n,
        counts[128:].sum() / n, len(set(words)) / w, sum(map(eq, words, islice(words, 1, None))) / w, np.log1p(len(lines)),
        len(set(lines)) / len(lines), len(words) / len(lines), sum(x.endswith(b".") for x in lines) / len(lines), symbols / w, stops / w,
    ]


def _matrix(texts: list[str]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.float64).reshape(len(texts), len(STATISTICS))


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, rows: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled ids: the first by hash. Several labels of an id count as the largest."""
    ids = (
        labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & train)
        .groupBy(F.col(doc_id).alias("__id"))
        .agg(F.max(label).alias("label"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(rows)
    )
    return docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text")).join(F.broadcast(ids), "__id")  # bounded by ``rows``


def fit_quality(docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality", rows: int = TRAIN_ROWS, doc_id: str = "doc_id", text: str = "text") -> gbdt.Trees:
    """Trees fitted to ``label`` of the rows where ``train`` holds. Only the text is an input.

    Several labels of an id count as the largest; rows of one id and label as one, with the smallest
    statistics. Without rows, or with one class alone, every text gets the base rate.
    """

    def make():
        return lambda texts: {"x": pa.array(list(_matrix(texts)), pa.list_(pa.float64()))}

    sample = labelled_sample(docs, labels, label, train, rows, doc_id, text)
    found = map_texts(sample, make, "x array<double>", keep=("__id", "label")).groupBy("__id", "label").agg(F.min("x").alias("x")).orderBy("__id").toArrow()
    x = np.array(found["x"].to_pylist(), np.float64).reshape(found.num_rows, len(STATISTICS))
    return gbdt.fit(x, (np.array(found["label"].to_pylist(), np.float64) > 0).astype(np.float64))


def score_quality(docs: DataFrame, model: gbdt.Trees, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for every row; null and empty texts are scored by the statistics of an empty text.

    Repeated rows come back as often as they come, an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        return lambda texts: {"score": pa.array(shared.value.probability(_matrix(texts)))}

    return map_texts(docs, make, "score double", text, (doc_id,))


def keep_quality(docs: DataFrame, model: gbdt.Trees, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score at least ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        return lambda texts: pa.array(shared.value.probability(_matrix(texts)) >= least)

    return keep_texts(docs, make, text)
