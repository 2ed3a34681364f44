"""Small helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes in one Arrow batch, so that a Python worker holds few long texts at once.
BATCH_BYTES = 2 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes where the session has Spark's default bound (64 MB); a batch holds one text at least."""
    if spark.conf.get(_BYTES).lower() in ("67108864b", "67108864", "64m", "64mb"):
        spark.conf.set(_BYTES, str(BATCH_BYTES))


def map_texts(docs: DataFrame, make: Callable[[], Callable[[list[str]], dict[str, pa.Array]]], schema: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: the columns ``keep`` and what ``make()`` computes from the texts.

    ``make`` runs once per task; its result gets the texts of a batch (null: empty) and
    returns the further columns by name.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(batch.num_columns - 1).to_pylist()]
            new = compute(texts)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *new.values()], [*keep, *new])

    kept = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return docs.select(*keep, docs[text].alias("__text")).mapInArrow(run, f"{kept}, {schema}")


def keep_texts(docs: DataFrame, make: Callable[[], Callable[[list[str]], pa.Array]], text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, for which ``make()`` says true."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = make()
        for batch in batches:
            yield batch.filter(decide(["" if t is None else t for t in batch.column(at).to_pylist()]))

    return docs.mapInArrow(run, docs.schema)
