"""Folds over the rows of a key in order: sorted by Spark, streamed batch by batch, with only the fold's own state held."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


class Fold:
    """What is kept of one key. ``frame`` takes the rows of one step, ``end`` is called after the last; both give rows."""

    def frame(self, rows: list[tuple]) -> list[tuple]:
        raise NotImplementedError

    def end(self) -> list[tuple]:
        return []


#: Parts for each core where a key is a whole source, of which there are few.
SPREAD = 16


def _plain(column: pa.Array) -> list:
    """Python values of a column, by numpy where it can: ``to_pylist`` makes an object for each value on the way."""
    kind = column.type
    if pa.types.is_list(kind):
        inner = _plain(column.flatten())
        sizes, out, at = _plain(pc.list_value_length(column)), [], 0
        for n in sizes:
            out.append(None if n is None else inner[at : at + n])
            at += n or 0
        return out
    if pa.types.is_string(kind) or pa.types.is_binary(kind):
        return column.to_numpy(zero_copy_only=False).tolist()
    if not (pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_boolean(kind)):
        return column.to_pylist()
    if not column.null_count:
        return column.to_numpy(zero_copy_only=False).tolist()
    values = pc.fill_null(column, pa.scalar(0).cast(kind)).to_numpy(zero_copy_only=False).tolist()
    for k in np.flatnonzero(column.is_null().to_numpy(zero_copy_only=False)).tolist():
        values[k] = None
    return values


def _values(column: pa.Array) -> list:
    """Python values of a column; NaN counts as null."""
    if pa.types.is_floating(column.type):
        column = pc.if_else(pc.is_nan(column), None, column)
    return _plain(column)


def parts_of(session: SparkSession, spread: int) -> int:
    """Parts of a shuffle: ``spread`` for each core, and no fewer than Spark's setting. A number keeps AQE from laying few, long keys into one task."""
    return max(int(session.conf.get("spark.sql.shuffle.partitions")), spread * session.sparkContext.defaultParallelism)


def fold_frames(rows: DataFrame, keys: list[str], step: list[str], columns: list[str], make: Callable[[], Fold], schema: str, spread: int = 4) -> DataFrame:
    """One fold per key over ``columns``, a call for all rows that share the columns ``step``, in their order.

    Rows of a step come sorted by ``columns``. The result has the key, the step and what the
    fold gives; ``schema`` names the latter. A key of any length streams: no group is held
    whole. Empty tables give empty results; null keys are keys of their own. ``spread``: the parts
    for each core; many, where keys are few and long, so that hardly two of them meet in a task.
    """
    used = list(dict.fromkeys([*keys, *step, *columns]))
    ordered = rows.select(*used).repartition(parts_of(rows.sparkSession, spread), *keys).sortWithinPartitions(*keys, *step, *[c for c in columns if c not in step])
    place = {c: k for k, c in enumerate(used)}
    at = [place[c] for c in columns]
    typed = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (*keys, *step))
    out_type = T.StructType.fromDDL(f"{typed}, {schema}")
    arrow = to_arrow_schema(out_type)
    n_keys, n_head = len(keys), len(keys) + len(step)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, fold = None, None
        held: list[tuple] = []

        def close(whole: bool) -> list[tuple]:
            found = [(*head, *r) for r in fold.frame(held)] if held else []
            return found + [(*head, *r) for r in fold.end()] if whole else found

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            columns_out = zip(*out) if out else [()] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns_out, arrow)], schema=arrow)

        for batch in batches:
            values = [_values(c) for c in batch.columns]
            heads, wanted = zip(*values[:n_head]), zip(*(values[i] for i in at))
            out: list[tuple] = []
            for now, part in groupby(zip(heads, wanted), key=itemgetter(0)):
                if now != head:
                    if fold is not None:
                        out += close(now[:n_keys] != head[:n_keys])
                    if fold is None or now[:n_keys] != head[:n_keys]:
                        fold = make()
                    head, held = now, []
                held.extend(row for _, row in part)
            if out:
                yield batch_of(out)
        if fold is not None:
            yield batch_of(close(True))

    return ordered.mapInArrow(run, out_type)
