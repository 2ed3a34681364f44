"""Connected components and related edge-table jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrack.functions.shared import shared_dir


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(id, component) for every id on an edge; component is the smallest id reachable.

    Alternating large-star and small-star rounds: every vertex hangs its larger
    neighbours, then its smaller ones, below the smallest neighbour it knows. Rounds
    grow with the logarithm of the longest path. Neighbour lists are never collected:
    the smallest neighbour is a partially aggregated minimum, checkpointed, and the
    rewiring an equi-join of two plain shuffles, which AQE can split when one vertex has
    most of the edges.

    Null ends and self-loops are ignored; an empty edge table gives an empty result;
    repeated and reversed edges change nothing.
    """
    shared_dir(edges.sparkSession)
    current = (
        edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
        .select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .distinct()
        .checkpoint()
    )
    before = None
    while True:
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        both = current.union(current.select("v", "u")).toDF("x", "y")
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")).checkpoint()
        large = both.where("y > x").join(low.hint("merge"), "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct().checkpoint()
        low = large.groupBy("u").agg(F.min("v").alias("m")).checkpoint()
        small = large.join(low.hint("merge"), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = small.union(low.select("u", F.col("m").alias("v"))).distinct().checkpoint()
    roots = current.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return current.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


#: Ids whose links a task holds before it hands them on.
HELD = 1_000_000


def contracted(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """An edge table with the same components: within each task one link for each id, to the smallest id it was joined with.

    Exact wherever the rows lie; where the edges of a component share a task, as many links as ids are left of it.
    """
    kind = edges.schema[src].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}

        def root(x):
            while (y := above.setdefault(x, x)) != x:
                above[x] = x = above[y]
            return x

        def links(type_: pa.DataType) -> pa.RecordBatch:
            found = [(x, r) for x in list(above) if (r := root(x)) != x]
            above.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, type_) for c in (zip(*found) if found else ((), ()))], [src, dst])

        last = None
        for batch in batches:
            last = batch.schema.field(0).type
            for a, b in zip(*(c.to_numpy(zero_copy_only=False).tolist() for c in batch.columns)):
                a, b = root(a), root(b)
                if a != b:
                    above[max(a, b)] = min(a, b)
            if len(above) > HELD:
                yield links(last)
        if above:
            yield links(last)

    return edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(src, dst).mapInArrow(run, f"`{src}` {kind}, `{dst}` {kind}")
