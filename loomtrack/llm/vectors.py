"""Near-duplicate vectors by random hyperplanes, and nearest neighbours by collision counting."""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, erf, log, log2, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrack.functions.shared import written
from loomtrack.operators.graph import connected_components

COSINE = 0.93
#: Hyperplanes in a table at least, vectors that a bucket should hold on average, and how likely a pair at the limit may share no bucket.
BITS, BUCKET, MISS = 8, 128, 3e-4
#: Vectors of a bucket that meet in one task; larger buckets are split into pairs of blocks.
BLOCK = 1024
#: Up to so many large buckets are broadcast (50 bytes each); more are joined.
BROADCAST_BUCKETS = 100_000
SEED = 20_240

#: Collision counting: directions, windows per unit of radius, the k-th distance's distance to the radius, rounds per median distance, vectors in a block, queries whose windows are found at once.
PROJECTIONS, WIDTH, SLACK, STEPS = 128, 1.8, 1.03, 14
DATA_BLOCK, QUERY_BATCH = 16_384, 32


def usable(vector: str) -> Column:
    """Not null, not empty, not zero, and without null or non-finite components."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def tables_for(largest: int) -> tuple[int, int]:
    """(tables, hyperplanes in each) for a label of ``largest`` different vectors.

    Buckets keep their mean size as a label grows, so comparisons grow with the rows, not with
    their square; more hyperplanes part more pairs at the limit, which more tables make up for.
    """
    bits = max(BITS, ceil(log2(max(largest, 1) / BUCKET)))
    together = (1 - acos(COSINE) / pi) ** bits
    return ceil(log(MISS) / log(1 - together)), bits


def _classes(rows: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """(label, vector, rep, copies): equal vectors of a label as one, named by their smallest id."""
    return rows.where(F.col(label).isNotNull() & F.col(vec_id).isNotNull() & usable(vector)).groupBy(F.col(label).alias("label"), F.col(vector).alias("vector")).agg(F.min(vec_id).alias("rep"), F.count("*").alias("copies"))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _planes(dim: int, tables: int, bits: int) -> np.ndarray:
    return np.random.default_rng(SEED + dim).standard_normal((dim, tables * bits))


def _signatures(unit: np.ndarray, tables: int, bits: int, planes: np.ndarray) -> np.ndarray:
    return ((unit @ planes > 0).reshape(len(unit), tables, bits) << np.arange(bits)).sum(axis=2)


def _signed(classes: DataFrame, tables: int, bits: int) -> DataFrame:
    """One row per class and table: (label, dim, rep, copies, vector, tab, sig)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        for pdf in batches:
            pdf = pdf.assign(dim=pdf["vector"].map(len))
            for dim, part in pdf.groupby("dim"):
                if dim not in planes:
                    planes[dim] = _planes(dim, tables, bits)
                sigs = _signatures(_unit(_matrix(part["vector"])), tables, bits, planes[dim])
                yield pd.DataFrame({"label": part["label"], "dim": part["dim"], "rep": part["rep"], "copies": part["copies"], "vector": part["vector"], "sigs": list(sigs)})

    signed = classes.mapInPandas(run, f"label {classes.schema['label'].dataType.simpleString()}, dim int, rep long, copies long, vector {classes.schema['vector'].dataType.simpleString()}, sigs array<long>")
    return signed.select("label", "dim", "rep", "copies", "vector", F.posexplode("sigs").alias("tab", "sig"))


def _links_of_bucket(x: np.ndarray, sigs: np.ndarray, tab: int, low: np.ndarray, high: np.ndarray, reps: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, ...]:
    """For one pair of blocks of a bucket: links of each linked vector, and the smallest vector it is connected with here.

    ``low`` and ``high`` say which vectors belong to which block. A pair counts only in the
    first table whose bucket both share.
    """
    n = len(x)
    left, right = np.flatnonzero(low), np.flatnonzero(high)
    near = x[left] @ x[right].T >= COSINE
    if low is high:
        near &= left[:, None] < right[None, :]
    a, b = np.nonzero(near)
    a, b = left[a], right[b]
    if tab and len(a):
        first = ~(sigs[a, :tab] == sigs[b, :tab]).any(axis=1)
        a, b = a[first], b[first]
    links = np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)
    root = reps.copy()
    while len(a):
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        if (new == root).all():
            break
        root = new
    found = links > 0
    return reps[found], links[found].astype(np.int64), root[found]


def _links(tables: int, bits: int):
    """Walks rows sorted by KEYS; a unit (a pair of blocks of a bucket) that runs over a batch's end is carried on."""

    def starts_of(rows: pa.Table) -> np.ndarray:
        """Where another unit starts, the first row left out."""
        n = rows.num_rows
        differ = np.zeros(max(n - 1, 0), bool)
        for c in KEYS:
            column = rows[c].combine_chunks()
            differ |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        return np.flatnonzero(differ) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}

        def of(rows: pa.Table) -> pa.RecordBatch:
            n = rows.num_rows
            dims = rows["dim"].to_numpy()
            starts = np.concatenate(([0], np.cumsum(dims)))
            values = rows["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            tab, block, low, high, reps, copies = (rows[c].to_numpy() for c in ("tab", "block", "low", "high", "rep", "copies"))
            cuts = [0, *starts_of(rows).tolist(), n]
            out = []
            for i, j in zip(cuts, cuts[1:]):
                if j - i > 1:
                    dim = int(dims[i])
                    if dim not in planes:
                        planes[dim] = _planes(dim, tables, bits)
                    x = _unit(values[starts[i] : starts[j]].reshape(j - i, -1))
                    first = block[i:j] == low[i]
                    sigs = _signatures(x, int(tab[i]), bits, planes[dim][:, : int(tab[i]) * bits])
                    out.append(_links_of_bucket(x, sigs, int(tab[i]), first, first if low[i] == high[i] else ~first, reps[i:j], copies[i:j]))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64), pa.int64()) for k in range(3)], ["rep", "links", "root"])

        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            units = starts_of(rows)
            last = int(units[-1]) if len(units) else 0
            held = rows.slice(last)
            if last:
                yield of(rows.slice(0, last))
        if held is not None:
            yield of(held)

    return run


#: What makes a unit of comparison, in the order of sorting.
KEYS = ("label", "dim", "tab", "sig", "low", "high")


def embedding_duplicates(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per vector.

    Vectors are linked where labels are equal and not null and the cosine is at least 0.93;
    only vectors of one length are compared. Equal vectors are handled as one class with a
    count, so copies are never expanded into pairs, and a large bucket is compared in pairs of
    blocks, each its own task. Vectors that are null, empty, zero, or hold null or non-finite
    components, or have a null id or label, link with nothing: they are their own component.
    Repeated rows link with each other. An empty table gives an empty result. Other columns are ignored.
    """
    classes = written(_classes(rows, vec_id, vector, label), "vectors-classes")
    largest = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    tables, bits = tables_for(largest)
    bucket = ["label", "dim", "tab", "sig"]
    sizes = written(_signed(classes, tables, bits).groupBy(*bucket).agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select(*bucket, F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("many")), "vectors-sizes")
    few = sizes.count() <= BROADCAST_BUCKETS
    placed = _signed(classes, tables, bits).join(F.broadcast(sizes) if few else sizes.hint("merge"), bucket, "left").withColumn("blocks", F.coalesce("many", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    met = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(*bucket, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "rep", "copies", "vector")
    sorted_rows = met.repartition(*KEYS).sortWithinPartitions(*KEYS)
    pairs = written(sorted_rows.mapInArrow(_links(tables, bits), "rep long, links long, root long"), "vectors-links")
    links = written(pairs.groupBy("rep").agg(F.sum("links").alias("links")), "vectors-counts")
    parts = written(connected_components(pairs.select("rep", "root"), "rep", "root").toDF("rep", "component"), "vectors-components")
    named = classes.join(links.hint("merge"), "rep", "left").join(parts.hint("merge"), "rep", "left").select("label", "vector", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    named = written(named, "vectors-named")
    left = rows.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"), F.when(F.col(vec_id).isNotNull() & usable(vector), F.col(label)).alias("label"))
    known = left.where("label IS NOT NULL").join(named.hint("merge"), ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = left.where("label IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.unionByName(alone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _apart(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``x`` from ``q``; each is taken to a power of two near its largest difference and back, so that squares neither overflow nor vanish."""
    difference = x - q
    power = np.frexp(np.abs(difference).max(axis=1, initial=0.0))[1]
    return np.ldexp(np.sqrt((np.ldexp(difference, -power[:, None]) ** 2).sum(axis=1)), power)


class Projections:
    """Sorted arrays of a block's vectors along single random directions (orthonormal ones, as far as the length allows)."""

    def __init__(self, x: np.ndarray):
        n, dim = x.shape
        rng = np.random.default_rng(SEED)
        bases = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-PROJECTIONS // dim))]
        self.power = int(np.frexp(np.abs(x).max(initial=0.0))[1])  # projections, windows and radii are in units of this power of two
        self.x, self.directions = x, np.hstack(bases)[:, :PROJECTIONS] * np.sqrt(dim)  # a difference of length d has projections of size d
        x = np.ldexp(x, -self.power)
        values = (x @ self.directions).T
        self.order = np.argsort(values, axis=1)
        self.sorted = np.take_along_axis(values, self.order, axis=1)
        pairs = rng.integers(0, n, (2, 256))
        apart = _apart(x[pairs[0]], x[pairs[1]])
        step = float(np.median(apart[apart > 0])) / STEPS if (apart > 0).any() else 1.0
        widths = [step * 2.0**r for r in range(-6, 0)] + [step * r for r in range(1, int(1.25 * WIDTH * STEPS))]
        while widths[-1] < np.ptp(values):  # beyond the distances of the sample
            widths.append(1.25 * widths[-1])
        self.radii = np.array([*widths, np.inf]) / WIDTH
        self.threshold = np.array([sum(erf(w / v * WIDTH / sqrt(2)) for w in widths[: r + 1]) for r, v in enumerate(widths)]) * PROJECTIONS

    def windows(self, queries: np.ndarray) -> np.ndarray:
        """First place and place after the last of each query's window, by round and direction: (queries, 2, rounds, directions)."""
        at, widths = np.ldexp(queries, -self.power) @ self.directions, self.radii * WIDTH
        out = np.empty((len(queries), 2, len(widths), PROJECTIONS), np.int64)
        for j, line in enumerate(self.sorted):
            for side, sign in enumerate((-1, 1)):
                out[:, side, :, j] = np.searchsorted(line, at[:, j, None] + sign * widths, side="left" if side == 0 else "right")
        return out

    def nearest(self, q: np.ndarray, windows: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(places, distances, verified): the ``k`` nearest found, one row for each id, and how many vectors were verified.

        The windows around the query grow round by round (virtual rehashing): first they double,
        then they grow by equal steps, at last they hold all. A vector collides once for each
        round and direction in whose window it lies. A window of half width h stands for the
        radius h / WIDTH; vectors with as many collisions as are to be expected at that radius
        are verified. The search ends when the k-th distance found, times SLACK, lies within
        the radius.
        """
        n, (lows, highs) = len(self.x), windows
        low = high = (lows[0] + highs[0]) // 2
        inside, collisions, verified = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
        places, distances = np.zeros(0, np.int64), np.zeros(0)
        for r, radius in enumerate(self.radii):
            a, b = lows[r], highs[r]
            entered = [line[i:j] for line, i, j in zip(self.order, a.tolist(), low.tolist()) if i < j] + [line[i:j] for line, i, j in zip(self.order, high.tolist(), b.tolist()) if i < j]
            if entered:
                inside += np.bincount(np.concatenate(entered), minlength=n)
            low, high = a, b
            collisions += inside
            new = np.flatnonzero(((collisions >= self.threshold[r]) if np.isfinite(radius) else True) & ~verified)
            if len(new):
                verified[new] = True
                new = new[ids[new] != own]
                places = np.concatenate((places, new))
                distances = np.concatenate((distances, _apart(self.x[new], q)))
                best = np.lexsort((distances, ids[places]))
                named = ids[places[best]]
                best = best[np.concatenate(([True], named[1:] != named[:-1]))[: len(best)]]  # of rows with one id the nearest
                best = best[np.lexsort((ids[places[best]], distances[best]))[:k]]
                places, distances = places[best], distances[best]
            if len(places) == k and np.ldexp(distances[-1], -self.power) * SLACK <= radius:
                break
        return places, distances, int(verified.sum())


def _search(k: int):
    """Answers the queries of each block of rows sorted by (dim, db, asks): the block's data come first, then the queries, which stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: tuple[int, int] | None = None
        ids: list[np.ndarray] = []
        data: list[np.ndarray] = []
        index: Projections | None = None
        for batch in batches:
            dims, blocks, asks, vec_ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            values, starts = batch.column(5).flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate(([0], np.cumsum(dims)))
            tags = batch.column(4).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((np.diff(dims) != 0) | (np.diff(blocks) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1).tolist(), batch.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                x = values[starts[i] : starts[j]].reshape(j - i, -1)
                if (dims[i], blocks[i]) != block:
                    block, ids, data, index = (dims[i], blocks[i]), [], [], None
                if not asks[i]:
                    ids.append(vec_ids[i:j])
                    data.append(x)
                    continue
                if index is None:
                    if not data:
                        continue
                    known, index = np.concatenate(ids), Projections(np.concatenate(data))
                    ids, data = [known], []
                found = []
                for at in range(i, j, QUERY_BATCH):
                    some = x[at - i : at - i + QUERY_BATCH]
                    found += [index.nearest(q, w, ids[0], own, k)[:2] for q, w, own in zip(some, index.windows(some), vec_ids[at:j])]
                many = [len(p) for p, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(vec_ids[i:j], many)), pa.array(np.repeat(tags[i:j], many)), pa.array(ids[0][np.concatenate([p for p, _ in found])]), pa.array(np.concatenate([d for _, d in found]))],
                    ["query_id", "asking", "vec_id", "score"],
                )

    return run


def nearest_neighbours(rows: DataFrame, queries: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", data_block: int = DATA_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each row where ``queries`` holds.

    Rows are dealt into blocks of about ``data_block`` vectors. Each block is one unit of work:
    its sorted arrays are built once, then all queries stream past it. The best of all blocks
    are ranked; ties go to the smaller id. Rows whose vector is null, empty, zero, or has null
    or non-finite components, or whose id is null, take no part, nor does a query's own id;
    vectors of other lengths are not compared. With fewer candidates than ``k`` all are
    returned. Rows equal in id and vector are one; of candidates with one id and different
    vectors the nearest counts, so that no neighbour is named twice; a query id with different vectors
    is asked, and ranked, once for each. An empty table gives an empty result. Other columns are ignored.
    """
    kept = rows.where(F.col(vec_id).isNotNull() & usable(vector)).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks"))
    kept = written(kept.groupBy("vec_id", "vector").agg(F.max("asks").alias("asks")).select("*", F.size("vector").alias("dim"), F.xxhash64("vec_id", "vector").alias("tag")), "nearest-rows")
    blocks = max(1, -(-kept.count() // data_block))
    data = kept.select("dim", F.pmod("tag", F.lit(blocks)).cast("int").alias("db"), F.lit(False).alias("asks"), "vec_id", "tag", "vector")
    asked = kept.where("asks").select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("db"), "asks", "vec_id", "tag", "vector")
    met = data.unionByName(asked).repartition("dim", "db").sortWithinPartitions("dim", "db", "asks")
    found = met.mapInArrow(_search(k), "query_id long, asking long, vec_id long, score double")
    found = found.groupBy("query_id", "asking", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id", "asking").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
