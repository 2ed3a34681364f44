"""SimHash near-duplicates by deletion-variant signatures.

Two fingerprints that differ in at most four of 64 bits, cut into three segments, agree
in one segment up to one bit. Each fingerprint is therefore indexed under every variant
of every segment with one bit wildcarded; fingerprints that meet under an equal variant
are compared by their true distance. Nothing is missed and no cap applies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrack.functions.shared import written
from loomtrack.llm.common import map_texts
from loomtrack.operators.graph import connected_components

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: First bit and length of each segment.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Fingerprints of a bucket that meet in one unit of work; buckets that are compared all at once; rows a task takes at a time.
BLOCK, SMALL, GATHERED = 2048, 24, 200_000
#: Up to so many hot buckets are broadcast (12 bytes each); more are joined.
BROADCAST_KEYS = 200_000


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the ``size``-word shingles of a text; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    if len(words) <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long, one row per document; null text counts as empty."""
    return _prints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ("doc_id",))


def _prints(named: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    def make():
        return lambda texts: {"fp": pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))}

    return map_texts(named, make, "fp long", "text", keep)


def _case(values: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN p < {start + length} THEN {value}" for (start, length), value in zip(SEGMENTS, values)) + " END"


def _variants(fps: DataFrame) -> DataFrame:
    """Adds ``key``: 64 rows per fingerprint, the key naming the wildcarded bit and the other bits of its segment."""
    shift, mask = _case([str(start) for start, _ in SEGMENTS]), _case([f"{(1 << length) - 1}L" for _, length in SEGMENTS])
    key = f"shiftleft(cast(p AS bigint), 22) | (shiftrightunsigned(fp & ~shiftleft(1L, p), {shift}) & {mask})"
    return fps.select("*", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p")).select(*fps.columns, F.expr(key).alias("key"))


def _hot_keys(fps: DataFrame, block: int) -> DataFrame:
    """(key, blocks) of the variants that may hold more than ``block`` fingerprints.

    A variant holds the fingerprints of two segment values, so counting the three segment
    values of each fingerprint is enough: one of the two has more than half a block.
    """
    values = [F.struct(F.lit(k).alias("segment"), F.expr(f"shiftleft(shiftrightunsigned(fp, {start}) & {(1 << length) - 1}L, {start})").alias("fp")) for k, (start, length) in enumerate(SEGMENTS)]
    counted = fps.select(F.explode(F.array(*values)).alias("s")).select("s.*").groupBy("segment", "fp").agg(F.count("*").alias("n")).where(F.col("n") > block // 2)
    keyed = _variants(counted)
    own = [f"(segment = {k} AND shiftrightunsigned(key, 22) BETWEEN {start} AND {start + length - 1})" for k, (start, length) in enumerate(SEGMENTS)]
    return keyed.where(" OR ".join(own)).groupBy("key").agg(F.sum("n").alias("n")).select("key", F.ceil(F.col("n") / F.lit(block) + F.lit(1)).cast("int").alias("blocks"))


def _parts(near: np.ndarray) -> Iterator[np.ndarray]:
    """The connected sets of two or more rows of a symmetric link matrix."""
    left = near.any(axis=1)
    while left.any():
        inside = np.zeros(len(near), bool)
        new = np.array([left.argmax()])
        while len(new):
            inside[new] = True
            new = np.flatnonzero(near[new].any(axis=0) & ~inside)
        left &= ~inside
        yield np.flatnonzero(inside)


def _bits(signed: np.ndarray) -> np.ndarray:
    """The 1-bits of signed longs, bit 63 included; bitwise_count takes the absolute value of a signed number first."""
    return np.bitwise_count(signed.view(np.uint64))


def _edges(distance: int):
    def of(rows: pa.Table) -> pa.RecordBatch:
        fp, key, low, high = (rows[c].to_numpy() for c in ("fp", "key", "low", "high"))
        n = len(fp)
        new = np.ones(n, bool)
        new[1:] = (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, n))
        group = np.repeat(np.arange(len(starts)), sizes)
        small = np.repeat(sizes <= SMALL, sizes)
        a_out, b_out = [], []
        for lag in range(1, SMALL):
            at = np.flatnonzero((group[lag:] == group[:-lag]) & small[lag:])
            if not len(at):
                break
            at = at[_bits(fp[at] ^ fp[at + lag]) <= distance]
            a_out.append(fp[at])
            b_out.append(fp[at + lag])
        for k in np.flatnonzero(sizes > SMALL).tolist():
            members = np.unique(fp[starts[k] : starts[k] + sizes[k]])
            near = np.zeros((len(members), len(members)), bool)
            for i in range(0, len(members), 512):
                near[i : i + 512] = _bits(members[i : i + 512, None] ^ members[None, :]) <= distance
            np.fill_diagonal(near, False)
            for part in _parts(near):
                a_out.append(np.full(len(part) - 1, members[part[0]]))
                b_out.append(members[part[1:]])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a_out, b_out))
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].astype(np.int64)), pa.array(pairs[:, 1].astype(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Walks rows sorted by bucket; the last bucket of what is at hand is carried on."""
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count < GATHERED:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            key, low, high = (rows[c].to_numpy() for c in ("key", "low", "high"))
            same = (key == key[-1]) & (low == low[-1]) & (high == high[-1])
            cut = 0 if same.all() else rows.num_rows - int(same[::-1].argmin())
            if cut:
                yield of(rows.slice(0, cut))
            held = rows.slice(cut).to_batches()
            count = rows.num_rows - cut
        if count:
            yield of(pa.Table.from_batches(held).combine_chunks())

    return run


def components(prints: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """(fp, component) for every distinct fingerprint; component is the smallest one reachable.

    Hot groups do not expand into pairs: the members of a variant bucket are compared where
    they meet, in a task, and each connected set comes out as a star. A bucket that may hold
    more than ``block`` fingerprints is dealt out as pairs of blocks, each its own unit.
    """
    fps = written(prints.select("fp").where("fp IS NOT NULL").distinct(), "simhash-distinct")
    hot = written(_hot_keys(fps, block), "simhash-hot")
    few = hot.count() <= BROADCAST_KEYS
    keyed = _variants(fps).join(F.broadcast(hot) if few else hot.hint("merge"), "key", "left")
    cold = keyed.where("blocks IS NULL").select("fp", "key", F.lit(0).alias("low"), F.lit(0).alias("high"))
    split = (
        keyed.where("blocks IS NOT NULL")
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        .select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("fp", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    )
    met = cold.unionByName(split).repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    found = written(met.mapInArrow(_edges(distance), "a long, b long"), "simhash-edges")
    parts = connected_components(found, "a", "b").toDF("fp", "component")
    return fps.join(parts.hint("merge"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))


def _grouped(prints: DataFrame, distance: int) -> DataFrame:
    """Adds ``component``, a fingerprint, to fingerprinted rows."""
    prints = written(prints, "simhash-prints")
    return prints.join(written(components(prints, distance), "simhash-components").hint("merge"), "fp")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per document.

    ``component_id`` is the smallest doc_id reachable over links of at most ``distance``
    bits, the document itself included. Empty or null texts have fingerprint zero and are
    linked like any other. Rows with a null doc_id take part; their component is named by
    the smallest known id. Repeated rows are returned as often as they come. An empty
    table gives an empty result. Only the two named columns are read.
    """
    grouped = _grouped(fingerprints(docs, doc_id, text), distance)
    named = written(grouped.groupBy("component").agg(F.min("doc_id").alias("component_id")), "simhash-named")
    return grouped.join(named.hint("merge"), "component").select(F.col("doc_id").alias(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row of ``docs``, all columns, for each component: the one with the smallest doc_id.

    Null ids come last; of rows with one id the one with the smaller hash of the text stays,
    then of all columns (but maps), so that the same row stays in every run; of rows equal in
    all of them any. Columns may have any names. An empty table gives an empty result.
    """
    hashed = [c for f in docs.schema for c in (F.col(f"`{f.name}`"), F.col(f"`{f.name}`").isNull()) if "map<" not in f.dataType.simpleString()]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"), F.xxhash64(*hashed).alias("row_hash"))
    keys = ("doc_id", "text_hash", "row_hash")
    grouped = _grouped(_prints(rows.select(*keys, "text"), keys), distance)
    each = F.struct(F.col("doc_id").isNull().alias("unknown"), *keys)
    chosen = grouped.groupBy("component", each.alias("who")).agg(F.count("*").alias("n")).groupBy("component").agg(F.min(F.struct("who", "n")).alias("best"))
    chosen = written(chosen.select(F.col("best.who.doc_id").alias("id"), F.col("best.who.text_hash").alias("hash"), F.col("best.who.row_hash").alias("row_id"), "best.n"), "simhash-chosen")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")) & (F.col("row_hash") == F.col("row_id"))
    joined = lambda some: rows.drop("text").join(chosen.where(some).hint("merge"), same)
    return joined("n = 1").select("row.*").unionByName(joined("n > 1").dropDuplicates(list(keys)).select("row.*"))
