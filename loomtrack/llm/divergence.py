"""Source divergence audit: how far apart the word use of a language's sources is, from count-level bitmaps.

A language's kept terms are dealt by hash into blocks of about 1,024 and numbered there. A bitmap
holds the terms of one block that occur a given number of times in one source. ANDing two sources' bitmaps
and counting bits gives the number of terms in each joint cell (count here, count there); terms that
one or both sources lack follow by complement. A cell's terms all have the same divergence.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrack.functions.shared import dimension, written
from loomtrack.llm.common import small_batches

#: Terms in a block on average, sources of one language in one block of pairs on average.
BLOCK, SOURCES = 1024, 64
#: Documents in which a term must occur to be kept; ranks of the term part; the whole of a distribution.
LEAST_DOCS, TERM_RANKS, WHOLE = 3, 200, 1_000_000_000
#: Entries that a task holds before it hands its counts on, and bytes of one text counted at a time.
HELD, PIECE = 300_000, 4 << 20
#: Terms are ASCII letters, lower-cased, and everything beyond ASCII; all else becomes a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_PLAIN = "lang string, source string, term string, n long, docs long"


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a long text's in parts that end between terms."""
    at = 0
    while at < len(data):
        end = len(data) if at + PIECE >= len(data) else data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and rows of ``docs`` that hold the term; a row with a null term for each group."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}

        def hand_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (ns, ds) in held.items():
                many = len(ns) + 1
                terms = pa.array([*ns, None], pa.binary()).cast(pa.string())
                counts = (np.fromiter((*ns.values(), 0), np.int64, many), np.fromiter((*map(ds.__getitem__, ns), 0), np.int64, many))
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, many), pa.repeat(source, many), terms, *map(pa.array, counts)], ["lang", "source", "term", "n", "docs"])
            held.clear()

        size = 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                ns, ds = held.setdefault((lang, source), (Counter(), Counter()))
                before, seen = len(ns), set()
                for words in _pieces((text or b"").translate(_TABLE)):
                    ns.update(words)
                    seen.update(words)
                ds.update(seen)
                size += len(ns) - before
                if size > HELD:
                    yield from hand_on()
                    size = 0
        yield from hand_on()

    group = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]
    parts = docs.select(*group, F.encode("text", "UTF-8")).mapInArrow(run, _PLAIN)
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _div(a: Column, b: Column) -> Column:
    """Whole-number division of longs or decimals."""
    return F.call_function("div", a, b)


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(WHOLE * (n + 1) / (total + terms)), in decimals, as WHOLE times a count can exceed a long."""
    return 1 + _div((n + 1).cast("decimal(19,0)") * F.lit(WHOLE).cast("decimal(10,0)"), (total + terms).cast("decimal(20,0)"))


def count_bitmaps(cells: DataFrame) -> DataFrame:
    """(lang, block, deal, source, p, p0, bits): for each source and share p of its in a block, the set of term numbers as little-endian words.

    ``cells``: (lang, block, deal, source, p, p0, id), one row per term of the block and source.
    """

    def run(table: pa.Table) -> pa.Table:
        source = table["source"].combine_chunks().dictionary_encode()
        codes, p, ids = source.indices.to_numpy(), table["p"].to_numpy(), table["id"].to_numpy()
        order = np.lexsort((p, codes))
        codes, p, ids = codes[order], p[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (p[1:] != p[:-1])]))
        level = np.cumsum(np.isin(np.arange(len(p)), first)) - 1
        width = -(-int(ids.max() + 1) // 64) * 64
        out = []
        for lo in range(0, len(first), 4096):  # levels at a time, so that their table of booleans stays small
            part = (level >= lo) & (level < lo + 4096)
            grid = np.zeros((min(4096, len(first) - lo), width), bool)
            grid[level[part] - lo, ids[part]] = True
            out += [row.tobytes() for row in np.packbits(grid, axis=1, bitorder="little")]
        taken = table.take(pa.array(order[first])).select(["lang", "block", "deal", "source", "p", "p0"])
        return taken.append_column("bits", pa.array(out, pa.binary()))

    return cells.groupBy("lang", "block", "deal").applyInArrow(run, "lang string, block long, deal int, source string, p long, p0 long, bits binary")


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def pair_values(bitmaps: DataFrame, groups: DataFrame, blocks: DataFrame) -> DataFrame:
    """(lang, source, item, value): the divergence of every source from every other one of its language, over all kept terms.

    ``groups``: (lang, source, deal, deals, p0); ``blocks``: (lang, block, terms). Sources are dealt into ``deals`` parts of
    bounded size; a task compares the sources of two parts within one block of terms. Partial sums of blocks are added by Spark.
    """
    # a source without terms in a block still has all of the block's terms at count zero
    absent = groups.select("lang", "source", "deal", "deals", "p0").join(blocks.hint("merge"), "lang").select("lang", "block", "deal", "deals", "source", F.lit(None).cast("long").alias("p"), "p0", F.lit(None).cast("binary").alias("bits"), "terms")
    present = bitmaps.join(groups.select("lang", "source", "deals").hint("merge"), ["lang", "source"]).select("lang", "block", "deal", "deals", "source", "p", "p0", "bits", F.lit(None).cast("long").alias("terms"))
    rows = present.unionByName(absent)
    other = F.explode(F.sequence(F.lit(0), F.col("deals") - 1))
    rows = rows.withColumn("__other", other).withColumn("low", F.least("deal", "__other")).withColumn("high", F.greatest("deal", "__other")).drop("__other", "deals")

    def run(table: pa.Table) -> pa.Table:
        terms = int(max(t for t in table["terms"].to_pylist() if t is not None))
        low, width = table["low"][0].as_py(), -(-terms // 64)
        by_source: dict[str, tuple[int, int, list[tuple[int, bytes]]]] = {}
        for source, deal, p, p0, bits in zip(*(table[c].to_pylist() for c in ("source", "deal", "p", "p0", "bits"))):
            levels = by_source.setdefault(source, (deal, p0, []))[2]
            if p is not None:
                levels.append((p, bits))
        names = sorted(by_source)
        shares, bitmaps, spans = [], [], []
        for name in names:
            levels = by_source[name][2]
            spans.append((len(shares), len(shares) + len(levels)))
            shares += [p for p, _ in levels]
            bitmaps += [np.frombuffer(b.ljust(8 * width, b"\0"), "<u8") for _, b in levels]
        p = np.array(shares, np.int64)
        bits = np.stack(bitmaps) if bitmaps else np.zeros((0, width), np.uint64)
        sizes = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        zero = np.array([by_source[x][1] for x in names], np.int64)
        deals = [by_source[x][0] for x in names]
        one_part = table["low"][0].as_py() == table["high"][0].as_py()
        rows = []
        for i, name in enumerate(names):
            mine, (a, b) = p[spans[i][0] : spans[i][1]], spans[i]
            joint = np.zeros((b - a, len(p)), np.int64)
            for w in range(width):  # a word of all bitmaps at a time, so that no cube of words is held
                joint += np.bitwise_count(bits[a:b, w][:, None] & bits[:, w][None, :])
            for j, item in enumerate(names):
                if i == j or (not one_part and (deals[i] == low) == (deals[j] == low)):
                    continue
                c, d = spans[j]
                cells, theirs = joint[:, c:d], p[c:d]
                lone, missed = sizes[a:b] - cells.sum(axis=1), sizes[c:d] - cells.sum(axis=0)
                neither = terms - int(sizes[a:b].sum()) - int(missed.sum())
                at, to = np.nonzero(cells)
                value = int((cells[at, to] * _divergence(mine[at], theirs[to])).sum())
                value += int((lone * _divergence(mine, zero[j])).sum()) + int((missed * _divergence(zero[i], theirs)).sum())
                rows.append((name, item, value + neither * int(_divergence(zero[i], zero[j]))))
        columns = list(zip(*rows)) if rows else [(), (), ()]
        return pa.table({"lang": pa.array([table["lang"][0].as_py()] * len(rows), pa.string()), "source": pa.array(columns[0], pa.string()), "item": pa.array(columns[1], pa.string()), "value": pa.array(columns[2], pa.int64())})

    parts = rows.groupBy("lang", "block", "low", "high").applyInArrow(run, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): which sources and which terms set a source apart.

    Part ``pair``: the divergence of each (lang, source) group from each other source of its language, over all terms that at
    least ``LEAST_DOCS`` documents of the language hold. Part ``term``: the group's terms that it uses more than the
    language as a whole, the first ``TERM_RANKS``. All arithmetic is in whole numbers. Null text, lang and source are
    read as empty; a group without terms takes part; a language with one source has no pairs, one without
    kept terms has pairs of value 0. Repeated rows count as documents of their own; an empty table gives an empty result.
    """
    counts = written(term_counts(docs), "divergence-counts")
    terms = counts.where(F.col("term").isNotNull())
    kept = terms.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST_DOCS).drop("docs")
    kept = written(kept, "divergence-kept")
    langs = written(kept.groupBy("lang").agg(F.count("*").alias("terms_in_lang"), F.sum("lang_n").alias("lang_total")), "divergence-langs")
    block = F.pmod(F.xxhash64("term"), F.ceil(F.col("terms_in_lang") / BLOCK))
    numbered = kept.join(dimension(langs), "lang").withColumn("block", block)
    numbered = numbered.withColumn("id", F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")) - 1)
    numbered = numbered.withColumn("lang_p", _share(F.col("lang_n"), F.col("lang_total"), F.col("terms_in_lang"))).select("lang", "term", "block", "id", "lang_p")
    cells = written(terms.select("lang", "source", "term", "n").join(numbered.hint("merge"), ["lang", "term"]), "divergence-cells")
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    every = counts.where(F.col("term").isNull()).select("lang", "source").join(totals.hint("merge"), ["lang", "source"], "left").join(dimension(langs), "lang", "left")
    sources = F.count("*").over(Window.partitionBy("lang"))
    every = every.withColumn("terms_in_lang", F.coalesce("terms_in_lang", F.lit(0))).withColumn("total", F.coalesce("total", F.lit(0)))
    every = every.withColumn("deals", F.ceil(sources / SOURCES).cast("int")).withColumn("deal", F.pmod(F.xxhash64("source"), F.col("deals")).cast("int"))
    every = every.withColumn("p0", F.when(F.col("terms_in_lang") > 0, _share(F.lit(0).cast("long"), F.col("total"), F.col("terms_in_lang"))))
    groups = written(every.select("lang", "source", "deals", "deal", "p0", "total", "terms_in_lang"), "divergence-groups")

    shared = cells.join(dimension(groups), ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("total"), F.col("terms_in_lang")))
    bitmaps = written(count_bitmaps(shared.select("lang", "block", "deal", "source", "p", "p0", "id")), "divergence-bitmaps")
    blocks = numbered.groupBy("lang", "block").agg(F.count("*").alias("terms"))
    pairs = pair_values(bitmaps, groups.where("terms_in_lang > 0"), blocks)
    termless = groups.where("terms_in_lang = 0").select("lang", "source")
    pairs = pairs.unionByName(termless.join(termless.select("lang", F.col("source").alias("item")).hint("merge"), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value")))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank"))

    p, q = F.col("p"), F.col("lang_p")
    louder = shared.where(p > q).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _div((p - q) * (p - q), q).alias("value"))
    ranked = louder.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).where(F.col("rank") <= TERM_RANKS)
    return pairs.unionByName(ranked)
