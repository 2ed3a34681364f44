"""Document fingerprints: Merkle trees over pieces, paragraphs and sections, in Spark expressions only.

A text is cut, without losing a character, into paragraphs (each ends with its line feed),
these into pieces of five to eight words that end with a sentence, and 16 paragraphs in
turn make a section. Every node's hash is the SHA-256 of its children's, a piece's is that of its text.
A fingerprint shows the root whole, the other nodes by their first digits:

    root | section:paragraph.piecepiece...,paragraph.piece...;section:... | bits

Equal roots mean equal texts. Two different trees are compared from the top: a section or a
paragraph found on both sides is settled, what is left locates the edit. Short texts also list
bits of three characters, as a few pieces are too coarse a measure of likeness.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrack.functions.shared import written

#: Paragraphs in a section, and code points below which a fingerprint lists bits and from which on pieces (both between, so that a text and its edit share one).
SECTION, BITS_BELOW, PIECES_FROM = 16, 600, 300
#: Keys in one range of the global order at most, on average.
RANGE_ROWS = 500_000

_PARAGRAPH_END = r"(?<=\n)"
_PIECE = r"\s*+(?:\S{1,24}+\s++){0,3}+(?:\S{1,24}+(?<![.!?])\s++){0,4}+\S{0,24}+\s*+"
_BIT = r"\s*+\S{0,3}+\s*+"
#: Hex digits of a section's or paragraph's hash, and of a piece's or bit's.
_BRANCH, _LEAF = 8, 6


def _cut(text: Column, pattern: str) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: x != "")


def _digests(pieces: Column) -> Column:
    return F.transform(pieces, lambda x: F.sha2(x, 256))


def _short(digests: Column, digits: int) -> Column:
    return F.array_join(F.transform(digests, lambda x: F.substring(x, 1, digits)), "")


def add_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the fingerprint of column ``text`` (null: of the empty text) as column ``name``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    paragraphs = F.filter(F.split(whole, _PARAGRAPH_END, -1), lambda p: p != "")
    # each step is a column of its own, since a lambda would compute what it names twice twice
    df = df.withColumn("__leaves", F.transform(paragraphs, lambda p: _digests(_cut(p, _PIECE))))
    df = df.withColumn("__nodes", F.transform("__leaves", lambda ls: F.struct(F.sha2(F.array_join(ls, ""), 256).alias("h"), _short(ls, _LEAF).alias("shown"))))
    n = F.size("__nodes")
    sections = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / SECTION).cast("int")), lambda i: F.slice(F.col("__nodes"), i * SECTION + 1, SECTION))).otherwise(F.array().cast("array<array<struct<h:string,shown:string>>>"))
    df = df.withColumn("__sections", sections)
    long_enough = F.length(whole) >= PIECES_FROM

    def section(ps: Column) -> Column:
        listed = F.array_join(F.transform(ps, lambda p: F.concat(F.substring(p["h"], 1, _BRANCH), F.lit("."), F.when(long_enough, p["shown"]).otherwise(""))), ",")
        return F.struct(F.sha2(F.array_join(F.transform(ps, lambda p: p["h"]), ""), 256).alias("h"), listed.alias("shown"))

    df = df.withColumn("__tree", F.transform("__sections", section))
    root = F.sha2(F.array_join(F.transform("__tree", lambda s: s["h"]), ""), 256)
    shown = F.array_join(F.transform("__tree", lambda s: F.concat(F.substring(s["h"], 1, _BRANCH), F.lit(":"), s["shown"])), ";")
    bits = F.when(F.length(whole) < BITS_BELOW, _short(_digests(_cut(whole, _BIT)), _LEAF)).otherwise("")
    return df.withColumn(name, F.concat(root, F.lit("|"), shown, F.lit("|"), bits)).drop("__leaves", "__nodes", "__sections", "__tree")


def root_of(fingerprint: Column) -> Column:
    return F.substring_index(fingerprint, "|", 1)


def _numbered(shown: Column) -> Column:
    """The leaves of concatenated short hashes, the k-th occurrence of one told from its others, as longs."""
    joined = F.array_join(F.sort_array(F.regexp_extract_all(shown, F.lit(f"[0-9a-f]{{{_LEAF}}}"), F.lit(0))), "")
    runs = F.regexp_extract_all(joined, F.lit(f"([0-9a-f]{{{_LEAF}}})\\1*+"), F.lit(0))  # equal leaves stand together
    leaf = lambda run: F.conv(F.substring(run, 1, _LEAF), 16, 10).cast("long") * (1 << 32)
    return F.flatten(F.transform(runs, lambda run: F.transform(F.sequence(F.lit(1), F.floor(F.length(run) / _LEAF).cast("int")), lambda k: leaf(run) + k)))


def add_likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """``df`` with the likeness (0 to 1) of the fingerprints in columns ``a`` and ``b`` as column ``name``.

    1 for equal roots, else twice the shared leaves over all leaves of both, repeats counted: bits where both
    fingerprints list bits, else pieces. Null where a fingerprint is null.
    """
    bits = lambda c: F.substring_index(F.col(c), "|", -1)
    both = (bits(a) != "") & (bits(b) != "")

    def leaves(c: str) -> Column:
        pieces = F.regexp_replace(F.substring_index(F.substring_index(F.col(c), "|", 2), "|", -1), f"[0-9a-f]{{{_BRANCH}}}[:.]|[,;]", "")
        return _numbered(F.when(both, bits(c)).otherwise(pieces))

    df = df.withColumn("__a", leaves(a)).withColumn("__b", leaves(b))
    of = F.size("__a") + F.size("__b")
    shared = F.size(F.array_intersect("__a", "__b"))
    likeness = F.when(root_of(F.col(a)) == root_of(F.col(b)), 1.0).when(F.col(a).isNull() | F.col(b).isNull(), F.lit(None)).when(of == 0, 0.0).otherwise(2.0 * shared / of)
    return df.withColumn(name, likeness).drop("__a", "__b")


def add_differences(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """``df`` with the paragraphs of ``a`` (section, paragraph; both from 0) that stand nowhere in ``b``, as column ``name``.

    Only sections of ``a`` that ``b`` lacks are opened. Equal texts give an empty list.
    """
    tree = lambda c: F.filter(F.split(F.substring_index(F.substring_index(F.col(c), "|", 2), "|", -1), ";"), lambda s: s != "")
    hashes = lambda s: F.regexp_extract_all(s, F.lit(f"([0-9a-f]{{{_BRANCH}}})[.]"), F.lit(1))
    head = lambda s: F.substring(s, 1, _BRANCH)
    df = df.withColumn("__a", tree(a)).withColumn("__b", F.transform(tree(b), head)).withColumn("__p", hashes(F.substring_index(F.substring_index(F.col(b), "|", 2), "|", -1)))
    opened = F.transform("__a", lambda s, i: F.when(F.array_contains("__b", head(s)), F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(
        F.filter(F.transform(hashes(s), lambda p, j: F.when(~F.array_contains("__p", p), F.struct(i.alias("section"), j.alias("paragraph")))), lambda x: x.isNotNull())))
    return df.withColumn(name, F.when(root_of(F.col(a)) == root_of(F.col(b)), F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(F.flatten(opened))).drop("__a", "__b", "__p")


def _next_keys(keys: DataFrame, ids: list[str]) -> DataFrame:
    """Distinct ``keys`` with the next key in ascending order (after the last: the first) as ``next_...``.

    The keys are range-partitioned and written with their range's number; the next key is looked for within
    the range, and only each range's first key goes through one task.
    """
    spark = keys.sparkSession
    n = keys.count()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // RANGE_ROWS))
    ranged = written(keys.repartitionByRange(ranges, *ids).withColumn("__range", F.spark_partition_id()), "merkle-keys")
    firsts = ranged.groupBy("__range").agg(F.min(F.struct(*ids)).alias("first"))  # a row for each range
    around = Window.orderBy("__range")
    firsts = firsts.select("__range", F.coalesce(F.lead("first").over(around), F.min("first").over(Window.partitionBy(F.lit(0)))).alias("first"))
    follow = F.lead(F.struct(*ids)).over(Window.partitionBy("__range").orderBy(*ids))
    found = ranged.withColumn("__next", follow).join(firsts.hint("broadcast"), "__range")
    after = F.coalesce("__next", "first")
    return found.select(*keys.columns, *(after[c].alias(f"next_{c}") for c in ids))


def edits_and_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its text's and its edited text's fingerprint, and their likeness.

    The edited text: the last quarter of the code points (rounded down) replaced by as many of the next document's
    first ones, or all it has. Documents follow one another by id, nulls first, those of one id by the
    XXH64 of their texts; rows of equal id and text are one document, and each has the same result. A null text is the empty
    text. A table of one document follows itself; an empty table gives an empty result. Columns: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.
    """
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = texts.withColumn("h", F.xxhash64("text"))
    keys = texts.select("doc_id", "h", F.length("text").alias("n_chars")).groupBy("doc_id", "h").agg(F.max("n_chars").cast("long").alias("n_chars"))
    links = written(_next_keys(keys, ["doc_id", "h"]), "merkle-links").withColumn("take", F.floor(F.col("n_chars") / 4).cast("int"))

    def at(x: str, y: str) -> Column:
        return F.col(f"{x}doc_id").eqNullSafe(F.col(f"{y}doc_id")) & (F.col(f"{x}h") == F.col(f"{y}h"))

    # ``texts`` stands unrenamed on the same keys in both joins, so that Spark shuffles whole texts once and reads them twice
    asked = links.select(F.col("doc_id").alias("at_doc_id"), F.col("h").alias("at_h"), "take", "next_doc_id", "next_h")
    met = asked.hint("merge").join(texts, at("next_", ""))
    heads = add_fingerprint(met.select("at_doc_id", "at_h", "take", "text"), "text", "next_fingerprint").withColumn("head", F.expr("substring(text, 1, take)"))
    heads = heads.groupBy("at_doc_id", "at_h").agg(F.max("head").alias("head"), F.max("take").alias("take"), F.max("next_fingerprint").alias("next_fingerprint"))
    rows = texts.join(heads.hint("merge"), at("at_", "")).select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), F.expr("concat(substring(text, 1, length(text) - take), head)").alias("edited"), "next_fingerprint")
    rows = add_fingerprint(add_fingerprint(rows.withColumn("edited_sha256", F.sha2("edited", 256)), "text", "fingerprint"), "edited", "edited_fingerprint").drop("text", "edited")
    rows = add_likeness(add_likeness(rows, "fingerprint", "edited_fingerprint", "near_edited"), "fingerprint", "next_fingerprint", "near_next")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
