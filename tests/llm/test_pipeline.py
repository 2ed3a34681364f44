"""The corpus pipeline against its operators applied plainly."""

import numpy as np
from pyspark.sql import functions as F
from test_simhash import plain_components, plain_fingerprint

import corpus_pipeline
from loomtrack.llm import packing


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_filter", "toxicity_filter", "near_dedup", "pack"]
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:2]:
        smaller = stage(spark, kept, sf)
        assert smaller.columns == docs.columns and 0 < smaller.count() <= kept.count()
        kept = smaller
    rows = {r.doc_id: plain_fingerprint(r.text) for r in kept.collect()}
    signed = {d: f - (1 << 64) if f >> 63 else f for d, f in rows.items()}
    parts, first = plain_components(signed.values()), {}
    for d in sorted(signed):
        first.setdefault(parts[signed[d]], d)
    single = corpus_pipeline.near_dedup(spark, kept, sf)
    assert single.columns == docs.columns
    assert sorted(r.doc_id for r in single.collect()) == sorted(first.values())
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in out} == set(first.values())
    encode = packing.WordEncoder(packing.tokenizer_json())
    wanted = {r.doc_id: len(encode(r.text)) // 4 + 1 for r in single.collect()}
    for d, n in wanted.items():
        assert sum(r.length for r in out if r.doc_id == d) == n
    assert len({r.sequence_id for r in out}) == np.ceil(sum(wanted.values()) / 4096)


def test_odd_rows_pass_every_stage(spark, sf):
    """Nulls in every column, empty texts, repeated rows and ties, columns that clash, tables without rows."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", None, 0), (-2, None, None, "x", None), (-3, "", "en", None, 0), (-3, "", "en", None, 0)], docs.schema)
    rows = docs.unionByName(odd).unionByName(docs.limit(3)).withColumns({c: F.lit(c) for c in ("score", "label", "component", "length", "sequence_id")})
    kept = rows
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, sf)
        assert after.columns == rows.columns, name
        assert after.exceptAll(kept).isEmpty(), name  # nothing but rows that were there
        kept = after
    packed = corpus_pipeline.pack(spark, kept, sf).collect()
    assert sum(r.piece == 0 for r in packed) == kept.count()
    nothing = rows.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        nothing = stage(spark, nothing, sf)
    assert corpus_pipeline.pack(spark, nothing, sf).count() == 0
