"""Registered queries of the dataset builder and of duplicate classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrack.functions.geometry import FRAME
from loomtrack.functions.shared import written
from loomtrack.operators import builder, datasets
from loomtrack.plans.datasets import _I, _items
from loomtrack.plans.frames import _flagged
from loomtrack.sources import fixtures as fx


def _inputs(spark, sf):
    """All track observations; each frame's image is one of the embeddings' hashes, some frames were not archived, and one session is for testing."""
    obs = written(_flagged(spark, sf), "builder-observations")  # read several times
    hashed = fx.vectors(spark, sf).select("vec_id", datasets.mean_threshold_hash("embedding").alias("hash"))
    frames = obs.select(*FRAME).distinct().where("frame_index % 29 <> 0").withColumn("vec_id", (F.col("frame_index") * 7 + F.crc32(F.concat("session_id", "source_id").cast("binary"))) % F.lit(hashed.count()))
    hashes = frames.join(hashed, "vec_id").select(*FRAME, "hash", F.sha2(F.col("hash").cast("string"), 256).alias("image_sha256"))
    return obs, builder.track_table(obs), hashes, spark.sql("SELECT 'S3' AS session_id, 'test' AS split")


def dq7_dataset_items(spark, sf):
    items, _ = builder.dataset_items(*_inputs(spark, sf))
    return items.select("item_id", "session_id", "sample_group_id", "split", "source_id", "stream_epoch", "frame_index", "reasons", F.round("group_score", 9).alias("group_score"), "n_observations", "tracklet_ids", "hash")


def dq4_leak_classes(spark, sf):
    return datasets.split_leak_classes(_items(spark, sf)).select("hash", "hash2", F.array_join("splits", ",").alias("splits"), "n")


QUERIES = {f.__name__: f for f in (dq7_dataset_items, dq4_leak_classes)}

ORACLES = {
    "dq4_leak_classes": f"""{_I}, c AS (SELECT hash, list(DISTINCT split) AS s, count(*) AS n FROM full_items WHERE hash IS NOT NULL GROUP BY hash)
      SELECT a.hash, b.hash AS hash2, array_to_string(list_sort(list_distinct(list_concat(a.s, b.s))), ',') AS splits, CASE WHEN a.hash = b.hash THEN a.n ELSE a.n + b.n END AS n FROM c a JOIN c b ON a.hash <= b.hash AND bit_count(xor(a.hash, b.hash)) <= 3
      WHERE len(list_distinct(list_concat(a.s, b.s))) > 1""",
}
