"""Registered queries over dataset items."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrack.operators import datasets as ops
from loomtrack.sources import fixtures as fx


def _items(spark, sf):
    """Items with split and hash; every tenth has a copy whose hash differs in 1 to 4 bits (by its id)."""
    hashed = fx.vectors(spark, sf).select("vec_id", ops.mean_threshold_hash("embedding").alias("hash"))
    items = fx.view(spark, sf, "items").join(hashed, "vec_id", "left").withColumn("split", ops.stable_split())
    flips = F.expr("shiftleft(1L, cast(pmod(item_id, 4) AS int) + 1) - 1")
    copies = items.where("item_id % 10 = 0").select(*(c for c in items.columns if c not in ("item_id", "hash", "split")), (F.col("item_id") + 1_000_000_000_000).alias("item_id"), F.col("hash").bitwiseXOR(flips).alias("hash"), F.when(F.col("item_id") % 20 == 0, F.col("split")).otherwise(F.lit("train")).alias("split"))
    return items.unionByName(copies)


def sc1_mean_threshold_hash(spark, sf):
    return fx.vectors(spark, sf).select("vec_id", ops.mean_threshold_hash("embedding").alias("hash"))


def sc2_stable_split(spark, sf):
    return fx.view(spark, sf, "items").groupBy("session_id", ops.stable_split().alias("split")).agg(F.count("*").alias("n"))


def jn10_near_duplicates(spark, sf):
    return ops.near_duplicates(_items(spark, sf))


def dq3_assign_splits(spark, sf):
    sessions = fx.view(spark, sf, "items").select("sample_group_id").distinct().withColumnRenamed("sample_group_id", "session_id")
    explicit = sessions.where("session_id LIKE '%:7'").withColumn("split", F.lit("val"))
    return ops.assign_splits(sessions, explicit)


def dq4_split_leaks(spark, sf):
    return ops.split_leaks(_items(spark, sf))


def dq5_frozen_test_digest(spark, sf):
    return ops.frozen_test_digest(_items(spark, sf)).select("digest", "n")


def ag4_review_counts(spark, sf):
    return ops.review_counts(_items(spark, sf))


def ag5_split_counts(spark, sf):
    return ops.split_counts(_items(spark, sf))


def ag6_dataset_sessions_rollup(spark, sf):
    return ops.dataset_sessions_rollup(_items(spark, sf))


def io12_training_manifest(spark, sf):
    return ops.training_manifest(_items(spark, sf).withColumn("label", F.when(F.col("item_id") % 3 > 0, F.concat_ws(" ", F.lit("0"), F.col("vec_id")))))


def _observed(spark, sf):
    o = lambda k, cls: F.struct(F.lit(cls).alias("class_name"), F.when((F.col("item_id") + k) % 3 > 0, F.col("item_id") % 17 + k).alias("track_id"), F.when((F.col("item_id") + k) % 4 > 0, F.col("vec_id") % 50 + k).alias("global_id"), (F.col("item_id") % 700 - 30.0).alias("x1"), F.lit(10.0).alias("y1"), (F.col("item_id") % 700 + 10.0).alias("x2"), F.lit(400.0).alias("y2"))
    return _items(spark, sf).withColumn("observations", F.array(o(0, "parcel"), o(1, "parcel"), o(2, "person")))


def io13_tracking_manifest(spark, sf):
    return ops.tracking_manifest(_observed(spark, sf))


def io14_reid_manifest(spark, sf):
    return ops.reid_manifest(_observed(spark, sf))


def io14_reid_status(spark, sf):
    return ops.reid_status(_observed(spark, sf))


def jn12_reid_pairs(spark, sf):
    """All items; a parcel is seen about 24 times at every size."""
    parcels = F.greatest(F.floor(F.lit(fx.vectors(spark, sf).count()) / 24), F.lit(1))
    return ops.reid_pairs(_items(spark, sf).select("session_id", "split", "item_id", (F.col("vec_id") % parcels).alias("global_id"), "camera_role"))


def jn13_referential_gaps(spark, sf):
    return ops.referential_gaps(_items(spark, sf), spark.createDataFrame([(f"src{k}",) for k in range(0, 40, 2)], "session_id string"))


def jn14_manifest_diff(spark, sf):
    items = fx.view(spark, sf, "items").select("item_id", "annotation_status")
    kept = items.where("item_id % 13 <> 0").withColumn("annotation_status", F.when(F.col("item_id") % 17 == 0, "CHANGED").otherwise(F.col("annotation_status")))
    extra = items.where("item_id % 19 = 0").withColumn("item_id", -F.col("item_id") - 1)
    return ops.manifest_diff(kept.unionByName(extra).unionByName(kept.where("item_id % 23 = 0")), items, ["annotation_status"])


def so2_id_set_diff(spark, sf):
    ids = fx.view(spark, sf, "items").select("item_id")
    return ops.id_set_diff(ids.where("item_id % 5 <> 0"), ids.where("item_id % 7 <> 0"))


def so3_required_splits(spark, sf):
    items = _items(spark, sf)
    return ops.required_splits(items.select("session_id").distinct().withColumn("is_real", F.col("session_id") == "src3"), items)


def st9_greedy_dedup(spark, sf):
    items = _items(spark, sf).withColumns({"session_order": F.col("session_id"), "group_order": F.expr("cast(split(sample_group_id, ':')[1] AS bigint)")})
    items = items.withColumn("sample_group_id", F.when(F.col("item_id") >= 1_000_000_000_000, F.concat("sample_group_id", F.lit("c"))).otherwise(F.col("sample_group_id")))
    return ops.greedy_dedup(items)


def dq14_finalize_dataset(spark, sf):
    return ops.finalize_dataset(_items(spark, sf))


def so1_merge_catalogue_sources(spark, sf):
    items = fx.view(spark, sf, "items")
    catalogue = items.where("item_id % 3 <> 1").select("item_id", F.lit("catalogue").alias("origin"), "vec_id")
    sidecar = items.where("item_id % 3 <> 0").select("item_id", F.lit("sidecar").alias("origin"), (F.col("vec_id") + 1).alias("vec_id"))
    return ops.merge_sources(catalogue, sidecar)


QUERIES = {f.__name__: f for f in (
    sc1_mean_threshold_hash, sc2_stable_split, jn10_near_duplicates, jn12_reid_pairs, jn13_referential_gaps, jn14_manifest_diff, dq3_assign_splits, dq4_split_leaks, dq5_frozen_test_digest, dq14_finalize_dataset,
    ag4_review_counts, ag5_split_counts, ag6_dataset_sessions_rollup, io12_training_manifest, io13_tracking_manifest, io14_reid_manifest, io14_reid_status, so1_merge_catalogue_sources, so2_id_set_diff, so3_required_splits, st9_greedy_dedup,
)}

_HASH = """hashed AS (SELECT vec_id, CASE WHEN len(embedding) = 64 THEN CAST(list_sum([CASE WHEN embedding[i]::DOUBLE > list_avg(embedding::DOUBLE[]) THEN (CASE WHEN i = 1 THEN -9223372036854775808 ELSE CAST(1 AS HUGEINT) << (64 - i) END)::HUGEINT ELSE 0::HUGEINT END FOR i IN range(1, 65)]) AS BIGINT) END AS hash FROM embeddings)"""
_SPLIT = "CASE WHEN CAST('0x' || substring(sha256(session_id), 1, 8) AS BIGINT) % 10 < 7 THEN 'train' WHEN CAST('0x' || substring(sha256(session_id), 1, 8) AS BIGINT) % 10 < 9 THEN 'val' ELSE 'test' END"
_I = f"""{fx.oracle('items')}, {_HASH}, base AS (SELECT items.*, hash, {_SPLIT} AS split FROM items LEFT JOIN hashed USING (vec_id)),
  full_items AS (SELECT * FROM base UNION ALL SELECT * REPLACE (item_id + 1000000000000 AS item_id, xor(hash, (1 << (item_id % 4 + 1)::INTEGER)::BIGINT - 1) AS hash, CASE WHEN item_id % 20 = 0 THEN split ELSE 'train' END AS split) FROM base WHERE item_id % 10 = 0)"""
_NEAR = "SELECT least(a.item_id, b.item_id) AS left_id, greatest(a.item_id, b.item_id) AS right_id, bit_count(xor(a.hash, b.hash))::INTEGER AS distance FROM full_items a JOIN full_items b ON a.item_id < b.item_id AND a.split <> b.split AND bit_count(xor(a.hash, b.hash)) <= 3"
_OBS = ", o AS (SELECT f.*, k, CASE WHEN k = 2 THEN 'person' ELSE 'parcel' END AS class_name, CASE WHEN (item_id + k) % 3 > 0 THEN item_id % 17 + k END AS track_id, CASE WHEN (item_id + k) % 4 > 0 THEN vec_id % 50 + k END AS global_id FROM full_items f, range(0, 3) r(k))"

ORACLES = {
    "sc1_mean_threshold_hash": f"WITH {_HASH} SELECT vec_id, hash FROM hashed",
    "sc2_stable_split": f"{fx.oracle('items')} SELECT session_id, {_SPLIT} AS split, count(*) AS n FROM items GROUP BY ALL",
    "jn10_near_duplicates": f"{_I} {_NEAR}",
    "dq4_split_leaks": f"""{_I} SELECT 'session' AS kind, session_id AS key FROM full_items GROUP BY session_id HAVING count(DISTINCT split) > 1 UNION ALL SELECT 'group', sample_group_id FROM full_items GROUP BY sample_group_id HAVING count(DISTINCT split) > 1
      UNION ALL SELECT 'image', image_sha256 FROM full_items GROUP BY image_sha256 HAVING count(DISTINCT split) > 1 UNION ALL SELECT 'near_duplicate', concat_ws('|', left_id, right_id) FROM ({_NEAR}) UNION ALL SELECT 'bad_hash', CAST(item_id AS VARCHAR) FROM full_items WHERE hash IS NULL""",
    "dq5_frozen_test_digest": f"""{_I} SELECT sha256('[' || coalesce(string_agg('["' || session_id || '","' || sample_group_id || '","' || camera_role || '",' || frame_index || ']', ',' ORDER BY session_id, sample_group_id, camera_role, frame_index), '') || ']') AS digest, count(*) AS n FROM full_items WHERE split = 'test'""",
    "ag4_review_counts": f"{_I} SELECT session_id, count(*) FILTER (annotation_status = 'AUTO_ACCEPTED') AS accepted, count(*) FILTER (annotation_status = 'REJECTED') AS rejected, count(*) FILTER (annotation_status = 'NEEDS_REVIEW') AS pending, count(*) FILTER (annotation_status = 'AUTO_ACCEPTED') AS trainable FROM full_items GROUP BY ALL",
    "ag5_split_counts": f"{_I} SELECT *, train > 0 AND val > 0 AND test > 0 AS all_filled FROM (SELECT count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test FROM full_items)",
    "ag6_dataset_sessions_rollup": f"{_I} SELECT session_id, count(DISTINCT camera_role) AS cameras, string_agg(DISTINCT camera_role, ',' ORDER BY camera_role) AS roles FROM full_items GROUP BY ALL",
    "io12_training_manifest": f"{_I} SELECT item_id, session_id, sample_group_id, camera_role, split, image_sha256, '0 ' || vec_id AS label FROM full_items WHERE annotation_status IN ('AUTO_ACCEPTED', 'HUMAN_VALIDATED') AND item_id % 3 > 0",
    "io13_tracking_manifest": f"{_I}{_OBS} SELECT item_id, session_id, camera_role, track_id, concat_ws(':', session_id, camera_role, track_id) AS identity FROM o WHERE track_id IS NOT NULL",
    "io14_reid_manifest": f"{_I}{_OBS} SELECT * FROM (SELECT item_id, session_id, camera_role, split, global_id, least(greatest(item_id % 700 - 30.0e0, 0), 640) AS x1, 10.0e0 AS y1, least(greatest(item_id % 700 + 10.0e0, 0), 640) AS x2, 360.0e0 AS y2 FROM o WHERE class_name = 'parcel' AND global_id IS NOT NULL) WHERE x2 > x1",
    "io14_reid_status": f"{_I}{_OBS} SELECT session_id, count(global_id) AS crops, count(*) FILTER (global_id IS NULL) AS missing, CASE WHEN count(global_id) = 0 THEN 'NOT_READY' WHEN count(*) FILTER (global_id IS NULL) > 0 THEN 'NEEDS_REVIEW' ELSE 'READY' END AS status FROM o WHERE class_name = 'parcel' GROUP BY ALL",
    "jn12_reid_pairs": f"""{_I}, n AS (SELECT greatest(count(*) // 24, 1) AS parcels FROM embeddings), r AS (SELECT item_id, session_id, split, camera_role, vec_id % parcels AS parcel FROM full_items, n),
      o AS (SELECT *, list(struct_pack(i := item_id, p := parcel)) OVER (PARTITION BY session_id, split ORDER BY sha256(CAST(item_id AS VARCHAR)), item_id ROWS BETWEEN 1 FOLLOWING AND {ops.LOOK} FOLLOWING) AS near FROM r)
      SELECT a.item_id AS left_id, b.item_id AS right_id, 'POSITIVE' AS label FROM r a JOIN r b ON a.session_id = b.session_id AND a.split = b.split AND a.parcel = b.parcel WHERE a.item_id < b.item_id AND a.camera_role <> b.camera_role
      UNION ALL SELECT least(item_id, x.i), greatest(item_id, x.i), 'NEGATIVE' FROM (SELECT item_id, unnest([x for x in near if x.p <> parcel][:{ops.NEGATIVES}]) AS x FROM o)""",
    "jn13_referential_gaps": f"{_I} SELECT session_id, count(*) AS n FROM full_items WHERE session_id NOT IN (SELECT 'src' || CAST(k AS VARCHAR) FROM range(0, 40, 2) r(k)) GROUP BY ALL",
    "jn14_manifest_diff": f"""{fx.oracle('items')}, kept AS (SELECT item_id, CASE WHEN item_id % 17 = 0 THEN 'CHANGED' ELSE annotation_status END AS s FROM items WHERE item_id % 13 <> 0), m AS (SELECT item_id, count(*) AS n, min(s) AS s FROM (SELECT * FROM kept UNION ALL SELECT -item_id - 1, annotation_status FROM items WHERE item_id % 19 = 0 UNION ALL SELECT * FROM kept WHERE item_id % 23 = 0) GROUP BY ALL)
      SELECT * FROM (SELECT coalesce(m.item_id, i.item_id) AS item_id, CASE WHEN m.item_id IS NULL THEN 'missing' WHEN i.item_id IS NULL THEN 'unexpected' WHEN n > 1 THEN 'duplicated' WHEN s IS DISTINCT FROM annotation_status THEN 'differs' END AS problem FROM m FULL JOIN items i ON i.item_id = m.item_id) WHERE problem IS NOT NULL""",
    "so2_id_set_diff": "SELECT doc_id AS item_id, 'expected_only' AS side FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 = 0 UNION ALL SELECT doc_id, 'actual_only' FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 5 = 0",
    "so3_required_splits": f"{_I} SELECT DISTINCT split FROM (SELECT split FROM full_items UNION ALL SELECT s FROM (VALUES ('train'), ('val'), ('test')) v(s) WHERE EXISTS (SELECT 1 FROM full_items WHERE session_id = 'src3'))",
    "dq14_finalize_dataset": f"{_I} SELECT count(*) FILTER (annotation_status = 'NEEDS_REVIEW') AS pending, count(*) FILTER (annotation_status = 'AUTO_ACCEPTED') AS trainable, count(*) FILTER (annotation_status = 'NEEDS_REVIEW') = 0 AND count(*) FILTER (annotation_status = 'AUTO_ACCEPTED') > 0 AND count(DISTINCT split) = 3 AS ready FROM full_items",
    "so1_merge_catalogue_sources": f"{fx.oracle('items')} SELECT item_id, CASE WHEN item_id % 3 <> 1 THEN 'catalogue' ELSE 'sidecar' END AS origin, CASE WHEN item_id % 3 <> 1 THEN vec_id ELSE vec_id + 1 END AS vec_id FROM items",
}
