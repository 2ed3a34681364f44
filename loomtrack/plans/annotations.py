"""Registered queries of automatic labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrack.functions.geometry import FRAME
from loomtrack.operators import annotations as ops
from loomtrack.plans.frames import FR, IOU
from loomtrack.sources import fixtures as fx


def _items(spark, sf):
    """A frame is an item of its source; a model finds most of its objects, some items are settled."""
    obs = fx.view(spark, sf, "track_obs")
    k = F.col("frame_index") + F.col("local_track_id")
    one = F.struct("class_name", "confidence", "x1", "y1", "x2", "y2", F.when(k % 3 > 0, F.col("local_track_id")).alias("local_track_id"), F.when(k % 3 == 0, k % 2 == 0).alias("tracker_consistent"), F.when(k % 7 > 0, 0.7 + 0.1 * (k % 3)).alias("model_agreement"), F.lit(None).cast("array<struct<x:double,y:double>>").alias("mask"), F.lit(None).cast("array<struct<x:double,y:double,v:double>>").alias("keypoints"))
    frames = obs.groupBy(*FRAME).agg(F.max("timestamp_global").alias("timestamp_global"), F.array_sort(F.collect_list(F.when(k % 11 > 0, one))).alias("detections"), F.collect_list(F.when(F.col("frame_index") % 4 > 0, F.when(k % 13 == 0, "forklift").otherwise(F.col("class_name")))).alias("expected"), F.count("*").alias("instance_count"))
    named = frames.withColumns({"item_id": F.concat_ws("/", *FRAME), "source_id": F.concat_ws("/", "session_id", "source_id")})
    return named.withColumns({"annotation_status": F.when(F.col("frame_index") % 6 == 0, "AUTO_ACCEPTED").otherwise("NEEDS_REVIEW"), "label": F.when(F.col("frame_index") % 12 == 0, "old")})


def dq9_annotate_items(spark, sf):
    out = ops.annotate_items(_items(spark, sf), ["parcel", "person"])
    return out.select("item_id", "skipped", "label_count", "expected_count", "status", *(F.round(c, 6).alias(c) for c in ("mean_conf", "max_overlap", "temporal_stability", "tracker_consistency", "model_agreement", "truncated_ratio")))


QUERIES = {"dq9_annotate_items": dq9_annotate_items}

_J = " AND ".join(f"a.{c} = b.{c}" for c in FRAME)
ORACLES = {
    "dq9_annotate_items": f"""{fx.oracle("track_obs")}, o AS (SELECT *, frame_index + local_track_id AS k FROM track_obs),
      f AS (SELECT {FR}, concat_ws('/', {FR}) AS item_id, max(timestamp_global) AS t, frame_index % 12 = 0 AS skipped, CASE WHEN frame_index % 4 > 0 THEN count(*) FILTER (k % 13 <> 0) ELSE count(*) END AS expected FROM o GROUP BY {FR}),
      q AS (SELECT *, row_number() OVER (PARTITION BY session_id, source_id ORDER BY t, item_id) AS n FROM f WHERE NOT skipped),
      d AS (SELECT o.*, n FROM o JOIN q USING ({FR}) WHERE k % 11 > 0),
      s AS (SELECT {FR}, count(*) AS n_det, round(avg(confidence), 9) AS conf, min(confidence) AS least, round(avg(CASE WHEN k % 3 > 0 OR k % 2 = 0 THEN 1.0e0 ELSE 0 END), 9) AS steady, round(avg(CASE WHEN k % 7 > 0 THEN 0.7e0 + 0.1e0 * (k % 3) END), 9) AS agree,
        avg(CASE WHEN x1 <= 1 OR y1 <= 1 OR x2 >= 639 OR y2 >= 359 THEN 1.0e0 ELSE 0 END) AS cut, bool_or((x2 - x1) * (y2 - y1) / 230400 NOT BETWEEN 0.0002e0 AND 0.9e0) AS odd FROM d GROUP BY {FR}),
      m AS (SELECT {", ".join("a." + c for c in FRAME)}, max({IOU}) AS overlap FROM d a JOIN d b ON {_J} AND a.local_track_id < b.local_track_id GROUP BY ALL),
      h AS (SELECT session_id, source_id, n, count(*) AS hits FROM (SELECT DISTINCT a.session_id, a.source_id, a.n, a.local_track_id FROM d a JOIN d b ON a.session_id = b.session_id AND a.source_id = b.source_id AND a.n = b.n + 1 AND a.class_name = b.class_name AND {IOU} >= 0.2) GROUP BY ALL),
      j AS (SELECT q.*, coalesce(n_det, 0) AS n_det, coalesce(conf, 0) AS conf, coalesce(least, 0) AS least, steady, agree, coalesce(cut, 0) AS cut, coalesce(odd, false) AS odd, coalesce(overlap, 0) AS overlap, coalesce(hits, 0) AS hits,
        coalesce(lag(n_det) OVER (PARTITION BY q.session_id, q.source_id ORDER BY q.n), 0) AS before FROM q LEFT JOIN s USING ({FR}) LEFT JOIN m USING ({FR}) LEFT JOIN h ON h.session_id = q.session_id AND h.source_id = q.source_id AND h.n = q.n),
      g AS (SELECT *, CASE WHEN before > 0 THEN hits / greatest(n_det, before)::DOUBLE ELSE 1 END AS stable, CASE WHEN before > 0 THEN abs(n_det - before) ELSE 0 END AS moved FROM j)
      SELECT item_id, false AS skipped, n_det::INTEGER AS label_count, expected::INTEGER AS expected_count, CASE WHEN odd THEN 'REJECTED' WHEN n_det < expected OR n_det = 0 OR conf < 0.65 OR least < 0.35 OR stable < 0.55 OR coalesce(steady, 0) < 0.75 OR coalesce(agree, 0) < 0.75 OR moved > 1 OR overlap > 0.8 OR cut > 0.5 THEN 'NEEDS_REVIEW' ELSE 'AUTO_ACCEPTED' END AS status,
        round(conf, 6) AS mean_conf, round(overlap, 6) AS max_overlap, round(stable, 6) AS temporal_stability, round(steady, 6) AS tracker_consistency, round(agree, 6) AS model_agreement, round(cut, 6) AS truncated_ratio FROM g
      UNION ALL SELECT item_id, true, NULL, NULL, CASE WHEN frame_index % 6 = 0 THEN 'AUTO_ACCEPTED' END, NULL, NULL, NULL, NULL, NULL, NULL FROM f WHERE skipped""",
}
