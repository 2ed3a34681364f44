"""Registered queries over detections, labels and ordered folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrack.functions.geometry import FRAME, TRACK
from loomtrack.operators import folds, interactions
from loomtrack.plans.frames import COUNTS, FR, IOU, KEYS, OVERLAP
from loomtrack.sources import fixtures as fx
from loomtrack.sources import labels


def _obs(spark, sf):
    return fx.view(spark, sf, "track_obs")


def _nested(spark, sf):
    box = F.struct("x1", "y1", "x2", "y2").alias("bbox")
    one = F.struct(F.col("local_track_id").alias("track_id"), "class_name", "confidence", box, F.lit(None).cast("array<struct<x:double,y:double>>").alias("mask"))
    return _obs(spark, sf).groupBy(*FRAME, "timestamp_global").agg(F.array_sort(F.collect_list(one)).alias("observations"))


def io2_explode_detections(spark, sf):
    return labels.explode_detections(_nested(spark, sf)).select(*FRAME, F.col("obs_index").cast("long").alias("obs_index"), "track_id", "x1")


def io3_flatten(spark, sf):
    rows = _obs(spark, sf).select(*FRAME, "local_track_id", F.struct("x1", "y1").alias("low"), F.struct(F.struct("x2").alias("x"), "y2").alias("high"))
    return labels.flatten(rows).withColumnsRenamed({"low.x1": "low_x1", "low.y1": "low_y1", "high.x.x2": "high_x2", "high.y2": "high_y2"})


def ag12_observation_summary(spark, sf):
    return labels.observation_summary(_nested(spark, sf))


def _lines(obs):
    parts = labels.parse_yolo_labels(labels.yolo_label_lines(obs, ["parcel", "person"]))
    return parts.select(*TRACK, "frame_index", "class_id", *(F.round(F.get("numbers", F.lit(k)) * size).cast("long").alias(f"v{k}") for k, size in enumerate((1280, 720, 640, 360))))


def io7_yolo_label_lines(spark, sf):
    return _lines(_obs(spark, sf))


def io8_parse_yolo_labels(spark, sf):
    broken = F.when(F.col("local_track_id") % 5 == 0, "x 0.5").when(F.col("local_track_id") % 5 == 1, F.concat_ws(" ", F.lit("1"), F.col("x1"), F.lit("abc"))).otherwise(F.concat_ws(" ", F.lit("0"), F.col("x1"), F.col("y1")))
    return labels.parse_yolo_labels(_obs(spark, sf).withColumn("line", broken)).select(*TRACK, "frame_index", "class_id", F.size("numbers").cast("long").alias("n"), F.get("numbers", F.lit(0)).alias("v0"), F.get("numbers", F.lit(1)).alias("v1"))


def dq11_validate_labels(spark, sf):
    line = F.when(F.col("local_track_id") % 6 == 0, "0 .5 .5 -.2 .2").when(F.col("local_track_id") % 6 == 1, "0 .1 .1 .2 .2 .3 .3").when(F.col("local_track_id") % 6 == 2, "9 .5 .5 .1 .1").when(F.col("local_track_id") % 6 == 3, "1 .5 .5 x .1").when(F.col("local_track_id") % 6 == 4, "0 .5 .5 .1").otherwise("0 .5 .5 .1 .1")
    return labels.validate_labels(labels.parse_yolo_labels(_obs(spark, sf).withColumn("line", line)), 2).groupBy("session_id", F.array_join("errors", ",").alias("errors")).agg(F.count("*").alias("n"))


def wrists_of(obs):
    none = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("v"))
    left = F.struct((F.col("x1") + 4).alias("x"), (F.col("y1") + 5).alias("y"), F.when(F.col("frame_index") % 3 > 0, 0.9).otherwise(0.0).alias("v"))
    right = F.struct((F.col("x2") / 640).alias("x"), (F.col("y2") / 360).alias("y"), F.when(F.col("frame_index") % 4 > 0, 0.9).otherwise(0.0).alias("v"))
    return interactions.person_wrists(obs.where("class_name = 'person'").withColumn("keypoints", F.array(*[none] * 9, left, right)))


def pf12_person_wrists(spark, sf):
    return wrists_of(_obs(spark, sf)).withColumns({"wx": F.round("wx", 6), "wy": F.round("wy", 6)})


def jn2_parcel_person_pairs(spark, sf):
    obs = _obs(spark, sf)
    out = interactions.parcel_person_pairs(obs.where("class_name = 'parcel'"), obs.where("class_name = 'person'"), wrists_of(obs), 734.3)
    return out.withColumn("distance", F.round("distance", 6))


def jn11_temporal_matches(spark, sf):
    return interactions.temporal_matches(_obs(spark, sf))


def dq8_quality_gate(spark, sf):
    signals = interactions.frame_quality(_obs(spark, sf))
    fixed = {"tracker_consistency": F.lit(0.9), "plausible_ratio": F.lit(1.0), "truncated_ratio": F.lit(0.0), "pose_errors": F.when(F.col("frame_index") % 50 == 0, 1)}
    return interactions.quality_gate(signals.withColumns(fixed)).select(*FRAME, "verdict")


def st1_greedy_iou_tracks(spark, sf):
    return folds.greedy_iou_tracks(_obs(spark, sf).withColumn("obs_index", F.col("local_track_id").cast("int")))


def st10_segment_frames(spark, sf):
    return folds.segment_frames(_obs(spark, sf).select(*FRAME, "timestamp_global").distinct(), 5.0)


def tk3_keyframes(spark, sf):
    views = _obs(spark, sf).select(*TRACK, "frame_index", F.least("confidence", F.lit(1.0)).alias("confidence"), F.lit(0.5).alias("area"), ((F.col("frame_index") % 10) / 10).alias("sharpness"), F.lit(0.4).alias("geometry"), F.lit(0.2).alias("zone"), F.lit(1.0).alias("integrity"))
    return folds.keyframes(views, list(TRACK))


QUERIES = {f.__name__: f for f in (
    io2_explode_detections, io3_flatten, io7_yolo_label_lines, io8_parse_yolo_labels, ag12_observation_summary, dq8_quality_gate, dq11_validate_labels, pf12_person_wrists, jn2_parcel_person_pairs, jn11_temporal_matches,
    st1_greedy_iou_tracks, st10_segment_frames, tk3_keyframes,
)}

_O = fx.oracle("track_obs")
_W = ", wrists AS (SELECT session_id, source_id, stream_epoch, frame_index, local_track_id AS person_id, 'left' AS side, x1 + 4 AS wx, y1 + 5 AS wy FROM track_obs WHERE class_name = 'person' AND frame_index % 3 > 0 UNION ALL SELECT session_id, source_id, stream_epoch, frame_index, local_track_id, 'right', x2 / 640 * 640, y2 / 360 * 360 FROM track_obs WHERE class_name = 'person' AND frame_index % 4 > 0)"
_N = f", numbered AS (SELECT *, dense_rank() OVER (PARTITION BY session_id, source_id, stream_epoch ORDER BY frame_index) AS n FROM track_obs), hits AS (SELECT DISTINCT a.session_id, a.source_id, a.stream_epoch, a.frame_index, a.local_track_id FROM numbered a JOIN numbered b ON a.session_id = b.session_id AND a.source_id = b.source_id AND a.stream_epoch = b.stream_epoch AND a.n = b.n + 1 AND a.class_name = b.class_name AND {IOU} >= 0.2), tm AS (SELECT {FR}, count(hits.local_track_id) AS matched, count(*) AS total FROM track_obs LEFT JOIN hits USING ({FR}, local_track_id) GROUP BY ALL)"

ORACLES = {
    "io2_explode_detections": f"{_O} SELECT {FR}, row_number() OVER (PARTITION BY {FR} ORDER BY local_track_id) - 1 AS obs_index, local_track_id AS track_id, x1 FROM track_obs",
    "io3_flatten": f"{_O} SELECT {FR}, local_track_id, x1 AS low_x1, y1 AS low_y1, x2 AS high_x2, y2 AS high_y2 FROM track_obs",
    "ag12_observation_summary": f"{_O} SELECT session_id, count(DISTINCT (source_id, stream_epoch, frame_index)) AS frames, count(*) AS observations FROM track_obs GROUP BY ALL",
    "io7_yolo_label_lines": f"{_O} SELECT {KEYS}, frame_index, CASE class_name WHEN 'parcel' THEN 0 ELSE 1 END AS class_id, CAST(x1 + x2 AS BIGINT) AS v0, CAST(y1 + y2 AS BIGINT) AS v1, CAST(x2 - x1 AS BIGINT) AS v2, CAST(y2 - y1 AS BIGINT) AS v3 FROM track_obs",
    "io8_parse_yolo_labels": f"{_O} SELECT {KEYS}, frame_index, CASE local_track_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 1 ELSE 0 END::INTEGER AS class_id, CASE local_track_id % 5 WHEN 0 THEN 1 ELSE 2 END::BIGINT AS n, CASE local_track_id % 5 WHEN 0 THEN 0.5e0 ELSE x1 END AS v0, CASE WHEN local_track_id % 5 > 1 THEN y1 END AS v1 FROM track_obs",
    "dq11_validate_labels": f"{_O} SELECT session_id, ['RANGE,BOX', 'AREA', 'CLASS', 'NUMBER', 'COUNT', ''][local_track_id % 6 + 1] AS errors, count(*) AS n FROM track_obs GROUP BY ALL",
    "pf12_person_wrists": f"{_O}{_W} SELECT * REPLACE (round(wx, 6) AS wx, round(wy, 6) AS wy) FROM wrists",
    "jn2_parcel_person_pairs": f"""{_O}{_W}, p AS (SELECT {", ".join("a." + c for c in FRAME)}, a.local_track_id AS parcel_id, b.local_track_id AS person_id, {IOU} > 0 AS overlap,
      coalesce((SELECT min(sqrt(pow(greatest(a.x1 - wx, 0, wx - a.x2), 2) + pow(greatest(a.y1 - wy, 0, wy - a.y2), 2))) FROM wrists w WHERE w.session_id = a.session_id AND w.source_id = a.source_id AND w.stream_epoch = a.stream_epoch AND w.frame_index = a.frame_index AND w.person_id = b.local_track_id) / 734.3, 10) AS d
      FROM track_obs a JOIN track_obs b USING ({FR}) WHERE a.class_name = 'parcel' AND b.class_name = 'person') SELECT {FR}, parcel_id, person_id, round(d, 6) AS distance, overlap, d <= 0.28 OR overlap AS near FROM p""",
    "jn11_temporal_matches": f"{_O}{_N} SELECT * FROM tm",
    "dq8_quality_gate": f"""{_O}{COUNTS}{OVERLAP}{_N}, e AS (SELECT {FR}, avg(confidence) AS mc, min(confidence) AS lc, min((x2 - x1) * (y2 - y1) / (640 * 360)) AS la, max((x2 - x1) * (y2 - y1) / (640 * 360)) AS ma FROM track_obs GROUP BY ALL)
      SELECT {FR}, CASE WHEN la < 0.0002 OR ma > 0.9 OR frame_index % 50 = 0 THEN 'REJECTED' WHEN mc < 0.65 OR lc < 0.35 OR matched / total < 0.55 OR count_change > 1 OR max_overlap > 0.8 THEN 'NEEDS_REVIEW' ELSE 'AUTO_ACCEPTED' END AS verdict FROM e JOIN counts USING ({FR}) JOIN overlap USING ({FR}) JOIN tm USING ({FR})""",
}
