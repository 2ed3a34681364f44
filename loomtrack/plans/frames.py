"""Registered queries over track observations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomtrack.functions.geometry import FRAME, TRACK
from loomtrack.operators import frames as ops
from loomtrack.sources import fixtures as fx

KEYS = "session_id, source_id, stream_epoch, local_track_id"
FR = "session_id, source_id, stream_epoch, frame_index"


def _obs(spark, sf):
    return fx.view(spark, sf, "track_obs")


def pf2_tag_zones(spark, sf):
    return ops.tag_zones(_obs(spark, sf), fx.zones(spark)).select(*TRACK, "frame_index", "zone_id")


def pf3_zone_kind(spark, sf):
    tagged = ops.zone_kind(ops.tag_zones(_obs(spark, sf), fx.zones(spark)), fx.zones(spark))
    return tagged.groupBy("session_id", "camera_role", "zone_kind").agg(F.count("*").alias("n"))


SCALED = """, scaled AS (SELECT position, camera_role AS zrole, zone_id, kind,
  CASE WHEN greatest(x1, y1, x2, y2) <= 1.5 THEN x1 * 640 ELSE x1 END AS zx1, CASE WHEN greatest(x1, y1, x2, y2) <= 1.5 THEN y1 * 360 ELSE y1 END AS zy1,
  CASE WHEN greatest(x1, y1, x2, y2) <= 1.5 THEN x2 * 640 ELSE x2 END AS zx2, CASE WHEN greatest(x1, y1, x2, y2) <= 1.5 THEN y2 * 360 ELSE y2 END AS zy2 FROM zones),
tagged AS (SELECT o.*, (SELECT arg_min(zone_id, position) FROM scaled z WHERE z.zrole = o.camera_role AND (o.x1 + o.x2) / 2 BETWEEN zx1 AND zx2 AND (o.y1 + o.y2) / 2 BETWEEN zy1 AND zy2) AS zone_id FROM track_obs o)"""

MOVING = """, moving AS (SELECT *,
  coalesce(((x1 + x2) / 2 - lag((x1 + x2) / 2) OVER w) / greatest(timestamp_global - lag(timestamp_global) OVER w, 0.001), 0) AS vx,
  coalesce(((y1 + y2) / 2 - lag((y1 + y2) / 2) OVER w) / greatest(timestamp_global - lag(timestamp_global) OVER w, 0.001), 0) AS vy
  FROM {0} WINDOW w AS (PARTITION BY session_id, source_id, stream_epoch, local_track_id ORDER BY frame_index))"""

IOU = """(greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)))
  / (greatest(1, (a.x2 - a.x1) * (a.y2 - a.y1)) + greatest(1, (b.x2 - b.x1) * (b.y2 - b.y1)) - (greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))) + 1e-6)"""

OVERLAP = f""", overlap AS (SELECT f.*, coalesce(m, 0) AS max_overlap FROM (SELECT DISTINCT {FR} FROM track_obs) f LEFT JOIN (
  SELECT {", ".join("a." + c for c in FRAME)}, max({IOU}) AS m FROM track_obs a JOIN track_obs b USING ({FR}) WHERE a.local_track_id < b.local_track_id GROUP BY ALL) USING ({FR}))"""

COUNTS = f""", counts AS (SELECT *, coalesce(abs(n_instances - lag(n_instances) OVER w), 0) AS count_change, (row_number() OVER w - 1) % 12 = 0 AS is_control
  FROM (SELECT {FR}, max(timestamp_global) AS timestamp_global, count(*) AS n_instances FROM track_obs GROUP BY ALL)
  WINDOW w AS (PARTITION BY session_id, source_id ORDER BY stream_epoch, frame_index))"""

FLAGGED = f""", flagged AS (SELECT *, local_track_id % 7 = 0 AND frame_index % 40 = 0 AS is_ambiguous,
  frame_index = min(frame_index) OVER t OR frame_index = max(frame_index) OVER t AS is_endpoint FROM track_obs WINDOW t AS (PARTITION BY {KEYS}))"""

SIGNALS = f"""{COUNTS}{OVERLAP}{FLAGGED}, signals AS (SELECT {FR}, timestamp_global,
  CASE WHEN ambiguous THEN 'ambiguous_identity' WHEN least_c < 0.65 THEN 'low_confidence' WHEN max_overlap > 0.55 THEN 'high_overlap' WHEN count_change > 0 THEN 'count_change' WHEN endpoint THEN 'endpoint' WHEN is_control THEN 'control' END AS reason,
  CASE WHEN ambiguous THEN 1.0e0 WHEN least_c < 0.65 THEN 1 - least_c WHEN max_overlap > 0.55 THEN max_overlap WHEN count_change > 0 THEN least(1.0e0, 0.5e0 + 0.1e0 * count_change) WHEN endpoint THEN 0.7e0 WHEN is_control THEN 0.2e0 END AS score
  FROM counts JOIN overlap USING ({FR}) JOIN (SELECT {FR}, bool_or(is_ambiguous) AS ambiguous, min(confidence) AS least_c, bool_or(is_endpoint) AS endpoint FROM flagged GROUP BY ALL) USING ({FR}))"""


def pf9_filter_by_pipeline(spark, sf):
    dets = _obs(spark, sf).withColumn("is_pose", (F.col("camera_role") != "C2") & (F.col("frame_index") % 100 == 0))
    return ops.filter_by_pipeline(dets, ["C1", "C2"], ["C3"]).groupBy("session_id", "source_id", "class_name").agg(F.count("*").alias("n"))


def jn3_frame_overlap(spark, sf):
    return ops.frame_overlap(_obs(spark, sf)).withColumn("max_overlap", F.round("max_overlap", 9))


def wn1_track_velocity(spark, sf):
    return ops.track_velocity(_obs(spark, sf)).select(*TRACK, "frame_index", F.round("vx", 6).alias("vx"), F.round("vy", 6).alias("vy"))


def wn2_frame_counts(spark, sf):
    return ops.frame_counts(_obs(spark, sf)).select(*FRAME, "n_instances", "count_change")


def wn3_control_stride(spark, sf):
    return ops.frame_counts(_obs(spark, sf)).where("is_control").select(*FRAME)


def wn4_person_motion(spark, sf):
    return ops.person_motion(_obs(spark, sf).where("class_name = 'person'")).select(*TRACK, "frame_index", F.round("vx", 6).alias("vx"), F.round("vy", 6).alias("vy"))


def wn5_contact_islands(spark, sf):
    pairs = _obs(spark, sf).withColumn("in_contact", (F.floor(F.col("x1") / 100) % 2) == 0)
    return ops.contact_islands(pairs, list(TRACK)).select(*TRACK, "frame_index", "in_contact", "since", "duration")


def wn6_sustained_since(spark, sf):
    rows = _obs(spark, sf).withColumn("visible", F.col("confidence") >= 0.7)
    return ops.sustained_since(rows, list(TRACK), "timestamp_global", "visible").select(*TRACK, "frame_index", "since")


def wn7_robust_motion(spark, sf):
    return ops.robust_motion(_obs(spark, sf)).select(*TRACK, "frame_index", *(F.round(c, 6).alias(c) for c in ("mvx", "mvy", "deviation_x")))


def wn8_occlusion_periods(spark, sf):
    return ops.occlusion_periods(_obs(spark, sf))


def wn9_relative_speed(spark, sf):
    return ops.relative_speed(ops.track_velocity(_obs(spark, sf))).select(*TRACK, "frame_index", F.round("relative_speed", 6).alias("relative_speed"))


def wn10_track_endpoints(spark, sf):
    return ops.track_endpoints(_obs(spark, sf)).select(*TRACK, "frame_index", "is_first", "is_last")


def ag1_tracklet_summary(spark, sf):
    out = ops.tracklet_summary(ops.track_velocity(ops.tag_zones(_obs(spark, sf), fx.zones(spark))))
    return out.withColumns({c: F.round(c, 6) for c in ("avg_w", "avg_h", "avg_vx", "avg_vy", "avg_speed")})


def _tracklets(obs):
    return obs.groupBy(*TRACK).agg(F.max("timestamp_global").alias("ended_at"), F.min("frame_index").alias("first_frame"), F.max("frame_index").alias("last_frame")).withColumns({"tracklet_id": F.concat_ws(":", *TRACK), "integrity_status": F.when(F.col("local_track_id") % 5 == 0, "AMBIGUOUS").otherwise("STABLE")})


def ag2_collect_frames(spark, sf):
    obs = _obs(spark, sf)
    return ops.collect_frames(obs, _tracklets(obs))


def _flagged(spark, sf):
    t = Window.partitionBy(*TRACK)
    return _obs(spark, sf).withColumns({"is_ambiguous": (F.col("local_track_id") % 7 == 0) & (F.col("frame_index") % 40 == 0), "is_endpoint": (F.col("frame_index") == F.min("frame_index").over(t)) | (F.col("frame_index") == F.max("frame_index").over(t))})


def dq1_frame_signals(spark, sf):
    return ops.frame_signals(_flagged(spark, sf)).withColumn("score", F.round("score", 9))


def jn6_nearest_frames(spark, sf):
    frames = _obs(spark, sf).select(*FRAME, "timestamp_global").distinct()
    anchors = frames.where("source_id = 'C1'").select("session_id", (F.col("timestamp_global") + 0.05).alias("anchor_time")).distinct()
    return ops.nearest_frames(anchors, frames).withColumn("gap", F.round("gap", 9))


def dq2_sample_groups(spark, sf):
    frames = _obs(spark, sf).select(*FRAME, "timestamp_global").distinct()
    return ops.sample_groups(ops.frame_signals(_flagged(spark, sf)), frames).withColumn("group_score", F.round("group_score", 9))


def _records(spark, sf):
    return _obs(spark, sf).select(*FRAME, F.col("local_track_id").alias("truth_id"), (F.col("local_track_id") * 1000 + F.floor(F.col("frame_index") / 50)).alias("given_id"))


def ag9_identity_metrics(spark, sf):
    return ops.identity_metrics(_records(spark, sf))


def ag10_replay_report(spark, sf):
    records = _records(spark, sf)
    return ops.replay_report(records, records.withColumn("given_id", F.col("truth_id")))


def ag11_count_accuracy(spark, sf):
    obs = _obs(spark, sf)
    count = lambda rows: rows.groupBy(*FRAME).agg(F.count("*").alias("n"))
    return ops.count_accuracy(count(obs.where("confidence >= 0.5")), count(obs)).withColumns({c: F.round(c, 9) for c in ("exact_rate", "merge_rate")})


QUERIES = {f.__name__: f for f in (
    pf2_tag_zones, pf3_zone_kind, pf9_filter_by_pipeline, jn3_frame_overlap, jn6_nearest_frames, wn1_track_velocity, wn2_frame_counts, wn3_control_stride,
    wn4_person_motion, wn5_contact_islands, wn6_sustained_since, wn7_robust_motion, wn8_occlusion_periods, wn9_relative_speed, wn10_track_endpoints,
    ag1_tracklet_summary, ag2_collect_frames, ag9_identity_metrics, ag10_replay_report, ag11_count_accuracy, dq1_frame_signals, dq2_sample_groups,
)}

_O = fx.oracle("track_obs")
_OZ = fx.oracle("track_obs", "zones")
_W = f"(PARTITION BY {KEYS} ORDER BY frame_index)"
_RECORDS = f", records AS (SELECT {FR}, local_track_id AS truth_id, local_track_id * 1000 + CAST(floor(frame_index / 50.0e0) AS BIGINT) AS given_id FROM track_obs)"
_METRICS = """(SELECT session_id, source_id, CAST(sum(f) AS BIGINT) AS fragmentations, CAST(sum(s) AS BIGINT) AS switches FROM (
  SELECT session_id, source_id, truth_id, count(DISTINCT {0}) - 1 AS f, count_if(sw) AS s FROM (SELECT *, {0} <> lag({0}) OVER (PARTITION BY session_id, source_id, truth_id ORDER BY stream_epoch, frame_index) AS sw FROM records) GROUP BY ALL) GROUP BY ALL)"""
_FRAMES = f", frames AS (SELECT DISTINCT {FR}, timestamp_global FROM track_obs)"
_NEAREST = """SELECT session_id, anchor_time{1}, source_id, b.frame_index AS frame_index, b.gap AS gap FROM (
  SELECT a.*, f.source_id, min({{'gap': abs(f.timestamp_global - a.anchor_time), 'frame_index': f.frame_index, 'stream_epoch': f.stream_epoch}}) AS b
  FROM {0} a JOIN frames f ON a.session_id = f.session_id AND f.timestamp_global BETWEEN a.anchor_time - 0.5 AND a.anchor_time + 0.5 AND abs(f.timestamp_global - a.anchor_time) <= 0.35 GROUP BY ALL)"""

ORACLES = {
    "pf2_tag_zones": f"{_OZ}{SCALED} SELECT {KEYS}, frame_index, zone_id FROM tagged",
    "pf3_zone_kind": f"{_OZ}{SCALED} SELECT session_id, t.camera_role, z.kind AS zone_kind, count(*) AS n FROM tagged t LEFT JOIN zones z ON z.camera_role = t.camera_role AND z.zone_id = t.zone_id GROUP BY ALL",
    "pf9_filter_by_pipeline": f"{_O} SELECT session_id, source_id, class_name, count(*) AS n FROM (SELECT *, max(CAST(camera_role <> 'C2' AND frame_index % 100 = 0 AS INTEGER)) OVER (PARTITION BY session_id, source_id) AS posed FROM track_obs) WHERE posed = 0 OR (camera_role IN ('C1', 'C2') AND class_name = 'parcel') OR (camera_role = 'C3' AND class_name <> 'parcel') GROUP BY ALL",
    "jn3_frame_overlap": f"{_O}{OVERLAP} SELECT {FR}, round(max_overlap, 9) AS max_overlap FROM overlap",
    "wn1_track_velocity": f"{_O}{MOVING.format('track_obs')} SELECT {KEYS}, frame_index, round(vx, 6) AS vx, round(vy, 6) AS vy FROM moving",
    "wn2_frame_counts": f"{_O}{COUNTS} SELECT {FR}, n_instances, count_change FROM counts",
    "wn3_control_stride": f"{_O}{COUNTS} SELECT {FR} FROM counts WHERE is_control",
    "wn4_person_motion": f"""{_O} SELECT {KEYS}, frame_index, round(CASE WHEN dt IS NULL OR dt > 2 THEN 0 ELSE dx / greatest(dt, 0.001) END, 6) AS vx, round(CASE WHEN dt IS NULL OR dt > 2 THEN 0 ELSE dy / greatest(dt, 0.001) END, 6) AS vy FROM (
      SELECT *, timestamp_global - lag(timestamp_global) OVER w AS dt, (x1 + x2) / 2 - lag((x1 + x2) / 2) OVER w AS dx, (y1 + y2) / 2 - lag((y1 + y2) / 2) OVER w AS dy FROM track_obs WHERE class_name = 'person' WINDOW w AS {_W})""",
    "wn5_contact_islands": f"""{_O}, c AS (SELECT *, CAST(floor(x1 / 100) AS BIGINT) % 2 = 0 AS in_contact FROM track_obs),
      n AS (SELECT *, CASE WHEN lag(timestamp_global) OVER w IS NULL OR in_contact <> lag(in_contact) OVER w OR timestamp_global - lag(timestamp_global) OVER w > 3 THEN 1 ELSE 0 END AS new FROM c WINDOW w AS {_W}),
      r AS (SELECT *, sum(new) OVER {_W} AS run FROM n)
      SELECT {KEYS}, frame_index, in_contact, min(timestamp_global) OVER (PARTITION BY {KEYS}, run) AS since, timestamp_global - min(timestamp_global) OVER (PARTITION BY {KEYS}, run) AS duration FROM r""",
    "wn6_sustained_since": f"""{_O}, n AS (SELECT *, confidence >= 0.7 AS v, CASE WHEN lag(confidence >= 0.7) OVER w = (confidence >= 0.7) THEN 0 ELSE 1 END AS new FROM track_obs WINDOW w AS {_W}),
      r AS (SELECT *, sum(new) OVER {_W} AS run FROM n) SELECT {KEYS}, frame_index, CASE WHEN v THEN min(timestamp_global) OVER (PARTITION BY {KEYS}, run) END AS since FROM r""",
    "wn7_robust_motion": f"""{_O}, s AS (SELECT *, ((x1 + x2) / 2 - lag((x1 + x2) / 2) OVER w) / greatest(timestamp_global - lag(timestamp_global) OVER w, 1e-6) AS sx, ((y1 + y2) / 2 - lag((y1 + y2) / 2) OVER w) / greatest(timestamp_global - lag(timestamp_global) OVER w, 1e-6) AS sy FROM track_obs WINDOW w AS {_W}),
      m AS (SELECT *, list(sx) FILTER (sx IS NOT NULL) OVER r AS lx, coalesce(median(sx) OVER r, 0) AS mvx, coalesce(median(sy) OVER r, 0) AS mvy FROM s WINDOW r AS (PARTITION BY {KEYS} ORDER BY frame_index ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
      SELECT {KEYS}, frame_index, round(mvx, 6) AS mvx, round(mvy, 6) AS mvy, round(coalesce(list_median([abs(v - mvx) FOR v IN lx]), 0), 6) AS deviation_x FROM m""",
    "wn8_occlusion_periods": f"""{_O}{_FRAMES}, cal AS (SELECT *, row_number() OVER (PARTITION BY session_id, source_id, stream_epoch ORDER BY frame_index) AS seq FROM frames),
      g AS (SELECT {", ".join("o." + c for c in TRACK)}, cal.seq, cal.timestamp_global, lag(cal.seq) OVER (PARTITION BY {", ".join("o." + c for c in TRACK)} ORDER BY cal.seq) AS before FROM track_obs o JOIN cal USING ({FR}))
      SELECT g.session_id, g.source_id, g.stream_epoch, local_track_id, cal.frame_index AS start_frame, cal.timestamp_global AS started_at, g.timestamp_global AS ended_at, g.seq - before - 1 AS missed
      FROM g JOIN cal ON cal.session_id = g.session_id AND cal.source_id = g.source_id AND cal.stream_epoch = g.stream_epoch AND cal.seq = before + 1 WHERE g.seq - before > 1""",
    "wn9_relative_speed": f"{_O}{MOVING.format('track_obs')} SELECT {KEYS}, frame_index, round(sqrt((vx / 640) * (vx / 640) + (vy / 360) * (vy / 360)), 6) AS relative_speed FROM moving",
    "wn10_track_endpoints": f"{_O} SELECT * FROM (SELECT {KEYS}, frame_index, frame_index = min(frame_index) OVER t AS is_first, frame_index = max(frame_index) OVER t AS is_last FROM track_obs WINDOW t AS (PARTITION BY {KEYS})) WHERE is_first OR is_last",
    "ag1_tracklet_summary": f"""{_OZ}{SCALED}{MOVING.format('tagged')}
      SELECT {KEYS}, min(timestamp_global) AS started_at, max(timestamp_global) AS ended_at, min(frame_index) AS first_frame, max(frame_index) AS last_frame,
        arg_min(zone_id, frame_index) FILTER (first) AS first_zone_id, arg_max(zone_id, frame_index) FILTER (last) AS last_zone_id, arg_min(x1, frame_index) AS first_x1, arg_max(x1, frame_index) AS last_x1, count(*) AS frame_count,
        round(avg(x2 - x1), 6) AS avg_w, round(avg(y2 - y1), 6) AS avg_h, round(avg(vx), 6) AS avg_vx, round(avg(vy), 6) AS avg_vy, round(avg(sqrt(vx * vx + vy * vy)), 6) AS avg_speed,
        coalesce(string_agg(zone_id, '>' ORDER BY frame_index) FILTER (fresh), '') AS visited_zones
      FROM (SELECT *, zone_id IS NOT NULL AND row_number() OVER (PARTITION BY {KEYS}, zone_id ORDER BY frame_index) = 1 AS fresh, frame_index = min(frame_index) OVER t AS first, frame_index = max(frame_index) OVER t AS last FROM moving WINDOW t AS (PARTITION BY {KEYS})) GROUP BY {KEYS}""",
    "ag2_collect_frames": f"""{_O} SELECT {FR}, count(*) AS n_observations, bool_or(local_track_id % 5 = 0) AS any_ambiguous, bool_or(frame_index = f OR frame_index = l) AS any_endpoint, string_agg(DISTINCT tid, ',' ORDER BY tid) AS tracklet_ids
      FROM (SELECT *, concat_ws(':', {KEYS}) AS tid, min(frame_index) OVER t AS f, max(frame_index) OVER t AS l FROM track_obs WINDOW t AS (PARTITION BY {KEYS})) GROUP BY {FR}""",
    "ag9_identity_metrics": f"{_O}{_RECORDS} SELECT * FROM {_METRICS.format('given_id')}",
    "ag10_replay_report": f"""{_O}{_RECORDS} SELECT * FROM (SELECT CAST(sum(fragmentations) AS BIGINT) AS raw_fragmentations, CAST(sum(switches) AS BIGINT) AS raw_switches FROM {_METRICS.format('given_id')}),
      (SELECT CAST(sum(fragmentations) AS BIGINT) AS canonical_fragmentations, CAST(sum(switches) AS BIGINT) AS canonical_switches FROM {_METRICS.format('truth_id')}),
      (SELECT count(DISTINCT (session_id, source_id, given_id)) AS raw_tracks, count(DISTINCT (session_id, source_id, truth_id)) AS canonical_tracks FROM records)""",
    "ag11_count_accuracy": f"{_O} SELECT session_id, round(avg(CAST(p = n AS INTEGER)), 9) AS exact_rate, round(avg(CAST(p < n AS INTEGER)), 9) AS merge_rate FROM (SELECT {FR}, count(*) AS n, count_if(confidence >= 0.5) AS p FROM track_obs GROUP BY ALL) GROUP BY ALL",
    "dq1_frame_signals": f"{_O}{SIGNALS} SELECT {FR}, timestamp_global, reason, round(score, 9) AS score FROM signals WHERE reason IS NOT NULL",
    "jn6_nearest_frames": f"{_O}{_FRAMES}, anchors AS (SELECT DISTINCT session_id, timestamp_global + 0.05 AS anchor_time FROM frames WHERE source_id = 'C1') SELECT session_id, anchor_time, source_id, frame_index, round(gap, 9) AS gap FROM ({_NEAREST.format('anchors', '')})",
    "dq2_sample_groups": f"""{_O}{SIGNALS}{_FRAMES}, anchors AS (SELECT session_id, CAST(round_even(timestamp_global / 0.25, 0) AS BIGINT) AS bucket, median(timestamp_global) AS anchor_time, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons, max(score) AS anchor_score FROM signals WHERE reason IS NOT NULL GROUP BY ALL),
      own AS (SELECT session_id, source_id, frame_index, max(score) AS own FROM signals WHERE reason IS NOT NULL GROUP BY ALL)
      SELECT session_id, bucket, anchor_time, source_id, frame_index, reasons, round(greatest(anchor_score, coalesce(own, 0)), 9) AS group_score FROM ({_NEAREST.format('anchors', ', bucket, reasons, anchor_score')}) LEFT JOIN own USING (session_id, source_id, frame_index)""",
}
