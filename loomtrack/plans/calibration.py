"""Registered queries over calibrated observations and links within frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrack.functions.geometry import FRAME, TRACK
from loomtrack.operators import calibration as ops
from loomtrack.sources import fixtures as fx

PROFILES = "SELECT * FROM VALUES ('p1', 'C1', 'wide', 640, 360, true, array(0.01D, 0.001D, 1D, 0D, 0.02D, 2D, 0D, 0.0001D, 1D)), ('p2', 'C2', CAST(NULL AS STRING), 640, 360, true, array(0.02D, 0D, 0D, 0.001D, 0.01D, -1D, 0.0002D, 0D, 1D)), ('p3', 'C9', 'wide', 640, 360, true, array(1D, 0D, 0D, 0D, 1D, 0D, 0D, 0D, 1D)) AS p(profile_id, source_id, optics, width, height, valid, homography)"


def _placed(spark, sf):
    obs = fx.view(spark, sf, "track_obs").withColumns({"ax": (F.col("x1") + F.col("x2")) / 2, "ay": F.col("y2")})
    return ops.to_world(obs, spark.sql(PROFILES), "ax", "ay")


def pf5_to_world(spark, sf):
    return _placed(spark, sf).select(*TRACK, "frame_index", F.round("world_x", 6).alias("world_x"), F.round("world_y", 6).alias("world_y"))


def pf6_to_image(spark, sf):
    return ops.to_image(_placed(spark, sf), spark.sql(PROFILES), "world_x", "world_y").select(*TRACK, "frame_index", F.round("image_x", 6).alias("image_x"), F.round("image_y", 6).alias("image_y"))


#: A camera matrix for each source, and lenses: barrel with all five parameters, and two parameters only.
LENSES = "SELECT p.*, array(600D, 0.5D, 320D, 0D, 580D, 180D, 0D, 0D, 1D) AS camera_matrix, CASE source_id WHEN 'C1' THEN array(-0.21D, 0.06D, 0.001D, -0.0007D, -0.004D) WHEN 'C2' THEN array(0.08D, -0.02D) END AS distortion FROM (" + PROFILES + ") p"


def _lens_placed(spark, sf):
    obs = fx.view(spark, sf, "track_obs").withColumns({"ax": (F.col("x1") + F.col("x2")) / 2, "ay": F.col("y2")})
    return ops.to_world(obs, spark.sql(LENSES), "ax", "ay")


def pf5_lens_to_world(spark, sf):
    return _lens_placed(spark, sf).select(*TRACK, "frame_index", F.round("world_x", 6).alias("world_x"), F.round("world_y", 6).alias("world_y"))


def pf6_lens_to_image(spark, sf):
    """There and back again: where the camera shows the world point, and how far that is from the point it came from."""
    back = ops.to_image(_lens_placed(spark, sf), spark.sql(LENSES), "world_x", "world_y")
    return back.select(*TRACK, "frame_index", F.round("image_x", 5).alias("image_x"), F.round("image_y", 5).alias("image_y"), (F.hypot(F.col("image_x") - F.col("ax"), F.col("image_y") - F.col("ay")) < 1e-6).alias("same"))


def pf8_active_profile(spark, sf):
    """Profiles by source and version from the track table; every second source's newest one is assigned, some fingerprints are stale."""
    seen = fx.view(spark, sf, "track_obs").groupBy(F.concat_ws("/", "session_id", "source_id").alias("source_id"), F.col("stream_epoch").alias("version")).agg(F.count("*").alias("n"))
    p = seen.withColumn("profile_id", F.concat_ws(":", "source_id", "version")).withColumn("homography", F.array(F.col("n").cast("string")))
    p = p.withColumn("fingerprint", F.when(F.col("n") % 3 == 0, "stale").otherwise(F.sha2(F.concat_ws("|", "source_id", "version", F.to_json("homography")), 256)))
    return ops.active_profile(p, p.where("n % 2 = 0")).select("profile_id", "source_id", "next_version", "fingerprint_ok")


def pf7_calibration_diagnostic(spark, sf):
    sources = fx.view(spark, sf, "track_obs").select("session_id", "source_id").distinct()
    n = F.substring("session_id", 2, 9).cast("int")
    seen = sources.withColumns({"profile_id": F.when(n == 0, F.lit(None)).when(n == 1, "p3").otherwise(F.concat(F.lit("p"), F.substring("source_id", 2, 1))), "optics": F.when(n == 2, F.lit(None)).when(n == 3, "tele").otherwise("wide"), "width": F.when(n == 4, 800).otherwise(640), "height": F.lit(360)})
    return ops.calibration_diagnostic(seen, spark.sql(PROFILES)).select("session_id", "source_id", "calibration")


def jn7_own_wrists(spark, sf):
    obs = fx.view(spark, sf, "track_obs")
    persons = obs.where("class_name = 'person'").select(*FRAME, F.col("local_track_id").alias("person_id"), F.array((F.col("local_track_id") % 5).cast("string")).alias("tokens"))
    wrists = obs.where("class_name = 'parcel'").select(*FRAME, F.col("local_track_id").alias("wrist_id"), (F.col("local_track_id") % 5).cast("string").alias("token"))
    return ops.own_wrists(wrists, persons).select(*FRAME, "wrist_id", "person_id")


def io6_attach_sidecar(spark, sf):
    obs = fx.view(spark, sf, "track_obs")
    frames = obs.select("source_id", "frame_index").distinct()
    count = lambda rows: rows.groupBy("source_id", "frame_index").agg(F.count("*").alias("detections"))
    return ops.attach_sidecar_detections(frames, count(obs.where("frame_index % 3 = 0")), count(obs.where("frame_index % 2 = 0 AND confidence > 0.6")))


def jn16_merge_members(spark, sf):
    wide = F.when(F.col("class_name") == "person", 150.0).otherwise(0.0)
    return ops.merge_members(fx.view(spark, sf, "track_obs").withColumns({"x1": F.col("x1") - wide, "x2": F.col("x2") + wide, "y1": F.col("y1") - wide, "y2": F.col("y2") + wide}))


QUERIES = {f.__name__: f for f in (pf5_to_world, pf5_lens_to_world, pf6_to_image, pf6_lens_to_image, pf8_active_profile, pf7_calibration_diagnostic, jn7_own_wrists, jn16_merge_members, io6_attach_sidecar)}

_O = fx.oracle("track_obs")
_T, _F = ", ".join(TRACK), ", ".join(FRAME)
_P = "(x1 + x2) / 2 AS ax, y2 AS ay"
_R2 = "(u * u + v * v)"
_LENS = f"""{_O}, o AS (SELECT *, {_P}, CASE source_id WHEN 'C1' THEN -0.21e0 ELSE 0.08e0 END AS k1, CASE source_id WHEN 'C1' THEN 0.06e0 ELSE -0.02e0 END AS k2, CASE source_id WHEN 'C1' THEN 0.001e0 ELSE 0 END AS p1,
      CASE source_id WHEN 'C1' THEN -0.0007e0 ELSE 0 END AS p2, CASE source_id WHEN 'C1' THEN -0.004e0 ELSE 0 END AS k3 FROM track_obs),
    s0 AS (SELECT *, u0 AS u, v0 AS v FROM (SELECT *, (ax - 320 - 0.5e0 * v0) / 600 AS u0 FROM (SELECT *, (ay - 180) / 580e0 AS v0 FROM o)))""" + "".join(
    f", s{k + 1} AS (SELECT * REPLACE ((u0 - (2 * p1 * u * v + p2 * ({_R2} + 2 * u * u))) / (1 + {_R2} * (k1 + {_R2} * (k2 + {_R2} * k3))) AS u, (v0 - (p1 * ({_R2} + 2 * v * v) + 2 * p2 * u * v)) / (1 + {_R2} * (k1 + {_R2} * (k2 + {_R2} * k3))) AS v) FROM s{k})"
    for k in range(ops.STEPS)
) + f", flat AS (SELECT *, 600 * u + 0.5e0 * v + 320 AS fx, 580 * v + 180 AS fy FROM s{ops.STEPS})"

ORACLES = {
    "pf5_lens_to_world": f"""{_LENS} SELECT {_T}, frame_index, round(CASE source_id WHEN 'C1' THEN (0.01e0 * fx + 0.001e0 * fy + 1) / (0.0001e0 * fy + 1) WHEN 'C2' THEN 0.02e0 * fx / (0.0002e0 * fx + 1) END, 6) AS world_x,
      round(CASE source_id WHEN 'C1' THEN (0.02e0 * fy + 2) / (0.0001e0 * fy + 1) WHEN 'C2' THEN (0.001e0 * fx + 0.01e0 * fy - 1) / (0.0002e0 * fx + 1) END, 6) AS world_y FROM flat""",
    "pf6_lens_to_image": f"{_O} SELECT {_T}, frame_index, round(CASE WHEN source_id <> 'C3' THEN ax END, 5) AS image_x, round(CASE WHEN source_id <> 'C3' THEN ay END, 5) AS image_y, CASE WHEN source_id <> 'C3' THEN true END AS same FROM (SELECT *, {_P} FROM track_obs)",
    "pf8_active_profile": f"{_O}, p AS (SELECT session_id || '/' || source_id AS source_id, stream_epoch AS version, count(*) AS n FROM track_obs GROUP BY ALL) SELECT source_id || ':' || version AS profile_id, source_id, (SELECT max(version) + 1 FROM p q WHERE q.source_id = p.source_id) AS next_version, n % 3 <> 0 AS fingerprint_ok FROM p WHERE n % 2 = 0",
    "pf5_to_world": f"""{_O} SELECT {_T}, frame_index, round(CASE source_id WHEN 'C1' THEN (0.01e0 * ax + 0.001e0 * ay + 1) / (0.0001e0 * ay + 1) WHEN 'C2' THEN 0.02e0 * ax / (0.0002e0 * ax + 1) END, 6) AS world_x,
      round(CASE source_id WHEN 'C1' THEN (0.02e0 * ay + 2) / (0.0001e0 * ay + 1) WHEN 'C2' THEN (0.001e0 * ax + 0.01e0 * ay - 1) / (0.0002e0 * ax + 1) END, 6) AS world_y FROM (SELECT *, {_P} FROM track_obs)""",
    "pf6_to_image": f"{_O} SELECT {_T}, frame_index, round(CASE WHEN source_id <> 'C3' THEN ax END, 6) AS image_x, round(CASE WHEN source_id <> 'C3' THEN ay END, 6) AS image_y FROM (SELECT *, {_P} FROM track_obs)",
    "pf7_calibration_diagnostic": f"""{_O} SELECT session_id, source_id, CASE WHEN n = 0 THEN 'NO_PROFILE' WHEN n = 1 OR source_id = 'C3' THEN 'WRONG_SOURCE' WHEN source_id = 'C1' AND n = 2 THEN 'OPTICAL_CONFIG_UNKNOWN' WHEN source_id = 'C1' AND n = 3 THEN 'INCOMPATIBLE_OPTICAL_CONFIG' WHEN n = 4 THEN 'INCOMPATIBLE_RESOLUTION' ELSE 'READY' END AS calibration
      FROM (SELECT DISTINCT session_id, source_id, CAST(substring(session_id, 2) AS INTEGER) AS n FROM track_obs)""",
    "jn7_own_wrists": f"""{_O}, own AS (SELECT {_F}, local_track_id % 5 AS t, min(local_track_id) AS person_id FROM track_obs WHERE class_name = 'person' GROUP BY ALL HAVING count(*) = 1)
      SELECT {", ".join("w." + c for c in FRAME)}, w.local_track_id AS wrist_id, person_id FROM track_obs w LEFT JOIN own o ON {" AND ".join(f"o.{c} = w.{c}" for c in FRAME)} AND t = local_track_id % 5 WHERE class_name = 'parcel'""",
    "io6_attach_sidecar": f"""{_O}, n AS (SELECT source_id, frame_index, count(*) AS a, count(*) FILTER (confidence > 0.6) AS b FROM track_obs GROUP BY ALL)
      SELECT source_id, frame_index, CASE WHEN frame_index % 3 = 0 THEN a WHEN frame_index % 2 = 0 AND b > 0 THEN b END AS detections, CASE WHEN frame_index % 3 = 0 THEN 'catalogue' WHEN frame_index % 2 = 0 AND b > 0 THEN 'sidecar' END AS origin FROM n""",
    "jn16_merge_members": f"""{_O}, t AS (SELECT * REPLACE (x1 - w AS x1, x2 + w AS x2, y1 - w AS y1, y2 + w AS y2) FROM (SELECT *, CASE WHEN class_name = 'person' THEN 150 ELSE 0 END AS w FROM track_obs)), p AS (SELECT {", ".join("b." + c for c in FRAME)}, b.local_track_id, (b.x2 - b.x1) * (b.y2 - b.y1) AS box, (m.x2 - m.x1) * (m.y2 - m.y1) AS own FROM t b JOIN t m USING ({_F})
      WHERE b.local_track_id <> m.local_track_id AND (m.x1 + m.x2) / 2 BETWEEN b.x1 AND b.x2 AND (m.y1 + m.y2) / 2 BETWEEN b.y1 AND b.y2 AND greatest(0, least(b.x2, m.x2) - greatest(b.x1, m.x1)) * greatest(0, least(b.y2, m.y2) - greatest(b.y1, m.y1)) >= 0.35e0 * (m.x2 - m.x1) * (m.y2 - m.y1))
      SELECT {_F}, local_track_id, count(*) AS members FROM p GROUP BY ALL HAVING count(*) >= 2 AND max(box) >= 0.65e0 * sum(own)""",
}
