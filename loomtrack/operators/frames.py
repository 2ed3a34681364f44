"""Jobs over track observations: one row for each track in each frame."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtrack.functions.shared import dimension, written
from loomtrack.functions.geometry import FRAME, TRACK, centre_x, centre_y, half_even, iou, track_window


def tag_zones(obs: DataFrame, zones: DataFrame, width: float = 640.0, height: float = 360.0) -> DataFrame:
    """Adds ``zone_id``: of the role's zones, by position, the first whose box holds the box centre (edges count).

    A zone whose corners are all at most 1.5 is normalized by the image size. Zones are a
    small dimension (a few per camera) and broadcast, if counted so; an observation in no zone gets null.
    """
    scale = F.when(F.greatest("x1", "y1", "x2", "y2") <= 1.5, True).otherwise(False)
    boxes = zones.select(
        "camera_role", "position", "zone_id",
        *(F.when(scale, F.col(c) * size).otherwise(F.col(c)).alias(f"z{c}") for c, size in (("x1", width), ("y1", height), ("x2", width), ("y2", height))),
    )
    listed = boxes.groupBy("camera_role").agg(F.array_sort(F.collect_list(F.struct("position", "zone_id", "zx1", "zy1", "zx2", "zy2"))).alias("zone_list"))
    inside = F.filter("zone_list", lambda z: F.col("cx").between(z["zx1"], z["zx2"]) & F.col("cy").between(z["zy1"], z["zy2"]))
    return obs.withColumns({"cx": centre_x(), "cy": centre_y()}).join(dimension(listed), "camera_role", "left").withColumn("zone_id", F.try_element_at(inside, F.lit(1))["zone_id"]).drop("zone_list", "cx", "cy")


def zone_kind(obs: DataFrame, zones: DataFrame) -> DataFrame:
    """Adds ``zone_kind`` of ``zone_id``; null for an unknown or null zone."""
    return obs.join(dimension(zones.select("camera_role", "zone_id", F.col("kind").alias("zone_kind"))), ["camera_role", "zone_id"], "left")


def filter_by_pipeline(dets: DataFrame, parcel_roles: list[str], pose_roles: list[str], is_pose: str = "is_pose") -> DataFrame:
    """Where a source has a pose pipeline, parcel roles keep only parcels and pose roles only the rest."""
    posed = dets.where(F.col(is_pose)).select(F.col("session_id").alias("__session"), F.col("source_id").alias("__source")).distinct().withColumn("__posed", F.lit(True))
    parcel = F.col("class_name") == "parcel"
    keep = F.col("__posed").isNull() | F.when(F.col("camera_role").isin(parcel_roles), parcel).when(F.col("camera_role").isin(pose_roles), ~parcel).otherwise(True)
    joined = dets.join(posed.hint("merge"), dets["session_id"].eqNullSafe(F.col("__session")) & dets["source_id"].eqNullSafe(F.col("__source")), "left")
    return joined.where(keep).drop("__session", "__source", "__posed")


def frame_overlap(obs: DataFrame) -> DataFrame:
    """(frame, max_overlap): the largest IoU of two different tracks in a frame; 0 for a lone track."""
    return obs.select(*FRAME).distinct().join(overlaps(obs), list(FRAME), "left").select(*FRAME, F.coalesce("max_overlap", F.lit(0.0)).alias("max_overlap"))


def overlaps(obs: DataFrame) -> DataFrame:
    """As ``frame_overlap``, without frames of a lone track."""
    side = lambda p: obs.select(*FRAME, F.col("local_track_id").alias(f"{p}id"), *(F.col(c).alias(f"{p}{c}") for c in ("x1", "y1", "x2", "y2")))
    return side("a_").join(side("b_"), list(FRAME)).where("a_id < b_id").groupBy(*FRAME).agg(F.max(iou("a_", "b_")).alias("max_overlap"))


def track_velocity(obs: DataFrame, least_dt: float = 1e-3) -> DataFrame:
    """Adds ``vx``, ``vy`` from the centre's move since the track's last frame; 0 for its first."""
    w = track_window()
    dt = F.greatest(F.col("timestamp_global") - F.lag("timestamp_global").over(w), F.lit(least_dt))
    return obs.withColumns({name: F.coalesce((c - F.lag(c).over(w)) / dt, F.lit(0.0)) for name, c in (("vx", centre_x()), ("vy", centre_y()))})


def relative_speed(moving: DataFrame, width: float = 640.0, height: float = 360.0) -> DataFrame:
    """Adds ``relative_speed``: velocity over the image size."""
    return moving.withColumn("relative_speed", F.hypot(F.col("vx") / width, F.col("vy") / height))


def frame_counts(obs: DataFrame) -> DataFrame:
    """(frame, timestamp_global, n_instances, count_change, is_control): WN2 and WN3.

    ``count_change`` is against the source's frame before (0 for its first); every 12th frame
    of a source, from the first, is a control frame.
    """
    return changes(obs.groupBy(*FRAME).agg(F.max("timestamp_global").alias("timestamp_global"), F.count("*").alias("n_instances")))


def changes(frames: DataFrame) -> DataFrame:
    """``frames`` with ``n_instances``, and with ``count_change`` and ``is_control``."""
    w = Window.partitionBy("session_id", "source_id").orderBy("stream_epoch", "frame_index")
    return frames.withColumn("count_change", F.coalesce(F.abs(F.col("n_instances") - F.lag("n_instances").over(w)), F.lit(0))).withColumn("is_control", (F.row_number().over(w) - 1) % 12 == 0)


def track_endpoints(obs: DataFrame) -> DataFrame:
    """The first and last observation of each track, flagged."""
    up, down = track_window(), Window.partitionBy(*TRACK).orderBy(F.desc("frame_index"))
    return obs.withColumns({"is_first": F.row_number().over(up) == 1, "is_last": F.row_number().over(down) == 1}).where("is_first OR is_last")


def robust_motion(obs: DataFrame, anchors: int = 6) -> DataFrame:
    """Adds median velocity of the last steps, their median deviation and the predicted next centre."""
    w = track_window()
    step = F.greatest(F.col("timestamp_global") - F.lag("timestamp_global").over(w), F.lit(1e-6))
    recent = track_window().rowsBetween(-(anchors - 2), 0)
    moved = obs.withColumns({"cx": centre_x(), "cy": centre_y()})
    moved = moved.withColumns({"sx": (F.col("cx") - F.lag("cx").over(w)) / step, "sy": (F.col("cy") - F.lag("cy").over(w)) / step})
    medians = moved.withColumns({f"list_{c}": F.array_sort(F.collect_list(c).over(recent)) for c in ("sx", "sy")})
    out = medians.withColumns({"mvx": _middle("list_sx"), "mvy": _middle("list_sy")})
    spread = F.array_sort(F.zip_with("list_sx", "list_sx", lambda a, _: F.abs(a - F.col("mvx"))))
    return out.withColumn("deviation_x", _middle(spread)).drop("list_sx", "list_sy", "sx", "sy")


def _middle(values) -> F.Column:
    v = F.col(values) if isinstance(values, str) else values
    n = F.size(v)
    at = lambda k: F.get(v, k.cast("int") - 1)
    return F.coalesce((at(F.floor((n + 1) / 2)) + at(F.floor((n + 2) / 2))) / 2, F.lit(0.0))


def islands(rows: DataFrame, keys: list[str], order: str, flag: str) -> DataFrame:
    """Adds ``since``: the ``order`` value at which the current run of equal ``flag`` began (WN6)."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = F.coalesce((F.col(flag) != F.lag(flag).over(w)).cast("int"), F.lit(1))
    return rows.withColumn("__run", F.sum(changed).over(w)).withColumn("since", F.min(order).over(Window.partitionBy(*keys, "__run"))).drop("__run")


def sustained_since(rows: DataFrame, keys: list[str], order: str, flag: str) -> DataFrame:
    """As ``islands``, with ``since`` null where the flag is not true."""
    return islands(rows, keys, order, flag).withColumn("since", F.when(F.col(flag), F.col("since")))


def contact_islands(pairs: DataFrame, keys: list[str], gap: float = 3.0) -> DataFrame:
    """Adds ``since`` and ``duration`` of the current contact or separation (WN5).

    A run ends when the flag flips, and when the pair was not seen for over ``gap`` seconds.
    """
    w = Window.partitionBy(*keys).orderBy("timestamp_global")
    before = F.lag("timestamp_global").over(w)
    new = before.isNull() | (F.col("in_contact") != F.lag("in_contact").over(w)) | (F.col("timestamp_global") - before > gap)
    run = pairs.withColumn("__run", F.sum(new.cast("int")).over(w))
    since = F.min("timestamp_global").over(Window.partitionBy(*keys, "__run"))
    return run.withColumn("since", since).withColumn("duration", F.col("timestamp_global") - F.col("since")).drop("__run")


def person_motion(persons: DataFrame, gap: float = 2.0) -> DataFrame:
    """Adds velocity from the last two samples; a person unseen for over ``gap`` seconds starts anew at 0."""
    w = track_window()
    dt = F.col("timestamp_global") - F.lag("timestamp_global").over(w)
    fresh = dt.isNull() | (dt > gap)
    v = lambda c: F.when(fresh, 0.0).otherwise((c - F.lag(c).over(w)) / F.greatest(dt, F.lit(1e-3)))
    return persons.withColumns({"vx": v(centre_x()), "vy": v(centre_y())})


def occlusion_periods(obs: DataFrame) -> DataFrame:
    """(track, start_frame, started_at, ended_at, missed): gaps in which a track missed frames of its source and came back."""
    calendar = obs.select(*FRAME, "timestamp_global").distinct()
    numbered = calendar.withColumn("seq", F.row_number().over(Window.partitionBy("session_id", "source_id", "stream_epoch").orderBy("frame_index")))
    w = track_window("seq")
    seen = obs.select(*TRACK, "frame_index").join(numbered, ["session_id", "source_id", "stream_epoch", "frame_index"])
    gaps = seen.withColumn("before", F.lag("seq").over(w)).where("seq - before > 1")
    start = numbered.select("session_id", "source_id", "stream_epoch", (F.col("seq") - 1).alias("before"), F.col("frame_index").alias("start_frame"), F.col("timestamp_global").alias("started_at"))
    return gaps.join(start, ["session_id", "source_id", "stream_epoch", "before"]).select(*TRACK, "start_frame", "started_at", F.col("timestamp_global").alias("ended_at"), (F.col("seq") - F.col("before") - 1).cast("long").alias("missed"))


def tracklet_summary(obs: DataFrame) -> DataFrame:
    """One row per track (AG1): first and last sighting, counts, mean geometry and motion, zones in order of visit.

    ``obs`` has velocities and zones. Equal times go by frame.
    """
    by = F.struct("timestamp_global", "frame_index")
    entered = obs.withColumn("__before", F.lag("zone_id").over(track_window("timestamp_global", "frame_index")))
    new = F.col("zone_id").isNotNull() & ~F.col("zone_id").eqNullSafe(F.col("__before"))  # only entries are collected, not every observation
    visited = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(new, F.struct("timestamp_global", "frame_index", "zone_id")))), lambda z: z["zone_id"]))
    return entered.groupBy(*TRACK).agg(
        F.min("timestamp_global").alias("started_at"), F.max("timestamp_global").alias("ended_at"),
        F.min_by("frame_index", by).alias("first_frame"), F.max_by("frame_index", by).alias("last_frame"),
        F.min_by("zone_id", by).alias("first_zone_id"), F.max_by("zone_id", by).alias("last_zone_id"),
        F.min_by("x1", by).alias("first_x1"), F.max_by("x1", by).alias("last_x1"),
        F.count("*").alias("frame_count"),
        F.avg(F.col("x2") - F.col("x1")).alias("avg_w"), F.avg(F.col("y2") - F.col("y1")).alias("avg_h"),
        F.avg("vx").alias("avg_vx"), F.avg("vy").alias("avg_vy"), F.avg(F.hypot("vx", "vy")).alias("avg_speed"),
        F.array_join(visited, ">").alias("visited_zones"),
    )


def collect_frames(obs: DataFrame, tracklets: DataFrame) -> DataFrame:
    """(frame, n_observations, any_ambiguous, any_endpoint, tracklet_ids): AG2.

    Of the observations of one (camera, track) in a frame, that of the tracklet that ended last
    counts (ties: the larger id).
    """
    joined = obs.join(tracklets, list(TRACK))
    key = [*FRAME, "camera_role", "local_track_id"]
    one = joined.groupBy(*key).agg(
        F.max_by(F.struct("tracklet_id", "integrity_status"), F.struct("ended_at", "tracklet_id")).alias("t"),
        F.bool_or(F.col("integrity_status") == "AMBIGUOUS").alias("ambiguous"),
        F.bool_or((F.col("frame_index") == F.col("first_frame")) | (F.col("frame_index") == F.col("last_frame"))).alias("endpoint"),
    )
    return one.groupBy(*FRAME).agg(F.count("*").alias("n_observations"), F.bool_or("ambiguous").alias("any_ambiguous"), F.bool_or("endpoint").alias("any_endpoint"), F.array_join(F.array_sort(F.collect_set("t.tracklet_id")), ",").alias("tracklet_ids"))


def frame_signals(obs: DataFrame) -> DataFrame:
    """(frame, timestamp_global, reason, score): why a frame is worth a label (DQ1), the first rule that holds.

    ``obs`` has ``is_ambiguous`` and ``is_endpoint``. Frames without a reason are left out.
    """
    each = obs.groupBy(*FRAME).agg(F.max("timestamp_global").alias("timestamp_global"), F.count("*").alias("n_instances"), F.bool_or("is_ambiguous").alias("ambiguous"), F.min("confidence").alias("least"), F.bool_or("is_endpoint").alias("endpoint"))
    joined = changes(each).join(overlaps(obs).hint("merge"), list(FRAME), "left").withColumn("max_overlap", F.coalesce("max_overlap", F.lit(0.0)))
    rules = (
        ("ambiguous_identity", F.col("ambiguous"), F.lit(1.0)),
        ("low_confidence", F.col("least") < 0.65, 1 - F.col("least")),
        ("high_overlap", F.col("max_overlap") > 0.55, F.col("max_overlap")),
        ("count_change", F.col("count_change") > 0, F.least(F.lit(1.0), F.lit(0.5) + 0.1 * F.col("count_change"))),
        ("endpoint", F.col("endpoint"), F.lit(0.7)),
        ("control", F.col("is_control"), F.lit(0.2)),
    )
    reason = score = None
    for name, holds, value in rules:
        reason = F.when(holds, name) if reason is None else reason.when(holds, name)
        score = F.when(holds, value) if score is None else score.when(holds, value)
    return joined.select(*FRAME, "timestamp_global", reason.alias("reason"), score.alias("score")).where("reason IS NOT NULL")


def nearest_frames(anchors: DataFrame, frames: DataFrame, tolerance: float = 0.35) -> DataFrame:
    """For each anchor, the nearest frame of every source of its session within ``tolerance`` (JN6).

    Time is cut into buckets of the tolerance; an anchor meets its bucket and both neighbours.
    Ties go to the lower frame index.
    """
    bucket = lambda c: F.floor(F.col(c) / tolerance)
    near = anchors.select("*", F.explode(F.array(*(bucket("anchor_time") + k for k in (-1, 0, 1)))).alias("__near"))
    cut = frames.select("session_id", "source_id", "stream_epoch", "frame_index", "timestamp_global", bucket("timestamp_global").alias("__near"))
    gap = F.abs(F.col("timestamp_global") - F.col("anchor_time"))
    keys = anchors.columns
    return near.join(cut.hint("merge"), ["session_id", "__near"]).where(gap <= tolerance).groupBy(*keys, "source_id").agg(F.min(F.struct(gap.alias("gap"), "frame_index", "stream_epoch")).alias("best")).select(*keys, "source_id", F.col("best.frame_index").alias("frame_index"), F.col("best.gap").alias("gap"))


def sample_groups(signals: DataFrame, frames: DataFrame, bucket_s: float = 0.25, tolerance: float = 0.35) -> DataFrame:
    """(session_id, bucket, anchor_time, source_id, frame_index, reasons, group_score): DQ2.

    Frames with a reason are grouped by session and quarter second; the anchor is the median time; every source gives
    its nearest frame; the score is the largest of the anchors' and the frame's own.
    """
    grouped = signals.withColumn("bucket", half_even(F.col("timestamp_global") / bucket_s)).groupBy("session_id", "bucket").agg(F.median("timestamp_global").alias("anchor_time"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"), F.max("score").alias("anchor_score"))
    chosen = nearest_frames(grouped, frames, tolerance)
    own = signals.groupBy("session_id", "source_id", "frame_index").agg(F.max("score").alias("own"))
    return chosen.join(own.hint("merge"), ["session_id", "source_id", "frame_index"], "left").select("session_id", "bucket", "anchor_time", "source_id", "frame_index", "reasons", F.greatest("anchor_score", F.coalesce("own", F.lit(0.0))).alias("group_score"))


#: Rows of identity records that one task sorts.
RECORDS = 500_000


def _by_identity(records: DataFrame) -> DataFrame:
    """The records, written once and dealt by true identity into as many parts as their number asks for, so that a task's share does not grow with the table."""
    rows = written(records.select("session_id", "source_id", "stream_epoch", "frame_index", "truth_id", "given_id"), "identity-records")
    least = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, ceil(rows.count() / RECORDS)), "session_id", "source_id", "truth_id")


def identity_metrics(records: DataFrame) -> DataFrame:
    """(session_id, source_id, fragmentations, switches): AG9 over rows with a true and a given id."""
    return _identity_metrics(_by_identity(records))


def _identity_metrics(records: DataFrame) -> DataFrame:
    w = Window.partitionBy("session_id", "source_id", "truth_id").orderBy("stream_epoch", "frame_index")
    each = records.withColumn("switched", F.coalesce((F.col("given_id") != F.lag("given_id").over(w)).cast("long"), F.lit(0)))
    per = each.groupBy("session_id", "source_id", "truth_id").agg((F.countDistinct("given_id") - 1).alias("fragmentations"), F.sum("switched").alias("switches"))
    return per.groupBy("session_id", "source_id").agg(F.sum("fragmentations").alias("fragmentations"), F.sum("switches").alias("switches"))


def replay_report(raw: DataFrame, canonical: DataFrame) -> DataFrame:
    """One row of tracks, fragmentations and switches of raw and canonical ids (AG10); both hold rows with a true and a given id."""
    raw, canonical = _by_identity(raw), _by_identity(canonical)
    total = lambda rows, p: _identity_metrics(rows).agg(F.sum("fragmentations").alias(f"{p}_fragmentations"), F.sum("switches").alias(f"{p}_switches"))
    tracks = lambda rows, p: rows.agg(F.countDistinct("session_id", "source_id", "given_id").alias(f"{p}_tracks"))
    return total(raw, "raw").crossJoin(total(canonical, "canonical")).crossJoin(tracks(raw, "raw")).crossJoin(tracks(canonical, "canonical"))  # one row each


def count_accuracy(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(session_id, exact_rate, merge_rate): AG11 over (frame, n) tables; frames without a prediction count 0."""
    joined = truth.join(predicted.withColumnRenamed("n", "p"), list(FRAME), "left").withColumn("p", F.coalesce("p", F.lit(0)))
    return joined.groupBy("session_id").agg(F.avg((F.col("p") == F.col("n")).cast("double")).alias("exact_rate"), F.avg((F.col("p") < F.col("n")).cast("double")).alias("merge_rate"))


def ground_anchor(obs: DataFrame) -> DataFrame:
    """Adds ``ax``, ``ay``: from a mask of three or more finite points (PF4), else the bottom centre of the box.

    With a mask, ay is the 80th percentile of y and ax the median x of the points at or below
    the 60th-percentile line (linear interpolation).
    """
    points = F.filter("mask", lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]))
    with_points = obs.withColumn("__p", points)
    ys = F.array_sort(F.transform("__p", lambda p: p["y"]))
    line = _percentile(ys, 0.6)
    low = F.array_sort(F.transform(F.filter("__p", lambda p: p["y"] >= F.col("__line")), lambda p: p["x"]))
    enough = F.coalesce(F.size("__p") >= 3, F.lit(False))
    out = with_points.withColumn("__line", line)
    return out.withColumns({"ax": F.when(enough, _percentile(low, 0.5)).otherwise(centre_x()), "ay": F.when(enough, _percentile(ys, 0.8)).otherwise(F.col("y2"))}).drop("__p", "__line")


def _percentile(ordered: F.Column, share: float) -> F.Column:
    place = (F.size(ordered) - 1) * F.lit(share)
    low = F.floor(place).cast("int")
    at = lambda k: F.get(ordered, k)
    return at(low) + (at(F.least(low + 1, F.size(ordered) - 1)) - at(low)) * (place - low)
