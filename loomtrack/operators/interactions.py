"""Parcels and persons in one frame, wrists, matches to the frame before, and the quality gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrack.functions.geometry import FRAME, iou
from loomtrack.functions.shared import written
from loomtrack.operators.frames import changes, overlaps


def person_wrists(obs: DataFrame, width: float = 640.0, height: float = 360.0) -> DataFrame:
    """(frame, person_id, side, wx, wy): keypoints 9 and 10 with confidence above 0 (PF12); normalized ones are scaled."""
    point = lambda k, side: F.struct(F.lit(side).alias("side"), F.get("keypoints", F.lit(k)).alias("p"))
    rows = obs.select(*FRAME, F.col("local_track_id").alias("person_id"), F.explode(F.array(point(9, "left"), point(10, "right"))).alias("w")).where("w.p.v > 0")
    small = (F.col("w.p.x") <= 1.5) & (F.col("w.p.y") <= 1.5)
    return rows.select(*FRAME, "person_id", "w.side", F.when(small, F.col("w.p.x") * width).otherwise(F.col("w.p.x")).alias("wx"), F.when(small, F.col("w.p.y") * height).otherwise(F.col("w.p.y")).alias("wy"))


def parcel_person_pairs(parcels: DataFrame, persons: DataFrame, wrists: DataFrame, diagonal: float) -> DataFrame:
    """Every parcel and person of a frame with wrist distance over the diagonal, overlap and ``near`` (JN2).

    The distance is to the parcel's box; 10 without wrists; near is 0.28 or less, or overlap.
    """
    side = lambda rows, p: rows.select(*FRAME, F.col("local_track_id").alias(f"{p}_id"), *(F.col(c).alias(f"{p}_{c}") for c in ("x1", "y1", "x2", "y2")))
    hands = wrists.groupBy(*FRAME, "person_id").agg(F.collect_list(F.struct("wx", "wy")).alias("hands"))  # two at most
    pairs = side(parcels, "parcel").join(side(persons, "person"), list(FRAME)).join(hands.hint("merge"), [*FRAME, "person_id"], "left")
    gap = lambda low, v, high: F.greatest(F.col(low) - v, F.lit(0.0), v - F.col(high))
    reach = F.array_min(F.transform("hands", lambda h: F.hypot(gap("parcel_x1", h["wx"], "parcel_x2"), gap("parcel_y1", h["wy"], "parcel_y2"))))
    out = pairs.withColumns({"distance": F.coalesce(reach / diagonal, F.lit(10.0)), "overlap": iou("parcel_", "person_") > 0})
    return out.select(*FRAME, "parcel_id", "person_id", "distance", "overlap", ((F.col("distance") <= 0.28) | F.col("overlap")).alias("near"))


def temporal_matches(obs: DataFrame) -> DataFrame:
    """(frame, matched, total): detections that overlap one of their class in the source's frame before by IoU 0.2 (JN11)."""
    total = obs.groupBy(*FRAME).agg(F.count("*").alias("total"))
    return total.join(_matched(obs, total).hint("merge"), list(FRAME), "left").select(*FRAME, F.coalesce("matched", F.lit(0)).alias("matched"), "total")


def _matched(obs: DataFrame, each: DataFrame) -> DataFrame:
    """(frame, matched) where any match; ``each`` has a row for each frame. A detection is sent to the frame after its own, so that only one side of the pairs needs the order of frames."""
    after = each.select(*FRAME, F.lead("frame_index").over(Window.partitionBy("session_id", "source_id", "stream_epoch").orderBy("frame_index")).alias("after")).where("after IS NOT NULL")
    box = ("class_name", "x1", "y1", "x2", "y2")
    side = lambda rows, p, *more: rows.select(*FRAME, *(F.col(c).alias(f"{p}{c}") for c in (*more, *box)))
    before = obs.join(after.hint("merge"), list(FRAME)).withColumn("frame_index", F.col("after"))
    pairs = side(obs, "a_", "local_track_id").join(side(before, "b_").hint("merge"), list(FRAME)).where((F.col("a_class_name") == F.col("b_class_name")) & (iou("a_", "b_") >= 0.2))
    return pairs.select(*FRAME, "a_local_track_id").distinct().groupBy(*FRAME).agg(F.count("*").alias("matched"))


def frame_quality(obs: DataFrame, width: float = 640.0, height: float = 360.0) -> DataFrame:
    """(frame, n_detections, mean_conf, min_conf, least_area, most_area, count_change, max_overlap, temporal_stability): what DQ8 takes from observations.

    Observations and frames are written once and read by all parts; areas are shares of the image.
    """
    obs = written(obs.select(*FRAME, "local_track_id", "class_name", "confidence", "x1", "y1", "x2", "y2"), "quality-observations")
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) / (width * height)
    frames = obs.groupBy(*FRAME).agg(F.count("*").alias("n_instances"), F.avg("confidence").alias("mean_conf"), F.min("confidence").alias("min_conf"), F.min(area).alias("least_area"), F.max(area).alias("most_area"))
    each = written(changes(frames).dropna(subset=list(FRAME)), "quality-frames")
    joined = each.join(overlaps(obs).hint("merge"), list(FRAME), "left").join(_matched(obs, each).hint("merge"), list(FRAME), "left")
    stable = F.coalesce("matched", F.lit(0)) / F.col("n_instances")
    return joined.select(*FRAME, F.col("n_instances").alias("n_detections"), "mean_conf", "min_conf", "least_area", "most_area", "count_change", F.coalesce("max_overlap", F.lit(0.0)).alias("max_overlap"), stable.alias("temporal_stability"))


def quality_gate(items: DataFrame) -> DataFrame:
    """Adds ``verdict`` from the quality signals of an item (DQ8); null signals count as the rules say.

    ``model_agreement`` and ``mask_quality`` count where the table has them.
    """
    c = F.col
    low = lambda name, least: c(name) < least
    missing_or_low = lambda name, least: c(name).isNull() | (c(name) < least)
    holds = lambda e: F.coalesce(e, F.lit(False))
    rejected = holds(c("least_area") < 0.0002) | holds(c("most_area") > 0.90) | holds(c("pose_errors") > 0)
    review: Column = (c("n_detections") == 0) | holds(low("mean_conf", 0.65)) | holds(low("min_conf", 0.35)) | holds(low("temporal_stability", 0.55)) | missing_or_low("tracker_consistency", 0.75)
    review = review | holds(c("count_change") > 1) | holds(c("max_overlap") > 0.80) | holds(low("plausible_ratio", 0.85)) | holds(c("truncated_ratio") > 0.5)
    if "model_agreement" in items.columns:
        review = review | missing_or_low("model_agreement", 0.75)
    if "mask_quality" in items.columns:
        rejected = rejected | holds((c("n_detections") > 0) & (c("mask_quality") <= 0))
        review = review | holds(low("mask_quality", 0.75))
    return items.withColumn("verdict", F.when(rejected, "REJECTED").when(review, "NEEDS_REVIEW").otherwise("AUTO_ACCEPTED"))
