"""Automatic labels of dataset items: label lines, quality signals and what becomes of the item (DQ8, DQ9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrack.operators.interactions import quality_gate
from loomtrack.sources.reviews import pose_line, segmentation_line

#: What a detection is to the functions here; ``detections`` is an array of these.
DETECTION = "struct<class_name:string,confidence:double,x1:double,y1:double,x2:double,y2:double,local_track_id:long,tracker_consistent:boolean,model_agreement:double,mask:array<struct<x:double,y:double>>,keypoints:array<struct<x:double,y:double,v:double>>>"
#: Items with one of these and a label are not labelled again.
SETTLED = ("AUTO_ACCEPTED", "HUMAN_VALIDATED")


def _iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes; each area is at least 1."""
    wide = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    high = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    area = lambda p: F.greatest(F.lit(1.0), (p["x2"] - p["x1"]) * (p["y2"] - p["y1"]))
    return wide * high / (area(a) + area(b) - wide * high + F.lit(1e-6))


def _mean(values: Column) -> Column:
    """Mean of an array's values that are not null, to nine decimals, so that a limit does not turn on the order of a sum; null without any."""
    known = F.filter(values, lambda v: v.isNotNull())
    return F.when(F.size(known) > 0, F.round(F.aggregate(known, F.lit(0.0), lambda s, v: s + v) / F.size(known), 9))


def _sound_mask(mask: Column) -> Column:
    """1 for a polygon of three points at least, a length above 4 and an area above 1, else 0."""
    n = F.size(mask)
    at = lambda k: F.get(mask, k % n)
    over = lambda f: F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), f), F.lit(0.0), lambda s, v: s + v)
    length = over(lambda k: F.hypot(at(k + 1)["x"] - at(k)["x"], at(k + 1)["y"] - at(k)["y"]))
    area = F.abs(over(lambda k: at(k)["x"] * at(k + 1)["y"] - at(k + 1)["x"] * at(k)["y"])) / 2
    return F.when(n >= 3, F.when((length > 4) & (area > 1), 1.0).otherwise(0.0)).otherwise(0.0)


def quality_signals(items: DataFrame, task: str = "detection", width: float = 640.0, height: float = 360.0) -> DataFrame:
    """``items`` with the signals that ``quality_gate`` reads.

    ``items``: (item_id, source_id, timestamp_global, detections, ...); a source's items in order of time and id are compared each with the one before. Pairs are those within an image, or of two
    images, so an array expression over the detections does without a join. Without an item before, or with an empty one, stability is 1 and nothing changed.
    ``pose_errors`` is taken as it is where the column exists. A null array is an empty one.
    """
    order = Window.partitionBy("source_id").orderBy("timestamp_global", "item_id")
    rows = items.withColumn("detections", F.coalesce("detections", F.array().cast(items.schema["detections"].dataType)))
    rows = rows.withColumn("__before", F.coalesce(F.lag("detections").over(order), F.array().cast(items.schema["detections"].dataType)))
    d, n, before = F.col("detections"), F.size("detections"), F.size("__before")
    share = F.transform(d, lambda x: F.greatest(F.lit(0.0), x["x2"] - x["x1"]) * F.greatest(F.lit(0.0), x["y2"] - x["y1"]) / F.lit(width * height))
    edge = F.filter(d, lambda x: (x["x1"] <= 1) | (x["y1"] <= 1) | (x["x2"] >= width - 1) | (x["y2"] >= height - 1))
    pairs = F.flatten(F.transform(d, lambda a, i: F.transform(F.slice(d, i + 2, F.greatest(n - i - 1, F.lit(0))), lambda b: _iou(a, b))))
    again = F.filter(d, lambda x: F.exists("__before", lambda y: y["class_name"].eqNullSafe(x["class_name"]) & (_iou(x, y) >= 0.2)))
    steady = F.transform(d, lambda x: F.when(x["local_track_id"].isNotNull(), 1.0).otherwise(x["tracker_consistent"].cast("double")))
    confidence = F.transform(d, lambda x: F.coalesce(x["confidence"], F.lit(0.0)))
    known = before > 0
    rows = rows.withColumns({
        "n_detections": n, "mean_conf": F.coalesce(_mean(confidence), F.lit(0.0)), "min_conf": F.coalesce(F.array_min(confidence), F.lit(0.0)), "least_area": F.array_min(share), "most_area": F.array_max(share),
        "max_overlap": F.coalesce(F.array_max(pairs), F.lit(0.0)), "count_change": F.when(known, F.abs(n - before)).otherwise(0), "temporal_stability": F.when(known, F.size(again) / F.greatest(n, before)).otherwise(1.0),
        "tracker_consistency": _mean(steady), "model_agreement": _mean(F.transform(d, lambda x: x["model_agreement"])), "truncated_ratio": F.size(edge) / F.greatest(n, F.lit(1)),
        "plausible_ratio": F.size(F.filter(share, lambda s: s.between(0.0002, 0.90))) / F.greatest(n, F.lit(1)),
        "mask_quality": F.coalesce(_mean(F.transform(d, lambda x: _sound_mask(x["mask"]))), F.lit(1.0)) if task == "segmentation" else F.lit(1.0),
    })
    return (rows if "pose_errors" in items.columns else rows.withColumn("pose_errors", F.lit(0))).drop("__before")


def label_text(names: list[str], task: str = "detection", width: float = 640.0, height: float = 360.0) -> Column:
    """One label line per detection of a known class (IO7), as one text; detections that make no line are left out."""
    number = lambda x: F.array_position(F.array(*map(F.lit, names)), x["class_name"]) - 1

    def box(x: Column) -> list[Column]:
        return [F.format_string("%.6f", v) for v in ((x["x1"] + x["x2"]) / 2 / width, (x["y1"] + x["y2"]) / 2 / height, (x["x2"] - x["x1"]) / width, (x["y2"] - x["y1"]) / height)]

    def line(x: Column) -> Column:
        if task == "segmentation":
            return segmentation_line(number(x), x["mask"], width, height)
        if task == "pose":
            return pose_line(number(x), x["keypoints"], width, height, of=x)
        return F.concat_ws(" ", number(x).cast("string"), *box(x))

    return F.filter(F.transform("detections", lambda x: F.when(number(x) >= 0, line(x))), lambda t: t.isNotNull())


def annotate_items(items: DataFrame, names: list[str], task: str = "detection", force: bool = False, width: float = 640.0, height: float = 360.0) -> DataFrame:
    """(item_id, skipped, label, label_count, expected_count, complete, status): DQ9, with the signals of the items that were labelled.

    ``items`` have ``detections``, ``annotation_status``, ``label`` (null: none yet) and ``expected`` (class names of the instances seen; null: ``instance_count`` counts). A settled
    item with a label is skipped unless ``force``, keeps both, and is not the item before of any other. An item with fewer lines than expected instances needs review, if it is not
    rejected.
    """
    settled = F.coalesce(F.col("label").isNotNull() & F.col("annotation_status").isin(*SETTLED), F.lit(False))
    skip = settled if not force else F.lit(False)
    signals = ["n_detections", "mean_conf", "min_conf", "max_overlap", "count_change", "temporal_stability", "tracker_consistency", "model_agreement", "truncated_ratio", "plausible_ratio", "mask_quality"]
    judged = quality_gate(quality_signals(items.where(~skip), task, width, height)).withColumn("__lines", label_text(names, task, width, height))
    expected = F.when(F.size("expected") > 0, F.size(F.filter("expected", lambda c: c.isin(*names)))).otherwise(F.coalesce("instance_count", F.lit(0))).cast("int")
    judged = judged.withColumns({"label_count": F.size("__lines"), "expected_count": expected, "label": F.array_join("__lines", "\n")}).withColumn("complete", F.col("label_count") >= F.col("expected_count"))
    status = F.when(~F.col("complete") & (F.col("verdict") != "REJECTED"), "NEEDS_REVIEW").otherwise(F.col("verdict"))
    done = judged.select("item_id", F.lit(False).alias("skipped"), "label", "label_count", "expected_count", "complete", status.alias("status"), *signals)
    kept = items.where(skip).select("item_id", F.lit(True).alias("skipped"), "label", F.col("annotation_status").alias("status"))
    return done.unionByName(kept, allowMissingColumns=True)
