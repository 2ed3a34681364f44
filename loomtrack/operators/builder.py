"""A training dataset built from observations as one staged job, published only when it is whole (DQ7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrack.functions.geometry import FRAME, TRACK
from loomtrack.functions.shared import dimension, written
from loomtrack.operators.datasets import assign_splits, greedy_dedup, split_leak_classes
from loomtrack.operators.frames import collect_frames, frame_signals, sample_groups

MANIFEST = "version long, name string, task string, items long, sample_groups long, skipped_groups long, splits string, items_digest string, path string"
TASKS = ("detection", "segmentation", "pose", "local_tracking", "reid_multicamera")


class SplitLeak(Exception):
    """The items of a dataset stand, by near or equal images, in several splits."""


def dataset_items(obs: DataFrame, tracklets: DataFrame, hashes: DataFrame, explicit: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(items, groups): the frames worth a label, in synchronized groups without near duplicates, and every group with ``kept``.

    ``obs``: observations with ``is_ambiguous`` and ``is_endpoint``; ``tracklets``: (TRACK, tracklet_id, ended_at, integrity_status, first_frame, last_frame); ``hashes``: (session_id, source_id, stream_epoch,
    frame_index, hash, image_sha256) of archived frames, without which a frame is no item; ``explicit``: (session_id, split). Frames are collected (AG2),
    rated (DQ1), grouped (DQ2), thinned (ST9, in order of session and time); a session's split is given or filled in (DQ3). Columns of items:
    item_id, session_id, sample_group_id, split, source_id, stream_epoch, frame_index, timestamp_global, reasons, group_score, n_observations, tracklet_ids, hash, image_sha256, annotation_status.
    """
    frames = written(obs.groupBy(*FRAME).agg(F.max("timestamp_global").alias("timestamp_global")), "dataset-times")
    sessions = frames.select("session_id").distinct()
    given = explicit if explicit is not None else sessions.limit(0).withColumn("split", F.lit(""))
    splits = written(assign_splits(sessions, given), "dataset-splits")
    picked = written(sample_groups(written(frame_signals(obs), "dataset-signals"), frames), "dataset-picked")
    # a group names a frame by source and index; of several epochs the one nearest to the anchor is meant
    placed = picked.join(frames.hint("merge"), ["session_id", "source_id", "frame_index"])
    nearest = F.min_by(F.struct("stream_epoch", "timestamp_global"), F.struct(F.abs(F.col("timestamp_global") - F.col("anchor_time")), "stream_epoch"))
    placed = placed.groupBy(*picked.columns).agg(nearest.alias("f")).select("*", "f.stream_epoch", "f.timestamp_global").drop("f")
    known = placed.join(hashes.select(*FRAME, "hash", "image_sha256").hint("merge"), list(FRAME))
    group = F.concat_ws(":", "session_id", F.col("bucket").cast("long"))
    rows = known.join(dimension(splits), "session_id").withColumn("sample_group_id", group)
    rows = rows.withColumns({"item_id": F.sha2(F.concat_ws("/", "sample_group_id", "source_id", "stream_epoch", "frame_index"), 256), "session_order": F.col("session_id"), "group_order": F.col("anchor_time")})
    rows = written(rows, "dataset-frames")
    groups = written(greedy_dedup(rows), "dataset-groups")
    kept = written(rows.join(groups.where("kept").select("sample_group_id").hint("merge"), "sample_group_id", "left_semi"), "dataset-kept")
    seen = obs.join(dimension(kept.select(*FRAME).distinct()), list(FRAME), "left_semi")  # what was seen is collected for the frames that stay
    kept = kept.join(collect_frames(seen, tracklets).select(*FRAME, "n_observations", "tracklet_ids").hint("merge"), list(FRAME), "left")
    columns = ["item_id", "session_id", "sample_group_id", "split", "source_id", "stream_epoch", "frame_index", "timestamp_global", "reasons", "group_score", "n_observations", "tracklet_ids", "hash", "image_sha256"]
    return kept.select(*columns, F.lit("NEEDS_REVIEW").alias("annotation_status")), groups


def published(spark: SparkSession, root: str) -> DataFrame:
    """The manifests of all versions of a dataset; none where nothing was ever published."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(MANIFEST).json(f"{root}/manifest") if there else spark.createDataFrame([], MANIFEST)


def build_dataset(obs: DataFrame, tracklets: DataFrame, hashes: DataFrame, root: str, name: str = "dataset", task: str = "detection", explicit: DataFrame | None = None) -> int:
    """Builds the next version of the dataset under ``root`` and publishes it; gives its number.

    Items and groups are written to the version's own folder first, then checked for split leaks, as they were written. The manifest row, one
    file that the commit of its job makes visible, comes last: a driver that is lost before leaves the version before it in force, and the
    next run takes the same number and overwrites what was left behind.
    """
    if task not in TASKS:
        raise ValueError(f"unknown task {task}")
    spark = obs.sparkSession
    version = (published(spark, root).agg(F.max("version").alias("v")).first().v or 0) + 1
    path = f"{root}/versions/{version}"
    items, groups = dataset_items(obs, tracklets, hashes, explicit)
    items.write.mode("overwrite").partitionBy("split").parquet(f"{path}/items")
    groups.write.mode("overwrite").parquet(f"{path}/groups")
    stored = spark.read.schema(items.schema).parquet(f"{path}/items")
    leaks = split_leak_classes(stored)
    leaks.write.mode("overwrite").parquet(f"{path}/leaks")
    found = spark.read.schema(leaks.schema).parquet(f"{path}/leaks")
    if not found.isEmpty():
        raise SplitLeak(f"{found.count()} pairs of near images stand in several splits, see {path}/leaks")
    publish(stored, spark.read.parquet(f"{path}/groups"), root, version, name, task)
    return version


def publish(items: DataFrame, groups: DataFrame, root: str, version: int, name: str, task: str) -> None:
    """Writes the manifest row of a version: counts, and a digest over its items that does not hang on their order."""
    digest = F.sha2(F.concat_ws("|", F.count("*"), F.sum(F.xxhash64("item_id").cast("decimal(38,0)")), F.sum(F.xxhash64("item_id", "image_sha256", "split").cast("decimal(38,0)"))), 256)
    totals = items.agg(F.count("*").alias("items"), F.countDistinct("sample_group_id").alias("sample_groups"), F.concat_ws(",", F.array_sort(F.collect_set("split"))).alias("splits"), digest.alias("items_digest"))
    skipped = groups.agg(F.count_if(~F.col("kept")).alias("skipped_groups"))
    row = totals.crossJoin(skipped).select(F.lit(version).cast("long").alias("version"), F.lit(name).alias("name"), F.lit(task).alias("task"), "items", "sample_groups", "skipped_groups", "splits", "items_digest", F.lit(f"{root}/versions/{version}").alias("path"))  # one row each
    row.coalesce(1).write.mode("append").json(f"{root}/manifest")


def read_dataset(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The items of the newest published version, or of ``version``."""
    rows = published(spark, root).where(F.lit(True) if version is None else F.col("version") == version).orderBy(F.desc("version")).limit(1).collect()
    if not rows:
        raise FileNotFoundError(f"no published version under {root}")
    return spark.read.parquet(f"{rows[0].path}/items")


def track_table(obs: DataFrame) -> DataFrame:
    """The ``tracklets`` that ``dataset_items`` needs, where observations are all there is."""
    return obs.groupBy(*TRACK).agg(
        F.concat_ws("/", *TRACK).alias("tracklet_id"), F.max("timestamp_global").alias("ended_at"), F.when(F.bool_or("is_ambiguous"), "AMBIGUOUS").otherwise("STABLE").alias("integrity_status"), F.min("frame_index").alias("first_frame"), F.max("frame_index").alias("last_frame"),
    )
