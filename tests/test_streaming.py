"""Streams against their batch twins, and readers of observation files."""

import json

from pyspark.sql import functions as F

from loomtrack.operators import sessions
from loomtrack.sources import fixtures as fx
from loomtrack.sources import labels
from loomtrack.streaming import jobs


def _run(stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def test_windows_match_the_batch(spark, sf, tmp_path):
    log = fx.view(spark, sf, "event_log")
    log.orderBy("ts").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = jobs.read_events(spark, f"{tmp_path}/in", log.schema, "30 days")
    found = _run(jobs.stream_windowed_counts(stream, "1 hour"), "windows", "complete")
    wanted = sessions.windowed_counts(log.withColumn("ts", F.col("ts").cast("timestamp")), "1 hour")
    assert found.exceptAll(wanted).count() == 0 and wanted.exceptAll(found).count() == 0


def test_dedup_stream(spark, sf, tmp_path):
    log = fx.view(spark, sf, "event_log")
    log.unionByName(log).write.parquet(f"{tmp_path}/in")
    stream = jobs.read_events(spark, f"{tmp_path}/in", log.schema, "3650 days", 100)
    assert _run(jobs.dedup_stream(stream, ["event_id"]), "once").count() == log.count()


def test_latest_per_source(spark, sf, tmp_path):
    frames = fx.view(spark, sf, "track_obs").select("source_id", "stream_epoch", "frame_index", "timestamp_global")
    frames.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(frames.schema).parquet(f"{tmp_path}/in")
    jobs.write_latest(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 3 and out.agg(F.sum("dropped")).first()[0] == frames.count() - 3


def test_read_observations(spark, tmp_path):
    good = {"session_id": "S", "source_id": "C", "stream_epoch": 0, "frame_index": 1, "timestamp_global": 1.5, "observations": [{"class_name": "parcel", "confidence": 0.9, "track_id": 4, "bbox": {"x1": 1, "y1": 2, "x2": 3, "y2": 4}}, {"class_name": "person"}]}
    (tmp_path / "a.jsonl").write_text(json.dumps(good) + "\n\n{broken\n")
    frames = labels.read_observations(spark, str(tmp_path / "a.jsonl")).cache()
    assert frames.count() == 2 and frames.where("_corrupt_record IS NOT NULL").count() == 1
    rows = labels.explode_detections(frames).orderBy("obs_index").collect()
    assert [(r.obs_index, r.class_name, r.x1) for r in rows] == [(0, "parcel", 1.0), (1, "person", None)]
    labels.export_observations(frames.where("_corrupt_record IS NULL").drop("_corrupt_record"), f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1
    assert labels.file_digests(spark, str(tmp_path / "a.jsonl")).first()["digest"]


def test_label_rules(spark):
    rows = spark.createDataFrame([("0 .5 .5 -.2 .2",), ("0 .1 .1 .2 .2 .3 .3",), ("0 .5 .5 .1 .1",), ("",), (None,)], "line string")
    found = [r.errors for r in labels.validate_labels(labels.parse_yolo_labels(rows), 2).collect()]
    assert found[:3] == [["RANGE", "BOX"], ["AREA"], []] and "CLASS" in found[3] and "CLASS" in found[4]
