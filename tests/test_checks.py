"""Checks, digests, review formats, replays and projections on small literals."""

import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtrack.operators import calibration, checks, datasets, handoffs
from loomtrack.plans import calibration as calibration_plan, checks as checks_plan
from loomtrack.sources import cvat, reviews


def test_site_dimensions(spark):
    square, bow, flat = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)], [(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.5)], [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)]
    box = (0.1, 0.1, 0.5, 0.5)
    rows = [("ok", "entry", *box, square), ("ok2", " Pick", *box, None), ("", "exit", *box, None), (None, "exit", *box, None), ("dup", "exit", *box, None), ("dup", "exit", *box, None), ("kind", "door", *box, None), ("half", "exit", 0.1, None, 0.5, 0.5, None), ("out", "exit", 0.1, 0.1, 1.5, 0.5, None), ("none", "exit", None, None, None, None, None), ("bow", "exit", *box, bow), ("flat", "exit", *box, flat), ("two", "exit", *box, flat[:2]), ("nan", "exit", *box, [(0.0, math.nan), (1.0, 0.0), (1.0, 1.0)])]
    zones = spark.createDataFrame([("s", "C1", *r) for r in rows], "site_id string, camera_role string, zone_id string, kind string, x1 double, y1 double, x2 double, y2 double, polygon array<struct<x:double,y:double>>")
    edges = spark.createDataFrame([("s", "C1", "C2", 0.5, 10.0), ("s", "C1", "C1", 0.0, 1.0), ("s", "C2", "", 0.0, 1.0), ("s", "C2", "C3", 2.0, 1.0), ("s", "C3", "C4", -1.0, None)], "site_id string, from_role string, to_role string, min_transit_s double, max_transit_s double")
    found = sorted((r.what, r.key, r.rule) for r in checks.check_site_dimensions(zones, edges).collect())
    assert found == sorted([("zone", "C1/", "ID_MISSING"), ("zone", "C1", "ID_MISSING"), ("zone", "C1/dup", "ID_DUPLICATE"), ("zone", "C1/dup", "ID_DUPLICATE"), ("zone", "C1/kind", "KIND"), ("zone", "C1/half", "BOX_INCOMPLETE"), ("zone", "C1/half", "NO_GEOMETRY"), ("zone", "C1/out", "BOX_RANGE"), ("zone", "C1/none", "NO_GEOMETRY"), ("zone", "C1/bow", "POLYGON_CROSSES"), ("zone", "C1/flat", "POLYGON_AREA"), ("zone", "C1/two", "POLYGON_POINTS"), ("zone", "C1/nan", "POLYGON_NUMBERS"), ("edge", "C1->C1", "SELF_LOOP"), ("edge", "C2->", "ROLE_MISSING"), ("edge", "C2->C3", "WINDOW"), ("edge", "C3->C4", "WINDOW")])


def test_pose(spark):
    good = [(float(k), float(k), 2.0) for k in range(17)]
    rows = [(1, 0, "person", 0.0, 0.0, 20.0, 20.0, good), (2, None, None, None, None, None, None, None), (3, 0, "parcel", 5.0, 0.0, 5.0, 20.0, good[:16]), (4, 0, "person", 0.0, math.nan, 20.0, 20.0, [(700.0, 0.0, 0.0), (None, 0.0, 0.0), (0.0, math.inf, 0.0), (0.0, 0.0, -1.0)] + [(0.0, 0.0, 0.0)] * 13)]
    dets = spark.createDataFrame(rows, "item_id long, instance int, class_name string, x1 double, y1 double, x2 double, y2 double, keypoints array<struct<x:double,y:double,v:double>>")
    found = sorted((r.item_id, -1 if r.keypoint is None else r.keypoint, r.rule) for r in checks.validate_pose(dets).collect())
    assert found == sorted([(2, -1, "NO_INSTANCE"), (3, -1, "CLASS"), (3, -1, "BOX_RANGE"), (3, -1, "KEYPOINT_COUNT"), (4, -1, "BOX_NUMBERS"), (4, -1, "NONE_VISIBLE"), (4, 0, "POINT_RANGE"), (4, 1, "POINT_MISSING"), (4, 2, "POINT_NUMBERS"), (4, 3, "VISIBILITY")])


def _items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, session_id string, sample_group_id string, camera_role string, frame_index long, split string, image_sha256 string, hash long, annotation_status string, label string")


ROWS = [(1, "S1", "g1", "C1", 5, "test", "a", 0xFF, "AUTO_ACCEPTED", "x"), (2, "S0", "gé", "C2", 10, "test", "b", 0xFF00, "NEEDS_REVIEW", None), (3, "S1", "g1", "C1", 2, "test", "c", 0xFF0000, "REJECTED", None), (4, "S2", "g3", "C1", 1, "train", "d", 0xFF000000, "REJECTED", None)]


def test_digests(spark):
    items = _items(spark, ROWS)
    (row,) = datasets.frozen_test_digest(items.repartition(3)).collect()
    keys = sorted((r[1], r[2], r[3], r[4]) for r in ROWS if r[5] == "test")
    assert (row.digest, row.n) == (hashlib.sha256(json.dumps(keys, separators=(",", ":")).encode()).hexdigest(), 3)
    assert datasets.frozen_test_digest(items.limit(0)).first().digest == hashlib.sha256(b"[]").hexdigest()
    files = spark.createDataFrame([("p", "d")], "path string, digest string")
    one = checks.dataset_fingerprint(items, files).first()
    assert one == checks.dataset_fingerprint(items.repartition(2).select(*items.columns[::-1]), files).first() and one.rows == 5
    changed = [checks.dataset_fingerprint(_items(spark, [(*ROWS[0][:9], None), *ROWS[1:]]), files), checks.dataset_fingerprint(items, files.withColumn("digest", F.lit("e"))), checks.dataset_fingerprint(items, files, "{1}"), checks.dataset_fingerprint(items.union(items.limit(1)), files)]
    assert len({one.fingerprint, *(c.first().fingerprint for c in changed)}) == 5


def test_report_and_reviews(spark):
    items = _items(spark, ROWS)
    report = {(r.area, r.rule): r.n for r in checks.integrity_report(items, spark.createDataFrame([("S0",), ("S1",)], "session_id string"), spark.createDataFrame([("BOX",), ("BOX",)], "rule string")).collect()}
    assert report == {("session", "UNKNOWN_SESSION"): 1, ("split", "EMPTY_VAL"): 1, ("check", "BOX"): 2}
    reviewed, none = spark.createDataFrame([(2, "y")], "item_id long, label string"), spark.createDataFrame([], "rule string")
    status = lambda df: {r.item_id: (r.label, r.annotation_status) for r in df.collect()}
    before = status(items)
    assert status(checks.import_reviews(items, reviewed, none)) == before | {2: ("y", "HUMAN_VALIDATED")}
    assert status(checks.import_reviews(items, reviewed, spark.createDataFrame([("BOX",)], "rule string"))) == before
    assert status(checks.import_reviews(items, spark.createDataFrame([(2, "y"), (99, "z")], "item_id long, label string"), none)) == before
    merged = datasets.merge_sources(items.where("item_id < 3"), items.withColumn("label", F.lit("second")))
    assert {r.item_id: r.label for r in merged.collect()} == {1: "x", 2: None, 3: "second", 4: "second"}


def test_review_round_trip(spark):
    kind = "array<struct<class_name:string,x1:double,y1:double,x2:double,y2:double,mask:array<struct<x:double,y:double>>,keypoints:array<struct<x:double,y:double,v:double>>>>"
    dets = [("person", 10.0, 20.0, 110.0, 220.0, None, [(float(k), float(2 * k), [2.0, 0.5, None][k % 3]) for k in range(17)]), ("parcel", 1.0, 2.0, 3.0, 4.0, [(1.0, 2.0), (3.0, 2.0), (3.0, 4.0)], None), (None, None, None, None, None, [(0.0, 0.0), (4.0, 0.0), (4.0, 6.0)], None)]
    items = spark.createDataFrame([(7, "i.png", "S", "C1", dets), (8, None, None, None, None), (9, "x", "S", "C1", [])], f"item_id long, image_path string, session_id string, camera_role string, detections {kind}")
    tasks = reviews.export_review_tasks(items)
    seven = json.loads(tasks.where("item_id = 7").first().task)
    results = seven["predictions"][0]["result"]
    assert results[0]["value"] == {"x": pytest.approx(10 / 6.4), "y": pytest.approx(20 / 3.6), "width": pytest.approx(100 / 6.4), "height": pytest.approx(200 / 3.6), "rectanglelabels": ["person"]}
    assert results[1]["parentID"] == "box-0" and results[1]["meta"] == {"coco_index": 0, "visibility": 2.0} and results[1]["score"] == 1.0
    back = {r.instance: r for r in reviews.import_review_tasks(tasks.unionByName(spark.createDataFrame([(1, "{broken")], "item_id long, task string"))).collect()}
    assert len(back) == 3
    person, parcel, other = (back[k] for k in sorted(back))
    assert (person.x1, person.y1, person.x2, person.y2) == pytest.approx((10, 20, 110, 220)) and len(person.keypoints) == 17 and person.keypoint_indices == list(range(17)) and [p.v for p in person.keypoints][:3] == [2.0, 0.5, 2.0]
    assert [(round(p.x, 6), round(p.y, 6)) for p in parcel.mask] == [(1.0, 2.0), (3.0, 2.0), (3.0, 4.0)] and parcel.class_name == "parcel"
    assert (other.class_name, other.x1, other.y1, round(other.x2, 6), round(other.y2, 6)) == ("parcel", 0.0, 0.0, 4.0, 6.0)


def test_documents_are_parsed_once(spark, sf):
    """The import reads parsed rows that were written, and the parser stands once in the plan that writes them."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    tasks = reviews.export_review_tasks(checks_plan._reviewed(spark, sf))
    assert "from_json" not in plan(reviews.import_review_tasks(tasks)) and plan(reviews._results(tasks, "task")).count("from_json") == 1
    images = cvat.parse_cvat(spark.createDataFrame([("<image/>",)], "xml string").selectExpr("upper(xml) AS xml"))
    assert "from_xml" not in plan(cvat.import_cvat(images)) and plan(images).count("from_xml") == 1


def test_replay_and_history(spark, tmp_path):
    lines = ['{"frame_index": 3, "timestamp_global": 1.5, "tracks": [{"backend_track_id": 1, "bbox": [0, 1, 2, 3], "ground_truth_id": "p"}]}', "", '{"timestamp_global": 2.0, "tracks": []}', '{"timestamp_global": 2.0, "tracks": {"a": 1}}', "{broken", '{"tracks": []}']
    (tmp_path / "replay.jsonl").write_text("\n".join(lines))
    tracks, rejects = reviews.read_replay(spark, str(tmp_path / "replay.jsonl"))
    assert [(r.frame_index, r.backend_track_id, r.ground_truth_id, r.x2) for r in tracks.orderBy("timestamp_global").collect()] == [(3, 1, "p", 2.0), (2, None, None, None)]
    assert rejects.count() == 3
    history = spark.createDataFrame([("t1", "S", 0.1 * k, k) for k in range(5)] + [("t2", "S", 0.0, 0)], "tracklet_id string, session_id string, timestamp_global double, frame_index long")
    reviews.write_track_history(history, str(tmp_path / "history"))
    assert reviews.read_track_history(spark, str(tmp_path / "history"), ["t1"]).count() == 5 and reviews.read_track_history(spark, str(tmp_path / "history")).count() == 6


def test_projection(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((5, 4))
    rows = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(9, None), (10, [0.0] * 4)], "vec_id long, embedding array<double>")
    down, up, bias, matrix = rng.standard_normal((2, 4)), rng.standard_normal((4, 2)), rng.standard_normal(4), rng.standard_normal((3, 4))
    for head, plain in (({"down": down, "up": up, "bias": bias}, x + np.tanh(x @ down.T) @ up.T + bias), ({"matrix": matrix}, x @ matrix.T), ({}, x)):
        found = {r.vec_id: r.embedding for r in handoffs.project_embeddings(rows, head).collect()}
        want = plain / np.linalg.norm(plain, axis=1, keepdims=True)
        assert found[9] is None and all(np.allclose(found[k], want[k]) for k in range(5))
    with pytest.raises(Exception, match="length is not 4"):
        handoffs.project_embeddings(rows.union(spark.createDataFrame([(11, [1.0])], rows.schema)), {"matrix": matrix}).collect()


def test_lines(spark):
    row = spark.sql("SELECT 0D AS x1, 0D AS y1, 64D AS x2, 36D AS y2, array(named_struct('x', 0D, 'y', 0D), named_struct('x', 64D, 'y', 0D), named_struct('x', 64D, 'y', 36D), named_struct('x', double('NaN'), 'y', 1D)) AS mask, transform(sequence(0, 16), i -> named_struct('x', 64D, 'y', 36D, 'v', i / 20D)) AS keypoints")
    out = row.select(reviews.segmentation_line(F.lit(2), F.col("mask")).alias("s"), reviews.pose_line(F.lit(0), F.col("keypoints")).alias("p"), reviews.segmentation_line(F.lit(2), F.slice("mask", 1, 2)).alias("none")).first()
    assert out.s == "2 0.000000 0.000000 0.100000 0.000000 0.100000 0.100000" and out.none is None
    assert out.p.split(" ")[:5] == ["0", "0.050000", "0.050000", "0.100000", "0.100000"] and out.p.split(" ")[7::3] == ["0"] + ["1"] * 10 + ["2"] * 6


def test_distortion_is_taken_out_once_a_row(spark, sf):
    """Both coordinates and all that is made of them come from one call; a point without a value stays null."""
    plan = calibration_plan.pf6_lens_to_image(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("_straight(") == 1 and "aggregate(" not in plan
    rows = spark.sql("SELECT * FROM VALUES (1, 100D, 50D), (2, NULL, 50D), (3, double('NaN'), 50D) AS t(k, x, y)")
    camera, lens = F.expr("array(600D, 0.5D, 320D, 0D, 580D, 180D, 0D, 0D, 1D)"), F.expr("array(-0.21D, 0.06D, 0.001D, -0.0007D, -0.004D)")
    ux, uy = calibration.undistorted(F.col("x"), F.col("y"), camera, lens)
    flat = rows.withColumns({"ux": ux, "uy": uy})
    bx, by = calibration.distorted(F.col("ux"), F.col("uy"), camera, lens)
    one, two, three = flat.withColumns({"bx": bx, "by": by}).orderBy("k").collect()
    assert (one.bx, one.by) == (pytest.approx(100, abs=1e-6), pytest.approx(50, abs=1e-6)) and abs(one.ux - 100) > 1
    assert two.ux is None and math.isnan(three.ux)


def test_poses_are_checked_in_one_pass(spark, sf):
    """Rules of instances and of points come from one reading of the rows, whose points are made once."""
    plan = checks_plan.dq10_validate_pose(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and plan.count("transform(sequence") == 1
