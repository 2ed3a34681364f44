"""Parcels followed batch by batch: later evidence, restarts, and a snapshot that stays small."""

import os

import pytest
from pyspark.sql import functions as F

from loomtrack.operators import association
from loomtrack.streaming import stateful

TRACKS = "session_id string, tracklet_id string, camera_role string, started_at_global double, ended_at_global double, local_track_id long, avg_w double, avg_h double, avg_vx double, avg_vy double, first_zone_id string, last_zone_id string, integrity_status string, vec_id long"


def track(name, role, start, end, w=12.0, vec=None, session="S"):
    return (session, name, role, start, end, 1, w, 10.0, 1.0, 0.0, None, None, "STABLE", vec)


@pytest.fixture(scope="module")
def site(spark):
    edges = spark.createDataFrame([("C1", "C2", 0.5, 5.0), ("C2", "C3", 0.5, 5.0)], "from_role string, to_role string, min_transit_s double, max_transit_s double")
    zones = spark.createDataFrame([], "zone_id string, kind string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.7, 0.7])], "vec_id long, embedding array<double>")
    rows = [track("a", "C1", 0.0, 1.0, vec=1), track("b", "C1", 0.0, 1.0, 12.1, vec=2), track("in", "C2", 2.5, 3.0, 12.05, vec=3), track("late", "C3", 4.0, 4.5, vec=1)]
    rows += [track(f"x{k}", "C1", 1000.0 + 100 * k, 1001.0 + 100 * k, session="T") for k in range(4)] + [track(f"y{k}", "C2", 1003.0 + 100 * k, 1004.0 + 100 * k, session="T") for k in range(4)]
    return spark.createDataFrame(rows, TRACKS), edges, zones, vectors


def empty(spark, tracklets):
    shaped = tracklets.withColumns({"camera_id": F.col("camera_role"), "parcel_id": F.lit(None).cast("string")})
    return shaped, association.Site(shaped.limit(0), spark.createDataFrame([], association.HYPOTHESES))


def test_an_unclear_handoff_is_settled_by_a_later_camera(spark, site):
    """Two parcels as like, one tracklet between them; the tracklet after it looks like the first."""
    tracklets, edges, zones, vectors = site
    new, before = empty(spark, tracklets.where("session_id = 'S'"))
    decided, said, after = association.associate(new, before, edges, zones, vectors)
    status = {r.tracklet_id: (r.status, r.parcel_id) for r in decided.collect()}
    assert status["a"] == ("NEW_AT_INGRESS", "g:a") and status["in"] == ("AMBIGUOUS", None)
    assert [(r.later_id, r.outcome, r.outgoing_id, r.new_chain) for r in said.collect()] == [("late", "RESOLVED", "a", ["a", "in"])]
    # the parcel has moved to ``in`` before the last wave is matched, so it goes on to ``late``
    assert status["late"] == ("MATCHED", "g:a")
    assert {r.tracklet_id: r.parcel_id for r in after.tracklets.collect()} == {"a": "g:a", "b": "g:b", "in": "g:a", "late": "g:a"}
    assert {r.hypothesis_id: r.status for r in after.hypotheses.collect()} == {"h:in": "RESOLVED"}
    assert association.forget(after, 60.0).hypotheses.count() == 0


def test_snapshots_forget(spark, site):
    tracklets, *_ = site
    known, _ = empty(spark, tracklets.where("session_id = 'T'"))
    known = known.withColumn("parcel_id", F.when(F.col("tracklet_id").isin("x0", "y3"), "p"))
    h = spark.createDataFrame([("h1", "T", "y0", "PENDING", [("x1", 0.5)], None, 9e9), ("h2", "T", "x2", "PENDING", [("x2", 0.5)], None, 1100.0), ("h3", "T", "x2", "RESOLVED", [], None, 9e9)], association.HYPOTHESES)
    kept = association.forget(association.Site(known, h), 50.0)
    # the newest, its parcel's older tracklet, and those that an open hypothesis names
    assert {r.tracklet_id for r in kept.tracklets.collect()} == {"x3", "y3", "x0", "y0", "x1"} and {r.hypothesis_id for r in kept.hypotheses.collect()} == {"h1"}


def test_stream_restarts_from_its_snapshot(spark, site, tmp_path):
    tracklets, edges, zones, vectors = site
    turns = [["a", "b", "x0"], ["in", "y0"], ["late"]]
    session = {r.tracklet_id: r.session_id for r in tracklets.collect()}

    def run(k):
        spark.createDataFrame([(session[t], t) for t in turns[k]], "session_id string, tracklet_id string").coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
        ready = spark.readStream.schema("session_id string, tracklet_id string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        query = stateful.write_handoffs(ready, tracklets, edges, zones, f"{tmp_path}/out", f"{tmp_path}/check", vectors, remember=150.0)
        query.awaitTermination(400)
        assert query.exception() is None

    run(0)
    run(1)
    # as if the driver had died after writing its tables but before the commit: the batch is done again, from the same snapshot
    commits = f"{tmp_path}/check/commits"
    for name in os.listdir(commits):
        if name.strip(".").split(".")[0] == "1":
            os.remove(f"{commits}/{name}")
    run(2)
    read = lambda name: spark.read.option("basePath", f"{tmp_path}/out/{name}").parquet(f"{tmp_path}/out/{name}")
    decided = {r.tracklet_id: (r.status, r.parcel_id) for r in read("decisions").collect()}
    assert len(decided) == read("decisions").count() == 6
    assert decided["in"][0] == "AMBIGUOUS" and decided["late"] == ("MATCHED", "g:a") and decided["y0"] == ("MATCHED", "g:x0")
    assert [(r.later_id, r.outcome) for r in read("evidence").collect()] == [("late", "RESOLVED")]
