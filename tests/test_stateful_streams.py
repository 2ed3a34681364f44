"""Stateful streams give what their batch twins give, whatever the micro-batches."""

import pytest
from pyspark.sql import functions as F
from test_identities import LIMITS, SCENES as TRACKS
from test_parcels import scene_tables

from loomtrack.operators import identities as ids, parcels, sessions as ops
from loomtrack.operators.frames import tag_zones, track_velocity, zone_kind
from loomtrack.plans import sessions
from loomtrack.streaming import stateful


def play(spark, rows, build, folder, by, ends=True):
    """Writes ``rows`` in files by the column ``by`` and runs the stream ``build`` makes of them, a file at a time.

    A stream that waits by the clock never ends by itself; it is stopped once all is read and the time is up.
    """
    for k, (value,) in enumerate(sorted(rows.select(by).distinct().collect())):
        rows.where(F.col(by) == value).coalesce(1).write.parquet(f"{folder}/in/part={k}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    found = []
    writer = build(stream).writeStream.foreachBatch(lambda df, _: found.extend(df.collect())).outputMode("append").option("checkpointLocation", f"{folder}/state")
    query = (writer.trigger(availableNow=True) if ends else writer).start()
    if ends:
        query.awaitTermination(240)
    else:
        query.awaitTermination(30)
        query.stop()
    assert query.exception() is None and (not ends or not query.isActive)
    return found


def test_identities(spark, tmp_path):
    tracks, frames = [], []
    for name in ("relink", "merge", "ambiguous"):
        for k, (t, boxes) in enumerate(TRACKS[name]):
            frames.append((name, "cam", 0, k, t))
            tracks += [(name, "cam", 0, k, t, *b) for b in boxes]
    frames += [("relink", "cam", 1, 0, 9.0)]
    tracks += [("relink", "cam", 1, 0, 9.0, 42, "parcel", 100.0, 100.0, 124.0, 120.0)]
    place = "session_id string, source_id string, stream_epoch int, frame_index long, timestamp_global double"
    rows = ids.identity_input(spark.createDataFrame(tracks, f"{place}, backend_track_id long, class_name string, x1 double, y1 double, x2 double, y2 double"), spark.createDataFrame(frames, place), 1000.0, 500.0)
    rows = rows.withColumn("event_time", F.timestamp_micros((F.col("timestamp_global") * 1e6 + 1e12).cast("long")))
    found = play(spark, rows, lambda s: stateful.stream_identities(s.withWatermark("event_time", "10 seconds"), LIMITS), tmp_path, "timestamp_global")
    batch = ids.canonical_identities(rows, LIMITS).where("kind <> 'tracklet'").collect()
    told = lambda r, number: (r.session_id, r.stream_epoch, r.frame_index, r.kind, r.event, number, r.backend_track_id, r.status)
    want = {told(r, r.local_track_id) for r in batch if r.event != "LOCAL_TRACK_FINALIZED"}
    assert {told(r, r.number) for r in found if r.kind != "tracklet" and r.event != "LOCAL_TRACK_FINALIZED"} == want
    assert [(r.number, r.n_observations, r.relinks) for r in found if r.kind == "tracklet" and r.session_id == "relink"] == [(1, 3, 1)]


@pytest.fixture
def store(spark):
    before = {k: spark.conf.get(k) for k in stateful.STORE}
    for k, v in stateful.STORE.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_parcel_states(spark, tmp_path, store):
    obs, wrists, zones = scene_tables(spark)
    tagged = zone_kind(tag_zones(track_velocity(obs.where("class_name = 'parcel'")), zones), zones).select("session_id", "frame_index", F.col("local_track_id").alias("parcel_id"), "zone_id", "zone_kind", F.hypot(F.col("vx") / 1000, F.col("vy") / 500).alias("speed"))
    rows = parcels.match_input(obs, wrists, zones, 1000.0, 500.0).join(tagged, ["session_id", "frame_index", "parcel_id"], "left").withColumn("turn", F.floor(F.col("frame_index") / 3))
    rows = rows.withColumn("event_time", F.timestamp_micros((F.col("timestamp_global") * 1e6 + 1e12).cast("long")))
    found = play(spark, rows, lambda s: stateful.stream_parcel_states(s.withWatermark("event_time", "10 seconds")), tmp_path, "turn")
    matches = parcels.interaction_matches(parcels.match_input(obs, wrists, zones, 1000.0, 500.0))
    batch = parcels.parcel_state_machine(obs, matches, zones, 1000.0, 500.0).collect()
    told = lambda r: (r.session_id, r.parcel_id, r.at, r.event_type, r.state, r.operator_id, r.destination_zone)
    assert sorted(map(str, map(told, found))) == sorted(map(str, map(told, batch))) and len(batch) > 10


def test_parcel_states_are_forgotten(spark, tmp_path, store):
    """Forty parcels pass one after the other, a minute apart: the state holds those of the last ten minutes, not all."""
    rows = [("s", "cam", 0, k, 60.0 * k, k, 7, 0.01, True, 1.0, True, False, "pick", "pick", 0.1, k // 8) for k in range(40)]
    columns = "session_id string, source_id string, stream_epoch int, frame_index long, timestamp_global double, parcel_id long, person_id long, distance double, overlap boolean, motion double, pick boolean, doubt boolean, zone_id string, zone_kind string, speed double, turn int"
    df = spark.createDataFrame(rows, columns).withColumn("event_time", F.timestamp_seconds(F.col("timestamp_global") + 1e9))
    sizes = []

    def build(stream):
        return stateful.stream_parcel_states(stream.withWatermark("event_time", "1 seconds"), remember=600.0)

    for k, (value,) in enumerate(sorted(df.select("turn").distinct().collect())):
        df.where(F.col("turn") == value).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    query = build(stream).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(240)
    for progress in query.recentProgress:
        sizes.append(sum(op["numRowsTotal"] for op in progress["stateOperators"]))
    assert query.exception() is None and sizes and max(sizes) < 40 * 5 and sizes[-1] <= max(sizes)
    operators = spark.read.format("statestore").option("operatorId", 1).option("stateVarName", "operators").load(f"{tmp_path}/state").count()
    lives = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "life").load(f"{tmp_path}/state").count()
    assert 0 < operators <= 20 and 0 < lives <= 20, (operators, lives)


def test_admissions(spark, sf, tmp_path, store):
    """In three batches as in one, with bad ids, wrong sessions, old epochs and late results."""
    results, active = sessions._requested(spark, sf)
    rows = results.where("arrival < 1500").withColumn("turn", F.floor(F.col("arrival") / 500)).coalesce(1).cache()
    found = play(spark, rows, lambda s: stateful.stream_admissions(s, active), tmp_path, "turn")
    want = {(r.source_id, r.arrival): r.verdict for r in ops.admit_screened(rows, active).collect()}
    assert {(r.source_id, r.arrival): r.verdict for r in found} == want and len(set(want.values())) == 5
    for source, verdict in {(r.source_id, r.verdict) for r in found}:
        n = sum(s == source and v == verdict for (s, _), v in want.items())
        assert max(r.so_far for r in found if (r.source_id, r.verdict) == (source, verdict)) == n


def test_pending_rules():
    pending = stateful.Pending()
    assert pending.add("later", "C:C2", 3.1, 100.0) == [] and pending.add("earlier", "C:C2", 3.0, 100.3) == [] and pending.add("later", "C:C2", 9.0, 100.3) == []
    assert pending.ready(100.4) == [] and pending.ready(100.8) == ["earlier", "later"] and pending.ready(200.0) == []
    bounded = stateful.Pending(1.0, most=2)
    assert [bounded.add(t, "C:C2", e, r) for t, e, r in (("a", 1.0, 10.0), ("b", 2.0, 10.1), ("c", 3.0, 10.2))] == [[], [], ["a"]]
    assert bounded.ready(10.3, force=True) == ["b", "c"]
    closed = stateful.Pending()
    closed.add("old", "C:C2", 1.0, 50.0), closed.add("new", "C:C3", 2.0, 50.0)
    assert closed.ready(50.1) == ["old"]  # the session has moved on, the other link has not


def test_pending_stream(spark, tmp_path):
    rows = spark.createDataFrame([("s", "a", "C:C2", 3.1, 100.0, 0), ("s", "b", "C:C2", 3.0, 100.3, 1), ("s", "b", "C:C2", 3.0, 100.3, 2), ("t", "x", "C:C2", 3.0, 100.3, 2), ("s", "c", "C:C3", 9.0, 100.4, 3)], "session_id string, tracklet_id string, link string, ended_at_global double, clock double, turn int")
    found = play(spark, rows, lambda s: stateful.pending_handoffs(s, clock="clock"), tmp_path, "turn", ends=False)
    assert [(r.session_id, r.batch, r.position, r.tracklet_id) for r in found if r.session_id == "s"][:2] == [("s", 0, 0, "b"), ("s", 0, 1, "a")]
    assert len(found) == len({r.tracklet_id for r in found})


def test_links_of(spark):
    edges = spark.createDataFrame([("C1", "C2"), ("C2", "C3"), ("D1", "D2")], "from_role string, to_role string")
    assert {r.camera_role: r.link for r in stateful.links_of(edges).collect()} == {"C1": "C1:C1", "C2": "C1:C2", "C3": "C1:C3", "D1": "D1:D1", "D2": "D1:D2"}
