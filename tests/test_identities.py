"""Canonical identities on small scenes with known answers; image 1000 x 500, least score 0.5."""

import numpy as np
import pytest

from loomtrack.operators import identities as ids

LIMITS = ids.Limits(score=0.50)


def box(backend, x, width=24.0, kind="parcel"):
    return (backend, kind, float(x), 100.0, float(x) + width, 120.0)


#: Scenes: frames of (time, boxes); what must hold is in the tests.
SCENES = {
    "nominal": [(0.0, [box(17, 100)]), (0.1, [box(17, 110)])],
    "irregular": [(t, [box(7, 100 + t * 100)]) for t in (0.0, 0.07, 0.31, 0.46)],
    "relink": [(0.0, [box(17, 100)]), (0.1, [box(17, 110)]), (0.2, []), (0.3, [box(42, 130)])],
    "long_gap": [(0.0, [box(17, 100)]), (1.0, []), (1.1, [box(42, 105)])],
    "impossible": [(0.0, [box(17, 10)]), (0.1, []), (0.2, [box(42, 850)])],
    "global": [(0.0, [box(10, 100, 20), box(20, 500, 42)]), (0.1, []), (0.2, [box(99, 505, 42), box(88, 105, 20)])],
    "ambiguous": [(0.0, [box(1, 390), box(2, 590)]), (0.1, []), (0.2, [box(3, 490)])],
    "returned": [(0.0, [box(5, 100)]), (0.2, []), (0.3, [box(5, 120)])],
    "merge": [(0.0, [box(1, 100), box(2, 260, 46)]), (0.1, [box(1, 95, 215)]), (0.2, [box(31, 110), box(32, 250, 46)])],
    "unclear_split": [(0.0, [box(1, 200, 30), box(2, 270, 30)]), (0.1, [box(9, 195, 110)]), (0.2, [box(10, 230, 30), box(11, 240, 30)])],
    "three": [(0.0, [box(1, 100), box(2, 150), box(3, 200)]), (0.1, [box(7, 95, 155)])],
    "close": [(0.0, [box(1, 100, 40), box(2, 135, 40)]), (0.1, [box(1, 105, 40), box(2, 140, 40)])],
    "missed": [(0.0, [box(1, 100, 35), box(2, 142, 35)]), (0.1, [box(1, 110, 35)])],
    "context": [(0.0, [box(1, 100, kind="person"), box(2, 300)]), (0.1, [box(1, 800, kind="person"), box(2, 300)])],
}


@pytest.fixture(scope="module")
def logs(spark):
    """All scenes as sessions of one table, folded by one job; scene ``nominal`` has a second epoch."""
    tracks, frames = [], []
    for name, scene in [*SCENES.items(), ("nominal", [(5.0, [box(17, 100)])])]:
        epoch = int(scene[0][0] == 5.0)
        for k, (t, boxes) in enumerate(scene):
            frames.append((name, "cam", epoch, k, t))
            tracks += [(name, "cam", epoch, k, t, *b) for b in boxes]
    place = "session_id string, source_id string, stream_epoch int, frame_index long, timestamp_global double"
    rows = ids.identity_input(spark.createDataFrame(tracks, f"{place}, backend_track_id long, class_name string, x1 double, y1 double, x2 double, y2 double"), spark.createDataFrame(frames, place), 1000.0, 500.0)
    log = ids.canonical_identities(rows, LIMITS)
    out = {}
    for r in log.orderBy("session_id", "stream_epoch", "frame_index").collect():
        out.setdefault(r.session_id, []).append(r)
    return out, log


def seen(rows, frame, epoch=0):
    return {r.backend_track_id: r for r in rows if r.kind == "observation" and r.frame_index == frame and r.stream_epoch == epoch}


def events(rows):
    return [r.event for r in rows if r.kind == "event"]


def test_known_ids_stay(logs):
    out, _ = logs
    nominal = out["nominal"]
    assert seen(nominal, 0)[17].local_track_id == seen(nominal, 1)[17].local_track_id == 1
    assert seen(nominal, 1)[17].vx == pytest.approx(100.0)
    assert seen(nominal, 0, 1)[17].local_track_id == 2  # numbers go on in the next epoch
    assert len({r.local_track_id for r in out["irregular"] if r.kind == "observation"}) == 1
    assert [r.status for r in seen(out["returned"], 2).values()] == ["RECOVERED"] and len([r for r in out["returned"] if r.kind == "tracklet"]) == 1
    people = {r.local_track_id for r in out["context"] if r.kind == "observation" and r.reason == "CONTEXT"}
    assert len(people) == 1


def test_relinks(logs):
    out, _ = logs
    relinked = seen(out["relink"], 3)[42]
    assert (relinked.local_track_id, relinked.status) == (seen(out["relink"], 0)[17].local_track_id, "RECOVERED") and "BACKEND_ID_RELINKED" in events(out["relink"])
    gap = out["long_gap"]
    assert [r.at for r in gap if r.kind == "tracklet" and r.reason == "OCCLUSION_TIMEOUT"] == [1.0]
    assert seen(gap, 2)[42].local_track_id != seen(gap, 0)[17].local_track_id
    assert seen(out["impossible"], 2)[42].local_track_id != seen(out["impossible"], 0)[17].local_track_id
    first, last = seen(out["global"], 0), seen(out["global"], 2)
    assert (last[88].local_track_id, last[99].local_track_id) == (first[10].local_track_id, first[20].local_track_id)
    doubt = out["ambiguous"]
    assert seen(doubt, 2)[3].status == "AMBIGUOUS" and seen(doubt, 2)[3].local_track_id not in {r.local_track_id for r in seen(doubt, 0).values()} and "IDENTITY_AMBIGUOUS" in events(doubt)


def test_merges(logs):
    out, _ = logs
    merge = out["merge"]
    first, last = seen(merge, 0), seen(merge, 2)
    assert seen(merge, 1) == {} and "SPLIT_RESOLVED" in events(merge)
    assert (last[31].local_track_id, last[32].local_track_id) == (first[1].local_track_id, first[2].local_track_id)
    unclear = out["unclear_split"]
    assert all(r.status == "AMBIGUOUS" for r in seen(unclear, 2).values()) and len(seen(unclear, 2)) == 2 and "IDENTITY_AMBIGUOUS" in events(unclear)
    assert {r.local_track_id for r in seen(unclear, 0).values()}.isdisjoint({r.local_track_id for r in seen(unclear, 2).values()})
    assert seen(out["three"], 1) == {} and [len(r.local_track_ids) for r in out["three"] if r.event == "MERGE_STARTED"] == [3]
    assert {r.local_track_id for r in seen(out["close"], 0).values()} == {r.local_track_id for r in seen(out["close"], 1).values()}
    assert "MERGE_STARTED" not in events(out["close"]) + events(out["missed"])
    assert seen(out["missed"], 1)[1].local_track_id == seen(out["missed"], 0)[1].local_track_id


def test_tracklets_and_empty(logs, spark):
    out, log = logs
    found = {r.session_id: r for r in ids.identity_tracklets(log).where("session_id IN ('relink', 'returned')").collect()}
    assert (found["relink"].relinks, found["relink"].n_observations, sorted(found["relink"].backends)) == (1, 3, [17, 42])
    assert found["relink"].tracklet_id == "relink-cam-1-0"
    place = "session_id string, source_id string, stream_epoch int, frame_index long, timestamp_global double, backend_track_id long, class_name string, x1 double, y1 double, x2 double, y2 double"
    assert ids.canonical_identities(ids.identity_input(spark.createDataFrame([], place))).count() == 0


def test_assignment_in_parts_is_that_of_the_whole():
    """Parts and favourites give the pairs of one solution over all rows; cells below the least score never pair."""
    rng = np.random.default_rng(5)
    for n in range(400):
        scores = np.where(rng.random((n % 6 + 1, n % 5 + 1)) < 0.5, rng.random((n % 6 + 1, n % 5 + 1)), -np.inf)
        whole = ids._solve(np.where(scores >= 0.55, scores - 0.55 + 1e-12, 0.0))
        found = ids._assign(scores, ids.Limits())
        assert [(i, j) for i, (j, _) in found.items()] == whole
        for i, (j, clear) in found.items():
            rivals = [v for k, v in np.ndenumerate(scores) if (k[0] == i) != (k[1] == j) and v > -np.inf]
            assert clear == (not rivals or scores[i, j] - max(rivals) >= 0.10)


def test_long_keys_get_tasks_of_their_own(spark):
    """A fold's shuffle has a fixed number of parts, and frames without a box need no join."""
    rows = spark.createDataFrame([("s", "c", 0, k, float(k), 1, "parcel", 0.0, 0.0, 9.0, 9.0) for k in range(3)], "session_id string, source_id string, stream_epoch int, frame_index long, timestamp_global double, backend_track_id long, class_name string, x1 double, y1 double, x2 double, y2 double")
    given = ids.identity_input(rows, rows)
    assert "Join" not in given._jdf.queryExecution().optimizedPlan().toString()
    folded = ids.fold_frames(given, ["session_id", "source_id", "stream_epoch"], ["frame_index"], ids.INPUT, ids.Epoch, ids.OUTPUT)
    assert "REPARTITION_BY_NUM" in folded._jdf.queryExecution().executedPlan().toString()
    assert folded.where("kind = 'observation'").count() == 3
