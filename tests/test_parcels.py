"""Operators and parcels on small scenes with known answers; image 1000 x 500."""

import random

import pytest
from pyspark.sql import functions as F

from loomtrack.operators import parcels

FRAME = "session_id string, source_id string, stream_epoch int, frame_index long, timestamp_global double"
PICKED_UP = [(round(0.1 * k, 2), [(1, 100 + 2.0 * k)], [(7, 80 + 2.0 * k, 120 + 2.0 * k)]) for k in range(8)]
#: Scenes: frames of (time, parcels (id, x), persons (id, x, wrist x)).
SCENES = {
    "one": [(0.0, [(1, 100)], [(7, 80, 120)])],
    "two": [(0.0, [(1, 100), (2, 680)], [(7, 70, 120), (8, 650, 700)])],
    "wrist": [(0.0, [(1, 100)], [(7, 20, 120), (8, 95, 400)])],
    "transient": [(0.0, [(1, 98)], [(7, 78, 118)]), (0.1, [(1, 100)], [(7, 80, 120)]), (0.2, [(1, 102)], [(7, 82, 122)]), (0.25, [(1, 103)], [(7, 83, 400)])],
    "doubt": PICKED_UP,
    "carried": PICKED_UP,
    "whole": PICKED_UP + [(0.8, [], [(7, 90, 130)]), (0.9, [(1, 600)], [(7, 570, 620)]), (0.95, [(1, 600)], [(7, 570, 620)])] + [(t, [(1, 600)], [(7, 570, 760)]) for t in (1.0, 1.1, 1.35)],
}


def scene_tables(spark):
    boxes, wrists = [], []
    for name, scene in SCENES.items():
        for k, (t, goods, people) in enumerate(scene):
            place = (name, "cam", 0, k)
            boxes += [(*place, t, "C1", i, "parcel", float(x), 150.0, x + 40.0, 190.0, "AMBIGUOUS" if name == "doubt" else "STABLE") for i, x in goods]
            boxes += [(*place, t, "C1", i, "person", float(x), 50.0, x + 80.0, 350.0, "STABLE") for i, x, _ in people]
            wrists += [(*place, i, "left", float(w), 170.0) for i, _, w in people]
    obs = spark.createDataFrame(boxes, f"{FRAME}, camera_role string, local_track_id long, class_name string, x1 double, y1 double, x2 double, y2 double, identity_status string")
    hands = spark.createDataFrame(wrists, "session_id string, source_id string, stream_epoch int, frame_index long, person_id long, side string, wx double, wy double")
    zones = spark.createDataFrame([(0, "C1", "pick", "pick", 2.0, 0.0, 500.0, 500.0), (1, "C1", "dest-A", "destination", 550.0, 0.0, 1000.0, 500.0)], "position int, camera_role string, zone_id string, kind string, x1 double, y1 double, x2 double, y2 double")
    return obs, hands, zones


@pytest.fixture(scope="module")
def scenes(spark):
    obs, wrists, zones = scene_tables(spark)
    found = parcels.interaction_matches(parcels.match_input(obs, wrists, zones, 1000.0, 500.0)).cache()
    events = parcels.parcel_state_machine(obs, found, zones, 1000.0, 500.0).orderBy("at").collect()
    matches, told = {}, {}
    for r in found.collect():
        matches.setdefault(r.session_id, []).append(r)
    for r in events:
        told.setdefault(r.session_id, []).append(r)
    return matches, told


def test_matches(scenes):
    matches, _ = scenes
    (one,) = matches["one"]
    assert (one.person_id, one.reliable, one.contact) == (7, True, True)
    assert {(m.parcel_id, m.person_id) for m in matches["two"]} == {(1, 7), (2, 8)}
    assert [m.person_id for m in matches["wrist"]] == [7]
    assert all(not m.reliable and m.reasons == ["PARCEL_IDENTITY_AMBIGUOUS"] for m in matches["doubt"])


def test_life_of_a_parcel(scenes):
    _, told = scenes
    kinds = lambda name: [e.event_type for e in told.get(name, [])]
    assert kinds("transient") == ["pickup_candidate", "pickup_cancelled"]
    assert kinds("carried") == ["pickup_candidate", "parcel_picked", "parcel_carried"]
    assert (told["carried"][-1].state, told["carried"][-1].operator_id) == ("CARRIED", 7)
    assert kinds("doubt") == ["interaction_ambiguous"]
    whole = told["whole"]
    assert [e.event_type for e in whole] == ["pickup_candidate", "parcel_picked", "parcel_carried", "parcel_carried_shadow", "parcel_reappeared", "destination_observed", "drop_candidate", "destination_confirmed", "parcel_dropped"]
    assert whole[3].at == 0.8 and (whole[-1].state, whole[-1].destination_zone, whole[-1].at) == ("DROPPED", "dest-A", 1.35)


@pytest.mark.parametrize("seed", range(40))
def test_frames_that_say_nothing_may_be_left_out(seed):
    """A life folded over all frames, and over those that ``parcel_state_machine`` keeps, gives the same events."""
    rng = random.Random(seed)
    rows, mood = [], {"sure": False, "lift": False, "carry": False, "rest": False, "frozen": False, "visible": True}
    for k in range(300):
        for name in mood:
            if rng.random() < 0.15:
                mood[name] = rng.random() < (0.85 if name == "visible" else 0.1 if name == "frozen" else 0.6)
        sure = mood["sure"] and not mood["frozen"]
        person = rng.choice([7, 7, 7, 8]) if sure or mood["rest"] else rng.choice([None, 7])
        flags = (sure and mood["lift"], sure and (mood["lift"] or mood["carry"]), mood["rest"] and person is not None)
        rows.append((0.05 * k, True, "z", person, 0.5, mood["frozen"], sure, *flags) if mood["visible"] else None)
    every, kept, before = parcels.Life(), parcels.Life(), None
    told, short = [], []
    for k, row in enumerate(rows):
        if row is None:
            if k and rows[k - 1] is not None:
                gone = (0.05 * k, False, *[None] * 8)
                told += every.frame([gone])
                short += kept.frame([gone])
            continue
        told += every.frame([row])
        says = row[6] or row[9]
        if before is None or says or before[0] or before[1] != row[5]:
            short += kept.frame([row])
        before = (says, row[5])
    assert told == short and parcels.Life(every.kept()).kept() == every.kept()
    assert len({e[1] for e in told}) >= 1


def test_empty(spark):
    obs, wrists, zones = scene_tables(spark)
    none = obs.where(F.lit(False))
    assert parcels.interaction_matches(parcels.match_input(none, wrists.limit(0), zones)).count() == 0
