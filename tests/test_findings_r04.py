"""What the findings of the fourth round were about, on small tables."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtrack.operators import handoffs, parcels
from loomtrack.operators import identities as ids
from loomtrack.plans import checks as check_plans
from loomtrack.plans import stateful
from loomtrack.plans.labels import wrists_of
from loomtrack.sources import cvat, reviews
from loomtrack.sources import fixtures as fx
from test_cvat import ITEMS
from test_parcels import scene_tables


def test_a_box_meets_a_hidden_track_once_a_frame(monkeypatch):
    """Boxes that stay unlinked are not scored again when they become tracks, and the solver gets one row for each member of the smaller side."""
    rng, scored, solved = random.Random(3), [], []
    plain, matching = ids.continuities, ids.Matching
    monkeypatch.setattr(ids, "continuities", lambda t, boxes, *a: scored.extend((t.number, s.backend) for s in boxes) or plain(t, boxes, *a))
    monkeypatch.setattr(ids, "Matching", lambda gains: solved.append((len(gains), len({k for g in gains for k in g}))) or matching(gains))
    epoch, created = ids.Epoch(), 0
    for k in range(300):
        boxes = [(k * 0.125, 1000 * k + n, "parcel", x, y, x + 40.0, y + 30.0, x + 20.0, y + 30.0, (x + 20) / 640, (y + 30) / 360, None, None) for n in range(3) for x, y in [(rng.uniform(0, 600), rng.uniform(0, 300))]]
        scored.clear()
        created += sum(r[2] == "LOCAL_TRACK_CREATED" for r in epoch.frame(boxes))
        assert len(scored) == len(set(scored))
    assert created > 300 and solved and all(few <= many for few, many in solved)


def test_frames_without_a_box_need_no_second_scan(spark, sf):
    """a row without a tracker id says that its frame was there; the input is scanned and aggregated once, and few long keys get many parts."""
    rows = ids.identity_input(stateful._rows(spark, sf))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    place = "session_id string, source_id string, stream_epoch int, frame_index long, timestamp_global double"
    told = spark.createDataFrame([("s", "c", 0, k, k / 4, None if k in (1, 2) else 5, "parcel", 9.0, 9.0, 49.0, 39.0) for k in range(5)], f"{place}, backend_track_id long, class_name string, x1 double, y1 double, x2 double, y2 double")
    boxes = told.where("backend_track_id IS NOT NULL")
    one, two = ids.canonical_identities(ids.identity_input(told)), ids.canonical_identities(ids.identity_input(boxes, told.select(*place.replace(",", "").split()[::2])))
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect())) and one.where("event = 'OCCLUSION_STARTED'").count() == 1
    folded = ids.fold_frames(rows, ["session_id", "source_id", "stream_epoch"], ["frame_index"], ids.INPUT, ids.Epoch, ids.OUTPUT, ids.SPREAD)
    assert folded.rdd.getNumPartitions() == ids.SPREAD * spark.sparkContext.defaultParallelism


def test_small_tables_are_solved_as_large_ones(monkeypatch):
    """the solver without arrays gives the pairs of the one with arrays, ties included."""
    rng = np.random.default_rng(8)
    for k in range(600):
        shape = tuple(rng.integers(1, 8, 2))
        gain = (rng.random(shape) * (rng.random(shape) < 0.6), rng.integers(0, 4, shape) * 0.1, rng.integers(-2, 3, shape) * 0.25)[k % 3]
        found = handoffs._solve(gain)
        with monkeypatch.context() as m:
            m.setattr(handoffs, "SMALL", 0)
            assert handoffs._solve(gain) == found


@pytest.mark.parametrize("odd", [False, True])
def test_scenes_match_as_their_pairs_do(spark, sf, odd):
    """boxes and wrists folded by frame give the matches of the joined pair table; nulls in boxes, wrists and keys included."""
    if odd:
        obs, wrists, zones = scene_tables(spark)
        size = (1000.0, 500.0)
        some = F.when(F.col("frame_index") % 4 != 1, F.col("x2"))
        obs = obs.withColumn("x2", F.when(F.col("class_name") == "person", some).otherwise(F.col("x2"))).withColumn("stream_epoch", F.when(F.col("frame_index") != 6, F.col("stream_epoch")))
        wrists = wrists.withColumn("wy", F.when(F.col("frame_index") != 2, F.col("wy"))).unionByName(wrists.withColumn("person_id", F.lit(None).cast("long")))
    else:
        obs, zones, size = stateful._obs(spark, sf.replace("0.001", "0.01")), fx.zones(spark), (640.0, 360.0)
        wrists = wrists_of(obs)
    shown = lambda df: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())
    want = shown(parcels.interaction_matches(parcels.match_input(obs, wrists, zones, *size)))
    assert shown(parcels.scene_matches(obs, wrists, zones, *size)) == want and len(want) > 20


def test_parcels_and_pairs_are_shuffled_once(spark, sf, monkeypatch):
    """no join over a shuffle is left in the matches or the lives of parcels."""
    obs = stateful._obs(spark, sf)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    matches = stateful._matches(spark, obs)
    joins = [line for line in plan(matches).splitlines() if "Join " in line]
    assert joins and all("broadcast" in line for line in joins), joins
    assert "Window" in plan(matches) and plan(matches).count("RepartitionByExpression") == 1
    tables = {}
    monkeypatch.setattr(parcels, "written", lambda df, name: tables.setdefault(name, df))
    parcels.parcel_state_machine(obs, matches, fx.zones(spark))
    life = plan(tables["parcels-life"])
    assert all("broadcast" in line for line in life.splitlines() if "Join " in line)
    assert life.split("RepartitionByExpression")[1].splitlines()[0].endswith(f", {parcels.parts_of(spark, parcels.SPREAD)}")


def _task(rng, k, odd):
    """A review task with what tools write: shapes without names, points of strangers, lone persons, and, if odd, values of other types."""
    results = []
    for n in range(rng.randrange(6)):
        size = {"original_width": rng.choice([640.0, 100]), "original_height": 360.0}
        label = rng.choice(["person", "parcel"])
        at = lambda: rng.choice([0, 1.5, 40.0, round(rng.uniform(0, 100), 3)])
        results.append({"id": f"box-{n}", "type": "rectanglelabels", **size, "value": {"x": at(), "y": at(), "width": at(), "height": at(), "rectanglelabels": [label]}})
        if rng.random() < 0.5:
            results.append({"id": f"polygon-{n + rng.randrange(2) * 10}", "type": "polygonlabels", **size, "value": {"points": [[at(), at()] for _ in range(rng.randrange(4))], "polygonlabels": [label]}})
        for i in rng.sample(range(17), rng.randrange(4)):
            told = {"score": 0.5} if rng.random() < 0.3 else {"meta": {"coco_index": i, "visibility": rng.choice([0, 1.0, None])}}
            results.append({"id": f"keypoint-{n}-{i}", "parentID": rng.choice([f"box-{n}", "box-77", None]), "type": "keypointlabels", **size, **told, "value": {"x": at(), "y": at(), "keypointlabels": [rng.choice([reviews.KEYPOINTS[i], "tail"])]}})
        if rng.random() < 0.2:
            del results[-1]["id"]
    if odd and results:
        r = rng.choice(results)
        rng.choice([lambda: r.update(value=None), lambda: r.update(type="choices"), lambda: r.update(original_width="640"), lambda: r["value"].update(x=None), lambda: r.update(id=5), lambda: results.append(None), lambda: r["value"].update(extra=1), lambda: r.update(score="high")])()
    task = {"id": rng.choice([f"t{k}"] * 9 + [None]), "data": {"image": "i"}, rng.choice(["annotations", "predictions"]): rng.choice([[{"result": results}]] * 8 + [[], None])}
    return json.dumps(task) + ("}" if odd and rng.random() < 0.05 else "")


@pytest.mark.parametrize("odd", [False, True])
def test_a_task_is_read_whole_as_by_joins(spark, odd):
    """tasks read where they lie give the detections of Spark's parser and joins; those of other types go that way."""
    rng = random.Random(11)
    texts = [_task(rng, k, odd and k % 2 == 0) for k in range(150)] + ["{broken", None, "", "[]", "7"]
    tasks = spark.createDataFrame([(t,) for t in texts], "task string").coalesce(2)
    point = lambda p: None if p is None else tuple(None if v is None else round(v, 9) for v in p)
    shown = lambda df: sorted(str([[point(p) if isinstance(p, tuple) else p for p in v] if isinstance(v, list) else round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())
    want = shown(reviews._joined_detections(tasks, "task"))
    plain, other = reviews.read_documents(tasks, "task", reviews.plain_detections, "test")
    assert shown(reviews.import_review_tasks(tasks)) == want and len(want) > 100
    assert plain.count() > (0.3 if odd else 0.8) * len(want) and other.count() >= 4
    assert reviews.import_review_tasks(tasks).schema.simpleString() == reviews._joined_detections(tasks, "task").schema.simpleString()


def test_plain_tasks_need_no_join(spark, sf):
    """of tasks that the export writes nothing is shuffled after they are read, and no structs are made for a writer."""
    tasks = reviews.export_review_tasks(check_plans._reviewed(spark, sf))
    plan = reviews.import_review_tasks(tasks)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and "named_struct(coco_index" not in tasks._jdf.queryExecution().optimizedPlan().toString()


ODD_IMAGES = (
    '<image id="4" name="x" width="10" height="10"><box label="parcel" xtl="1" ytl="2" xbr="3" ybr="4"/><points label="nose" points="8,9" group_id="7" occluded="1"/></image>',
    '<image id="4" name="a &lt; b" width="1.0" height="1.0">\n<box label="a b" xtl="1.0" ytl="2.0" xbr="3.0" ybr="4.0" group_id="0"/></image>',
    '<image id="5" name="twice" width="1.0" height="1.0"><box label="a" xtl="1.0" ytl="2.0" xbr="3.0" ybr="4.0" group_id="0"/><box label="b" xtl="1.0" ytl="2.0" xbr="3.0" ybr="9.0" group_id="0"/></image>',
    '<image id="6" name="said" width="1.0" height="1.0"><!-- c --><polygon label="a" points="1.0,2.0;5.0,2.0" group_id="3"/></image>', '<image id="7" name="none" width="1.0" height="1.0"/>', "<image broken", "", None,
)


def test_an_image_is_read_whole_as_by_joins(spark):
    """elements read where they lie give the detections of Spark's parser and joins; those in another form go that way."""
    rng = random.Random(12)
    number = lambda: rng.choice([0.0, 1e-5, 3.5, -2.0, round(rng.uniform(0, 600), 2), 1e8])
    some = lambda p, make: make() if rng.random() < p else None
    items = []
    for k in range(120):
        found = []
        for _ in range(rng.randrange(5)):
            box = [number() for _ in range(4)] if rng.random() < 0.6 else [0.0] * 4 if rng.random() < 0.3 else [None] * 4
            mask = some(0.5, lambda: [(number(), number()) for _ in range(rng.randrange(5))])
            found.append((rng.choice(["person", "parcel", None]), *box, mask, some(0.5, lambda: [(number(), number(), rng.choice([0.0, 1.0, 2.0, None])) for _ in range(rng.randrange(20))])))
        items.append((f"i{k}", found))
    texts = cvat.export_cvat(spark.createDataFrame(items, ITEMS)).select(F.to_xml(F.struct("*"), {"rowTag": "image", "attributePrefix": "_", "valueTag": "_VALUE"}).alias("xml"))
    texts = texts.unionByName(spark.createDataFrame([(t,) for t in ODD_IMAGES], "xml string")).localCheckpoint()
    shown = lambda df: sorted(map(str, df.select(cvat.import_cvat(cvat.parse_cvat(texts.limit(0))).columns).collect()))
    want = shown(cvat.import_cvat(cvat.parse_cvat(texts)))
    plain, odd = cvat.read_documents(texts, "xml", cvat.plain_image, "test")
    assert shown(cvat.import_documents(texts)) == want and len(want) > 100
    assert plain.count() > 0.8 * len(want) and 7 <= odd.count() < 40
    assert "Join" not in cvat.import_documents(texts.where("xml LIKE '%name=\"i1%' AND xml LIKE '%</image>%'"))._jdf.queryExecution().optimizedPlan().toString()
