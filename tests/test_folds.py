"""The ordered folds on small tables with known answers."""


from loomtrack.operators import folds

PLACE = "session_id string, source_id string, stream_epoch int, frame_index long"


def test_greedy_tracks(spark):
    box = lambda x: (float(x), 0.0, float(x) + 20, 20.0)
    rows = [("S", "C", 0, 0, 0, "parcel", *box(0)), ("S", "C", 0, 0, 1, "parcel", *box(100)), ("S", "C", 0, 1, 0, "parcel", *box(105)), ("S", "C", 0, 1, 1, "person", *box(0))]
    rows += [("S", "C", 0, 2, 0, "parcel", *box(2)), ("S", "C", 1, 3, 0, "parcel", *box(2))] + [("S", "C", 0, k, 0, "parcel", *box(500)) for k in range(3, 11)] + [("S", "C", 0, 11, 0, "parcel", *box(2))]
    dets = spark.createDataFrame(rows, f"{PLACE}, obs_index int, class_name string, x1 double, y1 double, x2 double, y2 double")
    found = {(r.stream_epoch, r.frame_index, r.obs_index): r.track_id for r in folds.greedy_iou_tracks(dets.repartition(3)).collect()}
    assert (found[0, 0, 0], found[0, 0, 1]) == (1, 2)
    assert (found[0, 1, 0], found[0, 1, 1]) == (2, 3)  # the person is no parcel
    assert found[0, 2, 0] == 1 and found[1, 3, 0] == 1  # a new epoch starts anew
    assert {found[0, k, 0] for k in range(3, 11)} == {4} and found[0, 11, 0] == 5  # unseen for too long
    assert folds.greedy_iou_tracks(dets.limit(0)).count() == 0


def test_segments(spark):
    rows = [("S", "C", e, k, t) for e, k, t in ((0, 0, 0.0), (0, 1, 59.9), (0, 2, 60.0), (0, 3, 130.0), (1, 0, 131.0), (1, 1, 132.0))] + [("S", "D", 0, 0, 5.0)]
    found = {(r.source_id, r.stream_epoch, r.frame_index): (r.segment, r.position) for r in folds.segment_frames(spark.createDataFrame(rows, f"{PLACE}, timestamp_global double").repartition(3)).collect()}
    assert found == {("C", 0, 0): (0, 0), ("C", 0, 1): (0, 1), ("C", 0, 2): (1, 0), ("C", 0, 3): (2, 0), ("C", 1, 0): (3, 0), ("C", 1, 1): (3, 1), ("D", 0, 0): (0, 0)}


def test_keyframes(spark):
    views = spark.createDataFrame([("t", k, q) for k, q in ((0, 0.5), (1, 0.9), (2, 0.4), (4, 0.8), (7, 0.2), (8, 0.8), (9, 1.0), (10, 0.6), (12, 0.35))] + [("u", 3, 0.1)], "track string, frame_index long, q double")
    views = views.select("track", "frame_index", *(views.q.alias(c) for c in ("confidence", "area", "sharpness", "geometry", "zone", "integrity")))
    found = [(r.track, r.frame_index) for r in folds.keyframes(views.repartition(2), ["track"], most=3).collect()]
    assert sorted(found) == [("t", 4), ("t", 8), ("t", 10)]


def test_scored_frames(spark):
    def make():
        return lambda pdf: pdf.assign(score=pdf["x"] * 2)

    found = folds.score_frames(spark.createDataFrame([(1.5,), (2.0,)], "x double"), make, "x double, score double")
    assert sorted((r.x, r.score) for r in found.collect()) == [(1.5, 3.0), (2.0, 4.0)]
