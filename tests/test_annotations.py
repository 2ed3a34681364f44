"""Signals and outcomes of automatic labels on single items."""

from loomtrack.operators import annotations as ops

BOX = (0.9, 100.0, 100.0, 200.0, 200.0)
ITEMS = f"item_id string, source_id string, timestamp_global double, detections array<{ops.DETECTION}>, expected array<string>, instance_count long, annotation_status string, label string"


def detection(name="parcel", box=BOX, track=1, agree=0.9, mask=None, points=None, consistent=None):
    return (name, *box, track, consistent, agree, mask, points)


def run(spark, rows, **options):
    return {r.item_id: r for r in ops.annotate_items(spark.createDataFrame(rows, ITEMS), ["parcel", "person"], **options).collect()}


def test_outcomes(spark):
    item = lambda name, detections, expected=("parcel",), status="NEEDS_REVIEW", label=None, n=1: (name, name, 0.0, detections, list(expected), n, status, label)
    out = run(spark, [
        item("good", [detection()]), item("missing", [detection()], ["parcel", "person"]), item("unknown", [detection(), detection("forklift", (0.9, 300.0, 100.0, 400.0, 200.0))], ["parcel", "forklift"]), item("none", [], []), item("null", None, ["parcel"]),
        item("tiny", [detection(box=(0.9, 1.5, 1.5, 2.0, 2.0))], ["parcel", "parcel"]), item("unsure", [detection(box=(0.5, *BOX[1:]))]), item("doubt", [detection(track=None)]), item("torn", [detection(track=None, consistent=False)]), item("alone", [detection(agree=None)]),
        item("settled", [detection()], status="HUMAN_VALIDATED", label="mine"), item("bare", [detection()], status="AUTO_ACCEPTED"), item("counted", [detection()], [], n=2),
    ])
    assert {k: r.status for k, r in out.items()} == {
        "good": "AUTO_ACCEPTED", "missing": "NEEDS_REVIEW", "unknown": "AUTO_ACCEPTED", "none": "NEEDS_REVIEW", "null": "NEEDS_REVIEW", "tiny": "REJECTED", "unsure": "NEEDS_REVIEW", "doubt": "NEEDS_REVIEW", "torn": "NEEDS_REVIEW", "alone": "NEEDS_REVIEW",
        "settled": "HUMAN_VALIDATED", "bare": "AUTO_ACCEPTED", "counted": "NEEDS_REVIEW",
    }
    assert out["settled"].skipped and out["settled"].label == "mine" and not out["good"].skipped
    assert out["good"].label == "0 0.234375 0.416667 0.156250 0.277778" and (out["unknown"].label_count, out["unknown"].expected_count) == (1, 1) and out["counted"].expected_count == 2
    again = run(spark, [item("settled", [detection()], status="HUMAN_VALIDATED", label="mine")], force=True)
    assert not again["settled"].skipped and again["settled"].status == "AUTO_ACCEPTED"
    assert run(spark, []) == {}


def test_signals_against_the_item_before(spark):
    far = detection(box=(0.9, 400.0, 100.0, 500.0, 200.0), track=2)
    rows = [("s", float(k), d) for k, d in enumerate([[detection()], [detection(), far], [], [detection()], [detection(), detection(box=(0.9, 105.0, 100.0, 205.0, 200.0), track=3)], [detection("person")]])]
    out = run(spark, [(f"i{int(t)}", s, t, d, [], 0, "NEEDS_REVIEW", None) for s, t, d in rows])
    told = [(out[f"i{k}"].temporal_stability, out[f"i{k}"].count_change) for k in range(6)]
    assert told == [(1.0, 0), (0.5, 1), (0.0, 2), (1.0, 0), (1.0, 1), (0.0, 1)]
    assert out["i4"].max_overlap > 0.8 and out["i4"].status == "NEEDS_REVIEW" and out["i1"].max_overlap == 0.0


def test_masks_and_points(spark):
    mask = [(100.0, 100.0), (200.0, 100.0), (200.0, 200.0)]
    item = lambda name, d: (name, name, 0.0, d, ["parcel"], 1, "NEEDS_REVIEW", None)
    out = run(spark, [item("sound", [detection(mask=mask)]), item("flat", [detection(mask=[(1.0, 1.0)] * 3)]), item("none", [detection()]), item("half", [detection(mask=mask), detection(box=(0.9, 300.0, 100.0, 400.0, 200.0))])], task="segmentation")
    assert {k: (r.status, r.mask_quality, r.label_count) for k, r in out.items()} == {"sound": ("AUTO_ACCEPTED", 1.0, 1), "flat": ("REJECTED", 0.0, 0), "none": ("REJECTED", 0.0, 0), "half": ("NEEDS_REVIEW", 0.5, 1)}
    points = [(float(k), 5.0, 1.0) for k in range(17)]
    out = run(spark, [item("person", [detection("person", points=points)]), item("few", [detection("person", points=points[:3])])], task="pose")
    assert out["person"].label_count == 1 and len(out["person"].label.split()) == 5 + 51 and (out["few"].label_count, out["few"].status) == (0, "NEEDS_REVIEW")


def test_a_mean_at_its_limit_is_no_rounding_error(spark):
    """The sum of 0.7, 0.7, 0.7 and 0.9 depends on their order, their mean of 0.75 does not."""
    orders = [(0.7, 0.7, 0.7, 0.7 + 0.1 * 2), (0.7 + 0.1 * 2, 0.7, 0.7, 0.7)]
    boxes = [(0.9, 20.0 + 60 * j, 100.0, 60.0 + 60 * j, 200.0) for j in range(4)]
    out = run(spark, [(f"i{k}", f"i{k}", 0.0, [detection(box=b, track=j, agree=a) for j, (b, a) in enumerate(zip(boxes, v))], [], 0, "NEEDS_REVIEW", None) for k, v in enumerate(orders)])
    assert [(out[f"i{k}"].status, out[f"i{k}"].model_agreement) for k in range(2)] == [("AUTO_ACCEPTED", 0.75)] * 2
