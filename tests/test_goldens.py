"""Small literals with known answers, and empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtrack.operators import datasets, frames, handoffs
from loomtrack.operators.graph import connected_components
from loomtrack.sources import fixtures as fx


def test_assignment_is_optimal():
    rng = np.random.default_rng(3)

    def best(g):
        if not len(g):
            return 0.0
        return max([best(g[1:])] + [g[0, j] + best(np.delete(g[1:], j, axis=1)) for j in range(g.shape[1]) if g[0, j] > 0])

    for _ in range(60):
        gain = np.round(rng.random(rng.integers(1, 5, 2)), 2) * (rng.random() < 0.9)
        assert sum(gain[i, j] for i, j in handoffs._solve(gain)) == pytest.approx(best(gain))


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60) if k != 30] + [(5, 5), (None, 3), (1, 0)], "a long, b long")
    found = {r.id: r.component for r in connected_components(edges, "a", "b").collect()}
    assert found == {k: 0 if k <= 30 else 31 for k in range(61)}
    assert connected_components(edges.limit(0), "a", "b").count() == 0


def test_ground_anchor(spark):
    rows = spark.sql("""SELECT 1 AS id, 0D AS x1, 0D AS y1, 10D AS x2, 20D AS y2, array(named_struct('x', 0D, 'y', 0D), named_struct('x', 2D, 'y', 10D), named_struct('x', 4D, 'y', 20D)) AS mask
      UNION ALL SELECT 2, 0D, 0D, 10D, 20D, NULL""")
    out = {r.id: (r.ax, r.ay) for r in frames.ground_anchor(rows).collect()}
    assert out[1] == (4.0, 16.0) and out[2] == (5.0, 20.0)


def test_near_duplicates_cover_three_bits(spark):
    rows = [(k, (1 << k) - 1, "a" if k % 2 else "b") for k in range(12)] + [(100, None, "a")]
    found = {(r.left_id, r.right_id) for r in datasets.near_duplicates(spark.createDataFrame(rows, "item_id long, hash long, split string")).collect()}
    assert found == {(a, b) for a in range(12) for b in range(a + 1, 12) if b - a <= 3 and (b - a) % 2}


def test_handoffs_move_a_parcel_through_the_site(spark):
    def row(name, role, start, first, last):
        return (name, "S", role, start, start + 1.0, 1, 40.0, 30.0, 2.0, 0.0, first, last, "STABLE", 0)

    names = "tracklet_id string, session_id string, camera_role string, started_at_global double, ended_at_global double, local_track_id long, avg_w double, avg_h double, avg_vx double, avg_vy double, first_zone_id string, last_zone_id string, integrity_status string, vec_id long"
    rows = spark.createDataFrame([row("t1", "C1", 0.0, None, "c1_exit"), row("t2", "C2", 6.0, "c2_entry", "c2_exit"), row("t3", "C3", 13.0, "c3_entry", None), row("t9", "C3", 500.0, "c3_entry", None)], names)
    out = {r.tracklet_id: (r.status, r.parcel_id) for r in handoffs.resolve_handoffs(rows, fx.edges(spark), fx.zones(spark)).collect()}
    assert out == {"t1": ("NEW_AT_INGRESS", "g:t1"), "t2": ("MATCHED", "g:t1"), "t3": ("MATCHED", "g:t1"), "t9": ("UNRESOLVED", None)}
    assert handoffs.resolve_handoffs(rows.limit(0), fx.edges(spark), fx.zones(spark)).count() == 0


def test_splits_fill_and_balance(spark):
    sessions = spark.range(100).select(F.col("id").cast("string").alias("session_id"))
    explicit = spark.createDataFrame([("7", "test")], "session_id string, split string")
    out = {r.session_id: r.split for r in datasets.assign_splits(sessions, explicit).collect()}
    counts = [list(out.values()).count(s) for s in ("train", "val", "test")]
    assert len(out) == 100 and out["7"] == "test" and counts == [70, 20, 10]


def test_greedy_dedup_keeps_the_first(spark):
    rows = [(1, "g1", "s1", 0, "train", 0b1), (2, "g2", "s1", 1, "train", 0b11), (3, "g3", "s2", 0, "test", 0b111), (4, "g4", "s3", 0, "val", 0xFF00FF00FF00)]
    out = {r.sample_group_id: r.kept for r in datasets.greedy_dedup(spark.createDataFrame(rows, "item_id long, sample_group_id string, session_order string, group_order long, split string, hash long")).collect()}
    assert out == {"g1": True, "g2": False, "g3": False, "g4": True}
