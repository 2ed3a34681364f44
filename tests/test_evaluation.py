"""Heads compared on a small set of episodes with known outcomes."""

import numpy as np
import pytest

from loomtrack.operators import evaluation

TRACKS = "session_id string, tracklet_id string, camera_role string, started_at_global double, ended_at_global double, local_track_id long, avg_w double, avg_h double, avg_vx double, avg_vy double, first_zone_id string, last_zone_id string, integrity_status string, vec_id long"
PAIRS = "session_id string, edge string, out_tracklet_id string, in_tracklet_id string, label string"


@pytest.fixture(scope="module")
def scene(spark):
    """In both sessions the true pair agrees in the first two dimensions; the third one speaks for the wrong one, and louder."""
    row = lambda s, name, role, start, vec: (s, f"{s}{name}", role, start, start + 1, 1, 10.0, 10.0, 1.0, 0.0, None, None, "STABLE", vec)
    rows, pairs = [], []
    for k, s in enumerate("ST"):
        rows += [row(s, "a", "C1", 0.0, 1), row(s, "b", "C1", 0.0, 2), row(s, "i", "C2", 3.0, 3), row(s, "free", "C2", 500.0, 3), row(s, "other", "C1", 0.0, 1)]
        pairs += [(s, "C1>C2", f"{s}a", f"{s}i", "POSITIVE"), (s, "C1>C2", f"{s}b", f"{s}i", "HARD_NEGATIVE"), (s, "C1>C2", f"{s}a", f"{s}free", "POSITIVE")]
    vectors = spark.createDataFrame([(1, [1.0, 0.0, -3.0]), (2, [-1.0, 0.0, 3.0]), (3, [1.0, 0.0, 3.0]), (9, None)], "vec_id long, embedding array<double>")
    edges = spark.createDataFrame([("C1", "C2", 0.5, 5.0)], "from_role string, to_role string, min_transit_s double, max_transit_s double")
    return spark.createDataFrame(pairs, PAIRS), spark.createDataFrame(rows, TRACKS), edges, spark.createDataFrame([], "zone_id string, kind string"), vectors


def test_a_head_that_ignores_the_loud_dimension_wins(spark, scene):
    heads = {"plain": {}, "quiet": {"matrix": np.eye(3)[:2]}}
    out = {r.head: r for r in evaluation.evaluate_handoffs(*scene, heads).collect()}
    # "free" is an episode that no outgoing tracklet reaches in time; "other" is in no pair and so is no candidate
    assert {h: (r.replay_episode_count, r.handoff_accuracy, r.global_id_switches) for h, r in out.items()} == {"plain": (4, 0.0, 2), "quiet": (4, 0.5, 0)}
    assert (out["quiet"].positive_pair_retrieval_accuracy, out["quiet"].hard_negative_separation) == (1.0, pytest.approx(1.0))
    cosine = lambda a, b: (1 + np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)) / 2
    assert out["plain"].hard_negative_separation == pytest.approx(cosine([1, 0, -3], [1, 0, 3]) - cosine([-1, 0, 3], [1, 0, 3])) and out["plain"].positive_pair_retrieval_accuracy == 0.0
    better = evaluation.clearly_better(evaluation.evaluate_handoffs(*scene, heads), "plain")
    assert [tuple(r) for r in better.collect()] == [("quiet", True)]
    assert [r.better for r in evaluation.clearly_better(evaluation.evaluate_handoffs(*scene, heads), "quiet").collect()] == [False]


def test_no_pairs(spark, scene):
    pairs, *rest = scene
    assert evaluation.evaluate_handoffs(pairs.limit(0), *rest, {"plain": {}}).count() == 0
