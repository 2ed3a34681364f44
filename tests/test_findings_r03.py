"""What the findings of the third round were about, on small tables."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomtrack.llm import lm
from loomtrack.operators import datasets, folds, frames, graph, handoffs, interactions, keyed, parcels, resolutions
from loomtrack.plans import builder as builder_plans
from loomtrack.plans import checks as check_plans
from loomtrack.plans import evaluation as evaluation_plans
from loomtrack.plans import frames as frame_plans
from loomtrack.plans import resolutions as resolution_plans
from loomtrack.plans import stateful
from loomtrack.sources import reviews
from test_builder import plain_greedy


def test_training_does_not_switch_at_a_size(spark):
    """the same documents train the same model, however many tokens the corpus is said to have."""
    docs = spark.createDataFrame([(f"a{k % 3} b{k % 5} c d{k % 2}",) for k in range(40)], "text string").coalesce(1)
    words = [b"c", b"d0", b"d1", b"a0", b"a1"]
    shares = np.ones(3 + lm.ENDINGS + 1)
    found = [lm._trained(docs, lm.Vocabulary(words, np.array([40, 20, 20, 14, 13]), n, 12, 40, 3), lm.Net(shares / shares.sum(), 3), 0.1, "text") for n in (3_999_999, 4_000_000)]
    assert np.array_equal(*found)
    assert [lm.step_size(n) for n in (0, 8192, 16384, 131_072, 10**9)] == [512, 512, 1024, 8192, 8192]


def test_fold_values_are_those_of_arrow():
    """columns become Python values by numpy, lists and nulls included."""
    columns = [
        pa.array([1, None, 3]), pa.array([1.5, float("nan"), None]), pa.array([True, None, False]), pa.array(["a", None, "é"]), pa.array([["x", None], None, []]), pa.array([[1.0, None], [2.0], []]).slice(1),
        pa.array([], pa.int32()), pa.array([b"q", None]), pa.array([{"a": 1}, None]), pa.array([[[1], []], None]),
    ]
    for c in columns:
        assert keyed._plain(c) == c.to_pylist() or pa.types.is_floating(c.type)
    assert keyed._values(columns[1]) == [1.5, None, None]


def test_facts_drop_candidate_lists_and_scores_are_written_once(spark, sf):
    """no shuffle after the first carries the lists, and the hypotheses are a written table."""
    hypotheses, tracklets, owners, edges = resolution_plans._tables(spark, sf)
    assert hypotheses.inputFiles() and "candidates" not in resolutions.with_facts(resolution_plans._requests(hypotheses), hypotheses, tracklets, owners, edges).columns


def test_star_pairs_are_the_solvers():
    """groups apart, and stars without the solver, give what the solver gives for the frame, ties included."""
    rng = np.random.default_rng(5)
    for trial in range(400):
        n, m = rng.integers(1, 5, 2)
        gain = rng.integers(1, 4, (n, m)) * (rng.random((n, m)) < 0.4) * 0.1 if trial % 2 else rng.random((n, m)) * (rng.random((n, m)) < 0.45)
        assert parcels.best_pairs({(p, q): gain[p, q] for p in range(n) for q in range(m)}) == sorted(handoffs._solve(gain))


class _Swept:
    """Contacts as the rule says it: every pair looked at in every frame."""

    def __init__(self):
        self.since = {}

    def frame(self, now, pairs):
        for pair, distance in pairs.items():
            times = self.since.setdefault(pair, [None, None])
            times[:] = [now if times[0] is None else times[0], None] if distance <= parcels.CONTACT else [None, now if times[1] is None else times[1]]
        for pair, times in list(self.since.items()):
            if pair not in pairs:
                times[:] = [None, now if times[1] is None else times[1]]
                if now - times[1] > parcels.FORGET:
                    del self.since[pair]
        return self.since


def test_contacts_are_kept_as_by_a_sweep_of_every_frame(monkeypatch):
    """only pairs of a frame and of the one before are touched; also when time goes back, and across a hand over."""
    monkeypatch.setattr(parcels, "SWEEP", 7)
    draw = random.Random(3)
    now, fold, plain = 0.0, parcels.Matching(), _Swept()
    for k in range(600):
        now += draw.choice((0.125, 0.5, 2.0, 3.5)) if draw.random() > 0.05 else -5.0
        pairs = {(p, q): draw.choice((0.02, 0.2, 0.5)) for p in range(3) for q in range(10, 12) if draw.random() < 0.25}
        fold.frame([(now, p, q, d, False, 0.5, False, False) for (p, q), d in pairs.items()] or [(now, None, None, None, None, None, None, None)])
        assert fold.open_pairs() == plain.frame(now, pairs)
        if k % 50 == 49:
            fold = parcels.Matching(fold.open_pairs(), fold.operator)


def test_observations_of_the_folds_are_written(spark, sf):
    """ST3 and ST4 read one written table instead of working the view out for every join."""
    assert any("stateful-observations" in f for f in stateful._obs(spark, sf).inputFiles())


def test_greedy_tracks_end_after_their_misses():
    """F16: tracks of a class, the longest unseen first; a track that missed more frames than allowed is gone."""
    fold = folds._Greedy(0.1, 2)
    box = (0.0, 0.0, 10.0, 10.0)
    assert fold.frame([(0, "p", *box), (1, "q", *box)]) == [(0, 1), (1, 2)]
    for _ in range(2):
        assert fold.frame([(0, "q", *box)]) == [(0, 2)]
    assert fold.frame([(0, "p", *box), (1, "q", *box)]) == [(0, 1), (1, 2)]
    for _ in range(3):
        fold.frame([(0, "q", *box)])
    assert fold.frame([(0, "p", *box)]) == [(0, 3)] and set(fold.live["p"]) == {3}


@pytest.mark.parametrize("held", (1_000_000, 2))
def test_contraction_keeps_components(spark, monkeypatch, held):
    """fewer links, the same components, wherever the rows lie."""
    monkeypatch.setattr(graph, "HELD", held)
    draw = random.Random(1)
    rows = [(f"a{draw.randrange(60)}", f"b{draw.randrange(60)}") for _ in range(70)] * 3
    edges = spark.createDataFrame([*rows, (None, "x")], "a string, b string")
    parts = [defaultdict(set), defaultdict(set)]
    for found, table in zip(parts, (edges, graph.contracted(edges.repartition(3), "a", "b"))):
        for r in graph.connected_components(table, "a", "b").collect():
            found[r.component].add(r.id)
    assert parts[0] == parts[1] and graph.contracted(edges.coalesce(1), "a", "b").count() < 70 * 2


def test_judging_does_not_hang_on_the_place_of_rows(spark):
    """with and without the hint of a session, and for groups streamed one after another."""
    draw = random.Random(2)
    rows = [(f"s{k % 4}", f"l{k % 4}-{draw.randrange(5)}", f"r{k % 4}-{draw.randrange(5)}", round(draw.uniform(0.4, 1), 3)) for k in range(60)]
    scored = spark.createDataFrame(rows, "session_id string, l string, r string, score double")
    told = [sorted(map(tuple, handoffs.judge_candidates(scored.repartition(n), "l", "r", near=near).collect())) for n, near in ((1, None), (3, "session_id"), (5, "l"))]
    assert told[0] == told[1] == told[2] and told[0]
    assert handoffs.judge_candidates(scored.where(F.lit(False)), "l", "r", near="session_id").count() == 0


def test_mined_pairs_are_read_from_a_table(spark, sf):
    """what the pairs are mined from is scored once, not for each of their readers."""
    assert not any("orders" in f for f in evaluation_plans._pairs(spark, sf).inputFiles())


def test_numbers_are_written_as_printf_does(spark):
    """six decimals by a decimal type, ties, signs, null and odd values as before."""
    rows = spark.range(-4000, 4000).select(F.explode(F.array(F.col("id") / 640, F.col("id") / 360, F.col("id") / 1280, F.col("id") * 1e-8)).alias("v"))
    odd = spark.sql("SELECT explode(array(double('NaN'), null, double('inf'), -0.0D, 1e12D, 999999999.9999999D)) AS v")
    both = rows.unionByName(odd).select("v", reviews._six(F.col("v")).alias("got"), F.format_string("%.6f", "v").alias("want"))
    assert both.where(~F.col("got").eqNullSafe(F.col("want"))).count() == 0


def test_lines_are_written_without_collecting_a_frame(spark, sf):
    """the lines of an observation need no other of its frame."""
    plan = check_plans.io7_segmentation_and_pose_lines(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_identity_records_are_dealt_by_their_number(spark, sf, monkeypatch):
    """the share of a task stays the same however many records there are, with the same results."""
    records = frame_plans._records(spark, sf)
    whole = [sorted(frames.identity_metrics(records).collect()), frames.replay_report(records, records.withColumn("given_id", F.col("truth_id"))).collect()]
    each = records.count() // 9
    monkeypatch.setattr(frames, "RECORDS", each)
    assert frames._by_identity(records).rdd.getNumPartitions() == -(-records.count() // each) > 4
    assert whole == [sorted(frames.identity_metrics(records).collect()), frames.replay_report(records, records.withColumn("given_id", F.col("truth_id"))).collect()]


def test_later_tracklets_meet_hypotheses_not_candidates(spark, sf):
    """a row for each hypothesis and later tracklet, with the best candidate and the second's score, as all proposals have them."""
    hypotheses, tracklets, owners, edges = resolution_plans._tables(spark, sf)
    rows = resolutions._proposals(hypotheses, tracklets, tracklets, owners, edges, None, 6)
    every = resolutions.continuations(hypotheses, tracklets, tracklets, edges).withColumn("combined", F.round("combined", 6))
    listed = every.groupBy("hypothesis_id", "later_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("combined")).alias("cost"), "outgoing_id"))).alias("p"))
    wanted = listed.select("hypothesis_id", "later_id", F.col("p")[0]["outgoing_id"].alias("outgoing_id"), (-F.col("p")[0]["cost"]).alias("combined"), (-F.get("p", F.lit(1))["cost"]).alias("second")).collect()
    assert sorted(rows.select("hypothesis_id", "later_id", "outgoing_id", "combined", "second").collect()) == sorted(wanted) and len(wanted) < every.count() / 2


def test_hypotheses_are_listed_where_their_pairs_were_joined(spark, sf):
    """no shuffle between the gates and the lists, and the score is worked out once for a pair."""
    base = resolution_plans.fx.view(spark, sf, "tracklets")
    scored = handoffs.handoff_score(handoffs.handoff_gates(base, base, resolution_plans.fx.edges(spark), resolution_plans.fx.zones(spark)).where("accepted"))
    shuffles = []
    for within in ((), ("to_role", "in_bucket")):
        found = resolutions.open_hypotheses(scored, within=within)
        shuffles.append(found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
    assert shuffles == [3, 2]


def test_groups_of_the_same_images_are_judged_once(spark, monkeypatch):
    """of groups with the same hashes and splits only the first is folded, with the result of a plain loop; frames without a hash keep a group apart."""
    draw = random.Random(4)
    rows = [(f"g{g:03}", f"s{g % 3}", g, draw.choice(("train", "test")), draw.choice((None, 1, 2, 3, 2**40, 2**41, 2**50 - 1) if g % 5 == 0 else (1, 3, 2**40, 2**50 - 1, 2**50 + 2**20))) for g in range(300) for _ in range(draw.randint(1, 3))]
    items = spark.createDataFrame(rows, "sample_group_id string, session_order string, group_order long, split string, hash long")
    folded, fold = [], datasets.fold_frames
    monkeypatch.setattr(datasets, "fold_frames", lambda df, *a: folded.append(df.select("sample_group_id").distinct().count()) or fold(df, *a))
    found = {r.sample_group_id: r.kept for r in datasets.greedy_dedup(items).collect()}
    assert found == plain_greedy([r.asDict() for r in items.collect()]) and 0 < sum(found.values())
    complete = defaultdict(set)
    for name, _, _, split, image in rows:
        complete[name].add((image, split))
    apart = {frozenset(c) for c in complete.values() if all(image is not None for image, _ in c)}
    assert folded[0] <= len(apart) + sum(any(image is None for image, _ in c) for c in complete.values()) < 300


def test_observations_of_the_builder_are_written(spark, sf):
    """the view is worked out once, not for each of its readers."""
    assert any("builder-observations" in f for f in builder_plans._inputs(spark, sf)[0].inputFiles())


def test_frame_quality_reads_written_tables_and_counts_as_a_loop(spark):
    """observations and frames are worked out once; overlaps, changes and matches are those of a plain loop, with gaps and lone frames."""
    draw = random.Random(6)
    rows = [("S", "C", e, f, t, draw.choice(("parcel", "person")), draw.random(), x := draw.randrange(30) * 1.0, 0.0, x + 20, 10.0) for e in (0, 1) for f in sorted(draw.sample(range(40), 20)) for t in draw.sample(range(9), draw.randint(1, 5))]
    obs = spark.createDataFrame(rows, "session_id string, source_id string, stream_epoch int, frame_index long, local_track_id long, class_name string, confidence double, x1 double, y1 double, x2 double, y2 double")
    found = interactions.frame_quality(obs)
    assert found.inputFiles() and all("quality-observations" in f or "quality-frames" in f for f in found.inputFiles())

    def iou(a, b):
        shared = max(0.0, min(a[9], b[9]) - max(a[7], b[7])) * 10
        return shared / (400 - shared + 1e-6)

    by_frame, before = defaultdict(list), []
    for r in rows:
        by_frame[r[2], r[3]].append(r)
    wanted = {}
    for k, key in enumerate(sorted(by_frame)):
        now = by_frame[key]
        last = before if k and before[0][2] == key[0] else []
        hits = sum(any(a[5] == b[5] and iou(a, b) >= 0.2 for b in last) for a in now)
        wanted[key] = (len(now), abs(len(now) - len(before)) if k else 0, max((iou(a, b) for a in now for b in now if a[4] < b[4]), default=0.0), hits / len(now))
        before = now
    got = {(r.stream_epoch, r.frame_index): (r.n_detections, r.count_change, r.max_overlap, r.temporal_stability) for r in found.collect()}
    assert got.keys() == wanted.keys() and all(got[k] == pytest.approx(wanted[k]) for k in wanted)
    matches = {(r.stream_epoch, r.frame_index): r.matched / r.total for r in interactions.temporal_matches(obs).collect()}
    assert matches == {k: v[3] for k, v in wanted.items()}
