"""Projection heads compared on held-out episodes (ML5): the same gates, scores and matching as in production, once for each head."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrack.functions.shared import written
from loomtrack.operators.handoffs import MARGIN, MIN_SCORE, handoff_gates, handoff_score, judge_candidates, project_embeddings, similarity

#: By how much a candidate's accuracy and separation must exceed the active head's, and episodes it must have been tried on.
BETTER, EPISODES = 0.02, 2


def replay_candidates(pairs: DataFrame, tracklets: DataFrame, edges: DataFrame, zones: DataFrame, vectors: DataFrame, heads: dict[str, dict[str, np.ndarray]]) -> DataFrame:
    """(head, session_id, edge, out_tracklet_id, in_tracklet_id, label, reid, score): all candidates of the episodes, scored under each head; written.

    ``pairs``: (session_id, edge, out_tracklet_id, in_tracklet_id, label), labels POSITIVE and HARD_NEGATIVE. An episode is an incoming tracklet with a positive; it meets every
    outgoing tracklet of its session and edge that passes the gates, labelled or not. Vectors are projected once for each head, and only those in use. ``pairs`` are read
    five times, so they are written first.
    """
    pairs = written(pairs, "evaluation-pairs")
    positive = pairs.where("label = 'POSITIVE'")
    outs = pairs.select("session_id", "edge", "out_tracklet_id").distinct()
    ins = positive.select("session_id", "edge", "in_tracklet_id").distinct()
    side = lambda rows, c: tracklets.join(rows.select(F.col(c).alias("tracklet_id")).distinct().hint("merge"), "tracklet_id", "left_semi")
    gated = handoff_gates(side(outs, "out_tracklet_id"), side(ins, "in_tracklet_id"), edges, zones).where("accepted").withColumn("edge", F.concat_ws(">", "from_role", "to_role"))
    gated = gated.join(outs.hint("merge"), ["session_id", "edge", "out_tracklet_id"], "left_semi").join(ins.hint("merge"), ["session_id", "edge", "in_tracklet_id"], "left_semi")
    gated = written(gated.drop("reid"), "evaluation-gated")
    used = gated.select(F.col("out_vec_id").alias("vec_id")).union(gated.select("in_vec_id")).distinct()
    needed = written(vectors.join(used.hint("merge"), "vec_id", "left_semi").select("vec_id", "embedding"), "evaluation-vectors")
    seen = None
    for name, head in heads.items():
        part = project_embeddings(needed, head).withColumn("head", F.lit(name))
        seen = part if seen is None else seen.unionByName(part)
    seen = written(seen, "evaluation-projected")
    v = lambda p: seen.select("head", F.col("vec_id").alias(f"{p}_vec_id"), F.col("embedding").alias(f"{p}_vector"))
    each = gated.withColumn("head", F.explode(F.array(*map(F.lit, heads))))
    each = each.join(v("out").hint("merge"), ["head", "out_vec_id"], "left").join(v("in").hint("merge"), ["head", "in_vec_id"], "left").withColumn("reid", similarity("out_vector", "in_vector")).drop("out_vector", "in_vector")
    labels = pairs.groupBy("session_id", "edge", "out_tracklet_id", "in_tracklet_id").agg(F.max("label").alias("label"))  # POSITIVE before HARD_NEGATIVE
    scored = handoff_score(each).join(labels.hint("merge"), ["session_id", "edge", "out_tracklet_id", "in_tracklet_id"], "left")
    return written(scored.select("head", "session_id", "edge", "out_tracklet_id", "in_tracklet_id", "label", "reid", "score"), "evaluation-candidates")


def retrieval(candidates: DataFrame) -> DataFrame:
    """(head, n_ranked, positive_pair_retrieval_accuracy, hard_negative_separation): whether the best positive looks more alike than the best hard negative, and by how much."""
    best = candidates.groupBy("head", "session_id", "edge", "in_tracklet_id").agg(F.max(F.when(F.col("label") == "POSITIVE", F.col("reid"))).alias("p"), F.max(F.when(F.col("label") == "HARD_NEGATIVE", F.col("reid"))).alias("n"))
    right = (F.col("p") > F.coalesce("n", F.lit(0.0))).cast("double")
    return best.where("p IS NOT NULL").groupBy("head").agg(F.count("*").alias("n_ranked"), F.avg(right).alias("positive_pair_retrieval_accuracy"), F.coalesce(F.avg(F.col("p") - F.col("n")), F.lit(0.0)).alias("hard_negative_separation"))


def evaluate_handoffs(pairs: DataFrame, tracklets: DataFrame, edges: DataFrame, zones: DataFrame, vectors: DataFrame, heads: dict[str, dict[str, np.ndarray]], least: float = MIN_SCORE, margin: float = MARGIN) -> DataFrame:
    """One row per head (ML5): episodes, shares of right, false and ambiguous matches, identity switches, retrieval and separation.

    All heads are matched in one pass, each session and edge apart, as ids carry the head and the edge. An episode without a candidate counts as one. No
    pairs: no rows.
    """
    pairs = written(pairs, "evaluation-pairs")
    candidates = replay_candidates(pairs, tracklets, edges, zones, vectors, heads)
    tagged = candidates.withColumns({c: F.concat_ws("|", "head", "edge", f"{c}_tracklet_id") for c in ("out", "in")})
    judged = judge_candidates(tagged, "out", "in", "score", least, margin, "session_id").select("in", F.col("out").alias("chosen_out"), "ambiguous")
    positives = pairs.where("label = 'POSITIVE'").select("session_id", "edge", "in_tracklet_id", "out_tracklet_id").distinct()
    episodes = positives.select("session_id", "edge", "in_tracklet_id").distinct().withColumn("head", F.explode(F.array(*map(F.lit, heads)))).withColumn("in", F.concat_ws("|", "head", "edge", "in_tracklet_id"))
    wanted = positives.withColumn("head", F.explode(F.array(*map(F.lit, heads)))).select(F.concat_ws("|", "head", "edge", "in_tracklet_id").alias("in"), F.concat_ws("|", "head", "edge", "out_tracklet_id").alias("chosen_out"), F.lit(True).alias("right"))
    told = episodes.join(judged.hint("merge"), "in", "left").join(wanted.hint("merge"), ["in", "chosen_out"], "left")
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    matched = ~F.col("ambiguous")
    wrong = matched & F.col("right").isNull()
    rates = told.groupBy("head").agg(
        F.count("*").alias("replay_episode_count"), share(matched & F.col("right")).alias("handoff_accuracy"), share(wrong).alias("false_match_rate"), share(F.col("ambiguous")).alias("ambiguous_rate"),
        F.count(F.when(wrong, 1)).alias("global_id_switches"),
    )
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("positive_pair_retrieval_accuracy", "hard_negative_separation")}
    return rates.join(retrieval(candidates).drop("n_ranked").hint("merge"), "head", "left").withColumns(zero)


def clearly_better(metrics: DataFrame, active: str) -> DataFrame:
    """(head, better): whether each head should take over from ``active``."""
    a = metrics.where(F.col("head") == active).select(*(F.col(c).alias(f"a_{c}") for c in metrics.columns if c != "head"))
    rows = metrics.where(F.col("head") != active).crossJoin(F.broadcast(a))  # one row on the right
    wins = (
        (F.col("replay_episode_count") >= EPISODES) & (F.col("replay_episode_count") == F.col("a_replay_episode_count"))
        & (F.col("handoff_accuracy") >= F.col("a_handoff_accuracy") + BETTER) & (F.col("hard_negative_separation") >= F.col("a_hard_negative_separation") + BETTER)
        & (F.col("false_match_rate") <= F.col("a_false_match_rate")) & (F.col("global_id_switches") <= F.col("a_global_id_switches"))
    )
    return rows.select("head", wins.alias("better"))

