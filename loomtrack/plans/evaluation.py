"""Registered queries that compare projection heads on mined pairs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from loomtrack.functions.shared import written
from loomtrack.operators import evaluation, handoffs
from loomtrack.plans.handoffs import _MINED, _gated, _tracklets
from loomtrack.sources import fixtures as fx

#: The vectors as they are, their first half, and a head that mixes dimensions.
HALF = 32


def _heads():
    rng = np.random.default_rng(11)
    return {"plain": {}, "half": {"matrix": np.eye(64)[:HALF]}, "mixed": {"down": rng.normal(0, 0.2, (8, 64)), "up": rng.normal(0, 0.2, (64, 8))}}


def _pairs(spark, sf):
    scored = handoffs.handoff_score(_gated(spark, sf).where("accepted")).withColumns({c: F.round(c, 6) for c in ("score", "physical_score", "temporal", "dimensions")})
    used = ("session_id", "out_tracklet_id", "in_tracklet_id", "to_role", "out_integrity_status", "in_integrity_status", "temporal", "zone", "dimensions", "integrity", "physical_score", "score")
    scored = written(scored.select(*used, F.concat_ws(">", "from_role", "to_role").alias("edge")), "evaluation-scored")  # mined, and read again for the names
    mined = handoffs.mine_pairs(scored)
    names = scored.select("session_id", "out_tracklet_id", "in_tracklet_id", "edge")
    return mined.join(names.hint("merge"), ["out_tracklet_id", "in_tracklet_id"]).select("session_id", "edge", "out_tracklet_id", "in_tracklet_id", "label")


def ml5_retrieval(spark, sf):
    heads = {k: h for k, h in _heads().items() if k != "mixed"}
    found = evaluation.replay_candidates(_pairs(spark, sf), _tracklets(spark, sf), fx.edges(spark), fx.zones(spark), fx.vectors(spark, sf), heads)
    return evaluation.retrieval(found).select("head", "n_ranked", F.round("positive_pair_retrieval_accuracy", 6).alias("accuracy"), F.round("hard_negative_separation", 6).alias("separation"))


def _metrics(spark, sf):
    return evaluation.evaluate_handoffs(_pairs(spark, sf), _tracklets(spark, sf), fx.edges(spark), fx.zones(spark), fx.vectors(spark, sf), _heads())


def ml5_evaluate_handoffs(spark, sf):
    counts = ("replay_episode_count", "global_id_switches")
    metrics = _metrics(spark, sf)
    return metrics.select("head", *counts, *(F.round(c, 6).alias(c) for c in metrics.columns if c not in ("head", *counts)))


QUERIES = {f.__name__: f for f in (ml5_retrieval, ml5_evaluate_handoffs)}

ORACLES = {
    "ml5_retrieval": f"""{_MINED}, pair AS (SELECT s.session_id, s.from_role || '>' || s.to_role AS edge, m.out_tracklet_id AS o, m.in_tracklet_id AS i, m.label FROM mined m JOIN s6 s ON s.out_tracklet_id = m.out_tracklet_id AND s.in_tracklet_id = m.in_tracklet_id),
      each AS (SELECT h.head, p.session_id, p.edge, p.i, p.label, (list_cosine_similarity((a.embedding::DOUBLE[])[:h.n], (b.embedding::DOUBLE[])[:h.n]) + 1) / 2 AS reid FROM pair p JOIN tracklets ot ON ot.tracklet_id = p.o JOIN tracklets it ON it.tracklet_id = p.i
        JOIN embeddings a ON a.vec_id = ot.vec_id JOIN embeddings b ON b.vec_id = it.vec_id, (VALUES ('plain', 64), ('half', {HALF})) h(head, n) WHERE p.i IN (SELECT i FROM pair WHERE label = 'POSITIVE')),
      top AS (SELECT head, session_id, edge, i, max(reid) FILTER (label = 'POSITIVE') AS p, max(reid) FILTER (label = 'HARD_NEGATIVE') AS n FROM each GROUP BY ALL)
      SELECT head, count(*) AS n_ranked, round(avg(CASE WHEN p > coalesce(n, 0) THEN 1.0e0 ELSE 0 END), 6) AS accuracy, round(coalesce(avg(p - n), 0), 6) AS separation FROM top WHERE p IS NOT NULL GROUP BY head""",
}
