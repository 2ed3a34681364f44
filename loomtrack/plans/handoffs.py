"""Registered queries over tracklets and handoffs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from loomtrack.operators import handoffs as ops
from loomtrack.operators.graph import connected_components
from loomtrack.sources import fixtures as fx


def _tracklets(spark, sf):
    return fx.view(spark, sf, "tracklets")


def _gated(spark, sf):
    t = _tracklets(spark, sf)
    return ops.handoff_gates(t, t, fx.edges(spark), fx.zones(spark))


def _scored(spark, sf):
    return ops.handoff_score(ops.with_reid(_gated(spark, sf).where("accepted"), fx.vectors(spark, sf)))


def jn1_handoff_gates(spark, sf):
    return _gated(spark, sf).select("session_id", "out_tracklet_id", "in_tracklet_id", F.round("transit_s", 6).alias("transit_s"), "accepted", "reason")


def _placed(spark, sf):
    """Tracklets with places in two world frames, some unknown or not finite, and a status of the summary's own."""
    t = _tracklets(spark, sf)
    n = F.col("local_track_id")
    nan = F.lit(float("nan"))
    return t.withColumns({
        "summary_status": F.when(n % 13 == 5, "AMBIGUOUS").when(n % 2 == 0, "STABLE"), "world_frame_id": F.when(n % 7 == 3, None).when(n % 5 == 0, "W2").otherwise("W1"),
        "first_world_x": F.col("avg_w") / 4, "first_world_y": F.when(n % 11 == 4, nan).otherwise(F.col("avg_vx")), "last_world_x": F.col("avg_h") / 8, "last_world_y": F.when(n % 6 != 1, F.col("avg_vx") + 1),
    })


def _fast_edges(spark):
    return fx.edges(spark).withColumn("max_speed_m_s", F.when(F.col("from_role") == "C1", 1.5))


def jn1_world_gates(spark, sf):
    t = _placed(spark, sf)
    gated = ops.handoff_gates(t, t, _fast_edges(spark), fx.zones(spark))
    return gated.select("out_tracklet_id", "in_tracklet_id", "accepted", "reason", "identity_usable", "same_world_frame", "world_unavailable", *(F.round(c, 6).alias(c) for c in ("world_distance_m", "world_limit_m", "world")))


def gr3_world_score(spark, sf):
    t = _placed(spark, sf)
    scored = ops.handoff_score(ops.handoff_gates(t, t, _fast_edges(spark), fx.zones(spark)).where("accepted"))
    return scored.select("out_tracklet_id", "in_tracklet_id", F.round("score", 6).alias("score"), F.round("physical_score", 6).alias("physical_score"))


def sc3_vector_similarity(spark, sf):
    return ops.with_reid(_gated(spark, sf).where("accepted"), fx.vectors(spark, sf)).select("out_tracklet_id", "in_tracklet_id", F.round("reid", 6).alias("reid"))


def gr3_handoff_score(spark, sf):
    return _scored(spark, sf).select("out_tracklet_id", "in_tracklet_id", *(F.round(c, 6).alias(c) for c in ("temporal", "dimensions", "zone", "speed", "integrity", "score", "physical_score")))


def tk2_best_candidate(spark, sf):
    scored = ops.handoff_score(_gated(spark, sf).where("accepted")).withColumn("score", F.round("score", 6))
    return ops.best_candidate(scored).select("in_tracklet_id", "out_tracklet_id", "score", "runner_up")


def tk5_overflow(spark, sf):
    return ops.overflow(_tracklets(spark, sf), 60).select("session_id", "tracklet_id")


def gr1_components(spark, sf):
    """Tracklets linked by a score of 0.9 at least, to nine decimals."""
    links = ops.linked(ops.handoff_score(_gated(spark, sf).where("accepted")), 0.9)
    return connected_components(links, "out_tracklet_id", "in_tracklet_id")


def gr2_topology_rank(spark, sf):
    roles = _tracklets(spark, sf).groupBy("camera_role").agg(F.count("*").alias("tracklets")).withColumnRenamed("camera_role", "role")
    return ops.topology_rank(fx.edges(spark)).join(roles, "role").select("role", F.col("rank").cast("long").alias("rank"), "tracklets")


def pf15_ingress_roles(spark, sf):
    t = _tracklets(spark, sf)
    return t.join(ops.ingress_roles(fx.edges(spark)), t["camera_role"] == F.col("role"), "left_semi").groupBy("camera_role").agg(F.count("*").alias("n"))


def gr4_assign_one_to_one(spark, sf):
    return ops.assign_one_to_one(ops.handoff_score(_gated(spark, sf).where("accepted")), "out_tracklet_id", "in_tracklet_id", near="session_id")


def gr6_resolve_handoffs(spark, sf):
    return ops.resolve_handoffs(_tracklets(spark, sf), fx.edges(spark), fx.zones(spark), fx.vectors(spark, sf))


def gr7_parcel_chains(spark, sf):
    return ops.parcel_chains(gr6_resolve_handoffs(spark, sf), _tracklets(spark, sf))


def gr7_chains_of_tracks(spark, sf):
    """Chains over a table of decided tracklets: those of one session and local id are one parcel."""
    t = _tracklets(spark, sf)
    return ops.parcel_chains(t.select(F.concat_ws("/", "session_id", "local_track_id").alias("parcel_id"), "tracklet_id"), t)


def pf11_destination_result(spark, sf):
    parcels = _tracklets(spark, sf).select("tracklet_id", F.col("first_zone_id").alias("expected_destination"), F.when(F.col("avg_vx") == 2, F.col("first_zone_id")).otherwise(F.col("last_zone_id")).alias("observed_destination"))
    return ops.destination_result(parcels).select("tracklet_id", "destination_result")


def pf13_descriptor_reliable(spark, sf):
    d = _tracklets(spark, sf).select("tracklet_id", (F.col("local_track_id") % 6).alias("view_count"), F.when(F.col("integrity_status") == "AMBIGUOUS", "LOW").otherwise("HIGH").alias("quality"), F.when(F.col("avg_w") > 75, True).alias("legacy"))
    return ops.descriptor_reliable(d).select("tracklet_id", "reliable")


def ag14_multi_view_descriptor(spark, sf):
    views = spark.read.parquet(f"{sf}/embeddings.parquet").select((F.col("vec_id") % 100).alias("tracklet"), F.col("embedding").cast("array<double>").alias("embedding"))
    out = ops.multi_view_descriptor(views, ["tracklet"])
    return out.select("tracklet", "view_count", "label", F.round(F.element_at("aggregate", 1), 6).alias("d0"), F.round(F.element_at("aggregate", -1), 6).alias("d_last"))


def ml2_mine_pairs(spark, sf):
    scored = ops.handoff_score(_gated(spark, sf).where("accepted")).withColumns({c: F.round(c, 6) for c in ("score", "physical_score", "temporal", "dimensions")})
    return ops.mine_pairs(scored)


def ml3_episode_split(spark, sf):
    pairs = _gated(spark, sf).where("accepted").select("session_id", F.concat_ws(">", "from_role", "to_role").alias("edge"), F.col("in_tracklet_id").alias("right_id"), "out_tracklet_id")
    return ops.episode_split(pairs).select("out_tracklet_id", "right_id", "held_out")


def ag13_pair_counts(spark, sf):
    return ops.pair_counts(ml2_mine_pairs(spark, sf))


def sc4_project_embeddings(spark, sf):
    rng = np.random.default_rng(3)
    head = {"down": rng.normal(0, 0.2, (8, 64)), "up": rng.normal(0, 0.2, (64, 8)), "bias": rng.normal(0, 0.01, 64)}
    out = ops.project_embeddings(fx.vectors(spark, sf), head)
    return out.select("vec_id", F.array_join(F.transform("embedding", lambda x: F.format_string("%.6f", x)), " ").alias("projected"))


def ag17_insert_or_ignore(spark, sf):
    t = _tracklets(spark, sf)
    rows = t.select("session_id", "camera_role", (F.col("local_track_id") % 9).alias("local_key"), "avg_w", "tracklet_id")  # several, different rows of a key
    return ops.insert_or_ignore(rows.unionByName(rows), ["session_id", "camera_role", "local_key"], rows.where("local_key % 7 = 0"))


QUERIES = {f.__name__: f for f in (
    jn1_handoff_gates, jn1_world_gates, gr3_world_score, sc3_vector_similarity, gr1_components, gr2_topology_rank, gr3_handoff_score, gr4_assign_one_to_one, gr6_resolve_handoffs, gr7_parcel_chains, gr7_chains_of_tracks,
    tk2_best_candidate, tk5_overflow, pf11_destination_result, pf13_descriptor_reliable, pf15_ingress_roles, ag13_pair_counts, ag14_multi_view_descriptor, ag17_insert_or_ignore, sc4_project_embeddings, ml2_mine_pairs, ml3_episode_split,
)}

_T = fx.oracle("tracklets", "edges", "zones")


def _gates(name: str, outgoing: str, incoming: str) -> str:
    return f""", {name} AS (SELECT *, reason IS NULL AS accepted FROM (SELECT o.session_id, o.tracklet_id AS out_id, i.tracklet_id AS in_id, i.started_at_global - o.ended_at_global AS transit_s, e.*,
      o.avg_w AS ow, i.avg_w AS iw, o.avg_h AS oh, i.avg_h AS ih, o.avg_vx AS ov, i.avg_vx AS iv, o.last_zone_id AS oz, i.first_zone_id AS iz, o.integrity_status AS os, i.integrity_status AS ist, o.vec_id AS ovec, i.vec_id AS ivec,
      CASE WHEN o.integrity_status = 'AMBIGUOUS' OR i.integrity_status = 'AMBIGUOUS' THEN 'IDENTITY_NOT_USABLE' WHEN zo.kind <> 'exit' THEN 'NOT_AN_EXIT' WHEN zi.kind <> 'entry' THEN 'NOT_AN_ENTRY' END AS reason
      FROM {outgoing} o JOIN edges e ON e.from_role = o.camera_role JOIN {incoming} i ON i.session_id = o.session_id AND i.camera_role = e.to_role
      LEFT JOIN zones zo ON zo.zone_id = o.last_zone_id LEFT JOIN zones zi ON zi.zone_id = i.first_zone_id
      WHERE i.started_at_global - o.ended_at_global BETWEEN min_transit_s AND max_transit_s))"""


_STATUS = "CASE {} WHEN 'STABLE' THEN 1.0e0 WHEN 'RECOVERED' THEN 0.82e0 WHEN 'OCCLUDED' THEN 0.65e0 WHEN 'AMBIGUOUS' THEN 0.0e0 ELSE 0.75e0 END"


def _score(name: str, gated: str, reid: bool = False) -> str:
    physical = "0.24e0 * temporal + 0.2e0 * dimensions + 0.16e0 * zone + 0.1e0 * speed + 0.1e0 * integrity"
    joined = f"{gated} g LEFT JOIN embeddings a ON a.vec_id = ovec LEFT JOIN embeddings b ON b.vec_id = ivec" if reid else f"{gated} g"
    similar = "(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + 1) / 2 AS reid" if reid else "NULL AS reid"
    total = f"({physical} + 0.32e0 * reid) / (0.8e0 + 0.32e0)" if reid else f"({physical}) / 0.8e0"
    return f""", {name} AS (SELECT *, {total} AS score, ({physical}) / 0.8e0 AS physical_score FROM (SELECT g.*, greatest(0, 1 - abs(transit_s - (min_transit_s + max_transit_s) / 2) / ((max_transit_s - min_transit_s) / 2)) AS temporal,
      (least(ow, iw) / greatest(ow, iw) + least(oh, ih) / greatest(oh, ih)) / 2 AS dimensions, CASE WHEN oz IS NOT NULL AND iz IS NOT NULL THEN 1.0e0 ELSE 0.6e0 END AS zone,
      least(ov, iv) / greatest(ov, iv) AS speed, least({_STATUS.format('os')}, {_STATUS.format('ist')}) AS integrity, {similar} FROM {joined} WHERE accepted))"""


_G = _T + _gates("gated", "tracklets", "tracklets")
_S = _G + _score("scored", "gated")
_S6 = f"{_S}, s6 AS (SELECT session_id, out_id AS out_tracklet_id, in_id AS in_tracklet_id, from_role, to_role, round(score, 6) AS score, round(physical_score, 6) AS physical_score, round(temporal, 6) AS temporal, zone, round(dimensions, 6) AS dimensions, integrity, os, ist FROM scored)"
_BEST = "best AS (SELECT * FROM (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS runner_up FROM s6 WINDOW w AS (PARTITION BY in_tracklet_id ORDER BY score DESC, out_tracklet_id)) WHERE k = 1)"
_MINED = f"""{_S6}, {_BEST}, pos AS (SELECT out_tracklet_id, in_tracklet_id, to_role, 'POSITIVE' AS label FROM best WHERE os = 'STABLE' AND ist = 'STABLE' AND temporal >= 0.65 AND zone >= 0.95 AND dimensions >= 0.7 AND integrity >= 0.95 AND physical_score >= 0.8 AND score - coalesce(runner_up, 0) >= 0.16),
  mined AS (SELECT out_tracklet_id, in_tracklet_id, label, min(to_role) AS to_role FROM (SELECT * FROM pos UNION ALL SELECT s.out_tracklet_id, s.in_tracklet_id, s.to_role, 'HARD_NEGATIVE' FROM s6 s JOIN pos p USING (in_tracklet_id, to_role) WHERE s.out_tracklet_id <> p.out_tracklet_id AND s.dimensions >= 0.6) GROUP BY ALL)"""

_W = f"""{_G}, placed AS (SELECT *, CASE WHEN local_track_id % 13 = 5 THEN 'AMBIGUOUS' WHEN local_track_id % 2 = 0 THEN 'STABLE' END AS own, CASE WHEN local_track_id % 7 = 3 THEN NULL WHEN local_track_id % 5 = 0 THEN 'W2' ELSE 'W1' END AS frame,
    avg_w / 4 AS fx, CASE WHEN local_track_id % 11 = 4 THEN 'nan'::DOUBLE ELSE avg_vx END AS fy, avg_h / 8 AS lx, CASE WHEN local_track_id % 6 <> 1 THEN avg_vx + 1 END AS ly FROM tracklets),
  met AS (SELECT g.*, coalesce(o.own, '') <> 'AMBIGUOUS' AND coalesce(i.own, '') <> 'AMBIGUOUS' AND coalesce(reason, '') <> 'IDENTITY_NOT_USABLE' AS usable, coalesce(o.frame = i.frame, false) AS same, CASE WHEN o.frame = i.frame AND NOT isnan(i.fy) THEN sqrt((i.fx - o.lx) ** 2 + (i.fy - o.ly) ** 2) END AS apart,
    CASE WHEN from_role = 'C1' THEN 1.5e0 ELSE 3.0e0 END * transit_s + 0.35e0 AS far FROM gated g JOIN placed o ON o.tracklet_id = out_id JOIN placed i ON i.tracklet_id = in_id),
  world AS (SELECT * REPLACE (CASE WHEN NOT usable THEN 'IDENTITY_NOT_USABLE' WHEN reason IS NOT NULL THEN reason WHEN apart > far THEN 'WORLD_TOO_FAR' END AS reason), CASE WHEN apart IS NOT NULL THEN greatest(0, 1 - apart / far) END AS near FROM met)"""

ORACLES = {
    "jn1_world_gates": f"""{_W} SELECT out_id AS out_tracklet_id, in_id AS in_tracklet_id, reason IS NULL AS accepted, reason, usable AS identity_usable, same AS same_world_frame, CASE WHEN NOT same THEN 'DIFFERENT_OR_UNKNOWN_FRAMES' WHEN apart IS NULL THEN 'MISSING_OR_INVALID_PLACES' END AS world_unavailable,
      round(apart, 6) AS world_distance_m, CASE WHEN apart IS NOT NULL THEN round(far, 6) END AS world_limit_m, round(near, 6) AS world FROM world""",
    "gr3_world_score": f"""{_W}{_score('plain', '(SELECT * REPLACE (reason IS NULL AS accepted) FROM world)')}
      SELECT out_id AS out_tracklet_id, in_id AS in_tracklet_id, round((physical_score * 0.8e0 + coalesce(0.08e0 * near, 0)) / CASE WHEN near IS NULL THEN 0.8e0 ELSE 0.88e0 END, 6) AS score, round((physical_score * 0.8e0 + coalesce(0.08e0 * near, 0)) / CASE WHEN near IS NULL THEN 0.8e0 ELSE 0.88e0 END, 6) AS physical_score FROM plain""",
    "jn1_handoff_gates": f"{_G} SELECT session_id, out_id AS out_tracklet_id, in_id AS in_tracklet_id, round(transit_s, 6) AS transit_s, accepted, reason FROM gated",
    "sc3_vector_similarity": f"{_G}{_score('scored', 'gated', True)} SELECT out_id AS out_tracklet_id, in_id AS in_tracklet_id, round(reid, 6) AS reid FROM scored",
    "gr3_handoff_score": f"{_G}{_score('scored', 'gated', True)} SELECT out_id AS out_tracklet_id, in_id AS in_tracklet_id, round(temporal, 6) AS temporal, round(dimensions, 6) AS dimensions, zone, round(speed, 6) AS speed, integrity, round(score, 6) AS score, round(physical_score, 6) AS physical_score FROM scored",
    "tk2_best_candidate": f"{_S6}, {_BEST} SELECT in_tracklet_id, out_tracklet_id, score, runner_up FROM best",
    "tk5_overflow": f"{_T} SELECT session_id, tracklet_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ended_at_global DESC, tracklet_id DESC) AS k FROM tracklets) WHERE k > 60",
    "gr1_components": f"""{_S.replace('WITH ', 'WITH RECURSIVE ', 1)}, e AS (SELECT out_id AS a, in_id AS b FROM scored WHERE round(score, 9) >= 0.9e0), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
      reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b) SELECT a AS id, min(b) AS component FROM reach GROUP BY a""",
    "gr2_topology_rank": f"{_T} SELECT camera_role AS role, CASE camera_role WHEN 'C1' THEN 0 WHEN 'C2' THEN 1 ELSE 2 END::BIGINT AS rank, count(*) AS tracklets FROM tracklets GROUP BY ALL",
    "gr7_chains_of_tracks": f"""{_T}, c AS (SELECT *, session_id || '/' || local_track_id AS parcel_id, lag(ended_at_global) OVER (PARTITION BY session_id, local_track_id ORDER BY started_at_global, tracklet_id) AS before FROM tracklets)
      SELECT parcel_id, count(*) AS n, string_agg(tracklet_id, '>' ORDER BY started_at_global, tracklet_id) AS chain, bool_and(coalesce(before <= started_at_global, true)) AS ordered, count(DISTINCT camera_role) = count(*) AS one_per_camera FROM c GROUP BY parcel_id""",
    "pf11_destination_result": f"{_T} SELECT tracklet_id, CASE WHEN first_zone_id IS NULL OR CASE WHEN avg_vx = 2 THEN first_zone_id ELSE last_zone_id END IS NULL THEN 'UNVERIFIED' WHEN first_zone_id = CASE WHEN avg_vx = 2 THEN first_zone_id ELSE last_zone_id END THEN 'SORT_OK' ELSE 'WRONG_DESTINATION' END AS destination_result FROM tracklets",
    "pf13_descriptor_reliable": f"{_T} SELECT tracklet_id, avg_w > 75 OR (local_track_id % 6 >= 3 AND integrity_status <> 'AMBIGUOUS') AS reliable FROM tracklets",
    "pf15_ingress_roles": f"{_T} SELECT camera_role, count(*) AS n FROM tracklets WHERE camera_role IN (SELECT from_role FROM edges EXCEPT SELECT to_role FROM edges) GROUP BY ALL",
    "ag13_pair_counts": f"{_MINED} SELECT l AS label, count(m.label) AS n FROM (VALUES ('POSITIVE'), ('HARD_NEGATIVE'), ('NEGATIVE')) v(l) LEFT JOIN mined m ON m.label = l GROUP BY ALL",
    "ag14_multi_view_descriptor": """WITH d AS (SELECT vec_id % 100 AS tracklet, i AS dim, median(embedding[i]::DOUBLE) AS value FROM embeddings, range(1, 65) r(i) WHERE i <= len(embedding) GROUP BY ALL), n AS (SELECT vec_id % 100 AS tracklet, count(*) AS view_count FROM embeddings GROUP BY ALL)
      SELECT tracklet, view_count, CASE WHEN view_count >= 3 THEN 'RELIABLE' ELSE 'LOW_VIEWS' END AS label, round(arg_min(value, dim) / sqrt(sum(value * value)), 6) AS d0, round(arg_max(value, dim) / sqrt(sum(value * value)), 6) AS d_last FROM d JOIN n USING (tracklet) GROUP BY ALL""",
    "ag17_insert_or_ignore": f"""{_T} SELECT session_id, camera_role, local_key, avg_w, tracklet_id FROM (SELECT *, local_track_id % 9 AS local_key, row_number() OVER (PARTITION BY session_id, camera_role, local_track_id % 9 ORDER BY avg_w, tracklet_id) AS k FROM tracklets)
      WHERE k = 1 AND local_key % 7 <> 0""",
    "ml2_mine_pairs": f"{_MINED} SELECT * FROM mined",
    "ml3_episode_split": f"""{_G}, p AS (SELECT concat_ws('|', session_id, concat_ws('>', from_role, to_role), in_id) AS episode, out_id, in_id FROM gated WHERE accepted), e AS (SELECT episode, row_number() OVER (ORDER BY sha256(episode), episode) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT episode FROM p))
      SELECT out_id AS out_tracklet_id, in_id AS right_id, k <= greatest(1, floor(n / 5)) AS held_out FROM p JOIN e USING (episode)""",
}
