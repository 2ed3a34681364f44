"""Registered queries of open handoffs: continuations, requests and later evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrack.functions.shared import written
from loomtrack.operators import handoffs, resolutions
from loomtrack.plans.handoffs import _G, _score
from loomtrack.sources import fixtures as fx

#: Scores closer than this are rivals in ``st8_later_evidence``; the test tables' tracklets are much alike.
CLOSE = 0.004


def _tables(spark, sf):
    """Tracklets of the first camera hold a parcel each; every later one with two or more scored candidates is a hypothesis."""
    base = fx.view(spark, sf, "tracklets")
    gated = handoffs.handoff_gates(base, base, fx.edges(spark), fx.zones(spark)).where("accepted")
    scored = handoffs.handoff_score(gated).select("session_id", "to_role", "in_bucket", "out_tracklet_id", "in_tracklet_id", F.round("score", 6).alias("score"))
    hypotheses = written(resolutions.open_hypotheses(scored, within=("to_role", "in_bucket")), "resolutions-hypotheses")  # read several times
    tracklets = base.withColumns({"camera_id": F.col("camera_role"), "parcel_id": F.when(F.col("camera_role") == "C1", F.concat(F.lit("g:"), "tracklet_id"))})
    parcels = tracklets.where("parcel_id IS NOT NULL").select("parcel_id", F.col("tracklet_id").alias("current_id"))
    return hypotheses, tracklets, parcels, fx.edges(spark)


def jn17_continuation_candidates(spark, sf):
    hypotheses, tracklets, _, edges = _tables(spark, sf)
    found = resolutions.continuations(hypotheses, tracklets, tracklets, edges)
    return found.select("session_id", "outgoing_id", "incoming_id", "later_id", F.round("evidence", 6).alias("evidence"), F.round("combined", 6).alias("combined"))


def _requests(hypotheses):
    """Every candidate of every hypothesis is asked for, best first; some hypotheses are rejected, some candidates are not theirs."""
    asked = hypotheses.select("session_id", "hypothesis_id", F.posexplode(F.reverse(F.sort_array(F.transform("candidates", lambda c: F.struct(c["score"], c["from_id"]))))).alias("k", "c"))
    other = F.length("hypothesis_id") % 2 == 0
    return asked.select(
        "session_id", F.concat_ws("/", "hypothesis_id", "k").alias("request_id"), F.col("k").cast("double").alias("requested_at"), "hypothesis_id",
        F.when(other & (F.col("k") == 1), F.substring("hypothesis_id", 3, 99)).otherwise(F.col("c.from_id")).alias("outgoing_id"), F.when(~other & (F.col("k") == 2), "REJECT").otherwise("RESOLVE").alias("action"),
    )


def st7_resolution_audit(spark, sf):
    hypotheses, tracklets, parcels, edges = _tables(spark, sf)
    out = resolutions.apply_resolutions(_requests(hypotheses), hypotheses, tracklets, parcels, edges)
    return out.select("session_id", "request_id", "outgoing_id", "outcome", "reason", "parcel_id", F.array_join("old_chain", ">").alias("old_chain"), F.array_join("new_chain", ">").alias("new_chain"))


def st8_later_evidence(spark, sf):
    hypotheses, tracklets, parcels, edges = _tables(spark, sf)
    out = resolutions.later_evidence(hypotheses, tracklets, tracklets, parcels, edges, margin=CLOSE, digits=6)
    return out.select("session_id", "later_id", "hypothesis_id", "outgoing_id", "outcome", "reason", "parcel_id", "combined", "runner_up")


QUERIES = {f.__name__: f for f in (jn17_continuation_candidates, st7_resolution_audit, st8_later_evidence)}

_H = f"""{_G.replace('WITH ', 'WITH RECURSIVE ', 1)}{_score('scored', 'gated')},
  cand AS (SELECT session_id, 'h:' || in_id AS hypothesis_id, in_id AS incoming_id, out_id AS outgoing_id, round(score, 6) AS score FROM scored WHERE round(score, 6) >= 0.48e0 QUALIFY count(*) OVER (PARTITION BY session_id, in_id) >= 2),
  props AS (SELECT c.*, l.tracklet_id AS later_id, l.ended_at_global AS later_end, (least(o.avg_w, l.avg_w) / greatest(o.avg_w, l.avg_w, 1e-6) + least(o.avg_h, l.avg_h) / greatest(o.avg_h, l.avg_h, 1e-6)) / 2 AS evidence
    FROM cand c JOIN tracklets i ON i.tracklet_id = c.incoming_id JOIN edges e ON e.from_role = i.camera_role
    JOIN tracklets l ON l.session_id = c.session_id AND l.camera_role = e.to_role AND l.started_at_global - i.ended_at_global BETWEEN e.min_transit_s AND e.max_transit_s JOIN tracklets o ON o.tracklet_id = c.outgoing_id)"""

ORACLES = {
    "jn17_continuation_candidates": f"{_H} SELECT session_id, outgoing_id, incoming_id, later_id, round(evidence, 6) AS evidence, round(0.6e0 * score + 0.4e0 * evidence, 6) AS combined FROM props",
    # one step of the recursion per request (or later tracklet) of a session, in order
    "st7_resolution_audit": f"""{_H},
      asked AS (SELECT *, row_number() OVER (PARTITION BY hypothesis_id ORDER BY score DESC, outgoing_id DESC) - 1 AS k FROM cand),
      req AS (SELECT session_id, hypothesis_id, incoming_id, hypothesis_id || '/' || k AS request_id, length(hypothesis_id) % 2 = 0 AND k = 1 AS wrong, length(hypothesis_id) % 2 = 1 AND k = 2 AS reject,
        CASE WHEN length(hypothesis_id) % 2 = 0 AND k = 1 THEN incoming_id ELSE outgoing_id END AS outgoing_id, row_number() OVER (PARTITION BY session_id ORDER BY k, hypothesis_id || '/' || k) AS n FROM asked),
      step AS (
        SELECT session_id, 0::BIGINT AS n, NULL::VARCHAR AS request_id, NULL::VARCHAR AS outgoing_id, NULL::VARCHAR AS outcome, NULL::VARCHAR AS reason, NULL::VARCHAR AS parcel_id, NULL::VARCHAR AS old_chain, NULL::VARCHAR AS new_chain,
          []::VARCHAR[] AS closed, []::VARCHAR[] AS used, MAP {{}}::MAP(VARCHAR, VARCHAR) AS chains FROM (SELECT DISTINCT session_id FROM req)
        UNION ALL
        SELECT session_id, n, request_id, outgoing_id, CASE WHEN reason IS NOT NULL THEN 'REFUSED' WHEN reject THEN 'REJECTED' ELSE 'RESOLVED' END, reason,
          CASE WHEN reason IS NULL AND NOT reject THEN 'g:' || split_part(before, '>', 1) END, CASE WHEN reason IS NULL AND NOT reject THEN before ELSE '' END, CASE WHEN reason IS NULL AND NOT reject THEN before || '>' || incoming_id ELSE '' END,
          CASE WHEN reason IS NULL THEN list_append(closed, hypothesis_id) ELSE closed END, CASE WHEN reason IS NULL AND NOT reject THEN list_append(used, outgoing_id) ELSE used END,
          CASE WHEN reason IS NULL AND NOT reject THEN map_concat(chains, MAP {{incoming_id: before || '>' || incoming_id}}) ELSE chains END
        FROM (SELECT r.*, s.closed, s.used, s.chains, CASE WHEN t.camera_role = 'C1' THEN r.outgoing_id ELSE s.chains[r.outgoing_id] END AS before,
                CASE WHEN list_contains(s.closed, r.hypothesis_id) THEN 'NOT_PENDING' WHEN r.reject THEN NULL WHEN r.wrong THEN 'NOT_A_CANDIDATE' WHEN t.camera_role <> 'C1' AND s.chains[r.outgoing_id] IS NULL THEN 'NO_PARCEL' WHEN list_contains(s.used, r.outgoing_id) THEN 'PARCEL_MOVED_ON' END AS reason
              FROM step s JOIN req r ON r.session_id = s.session_id AND r.n = s.n + 1 JOIN tracklets t ON t.tracklet_id = r.outgoing_id))
      SELECT session_id, request_id, outgoing_id, outcome, reason, parcel_id, old_chain, new_chain FROM step WHERE n > 0""",
    "st8_later_evidence": f"""{_H},
      each AS (SELECT session_id, later_id, later_end, list(struct_pack(c := -round(0.6e0 * score + 0.4e0 * evidence, 6), h := hypothesis_id, o := outgoing_id, i := incoming_id) ORDER BY -round(0.6e0 * score + 0.4e0 * evidence, 6), hypothesis_id, outgoing_id) AS ps FROM props GROUP BY ALL),
      laters AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY later_end, later_id) AS n FROM each),
      step AS (
        SELECT session_id, 0::BIGINT AS n, NULL::VARCHAR AS later_id, NULL::VARCHAR AS hypothesis_id, NULL::VARCHAR AS outgoing_id, NULL::VARCHAR AS outcome, NULL::VARCHAR AS reason, NULL::VARCHAR AS parcel_id, NULL::DOUBLE AS combined, NULL::DOUBLE AS runner_up,
          []::VARCHAR[] AS closed, []::VARCHAR[] AS used FROM (SELECT DISTINCT session_id FROM laters)
        UNION ALL
        SELECT session_id, n, later_id, best.h, best.o, CASE WHEN best IS NULL THEN NULL WHEN reason IS NULL THEN 'RESOLVED' WHEN reason IN ('SCORE_TOO_LOW', 'RIVAL_TOO_CLOSE') THEN 'HELD' ELSE 'REFUSED' END, reason,
          CASE WHEN best IS NOT NULL AND reason IS NULL THEN 'g:' || best.o END, -best.c, -second, CASE WHEN best IS NOT NULL AND reason IS NULL THEN list_append(closed, best.h) ELSE closed END, CASE WHEN best IS NOT NULL AND reason IS NULL THEN list_append(used, best.o) ELSE used END
        FROM (SELECT *, CASE WHEN -best.c < 0.48e0 THEN 'SCORE_TOO_LOW' WHEN -best.c - coalesce(-second, 0) < {CLOSE}e0 THEN 'RIVAL_TOO_CLOSE' WHEN list_contains(used, best.o) THEN 'PARCEL_MOVED_ON' END AS reason
              FROM (SELECT session_id, n, later_id, closed, used, still[1] AS best, still[2].c AS second
                    FROM (SELECT l.session_id, l.n, l.later_id, s.closed, s.used, [p for p in l.ps if NOT list_contains(s.closed, p.h)] AS still FROM step s JOIN laters l ON l.session_id = s.session_id AND l.n = s.n + 1))))
      SELECT session_id, later_id, hypothesis_id, outgoing_id, outcome, reason, parcel_id, combined, runner_up FROM step WHERE outcome IS NOT NULL""",
}
