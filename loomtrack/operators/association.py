"""Parcels followed through a site batch by batch, with hypotheses that later batches settle."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrack.functions.shared import written
from loomtrack.operators import resolutions
from loomtrack.operators.handoffs import CANDIDATES, MARGIN, MIN_SCORE, decide_wave, topology_rank

HYPOTHESES = f"hypothesis_id string, session_id string, incoming_id string, status string, candidates {CANDIDATES}, outgoing_id string, expires_at double"


class Site(NamedTuple):
    """What must be known of the past: recent tracklets with the parcel each belongs to (or null), and open hypotheses."""

    tracklets: DataFrame
    hypotheses: DataFrame


def current_holders(tracklets: DataFrame) -> DataFrame:
    """(tracklet_id, parcel_id): the last tracklet of each parcel."""
    last = F.max_by("tracklet_id", F.struct("started_at_global", "ended_at_global", "tracklet_id"))
    return tracklets.where("parcel_id IS NOT NULL").groupBy("parcel_id").agg(last.alias("tracklet_id")).select("tracklet_id", "parcel_id")


def associate(new: DataFrame, site: Site, edges: DataFrame, zones: DataFrame, vectors: DataFrame | None = None, least: float = MIN_SCORE, margin: float = MARGIN, window_s: float = 120.0) -> tuple[DataFrame, DataFrame | None, Site]:
    """Decides the tracklets ``new`` (GR6), wave by wave in order of topology rank, and what they settle (ST8).

    Before a wave is matched, its tracklets speak as later evidence for open hypotheses, also for those of earlier waves. An
    AMBIGUOUS tracklet, or an UNRESOLVED one with candidates, becomes a hypothesis for ``window_s`` seconds. Gives the decisions,
    the evidence (None where no hypothesis was open), and the next ``Site``; all are written tables.
    """
    ranks = {r["role"]: r["rank"] for r in topology_rank(edges).collect()}  # the site's roles
    known, open_ones = site
    decisions, evidence = [], []
    for rank in range(max(ranks.values(), default=0) + 1):
        wave = new.where(F.col("camera_role").isin([r for r, k in ranks.items() if k == rank]))
        if rank == 0:
            step = wave.select("session_id", "tracklet_id", F.concat(F.lit("g:"), "tracklet_id").alias("parcel_id"), F.lit("NEW_AT_INGRESS").alias("status"), F.lit(None).cast("string").alias("from_tracklet_id"), F.lit(None).cast("double").alias("score"), F.lit(None).cast(CANDIDATES).alias("candidates"))
        else:
            holders = current_holders(known).select("parcel_id", F.col("tracklet_id").alias("current_id"))
            if not open_ones.where("status = 'PENDING'").isEmpty():
                said = written(resolutions.later_evidence(open_ones, wave, known, holders, edges, vectors, least, margin), "association-evidence")
                evidence.append(said)
                open_ones, known, _ = resolutions.revised(said, open_ones, known, holders)
                open_ones, known = written(open_ones, "association-hypotheses"), written(known, "association-known")
            step = decide_wave(wave, known, written(current_holders(known), "association-holders"), edges, zones, vectors, least, margin)
        decisions.append(step)
        placed = wave.drop("parcel_id").join(step.select("tracklet_id", "parcel_id").hint("merge"), "tracklet_id", "left")
        known = written(known.unionByName(placed.select(*known.columns)), "association-known")
        doubtful = step.where("status = 'AMBIGUOUS' OR (status = 'UNRESOLVED' AND size(candidates) > 0)").join(wave.select("tracklet_id", "ended_at_global").hint("merge"), "tracklet_id")
        fresh = doubtful.select(F.concat(F.lit("h:"), "tracklet_id").alias("hypothesis_id"), "session_id", F.col("tracklet_id").alias("incoming_id"), F.lit("PENDING").alias("status"), "candidates", F.lit(None).cast("string").alias("outgoing_id"), (F.col("ended_at_global") + window_s).alias("expires_at"))
        open_ones = written(open_ones.unionByName(fresh), "association-hypotheses")
    decided = decisions[0]
    for step in decisions[1:]:
        decided = decided.unionByName(step)
    said = evidence[0] if evidence else None
    for more in evidence[1:]:
        said = said.unionByName(more)
    return decided, said, Site(known, open_ones)


def forget(site: Site, remember: float) -> Site:
    """``site`` without what can no longer matter: hypotheses that are settled or expired, and tracklets ``remember`` seconds older than
    their session's newest, unless their parcel, or an open hypothesis, has a newer one."""
    newest = site.tracklets.groupBy("session_id").agg(F.max("ended_at_global").alias("newest"))
    still = site.hypotheses.where("status = 'PENDING'").join(newest.hint("merge"), "session_id").where("expires_at > newest").drop("newest")
    of_parcel = site.tracklets.where("parcel_id IS NOT NULL").groupBy("parcel_id").agg(F.max("ended_at_global").alias("parcel_end"))
    named = still.select(F.explode(F.array_union(F.transform("candidates", lambda c: c["from_id"]), F.array("incoming_id"))).alias("tracklet_id")).distinct().withColumn("named", F.lit(True))
    rows = site.tracklets.join(newest.hint("merge"), "session_id").join(of_parcel.hint("merge"), "parcel_id", "left").join(named.hint("merge"), "tracklet_id", "left")
    recent = F.coalesce("parcel_end", "ended_at_global") >= F.col("newest") - remember
    return Site(rows.where(recent | F.col("named")).select(*site.tracklets.columns), still)
