"""Cross-camera handoffs: gates, scores, assignment and resolution over tracklet tables."""

from __future__ import annotations

from math import inf

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrack.functions.shared import dimension, shared_dir, written
from loomtrack.operators import matching
from loomtrack.operators.graph import connected_components, contracted
from loomtrack.operators.keyed import Fold, fold_frames

MIN_SCORE, MARGIN = 0.48, 0.08
#: Seconds in a bucket of the transit range join.
BUCKET_S = 10.0
#: Weight of an integrity status (any other: 0.75).
INTEGRITY = {"STABLE": 1.0, "RECOVERED": 0.82, "OCCLUDED": 0.65, "AMBIGUOUS": 0.0}
WEIGHTS = {"temporal": 0.24, "dimensions": 0.20, "zone": 0.16, "speed": 0.10, "integrity": 0.10, "world": 0.08, "reid": 0.32}

#: Metres a second between cameras where an edge names no limit of its own, and metres of tolerance.
MAX_SPEED_M_S, SLACK_M = 3.0, 0.35
#: Tracklet columns that may be missing: the summary's own integrity status, and its first and last place in a world frame (metres).
OPTIONAL = {"summary_status": "string", "world_frame_id": "string", "first_world_x": "double", "first_world_y": "double", "last_world_x": "double", "last_world_y": "double"}

SIDE = ("tracklet_id", "camera_role", "started_at_global", "ended_at_global", "local_track_id", "avg_w", "avg_h", "avg_vx", "avg_vy", "first_zone_id", "last_zone_id", "integrity_status", "vec_id")


def _side(tracklets: DataFrame, prefix: str) -> DataFrame:
    known = [F.col(c) if c in tracklets.columns else F.lit(None).cast(kind).alias(c) for c, kind in OPTIONAL.items()]
    return tracklets.select("session_id", *SIDE, *known).select("session_id", *(F.col(c).alias(f"{prefix}_{c}") for c in (*SIDE, *OPTIONAL)))


def handoff_gates(outgoing: DataFrame, incoming: DataFrame, edges: DataFrame, zones: DataFrame) -> DataFrame:
    """Pairs along a topology edge with a transit in its window (JN1), ``accepted`` or with the first failing ``reason``.

    The transit range is an equality join on (session, roles, time bucket) and a check. Later
    gates, in order: both identities usable (ids not negative, none of the four status fields AMBIGUOUS); the zones left and entered are an exit and an
    entry (an unknown zone passes); within one world frame the way is no longer than the edge's ``max_speed_m_s`` (else ``MAX_SPEED_M_S``) allows in the transit, plus
    ``SLACK_M``. Places in different or unknown frames, missing or not finite ones pass. Every pair carries the evidence of all gates; ``world`` is 1 at distance 0 and 0 at the limit. Edges and zones are small
    dimensions and broadcast, if counted so.
    """
    kinds = zones.select("zone_id", "kind")
    links = dimension(edges if "max_speed_m_s" in edges.columns else edges.withColumn("max_speed_m_s", F.lit(None).cast("double")))
    out = _side(outgoing, "out").join(links, F.col("out_camera_role") == F.col("from_role")).join(dimension(kinds.toDF("out_last_zone_id", "out_kind")), "out_last_zone_id", "left")
    first, last = (F.floor((F.col("out_ended_at_global") + F.col(c)) / BUCKET_S) for c in ("min_transit_s", "max_transit_s"))
    out = out.withColumn("bucket", F.explode(F.sequence(first, last)))
    inc = _side(incoming, "in").join(dimension(kinds.toDF("in_first_zone_id", "in_kind")), "in_first_zone_id", "left").withColumns({"bucket": F.floor(F.col("in_started_at_global") / BUCKET_S), "to_role": F.col("in_camera_role")})
    pairs = out.join(inc.hint("merge"), ["session_id", "to_role", "bucket"]).withColumn("transit_s", F.col("in_started_at_global") - F.col("out_ended_at_global")).where("transit_s BETWEEN min_transit_s AND max_transit_s")
    is_so = lambda c: F.coalesce(c, F.lit(False))
    unusable = [F.col(f"{p}_local_track_id") < 0 for p in ("out", "in")] + [F.col(f"{p}_{c}") == "AMBIGUOUS" for p in ("out", "in") for c in ("integrity_status", "summary_status")]
    identity_usable = ~F.greatest(*map(is_so, unusable))
    same_frame = is_so((F.col("out_world_frame_id") != "") & (F.col("out_world_frame_id") == F.col("in_world_frame_id")))
    apart = F.hypot(F.col("in_first_world_x") - F.col("out_last_world_x"), F.col("in_first_world_y") - F.col("out_last_world_y"))
    finite = is_so(~F.isnan(apart) & (F.abs(apart) < float("inf")))
    pairs = pairs.withColumns({
        "identity_usable": identity_usable, "same_world_frame": same_frame,
        "world_distance_m": F.when(same_frame & finite, apart), "world_limit_m": F.when(same_frame & finite, F.coalesce("max_speed_m_s", F.lit(MAX_SPEED_M_S)) * F.col("transit_s") + SLACK_M),
        "world_unavailable": F.when(~same_frame, "DIFFERENT_OR_UNKNOWN_FRAMES").when(~finite, "MISSING_OR_INVALID_PLACES"),
    })
    checks = (("IDENTITY_NOT_USABLE", ~F.col("identity_usable")), ("NOT_AN_EXIT", is_so(F.col("out_kind") != "exit")), ("NOT_AN_ENTRY", is_so(F.col("in_kind") != "entry")), ("WORLD_TOO_FAR", is_so(F.col("world_distance_m") > F.col("world_limit_m"))))
    reason = F.coalesce(*(F.when(fails, name) for name, fails in checks))
    pairs = pairs.withColumnRenamed("bucket", "in_bucket").drop("max_speed_m_s").withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())
    return pairs.withColumn("world", F.when(F.col("world_limit_m") > 0, F.greatest(F.lit(0.0), 1 - F.col("world_distance_m") / F.col("world_limit_m"))))


def with_reid(gated: DataFrame, vectors: DataFrame) -> DataFrame:
    """Adds ``reid``, the cosine of both vectors mapped to 0..1 (SC3); only surviving pairs fetch vectors."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    units = vectors.withColumn("__norm", norm).select("vec_id", F.when(F.col("__norm") > 0, F.transform("embedding", lambda x: x / F.col("__norm"))).alias("unit"))  # once for each vector, not for each pair
    v = lambda p: units.select(F.col("vec_id").alias(f"{p}_vec_id"), F.col("unit").alias(f"{p}_vector"))
    dot = F.aggregate(F.zip_with("out_vector", "in_vector", lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    return gated.join(v("out").hint("merge"), "out_vec_id", "left").join(v("in").hint("merge"), "in_vec_id", "left").withColumn("reid", F.when(F.size("out_vector") == F.size("in_vector"), (dot + 1) / 2)).drop("out_vector", "in_vector")


def similarity(a: str, b: str) -> Column:
    """(cosine + 1) / 2; null for null, zero or unequally long vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), (dot(a, b) / norms + 1) / 2)


def handoff_score(pairs: DataFrame) -> DataFrame:
    """Adds the part scores, ``score`` and ``physical_score`` (without reid): GR3.

    Each is the weighted mean over the parts that are there (``reid`` may be null or absent).
    """
    ratio = lambda a, b: F.when(F.greatest(a, b) > 0, F.least(a, b) / F.greatest(a, b)).otherwise(1.0)
    mid, half = (F.col("min_transit_s") + F.col("max_transit_s")) / 2, (F.col("max_transit_s") - F.col("min_transit_s")) / 2
    status = lambda p: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in INTEGRITY.items() for x in kv)), F.col(f"{p}_integrity_status")), F.lit(0.75))
    speed = lambda p: F.hypot(f"{p}_avg_vx", f"{p}_avg_vy")
    parts = {
        "temporal": F.greatest(F.lit(0.0), 1 - F.abs(F.col("transit_s") - mid) / half),
        "dimensions": (ratio(F.col("out_avg_w"), F.col("in_avg_w")) + ratio(F.col("out_avg_h"), F.col("in_avg_h"))) / 2,
        "zone": F.when(F.col("out_last_zone_id").isNotNull() & F.col("in_first_zone_id").isNotNull(), 1.0).otherwise(0.6),
        "speed": ratio(speed("out"), speed("in")),
        "integrity": F.least(status("out"), status("in")),
    }
    scored = pairs.withColumns(parts)
    named = [*parts, *(c for c in ("world", "reid") if c in pairs.columns)]

    def mean(names: list[str]) -> Column:
        total = sum((F.coalesce(F.col(n) * WEIGHTS[n], F.lit(0.0)) for n in names), F.lit(0.0))
        weight = sum((F.when(F.col(n).isNotNull(), WEIGHTS[n]).otherwise(0.0) for n in names), F.lit(0.0))
        return total / weight

    return scored.withColumns({"score": mean(named), "physical_score": mean([n for n in named if n != "reid"])})


def linked(scored: DataFrame, least: float, score: str = "score") -> DataFrame:
    """Rows whose score, to nine decimals, is at least ``least``: a score that is the limit but for its rounding error counts."""
    return scored.where(F.round(score, 9) >= least)


def best_candidate(scored: DataFrame, key: str = "in_tracklet_id") -> DataFrame:
    """Adds nothing but keeps, per ``key``, the best row with the runner-up's score (TK2); ties go to the smaller other id."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "out_tracklet_id")
    return scored.withColumns({"rank": F.row_number().over(w), "runner_up": F.lead("score").over(w)}).where("rank = 1").drop("rank")


def overflow(pending: DataFrame, most: int, group: str = "session_id", order: str = "ended_at_global") -> DataFrame:
    """The oldest rows beyond the newest ``most`` of a group (TK5)."""
    w = Window.partitionBy(group).orderBy(F.desc(order), F.desc("tracklet_id"))
    return pending.withColumn("rank", F.row_number().over(w)).where(F.col("rank") > most).drop("rank")


#: Left and right nodes up to which lists are faster than arrays.
SMALL = 100


def _solve_small(gain: list[list[float]], n: int, m: int) -> list[tuple[int, int]]:
    """``_solve`` step by step, without arrays: the same pairs, ties included."""
    size = n + m
    cost = [[-g if g > 0 else 1e6 for g in row] + [0.0] * n for row in gain] + [[0.0] * size] * m
    u, v, match = [0.0] * (size + 1), [0.0] * (size + 1), [0] * (size + 1)
    for row in range(1, size + 1):
        match[0], column = row, 0
        least, way, used, free = [inf] * (size + 1), [0] * (size + 1), [0], list(range(1, size + 1))
        while True:
            costs, up = cost[match[column] - 1], u[match[column]]
            nxt, delta = free[0], inf
            for j in free:
                slack = costs[j - 1] - up - v[j]
                if slack < least[j]:
                    least[j], way[j] = slack, column
                if least[j] < delta:
                    nxt, delta = j, least[j]
            if delta:
                for j in used:
                    u[match[j]] += delta
                    v[j] -= delta
                for j in free:
                    least[j] -= delta
            column = nxt
            if match[column] == 0:
                break
            used.append(column)
            free.remove(column)
        while column:
            match[column] = match[way[column]]
            column = way[column]
    return [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j] - 1 < n and gain[match[j] - 1][j - 1] > 0]


def _solve(gain: np.ndarray) -> list[tuple[int, int]]:
    """One-to-one pairs of largest total gain, only pairs of positive gain; shortest augmenting paths."""
    n, m = gain.shape
    size = n + m  # everyone may stay alone at gain 0
    if size <= SMALL:
        return _solve_small(gain.tolist(), n, m)
    cost = np.zeros((size, size))
    cost[:n, :m] = np.where(gain > 0, -gain, 1e6)
    u, v, match = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1, np.int64)
    for row in range(1, size + 1):
        match[0], column = row, 0
        least, way, used = np.full(size + 1, np.inf), np.zeros(size + 1, np.int64), np.zeros(size + 1, bool)
        while True:
            used[column] = True
            slack = cost[match[column] - 1] - u[match[column]] - v[1:]
            free = ~used[1:]
            better = free & (slack < least[1:])
            least[1:][better], way[1:][better] = slack[better], column
            nxt = int(np.where(free, least[1:], np.inf).argmin()) + 1
            delta = least[nxt]
            u[match[used]] += delta
            v[used] -= delta
            least[1:][free] -= delta
            column = nxt
            if match[column] == 0:
                break
        while column:
            match[column] = match[way[column]]
            column = way[column]
    return [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j] - 1 < n and gain[match[j] - 1, j - 1] > 0]


def assign_one_to_one(scored: DataFrame, left: str, right: str, score: str = "score", least: float = MIN_SCORE, margin: float = MARGIN, near: str | None = None) -> DataFrame:
    """(left, right, score, ambiguous): the best one-to-one matching of a table of candidate pairs (GR4, GR5)."""
    return judge_candidates(scored, left, right, score, least, margin, near).where("chosen").drop("chosen")


class _Contest(Fold):
    """The candidates of one connected group, matched."""

    def __init__(self, least: float, margin: float):
        self.least, self.margin = least, margin

    def frame(self, rows: list[tuple]) -> list[tuple]:
        return matching.assign(rows, self.least, self.margin)


def judge_candidates(scored: DataFrame, left: str, right: str, score: str = "score", least: float = MIN_SCORE, margin: float = MARGIN, near: str | None = None) -> DataFrame:
    """(left, right, score, chosen, ambiguous): the matched pairs, and the best candidate of each right id that is ambiguous without a match.

    The objective is separable, so connected groups of candidates are solved apart: a lone
    pair by a filter, the others each by ``matching.assign`` as they stream by in order, which holds a group's candidate list. A group is as
    large as the set of tracklets that compete for each other, not as the session. ``near``: a column that candidates of a group mostly share; it
    changes no result, but lets a task contract most of a group before the groups are joined.
    """
    place = F.xxhash64(near) if near else F.lit(0).cast("long")
    pairs = written(scored.select(F.col(left).alias("l"), F.col(right).alias("r"), F.col(score).alias("s"), place.alias("near")), "assign-pairs")  # no filter works a score out again
    edges = written(pairs.where(F.col("s") >= least).groupBy("l", "r").agg(F.max("s").alias("s"), F.min("near").alias("near")), "assign-edges")
    degree = lambda c: edges.groupBy(c).agg(F.count("*").alias(f"n{c}")).hint("merge")
    counted = written(edges.join(degree("l"), "l").join(degree("r"), "r"), "assign-degrees")
    alone = counted.where("nl = 1 AND nr = 1").select("l", "r", "s", F.lit(True).alias("chosen"), F.lit(False).alias("ambiguous"))
    contested = counted.where("nl > 1 OR nr > 1").select("l", "r", "s", "near")
    if contested.isEmpty():
        return alone.toDF(left, right, score, "chosen", "ambiguous")
    links = (contested.repartition(4 * contested.sparkSession.sparkContext.defaultParallelism, "near") if near else contested).select(F.concat(F.lit("l:"), "l").alias("a"), F.concat(F.lit("r:"), "r").alias("b"))
    parts = connected_components(contracted(links, "a", "b"), "a", "b")
    grouped = contested.withColumn("id", F.concat(F.lit("l:"), "l")).join(parts.hint("merge"), "id").drop("id")
    kinds = {c: edges.schema[c].dataType.simpleString() for c in ("l", "r")}
    several = fold_frames(grouped, ["component"], [], ["l", "r", "s"], lambda: _Contest(least, margin), f"l_ {kinds['l']}, r_ {kinds['r']}, s_ double, chosen boolean, ambiguous boolean")
    return alone.unionByName(several.drop("component").toDF("l", "r", "s", "chosen", "ambiguous")).toDF(left, right, score, "chosen", "ambiguous")


def topology_rank(edges: DataFrame) -> DataFrame:
    """(role, rank): longest path from a role without incoming edges, at most one round per edge (GR2).

    The edge table is a site's topology (tens of rows): each round is one small join.
    """
    shared_dir(edges.sparkSession)
    roles = edges.select(F.col("from_role").alias("role")).union(edges.select("to_role")).distinct()
    ranks = roles.withColumn("rank", F.lit(0))
    for _ in range(edges.count() + 1):
        step = edges.join(ranks, edges["from_role"] == ranks["role"]).groupBy("to_role").agg((F.max("rank") + 1).alias("next"))
        new = roles.join(step, roles["role"] == step["to_role"], "left").select("role", F.coalesce("next", F.lit(0)).alias("rank")).checkpoint()
        if new.exceptAll(ranks).isEmpty():
            return new
        ranks = new
    return ranks


def ingress_roles(edges: DataFrame) -> DataFrame:
    """Roles that nothing leads to (PF15); without such a role, every role."""
    starts = edges.select(F.col("from_role").alias("role")).distinct()
    free = starts.join(edges.select(F.col("to_role").alias("role")), "role", "left_anti")
    every = starts.union(edges.select("to_role")).distinct()
    return free.unionByName(every.join(free.agg(F.count("*").alias("n")).where("n = 0"), how="cross").select("role"))  # one row at most on the right


def resolve_handoffs(tracklets: DataFrame, edges: DataFrame, zones: DataFrame, vectors: DataFrame | None = None, least: float = MIN_SCORE, margin: float = MARGIN) -> DataFrame:
    """(session_id, tracklet_id, parcel_id, status, from_tracklet_id, score): GR6.

    Roles are taken in order of topology rank, all sessions at once. Only the current
    tracklet of a parcel is a candidate; a clear match moves the parcel to the incoming
    tracklet. Tracklets at ingress start parcels; the others are MATCHED, AMBIGUOUS (an unclear match, or a close rival
    of one that is clear) or UNRESOLVED, and only matched ones carry a parcel on. The loop runs once per rank.
    """
    return resolve_batch(tracklets, tracklets, None, edges, zones, vectors, least, margin).drop("candidates")


def resolve_batch(tracklets: DataFrame, new_tracklets: DataFrame, current: DataFrame | None, edges: DataFrame, zones: DataFrame, vectors: DataFrame | None = None, least: float = MIN_SCORE, margin: float = MARGIN) -> DataFrame:
    """``resolve_handoffs`` of ``new_tracklets`` alone, where ``current`` says which tracklet holds which parcel before.

    ``candidates`` lists (from_id, score) of all that passed the gates, for AMBIGUOUS and UNRESOLVED rows: what a hypothesis needs.
    """
    ranks = {r["role"]: r["rank"] for r in topology_rank(edges).collect()}  # the site's roles
    at = lambda rank: new_tracklets.where(F.col("camera_role").isin([r for r, k in ranks.items() if k == rank]))
    new = at(0).select("session_id", "tracklet_id", F.concat(F.lit("g:"), "tracklet_id").alias("parcel_id"), F.lit("NEW_AT_INGRESS").alias("status"), F.lit(None).cast("string").alias("from_tracklet_id"), F.lit(None).cast("double").alias("score"), F.lit(None).cast(CANDIDATES).alias("candidates"))
    decided = written(new, "handoffs-0")
    started = decided.select("tracklet_id", "parcel_id")
    current = started if current is None else current.unionByName(started)
    for rank in range(1, max(ranks.values(), default=0) + 1):
        step = decide_wave(at(rank), tracklets, current, edges, zones, vectors, least, margin)
        decided = decided.unionByName(step)
        moved = step.where("status = 'MATCHED'")
        current = written(current.join(moved.select(F.col("from_tracklet_id").alias("tracklet_id")).hint("merge"), "tracklet_id", "left_anti").unionByName(moved.select("tracklet_id", "parcel_id")), "handoffs-current")
    return decided


#: The candidates of a tracklet without a clear match.
CANDIDATES = "array<struct<from_id:string,score:double>>"


def decide_wave(wave: DataFrame, tracklets: DataFrame, current: DataFrame, edges: DataFrame, zones: DataFrame, vectors: DataFrame | None, least: float, margin: float) -> DataFrame:
    """The decisions on the tracklets ``wave``, none of which leads to another, where ``current`` (tracklet_id, parcel_id) says who holds which parcel; written."""
    holders = tracklets.join(current.select("tracklet_id").hint("merge"), "tracklet_id")
    gated = handoff_gates(holders, wave, edges, zones).where("accepted")
    scored = written(handoff_score(with_reid(gated, vectors) if vectors is not None else gated).select("session_id", "out_tracklet_id", "in_tracklet_id", "score"), "handoffs-scored")
    judged = written(judge_candidates(scored, "out_tracklet_id", "in_tracklet_id", "score", least, margin, "session_id"), "handoffs-judged")
    status = F.when(F.col("ambiguous"), "AMBIGUOUS").otherwise("MATCHED")
    found = judged.join(current.select(F.col("tracklet_id").alias("out_tracklet_id"), "parcel_id").hint("merge"), "out_tracklet_id").select(F.col("in_tracklet_id").alias("tracklet_id"), F.when(~F.col("ambiguous"), F.col("parcel_id")).alias("parcel_id"), status.alias("status"), F.col("out_tracklet_id").alias("from_tracklet_id"), "score")
    seen = scored.groupBy(F.col("in_tracklet_id").alias("tracklet_id")).agg(F.sort_array(F.collect_list(F.struct(F.col("out_tracklet_id").alias("from_id"), "score"))).alias("seen"))  # those in one transit window
    step = wave.select("session_id", "tracklet_id").join(found.hint("merge"), "tracklet_id", "left").join(seen.hint("merge"), "tracklet_id", "left").withColumn("status", F.coalesce("status", F.lit("UNRESOLVED")))
    return written(step.withColumn("candidates", F.when(F.col("status") != "MATCHED", F.coalesce("seen", F.array().cast(CANDIDATES)))).drop("seen"), "handoffs-wave")


def parcel_chains(decided: DataFrame, tracklets: DataFrame) -> DataFrame:
    """(parcel_id, n, chain, ordered, one_per_camera): GR7."""
    w = Window.partitionBy("parcel_id").orderBy("started_at_global", "tracklet_id")
    rows = decided.where("parcel_id IS NOT NULL").select("parcel_id", "tracklet_id").join(tracklets, "tracklet_id").withColumn("before", F.lag("ended_at_global").over(w))
    listed = F.array_sort(F.collect_list(F.struct("started_at_global", "tracklet_id")))
    return rows.groupBy("parcel_id").agg(
        F.count("*").alias("n"), F.array_join(F.transform(listed, lambda t: t["tracklet_id"]), ">").alias("chain"),
        F.bool_and(F.coalesce(F.col("before") <= F.col("started_at_global"), F.lit(True))).alias("ordered"), (F.countDistinct("camera_role") == F.count("*")).alias("one_per_camera"),
    )


def destination_result(parcels: DataFrame) -> DataFrame:
    """Adds ``destination_result`` (PF11): UNVERIFIED if either side is null."""
    known = F.col("expected_destination").isNotNull() & F.col("observed_destination").isNotNull()
    return parcels.withColumn("destination_result", F.when(~known, "UNVERIFIED").when(F.col("expected_destination") == F.col("observed_destination"), "SORT_OK").otherwise("WRONG_DESTINATION"))


def descriptor_reliable(descriptors: DataFrame, least_views: int = 3) -> DataFrame:
    """Adds ``reliable`` (PF13): enough views and a quality that is not LOW; a legacy vector counts as reliable."""
    return descriptors.withColumn("reliable", F.coalesce("legacy", F.lit(False)) | ((F.col("view_count") >= least_views) & (F.col("quality") != "LOW")))


def multi_view_descriptor(views: DataFrame, keys: list[str], least_views: int = 3) -> DataFrame:
    """(keys, aggregate, view_count, label): per-dimension median of the views, L2-normalized (AG14)."""
    spread = views.select(*keys, F.posexplode("embedding").alias("dim", "value"))
    medians = spread.groupBy(*keys, "dim").agg(F.median("value").alias("value"))
    sized = views.groupBy(*keys).agg(F.count("*").alias("view_count"))
    joined = medians.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("d"), F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm")).join(sized.hint("merge"), keys)
    return joined.select(*keys, F.transform("d", lambda x: F.when(F.col("norm") > 0, x["value"] / F.col("norm")).otherwise(x["value"])).alias("aggregate"), "view_count", F.when(F.col("view_count") >= least_views, "RELIABLE").otherwise("LOW_VIEWS").alias("label"))


def mine_pairs(scored: DataFrame, margin: float = MARGIN) -> DataFrame:
    """(left, right, label): training pairs from clear handoffs (ML2), first per natural key (AG17).

    POSITIVE: stable on both sides with strong evidence and a wide margin to the runner-up.
    HARD_NEGATIVE: a rival of a positive on the same edge with like dimensions.
    """
    best = best_candidate(scored)
    strong = (
        (F.col("out_integrity_status") == "STABLE") & (F.col("in_integrity_status") == "STABLE") & (F.col("temporal") >= 0.65) & (F.col("zone") >= 0.95)
        & (F.col("dimensions") >= 0.70) & (F.col("integrity") >= 0.95) & (F.col("physical_score") >= 0.80)
        & (F.col("score") - F.coalesce("runner_up", F.lit(0.0)) >= max(0.16, 2 * margin))
    )
    positive = best.where(strong).select("out_tracklet_id", "in_tracklet_id", "to_role", F.lit("POSITIVE").alias("label"))
    won = positive.select(F.col("out_tracklet_id").alias("won"), "in_tracklet_id", "to_role")
    negative = scored.join(won.hint("merge"), ["in_tracklet_id", "to_role"]).where((F.col("out_tracklet_id") != F.col("won")) & (F.col("dimensions") >= 0.60)).select("out_tracklet_id", "in_tracklet_id", "to_role", F.lit("HARD_NEGATIVE").alias("label"))
    return insert_or_ignore(positive.unionByName(negative), ["out_tracklet_id", "in_tracklet_id", "label"])


def insert_or_ignore(rows: DataFrame, key: list[str], existing: DataFrame | None = None) -> DataFrame:
    """One row per natural key, without keys that ``existing`` has (AG17).

    Of the rows of a key the smallest one stays, whole: compared column by column in the table's order, nulls first.
    """
    rest = [c for c in rows.columns if c not in key]
    first = rows.groupBy(*key).agg(F.min(F.struct(*rest)).alias("__first")).select(*(F.col(c) if c in key else F.col("__first")[c].alias(c) for c in rows.columns)) if rest else rows.distinct()
    return first if existing is None else first.join(existing.select(*key), key, "left_anti")


def episode_split(pairs: DataFrame) -> DataFrame:
    """Adds ``held_out`` (ML3): episodes in sha256 order, the first fifth (at least one) is held out."""
    name = F.concat_ws("|", "session_id", "edge", "right_id")
    episodes = pairs.select(name.alias("episode")).distinct().withColumn("h", F.sha2("episode", 256))
    cut = episodes.agg(F.greatest(F.lit(1), F.floor(F.count("*") / 5)).alias("n"))
    # rank by the count of smaller hashes: bucketed by the leading hex digits, so no single task sorts all episodes
    lead = episodes.withColumn("lead", F.substring("h", 1, 3))
    below = lead.groupBy("lead").agg(F.count("*").alias("k")).withColumn("before", F.coalesce(F.sum("k").over(Window.orderBy("lead").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # at most 4096 rows
    placed = lead.join(F.broadcast(below.select("lead", "before")), "lead").withColumn("place", F.col("before") + F.row_number().over(Window.partitionBy("lead").orderBy("h", "episode")))
    held = placed.join(F.broadcast(cut), F.col("place") <= F.col("n"), "left_semi").select("episode")
    return pairs.withColumn("episode", name).join(held.withColumn("held_out", F.lit(True)), "episode", "left").withColumn("held_out", F.coalesce("held_out", F.lit(False)))


def pair_counts(pairs: DataFrame, labels: tuple[str, ...] = ("POSITIVE", "HARD_NEGATIVE", "NEGATIVE")) -> DataFrame:
    """(label, n): pairs of each label, 0 for labels that do not occur (AG13)."""
    counted = pairs.where(F.col("label").isin(*labels)).groupBy("label").agg(F.count("*").alias("n"))
    every = pairs.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    return every.join(counted, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def project_embeddings(vectors: DataFrame, head: dict[str, np.ndarray], vector: str = "embedding") -> DataFrame:
    """``vectors`` with ``vector`` projected and scaled to length one (SC4).

    ``head`` holds ``down`` and ``up`` (x + up tanh(down x) + bias) or ``matrix`` (matrix x + bias); ``bias``
    may be missing, and an empty head only scales. Null vectors stay null, zero ones zero;
    a vector of another length than the head's raises an error.
    """
    shared = vectors.sparkSession.sparkContext.broadcast({k: np.asarray(v, np.float64) for k, v in head.items()})

    def run(batches):
        m = shared.value
        wide = m["down"].shape[1] if "down" in m else m["matrix"].shape[1] if "matrix" in m else None
        for pdf in batches:
            known = pdf[vector].notna().to_numpy()
            out = pdf.copy()
            if known.any():
                rows = pdf.loc[known, vector]
                if wide is not None and (rows.map(len) != wide).any():
                    raise ValueError(f"a vector's length is not {wide}")
                for _, part in rows.groupby(rows.map(len)):
                    x = np.stack(part.to_numpy()).astype(np.float64)
                    if "down" in m:
                        x = x + np.tanh(x @ m["down"].T) @ m["up"].T + m.get("bias", 0.0)
                    elif "matrix" in m:
                        x = x @ m["matrix"].T + m.get("bias", 0.0)
                    norm = np.linalg.norm(x, axis=1, keepdims=True)
                    out.loc[part.index, vector] = pd.Series(list(x / np.where(norm > 0, norm, 1.0)), index=part.index)
            yield out

    return vectors.mapInPandas(run, vectors.schema)
