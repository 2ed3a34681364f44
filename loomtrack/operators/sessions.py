"""Event logs, media, registries and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrack.functions.shared import dimension

#: Parcel states in forward order, and the event that leads to each.
STATES = ("ON_CONVEYOR", "PICK_CANDIDATE", "PICKED", "CARRIED", "DROP_CANDIDATE", "DROPPED", "DESTINATION_CONFIRMED")
EVENT_RANK = {"pickup_candidate": 1, "parcel_picked": 2, "parcel_carried": 3, "drop_candidate": 4, "parcel_dropped": 5, "destination_observed": 6, "destination_confirmed": 6}
LOCAL = ["session_id", "source_id", "local_track_id"]


def bind_parcel_events(events: DataFrame, tracklets: DataFrame) -> DataFrame:
    """Events with ``global_parcel_id`` of their (session, source, local key); null without one (JN8). The smallest id wins."""
    one = tracklets.groupBy(*LOCAL).agg(F.min("global_parcel_id").alias("global_parcel_id"))
    return events.join(one, LOCAL, "left")


def known_parcel_for_event(events: DataFrame, tracklets: DataFrame) -> DataFrame:
    """Events with the parcel of the latest tracklet of their local key that has one (JN9)."""
    latest = tracklets.where("global_parcel_id IS NOT NULL").groupBy(*LOCAL).agg(F.max_by("global_parcel_id", F.struct("ended_at", "global_parcel_id")).alias("known_parcel_id"))
    return events.join(latest, LOCAL, "left")


def project_parcels(events: DataFrame, key: list[str]) -> DataFrame:
    """(key, state, observed_destination, last_ts): the forward-only state of each parcel (ST5).

    A destination counts only once the state before it is CARRIED or further; two running
    maxima give that exactly. Ties in time go by event id.
    """
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in EVENT_RANK.items() for x in kv)), F.col("event_type"))
    before = Window.partitionBy(*key).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    ranked = events.withColumn("rank", rank).withColumn("reached", F.coalesce(F.max(F.when(F.col("rank") < 6, F.col("rank"))).over(before), F.lit(0)))
    counted = ranked.withColumn("rank", F.when((F.col("rank") < 6) | (F.col("reached") >= 3), F.col("rank")).otherwise(0))
    destination = F.max_by("observed_destination", F.when(F.col("rank") == 6, F.struct("ts", "event_id")))
    return counted.groupBy(*key).agg(F.element_at(F.array(*map(F.lit, STATES)), (F.max("rank") + 1).cast("int")).alias("state"), destination.alias("observed_destination"), F.max("ts").alias("last_ts"))


def derived_drops(events: DataFrame, key: list[str]) -> DataFrame:
    """(key, ts): a ``parcel_dropped`` for each parcel whose destination was seen after it was carried, without a drop of its own."""
    flags = events.groupBy(*key).agg(F.bool_or(F.col("event_type") == "parcel_dropped").alias("dropped"), F.min(F.when(F.col("event_type") == "parcel_carried", F.col("ts"))).alias("carried"), F.max(F.when(F.col("event_type") == "destination_observed", F.col("ts"))).alias("seen"))
    return flags.where("NOT dropped AND seen > carried").select(*key, F.col("seen").alias("ts"))


def recent(rows: DataFrame, n: int, order: str, tie: str, offset: int = 0) -> DataFrame:
    """The newest ``n`` rows after ``offset`` (TK1); ``tie`` is unique. A top-k: each task keeps n + offset rows."""
    return rows.orderBy(F.desc(order), F.desc(tie)).offset(offset).limit(n)


def session_report(tables: dict[str, DataFrame]) -> DataFrame:
    """(session_id, n_<table>...): rows of each table per session, zero where none (AG3)."""
    out = None
    for name, rows in tables.items():
        counted = rows.groupBy("session_id").agg(F.count("*").alias(f"n_{name}"))
        out = counted if out is None else out.join(counted, "session_id", "full_outer")
    return out.select("session_id", *(F.coalesce(f"n_{name}", F.lit(0)).alias(f"n_{name}") for name in tables))


def decision_log(parts: dict[str, DataFrame]) -> DataFrame:
    """The named logs in one schema with ``kind`` (SO4); columns that one lacks are null."""
    out = None
    for kind, rows in parts.items():
        rows = rows.withColumn("kind", F.lit(kind))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def windowed_counts(events: DataFrame, width: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """(window_start, source_id, event_type, n): tumbling or sliding counts; the same on a stream (SS3)."""
    return events.groupBy(F.window("ts", width, slide or width).alias("w"), "source_id", "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "source_id", "event_type", "n")


def session_windows(events: DataFrame, gap: str = "1 hour") -> DataFrame:
    """(source_id, local_track_id, started, ended, n): bursts of events of a track without a longer gap (SS3)."""
    return events.groupBy(F.session_window("ts", gap).alias("w"), "source_id", "local_track_id").agg(F.count("*").alias("n")).select("source_id", "local_track_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def running_epoch(results: DataFrame) -> DataFrame:
    """Adds ``highest_epoch``: the highest epoch of the source among earlier arrivals (WN11); null for the first."""
    w = Window.partitionBy("source_id").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    return results.withColumn("highest_epoch", F.max("stream_epoch").over(w))


def admit_results(results: DataFrame) -> DataFrame:
    """Adds ``verdict`` (SS5): ignored (old epoch), late (received after it expired) or accepted."""
    return running_epoch(results).withColumn("verdict", F.when(F.coalesce(F.col("stream_epoch") < F.col("highest_epoch"), F.lit(False)), "ignored").when(F.col("received_at") > F.col("expires_at"), "late").otherwise("accepted"))


def screened(results: DataFrame, active: DataFrame) -> DataFrame:
    """Adds ``refusal``, what is wrong with a result by itself: BAD_ID (``request_id`` is no UUID) or WRONG_SESSION (``active`` has another one, or none, for its source); null for neither."""
    digits = F.regexp_replace(F.regexp_replace(F.coalesce("request_id", F.lit("")), "urn:|uuid:", ""), r"^[{}]+|[{}]+$|-", "")
    joined = results.join(dimension(active.select("source_id", F.col("session_id").alias("__active"))), "source_id", "left")
    refusal = F.when(~digits.rlike("^[0-9a-fA-F]{32}$"), "BAD_ID").when(~F.coalesce(F.col("__active") == F.col("session_id"), F.lit(False)), "WRONG_SESSION")
    return joined.withColumn("refusal", refusal).drop("__active")


def admit_screened(results: DataFrame, active: DataFrame) -> DataFrame:
    """Adds ``verdict`` (SS5): what ``screened`` refuses, OLD_EPOCH (of the source's results that passed so far one has a higher epoch), LATE (received after it expired) or ACCEPTED.

    Results of a source come in the order of ``arrival``; refused ones do not raise its epoch.
    """
    w = Window.partitionBy("source_id").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    rows = screened(results, active)
    highest = F.max(F.when(F.col("refusal").isNull(), F.coalesce("stream_epoch", F.lit(0)))).over(w)
    old = F.coalesce(F.coalesce("stream_epoch", F.lit(0)) < highest, F.lit(False))
    return rows.withColumn("verdict", F.coalesce("refusal", F.when(old, "OLD_EPOCH"), F.when(F.col("received_at") > F.coalesce("expires_at", F.lit(0.0)), "LATE"), F.lit("ACCEPTED"))).drop("refusal")


def archive_lookup(keys: DataFrame, archived: DataFrame, recordings: DataFrame) -> DataFrame:
    """For each wanted frame the archived frame nearest in time among those of equal keys (JN4), with its recording."""
    same = ["session_id", "source_id", "stream_epoch", "frame_index"]
    gap = F.abs(F.col("archived_at") - F.col("timestamp_global"))
    best = keys.join(archived, same, "left").groupBy(*same, "timestamp_global").agg(F.min_by(F.struct("archived_at", "recording_id"), F.struct(gap, "recording_id")).alias("b"))
    return best.select(*same, "timestamp_global", "b.archived_at", "b.recording_id").join(recordings.select("recording_id", "corrupted"), "recording_id", "left")


def frame_origin(lookup: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds ``origin`` and ``refused_reason`` (JN5): the archive, else a frozen replay of the source, else refused."""
    joined = lookup.join(sources, "source_id", "left")
    archived = F.col("archived_at").isNotNull() & ~F.coalesce("corrupted", F.lit(False))
    replay = F.coalesce(F.col("kind") == "replay", F.lit(False))
    return joined.withColumn("origin", F.when(archived, "ARCHIVE").when(replay, "REPLAY").otherwise("REFUSED")).withColumn(
        "refused_reason", F.when(archived | replay, F.lit(None)).when(F.col("kind").isNull(), "UNKNOWN_SOURCE").when(F.col("archive_required"), "ARCHIVE_REQUIRED").otherwise("NOT_A_REPLAY")
    )


def media_coverage(frames: DataFrame, archived: DataFrame, required: Column) -> DataFrame:
    """(session_id, source_id, processed, archived, unarchived, ratio, status): AG7."""
    same = ["session_id", "source_id", "stream_epoch", "frame_index"]
    joined = frames.join(archived.select(*same, F.lit(1).alias("kept")).distinct(), same, "left")
    counted = joined.groupBy("session_id", "source_id").agg(F.count("*").alias("processed"), F.count("kept").alias("archived"))
    return counted.select("*", (F.col("processed") - F.col("archived")).alias("unarchived"), _ratio().alias("ratio")).withColumn("status", F.when(~required, "NOT_REQUIRED").when(F.col("ratio") >= 1, "COMPLETE").otherwise("INSUFFICIENT"))


def _ratio() -> Column:
    return F.when(F.col("processed") > 0, F.least(F.lit(1.0), F.col("archived") / F.col("processed"))).otherwise(F.when(F.col("archived") > 0, 1.0).otherwise(0.0))


def media_report(coverage: DataFrame, errors: DataFrame) -> DataFrame:
    """Coverage per source with totals per session and over all (AG8, a rollup), and segment errors; ``valid`` without any."""
    joined = coverage.join(errors, ["session_id", "source_id"], "left").withColumn("segment_errors", F.coalesce("segment_errors", F.lit(0)))
    out = joined.rollup("session_id", "source_id").agg(F.sum("processed").alias("processed"), F.sum("archived").alias("archived"), F.sum("segment_errors").alias("segment_errors"))
    return out.withColumn("ratio", _ratio()).withColumn("valid", (F.col("segment_errors") == 0) & (F.col("ratio") >= 0.9))


def source_status(sources: DataFrame, state: DataFrame, assignments: DataFrame) -> DataFrame:
    """Sources with their latest state and their enabled pipelines in order (JN15)."""
    latest = state.groupBy("source_id").agg(F.max_by("status", F.struct("updated_at", "status")).alias("status"))
    enabled = assignments.where("enabled").groupBy("source_id").agg(F.array_join(F.array_sort(F.collect_set("pipeline")), ",").alias("pipelines"))
    return sources.join(latest, "source_id", "left").join(enabled, "source_id", "left")


def rollback_target(history: DataFrame, registry: DataFrame) -> DataFrame:
    """(task, model_id): per task the latest applied model that may still serve and is not the current one (TK4)."""
    applied = history.where("runtime_applied AND status <> 'FAILED'").join(registry.where("status IN ('CHAMPION', 'BASELINE', 'CANDIDATE')").select("model_id"), "model_id")
    current = history.where("status = 'ACTIVE'").groupBy("task").agg(F.max_by("model_id", F.struct("completed_at_s", "activation_id")).alias("current_id"))
    others = applied.join(current, "task", "left").where("current_id IS NULL OR model_id <> current_id")
    return others.groupBy("task").agg(F.max_by("model_id", F.struct("completed_at_s", "activation_id")).alias("model_id"))


def max_routing_generation(history: DataFrame) -> DataFrame:
    return history.groupBy("task").agg(F.max("routing_generation").alias("generation"))


def registry_consistency(registry: DataFrame, routes: DataFrame, loaded: DataFrame) -> DataFrame:
    """(task, errors): AG15 over active models, routes and loaded models by task."""
    active = registry.groupBy("task").agg(F.count("*").alias("n_active"), F.min("model_id").alias("active_id"))
    joined = active.join(routes.withColumnRenamed("model_id", "route_id"), "task", "full_outer").join(loaded.withColumnRenamed("model_id", "loaded_id"), "task", "full_outer")
    rules = (
        ("NO_ACTIVE_MODEL", F.col("n_active").isNull()),
        ("SEVERAL_ACTIVE_MODELS", F.col("n_active") > 1),
        ("ROUTE_DIFFERS", F.col("n_active").isNotNull() & ~F.col("active_id").eqNullSafe(F.col("route_id"))),
        ("ROUTE_NOT_LOADED", F.col("route_id").isNotNull() & ~F.col("route_id").eqNullSafe(F.col("loaded_id"))),
    )
    return joined.select("task", F.array_join(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), name) for name, c in rules))), ",").alias("errors"))


def resolve_model_route(assignments: DataFrame, routes: DataFrame) -> DataFrame:
    """Assignments with their model (PF10): the fixed one at generation 0, else the task's route, else rejected."""
    joined = assignments.join(routes.select("task", F.col("model_id").alias("route_id"), "generation"), "task", "left")
    return joined.select(*assignments.columns, F.coalesce("fixed_model_id", "route_id").alias("model_id"), F.when(F.col("fixed_model_id").isNotNull(), 0).otherwise(F.col("generation")).alias("routing_generation"), (F.col("fixed_model_id").isNull() & F.col("route_id").isNull()).alias("rejected"))


def metric_deltas(candidate: DataFrame, active: DataFrame, metrics: list[str]) -> DataFrame:
    """(task, metric, delta, available): ML6, long by metric."""
    long = lambda rows, name: rows.unpivot("task", metrics, "metric", name)
    joined = long(candidate, "new").join(long(active, "old"), ["task", "metric"], "left")
    return joined.select("task", "metric", (F.col("new") - F.col("old")).alias("delta"), (F.col("new").isNotNull() & F.col("old").isNotNull()).alias("available"))


def promotion_gate(measured: DataFrame, criteria: DataFrame) -> DataFrame:
    """(task, model_id, failures, promoted): ML7; ``measured`` is long by metric, a missing metric is a failure.

    A criterion has ``bound`` and ``is_floor`` (else a ceiling). Criteria are a few rows and broadcast.
    """
    models = measured.select("task", "model_id").distinct()
    wanted = models.join(F.broadcast(criteria), how="cross")  # each model has each of the few criteria
    joined = wanted.join(measured, ["task", "model_id", "metric"], "left")
    bad = F.col("value").isNull() | F.when(F.col("is_floor"), F.col("value") < F.col("bound")).otherwise(F.col("value") > F.col("bound"))
    return joined.groupBy("task", "model_id").agg(F.array_join(F.array_sort(F.collect_list(F.when(bad, F.col("metric")))), ",").alias("failures")).withColumn("promoted", F.col("failures") == "")


def dashboard_counts(rows: DataFrame) -> DataFrame:
    """(role, status, n): a cube of roles and statuses (AG16); null stands for all."""
    return rows.cube("camera_role", "status").agg(F.count("*").alias("n"))


def hypotheses(decisions: DataFrame, now: float, window_s: float = 120.0) -> DataFrame:
    """(session_id, incoming_id, status): one pending row for each ambiguous, or unresolved but contested, incoming tracklet (ST6)."""
    open_rows = decisions.where("status = 'AMBIGUOUS' OR (status = 'UNRESOLVED' AND n_candidates > 0)")
    return open_rows.groupBy("session_id", "incoming_id").agg(F.min("created_at").alias("created_at")).select("session_id", "incoming_id", F.when(F.col("created_at") + window_s <= now, "EXPIRED").otherwise("PENDING").alias("status"))


def apply_resolutions(requests: DataFrame, pending: DataFrame) -> DataFrame:
    """(request_id, verdict, reason): ST7's ordered checks; the first request for an outgoing tracklet wins."""
    w = Window.partitionBy("session_id", "outgoing_id").orderBy("requested_at", "request_id")
    joined = requests.join(pending, ["session_id", "incoming_id"], "left")
    checks = (
        ("NOT_PENDING", F.col("status").isNull() | (F.col("status") != "PENDING")),
        ("NOT_A_CANDIDATE", ~F.col("is_candidate")),
        ("TRANSIT_OUT_OF_WINDOW", ~F.col("transit_ok")),
    )
    reason: Column | None = None
    for name, fails in checks:
        reason = F.when(fails, name) if reason is None else reason.when(fails, name)
    judged = joined.withColumn("reason", reason)
    passed = judged.where("reason IS NULL").withColumn("reason", F.when(F.row_number().over(w) > 1, "ALREADY_CONSUMED"))
    return judged.where("reason IS NOT NULL").unionByName(passed).select("request_id", F.when(F.col("reason").isNull(), "RESOLVED").otherwise("REFUSED").alias("verdict"), "reason")


def align_clocks(frames: DataFrame, sessions: DataFrame) -> DataFrame:
    """Adds ``aligned``: session start, plus the spans of the source's earlier epochs, plus the time within the epoch (PF1)."""
    span = frames.groupBy("session_id", "source_id", "stream_epoch").agg(F.min("timestamp_local").alias("t0"), (F.max("timestamp_local") - F.min("timestamp_local")).alias("span"))
    w = Window.partitionBy("session_id", "source_id").orderBy("stream_epoch").rowsBetween(Window.unboundedPreceding, -1)
    placed = span.withColumn("earlier", F.coalesce(F.sum("span").over(w), F.lit(0.0)))
    return frames.join(placed, ["session_id", "source_id", "stream_epoch"]).join(sessions, "session_id").withColumn("aligned", F.col("started_at") + F.col("earlier") + F.col("timestamp_local") - F.col("t0")).drop("t0", "span", "earlier", "started_at")
