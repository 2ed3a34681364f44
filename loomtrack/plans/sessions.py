"""Registered queries over event logs, media, registries and results."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtrack.functions.geometry import FRAME
from loomtrack.operators import sessions as ops
from loomtrack.sources import fixtures as fx


def _events(spark, sf):
    return fx.view(spark, sf, "event_log")


def _local(spark, sf):
    t = fx.view(spark, sf, "tracklets")
    return t.select(F.concat(F.lit("S"), (F.col("local_track_id") % 10).cast("string")).alias("session_id"), F.col("camera_role").alias("source_id"), F.expr("cast(substring(tracklet_id, 2) AS bigint) % 500").alias("local_track_id"), F.col("ended_at_global").alias("ended_at"), F.when(F.col("avg_w") < 70, F.concat(F.lit("g:"), "tracklet_id")).alias("global_parcel_id"))


def jn8_bind_parcel_events(spark, sf):
    return ops.bind_parcel_events(_events(spark, sf), _local(spark, sf)).select("event_id", "global_parcel_id")


def jn9_known_parcel_for_event(spark, sf):
    return ops.known_parcel_for_event(_events(spark, sf), _local(spark, sf)).select("event_id", "known_parcel_id")


def st5_project_parcels(spark, sf):
    return ops.project_parcels(_events(spark, sf), ["session_id", "local_track_id"])


def st5_derived_drops(spark, sf):
    return ops.derived_drops(_events(spark, sf), ["session_id", "source_id", "local_track_id"])


def tk1_recent(spark, sf):
    return ops.recent(_events(spark, sf), 100, "ts", "event_id", offset=20).select("event_id", "ts", "event_type")


def ag3_session_report(spark, sf):
    log = _events(spark, sf)
    return ops.session_report({"events": log, "tracklets": fx.view(spark, sf, "tracklets"), "observations": fx.view(spark, sf, "track_obs")})


def ag16_dashboard_counts(spark, sf):
    rows = fx.view(spark, sf, "tracklets").select("camera_role", F.col("integrity_status").alias("status"))
    return ops.dashboard_counts(rows)


def so4_decision_log(spark, sf):
    parts = {"interaction": _events(spark, sf).select("session_id", "event_type", "event_id"), "handoff": fx.view(spark, sf, "tracklets").select("session_id", "tracklet_id", F.col("ended_at_global").alias("at"))}
    return ops.decision_log(parts)


def ss3_tumbling_counts(spark, sf):
    return ops.windowed_counts(_events(spark, sf), "1 hour")


def ss3_sliding_counts(spark, sf):
    return ops.windowed_counts(_events(spark, sf), "2 hours", "1 hour")


def ss3_session_windows(spark, sf):
    return ops.session_windows(_events(spark, sf), "6 hours")


def wn11_running_epoch(spark, sf):
    return ops.running_epoch(fx.view(spark, sf, "results")).select("arrival", "highest_epoch")


def ss5_admit_results(spark, sf):
    return ops.admit_results(fx.view(spark, sf, "results")).select("arrival", "source_id", "verdict")


def _media(spark, sf):
    frames = fx.view(spark, sf, "track_obs").select(*FRAME, "timestamp_global").distinct()
    archived = frames.where("frame_index % 11 <> 0").select(*FRAME, (F.col("timestamp_global") + (F.col("frame_index") % 3) * 0.01).alias("archived_at"), F.concat_ws(":", "session_id", "source_id", F.floor(F.col("frame_index") / 50).cast("string")).alias("recording_id"))
    recordings = archived.select("recording_id").distinct().withColumn("corrupted", F.col("recording_id").endswith("7"))
    return frames, archived, recordings


def _kinds(spark):
    return spark.sql("SELECT * FROM VALUES ('C1', 'replay', false), ('C2', 'live', true) AS s(source_id, kind, archive_required)")


def jn4_archive_lookup(spark, sf):
    return ops.archive_lookup(*_media(spark, sf)).select(*FRAME, "archived_at", "recording_id", "corrupted")


def jn5_frame_origin(spark, sf):
    return ops.frame_origin(ops.archive_lookup(*_media(spark, sf)), _kinds(spark)).select(*FRAME, "origin", "refused_reason")


def ag7_media_coverage(spark, sf):
    frames, archived, _ = _media(spark, sf)
    return ops.media_coverage(frames, archived, F.col("source_id") != "C3").withColumn("ratio", F.round("ratio", 9))


def ag8_media_report(spark, sf):
    frames, archived, recordings = _media(spark, sf)
    errors = archived.select("session_id", "source_id", "recording_id").distinct().join(recordings.where("corrupted"), "recording_id").groupBy("session_id", "source_id").agg(F.count("*").alias("segment_errors"))
    return ops.media_report(ops.media_coverage(frames, archived, F.lit(True)), errors).withColumn("ratio", F.round("ratio", 9))


def _read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def jn15_source_status(spark, sf):
    c = _read(spark, sf, "customer")
    state = c.select(F.col("c_nationkey").alias("source_id"), F.col("c_mktsegment").alias("status"), F.col("c_custkey").alias("updated_at"))
    assigned = c.select(F.col("c_nationkey").alias("source_id"), F.col("c_mktsegment").alias("pipeline"), (F.col("c_acctbal") > 5000).alias("enabled"))
    sources = _read(spark, sf, "nation").select(F.col("n_nationkey").alias("source_id"), F.col("n_name").alias("name"))
    return ops.source_status(sources, state, assigned)


def tk4_rollback_target(spark, sf):
    return ops.rollback_target(fx.view(spark, sf, "activations"), fx.view(spark, sf, "model_registry"))


def tk6_max_routing_generation(spark, sf):
    return ops.max_routing_generation(fx.view(spark, sf, "activations"))


def _latest(rows):
    return rows.groupBy("task").agg(F.max_by("model_id", "activation_id").alias("model_id"))


def ag15_registry_consistency(spark, sf):
    """The current registry: per task the model of the latest active row."""
    a = fx.view(spark, sf, "activations")
    return ops.registry_consistency(_latest(a.where("status = 'ACTIVE'")), _latest(a.where("runtime_applied")), _latest(a.where("status <> 'FAILED'")))


def pf10_resolve_model_route(spark, sf):
    a = fx.view(spark, sf, "activations")
    routes = a.where("status = 'ACTIVE' AND task <> 'MACHINERY'").groupBy("task").agg(F.max_by("model_id", "activation_id").alias("model_id"), F.max("routing_generation").alias("generation"))
    assigned = a.select("activation_id", "task", F.when(F.col("activation_id") % 10 == 0, F.col("model_id")).alias("fixed_model_id"))
    return ops.resolve_model_route(assigned, routes).select("activation_id", F.col("model_id").cast("long").alias("model_id"), F.col("routing_generation").cast("long").alias("routing_generation"), "rejected")


def _metrics(spark, sf, status):
    a = fx.view(spark, sf, "activations").where(f"status = '{status}'")
    return a.groupBy("task").agg(F.avg(F.col("routing_generation").cast("double")).alias("fps"), (F.avg(F.col("model_id").cast("double")) / 25).alias("accuracy"), F.max(F.when(F.col("task") != "BUILDING", F.col("model_id") / 100.0)).cast("double").alias("merge_rate"))


def ml6_metric_deltas(spark, sf):
    return ops.metric_deltas(_metrics(spark, sf, "ACTIVE"), _metrics(spark, sf, "SUPERSEDED"), ["fps", "accuracy", "merge_rate"]).withColumn("delta", F.round("delta", 9))


def ml7_promotion_gate(spark, sf):
    a = fx.view(spark, sf, "activations").groupBy("task", "model_id").agg(F.avg(F.col("routing_generation").cast("double")).alias("fps"), (F.avg(F.col("runtime_applied").cast("double"))).alias("accuracy"))
    long = a.unpivot(["task", "model_id"], ["fps", "accuracy"], "metric", "value")
    criteria = spark.sql("SELECT * FROM VALUES ('fps', 24.0e0, true), ('accuracy', 0.9e0, true), ('merge_rate', 0.15e0, false) AS c(metric, bound, is_floor)")
    return ops.promotion_gate(long, criteria)


def st6_hypotheses(spark, sf):
    d = fx.view(spark, sf, "tracklets").select("session_id", F.col("tracklet_id").alias("incoming_id"), F.when(F.col("integrity_status") == "AMBIGUOUS", "AMBIGUOUS").otherwise("UNRESOLVED").alias("status"), (F.col("local_track_id") % 3).alias("n_candidates"), F.col("ended_at_global").alias("created_at"))
    return ops.hypotheses(d, 160.0)


def st7_apply_resolutions(spark, sf):
    t = fx.view(spark, sf, "tracklets")
    requests = t.select(F.col("tracklet_id").alias("request_id"), "session_id", F.col("tracklet_id").alias("incoming_id"), (F.col("local_track_id") % 12).alias("outgoing_id"), F.col("started_at_global").alias("requested_at"), (F.col("local_track_id") % 4 != 1).alias("is_candidate"), (F.col("avg_w") < 72).alias("transit_ok"))
    pending = st6_hypotheses(spark, sf)
    return ops.apply_resolutions(requests, pending)


def pf1_align_clocks(spark, sf):
    frames = fx.view(spark, sf, "track_obs").select(*FRAME, (F.col("frame_index") * 0.125 + 3).alias("timestamp_local")).distinct()
    starts = frames.select("session_id").distinct().withColumn("started_at", F.substring("session_id", 2, 9).cast("double") * 1000)
    return ops.align_clocks(frames, starts).select(*FRAME, "aligned")


def _requested(spark, sf):
    """Results with request ids, most of them UUIDs, and sessions, of which one is active for each source; C3 has none."""
    r = fx.view(spark, sf, "results")
    digest = F.md5(F.col("arrival").cast("string"))
    results = r.withColumns({"request_id": F.when(F.col("arrival") % 11 == 0, F.concat(F.lit("x"), digest)).when(F.col("arrival") % 5 == 0, F.concat(F.lit("{"), F.upper(digest), F.lit("}"))).otherwise(digest), "session_id": F.when(F.col("arrival") % 17 == 0, "S0").otherwise("S1")})
    return results, spark.sql("SELECT * FROM VALUES ('C1', 'S1'), ('C2', 'S1') AS a(source_id, session_id)")


def ss5_screened_results(spark, sf):
    return ops.admit_screened(*_requested(spark, sf)).select("arrival", "source_id", "verdict")


QUERIES = {f.__name__: f for f in (
    pf1_align_clocks, pf10_resolve_model_route, jn4_archive_lookup, jn5_frame_origin, jn8_bind_parcel_events, jn9_known_parcel_for_event, jn15_source_status, ag3_session_report, ag7_media_coverage, ag8_media_report,
    ag15_registry_consistency, ag16_dashboard_counts, wn11_running_epoch, tk1_recent, tk4_rollback_target, tk6_max_routing_generation, so4_decision_log, st5_project_parcels, st5_derived_drops, st6_hypotheses, st7_apply_resolutions,
    ml6_metric_deltas, ml7_promotion_gate, ss3_tumbling_counts, ss3_sliding_counts, ss3_session_windows, ss5_admit_results, ss5_screened_results,
)}

_E, _T, _A, _R = fx.oracle("event_log"), fx.oracle("tracklets"), fx.oracle("activations", "model_registry"), fx.oracle("results")
_LOCAL = ", local AS (SELECT concat('S', CAST(local_track_id % 10 AS STRING)) AS session_id, camera_role AS source_id, CAST(substring(tracklet_id, 2) AS BIGINT) % 500 AS local_track_id, ended_at_global AS ended_at, CASE WHEN avg_w < 70 THEN 'g:' || tracklet_id END AS gid FROM tracklets)"
_FR = "session_id, source_id, stream_epoch, frame_index"
_MEDIA = fx.oracle("track_obs") + f""", frames AS (SELECT DISTINCT {_FR}, timestamp_global FROM track_obs), archived AS (SELECT {_FR}, timestamp_global + (frame_index % 3) * 0.01e0 AS archived_at, concat_ws(':', session_id, source_id, CAST(CAST(floor(frame_index / 50.0e0) AS BIGINT) AS STRING)) AS recording_id FROM frames WHERE frame_index % 11 <> 0)"""
_COVER = ", cover AS (SELECT f.session_id, f.source_id, count(*) AS processed, count(archived_at) AS archived FROM frames f LEFT JOIN archived a USING (session_id, source_id, stream_epoch, frame_index) GROUP BY ALL)"
_HYP = """, hyp AS (SELECT session_id, tracklet_id AS incoming_id, CASE WHEN ended_at_global + 120 <= 160 THEN 'EXPIRED' ELSE 'PENDING' END AS status FROM tracklets WHERE integrity_status = 'AMBIGUOUS' OR local_track_id % 3 > 0)"""
_MET = "SELECT task, avg(CAST(routing_generation AS DOUBLE)) AS fps, avg(CAST(model_id AS DOUBLE)) / 25 AS accuracy, max(CASE WHEN task <> 'BUILDING' THEN model_id / 100.0e0 END) AS merge_rate FROM activations WHERE status = '{}' GROUP BY ALL"
_RANK = "CASE event_type WHEN 'pickup_candidate' THEN 1 WHEN 'parcel_picked' THEN 2 WHEN 'parcel_carried' THEN 3 WHEN 'parcel_dropped' THEN 5 WHEN 'destination_observed' THEN 6 END"

ORACLES = {
    "jn8_bind_parcel_events": f"{fx.oracle('event_log', 'tracklets')}{_LOCAL} SELECT event_id, g AS global_parcel_id FROM event_log LEFT JOIN (SELECT session_id, source_id, local_track_id, min(gid) AS g FROM local GROUP BY ALL) USING (session_id, source_id, local_track_id)",
    "jn9_known_parcel_for_event": f"{fx.oracle('event_log', 'tracklets')}{_LOCAL} SELECT event_id, g AS known_parcel_id FROM event_log LEFT JOIN (SELECT * FROM (SELECT session_id, source_id, local_track_id, gid AS g, row_number() OVER (PARTITION BY session_id, source_id, local_track_id ORDER BY ended_at DESC, gid DESC) AS k FROM local WHERE gid IS NOT NULL) WHERE k = 1) USING (session_id, source_id, local_track_id)",
    "st5_project_parcels": f"""{_E}, r AS (SELECT *, {_RANK} AS rank FROM event_log), p AS (SELECT *, coalesce(max(CASE WHEN rank < 6 THEN rank END) OVER (PARTITION BY session_id, local_track_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached FROM r),
      c AS (SELECT *, CASE WHEN rank < 6 OR reached >= 3 THEN rank ELSE 0 END AS counted FROM p)
      SELECT session_id, local_track_id, ['ON_CONVEYOR', 'PICK_CANDIDATE', 'PICKED', 'CARRIED', 'DROP_CANDIDATE', 'DROPPED', 'DESTINATION_CONFIRMED'][max(counted) + 1] AS state, arg_max(observed_destination, {{'ts': ts, 'e': event_id}}) FILTER (counted = 6) AS observed_destination, max(ts) AS last_ts FROM c GROUP BY ALL""",
    "st5_derived_drops": f"{_E} SELECT session_id, source_id, local_track_id, seen AS ts FROM (SELECT session_id, source_id, local_track_id, bool_or(event_type = 'parcel_dropped') AS d, min(ts) FILTER (event_type = 'parcel_carried') AS c, max(ts) FILTER (event_type = 'destination_observed') AS seen FROM event_log GROUP BY ALL) WHERE NOT d AND seen > c",
    "tk1_recent": f"{_E} SELECT event_id, ts, event_type FROM event_log ORDER BY ts DESC, event_id DESC LIMIT 100 OFFSET 20",
    "ag3_session_report": f"""{fx.oracle('event_log', 'tracklets', 'track_obs')}, s AS (SELECT session_id, 1 AS a, 0 AS b, 0 AS c FROM event_log UNION ALL SELECT session_id, 0, 1, 0 FROM tracklets UNION ALL SELECT session_id, 0, 0, 1 FROM track_obs)
      SELECT session_id, CAST(sum(a) AS BIGINT) AS n_events, CAST(sum(b) AS BIGINT) AS n_tracklets, CAST(sum(c) AS BIGINT) AS n_observations FROM s GROUP BY ALL""",
    "ag16_dashboard_counts": f"{_T} SELECT camera_role, integrity_status AS status, count(*) AS n FROM tracklets GROUP BY CUBE (camera_role, integrity_status)",
    "so4_decision_log": f"{fx.oracle('event_log', 'tracklets')} SELECT session_id, event_type, event_id, 'interaction' AS kind, NULL AS tracklet_id, NULL::DOUBLE AS at FROM event_log UNION ALL SELECT session_id, NULL, NULL, 'handoff', tracklet_id, ended_at_global FROM tracklets",
    "ss3_tumbling_counts": f"{_E} SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, source_id, event_type, count(*) AS n FROM event_log GROUP BY ALL",
    "ss3_sliding_counts": f"{_E} SELECT time_bucket(INTERVAL 1 HOUR, ts) - to_hours(k) AS window_start, source_id, event_type, count(*) AS n FROM event_log, range(0, 2) r(k) GROUP BY ALL",
    "ss3_session_windows": f"""{_E}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM event_log WINDOW w AS (PARTITION BY source_id, local_track_id ORDER BY ts, event_id)),
      r AS (SELECT *, sum(new) OVER (PARTITION BY source_id, local_track_id ORDER BY ts, event_id) AS run FROM g) SELECT source_id, local_track_id, min(ts) AS started, max(ts) + INTERVAL 6 HOUR AS ended, count(*) AS n FROM r GROUP BY source_id, local_track_id, run""",
    "wn11_running_epoch": f"{_R} SELECT arrival, max(stream_epoch) OVER (PARTITION BY source_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest_epoch FROM results",
    "ss5_screened_results": f"""{_R}, s AS (SELECT *, CASE WHEN arrival % 11 = 0 THEN 'BAD_ID' WHEN source_id = 'C3' OR arrival % 17 = 0 THEN 'WRONG_SESSION' END AS refusal FROM results)
      SELECT arrival, source_id, CASE WHEN refusal IS NOT NULL THEN refusal WHEN stream_epoch < h THEN 'OLD_EPOCH' WHEN received_at > expires_at THEN 'LATE' ELSE 'ACCEPTED' END AS verdict
      FROM (SELECT *, max(stream_epoch) FILTER (refusal IS NULL) OVER (PARTITION BY source_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM s)""",
    "ss5_admit_results": f"{_R} SELECT arrival, source_id, CASE WHEN stream_epoch < h THEN 'ignored' WHEN received_at > expires_at THEN 'late' ELSE 'accepted' END AS verdict FROM (SELECT *, max(stream_epoch) OVER (PARTITION BY source_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM results)",
    "jn4_archive_lookup": f"{_MEDIA} SELECT {_FR}, archived_at, recording_id, recording_id LIKE '%7' AS corrupted FROM frames LEFT JOIN archived USING ({_FR})",
    "jn5_frame_origin": f"""{_MEDIA} SELECT {_FR}, CASE WHEN ok THEN 'ARCHIVE' WHEN source_id = 'C1' THEN 'REPLAY' ELSE 'REFUSED' END AS origin, CASE WHEN ok OR source_id = 'C1' THEN NULL WHEN source_id = 'C3' THEN 'UNKNOWN_SOURCE' WHEN source_id = 'C2' THEN 'ARCHIVE_REQUIRED' END AS refused_reason
      FROM (SELECT {_FR}, archived_at IS NOT NULL AND recording_id NOT LIKE '%7' AS ok FROM frames LEFT JOIN archived USING ({_FR}))""",
    "ag7_media_coverage": f"{_MEDIA}{_COVER} SELECT session_id, source_id, processed, archived, processed - archived AS unarchived, round(least(1.0e0, archived / processed), 9) AS ratio, CASE WHEN source_id = 'C3' THEN 'NOT_REQUIRED' WHEN archived >= processed THEN 'COMPLETE' ELSE 'INSUFFICIENT' END AS status FROM cover",
    "ag8_media_report": f"""{_MEDIA}{_COVER}, err AS (SELECT session_id, source_id, count(DISTINCT recording_id) AS e FROM archived WHERE recording_id LIKE '%7' GROUP BY ALL)
      SELECT session_id, source_id, CAST(sum(processed) AS BIGINT) AS processed, CAST(sum(archived) AS BIGINT) AS archived, CAST(sum(coalesce(e, 0)) AS BIGINT) AS segment_errors, round(least(1.0e0, sum(archived) / sum(processed)), 9) AS ratio, sum(coalesce(e, 0)) = 0 AND sum(archived) / sum(processed) >= 0.9 AS valid FROM cover LEFT JOIN err USING (session_id, source_id) GROUP BY ROLLUP (session_id, source_id)""",
    "jn15_source_status": "SELECT n_nationkey AS source_id, n_name AS name, s AS status, p AS pipelines FROM nation LEFT JOIN (SELECT c_nationkey AS n_nationkey, arg_max(c_mktsegment, c_custkey) AS s FROM customer GROUP BY ALL) USING (n_nationkey) LEFT JOIN (SELECT c_nationkey AS n_nationkey, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS p FROM customer WHERE c_acctbal > 5000 GROUP BY ALL) USING (n_nationkey)",
    "tk4_rollback_target": f"""{_A} SELECT a.task, arg_max(a.model_id, a.activation_id) AS model_id FROM activations a JOIN model_registry r ON r.model_id = a.model_id AND r.status IN ('CHAMPION', 'BASELINE', 'CANDIDATE') LEFT JOIN (SELECT task, arg_max(model_id, activation_id) AS cur FROM activations WHERE status = 'ACTIVE' GROUP BY ALL) c ON c.task = a.task
      WHERE a.runtime_applied AND a.status <> 'FAILED' AND (cur IS NULL OR a.model_id <> cur) GROUP BY ALL""",
    "tk6_max_routing_generation": f"{_A} SELECT task, max(routing_generation) AS generation FROM activations GROUP BY ALL",
    "ag15_registry_consistency": f"""{_A}, t AS (SELECT task, arg_max(model_id, activation_id) FILTER (status = 'ACTIVE') AS a, arg_max(model_id, activation_id) FILTER (runtime_applied) AS b,
        arg_max(model_id, activation_id) FILTER (status <> 'FAILED') AS c, bool_or(status = 'ACTIVE' OR runtime_applied OR status <> 'FAILED') AS there FROM activations GROUP BY ALL)
      SELECT task, concat_ws(',', CASE WHEN a IS NULL THEN 'NO_ACTIVE_MODEL' END, CASE WHEN a IS NOT NULL AND a IS DISTINCT FROM b THEN 'ROUTE_DIFFERS' END, CASE WHEN b IS NOT NULL AND b IS DISTINCT FROM c THEN 'ROUTE_NOT_LOADED' END) AS errors FROM t WHERE there""",
    "pf10_resolve_model_route": f"""{_A}, rt AS (SELECT task, arg_max(model_id, activation_id) AS r, max(routing_generation) AS g FROM activations WHERE status = 'ACTIVE' AND task <> 'MACHINERY' GROUP BY ALL)
      SELECT activation_id, CAST(CASE WHEN activation_id % 10 = 0 THEN model_id ELSE r END AS BIGINT) AS model_id, CAST(CASE WHEN activation_id % 10 = 0 THEN 0 ELSE g END AS BIGINT) AS routing_generation, activation_id % 10 <> 0 AND r IS NULL AS rejected FROM activations LEFT JOIN rt USING (task)""",
    "ml6_metric_deltas": f"""{_A}, n AS ({_MET.format('ACTIVE')}), o AS ({_MET.format('SUPERSEDED')}) SELECT n.task, m AS metric, round(CASE m WHEN 'fps' THEN n.fps - o.fps WHEN 'accuracy' THEN n.accuracy - o.accuracy ELSE n.merge_rate - o.merge_rate END, 9) AS delta,
      CASE m WHEN 'fps' THEN n.fps - o.fps WHEN 'accuracy' THEN n.accuracy - o.accuracy ELSE n.merge_rate - o.merge_rate END IS NOT NULL AS available FROM n LEFT JOIN o USING (task), (VALUES ('fps'), ('accuracy'), ('merge_rate')) v(m)""",
    "ml7_promotion_gate": f"""{_A}, m AS (SELECT task, model_id, avg(CAST(routing_generation AS DOUBLE)) AS fps, avg(CAST(runtime_applied AS INTEGER)) AS acc FROM activations GROUP BY ALL)
      SELECT task, model_id, concat_ws(',', CASE WHEN acc < 0.9 THEN 'accuracy' END, CASE WHEN fps < 24 THEN 'fps' END, 'merge_rate') AS failures, false AS promoted FROM m""",
    "st6_hypotheses": f"{_T}{_HYP} SELECT * FROM hyp",
    "st7_apply_resolutions": f"""{_T}{_HYP}, j AS (SELECT t.*, local_track_id % 12 AS outgoing_id, CASE WHEN h.status IS NULL OR h.status <> 'PENDING' THEN 'NOT_PENDING' WHEN local_track_id % 4 = 1 THEN 'NOT_A_CANDIDATE' WHEN avg_w >= 72 THEN 'TRANSIT_OUT_OF_WINDOW' END AS why FROM tracklets t LEFT JOIN hyp h ON h.session_id = t.session_id AND h.incoming_id = t.tracklet_id)
      SELECT tracklet_id AS request_id, CASE WHEN reason IS NULL THEN 'RESOLVED' ELSE 'REFUSED' END AS verdict, reason FROM (SELECT tracklet_id, why AS reason FROM j WHERE why IS NOT NULL UNION ALL SELECT tracklet_id, CASE WHEN row_number() OVER (PARTITION BY session_id, outgoing_id ORDER BY started_at_global, tracklet_id) > 1 THEN 'ALREADY_CONSUMED' END FROM j WHERE why IS NULL)""",
    "pf1_align_clocks": f"""{fx.oracle('track_obs')}, f AS (SELECT DISTINCT {_FR}, frame_index * 0.125e0 + 3 AS tl FROM track_obs), s AS (SELECT session_id, source_id, stream_epoch, min(tl) AS t0, max(tl) - min(tl) AS span FROM f GROUP BY ALL),
      e AS (SELECT *, coalesce(sum(span) OVER (PARTITION BY session_id, source_id ORDER BY stream_epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM s)
      SELECT {_FR}, CAST(substring(session_id, 2) AS DOUBLE) * 1000 + earlier + tl - t0 AS aligned FROM f JOIN e USING (session_id, source_id, stream_epoch)""",
}
