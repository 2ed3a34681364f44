"""Tracking tables derived from the driver's star-schema tables.

Each view is one SELECT that Spark and DuckDB both run, so a query and its SQL twin start
from the same rows. All rows of the source tables take part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRACK_OBS = """
SELECT session_id, camera_role AS source_id, camera_role, stream_epoch, frame_index, local_track_id,
       stream_epoch * 10000.0e0 + frame_index * 0.125e0 AS timestamp_global,
       CASE WHEN local_track_id % 4 = 3 THEN 'person' ELSE 'parcel' END AS class_name,
       0.4e0 + 0.012e0 * CAST(q AS DOUBLE) AS confidence,
       CAST((local_track_id * 37 + frame_index * 3) % 560 AS DOUBLE) AS x1,
       CAST(40 + (local_track_id * 13) % 200 AS DOUBLE) AS y1,
       CAST((local_track_id * 37 + frame_index * 3) % 560 + 40 + n AS DOUBLE) AS x2,
       CAST(40 + (local_track_id * 13) % 200 + 30 + n AS DOUBLE) AS y2
FROM (SELECT concat('S', CAST(l_suppkey % 8 AS STRING)) AS session_id,
             concat('C', CAST(l_partkey % 3 + 1 AS STRING)) AS camera_role,
             CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END AS stream_epoch,
             CAST(floor(l_orderkey / 100.0e0) AS BIGINT) AS frame_index,
             CAST(floor(l_suppkey / 8.0e0) AS BIGINT) AS local_track_id,
             min(l_linenumber) AS n, max(l_quantity) AS q
      FROM {lineitem} GROUP BY 1, 2, 3, 4, 5) r
"""

TRACKLETS = """
SELECT concat('t', CAST(o_orderkey AS STRING)) AS tracklet_id,
       concat('S', CAST(CAST(floor(o_orderkey / 90.0e0) AS BIGINT) AS STRING)) AS session_id,
       concat('C', CAST(CAST(floor((o_orderkey % 90) / 30.0e0) AS BIGINT) + 1 AS STRING)) AS camera_role,
       (o_orderkey % 30) * 2.0e0 + floor((o_orderkey % 90) / 30.0e0) * 4.0e0 + (o_custkey % 10) * 0.1e0 AS started_at_global,
       (o_orderkey % 30) * 2.0e0 + floor((o_orderkey % 90) / 30.0e0) * 4.0e0 + (o_custkey % 10) * 0.1e0
         + 1.0e0 + (o_custkey % 5) * 0.1e0 AS ended_at_global,
       o_orderkey % 30 AS local_track_id,
       40.0e0 + CAST(floor(o_totalprice) AS BIGINT) % 40 AS avg_w,
       30.0e0 + CAST(floor(o_totalprice) AS BIGINT) % 20 AS avg_h,
       2.0e0 + o_custkey % 3 AS avg_vx, 0.0e0 AS avg_vy,
       CASE WHEN o_orderpriority = '1-URGENT' THEN NULL
            ELSE concat('c', CAST(CAST(floor((o_orderkey % 90) / 30.0e0) AS BIGINT) + 1 AS STRING), '_entry') END AS first_zone_id,
       CASE WHEN o_orderpriority = '5-LOW' THEN NULL
            ELSE concat('c', CAST(CAST(floor((o_orderkey % 90) / 30.0e0) AS BIGINT) + 1 AS STRING), '_exit') END AS last_zone_id,
       CASE WHEN o_orderstatus = 'P' THEN 'RECOVERED'
            WHEN o_orderstatus = 'F' AND o_custkey % 7 = 0 THEN 'AMBIGUOUS' ELSE 'STABLE' END AS integrity_status,
       o_orderkey % (SELECT count(*) FROM {embeddings}) AS vec_id
FROM {orders}
"""

EVENT_LOG = """
SELECT event_id, concat('S', CAST(user_id % 10 AS STRING)) AS session_id,
       concat('C', CAST(event_id % 3 + 1 AS STRING)) AS source_id,
       user_id AS local_track_id, ts,
       CASE event_type WHEN 'view' THEN 'pickup_candidate' WHEN 'click' THEN 'parcel_picked'
            WHEN 'signup' THEN 'parcel_carried' WHEN 'error' THEN 'destination_observed'
            ELSE 'parcel_dropped' END AS event_type,
       concat('zone_', CAST(user_id % 4 AS STRING)) AS observed_destination, value
FROM {events}
"""

ITEMS = """
SELECT d.doc_id AS item_id, d.source AS session_id,
       concat(d.source, ':', CAST(CAST(floor(d.doc_id / 4.0e0) AS BIGINT) AS STRING)) AS sample_group_id,
       d.lang AS camera_role, d.doc_id AS frame_index, d.sha2_text AS image_sha256,
       CASE WHEN l.quality = 1 THEN 'AUTO_ACCEPTED' WHEN l.quality = 0 THEN 'REJECTED'
            ELSE 'NEEDS_REVIEW' END AS annotation_status,
       d.doc_id % (SELECT count(*) FROM {embeddings}) AS vec_id
FROM (SELECT doc_id, source, lang, {sha} AS sha2_text FROM {documents}) d
LEFT JOIN {labels} l ON l.doc_id = d.doc_id
"""

ACTIVATIONS = """
SELECT c_custkey AS activation_id, c_mktsegment AS task, c_nationkey AS model_id,
       c_custkey % 50 AS routing_generation,
       CASE WHEN c_acctbal < 0 THEN 'FAILED' WHEN c_custkey % 3 = 0 THEN 'ACTIVE' ELSE 'SUPERSEDED' END AS status,
       c_acctbal >= 0 AS runtime_applied, c_custkey * 60 AS completed_at_s
FROM {customer}
"""

REGISTRY = """
SELECT n_nationkey AS model_id, n_name AS name,
       CASE n_regionkey WHEN 0 THEN 'CHAMPION' WHEN 1 THEN 'ARCHIVED' WHEN 2 THEN 'BASELINE'
            WHEN 3 THEN 'CANDIDATE' ELSE 'REJECTED' END AS status
FROM {nation}
"""

RESULTS = """
SELECT o_orderkey AS arrival, concat('C', CAST(o_custkey % 3 + 1 AS STRING)) AS source_id,
       CAST(floor(o_orderkey / 500.0e0) AS BIGINT) - o_custkey % 2 AS stream_epoch,
       o_orderkey * 1.0e0 AS received_at, o_orderkey * 1.0e0 + (o_custkey % 9) - 1.0e0 AS expires_at
FROM {orders}
"""

VIEWS = {"track_obs": TRACK_OBS, "tracklets": TRACKLETS, "event_log": EVENT_LOG, "items": ITEMS, "activations": ACTIVATIONS, "model_registry": REGISTRY, "results": RESULTS}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels")

#: (from, to, least transit, most transit) of the test site, and (role, zone, kind, box) of its zones.
EDGES = (("C1", "C2", 0.5, 10.0), ("C2", "C3", 0.2, 12.0))
ZONES = (
    ("C1", "c1_pick", "pick", 0.0, 0.0, 0.3, 1.0),
    ("C1", "c1_exit", "exit", 0.7, 0.0, 1.0, 1.0),
    ("C2", "c2_entry", "entry", 0.0, 0.0, 0.25, 1.0),
    ("C2", "c2_exit", "exit", 0.75, 0.0, 1.0, 1.0),
    ("C3", "c3_entry", "entry", 0.0, 0.0, 0.3, 1.0),
    ("C3", "c3_destination", "destination", 200.0, 0.0, 640.0, 360.0),
)

EDGES_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {lo}e0, {hi}e0)" for a, b, lo, hi in EDGES) + ") AS e(from_role, to_role, min_transit_s, max_transit_s)"
ZONES_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{r}', '{z}', '{kind}', {a}e0, {b}e0, {c}e0, {d}e0)" for k, (r, z, kind, a, b, c, d) in enumerate(ZONES)) + ") AS z(position, camera_role, zone_id, kind, x1, y1, x2, y2)"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The fixture ``name`` as a DataFrame."""
    sql = VIEWS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in sql}
    return spark.sql(sql.replace("{sha}", "sha2(text, 256)"), **used)


def edges(spark: SparkSession) -> DataFrame:
    return spark.sql(EDGES_SQL)


def zones(spark: SparkSession) -> DataFrame:
    return spark.sql(ZONES_SQL)


def oracle(*names: str) -> str:
    """``WITH`` clause that defines the named fixtures (also ``edges`` and ``zones``) for DuckDB."""
    fixed = {"edges": EDGES_SQL, "zones": ZONES_SQL}
    ctes = []
    for name in names:
        sql = fixed.get(name) or VIEWS[name].replace("{sha}", "sha256(text)")
        for t in TABLES:
            sql = sql.replace(f"{{{t}}}", t)
        ctes.append(f"{name} AS ({sql})")
    return "WITH " + ",\n".join(ctes)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
