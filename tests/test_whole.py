"""Queries over all rows against brute force: nothing is left out by an id filter."""

import hashlib
import os
from itertools import combinations

import duckdb
from pyspark.sql import functions as F

from loomtrack import registry
from loomtrack.operators import datasets as ops, handoffs
from loomtrack.plans import datasets, handoffs as plans, sessions
from loomtrack.sources import fixtures as fx


def _rows(spark, sf, name):
    found = registry.queries()[name](spark, sf)
    columns = sorted(found.columns)
    return columns, sorted(str([round(r[c], 6) if isinstance(r[c], float) else str(r[c]) for c in columns]) for r in found.collect())


def _sql(sf, name, *filters):
    text = registry.oracle_sql()[name]
    for part in filters:
        assert text.count(part) == 1
        text = text.replace(part, "")
    con = duckdb.connect()
    for file in os.listdir(sf):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{sf}/{file}'")
    wanted = con.sql(text)
    columns = sorted(wanted.columns)
    place = [wanted.columns.index(c) for c in columns]
    return columns, sorted(str([round(r[k], 6) if isinstance(r[k], float) else str(r[k]) for k in place]) for r in wanted.fetchall())


def test_continuations_and_lines_of_all_rows(spark, sf):
    for name in ("jn17_continuation_candidates", "io7_yolo_label_lines"):
        wanted = _sql(sf, name)
        assert _rows(spark, sf, name) == wanted and wanted[1]
    assert len(wanted[1]) == fx.view(spark, sf, "track_obs").count()


def test_assignment_over_both_edges(spark, sf):
    scored = handoffs.handoff_score(plans._gated(spark, sf).where("accepted"))
    apart = [{(r.out_tracklet_id, r.in_tracklet_id) for r in handoffs.assign_one_to_one(scored.where(F.col("to_role") == role), "out_tracklet_id", "in_tracklet_id").collect()} for role in ("C2", "C3")]
    found = [(r.out_tracklet_id, r.in_tracklet_id) for r in plans.gr4_assign_one_to_one(spark, sf).collect()]
    assert all(apart) and len(found) == len(set(found)) and set(found) == apart[0] | apart[1]
    assert len({a for a, _ in found}) == len({b for _, b in found}) == len(found)


def test_registry_of_all_rows(spark, sf):
    rows = fx.view(spark, sf, "activations").collect()

    def latest(keep):
        return {r.task: r.model_id for r in sorted(filter(keep, rows), key=lambda r: r.activation_id)}

    active, route, loaded = latest(lambda r: r.status == "ACTIVE"), latest(lambda r: r.runtime_applied), latest(lambda r: r.status != "FAILED")
    wanted = {}
    for task in {*active, *route, *loaded}:
        a, b, c = (x.get(task) for x in (active, route, loaded))
        wanted[task] = ",".join(name for name, bad in (("NO_ACTIVE_MODEL", a is None), ("ROUTE_DIFFERS", a is not None and a != b), ("ROUTE_NOT_LOADED", b is not None and b != c)) if bad)
    assert {r.task: r.errors for r in sessions.ag15_registry_consistency(spark, sf).collect()} == wanted


def test_positives_over_all_blocks(spark, sf):
    parcels = max(fx.vectors(spark, sf).count() // 24, 1)
    items = sorted((r.item_id, r.session_id, r.split, r.vec_id % parcels, r.camera_role) for r in datasets._items(spark, sf).collect())
    wanted = {(a[0], b[0]) for a, b in combinations(items, 2) if a[1:4] == b[1:4] and a[4] != b[4]}
    out = datasets.jn12_reid_pairs(spark, sf).collect()
    found = [(r.left_id, r.right_id) for r in out if r.label == "POSITIVE"]
    assert len(found) == len(set(found)) and set(found) == wanted
    assert any(a // 200 != b // 200 for a, b in wanted)
    other = [(r.left_id, r.right_id) for r in out if r.label == "NEGATIVE"]
    order, wanted = {}, []
    for item in sorted(items, key=lambda r: (hashlib.sha256(str(r[0]).encode()).hexdigest(), r[0])):
        order.setdefault(item[1:3], []).append(item)
    for rows in order.values():
        for k, a in enumerate(rows):
            wanted += [tuple(sorted((a[0], b[0]))) for b in [b for b in rows[k + 1 : k + 1 + ops.LOOK] if b[3] != a[3]][: ops.NEGATIVES]]
    assert sorted(other) == sorted(wanted)
