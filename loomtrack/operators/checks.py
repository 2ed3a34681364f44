"""Checks of site dimensions, poses and dataset artefacts: one row for each broken rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrack.operators.datasets import SPLITS, split_leaks

ZONE_KINDS = ("entry", "exit", "pick", "destination")


def _names(rules: list[tuple[str, Column]]) -> Column:
    """The names of the rules whose condition is true."""
    return F.array_compact(F.array(*(F.when(F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules)))


def _broken(rows: DataFrame, keys: list[str], rules: list[tuple[str, Column]]) -> DataFrame:
    """(keys, rule) for each rule whose condition is true for a row."""
    return rows.select(*keys, F.explode(_names(rules)).alias("rule"))


def polygon_crosses(points: Column) -> Column:
    """Whether two sides of a polygon that do not meet at a corner cross each other."""
    n = F.size(points)
    at = lambda k: F.get(points, k % n)
    turn = lambda a, b, c: (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])

    def cross(i: Column, j: Column) -> Column:
        a, b, c, d = at(i), at(i + 1), at(j), at(j + 1)
        apart = (j > i + 1) & ((j + 1) % n != i)
        return apart & (turn(a, b, c) * turn(a, b, d) < -1e-12) & (turn(c, d, a) * turn(c, d, b) < -1e-12)

    sides = F.sequence(F.lit(0), n - 1)
    return F.exists(sides, lambda i: F.exists(sides, lambda j: cross(i, j)))


def check_site_dimensions(zones: DataFrame, edges: DataFrame) -> DataFrame:
    """(site_id, what, key, rule): one row per broken rule of a site's zones and edges (PF14).

    ``zones``: site_id, camera_role, zone_id, kind, x1, y1, x2, y2 and ``polygon``, an array of
    (x, y) in world metres or null; ``edges``: site_id, from_role, to_role, min_transit_s,
    max_transit_s. A zone needs a box or a polygon; boxes are shares of the image.
    """
    name = F.trim(F.coalesce("zone_id", F.lit("")))
    rows = zones.withColumn("copies", F.count("*").over(Window.partitionBy("site_id", "camera_role", "zone_id")))
    corners = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    given = sum((c.isNotNull().cast("int") for c in corners), F.lit(0))
    inside = (corners[0] >= 0) & (corners[0] < corners[2]) & (corners[2] <= 1) & (corners[1] >= 0) & (corners[1] < corners[3]) & (corners[3] <= 1)
    p, n = F.col("polygon"), F.size("polygon")
    at = lambda k: F.get("polygon", k % n)
    area = F.aggregate(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: at(k)["x"] * at(k + 1)["y"] - at(k + 1)["x"] * at(k)["y"]), F.lit(0.0), lambda s, x: s + x)
    finite = F.forall(p, lambda q: q["x"].isNotNull() & q["y"].isNotNull() & ~F.isnan(q["x"]) & ~F.isnan(q["y"]) & (F.abs(q["x"]) != float("inf")) & (F.abs(q["y"]) != float("inf")))
    sound = p.isNotNull() & (F.size(F.array_distinct(p)) >= 3) & finite
    rules = [
        ("ROLE_MISSING", F.trim(F.coalesce("camera_role", F.lit(""))) == ""), ("ID_MISSING", name == ""), ("ID_DUPLICATE", (name != "") & (F.col("copies") > 1)),
        ("KIND", ~F.coalesce(F.lower(F.trim("kind")).isin(*ZONE_KINDS), F.lit(False))), ("BOX_INCOMPLETE", (given > 0) & (given < 4)), ("BOX_RANGE", (given == 4) & ~inside),
        ("NO_GEOMETRY", (given < 4) & p.isNull()), ("POLYGON_POINTS", p.isNotNull() & (F.size(F.array_distinct(p)) < 3)), ("POLYGON_NUMBERS", p.isNotNull() & ~finite),
        ("POLYGON_AREA", sound & (F.abs(area) <= 1e-9)), ("POLYGON_CROSSES", F.when(sound, polygon_crosses(p))),
    ]
    of_zones = _broken(rows.withColumn("key", F.concat_ws("/", "camera_role", "zone_id")), ["site_id", F.lit("zone").alias("what"), "key"], rules)
    low, high = F.col("min_transit_s"), F.col("max_transit_s")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    links = [("ROLE_MISSING", blank("from_role") | blank("to_role")), ("SELF_LOOP", F.col("from_role") == F.col("to_role")), ("WINDOW", low.isNull() | high.isNull() | F.isnan(low) | F.isnan(high) | (low < 0) | (high < low))]
    return of_zones.unionByName(_broken(edges.withColumn("key", F.concat_ws("->", "from_role", "to_role")), ["site_id", F.lit("edge").alias("what"), "key"], links))


def validate_pose(dets: DataFrame, width: float = 640.0, height: float = 360.0, points: int = 17) -> DataFrame:
    """(item_id, instance, keypoint, rule): broken rules of pose detections (DQ10); ``keypoint`` is null for rules of the instance.

    ``dets``: item_id, instance (null for an item without any), class_name, x1, y1, x2, y2,
    ``keypoints`` (x, y, v) and, where known, ``keypoint_indices``.
    """
    box = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    odd = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    no_number = box[0].isNull() | box[1].isNull() | box[2].isNull() | box[3].isNull()
    infinite = odd(box[0]) | odd(box[1]) | odd(box[2]) | odd(box[3])
    there, k = F.col("instance").isNotNull(), F.coalesce(F.size("keypoints"), F.lit(0))
    full = there & (k == points)
    visible = F.exists("keypoints", lambda q: F.coalesce(q["v"] > 0, F.lit(False)))
    indices = F.col("keypoint_indices") if "keypoint_indices" in dets.columns else F.lit(None).cast("array<int>")
    rules = [
        ("NO_INSTANCE", ~there), ("CLASS", there & ~F.col("class_name").eqNullSafe(F.lit("person"))), ("BOX_MISSING", there & no_number), ("BOX_NUMBERS", there & ~no_number & infinite),
        ("BOX_RANGE", there & ~no_number & ~infinite & ((box[2] <= box[0]) | (box[3] <= box[1]) | (box[0] < 0) | (box[1] < 0) | (box[2] > width) | (box[3] > height))),
        ("KEYPOINT_COUNT", there & (k != points)), ("KEYPOINT_ORDER", full & indices.isNotNull() & (indices != F.sequence(F.lit(0), F.lit(points - 1)))), ("NONE_VISIBLE", full & ~visible),
    ]

    def of_point(p: Column, k: Column) -> Column:
        x, y, v = p["x"], p["y"], p["v"]
        missing = x.isNull() | y.isNull() | v.isNull()
        bad = odd(x) | odd(y) | odd(v)
        broken = F.when(missing, "POINT_MISSING").when(bad, "POINT_NUMBERS")  # either stands alone
        place = F.when(~missing & ~bad & ((x < 0) | (y < 0) | (x > width) | (y > height)), "POINT_RANGE")
        shown = F.when(~missing & ~bad & ((v < 0) | (v > 2)), "VISIBILITY")
        return F.struct(k.alias("keypoint"), F.array_compact(F.array(broken, place, shown)).alias("rules"))

    of_points = F.when(full, F.filter(F.transform("keypoints", of_point), lambda p: F.size(p["rules"]) > 0))
    of_instance = F.struct(F.lit(None).cast("int").alias("keypoint"), _names(rules).alias("rules"))
    # one pass over the rows; outer generators infer no filter, which would work all rules out a second time
    found = dets.select("item_id", "instance", F.explode_outer(F.concat(F.array(of_instance), F.coalesce(of_points, F.array()))).alias("f"))
    return found.select("item_id", "instance", "f.keypoint", F.explode_outer("f.rules").alias("rule")).where("rule IS NOT NULL")


def validate_reid_artifacts(manifest: DataFrame, pairs: DataFrame) -> DataFrame:
    """(left_crop, right_crop, rule): broken rules of a re-identification manifest and its pairs (DQ12).

    ``manifest``: crop_path, global_id, camera_role; ``pairs``: left_crop, right_crop, label (1 or
    0). Rules of the whole set have null crops.
    """
    known = manifest.groupBy("crop_path").agg(F.max("global_id").alias("id"), F.max("camera_role").alias("camera"))
    side = lambda p: known.select(*(F.col(c).alias(f"{p}_{c}") for c in known.columns))
    both = pairs.join(side("l").hint("merge"), F.col("left_crop") == F.col("l_crop_path"), "left").join(side("r").hint("merge"), F.col("right_crop") == F.col("r_crop_path"), "left")
    label, found = F.col("label"), F.col("l_crop_path").isNotNull() & F.col("r_crop_path").isNotNull()
    same = F.col("l_id").eqNullSafe(F.col("r_id"))
    rules = [
        ("LABEL", ~F.coalesce(label.isin(0, 1), F.lit(False))), ("CROP_MISSING", F.col("left_crop").isNull() | F.col("right_crop").isNull()), ("CROP_UNKNOWN", ~found),
        ("POSITIVE", found & (label == 1) & (~same | F.col("l_camera").eqNullSafe(F.col("r_camera")))), ("NEGATIVE", found & (label == 0) & same),
    ]
    none = [F.lit(None).cast("string").alias(c) for c in ("left_crop", "right_crop")]
    ids = _broken(manifest.agg(F.count_if(F.coalesce("global_id", F.lit("")) == "").alias("n")), none, [("IDENTITY_MISSING", F.col("n") > 0)])
    kinds = _broken(pairs.agg(F.count_if(label == 1).alias("p"), F.count_if(label == 0).alias("q")), none, [("BOTH_KINDS_NEEDED", (F.col("p") == 0) | (F.col("q") == 0))])
    return _broken(both, ["left_crop", "right_crop"], rules).unionByName(ids).unionByName(kinds)


def integrity_report(items: DataFrame, sessions: DataFrame, *errors: DataFrame) -> DataFrame:
    """(area, rule, n): counts of what is wrong with a dataset (DQ13); no rows mean that it is valid.

    Leaks between splits, sessions that do not exist and empty splits are found here;
    ``errors`` are tables of checks with a column ``rule`` (labels, poses, artefacts).
    """
    leaks = split_leaks(items).groupBy(F.col("kind").alias("rule")).agg(F.count("*").alias("n")).select(F.lit("split").alias("area"), "rule", "n")
    gaps = items.join(sessions.select("session_id").distinct().hint("merge"), "session_id", "left_anti").agg(F.count("*").alias("n")).where("n > 0").select(F.lit("session").alias("area"), F.lit("UNKNOWN_SESSION").alias("rule"), "n")
    filled = items.agg(*(F.count_if(F.col("split") == s).alias(s) for s in SPLITS))
    empty = filled.select(F.explode(F.array_compact(F.array(*(F.when(F.col(s) == 0, F.lit(s)) for s in SPLITS)))).alias("s")).select(F.lit("split").alias("area"), F.concat(F.lit("EMPTY_"), F.upper("s")).alias("rule"), F.lit(1).cast("long").alias("n"))
    out = leaks.unionByName(gaps).unionByName(empty)
    for found in errors:
        out = out.unionByName(found.groupBy("rule").agg(F.count("*").alias("n")).select(F.lit("check").alias("area"), "rule", "n"))
    return out


def dataset_fingerprint(items: DataFrame, files: DataFrame, config: str = "{}") -> DataFrame:
    """(fingerprint, rows): a digest of a dataset's items, file digests and configuration (DQ6).

    Rows are hashed one by one; their digests are combined in 4,096 ranges, and these in
    order, so that no task holds them all. The order of rows and columns does not matter, every value does.
    ``files``: path, digest.
    """

    def digests(rows: DataFrame, kind: str) -> DataFrame:
        return rows.select(F.sha2(F.concat(F.lit(f"{kind}:"), F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})), 256).alias("h"))

    each = digests(items, "item").unionByName(digests(files, "file")).withColumn("lead", F.substring("h", 1, 3))
    parts = each.groupBy("lead").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("d"), F.count("*").alias("n"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lead", "d"))), lambda x: x["d"]), "")  # at most 4096
    return parts.agg(F.sha2(F.concat(F.lit(f"config:{config}:"), whole), 256).alias("fingerprint"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def import_reviews(items: DataFrame, reviewed: DataFrame, errors: DataFrame) -> DataFrame:
    """``items`` with reviewed labels and status HUMAN_VALIDATED, all or nothing (DQ15).

    ``reviewed``: item_id, label; ``errors``: what the checks found in the reviewed detections.
    With any error, or a reviewed id that does not exist, the items come back unchanged.
    """
    unknown = reviewed.select("item_id").join(items.select("item_id").hint("merge"), "item_id", "left_anti")
    ok = errors.limit(1).agg(F.count("*").alias("a")).crossJoin(unknown.limit(1).agg(F.count("*").alias("b"))).select(((F.col("a") == 0) & (F.col("b") == 0)).alias("all_valid"))  # one row
    new = reviewed.groupBy("item_id").agg(F.max("label").alias("new_label"))
    joined = items.join(new.hint("merge"), "item_id", "left").crossJoin(ok)
    take = F.col("all_valid") & F.col("new_label").isNotNull()
    kept = [c for c in items.columns if c not in ("label", "annotation_status")]
    return joined.select(*kept, F.when(take, F.col("new_label")).otherwise(F.col("label")).alias("label"), F.when(take, F.lit("HUMAN_VALIDATED")).otherwise(F.col("annotation_status")).alias("annotation_status"))
