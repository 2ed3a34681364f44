"""Calibration profiles: choice, checks and image-to-world mapping. Profiles are a small dimension (one per source and version)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtrack.functions.shared import dimension


def active_profile(profiles: DataFrame, assignments: DataFrame) -> DataFrame:
    """Assigned profiles with the next free version of their source, and whether the stored fingerprint still fits (PF8)."""
    latest = profiles.groupBy("source_id").agg((F.max("version") + 1).alias("next_version"))
    digest = F.sha2(F.concat_ws("|", "source_id", "version", F.to_json("homography")), 256)
    chosen = assignments.select("profile_id").join(profiles, "profile_id").withColumn("fingerprint_ok", F.col("fingerprint") == digest)
    return chosen.join(latest, "source_id")


def calibration_diagnostic(sources: DataFrame, profiles: DataFrame) -> DataFrame:
    """Adds ``calibration``: the first rule that holds for a source and its profile (PF7)."""
    p = profiles.select(F.col("profile_id"), F.col("source_id").alias("p_source"), F.col("optics").alias("p_optics"), F.col("width").alias("p_width"), F.col("height").alias("p_height"), F.col("valid").alias("p_valid"))
    rules = (
        ("NO_PROFILE", F.col("p_source").isNull()),
        ("WRONG_SOURCE", F.col("p_source") != F.col("source_id")),
        ("OPTICAL_CONFIG_UNKNOWN", F.col("p_optics").isNotNull() & F.col("optics").isNull()),
        ("INCOMPATIBLE_OPTICAL_CONFIG", F.col("p_optics").isNotNull() & (F.col("p_optics") != F.col("optics"))),
        ("INCOMPATIBLE_RESOLUTION", (F.col("p_width") != F.col("width")) | (F.col("p_height") != F.col("height"))),
        ("PROFILE_NOT_VALID", ~F.col("p_valid")),
    )
    status: Column | None = None
    for name, holds in rules:
        status = F.when(holds, name) if status is None else status.when(holds, name)
    return sources.join(dimension(p), "profile_id", "left").withColumn("calibration", status.otherwise("READY")).drop("p_source", "p_optics", "p_width", "p_height", "p_valid")


def _apply(h: Column, x: Column, y: Column) -> tuple[Column, Column]:
    at = lambda k: F.get(h, F.lit(k))
    w = at(6) * x + at(7) * y + at(8)
    return F.when(w != 0, (at(0) * x + at(1) * y + at(2)) / w), F.when(w != 0, (at(3) * x + at(4) * y + at(5)) / w)


def _inverse(h: Column) -> Column:
    """The inverse of a row-major 3x3 matrix, up to scale (the adjugate)."""
    a, b, c, d, e, f, g, i, j = (F.get(h, F.lit(k)) for k in range(9))
    return F.array(e * j - f * i, c * i - b * j, b * f - c * e, f * g - d * j, a * j - c * g, c * d - a * f, d * i - e * g, b * g - a * i, a * e - b * d)


#: Steps of the fixed point that takes lens distortion out of a point; each gains about a digit for usual lenses.
STEPS = 20
#: Lens parameters in a profile's ``distortion``: k1, k2, p1, p2, k3 (missing ones are 0).
LENS = 5


def _bend(x: Column, y: Column, lens: Column) -> tuple[Column, Column, Column]:
    """Radial factor and tangential shift of a normalized point."""
    k1, k2, p1, p2, k3 = (F.coalesce(F.get(lens, F.lit(k)), F.lit(0.0)) for k in range(LENS))
    r2 = x * x + y * y
    return 1 + r2 * (k1 + r2 * (k2 + r2 * k3)), 2 * p1 * x * y + p2 * (r2 + 2 * x * x), p1 * (r2 + 2 * y * y) + 2 * p2 * x * y


def _normal(camera: Column, x: Column, y: Column) -> tuple[Column, Column]:
    fx, skew, cx, fy, cy = (F.get(camera, F.lit(k)) for k in (0, 1, 2, 4, 5))
    v = (y - cy) / fy
    return (x - cx - skew * v) / fx, v


def _pixel(camera: Column, u: Column, v: Column) -> tuple[Column, Column]:
    fx, skew, cx, fy, cy = (F.get(camera, F.lit(k)) for k in (0, 1, 2, 4, 5))
    return fx * u + skew * v + cx, fy * v + cy


@F.arrow_udf(T.StructType().add("u", "double").add("v", "double"))
def _straight(u: pa.Array, v: pa.Array, k1: pa.Array, k2: pa.Array, p1: pa.Array, p2: pa.Array, k3: pa.Array) -> pa.Array:
    """Normalized points without their lens distortion, a batch at once; null where an input is, or where a step divides by zero."""
    given = (u, v, k1, k2, p1, p2, k3)
    missing = np.logical_or.reduce([c.is_null().to_numpy(zero_copy_only=False) for c in given])
    u0, v0, k1, k2, p1, p2, k3 = (c.to_numpy(zero_copy_only=False).astype(float) for c in given)
    x, y = u0, v0
    with np.errstate(all="ignore"):
        for _ in range(STEPS):
            r2 = x * x + y * y
            radial, du, dv = 1 + r2 * (k1 + r2 * (k2 + r2 * k3)), 2 * p1 * x * y + p2 * (r2 + 2 * x * x), p1 * (r2 + 2 * y * y) + 2 * p2 * x * y
            missing = missing | (radial == 0)
            x, y = (u0 - du) / radial, (v0 - dv) / radial
    return pa.StructArray.from_arrays([pa.array(c, pa.float64(), mask=missing) for c in (x, y)], ["u", "v"])


def undistorted(x: Column, y: Column, camera: Column, lens: Column) -> tuple[Column, Column]:
    """The pixel that a lens without distortion would show the point at; the same pixel where camera or lens is null."""
    flat = _straight(*_normal(camera, x, y), *(F.coalesce(F.get(lens, F.lit(k)), F.lit(0.0)) for k in range(LENS)))
    px, py = _pixel(camera, flat["u"], flat["v"])
    known = camera.isNotNull() & lens.isNotNull()
    return F.when(known, px).otherwise(x), F.when(known, py).otherwise(y)


def distorted(x: Column, y: Column, camera: Column, lens: Column) -> tuple[Column, Column]:
    """The pixel at which the lens shows the point that a lens without distortion shows at (x, y)."""
    u, v = _normal(camera, x, y)
    radial, du, dv = _bend(u, v, lens)
    px, py = _pixel(camera, u * radial + du, v * radial + dv)
    known = camera.isNotNull() & lens.isNotNull()
    return F.when(known, px).otherwise(x), F.when(known, py).otherwise(y)


def _optics(profiles: DataFrame) -> DataFrame:
    """Valid profiles by source, with ``camera_matrix`` and ``distortion`` (null where the table has none)."""
    lens = [F.col(c) if c in profiles.columns else F.lit(None).cast("array<double>").alias(c) for c in ("camera_matrix", "distortion")]
    return dimension(profiles.where("valid").select("source_id", "homography", *lens))


def to_world(points: DataFrame, profiles: DataFrame, x: str, y: str) -> DataFrame:
    """Adds ``world_x``, ``world_y``: lens distortion out, then the source's homography (PF5); null without a valid profile."""
    joined = points.join(_optics(profiles), "source_id", "left")
    ux, uy = undistorted(F.col(x), F.col(y), F.col("camera_matrix"), F.col("distortion"))
    flat = joined.withColumns({"__x": ux, "__y": uy})  # columns of their own: the homography names each several times
    wx, wy = _apply(F.col("homography"), F.col("__x"), F.col("__y"))
    return flat.withColumns({"world_x": wx, "world_y": wy}).drop("homography", "camera_matrix", "distortion", "__x", "__y")


def to_image(points: DataFrame, profiles: DataFrame, x: str, y: str) -> DataFrame:
    """Adds ``image_x``, ``image_y``: the inverse homography, then lens distortion (PF6); null without a valid profile."""
    joined = points.join(_optics(profiles), "source_id", "left")
    fx, fy = _apply(_inverse(F.col("homography")), F.col(x), F.col(y))
    flat = joined.withColumns({"__x": fx, "__y": fy})
    ix, iy = distorted(F.col("__x"), F.col("__y"), F.col("camera_matrix"), F.col("distortion"))
    return flat.withColumns({"image_x": ix, "image_y": iy}).drop("homography", "camera_matrix", "distortion", "__x", "__y")


def own_wrists(wrists: DataFrame, persons: DataFrame) -> DataFrame:
    """Explicit wrists with the one person of their frame that shares their link token (JN7); none or several leave it null."""
    frame = ["session_id", "source_id", "stream_epoch", "frame_index"]
    tokens = persons.select(*frame, "person_id", F.explode("tokens").alias("token")).distinct()
    owners = tokens.groupBy(*frame, "token").agg(F.count("*").alias("n"), F.min("person_id").alias("person_id")).where("n = 1").drop("n")
    return wrists.join(owners.hint("merge"), [*frame, "token"], "left")


def attach_sidecar_detections(frames: DataFrame, catalogue: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Frames with their detections (IO6): the catalogue's where it has any, else the sidecar's, and which it was."""
    keys = ["source_id", "frame_index"]
    own, other = catalogue.select(*keys, F.col("detections").alias("own")), sidecar.select(*keys, F.col("detections").alias("other"))
    joined = frames.join(own, keys, "left").join(other, keys, "left")
    return joined.select(*frames.columns, F.coalesce("own", "other").alias("detections"), F.when(F.col("own").isNotNull(), "catalogue").when(F.col("other").isNotNull(), "sidecar").alias("origin"))


def merge_members(obs: DataFrame, share: float = 0.35, area: float = 0.65) -> DataFrame:
    """(frame, box track, members): boxes that cover the share and the centre of two or more smaller tracks (JN16).

    The box's area must be at least ``area`` of the members' sum; both lie in one frame.
    """
    frame = ["session_id", "source_id", "stream_epoch", "frame_index"]
    side = lambda p: obs.select(*frame, *(F.col(c).alias(f"{p}{c}") for c in ("local_track_id", "x1", "y1", "x2", "y2")))
    pairs = side("b_").join(side("m_"), frame).where("b_local_track_id <> m_local_track_id")
    size = lambda p: (F.col(f"{p}x2") - F.col(f"{p}x1")) * (F.col(f"{p}y2") - F.col(f"{p}y1"))
    common = F.greatest(F.lit(0.0), F.least("b_x2", "m_x2") - F.greatest("b_x1", "m_x1")) * F.greatest(F.lit(0.0), F.least("b_y2", "m_y2") - F.greatest("b_y1", "m_y1"))
    inside = ((F.col("m_x1") + F.col("m_x2")) / 2).between(F.col("b_x1"), F.col("b_x2")) & ((F.col("m_y1") + F.col("m_y2")) / 2).between(F.col("b_y1"), F.col("b_y2"))
    held = pairs.where(inside & (common >= share * size("m_"))).groupBy(*frame, "b_local_track_id").agg(F.count("*").alias("members"), F.sum(size("m_")).alias("member_area"), F.max(size("b_")).alias("box_area"))
    return held.where((F.col("members") >= 2) & (F.col("box_area") >= area * F.col("member_area"))).select(*frame, F.col("b_local_track_id").alias("local_track_id"), "members")
