"""Order-dependent jobs: folds over the rows of a key in time order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrack.operators.keyed import Fold, fold_frames


class _Greedy(Fold):
    """Live tracks of one source and epoch, by class: box, area and the step they were last seen in, the longest unseen first."""

    def __init__(self, least: float, misses: int):
        self.least, self.misses, self.live, self.fresh, self.step = least, misses, {}, 1, 0

    def frame(self, rows: list[tuple]) -> list[tuple]:
        self.step += 1
        for tracks in self.live.values():
            while tracks and tracks[t := next(iter(tracks))][5] < self.step - self.misses - 1:
                del tracks[t]
        least, pairs = self.least, []
        areas = [max(1.0, (x2 - x1) * (y2 - y1)) for _, _, x1, y1, x2, y2 in rows]
        for k, (_, name, x1, y1, x2, y2) in enumerate(rows):
            for t, (a1, b1, a2, b2, area, _) in self.live.get(name, {}).items():
                w, h = (a2 if a2 < x2 else x2) - (a1 if a1 > x1 else x1), (b2 if b2 < y2 else y2) - (b1 if b1 > y1 else y1)
                shared = w * h if w > 0 and h > 0 else 0.0
                if (shared or least <= 0) and (s := shared / (area + areas[k] - shared + 1e-6)) >= least:
                    pairs.append((s, t, k))
        used, given = set(), {}
        for _, t, k in sorted(pairs, reverse=True):
            if t not in used and k not in given:
                used.add(t)
                given[k] = t
        for k, (_, name, *box) in enumerate(rows):
            if k not in given:
                given[k] = self.fresh
                self.fresh += 1
            tracks = self.live.setdefault(name, {})
            tracks.pop(given[k], None)
            tracks[given[k]] = (*box, areas[k], self.step)
        return [(r[0], given[k]) for k, r in enumerate(rows)]


def greedy_iou_tracks(dets: DataFrame, least: float = 0.10, misses: int = 6) -> DataFrame:
    """(session, source, epoch, frame, obs_index, track_id): ST1.

    In each frame detections and live tracks of one class are matched by falling IoU (ties:
    larger track, then larger detection); the rest start tracks in detection order; a track ends
    after more than ``misses`` frames without a match. Keyed by source and epoch; frames stream, only live tracks are held.
    """
    return fold_frames(dets, ["session_id", "source_id", "stream_epoch"], ["frame_index"], ["obs_index", "class_name", "x1", "y1", "x2", "y2"], lambda: _Greedy(least, misses), "obs_index int, track_id long")


class _Segments(Fold):
    def __init__(self, seconds: float):
        self.seconds, self.segment, self.start, self.epoch, self.at = seconds, -1, None, None, 0

    def frame(self, rows: list[tuple]) -> list[tuple]:
        out = []
        for epoch, time in rows:
            if self.start is None or epoch != self.epoch or time - self.start >= self.seconds:
                self.segment, self.start, self.epoch, self.at = self.segment + 1, time, epoch, 0
            out.append((time, self.segment, self.at))
            self.at += 1
        return out


def segment_frames(frames: DataFrame, seconds: float = 60.0) -> DataFrame:
    """Adds ``segment`` and ``position`` (ST10): a new segment when ``seconds`` have passed since its start, or the epoch changes. Frames of a source stream in order."""
    return fold_frames(frames, ["session_id", "source_id"], ["stream_epoch", "frame_index"], ["stream_epoch", "timestamp_global"], lambda: _Segments(seconds), "timestamp_global double, segment long, position long")


class _Best(Fold):
    """The best views of a track so far, and the newest view that was far enough from the one before."""

    def __init__(self, apart: int, most: int):
        self.apart, self.most, self.newest, self.kept = apart, most, None, []

    def frame(self, rows: list[tuple]) -> list[tuple]:
        frame, quality = rows[0]
        if self.newest is None or frame - self.newest >= self.apart:
            self.newest = frame
            self.kept = sorted([*self.kept, (frame, quality)], key=lambda v: (-v[1], v[0]))[: self.most]
        return []

    def end(self) -> list[tuple]:
        return self.kept


def keyframes(views: DataFrame, keys: list[str], least: float = 0.30, apart: int = 2, most: int = 5) -> DataFrame:
    """The best views of each track (TK3): quality at least ``least``, ``apart`` frames after the newest kept one, top ``most``.

    ``views`` has confidence, area, sharpness, geometry, zone and integrity scores in 0..1. Of views of one frame the first
    by quality counts, the smaller first.
    """
    weights = {"confidence": 0.32, "area": 0.18, "sharpness": 0.22, "geometry": 0.12, "zone": 0.10, "integrity": 0.06}
    scored = views.select(*keys, "frame_index", sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0)).alias("quality")).where(F.col("quality") >= least)
    found = fold_frames(scored, keys, ["frame_index"], ["frame_index", "quality"], lambda: _Best(apart, most), "kept long, view_quality double")
    return found.select(*keys, F.col("kept").alias("frame_index"), F.col("view_quality").alias("quality"))


def score_frames(frames: DataFrame, make_predict, schema: str) -> DataFrame:
    """Frames with a user's model applied (ML1): ``make_predict()`` loads it once per task and maps pandas frames."""

    def run(batches):
        predict = make_predict()
        for pdf in batches:
            yield predict(pdf)

    return frames.mapInPandas(run, schema)
