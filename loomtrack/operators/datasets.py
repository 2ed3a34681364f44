"""Dataset items: hashes, splits, near duplicates, leaks and checks."""

from __future__ import annotations

import hashlib
import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrack.functions.shared import written
from loomtrack.operators.graph import connected_components
from loomtrack.operators.keyed import Fold, fold_frames

SPLITS = ("train", "val", "test")
TRAINABLE = ("AUTO_ACCEPTED", "HUMAN_VALIDATED")


def mean_threshold_hash(vector: str) -> Column:
    """64 bits, value > mean, first value the highest bit (SC1); null unless there are 64 values."""
    v = F.col(vector)
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / 64
    bits = F.transform(v, lambda x, i: F.when(x > mean, F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(63) - i).cast("int"))).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(v) == 64, F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x)))


def stable_split(session: str = "session_id") -> Column:
    """train, val or test from the first eight hex digits of the session's SHA-256 (SC2)."""
    k = F.conv(F.substring(F.sha2(session, 256), 1, 8), 16, 10).cast("long") % 10
    return F.when(k < 7, "train").when(k < 9, "val").otherwise("test")


def near_classes(items: DataFrame, most: int = 3) -> DataFrame:
    """(hash, hash2), hash < hash2: different hashes of ``items`` that differ in at most ``most`` (up to 3) bits.

    Four 16-bit bands: hashes at distance 3 or less agree in one. However many items share a hash, it is compared once.
    """
    classes = items.select("hash").where("hash IS NOT NULL").distinct()
    bands = F.array(*(F.struct(F.lit(k).alias("band"), F.shiftrightunsigned("hash", 16 * k).bitwiseAND(F.lit(0xFFFF)).alias("part")) for k in range(4)))
    cut = classes.select("hash", F.explode(bands).alias("b")).select("hash", "b.band", "b.part")
    other = cut.withColumnRenamed("hash", "hash2")
    return cut.join(other.hint("merge"), ["band", "part"]).where((F.col("hash") < F.col("hash2")) & (F.bit_count(F.col("hash").bitwiseXOR(F.col("hash2"))) <= most)).select("hash", "hash2").distinct()


def near_duplicates(items: DataFrame, across: str | None = "split", most: int = 3) -> DataFrame:
    """(left_id, right_id, distance): items whose hashes differ in at most 3 bits, of different ``across`` values (JN10).

    The pairs themselves are the result that is asked for; ``near_classes`` and ``split_leak_classes`` do without listing copies.
    """
    keep = [c for c in (across,) if c]
    near = near_classes(items, most).unionByName(items.select("hash", F.col("hash").alias("hash2")).where("hash IS NOT NULL").distinct())
    a = items.select(F.col("item_id").alias("a"), "hash", *(F.col(c).alias("sa") for c in keep))
    b = items.select(F.col("item_id").alias("b"), F.col("hash").alias("hash2"), *(F.col(c).alias("sb") for c in keep))
    pairs = near.join(a.hint("merge"), "hash").join(b.hint("merge"), "hash2").where("hash <> hash2 OR a < b")
    pairs = pairs.where("sa <> sb") if keep else pairs
    return pairs.select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"), F.bit_count(F.col("hash").bitwiseXOR(F.col("hash2"))).cast("int").alias("distance"))


def split_leak_classes(items: DataFrame, most: int = 3) -> DataFrame:
    """(hash, hash2, splits, n): near or equal hashes whose items stand in several splits, with these splits and the number of items of both.

    One row per pair of classes, so a million copies of one image in two splits are one row.
    """
    held = items.where("hash IS NOT NULL").groupBy("hash").agg(F.collect_set("split").alias("s"), F.count("*").alias("n"))  # three splits at most
    other = held.select(F.col("hash").alias("hash2"), F.col("s").alias("s2"), F.col("n").alias("n2"))
    near = near_classes(items, most).join(held.hint("merge"), "hash").join(other.hint("merge"), "hash2").select("hash", "hash2", F.array_sort(F.array_union("s", "s2")).alias("splits"), (F.col("n") + F.col("n2")).alias("n"))
    same = held.select("hash", F.col("hash").alias("hash2"), F.array_sort("s").alias("splits"), "n")
    return near.unionByName(same).where(F.size("splits") > 1)


def split_at(place: np.ndarray, counts: list[int], weights: tuple[int, ...]) -> np.ndarray:
    """Split of the session at each place (from 0) of the order: empty splits first, then always the least full, ties by name.

    A split that holds c sessions is filled to c / weight; the places are the merged steps c, c + 1, ...
    of all splits by that measure, so the split at a place is found by bisection.
    """
    empty = [k for k, c in enumerate(counts) if c == 0]
    held = np.array([max(c, 1) for c in counts])
    scale = np.array([math.lcm(*weights) // w for w in weights])
    wanted = np.maximum(place - len(empty), 0)

    def steps(upto: np.ndarray) -> np.ndarray:
        """How many steps have a fill of at most ``upto``, in units of one over the weights' least common multiple."""
        return np.maximum(upto[:, None] // scale - held + 1, 0).sum(axis=1)

    low, high = np.zeros(len(place), np.int64), np.full(len(place), (int(held.max()) + int(place.max(initial=0)) + 2) * int(scale.max()), np.int64)
    while (low < high).any():
        middle = (low + high) // 2
        enough = steps(middle) > wanted
        low, high = np.where(enough, low, middle + 1), np.where(enough, middle, high)
    tie = wanted - steps(low - 1)  # of the splits with a step at this fill, by name
    names = sorted(range(len(SPLITS)), key=lambda k: SPLITS[k])
    there = np.stack([(low % scale[k] == 0) & (low // scale[k] >= held[k]) for k in names], axis=1)
    found = np.array(SPLITS)[np.array(names)[(there.cumsum(axis=1) == (tie + 1)[:, None]).argmax(axis=1)]]
    return np.where(place < len(empty), np.array([SPLITS[k] for k in empty] + [""])[np.minimum(place, len(empty))], found)


def assign_splits(sessions: DataFrame, explicit: DataFrame, weights: tuple[int, ...] = (7, 2, 1)) -> DataFrame:
    """(session_id, split): explicit ones first, then sessions in hash order fill empty splits and the least full one (DQ3).

    The order of splits depends on counts alone, so each session's split follows from its rank
    (``split_at``); ranks are counted within hash ranges.
    """
    fixed = sessions.join(explicit, "session_id")
    rest = sessions.join(explicit, "session_id", "left_anti").withColumn("h", F.sha2("session_id", 256)).withColumn("lead", F.substring("h", 1, 3))
    before = rest.groupBy("lead").agg(F.count("*").alias("k")).withColumn("before", F.coalesce(F.sum("k").over(Window.orderBy("lead").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # at most 4096 rows
    placed = rest.join(before.select("lead", "before"), "lead").withColumn("place", F.col("before") + F.row_number().over(Window.partitionBy("lead").orderBy("h", "session_id")) - 1)
    have = {r["split"]: r["n"] for r in fixed.groupBy("split").agg(F.count("*").alias("n")).collect()}  # three rows
    counts = [have.get(s, 0) for s in SPLITS]
    pick = F.pandas_udf(lambda place: pd.Series(split_at(place.to_numpy(), counts, weights)), "string")(F.col("place"))
    return fixed.select("session_id", "split").unionByName(placed.select("session_id", pick.alias("split")))


def split_leaks(items: DataFrame) -> DataFrame:
    """(kind, key): what stands in several splits: sessions, groups, images, near duplicates; and bad hashes (DQ4)."""
    several = lambda kind, c: items.groupBy(F.col(c).alias("key")).agg(F.countDistinct("split").alias("n")).where("n > 1").select(F.lit(kind).alias("kind"), F.col("key").cast("string").alias("key"))
    near = near_duplicates(items).select(F.lit("near_duplicate").alias("kind"), F.concat_ws("|", "left_id", "right_id").alias("key"))
    bad = items.where("hash IS NULL").select(F.lit("bad_hash").alias("kind"), F.col("item_id").cast("string").alias("key"))
    return several("session", "session_id").unionByName(several("group", "sample_group_id")).unionByName(several("image", "image_sha256")).unionByName(near).unionByName(bad)


class _Digest(Fold):
    """SHA-256 of a JSON list, fed row by row."""

    def __init__(self):
        self.hash, self.n = hashlib.sha256(b"["), 0

    def frame(self, rows: list[tuple]) -> list[tuple]:
        for session, group, source, frame in rows:
            self.hash.update(("," if self.n else "").encode() + json.dumps([session, group, source, frame], separators=(",", ":")).encode())
            self.n += 1
        return []

    def end(self) -> list[tuple]:
        self.hash.update(b"]")
        return [(self.hash.hexdigest(), self.n)]


def frozen_test_digest(items: DataFrame, source: str = "camera_role") -> DataFrame:
    """(digest, merkle, n): digests of the test keys (session, group, source, frame) in order (DQ5).

    ``digest`` is the SHA-256 of the keys as one JSON list, which only reading them in order gives: they
    stream, sorted, through one task, with nothing held. ``merkle`` combines digests of rows in 4,096
    ranges and scales; compare that one for test splits of many millions of rows.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    keys = items.where("split = 'test'").select(F.lit(0).alias("all"), text("session_id").alias("a"), text("sample_group_id").alias("b"), text(source).alias("c"), F.coalesce(F.col("frame_index").cast("long"), F.lit(0)).alias("d"))
    digest = fold_frames(keys, ["all"], ["a"], ["a", "b", "c", "d"], _Digest, "digest string, n long").agg(F.coalesce(F.max("digest"), F.sha2(F.lit("[]"), 256)).alias("digest"), F.coalesce(F.max("n"), F.lit(0)).alias("n"))
    rows = keys.select(F.sha2(F.to_json(F.array(F.to_json(F.struct("a", "b", "c", "d")))), 256).alias("h")).withColumn("lead", F.substring("h", 1, 3))
    parts = rows.groupBy("lead").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("d"))
    merkle = parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lead", "d"))), lambda x: x["d"]), ""), 256).alias("merkle"))
    return digest.crossJoin(merkle).select("digest", "merkle", "n")  # one row each


def merge_sources(*sources: DataFrame, key: str = "item_id") -> DataFrame:
    """One row per key, from the first source that has it (SO1); sources share their columns."""
    ranked = [rows.withColumn("__place", F.lit(k)) for k, rows in enumerate(sources)]
    both = ranked[0]
    for rows in ranked[1:]:
        both = both.unionByName(rows)
    others = [c for c in sources[0].columns if c != key]
    best = both.groupBy(key).agg(F.min_by(F.struct(*others), "__place").alias("best"))
    return best.select(key, *(F.col(f"best.{c}").alias(c) for c in others))


def review_counts(items: DataFrame) -> DataFrame:
    """(session_id, accepted, rejected, pending, trainable): AG4."""
    s = F.col("annotation_status")
    return items.groupBy("session_id").agg(F.count_if(s == "AUTO_ACCEPTED").alias("accepted"), F.count_if(s == "REJECTED").alias("rejected"), F.count_if(s == "NEEDS_REVIEW").alias("pending"), F.count_if(s.isin(*TRAINABLE)).alias("trainable"))


def split_counts(items: DataFrame) -> DataFrame:
    """(train, val, test, all_filled): AG5."""
    counts = items.agg(*(F.count_if(F.col("split") == s).alias(s) for s in SPLITS))
    return counts.withColumn("all_filled", (F.col("train") > 0) & (F.col("val") > 0) & (F.col("test") > 0))


def dataset_sessions_rollup(items: DataFrame) -> DataFrame:
    """(session_id, cameras, roles): AG6."""
    return items.groupBy("session_id").agg(F.countDistinct("camera_role").alias("cameras"), F.array_join(F.array_sort(F.collect_set("camera_role")), ",").alias("roles"))


def training_manifest(items: DataFrame) -> DataFrame:
    """Accepted items with a label, in order of group and role (IO12)."""
    return items.where(F.col("annotation_status").isin(*TRAINABLE) & F.col("label").isNotNull()).select("item_id", "session_id", "sample_group_id", "camera_role", "split", "image_sha256", "label").orderBy("sample_group_id", "camera_role", "item_id")


def tracking_manifest(items: DataFrame) -> DataFrame:
    """One row per observation with a track id (IO13)."""
    return items.select("item_id", "session_id", "camera_role", F.explode("observations").alias("o")).where("o.track_id IS NOT NULL").select("item_id", "session_id", "camera_role", F.col("o.track_id").alias("track_id"), F.concat_ws(":", "session_id", "camera_role", F.col("o.track_id")).alias("identity"))


def reid_manifest(items: DataFrame, width: float = 640.0, height: float = 360.0) -> DataFrame:
    """Parcel observations with an identity, boxes clipped to the image (IO14); empty boxes are dropped."""
    o = items.select("item_id", "session_id", "camera_role", "split", F.explode("observations").alias("o")).where("o.class_name = 'parcel' AND o.global_id IS NOT NULL")
    clip = lambda c, m: F.least(F.greatest(F.col(f"o.{c}"), F.lit(0.0)), F.lit(m))
    return o.select("item_id", "session_id", "camera_role", "split", F.col("o.global_id").alias("global_id"), clip("x1", width).alias("x1"), clip("y1", height).alias("y1"), clip("x2", width).alias("x2"), clip("y2", height).alias("y2")).where("x2 > x1 AND y2 > y1")


def reid_status(items: DataFrame) -> DataFrame:
    """(session_id, crops, missing, status): READY, NEEDS_REVIEW (identities missing) or NOT_READY (no crop)."""
    o = items.select("session_id", F.explode("observations").alias("o")).where("o.class_name = 'parcel'")
    n = o.groupBy("session_id").agg(F.count("o.global_id").alias("crops"), F.count_if(F.col("o.global_id").isNull()).alias("missing"))
    return n.withColumn("status", F.when(F.col("crops") == 0, "NOT_READY").when(F.col("missing") > 0, "NEEDS_REVIEW").otherwise("READY"))


#: Negatives for each item, and how many items further on are looked at for them.
NEGATIVES, LOOK = 4, 24


def reid_pairs(manifest: DataFrame, negatives: int = NEGATIVES, look: int = LOOK) -> DataFrame:
    """(left_id, right_id, label): the positives of a session and split, and ``negatives`` negatives for each item (JN12).

    All negatives would be nearly all pairs of a session. Instead the items of a session and split stand in the order of their ids'
    SHA-256, and each meets the next ``negatives`` items of other parcels, of the ``look`` that follow it: a random choice, spread over the
    whole session and split, that is the same in every run. Items without a parcel have no pairs. The order is cut into 4,096 ranges of hashes, so that no task sorts a session.
    """
    rows = manifest.where("global_id IS NOT NULL").select("session_id", "split", "item_id", "global_id", F.sha2(F.col("item_id").cast("string"), 256).alias("h")).withColumn("range", F.substring("h", 1, 3))
    key, one = ["session_id", "split"], F.struct("item_id", "global_id")
    within = Window.partitionBy(*key, "range").orderBy("h", "item_id")
    placed = written(rows.withColumns({"place": F.row_number().over(within), "after": F.collect_list(one).over(within.rowsBetween(1, look))}), "reid-order")
    # the first items of each range stand in for the ranges after one: at most ``look`` for each of 4,096
    heads = placed.where(F.col("place") <= look)
    following = F.collect_list(one).over(Window.partitionBy(*key).orderBy("range", "place").rowsBetween(1, look))
    last = F.lead("range").over(Window.partitionBy(*key).orderBy("range", "place"))
    ends = heads.select(*key, "range", following.alias("beyond"), last.alias("next")).where("next IS NULL OR next <> range").drop("next")
    joined = placed.join(ends.hint("merge"), [*key, "range"])
    others = F.filter(F.slice(F.concat("after", "beyond"), 1, look), lambda x: x["global_id"] != F.col("global_id"))
    pairs = joined.select("item_id", F.explode(F.slice(others, 1, negatives)).alias("o"))
    found = pairs.select(F.least("item_id", "o.item_id").alias("left_id"), F.greatest("item_id", "o.item_id").alias("right_id"), F.lit("NEGATIVE").alias("label"))
    return reid_positives(manifest).unionByName(found)


def reid_positives(manifest: DataFrame) -> DataFrame:
    """(left_id, right_id, label): same parcel on different cameras anywhere in a session and split (JN12); grows with the sightings of a parcel."""
    side = lambda p: manifest.select("session_id", "split", "global_id", *(F.col(c).alias(f"{p}_{c}") for c in ("item_id", "camera_role")))
    pairs = side("l").join(side("r").hint("merge"), ["session_id", "split", "global_id"]).where("l_item_id < r_item_id AND l_camera_role <> r_camera_role")
    return pairs.select(F.col("l_item_id").alias("left_id"), F.col("r_item_id").alias("right_id"), F.lit("POSITIVE").alias("label"))


def referential_gaps(items: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions that items name and that do not exist (JN13)."""
    return items.join(sessions, "session_id", "left_anti").groupBy("session_id").agg(F.count("*").alias("n"))


def manifest_diff(manifest: DataFrame, items: DataFrame, fields: list[str]) -> DataFrame:
    """(item_id, problem): missing, unexpected, duplicated or differing rows (JN14)."""
    m = manifest.groupBy("item_id").agg(F.count("*").alias("n"), *(F.min(f).alias(f"m_{f}") for f in fields))
    i = items.select("item_id", F.lit(True).alias("there"), *(F.col(f).alias(f"i_{f}") for f in fields))
    joined = m.join(i, "item_id", "full_outer")
    differs = F.lit(False)
    for f in fields:
        differs = differs | ~F.col(f"m_{f}").eqNullSafe(F.col(f"i_{f}"))
    return joined.select("item_id", F.when(F.col("n").isNull(), "missing").when(F.col("there").isNull(), "unexpected").when(F.col("n") > 1, "duplicated").when(differs, "differs").alias("problem")).where("problem IS NOT NULL")


def id_set_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(id, side): ids on one side only, as often as they are there more (SO2)."""
    return expected.exceptAll(actual).withColumn("side", F.lit("expected_only")).unionByName(actual.exceptAll(expected).withColumn("side", F.lit("actual_only")))


def required_splits(sessions: DataFrame, items: DataFrame) -> DataFrame:
    """(split): all three as soon as one real session is used, else those that are there (SO3)."""
    used = items.select("session_id").distinct().join(sessions.where("is_real"), "session_id", "left_semi").limit(1)
    all_three = used.select(F.explode(F.array(*map(F.lit, SPLITS))).alias("split"))
    return all_three.unionByName(items.select("split").distinct()).distinct()


class _Kept(Fold):
    """Which splits the kept frames of each hash have."""

    def __init__(self) -> None:
        self.splits: dict[int, set[str]] = {}

    def frame(self, rows: list[tuple]) -> list[tuple]:
        near, crosses = 0, False
        for frames, split, own, n, others in rows:
            seen = set().union(*(self.splits.get(h, ()) for h in (own, *(others or ()))))
            near += n if seen else 0
            crosses |= bool(seen - {split})
        kept = not crosses and near < rows[0][0]
        for _, split, own, _, _ in rows if kept else ():
            self.splits.setdefault(own, set()).add(split)
        return [(kept,)]


def greedy_dedup(items: DataFrame) -> DataFrame:
    """(sample_group_id, kept): ST9. ``items`` has ``group_order``, ``session_order``, ``split`` and ``hash``.

    A group goes if a frame is near a kept frame of another split, or if all its frames are
    near frames kept before it. All is done on classes of equal hashes, so copies are never paired: a group whose
    hashes are its own and near to no other stays without further work; the others are folded in order within
    each connected set of groups and hashes, whose state is the splits of each hash. Of groups with the same hashes and splits, and no frame
    without a hash, only the first is looked at: the others go, since what it was near to, or its own frames, were kept before them.
    """
    order = ["session_order", "group_order", "sample_group_id"]
    same = F.when(F.count("hash") == F.count("*"), F.array_sort(F.collect_set(F.struct("hash", "split"))))
    every = written(items.groupBy("sample_group_id").agg(F.min(F.struct("session_order", "group_order")).alias("place"), F.count("*").alias("frames"), same.alias("same")), "dedup-groups")
    first = every.where("same IS NOT NULL").groupBy("same").agg(F.min_by(F.struct("sample_group_id", "place", "frames"), F.struct("place", "sample_group_id")).alias("g")).select("g.*")
    groups = written(first.unionByName(every.where("same IS NULL").drop("same")), "dedup-first")
    items = items.join(groups.select("sample_group_id").hint("merge"), "sample_group_id", "left_semi")
    held = written(items.where("hash IS NOT NULL").groupBy("sample_group_id", "split", "hash").agg(F.count("*").alias("n")), "dedup-classes")
    near = written(near_classes(held), "dedup-near")
    both = near.unionByName(near.select(F.col("hash2").alias("hash"), F.col("hash").alias("hash2")))
    neighbours = both.groupBy("hash").agg(F.collect_list("hash2").alias("near"))  # hashes within three bits of one
    shared = held.groupBy("hash").agg(F.countDistinct("sample_group_id").alias("k")).where("k > 1").select("hash").unionByName(neighbours.select("hash")).distinct()
    contested = written(held.join(shared.hint("merge"), "hash"), "dedup-contested")
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    links = contested.select(name("g", "sample_group_id").alias("a"), name("h", "hash").alias("b")).unionByName(near.select(name("h", "hash").alias("a"), name("h", "hash2").alias("b")))
    parts = connected_components(links, "a", "b")
    rows = contested.withColumn("id", name("g", "sample_group_id")).join(parts.hint("merge"), "id").join(neighbours.hint("merge"), "hash", "left").join(groups.hint("merge"), "sample_group_id")
    rows = rows.select("component", "place.session_order", "place.group_order", "sample_group_id", "frames", "split", "hash", "n", "near")
    judged = fold_frames(rows, ["component"], order, ["frames", "split", "hash", "n", "near"], _Kept, "kept boolean").select("sample_group_id", "kept")
    stay = groups.select("sample_group_id").join(judged.hint("merge"), "sample_group_id", "left").select("sample_group_id", F.coalesce("kept", F.lit(True)).alias("kept"))
    return every.select("sample_group_id").join(stay.hint("merge"), "sample_group_id", "left").select("sample_group_id", F.coalesce("kept", F.lit(False)).alias("kept"))


def finalize_dataset(items: DataFrame) -> DataFrame:
    """(pending, trainable, ready): DQ14's one row; ready if nothing pends, something is trainable and the splits are full."""
    n = items.agg(F.count_if(F.col("annotation_status") == "NEEDS_REVIEW").alias("pending"), F.count_if(F.col("annotation_status").isin(*TRAINABLE)).alias("trainable"), F.countDistinct("split").alias("splits"))
    return n.select("pending", "trainable", ((F.col("pending") == 0) & (F.col("trainable") > 0) & (F.col("splits") == 3)).alias("ready"))
