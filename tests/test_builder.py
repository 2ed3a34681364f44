"""The dataset builder and greedy thinning against plain loops; versions that are whole or not there."""

import pytest
from pyspark.sql import functions as F

from loomtrack.operators import builder, datasets
from loomtrack.plans import builder as plans
from loomtrack.plans.datasets import _items


def plain_greedy(rows):
    """Groups in order; frames compared with all kept frames, one by one."""
    groups = {}
    for r in rows:
        groups.setdefault((r["session_order"], r["group_order"], r["sample_group_id"]), []).append(r)
    kept, out = [], {}
    for key in sorted(groups):
        frames = groups[key]
        near = [[s for h, s in kept if f["hash"] is not None and bin((f["hash"] ^ h) & (2**64 - 1)).count("1") <= 3] for f in frames]
        crosses = any(s != f["split"] for f, found in zip(frames, near) for s in found)
        out[key[2]] = not crosses and not all(near)
        if out[key[2]]:
            kept += [(f["hash"], f["split"]) for f in frames if f["hash"] is not None]
    return out


def test_thinning_of_all_items(spark, sf):
    items = _items(spark, sf).withColumns({"session_order": F.col("session_id"), "group_order": F.expr("cast(split(sample_group_id, ':')[1] AS bigint)")})
    items = items.withColumn("hash", F.col("hash").bitwiseAND(0xFF)).withColumn("sample_group_id", F.when(F.col("item_id") >= 1_000_000_000_000, F.concat("sample_group_id", F.lit("c"))).otherwise(F.col("sample_group_id")))
    rows = [r.asDict() for r in items.select("session_order", "group_order", "sample_group_id", "split", "hash").collect()]
    found = {r.sample_group_id: r.kept for r in datasets.greedy_dedup(items).collect()}
    assert found == plain_greedy(rows) and 0 < sum(found.values()) < len(found)


def test_copies_are_never_paired(spark):
    """A hundred thousand copies of one image in as many groups: the first stays, and the work is linear."""
    items = spark.range(100_000).selectExpr("id AS item_id", "cast(id AS string) AS sample_group_id", "'s' AS session_order", "id AS group_order", "CASE WHEN id = 0 THEN 'train' ELSE 'test' END AS split", "7L AS hash")
    assert datasets.greedy_dedup(items).where("kept").count() == 1
    (leak,) = datasets.split_leak_classes(items).collect()
    assert (leak.hash, leak.hash2, leak.splits, leak.n) == (7, 7, ["test", "train"], 100_000)


def test_items_of_the_whole_job(spark, sf):
    obs, tracks, hashes, explicit = plans._inputs(spark, sf)
    items, groups = builder.dataset_items(obs, tracks, hashes, explicit)
    rows = items.collect()
    assert len({r.item_id for r in rows}) == len(rows) > 50
    assert {r.split for r in rows if r.session_id == "S3"} <= {"test"} and all(r.hash is not None for r in rows)
    by_session = {}
    for r in rows:
        by_session.setdefault(r.session_id, set()).add(r.split)
    assert all(len(s) == 1 for s in by_session.values())
    kept = {r.sample_group_id for r in groups.where("kept").collect()}
    assert {r.sample_group_id for r in rows} == kept and datasets.split_leak_classes(items).count() == 0
    seen = {(r.session_id, r.source_id, r.stream_epoch, r.frame_index): r.n for r in obs.groupBy("session_id", "source_id", "stream_epoch", "frame_index").agg(F.count("*").alias("n")).collect()}
    assert all(seen[r.session_id, r.source_id, r.stream_epoch, r.frame_index] == r.n_observations == len(r.tracklet_ids.split(",")) for r in rows)


def test_a_lost_driver_leaves_the_old_version(spark, sf, tmp_path, monkeypatch):
    obs, tracks, hashes, explicit = plans._inputs(spark, sf)
    few, root = obs.where("session_id IN ('S1', 'S3')"), f"{tmp_path}/set"
    with pytest.raises(FileNotFoundError):
        builder.read_dataset(spark, root)
    assert builder.build_dataset(few, tracks, hashes, root, explicit=explicit) == 1
    first = builder.read_dataset(spark, root).count()
    manifest = builder.published(spark, root).first()
    assert manifest["items"] == first > 0 and manifest.splits and manifest.skipped_groups >= 0

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(builder, "publish", die)
        with pytest.raises(KeyboardInterrupt):
            builder.build_dataset(few.where("session_id = 'S1'"), tracks, hashes, root)
    assert builder.read_dataset(spark, root).count() == first and builder.published(spark, root).count() == 1
    assert builder.build_dataset(few.where("session_id = 'S1'"), tracks, hashes, root) == 2  # over what was left behind
    assert {r.session_id for r in builder.read_dataset(spark, root).select("session_id").distinct().collect()} == {"S1"} and builder.read_dataset(spark, root, 1).count() == first
    with monkeypatch.context() as m:
        m.setattr(builder, "greedy_dedup", lambda rows: rows.select("sample_group_id").distinct().withColumn("kept", F.lit(True)))
        same = hashes.withColumn("hash", F.lit(5).cast("long"))
        with pytest.raises(builder.SplitLeak):
            builder.build_dataset(few, tracks, same, root, explicit=explicit)
    assert builder.published(spark, root).count() == 2
    with pytest.raises(ValueError):
        builder.build_dataset(few, tracks, hashes, root, task="singing")
