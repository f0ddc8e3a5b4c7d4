"""Segment statistics, catalogs, pruning, retention and compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.functions.ordered import ordered_pass
from tideline.operators import indexset


def info(records: DataFrame, live: DataFrame) -> DataFrame:
    """Per segment: physical records, range, bytes, and what of it is live.

    ``records``: ``uid, segment, idx, bytes``; overwritten records count as records.
    """
    l = live.select("uid", "idx").withColumn("_live", F.lit(True))
    rows = records.join(l, ["uid", "idx"], "left")
    return rows.groupBy("uid", "segment").agg(
        F.count("*").alias("n"),
        F.min("idx").alias("lo"),
        F.max("idx").alias("hi"),
        F.sum("bytes").alias("bytes"),
        F.count_if(F.col("_live").isNotNull()).alias("n_live"),
        F.coalesce(F.sum(F.when(F.col("_live"), F.col("bytes"))), F.lit(0)).alias("live_bytes"),
    )


def overlay(refs: DataFrame) -> DataFrame:
    """Segment references (``uid, seq, segment, lo, hi``, later ``seq`` newer) with the
    range that newer ones leave; ``overwritten`` marks those with nothing left."""
    newer = Window.partitionBy("uid").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    cut = F.least(F.col("hi"), F.min("lo").over(newer) - 1)
    return refs.withColumn("hi", cut).withColumn("overwritten", F.col("hi") < F.col("lo"))


def slices(segments: DataFrame, lo: int, hi: int) -> DataFrame:
    """The part of an index range that each segment serves, empty parts left out."""
    return indexset.clip(segments, lo, hi)


def compactable(segments: DataFrame, snap: DataFrame) -> DataFrame:
    """Segments that end at or below the snapshot, never the newest one of a log."""
    newest = segments.groupBy("uid").agg(F.max("hi").alias("_newest"))
    joined = segments.join(newest, "uid").join(snap, "uid")
    return joined.filter((F.col("hi") <= F.col("snap")) & (F.col("hi") < F.col("_newest"))).drop("_newest", "snap")


def unreferenced(segments: DataFrame, live: DataFrame, width: int = 1024) -> DataFrame:
    """Minor compaction: segments that hold no live index."""
    s = segments.withColumn("owner", F.col("uid"))
    held = indexset.locate(live.withColumnRenamed("uid", "owner"), s, ["uid", "segment"], width)
    return segments.join(held.select("uid", "segment").distinct(), ["uid", "segment"], "left_anti")


def groups(infos: DataFrame, max_count: int, max_bytes: int) -> DataFrame:
    """Major compaction's greedy grouping, oldest segment first: ``uid, segment, grp``.

    A segment joins when under half of its entries or bytes are live and the group's
    budgets hold; those without a live entry are deleted, not grouped. One that is over budget heads the next group, or is passed over if it
    is over an empty group's; a dense one ends an open group. The choice depends on the
    order, so it is one ordered pass over a log's segments.
    """

    def step(state, n, size, n_live, live_bytes):
        group, count_left, bytes_left, used = state
        sparse = n_live / n < 0.5 or live_bytes / size < 0.5
        if sparse and n_live <= count_left and live_bytes <= bytes_left:
            return (group, count_left - n_live, bytes_left - live_bytes, True), (group,)
        if sparse and used and n_live <= max_count and live_bytes <= max_bytes:
            return (group + 1, max_count - n_live, max_bytes - live_bytes, True), (group + 1,)
        return (group + used, max_count, max_bytes, False), (None,)

    rows = infos.filter("n_live > 0").select("uid", "segment", "lo", "n", "bytes", "n_live", "live_bytes")
    start = lambda: (1, max_count, max_bytes, False)
    out = ordered_pass(rows, ["uid"], ["lo", "segment"], ["n", "bytes", "n_live", "live_bytes"], {"grp": "long"}, start, step)
    return out.filter("grp is not null").select("uid", "segment", "grp")


def copied(entries: DataFrame, live: DataFrame, grouped: DataFrame) -> DataFrame:
    """Live entries of each group in its new segment, named after the group's first one."""
    target = grouped.withColumn("target", F.min("segment").over(Window.partitionBy("uid", "grp")))
    kept = entries.join(live.select("uid", "idx"), ["uid", "idx"], "left_semi")
    return kept.join(target.select("uid", "segment", "target"), ["uid", "segment"])


def major_plan(infos: DataFrame, grouped: DataFrame) -> DataFrame:
    """``uid, segment, action, target`` of a major compaction: segments without a live entry are
    a ``delete``; the first of a group is a ``copy`` that takes the live entries of all, the
    others are a ``link`` to it; the rest is a ``keep``."""
    target = grouped.withColumn("target", F.min("segment").over(Window.partitionBy("uid", "grp"))).select("uid", "segment", "target")
    action = (
        F.when(F.col("n_live") == 0, "delete").when(F.col("target") == F.col("segment"), "copy")
        .when(F.col("target").isNotNull(), "link").otherwise("keep")
    )
    rows = infos.select("uid", "segment", "n_live").join(target, ["uid", "segment"], "left").withColumn("action", action)
    return rows.select("uid", "segment", "action", F.when(F.col("action") != "delete", F.coalesce("target", "segment")).alias("target"))


def compacted(infos: DataFrame, plan: DataFrame, live_entries: DataFrame) -> DataFrame:
    """The catalog after a major compaction: ``uid, segment, lo, hi, n, bytes`` of the segments
    that are left. Kept ones are as they were; a copy has what is live in its group
    (``live_entries``: ``uid, segment, idx, bytes`` of the segments before)."""
    kept = infos.join(plan.filter("action = 'keep'").select("uid", "segment"), ["uid", "segment"], "left_semi").select("uid", "segment", "lo", "hi", "n", "bytes")
    moved = live_entries.join(plan.filter("action in ('copy', 'link')").select("uid", "segment", "target"), ["uid", "segment"])
    made = moved.groupBy("uid", F.col("target").alias("segment")).agg(
        F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.count("*").alias("n"), F.sum("bytes").alias("bytes")
    )
    return kept.unionByName(made)


def purgeable_links(files: DataFrame, older_than: int) -> DataFrame:
    """``uid, name, reason`` of links to remove (``files``: ``uid, name, target, age``; a target
    makes it a link): ``dangling`` where no file has the target's name, else ``old``."""
    links = files.filter("target is not null")
    real = files.filter("target is null").select("uid", F.col("name").alias("target"), F.lit(True).alias("_there"))
    j = links.join(real, ["uid", "target"], "left")
    reason = F.when(F.col("_there").isNull(), "dangling").when(F.col("age") > older_than, "old")
    return j.select("uid", "name", reason.alias("reason")).filter("reason is not null")


def catalog_overview(segments: DataFrame) -> DataFrame:
    """``uid, segments, lo, hi, entries, bytes`` of each log's segment files."""
    return segments.groupBy("uid").agg(
        F.count("*").alias("segments"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("entries"), F.sum("bytes").alias("bytes")
    )


def schedule(requests: DataFrame, minors: int) -> DataFrame:
    """``uid, n, kind``: minor requests become major after ``minors`` minors; a request
    without live indexes is a minor one and counts, whatever was asked."""

    def step(minor, asked, live):
        kind = "major" if (asked == "major" or minor >= minors) and live else "minor"
        return 0 if kind == "major" else minor + 1, (kind,)

    rows = requests.select("uid", "n", "asked", "live")
    return ordered_pass(rows, ["uid"], ["n"], ["asked", "live"], {"kind": "string"}, lambda: 0, step).select("uid", "n", "kind")


def recovery(files: DataFrame) -> DataFrame:
    """What an interrupted compaction needs: ``grp, action`` from its member files
    (``grp, name, is_compacting``)."""
    seen = files.groupBy("grp").agg(F.count("*").alias("_n"), F.bool_or("is_compacting").alias("_tmp"))
    action = F.when(F.col("_n") == 1, "discard").when(F.col("_tmp"), "discard").otherwise("finish_links")
    return seen.select("grp", action.alias("action"))
