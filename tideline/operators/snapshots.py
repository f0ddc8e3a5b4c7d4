"""Checkpoint selection, thinning and snapshot scheduling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.functions import scan
from tideline.functions.ordered import ordered_pass

MAX_DIFF = 65_536  # the gap that thinning lets grow to, times a factor


def promotable(requests: DataFrame, checkpoints: DataFrame, block: int = scan.BLOCK) -> DataFrame:
    """``uid, idx, checkpoint``: the greatest checkpoint at or below each requested index."""
    c = checkpoints.select("uid", "idx", F.col("idx").alias("_ck"), F.lit(0).alias("_kind"))
    r = requests.select("uid", "idx", F.lit(None).cast("long").alias("_ck"), F.lit(1).alias("_kind"))
    out = scan.last_value(c.unionByName(r), F.col("_ck"), "checkpoint", ["uid"], [F.col("idx"), F.col("_kind")], F.floor(F.col("idx") / block))
    return out.filter("_kind = 1 and checkpoint is not null").select("uid", "idx", "checkpoint")


def split(checkpoints: DataFrame, snap: DataFrame) -> DataFrame:
    """``outdated`` marks checkpoints that the snapshot has overtaken."""
    return checkpoints.join(snap, "uid").withColumn("outdated", F.col("idx") <= F.col("snap")).drop("snap")


def thin(checkpoints: DataFrame, most: int, max_diff: int = MAX_DIFF) -> DataFrame:
    """The one checkpoint per log to delete next, if there are more than ``most``: from the
    oldest on, the middle of the first three that span less than the allowed gap."""
    n = F.count("*").over(Window.partitionBy("uid"))
    order = Window.partitionBy("uid").orderBy("idx")
    rows = checkpoints.withColumns({"_n": n, "_mid": F.lead("idx", 1).over(order), "_third": F.lead("idx", 2).over(order)})
    factor = F.least(F.lit(8), F.floor(F.col("_n") / most))
    hit = rows.filter((F.col("_n") > most) & (F.col("_third") - F.col("idx") < max_diff * factor))
    return hit.groupBy("uid").agg(F.min_by("_mid", "idx").alias("delete_idx"))


def schedule(requests: DataFrame, interval: int) -> DataFrame:
    """Requests that are granted: those more than ``interval`` above the last granted one."""

    def step(last, idx):
        go = idx > last + interval
        return idx if go else last, (go,)

    return ordered_pass(requests.select("uid", "idx"), ["uid"], ["idx"], ["idx"], {"_go": "boolean"}, lambda: 0, step).filter("_go").select("uid", "idx")


def lifecycle(events: DataFrame) -> DataFrame:
    """``uid, current, pending`` from begin, complete and abort events (``uid, seq, event, idx``):
    the newest completed snapshot (one below it that completes later is dropped), and the
    last begun one where neither an end nor a newer completed snapshot has come."""
    ends = events.filter("event <> 'begin'").groupBy("uid", "idx").agg(F.max("seq").alias("_ended"))
    done = events.filter("event = 'complete'").groupBy("uid").agg(F.max("idx").alias("current"))
    begun = events.filter("event = 'begin'").groupBy("uid", "idx").agg(F.max("seq").alias("_begun"))
    open_ = begun.join(ends, ["uid", "idx"], "left").filter(F.col("_ended").isNull() | (F.col("_ended") < F.col("_begun")))
    open_ = open_.join(done, "uid", "left").filter(F.col("current").isNull() | (F.col("idx") > F.col("current")))
    last = open_.groupBy("uid").agg(F.max_by("idx", "_begun").alias("pending"))
    return events.select("uid").distinct().join(done, "uid", "left").join(last, "uid", "left").select("uid", "current", "pending")


def stale_checkpoints(checkpoints: DataFrame, snap: DataFrame) -> DataFrame:
    """Checkpoints to delete on start: those at or below their log's snapshot (``uid, snap``)."""
    return checkpoints.join(snap, "uid").filter(F.col("idx") <= F.col("snap")).drop("snap")


def recovery_checkpoint(applied: DataFrame, checkpoints: DataFrame, interval: int) -> DataFrame:
    """``uid, idx``: logs for which a checkpoint is written on shutdown, at ``last_applied``
    (``applied``: ``uid, last_applied``), as that is ``interval`` or more above their newest one."""
    newest = checkpoints.groupBy("uid").agg(F.max("idx").alias("_newest"))
    j = applied.join(newest, "uid", "left")
    return j.filter(F.col("last_applied") - F.coalesce("_newest", F.lit(0)) >= interval).select("uid", F.col("last_applied").alias("idx"))


def newest_valid(snapshots: DataFrame) -> DataFrame:
    """Recovery: the newest snapshot whose checksum holds."""
    return snapshots.filter("valid").groupBy("uid").agg(F.max("idx").alias("idx"), F.max_by("term", "idx").alias("term"))


def smallest_live(snap: DataFrame, live: DataFrame) -> DataFrame:
    """First index a log still needs: the first live one, or the one after the snapshot."""
    low = live.groupBy("uid").agg(F.min("idx").alias("_low"))
    return snap.join(low, "uid", "left").select("uid", "snap", F.coalesce("_low", F.col("snap") + 1).alias("smallest"))


def release_ready(cursors: DataFrame, progress: DataFrame) -> DataFrame:
    """The newest release cursor of each log whose conditions hold: written up to its
    index, and no snapshot being sent if it asks for that."""
    j = cursors.join(progress, "uid")
    ok = (F.col("written_cond").isNull() | (F.col("written_cond") <= F.col("last_written"))) & (~F.col("no_sends") | (F.col("sending") == 0))
    newest = j.groupBy("uid").agg(F.max_by(F.struct("idx", ok.alias("ok")), "idx").alias("_c"))
    return newest.select("uid", "_c.idx", F.col("_c.ok").alias("ready"))


def query_ready(queries: DataFrame, log: DataFrame, applied: DataFrame) -> DataFrame:
    """Conditional queries that may run: their index is applied and its term matches; one
    whose term differs stays pending for good."""
    t = log.select("uid", "idx", F.col("term").alias("_term"))
    j = queries.join(t, ["uid", "idx"], "left").join(applied, "uid")
    ready = F.coalesce((F.col("idx") <= F.col("last_applied")) & (F.col("term") == F.col("_term")), F.lit(False))
    return j.select("uid", "idx", "term", ready.alias("ready"))


def chunks_to_send(live: DataFrame, last_applied: int, size: int = 16) -> DataFrame:
    """Live indexes that a follower lacks, in chunks."""
    rows = live.filter(F.col("idx") > last_applied).withColumn("_one", F.lit(1))
    nth = scan.running_sum(rows, "_one", "_n", ["uid"], "idx")
    return nth.withColumn("chunk", F.floor((F.col("_n") - 1) / size)).drop("_one", "_n")
