"""What moves a log along: written events, resends, follower appends and leader back-off.

All work on tables of many logs at once; a log's rows are found by ``uid`` and ``idx``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.functions import scan


def written_in_batch(writes: DataFrame, floors: DataFrame, block: int = scan.BLOCK) -> DataFrame:
    """``uid, batch, term, lo, hi, n``: what a commit batch tells each writer it has written.

    Of a batch (``uid, batch, write_seq, idx, term``) only rows count that no later row of the
    batch overwrites and that are at or above the smallest live index of the writer."""
    own = writes.select("uid", "batch", "write_seq", "idx", "term")
    seen = scan.later_min(own, "idx", "_later", ["uid", "batch"], "write_seq", block)
    left = seen.filter(F.col("_later").isNull() | (F.col("_later") > F.col("idx"))).join(floors.select("uid", "smallest"), "uid", "left")
    left = left.filter(F.col("smallest").isNull() | (F.col("idx") >= F.col("smallest")))
    return left.groupBy("uid", "batch", "term").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.count("*").alias("n"))


def written(events: DataFrame, log: DataFrame, pending: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``uid, status, last_written, pending, resend_from`` after one written event per log.

    ``events``: ``uid, term, lo, hi``; ``pending``: ``uid, idx`` not yet known as written;
    ``snapshots``: ``uid, snap``. The event holds up to the last of its indexes at which the log
    has its term (``written``); pending indexes up to there are settled. If one below the
    event's first is pending the event has a gap before it: nothing is settled and all pending
    ones are resent (``resend``). If the log has none of the last index because a snapshot
    has overtaken it, pending ones up to there are settled (``below_snapshot``); an event of which
    the log holds nothing in that term changes nothing (``no_match``).
    """
    e = events.select("uid", F.col("term").alias("_term"), "lo", "hi")
    rows = log.select("uid", "idx", "term").join(e, "uid").filter("idx between lo and hi")
    rows = rows.groupBy("uid").agg(
        F.max(F.when(F.col("term") == F.col("_term"), F.col("idx"))).alias("_good"), F.max("idx").alias("_top")
    )
    p = pending.join(e.select("uid", "lo"), "uid").groupBy("uid").agg(F.min("idx").alias("_first"))
    all_of = e.join(rows, "uid", "left").join(p, "uid", "left").join(snapshots.select("uid", "snap"), "uid", "left")
    gone = (F.coalesce("_top", F.lit(-1)) < F.col("hi")) & F.coalesce(F.col("hi") <= F.col("snap"), F.lit(False))
    status = (
        F.when(gone, "below_snapshot").when(F.col("_good").isNull(), "no_match")
        .when(F.coalesce(F.col("_first") < F.col("lo"), F.lit(False)), "resend").otherwise("written")
    )
    told = all_of.withColumn("status", status).withColumn(
        "_upto", F.when(F.col("status") == "written", F.col("_good")).when(F.col("status") == "below_snapshot", F.col("hi"))
    )
    left = pending.join(told.select("uid", "_upto"), "uid").filter(F.col("_upto").isNull() | (F.col("idx") > F.col("_upto")))
    left = left.groupBy("uid").agg(F.count("*").alias("_n"))
    return told.join(left, "uid", "left").select(
        "uid", "status", F.when(F.col("status") == "written", F.col("_good")).alias("last_written"),
        F.coalesce("_n", F.lit(0).cast("long")).alias("pending"), F.when(F.col("status") == "resend", F.col("_first")).alias("resend_from"),
    )


def resends(pending: DataFrame, log: DataFrame, starts: DataFrame) -> DataFrame:
    """``uid, idx, prev, term``: entries to write once more, each naming the one before it:
    the pending ones from ``starts`` (``uid, resend_from, prev_idx``) on, looked up in the log."""
    rows = pending.join(starts, "uid").filter(F.col("idx") >= F.col("resend_from"))
    before = F.lag("idx").over(Window.partitionBy("uid").orderBy("idx"))
    rows = rows.withColumn("prev", F.coalesce(before, F.col("prev_idx"))).select("uid", "idx", "prev")
    return rows.join(log.select("uid", "idx", "term"), ["uid", "idx"])


def follower_append(log: DataFrame, rpcs: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A leader's append request to each log: its reply, and the log afterwards.

    ``rpcs``: ``uid, term, current_term, prev_idx, prev_term``; ``entries``: ``uid, idx, term``
    that follow ``prev_idx`` without holes. Replies ``uid, status, last_idx``: ``stale_term`` below
    the current term; ``missing`` or ``term_mismatch`` where the log lacks the entry before
    (index 0 is in every log); ``appended`` up to ``last_idx`` where entries are new;
    ``reset`` where none were sent, which cuts the log behind ``prev_idx``; ``validated`` where the
    log ends with what was sent, and ``partly`` where it goes on behind it.
    The log is ``uid, idx, term``; entries it has already stay, from the first that differs on
    they are written and what was behind goes.
    """
    r = rpcs.select("uid", F.col("term").alias("_term"), "current_term", "prev_idx", "prev_term")
    at = log.select("uid", F.col("idx").alias("prev_idx"), F.col("term").alias("_has"))
    ends = log.groupBy("uid").agg(F.max("idx").alias("_end"))
    r = r.join(at, ["uid", "prev_idx"], "left").join(ends, "uid", "left")
    known = entries.select("uid", "idx", "term").join(log.select("uid", "idx", F.col("term").alias("_own")), ["uid", "idx"], "left")
    sent = known.groupBy("uid").agg(F.min(F.when(~F.col("_own").eqNullSafe(F.col("term")), F.col("idx"))).alias("_new"), F.max("idx").alias("_last"))
    r = r.join(sent, "uid", "left")
    status = (
        F.when(F.col("_term") < F.col("current_term"), "stale_term")
        .when((F.col("prev_idx") > 0) & F.col("_has").isNull(), "missing")
        .when((F.col("prev_idx") > 0) & (F.col("_has") != F.col("prev_term")), "term_mismatch")
        .when(F.col("_new").isNotNull(), "appended")
        .when(F.col("_last").isNull() & (F.col("_end") > F.col("prev_idx")), "reset")
        .when(F.coalesce("_end", F.lit(0)) <= F.coalesce("_last", "prev_idx"), "validated")
        .otherwise("partly")
    )
    r = r.withColumn("status", status)
    accepted = F.col("status").isin("appended", "reset", "validated", "partly")
    replies = r.select("uid", "status", F.when(accepted, F.coalesce("_last", "prev_idx")).alias("last_idx"))
    cut = r.select("uid", F.when(F.col("status") == "appended", F.col("_new")).when(F.col("status") == "reset", F.col("prev_idx") + 1).alias("_cut"))
    kept = log.select("uid", "idx", "term").join(cut, "uid", "left").filter(F.col("_cut").isNull() | (F.col("idx") < F.col("_cut"))).drop("_cut")
    new = entries.select("uid", "idx", "term").join(r.filter("status = 'appended'").select("uid", "_new"), "uid").filter(F.col("idx") >= F.col("_new")).drop("_new")
    return replies, kept.unionByName(new)


def back_off(peers: DataFrame, replies: DataFrame, log: DataFrame) -> DataFrame:
    """``member, match_index, next_index`` after failed replies (``member, last_idx, last_term,
    next``), one per peer; peers without a reply and replies of unknown peers change nothing.

    If the leader's log (``idx, term``) lacks the peer's last entry it goes on where the peer
    says. If both have it in the same term and it is not below the match index, that becomes the
    match index. A peer that has fallen below its match index starts over from its last entry.
    Else its entries must be overwritten: one further back, not below the match index."""
    r = replies.select("member", "last_idx", "last_term", F.col("next").alias("_next"))
    j = peers.join(r, "member", "left").join(log.select(F.col("idx").alias("last_idx"), F.col("term").alias("_own")), "last_idx", "left")
    same = (F.col("_own") == F.col("last_term")) & (F.col("last_idx") >= F.col("match_index"))
    below = F.col("last_idx") < F.col("match_index")
    back = F.greatest(F.least(F.col("next_index") - 1, F.col("last_idx")), F.col("match_index") + 1)
    none, lacks = F.col("_next").isNull(), F.col("_own").isNull()
    match = F.when(none | lacks, F.col("match_index")).when(same | below, F.col("last_idx")).otherwise(F.col("match_index"))
    following = F.when(none, F.col("next_index")).when(lacks | same, F.col("_next")).when(below, F.col("last_idx") + 1).otherwise(back)
    return j.select("member", match.alias("match_index"), following.alias("next_index"))


def tick(logs: DataFrame, memtable: DataFrame, now: int, timeout: int) -> DataFrame:
    """``uid, resend_from``: logs that write their cached entries again on a tick.

    ``logs``: ``uid, last_written, last_write_at, writer, current_writer``; ``memtable``: ``uid, idx``. It
    takes that the last write was more than ``timeout`` ago, that there is a writer process and
    another one than then, and that the entry after the last written one is cached."""
    late = (F.lit(now) > F.col("last_write_at") + timeout) & F.col("current_writer").isNotNull() & (F.col("current_writer") != F.col("writer"))
    due = logs.filter(late).select("uid", (F.col("last_written") + 1).alias("resend_from"))
    return due.join(memtable.select("uid", F.col("idx").alias("resend_from")), ["uid", "resend_from"], "left_semi")


def snapshot_written(log: DataFrame, live: DataFrame, pending: DataFrame, checkpoints: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``uid, first, entries, pending, checkpoints`` after each log's snapshot (``uid, snap``): entries
    above it or live, pending indexes above it, and checkpoints above it are left; ``first`` is
    the smallest index left, or the one after the snapshot."""

    def left(df: DataFrame, name: str) -> DataFrame:
        above = df.select("uid", "idx").join(snapshots, "uid").filter(F.col("idx") > F.col("snap"))
        return above.groupBy("uid").agg(F.count("*").alias(name), F.min("idx").alias(f"_{name}"))

    held = log.select("uid", "idx").join(snapshots, "uid").join(live.select("uid", "idx", F.lit(True).alias("_live")), ["uid", "idx"], "left")
    held = held.filter((F.col("idx") > F.col("snap")) | F.col("_live")).groupBy("uid").agg(F.count("*").alias("entries"), F.min("idx").alias("_first"))
    out = snapshots.join(held, "uid", "left").join(left(pending, "pending"), "uid", "left").join(left(checkpoints, "checkpoints"), "uid", "left")
    zero = F.lit(0).cast("long")
    return out.select("uid", F.coalesce("_first", F.col("snap") + 1).alias("first"), *(F.coalesce(c, zero).alias(c) for c in ("entries", "pending", "checkpoints")))


def routed(commands: DataFrame, leaders: DataFrame) -> DataFrame:
    """``uid, idx, outcome, member`` of commands sent to a member (``to``): taken by the leader
    (``appended``), sent on to it (``redirect``), or, where a cluster has none, ``noleader``.
    ``leaders``: ``cluster, leader``."""
    j = commands.join(leaders.select("cluster", "leader"), "cluster", "left")
    outcome = F.when(F.col("leader").isNull(), "noleader").when(F.col("leader") == F.col("to"), "appended").otherwise("redirect")
    return j.select("uid", "idx", outcome.alias("outcome"), F.col("leader").alias("member"))
