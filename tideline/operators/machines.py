"""Deterministic state machines as ordered folds, and the key-value machine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.functions import scan
from tideline.operators import indexset


def fold(commands: DataFrame, by: str, order: str, fields: list[str], zero: Column, apply: Callable[[Column, Column], Column]) -> DataFrame:
    """``by, state``: a left fold of each machine's commands in index order. The commands
    are sorted inside the fold, so partitioning cannot change the result."""
    rows = F.array_sort(F.collect_list(F.struct(order, *fields)))
    return commands.groupBy(by).agg(F.aggregate(rows, zero, apply).alias("state"))


def fold_from(commands: DataFrame, snapshots: DataFrame, by: str, order: str, fields: list[str], default: Column, apply) -> DataFrame:
    """Incremental recovery: ``snapshots`` (``by, snap, state``) and the commands after them."""
    tail = commands.join(snapshots, by, "left").filter(F.col("snap").isNull() | (F.col(order) > F.col("snap")))
    rows = F.array_sort(F.collect_list(F.struct(order, *fields)))
    grouped = tail.groupBy(by).agg(rows.alias("_r"))
    every = grouped.join(snapshots, by, "full")
    none = F.coalesce("_r", F.expr("filter(_r, x -> false)"))
    start = F.coalesce("state", default)
    return every.select(by, F.when(F.col("_r").isNull(), start).otherwise(F.aggregate(none, start, apply)).alias("state"))


def running(commands: DataFrame, value: str, by: list[str], order: str, initial: int = 0, block: int = scan.BLOCK) -> DataFrame:
    """The additive machine's reply to every command: its state after it."""
    out = scan.running_sum(commands, value, "reply", by, order, block)
    return out.withColumn("reply", F.col("reply") + initial)


def applied(commands: DataFrame, commits: DataFrame, by: str) -> DataFrame:
    """Commands that a machine with ``last_applied`` may apply up to ``commit_index``."""
    return commands.join(commits, by).filter((F.col("idx") > F.col("last_applied")) & (F.col("idx") <= F.col("commit_index")))


def notifications(replies: DataFrame) -> DataFrame:
    """Replies grouped per receiver in the order of issue: ``pid, n, correlations``."""
    rows = F.array_sort(F.collect_list(F.struct("idx", "correlation")))
    return replies.groupBy("pid").agg(F.count("*").alias("n"), F.array_join(F.transform(rows, lambda x: x["correlation"].cast("string")), ",").alias("correlations"))


def version_as_of(commands: DataFrame, versions: DataFrame, block: int = scan.BLOCK) -> DataFrame:
    """``commands`` with the machine version in force: the last version entry at or before
    the index, by one ordered scan over both (null before the first)."""
    marks = versions.select("uid", "idx", "version").withColumn("_mark", F.lit(0))
    rows = commands.withColumn("_mark", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    value = F.col("version") if "version" in rows.columns else F.lit(None)
    out = scan.last_value(rows, value, "_version", ["uid"], [F.col("idx"), F.col("_mark")], F.floor(F.col("idx") / block))
    return out.filter("_mark = 1").drop("_mark", "version").withColumnRenamed("_version", "version")


def supported(commands: DataFrame, highest: int) -> DataFrame:
    """Commands before the first one that needs a higher machine version."""
    stop = commands.filter(F.col("version") > highest).groupBy("uid").agg(F.min("idx").alias("_stop"))
    return commands.join(stop, "uid", "left").filter(F.col("_stop").isNull() | (F.col("idx") < F.col("_stop"))).drop("_stop")


def command_counts(log: DataFrame, types: list[str]) -> DataFrame:
    return log.groupBy("uid").agg(*(F.count_if(F.col("type") == t).alias(f"n_{t}") for t in types))


def effects(log: DataFrame) -> DataFrame:
    """The side effects of each command as rows: ``idx, ordinal, kind, target``. Purchases
    reply and append, errors are sent to a monitor, all else replies."""
    reply = F.struct(F.lit("reply").alias("kind"), F.col("key").cast("string").alias("target"))
    kinds = (
        F.when(F.col("type") == "purchase", F.array(reply, F.struct(F.lit("append").alias("kind"), F.lit("audit").alias("target"))))
        .when(F.col("type") == "error", F.array(F.struct(F.lit("send_msg").alias("kind"), F.lit("monitor").alias("target"))))
        .otherwise(F.array(reply))
    )
    return log.select("uid", "idx", F.posexplode(kinds).alias("ordinal", "x")).select("uid", "idx", "ordinal", "x.kind", "x.target")


def fired_timers(settings: DataFrame, now: Column) -> DataFrame:
    """``uid, name, set_at, fires_at``: timers that go off (``settings``: ``uid, name, idx, ms,
    after``; a null ``after`` cancels). Setting a timer again, or cancelling it, before it is due
    replaces it; one that is due at ``now`` (ms) or before has fired."""
    after = F.lead("ms").over(Window.partitionBy("uid", "name").orderBy("ms", "idx"))
    rows = settings.withColumn("_next", after).withColumn("fires_at", F.col("ms") + F.col("after"))
    due = (F.col("fires_at") <= now) & (F.col("_next").isNull() | (F.col("_next") > F.col("fires_at")))
    return rows.filter(due).select("uid", "name", F.col("idx").alias("set_at"), "fires_at")


def ticks(machines: DataFrame, every: int) -> DataFrame:
    """``uid, ms``: the tick commands of machines that run from ``started`` to ``stopped`` (ms), one
    ``every`` so many."""
    return machines.filter(F.col("started") + every <= F.col("stopped")).select(
        "uid", F.explode(F.sequence(F.col("started") + every, F.col("stopped"), F.lit(every).cast("long"))).alias("ms")
    )


def aux_overview(log: DataFrame, applied: DataFrame, snapshots: DataFrame) -> DataFrame:
    """What a machine may ask of its log: ``uid, last_index, last_term, current_term, last_applied,
    snapshot_index, snapshot_age, entries_above`` (``applied``: ``uid, last_applied``; ``snapshots``: ``uid,
    snap``)."""
    own = log.groupBy("uid").agg(F.max("idx").alias("last_index"), F.max_by("term", "idx").alias("last_term"), F.max("term").alias("current_term"))
    j = own.join(applied, "uid", "left").join(snapshots, "uid", "left")
    age = F.col("last_applied") - F.coalesce("snap", F.lit(0))
    return j.select("uid", "last_index", "last_term", "current_term", "last_applied", F.col("snap").alias("snapshot_index"), age.alias("snapshot_age"),
                    (F.col("last_index") - F.coalesce("snap", F.lit(0))).alias("entries_above"))


def effects_where(log: DataFrame, rules: dict[str, tuple[Column, Column]], leader: Column) -> DataFrame:
    """``uid, idx, kind, target``: effects of each command by ``rules`` (kind to condition and
    target). Only a leader performs them, but for ``log``, ``release_cursor`` and ``checkpoint``,
    which every member does."""
    own = ("log", "release_cursor", "checkpoint")
    each = [F.when(c if k in own else c & leader, F.struct(F.lit(k).alias("kind"), t.cast("string").alias("target"))) for k, (c, t) in rules.items()]
    made = F.filter(F.array(*each), lambda x: x.isNotNull())
    return log.select("uid", "idx", F.explode(made).alias("x")).select("uid", "idx", "x.kind", "x.target")


def pipelined(commands: DataFrame, applied: DataFrame) -> DataFrame:
    """``pid, batch, n, correlations``: applied replies to pipelined commands (``uid, idx, pid,
    correlation``), one message for each applied range (``uid, batch, lo, hi``) and sender, in
    log order; commands beyond every range have no reply yet."""
    a = applied.withColumn("owner", F.col("uid")).select("owner", "lo", "hi", "batch")
    found = indexset.locate(commands.withColumn("owner", F.col("uid")), a, ["batch"], 128)
    rows = F.array_sort(F.collect_list(F.struct("idx", "correlation")))
    joined = F.array_join(F.transform(rows, lambda x: x["correlation"].cast("string")), ",")
    return found.groupBy("pid", "batch").agg(F.count("*").alias("n"), joined.alias("correlations"))


# The key-value machine keeps pointers into the log; values stay there.


def kv_state(commands: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``key, idx``: the put in force of every key that has one."""
    keys = [*(by or []), "key"]
    last = commands.groupBy(*keys).agg(F.max_by("op", "idx").alias("_op"), F.max("idx").alias("idx"))
    return last.filter("_op = 'put'").drop("_op")


def kv_read(state: DataFrame, log: DataFrame) -> DataFrame:
    """Late materialisation: payloads are fetched only for the pointers that are left. An
    index names an entry only within its log: a state of several logs has their ``uid``."""
    on = ["uid", "idx"] if "uid" in state.columns else ["idx"]
    return state.join(log.drop("key"), on)


def kv_replies(commands: DataFrame) -> DataFrame:
    """Reply to each delete: ok, or not_found where the key was absent at that point."""
    before = F.lag("op").over(Window.partitionBy("key").orderBy("idx"))
    return commands.withColumn("_before", before).filter("op = 'delete'").select(
        "key", "idx", F.when(F.col("_before") == "put", "ok").otherwise("not_found").alias("reply")
    )


def replica_convergence(states: DataFrame) -> DataFrame:
    """``uid, members, converged``: whether all members hold the same live indexes.

    Sets are compared by count and a sum of hashes, which partial aggregation keeps small.
    """
    each = states.groupBy("uid", "member").agg(F.count("*").alias("_n"), F.sum(F.xxhash64("idx").cast("decimal(38,0)")).alias("_h"))
    return each.groupBy("uid").agg(F.count("*").alias("members"), (F.countDistinct("_n", "_h") == 1).alias("converged"))


def replica_diff(states: DataFrame, reference: DataFrame) -> DataFrame:
    """Pointers in which a member differs from the reference: ``member, key, idx, expected``."""
    members = states.select("member").distinct()
    want = reference.select("key", F.col("idx").alias("expected")).crossJoin(F.broadcast(members))
    return states.join(want, ["member", "key"], "full").filter(~F.col("idx").eqNullSafe(F.col("expected"))).select("member", "key", "idx", "expected")


def difference_patterns(states: DataFrame, reference: DataFrame) -> DataFrame:
    """``member, pattern, n``: how members differ from the reference, by kind."""
    diff = replica_diff(states, reference)
    kind = F.when(F.col("idx").isNull(), "missing").when(F.col("expected").isNull(), "extra").otherwise("stale")
    return diff.groupBy("member", kind.alias("pattern")).agg(F.count("*").alias("n"))


def workload(spark, n: int, keys: int = 10_000) -> DataFrame:
    """A reproducible operation mix: 68 % put, 20 % get, 4 % snapshot, 2 % major compaction and
    1 % of each of six others, spread by a multiplicative sequence."""
    rows = spark.range(n).withColumn("r", F.col("id") * 7919 % 100)
    op = F.when(F.col("r") < 68, "put").when(F.col("r") < 88, "get").when(F.col("r") < 92, "snapshot").when(F.col("r") < 94, "major_compaction")
    others = ["update_almost_all", "put_many", "add_member", "remove_member", "kill_wal", "kill_member"]
    for k, name in enumerate(others):
        op = op.when(F.col("r") == 94 + k, name)
    return rows.select("id", op.alias("op"), F.concat(F.lit("key_"), F.col("id") * 104_729 % keys + 1).alias("key"))


def shadow_points(commands: DataFrame, every: int = 4096) -> DataFrame:
    """Commands after which a count-only copy of the state is kept, with the count so far."""
    one = scan.running_sum(commands.withColumn("_one", F.lit(1)), "_one", "enqueued", ["uid"], "idx")
    return one.filter(F.col("enqueued") % every == 0).drop("_one")


def reply_mode_ok(mode: Column) -> Column:
    """Reply modes that a command envelope may carry."""
    return mode.isin("after_log_append", "await_consensus", "noreply") | mode.rlike("^notify:[0-9]+$")
