"""Relational operators over a log: rows with ``uid, idx, term`` and a payload."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from tideline.functions import scan
from tideline.functions.ordered import ordered_pass
from tideline.operators import indexset


def visible(writes: DataFrame, block: int = scan.BLOCK) -> DataFrame:
    """The effective log. A write at an index hides every older entry at or above it, so an
    entry is visible if no later write has an index at or below its own."""
    seen = scan.later_min(writes, "idx", "_later", ["uid"], "write_seq", block)
    return seen.filter(F.col("_later").isNull() | (F.col("_later") > F.col("idx"))).drop("_later")


def latest_by_index(writes: DataFrame) -> DataFrame:
    """The newest row of each index (a plain upsert, unlike :func:`visible`)."""
    cols = [c for c in writes.columns if c not in ("uid", "idx")]
    newest = writes.groupBy("uid", "idx").agg(F.max_by(F.struct(*cols), "write_seq").alias("_r"))
    return newest.select("uid", "idx", "_r.*")


def term_runs(log: DataFrame) -> DataFrame:
    """First and last index of each term."""
    return log.groupBy("uid", "term").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.count("*").alias("n"))


def fold_range(log: DataFrame, lo: int, hi: int, value: Column, zero: Column, merge, by: str = "uid") -> DataFrame:
    """Ordered left fold of an index range, one result per ``by``; independent of partitioning."""
    rows = log.filter(F.col("idx").between(lo, hi)).groupBy(by)
    entries = F.array_sort(F.collect_list(F.struct("idx", value.alias("v"))))
    return rows.agg(F.aggregate(entries, zero, lambda a, x: merge(a, x["v"])).alias("value"))


def fold_blocks(log: DataFrame, value: Column, unit: Column, step, start: Column, through, by: str = "uid", block: int = scan.BLOCK) -> DataFrame:
    """Ordered left fold of a whole log whose steps compose, one result per ``by``.

    Each block of ``block`` indexes is folded from ``unit`` by ``step`` into a map; the state
    goes from ``start`` through the maps in order. No task holds more entries than a block.
    """
    nth = F.floor((F.col("idx") - 1) / block).alias("_block")
    entries = F.array_sort(F.collect_list(F.struct("idx", value.alias("v"))))
    maps = log.groupBy(by, nth).agg(F.aggregate(entries, unit, lambda a, x: step(a, x["v"])).alias("_map"))
    in_order = F.array_sort(F.collect_list(F.struct("_block", "_map")))
    return maps.groupBy(by).agg(F.aggregate(in_order, start, lambda s, x: through(s, x["_map"])).alias("value"))


def contiguous_prefix(log: DataFrame, lo: int, hi: int) -> DataFrame:
    """Rows of a range up to its first hole: the part a scan that returns early has seen."""
    rows = log.filter(F.col("idx").between(lo, hi))
    nth = rows.withColumn("_one", F.lit(1))
    return scan.running_sum(nth, "_one", "_n", ["uid"], "idx").filter(F.col("_n") == F.col("idx") - lo + 1).drop("_one", "_n")


def sparse_read(log: DataFrame, wanted: DataFrame, missing: str = "omit") -> DataFrame:
    """Entries at ``wanted`` (``pos, idx``) with the caller's order in ``pos``; with a ``uid`` too
    where there are several logs.

    ``missing``: ``omit`` leaves absent indexes out, ``error`` fails, ``stop`` keeps the
    positions before the first absent one.
    """
    on = ["uid", "idx"] if "uid" in wanted.columns else ["idx"]
    if missing == "omit":
        return wanted.join(log, on)
    all_of = wanted.join(log.withColumn("_hit", F.lit(True)), on, "left")
    if missing == "error":
        absent = F.when(F.col("_hit").isNull(), F.raise_error(F.concat(F.lit("missing index "), F.col("idx").cast("string"))))
        return all_of.withColumn("_hit", F.coalesce("_hit", absent.cast("boolean"))).filter("_hit").drop("_hit")
    first = all_of.filter("_hit is null").groupBy(*on[:-1]).agg(F.min("pos").alias("_stop"))
    stops = all_of.crossJoin(F.broadcast(first)) if len(on) == 1 else all_of.join(first, "uid", "left")  # one row without uid
    return stops.filter(F.col("_stop").isNull() | (F.col("pos") < F.col("_stop"))).drop("_hit", "_stop")


def read_plan(wanted: DataFrame, segments: DataFrame) -> DataFrame:
    """Which segment serves which wanted indexes: ``uid, segment, n, first, last``."""
    s = segments.select(F.col("uid").alias("owner"), "lo", "hi", "segment")
    found = indexset.locate(wanted.withColumnRenamed("uid", "owner"), s, ["segment"], 128)
    return found.groupBy(F.col("owner").alias("uid"), "segment").agg(
        F.count("*").alias("n"), F.min("idx").alias("first"), F.max("idx").alias("last")
    )


def exec_plan(wanted: DataFrame, segments: DataFrame, log: DataFrame, width: int = 128) -> DataFrame:
    """Entries at the ``wanted`` indexes (``uid, idx``) with the segment that serves each; those
    that no segment holds are left out."""
    s = segments.select(F.col("uid").alias("owner"), "lo", "hi", "segment")
    found = indexset.locate(wanted.withColumn("owner", F.col("uid")), s, ["segment"], width)
    return found.drop("owner").join(log, ["uid", "idx"])


def above_snapshot(log: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Entries that a fold over the log sees: those behind the log's snapshot (``uid, snap``), all
    where it has none."""
    return log.join(snapshots, "uid", "left").filter(F.col("snap").isNull() | (F.col("idx") > F.col("snap"))).drop("snap")


def fetch_term(wanted: DataFrame, log: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Term of each wanted index, from the log or else from the snapshot that ends there."""
    l = log.select("uid", "idx", F.col("term").alias("_log"))
    s = snapshots.select("uid", "idx", F.col("term").alias("_snap"))
    both = wanted.join(l, ["uid", "idx"], "left").join(s, ["uid", "idx"], "left")
    return both.select(*wanted.columns, F.coalesce("_log", "_snap").alias("term"))


def prefix_match(batch: DataFrame, log: DataFrame) -> DataFrame:
    """``batch`` rows with ``status``: ok, term_mismatch or missing, and ``drop``: whether the
    row belongs to the leading entries that the log has already."""
    known = log.select("uid", "idx", F.col("term").alias("_known"))
    status = (
        F.when(F.col("_known").isNull(), "missing").when(F.col("_known") == F.col("term"), "ok").otherwise("term_mismatch")
    )
    rows = batch.join(known, ["uid", "idx"], "left").withColumn("status", status).drop("_known")
    first = rows.filter("status <> 'ok'").groupBy("uid").agg(F.min("idx").alias("_first"))
    rows = rows.join(first, "uid", "left")
    return rows.withColumn("drop", F.col("_first").isNull() | (F.col("idx") < F.col("_first"))).drop("_first")


def overview(log: DataFrame) -> DataFrame:
    return log.groupBy("uid").agg(
        F.min("idx").alias("first_idx"),
        F.max("idx").alias("last_idx"),
        F.max_by("term", "idx").alias("last_term"),
        (F.max("idx") + 1).alias("next_idx"),
        F.count("*").alias("entries"),
        F.countDistinct("term").alias("terms"),
    )


def gaps(wal: DataFrame) -> DataFrame:
    """Rows whose index skips some after the writer's row before: the resend requests."""
    prev = F.lag("idx").over(Window.partitionBy("uid").orderBy("arrival"))
    return wal.withColumn("prev", prev).filter("idx > prev + 1").withColumn("resend_from", F.col("prev") + 1).drop("prev")


def admission(wal: DataFrame, floors: DataFrame | None = None) -> DataFrame:
    """``uid, idx, term, n, status, truncates`` of each row (n counts a writer's rows in
    arrival order).

    A row names the index that its writer wrote before it (``prev``; one less where there is
    no such column). A first row is accepted; so is one whose ``prev`` is not beyond the last
    index taken, and one at the smallest live index of its writer (``floors``: ``uid,
    smallest``), which ``truncates`` what was there. A row below the smallest live index is
    ``below``: not written, but the writer counts as in sequence up to there. Else the first
    gap asks for a ``resend`` and further ones are ``dropped``."""
    rows = wal if "prev" in wal.columns else wal.withColumn("prev", F.col("idx") - 1)
    rows = rows.select("uid", "idx", "term", "arrival", "prev").withColumn("smallest", F.lit(None).cast("long"))
    if floors is not None:  # a writer's floor comes before its rows, which spares a join of them all
        low = floors.select("uid", F.col("smallest").cast("long")).filter("uid IS NOT NULL AND smallest IS NOT NULL")
        rows = rows.unionByName(low, allowMissingColumns=True)

    def step(state, idx, prev, floor):
        last, in_order, n, smallest = state
        if floor is not None:
            return (last, in_order, n, floor), (None, None, None)
        if idx < smallest:
            return (smallest - 1, True, n + 1, smallest), (n, "below", False)
        if last is None or prev <= last or idx == smallest:
            return (idx, True, n + 1, smallest), (n, "accepted", last is not None and idx == smallest)
        return (last, False, n + 1, smallest), (n, "resend" if in_order else "dropped", False)

    out = ordered_pass(
        rows, ["uid"], [F.col("smallest").isNull(), "arrival"], ["idx", "prev", "smallest"], {"n": "int", "status": "string", "truncates": "boolean"}, lambda: (None, True, 0, 0), step,
        ["uid", "idx", "term", "prev", "smallest"],
    )
    return out.filter("n IS NOT NULL").select("uid", "idx", "term", "n", "status", "truncates")


def batch_ranges(writes: DataFrame) -> DataFrame:
    """Per commit batch, writer and term: range and count of what was written."""
    return writes.groupBy("batch", "uid", "term").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.count("*").alias("n"))


def file_numbers(log: DataFrame, size: Column, max_bytes: int, max_entries: int | None = None) -> DataFrame:
    """``uid, idx, file``: entries dealt to files in index order. A file is full when it holds
    more than ``max_bytes`` or has ``max_entries`` entries; the entry after starts the next
    one, so a file may overshoot by its last entry, and counts start anew."""
    rows = log.select("uid", "idx", size.cast("long").alias("_size"))

    def step(state, n_bytes):
        file, held, n = state
        if held > max_bytes or max_entries is not None and n + 1 > max_entries:
            file, held, n = file + 1, 0, 0
        return (file, held + n_bytes, n + 1), (file,)

    return ordered_pass(rows, ["uid"], ["idx"], ["_size"], {"file": "long"}, lambda: (0, 0, 0), step).drop("_size")


def checksum_ok(payload: Column, crc: Column) -> Column:
    """Zero stands for no checksum and passes."""
    return F.when(crc == 0, F.lit(True)).otherwise(F.crc32(payload) == crc)


def last_per_writer(wal: DataFrame) -> DataFrame:
    return wal.groupBy("uid").agg(F.max("idx").alias("last_idx"), F.count("*").alias("n"))


def latest_meta(changes: DataFrame) -> DataFrame:
    """Current ``term, voted_for, last_applied`` per uid from an append-only change log
    (``uid, seq, field, value``); a vote before the last change of term does not count."""

    def last(field: str) -> Column:
        return F.max_by(F.when(F.col("field") == field, F.col("value")), F.when(F.col("field") == field, F.col("seq")))

    def seq(field: str) -> Column:
        return F.max(F.when(F.col("field") == field, F.col("seq")))

    rows = changes.groupBy("uid").agg(
        last("current_term").alias("current_term"), last("voted_for").alias("_vote"), last("last_applied").alias("last_applied"),
        seq("current_term").alias("_t"), seq("voted_for").alias("_v"),
    )
    return rows.select("uid", "current_term", F.when(F.coalesce(F.col("_v") > F.col("_t"), F.col("_t").isNull()), F.col("_vote")).alias("voted_for"), "last_applied")


def debounce(events: DataFrame, by: str, ts: str, seconds: float) -> DataFrame:
    """Events let through: a key's first one, and each that comes more than ``seconds`` after
    the last one let through (``ts`` is a timestamp; order is ``ts``, ``idx``)."""
    rows = events.withColumn("_us", F.unix_micros(ts))
    window = int(seconds * 1e6)

    def step(last, us):
        go = last is None or us > last + window
        return us if go else last, (go,)

    return ordered_pass(rows, [by], [ts, "idx"], ["_us"], {"_go": "boolean"}, lambda: None, step).filter("_go").drop("_us", "_go")


def flushable(log: DataFrame, state: DataFrame) -> DataFrame:
    """What of a log is still needed: rows above the snapshot and live rows below it.

    ``state``: ``uid, snap, live array<long>`` or rows to join; missing writers keep all.
    """
    rows = log.join(state, "uid", "left")
    return rows.filter(F.col("snap").isNull() | (F.col("idx") > F.col("snap")) | F.col("is_live"))


def low_priority_batches(commands: DataFrame, size: int = 16) -> DataFrame:
    """``batch`` of low-priority commands, which wait and go ``size`` at a time; null for
    normal ones, which go at once."""
    rows = commands.withColumn("_low", (F.col("priority") == "low").cast("int"))
    rows = scan.running_sum(rows, "_low", "_n", ["uid"], "idx")
    return rows.withColumn("batch", F.when(F.col("_low") == 1, F.floor((F.col("_n") - 1) / size))).drop("_low", "_n")


def recover(wal: DataFrame, registry: DataFrame, floors: DataFrame, block: int = scan.BLOCK) -> DataFrame:
    """What a recovery scan restores: rows of registered writers, at or above the smallest
    index still live (``floors``: ``uid, smallest``), after overwrites.

    A bad checksum of a registered writer's row is tolerated at the end of the file only
    (the greatest ``write_seq``; of each ``file`` where there is that column): there the row is
    left out. Anywhere else the scan fails."""
    file = ["file"] if "file" in wal.columns else []
    good = checksum_ok(F.col("payload"), F.col("crc"))
    ends = wal.groupBy(*file).agg(F.max("write_seq").alias("_end"))
    rows = wal.join(registry.select("uid"), "uid", "left_semi").withColumn("_good", good)
    rows = rows.join(ends, file) if file else rows.crossJoin(F.broadcast(ends))  # one row
    place = F.concat(F.lit("bad checksum before the end of the file, write_seq "), F.col("write_seq").cast("string"))
    rows = rows.filter(F.when(F.col("_good"), True).when(F.col("write_seq") == F.col("_end"), False).otherwise(F.raise_error(place).cast("boolean")))
    rows = rows.drop("_good", "_end").join(floors.select("uid", "smallest"), "uid", "left")
    rows = rows.filter(F.col("smallest").isNull() | (F.col("idx") >= F.col("smallest"))).drop("smallest")
    return visible(rows, block)


MEMTABLE_ENTRIES = 1_000_000  # a fixed value: a table takes one entry more than this


def insert_status(rows: DataFrame, most: int = MEMTABLE_ENTRIES) -> DataFrame:
    """Adds ``status`` of sparse inserts that name their predecessor (``prev_idx``).

    An empty table takes anything. Then an index at or below the last one taken is
    ``overwriting``, whatever it names; one that names another predecessor than that is a
    ``gap_detected``; a table of more than ``most`` entries answers ``limit_reached``. Refused
    rows leave the table as it was."""

    def step(state, idx, prev):
        last, n = state
        if last is None:
            return (idx, 1), ("ok",)
        if idx <= last:
            return state, ("overwriting",)
        if prev != last:
            return state, ("gap_detected",)
        return (state, ("limit_reached",)) if n > most else ((idx, n + 1), ("ok",))

    return ordered_pass(rows, ["uid"], ["arrival"], ["idx", "prev_idx"], {"status": "string"}, lambda: (None, 0), step)


def dense_insert_status(rows: DataFrame, most: int = MEMTABLE_ENTRIES) -> DataFrame:
    """Adds ``status`` of inserts that must follow on: ``ok`` for the next index or the first
    of an empty table, ``overwriting``, ``limit_reached``; a hole is ``unexpected_sparse``, on
    which a writer stops: all its later rows are ``stopped``."""

    def step(state, idx):
        last, n, stopped = state
        if stopped:
            return state, ("stopped",)
        if last is None or idx == last + 1:
            return (state, ("limit_reached",)) if n > most else ((idx, n + 1, False), ("ok",))
        return (state, ("overwriting",)) if idx <= last else ((last, n, True), ("unexpected_sparse",))

    return ordered_pass(rows, ["uid"], ["arrival"], ["idx"], {"status": "string"}, lambda: (None, 0, False), step)


def evict(log: DataFrame, flushed: DataFrame) -> DataFrame:
    """``uid, deleted, kept, first`` after rows up to ``flushed_to`` have left the hot table;
    ``by_range`` where over half of it goes, which a range delete does better than keys."""
    gone = F.coalesce(F.col("idx") <= F.col("flushed_to"), F.lit(False))
    return log.join(flushed, "uid", "left").groupBy("uid").agg(
        F.count_if(gone).alias("deleted"),
        F.count_if(~gone).alias("kept"),
        F.min(F.when(~gone, F.col("idx"))).alias("first"),
        (F.count_if(gone) * 2 > F.count("*")).alias("by_range"),
    )


def generations(writes: DataFrame, block: int = scan.BLOCK) -> DataFrame:
    """Adds ``generation``: how many times a writer's index has gone back before a row, which
    is the number of the hot table that took it."""
    back = F.lag("idx").over(Window.partitionBy("uid", "_w").orderBy("write_seq"))
    rows = writes.withColumn("_w", F.floor(F.col("write_seq") / block))
    last = rows.groupBy("uid", "_w").agg(F.max_by("idx", "write_seq").alias("_last"))
    ahead = Window.partitionBy("uid").orderBy("_w")
    last = last.withColumn("_before", F.lag("_last").over(ahead)).drop("_last")
    rows = rows.join(last, ["uid", "_w"]).withColumn("_back", (F.coalesce(back, F.col("_before")) >= F.col("idx")).cast("int"))
    rows = rows.withColumn("_back", F.coalesce("_back", F.lit(0))).drop("_w", "_before")
    return scan.running_sum(rows, "_back", "generation", ["uid"], "write_seq", block).drop("_back")


def flush_ranges(generations_: DataFrame, floors: DataFrame) -> DataFrame:
    """``uid, generation, lo, hi``: what each hot table flushes to segments. An older table
    stops where a newer one begins, nothing below the smallest live index is flushed, and
    only writers of ``floors`` (``uid, smallest``), the registered ones, are."""
    g = generations_.groupBy("uid", "generation").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    newer = Window.partitionBy("uid").orderBy(F.desc("generation")).rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("hi", F.least(F.col("hi"), F.min("lo").over(newer) - 1)).join(floors.select("uid", "smallest"), "uid")
    return g.select("uid", "generation", F.greatest("lo", "smallest").alias("lo"), "hi").filter("lo <= hi")


def generation_of(wanted: DataFrame, generations_: DataFrame) -> DataFrame:
    """``wanted`` (``uid, idx, term``) with the newest hot table that holds such an entry, null
    where none does."""
    held = generations_.groupBy("uid", "idx", "term").agg(F.max("generation").alias("generation"))
    return wanted.join(held, ["uid", "idx", "term"], "left")


def staged(ops: DataFrame, block: int = scan.BLOCK) -> DataFrame:
    """``uid, seq, idx, status`` of entries among transaction marks (``op``: begin, entry, commit,
    abort; ``seq`` orders a log's rows). Entries between begin and commit appear together:
    ``committed``; an abort takes them back: ``aborted``; they are ``staged`` while neither has
    come. Entries outside transactions are ``committed``."""
    rows = ops.withColumn("_begins", (F.col("op") == "begin").cast("int"))
    rows = scan.running_sum(rows, "_begins", "_tx", ["uid"], "seq", block)
    ends = rows.filter(F.col("op").isin("commit", "abort")).groupBy("uid", "_tx").agg(F.min_by("op", "seq").alias("_end"), F.min("seq").alias("_at"))
    e = rows.filter("op = 'entry'").join(ends, ["uid", "_tx"], "left")
    inside = (F.col("_tx") > 0) & (F.col("_at").isNull() | (F.col("seq") < F.col("_at")))
    status = F.when(~inside | (F.col("_end") == "commit"), "committed").when(F.col("_end") == "abort", "aborted").otherwise("staged")
    return e.select("uid", "seq", "idx", status.alias("status"))


def newest_where(items: DataFrame, found: Column, by: str = "uid") -> DataFrame:
    """``by, idx``: the newest item of a log for which ``found`` holds, as a search from its end."""
    return items.filter(found).groupBy(by).agg(F.max("idx").alias("idx"))


def take_while(items: DataFrame, holds: Column, by: str = "uid") -> DataFrame:
    """Items from the newest one back to the first for which ``holds`` is not true."""
    stop = items.filter(~F.coalesce(holds, F.lit(False))).groupBy(by).agg(F.max("idx").alias("_stop"))
    return items.join(stop, by, "left").filter(F.col("_stop").isNull() | (F.col("idx") > F.col("_stop"))).drop("_stop")


def read_commands(log: DataFrame, wanted: DataFrame, kinds: list[str]) -> DataFrame:
    """User commands at the ``wanted`` indexes (``pos, idx``): entries of other kinds, such as
    membership changes, are left out."""
    return sparse_read(log.filter(F.col("type").isin(kinds)), wanted)


def adler32(payload: Column) -> Column:
    """Adler-32 of a binary column, an Arrow batch at a time (there is no such built-in)."""

    def sums(column: pd.Series) -> pd.Series:
        return column.map(lambda b: None if b is None else zlib.adler32(b))

    return F.pandas_udf(sums, LongType())(payload)


def fill_ratio(size: Column, most: Column) -> Column:
    """Share of a file in use, one half where its size is unknown."""
    return F.when(size.isNull(), 0.5).otherwise(F.least(F.lit(1.0), size / most))


def parked_until(queries: DataFrame, permits: DataFrame, block: int = scan.BLOCK) -> DataFrame:
    """``uid, idx, runs_at``: consistent queries wait for the first permit at or after them
    (null where none comes): a forward as-of lookup by one scan from the end."""
    q = queries.select("uid", (-F.col("idx")).alias("_at"), F.lit(None).cast("long").alias("_p"), F.lit(1).alias("_kind"))
    p = permits.select("uid", (-F.col("idx")).alias("_at"), F.col("idx").alias("_p"), F.lit(0).alias("_kind"))
    out = scan.last_value(p.unionByName(q), F.col("_p"), "runs_at", ["uid"], [F.col("_at"), F.col("_kind")], F.floor(F.col("_at") / block))
    return out.filter("_kind = 1").select("uid", (-F.col("_at")).alias("idx"), "runs_at")
