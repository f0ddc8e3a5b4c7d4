"""Small cases with known results."""

import datetime
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tideline.functions import ordered, ranges, scan
from tideline.operators import indexset, logops, machines, metrics, queues, quorum, segments, snapshots


def seq(spark, *idx):
    return spark.createDataFrame([("a", i) for i in idx], "owner string, idx long")


def spans(df):
    return sorted((r.lo, r.hi) for r in df.collect())


def test_compress(spark):
    df = seq(spark, 1, 2, 3, 3, 5, 6, 7, 7, 10, 11, 11)
    assert spans(indexset.compress(df)) == [(1, 3), (5, 7), (10, 11)]
    assert spans(indexset.compress(df, block=2)) == [(1, 3), (5, 7), (10, 11)]
    assert spans(indexset.compress(seq(spark), block=2)) == []


def test_overlay_and_subtract(spark):
    over = indexset.overlay(seq(spark, 7, 8, 9, 11), seq(spark, 1, 2, 3, 5, 6, 7, 8))
    assert spans(indexset.compress(over)) == [(1, 3), (5, 9), (11, 11)]
    less = indexset.subtract(seq(spark, *range(1, 12)), seq(spark, 10, 4, 5, 6))
    assert spans(indexset.compress(less)) == [(1, 3), (7, 9), (11, 11)]


def test_remove_prefix(spark):
    s = seq(spark, 2, 3, 5, 6, 8, 9, 10, 12)
    ok = indexset.remove_prefix(seq(spark, 2, 3, 5), s).collect()
    assert sorted(r.idx for r in ok) == [6, 8, 9, 10, 12] and not any(r.not_prefix for r in ok)
    assert all(r.not_prefix for r in indexset.remove_prefix(seq(spark, 5, 6, 8), s).collect())


@pytest.mark.parametrize("lo,hi,expected", [(4, 4, False), (9, 15, True), (0, 1, True), (100, 200, False)])
def test_has_overlap(spark, lo, hi, expected):
    held = indexset.compress(seq(spark, 1, 2, 3, 5, 6, 7, 8, 9, 11))
    asked = spark.createDataFrame([("a", lo, hi)], "owner string, lo long, hi long")
    assert (indexset.overlapping(asked, held, 4).count() == 1) is expected


def test_ranges(spark):
    row = spark.range(1).select(
        ranges.subtract(ranges.new(F.lit(2), F.lit(10)), ranges.new(F.lit(1), F.lit(20))).alias("s"),
        ranges.add(ranges.new(F.lit(30), F.lit(40)), ranges.new(F.lit(1), F.lit(20))).alias("apart"),
        ranges.size(ranges.new(F.lit(3), F.lit(2))).alias("none"),
        ranges.fold(ranges.new(F.lit(1), F.lit(4)), F.lit(0).cast("long"), lambda a, x: a * 10 + x).alias("f"),
        ranges.extend(F.lit(5), ranges.new(F.lit(1), F.lit(4))).alias("e"),
    ).first()
    assert [tuple(x) for x in row.s] == [(1, 1), (11, 20)]
    assert tuple(row.apart) == (30, 40) and row.none == 0 and row.f == 1234 and tuple(row.e) == (1, 5)
    with pytest.raises(Exception, match="not the next"):
        spark.range(1).select(ranges.extend(F.lit(7), ranges.new(F.lit(1), F.lit(4)))).collect()


@pytest.mark.parametrize("values,expected", [([4], 4), ([4, 3], 3), ([4, 4, 4], 4), ([4, 4, 3], 4), ([3, 4, 4], 4), ([4, 2, 3], 3)])
def test_agreed(spark, values, expected):
    assert spark.range(1).select(quorum.agreed(F.array(*map(F.lit, values))).alias("a")).first().a == expected


def overlapped(spark):
    parts = [(range(1, 300), 1), (range(300, 400), 1), (range(200, 350), 2), (range(350, 500), 2), (range(500, 551), 2)]
    rows = [("a", i, t) for r, t in parts for i in r]
    return spark.createDataFrame([(u, i, t, n) for n, (u, i, t) in enumerate(rows)], "uid string, idx long, term long, write_seq long")


@pytest.mark.parametrize("block", [7, 64, 1 << 16])
def test_visible(spark, block):
    once = logops.visible(overlapped(spark), block)
    runs = sorted((r.term, r.lo, r.hi, r.n) for r in logops.term_runs(once).collect())
    assert runs == [(1, 1, 199, 199), (2, 200, 550, 351)]
    assert logops.visible(once, block).count() == 550


def test_admission(spark):
    wal = spark.createDataFrame([(1, n, i, 1) for n, i in enumerate([1, 2, 3, 5, 6, 4, 5])], "uid long, arrival long, idx long, term long")
    got = [r.status for r in logops.admission(wal).orderBy("n").collect()]
    assert got == ["accepted"] * 3 + ["resend", "dropped", "accepted", "accepted"]


def test_sparse_read(spark):
    log = spark.createDataFrame([("a", i, i * 10) for i in range(1, 8)], "uid string, idx long, v long")
    want = spark.createDataFrame([(0, 6), (1, 5), (2, 99), (3, 3)], "pos long, idx long")
    assert [r.idx for r in logops.sparse_read(log, want).orderBy("pos").collect()] == [6, 5, 3]
    assert [r.idx for r in logops.sparse_read(log, want, "stop").orderBy("pos").collect()] == [6, 5]
    with pytest.raises(Exception, match="missing index 99"):
        logops.sparse_read(log, want, "error").collect()


@pytest.mark.parametrize(
    "infos,count,expected",
    [
        ([(10, 4), (10, 4), (10, 9), (10, 3), (10, 2)], 100, {1: 1, 2: 1, 4: 2, 5: 2}),
        ([(128, 42), (128, 43), (128, 43), (128, 128), (128, 43)], 128, {1: 1, 2: 1, 3: 1, 5: 2}),
        ([(128, 60), (128, 60), (128, 60)], 128, {1: 1, 2: 1, 3: 2}),
        ([(10, 4), (300, 140), (10, 4)], 100, {1: 1, 3: 2}),
    ],
)
def test_compaction_groups(spark, infos, count, expected):
    rows = [("a", n, n * 1000, e, e, l, l) for n, (e, l) in enumerate(infos, 1)]
    df = spark.createDataFrame(rows, "uid string, segment long, lo long, n long, bytes long, n_live long, live_bytes long")
    assert {r.segment: r.grp for r in segments.groups(df, count, 10**9).collect()} == expected


def test_fold_is_order_deterministic(spark):
    rng = random.Random(1)
    ops = [(1, i, rng.choice("asdm"), rng.randint(1, 9)) for i in range(200)]

    def apply(a, x):
        return F.when(x["op"] == "a", a + x["n"]).when(x["op"] == "s", a - x["n"]).when(x["op"] == "m", a * x["n"] % 1009).otherwise(F.floor(a / x["n"]))

    state = 7
    for _, _, op, n in ops:
        state = state + n if op == "a" else state - n if op == "s" else (abs(state * n) % 1009 * (1 if state >= 0 else -1)) if op == "m" else state // n
    df = spark.createDataFrame(ops, "k long, idx long, op string, n long")
    for parts in (1, 4):
        got = machines.fold(df.repartition(parts), "k", "idx", ["op", "n"], F.lit(7).cast("long"), apply).first().state
        assert got == state


def test_leaky_rate(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 10.0), (1, 2, 1000.0, 5.0), (1, 3, 500.0, 2.0)], "key long, idx long, t double, amount double")
    got = metrics.leaky_rate(df, "key", "idx", 1000.0).first().value
    assert got == pytest.approx(10 * 2.718281828459045**-1 + 7)


def test_kv_and_queue(spark):
    cmd = spark.createDataFrame([(1, 1, "put"), (2, 2, "put"), (2, 3, "delete"), (2, 4, "delete"), (2, 5, "put")], "key long, idx long, op string")
    assert {(r.key, r.idx) for r in machines.kv_state(cmd).collect()} == {(1, 1), (2, 5)}
    assert [r.reply for r in machines.kv_replies(cmd).orderBy("idx").collect()] == ["ok", "not_found"]
    d = spark.createDataFrame([(1, 1, 1), (1, 3, 2), (1, 3, 3), (1, 2, 4), (1, 5, 5)], "producer long, seqno long, arrival long")
    assert [(r.seqno, r.enqueued_at) for r in queues.exactly_once(d).orderBy("seqno").collect()] == [(1, 1), (2, 4), (3, 4)]


def test_checkpoints(spark):
    c = spark.createDataFrame([("a", i) for i in (10, 20, 30)], "uid string, idx long")
    r = spark.createDataFrame([("a", i) for i in (5, 10, 29, 99)], "uid string, idx long")
    got = {x.idx: x.checkpoint for x in snapshots.promotable(r, c, 8).collect()}
    assert got == {10: 10, 29: 20, 99: 30}


def test_scan_blocks_do_not_matter(spark):
    df = spark.range(1000).select(F.lit("a").alias("u"), F.col("id").alias("i"), (F.col("id") * 7 % 13).alias("v"))
    got = {b: [r.s for r in scan.running_sum(df, "v", "s", ["u"], "i", b).orderBy("i").collect()] for b in (3, 100, 10**6)}
    assert got[3] == got[100] == got[10**6]


def test_metadata_vote_reset(spark):
    rows = [("a", 1, "voted_for", 7), ("a", 2, "current_term", 2), ("b", 1, "current_term", 1), ("b", 2, "voted_for", 9)]
    df = spark.createDataFrame(rows, "uid string, seq long, field string, value long")
    assert {r.uid: r.voted_for for r in logops.latest_meta(df).collect()} == {"a": None, "b": 9}


def test_admission_rules(spark):
    rows = [("a", 1, 5, 4), ("a", 2, 6, 5), ("a", 3, 9, 8), ("a", 4, 10, 9), ("a", 5, 7, 6), ("a", 6, 9, 7), ("b", 1, 1, 0), ("b", 2, 3, 2), ("b", 3, 4, 3), ("b", 4, 9, 8), ("c", 1, 3, 2), ("c", 2, 3, 9)]
    df = spark.createDataFrame(rows, "uid string, arrival long, idx long, prev long").withColumn("term", F.lit(1))
    floors = spark.createDataFrame([("b", 4), ("c", 3)], "uid string, smallest long")
    got = {(r.uid, r.n): (r.status, r.truncates) for r in logops.admission(df.repartition(4), floors).collect()}
    a = ["accepted", "accepted", "resend", "dropped", "accepted", "accepted"]
    assert [got["a", n] for n in range(6)] == [(s, False) for s in a]
    assert [got["b", n] for n in range(4)] == [("below", False), ("below", False), ("accepted", True), ("resend", False)]
    assert [got["c", n] for n in range(2)] == [("accepted", False), ("accepted", True)]


#: Ways in which Spark undoes the deal of a join by key at run time.
UNDONE = {
    "broadcast": {"autoBroadcastJoinThreshold": "-1", "adaptive.autoBroadcastJoinThreshold": "10m", "adaptive.coalescePartitions.enabled": "false"},
    "skew": {
        "autoBroadcastJoinThreshold": "-1", "adaptive.autoBroadcastJoinThreshold": "-1", "adaptive.advisoryPartitionSizeInBytes": "1k",
        "adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "adaptive.skewJoin.skewedPartitionFactor": "1",
    },
}


@pytest.fixture(params=UNDONE)
def undone(spark, request):
    before = {f"spark.sql.{k}": spark.conf.get(f"spark.sql.{k}", None) for k in UNDONE[request.param]}
    for k, v in UNDONE[request.param].items():
        spark.conf.set(f"spark.sql.{k}", v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot_writer(spark):
    """Writer 1 has nine tenths of 4,000 rows, which four tasks read."""
    n = F.col("id")
    return spark.range(0, 4000, 1, 4).select(F.when(n % 10 == 0, n % 7 + 2).otherwise(1).alias("uid"), n.alias("arrival"), F.lit(1).cast("long").alias("term"))


def test_ordered_pass_after_join(undone):
    rows = hot_writer(undone).join(undone.createDataFrame([(1, 5)], "uid long, low long"), "uid", "left")
    uids = [r.uid for r in hot_writer(undone).orderBy("arrival").collect()]
    want = sorted((u, at, uids[:at].count(u) + 1) for at, u in enumerate(uids))
    step = lambda n, at: (n + 1, (n + 1,))
    got = ordered.ordered_pass(rows, ["uid"], ["arrival"], ["arrival"], {"n": "long"}, lambda: 0, step)
    assert sorted((r.uid, r.arrival, r.n) for r in got.collect()) == want

    def listed(state, at):
        state.append(at)
        return [(at, len(state))]

    got = ordered.ordered_rows(rows, ["uid"], ["arrival"], ["arrival"], "uid long, arrival long, n long", list, listed)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_admission_keeps_writers_together(undone):
    """Whatever Spark makes of the floors: a writer's rows are numbered and judged in one go."""
    wal = hot_writer(undone).withColumn("idx", F.when(F.col("uid") == 1, F.col("arrival")).otherwise(9))
    floors = undone.createDataFrame([(1, 3), (2, 9), (99, 1), (None, 9), (3, None)], "uid long, smallest long")
    got = {(r.uid, r.n): (r.idx, r.status, r.truncates) for r in logops.admission(wal.withColumn("prev", F.col("idx") - 2), floors).collect()}
    assert len(got) == 4000
    assert [got[1, n] for n in range(4)] == [(1, "below", False), (2, "below", False), (3, "accepted", True), (4, "accepted", False)]
    assert all(got[1, n][1:] == ("accepted", False) for n in range(3, 3600))
    assert [got[2, n] for n in range(2)] == [(9, "accepted", False), (9, "accepted", True)]
    assert got[3, 1] == (9, "accepted", False)


def test_files_start_anew_and_overshoot(spark):
    sizes = [10, 200, 5, 5, 5, 150, 1, 1]
    df = spark.createDataFrame([("a", i + 1, n) for i, n in enumerate(sizes)], "uid string, idx long, n long")
    files = lambda *a: [r.file for r in logops.file_numbers(df, F.col("n"), *a).orderBy("idx").collect()]
    assert files(100) == [0, 0, 1, 1, 1, 1, 2, 2]
    assert files(100, 2) == [0, 0, 1, 1, 2, 2, 3, 3]
    assert files(14) == [0, 0, 1, 1, 1, 2, 3, 3]


def test_debounce_counts_from_the_last_one_let_through(spark):
    rows = [("k", i, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=10 * i)) for i in range(10)] + [("j", 0, datetime.datetime(2024, 1, 1))]
    df = spark.createDataFrame(rows, "key string, idx long, ts timestamp")
    got = sorted((r.key, r.idx) for r in logops.debounce(df, "key", "ts", 20).collect())
    assert got == [("j", 0), ("k", 0), ("k", 3), ("k", 6), ("k", 9)]  # twenty seconds are not more than twenty


def test_sparse_inserts(spark):
    rows = [("a", 1, 4, 3), ("a", 2, 6, 5), ("a", 3, 7, 4), ("a", 4, 7, 7), ("a", 5, 7, 99), ("a", 6, 9, 7), ("a", 7, 10, 9)]
    df = spark.createDataFrame(rows, "uid string, arrival long, idx long, prev_idx long")
    got = [r.status for r in logops.insert_status(df, 2).orderBy("arrival").collect()]
    assert got == ["ok", "gap_detected", "ok", "overwriting", "overwriting", "ok", "limit_reached"]
    rows = [("a", n, i) for n, i in enumerate([5, 6, 6, 7, 8])] + [("b", n, i) for n, i in enumerate([1, 3, 2])]
    got = [(r.uid, r.status) for r in logops.dense_insert_status(spark.createDataFrame(rows, "uid string, arrival long, idx long"), 2).orderBy("uid", "arrival").collect()]
    assert got == [("a", "ok"), ("a", "ok"), ("a", "overwriting"), ("a", "ok"), ("a", "limit_reached"), ("b", "ok"), ("b", "unexpected_sparse"), ("b", "stopped")]


def test_recovery_tolerates_only_a_torn_end(spark):
    rows = [("a", 2 * i, i, 1, b"x", zlib.crc32(b"x")) for i in range(1, 6)] + [("gone", 3, 1, 1, b"x", 7)]
    frame = lambda r: spark.createDataFrame(r, "uid string, write_seq long, idx long, term long, payload binary, crc long")
    registry, floors = spark.createDataFrame([("a",)], "uid string"), spark.createDataFrame([("a", 2)], "uid string, smallest long")
    torn = [*rows, ("a", 12, 6, 1, b"x", 1)]
    assert sorted(r.idx for r in logops.recover(frame(torn), registry, floors).collect()) == [2, 3, 4, 5]
    with pytest.raises(Exception, match="bad checksum"):
        logops.recover(frame([*torn, ("a", 14, 7, 1, b"x", zlib.crc32(b"x"))]), registry, floors).collect()


def test_dequeues_of_an_empty_queue_take_no_number(spark):
    rng = random.Random(3)
    ops = [(q, i, rng.choice(["enq", "deq", "deq"] if rng.random() < 0.6 else ["enq"])) for q in (1, 2) for i in range(1, 80)]
    want, held = [], {1: [], 2: []}
    for q, i, op in ops:
        if op == "enq":
            held[q].append(i)
        else:
            want.append((q, i, held[q].pop(0) if held[q] else None))
    got = [tuple(r) for r in queues.matched(spark.createDataFrame(ops, "queue long, idx long, op string").repartition(3)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_full_windows_get_nothing(spark):
    rows = [(1, 1, 10, 11, 5, "normal"), (1, 2, 10, 15, 5, "normal"), (1, 3, 10, 13, 5, "suspended"), (1, 4, 19, 20, 9, "normal"), (1, 5, 19, 20, 8, "normal")]
    df = spark.createDataFrame(rows, "cluster long, member long, match_index long, next_index long, commit_sent long, status string")
    sent = lambda **k: sorted((r.member, r.batch) for r in quorum.pipeline(df, F.lit(20), F.lit(9), 3, 4, **k).collect())
    assert sent() == [(1, 3), (5, 3)] and sent(force=True) == [(1, 3), (2, 1), (5, 3)]


def test_logs_do_not_share_indexes(spark):
    log = spark.createDataFrame([("a", 1, 5, "put", "x"), ("b", 1, 5, "put", "y")], "uid string, idx long, key long, op string, payload string")
    got = machines.kv_read(machines.kv_state(log, ["uid"]), log).select("uid", "payload").collect()
    assert sorted(map(tuple, got)) == [("a", "x"), ("b", "y")]
    wanted = spark.createDataFrame([("a", 1, 0), ("b", 2, 0)], "uid string, idx long, pos long")
    assert [r.payload for r in logops.sparse_read(log, wanted).collect()] == ["x"]
    assert [r.payload for r in logops.sparse_read(log, wanted, "stop").collect()] == ["x"]


def test_columns_as_python_values():
    import pyarrow as pa

    from tideline.functions.ordered import _values

    for column in (
        pa.array([1, None, 3]), pa.array([1.5, None]), pa.array([True, None, False]), pa.array(["a", None, "b", "a"]), pa.array([[1, 2], None, [], [3]]),
        pa.array([[1, None], [2]]), pa.array([None, None], pa.int64()), pa.array([], pa.string()), pa.array([[["a"], []], None]), pa.array([{"x": 1}]), pa.array([[1, 2], [3]]).slice(1),
    ):
        assert _values(column) == column.to_pylist()


def test_checked_files(spark, tmp_path):
    from tideline.sources import log_table

    rows = spark.createDataFrame([("a", i) for i in (1, 2, 3, 7, 9, 10)], "owner string, idx long")
    whole, torn, damaged = (str(tmp_path / n) for n in ("whole", "torn", "damaged"))
    for path in (whole, torn, damaged):
        log_table.write_snapshot(rows, {"idx": 10, "term": 2}, path)
    rows.limit(5).write.mode("overwrite").parquet(f"{damaged}/state")
    import shutil

    shutil.rmtree(f"{torn}/meta")
    with pytest.raises(ValueError, match="bad checksum"):
        log_table.read_snapshot(spark, damaged)
    assert log_table.recover_snapshot(spark, [torn, damaged, str(tmp_path / "none"), whole]) == whole
    assert log_table.recover_snapshot(spark, [torn, damaged]) is None
    assert log_table.read_snapshot(spark, whole)[0].first().term == 2
    log_table.write_indexes(rows, str(tmp_path / "live"))
    assert spark.read.parquet(str(tmp_path / "live/state")).count() == 3
    assert sorted(r.idx for r in log_table.read_indexes(spark, str(tmp_path / "live")).collect()) == [1, 2, 3, 7, 9, 10]


def test_shuffles_depend_on_the_seed_only(spark):
    from tideline.operators import scheduling

    df = spark.createDataFrame([("a", i) for i in range(50)], "uid string, item long")
    order = lambda d, seed: [r.item for r in scheduling.shuffled(d, "uid", seed).orderBy("rank").collect()]
    assert order(df, 1) == order(df.repartition(7), 1) != order(df, 2) and sorted(order(df, 1)) == list(range(50)) != order(df, 1)
