"""Streams over files give what the batch operators give."""

import pytest
from pyspark.sql import functions as F

from tideline.operators import logops, machines, metrics, queues
from tideline.plans import views
from tideline.sources import log_table
from tideline.streaming import keyed

SF = "/root/testdata/sf0.001"


def streamed(spark, tmp_path, df, by, build, mode):
    """Run ``build`` over ``df`` in three micro-batches, in the order of ``by``."""
    n = df.count()
    ordered = df.orderBy(by).toPandas()
    for k in range(3):
        spark.createDataFrame(ordered[k * n // 3 : (k + 1) * n // 3], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = []
    q = build(stream).writeStream.outputMode(mode).foreachBatch(lambda b, i: got.extend(b.collect()))
    q.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    return got


@pytest.fixture(autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_admission(spark, tmp_path):
    wal = views.wal(spark, SF).withColumn("n", F.rank().over(__import__("pyspark").sql.Window.partitionBy("uid").orderBy("arrival")))
    rows = wal.filter("uid < 60").select("uid", F.col("n").cast("long").alias("arrival"), "idx", "term")
    got = streamed(spark, tmp_path, rows.drop("term"), "arrival", keyed.admission, "append")
    want = logops.admission(rows).collect()
    assert sorted((r.uid, r.arrival - 1, r.idx, r.status) for r in got) == sorted((r.uid, r.n, r.idx, r.status) for r in want)


def test_kv(spark, tmp_path):
    log = views.log(spark, SF).select("key", "idx", "op")
    got = streamed(spark, tmp_path, log, "idx", keyed.kv_state, "update")
    last = {r.key: r.idx for r in sorted(got, key=lambda r: r.seen)}
    assert {k: v for k, v in last.items() if v is not None} == {r.key: r.idx for r in machines.kv_state(log).collect()}


def test_exactly_once(spark, tmp_path):
    rows = views.fifo(spark, SF).select("producer", "seqno", "arrival")
    got = streamed(spark, tmp_path, rows, "arrival", keyed.exactly_once, "append")
    want = queues.exactly_once(rows).collect()
    assert sorted(tuple(r) for r in got) == sorted((r.producer, r.seqno, r.arrival, r.enqueued_at) for r in want)


def test_rate(spark, tmp_path):
    log = views.log(spark, SF).select("key", "idx", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000.0).alias("t"), "amount")
    got = streamed(spark, tmp_path, log, "idx", lambda s: keyed.leaky_rate(s, 6e7), "update")
    last = {r.key: r.value for r in got}
    for r in metrics.leaky_rate(log, "key", "idx", 6e7).collect():
        assert last[r.key] == pytest.approx(r.value)


def test_debounce(spark, tmp_path):
    log = views.log(spark, SF).select("key", "idx", F.col("ts").cast("timestamp").alias("ts"))
    got = streamed(spark, tmp_path, log, ["ts", "idx"], lambda s: keyed.debounce(s, 3 * 86_400), "append")
    want = logops.debounce(log, "key", "ts", 3 * 86_400).collect()
    assert sorted((r.key, r.idx) for r in got) == sorted((r.key, r.idx) for r in want) and len(want) < log.count()


def test_sessions(spark, tmp_path):
    log = views.log(spark, SF).select("key", F.col("ts").cast("timestamp").alias("ts"))
    got = streamed(spark, tmp_path, log, "ts", lambda s: keyed.sessions(s, "2 days", "1 second"), "append")
    want = log.groupBy("key", F.session_window("ts", "2 days").alias("s")).agg(F.count("*").alias("n")).select("key", "s.start", "s.end", "n").collect()
    closed = {tuple(r) for r in got}
    assert closed and closed <= {tuple(r) for r in want}  # the last ones are open when the stream ends


def test_windows(spark, tmp_path):
    log = views.log(spark, SF).select("key", F.col("ts").cast("timestamp").alias("ts"))
    got = streamed(spark, tmp_path, log, "ts", lambda s: keyed.per_second(s), "update")
    want = {r.second: r.ops for r in metrics.per_second(log).collect()}
    seen = {}
    for r in got:
        seen[r.second] = max(seen.get(r.second, 0), r.ops)
    assert seen == want


def test_log_table(spark, tmp_path):
    rows = views.log(spark, SF).select("uid", (F.col("idx") * 2).alias("write_seq"), "idx", "term", "type", F.col("payload").cast("binary").alias("payload"))
    log_table.append(rows, str(tmp_path / "wal"))
    assert log_table.read_log(spark, str(tmp_path / "wal"), 11, 20).count() == 10
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "wal")).schema).parquet(str(tmp_path / "wal")).drop("crc")
    log_table.commit_stream(stream, str(tmp_path / "bronze"), str(tmp_path / "ck")).awaitTermination()
    bronze = spark.read.parquet(str(tmp_path / "bronze"))
    assert bronze.count() == rows.count() and bronze.filter(~logops.checksum_ok(F.col("payload"), F.col("crc"))).count() == 0
    log_table.write_segments(rows, str(tmp_path / "silver"), 128)
    log_table.truncate_segments(spark, str(tmp_path / "silver"), 3)
    assert log_table.read_log(spark, str(tmp_path / "silver")).agg(F.min("idx")).first()[0] == 3 * 128 + 1
    log_table.write_snapshot(machines.kv_state(views.log(spark, SF)), {"idx": 9, "term": 1}, str(tmp_path / "snap"))
    assert log_table.read_snapshot(spark, str(tmp_path / "snap"))[0].first().idx == 9
