"""Recovery, hot-table bookkeeping, parked queries, workload and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import logops, machines, metrics
from tideline.plans import views
from tideline.plans.machine_queries import _KV, _REPLICAS, _replicas
from tideline.plans.registry import query


@query("""WITH e AS (SELECT max(write_seq) AS last FROM writes), w AS (SELECT writes.* FROM writes, e, maxidx WHERE write_seq <> last AND idx >= n // 20),
    v AS (SELECT *, min(idx) OVER (PARTITION BY uid ORDER BY write_seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM w)
    SELECT uid, idx, term, write_seq FROM v WHERE later IS NULL OR later > idx""")
def wal_recover(spark, sf):
    """The last record is torn, and a twentieth of the log is no longer live."""
    rows = views.writes(spark, sf).withColumn("payload", F.col("payload").cast("binary"))
    good, end = F.crc32("payload"), F.broadcast(rows.agg(F.max("write_seq").alias("last")))
    rows = rows.crossJoin(end).withColumn("crc", F.when(F.col("write_seq") == F.col("last"), good + 1).otherwise(good)).drop("last")
    main = views.max_idx(spark, sf).select(F.lit("main").alias("uid"), F.expr("n div 20").alias("smallest"))
    return logops.recover(rows, main, main).select("uid", "idx", "term", "write_seq")


@query("""WITH RECURSIVE s AS (
    SELECT uid, idx, term, arrival, idx AS last, 'ok' AS status FROM wal WHERE arrival = 1 UNION ALL
    SELECT w.uid, w.idx, w.term, w.arrival, CASE WHEN w.idx > s.last AND w.idx - 1 = s.last THEN w.idx ELSE s.last END,
           CASE WHEN w.idx <= s.last THEN 'overwriting' WHEN w.idx - 1 = s.last THEN 'ok' ELSE 'gap_detected' END
    FROM s JOIN wal w ON w.uid = s.uid AND w.arrival = s.arrival + 1)
    SELECT uid, idx, term, status FROM s""")
def memtable_insert(spark, sf):
    rows = views.wal(spark, sf).select("uid", "idx", "term", "arrival", (F.col("idx") - 1).alias("prev_idx"))
    return logops.insert_status(rows).select("uid", "idx", "term", "status")


@query("""WITH kv AS (SELECT uid, key, max(idx) AS idx FROM logs GROUP BY uid, key HAVING arg_max(op, idx) = 'put')
    SELECT uid, kv.key, idx, payload FROM kv JOIN logs USING (uid, idx)""")
def kv_get_of_many_logs(spark, sf):
    logs = views.logs(spark, sf)
    return machines.kv_read(machines.kv_state(logs, ["uid"]), logs.select("uid", "idx", "key", "payload")).select("uid", "key", "idx", "payload")


@query("""WITH w AS (SELECT uid, idx, idx AS pos FROM logs WHERE idx % 3 = 0), j AS (SELECT w.uid, w.pos, w.idx, l.seq FROM w LEFT JOIN
    (SELECT * FROM logs WHERE seq % 101 <> 0) l USING (uid, idx)), s AS (SELECT uid, min(pos) FILTER (seq IS NULL) AS stop FROM j GROUP BY uid)
    SELECT uid, pos, idx, seq FROM j JOIN s USING (uid) WHERE stop IS NULL OR pos < stop""")
def sparse_read_of_many_logs(spark, sf):
    """Every third index of each log up to the first hole."""
    logs = views.logs(spark, sf)
    wanted = logs.filter("idx % 3 = 0").select("uid", "idx", F.col("idx").alias("pos"))
    return logops.sparse_read(logs.filter("seq % 101 <> 0"), wanted, "stop").select("uid", "pos", "idx", "seq")


@query("""WITH l AS (SELECT key AS uid, idx FROM log), f AS (SELECT key AS uid, max(idx) - 700 AS t FROM log GROUP BY key)
    SELECT l.uid, count(*) FILTER (coalesce(idx <= t, false)) AS deleted, count(*) FILTER (NOT coalesce(idx <= t, false)) AS kept,
    min(idx) FILTER (NOT coalesce(idx <= t, false)) AS first, count(*) FILTER (coalesce(idx <= t, false)) * 2 > count(*) AS by_range
    FROM l LEFT JOIN f ON l.uid = f.uid GROUP BY l.uid""")
def memtable_evict(spark, sf):
    rows = views.log(spark, sf).select(F.col("key").alias("uid"), "idx")
    flushed = rows.groupBy("uid").agg((F.max("idx") - 700).alias("flushed_to"))
    return logops.evict(rows, flushed)


@query("""WITH b AS (SELECT *, coalesce((lag(idx) OVER (PARTITION BY uid ORDER BY write_seq) >= idx)::INT, 0) AS back FROM writes)
    SELECT uid, write_seq, idx, sum(back) OVER (PARTITION BY uid ORDER BY write_seq)::BIGINT AS generation FROM b""")
def memtable_generations(spark, sf):
    return logops.generations(views.writes(spark, sf), 1024).select("uid", "write_seq", "idx", "generation")


@query("""SELECT q.uid, q.idx, p.idx AS runs_at FROM (SELECT uid, idx FROM log WHERE type = 'click') q
    ASOF LEFT JOIN (SELECT uid, idx FROM log WHERE type = 'error') p ON q.uid = p.uid AND q.idx <= p.idx""")
def parked_queries(spark, sf):
    log = views.log(spark, sf)
    return logops.parked_until(log.filter("type = 'click'").select("uid", "idx"), log.filter("type = 'error'").select("uid", "idx"), 1024)


@query(f"""WITH {_REPLICAS}, {_KV}, w AS (SELECT member, key, kv.idx AS expected FROM kv, range(1, 4) t(member)),
    d AS (SELECT coalesce(m.member, w.member) AS member, m.idx, expected FROM m FULL JOIN w ON m.member = w.member AND m.key = w.key WHERE m.idx IS DISTINCT FROM expected)
    SELECT member, CASE WHEN idx IS NULL THEN 'missing' WHEN expected IS NULL THEN 'extra' ELSE 'stale' END AS pattern, count(*) AS n FROM d GROUP BY ALL""")
def replica_patterns(spark, sf):
    return machines.difference_patterns(_replicas(spark, sf), machines.kv_state(views.log(spark, sf)))


@query("SELECT uid, idx, idx AS enqueued FROM log WHERE idx % 256 = 0")
def shadow_states(spark, sf):
    return machines.shadow_points(views.log(spark, sf).select("uid", "idx"), 256)


@query("""WITH g AS (SELECT key, type AS field, arg_max(amount, idx) AS v FROM log GROUP BY key, type),
    w AS (SELECT key, max(v) FILTER (field = 'click') AS click, max(v) FILTER (field = 'view') AS "view" FROM g GROUP BY key)
    SELECT c_custkey::VARCHAR AS name, CASE WHEN coalesce(click, "view") IS NULL THEN 'noproc' ELSE 'running' END AS state, click, "view"
    FROM customer LEFT JOIN w ON key = c_custkey""")
def key_metrics(spark, sf):
    samples = views.log(spark, sf).select(F.col("key").cast("string").alias("name"), F.col("type").alias("field"), F.col("amount").alias("value"), F.col("idx").alias("seq"))
    members = views.read(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("name"))
    return metrics.key_metrics(members, samples, ["click", "view"])


@query("SELECT cluster, member, status FROM peers WHERE voter")
def state_voters(spark, sf):
    return views.peers(spark, sf).filter("voter").select("cluster", "member", "status")


@query("""SELECT idx, CASE WHEN idx % 4 < 3 THEN true ELSE idx % 8 = 3 END AS valid FROM log""")
def reply_modes(spark, sf):
    k = F.col("idx") % 4
    mode = F.when(k == 0, "after_log_append").when(k == 1, "await_consensus").when(k == 2, F.concat(F.lit("notify:"), "idx"))
    mode = mode.otherwise(F.when(F.col("idx") % 8 == 3, "noreply").otherwise("sometime"))
    return views.log(spark, sf).select("idx", machines.reply_mode_ok(mode).alias("valid"))
