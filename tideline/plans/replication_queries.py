"""Written events, resends, follower appends, transactions, timers and snapshots' lives."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import counters
from tideline.operators import logops, machines, replication, scheduling, snapshots
from tideline.plans import views
from tideline.plans.registry import query


@query("""WITH b AS (SELECT *, write_seq // 2000 AS batch FROM writes),
    v AS (SELECT *, min(idx) OVER (PARTITION BY uid, batch ORDER BY write_seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM b)
    SELECT uid, batch, term, min(idx) AS lo, max(idx) AS hi, count(*) AS n FROM v, maxidx m WHERE (later IS NULL OR later > idx) AND idx >= m.n // 20
    GROUP BY uid, batch, term""")
def wal_written_ranges(spark, sf):
    floors = views.max_idx(spark, sf).select(F.lit("main").alias("uid"), F.expr("n div 20").alias("smallest"))
    return replication.written_in_batch(views.writes(spark, sf).withColumn("batch", F.floor(F.col("write_seq") / 2000)), floors)


@query("""WITH g AS (SELECT uid, generation, min(idx) AS lo, max(idx) AS hi FROM gens GROUP BY uid, generation),
    c AS (SELECT a.uid, a.generation, a.lo, least(a.hi, coalesce((SELECT min(b.lo) FROM g b WHERE b.uid = a.uid AND b.generation > a.generation) - 1, a.hi)) AS hi FROM g a)
    SELECT uid, generation, greatest(lo, n // 20) AS lo, hi FROM c, maxidx WHERE greatest(lo, n // 20) <= hi""")
def memtable_flush_ranges(spark, sf):
    floors = views.max_idx(spark, sf).select(F.lit("main").alias("uid"), F.expr("n div 20").alias("smallest"))
    return logops.flush_ranges(logops.generations(views.writes(spark, sf)), floors)


@query("""WITH w AS (SELECT DISTINCT uid, idx, term + CASE WHEN idx % 3 = 0 THEN 1 ELSE 0 END AS term FROM writes WHERE write_seq % 13 = 0)
    SELECT w.uid, w.idx, w.term, (SELECT max(generation) FROM gens g WHERE g.uid = w.uid AND g.idx = w.idx AND g.term = w.term) AS generation FROM w""")
def memtable_tid_for(spark, sf):
    wanted = views.writes(spark, sf).filter("write_seq % 13 = 0").select("uid", "idx", (F.col("term") + (F.col("idx") % 3 == 0).cast("long")).alias("term")).distinct()
    return logops.generation_of(wanted, logops.generations(views.writes(spark, sf)))


_OPS = """o AS (SELECT uid, idx AS seq, idx, CASE WHEN type = 'purchase' THEN 'commit' WHEN type = 'error' THEN 'abort'
    WHEN type = 'click' AND idx % 2 = 0 THEN 'begin' ELSE 'entry' END AS op FROM logs)"""


@query(f"""WITH {_OPS}, t AS (SELECT e.uid, e.seq, e.idx, max(b.seq) AS began FROM o e LEFT JOIN o b ON b.uid = e.uid AND b.op = 'begin' AND b.seq < e.seq
        WHERE e.op = 'entry' GROUP BY e.uid, e.seq, e.idx),
    y AS (SELECT t.*, (SELECT min(b.seq) FROM o b WHERE b.uid = t.uid AND b.op = 'begin' AND b.seq > t.began) AS again FROM t),
    x AS (SELECT y.uid, y.seq, y.idx, y.began, min(c.seq) AS ended FROM y LEFT JOIN o c ON c.uid = y.uid AND c.op IN ('commit', 'abort') AND c.seq > y.began
        AND (y.again IS NULL OR c.seq < y.again) GROUP BY y.uid, y.seq, y.idx, y.began)
    SELECT x.uid, x.seq, x.idx, CASE WHEN began IS NULL OR ended < x.seq THEN 'committed' WHEN ended IS NULL THEN 'staged'
    WHEN o.op = 'commit' THEN 'committed' ELSE 'aborted' END AS status FROM x LEFT JOIN o ON o.uid = x.uid AND o.seq = x.ended""")
def tx_entries(spark, sf):
    op = F.when(F.col("type") == "purchase", "commit").when(F.col("type") == "error", "abort").when((F.col("type") == "click") & (F.col("idx") % 2 == 0), "begin").otherwise("entry")
    return logops.staged(views.logs(spark, sf).select("uid", F.col("idx").alias("seq"), "idx", op.alias("op")))


@query("SELECT uid, max(idx) AS idx FROM logs WHERE key % 7 = 0 GROUP BY uid")
def lol_search(spark, sf):
    return logops.newest_where(views.logs(spark, sf), F.col("key") % 7 == 0)


@query("SELECT uid, idx, key FROM logs l WHERE idx > coalesce((SELECT max(idx) FROM logs s WHERE s.uid = l.uid AND s.op <> 'put'), 0)")
def lol_take_while(spark, sf):
    return logops.take_while(views.logs(spark, sf), F.col("op") == "put").select("uid", "idx", "key")


@query("SELECT uid, idx, seq, type FROM logs WHERE idx % 3 = 0 AND type IN ('click', 'purchase')")
def log_read_commands(spark, sf):
    logs = views.logs(spark, sf)
    wanted = logs.filter("idx % 3 = 0").select("uid", "idx", F.col("idx").alias("pos"))
    return logops.read_commands(logs, wanted, ["click", "purchase"]).select("uid", "idx", "seq", "type")


# Every tenth log has been overtaken by a snapshot, every third has older indexes pending,
# every fourth hears of a term that its last entry does not have.
_WRITTEN = """l AS (SELECT logs.* FROM logs JOIN heads USING (uid) WHERE NOT (logs.k % 10 = 7 AND idx >= n // 2)),
    e AS (SELECT uid, h.k, n // 2 AS lo, n AS hi, (SELECT term FROM logs t WHERE t.uid = h.uid AND t.idx = h.n) - CASE WHEN k % 4 = 1 THEN 1 ELSE 0 END AS term FROM heads h),
    p AS (SELECT logs.uid, idx FROM logs JOIN heads h ON h.uid = logs.uid WHERE idx >= n // 2 - CASE WHEN h.k % 3 = 0 THEN 5 ELSE 0 END)"""


@query(f"""WITH {_WRITTEN}, s AS (SELECT e.*, (SELECT max(idx) FROM l WHERE l.uid = e.uid AND idx BETWEEN lo AND hi AND l.term = e.term) AS good,
    (SELECT min(idx) FROM p WHERE p.uid = e.uid) AS first FROM e),
    t AS (SELECT *, CASE WHEN k % 10 = 7 THEN 'below_snapshot' WHEN good IS NULL THEN 'no_match' WHEN first < lo THEN 'resend' ELSE 'written' END AS status FROM s)
    SELECT uid, status, CASE WHEN status = 'written' THEN good END AS last_written,
    (SELECT count(*) FROM p WHERE p.uid = t.uid AND idx > CASE status WHEN 'written' THEN good WHEN 'below_snapshot' THEN hi ELSE -1 END) AS pending,
    CASE WHEN status = 'resend' THEN first END AS resend_from FROM t""")
def written_events(spark, sf):
    logs, heads = views.logs(spark, sf), views.heads(spark, sf)
    all_of = logs.join(heads.drop("k"), "uid")
    left = all_of.filter("not (k % 10 = 7 and idx >= n div 2)").select("uid", "idx", "term")
    ends = logs.select("uid", F.col("idx").alias("n"), "term")
    events = heads.join(ends, ["uid", "n"]).select("uid", F.expr("n div 2").alias("lo"), F.col("n").alias("hi"), (F.col("term") - (F.col("k") % 4 == 1).cast("long")).alias("term"))
    pending = all_of.filter("idx >= n div 2 - case when k % 3 = 0 then 5 else 0 end").select("uid", "idx")
    snaps = heads.select("uid", F.when(F.col("k") % 10 == 7, F.col("n")).otherwise(0).alias("snap"))
    return replication.written(events, left, pending, snaps)


@query("""WITH p AS (SELECT l.uid, idx, term FROM logs l JOIN heads h ON h.uid = l.uid WHERE idx > n * 9 // 10 AND idx % 4 <> 1 AND idx > n * 9 // 10 + h.k % 3)
    SELECT p.uid, idx, coalesce(lag(idx) OVER (PARTITION BY p.uid ORDER BY idx), n * 9 // 10) AS prev, term FROM p JOIN heads USING (uid)""")
def resend_entries(spark, sf):
    logs, heads = views.logs(spark, sf), views.heads(spark, sf)
    pending = logs.join(heads.drop("k"), "uid").filter("idx > n * 9 div 10 and idx % 4 <> 1").select("uid", "idx")
    starts = heads.select("uid", F.expr("n * 9 div 10 + 1 + k % 3").alias("resend_from"), F.expr("n * 9 div 10").alias("prev_idx"))
    return replication.resends(pending, logs, starts)


# What a log is sent depends on its number: see the cases of ``k % 8``.
_RPC = """r AS (SELECT uid, k % 8 AS c, n, n - CASE k % 8 WHEN 0 THEN -5 WHEN 7 THEN 6 ELSE 10 END AS prev_idx FROM heads),
    q AS (SELECT r.*, coalesce(l.term, 0) + CASE WHEN c = 1 THEN 1 ELSE 0 END AS prev_term, 5 AS term, CASE WHEN c = 2 THEN 6 ELSE 5 END AS current_term, l.idx IS NULL AS lacks
        FROM r LEFT JOIN logs l ON l.uid = r.uid AND l.idx = prev_idx),
    e AS (SELECT q.uid, prev_idx + i AS idx, coalesce(l.term, 1) + CASE WHEN c IN (3, 4) AND i >= 4 THEN 1 ELSE 0 END AS term
        FROM q CROSS JOIN range(1, 7) t(i) LEFT JOIN logs l ON l.uid = q.uid AND l.idx = prev_idx + i WHERE c <> 5)"""
_REPLY = """s AS (SELECT q.*, CASE WHEN c = 2 THEN 'stale_term' WHEN lacks THEN 'missing' WHEN c = 1 THEN 'term_mismatch' WHEN c IN (3, 4) THEN 'appended'
    WHEN c = 5 THEN 'reset' WHEN c = 7 THEN 'validated' ELSE 'partly' END AS status FROM q)"""


def _append(spark, sf):
    logs, heads = views.logs(spark, sf).select("uid", "idx", "term"), views.heads(spark, sf)
    c = F.col("k") % 8
    r = heads.select("uid", c.alias("c"), (F.col("n") - F.when(c == 0, -5).when(c == 7, 6).otherwise(10)).alias("prev_idx"))
    at = logs.select("uid", F.col("idx").alias("prev_idx"), "term")
    q = r.join(at, ["uid", "prev_idx"], "left").withColumn("prev_term", F.coalesce("term", F.lit(0).cast("long")) + (F.col("c") == 1).cast("long"))
    q = q.withColumns({"term": F.lit(5).cast("long"), "current_term": F.when(F.col("c") == 2, 6).otherwise(5).cast("long")})
    e = q.filter("c <> 5").select("uid", "c", "prev_idx", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("i"))
    e = e.select("uid", "c", "i", (F.col("prev_idx") + F.col("i")).alias("idx")).join(logs, ["uid", "idx"], "left")
    later = (F.col("c").isin(3, 4) & (F.col("i") >= 4)).cast("long")
    e = e.select("uid", "idx", (F.coalesce("term", F.lit(1).cast("long")) + later).alias("term"))
    return replication.follower_append(logs, q, e)


@query(f"""WITH {_RPC}, {_REPLY} SELECT uid, status, CASE WHEN status IN ('appended', 'partly', 'validated') THEN prev_idx + 6 WHEN status = 'reset' THEN prev_idx END AS last_idx FROM s""")
def follower_reply(spark, sf):
    return _append(spark, sf)[0]


@query(f"""WITH {_RPC}, {_REPLY} SELECT l.uid, idx, l.term FROM logs l JOIN s ON s.uid = l.uid
    WHERE idx < CASE status WHEN 'appended' THEN prev_idx + 4 WHEN 'reset' THEN prev_idx + 1 ELSE n + 1 END
    UNION ALL SELECT e.uid, idx, e.term FROM e JOIN s ON s.uid = e.uid WHERE status = 'appended' AND idx >= prev_idx + 4""")
def follower_log(spark, sf):
    return _append(spark, sf)[1]


@query("""WITH r AS (SELECT member, match_index AS m, next_index AS x, match_index + member % 7 - 3 AS last FROM peers),
    j AS (SELECT r.*, l.term AS own, l.term + CASE WHEN member % 3 = 0 THEN 1 ELSE 0 END AS told FROM r LEFT JOIN log l ON l.idx = last)
    SELECT member, CASE WHEN member % 4 = 0 OR own IS NULL THEN m WHEN own = told AND last >= m OR last < m THEN last ELSE m END AS match_index,
    CASE WHEN member % 4 = 0 THEN x WHEN own IS NULL OR own = told AND last >= m THEN last + 2 WHEN last < m THEN last + 1
    ELSE greatest(least(x - 1, last), m + 1) END AS next_index FROM j""")
def leader_back_off(spark, sf):
    peers, log = views.peers(spark, sf), views.log(spark, sf).select("idx", "term")
    last = peers.filter("member % 4 <> 0").select("member", (F.col("match_index") + F.col("member") % 7 - 3).alias("last_idx"))
    known = last.join(log.withColumnRenamed("idx", "last_idx"), "last_idx", "left")
    replies = known.select("member", "last_idx", (F.col("term") + (F.col("member") % 3 == 0).cast("long")).alias("last_term"), (F.col("last_idx") + 2).alias("next"))
    return replication.back_off(peers.select("member", "match_index", "next_index"), replies, log)


@query("""WITH s AS (SELECT key AS uid, idx % 2 AS name, idx, epoch_us(ts) // 1000 AS ms, CASE WHEN type <> 'error' THEN 86400000 * (1 + idx % 3) END AS after FROM log),
    n AS (SELECT *, lead(ms) OVER (PARTITION BY uid, name ORDER BY ms, idx) AS following FROM s)
    SELECT uid, name, idx AS set_at, ms + after AS fires_at FROM n WHERE ms + after <= (SELECT max(ms) FROM s) AND (following IS NULL OR following > ms + after)""")
def timers_fired(spark, sf):
    log = views.log(spark, sf).withColumn("ms", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000))
    now = log.agg(F.max("ms")).first()[0] or 0
    after = F.when(F.col("type") != "error", 86_400_000 * (1 + F.col("idx") % 3))
    return machines.fired_timers(log.select(F.col("key").alias("uid"), (F.col("idx") % 2).alias("name"), "idx", "ms", after.alias("after")), F.lit(now))


_RULES = {  # kind: condition and target, as SQL of either engine
    "reply": ("op = 'put'", "key"),
    "send_msg": ("type = 'error'", "'monitor'"),
    "mod_call": ("idx % 50 = 0", "'audit'"),
    "append": ("type = 'purchase'", "'audit'"),
    "try_append": ("type = 'purchase' AND idx % 3 = 0", "'audit'"),
    "log": ("idx % 20 = 0", "idx - 1"),
    "timer": ("type = 'click' AND idx % 10 = 0", "'tick'"),
    "monitor": ("type = 'view' AND idx % 11 = 0", "key"),
    "demonitor": ("type = 'error' AND idx % 2 = 0", "key"),
    "aux": ("idx % 33 = 0", "'eval'"),
    "release_cursor": ("idx % 100 = 0", "idx"),
    "checkpoint": ("idx % 64 = 0", "idx"),
}
_OWN = ("log", "release_cursor", "checkpoint")


@query(" UNION ALL ".join(f"SELECT uid, idx, '{k}' AS kind, ({t})::VARCHAR AS target FROM log WHERE {c}" + ("" if k in _OWN else " AND key % 3 <> 0") for k, (c, t) in _RULES.items()))
def effects_of_rules(spark, sf):
    rules = {k: (F.expr(c), F.expr(t)) for k, (c, t) in _RULES.items()}
    return machines.effects_where(views.log(spark, sf), rules, F.col("key") % 3 != 0)


@query("""WITH c AS (SELECT key % 20 AS pid, (idx - 1) // 128 + 1 AS batch, idx FROM log, maxidx WHERE type = 'click' AND idx <= n * 4 // 5 // 128 * 128)
    SELECT pid, batch, count(*) AS n, string_agg(idx::VARCHAR, ',' ORDER BY idx) AS correlations FROM c GROUP BY pid, batch""")
def pipelined_replies(spark, sf):
    n = views.max_idx(spark, sf).first()["n"] or 0
    applied = views.segments(spark, sf).filter(F.col("hi") <= n * 4 // 5 // 128 * 128).select("uid", F.col("segment").alias("batch"), "lo", "hi")
    commands = views.log(spark, sf).filter("type = 'click'").select("uid", "idx", (F.col("key") % 20).alias("pid"), F.col("idx").alias("correlation"))
    return machines.pipelined(commands, applied)


_LIFE = "e AS (SELECT uid, seq, CASE type WHEN 'click' THEN 'begin' WHEN 'purchase' THEN 'complete' ELSE 'abort' END AS event, idx // 4 AS idx FROM logs WHERE type <> 'view')"


@query(f"""WITH {_LIFE}, d AS (SELECT uid, max(idx) AS current FROM e WHERE event = 'complete' GROUP BY uid),
    o AS (SELECT b.uid, b.idx, max(b.seq) AS begun FROM e b WHERE event = 'begin' AND NOT EXISTS
        (SELECT 1 FROM e x WHERE x.uid = b.uid AND x.idx = b.idx AND x.event <> 'begin' AND x.seq > b.seq) GROUP BY b.uid, b.idx)
    SELECT u.uid, d.current, (SELECT arg_max(o.idx, begun) FROM o WHERE o.uid = u.uid AND (d.current IS NULL OR o.idx > d.current)) AS pending
    FROM (SELECT DISTINCT uid FROM e) u LEFT JOIN d ON d.uid = u.uid""")
def snapshot_lifecycle(spark, sf):
    event = F.when(F.col("type") == "click", "begin").when(F.col("type") == "purchase", "complete").otherwise("abort")
    return snapshots.lifecycle(views.logs(spark, sf).filter("type <> 'view'").select("uid", "seq", event.alias("event"), F.floor(F.col("idx") / 4).alias("idx")))


@query("SELECT l.uid, idx FROM logs l JOIN heads h ON h.uid = l.uid WHERE idx % 17 = 0 AND idx <= n // 2")
def checkpoints_stale(spark, sf):
    snap = views.heads(spark, sf).select("uid", F.expr("n div 2").alias("snap"))
    return snapshots.stale_checkpoints(views.logs(spark, sf).filter("idx % 17 = 0").select("uid", "idx"), snap)


@query("""SELECT h.uid, n AS idx FROM heads h LEFT JOIN (SELECT uid, max(idx) AS c FROM logs WHERE idx % 17 = 0 AND k % 9 <> 0 GROUP BY uid) x ON x.uid = h.uid
    WHERE n - coalesce(c, 0) >= 9""")
def recovery_checkpoint(spark, sf):
    marks = views.logs(spark, sf).filter("idx % 17 = 0 and k % 9 <> 0").select("uid", "idx")
    return snapshots.recovery_checkpoint(views.heads(spark, sf).select("uid", F.col("n").alias("last_applied")), marks, 9)


@query("""SELECT idx, ((length(payload) + list_sum(list_transform(range(1, length(payload) + 1), lambda i: (length(payload) - i + 1) * ascii(payload[i])))) % 65521 * 65536
    + (1 + list_sum(list_transform(range(1, length(payload) + 1), lambda i: ascii(payload[i])))) % 65521)::BIGINT AS checksum FROM log""")
def wal_adler32(spark, sf):
    return views.log(spark, sf).select("idx", logops.adler32(F.col("payload").cast("binary")).alias("checksum"))


@query("SELECT uid, segment, CASE WHEN segment % 7 = 0 THEN 0.5 ELSE least(1.0, bytes / 8192.0) END::DOUBLE AS ratio FROM segments")
def wal_fill_ratio(spark, sf):
    size = F.when(F.col("segment") % 7 != 0, F.col("bytes"))
    return views.segments(spark, sf).select("uid", "segment", logops.fill_ratio(size, F.lit(8192)).alias("ratio"))


@query("""WITH RECURSIVE s AS (
    SELECT uid, idx, term, arrival, idx AS last, false AS stopped, 'ok' AS status FROM wal WHERE arrival = 1 UNION ALL
    SELECT w.uid, w.idx, w.term, w.arrival, CASE WHEN NOT stopped AND w.idx = s.last + 1 THEN w.idx ELSE s.last END, stopped OR w.idx > s.last + 1,
           CASE WHEN stopped THEN 'stopped' WHEN w.idx = s.last + 1 THEN 'ok' WHEN w.idx <= s.last THEN 'overwriting' ELSE 'unexpected_sparse' END
    FROM s JOIN wal w ON w.uid = s.uid AND w.arrival = s.arrival + 1)
    SELECT uid, idx, term, status FROM s""")
def memtable_dense_insert(spark, sf):
    return logops.dense_insert_status(views.wal(spark, sf).select("uid", "idx", "term", "arrival")).select("uid", "idx", "term", "status")


@query("""SELECT cluster, member, row_number() OVER (PARTITION BY cluster ORDER BY status <> 'normal', member) AS rank FROM peers""")
def members_local_first(spark, sf):
    return scheduling.local_rank(views.peers(spark, sf), "cluster", F.col("status") == "normal", "member").select("cluster", "member", "rank")


@query("SELECT uid, idx, idx % 4 AS worker FROM logs WHERE op = 'put'")
def partitioned_work(spark, sf):
    return scheduling.partitioned(views.logs(spark, sf).filter("op = 'put'"), "idx", 4).select("uid", "idx", "worker")


@query("""SELECT uid, n - 8 AS resend_from FROM heads WHERE k % 4 <> 0 AND k % 3 <> 1 AND k % 5 <> 2 AND 100000 > 90000 + k * 300 + 5000""")
def log_tick(spark, sf):
    """The writer has restarted for most logs, some have none, some wrote just now, some have
    cached nothing."""
    h, k = views.heads(spark, sf), F.col("k")
    logs = h.select(
        "uid", (F.col("n") - 9).alias("last_written"), (90_000 + k * 300).alias("last_write_at"), F.lit(1).alias("writer"),
        F.when(k % 4 == 0, 1).when(k % 5 != 2, 2).alias("current_writer"),
    )
    cached = views.logs(spark, sf).join(h.drop("k"), "uid").filter("idx > n - 20 and not (k % 3 = 1 and idx = n - 8)")
    return replication.tick(logs, cached, 100_000, 5000)


@query("""WITH s AS (SELECT uid, n, n // 2 AS snap FROM heads)
    SELECT s.uid, min(l.idx) FILTER (l.idx > snap OR l.key % 9 = 0) AS first, count(*) FILTER (l.idx > snap OR l.key % 9 = 0) AS entries,
    count(*) FILTER (l.idx > snap AND l.idx > n - 30 AND l.idx % 2 = 0) AS pending, count(*) FILTER (l.idx > snap AND l.idx % 7 = 0) AS checkpoints
    FROM s JOIN logs l ON l.uid = s.uid GROUP BY s.uid""")
def snapshot_written(spark, sf):
    logs, heads = views.logs(spark, sf), views.heads(spark, sf)
    pending = logs.join(heads.drop("k"), "uid").filter("idx > n - 30 and idx % 2 = 0")
    return replication.snapshot_written(logs, logs.filter("key % 9 = 0"), pending, logs.filter("idx % 7 = 0"), heads.select("uid", F.expr("n div 2").alias("snap")))


@query("""WITH b AS (SELECT key % 50 AS cluster, arg_max(key, idx) AS leader FROM log WHERE type = 'view' AND key % 50 <> 13 GROUP BY 1)
    SELECT uid, idx, CASE WHEN leader IS NULL THEN 'noleader' WHEN leader = key THEN 'appended' ELSE 'redirect' END AS outcome, leader AS member
    FROM log LEFT JOIN b ON b.cluster = key % 50""")
def commands_routed(spark, sf):
    log, cluster = views.log(spark, sf), F.col("key") % 50
    leaders = log.filter("type = 'view' and key % 50 <> 13").groupBy(cluster.alias("cluster")).agg(F.max_by("key", "idx").alias("leader"))
    return replication.routed(log.select("uid", "idx", cluster.alias("cluster"), F.col("key").alias("to")), leaders)


@query("SELECT l.uid, l.idx, s.segment, l.key FROM log l JOIN segments s ON l.idx BETWEEN s.lo AND s.hi, maxidx m WHERE l.idx % 11 = 0 AND s.segment % 4 <> 0")
def log_exec_plan(spark, sf):
    log = views.log(spark, sf)
    return logops.exec_plan(log.filter("idx % 11 = 0").select("uid", "idx"), views.segments(spark, sf).filter("segment % 4 <> 0"), log.select("uid", "idx", "key"))


@query("SELECT l.uid, count(*) AS n, sum(key)::BIGINT AS total FROM logs l JOIN heads h ON h.uid = l.uid WHERE h.k % 2 = 0 OR idx > n // 2 GROUP BY l.uid")
def log_fold_above_snapshot(spark, sf):
    snaps = views.heads(spark, sf).filter("k % 2 <> 0").select("uid", F.expr("n div 2").alias("snap"))
    return logops.above_snapshot(views.logs(spark, sf), snaps).groupBy("uid").agg(F.count("*").alias("n"), F.sum("key").alias("total"))


@query("""WITH m AS (SELECT key AS uid, min(epoch_us(ts)) // 1000 AS a, max(epoch_us(ts)) // 1000 AS b FROM log GROUP BY key)
    SELECT uid, a + 86400000 * i AS ms FROM m, range(1, 4000) t(i) WHERE a + 86400000 * i <= b""")
def machine_ticks(spark, sf):
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    return machines.ticks(views.log(spark, sf).groupBy(F.col("key").alias("uid")).agg(F.min(ms).alias("started"), F.max(ms).alias("stopped")), 86_400_000)


@query("""SELECT l.uid, max(idx) AS last_index, arg_max(term, idx) AS last_term, max(term) AS current_term, max(n) - 3 AS last_applied,
    CASE WHEN max(h.k) % 2 = 0 THEN max(n) // 2 END AS snapshot_index, max(n) - 3 - CASE WHEN max(h.k) % 2 = 0 THEN max(n) // 2 ELSE 0 END AS snapshot_age,
    max(idx) - CASE WHEN max(h.k) % 2 = 0 THEN max(n) // 2 ELSE 0 END AS entries_above FROM logs l JOIN heads h ON h.uid = l.uid GROUP BY l.uid""")
def aux_overview(spark, sf):
    heads = views.heads(spark, sf)
    return machines.aux_overview(views.logs(spark, sf), heads.select("uid", (F.col("n") - 3).alias("last_applied")), heads.filter("k % 2 = 0").select("uid", F.expr("n div 2").alias("snap")))


_FIELDS = [*counters.LOG, *counters.SERVER, *counters.METRICS]


@query(f"""WITH f AS (SELECT unnest({_FIELDS!r}) AS field), s AS (SELECT uid AS name, CASE k % 3 WHEN 0 THEN 'commands' WHEN 1 THEN 'term' ELSE 'unknown' END AS field, count(*)::DOUBLE AS value FROM logs GROUP BY uid, k)
    SELECT n.name, f.field, coalesce(s.value, 0) AS value FROM (SELECT DISTINCT name FROM s) n CROSS JOIN f LEFT JOIN s ON s.name = n.name AND s.field = f.field""")
def counter_catalogue(spark, sf):
    field = F.when(F.col("k") % 3 == 0, "commands").when(F.col("k") % 3 == 1, "term").otherwise("unknown")
    samples = views.logs(spark, sf).groupBy(F.col("uid").alias("name"), field.alias("field")).agg(F.count("*").cast("double").alias("value"))
    return counters.with_defaults(samples, counters.catalogue(spark))
