"""Snapshots, rates, status views and queues."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.operators import fifo, metrics, queues, snapshots
from tideline.plans import views
from tideline.plans.registry import query


def _uid(df, **cols):
    return df.select(F.lit("main").alias("uid"), *(c.alias(n) for n, c in cols.items()))


@query("""WITH r AS (SELECT uid, idx FROM log WHERE idx % 5 = 0) SELECT r.uid, r.idx, c.idx AS checkpoint FROM r ASOF JOIN ckpt c ON r.uid = c.uid AND r.idx >= c.idx""")
def checkpoint_promote_asof(spark, sf):
    return snapshots.promotable(views.log(spark, sf).filter("idx % 5 = 0").select("uid", "idx"), views.checkpoints(spark, sf), 1024)


@query("SELECT uid, idx, term, idx <= snap AS outdated FROM ckpt, snapidx")
def checkpoint_outdated(spark, sf):
    snap = _uid(views.snapshot_idx(spark, sf), snap=F.col("snap"))
    return snapshots.split(views.checkpoints(spark, sf), snap).select("uid", "idx", "term", "outdated")


@query("""WITH c AS (SELECT key::VARCHAR AS uid, idx FROM log), n AS (SELECT uid, idx, count(*) OVER (PARTITION BY uid) AS n,
    lead(idx, 1) OVER (PARTITION BY uid ORDER BY idx) AS mid, lead(idx, 2) OVER (PARTITION BY uid ORDER BY idx) AS third FROM c)
    SELECT uid, arg_min(mid, idx) AS delete_idx FROM n WHERE n > 10 AND third - idx < 40 * least(8, n // 10) GROUP BY uid""")
def checkpoint_thinning(spark, sf):
    c = views.log(spark, sf).select(F.col("key").cast("string").alias("uid"), "idx")
    return snapshots.thin(c, 10, 40)


@query("""WITH RECURSIVE q AS (SELECT key::VARCHAR AS uid, idx, row_number() OVER (PARTITION BY key ORDER BY idx) AS k FROM log),
    s AS (SELECT uid, k, idx, idx > 100 AS go, CASE WHEN idx > 100 THEN idx ELSE 0 END AS last FROM q WHERE k = 1
        UNION ALL SELECT q.uid, q.k, q.idx, q.idx > s.last + 100, CASE WHEN q.idx > s.last + 100 THEN q.idx ELSE s.last END
        FROM s JOIN q ON q.uid = s.uid AND q.k = s.k + 1) SELECT uid, idx FROM s WHERE go""")
def snapshot_schedule(spark, sf):
    return snapshots.schedule(views.log(spark, sf).select(F.col("key").cast("string").alias("uid"), "idx"), 100)


@query("SELECT uid, max(idx) AS idx, arg_max(term, idx) AS term FROM ckpt WHERE idx % 4 <> 0 GROUP BY uid")
def snapshot_recover(spark, sf):
    return snapshots.newest_valid(views.checkpoints(spark, sf).withColumn("valid", F.col("idx") % 4 != 0))


@query("SELECT 'main' AS uid, snap, coalesce((SELECT min(idx) FROM live), snap + 1) AS smallest FROM snapidx")
def smallest_live_index(spark, sf):
    return snapshots.smallest_live(_uid(views.snapshot_idx(spark, sf), snap=F.col("snap")), views.live(spark, sf))


@query("""WITH c AS (SELECT key AS uid, idx, CASE WHEN idx % 3 = 0 THEN idx - 5 END AS w, idx % 2 = 0 AS ns FROM log),
    p AS (SELECT key AS uid, max(idx) - 3 AS last_written, key % 2 AS sending FROM log GROUP BY key),
    n AS (SELECT c.uid, max(idx) AS idx, arg_max((w IS NULL OR w <= last_written) AND (NOT ns OR sending = 0), idx) AS ready FROM c JOIN p ON c.uid = p.uid GROUP BY c.uid)
    SELECT uid, idx, ready FROM n""")
def release_cursor(spark, sf):
    log = views.log(spark, sf)
    cursors = log.select(F.col("key").alias("uid"), "idx", F.when(F.col("idx") % 3 == 0, F.col("idx") - 5).alias("written_cond"), (F.col("idx") % 2 == 0).alias("no_sends"))
    progress = log.groupBy(F.col("key").alias("uid")).agg((F.max("idx") - 3).alias("last_written")).withColumn("sending", F.col("uid") % 2)
    return snapshots.release_ready(cursors, progress)


@query("""SELECT 'main' AS uid, q.idx, q.term, coalesce(q.idx <= floor(n * 0.8) AND q.term = l.term, false) AS ready
    FROM (SELECT idx + 7 AS idx, term FROM log WHERE idx % 10 = 3) q CROSS JOIN maxidx LEFT JOIN log l ON l.idx = q.idx""")
def conditional_query_ready(spark, sf):
    log = views.log(spark, sf)
    asked = log.filter("idx % 10 = 3").select("uid", (F.col("idx") + 7).alias("idx"), "term")
    applied = _uid(views.max_idx(spark, sf), last_applied=F.floor(F.col("n") * 0.8))
    return snapshots.query_ready(asked, log, F.broadcast(applied))


@query("SELECT uid, idx, (row_number() OVER (PARTITION BY uid ORDER BY idx) - 1) // 16 AS chunk FROM live, maxidx WHERE idx > n // 20")
def snapshot_pre_phase(spark, sf):
    return snapshots.chunks_to_send(views.live(spark, sf), (views.max_idx(spark, sf).first()["n"] or 0) // 20)


_RATE = """SELECT key, round(v, 6) AS value, round(v / 60000000.0 * 1000, 9) AS rate FROM (SELECT key,
    list_reduce(list_prepend({'t': NULL::DOUBLE, 'v': 0::DOUBLE}, list({'t': epoch_us(ts) / 1000.0, 'v': amount} ORDER BY idx)),
    lambda a, x: {'t': greatest(a.t, x.t), 'v': CASE WHEN a.t IS NULL THEN 0.0 WHEN x.t > a.t THEN a.v * exp((a.t - x.t) / 60000000.0) ELSE a.v END + x.v}).v AS v
    FROM log GROUP BY key)"""


@query(_RATE)
def rate_leaky(spark, sf):
    log = views.log(spark, sf).select("key", "idx", (F.unix_micros(F.col("ts").cast("timestamp")) / 1000.0).alias("t"), "amount")
    out = metrics.leaky_rate(log, "key", "idx", 60_000_000.0)
    return out.select("key", F.round("value", 6).alias("value"), F.round("rate", 9).alias("rate"))


@query("""WITH s AS (SELECT key, idx, idx - idx % 50 AS commit FROM log), d AS (SELECT *, commit - lag(commit) OVER (PARTITION BY key ORDER BY idx) AS c FROM s)
    SELECT key, idx, CASE WHEN c < 0 THEN commit ELSE c END AS delta FROM d""")
def commit_delta(spark, sf):
    s = views.log(spark, sf).select("key", "idx", (F.col("idx") - F.col("idx") % 50).alias("commit"))
    return metrics.deltas(s, "key", "idx", "commit").select("key", "idx", "delta")


@query("SELECT date_trunc('second', ts) AS second, count(*) AS ops FROM log GROUP BY 1")
def ops_per_second(spark, sf):
    log = views.log(spark, sf)
    return metrics.per_second(log).withColumn("second", F.col("second").cast("timestamp_ntz"))


@query("SELECT idx // 100 AS batch, arg_max(idx % 37 + 5, idx) AS latency_ms FROM log GROUP BY 1")
def commit_latency(spark, sf):
    rows = views.log(spark, sf).select("idx", F.lit(0).alias("ts_ms"), (F.col("idx") % 37 + 5).alias("applied_ms"))
    return metrics.latency(rows, F.floor(F.col("idx") / 100))


_FIELDS = ["click", "view", "purchase", "error"]


@query("SELECT key::VARCHAR AS name, " + ", ".join(f"round(coalesce(sum(amount) FILTER (type = '{f}'), 0), 4) AS \"{f}\"" for f in _FIELDS) + " FROM log GROUP BY key")
def counter_pivot(spark, sf):
    rows = views.log(spark, sf).select(F.col("key").cast("string").alias("name"), F.col("type").alias("field"), F.col("amount").alias("value"))
    out = metrics.pivot_counters(rows, _FIELDS)
    return out.select("name", *(F.round(f, 4).alias(f) for f in _FIELDS))


@query("SELECT key::VARCHAR AS name, type AS field, arg_max(amount, idx) AS value FROM log GROUP BY key, type")
def gauge_latest(spark, sf):
    return metrics.latest_gauges(views.log(spark, sf).select(F.col("key").cast("string").alias("name"), F.col("type").alias("field"), F.col("amount").alias("value"), F.col("idx").alias("seq")))


@query("""SELECT c_name AS name, c_custkey AS uid, coalesce(s.state, 'undefined') AS state, coalesce(k.snap_idx, -1) AS snap_idx FROM customer
    LEFT JOIN (SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'O') THEN 'leader' ELSE 'follower' END AS state FROM orders GROUP BY 1) s ON s.o_custkey = c_custkey
    LEFT JOIN (SELECT key AS uid, max(idx) AS snap_idx FROM log GROUP BY key) k ON k.uid = c_custkey""")
def directory_overview(spark, sf):
    c = views.read(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("uid"))
    o = views.read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("uid")).agg(
        F.when(F.bool_or(F.col("o_orderstatus") == "O"), "leader").otherwise("follower").alias("state")
    )
    states = c.join(o, "uid").select("name", "state")
    snaps = views.log(spark, sf).groupBy(F.col("key").alias("uid")).agg(F.max("idx").alias("snap_idx"))
    return metrics.directory(c, states, snaps)


@query("SELECT key % 5 AS cluster, arg_max(key, idx) AS leader, max(idx) AS seq FROM log WHERE type = 'view' GROUP BY 1")
def leaderboard(spark, sf):
    rows = views.log(spark, sf).filter("type = 'view'").select((F.col("key") % 5).alias("cluster"), F.col("key").alias("leader"), F.col("idx").alias("seq"))
    return metrics.leaderboard(rows)


@query("""WITH l AS (SELECT key, idx, (amount::INT % 50 + 1)::DOUBLE AS a, (idx % 30)::DOUBLE AS i FROM log)
    SELECT key, round(list_reduce(list({'a': a, 'i': i, 'u': a / (a + i)} ORDER BY idx), lambda s, x: {'a': x.a, 'i': x.i,
    'u': x.u * (1 - exp((x.a + x.i) * ln(0.5) / 200.0)) + s.u * exp((x.a + x.i) * ln(0.5) / 200.0)}).u, 9) AS usage FROM l GROUP BY key""")
def usage_ewma(spark, sf):
    spans = views.log(spark, sf).select("key", F.col("idx").alias("seq"), (F.rint("amount").cast("long") % 50 + 1).cast("double").alias("active"), (F.col("idx") % 30).cast("double").alias("inactive"))
    return metrics.usage(spans, "key", 200.0).withColumn("usage", F.round("usage", 9))


@query("""WITH e AS (SELECT key AS target, type AS component, arg_max(op, idx) AS a FROM log WHERE idx % 2 = 0 OR type = 'error' GROUP BY 1, 2)
    SELECT target, count(*) AS n, string_agg(component, ',' ORDER BY component) AS components FROM e WHERE a = 'put' GROUP BY target""")
def monitors(spark, sf):
    rows = views.log(spark, sf).filter("idx % 2 = 0 or type = 'error'")
    action = F.when(F.col("op") == "put", "add").otherwise("remove")
    return metrics.monitors(rows.select(F.col("key").alias("target"), F.col("type").alias("component"), action.alias("action"), F.col("idx").alias("seq")))


@query("""SELECT type, count(*) AS ops, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0), 9) AS ops_per_second FROM log GROUP BY type""")
def throughput(spark, sf):
    rows = views.log(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    return metrics.throughput(rows, "type").withColumn("ops_per_second", F.round("ops_per_second", 9))


_ONCE = """f AS (SELECT producer, seqno, min(arrival) AS arrival FROM fifo GROUP BY producer, seqno),
    x AS (SELECT *, row_number() OVER (PARTITION BY producer ORDER BY seqno) AS n, max(arrival) OVER (PARTITION BY producer ORDER BY seqno) AS enqueued_at FROM f),
    once AS (SELECT producer, seqno, arrival, enqueued_at FROM x WHERE n = seqno)"""
_EVENTS = """e AS (SELECT producer, seqno, arrival, CASE (producer + arrival) % 4 WHEN 0 THEN 'settle' WHEN 1 THEN 'return' WHEN 2 THEN 'checkout'
    ELSE 'discard' END AS event FROM fifo)"""


def _events(spark, sf):
    k = (F.col("producer") + F.col("arrival")) % 4
    kind = F.when(k == 0, "settle").when(k == 1, "return").when(k == 2, "checkout").otherwise("discard")
    return views.fifo(spark, sf).select("producer", "seqno", "arrival", kind.alias("event"))


@query(f"WITH {_ONCE} SELECT * FROM once")
def fifo_exactly_once(spark, sf):
    return queues.exactly_once(views.fifo(spark, sf))


@query(f"""WITH {_ONCE}, {_EVENTS}, l AS (SELECT producer, seqno, arg_max(event, arrival) AS event FROM e GROUP BY producer, seqno)
    SELECT producer, count(*) FILTER (event IS NULL OR event = 'return') AS ready, count(*) FILTER (event = 'checkout') AS checked_out,
    count(*) FILTER (event = 'settle') AS settled, count(*) FILTER (event = 'discard') AS dead
    FROM (SELECT o.producer, event FROM once o LEFT JOIN l ON o.producer = l.producer AND o.seqno = l.seqno) GROUP BY producer""")
def fifo_ready(spark, sf):
    return queues.ready(queues.exactly_once(views.fifo(spark, sf)), _events(spark, sf))


@query(f"WITH {_EVENTS} SELECT producer, seqno, count(*) FILTER (event = 'return') AS delivery_count FROM e GROUP BY producer, seqno")
def fifo_redelivery(spark, sf):
    return queues.redelivery(_events(spark, sf))


@query(f"""WITH {_ONCE}, {_EVENTS} SELECT producer, min(seqno) AS smallest FROM once o WHERE NOT EXISTS
    (SELECT 1 FROM e WHERE event = 'settle' AND e.producer = o.producer AND e.seqno = o.seqno) GROUP BY producer""")
def fifo_low_watermark(spark, sf):
    settled = _events(spark, sf).filter("event = 'settle'")
    return queues.low_watermark(queues.exactly_once(views.fifo(spark, sf)), settled)


@query("""WITH o AS (SELECT key AS queue, idx, CASE WHEN type IN ('purchase', 'error') THEN 'deq' ELSE 'enq' END AS op FROM log),
    r AS (SELECT queue, list_reduce(list_prepend({'idx': 0::BIGINT, 'op': '', 'held': []::BIGINT[], 'out': []::BIGINT[][]},
        list({'idx': idx, 'op': op, 'held': []::BIGINT[], 'out': []::BIGINT[][]} ORDER BY idx)),
        lambda a, x: {'idx': x.idx, 'op': x.op, 'held': CASE WHEN x.op = 'enq' THEN list_append(a.held, x.idx) ELSE a.held[2:] END,
        'out': CASE WHEN x.op = 'deq' THEN list_append(a.out, [x.idx, a.held[1]]) ELSE a.out END}).out AS out FROM o GROUP BY queue)
    SELECT queue, p[1] AS deq_idx, p[2] AS enq_idx FROM (SELECT queue, unnest(out) AS p FROM r)""")
def queue_match(spark, sf):
    op = F.when(F.col("type").isin("purchase", "error"), "deq").otherwise("enq")
    return queues.matched(views.log(spark, sf).select(F.col("key").alias("queue"), "idx", op.alias("op")))


def _fifo_commands(spark, sf):
    """Each user's events as commands of one queue, every kind of command among them. Some
    messages come early, twice or without a number."""
    log, i = views.log(spark, sf), F.col("idx")
    kind = (
        F.when(F.col("type") == "click", F.when(i % 13 == 0, "dequeue").otherwise("checkout"))
        .when(F.col("type") == "purchase", F.when(i % 5 == 0, "discard").otherwise("settle"))
        .when(F.col("type") == "error", F.element_at(F.array(*map(F.lit, "return return cancel down return noconnection nodeup purge".split())), (i % 8 + 1).cast("int")))
        .otherwise("enqueue")
    )
    rows = log.select(F.col("key").alias("queue"), "idx", kind.alias("event"), (i % 3).alias("pid"))
    n = F.row_number().over(Window.partitionBy("queue", "event", "pid").orderBy("idx"))
    rows = rows.withColumn("n", n)
    seqno = F.when(i % 6 == 0, None).when(F.col("n") % 4 == 1, F.col("n") + 1).when(F.col("n") % 4 == 2, F.col("n") - 1).otherwise(F.col("n") - (F.col("n") % 7 == 0).cast("int"))
    life = F.when(F.col("event") == "dequeue", F.when(i % 2 == 0, "settled").otherwise("unsettled")).when(i % 4 == 0, "once").otherwise("auto")
    return rows.select("queue", "idx", "event", "pid", seqno.cast("long").alias("seqno"), F.array(i % 4, i % 4 + 1).alias("ids"), life.alias("life"), (1 + i % 3).alias("credit"))


@query()
def fifo_effects(spark, sf):
    """Deliveries and replies of the queue machine; compared with a plain version in the tests."""
    return fifo.effects(_fifo_commands(spark, sf))


@query()
def fifo_overview(spark, sf):
    """State of every queue after its log; compared with a plain version in the tests."""
    return fifo.overview(_fifo_commands(spark, sf))
