"""State machines: folds, replies, versions, key-value state, replicas."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import machines
from tideline.plans import views
from tideline.plans.registry import query

_KV = "kv AS (SELECT key, max(idx) AS idx FROM log GROUP BY key HAVING arg_max(op, idx) = 'put')"


@query(f"WITH {_KV} SELECT key, idx FROM kv")
def kv_current_state(spark, sf):
    return machines.kv_state(views.log(spark, sf))


@query(f"WITH {_KV} SELECT kv.key, idx, term, amount, payload FROM kv JOIN log USING (idx)")
def kv_get_materialized(spark, sf):
    log = views.log(spark, sf)
    return machines.kv_read(machines.kv_state(log), log.select("idx", "key", "term", "amount", "payload")).select("key", "idx", "term", "amount", "payload")


@query("""SELECT key, idx, CASE WHEN before = 'put' THEN 'ok' ELSE 'not_found' END AS reply
    FROM (SELECT *, lag(op) OVER (PARTITION BY key ORDER BY idx) AS before FROM log) WHERE op = 'delete'""")
def kv_delete_replies(spark, sf):
    return machines.kv_replies(views.log(spark, sf))


@query(f"WITH {_KV} SELECT count(*) AS num_keys, min(idx) AS first_live, max(idx) AS last_live FROM kv")
def kv_overview(spark, sf):
    state = machines.kv_state(views.log(spark, sf))
    return state.agg(F.count("*").alias("num_keys"), F.min("idx").alias("first_live"), F.max("idx").alias("last_live"))


@query("SELECT uid, idx FROM live")
def live_indexes(spark, sf):
    return views.live(spark, sf)


_OP = "CASE idx % 4 WHEN 0 THEN {s} + v WHEN 1 THEN {s} - v WHEN 2 THEN {s} * (v % 3 + 1) ELSE {s} // (v % 5 + 1) END"


def _apply(a, x):
    """Add, subtract, multiply or divide, bounded so that longs hold every step."""
    v = x["v"]
    out = (
        F.when(x["idx"] % 4 == 0, a + v)
        .when(x["idx"] % 4 == 1, a - v)
        .when(x["idx"] % 4 == 2, a * (v % 3 + 1))
        .otherwise(F.floor(a / (v % 5 + 1)))
    )
    return F.pmod(out, F.lit(1_000_003).cast("long"))


_FOLD = """list_reduce(list_prepend({{'idx': 0::BIGINT, 'v': {zero}::BIGINT}}, list({{'idx': idx, 'v': (amount::INT % 50 + 1)::BIGINT}} ORDER BY idx)),
    lambda a, x: {{'idx': x.idx, 'v': (((CASE x.idx % 4 WHEN 0 THEN a.v + x.v WHEN 1 THEN a.v - x.v WHEN 2 THEN a.v * (x.v % 3 + 1)
    ELSE floor(a.v / (x.v % 5 + 1))::BIGINT END) % 1000003) + 1000003) % 1000003}}).v"""


def _commands(spark, sf):
    return views.log(spark, sf).select("uid", "idx", "key", (F.rint("amount").cast("long") % 50 + 1).alias("v"))


@query(f"SELECT key, {_FOLD.format(zero=9)} AS state FROM log GROUP BY key")
def fold_nonassoc(spark, sf):
    return machines.fold(_commands(spark, sf), "key", "idx", ["v"], F.lit(9).cast("long"), _apply)


@query(f"SELECT key, {_FOLD.format(zero=9)} AS state FROM log GROUP BY key")
def incremental_recover(spark, sf):
    """Snapshot of the first three fifths, then the tail: equal to the whole fold."""
    rows = _commands(spark, sf)
    cut = views.max_idx(spark, sf).select(F.floor(F.col("n") * 0.6).alias("snap"))
    head = rows.crossJoin(F.broadcast(cut)).filter("idx <= snap")
    state = machines.fold(head, "key", "idx", ["v"], F.lit(9).cast("long"), _apply).crossJoin(F.broadcast(cut))
    return machines.fold_from(rows, state, "key", "idx", ["v"], F.lit(9).cast("long"), _apply)


@query("SELECT uid, idx, 9 + sum(key) OVER (PARTITION BY uid ORDER BY idx)::BIGINT AS reply FROM log")
def fold_simple_running(spark, sf):
    return machines.running(views.log(spark, sf), "key", ["uid"], "idx", 9, 4096).select("uid", "idx", "reply")


@query("SELECT uid, " + ", ".join(f"count(*) FILTER (type = '{t}') AS n_{t}" for t in ("click", "view", "purchase", "error")) + " FROM log GROUP BY uid")
def command_counts(spark, sf):
    return machines.command_counts(views.log(spark, sf), ["click", "view", "purchase", "error"])


@query("SELECT key AS pid, count(*) AS n, string_agg(idx::VARCHAR, ',' ORDER BY idx) AS correlations FROM log WHERE type = 'purchase' GROUP BY key")
def notify_grouping(spark, sf):
    rows = views.log(spark, sf).filter("type = 'purchase'").select(F.col("key").alias("pid"), "idx", F.col("idx").alias("correlation"))
    return machines.notifications(rows)


@query("""SELECT uid, idx, kind, target, ordinal FROM (
    SELECT uid, idx, 'reply' AS kind, key::VARCHAR AS target, 0 AS ordinal FROM log WHERE type <> 'error'
    UNION ALL SELECT uid, idx, 'append', 'audit', 1 FROM log WHERE type = 'purchase'
    UNION ALL SELECT uid, idx, 'send_msg', 'monitor', 0 FROM log WHERE type = 'error')""")
def effects_table(spark, sf):
    return machines.effects(views.log(spark, sf))


_VERSIONS = "v AS (SELECT uid, idx, idx // 97 % 5 AS version FROM ckpt WHERE idx % 194 = 0)"


def _versioned(spark, sf, block):
    marks = views.checkpoints(spark, sf).filter("idx % 194 = 0").withColumn("version", F.floor(F.col("idx") / 97) % 5)
    return machines.version_as_of(views.log(spark, sf).select("uid", "idx", "key"), marks, block)


@query(f"WITH {_VERSIONS} SELECT l.uid, l.idx, l.key, v.version FROM log l ASOF LEFT JOIN v ON l.uid = v.uid AND l.idx >= v.idx")
def machine_version_asof(spark, sf):
    return _versioned(spark, sf, 1024)


@query(f"""WITH {_VERSIONS}, a AS (SELECT l.uid, l.idx, l.key, v.version FROM log l ASOF LEFT JOIN v ON l.uid = v.uid AND l.idx >= v.idx),
    s AS (SELECT min(idx) AS stop FROM a WHERE version > 3) SELECT a.uid, idx, key, version FROM a, s WHERE stop IS NULL OR idx < stop""")
def machine_version_stop(spark, sf):
    return machines.supported(_versioned(spark, sf, 1024), 3)


@query("""SELECT l.uid, l.idx, l.key FROM log l, maxidx WHERE l.idx > floor(n * 0.3) AND l.idx <= floor(n * 0.5)""")
def apply_to_commit(spark, sf):
    n = views.max_idx(spark, sf)
    marks = n.select(F.lit("main").alias("uid"), F.floor(F.col("n") * 0.3).alias("last_applied"), F.floor(F.col("n") * 0.5).alias("commit_index"))
    return machines.applied(views.log(spark, sf), F.broadcast(marks), "uid").select("uid", "idx", "key")


def _replicas(spark, sf):
    """Three members; the third has not applied the last fiftieth of the log."""
    n = F.broadcast(views.max_idx(spark, sf))
    members = F.broadcast(spark.range(1, 4).select(F.col("id").alias("member")))
    rows = views.log(spark, sf).crossJoin(n).crossJoin(members).filter((F.col("member") < 3) | (F.col("idx") <= F.floor(F.col("n") * 0.98)))
    return machines.kv_state(rows, ["uid", "member"])


_REPLICAS = """m AS (SELECT uid, member, key, max(idx) AS idx FROM log, maxidx, range(1, 4) t(member) WHERE member < 3 OR idx <= floor(n * 0.98)
    GROUP BY uid, member, key HAVING arg_max(op, idx) = 'put')"""


@query(f"""WITH {_REPLICAS}, l AS (SELECT uid, member, list(idx ORDER BY idx) AS x FROM m GROUP BY uid, member)
    SELECT uid, count(*) AS members, count(DISTINCT x) = 1 AS converged FROM l GROUP BY uid""")
def replica_convergence(spark, sf):
    return machines.replica_convergence(_replicas(spark, sf))


@query(f"""WITH {_REPLICAS}, {_KV}, w AS (SELECT member, key, kv.idx AS expected FROM kv, range(1, 4) t(member))
    SELECT coalesce(m.member, w.member) AS member, coalesce(m.key, w.key) AS key, m.idx, expected FROM m FULL JOIN w
    ON m.member = w.member AND m.key = w.key WHERE m.idx IS DISTINCT FROM expected""")
def replica_diff(spark, sf):
    return machines.replica_diff(_replicas(spark, sf), machines.kv_state(views.log(spark, sf)))


@query(f"""WITH {_REPLICAS}, {_KV}, d AS (SELECT m.member, count(*) FILTER (m.idx IS DISTINCT FROM kv.idx) AS stale, count(*) AS n
    FROM m LEFT JOIN kv ON m.key = kv.key GROUP BY m.member) SELECT member, n, stale FROM d""")
def replica_staleness(spark, sf):
    want = machines.kv_state(views.log(spark, sf)).withColumnRenamed("idx", "expected")
    return _replicas(spark, sf).join(want, "key", "left").groupBy("member").agg(
        F.count("*").alias("n"), F.count_if(~F.col("idx").eqNullSafe(F.col("expected"))).alias("stale")
    )
