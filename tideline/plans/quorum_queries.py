"""Quorums, replication progress and membership."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import quorum
from tideline.plans import views
from tideline.plans.registry import query

_CAND = """k AS (SELECT cluster, match_index AS candidate FROM (SELECT cluster, match_index, count(*) OVER (PARTITION BY cluster) AS n,
    row_number() OVER (PARTITION BY cluster ORDER BY match_index DESC, member) AS r FROM peers WHERE voter) WHERE r = n // 2 + 1)"""


@query(f"WITH {_CAND} SELECT cluster, candidate FROM k")
def quorum_commit(spark, sf):
    return quorum.commit_candidates(views.peers(spark, sf))


@query("""SELECT cluster, query_index AS candidate FROM (SELECT cluster, query_index, count(*) OVER (PARTITION BY cluster) AS n,
    row_number() OVER (PARTITION BY cluster ORDER BY query_index DESC, member) AS r FROM peers WHERE voter) WHERE r = n // 2 + 1""")
def quorum_query_index(spark, sf):
    return quorum.commit_candidates(views.peers(spark, sf), "query_index")


_CLUSTERS = """c AS (SELECT DISTINCT cluster, (SELECT max(term) FROM log, maxidx WHERE idx <= n // 2) - cluster % 2 AS current_term,
    3 + cluster % 100 AS commit_index FROM peers)"""


def _clusters(spark, sf):
    half = views.log(spark, sf).crossJoin(F.broadcast(views.max_idx(spark, sf))).filter("idx <= n div 2")
    term = half.agg(F.max("term").alias("t"))
    c = views.peers(spark, sf).select("cluster").distinct().crossJoin(F.broadcast(term))
    return c.select("cluster", (F.col("t") - F.col("cluster") % 2).alias("current_term"), (3 + F.col("cluster") % 100).alias("commit_index"))


@query(f"""WITH {_CAND}, {_CLUSTERS} SELECT k.cluster, CASE WHEN l.term = c.current_term AND candidate > c.commit_index THEN candidate
    ELSE c.commit_index END AS commit_index FROM k JOIN c ON k.cluster = c.cluster LEFT JOIN log l ON l.idx = candidate""")
def commit_term_guard(spark, sf):
    return quorum.commit(views.peers(spark, sf), _clusters(spark, sf), views.log(spark, sf))


@query("SELECT cluster, count(*) FILTER (voter) AS voters, count(*) FILTER (voter) // 2 + 1 AS quorum FROM peers GROUP BY cluster")
def required_quorum(spark, sf):
    return quorum.required(views.peers(spark, sf))


_VOTES = """v AS (SELECT key % 50 AS cluster, idx // 400 AS term, key % 3 AS candidate, idx AS seq, type <> 'error' AS granted FROM log)"""


@query(f"""WITH {_VOTES}, q AS (SELECT cluster, count(*) FILTER (voter) // 2 + 1 AS quorum FROM peers GROUP BY cluster),
    n AS (SELECT v.*, row_number() OVER (PARTITION BY v.cluster, term, candidate ORDER BY seq) AS n, quorum FROM v JOIN q ON q.cluster = v.cluster WHERE granted)
    SELECT cluster, term, candidate, count(*) AS granted, min(CASE WHEN n = quorum THEN seq END) AS elected_at FROM n
    GROUP BY cluster, term, candidate HAVING min(CASE WHEN n = quorum THEN seq END) IS NOT NULL""")
def election_results(spark, sf):
    votes = views.log(spark, sf).select(
        (F.col("key") % 50).alias("cluster"), F.floor(F.col("idx") / 400).alias("term"), (F.col("key") % 3).alias("candidate"),
        F.col("idx").alias("seq"), (F.col("type") != "error").alias("granted"),
    )
    return quorum.elections(votes, quorum.required(views.peers(spark, sf)).drop("voters"))


@query("""SELECT key, max(term) AS term, arg_max(idx, idx) AS idx, (max(term), max(idx)) >= (t, i) AS up_to_date
    FROM log, (SELECT term AS t, idx AS i FROM log, maxidx WHERE idx = n // 2) GROUP BY key, t, i""")
def log_up_to_date(spark, sf):
    log = views.log(spark, sf)
    mid = log.crossJoin(F.broadcast(views.max_idx(spark, sf))).filter("idx = n div 2").select(F.col("term").alias("t"), F.col("idx").alias("i"))
    heads = log.groupBy("key").agg(F.max("term").alias("term"), F.max("idx").alias("idx"))
    fresh = quorum.up_to_date(F.col("term"), F.col("idx"), F.col("t"), F.col("i"))
    return heads.crossJoin(F.broadcast(mid)).select("key", "term", "idx", fresh.alias("up_to_date"))


@query("""SELECT cluster, member, CASE WHEN 10 + member % 3 < 11 THEN 'stale_term' WHEN machine_version < 2 THEN 'denied'
    WHEN match_index >= 50 THEN 'granted' ELSE 'denied' END AS decision FROM peers WHERE machine_version IS NOT NULL""")
def pre_vote_decision(spark, sf):
    p = views.peers(spark, sf).filter("machine_version is not null")
    d = quorum.pre_vote(10 + F.col("member") % 3, F.lit(11), F.col("match_index") >= 50, F.col("machine_version"), F.lit(2))
    return p.select("cluster", "member", d.alias("decision"))


@query("SELECT cluster, member FROM peers WHERE status = 'normal' AND (match_index < next_index - 1 OR commit_sent < 60)")
def stale_peers(spark, sf):
    return quorum.stale(views.peers(spark, sf), F.lit(60)).select("cluster", "member")


@query("""SELECT cluster, member, next_index - match_index - 1 AS in_flight, greatest(1, least(128, 2 - (next_index - match_index - 1))) AS batch
    FROM peers WHERE status = 'normal' AND (next_index < 150 OR commit_sent < 120) AND next_index - match_index - 1 < 2""")
def pipeline_window(spark, sf):
    return quorum.pipeline(views.peers(spark, sf), F.lit(150), F.lit(120), max_pipeline=2)


@query("""SELECT uid AS cluster, key AS member, idx AS seq, max(idx) OVER w AS match_index, max(idx + key % 7) OVER w AS next_index FROM log
    WINDOW w AS (PARTITION BY uid, key ORDER BY idx ROWS UNBOUNDED PRECEDING)""")
def peer_progress(spark, sf):
    r = views.log(spark, sf).select(F.col("uid").alias("cluster"), F.col("key").alias("member"), F.col("idx").alias("seq"), F.col("idx").alias("last_index"), (F.col("idx") + F.col("key") % 7).alias("next"))
    return quorum.progress(r).select("cluster", "member", "seq", "match_index", "next_index")


@query("SELECT cluster, member, CASE WHEN voter OR match_index >= 58 THEN 'voter' ELSE 'promotable' END AS membership FROM peers")
def promote_members(spark, sf):
    return quorum.promoted(views.peers(spark, sf), F.lit(58))


@query("""SELECT cluster, CASE WHEN count(*) FILTER (machine_version IS NULL) > 0 THEN 1 ELSE greatest(min(machine_version), 1) END::INT AS version
    FROM peers GROUP BY cluster""")
def max_machine_version(spark, sf):
    return quorum.machine_version(views.peers(spark, sf), 1)


@query("""SELECT uid, idx AS from_idx, key AS members, lead(idx) OVER (PARTITION BY uid ORDER BY idx) - 1 AS to_idx FROM log WHERE type = 'error'""")
def membership_history(spark, sf):
    changes = views.log(spark, sf).filter("type = 'error'").select("uid", "idx", F.col("key").alias("members"))
    return quorum.membership_history(changes)


@query("""WITH c AS (SELECT cluster, query_index AS candidate FROM (SELECT cluster, query_index, count(*) OVER (PARTITION BY cluster) AS n,
    row_number() OVER (PARTITION BY cluster ORDER BY query_index DESC, member) AS r FROM peers WHERE voter) WHERE r = n // 2 + 1)
    SELECT q.cluster, q.idx FROM (SELECT key % 5 AS cluster, idx, idx % 17 AS query_index FROM log) q JOIN c ON c.cluster = q.cluster WHERE q.query_index <= candidate""")
def consistent_query_release(spark, sf):
    waiting = views.log(spark, sf).select((F.col("key") % 5).alias("cluster"), "idx", (F.col("idx") % 17).alias("query_index"))
    return quorum.released(waiting, quorum.commit_candidates(views.peers(spark, sf), "query_index")).select("cluster", "idx")


@query(f"""WITH {_CLUSTERS} SELECT c.cluster, coalesce(min(least(match_index, commit_sent)) >= c.commit_index, true) AS replicated
    FROM c LEFT JOIN peers p ON p.cluster = c.cluster GROUP BY c.cluster, c.commit_index""")
def fully_replicated(spark, sf):
    return quorum.fully_replicated(views.peers(spark, sf), _clusters(spark, sf))
