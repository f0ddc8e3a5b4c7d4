"""Queries whose bounds follow the log.

Bounds are shares of the largest index, so what they read grows with the table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import scalars
from tideline.operators import indexset, logops, machines, quorum
from tideline.plans import views
from tideline.plans.index_queries import _PUTS, _RANGES, _clicks, _puts
from tideline.plans.registry import query

_P = 1000003


def _max_idx(spark, sf) -> int:
    return views.max_idx(spark, sf).first()["n"] or 0


@query(f"SELECT uid, list_reduce(list_prepend(1::BIGINT, list(key ORDER BY idx)), lambda a, x: (a * 31 + x) % {_P}) AS value FROM log GROUP BY uid")
def log_fold_range(spark, sf):
    pair = lambda m, c: F.struct(m.cast("long").alias("m"), c.cast("long").alias("c"))  # noqa: E731  the map s -> s * m + c
    step = lambda a, x: pair(a["m"] * 31 % _P, (a["c"] * 31 + x) % _P)
    through = lambda s, f: (s * f["m"] + f["c"]) % _P
    return logops.fold_blocks(views.log(spark, sf), F.col("key"), pair(F.lit(1), F.lit(0)), step, F.lit(1).cast("long"), through)


@query("""WITH h AS (SELECT log.* FROM log, maxidx WHERE idx <> n * 9 // 10),
    k AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY idx) AS k FROM h) SELECT uid, idx, key FROM k WHERE k = idx""")
def log_fold_until_hole(spark, sf):
    n = _max_idx(spark, sf)
    return logops.contiguous_prefix(views.log(spark, sf).filter(F.col("idx") != n * 9 // 10), 1, n).select("uid", "idx", "key")


@query("""WITH w AS (SELECT i::INT AS pos, 1 + 17 * i AS idx FROM maxidx, range(0, 1 + (n - 1) // 17) t(i)),
    l AS (SELECT log.* FROM log, maxidx WHERE idx <> 1 + 17 * (n // 20)),
    j AS (SELECT pos, idx, key FROM w LEFT JOIN l USING (idx)), s AS (SELECT min(pos) AS stop FROM j WHERE key IS NULL)
    SELECT pos, idx, key FROM j, s WHERE stop IS NULL OR pos < stop""")
def log_multi_get(spark, sf):
    n = _max_idx(spark, sf)
    wanted = spark.range(1 + (n - 1) // 17).select(F.col("id").cast("int").alias("pos"), (1 + 17 * F.col("id")).alias("idx"))
    return logops.sparse_read(views.log(spark, sf).filter(F.col("idx") != 1 + 17 * (n // 20)), wanted, "stop").select("pos", "idx", "key")


@query("""WITH b AS (SELECT uid, idx, CASE WHEN idx > n * 9 // 10 THEN term + 1 ELSE term END AS term FROM log, maxidx),
    l AS (SELECT uid, idx, term FROM log, maxidx WHERE idx <= n * 19 // 20),
    s AS (SELECT b.uid, b.idx, b.term, CASE WHEN l.term IS NULL THEN 'missing' WHEN l.term = b.term THEN 'ok'
    ELSE 'term_mismatch' END AS status FROM b LEFT JOIN l ON b.uid = l.uid AND b.idx = l.idx),
    f AS (SELECT min(idx) AS m FROM s WHERE status <> 'ok') SELECT uid, idx, term, status, m IS NULL OR idx < m AS drop FROM s, f""")
def log_prefix_match(spark, sf):
    n = _max_idx(spark, sf)
    rows = views.log(spark, sf).select("uid", "idx", "term")
    batch = rows.withColumn("term", F.when(F.col("idx") > n * 9 // 10, F.col("term") + 1).otherwise(F.col("term")))
    return logops.prefix_match(batch, rows.filter(F.col("idx") <= n * 19 // 20))


@query("SELECT uid, idx, key FROM log, maxidx WHERE idx <= n * 9 // 10")
def log_truncate_suffix(spark, sf):
    return views.log(spark, sf).filter(F.col("idx") <= _max_idx(spark, sf) * 9 // 10).select("uid", "idx", "key")


@query(f"WITH p AS ({_PUTS}) SELECT owner, idx FROM p, maxidx WHERE idx >= n // 20 AND idx <= n * 19 // 20")
def seq_floor_limit(spark, sf):
    n = _max_idx(spark, sf)
    return indexset.limit(indexset.floor(_puts(spark, sf), n // 20), n * 19 // 20)


@query(f"""WITH {_RANGES} SELECT owner, greatest(lo, n // 20) AS lo, least(hi, n * 19 // 20) AS hi FROM r, maxidx
    WHERE hi >= n // 20 AND lo <= n * 19 // 20""")
def seq_in_range(spark, sf):
    n = _max_idx(spark, sf)
    return indexset.clip(indexset.compress(_clicks(spark, sf)), n // 20, n * 19 // 20)


@query("SELECT uid, arg_max(key, idx) AS members, max(idx) AS idx FROM log WHERE type = 'error' GROUP BY uid")
def cluster_scan(spark, sf):
    changes = views.log(spark, sf).filter("type = 'error'").select("uid", "idx", F.col("key").alias("members"))
    return quorum.current_membership(changes, _max_idx(spark, sf))


@query("""WITH r AS (SELECT id, id * 7919 % 100 AS r, 'key_' || (id * 104729 % 10000 + 1) AS key FROM maxidx, range(0, n) t(id))
    SELECT CASE WHEN r < 68 THEN 'put' WHEN r < 88 THEN 'get' WHEN r < 92 THEN 'snapshot' WHEN r < 94 THEN 'major_compaction'
    ELSE ['update_almost_all', 'put_many', 'add_member', 'remove_member', 'kill_wal', 'kill_member'][r - 93] END AS op,
    count(*) AS n, count(DISTINCT key) AS keys FROM r GROUP BY 1""")
def workload_mix(spark, sf):
    """As many operations as the log has entries."""
    return machines.workload(spark, _max_idx(spark, sf)).groupBy("op").agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys"))


@query("""WITH l AS (SELECT key, list(amount ORDER BY idx) AS v FROM log GROUP BY key),
    f AS (SELECT key, len(v) AS n, v = list_sort(v) AS up, v = list_reverse_sort(v) AS down FROM l)
    SELECT key, CASE WHEN n < 2 OR (up AND down) THEN 'undefined' WHEN up THEN 'ascending' WHEN down THEN 'descending' ELSE 'unsorted' END AS sorted FROM f""")
def detect_sort(spark, sf):
    """Every key, by all of its entries."""
    rows = views.log(spark, sf).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("idx", "amount"))).alias("v"))
    return rows.select("key", scalars.detect_sort(F.transform("v", lambda x: x["amount"])).alias("sorted"))
