"""Segments, retention and compaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import segments
from tideline.plans import views
from tideline.plans.registry import query

_RECORDS = "rec AS (SELECT uid, (idx - 1) // 128 + 1 AS segment, idx, octet_length(encode(payload)) AS bytes FROM writes)"
_INFO = """i AS (SELECT r.uid, r.segment, count(*) AS n, min(r.idx) AS lo, max(r.idx) AS hi, sum(bytes)::BIGINT AS bytes,
    count(l.idx) AS n_live, coalesce(sum(CASE WHEN l.idx IS NOT NULL THEN bytes END), 0)::BIGINT AS live_bytes
    FROM rec r LEFT JOIN live l ON r.uid = l.uid AND r.idx = l.idx GROUP BY r.uid, r.segment)"""
COUNT, BYTES = 64, 4096


def _records(spark, sf):
    rows = views.writes(spark, sf).withColumn("segment", F.floor((F.col("idx") - 1) / 128) + 1)
    return rows.select("uid", "segment", "idx", F.octet_length("payload").cast("long").alias("bytes"))


def _info(spark, sf):
    return segments.info(_records(spark, sf), views.live(spark, sf))


def _snap(spark, sf):
    return views.snapshot_idx(spark, sf).select(F.lit("main").alias("uid"), "snap")


@query(f"WITH {_RECORDS}, {_INFO} SELECT * FROM i")
def segment_info(spark, sf):
    return _info(spark, sf)


@query("""SELECT uid, segment, greatest(lo, x.n // 10) AS lo, least(hi, x.n * 9 // 10) AS hi FROM segments, maxidx x
    WHERE hi >= x.n // 10 AND lo <= x.n * 9 // 10""")
def segment_prune(spark, sf):
    n = views.max_idx(spark, sf).first()["n"] or 0
    return segments.slices(views.segments(spark, sf).select("uid", "segment", "lo", "hi"), n // 10, n * 9 // 10)


_REFS = "r AS (SELECT uid, write_seq // 512 AS seq, write_seq // 512 AS segment, min(idx) AS lo, max(idx) AS hi FROM writes GROUP BY ALL)"


@query(f"""WITH {_REFS}, o AS (SELECT *, min(lo) OVER (PARTITION BY uid ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - 1 AS cut FROM r)
    SELECT uid, seq, segment, lo, least(hi, coalesce(cut, hi)) AS hi, least(hi, coalesce(cut, hi)) < lo AS overwritten FROM o""")
def catalog_overlay(spark, sf):
    rows = views.writes(spark, sf).withColumn("seq", F.floor(F.col("write_seq") / 512))
    refs = rows.groupBy("uid", "seq").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    return segments.overlay(refs.withColumn("segment", F.col("seq"))).select("uid", "seq", "segment", "lo", "hi", "overwritten")


@query("SELECT uid, segment, lo, hi, n, bytes FROM segments, snapidx, maxidx m WHERE hi <= snap AND hi < m.n".replace("lo, hi, n,", "lo, hi, segments.n,"))
def compaction_candidates(spark, sf):
    return segments.compactable(views.segments(spark, sf), _snap(spark, sf)).select("uid", "segment", "lo", "hi", "n", "bytes")


@query("""SELECT uid, segment, lo, hi FROM segments s, snapidx, maxidx m WHERE hi <= snap AND hi < m.n
    AND NOT EXISTS (SELECT 1 FROM live l WHERE l.idx BETWEEN s.lo AND s.hi)""")
def compaction_minor(spark, sf):
    candidates = segments.compactable(views.segments(spark, sf), _snap(spark, sf))
    return segments.unreferenced(candidates, views.live(spark, sf), 128).select("uid", "segment", "lo", "hi")


_GROUPS = f"""{_RECORDS}, {_INFO}, c AS (SELECT i.*, row_number() OVER (ORDER BY lo) AS k FROM i, snapidx, maxidx m WHERE hi <= snap AND hi < m.n AND n_live > 0),
    g AS (
        SELECT 0::BIGINT AS k, 0::BIGINT AS segment, 1::BIGINT AS g, {COUNT}::BIGINT AS cnt, {BYTES}::BIGINT AS size, false AS used, NULL::BIGINT AS grp
        UNION ALL SELECT k, segment, CASE WHEN sparse AND fits THEN g WHEN sparse AND used AND alone THEN g + 1 ELSE g + used::BIGINT END,
            CASE WHEN sparse AND fits THEN cnt - n_live WHEN sparse AND used AND alone THEN {COUNT} - n_live ELSE {COUNT} END,
            CASE WHEN sparse AND fits THEN size - live_bytes WHEN sparse AND used AND alone THEN {BYTES} - live_bytes ELSE {BYTES} END,
            sparse AND (fits OR used AND alone),
            CASE WHEN sparse AND fits THEN g WHEN sparse AND used AND alone THEN g + 1 END
        FROM (SELECT c.k, c.segment, g.g, g.cnt, g.size, g.used, c.n_live, c.live_bytes,
            c.n_live / c.n < 0.5 OR c.live_bytes / c.bytes < 0.5 AS sparse, c.n_live <= g.cnt AND c.live_bytes <= g.size AS fits,
            c.n_live <= {COUNT} AND c.live_bytes <= {BYTES} AS alone FROM g JOIN c ON c.k = g.k + 1))"""


def _groups(spark, sf):
    return segments.groups(segments.compactable(_info(spark, sf), _snap(spark, sf)), COUNT, BYTES)


@query(f"WITH RECURSIVE {_GROUPS} SELECT 'main' AS uid, segment, grp FROM g WHERE grp IS NOT NULL")
def compaction_groups(spark, sf):
    return _groups(spark, sf)


@query(f"""WITH RECURSIVE {_GROUPS}, t AS (SELECT segment, grp, min(segment) OVER (PARTITION BY grp) AS target FROM g WHERE grp IS NOT NULL)
    SELECT r.uid, r.segment, r.idx, r.bytes, t.target FROM rec r JOIN live l ON r.uid = l.uid AND r.idx = l.idx JOIN t ON t.segment = r.segment""")
def compaction_major_copy(spark, sf):
    return segments.copied(_records(spark, sf), views.live(spark, sf), _groups(spark, sf)).select("uid", "segment", "idx", "bytes", "target")


@query("""WITH RECURSIVE q AS (SELECT key::VARCHAR AS uid, idx AS n, CASE WHEN type = 'purchase' THEN 'major' ELSE 'minor' END AS asked, idx % 11 <> 0 AS live,
        row_number() OVER (PARTITION BY key ORDER BY idx) AS k FROM log),
    s AS (SELECT uid, n, k, CASE WHEN asked = 'major' AND live THEN 'major' ELSE 'minor' END AS kind,
        CASE WHEN asked = 'major' AND live THEN 0 ELSE 1 END AS c FROM q WHERE k = 1
        UNION ALL SELECT q.uid, q.n, q.k, CASE WHEN (q.asked = 'major' OR s.c >= 8) AND q.live THEN 'major' ELSE 'minor' END,
        CASE WHEN (q.asked = 'major' OR s.c >= 8) AND q.live THEN 0 ELSE s.c + 1 END FROM s JOIN q ON q.uid = s.uid AND q.k = s.k + 1)
    SELECT uid, n, kind FROM s""")
def compaction_schedule(spark, sf):
    asked = F.when(F.col("type") == "purchase", "major").otherwise("minor")
    rows = views.log(spark, sf).select(F.col("key").cast("string").alias("uid"), F.col("idx").alias("n"), asked.alias("asked"), (F.col("idx") % 11 != 0).alias("live"))
    return segments.schedule(rows, 8)


@query("""SELECT segment // 3 AS grp, CASE WHEN count(*) = 1 OR bool_or(segment % 5 = 0) THEN 'discard' ELSE 'finish_links' END AS action
    FROM segments GROUP BY 1""")
def compaction_recovery(spark, sf):
    s = views.segments(spark, sf)
    return segments.recovery(s.select(F.floor(F.col("segment") / 3).alias("grp"), F.col("segment").alias("name"), (F.col("segment") % 5 == 0).alias("is_compacting")))


_PLAN = f"""{_GROUPS}, all_c AS (SELECT i.* FROM i, snapidx, maxidx m WHERE hi <= snap AND hi < m.n),
    t AS (SELECT segment, min(segment) OVER (PARTITION BY grp) AS target FROM g WHERE grp IS NOT NULL),
    plan AS (SELECT c.uid, c.segment, CASE WHEN n_live = 0 THEN 'delete' WHEN target = c.segment THEN 'copy' WHEN target IS NOT NULL THEN 'link' ELSE 'keep' END AS action,
    CASE WHEN n_live > 0 THEN coalesce(target, c.segment) END AS target FROM all_c c LEFT JOIN t ON t.segment = c.segment)"""


def _plan(spark, sf):
    infos = segments.compactable(_info(spark, sf), _snap(spark, sf))
    return infos, segments.major_plan(infos, segments.groups(infos, COUNT, BYTES))


@query(f"WITH RECURSIVE {_PLAN} SELECT * FROM plan")
def compaction_plan(spark, sf):
    return _plan(spark, sf)[1]


@query(f"""WITH RECURSIVE {_PLAN} SELECT c.uid, c.segment, lo, hi, n, bytes FROM all_c c JOIN plan p ON p.segment = c.segment AND action = 'keep'
    UNION ALL SELECT r.uid, p.target, min(r.idx), max(r.idx), count(*), sum(r.bytes)::BIGINT FROM rec r JOIN live l ON r.uid = l.uid AND r.idx = l.idx
    JOIN plan p ON p.segment = r.segment AND action IN ('copy', 'link') GROUP BY r.uid, p.target""")
def compaction_result(spark, sf):
    infos, plan = _plan(spark, sf)
    live = _records(spark, sf).join(views.live(spark, sf), ["uid", "idx"], "left_semi")
    return segments.compacted(infos, plan, live)


@query("SELECT uid, count(*) AS segments, min(lo) AS lo, max(hi) AS hi, sum(n)::BIGINT AS entries, sum(bytes)::BIGINT AS bytes FROM segments GROUP BY uid")
def catalog_overview(spark, sf):
    return segments.catalog_overview(views.segments(spark, sf))


@query("""WITH f AS (SELECT p_partkey % 20 AS uid, p_partkey AS name, p_size AS age, CASE WHEN p_partkey % 3 = 0 THEN p_partkey + 20 WHEN p_partkey % 7 = 0 THEN -1 END AS target FROM part)
    SELECT l.uid, l.name, CASE WHEN r.name IS NULL THEN 'dangling' ELSE 'old' END AS reason FROM f l LEFT JOIN f r ON r.uid = l.uid AND r.name = l.target AND r.target IS NULL
    WHERE l.target IS NOT NULL AND (r.name IS NULL OR l.age > 30)""")
def purge_links(spark, sf):
    p = views.read(spark, sf, "part")
    k = F.col("p_partkey")
    target = F.when(k % 3 == 0, k + 20).when(k % 7 == 0, F.lit(-1))
    return segments.purgeable_links(p.select((k % 20).alias("uid"), k.alias("name"), F.col("p_size").alias("age"), target.alias("target")), 30)
