"""Index-set and range algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import ranges
from tideline.operators import indexset
from tideline.plans import views
from tideline.plans.registry import query


def _puts(spark, sf):
    """Indexes that each key's puts use."""
    return views.log(spark, sf).filter("op = 'put'").select(F.col("key").cast("string").alias("owner"), "idx")


def _clicks(spark, sf):
    return views.log(spark, sf).filter("type <> 'view'").select(F.col("uid").alias("owner"), "idx")


_PUTS = "SELECT key::VARCHAR AS owner, idx FROM log WHERE op = 'put'"
_CLICKS = "SELECT uid AS owner, idx FROM log WHERE type <> 'view'"
_RANGES = f"""c AS ({_CLICKS}), r AS (SELECT owner, min(idx) AS lo, max(idx) AS hi FROM
    (SELECT owner, idx, idx - row_number() OVER (PARTITION BY owner ORDER BY idx) AS i FROM c) GROUP BY owner, i)"""


@query(f"WITH {_RANGES} SELECT owner, lo, hi FROM r")
def seq_compress(spark, sf):
    return indexset.compress(_clicks(spark, sf), block=4096)


@query(f"WITH {_RANGES} SELECT owner, idx FROM c")
def seq_expand(spark, sf):
    return indexset.expand(indexset.compress(_clicks(spark, sf)))


@query(f"WITH {_RANGES} SELECT owner, sum(hi - lo + 1)::BIGINT AS n FROM r GROUP BY owner")
def seq_length(spark, sf):
    return indexset.length(indexset.compress(_clicks(spark, sf)))


@query(f"WITH p AS ({_PUTS}) SELECT owner, min(idx) AS first, max(idx) AS last FROM p GROUP BY owner")
def seq_bounds(spark, sf):
    return indexset.bounds(_puts(spark, sf))


@query(f"WITH p AS ({_PUTS}), l AS (SELECT key::VARCHAR AS owner, idx FROM log WHERE type = 'click') SELECT * FROM p EXCEPT SELECT * FROM l")
def seq_subtract(spark, sf):
    clicks = views.log(spark, sf).filter("type = 'click'").select(F.col("key").cast("string").alias("owner"), "idx")
    return indexset.subtract(_puts(spark, sf), clicks)


@query(f"""WITH p AS ({_PUTS}), a AS (SELECT owner, idx FROM p WHERE idx % 7 = 0 AND idx > (SELECT n // 4 FROM maxidx)),
    f AS (SELECT owner, min(idx) AS m FROM a GROUP BY owner)
    SELECT p.owner, idx FROM p LEFT JOIN f ON p.owner = f.owner WHERE m IS NULL OR idx < m UNION ALL SELECT * FROM a""")
def seq_overlay(spark, sf):
    p = _puts(spark, sf)
    return indexset.overlay(p.filter("idx % 7 = 0").crossJoin(F.broadcast(views.max_idx(spark, sf))).filter("idx > n div 4").drop("n"), p)


@query(f"WITH {_RANGES} SELECT s.uid AS owner, s.idx FROM live s WHERE EXISTS (SELECT 1 FROM r WHERE s.uid = r.owner AND s.idx BETWEEN lo AND hi)")
def seq_in(spark, sf):
    held = views.live(spark, sf).withColumnRenamed("uid", "owner")
    return indexset.contains(held, indexset.compress(_clicks(spark, sf)))


@query(f"""WITH {_RANGES} SELECT uid AS owner, lo, hi, segment FROM segments s
    WHERE EXISTS (SELECT 1 FROM r WHERE r.owner = s.uid AND r.hi - r.lo >= 3 AND r.lo <= s.hi AND r.hi >= s.lo)""")
def seq_has_overlap(spark, sf):
    long = indexset.compress(_clicks(spark, sf)).filter("hi - lo >= 3")
    return indexset.overlapping(views.segments(spark, sf).select(F.col("uid").alias("owner"), "lo", "hi", "segment"), long)


@query(f"""WITH p AS ({_PUTS}), x AS (SELECT owner, idx FROM p WHERE idx <= (SELECT n // 2 FROM maxidx) AND (owner::BIGINT % 3 <> 0 OR idx % 5 <> 0)),
    l AS (SELECT * FROM p EXCEPT SELECT * FROM x), e AS (SELECT owner, max(idx) AS m FROM x GROUP BY owner)
    SELECT l.owner, idx, coalesce(min(idx) OVER (PARTITION BY l.owner) < m, false) AS not_prefix
    FROM l LEFT JOIN e ON l.owner = e.owner""")
def seq_remove_prefix(spark, sf):
    p = _puts(spark, sf)
    head = p.filter("cast(owner as long) % 3 <> 0 or idx % 5 <> 0").crossJoin(F.broadcast(views.max_idx(spark, sf))).filter("idx <= n div 2").drop("n")
    return indexset.remove_prefix(head, p)


@query(f"""WITH p AS ({_PUTS}), n AS (SELECT owner, idx, (row_number() OVER (PARTITION BY owner ORDER BY idx) - 1) // 16 AS chunk FROM p)
    SELECT owner, chunk, count(*) AS n, min(idx) AS first, max(idx) AS last FROM n GROUP BY owner, chunk""")
def seq_chunk(spark, sf):
    return indexset.chunk(_puts(spark, sf), 16)


@query(f"""WITH p AS ({_PUTS}) SELECT owner, list_reduce(list_prepend(7::BIGINT, list(idx ORDER BY idx)), lambda a, x: (a * 31 + x) % 1000003) AS value
    FROM p GROUP BY owner""")
def seq_fold(spark, sf):
    return indexset.fold(_puts(spark, sf), F.lit(7).cast("long"), lambda a, x: (a * 31 + x) % 1000003)


def _pairs(spark, sf):
    """Each segment with a range that is a third wider and shifted."""
    s = views.segments(spark, sf)
    shift = (F.col("segment") * 37) % 300 - 150
    return s.select("segment", ranges.new(F.col("lo"), F.col("hi")).alias("r"), ranges.new(F.col("lo") + shift, F.col("lo") + shift + 40).alias("x"))


_PAIRS = "p AS (SELECT segment, lo, hi, lo + (segment * 37) % 300 - 150 AS xl, lo + (segment * 37) % 300 - 110 AS xh FROM segments)"


@query(f"""WITH {_PAIRS} SELECT segment, CASE WHEN greatest(lo, xl) <= least(hi, xh) THEN greatest(lo, xl) END AS lo,
    CASE WHEN greatest(lo, xl) <= least(hi, xh) THEN least(hi, xh) END AS hi,
    CASE WHEN greatest(lo, xl) <= least(hi, xh) THEN least(hi, xh) - greatest(lo, xl) + 1 ELSE 0 END AS size FROM p""")
def range_overlap(spark, sf):
    o = _pairs(spark, sf).withColumn("o", ranges.overlap(F.col("r"), F.col("x")))
    return o.select("segment", "o.lo", "o.hi", ranges.size(F.col("o")).alias("size"))


@query(f"""WITH {_PAIRS} SELECT segment, lo, least(hi, xl - 1) AS hi FROM p WHERE lo <= least(hi, xl - 1)
    UNION ALL SELECT segment, greatest(lo, xh + 1), hi FROM p WHERE greatest(lo, xh + 1) <= hi""")
def range_subtract(spark, sf):
    return _pairs(spark, sf).select("segment", F.inline(ranges.subtract(F.col("x"), F.col("r"))))


@query(f"""WITH {_PAIRS} SELECT segment, CASE WHEN lo <= xh + 1 AND xl <= hi + 1 THEN least(lo, xl) ELSE xl END AS add_lo,
    CASE WHEN lo <= xh + 1 AND xl <= hi + 1 THEN greatest(hi, xh) ELSE xh END AS add_hi, least(lo, xl) AS combine_lo, xh AS combine_hi,
    CASE WHEN lo <= least(hi, xl - 1) THEN least(hi, xl - 1) END AS limit_hi,
    CASE WHEN greatest(lo, xl + 1) <= hi THEN greatest(lo, xl + 1) END AS truncate_lo, xl BETWEEN lo AND hi AS holds FROM p""")
def range_algebra(spark, sf):
    r, x = F.col("r"), F.col("x")
    return _pairs(spark, sf).select(
        "segment",
        ranges.add(x, r)["lo"].alias("add_lo"),
        ranges.add(x, r)["hi"].alias("add_hi"),
        ranges.combine(x, r)["lo"].alias("combine_lo"),
        ranges.combine(x, r)["hi"].alias("combine_hi"),
        ranges.limit(x["lo"], r)["hi"].alias("limit_hi"),
        ranges.truncate(x["lo"], r)["lo"].alias("truncate_lo"),
        ranges.contains(x["lo"], r).alias("holds"),
    )
