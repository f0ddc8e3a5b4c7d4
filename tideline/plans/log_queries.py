"""Log operators: effective log, reads, matching, admission."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import scalars
from tideline.operators import logops
from tideline.plans import views
from tideline.plans.registry import query

_VISIBLE = """SELECT * EXCLUDE (later) FROM (SELECT *, min(idx) OVER (PARTITION BY uid ORDER BY write_seq
    ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM writes) WHERE later IS NULL OR later > idx"""


@query(f"WITH v AS ({_VISIBLE}) SELECT uid, idx, term, key, op, write_seq FROM v")
def log_visible(spark, sf):
    return logops.visible(views.writes(spark, sf)).select("uid", "idx", "term", "key", "op", "write_seq")


@query("SELECT uid, idx, arg_max(term, write_seq) AS term, arg_max(key, write_seq) AS key, max(write_seq) AS write_seq FROM writes GROUP BY uid, idx")
def wal_dedup_latest(spark, sf):
    return logops.latest_by_index(views.writes(spark, sf)).select("uid", "idx", "term", "key", "write_seq")


@query("SELECT uid, term, min(idx) AS lo, max(idx) AS hi, count(*) AS n FROM log GROUP BY uid, term")
def term_runs(spark, sf):
    return logops.term_runs(views.log(spark, sf))


def _wanted(spark, sf):
    """Every 13th index, from the back, with some beyond the end."""
    n = views.max_idx(spark, sf)
    return n.select(F.posexplode(F.expr("transform(sequence(0L, n div 13), x -> n + 40 - 13 * x)"))).toDF("pos", "idx")


_WANTED = "w AS (SELECT i::INT AS pos, n + 40 - 13 * i AS idx FROM maxidx, range(0, 1 + n // 13) t(i))"


@query(f"WITH {_WANTED} SELECT pos, idx, term, key, payload FROM w JOIN log USING (idx)")
def log_sparse_read(spark, sf):
    return logops.sparse_read(views.log(spark, sf), _wanted(spark, sf)).select("pos", "idx", "term", "key", "payload")


@query(f"""WITH {_WANTED} SELECT uid, segment, count(*) AS n, min(idx) AS first, max(idx) AS last
    FROM w JOIN segments s ON idx BETWEEN lo AND hi GROUP BY uid, segment""")
def log_read_plan(spark, sf):
    wanted = _wanted(spark, sf).select(F.lit("main").alias("uid"), "idx")
    return logops.read_plan(wanted, views.segments(spark, sf))


@query("""SELECT c.uid, c.idx + 1 AS idx, coalesce(l.term, k.term) AS term FROM ckpt c
    LEFT JOIN (SELECT log.* FROM log, maxidx WHERE idx > n // 20) l ON l.idx = c.idx + 1 LEFT JOIN ckpt k ON k.idx = c.idx + 1""")
def log_fetch_term(spark, sf):
    ck = views.checkpoints(spark, sf)
    left = views.log(spark, sf).crossJoin(F.broadcast(views.max_idx(spark, sf))).filter("idx > n div 20").drop("n")
    return logops.fetch_term(ck.select("uid", (F.col("idx") + 1).alias("idx")), left, ck)


@query("""SELECT uid, min(idx) AS first_idx, max(idx) AS last_idx, arg_max(term, idx) AS last_term, max(idx) + 1 AS next_idx,
    count(*) AS entries, count(DISTINCT term) AS terms FROM log GROUP BY uid""")
def log_overview(spark, sf):
    return logops.overview(views.log(spark, sf))


@query("""SELECT uid, idx, term, prev + 1 AS resend_from FROM (SELECT *, lag(idx) OVER (PARTITION BY uid ORDER BY arrival) AS prev
    FROM wal) WHERE idx > prev + 1""")
def wal_gap_detect(spark, sf):
    return logops.gaps(views.wal(spark, sf)).select("uid", "idx", "term", "resend_from")


# Half of the writers write sparsely and name an older predecessor; a fifth has a snapshot.
_ADMIT = """a AS (SELECT *, idx - 1 - CASE WHEN uid % 2 = 0 AND idx % 3 = 0 THEN 1 ELSE 0 END AS prev, CASE WHEN uid % 5 = 0 THEN 3 ELSE 0 END AS low FROM wal)"""


@query(f"""WITH RECURSIVE {_ADMIT}, s AS (
    SELECT uid, idx, term, arrival, CASE WHEN idx < low THEN low - 1 ELSE idx END AS last, true AS ok,
           CASE WHEN idx < low THEN 'below' ELSE 'accepted' END AS status, false AS truncates FROM a WHERE arrival = 1 UNION ALL
    SELECT a.uid, a.idx, a.term, a.arrival,
           CASE WHEN a.idx < low THEN low - 1 WHEN a.prev <= s.last OR a.idx = low THEN a.idx ELSE s.last END,
           a.idx < low OR a.prev <= s.last OR a.idx = low,
           CASE WHEN a.idx < low THEN 'below' WHEN a.prev <= s.last OR a.idx = low THEN 'accepted' WHEN s.ok THEN 'resend' ELSE 'dropped' END,
           a.idx = low FROM s JOIN a ON a.uid = s.uid AND a.arrival = s.arrival + 1)
    SELECT uid, idx, term, (arrival - 1)::INT AS n, status, truncates FROM s""")
def wal_admission(spark, sf):
    wal = views.wal(spark, sf)
    sparse = (F.col("uid") % 2 == 0) & (F.col("idx") % 3 == 0)
    floors = wal.filter("uid % 5 = 0").select("uid").distinct().withColumn("smallest", F.lit(3).cast("long"))
    return logops.admission(wal.withColumn("prev", F.col("idx") - 1 - sparse.cast("long")), floors)


@query("SELECT (idx - 1) // 1000 AS batch, uid, term, min(idx) AS lo, max(idx) AS hi, count(*) AS n FROM writes GROUP BY ALL")
def wal_batch_ranges(spark, sf):
    return logops.batch_ranges(views.writes(spark, sf).withColumn("batch", F.floor((F.col("idx") - 1) / 1000)))


@query("""WITH RECURSIVE r AS (SELECT uid, idx, octet_length(encode(payload)) AS b FROM log),
    f AS (SELECT uid, idx, b AS held, 1 AS n, 0::BIGINT AS file FROM r WHERE idx = 1 UNION ALL
    SELECT r.uid, r.idx, CASE WHEN held > 1024 OR n + 1 > 128 THEN b ELSE held + b END, CASE WHEN held > 1024 OR n + 1 > 128 THEN 1 ELSE n + 1 END,
           CASE WHEN held > 1024 OR n + 1 > 128 THEN file + 1 ELSE file END FROM f JOIN r ON r.uid = f.uid AND r.idx = f.idx + 1)
    SELECT uid, idx, file FROM f""")
def wal_roll_files(spark, sf):
    return logops.file_numbers(views.log(spark, sf), F.octet_length("payload"), 1024, 128)


@query("""SELECT count(*) AS n, count(*) FILTER (idx % 10 = 0) AS unchecked, count(*) FILTER (idx % 10 = 0 OR idx % 7 <> 0) AS ok FROM log""")
def wal_checksum(spark, sf):
    """Every tenth row has no checksum, and of the rest every seventh has another payload's."""
    rows = views.log(spark, sf).withColumn("p", F.col("payload").cast("binary"))
    damaged = F.when(F.col("idx") % 7 == 0, F.concat(F.col("p"), F.lit("x").cast("binary"))).otherwise(F.col("p"))
    rows = rows.withColumn("crc", F.when(F.col("idx") % 10 == 0, 0).otherwise(F.crc32(damaged)))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("crc") == 0).alias("unchecked"), F.count_if(logops.checksum_ok(F.col("p"), F.col("crc"))).alias("ok"))


@query("SELECT uid, max(idx) AS last_idx, count(*) AS n FROM wal GROUP BY uid")
def wal_last_writer_seq(spark, sf):
    return logops.last_per_writer(views.wal(spark, sf))


_META = """m AS (SELECT key::VARCHAR AS uid, idx AS seq, CASE type WHEN 'error' THEN 'current_term' WHEN 'click' THEN 'voted_for'
    ELSE 'last_applied' END AS field, idx % 97 AS value FROM log)"""


@query(f"""WITH {_META}, a AS (SELECT uid, arg_max(value, seq) FILTER (field = 'current_term') AS current_term,
    arg_max(value, seq) FILTER (field = 'voted_for') AS v, arg_max(value, seq) FILTER (field = 'last_applied') AS last_applied,
    max(seq) FILTER (field = 'current_term') AS ts, max(seq) FILTER (field = 'voted_for') AS vs FROM m GROUP BY uid)
    SELECT uid, current_term, CASE WHEN coalesce(vs > ts, ts IS NULL) THEN v END AS voted_for, last_applied FROM a""")
def meta_fetch(spark, sf):
    field = F.when(F.col("type") == "error", "current_term").when(F.col("type") == "click", "voted_for").otherwise("last_applied")
    rows = views.log(spark, sf).select(F.col("key").cast("string").alias("uid"), F.col("idx").alias("seq"), field.alias("field"), (F.col("idx") % 97).alias("value"))
    return logops.latest_meta(rows)


@query("""WITH RECURSIVE q AS (SELECT key, idx, epoch_us(ts) AS us, row_number() OVER (PARTITION BY key ORDER BY ts, idx) AS k FROM log),
    s AS (SELECT key, idx, k, us AS last, true AS go FROM q WHERE k = 1 UNION ALL
    SELECT q.key, q.idx, q.k, CASE WHEN us > last + 259200000000 THEN us ELSE last END, us > last + 259200000000
    FROM s JOIN q ON q.key = s.key AND q.k = s.k + 1) SELECT idx, key FROM s WHERE go""")
def resend_rate_limit(spark, sf):
    """At most one resend of a writer in three days, a window that binds on these events."""
    rows = views.log(spark, sf).select("key", "idx", F.col("ts").cast("timestamp").alias("ts"))
    return logops.debounce(rows, "key", "ts", 3 * 86_400).select("idx", "key")


@query("""SELECT uid, idx FROM log, snapidx WHERE idx > snap OR idx IN (SELECT idx FROM live)""")
def retention_filter(spark, sf):
    state = views.snapshot_idx(spark, sf)
    rows = views.log(spark, sf).join(views.live(spark, sf).withColumn("is_live", F.lit(True)), ["uid", "idx"], "left")
    rows = rows.withColumn("is_live", F.coalesce("is_live", F.lit(False)))
    return logops.flushable(rows, state.withColumn("uid", F.lit("main"))).select("uid", "idx")


@query("""WITH c AS (SELECT uid, idx, CASE WHEN type = 'view' THEN 'low' ELSE 'normal' END AS priority FROM log),
    n AS (SELECT *, row_number() OVER (PARTITION BY uid, priority ORDER BY idx) - 1 AS k FROM c)
    SELECT uid, idx, priority, CASE WHEN priority = 'low' THEN k // 16 END AS batch FROM n""")
def low_priority_batches(spark, sf):
    rows = views.log(spark, sf).select("uid", "idx", F.when(F.col("type") == "view", "low").otherwise("normal").alias("priority"))
    return logops.low_priority_batches(rows).select("uid", "idx", "priority", "batch")


@query("""SELECT p_partkey AS id, lpad(to_hex(p_partkey), 16, '0') AS hex, lpad(p_partkey::VARCHAR, 16, '0') || '.segment' AS file,
    lpad((p_partkey + 1)::VARCHAR, 16, '0') || '.segment' AS next, p_partkey AS num FROM part""")
def zpad_names(spark, sf):
    p = views.read(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    p = p.withColumn("file", scalars.zpad_filename(F.col("id"), "segment"))
    return p.select("id", scalars.zpad_hex(F.col("id")).alias("hex"), "file", scalars.zpad_incr(F.col("file")).alias("next"), scalars.zpad_num(F.col("file")).alias("num"))


@query("""SELECT page_id, substr(regexp_replace(url, '[^A-Za-z0-9_=-]', '', 'g'), 1, 6) AS prefix,
    regexp_matches(url, '^[A-Za-z0-9_=-]*$') AS valid FROM pages""")
def safe_string(spark, sf):
    p = views.read(spark, sf, "pages")
    return p.select("page_id", scalars.safe_string(F.col("url"), 6).alias("prefix"), scalars.is_safe(F.col("url")).alias("valid"))


@query("""SELECT doc_id, i::INT AS chunk, substr(text, 1 + 1000 * i, 1000) AS data FROM documents, range(0, 1000) t(i)
    WHERE i < greatest(1, ceil(length(text) / 1000.0))""")
def chunk_blobs(spark, sf):
    return scalars.chunks(views.read(spark, sf, "documents").select("doc_id", "text"), "text", 1000)


@query("SELECT doc_id, md5(text) AS digest, length(text) AS n FROM documents")
def chunk_reassemble(spark, sf):
    parts = chunk_blobs(spark, sf)
    return scalars.reassembled(parts, "doc_id").select("doc_id", F.md5("data").alias("digest"), F.length("data").cast("long").alias("n"))
