"""Log-shaped views over the driver's tables, for Spark and as SQL.

``CTES`` holds the same views as DuckDB common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import scan

SEGMENT = 128


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def log(spark: SparkSession, sf: str) -> DataFrame:
    """One entry per event; terms are days, keys are users, errors are deletes."""
    e = read(spark, sf, "events")
    return e.select(
        F.lit("main").alias("uid"),
        (F.col("event_id") + 1).alias("idx"),
        (F.unix_date(F.to_date("ts")) + 1).cast("long").alias("term"),
        "ts",
        F.col("user_id").alias("key"),
        F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"),
        F.col("event_type").alias("type"),
        F.col("value").alias("amount"),
        F.col("props").alias("payload"),
    )


def logs(spark: SparkSession, sf: str) -> DataFrame:
    """Forty logs in one table, each with indexes of its own; ``seq`` is the place over all."""
    rows = log(spark, sf).withColumns({"k": F.col("key") % 40, "uid": F.concat(F.lit("log_"), F.col("key") % 40), "one": F.lit(1).cast("long")})
    rows = scan.running_sum(rows, "one", "nth", ["uid"], "idx")
    return rows.select("uid", "k", F.col("nth").alias("idx"), "term", "key", "op", "type", "payload", F.col("idx").alias("seq"))


def heads(spark: SparkSession, sf: str) -> DataFrame:
    return logs(spark, sf).groupBy("uid", "k").agg(F.max("idx").alias("n"))


def max_idx(spark: SparkSession, sf: str) -> DataFrame:
    return log(spark, sf).agg(F.max("idx").alias("n"))


def segments(spark: SparkSession, sf: str) -> DataFrame:
    seg = F.floor((F.col("idx") - 1) / SEGMENT) + 1
    return log(spark, sf).groupBy("uid", seg.alias("segment")).agg(
        F.min("idx").alias("lo"),
        F.max("idx").alias("hi"),
        F.count("*").alias("n"),
        F.sum(F.octet_length("payload").cast("long")).alias("bytes"),
    )


def writes(spark: SparkSession, sf: str) -> DataFrame:
    """The log, and after it a rewrite of a fiftieth of it in a later term."""
    first = log(spark, sf).withColumn("write_seq", 2 * (F.col("idx") - 1))
    n = F.broadcast(max_idx(spark, sf))
    again = (
        log(spark, sf)
        .crossJoin(n)
        .filter((F.col("idx") > F.floor(F.col("n") * 0.4)) & (F.col("idx") <= F.floor(F.col("n") * 0.42)))
        .withColumns(
            {
                "write_seq": 2 * F.col("n") + F.col("idx"),
                "term": F.col("term") + 1000,
                "idx": F.col("idx") - F.floor(F.col("n") * 0.005),
            }
        )
        .drop("n")
    )
    return first.unionByName(again)


def snapshot_idx(spark: SparkSession, sf: str) -> DataFrame:
    return max_idx(spark, sf).select(F.floor(F.col("n") * 0.9).alias("snap"))


def live(spark: SparkSession, sf: str) -> DataFrame:
    """Pointers that the key-value state holds at the snapshot."""
    before = log(spark, sf).crossJoin(F.broadcast(snapshot_idx(spark, sf))).filter("idx <= snap")
    last = before.groupBy("uid", "key").agg(F.max_by("op", "idx").alias("op"), F.max("idx").alias("idx"))
    return last.filter("op = 'put'").select("uid", "idx")


def wal(spark: SparkSession, sf: str) -> DataFrame:
    """Writers are orders, entries their lines; arrival is a total order within a writer."""
    li = read(spark, sf, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("uid"),
        F.col("l_linenumber").cast("long").alias("idx"),
        F.unix_date(F.to_date("l_shipdate")).cast("long").alias("term"),
        F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("arrival"),
        F.col("l_quantity").alias("amount"),
    )


def peers(spark: SparkSession, sf: str) -> DataFrame:
    """Customers, five to a cluster, with positions from their balances."""
    c = read(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("k"), F.pmod(F.floor("c_acctbal").cast("long"), F.lit(200)).alias("m"))
    k, m = F.col("k"), F.col("m")
    return c.select(
        F.floor(k / 5).cast("long").alias("cluster"),
        k.alias("member"),
        m.alias("match_index"),
        (m + 1 + k % 3).alias("next_index"),
        (m % 17).alias("query_index"),
        (m - k % 2).alias("commit_sent"),
        (k % 5 != 4).alias("voter"),
        F.when(k % 7 == 3, "suspended").otherwise("normal").alias("status"),
        F.when(k % 11 != 0, 1 + k % 3).cast("int").alias("machine_version"),
    )


def fifo(spark: SparkSession, sf: str) -> DataFrame:
    """Producers are conversations; every third message comes twice and every fourth late."""
    c = read(spark, sf, "conversations").select(
        F.col("conv_id").alias("producer"), (F.col("turn") + 1).cast("long").alias("seqno"), "role", "text"
    )
    at = F.col("seqno") * 10 + F.when(F.col("seqno") % 4 == 0, 15).otherwise(0)
    first = c.withColumn("arrival", at.cast("long"))
    twice = c.filter("seqno % 3 = 0").withColumn("arrival", (at + 25).cast("long"))
    return first.unionByName(twice)


def checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    return log(spark, sf).filter("idx % 97 = 0").select("uid", "idx", "term")


CTES = {
    "log": """SELECT 'main' AS uid, event_id + 1 AS idx, date_diff('day', DATE '1970-01-01', ts::DATE) + 1 AS term, ts,
        user_id AS key, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, event_type AS type,
        value AS amount, props AS payload FROM events""",
    "logs": """SELECT 'log_' || key % 40 AS uid, key % 40 AS k, row_number() OVER (PARTITION BY key % 40 ORDER BY idx) AS idx, term, key, op, type,
        payload, idx AS seq FROM log""",
    "heads": "SELECT uid, k, max(idx) AS n FROM logs GROUP BY uid, k",
    "gens": """SELECT *, sum(back) OVER (PARTITION BY uid ORDER BY write_seq)::BIGINT AS generation FROM
        (SELECT *, coalesce((lag(idx) OVER (PARTITION BY uid ORDER BY write_seq) >= idx)::INT, 0) AS back FROM writes)""",
    "maxidx": "SELECT max(idx) AS n FROM log",
    "segments": """SELECT uid, (idx - 1) // 128 + 1 AS segment, min(idx) AS lo, max(idx) AS hi, count(*) AS n,
        sum(octet_length(encode(payload)))::BIGINT AS bytes FROM log GROUP BY ALL""",
    "writes": """SELECT *, 2 * (idx - 1) AS write_seq FROM log UNION ALL
        SELECT uid, idx - floor(n * 0.005)::BIGINT, term + 1000, ts, key, op, type, amount, payload, 2 * n + idx
        FROM log, maxidx WHERE idx > floor(n * 0.4) AND idx <= floor(n * 0.42)""",
    "snapidx": "SELECT floor(n * 0.9)::BIGINT AS snap FROM maxidx",
    "live": """SELECT uid, idx FROM (SELECT uid, key, arg_max(op, idx) AS op, max(idx) AS idx FROM log, snapidx
        WHERE idx <= snap GROUP BY uid, key) WHERE op = 'put'""",
    "wal": """SELECT l_orderkey AS uid, l_linenumber::BIGINT AS idx, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) AS term,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber, l_quantity,
        l_extendedprice, l_discount, l_tax) AS arrival, l_quantity AS amount FROM lineitem""",
    "peers": """SELECT k // 5 AS cluster, k AS member, m AS match_index, m + 1 + k % 3 AS next_index, m % 17 AS query_index,
        m - k % 2 AS commit_sent, k % 5 <> 4 AS voter, CASE WHEN k % 7 = 3 THEN 'suspended' ELSE 'normal' END AS status,
        CASE WHEN k % 11 <> 0 THEN (1 + k % 3)::INT END AS machine_version
        FROM (SELECT c_custkey::BIGINT AS k, ((floor(c_acctbal)::BIGINT % 200) + 200) % 200 AS m FROM customer)""",
    "fifo": """SELECT conv_id AS producer, (turn + 1)::BIGINT AS seqno, role, text,
        ((turn + 1) * 10 + CASE WHEN (turn + 1) % 4 = 0 THEN 15 ELSE 0 END)::BIGINT AS arrival FROM conversations UNION ALL
        SELECT conv_id, turn + 1, role, text, ((turn + 1) * 10 + CASE WHEN (turn + 1) % 4 = 0 THEN 15 ELSE 0 END + 25)::BIGINT
        FROM conversations WHERE (turn + 1) % 3 = 0""",
    "ckpt": "SELECT uid, idx, term FROM log WHERE idx % 97 = 0",
}
_NEEDS = {name: [o for o in CTES if o != name and re.search(rf"\b{o}\b", sql)] for name, sql in CTES.items()}


def with_views(sql: str) -> str:
    """``sql`` preceded by the views that it names."""
    order: list[str] = []

    def add(name: str) -> None:
        for o in _NEEDS[name]:
            add(o)
        if name not in order:
            order.append(name)

    for name in CTES:
        if re.search(rf"\b{name}\b", sql):
            add(name)
    if not order:
        return sql
    head = ", ".join(f"{n} AS ({CTES[n]})" for n in order)
    m = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    return f"WITH {m[1] or ''}{head}, {sql[m.end():]}" if m else f"WITH {head} {sql}"
