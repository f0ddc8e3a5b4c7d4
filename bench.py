"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINES = [
    "kv_current_state",
    "kv_get_materialized",
    "kv_delete_replies",
    "log_visible",
    "wal_gap_detect",
    "wal_admission",
    "seq_compress",
    "log_sparse_read",
    "segment_info",
    "compaction_groups",
    "fold_nonassoc",
    "fold_simple_running",
    "machine_version_asof",
    "checkpoint_promote_asof",
    "quorum_commit",
    "rate_leaky",
    "fifo_exactly_once",
    "queue_match",
]


def fifo_apply(spark):
    """The one workload with a published time: 99,999 enqueues, then 100,000 settles of a
    consumer that does not exist, applied one by one by the queue machine."""
    from pyspark.sql import functions as F

    from tideline.operators import fifo

    n = F.col("id")
    none = lambda kind: F.lit(None).cast(kind)
    commands = spark.range(1, 200_000).select(
        F.lit(1).cast("long").alias("queue"), n.alias("idx"), F.when(n < 100_000, "enqueue").otherwise("settle").alias("event"), (n >= 100_000).cast("long").alias("pid"),
        F.when(n < 100_000, n).alias("seqno"), F.array(n - 100_000).alias("ids"), none("string").alias("life"), none("long").alias("credit"),
    )
    return fifo.overview(commands)


def main() -> None:
    from pyspark.sql import SparkSession

    from tideline.plans import registry

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    jobs = {name: (lambda f=registry.QUERIES[name]: f(spark, sf)) for name in HEADLINES}
    jobs["fifo_apply_100k"] = lambda: fifo_apply(spark)
    took = {}
    for name, build in jobs.items():
        times = []
        for _ in range(2):  # the first compiles
            start = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        took[name] = round(times[1], 4)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
