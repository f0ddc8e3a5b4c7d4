"""Rates, counters, status views."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def leaky_rate(events: DataFrame, by: str, order: str, tau_ms: float) -> DataFrame:
    """``by, value, rate`` of a leaky integrator per key: the value decays with time constant
    ``tau_ms`` between updates; an update from before the clock adds without decay and leaves
    the clock. ``events`` has ``t`` (ms, double) and ``amount``."""
    rows = F.array_sort(F.collect_list(F.struct(order, "t", "amount")))
    zero = F.struct(F.lit(None).cast("double").alias("t"), F.lit(0.0).alias("v"))

    def step(a: Column, x: Column) -> Column:
        decayed = F.when(a["t"].isNull(), F.lit(0.0)).when(x["t"] > a["t"], a["v"] * F.exp((a["t"] - x["t"]) / tau_ms)).otherwise(a["v"])
        return F.struct(F.greatest(a["t"], x["t"]).alias("t"), (decayed + x["amount"]).alias("v"))

    out = events.groupBy(by).agg(F.aggregate(rows, zero, step)["v"].alias("value"))
    return out.withColumn("rate", F.col("value") / tau_ms * 1000)


def deltas(samples: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Increase of a monotone counter between samples; a fall is a reset."""
    before = F.lag(value).over(Window.partitionBy(by).orderBy(order))
    change = F.col(value) - before
    return samples.withColumn("delta", F.when(change < 0, F.col(value)).otherwise(change))


def per_second(events: DataFrame, ts: str = "ts") -> DataFrame:
    return events.groupBy(F.date_trunc("second", ts).alias("second")).agg(F.count("*").alias("ops"))


def latency(commands: DataFrame, batch: Column) -> DataFrame:
    """Commit latency of each applied batch: from the last command's time to the batch's end."""
    return commands.groupBy(batch.alias("batch")).agg(F.max_by(F.col("applied_ms") - F.col("ts_ms"), "idx").alias("latency_ms"))


def pivot_counters(samples: DataFrame, fields: list[str]) -> DataFrame:
    """One row per name with a column per field, sums of counter samples."""
    return samples.groupBy("name").agg(*(F.coalesce(F.sum(F.when(F.col("field") == f, F.col("value"))), F.lit(0.0)).alias(f) for f in fields))


def latest_gauges(samples: DataFrame) -> DataFrame:
    return samples.groupBy("name", "field").agg(F.max_by("value", "seq").alias("value"))


def directory(names: DataFrame, states: DataFrame, snapshots: DataFrame) -> DataFrame:
    """All registered names with state and snapshot where known, defaults where not."""
    j = names.join(states, "name", "left").join(snapshots, "uid", "left")
    return j.select("name", "uid", F.coalesce("state", F.lit("undefined")).alias("state"), F.coalesce("snap_idx", F.lit(-1).cast("long")).alias("snap_idx"))


def leaderboard(records: DataFrame) -> DataFrame:
    """Last leader and members recorded for each cluster."""
    return records.groupBy("cluster").agg(F.max_by("leader", "seq").alias("leader"), F.max("seq").alias("seq"))


def usage(spans: DataFrame, by: str, half_life: float) -> DataFrame:
    """Time-weighted moving average of the active share over ``(order, active, inactive)``
    spans in microseconds; the first span sets it."""
    rows = F.array_sort(F.collect_list(F.struct("seq", "active", "inactive")))
    k = math.log(0.5) / half_life

    def step(a: Column, x: Column) -> Column:
        time = x["active"] + x["inactive"]
        share = x["active"] / time
        w = F.exp(time * k)
        return F.when(time == 0, a).when(a.isNull(), share).otherwise(share * (1 - w) + a * w)

    return spans.groupBy(by).agg(F.aggregate(rows, F.lit(None).cast("double"), step).alias("usage"))


def monitors(events: DataFrame) -> DataFrame:
    """Components that watch each target after adds and removes: last event per pair wins."""
    last = events.groupBy("target", "component").agg(F.max_by("action", "seq").alias("a")).filter("a = 'add'")
    return last.groupBy("target").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("component")), ",").alias("components"))


def throughput(events: DataFrame, by: str) -> DataFrame:
    span = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6
    return events.groupBy(by).agg(F.count("*").alias("ops"), F.when(span > 0, F.count("*") / span).alias("ops_per_second"))


def key_metrics(members: DataFrame, samples: DataFrame, fields: list[str]) -> DataFrame:
    """Latest value of each key field per member; members without samples are ``noproc``."""
    last = latest_gauges(samples)
    wide = last.groupBy("name").agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields))
    state = F.when(F.coalesce(*(F.col(f) for f in fields)).isNull(), "noproc").otherwise("running")
    return members.join(wide, "name", "left").select("name", state.alias("state"), *fields)
