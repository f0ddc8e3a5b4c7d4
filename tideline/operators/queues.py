"""Exactly-once ordered queues."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.functions.ordered import ordered_rows


def exactly_once(deliveries: DataFrame) -> DataFrame:
    """Messages that producers' deliveries lead to: per producer the first delivery of each
    sequence number, as far as the numbers run from 1 without a hole; ``enqueued_at`` is the
    arrival that let the message in (a late predecessor holds it back)."""
    first = deliveries.groupBy("producer", "seqno").agg(F.min("arrival").alias("arrival"))
    order = Window.partitionBy("producer").orderBy("seqno")
    rows = first.withColumn("_n", F.row_number().over(order)).filter("_n = seqno")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("enqueued_at", F.max("arrival").over(upto)).drop("_n")


def ready(messages: DataFrame, events: DataFrame) -> DataFrame:
    """Per producer: messages ready, checked out, settled and dead, by the last event of each."""
    last = events.groupBy("producer", "seqno").agg(F.max_by("event", "arrival").alias("event"))
    j = messages.join(last, ["producer", "seqno"], "left")
    count = lambda e: F.count_if(F.col("event") == e)
    return j.groupBy("producer").agg(
        F.count_if(F.col("event").isNull() | (F.col("event") == "return")).alias("ready"),
        count("checkout").alias("checked_out"),
        count("settle").alias("settled"),
        count("discard").alias("dead"),
    )


def redelivery(events: DataFrame) -> DataFrame:
    """Delivery count of each message: how often it was returned."""
    return events.groupBy("producer", "seqno").agg(F.count_if(F.col("event") == "return").alias("delivery_count"))


def low_watermark(messages: DataFrame, settled: DataFrame) -> DataFrame:
    """Smallest message that is not settled, per producer."""
    return messages.join(settled, ["producer", "seqno"], "left_anti").groupBy("producer").agg(F.min("seqno").alias("smallest"))


def matched(ops: DataFrame) -> DataFrame:
    """``queue, deq_idx, enq_idx``: the message that each dequeue (``op``: enq, deq) gets, null where
    the queue was empty at that point. One ordered pass; the messages in wait are held."""

    def step(waiting: deque, idx: int, op: str) -> list:
        if op == "enq":
            waiting.append(idx)
            return []
        return [(idx, waiting.popleft() if waiting else None)]

    return ordered_rows(ops, ["queue"], ["idx"], ["idx", "op"], "queue long, deq_idx long, enq_idx long", deque, step)
