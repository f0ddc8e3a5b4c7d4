"""Order and placement of work: members nearest first, shuffled lists, parallel shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def local_rank(items: DataFrame, by: str, is_local: Column, order: str) -> DataFrame:
    """Adds ``rank`` within each ``by``: local items first, else in ``order``."""
    w = Window.partitionBy(by).orderBy((~is_local).cast("int"), order)
    return items.withColumn("rank", F.row_number().over(w).cast("long"))


def shuffled(items: DataFrame, by: str, seed: int) -> DataFrame:
    """Adds ``rank`` within each ``by`` in an order that only ``seed`` decides: the same rows give
    the same order however they are partitioned."""
    own = [c for c in items.columns if c != by]
    w = Window.partitionBy(by).orderBy(F.xxhash64(F.lit(seed), *own), *own)
    return items.withColumn("rank", F.row_number().over(w).cast("long"))


def partitioned(items: DataFrame, key: str, workers: int) -> DataFrame:
    """Adds ``worker``, the share of parallel work that an item belongs to; items of one share
    are in one partition."""
    return items.withColumn("worker", F.pmod(F.col(key), F.lit(workers)).cast("long")).repartition(workers, "worker")
