"""Running aggregates over one long ordered sequence without one long task.

A window with no partition puts a whole log into one task. Here the sequence is
cut into blocks by its order column: blocks are summarised (with map-side partial
aggregation), the small table of blocks is scanned, and the scan's result is
joined back as each block's starting value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 1 << 16


def _block(order: str, block: int) -> Column:
    return F.floor(F.col(order) / block)


def running_sum(df: DataFrame, value: str, out: str, by: list[str], order: str, block: int = BLOCK) -> DataFrame:
    """Adds ``out``: the sum of ``value`` up to and including each row (``order`` is unique and numeric)."""
    df = df.withColumn("__block", _block(order, block))
    ahead = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*by, "__block").agg(F.sum(value).alias("__s")).withColumn("__start", F.coalesce(F.sum("__s").over(ahead), F.lit(0)))
    inside = Window.partitionBy(*by, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = df.join(sums.drop("__s"), [*by, "__block"])
    return joined.withColumn(out, F.col("__start") + F.sum(value).over(inside)).drop("__block", "__start")


def running_max(df: DataFrame, value: str, out: str, by: list[str], order: str, block: int = BLOCK) -> DataFrame:
    """Adds ``out``: the greatest ``value`` up to and including each row."""
    df = df.withColumn("__block", _block(order, block))
    ahead = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    tops = df.groupBy(*by, "__block").agg(F.max(value).alias("__m")).withColumn("__start", F.max("__m").over(ahead))
    inside = Window.partitionBy(*by, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = df.join(tops.drop("__m"), [*by, "__block"])
    return joined.withColumn(out, F.greatest(F.max(value).over(inside), F.col("__start"))).drop("__block", "__start")


def later_min(df: DataFrame, value: str, out: str, by: list[str], order: str, block: int = BLOCK) -> DataFrame:
    """Adds ``out``: the least ``value`` of the rows after each row, null for the last."""
    df = df.withColumn("__block", _block(order, block))
    # From the end backwards: a growing frame costs one step a row, a shrinking one all of it.
    behind = Window.partitionBy(*by).orderBy(F.desc("__block")).rowsBetween(Window.unboundedPreceding, -1)
    low = df.groupBy(*by, "__block").agg(F.min(value).alias("__m")).withColumn("__later", F.min("__m").over(behind))
    inside = Window.partitionBy(*by, "__block").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(low.drop("__m"), [*by, "__block"])
    return joined.withColumn(out, F.least(F.min(value).over(inside), F.col("__later"))).drop("__block", "__later")


def last_value(df: DataFrame, value: Column, out: str, by: list[str], order: list[Column], block: Column) -> DataFrame:
    """Adds ``out``: the last non-null ``value`` up to and including each row; ``block`` must
    not decrease along ``order``."""
    df = df.withColumns({"__block": block, "__v": value})
    key = F.struct(*order)
    ahead = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    ends = df.filter("__v is not null").groupBy(*by, "__block").agg(F.max_by("__v", key).alias("__e"))
    every = df.select(*by, "__block").distinct().join(ends, [*by, "__block"], "left")
    every = every.withColumn("__start", F.last("__e", ignorenulls=True).over(ahead)).drop("__e")
    inside = Window.partitionBy(*by, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = df.join(every, [*by, "__block"])
    return joined.withColumn(out, F.coalesce(F.last("__v", ignorenulls=True).over(inside), F.col("__start"))).drop("__block", "__v", "__start")
