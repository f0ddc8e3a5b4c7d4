"""Index sets: rows ``(owner, idx)``, or range-compressed rows ``(owner, lo, hi)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.functions import scan

BLOCK = 1 << 16


def compress(indexes: DataFrame, owner: str = "owner", idx: str = "idx", block: int = BLOCK) -> DataFrame:
    """Distinct indexes as maximal ranges. Islands are found block by block; only ranges at
    a block's edge, two per block at most, are looked at across blocks."""
    b = F.floor(F.col(idx) / block)
    rows = indexes.select(F.col(owner).alias("owner"), F.col(idx).alias("idx")).distinct().withColumn("_b", b)
    order = Window.partitionBy("owner", "_b").orderBy("idx")
    ranges = (
        rows.withColumn("_i", F.col("idx") - F.row_number().over(order))
        .groupBy("owner", "_b", "_i")
        .agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    )
    edge = (F.col("lo") % block == 0) | (F.col("hi") % block == block - 1)
    across = Window.partitionBy("owner").orderBy("lo")
    new = F.coalesce((F.col("lo") > F.lag("hi").over(across) + 1).cast("int"), F.lit(1))
    edges = ranges.filter(edge).withColumn("_n", new).withColumn("_g", F.sum("_n").over(across))
    edges = edges.groupBy("owner", "_g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return ranges.filter(~edge).select("owner", "lo", "hi").unionByName(edges.select("owner", "lo", "hi"))


def expand(ranges: DataFrame) -> DataFrame:
    return ranges.select("owner", F.explode(F.sequence("lo", "hi")).alias("idx"))


def floor(indexes: DataFrame, bound: Column | int) -> DataFrame:
    return indexes.filter(F.col("idx") >= bound)


def limit(indexes: DataFrame, bound: Column | int) -> DataFrame:
    """Indexes up to ``bound``, inclusive (ranges.limit is exclusive)."""
    return indexes.filter(F.col("idx") <= bound)


def overlay(added: DataFrame, to: DataFrame) -> DataFrame:
    """``to`` cut off below the first of ``added``, then ``added``: no plain union."""
    first = added.groupBy("owner").agg(F.min("idx").alias("_first"))
    kept = to.join(first, "owner", "left").filter(F.col("_first").isNull() | (F.col("idx") < F.col("_first")))
    return kept.select("owner", "idx").unionByName(added.select("owner", "idx"))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("owner", "idx"), ["owner", "idx"], "left_anti")


def bounds(indexes: DataFrame) -> DataFrame:
    return indexes.groupBy("owner").agg(F.min("idx").alias("first"), F.max("idx").alias("last"))


def length(ranges: DataFrame) -> DataFrame:
    return ranges.groupBy("owner").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("n"))


def _by_bucket(ranges: DataFrame, width: int) -> DataFrame:
    """A range once per bucket of ``width`` that it touches."""
    return ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))


def locate(indexes: DataFrame, ranges: DataFrame, keep: list[str], width: int = 1024, how: str = "inner") -> DataFrame:
    """Interval lookup as an equi-join: indexes with columns ``keep`` of the range that holds
    them. A range join as such would compare all with all."""
    r = _by_bucket(ranges, width).select(F.col("owner").alias("_o"), "_b", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), *keep)
    i = indexes.withColumn("_ib", F.floor(F.col("idx") / width))
    on = (F.col("owner") == F.col("_o")) & (F.col("_ib") == F.col("_b")) & F.col("idx").between(F.col("_lo"), F.col("_hi"))
    return i.join(r, on, how).drop("_ib", "_o", "_b", "_lo", "_hi")


def contains(indexes: DataFrame, ranges: DataFrame, width: int = 1024) -> DataFrame:
    """The indexes that lie in a range."""
    return locate(indexes, ranges, [], width, "left_semi")


def clip(ranges: DataFrame, lo: Column | int, hi: Column | int) -> DataFrame:
    lo, hi = (x if isinstance(x, Column) else F.lit(x) for x in (lo, hi))
    cut = ranges.withColumns({"lo": F.greatest("lo", lo), "hi": F.least("hi", hi)})
    return cut.filter("lo <= hi")


def overlapping(ranges: DataFrame, others: DataFrame, width: int = 1024) -> DataFrame:
    """Ranges that overlap any of ``others``: an existence test, not a join of pairs."""
    a = _by_bucket(ranges.withColumns({"_l": F.col("lo"), "_h": F.col("hi")}), width)
    b = _by_bucket(others.select("owner", "lo", "hi"), width).select(
        F.col("owner").alias("_o"), F.col("_b").alias("_ob"), F.col("lo").alias("_ol"), F.col("hi").alias("_oh")
    )
    on = (F.col("owner") == F.col("_o")) & (F.col("_b") == F.col("_ob")) & (F.col("lo") <= F.col("_oh")) & (F.col("hi") >= F.col("_ol"))
    return a.join(b, on, "left_semi").drop("_b", "_l", "_h").distinct()


def remove_prefix(prefix: DataFrame, indexes: DataFrame) -> DataFrame:
    """``owner, idx, not_prefix``: what is left, and whether some index that is left lies
    below the end of the prefix (then it was no prefix)."""
    end = prefix.groupBy("owner").agg(F.max("idx").alias("_end"))
    left = subtract(indexes, prefix).join(end, "owner", "left")
    low = left.groupBy("owner").agg(F.coalesce(F.min("idx") < F.max("_end"), F.lit(False)).alias("not_prefix"))
    return left.drop("_end").join(low, "owner")


def chunk(indexes: DataFrame, size: int) -> DataFrame:
    """``owner, chunk, n, first, last`` of each run of ``size`` indexes, in ascending order."""
    nth = scan.running_sum(indexes.withColumn("_one", F.lit(1)), "_one", "_n", ["owner"], "idx")
    numbered = nth.withColumn("chunk", F.floor((F.col("_n") - 1) / size))
    return numbered.groupBy("owner", "chunk").agg(
        F.count("*").alias("n"), F.min("idx").alias("first"), F.max("idx").alias("last")
    )


def fold(indexes: DataFrame, zero: Column, merge) -> DataFrame:
    """Ascending fold of each owner's indexes."""
    every = F.array_sort(F.collect_list("idx"))
    return indexes.groupBy("owner").agg(F.aggregate(every, zero, merge).alias("value"))
