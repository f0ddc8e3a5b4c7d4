"""Inclusive index ranges as nullable structs ``lo, hi``; null is the empty range."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def new(lo: Column, hi: Column) -> Column:
    return F.when(lo <= hi, F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi")))


def combine(added: Column, r: Column) -> Column:
    """Tail overwrite: the wider start, ending where ``added`` ends."""
    return F.when(r.isNull(), added).when(added.isNull(), r).otherwise(
        F.struct(F.least(added["lo"], r["lo"]).alias("lo"), added["hi"].alias("hi"))
    )


def add(added: Column, r: Column) -> Column:
    """Union if the ranges overlap or touch, else ``added`` replaces ``r``."""
    touch = (r["lo"] <= added["hi"] + 1) & (added["lo"] <= r["hi"] + 1)
    union = F.struct(F.least(added["lo"], r["lo"]).alias("lo"), F.greatest(added["hi"], r["hi"]).alias("hi"))
    return F.when(added.isNull(), r).when(r.isNull() | ~touch, added).otherwise(union)


def contains(idx: Column, r: Column) -> Column:
    return F.coalesce(idx.between(r["lo"], r["hi"]), F.lit(False))


def extend(idx: Column, r: Column) -> Column:
    """Grow by exactly the next index; any other index is an error."""
    grown = F.struct(r["lo"].alias("lo"), idx.cast("long").alias("hi"))
    return F.when(r.isNull(), new(idx, idx)).when(idx == r["hi"] + 1, grown).otherwise(F.raise_error(F.lit("not the next index")))


def limit(ceiling: Column, r: Column) -> Column:
    """Indexes below ``ceiling`` (exclusive)."""
    return new(r["lo"], F.least(r["hi"], ceiling - 1))


def truncate(upto: Column, r: Column) -> Column:
    """Indexes above ``upto``."""
    return new(F.greatest(r["lo"], upto + 1), r["hi"])


def size(r: Column) -> Column:
    return F.coalesce(r["hi"] - r["lo"] + 1, F.lit(0).cast("long"))


def overlap(a: Column, b: Column) -> Column:
    both = a.isNotNull() & b.isNotNull()
    return F.when(both, new(F.greatest(a["lo"], b["lo"]), F.least(a["hi"], b["hi"])))


def subtract(sub: Column, r: Column) -> Column:
    """Up to two ranges of ``r`` outside ``sub``, as an array."""
    below = new(r["lo"], F.least(r["hi"], sub["lo"] - 1))
    above = new(F.greatest(r["lo"], sub["hi"] + 1), r["hi"])
    parts = F.when(sub.isNull(), F.array(r)).otherwise(F.array(below, above))
    return F.filter(parts, lambda x: x.isNotNull())


def fold(r: Column, zero: Column, merge) -> Column:
    """Ascending fold over the indexes of a range."""
    every = F.when(r.isNotNull(), F.sequence(r["lo"], r["hi"])).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(every, zero, merge)
