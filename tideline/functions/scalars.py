"""Scalar and list utilities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def zpad_hex(n: Column) -> Column:
    return F.lpad(F.hex(n), 16, "0")


def zpad_filename(n: Column, extension: str) -> Column:
    return F.concat(F.lpad(n.cast("string"), 16, "0"), F.lit(f".{extension}"))


def zpad_num(name: Column) -> Column:
    return F.regexp_extract(name, "([0-9]{16})", 1).cast("long")


def zpad_incr(name: Column) -> Column:
    """The name with its number one higher."""
    part = lambda k: F.regexp_extract(name, "^(.*?)([0-9]{16})(.*)$", k)
    return F.concat(part(1), F.lpad((part(2).cast("long") + 1).cast("string"), 16, "0"), part(3))


def zpad_upgrade(name: Column) -> Column:
    """Eight-digit names widened to sixteen digits."""
    part = lambda k: F.regexp_extract(name, "^(.*?)([0-9]{8})(\\D.*)$", k)
    old = name.rlike("^\\D*[0-9]{8}\\D")
    return F.when(old, F.concat(part(1), F.lpad(part(2), 16, "0"), part(3))).otherwise(name)


def detect_sort(values: Column) -> Column:
    """undefined (under two values, or all equal), ascending, descending or unsorted."""
    up, down = values == F.array_sort(values), values == F.sort_array(values, asc=False)
    return F.when((F.size(values) < 2) | (up & down), "undefined").when(up, "ascending").when(down, "descending").otherwise("unsorted")


def safe_string(s: Column, n: int) -> Column:
    return F.substring(F.regexp_replace(s, "[^A-Za-z0-9_=-]", ""), 1, n)


def is_safe(s: Column) -> Column:
    return s.rlike("^[A-Za-z0-9_=-]*$")


def local_first(items: DataFrame, is_local: Column, order: str) -> DataFrame:
    """Rows with the local ones at the head."""
    return items.orderBy((~is_local).cast("int"), order)


def chunks(df: DataFrame, column: str, size: int) -> DataFrame:
    """``chunk, data`` pieces of ``size`` characters; an empty text is one empty piece."""
    last = F.greatest(F.ceil(F.length(column) / size) - 1, F.lit(0)).cast("int")
    keep = [c for c in df.columns if c != column]
    cut = df.withColumn("chunk", F.explode(F.sequence(F.lit(0), last)))
    return cut.select(*keep, "chunk", F.substring(column, F.col("chunk") * size + 1, F.lit(size)).alias("data"))


def reassembled(parts: DataFrame, key: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("chunk", "data")))
    return parts.groupBy(key).agg(F.array_join(F.transform(rows, lambda x: x["data"]), "").alias("data"))
