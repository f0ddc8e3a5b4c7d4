"""Parquet log tables: append, idempotent streaming commit, compacted silver layout."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from tideline.operators import indexset

LOG_SCHEMA = StructType(
    [
        StructField("uid", StringType(), False),
        StructField("write_seq", LongType(), False),
        StructField("idx", LongType(), False),
        StructField("term", LongType(), False),
        StructField("type", StringType()),
        StructField("payload", BinaryType()),
    ]
)


def with_checksum(entries: DataFrame) -> DataFrame:
    return entries.withColumn("crc", F.crc32(F.coalesce("payload", F.lit(b""))))


def append(entries: DataFrame, path: str, max_records: int = 1_000_000) -> None:
    """One atomic append; files roll at ``max_records``."""
    with_checksum(entries).write.mode("append").option("maxRecordsPerFile", max_records).parquet(path)


def read_log(spark: SparkSession, path: str, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """The table, with an index range pushed down to file and row-group statistics."""
    df = spark.read.parquet(path)
    if lo is not None:
        df = df.filter(F.col("idx") >= lo)
    return df if hi is None else df.filter(F.col("idx") <= hi)


def write_segments(entries: DataFrame, path: str, width: int, partitions: int | None = None) -> None:
    """Silver layout: clustered by writer and sorted by index inside a segment partition, so
    that Parquet statistics prune index ranges."""
    rows = with_checksum(entries).withColumn("segment", F.floor((F.col("idx") - 1) / width))
    dealt = rows.repartition(partitions, "segment") if partitions else rows.repartition("segment")
    dealt.sortWithinPartitions("segment", "uid", "idx").write.mode("overwrite").partitionBy("segment").parquet(path)


def truncate_segments(spark: SparkSession, path: str, below: int) -> None:
    """Delete whole segments below a pivot."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("segment=") and int(name.split("=")[1]) < below:
            fs.delete(status.getPath(), True)


def commit_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A micro-batch is the commit unit. It lands in a folder of its own number, overwritten
    on replay, so a batch that is retried is still there once."""

    def commit(batch: DataFrame, number: int) -> None:
        with_checksum(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def written_ranges(log: DataFrame) -> DataFrame:
    """What a commit acknowledges: per batch, writer and term the range and count written."""
    return log.groupBy("batch", "uid", "term").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.count("*").alias("n"))


def _digest(df: DataFrame) -> tuple[int, int]:
    """Number of rows and sum of their hashes, whatever their order."""
    hashed = F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)") % 1_000_000_007)
    n, total = df.agg(F.count("*"), F.coalesce(hashed, F.lit(0))).first()
    return n, int(total)


def write_checked(df: DataFrame, meta: dict, path: str) -> None:
    """Rows, and after them one row of ``meta`` with their number and checksum: a write that
    was cut short has no meta, and one that was damaged does not agree with it."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}/state")
    n, total = _digest(spark.read.parquet(f"{path}/state"))
    spark.createDataFrame([meta | {"rows": n, "checksum": total}]).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def read_checked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Meta and rows; fails where the rows do not agree with the checksum."""
    meta, rows = spark.read.parquet(f"{path}/meta"), spark.read.parquet(f"{path}/state")
    want = meta.first()
    if (want["rows"], want["checksum"]) != _digest(rows):
        raise ValueError(f"bad checksum: {path}")
    return meta, rows


def is_valid(spark: SparkSession, path: str) -> bool:
    try:
        read_checked(spark, path)
    except (AnalysisException, ValueError):
        return False
    return True


def recover_snapshot(spark: SparkSession, paths: list[str]) -> str | None:
    """The first of ``paths`` (newest first) that is whole; damaged ones are passed over."""
    return next((p for p in paths if is_valid(spark, p)), None)


def write_snapshot(state: DataFrame, meta: dict, path: str) -> None:
    """State and a one-row meta table with its checksum; the meta can be read without the state."""
    write_checked(state, meta, path)


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return read_checked(spark, path)


def write_indexes(indexes: DataFrame, path: str) -> None:
    """Live indexes (``owner, idx``) as ranges, with a checksum."""
    write_checked(indexset.compress(indexes), {"kind": "indexes"}, path)


def read_indexes(spark: SparkSession, path: str) -> DataFrame:
    return indexset.expand(read_checked(spark, path)[1])
