"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    It is the one named by ``spark.checkpoint.dir``. Where that is unset a temporary folder
    takes its place, but only if one machine runs everything (``local`` masters, as in
    tests): executors elsewhere would not see it.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="tideline-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage and computes an expensive frame once; unlike a cached frame
    the files survive the loss of executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tideline/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a frame returned by :func:`materialize`."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if "/tideline/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator needs, null texts as empty ones.

    Selecting first keeps extra columns of the input, whatever their names,
    away from the operator's own.
    """
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )


# Batches of long texts: bytes that go to a Python worker at once, and rows that the reader holds.
SMALL = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.parquet.columnarReaderBatchSize": "512"}


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside moves texts in batches of a few megabytes; afterwards the session's settings
    are as before."""
    before = {k: spark.conf.get(k, None) for k in SMALL}
    try:
        for k, v in SMALL.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def lean(fn: Callable) -> Callable:
    """``fn`` of batches for a worker that returns free memory to the system after it, as idle
    workers count towards their executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # glibc only
            ctypes.CDLL(None).malloc_trim(0)

    return run


BROADCAST_ROWS = 500_000  # rows of a few numbers each, some tens of megabytes


def few(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` (narrow rows, read from a written table) is small enough to broadcast."""
    return df.limit(rows + 1).count() <= rows


def drop_rows(docs: DataFrame, dropped: DataFrame, on: list[str], broadcast_rows: int = 50_000) -> DataFrame:
    """``docs`` without the rows named in ``dropped``. The names are broadcast only where
    there are few of them; beyond that both sides are shuffled."""
    return docs.join(F.broadcast(dropped) if few(dropped, broadcast_rows) else dropped, on, "left_anti")
