"""Queries that read the whole log whatever its size."""

import shutil
from functools import reduce

import pytest
from pyspark.sql import functions as F

from tideline.functions import scalars
from tideline.operators import logops
from tideline.plans import registry


@pytest.fixture(scope="module")
def long_log(spark, tmp_path_factory):
    """The events of the smallest tables ten times over, under ids that go on."""
    sf = tmp_path_factory.mktemp("long")
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    n = e.count()
    e = e.crossJoin(spark.range(10).withColumnRenamed("id", "_k")).withColumn("event_id", F.col("event_id") + n * F.col("_k")).drop("_k")
    e.write.parquet(f"{sf}/events.parquet")
    yield str(sf), 10 * n
    shutil.rmtree(sf)


def test_fold(spark, long_log):
    sf, n = long_log
    rows = spark.read.parquet(f"{sf}/events.parquet").orderBy("event_id").collect()
    assert len(rows) == n
    want = reduce(lambda a, r: (a * 31 + r.user_id) % 1000003, rows, 1)
    assert [r.value for r in registry.QUERIES["log_fold_range"](spark, sf).collect()] == [want]


@pytest.mark.parametrize("block", [1, 3, 100])
def test_fold_blocks(spark, block):
    df = spark.createDataFrame([("a", i, i % 5) for i in range(1, 20)] + [("b", 7, 2)], "uid string, idx long, v long").repartition(3)
    got = logops.fold_blocks(df, F.col("v").cast("string"), F.lit(""), F.concat, F.lit(">"), F.concat, block=block)
    assert {r.uid: r.value for r in got.collect()} == {"a": ">" + "".join(str(i % 5) for i in range(1, 20)), "b": ">2"}


def test_bounds_follow_the_log(spark, long_log):
    sf, n = long_log
    rows = lambda name: registry.QUERIES[name](spark, sf)
    top = lambda name, col: rows(name).agg(F.max(col)).first()[0]
    assert rows("log_truncate_suffix").count() == n * 9 // 10
    assert rows("log_fold_until_hole").count() == n * 9 // 10 - 1
    assert rows("log_multi_get").count() == n // 20
    assert rows("log_prefix_match").count() == n and rows("log_prefix_match").filter("drop").count() == n * 9 // 10
    assert n // 2 < top("seq_floor_limit", "idx") <= n * 19 // 20 and n // 2 < top("seq_in_range", "hi") <= n * 19 // 20
    assert top("cluster_scan", "idx") > n // 2
    assert rows("workload_mix").agg(F.sum("n")).first()[0] == n


def test_detect_sort_judges_whole_lists(spark, tmp_path):
    lists = {4: [1.0, 2.0, 3.0, 4.0, 0.5], 8: [5.0, 4.0, 3.0, 2.0, 1.0], 5: [1.0, 2.0, 2.0, 3.0], 6: [7.0], 7: [3.0, 3.0, 3.0], 9: [2.0, 1.0, 1.0, 0.0]}
    events = [(key, v) for i in range(5) for key, values in lists.items() for v in values[i : i + 1]]
    rows = [(i, key, v) for i, (key, v) in enumerate(events)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, value double")
    df.withColumns({"ts": F.lit("2024-01-01").cast("timestamp_ntz"), "event_type": F.lit("view"), "props": F.lit("{}")}).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.key: r.sorted for r in registry.QUERIES["detect_sort"](spark, str(tmp_path)).collect()}
    assert got == {4: "unsorted", 8: "descending", 5: "ascending", 6: "undefined", 7: "undefined", 9: "descending"}
    empty = spark.range(1).select(scalars.detect_sort(F.array().cast("array<double>")).alias("s"))
    assert empty.first().s == "undefined"
