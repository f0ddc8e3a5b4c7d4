"""Names of the counters that logs and servers keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Field names in their natural order, per group.
LOG = (
    "write_ops write_resends read_ops read_cache read_mem_table read_closed_mem_tbl read_segment fetch_term snapshots_written "
    "snapshot_installed snapshot_bytes_written open_segments checkpoints_written checkpoint_bytes_written checkpoints_promoted "
    "minor_compactions major_compactions compaction_segments_written compaction_segments_compacted reserved_1"
).split()
SERVER = (
    "aer_received_follower aer_replies_success aer_replies_fail commands command_flushes aux_commands consistent_queries rpcs_sent "
    "msgs_sent dropped_sends send_msg_effects_sent pre_vote_elections elections forced_gcs snapshots_sent release_cursors "
    "aer_received_follower_empty term_and_voted_for_updates local_queries invalid_reply_mode_commands checkpoints reserved_2"
).split()
METRICS = (
    "last_applied commit_index snapshot_index last_index last_written_index commit_latency term checkpoint_index "
    "effective_machine_version num_segments"
).split()
GAUGES = frozenset(["open_segments", *METRICS])


def catalogue(spark: SparkSession) -> DataFrame:
    """``grp, place, field, kind``: every field with its place in its group."""
    rows = [(g, n, f, "gauge" if f in GAUGES else "counter") for g, fields in (("log", LOG), ("server", SERVER), ("metrics", METRICS)) for n, f in enumerate(fields, 1)]
    return spark.createDataFrame(rows, "grp string, place int, field string, kind string")


def with_defaults(samples: DataFrame, fields: DataFrame) -> DataFrame:
    """``name, field, value`` for every name and catalogue field: the sample, or zero. Samples of
    fields that the catalogue lacks are left out."""
    names = samples.select("name").distinct()
    every = names.crossJoin(F.broadcast(fields.select("field")))  # the catalogue has some fifty rows
    return every.join(samples.select("name", "field", "value"), ["name", "field"], "left").select("name", "field", F.coalesce("value", F.lit(0.0)).alias("value"))
