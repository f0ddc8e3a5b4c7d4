"""Quorum order statistics and membership decisions over peer tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_BATCH, MAX_PIPELINE = 128, 4096  # entries per request, and in flight per peer


def agreed(values: Column) -> Column:
    """The value that a majority has reached: place floor(n/2)+1 in descending order, so
    the smaller middle one for an even number."""
    return F.element_at(F.sort_array(values, asc=False), (F.floor(F.size(values) / 2) + 1).cast("int"))


def commit_candidates(peers: DataFrame, value: str = "match_index") -> DataFrame:
    """``cluster, candidate`` over the voters of each cluster (clusters are small)."""
    return peers.filter("voter").groupBy("cluster").agg(agreed(F.collect_list(value)).alias("candidate"))


def commit(peers: DataFrame, clusters: DataFrame, log: DataFrame) -> DataFrame:
    """``cluster, commit_index``: the candidate if its entry is of the current term, else
    the old commit. ``clusters``: ``cluster, current_term, commit_index``; ``log``: ``idx, term``."""
    c = commit_candidates(peers).join(clusters, "cluster").join(log.select(F.col("idx").alias("candidate"), "term"), "candidate", "left")
    moves = (F.col("term") == F.col("current_term")) & (F.col("candidate") > F.col("commit_index"))
    return c.select("cluster", F.when(moves, F.col("candidate")).otherwise(F.col("commit_index")).alias("commit_index"))


def required(peers: DataFrame) -> DataFrame:
    return peers.groupBy("cluster").agg(
        F.count_if("voter").alias("voters"), (F.floor(F.count_if("voter") / 2) + 1).alias("quorum")
    )


def elections(votes: DataFrame, quorums: DataFrame) -> DataFrame:
    """``cluster, term, candidate, granted, elected_at``: candidates whose granted votes reach
    the quorum, with the sequence number of the vote that did it."""
    order = Window.partitionBy("cluster", "term", "candidate").orderBy("seq")
    granted = votes.filter("granted").withColumn("_n", F.row_number().over(order)).join(quorums, "cluster")
    return granted.groupBy("cluster", "term", "candidate").agg(
        F.count("*").alias("granted"), F.min(F.when(F.col("_n") == F.col("quorum"), F.col("seq"))).alias("elected_at")
    ).filter("elected_at is not null")


def up_to_date(term: Column, idx: Column, than_term: Column, than_idx: Column) -> Column:
    """Whether a log that ends at (term, idx) may lead one that ends at the other."""
    return F.struct(term, idx) >= F.struct(than_term, than_idx)


def pre_vote(term: Column, own_term: Column, fresh: Column, version: Column, own_version: Column) -> Column:
    """Decision on a pre-vote: granted, denied, or ignored for a stale term."""
    return (
        F.when(term < own_term, "stale_term")
        .when(version < own_version, "denied")
        .otherwise(F.when(fresh, "granted").otherwise("denied"))
    )


def stale(peers: DataFrame, commit_index: Column) -> DataFrame:
    """Normal peers that lack entries or the latest commit index."""
    behind = (F.col("match_index") < F.col("next_index") - 1) | (F.col("commit_sent") < commit_index)
    return peers.filter((F.col("status") == "normal") & behind)


def pipeline(peers: DataFrame, next_log: Column, commit_index: Column, max_batch: int = MAX_BATCH, max_pipeline: int = MAX_PIPELINE, force: bool = False) -> DataFrame:
    """``cluster, member, in_flight, batch``: how many entries go to each peer that is sent to.

    Only normal peers that lack entries (below ``next_log``, the log's next index) or the
    commit index are sent to, and none with ``max_pipeline`` entries in flight unless
    ``force``, which then sends one."""
    flight = F.col("next_index") - F.col("match_index") - 1
    lacks = (F.col("next_index") < next_log) | (F.col("commit_sent") < commit_index)
    due = peers.filter((F.col("status") == "normal") & lacks)
    due = due if force else due.filter(flight < max_pipeline)
    batch = F.greatest(F.lit(1), F.least(F.lit(max_batch), max_pipeline - flight))
    return due.select("cluster", "member", flight.alias("in_flight"), batch.alias("batch"))


def progress(replies: DataFrame) -> DataFrame:
    """Match and next index of each peer after successful replies: running maxima."""
    w = Window.partitionBy("cluster", "member").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return replies.withColumns({"match_index": F.max("last_index").over(w), "next_index": F.max("next").over(w)})


def promoted(peers: DataFrame, target: Column) -> DataFrame:
    """Membership after promotion: non-voters that have reached their target vote."""
    kind = F.when(F.col("voter") | (F.col("match_index") >= target), "voter").otherwise("promotable")
    return peers.select("cluster", "member", kind.alias("membership"))


def machine_version(peers: DataFrame, effective: int) -> DataFrame:
    """Highest version that every member supports; an unknown one pins it to the effective."""
    low = F.min("machine_version")
    return peers.groupBy("cluster").agg(
        F.when(F.count_if(F.col("machine_version").isNull()) > 0, F.lit(effective)).otherwise(F.greatest(low, F.lit(effective))).cast("int").alias("version")
    )


def membership_history(changes: DataFrame) -> DataFrame:
    """Cluster configurations as validity intervals ``from_idx, to_idx`` over the log."""
    after = F.lead("idx").over(Window.partitionBy("uid").orderBy("idx"))
    return changes.withColumn("to_idx", after - 1).withColumnRenamed("idx", "from_idx")


def current_membership(changes: DataFrame, commit_index: int | Column) -> DataFrame:
    return changes.filter(F.col("idx") <= commit_index).groupBy("uid").agg(F.max_by("members", "idx").alias("members"), F.max("idx").alias("idx"))


def released(waiting: DataFrame, consensus: DataFrame) -> DataFrame:
    """Consistent queries that the agreed query index lets go."""
    return waiting.join(consensus, "cluster").filter(F.col("query_index") <= F.col("candidate"))


def fully_replicated(peers: DataFrame, commits: DataFrame) -> DataFrame:
    low = peers.groupBy("cluster").agg(F.min(F.least("match_index", "commit_sent")).alias("_low"))
    return commits.join(low, "cluster", "left").select("cluster", F.coalesce(F.col("_low") >= F.col("commit_index"), F.lit(True)).alias("replicated"))
