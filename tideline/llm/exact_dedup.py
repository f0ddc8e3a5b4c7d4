"""Exact deduplication by progressive refinement.

Documents are grouped by length, then by a hash of length and first characters, then
by a hash of the whole text. Each level only looks at what the level before left in
company. What a level passes on is the keys that several rows share: lengths, of which
there are no more than the longest text has bytes, and prefix hashes, of which there
are no more than groups of texts that begin alike. Keys are broadcast if they are few;
if not, every text is hashed in place and only its hash moves, so no text is shuffled at
any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import discard, drop_rows, few, id_and_text, materialize

PREFIX_CHARS = 128
_LENGTH, _START = "__length", "__start"  # columns added to a caller's table


def _keyed(rows: DataFrame, text_col: str) -> DataFrame:
    """Adds the keys of the first two levels."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.octet_length(text)
    return rows.withColumns({_LENGTH: size, _START: F.xxhash64(size, F.substring(text, 1, PREFIX_CHARS))})


def _crowded(keyed: DataFrame) -> DataFrame:
    """Prefix hashes that several rows have, among rows whose length several have."""

    def shared(rows: DataFrame, key: str) -> DataFrame:
        return materialize(rows.groupBy(key).count().filter("count > 1").select(key))

    lengths = shared(keyed, _LENGTH)
    crowded = shared(keyed.join(F.broadcast(lengths) if few(lengths) else lengths, _LENGTH, "left_semi"), _START)
    discard(lengths)
    return crowded


def _marked(keyed: DataFrame, crowded: DataFrame) -> DataFrame:
    """Adds ``__hit``: whether the whole text has to be hashed."""
    if not few(crowded):
        return keyed.withColumn("__hit", F.lit(True))
    hits = F.broadcast(crowded.withColumn("__hit", F.lit(True)))
    return keyed.join(hits, _START, "left").withColumn("__hit", F.coalesce("__hit", F.lit(False)))


def text_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_all: bool = True) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical; the largest ``doc_id`` of a group stays.
    Null and empty texts are the same text. A row with a null id counts in its
    group and is kept only if no row of the group has an id; rows repeated under
    the largest id are one document and are all marked kept. An empty table gives
    no rows. ``hash_all=False`` leaves ``text_sha256`` null for documents that an
    earlier level has already shown to be unique.
    """
    t = _keyed(id_and_text(docs, id_col, text_col), "text")
    return _groups(_marked(t, _crowded(t)), hash_all)


def _groups(marked: DataFrame, hash_all: bool) -> DataFrame:
    whole = F.sha2(F.col("text"), 256)
    rows = materialize(
        marked.select(
            "doc_id", _LENGTH, "__hit", (whole if hash_all else F.when(F.col("__hit"), whole)).alias("text_sha256")
        )
    )
    alone = rows.filter("not __hit").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    left = rows.filter("__hit")
    # Written first, so that Spark can split a hot group's rows in the join below.
    groups = materialize(
        left.groupBy("text_sha256", _LENGTH).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    )
    shared = left.join(groups, ["text_sha256", _LENGTH]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
    return alone.unionByName(shared)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`text_groups` does not keep and that have an id:
    of equal texts the one with the largest id stays.

    Rows without an id are exempt: all of them stay, copies among them included, as does
    each row repeated under a kept id. Only texts whose length and beginning occur again
    are hashed whole.
    """
    t = _keyed(id_and_text(docs, id_col, text_col), "text")
    crowded = _crowded(t)
    copies = _groups(_marked(t, crowded), False).filter("not kept and doc_id is not null")
    copies = materialize(copies.select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha")))
    keyed = _marked(_keyed(docs, text_col).withColumn("__id", F.col(id_col).cast("long")), crowded)
    keyed = keyed.withColumn("__sha", F.when(F.col("__hit"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)))
    return drop_rows(keyed, copies, ["__id", "__sha"]).select(*docs.columns)
