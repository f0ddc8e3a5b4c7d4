"""A join inside buckets, on matrices instead of pairs.

Rows are stored in buckets and probe buckets; one that does both in a bucket is a single
row there. Every bucket becomes tiles of at most ``tile`` stored rows by ``probes``
probing rows; stored rows are repeated for each probe slice and probing rows for each
stored tile, so a bucket of any size is spread over many tasks and each task holds one
tile.
Per tile only two things leave the worker: what each probing row has matched
(a weight) and a spanning forest of the matches; pairs are never emitted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import partitions

TILE, PROBES = 4096, 65536
HOT_ROWS = 100_000
SCHEMA = "id long, links long, root long"


def forest(q_ids: np.ndarray, h_ids: np.ndarray, qi: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id of each match component, for every id that has a match with another."""
    other = q_ids[qi] != h_ids[hi]
    ids, at = np.unique(np.concatenate([q_ids[qi[other]], h_ids[hi[other]]]), return_inverse=True)
    if not len(ids):
        return ids, ids
    a, b = np.split(at, 2)
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return ids, ids[label]
        label = new


def _numpy(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _tiles(batches: Iterator[pa.RecordBatch], match: Callable, link: Callable | None) -> Iterator[pa.RecordBatch]:
    key, ids, weights, held, both = None, [], [], [], False
    block = None
    none_matched = pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, names=["id", "links", "root"])

    def stored() -> tuple:
        return np.concatenate(ids), np.concatenate(weights), b"".join(held)

    def joined(q_ids: np.ndarray, q: bytes, h_ids: np.ndarray, h_w: np.ndarray, h: bytes) -> pa.RecordBatch:
        qi, hj = match(q, h)
        if not len(qi):
            return none_matched
        links = np.bincount(qi, weights=h_w[hj], minlength=len(q_ids)).astype(np.int64)
        some = np.flatnonzero(links)
        nodes, roots = link(q_ids, h_ids, qi, hj, q, h) if link else forest(q_ids, h_ids, qi, hj)
        none = pa.nulls(len(nodes), pa.int64()), pa.nulls(len(some), pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([q_ids[some], nodes])),
                pa.concat_arrays([pa.array(links[some]), none[0]]),
                pa.concat_arrays([none[1], pa.array(roots)]),
            ],
            names=["id", "links", "root"],
        )

    def within() -> pa.RecordBatch:
        h_ids, h_w, h = stored()
        return joined(h_ids, h, h_ids, h_w, h)

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([_numpy(batch, n).astype(np.int64) for n in ("bucket", "t", "s", "role")], 1)
        b_ids, b_w = _numpy(batch, "id"), _numpy(batch, "w")
        payload = batch.column(batch.schema.get_field_index("payload")).to_pylist()
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts, cuts[1:]):
            if (now := tuple(keys[lo, :3])) != key:
                if both:
                    yield within()
                key, ids, weights, held, both, block = now, [], [], [], False, None
            if keys[lo, 3] != 1:
                ids.append(b_ids[lo:hi])
                weights.append(b_w[lo:hi])
                held += payload[lo:hi]
                both = keys[lo, 3] == 2
                continue
            if not held:
                continue
            if block is None:
                block = stored()
            yield joined(b_ids[lo:hi], b"".join(payload[lo:hi]), *block)
    if both:
        yield within()


def _gathered(batches: Iterator[pa.RecordBatch], at_once: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in fewer batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if len(held) == at_once or batch.num_rows > at_once:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def bucket_join(rows: DataFrame, counts: DataFrame, match: Callable, tile: int = TILE, probes: int = PROBES, link: Callable | None = None) -> DataFrame:
    """``id, links, root``: what probing rows matched (``links``, a sum of stored
    weights, ``root`` null) and forest edges ``id - root`` (``links`` null).

    ``rows``: ``bucket long, role int (0 stored, 1 probing, 2 both), id long, w long,
    payload binary``. ``counts``: ``bucket, stored, probing`` of the same rows.
    ``match(probing bytes, stored bytes)`` gives index arrays of the matches. ``link(probing
    ids, stored ids, indexes of matches, probing bytes, stored bytes)`` may give other edges
    than those of the forest, a bounded number per row.
    """
    hot = counts.filter((F.col("stored") > tile) | (F.col("probing") > probes)).select(
        "bucket",
        F.ceil(F.col("stored") / tile).cast("int").alias("nt"),
        F.ceil(F.col("probing") / probes).cast("int").alias("ns"),
    )
    if hot.limit(HOT_ROWS + 1).count() <= HOT_ROWS:  # else Spark joins them as it sees fit
        hot = F.broadcast(hot)
    own, all_of = F.pmod(F.xxhash64("id"), F.col("n")).cast("int"), F.expr("explode(sequence(0, other - 1))")
    split = F.when((F.col("role") == 2) & F.col("nt").isNotNull(), F.array(F.lit(0), F.lit(1))).otherwise(F.array("role"))
    rows = rows.join(hot, "bucket", "left").select("bucket", F.explode(split).alias("role"), "id", "w", "payload", "nt", "ns")
    at = rows.withColumns(
        {
            "n": F.coalesce(F.when(F.col("role") == 0, F.col("nt")).otherwise(F.col("ns")), F.lit(1)),
            "other": F.coalesce(F.when(F.col("role") == 0, F.col("ns")).otherwise(F.col("nt")), F.lit(1)),
        }
    )
    at = at.select("bucket", "role", "id", "w", "payload", own.alias("own"), all_of.alias("each"))
    side = F.col("role") == 0
    at = at.select(
        "bucket",
        F.when(side, F.col("own")).otherwise(F.col("each")).alias("t"),
        F.when(side, F.col("each")).otherwise(F.col("own")).alias("s"),
        "role",
        "id",
        "w",
        "payload",
    )
    placed = at.repartition(partitions(rows.sparkSession), "bucket", "t", "s").sortWithinPartitions("bucket", "t", "s", "role")
    return placed.mapInArrow(lambda it: _gathered(_tiles(it, match, link)), SCHEMA)
