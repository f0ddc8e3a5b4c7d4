"""Which hashes several rows have, as a bitmap.

Hashes have 40 bits here, 12 of a bucket and 28 in it. Every task sends its rows' hashes sorted,
as packed differences; a bucket's repeated ones set the bits of their places. The bitmap may
name hashes that only one row has, and never lacks one that two have.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tideline.llm.common import discard, materialize, partitions

HELD = 1 << 20  # hashes a task sorts at once
BITS, _BUCKET = 40, 28


def sketches(rows: Iterable[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """``bucket, hashes`` from the distinct hashes of each row, of ``BITS`` bits."""
    held, n = [], 0

    def packed() -> pa.RecordBatch:
        every = np.sort(np.concatenate(held))
        buckets, at = np.unique(every >> np.uint64(_BUCKET), return_index=True)
        low = (every & np.uint64((1 << _BUCKET) - 1)).astype("<u4")
        blobs = [zlib.compress(np.diff(x, prepend=np.uint32(0)).tobytes(), 1) for x in np.split(low, at[1:])]
        return pa.RecordBatch.from_arrays([pa.array(buckets.astype(np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "hashes"])

    for row in rows:
        held.append(row)
        n += len(row)
        if n >= HELD:
            yield packed()
            held, n = [], 0
    if n:
        yield packed()


def _several(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[pa.RecordBatch]:
    """``bucket, bits``: the places of the hashes that several rows have."""

    def bits(bucket: int, held: list[bytes]) -> pa.RecordBatch:
        every = np.sort(np.concatenate([np.cumsum(np.frombuffer(zlib.decompress(x), dtype="<u4"), dtype=np.uint32) for x in held]))
        some = np.zeros(1 << _BUCKET - place, dtype=bool)
        some[every[1:][every[1:] == every[:-1]] >> np.uint32(place)] = True
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([np.packbits(some).tobytes()], pa.binary())], names=["bucket", "bits"])

    now, held = None, []
    for batch in batches:
        for bucket, hashes in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != now and held:
                yield bits(now, held)
                held = []
            now = bucket
            held.append(hashes)
    if held:
        yield bits(now, held)


def bitmap(sketched: DataFrame, width: int = 27) -> np.ndarray:
    """``2**width`` bits, 15 to 40, from rows of :func:`sketches`."""
    place = BITS - width
    dealt = sketched.repartition(partitions(sketched.sparkSession), "bucket").sortWithinPartitions("bucket")
    out = np.zeros((1 << BITS - _BUCKET, 1 << _BUCKET - place - 3), dtype=np.uint8)
    found = materialize(dealt.mapInArrow(lambda it: _several(it, place), "bucket int, bits binary"))
    for r in found.toLocalIterator():
        out[r.bucket] = np.frombuffer(r.bits, dtype=np.uint8)
    discard(found)
    return out.ravel()


def marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether several rows may have each of ``hashes``."""
    at = hashes >> np.uint64(BITS - int(len(bits) * 8).bit_length() + 1)
    return (bits[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1
