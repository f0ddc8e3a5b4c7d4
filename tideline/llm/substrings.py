"""Removal of long repeated byte strings with run-length indexes.

A byte goes if a string of ``width`` bytes that covers it also starts anywhere
else. All windows of ``width`` bytes are dealt to anchors: a window's anchor is
its leftmost smallest hashed gram, which equal windows share at the same place.
An anchor with its windows is a context of less than ``2 * width`` bytes, so all
copies of a window lie in contexts of one anchor hash:

* a hash that occurs once has no repeats;
* equal contexts repeat throughout, and are counted, not gathered;
* the distinct contexts of a hash go through a run-length index: the suffixes of
  the contexts are sorted, the Burrows-Wheeler transform is cut into runs, match
  lengths are computed at run heads and run ends only, and every other place
  streams its matching statistic from the place before it (one less). Windows
  whose statistic with either neighbour reaches ``width`` are marked.

A hash with more than ``GROUP`` distinct contexts is not gathered either: its
windows are counted by hash, which is as exact and spreads over all tasks.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import discard, materialize, partitions

WIDTH, GRAM = 200, 32
GROUP = 4096  # distinct contexts of one hash that an index may hold
CHUNK = 1 << 20  # bytes of context indexed at once
_SEGMENT = 1 << 19  # window starts of one document handled at once
_PLACE = np.uint64(20)  # low bits of a sort key that hold the place
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _grams(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` (a power of two) bytes."""
    h, n = data.astype(np.uint64) * _B + _A, 1
    while n < size:
        h = h[:-n] * _A + (h[n:] ^ (h[n:] >> np.uint64(29)))
        h ^= h >> np.uint64(32)
        h *= _B
        n *= 2
    return h ^ (h >> np.uint64(31))


def _window_min(keys: np.ndarray, size: int) -> np.ndarray:
    low, n = keys, 1
    while 2 * n <= size:
        low, n = np.minimum(low[:-n], low[n:]), 2 * n
    return np.minimum(low[: len(keys) - size + 1], low[size - n :]) if n < size else low


def anchors(data: bytes, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and last window start of each anchor of a text."""
    raw, found = np.frombuffer(data, dtype=np.uint8), []
    for lo in range(0, len(raw) - width + 1, _SEGMENT):
        part = raw[lo : lo + _SEGMENT + width - 1]
        h = _grams(part, gram)
        place = np.arange(len(h), dtype=np.uint64)
        at = (_window_min((h >> _PLACE << _PLACE) | place, width - gram + 1) & ((np.uint64(1) << _PLACE) - np.uint64(1))).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.concatenate([first[1:] - 1, [len(at) - 1]])
        found.append((h[at[first]].view(np.int64), first + lo, last + lo))
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found))


def repeated_windows(contexts: list[bytes], width: int = WIDTH) -> np.ndarray:
    """For each place of the joined contexts: whether the ``width`` bytes from it also
    start at another place. Matches do not cross contexts."""
    text = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    sizes = np.array([len(c) for c in contexts])
    n, place = len(text), np.arange(len(text), dtype=np.int32)
    end = np.repeat(np.cumsum(sizes), sizes).astype(np.int32)
    first = np.zeros(n, dtype=bool)
    first[np.cumsum(sizes) - sizes] = True

    def ranked(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        s = key[order]
        rank = np.empty(n, dtype=np.int32)
        rank[order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
        return rank

    key = np.zeros(n, dtype=np.uint64)
    for j in range(7):
        inside = place + j < end
        key = (key << np.uint64(9)) | np.where(inside, text[np.minimum(place + j, n - 1)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    levels, deep = [(7, ranked(key))], 7
    while deep < sizes.max() and levels[-1][1].max() < n - 1:
        rank = levels[-1][1]
        after = np.where(place + deep < end, rank[np.minimum(place + deep, n - 1)] + 1, 0)
        deep *= 2
        levels.append((deep, ranked((rank.astype(np.uint64) << np.uint64(32)) | after.astype(np.uint64))))
    order = np.argsort((levels[-1][1].astype(np.uint64) << np.uint64(32)) | place.astype(np.uint64))
    bwt = np.where(first[order], np.int16(-1), text[order - 1].astype(np.int16))
    cut = (bwt[1:] != bwt[:-1]) | (bwt[1:] < 0)  # where a run of the transform ends

    def match(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        most = np.minimum(end[i] - i, end[j] - j)
        length = np.zeros(len(i), dtype=np.int32)
        for size, rank in reversed(levels):
            live = length < most
            a, b = np.minimum(i + length, n - 1), np.minimum(j + length, n - 1)
            length += np.where(live & (rank[a] == rank[b]), size, 0).astype(np.int32)
            length = np.minimum(length, most)
        for _ in range(6):
            a, b = np.minimum(i + length, n - 1), np.minimum(j + length, n - 1)
            length += (length < most) & (text[a] == text[b])
        return length

    best = np.zeros(n, dtype=np.int32)
    for step in (-1, 1):  # the neighbour before, at run heads; the neighbour behind, at run ends
        sampled = np.flatnonzero(np.concatenate([[True], cut] if step < 0 else [cut, [True]]))
        near = sampled + step
        some = (near >= 0) & (near < n)
        at = np.full(n, -1, dtype=np.int32)
        at[order[sampled]] = 0
        at[order[sampled[some]]] = match(order[sampled[some]].astype(np.int32), order[near[some]].astype(np.int32))
        source = np.maximum.accumulate(np.where(at >= 0, place, 0))
        best = np.maximum(best, at[source] - (place - source))
    return best >= width


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds the text and a key of 128 bits; equal texts share both."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({"_text": text, "_k1": F.xxhash64(text), "_k2": F.xxhash64(F.lit(1), text, F.octet_length(text))})


def _binary(column: pa.Array) -> pa.Array:
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())


def _emit_anchors(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, out = [batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)], []
        texts = _binary(batch.column(2))
        for i in range(batch.num_rows):
            data = texts[i].as_py()
            h, a, b = anchors(data, width)
            c = [xxhash.xxh3_64_intdigest(data[x : y + width]) for x, y in zip(a.tolist(), b.tolist())]
            out.append((h, np.array(c, dtype=np.uint64).view(np.int64), np.full(len(h), keys[0][i]), np.full(len(h), keys[1][i]), a.astype(np.int32), b.astype(np.int32)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["h", "c", "_k1", "_k2", "a", "b"])


def _emit_contexts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    seen = set()  # rows repeated with the same id meet here, and one of them is enough
    for batch in batches:
        rows = []
        for k1, k2, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _binary(batch.column(2)), batch.column(3)):
            if (k1, k2) not in seen:
                seen.add((k1, k2))
                data = text.as_py()
                rows += [(w["h"], w["c"], k1, k2, w["a"], w["m"], w["n"], data[w["a"] : w["b"] + width]) for w in wanted.as_py()]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        for lo in range(0, len(rows), 8192):
            part = zip(*rows[lo : lo + 8192])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(part, kinds)], names=["h", "c", "_k1", "_k2", "a", "m", "n", "ctx"])


def _runs(marked: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Byte ranges of runs of marked window starts."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], marked, [False]]).astype(np.int8)))
    return [(s, e - 1 + width) for s, e in edge.reshape(-1, 2).tolist()]


def _index_groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Contexts sorted by h and c; whole groups are indexed, some at a time."""
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())

    def index(rows: list) -> pa.RecordBatch:
        hit, out, at = repeated_windows([r[7] for r in rows], width), [], 0
        for r in rows:
            size = len(r[7])
            if r[5] == 1:  # contexts with copies are marked already
                out += [(r[2], r[3], r[4] + s, r[4] + e) for s, e in _runs(hit[at : at + size - width + 1], width)]
            at += size
        cols = list(zip(*out)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds)], names=["_k1", "_k2", "s", "e"])

    held, size, last = [], 0, None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:2] == last:
                continue
            if size >= CHUNK and row[0] != last[0]:
                yield index(held)
                held, size = [], 0
            last = row[:2]
            held.append(row)
            size += len(row[7])
    if held:
        yield index(held)


def _emit_windows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, k1, k2, a, m, _, ctx in zip(*(c.to_pylist() for c in batch.columns)):
            starts = range(len(ctx) - width + 1)
            d = [xxhash.xxh3_128_digest(ctx[s : s + width]) for s in starts]
            n = len(d)
            yield pa.RecordBatch.from_arrays(
                [pa.array(d, pa.binary()), pa.array([k1] * n), pa.array([k2] * n), pa.array([a + s for s in starts], pa.int32()), pa.array([m] * n)],
                names=["w", "_k1", "_k2", "s", "m"],
            )


def _release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of what has been written already."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def repeated_spans(keyed: DataFrame, width: int = WIDTH, group: int = GROUP) -> DataFrame:
    """``_k1, _k2, spans``: byte ranges to remove, for texts that have any."""
    spark = keyed.sparkSession
    id_ = F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_id")
    texts = keyed.filter(F.octet_length("_text") >= width).select("_k1", "_k2", "_text", id_)
    every = materialize(texts.select("_k1", "_k2", "_text").mapInArrow(lambda it: _emit_anchors(it, width), "h long, c long, _k1 long, _k2 long, a int, b int"))
    groups = every.groupBy("h").agg(F.count("*").alias("n"), (F.min("c") != F.max("c")).alias("mixed")).filter("n > 1")
    # Counts are written before they are joined: only then can Spark split a hot hash's rows.
    again = materialize(every.join(materialize(groups.select("h", "mixed")), "h"))
    discard(every)
    _release(spark)
    whole = lambda df: df.select("_k1", "_k2", F.col("a").alias("s"), (F.col("b") + width).alias("e"))
    marks = whole(again.filter("not mixed"))
    mixed = again.filter("mixed").drop("mixed")
    kinds = mixed.groupBy("h", "c").agg(F.count("*").alias("m"), F.min(F.struct("_k1", "_k2", "a", "b")).alias("r"))
    kinds = materialize(kinds)
    sizes = materialize(kinds.groupBy("h").agg(F.count("*").alias("n")))
    # A join of its own, so that Spark can split the rows of a context that very many texts have.
    equal = materialize(whole(mixed.join(kinds.filter("m > 1").select("h", "c"), ["h", "c"])))
    marks = marks.unionByName(equal)
    one = kinds.join(sizes, "h").select("r._k1", "r._k2", F.struct("h", "c", "m", "n", "r.a", "r.b").alias("x"))
    one = one.groupBy("_k1", "_k2").agg(F.collect_list("x").alias("wanted"))  # at most one per byte of the text
    # One row of each group of copies gives the contexts, so that a hot text is read once.
    first = texts.groupBy("_k1", "_k2").agg(F.min("_id").alias("_id"))
    one = materialize(one.join(materialize(first), ["_k1", "_k2"]))
    fields = "h long, c long, _k1 long, _k2 long, a int, m long, n long, ctx binary"
    contexts = texts.join(one, ["_k1", "_k2", "_id"]).select("_k1", "_k2", "_text", "wanted").mapInArrow(lambda it: _emit_contexts(it, width), fields)
    contexts = materialize(contexts)
    _release(spark)
    spot = contexts.filter(F.col("n") <= group).repartition(partitions(spark), "h").sortWithinPartitions("h", "c")
    marks = marks.unionByName(spot.mapInArrow(lambda it: _index_groups(it, width), "_k1 long, _k2 long, s int, e int"))
    crowd = contexts.filter(F.col("n") > group).dropDuplicates(["h", "c"])
    crowd = crowd.mapInArrow(lambda it: _emit_windows(it, width), "w binary, _k1 long, _k2 long, s int, m long")
    often = crowd.groupBy("w").agg(F.count("*").alias("n")).filter("n > 1").select("w")
    crowd = crowd.filter("m = 1").join(often, "w", "left_semi").select("_k1", "_k2", "s", (F.col("s") + width).alias("e"))
    spans = marks.unionByName(crowd).distinct().groupBy("_k1", "_k2")
    return spans.agg(F.collect_list(F.struct("s", "e")).alias("spans"))


def _merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], e)
        else:
            out.append((s, e))
    return out


def _kept(data: bytes, removed: list[tuple[int, int]]) -> bytes:
    cuts = [0, *(x for r in removed for x in r), len(data)]
    return b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2]))


def _applied(docs: DataFrame, id_col: str, text_col: str, width: int, fields: str, kinds: list[pa.DataType], row) -> DataFrame:
    rows = _keyed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "text").drop("text")
    spans = materialize(repeated_spans(rows, width))
    _release(docs.sparkSession)
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, marks = _binary(batch.column(1)), batch.column(2)
            found = [row(texts[i].as_py(), _merged(marks[i].as_py())) for i in range(batch.num_rows)]
            cols = zip(*found) if found else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(cols, kinds))], names=names)

    return rows.join(spans, ["_k1", "_k2"], "left").select("doc_id", "_text", "spans").mapInArrow(run, fields)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``doc_id, kept binary, removed``: the remaining bytes and the removed byte ranges.

    Texts are judged as UTF-8; null texts are empty. Matches never cross documents, may
    overlap, and are judged on the input. Texts shorter than ``width`` stay whole; copies
    of a longer text go whole, all of them. Ids may be null or repeat. Empty in, empty out.
    A cut may fall inside a character, so what stays is bytes.
    """
    fields = "doc_id long, kept binary, removed array<struct<s:int,e:int>>"
    kinds = [pa.binary(), pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))]
    return _applied(docs, id_col, text_col, width, fields, kinds, lambda data, cut: (_kept(data, cut), [{"s": s, "e": e} for s, e in cut]))


def repeat_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of :func:`remove_repeats`."""
    fields = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def row(data: bytes, cut: list[tuple[int, int]]) -> tuple:
        return len(data), sum(e - s for s, e in cut), len(cut), sha256(_kept(data, cut)).hexdigest()

    return _applied(docs, id_col, text_col, width, fields, [pa.int64()] * 3 + [pa.string()], row)
