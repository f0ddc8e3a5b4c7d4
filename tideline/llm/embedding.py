"""Embedding near-duplicates through spherical-cap filters.

Filter directions are products: after a random rotation the space is cut into two
blocks, each with random unit codes, and a direction is one code of each. Every vector is
stored at, and probes, the directions that exceed its cap, whose height is such that
``LISTED`` of them do. List decoding finds them from the best codes of each block
without going through the products: the r-th best code of one block and the s-th of the
other can be among the best ``LISTED`` only if r * s <= ``LISTED``.

Two vectors meet at the smallest direction that both list, so a pair is judged once, in
double precision. How many directions a vector lists does not grow with the table; the
number of directions does, so that each holds about ``PER_FILTER`` vectors. A pair at the
threshold lists no direction in common with about 3e-4 at 60,000 directions and fewer
than 3e-3 at 600,000 (simulated); closer pairs with far less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from tideline.llm.bucket_join import bucket_join
from tideline.llm.common import materialize
from tideline.llm.components import connected_components

COSINE = 0.95
LISTED = 24  # directions of a vector
PER_FILTER = 256  # vectors that list a direction, on average
CODES = 46_340  # most codes of a block, so that directions are 32-bit numbers


class ProductCode:
    """``codes ** 2`` unit directions in ``dim`` dimensions."""

    def __init__(self, dim: int, codes: int, listed: int = LISTED, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.half = (dim + 1) // 2
        self.codes = []
        for width in (self.half, dim - self.half):
            c = rng.standard_normal((codes if width else 1, max(width, 1)))
            self.codes.append(c / np.linalg.norm(c, axis=1, keepdims=True))
        self.listed = min(listed, len(self.codes[0]) * len(self.codes[1]))

    def decode(self, unit: np.ndarray) -> np.ndarray:
        """The ``listed`` directions of the greatest inner product with each row, ascending."""
        turned = unit @ self.turn
        best, places = [], []
        for part, codes in zip((turned[:, : self.half], turned[:, self.half :]), self.codes):
            score = part @ codes.T if part.shape[1] else np.zeros((len(unit), 1))
            k = min(self.listed, len(codes))
            top = np.argpartition(-score, k - 1, axis=1)[:, :k]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(score, top, 1), axis=1, kind="stable"), 1)
            places.append(top)
            best.append(np.take_along_axis(score, top, 1))
        r, s = np.nonzero(np.outer(np.arange(1, best[0].shape[1] + 1), np.arange(1, best[1].shape[1] + 1)) <= self.listed)
        total = best[0][:, r] + best[1][:, s]
        chosen = np.argpartition(-total, self.listed - 1, axis=1)[:, : self.listed]
        at = places[0][:, r] * len(self.codes[1]) + places[1][:, s]
        return np.sort(np.take_along_axis(at, chosen, 1), axis=1)


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _met(q: np.ndarray, h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether pairs of rows have a direction in common, where -1 is none."""
    values = np.intersect1d(q[q >= 0], h[h >= 0])
    if not len(a) or not len(values):
        return np.zeros(len(a), dtype=bool)
    if len(values) <= 4096 and len(a) > len(q) * len(h) // 50:  # nearly all pairs: one product does
        def held(lists: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(values, lists), len(values) - 1)
            row, col = np.nonzero(values[at] == lists)
            out = np.zeros((len(lists), len(values)), dtype=np.float32)
            out[row, at[row, col]] = 1
            return out

        return (held(q) @ held(h).T)[a, b] > 0
    out = np.zeros(len(a), dtype=bool)
    for i in range(0, len(a), 1 << 14):
        x, y = q[a[i : i + (1 << 14)]], h[b[i : i + (1 << 14)]]
        out[i : i + (1 << 14)] = ((x[:, :, None] == y[:, None, :]) & (x >= 0)[:, :, None]).any((1, 2))
    return out


def _alike(cosine: float, width: int, kind: str, listed: int):
    cut = width * np.dtype(kind).itemsize

    def read(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(payload, dtype=np.uint8).reshape(-1, cut + 4 * listed)
        return _unit(raw[:, :cut].copy().view(kind)), raw[:, cut:].copy().view("<i4")

    def match(q: bytes, h: bytes) -> tuple[np.ndarray, np.ndarray]:
        qv, ql = read(q)
        hv, hl = (qv, ql) if q is h else read(h)
        found = []
        for i in range(0, len(qv), 512):
            a, b = np.nonzero(qv[i : i + 512] @ hv.T >= cosine)
            fresh = ~_met(ql[i : i + 512], hl, a, b)
            found.append((a[fresh] + i, b[fresh]))
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])

    return match


def _vectors(batches: Iterator[pa.RecordBatch], decode, width: int, emit) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            rows = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            yield emit(part, rows, decode(_unit(rows)))


def _as_rows(kind: str):
    def emit(part, rows, at):
        """A row for each direction of a vector, with the vector and its smaller directions."""
        n, listed = at.shape
        smaller = np.where(np.arange(listed) < np.arange(listed)[:, None], at[:, None, :], -1).astype("<i4")  # row, place, list
        vector = np.repeat(rows.astype(kind)[:, None, :], listed, axis=1)
        raw = np.concatenate([vector.view(np.uint8), smaller.view(np.uint8)], axis=2).reshape(n * listed, -1)
        payload = pa.array(raw.view(f"V{raw.shape[1]}").ravel().tolist(), pa.binary())
        i = pa.array(np.repeat(np.arange(n), listed))
        ids, w = (part.column(k).take(i) for k in (0, 1))
        role = pa.array(np.full(n * listed, 2, dtype=np.int32))
        return pa.RecordBatch.from_arrays([pa.array(at.ravel().astype(np.int64)), role, ids, w, payload], names=["bucket", "role", "id", "w", "payload"])

    return emit


def _as_counts(part, rows, at):
    buckets, n = np.unique(at, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(buckets.astype(np.int64)), pa.array(n.astype(np.int64))], names=["bucket", "n"])


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    ``n_links`` counts the other rows at ``cosine`` or more, ``component_id`` is the
    smallest id reachable by such links. Equal vectors are one class with a weight, so a
    vector that many rows share is compared once. Vectors that are null, empty, zero or
    hold a null or non-finite component link with nothing; so do vectors whose length is
    not the most common one's, except among themselves (each length is a space of its
    own). Repeated rows count as rows. Rows with a null id link with nothing and are kept.
    Empty in, empty out.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("e"))
    finite = "x is not null and not isnan(x) and abs(x) < double('Infinity')"
    sound = F.expr(f"vec_id is not null and size(e) > 0 and forall(e, x -> {finite}) and exists(e, x -> x != 0)")
    v = v.withColumn("ok", F.coalesce(sound, F.lit(False)))
    classes = materialize(v.filter("ok").groupBy("e").agg(F.min("vec_id").alias("id"), F.count("*").alias("w")))
    links, found = None, None
    sizes = classes.groupBy(F.size("e").alias("d")).count().collect()  # a row per dimension in use
    # Floats are exact in four bytes; they are compared as doubles all the same.
    kind = "<f4" if isinstance(vectors.schema[vector_col].dataType.elementType, FloatType) else "<f8"
    for d, n in sorted((r["d"], r["count"]) for r in sizes):
        code = ProductCode(d, min(CODES, max(1, round((n * LISTED / PER_FILTER) ** 0.5))))
        own = classes.filter(F.size("e") == d).select("id", "w", "e")
        rows = own.mapInArrow(lambda it, c=code, d=d: _vectors(it, c.decode, d, _as_rows(kind)), "bucket long, role int, id long, w long, payload binary")
        counts = own.mapInArrow(lambda it, c=code, d=d: _vectors(it, c.decode, d, _as_counts), "bucket long, n long")
        counts = counts.groupBy("bucket").agg(F.sum("n").alias("stored"), F.sum("n").alias("probing"))
        part = bucket_join(rows, counts, _alike(cosine, d, kind, code.listed))
        found = part if found is None else found.unionByName(part)
    own = F.col("vec_id")
    if found is None:
        return v.select("vec_id", F.lit(0).cast("long").alias("n_links"), own.alias("component_id"), F.lit(True).alias("kept"))
    found = materialize(found)
    links = found.filter("links is not null").groupBy("id").agg((F.sum("links") - 1).alias("n_links"))
    parts = connected_components(found.filter("root is not null"), "id", "root")
    named = classes.join(links, "id", "left").join(parts.withColumnRenamed("node", "id"), "id", "left")
    named = materialize(named.select("e", F.coalesce("n_links", F.col("w") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")))
    return v.filter("ok").join(named, "e").unionByName(v.filter("not ok"), allowMissingColumns=True).select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component_id", own).alias("component_id"),
        own.eqNullSafe(F.coalesce("component_id", own)).alias("kept"),
    )
