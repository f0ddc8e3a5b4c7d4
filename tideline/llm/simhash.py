"""SimHash near-duplicates through vantage-point shards.

Every text gets a 64-bit fingerprint. Distinct fingerprints are sharded by a
vantage-point tree: at each node the Hamming distance to the vantage point
decides the side. A fingerprint is stored in one shard and probes that shard
and those which the triangle bound leaves open: if two fingerprints differ in
at most r bits, their distances to any vantage point differ by at most r. Of a
pair that a node parts, only the near side probes across, so each pair meets in
one shard. Inside a shard the same bound prunes again before bits are counted. The upper
levels are fitted to a sample; below them vantage points are pseudo-random, as the
bits of what is left there are near random, so the tree grows with the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import several
from tideline.llm.bucket_join import TILE, bucket_join, forest
from tideline.llm.common import discard, drop_rows, few, id_and_text, lean, materialize
from tideline.llm.components import connected_components

SHINGLE, RADIUS, SEED = 3, 2, 42
SHARD = 2048  # distinct fingerprints a shard is meant to hold
SAMPLE = 1 << 15  # fingerprints, at most, from which the tree is grown
_BITS = np.arange(64, dtype=np.uint64)
_BLOCK = 1 << 15  # shingles counted at once
COMMON_SAMPLE, COMMON = 8192, 200_000  # documents, about, to learn common shingles from, and how many, at most, are learned
DENSE = 4  # candidate pairs a row, at most, that leave the worker
FAMILY = 512  # texts of a family that are compared at once
_WIDE = 2048  # shingles of them that are counted at once
_ROW = np.dtype([("fp", ">u8"), ("id", ">i8"), ("label", ">i8"), ("size", ">i8"), ("pos", ">i8")])


def _hashes(text: bytes, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles, some at a time; nothing for a text without words.

    ``bytes.lower`` and ``bytes.split`` touch A-Z and split at space, tab to
    carriage return and nothing else.
    """
    words, digest = text.lower().split(), xxhash.xxh64_intdigest
    if not words:
        return
    if len(words) <= shingle:
        yield np.array([digest(b" ".join(words), SEED)], dtype="<u8")
        return
    n = len(words) - shingle + 1
    for lo in range(0, n, _BLOCK):
        part = words[lo : lo + _BLOCK + shingle - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle))))
        yield np.array([digest(g, SEED) for g in grams], dtype="<u8")


def _majority(blocks: list[np.ndarray]) -> int:
    ones, n = np.zeros(64, dtype=np.int64), 0
    for h in blocks:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return int(np.bitwise_or.reduce(np.where(2 * ones > n, np.uint64(1) << _BITS, np.uint64(0))))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit i is 1 if it is set in over half of the shingles' XXH64 values."""
    return _majority(_hashes(text, shingle))


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary() if pa.types.is_string(batch.column(1).type) else pa.large_binary())
        values = np.array([fingerprint(t.as_py(), shingle) for t in texts], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long); null texts are empty, no words give zero."""
    return id_and_text(docs, id_col, text_col).mapInArrow(lambda it: _fingerprints(it, shingle), "doc_id long, fp long")


def _scattered(nodes: np.ndarray) -> np.ndarray:
    """A pseudo-random vantage point for each node number."""
    x = nodes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class VantageTree:
    """Inner nodes in heap order: a vantage point and the largest near distance. ``deeper``
    levels without a table follow below the ``depth`` fitted ones."""

    def __init__(self, sample: np.ndarray, depth: int, deeper: int = 0):
        rng = np.random.default_rng(7)
        self.depth, self.deeper = depth, deeper
        self.points = np.zeros(max(1, 2**depth - 1), dtype=np.uint64)
        self.radii = np.zeros(len(self.points), dtype=np.int64)
        held = {0: sample}
        for node in range(2**depth - 1):
            own = held.pop(node)
            if len(own):
                tries = own[rng.permutation(len(own))[:8]]
                far = np.bitwise_count(tries[:, None] ^ own[None, :]).astype(np.int64)
                cut = np.median(far, axis=1).astype(np.int64)
                uneven = np.abs((far <= cut[:, None]).mean(1) - 0.5)
                best = int(uneven.argmin())
                self.points[node], self.radii[node] = tries[best], cut[best]
                near = far[best] <= cut[best]
            else:
                near = np.zeros(0, dtype=bool)
            held[2 * node + 1], held[2 * node + 2] = own[near], own[~near]

    def _nodes(self, level: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray | int]:
        return (self.points[at], self.radii[at]) if level < self.depth else (_scattered(at), 31)

    def route(self, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Home leaf of each fingerprint; index and leaf of its probes in other leaves."""
        home = np.zeros(len(fps), dtype=np.int64)
        who, at = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        everyone = np.arange(len(fps))
        for level in range(self.depth + self.deeper):
            point, cut = self._nodes(level, at)
            d = np.bitwise_count(fps[who] ^ point).astype(np.int64)
            left, right = d - radius <= cut, d + radius > cut
            who, at = np.concatenate([who[left], who[right]]), np.concatenate([2 * at[left] + 1, 2 * at[right] + 2])
            point, cut = self._nodes(level, home)
            d = np.bitwise_count(fps ^ point).astype(np.int64)
            near = d <= cut
            across = near & (d + radius > cut)
            who, at = np.concatenate([who, everyone[across]]), np.concatenate([at, 2 * home[across] + 2])
            home = np.where(near, 2 * home + 1, 2 * home + 2)
        return home, who, at


def _close(radius: int):
    def match(q: bytes, h: bytes) -> tuple[np.ndarray, np.ndarray]:
        q, h = np.frombuffer(q, dtype="<u8"), np.frombuffer(h, dtype="<u8")
        far = np.bitwise_count(h ^ h[0])
        order = np.argsort(far, kind="stable")
        far, h = far[order], h[order]
        mine = np.bitwise_count(q ^ h[0]).astype(np.int64)
        qi, hi = [], []
        for d in np.unique(mine):
            lo, up = np.searchsorted(far, [max(0, d - radius), d + radius + 1])
            some = np.flatnonzero(mine == d)
            for i in range(0, len(some), 512):
                a, b = np.nonzero(np.bitwise_count(q[some[i : i + 512], None] ^ h[None, lo:up]) <= radius)
                qi.append(some[i : i + 512][a])
                hi.append(order[lo:up][b])
        return np.concatenate(qi), np.concatenate(hi)

    return match


def near_duplicates(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """``fp, component_id`` for each distinct fingerprint of ``fps`` (``doc_id, fp``).

    Fingerprints that differ in at most ``radius`` bits are linked; the component is
    the smallest ``doc_id`` reachable. Equal fingerprints are one node, however many
    documents have them. Ids may be null: such rows join the component of their
    fingerprint, which is null only if no id is reachable. Empty in, empty out.
    """
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("id")))
    known = classes.filter("id is not null")
    n = known.count()
    levels = int(np.ceil(np.log2(max(1, n / shard))))
    depth = min(levels, int(np.log2(sample)) - 4)
    drawn = known.orderBy(F.xxhash64("fp"), "fp").limit(sample if depth else 1).select("fp").collect()
    tree = VantageTree(np.array([r.fp for r in drawn], dtype=np.int64).view(np.uint64), depth, levels - depth)

    def routed(batches: Iterator[pa.RecordBatch], emit) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                fp = batch.column(0).slice(lo, 4096).to_numpy(zero_copy_only=False)
                ids = batch.column(1).slice(lo, 4096).to_numpy(zero_copy_only=False)
                home, who, at = tree.route(fp.view(np.uint64), radius)
                every = np.arange(len(fp))
                yield emit(fp, ids, np.concatenate([every, every, who]), np.concatenate([home, home, at]), np.repeat([0, 1], [len(fp), len(fp) + len(who)]))

    def as_rows(fp, ids, i, leaf, role):
        return pa.RecordBatch.from_arrays(
            [pa.array(leaf), pa.array(role.astype(np.int32)), pa.array(ids[i]), pa.array(np.ones(len(i), dtype=np.int64)), pa.array(fp[i].view("V8").tolist(), pa.binary())],
            names=["bucket", "role", "id", "w", "payload"],
        )

    def as_counts(fp, ids, i, leaf, role):
        leaves, at = np.unique(leaf, return_inverse=True)
        probing = np.bincount(at, weights=role, minlength=len(leaves)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(leaves), pa.array(np.bincount(at, minlength=len(leaves)) - probing), pa.array(probing)], names=["bucket", "stored", "probing"])

    rows = known.mapInArrow(lambda it: routed(it, as_rows), "bucket long, role int, id long, w long, payload binary")
    counts = known.mapInArrow(lambda it: routed(it, as_counts), "bucket long, stored long, probing long")
    counts = counts.groupBy("bucket").agg(F.sum("stored").alias("stored"), F.sum("probing").alias("probing"))
    links = bucket_join(rows, counts, _close(radius)).filter("root is not null")
    found = connected_components(links, "id", "root")
    return classes.join(found, classes["id"] == found["node"], "left").select(
        "fp", F.coalesce("component", "id").alias("component_id")
    )


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: ``doc_id, fingerprint`` (16 hex digits)``, component_id``."""
    fps = materialize(fingerprints(docs, id_col, text_col, shingle))
    return fps.join(near_duplicates(fps, radius), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _set(text: bytes, shingle: int) -> np.ndarray:
    """The distinct shingles of a text, sorted."""
    return np.unique(np.concatenate([np.zeros(0, dtype="<u8"), *_hashes(text, shingle)]))


def _ordered(shingles: np.ndarray, shared: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Distinct shingles in the one order of all documents: those that only one has, then the
    ``shared`` ones, of which the common (``common``, sorted rows of shingle and count) come
    last by their counts."""
    n = np.zeros(len(shingles), dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common["shingle"], shingles), len(common) - 1)
        n = np.where(common["shingle"][at] == shingles, common["n"][at], 0)
    return shingles[np.lexsort((shingles, n, shared))]


def _slack(x: float) -> int:
    """The next whole number, where what is beyond ``x`` by rounding alone counts as ``x``."""
    return int(np.ceil(x - 1e-9))


def _places(shingles: np.ndarray) -> np.ndarray:
    return shingles >> np.uint64(64 - several.BITS)


def shared_shingles(docs: DataFrame, shingle: int) -> np.ndarray:
    """A bitmap of the shingles that several documents may have, of some 4 characters a bit, 64 MB at most."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    found = docs.mapInArrow(
        lean(lambda it: several.sketches(np.unique(_places(_set(t.as_py().encode(), shingle))) for batch in it for t in batch.column(1))),
        "bucket int, hashes binary",
    )
    return several.bitmap(found, min(29, max(20, (chars // 4).bit_length())))


def _signatures(batches: Iterator[pa.RecordBatch], shingle: int, similarity: float, common: np.ndarray, bitmap: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Fingerprint, a key of the set of shingles, its size and its prefix: of two sets as
    similar as asked, the prefixes share a shingle. Shingles that only one document has come
    first, ``skipped`` of them, and are left out, as nothing meets them. A set that shares fewer
    shingles with all others than a partner would need has no prefix."""
    kinds = (pa.int64(), pa.uint64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            part, rows = batch.slice(lo, 1024), []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                blocks = list(_hashes(text.as_py().encode(), shingle))
                x = np.unique(np.concatenate([np.zeros(0, dtype="<u8"), *blocks]))
                shared = several.marked(bitmap, _places(x))
                alone = len(x) - int(shared.sum())
                prefix = _ordered(x, shared, common)[alone : max(alone, len(x) - _slack(similarity * len(x)) + 1)]
                rows.append((doc_id, _majority(blocks), xxhash.xxh3_128_digest(x.tobytes()), len(x), alone, prefix.view(np.int64)))
            cols = [pa.array(x, k) for x, k in zip(zip(*rows), kinds)]
            cols[1] = cols[1].view(pa.int64())
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "fp", "key", "size", "skipped", "prefix"])


def _shingles(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column(1):
            yield pa.RecordBatch.from_arrays([pa.array(_set(text.as_py().encode(), shingle).view(np.int64))], names=["shingle"])


def common_shingles(docs: DataFrame, shingle: int) -> np.ndarray:
    """Shingles of three or more documents of a sample. They only set an order, so what the
    sample lacks costs time and no pair."""
    every = max(1, -(-docs.count() // COMMON_SAMPLE))
    drawn = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("doc_id", "text")
    found = drawn.mapInArrow(lean(lambda it: _shingles(it, shingle)), "shingle long").groupBy("shingle").agg(F.count("*").alias("n"))
    found = found.filter("n > 2").orderBy(F.desc("n"), "shingle").limit(COMMON).collect()
    rows = np.array([(r.shingle % 2**64, r.n) for r in found], dtype=[("shingle", "<u8"), ("n", "<i8")])
    return np.sort(rows, order="shingle")


def _partners(similarity: float, every: bool):
    """Matches of other labels whose sizes, and what is left of them behind the shared shingle,
    allow the similarity: all of them, or the nearest fingerprint and the smallest id."""

    def match(q: bytes, h: bytes) -> tuple[np.ndarray, np.ndarray]:
        q, h = (np.frombuffer(x, dtype=_ROW) for x in (q, h))
        order = np.argsort(h["id"], kind="stable")
        fp, ids, label, size, pos = (h[n][order].astype(t) for n, t in zip(_ROW.names, ("u8", "i8", "i8", "i8", "i8")))
        mine = {n: q[n].astype("u8" if n == "fp" else "i8")[:, None] for n in _ROW.names}
        qi, hi = [], []
        for i in range(0, len(q), 256):
            a = {n: x[i : i + 256] for n, x in mine.items()}
            least = similarity / (1 + similarity) * (a["size"] + size) - 1e-6  # shingles they must share
            fit = (a["label"] != label) & (a["id"] != ids) & (np.minimum(a["size"] - a["pos"], size - pos) >= least)
            if not fit.any():
                continue
            if every:
                x, y = np.nonzero(fit & (a["id"] > ids))
            else:
                some = np.flatnonzero(fit.any(1))
                bits = np.where(fit[some], np.bitwise_count(a["fp"][some] ^ fp), 65)
                x, y = np.tile(some, 2), np.concatenate([bits.argmin(1), fit[some].argmax(1)])
            qi.append(x + i)
            hi.append(order[y])
        none = np.zeros(0, dtype=np.int64)
        return np.concatenate([none, *qi]), np.concatenate([none, *hi])

    return match


def _pairs(q_ids: np.ndarray, h_ids: np.ndarray, qi: np.ndarray, hi: np.ndarray, q: bytes, h: bytes) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.unique(np.sort(np.stack([q_ids[qi], h_ids[hi]]), axis=0), axis=1)
    return b, a


def _pairs_or_family(q_ids: np.ndarray, h_ids: np.ndarray, qi: np.ndarray, hi: np.ndarray, q: bytes, h: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Matches as pairs, the smaller id second, or where there are more than a few a row as a forest
    of them, the smaller id first."""
    if len(qi) <= DENSE * (len(q_ids) + len(h_ids)):
        return _pairs(q_ids, h_ids, qi, hi, q, h)
    ids, roots = forest(q_ids, h_ids, qi, hi)
    some = ids != roots
    return roots[some], ids[some]


def jaccard(a: bytes, b: bytes, shingle: int) -> float:
    """Similarity of the sets of shingles; texts without words are alike."""
    x, y = (_set(t, shingle) for t in (a, b))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def _verified(pairs: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of ``pairs`` (``id, root``) whose texts are as similar as asked."""
    ids = pairs.select(F.explode(F.array("id", "root")).alias("doc_id")).distinct()
    texts = docs.join(materialize(ids), "doc_id", "left_semi")
    both = pairs.join(texts.select(F.col("doc_id").alias("id"), F.col("text").alias("a")), "id")
    both = both.join(texts.select(F.col("doc_id").alias("root"), F.col("text").alias("b")), "root").select("id", "root", "a", "b")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(k) for k in (2, 3))
            good = [jaccard(x.as_py().encode(), y.as_py().encode(), shingle) >= similarity for x, y in zip(a, b)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["id", "root"]).filter(pa.array(good, pa.bool_()))

    return materialize(both.mapInArrow(lean(verified), "id long, root long").distinct())


def _unpacked(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and shingles of sets that follow each other, each behind its size."""
    words, starts, at = np.frombuffer(payload, dtype="<u8"), [], 0
    while at < len(words):
        starts.append(at)
        at += int(words[at]) + 1
    return words[starts].astype(np.int64), np.delete(words, starts)


def _alike(similarity: float):
    """Pairs of sets as similar as asked, from the counts of what all of them share."""

    def match(q: bytes, h: bytes) -> tuple[np.ndarray, np.ndarray]:
        (m, x), (n, y) = _unpacked(q), _unpacked(h)
        both = np.zeros((len(m), len(n)), dtype=np.float32)
        known = np.intersect1d(x, y)
        sides = []
        for sizes, found in ((m, x), (n, y)):
            row = np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(known, found), max(0, len(known) - 1))
            some = np.flatnonzero(known[at] == found) if len(known) else at[:0]
            some = some[np.argsort(at[some], kind="stable")]
            sides.append((row[some], at[some], len(sizes)))
        for lo in range(0, len(known), _WIDE):
            a, b = (np.zeros((k, _WIDE), dtype=np.float32) for _, _, k in sides)
            for to, (row, at, _) in zip((a, b), sides):
                i, j = np.searchsorted(at, [lo, lo + _WIDE])
                to[row[i:j], at[i:j] - lo] = 1
            both += a @ b.T
        both = both.astype(np.float64)
        return np.nonzero(both / np.maximum(m[:, None] + n - both, 1) >= similarity)

    return match


def _family_links(families: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``id, root`` edges that connect what is as similar as asked inside each family (``node,
    component``). The pairs are counted where the texts meet and never written."""
    texts = docs.join(families.withColumnRenamed("node", "doc_id"), "doc_id").select("component", "doc_id", "text").dropDuplicates(["doc_id"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [_set(t.as_py().encode(), shingle) for t in batch.column(2)]
            payload = [np.concatenate([np.array([len(x)], dtype="<u8"), x]).tobytes() for x in held]
            n, one = len(held), np.ones(len(held), dtype=np.int64)
            cols = [batch.column(0), pa.array(np.full(n, 2, dtype=np.int32)), batch.column(1), pa.array(one), pa.array(payload, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["bucket", "role", "id", "w", "payload"])

    rows = texts.mapInArrow(lean(sets), "bucket long, role int, id long, w long, payload binary")
    counts = families.groupBy(F.col("component").alias("bucket")).agg(F.count("*").alias("stored"), F.count("*").alias("probing"))
    return bucket_join(rows, counts, _alike(similarity), tile=FAMILY, probes=FAMILY).filter("root is not null").select("id", "root")


def similar_links(sig: DataFrame, docs: DataFrame, links: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``node, component`` of the groups that ``links`` (``id, root``) and all pairs of a Jaccard
    similarity of ``similarity`` or more connect.

    Of such a pair the prefixes share a shingle, so every pair is a candidate in some bucket. First
    each document's nearest and first candidate of a bucket are compared by their texts; then
    all candidates which that has left in different groups. Where a bucket has more than a few of
    those a document, they are no rows: their documents are a family, which is compared in tiles."""
    first = sig.groupBy("key").agg(F.min("doc_id").alias("id"))
    copies = materialize(sig.select("doc_id", "key").join(first, "key").filter("doc_id != id").select(F.col("doc_id").alias("id"), F.col("id").alias("root"), "key"))
    own = drop_rows(sig.withColumnRenamed("doc_id", "id"), copies.select("id", "key"), ["id", "key"])
    each = materialize(own.select("id", "fp", "size", "skipped", F.posexplode("prefix").alias("pos", "bucket")).withColumn("pos", F.col("pos") + F.col("skipped")).drop("skipped"))
    crowd = materialize(each.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"))
    held = each.join(F.broadcast(crowd.select("bucket")) if few(crowd) else crowd.select("bucket"), "bucket")
    held = materialize(held)
    discard(each)
    discard(crowd)
    links = links.unionByName(copies.select("id", "root"))

    def candidates(rows: DataFrame, every: bool) -> DataFrame:
        counts = rows.groupBy("bucket").agg(F.count("*").alias("stored"), F.count("*").alias("probing"))
        payload = F.concat(*(F.unhex(F.lpad(F.hex(F.col(n).cast("long")), 16, "0")) for n in _ROW.names))
        rows = rows.select("bucket", F.lit(2).alias("role"), "id", F.lit(1).cast("long").alias("w"), payload.alias("payload"))
        found = bucket_join(rows, counts, _partners(similarity, every), probes=TILE, link=_pairs_or_family if every else _pairs)
        return materialize(found.filter("root is not null").select("id", "root").distinct())

    pairs = candidates(held.withColumn("label", F.col("id")), False)
    links = materialize(links.unionByName(_verified(pairs, docs, shingle, similarity)))
    discard(copies)
    groups = materialize(connected_components(links, "id", "root"))
    rest = materialize(held.join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component"))
    discard(held)
    mixed = rest.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi").select("bucket")
    left = candidates(rest.join(mixed, "bucket", "left_semi"), True)
    more = _verified(materialize(left.filter("id > root").join(pairs, ["id", "root"], "left_anti")), docs, shingle, similarity)
    families = materialize(connected_components(left.filter("id < root"), "id", "root"))
    if not families.isEmpty():
        more = materialize(more.unionByName(_family_links(families, docs, shingle, similarity)))
    discard(rest)
    discard(pairs)
    discard(left)
    if more.isEmpty():
        return groups
    return connected_components(links.unionByName(more), "id", "root")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """``doc_id, component_id``: groups of documents linked by fingerprints within ``radius`` bits,
    through the vantage-point tree, or by a Jaccard similarity of ``similarity`` (above 0) or more.

    At 0.8 fingerprints are some 3 to 17 bits apart. No bound on distances prunes a tree of
    64 bits there, so those pairs come from shared shingles of the sets' prefixes, which lose none, and
    are verified by their texts. A bitmap of the shingles that several documents have tells which
    sets can have a partner at all. Null texts count as empty, texts without words are
    alike, rows without an id have no group. Empty in, empty out.
    """
    rows = id_and_text(docs, id_col, text_col).filter("doc_id is not null")
    common = common_shingles(rows, shingle)
    bitmap = rows.sparkSession.sparkContext.broadcast(shared_shingles(rows, shingle))
    fields = "doc_id long, fp long, key binary, size long, skipped long, prefix array<long>"
    sig = materialize(rows.mapInArrow(lean(lambda it: _signatures(it, shingle, similarity, common, bitmap.value)), fields))
    bitmap.destroy()  # nothing reads it again
    near = sig.select("doc_id", "fp").join(materialize(near_duplicates(sig.select("doc_id", "fp"), radius)), "fp")
    links = near.select(F.col("doc_id").alias("id"), F.col("component_id").alias("root")).filter("id != root")
    found = similar_links(sig, rows, materialize(links), shingle, similarity).withColumnRenamed("node", "doc_id")
    alone = sig.select("doc_id").distinct().join(found.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.col("doc_id").alias("component_id"))
    return found.select("doc_id", F.col("component").alias("component_id")).unionByName(alone)


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, similarity: float | None = None
) -> DataFrame:
    """``docs`` with one document, that of the smallest id, of each component: of
    :func:`simhash_components`, or with ``similarity`` of :func:`similar_groups`.

    Rows without an id are exempt: all of them stay, copies among them included, as does
    each row repeated under a kept id.
    """
    if similarity is None:
        groups = simhash_components(docs, id_col, text_col, radius, shingle)
    else:
        groups = similar_groups(docs, id_col, text_col, shingle, similarity, radius)
    dropped = materialize(groups.filter("doc_id != component_id").select(F.col("doc_id").alias("__id")).distinct())
    return drop_rows(docs.withColumn("__id", F.col(id_col).cast("long")), dropped, ["__id"]).select(*docs.columns)
