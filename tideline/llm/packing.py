"""Packing into length buckets with the least padding.

Lengths are byte tokens (UTF-8 bytes). A document longer than ``max_len`` is cut
into pieces of that length. The global histogram of piece lengths, in bins of
``step`` tokens, has at most ``max_len / step`` rows however many documents there
are; dynamic programming over it picks the bucket boundaries. With a step of one,
which is the default, they are the best among all lengths. Rows are numbered
inside a bucket by counting per shard first, so no window holds a whole bucket; shards
are dealt by a row number that is written down, so repeated ids share none.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.llm.common import id_and_text, materialize

MAX_LEN, STEP, BUCKETS, BUDGET, SHARDS = 8192, 1, 8, 65_536, 1024


def best_boundaries(bins: list[tuple[int, int, int]], buckets: int, step: int) -> list[int]:
    """Boundaries that minimise padding. ``bins``: (bin number from 1, rows, tokens), ascending.

    A bucket reaches to the upper end of its last bin; at most ``buckets`` are used. Of
    equal costs the later cut wins.
    """
    if not bins:
        return []
    ends = np.array([b * step for b, _, _ in bins], dtype=np.float64)
    rows = np.concatenate([[0], np.cumsum([float(n) for _, n, _ in bins])])
    tokens = np.concatenate([[0], np.cumsum([float(t) for _, _, t in bins])])
    n = len(bins)
    cost = np.full(n + 1, np.inf)
    cost[0], cuts = 0.0, []
    for _ in range(min(buckets, n)):
        new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int)
        new[0] = 0.0
        for j in range(1, n + 1):  # the last bucket holds bins i..j-1
            total = cost[:j] + ends[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            cut[j] = j - 1 - int(total[::-1].argmin())
            new[j] = total[cut[j]]
        cost = new
        cuts.append(cut)
    out, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        out.append(int(ends[j - 1]))
        j = cut[j]
    return out[::-1]


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_len: int = MAX_LEN,
    step: int = STEP,
    buckets: int = BUCKETS,
    budget: int = BUDGET,
    shards: int = SHARDS,
) -> DataFrame:
    """One row per piece: ``doc_id, piece, n_tokens, bucket, bucket_len, batch, slot, padding``.

    ``batch`` numbers the batches of a bucket from 0; a batch holds as many pieces of
    ``bucket_len`` tokens as ``budget`` allows, at least one. Null and empty texts are one
    piece without tokens in the first bucket. Rows may repeat and ids may be null; each row
    is packed. Which batch a piece falls into may differ from run to run, how many batches a
    bucket has and how full they are may not. An empty table gives no rows.
    """
    sized = id_and_text(docs, id_col, text_col).select("doc_id", F.octet_length("text").alias("_n"))
    # Written, as row numbers may come out otherwise when a task runs again.
    sized = materialize(sized.withColumn("_row", F.monotonically_increasing_id()))
    last = F.greatest(F.ceil(F.col("_n") / max_len) - 1, F.lit(0)).cast("int")
    pieces = sized.select("doc_id", "_row", "_n", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    pieces = pieces.select(
        "doc_id", "_row", "piece", F.least(F.lit(max_len), F.col("_n") - F.col("piece") * max_len).cast("long").alias("n_tokens")
    )
    bin_ = F.greatest(F.ceil(F.col("n_tokens") / step), F.lit(1)).cast("int")
    histogram = pieces.groupBy(bin_.alias("b")).agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).orderBy("b")
    ends = best_boundaries([tuple(r) for r in histogram.collect()], buckets, step)  # at most max_len / step rows
    bucket = F.size(F.filter(F.array(*map(F.lit, ends)), lambda x: x < F.col("n_tokens"))) if ends else F.lit(0)
    length = F.element_at(F.array(*map(F.lit, ends)), bucket + 1) if ends else F.lit(step)
    rows = pieces.withColumns(
        {
            "bucket": bucket.cast("int"),
            "bucket_len": length.cast("long"),
            "_s": F.pmod(F.xxhash64("_row", "piece"), F.lit(shards)).cast("int"),
        }
    )
    before = Window.partitionBy("bucket").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("bucket", "_s").count()  # at most buckets x shards rows, so it is broadcast
    counts = counts.select("bucket", "_s", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    order = Window.partitionBy("bucket", "_s").orderBy("doc_id", "piece", "_row")
    per = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_len")))
    at = F.col("_before") + F.row_number().over(order) - 1
    return (
        rows.join(F.broadcast(counts), ["bucket", "_s"])
        .withColumn("_at", at)
        .select(
            "doc_id",
            "piece",
            "n_tokens",
            "bucket",
            "bucket_len",
            F.floor(F.col("_at") / per).cast("long").alias("batch"),
            F.pmod(F.col("_at"), per).cast("long").alias("slot"),
            (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
        )
    )
