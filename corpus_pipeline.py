"""A training-corpus pipeline over the ``documents`` table.

Language identification rejects texts in no language, exact and near copies go,
personal data is masked, and what is left is packed. Every stage but the last
returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import exact_dedup, language, packing, pii, simhash
from tideline.llm.common import discard, materialize, small_batches

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``lang`` becomes the predicted language; texts that are null or have no letter go."""
    docs = docs.select(*COLUMNS)
    found = language.with_language(docs, language.learn(docs), COLUMNS)
    return found.filter(F.col("lang_pred") != language.UNKNOWN).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays. Null counts as empty; rows without
    an id and rows repeated under a kept id stay. An empty table gives no rows."""
    return exact_dedup.drop_copies(docs.select(*COLUMNS)).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts alike the document with the smallest id stays: those whose sets of five-word
    shingles have a Jaccard similarity of 0.8 or more, or whose five-word fingerprints differ in
    two bits at most, and what such links connect. Rows without an id and rows repeated under
    a kept id stay. An empty table gives no rows."""
    with small_batches(spark):
        return simhash.drop_near_copies(docs.select(*COLUMNS), shingle=5, similarity=0.8).select(*COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span becomes its kind in brackets; ``n_chars`` follows the new text."""
    rows = docs.select(*COLUMNS, F.coalesce("text", F.lit("")).alias("_text"))
    with small_batches(spark):
        rows = pii.with_spans(rows.withColumn("_key", F.sha2("_text", 256)), "_key", "_text")
    some = F.size("spans") > 0
    rows = pii.mask(rows, "_text", "spans", "_masked").withColumn("text", F.when(some, F.col("_masked")).otherwise(F.col("text")))
    return rows.withColumn("n_chars", F.when(some, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, see :func:`tideline.llm.packing.pack`; null and empty
    texts are one piece, repeated rows and rows without an id are packed like any others."""
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("pii", mask_personal_data),
    ("packing", pack_documents),
]
# Language identification and fingerprints are beyond SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = materialize(docs)
            if n:
                discard(before)
    return docs
