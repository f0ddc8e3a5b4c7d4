"""The pipeline against a plain version of its stages."""

from collections import defaultdict

import corpus_pipeline as p
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.test_documents import SCHEMA, components, plain_jaccard, plain_shingles, plain_spans
from tideline.llm import simhash
from tideline.llm.common import SMALL, materialize


def test_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = [(5000, None, "en", "s", 0), (5001, "123 456", "en", "s", 7), (5002, "", None, None, None)]
    docs = docs.unionByName(spark.createDataFrame(odd, SCHEMA)).unionByName(docs.limit(3)).withColumn("score", F.lit(1)).repartition(2)
    sizes = []
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == p.COLUMNS
        docs = spark.createDataFrame(docs.collect(), SCHEMA)
        sizes.append(docs)
    first, exact, near, masked = [{r.doc_id: r for r in d.collect()} for d in sizes]
    assert not {5000, 5001, 5002} & set(first)
    groups = defaultdict(list)
    for r in first.values():
        groups[r.text].append(r.doc_id)
    assert set(exact) == {max(v) for v in groups.values()}
    sets = {i: plain_shingles(r.text, 5) for i, r in exact.items()}
    fps = {i: simhash.fingerprint(r.text.encode(), 5) for i, r in exact.items()}
    links = [(a, b) for a in sets for b in sets if a < b and (plain_jaccard(sets[a], sets[b]) >= 0.8 or (fps[a] ^ fps[b]).bit_count() <= 2)]
    comp = components(sets, links)
    assert set(near) == {i for i, c in comp.items() if i == c} and len(near) < len(exact)
    assert set(masked) == set(near)
    for i, r in masked.items():
        assert not plain_spans(r.text) and r.n_chars == (len(r.text) if r.text != near[i].text else near[i].n_chars)
    packed = p.STAGES[-1][1](spark, sizes[-1], "")
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(masked)


def test_run(spark):
    assert p.run(spark, "/root/testdata/sf0.001").count() > 0


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in p.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_texts_go_to_workers_in_small_batches(spark, monkeypatch):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    def seen(docs, **_):
        found.append(materialize(docs.select("text").mapInArrow(sizes, "n long")).agg(F.max("n")).first()[0])
        return docs

    found, before = [], {k: spark.conf.get(k) for k in SMALL}
    monkeypatch.setattr(simhash, "drop_near_copies", seen)
    docs = spark.range(0, 400, 1, 1).selectExpr("id AS doc_id", "repeat('a', 40000) AS text", "'en' AS lang", "'s' AS source", "40000L AS n_chars")
    p.drop_near_copies(spark, docs, "")
    assert found[0] < 6e6  # 16 MB at once before
    assert {k: spark.conf.get(k) for k in SMALL} == before
