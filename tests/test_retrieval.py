"""Stored indexes and token counts against searches of everything."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyward import queries
from tallyward.operators import indexes, retrieval

TEXT = "id bigint, text string"


def rounded(rows):
    return {r[0]: round(r[1], 9) for r in rows}


def test_word_index_equals_search_of_all_texts_after_upserts(spark, tmp_path):
    rng, path = random.Random(2), str(tmp_path / "words")
    text = lambda: " ".join(f"t{min(rng.randrange(40), rng.randrange(40))}" for _ in range(rng.randrange(1, 60)))
    now = {}
    assert indexes.search_words(spark, path, "t1").count() == 0
    for batch in ({i: text() for i in range(300)}, {i: text() for i in range(0, 300, 7)} | {5: None, 9000: "t1", -4: ""}, {i: text() for i in range(280, 420)}, {0: "T1 t1, t1!"}):
        now |= batch
        indexes.upsert_chunks(spark.createDataFrame(list(batch.items()), TEXT), path)
        docs = spark.createDataFrame([(i, t or "") for i, t in now.items()], TEXT)
        for query in ("t1", "t1 T3 t39", "nothing", "t0 t1 t2 nothing"):
            want = rounded(retrieval.bm25(docs, "id", query).collect())
            assert rounded(indexes.search_words(spark, path, query).collect()) == want, query
    assert len(indexes.segments_of(spark, path)) == 4


def test_word_index_reads_only_the_terms_buckets(spark, tmp_path):
    path = str(tmp_path / "words")
    indexes.upsert_chunks(spark.createDataFrame([(i, f"common w{i}") for i in range(500)], TEXT), path)
    bucket = spark.createDataFrame([("w7",)], "t string").select(indexes.term_bucket(F.col("t"))).first()[0]
    read = [f for f in indexes.live_postings(spark, path, ["w7"]).inputFiles() if "/postings/" in f]
    plan = indexes.live_postings(spark, path, ["w7"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and f"= {bucket}" in plan and len(read) > 30
    common = spark.read.parquet(f"{path}/segment=000000/postings").where("term = 'common'")
    assert common.count() == 1 and common.select(F.size("ids")).first()[0] == 500


def test_word_index_refuses_unequal_lengths(spark, tmp_path):
    path = str(tmp_path / "words")
    chunks = spark.createDataFrame([(1, "a"), (2, "b")], TEXT)
    vectors = lambda *ids: spark.createDataFrame([(i, [1.0]) for i in ids], "id bigint, embedding array<double>")
    for given in (vectors(1), vectors(1, 2, 3), vectors(1, 3), vectors(1, 1)):
        with pytest.raises(ValueError, match="vectors"):
            indexes.upsert_chunks(chunks, path, given)
    for bad in ([(1, "a"), (1, "b")], [(None, "a")]):
        with pytest.raises(ValueError, match="ids"):
            indexes.upsert_chunks(spark.createDataFrame(bad, TEXT), path)
    assert indexes.segments_of(spark, path) == [] and indexes.upsert_chunks(chunks, path, vectors(2, 1)) == 0


def test_vector_index_recall(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    rows = e.collect()
    x, ids = indexes.scaled(np.array([r.embedding for r in rows], np.float64)), np.array([r.id for r in rows])
    centres = indexes.build_vectors(e, str(tmp_path / "v"))
    found = {}
    for r in indexes.search_vectors(e.where("id % 50 = 0"), str(tmp_path / "v"), centres).collect():
        found.setdefault(r.query, []).append(r.id)
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        want = set(ids[np.lexsort((ids, -(x @ x[q])))[:10]].tolist())
        hits, total = hits + len(want & set(found[int(ids[q])])), total + 10
    print("recall", hits / total, "cells", centres.probed, "of", len(centres.centres))
    assert hits / total >= 0.9 and spark.read.parquet(str(tmp_path / "v")).count() == len(rows)
    everything = indexes.search_vectors(e.where("id % 50 = 0"), str(tmp_path / "v"), centres, probed=10_000).count()
    assert everything == total


def test_vectors_in_clusters_need_few_cells(spark, tmp_path):
    rng = np.random.default_rng(3)
    tops = rng.normal(size=(40, 16))
    rows = [(i, (tops[i % 40] + 0.1 * rng.normal(size=16)).tolist()) for i in range(2000)]
    e = spark.createDataFrame(rows, "id bigint, embedding array<float>")
    cells = indexes.build_vectors(e, str(tmp_path / "v"))
    assert cells.probed < len(cells.centres) / 4


def test_vector_index_parts_and_edges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(indexes, "PART_ROWS", 10)
    rows = [(i, [1.0, 0.0]) for i in range(95)] + [(200, [0.0, 1.0]), (201, [0.0, 0.0]), (202, None), (203, [-1.0, 0.0])]
    e = spark.createDataFrame(rows, "id bigint, embedding array<float>")
    centres = indexes.build_vectors(e, str(tmp_path / "v"), cells=3)
    stored = spark.read.parquet(str(tmp_path / "v"))
    assert stored.count() == 98 and stored.groupBy("cell", "part").count().agg(F.max("count")).first()[0] < 40
    got = [r.id for r in indexes.search_vectors(e.where("id in (0, 202)"), str(tmp_path / "v"), centres, k=5).collect()]
    assert sorted(got) == [0, 1, 2, 3, 4]


def test_chunk_tokens_equal_the_tokenizers_own(spark, sf_dir):
    from tokenizers import Tokenizer

    texts = [None, "", "Tokens of <|endoftext|> naïve words", "x" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), TEXT).repartition(2)
    own = Tokenizer.from_file(retrieval.VOCABULARY)
    own.encode_special_tokens = True
    want = {i: len(own.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert {r.id: r.n for r in df.select("id", retrieval.token_counter()(F.col("text")).alias("n")).collect()} == want
    chunks = queries.QUERIES["chunk_tokens"](spark, sf_dir)
    got = chunks.agg(F.count(F.lit(1)), F.count_if("truncated"), F.count_if(F.col("n_tokens") < F.col("word_count"))).first()
    assert got[0] > 200 and 0 < got[1] < got[0]
    with pytest.raises(ValueError, match="over 256 tokens"):
        retrieval.ingest(spark.createDataFrame([("a.md", "# T\n" + "qzxj" * 30 + " zqxv" * 150)], "source_file string, text string"), retrieval.hashed_embedding(), "/tmp/never", retrieval.token_counter())
