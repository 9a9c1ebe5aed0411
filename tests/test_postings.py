"""The stored index against the plain BM25 search."""

from __future__ import annotations

import random

import pytest
from conftest import LARGER
from pyspark.sql import functions as F

from admitlake.functions import english
from admitlake.operators import postings, retrieval


def hits(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 6)) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    """Words by a steep law; a third of the rows has the same text; some have none."""
    draw = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    rows = [(i, " ".join(draw.choices(words, weights, k=draw.choice((3, 8, 40, 200))))) for i in range(600)]
    rows += [(600 + i, "the same w1 w2 words running") for i in range(300)] + [(1000, None), (1001, ""), (1002, "w0 " * 3000), (None, "w5 w7")]
    return spark.createDataFrame(rows, "id long, text string").repartition(4)


QUERIES = [(1, "w1 w2"), (2, "w250 w0 w0"), (3, "w299"), (4, "unknown"), (5, None), (6, "w10 w20 w30 w40 W50"), (7, "same words"), (8, "w0")]


def test_same_hits_and_fewer_blocks(spark, docs, tmp_path):
    queries = spark.createDataFrame(QUERIES, "query_id long, text string")
    path, seen = f"file://{tmp_path}/index", {}
    postings.build_postings(docs, path, span=16)
    found = postings.search_postings(spark, path, queries, 5, seen=seen)
    assert hits(found) == hits(retrieval.bm25_topk(docs, queries, 5))
    assert 0 < seen["read"] < 0.7 * seen["blocks"]
    blocks = spark.read.parquet(f"{path}/blocks")
    assert blocks.agg(F.max(F.size("ids"))).first()[0] <= 50  # though a third of the texts are equal
    assert blocks.where(F.array_max("weights") != F.col("top")).count() == 0


def test_all_documents_are_one_range(spark, docs, tmp_path):
    queries = spark.createDataFrame(QUERIES, "query_id long, text string")
    path = f"file://{tmp_path}/index"
    postings.build_postings(docs, path, span=100_000)
    assert hits(postings.search_postings(spark, path, queries, 50)) == hits(retrieval.bm25_topk(docs, queries, 50))


def test_many_terms_are_joined(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "TERMS", 2)
    queries = spark.createDataFrame(QUERIES, "query_id long, text string")
    path = f"file://{tmp_path}/index"
    postings.build_postings(docs, path, span=32)
    assert hits(postings.search_postings(spark, path, queries, 3)) == hits(retrieval.bm25_topk(docs, queries, 3))


def test_index_is_built_once_and_anew_when_its_layout_is_old(spark, docs, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/index"
    assert not postings.is_ready(spark, path)
    assert postings.ensure_postings(docs, path) and not postings.ensure_postings(docs, path)
    monkeypatch.setattr(postings, "LAYOUT", 2)
    assert postings.ensure_postings(docs.limit(0), path)
    assert spark.read.parquet(f"{path}/blocks").count() == 0 and spark.read.parquet(f"{path}/about").first()["n"] == 0
    assert postings.search_postings(spark, path, spark.createDataFrame(QUERIES, "query_id long, text string"), 3).count() == 0
    spark.range(3).write.mode("overwrite").parquet(f"{path}/terms")
    assert not postings.is_ready(spark, path)


def test_stems_meet(spark, tmp_path):
    docs = spark.createDataFrame([(1, "The universities are studying"), (2, "a study of the university"), (3, "nothing")], "id long, text string")
    path = f"file://{tmp_path}/index"
    postings.build_postings(docs, path, english.words, english.stem)
    queries = spark.createDataFrame([(1, "Studies in universities"), (2, "the of")], "query_id long, text string")
    assert sorted((r["query_id"], r["id"]) for r in postings.search_postings(spark, path, queries, 5, english.words, english.stem).collect()) == [(1, 1), (1, 2)]


def test_blocks_skipped_on_the_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    queries = spark.read.parquet(f"{LARGER}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    path, seen = f"file://{tmp_path}/index", {}
    postings.build_postings(docs, path, span=16)
    assert hits(postings.search_postings(spark, path, queries, 10, seen=seen)) == hits(retrieval.bm25_topk(docs, queries, 10))
    assert seen["read"] < seen["blocks"]


def test_more_words_are_held_by_more_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "HELD", 100)
    docs = spark.createDataFrame([(k, " ".join(f"w{k * j % 97}" for j in range(60))) for k in range(50)], "id long, text string")
    postings.build_postings(docs, str(tmp_path))
    files = spark.read.parquet(f"{tmp_path}/blocks")
    assert files.select(F.input_file_name()).distinct().count() > 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert files.groupBy("term", "span").count().where("count > 1").isEmpty()
