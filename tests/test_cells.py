"""The inverted file against the exact search."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import LARGER
from pyspark.sql import functions as F

from admitlake.operators import cells, retrieval
from admitlake.plans import QUERIES


@pytest.fixture(scope="module")
def vectors(spark):
    """A third of all rows is one vector; some are of no use."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8)) * 3
    rows = [(i, (centres[i % 12] + rng.normal(size=8)).round(4).tolist()) for i in range(900)] + [(900 + i, [1.0] * 8) for i in range(450)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 8), (2003, [1.0] * 5), (2004, [float("nan")] * 8), (2005, [None] * 8), (None, [2.0] * 8)]
    return spark.createDataFrame([(*r, "x") for r in rows], "id long, embedding array<float>, Cell string").repartition(5)


def queries_of(vectors):
    return vectors.where("id % 20 = 0 or id > 1999").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))


def hits(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 6)) for r in df.collect())


def test_all_cells_visited_is_the_exact_search(spark, vectors, tmp_path, monkeypatch):
    monkeypatch.setattr(cells, "PART", 50)
    monkeypatch.setattr(cells, "BLOCK", 7)
    path, queries = f"file://{tmp_path}/index", queries_of(vectors)
    cells.build_cells(vectors, path, cells=9)
    counts = spark.read.parquet(f"{path}/counts")
    assert counts.agg(F.sum("n")).first()[0] == 1351 and counts.agg(F.max("parts")).first()[0] >= 9
    exact = retrieval.dense_topk(vectors.where("not id between 2000 and 2005 or id is null"), queries.where("query_id < 2000"), 10)
    assert hits(cells.search_cells(spark, path, queries, 10, probes=9)) == hits(exact)
    assert hits(cells.search_cells(spark, path, queries, 5, probes=99)) == [h for h in hits(exact) if h[1] <= 5]


def test_few_cells_find_most(spark, vectors, tmp_path):
    path, queries = f"file://{tmp_path}/index", queries_of(vectors)
    cells.build_cells(vectors, path, cells=16)
    exact = retrieval.dense_topk(vectors.where("id < 2000"), queries.where("query_id < 2000"), 10)
    probes = cells.probes_for(spark, path, queries, 10)
    assert probes < 16 and cells.recall(cells.search_cells(spark, path, queries, 10, probes), exact) >= 0.9
    one = cells.search_cells(spark, path, queries.limit(1), 3, 1)
    assert one.count() == 3
    assert "PartitionFilters: [isnotnull(cell" in one._jdf.queryExecution().executedPlan().toString()  # folders of other cells are not read


def test_no_rows(spark, vectors, tmp_path):
    path = f"file://{tmp_path}/index"
    cells.build_cells(vectors.where("id between 2000 and 2002"), path)
    assert cells.search_cells(spark, path, queries_of(vectors), 10).count() == 0
    assert cells.probes_for(spark, path, queries_of(vectors), 10) == cells.PROBES
    assert cells.recall(*[vectors.select(F.col("id").alias("query_id"), "id").limit(0)] * 2) == 1.0
    path = f"file://{tmp_path}/single"
    cells.build_cells(vectors.where("id = 1"), path)
    assert cells.search_cells(spark, path, queries_of(vectors).where("query_id = 20"), 10).count() == 1


def test_query_has_the_recall(spark):
    assert cells.recall(QUERIES["ann_topk"](spark, LARGER), QUERIES["dense_topk"](spark, LARGER)) >= 0.9
