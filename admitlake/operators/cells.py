"""An inverted file for dense search: rows in cells around fitted centres, stored by cell, of which each query visits a few.

The search is approximate: a row outside the visited cells is not found. `dense_topk` is the exact form.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import written
from .retrieval import _scaled, dense_topk

#: Rows that centres are fitted on, for each cell, about; most cells; cells that a query visits; rows and queries that meet in one task.
SAMPLE, CELLS, PROBES, PART, BLOCK = 256, 1 << 16, 64, 8192, 2048
#: Queries that the number of cells to visit is measured on, about.
TUNED = 256
#: Most cells that are named in a filter on the stored partitions.
NAMED = 1000


def cell_count(n: int) -> int:
    """About the square root of n, as a power of two, up to CELLS."""
    return 2 ** min(round(log2(max(n, 1)) / 2), int(log2(CELLS)))


def _usable(rows: DataFrame, column: str, size: int) -> DataFrame:
    """Vectors of a size, without nulls, other than the zero vector."""
    fine = (F.size(column) == size) & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(column, lambda x: x != 0)
    return rows.where(F.coalesce(fine, F.lit(False)))


def _nearest(rows: DataFrame, column: int, centres: np.ndarray, many: int, schema: str) -> DataFrame:
    """Each row, once for each of the `many` centres of highest cosine to its vector, with the centre's place from 1; of equals the lower number first."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for batch in batches:
            scaled, _ = _scaled(batch.column(column).cast(pa.list_(pa.float64())), centres.shape[1])
            cells = np.argsort(-np.round(scaled @ centres.T, 12), axis=1, kind="stable")[:, :many]
            at, place = pa.array(np.repeat(np.arange(len(cells)), cells.shape[1])), np.tile(np.arange(1, cells.shape[1] + 1, dtype=np.int32), len(cells))
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns), pa.array(cells.ravel().astype(np.int32)), pa.array(place)], [*batch.schema.names, "cell", "place"])

    return rows.mapInArrow(task, f"{schema}, cell int, place int")


def _kinds(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def build_cells(vectors: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE, seed: int = 42) -> None:
    """Store all of vectors (id, embedding) by cell under path: `rows` in one folder for each cell, `centres`, and `counts` with each cell's parts.

    Centres are fitted by k-means with cosine distance on about `sample` rows for each cell, taken by a hash of
    the id; every row then gets the cell of its nearest centre. A cell of many rows is cut in parts of about
    PART rows by a hash of the id, so one cell may hold any share of the rows. Null vectors, vectors with a
    null or NaN, zero vectors, and those of another size than the first one stay out. cells: None for
    about the square root of the rows. Of no rows the three tables are empty.
    """
    spark = vectors.sparkSession
    first = vectors.where("size(embedding) > 0").select(F.size("embedding").alias("n")).first()
    rows = written(_usable(vectors.select("id", "embedding"), "embedding", first["n"] if first else 0))
    n = rows.count()
    if not n:
        rows.withColumn("part", F.lit(0)).withColumn("cell", F.lit(0)).write.parquet(f"{path}/rows")
        spark.createDataFrame([], "cell int, centre array<double>").write.parquet(f"{path}/centres")
        spark.createDataFrame([], "cell int, n long, parts int").write.parquet(f"{path}/counts")
        return
    cells = min(cells or cell_count(n), n, CELLS)
    share = min(1.0, cells * sample / n)
    taken = rows.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    taken = written(taken.select(array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features")))
    centres = np.array(KMeans(k=cells, seed=seed, maxIter=10, distanceMeasure="cosine").fit(taken).clusterCenters()) if cells > 1 and taken.count() > 1 else np.ones((1, first["n"]))
    spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cell int, centre array<double>").write.parquet(f"{path}/centres")
    dealt = written(_nearest(rows, 1, centres, 1, _kinds(rows)).drop("place"))
    counts = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / PART).cast("int"))
    counts.coalesce(1).write.parquet(f"{path}/counts")
    counts = spark.read.parquet(f"{path}/counts")
    dealt = dealt.join(F.broadcast(counts), "cell").select("id", "embedding", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "cell")
    dealt.repartition("cell", "part").write.partitionBy("cell").parquet(f"{path}/rows")


def _centres(spark: SparkSession, path: str) -> np.ndarray:
    return np.array([r["centre"] for r in spark.read.parquet(f"{path}/centres").orderBy("cell").collect()])


def probes_for(spark: SparkSession, path: str, queries: DataFrame, k: int, target: float = 0.95, sample: int = TUNED, seed: int = 42) -> int:
    """How many cells queries like these must visit for a recall of `target`.

    Some `sample` of queries (query_id, vector), taken by a hash of the id, are searched exactly. Each of their
    hits has a cell, and the query a place for that cell; the answer is the place within which a
    share `target` of the hits lies. Without any hit it is PROBES.
    """
    centres, rows = _centres(spark, path), spark.read.parquet(f"{path}/rows")
    n = queries.count()
    if not len(centres) or not n:
        return PROBES
    few = queries.where(F.pmod(F.xxhash64(F.lit(seed), "query_id"), F.lit(1 << 30)) < int(min(1.0, sample / n) * (1 << 30)))
    few = written(_usable(few.select("query_id", "vector"), "vector", centres.shape[1]))
    exact = dense_topk(rows.select("id", "embedding"), few, k).select("query_id", "id")
    cells = _nearest(few, 1, centres, len(centres), _kinds(few)).select("query_id", "cell", "place")
    places = exact.join(rows.select("id", "cell"), "id").join(cells, ["query_id", "cell"]).groupBy("place").agg(F.count(F.lit(1)).alias("n")).collect()
    total, held = sum(r["n"] for r in places), 0
    for r in sorted(places):
        held += r["n"]
        if held >= target * total:
            return r["place"]
    return PROBES


def search_cells(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int = PROBES, digits: int = 9) -> DataFrame:
    """(query_id, id, score, rank): for each of queries (query_id, vector) the k rows of highest cosine, rounded, in the `probes` nearest cells; of equals the smallest ids.

    Rows and queries meet by cell, part of the cell and block of its queries, so a task holds PART rows and
    BLOCK queries about, however many a cell has. Queries whose vector is null, zero or of another size have no hits.
    """
    centres = _centres(spark, path)
    rows, counts = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/counts")
    kinds = {c: d.schema[c].dataType.simpleString() for d, c in ((queries, "query_id"), (rows, "id"))}
    schema = f"query_id {kinds['query_id']}, id {kinds['id']}, score double"
    if not len(centres):
        return spark.createDataFrame([], schema + ", rank int")
    asked = _usable(queries.select("query_id", "vector"), "vector", centres.shape[1])
    asked = written(_nearest(asked, 1, centres, min(probes, len(centres)), _kinds(asked)).drop("place"))
    wanted = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    about = written(counts.join(wanted, "cell").select("cell", "parts", "blocks"))
    named = [r["cell"] for r in about.select("cell").limit(NAMED + 1).collect()]
    rows = rows.where(F.col("cell").isin(named)) if len(named) <= NAMED else rows
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = rows.join(F.broadcast(about), "cell").select("id", "embedding", "cell", "part", each(F.col("blocks")).alias("block"))
    right = asked.join(F.broadcast(about), "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
    right = right.select("query_id", "vector", "cell", "block", each(F.col("parts")).alias("part"))
    size = centres.shape[1]

    def best(rows: pa.Table, asked: pa.Table) -> pa.Table:
        held, _ = _scaled(rows.column("embedding").combine_chunks().cast(pa.list_(pa.float64())), size)
        block, _ = _scaled(asked.column("vector").combine_chunks().cast(pa.list_(pa.float64())), size)
        scores = np.round(block @ held.T, digits)
        if not scores.size:
            return pa.table([asked.column("query_id")[:0], rows.column("id")[:0], pa.array([], pa.float64())], ["query_id", "id", "score"])
        least = np.partition(scores, -k, axis=1)[:, -k, None] if scores.shape[1] > k else -np.inf
        at, of = np.nonzero(scores >= least)
        return pa.table([asked.column("query_id").take(pa.array(at)), rows.column("id").take(pa.array(of)), pa.array(scores[at, of])], ["query_id", "id", "score"])

    key = ["cell", "part", "block"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(best, schema)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of exact hits (query_id, id) that are found; of none 1."""
    hit = exact.select("query_id", "id").join(found.select("query_id", "id").withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    n, got = hit.agg(F.count(F.lit(1)), F.count("hit")).first()
    return got / n if n else 1.0
