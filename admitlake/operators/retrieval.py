"""Dense and sparse top-k, fusion, boosts, caps and labels of hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..storage import written

K1, B = 1.2, 0.75
#: Bytes of query vectors that travel at a time; queries that meet a batch at a time; terms that are looked up without a join.
BLOCK_BYTES, TILE, TERMS = 64 << 20, 256, 50_000


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 9, match: tuple[str, str] | None = None) -> DataFrame:
    """For each query (query_id, vector) the k rows (id, embedding) of highest cosine, rounded; of equals the smallest ids.

    match: a column of the rows and one of the queries that must be equal for a hit. Queries travel to
    every task in blocks of BLOCK_BYTES, scaled to length 1; a task multiplies each Arrow batch with the
    block, tile by tile, and hands on the candidates for each query's k best of the batch, which are
    ranked. Null vectors, vectors of another size or of length 0, and null values of match give no hits.
    """
    own, wanted = (F.xxhash64(F.col(c).cast("string")) if c else F.lit(0).cast("long") for c in (match or (None, None)))
    asked = queries.where(F.col(match[1]).isNotNull()) if match else queries
    asked = asked.where("vector is not null").select("query_id", F.col("vector").cast("array<double>").alias("vector"), wanted.alias("wanted"))
    rows = vectors.where(F.col(match[0]).isNotNull()) if match else vectors
    rows = rows.select("id", F.col("embedding").cast("array<double>").alias("embedding"), own.alias("own"))
    kinds = {c: t.simpleString() for c, t in ((f.name, f.dataType) for f in (queries.schema["query_id"], vectors.schema["id"]))}
    schema = f"query_id {kinds['query_id']}, id {kinds['id']}, score double"
    found = None
    for ids, matrix, groups in _blocks(asked):
        shared = vectors.sparkSession.sparkContext.broadcast((ids, matrix, groups))

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, block, groups = shared.value
            for batch in batches:
                scaled, real = _scaled(batch.column(1), block.shape[1])
                kept, mine = batch.column(0).filter(pa.array(real)), batch.column(2).to_numpy()[real]
                for begin in range(0, len(block), TILE):
                    scores = np.round(block[begin : begin + TILE] @ scaled.T, digits)
                    if match:
                        scores[groups[begin : begin + TILE, None] != mine] = -np.inf
                    if not scores.size:
                        continue
                    least = np.partition(scores, -k, axis=1)[:, -k, None] if scores.shape[1] > k else -np.inf
                    at, of = np.nonzero((scores >= least) & (scores > -np.inf))
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(at + begin)), kept.take(pa.array(of)), pa.array(scores[at, of])], ["query_id", "id", "score"])

        part = rows.where(F.size("embedding") == matrix.shape[1]).mapInArrow(best, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], schema)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def _blocks(queries: DataFrame) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Queries in blocks of bounded size: ids, scaled vectors, groups. All vectors are as long as the first one; others are passed over."""
    first = queries.where("size(vector) > 0").select(F.size("vector").alias("n")).first()
    if first is None:
        return
    size, kind = first["n"], queries.select("query_id").schema
    ids, vectors, groups = [], [], []

    def block() -> tuple[pa.Array, np.ndarray, np.ndarray]:
        scaled, real = _scaled(pa.array(vectors, pa.list_(pa.float64())), size)
        return pa.array(ids, to_arrow_type(kind[0].dataType)).filter(pa.array(real)), scaled, np.array(groups, np.int64)[real]

    for row in queries.where(F.size("vector") == size).toLocalIterator():
        ids.append(row["query_id"]), vectors.append(row["vector"]), groups.append(row["wanted"])
        if len(ids) * size * 8 >= BLOCK_BYTES:
            yield block()
            ids, vectors, groups = [], [], []
    if ids:
        yield block()


def _scaled(vectors: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1, and which of the given ones are not of length 0."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    norms = np.sqrt((flat * flat).sum(1))
    real = norms > 0
    return flat[real] / norms[real, None], real


def filtered_or_global(filtered: DataFrame, everywhere: DataFrame, queries: DataFrame, boost: Column, each: int = 4) -> DataFrame:
    """For each query (query_id, n_schools) its schools' hits if there are `each` for every school, else the hits of all schools, boosted."""
    enough = filtered.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).join(queries.select("query_id", "n_schools"), "query_id").where(F.col("n") >= each * F.col("n_schools")).select("query_id")
    own = filtered.join(enough, "query_id", "left_semi").select("query_id", "id", "score")
    return own.unionByName(everywhere.join(enough, "query_id", "left_anti").select("query_id", "id", (F.col("score") + boost).alias("score")))


def page_type_boost(score: Column, kind: Column, preferred: list[str], by: float = 0.1) -> Column:
    """The score, raised for pages of a preferred type; a missing score counts as 0 there."""
    return F.when(kind.isin(preferred), F.coalesce(score, F.lit(0.0)) + by).otherwise(score)


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+"), lambda t: t != "")


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """For each query (query_id, text) the k documents (id, text) of highest BM25 score over the query's distinct terms.

    One pass over the texts: each document's size and those of its words that queries ask for, written
    once. Postings, frequencies and the mean size come from there and cover all documents. Up to TERMS
    terms are looked up as the words pass; more of them are joined.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    wanted = terms.select("term").distinct()
    few = [r["term"] for r in wanted.limit(TERMS + 1).collect()]
    cut = docs.select("id", tokens(F.col("text")).alias("words")).withColumn("size", F.size("words"))
    if len(few) <= TERMS:
        cut = written(cut.select("id", "size", F.filter("words", lambda w: w.isin(few)).alias("words")))
    else:
        kept = cut.select("id", F.explode("words").alias("term")).join(wanted, "term", "left_semi").groupBy("id").agg(F.collect_list("term").alias("words"))
        cut = written(cut.drop("words").join(kept, "id", "left"))
    about = cut.agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean")).first()
    n, mean = about["n"], about["mean"] or 1.0
    postings = written(cut.select("id", "size", F.explode("words").alias("term")).groupBy("term", "id", "size").agg(F.count(F.lit(1)).alias("tf")))
    frequency = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / mean))
    scored = postings.join(frequency, "term").select("term", "id", weight.alias("w"))
    found = scored.join(terms, "term").groupBy("query_id", "id").agg(F.round(F.sum("w"), digits).alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k)


def reciprocal_fusion(a: DataFrame, b: DataFrame, k: int = 60) -> DataFrame:
    """Two ranked lists (query_id, id, rank) as one: the sum of 1 / (k + rank)."""
    both = a.select("query_id", "id", F.col("rank").alias("rank_a")).join(b.select("query_id", "id", F.col("rank").alias("rank_b")), ["query_id", "id"], "full")
    part = [F.coalesce(1 / (k + F.col(c)), F.lit(0.0)) for c in ("rank_a", "rank_b")]
    return both.withColumn("score", part[0] + part[1])


def weighted_fusion(a: DataFrame, b: DataFrame, weight_a: float = 0.7, weight_b: float = 0.3) -> DataFrame:
    """Two scored lists as one: scores brought to 0..1 in each query's list, weighted and added; a list without spread counts 1."""

    def scaled(df: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy("query_id")
        low, high = F.min("score").over(w), F.max("score").over(w)
        return df.select("query_id", "id", F.coalesce(F.try_divide(F.col("score") - low, high - low), F.lit(1.0)).alias(name))

    both = scaled(a, "a").join(scaled(b, "b"), ["query_id", "id"], "full")
    return both.select("query_id", "id", (weight_a * F.coalesce("a", F.lit(0.0)) + weight_b * F.coalesce("b", F.lit(0.0))).alias("score"))


def capped_by_key(hits: DataFrame, key: str, rank: str, most: int = 2) -> DataFrame:
    """At most `most` hits of a key in rank order; hits without a key all stay."""
    blank = F.coalesce(F.col(key), F.lit("")) == ""
    place = F.row_number().over(Window.partitionBy(key).orderBy(rank))
    return hits.where(~blank).withColumn("place", place).where(F.col("place") <= most).drop("place").unionByName(hits.where(blank))


def first_by_key(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


def merged_queries(hits: DataFrame, top_k: int) -> DataFrame:
    """Hits (question_id, query_no, rank, url) of a question's several searches as one list: the first of each address, by search and rank; hits without an address go; top_k of each question, with `place`."""
    first = first_by_key(hits.where(F.coalesce("url", F.lit("")) != ""), ["question_id", "url"], "query_no", "rank")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy("query_no", "rank"))).where(F.col("place") <= top_k)


def answered_or(first: DataFrame, fallback: DataFrame) -> DataFrame:
    """Each query's hits by the first search; of queries that it has none for, those of the other one."""
    return first.unionByName(fallback.join(first.select("query_id").distinct(), "query_id", "left_anti"))


def confidence(n: Column, mean: Column, high: float = 0.5, medium: float = 0.2) -> Column:
    return F.when((n >= 4) & (mean > high), "high").when((n >= 2) & (mean > medium), "medium").otherwise("low")


def ranking_boost(rank: Column, acceptance: Column, academics: Column, grade: Column) -> Column:
    """What a school's rank, selectivity (for academics) and mean grade add to a hit's score."""
    by_rank = F.coalesce(F.greatest(F.lit(0.0), 1 - (rank - 1) / 500) * 0.15, F.lit(0.0))
    by_rate = F.coalesce(F.when(academics & (acceptance > 0) & (acceptance <= 1), (1 - acceptance) * 0.05), F.lit(0.0))
    return by_rank + by_rate + F.coalesce(grade / 4.3 * 0.10, F.lit(0.0))
