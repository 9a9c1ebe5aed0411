"""A stored sparse index, and BM25 search that reads only blocks which can still hold a hit.

Postings of a term are stored in blocks, one for each range of documents, with the block's largest
weight. Documents of like size share ranges, so that short documents' high weights stand apart. A query
adds up its terms' largest weights by range, scores the most promising ranges, and then only those whose
sum reaches the k-th best score found. The rows are those of `bm25_topk`.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import counted
from ..storage import written
from .retrieval import K1, B, tokens

#: Documents of a range, about; classes of size; ranges that a query scores before it prunes; terms of queries that are sent to all tasks.
SPAN, LAYERS, FIRST, TERMS = 256, 64, 4, 100_000
#: Words of the texts whose postings one task holds, about.
HELD = 2_000_000
#: Digits of weights that rounding may take from a bound.
SLACK = 1e-9
_TABLES = {"blocks": ["term", "span", "ids", "weights", "top"], "terms": ["term", "df"], "about": ["n", "mean", "layout"]}
LAYOUT = 1


def is_ready(spark: SparkSession, path: str) -> bool:
    """Whether path holds an index of the present layout."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    under = lambda name: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS")
    if not all(files.exists(under(name)) for name in _TABLES):
        return False
    if any(spark.read.parquet(f"{path}/{name}").columns != columns for name, columns in _TABLES.items()):
        return False
    return spark.read.parquet(f"{path}/about").first()["layout"] == LAYOUT


def build_postings(docs: DataFrame, path: str, words: Callable[[Column], Column] = tokens, stem: Callable[[Column], Column] | None = None, span: int = SPAN) -> None:
    """Store postings of all docs (id, text) under path, in place of what is there.

    blocks: (term, span, ids, weights, top), each file sorted by term; a weight is all of BM25 but the term's rarity. terms:
    (term, df). about: number of documents, their mean size, layout. words makes a text's words, stem a word's
    term; it sees each word of a document once. Ids are unique; rows without words count as documents. A
    range is a class of sizes and a part of it by a hash of the id, so a block holds about `span` documents
    at most. Text is read twice: for the sizes, and for the postings. Words are counted in their document's row and
    shuffled once, to as many tasks as there are times HELD words.
    """
    spark = docs.sparkSession
    read = docs.select("id", words(F.col("text")).alias("words")).withColumn("size", F.size("words"))
    sizes = written(read.groupBy("size").agg(F.count(F.lit(1)).alias("n")))
    cuts = [k / LAYERS for k in range(1, LAYERS)]
    about = sizes.agg(F.sum("n").alias("n"), F.sum(F.col("size") * F.col("n")).alias("words"), (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.percentile("size", cuts, F.col("n")).alias("cuts")).first()
    n, mean = about["n"] or 0, about["mean"] or 1.0
    layers = min(LAYERS, max(1, ceil(n / span)))
    cuts = sorted({about["cuts"][k * LAYERS // layers - 1] for k in range(1, layers)}) if n else []
    layer = sum(((F.col("size") > c).cast("int") for c in cuts), F.lit(0))
    held = dict(map(tuple, sizes.groupBy(layer.alias("layer")).agg(F.sum("n")).collect()))
    parts = [max(1, ceil(held.get(k, 0) / span)) for k in range(len(cuts) + 1)]
    first, many = (F.element_at(F.array(*map(F.lit, x)), layer + 1) for x in ([sum(parts[:k]) for k in range(len(parts))], parts))
    row = read.select("id", "size", (first + F.pmod(F.xxhash64("id"), many)).cast("int").alias("span"), F.inline(counted(F.col("words"))))
    row = row.select("id", "size", "span", (stem(F.col("word")) if stem is not None else F.col("word")).alias("term"), F.col("n").alias("tf"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil((about["words"] or 0) / HELD))
    row = row.repartition(tasks, "term", "span")
    if stem is not None:
        row = row.groupBy("id", "size", "span", "term").agg(F.sum("tf").alias("tf"))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / mean))
    held = row.withColumn("w", weight).groupBy("term", "span").agg(F.sort_array(F.collect_list(F.struct("id", "w"))).alias("held"), F.max("w").alias("top"))
    blocks = held.select("term", "span", F.col("held.id").alias("ids"), F.col("held.w").alias("weights"), "top")
    blocks.sortWithinPartitions("term", "span").write.mode("overwrite").parquet(f"{path}/blocks")
    df = spark.read.parquet(f"{path}/blocks").groupBy("term").agg(F.sum(F.size("ids")).alias("df"))
    df.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    spark.createDataFrame([(n, float(mean), LAYOUT)], "n long, mean double, layout int").write.mode("overwrite").parquet(f"{path}/about")


def ensure_postings(docs: DataFrame, path: str, **how) -> bool:
    """Build the index unless one of the present layout is there; whether it was built."""
    if is_ready(docs.sparkSession, path):
        return False
    build_postings(docs, path, **how)
    return True


def search_postings(
    spark: SparkSession, path: str, queries: DataFrame, k: int, words: Callable[[Column], Column] = tokens, stem: Callable[[Column], Column] | None = None, digits: int = 9, seen: dict[str, int] | None = None,
) -> DataFrame:
    """(query_id, id, score, rank): for each of queries (query_id, text) the k documents of highest BM25 score over its distinct terms; of equals the smallest ids.

    words and stem are those of the index. seen: told how many blocks of the queries' terms there are
    (`blocks`) and how many of them were read with their postings (`read`).
    """
    about = spark.read.parquet(f"{path}/about").first()
    blocks, terms = spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/terms")
    asked = queries.select("query_id", F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    if stem is not None:
        asked = asked.select("query_id", stem(F.col("term")).alias("term"))
    asked = asked.distinct()
    small = asked.select("term").distinct().limit(TERMS + 1).count() <= TERMS
    sent = F.broadcast if small else (lambda df: df)
    idf = F.log(1 + (about["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    rare = terms.join(sent(asked.select("term").distinct()), "term", "left_semi").select("term", idf.alias("idf"))
    asked = written(asked.join(rare, "term").select("query_id", "term", "idf"))
    wanted = written(asked.select("term").distinct())
    mine = blocks.join(sent(wanted), "term", "left_semi")
    heads = mine.select("term", "span", "top").join(asked, "term").groupBy("query_id", "span").agg(F.sum(F.col("idf") * F.col("top")).alias("bound"), F.count(F.lit(1)).alias("blocks"))
    best_first = Window.partitionBy("query_id").orderBy(F.desc("bound"), "span")
    heads = written(heads)
    first = written(heads.withColumn("place", F.row_number().over(best_first)).where(F.col("place") <= FIRST).select("query_id", "span", "blocks"))

    def score(pairs: DataFrame) -> DataFrame:
        needed = pairs.select("query_id", "span").join(asked, "query_id")
        held = mine.join(needed, ["term", "span"]).select("query_id", "idf", F.explode(F.arrays_zip("ids", "weights")).alias("p"))
        return held.groupBy("query_id", F.col("p.ids").alias("id")).agg(F.round(F.sum(F.col("idf") * F.col("p.weights")), digits).alias("score"))

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)

    early = written(ranked(score(first)))
    least = early.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    left = heads.join(first.select("query_id", "span"), ["query_id", "span"], "left_anti").join(least, "query_id", "left")
    left = written(left.where(F.col("least").isNull() | (F.col("bound") >= F.col("least") * (1 - SLACK) - SLACK)).select("query_id", "span", "blocks"))
    if seen is not None:
        count = lambda df: df.agg(F.sum("blocks")).first()[0] or 0
        seen |= {"blocks": count(heads), "read": count(first) + count(left)}
    return ranked(early.drop("rank").unionByName(score(left)))
