"""The training-data pipeline: five operators in order over `documents`, each stage on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from admitlake.llm import decontam, langid, lines, pieces, queries, simhash
from admitlake.llm.common import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Segments that the encoder's workers remember here, where earlier stages' memory is still theirs.
REMEMBERED = 30_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known and likely enough; documents in no language go."""
    found = langid.identify_language(docs)
    return found.where((F.col("language") != langid.UNKNOWN) & (F.col("probability") >= langid.ENOUGH)).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that at least three of them share; n_chars follows the text."""
    found = lines.drop_repeated_lines(docs)
    text = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text"))
    size = F.when(F.col("n_dropped") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return found.select("doc_id", text.alias("text"), "lang", "source", size.alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 by 256-bit fingerprints."""
    return simhash.one_of_each(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    found = decontam.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("contamination.spans") == 0).select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's number of ids and the digests of its ids and of the text they decode to."""
    return queries.piece_digests(pieces.encode_pieces(docs, queries._model_path(), remembered=REMEMBERED))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: SQL has no such encoder and no such text model; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
