"""What the training-data operators share: the shared folder, column names, Arrow helpers."""

from __future__ import annotations

import atexit
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_dir

#: Bytes of text that one Arrow batch carries to a Python worker; a longer text travels alone.
BATCH_BYTES = "4m"

_written: list[tuple[SparkSession, str]] = []


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for a worker, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def stored(df: DataFrame) -> DataFrame:
    """df written once as Parquet in the shared folder and read back, so that later branches reuse it and prune columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_remove)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _remove() -> None:
    for spark, path in _written:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may be gone; the cluster then clears its own folder
            return


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df does not have yet, whatever its letters' case."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """df with new columns at the end; an old column of the same name in any case gives way."""
    lower = {n.lower() for n in new}
    return df.select(*[F.col(quoted(c)) for c in df.columns if c.lower() not in lower], *[c.alias(n) for n, c in new.items()])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def utf8_parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array as one buffer, and len + 1 offsets into it; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_binary(texts.type) else b"")
    if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def utf8_list(texts: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; nulls are empty."""
    raw, at = utf8_parts(texts)
    whole = raw.tobytes()
    return [whole[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def list_array(values: np.ndarray, sizes: np.ndarray | list[int], kind: pa.DataType) -> pa.ListArray:
    """Rows of the given sizes cut from values."""
    at = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values, kind))


#: A-Z to a-z and nothing else, for texts held as str.
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def lowered(column: Column) -> Column:
    """A-Z lower-cased, all other characters kept."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: White space of words, and what a pattern calls it.
BLANKS, BLANK = " \t\n\x0b\x0c\r", r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """The maximal runs of other characters than white space, in order; of null or white space alone an empty list."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK))
