"""Line dedup: two Bloom filters propose repeated lines, and only these are shuffled and confirmed.

Each task puts the hashes of its documents' lines into a filter of lines seen once and a filter of
lines seen twice. Filters are cut into segments by hash; segments of all tasks are merged (a bit
that two tasks have in their first filters goes to the second), so no line seen twice is lost. A
filter's size follows the number of lines up to MOST_BITS: beyond that it lets more lines through
to the exact part, never fewer. The exact part counts documents by line and chooses the one that
keeps it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, free_name, quoted, stored, utf8_list, with_columns

#: Lines shorter than this stay, and so do those in fewer documents.
CODE_POINTS, DOCUMENTS = 20, 3
#: Bits of each filter for a line, at least and at most; segments that merge on their own.
BITS_EACH, LEAST_BITS, MOST_BITS, SEGMENTS = 16, 1 << 20, 1 << 27, 64
#: Line hashes that a task holds before it puts them into its filters.
HELD = 1_000_000
#: Hashes of one filter entry.
PROBES = 2
#: Repeated lines that may travel to every task in one piece; more of them are joined.
BROADCAST_LINES = 200_000

_WHITE = b" \t\n\x0b\x0c\r"
_INNER = re.compile(rb"[\x80-\xbf]")


def keys_of(raw: bytes, least: int = CODE_POINTS) -> list[bytes | None]:
    """For each line of a text its key, or None if the line is too short to be looked at."""
    out: list[bytes | None] = []
    for line in raw.split(b"\n"):
        if len(line) < least:
            out.append(None)
            continue
        key = line.strip(_WHITE).lower()
        n = len(key)
        out.append(key if n >= least and (n >= 4 * least or n - len(_INNER.findall(key)) >= least) else None)
    return out


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """PROBES bit positions for each hash, all in the segment that its top bits name."""
    each = bits // SEGMENTS
    segment = (hashes >> np.uint64(58)).astype(np.int64) * each
    one, two = hashes & np.uint64(0xFFFFFFF), (hashes >> np.uint64(28)) & np.uint64(0xFFFFFFF)
    return np.stack([segment + ((one + np.uint64(k) * (two | np.uint64(1))) % np.uint64(each)).astype(np.int64) for k in range(PROBES)], 1)


def _hashes(raw: bytes, least: int) -> np.ndarray:
    found = {k for k in keys_of(raw, least) if k is not None}
    return np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))


def _partial(bits: int, least: int):
    """Of a task's texts: the segments of both filters, as set bits' numbers; a part for every HELD hashes."""

    def filters(hashes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        found, times = np.unique(np.concatenate(hashes), return_counts=True)
        each = bits // SEGMENTS
        once, twice = np.unique(_positions(found, bits)), np.unique(_positions(found[times > 1], bits))
        for s in range(SEGMENTS):
            packed = [(x[np.searchsorted(x, s * each) : np.searchsorted(x, (s + 1) * each)] - s * each).astype("<u4").tobytes() for x in (once, twice)]
            if packed[0]:
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array(packed[:1], pa.binary()), pa.array(packed[1:], pa.binary())], ["segment", "once", "twice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held = [], 0
        for batch in batches:
            for raw in utf8_list(batch.column(0)):
                hashes.append(_hashes(raw, least))
                held += len(hashes[-1])
            if held >= HELD:
                yield from filters(hashes)
                hashes, held = [], 0
        if held:
            yield from filters(hashes)

    return run


def _merged(bits: int):
    """Of a segment: the second filter after all tasks' parts, zipped."""
    each = bits // SEGMENTS

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(each, bool), np.zeros(each, bool)
        for batch in batches:
            for a, b in zip(batch.column("once"), batch.column("twice")):
                first, second = (np.frombuffer(x.as_py(), "<u4") for x in (a, b))
                twice[second] = True
                twice[first[once[first]]] = True
                once[first] = True
        if twice.any():
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.flatnonzero(twice).astype("<u4").tobytes()], pa.binary())], ["segment", "twice"])

    return run


def repeated_filter(df: DataFrame, text: str = "text", least: int = CODE_POINTS) -> np.ndarray:
    """The filter of lines seen twice or more, as a packed bit array of MOST_BITS / 8 bytes at most."""
    column = F.col(quoted(text)).cast("string").alias("text")
    newlines = F.sum(F.length(column) - F.length(F.replace(column, F.lit("\n"))) + 1).alias("n")
    lines = df.select(newlines).first()["n"] or 0
    bits = LEAST_BITS
    while bits < min(MOST_BITS, lines * BITS_EACH):
        bits *= 2
    parts = df.select(column).mapInArrow(_partial(bits, least), "segment int, once binary, twice binary")
    merged = parts.groupBy("segment").applyInArrow(_merged(bits), "segment int, twice binary")
    out, each = np.zeros(bits // 8, np.uint8), bits // SEGMENTS
    for row in merged.toLocalIterator():
        own = np.zeros(each, bool)
        own[np.frombuffer(row["twice"], "<u4")] = True
        out[row["segment"] * each // 8 : (row["segment"] + 1) * each // 8] = np.packbits(own, bitorder="little")
    return out


def repeated_lines(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = CODE_POINTS, documents: int = DOCUMENTS) -> DataFrame:
    """Line keys found in at least `documents` rows: line, n (rows), keeper (largest document id with it).

    The lines that pass the filter are counted before they are shuffled, so a line that most
    documents hold is a row for each task. keeper is null where only rows with a null id hold it.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(repeated_filter(df, text, least))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = shared.value
        bits = len(twice) * 8
        for batch in batches:
            rows, keys = [], []
            for i, raw in enumerate(utf8_list(batch.column(1))):
                found = list({k for k in keys_of(raw, least) if k is not None})
                if not found:
                    continue
                at = _positions(np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found)), bits)
                passed = np.flatnonzero((twice[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(1)).tolist()
                keys += [found[k] for k in passed]
                rows += [i] * len(passed)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), batch.column(0).take(pa.array(rows))], ["line", "id"])

    ids = df.select(F.col(quoted(key)).cast("long").alias("id"), F.col(quoted(text)).cast("string").alias("text"))
    found = ids.mapInArrow(suspects, "line binary, id long")
    return found.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= documents)


def drop_repeated_lines(
    df: DataFrame, key: str = "doc_id", text: str = "text", kept: str = "kept_text", n_lines: str = "n_lines", n_dropped: str = "n_dropped",
    least: int = CODE_POINTS, documents: int = DOCUMENTS, broadcast_lines: int = BROADCAST_LINES,
) -> DataFrame:
    """df with each whole text without its repeated lines, and how many lines it had and lost.

    A line's key is the line without white space at its ends, A-Z lower-cased. Keys of `least` code
    points or more that `documents` rows or more hold lose all their lines except in the row whose
    id is the largest of them; rows that share this id all keep them, and a key that only rows with
    a null id hold stays everywhere. A null or empty text is one empty line and its kept text is
    empty. Rows stay as they are, repeated ones included, each counting as a document; old columns
    named like the new ones give way.

    Up to broadcast_lines repeated keys are sent to every task as 16-byte digests; more are joined
    to the lines that hold them, gathered by document id, and joined to the documents.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    lost = stored(repeated_lines(df, key, text, least, documents).where("keeper is not null"))
    kind = "struct<kept:string,n_lines:long,n_dropped:long>"

    def cut(raw: bytes, gone) -> tuple[bytes, int, int]:
        lines, keys = raw.split(b"\n"), keys_of(raw, least)
        stay = [line for line, k in zip(lines, keys) if k is None or not gone(k)]
        return (raw if len(stay) == len(lines) else b"\n".join(stay)), len(lines), len(lines) - len(stay)

    def packed(rows: list[tuple[bytes, int, int]]) -> pa.Array:
        a, b, c = zip(*rows) if rows else ([], [], [])
        return pa.StructArray.from_arrays([pa.array(a, pa.binary()).cast(pa.string()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], ["kept", "n_lines", "n_dropped"])

    if lost.count() <= broadcast_lines:
        keepers = spark.sparkContext.broadcast({xxhash.xxh3_128_digest(bytes(r["line"])): r["keeper"] for r in lost.select("line", "keeper").toLocalIterator()})

        @F.arrow_udf(kind)
        def run(ids: pa.Array, texts: pa.Array) -> pa.Array:
            found, rows = keepers.value, []
            for i, raw in zip(ids.to_pylist(), utf8_list(texts)):
                rows.append(cut(raw, lambda k, i=i: found.get(xxhash.xxh3_128_digest(k), i) != i))
            return packed(rows)

        made = run(F.col(quoted(key)).cast("long"), F.col(quoted(text)).cast("string"))
    else:
        def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = [(i, k) for i, raw in enumerate(utf8_list(batch.column(1))) for k in {x for x in keys_of(raw, least) if x is not None}]
                if keys:
                    rows, lines = zip(*keys)
                    yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary()), batch.column(0).take(pa.array(rows))], ["line", "id"])

        ids = df.select(F.col(quoted(key)).cast("long").alias("id"), F.col(quoted(text)).cast("string").alias("text"))
        gone, at = free_name(df, "gone_lines"), free_name(df, "gone_at")
        drops = ids.mapInArrow(holders, "line binary, id long").join(lost.select("line", "keeper"), "line").where(~F.col("id").eqNullSafe(F.col("keeper")))
        drops = drops.groupBy(F.col("id").alias(at)).agg(F.collect_set("line").alias(gone))
        df = df.join(drops, F.col(quoted(key)).cast("long").eqNullSafe(F.col(at)), "left").drop(at)

        @F.arrow_udf(kind)
        def run(texts: pa.Array, lists: pa.Array) -> pa.Array:
            return packed([cut(raw, frozenset(some or ()).__contains__) for raw, some in zip(utf8_list(texts), lists.to_pylist())])

        made = run(F.col(quoted(text)).cast("string"), F.col(gone))
        out = with_columns(df, {kept: made["kept"], n_lines: made["n_lines"], n_dropped: made["n_dropped"]})
        return out.drop(gone)
    return with_columns(df, {kept: made["kept"], n_lines: made["n_lines"], n_dropped: made["n_dropped"]})
