"""Benchmark decontamination: a prefix-filtered set join of benchmark windows with documents.

A window is what must be contained whole, so its prefix is one shingle: the rarest of the window,
by counts over all documents. A document is looked through for prefix shingles only; where one
stands, its place in the window says where the window would have to begin, a bound that must lie
inside the document, and the words there are compared with the window's.

The benchmark is read in blocks of BLOCK_WORDS words; each block's windows travel to every task,
and the blocks' results are merged, so memory is bounded however large the benchmark is.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, quoted, utf8_list, with_columns

#: Words of a window, of a shingle, and of one block of the benchmark.
WINDOW, SHINGLE, BLOCK_WORDS = 10, 2, 100_000

#: Bytes to words: A-Z to a-z, separators to spaces.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(raw: bytes) -> list[bytes]:
    """Lower-cased words of a text's UTF-8 bytes: digits, letters a-z, and all beyond ASCII."""
    return raw.translate(_TO_WORDS).split()


class Block:
    """Windows of some items, found by the rarest shingle of each."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.items = items
        self.window = window
        self.first: frozenset[bytes] = frozenset()
        self.prefix: dict[tuple[bytes, ...], list[tuple[int, int, int]]] = {}

    def shingles(self) -> set[tuple[bytes, ...]]:
        return {s for _, words in self.items for s in _shingles(words)}

    def order(self, counts: dict[tuple[bytes, ...], int]) -> None:
        """Choose each window's prefix: the shingle with the smallest count, of equals the smallest."""
        self.prefix = {}
        for i, (_, words) in enumerate(self.items):
            size = min(self.window, len(words))
            found = _shingles(words)
            per = size - len(found[0]) + 1 if found else 0
            for start in range(len(words) - size + 1 if words else 0):
                at = min(range(start, start + per), key=lambda k: (counts.get(found[k], 0), found[k]))
                self.prefix.setdefault(found[at], []).append((i, start, at - start))
        self.first = frozenset(s[0] for s in self.prefix)

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Where windows occur in a document's words, and of which items."""
        if self.first.isdisjoint(words):
            return [], set()
        spans, items = [], set()
        first, prefix, n = self.first, self.prefix, len(words)
        for k in [k for k, w in enumerate(words) if w in first]:
            for s in {tuple(words[k : k + SHINGLE]), (words[k],)}:
                for i, start, offset in prefix.get(s, ()):
                    whole = self.items[i][1]
                    size, begin = min(self.window, len(whole)), k - offset
                    if begin >= 0 and begin + size <= n and words[begin : begin + size] == whole[start : start + size]:
                        spans.append((begin, begin + size))
                        items.add(i)
        return spans, items


def _shingles(words: list[bytes]) -> list[tuple[bytes, ...]]:
    size = min(SHINGLE, len(words))
    return [tuple(words[k : k + size]) for k in range(len(words) - size + 1)] if words else []


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans without overlaps, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, item: str, text: str, window: int) -> Iterator[Block]:
    rows: list[tuple[str, list[bytes]]] = []
    size = 0
    chosen = benchmark.select(F.col(quoted(item)).cast("string").alias("item"), F.col(quoted(text)).cast("string").alias("text")).where("item is not null")
    for row in chosen.toLocalIterator():
        words = words_of((row["text"] or "").encode())
        if not words:
            continue
        if rows and size + len(words) > BLOCK_WORDS:
            yield Block(rows, window)
            rows, size = [], 0
        rows.append((row["item"], words))
        size += len(words)
    if rows:
        yield Block(rows, window)


def _counted(df: DataFrame, text: Column, block: Block) -> dict[tuple[bytes, ...], int]:
    """How often each shingle of the block stands in all documents."""
    names = sorted(block.shingles())
    shared = df.sparkSession.sparkContext.broadcast({s: k for k, s in enumerate(names)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total = shared.value, Counter()
        first = frozenset(s[0] for s in number)
        for batch in batches:
            for raw in utf8_list(batch.column(0)):
                words = words_of(raw)
                words.append(b"")
                at = [k for k, w in enumerate(words) if w in first]
                total.update([s for k in at if (s := (words[k], words[k + 1])) in number])
                total.update([s for k in at if (s := (words[k],)) in number])
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([number[s] for s in total], pa.int32()), pa.array(list(total.values()), pa.int64())], ["k", "n"])

    found = df.select(text.alias("text")).mapInArrow(count, "k int, n long").groupBy("k").agg(F.sum("n").alias("n"))
    return {names[r["k"]]: r["n"] for r in found.toLocalIterator()}


def find_contamination(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", found: str = "contamination", window: int = WINDOW) -> DataFrame:
    """df with a struct about the benchmark items in each whole text.

    n_words; spans: array of (start, end) word spans, end exclusive, without overlaps, that occurring
    windows cover; items: the ids, as sorted strings without repeats, of items with such a window.
    A window is `window` consecutive words of an item, or all words of a shorter one. Null and empty
    texts have no words; items without words or without an id are passed over; items that share an
    id count as one. Rows stay as they are; an old column named like the new one gives way. Two
    passes over the texts for each block of the benchmark, no shuffle of texts.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    column = F.col(quoted(text)).cast("string")
    kind = "struct<n_words:long,spans:array<struct<start:int,end:int>>,items:array<string>>"
    before: Column = F.lit(None).cast(kind)
    searched = False
    for block in _blocks(benchmark, item, item_text, window):
        block.order(_counted(df, column, block))
        before, searched = _searched(spark.sparkContext.broadcast(block), kind)(column, before), True
    if not searched:
        before = _searched(spark.sparkContext.broadcast(Block([], window)), kind)(column, before)
    return with_columns(df, {found: before})


def _searched(shared, kind: str):
    fields = [pa.field("start", pa.int32()), pa.field("end", pa.int32())]

    @F.arrow_udf(kind)
    def run(texts: pa.Array, before: pa.Array) -> pa.Array:
        block = shared.value
        sizes, spans, names = [], [], []
        for raw, old in zip(utf8_list(texts), before.to_pylist()):
            words = words_of(raw)
            sizes.append(len(words))
            found, items = block.hits(words)
            ids = {block.items[i][0] for i in items}
            if old:
                found += [(s["start"], s["end"]) for s in old["spans"]]
                ids |= set(old["items"])
            spans.append(united(found))
            names.append(sorted(ids))
        flat = [s for one in spans for s in one]
        starts, ends = zip(*flat) if flat else ((), ())
        pairs = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], fields=fields)
        at = pa.array(np.concatenate(([0], np.cumsum([len(s) for s in spans]))).astype(np.int32))
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(at, pairs), pa.array(names, pa.list_(pa.string()))], ["n_words", "spans", "items"])

    return run
