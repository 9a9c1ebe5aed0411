"""SimHash near-dedup: fingerprints linked by a binary trie self-join, and the components of the links.

Fingerprints that differ in at most k bits agree in at least one of k + 1 bands of bits. For each
band the fingerprints are dealt out by the band's value and turned so that the band comes first:
then a band's value is a node of the binary trie of the sorted numbers. From the pairs (node, same
node) the trie is walked two nodes at a time, level by level with array operations; a pair's count
of differing bits grows where its nodes part, and pairs beyond k are dropped. Of a task's links a
spanning forest goes on, so a large group of near copies sends a link for each member, not for
each pair. Components come from alternating star contraction, written out after each round.

near_copies takes a small budget on 64 bits, where every link is found. similar_copies takes a
similarity of shingles: its budget is too large for bands that are sure to agree, so 256 bits are
dealt out by many samples of them, and each sample's buckets are walked as tries.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, free_name, quoted, stored, utf8_list, with_columns

SEED = 42
#: A print that more than 1 / HOT of all rows have is not gathered: there are at most HOT of them, and their classes travel to every task.
HOT = 1000
#: Node pairs that are walked at a time, so that memory is bounded.
PAIRS = 1 << 20
#: Prints that are held at a time.
BLOCK = 100_000


def fingerprint(raw: bytes, shingle: int = 3) -> int:
    """The SimHash of a text's UTF-8 bytes: a bit is set if it is in more than half of the shingles' hashes."""
    words = raw.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    count = len(words) - shingle + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[k:] for k in range(shingle)))), repeat(SEED)), np.uint64, count)
    total = np.zeros(64, np.int64)
    for k in range(0, count, 1 << 14):
        part = hashes[k : k + (1 << 14)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > count, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint", shingle: int = 3) -> DataFrame:
    """df with each whole text's fingerprint as a 64-bit integer; a null or empty text has fingerprint 0."""
    bounded_batches(df.sparkSession)

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        found = np.array([fingerprint(raw, shingle) for raw in utf8_list(texts)], np.uint64)
        return pa.array(found.view(np.int64))

    return with_columns(df, {out: run(F.col(quoted(text)).cast("string"))})


def bands(most: int) -> list[tuple[int, int]]:
    """(first bit, bits) of most + 1 bands that share out 64 bits."""
    size, more = divmod(64, most + 1)
    out, at = [], 0
    for k in range(most + 1):
        n = size + (k < more)
        out.append((at, n))
        at += n
    return out


def _turned(prints: np.ndarray, first: int, n: int) -> np.ndarray:
    """Bits first .. first + n - 1 moved to the top, the others below in order."""
    up = np.uint64(64 - first - n)
    if up == 0 and first + n == 64:
        return prints.copy()
    return (prints << up) | (prints >> np.uint64(first + n)) if first + n < 64 else prints


def trie_links(values: np.ndarray, top: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of sorted distinct numbers with equal top bits that differ in at most `most` bits."""
    if len(values) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    head = values >> np.uint64(64 - top)
    starts = np.flatnonzero(np.concatenate(([True], head[1:] != head[:-1])))
    ends = np.append(starts[1:], len(values))
    real = ends - starts > 1
    starts, ends = starts[real], ends[real]
    work = [(top, starts[k : k + PAIRS], ends[k : k + PAIRS], starts[k : k + PAIRS], ends[k : k + PAIRS], np.zeros(len(starts[k : k + PAIRS]), np.int8)) for k in range(0, len(starts), PAIRS)]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while work:
        depth, a0, a1, b0, b1, off = work.pop()
        while depth < 64 and len(a0):
            bit = np.uint64(63 - depth)
            am, bm = _middle(values, a0, a1, bit), _middle(values, b0, b1, bit)
            same = (a0 == b0) & (a1 == b1)
            sides = [(a0, am, b0, bm, off, True), (am, a1, bm, b1, off, True), (a0, am, bm, b1, off + 1, True), (am, a1, b0, bm, off + 1, ~same)]
            parts = []
            for x0, x1, y0, y1, d, allowed in sides:
                good = (x1 > x0) & (y1 > y0) & (d <= most) & allowed
                good &= ~((x0 == y0) & (x1 == y1) & (x1 - x0 == 1))
                parts.append((x0[good], x1[good], y0[good], y1[good], d[good]))
            a0, a1, b0, b1, off = (np.concatenate(p) for p in zip(*parts))
            depth += 1
            if len(a0) > 2 * PAIRS:
                for k in range(PAIRS, len(a0), PAIRS):
                    part = slice(k, k + PAIRS)
                    work.append((depth, a0[part], a1[part], b0[part], b1[part], off[part]))
                a0, a1, b0, b1, off = a0[:PAIRS], a1[:PAIRS], b0[:PAIRS], b1[:PAIRS], off[:PAIRS]
        if len(a0):
            found.append((a0, b0))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _middle(values: np.ndarray, low: np.ndarray, high: np.ndarray, bit: np.uint64) -> np.ndarray:
    """In each range of numbers that agree above a bit, the first position with the bit set."""
    border = (values[low] >> bit | np.uint64(1)) << bit
    single = high - low == 1
    out = np.where(values[low] >= border, low, high)
    many = ~single
    if many.any():
        out[many] = np.clip(np.searchsorted(values, border[many]), low[many], high[many])
    return out


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """(member, root) for what links a-b join."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[up]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(x, r) for x in list(parent) if (r := root(x)) != x]


def links(prints: DataFrame, most: int) -> DataFrame:
    """Links (a > b) that join the distinct 64-bit numbers of column `print` that differ in at most `most` bits.

    Not every pair: a forest of each block's, from which all components follow. Tasks read the numbers sorted by band
    value and hold a block of about BLOCK of them, cut between values; numbers of one value are walked together.
    """
    cut = bands(most)

    def split(first: int, n: int):
        return F.shiftrightunsigned("print", first).bitwiseAND(F.lit((1 << n) - 1))

    dealt = prints.select("print", F.explode(F.array(*[F.struct(F.lit(k).alias("band"), split(*c).alias("value")) for k, c in enumerate(cut)])).alias("of"))
    dealt = dealt.select("print", F.col("of.band").alias("band"), F.col("of.value").cast("long").alias("value")).repartition("band", "value").sortWithinPartitions("band", "value")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fresh = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)))
                fresh += batch.num_rows
            if fresh >= BLOCK:
                numbers, kinds, values = (np.concatenate(c) for c in zip(*held))
                end = int(np.flatnonzero((kinds == kinds[-1]) & (values == values[-1]))[0])
                yield from walked(numbers[:end], kinds[:end])
                held, fresh = [(numbers[end:], kinds[end:], values[end:])], 0
        if held:
            numbers, kinds, _ = (np.concatenate(c) for c in zip(*held))
            yield from walked(numbers, kinds)

    def walked(numbers: np.ndarray, kinds: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in np.unique(kinds).tolist():
            first, n = cut[k]
            own = np.unique(numbers[kinds == k]).view(np.uint64)
            turned = _turned(own, first, n)
            order = np.argsort(turned)
            a, b = trie_links(turned[order], n, most)
            signed = own[order].view(np.int64)
            pairs = _forest(signed[a], signed[b])
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs)], ["a", "b"])

    return dealt.mapInArrow(join, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """For each node of links (a > b) but the smallest of its component: a, and that smallest as b."""
    edges, before = stored(edges), None
    while True:
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == before or not now["n"]:
            return edges
        before = now
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")))
        large = stored(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a")
        small = small.select("a", F.col("m").alias("b")).union(small.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a > b")
        edges = stored(small.distinct())


def near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, most: int = 2) -> DataFrame:
    """Each row's key, fingerprint (64-bit integer) and component_id.

    Words are split at ASCII white space, A-Z lower-cased; shingles are `shingle` words with repeats,
    or all words of a shorter text; a null or empty text has fingerprint 0 and is linked like any
    other. Fingerprints link at `most` or fewer differing bits. component_id is the smallest key of
    all rows that links reach, itself included, null only where all of them have null keys. A row for
    each row of df, repeated ones and null keys included; no other column is kept. The key must be
    an integer.
    """
    prints = stored(fingerprints(df.select(F.col(quoted(key)).cast("long").alias("key"), F.col(quoted(text)).alias("text")), "text", "print", shingle).select("key", "print"))
    single = stored(prints.groupBy("print").agg(F.min("key").alias("first")))
    joined = components(links(single.select("print"), most)).select(F.col("a").alias("print"), F.col("b").alias("root"))
    linked = single.join(joined, "print", "left").select("print", "first", F.coalesce("root", "print").alias("root"))
    smallest = stored(linked.join(joined.select("root").distinct(), "root", "left_semi").groupBy("root").agg(F.min("first").alias("smallest")))
    classes = stored(linked.join(smallest, "root", "left").select("print", F.coalesce("smallest", "first").alias("component_id")))
    total = prints.count()
    often = prints.groupBy("print").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * HOT > total).select("print")
    hot = classes.join(F.broadcast(often), "print").withColumnRenamed("component_id", "hot_id")
    out = prints.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "print", "left")
    rest = out.where("hot is null").select("key", "print").join(classes, "print")
    out = out.where("hot").select("key", "print", F.col("hot_id").alias("component_id")).union(rest.select("key", "print", "component_id"))
    return out.select(F.col("key").alias(key), F.col("print").alias("fingerprint"), "component_id")


#: Fingerprints of the similarity form: bits, tables, and the bits that two prints share in a table to be compared.
WIDE, TABLES, SHARED = 256, 64, 20


def wide_fingerprint(raw: bytes, shingle: int = 5) -> bytes:
    """A SimHash of WIDE bits of a text's distinct shingles; without words all bits are 0."""
    return wide_print(shingle_hashes(raw, shingle))


def shingle_hashes(raw: bytes, shingle: int = 5) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles; a shorter text is one shingle, a text without words has none."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    count = max(1, len(words) - shingle + 1)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[k : k + count] for k in range(min(shingle, len(words)))))), repeat(SEED)), np.uint64, count))


def wide_print(hashes: np.ndarray) -> bytes:
    if not len(hashes):
        return bytes(WIDE // 8)
    total = np.zeros(WIDE, np.int64)
    for k in range(0, len(hashes), 1 << 13):
        part = hashes[k : k + (1 << 13)]
        mixed = np.stack([_mixed(part, j) for j in range(WIDE // 64)], 1)
        total += np.unpackbits(mixed.view(np.uint8), axis=1).sum(0, dtype=np.uint16)
    return np.packbits(total * 2 > len(hashes)).tobytes()


def _mixed(x: np.ndarray, k: int) -> np.ndarray:
    """64 further bits of each hash: the finaliser of SplitMix64 after k + 1 of its steps."""
    x = x + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def budget(similarity: float) -> int:
    """Differing bits of WIDE within which nearly all texts of that Jaccard similarity stay: the mean and 1.7 deviations."""
    part = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(WIDE * part + 1.7 * np.sqrt(WIDE * part * (1 - part)))


def orders() -> list[np.ndarray]:
    """For each table an order of the bits; its first SHARED bits are the table's bucket."""
    draw = np.random.default_rng(11)
    return [draw.permutation(WIDE) for _ in range(TABLES)]


def trie_classes(bits: np.ndarray, top: int, most: int, label: np.ndarray | None = None) -> np.ndarray:
    """For rows of bits in sorted order, a row of the same class each: classes of rows that agree in the first `top` bits
    and are joined by at most `most` differing bits. label: classes known before, each row's the smallest row of its class.

    Neighbours are compared first. Then the trie is walked two nodes at a time; a pair of nodes is
    dropped beyond the budget and where all rows of both are in one class already, so that a large
    group of near copies is not compared pair by pair.
    """
    n = len(bits)
    label = np.arange(n) if label is None else label
    if n < 2:
        return label
    packed = np.ascontiguousarray(np.packbits(bits, axis=1)).view(np.uint64)
    heads = np.packbits(bits[:, :top], axis=1)
    borders = np.flatnonzero(np.concatenate(([True], (heads[1:] != heads[:-1]).any(1))))
    ends = np.append(borders[1:], n)
    bucket = np.repeat(np.arange(len(borders)), ends - borders)

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bitwise_count(packed[a[k : k + PAIRS]] ^ packed[b[k : k + PAIRS]]).sum(1, dtype=np.int64) for k in range(0, len(a), PAIRS)] or [np.zeros(0, np.int64)]) <= most

    for step in (1, 2, 3, 4):
        a = np.flatnonzero(bucket[:-step] == bucket[step:])
        a = a[near(a, a + step)]
        label = _joined(label, a, a + step)
    changes = _changes(label)
    real = ends - borders > 1
    borders, ends = borders[real], ends[real]
    work = [(top, borders[k : k + PAIRS], ends[k : k + PAIRS], borders[k : k + PAIRS], ends[k : k + PAIRS], np.zeros(len(borders[k : k + PAIRS]), np.int16)) for k in range(0, len(borders), PAIRS)]
    while work:
        depth, a0, a1, b0, b1, off = work.pop()
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(a0) and depth < bits.shape[1]:
            ones = np.concatenate(([0], np.cumsum(bits[:, depth], dtype=np.int64)))
            am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
            apart = a0 != b0
            sides = [(a0, am, b0, bm, off, True), (am, a1, bm, b1, off, True), (a0, am, bm, b1, off + 1, True), (am, a1, b0, bm, off + 1, apart)]
            parts = []
            for x0, x1, y0, y1, d, allowed in sides:
                good = (x1 > x0) & (y1 > y0) & (d <= most) & allowed
                parts.append(tuple(c[good] for c in (x0, x1, y0, y1, d)))
            a0, a1, b0, b1, off = (np.concatenate(c) for c in zip(*parts))
            done = (label[a0] == label[b0]) & (changes[a1 - 1] == changes[a0]) & (changes[b1 - 1] == changes[b0])
            single = (a1 - a0 == 1) & (b1 - b0 == 1) & ~done
            x, y = a0[single], b0[single]
            good = near(x, y)
            if good.any():
                found.append((x[good], y[good]))
            on = ~done & ~single
            a0, a1, b0, b1, off = a0[on], a1[on], b0[on], b1[on], off[on]
            depth += 1
            if found and depth % 16 == 0:
                label, found = _joined(label, *(np.concatenate(c) for c in zip(*found))), []
                changes = _changes(label)
            if len(a0) > 2 * PAIRS:
                for k in range(PAIRS, len(a0), PAIRS):
                    part = slice(k, k + PAIRS)
                    work.append((depth, a0[part], a1[part], b0[part], b1[part], off[part]))
                a0, a1, b0, b1, off = a0[:PAIRS], a1[:PAIRS], b0[:PAIRS], b1[:PAIRS], off[:PAIRS]
        if found:
            label = _joined(label, *(np.concatenate(c) for c in zip(*found)))
            changes = _changes(label)
    return label


def _changes(label: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the smallest row of its class) after rows a and b are joined."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return label
        a, b = a[differ], b[differ]
        label = label.copy()
        np.minimum.at(label, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while not np.array_equal(up := label[label], label):
            label = up


class LargeBucket:
    """A bucket that does not fit in a block: its parts are written to a file, and each part is compared with all before it.

    Classes known from earlier pairs of parts go into the next walk, so what is joined already is
    dropped there. They are those of one walk over the whole bucket, however it is cut into parts.
    """

    def __init__(self, order: np.ndarray, most: int) -> None:
        self.order, self.most = order, most
        self.file, self.sizes = tempfile.TemporaryFile(), []
        self.first, self.label = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, first: np.ndarray, raw: np.ndarray) -> None:
        for k in range(0, len(first), max(1, BLOCK // 2)):
            self._add(first[k : k + max(1, BLOCK // 2)], raw[k : k + max(1, BLOCK // 2)])

    def _add(self, first: np.ndarray, raw: np.ndarray) -> None:
        start = len(self.first)
        own = np.arange(start, start + len(first))
        self.first, self.label = np.concatenate([self.first, first]), np.concatenate([self.label, own])
        self._walk(raw, own)
        at = 0
        for size in self.sizes:
            self.file.seek(at * raw.shape[1])
            before = np.frombuffer(self.file.read(size * raw.shape[1]), np.uint8).reshape(size, -1)
            self._walk(np.concatenate([before, raw]), np.concatenate([np.arange(at, at + size), own]))
            at += size
        self.file.seek(0, 2)
        self.file.write(np.ascontiguousarray(raw).tobytes())
        self.sizes.append(len(first))

    def _walk(self, raw: np.ndarray, places: np.ndarray) -> None:
        bits = np.ascontiguousarray(np.unpackbits(raw, axis=1)[:, self.order])
        order = np.argsort(np.packbits(bits, axis=1).view(f"S{raw.shape[1]}").ravel(), kind="stable")
        places = places[order]
        _, heads, of = np.unique(self.label[places], return_index=True, return_inverse=True)
        found = trie_classes(bits[order], SHARED, self.most, heads[of])
        self.label = _joined(self.label, places, places[found])

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """(a > b) of the `first` of each print and of its class."""
        self.file.close()
        a, b = self.first, self.first[self.label]
        real = a != b
        return np.maximum(a, b)[real], np.minimum(a, b)[real]


def similar_links(prints: DataFrame, most: int) -> DataFrame:
    """Edges (a > b) that join the `first` of rows whose distinct `print` (WIDE bits, binary) share a bucket and differ in at most `most` bits.

    Rows are dealt out once for each table, sorted by bucket and read in blocks; a bucket larger than
    a block is compared part by part (LargeBucket), all its prints with each other.
    """
    turned = orders()
    width = WIDE // 8

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(SHARED)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                raw = np.frombuffer(b"".join(utf8_list(part.column(1))), np.uint8).reshape(-1, width)
                bits = np.unpackbits(raw, axis=1)
                values = np.concatenate([bits[:, o[:SHARED]] @ weights for o in turned])
                n = part.num_rows
                firsts = np.tile(part.column(0).to_numpy(zero_copy_only=False), TABLES)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(np.arange(TABLES), n), pa.int32()), pa.array(values, pa.int32()), pa.array(firsts, pa.int64()), pa.concat_arrays([part.column(1)] * TABLES),
                ], ["band", "value", "first", "print"])

    dealt = prints.select("first", "print").mapInArrow(deal, "band int, value int, first long, print binary")
    dealt = dealt.repartition("band", "value").sortWithinPartitions("band", "value")

    def edges(band: np.ndarray, first: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, first of its class) of classes of two or more."""
        out = []
        for k in np.unique(band):
            rows = np.flatnonzero(band == k)
            bits = np.ascontiguousarray(np.unpackbits(raw[rows], axis=1)[:, turned[k]])
            order = np.argsort(np.packbits(bits, axis=1).view(f"S{width}").ravel(), kind="stable")
            label = trie_classes(bits[order], SHARED, most)
            rows = rows[order]
            out.append((first[rows], first[rows[label]]))
        a, b = (np.concatenate(c) for c in zip(*out))
        real = a != b
        return np.maximum(a, b)[real], np.minimum(a, b)[real]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        large: LargeBucket | None = None
        bucket: tuple[int, int] | None = None

        def settle(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal large, bucket
            band, value, first, raw = (np.concatenate(c) for c in zip(*held))
            held.clear()
            found, begin = [], 0
            if large is not None:
                other = np.flatnonzero((band != bucket[0]) | (value != bucket[1]))
                begin = int(other[0]) if len(other) else len(band)
                large.add(first[:begin], raw[:begin])
                if begin < len(band) or last:
                    found.append(large.edges())
                    large = bucket = None
            if begin < len(band):
                end = len(band) if last else begin + int(np.flatnonzero((band[begin:] == band[-1]) & (value[begin:] == value[-1]))[0])
                if end > begin:
                    found.append(edges(band[begin:end], first[begin:end], raw[begin:end]))
                if len(band) - end >= BLOCK // 2:
                    bucket = (band[-1], value[-1])
                    large = LargeBucket(turned[band[-1]], most)
                    large.add(first[end:], raw[end:])
                elif end < len(band):
                    held.append((band[end:], value[end:], first[end:], raw[end:]))
            for a, b in found:
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        fresh = 0
        for batch in batches:
            if batch.num_rows:
                raw = np.frombuffer(b"".join(utf8_list(batch.column(3))), np.uint8).reshape(-1, width)
                held.append((*(batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)), raw))
                fresh += batch.num_rows
            if fresh >= BLOCK // 2:
                yield from settle(False)
                fresh = 0
        if held:
            yield from settle(True)
        elif large is not None:
            a, b = large.edges()
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return dealt.mapInArrow(join, "a long, b long").distinct()


#: Shingle hashes of a part of a group of candidates; two parts are held at a time.
PART = 1 << 19


class Verified:
    """Classes of texts joined by an exact Jaccard similarity of their shingles, in a group of candidates.

    Texts come part by part; parts are written to a file, and each is compared with all before it.
    A pair is compared if both hold one of their rarest shingles (prefixes long enough that no pair
    of the similarity is passed over) and they are not in one class already.
    """

    def __init__(self, similarity: float) -> None:
        self.similarity, self.file, self.parts = similarity, tempfile.TemporaryFile(), []
        self.first: list[int] = []
        self.parent: list[int] = []

    def root(self, x: int) -> int:
        while (up := self.parent[x]) != x:
            self.parent[x] = x = self.parent[up]
        return x

    def add(self, first: list[int], sets: list[np.ndarray]) -> None:
        own = range(len(self.first), len(self.first) + len(first))
        self.first += first
        self.parent += own
        self._walk([], [], list(own), sets)
        for at, begin, sizes in self.parts:
            self.file.seek(at)
            flat = np.frombuffer(self.file.read(8 * int(sizes.sum())), np.uint64)
            self._walk(list(range(begin, begin + len(sizes))), np.split(flat, np.cumsum(sizes)[:-1]), list(own), sets)
        at = self.file.seek(0, 2)
        self.file.write(np.concatenate(sets).tobytes())
        self.parts.append((at, own[0], np.array([len(x) for x in sets])))

    def _walk(self, old: list[int], old_sets: list[np.ndarray], new: list[int], new_sets: list[np.ndarray]) -> None:
        """Joins new texts with old ones, or with each other if there are no old ones."""
        sets, nodes, t = [*old_sets, *new_sets], [*old, *new], self.similarity
        values, of, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        place = np.empty(len(values), np.int64)
        place[np.argsort(counts, kind="stable")] = np.arange(len(values))
        single = int((counts == 1).sum())
        ranks = np.split(place[of], np.cumsum([len(x) for x in sets])[:-1])
        index: dict[int, dict[int, list[int]]] = {}
        for k, x in enumerate(nodes):
            own = np.sort(ranks[k])
            n = len(own)
            prefix = own[: n - int(np.ceil(t * n - 1e-9)) + 1] if n else own
            prefix = prefix[prefix >= single].tolist()
            if not old or k >= len(old):
                tried: set[int] = set()
                for r in prefix:
                    held = index.get(r)
                    if not held:
                        continue
                    for root in list(held):
                        if (now := self.root(root)) != root:
                            held.setdefault(now, []).extend(held.pop(root))
                    for root in list(held):
                        for j in held[root]:
                            if self.root(root) == self.root(x):
                                break
                            m = len(sets[j])
                            if j not in tried and min(n, m) >= t * max(n, m) - 1e-9:
                                tried.add(j)
                                both = len(np.intersect1d(sets[j], sets[k], assume_unique=True))
                                if both >= t * (n + m - both) - 1e-9:
                                    a, b = self.root(x), self.root(root)
                                    self.parent[max(a, b)] = min(a, b)
            if not old or k < len(old):
                for r in prefix:
                    index.setdefault(r, {}).setdefault(self.root(x), []).append(k)

    def edges(self) -> list[tuple[int, int]]:
        self.file.close()
        pairs = ((self.first[k], self.first[self.root(k)]) for k in range(len(self.first)))
        return [(max(a, b), min(a, b)) for a, b in pairs if a != b]


def verified_links(texts: DataFrame, similarity: float) -> DataFrame:
    """Edges (a > b) between the `first` of rows with one `root` whose `hashes` (sorted, binary) have that Jaccard similarity.

    Not every pair: a forest, from which all components follow. The texts of a root are compared in one task, in parts.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: Verified | None = None
        root, held = None, 0
        first: list[int] = []
        sets: list[np.ndarray] = []

        def settle() -> None:
            nonlocal held
            if first:
                group.add(list(first), list(sets))
            first.clear(), sets.clear()
            held = 0

        def closed() -> Iterator[pa.RecordBatch]:
            settle()
            if pairs := group.edges():
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs)], ["a", "b"])

        for batch in batches:
            for r, f, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if group is None or r != root:
                    if group is not None:
                        yield from closed()
                    root, group = r, Verified(similarity)
                first.append(f)
                sets.append(np.frombuffer(raw, np.uint64))
                held += len(sets[-1]) + 1
                if held >= PART:
                    settle()
        if group is not None:
            yield from closed()

    return texts.select("root", "first", "hashes").repartition("root").sortWithinPartitions("root").mapInArrow(check, "a long, b long")


def similar_copies(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Each row's key and component_id, the smallest key of all rows that links of the similarity reach.

    Texts link where the exact Jaccard similarity of their distinct shingles is `similarity` or more. Compared are texts
    of one group of candidates: of what SimHashes (WIDE bits) join that share a bucket in one of TABLES tables and
    differ in at most budget(similarity) bits. Of pairs of similarity 0.8 about nine in ten are candidates, of 0.85
    nearly all. A table compares a print with one in 2 ** SHARED of the others.
    Null and empty texts are equal texts. Rows with a null key get a null component_id and link nothing; repeated keys are one node. The key must be an integer.
    """
    bounded_batches(df.sparkSession)

    @F.arrow_udf("struct<print:binary,digest:binary>")
    def run(texts: pa.Array) -> pa.Array:
        sets = [shingle_hashes(raw, shingle) for raw in utf8_list(texts)]
        return pa.StructArray.from_arrays([pa.array(map(wide_print, sets), pa.binary()), pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary())], ["print", "digest"])

    @F.arrow_udf("struct<hashes:binary,digest:binary>")
    def shingles(texts: pa.Array) -> pa.Array:
        sets = [shingle_hashes(raw, shingle).tobytes() for raw in utf8_list(texts)]
        return pa.StructArray.from_arrays([pa.array(sets, pa.binary()), pa.array(map(xxhash.xxh3_128_digest, sets), pa.binary())], ["hashes", "digest"])

    keyed = df.select(F.col(quoted(key)).cast("long").alias("key"), F.col(quoted(text)).cast("string").alias("text"))
    prints = stored(keyed.select("key", run("text").alias("of")).select("key", "of.print", "of.digest"))
    single = stored(prints.where("key is not null").groupBy("print", "digest").agg(F.min("key").alias("first")))
    copies = prints.join(single, ["print", "digest"]).where("key > first").select(F.col("key").alias("a"), F.col("first").alias("b")).distinct()
    heads = stored(single.groupBy("print").agg(F.min("first").alias("head")))
    joined = components(similar_links(heads.select(F.col("head").alias("first"), "print"), budget(similarity)))
    grouped = single.join(heads, "print").join(joined, F.col("head") == F.col("a"), "left").select("first", "digest", F.coalesce("b", "head").alias("root"))
    grouped = stored(grouped)
    several = grouped.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("root")
    candidates = stored(grouped.join(several, "root"))
    found = keyed.join(candidates.withColumnRenamed("digest", "wanted"), F.col("key") == F.col("first")).select("root", "first", "wanted", shingles("text").alias("of"))
    links = verified_links(found.where("wanted = of.digest").select("root", "first", "of.hashes"), similarity)
    joined = components(links.union(copies).distinct())
    return prints.select("key").join(joined, F.col("key") == F.col("a"), "left").select(F.col("key").alias(key), F.coalesce("b", "key").alias("component_id"))


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """df with one row of each group of near copies, as similar_copies finds them: the one with the smallest key.

    If rows share this key, one of each of their different texts stays, as the key does not tell them apart. Rows with
    null keys stay, as no result names them.
    """
    groups = stored(similar_copies(df, key, text, shingle, similarity))
    mark = free_name(df, "gone")
    gone = groups.where(F.col(key) != F.col("component_id")).select(F.col(key).alias(mark)).distinct()
    kept = df.join(gone, F.col(quoted(key)).cast("long") == F.col(mark), "left_anti")
    if groups.where(f"`{key}` is not null").groupBy(key).count().where("count > 1").limit(1).count():
        digest = free_name(df, "text_digest")
        named = kept.where(F.col(quoted(key)).isNotNull()).withColumn(digest, F.sha2(F.col(quoted(text)).cast("string"), 256)).dropDuplicates([key, digest]).drop(digest)
        kept = named.union(kept.where(F.col(quoted(key)).isNull()))
    return kept
