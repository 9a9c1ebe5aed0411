"""What the scanners share: span columns and the digest of spans that the queries return."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spans as a column: kind, code points from start to end (exclusive), score, and whether a base rule found it.
SPANS = "array<struct<kind:string,start:int,end:int,score:double,base:boolean>>"
_FIELDS = [pa.field("kind", pa.string()), pa.field("start", pa.int32()), pa.field("end", pa.int32()), pa.field("score", pa.float64()), pa.field("base", pa.bool_())]


def span_array(rows: list[tuple[str, int, int, float, bool]], sizes: list[int]) -> pa.Array:
    """Rows of spans; sizes says how many belong to each text."""
    columns = list(zip(*rows)) if rows else [[]] * len(_FIELDS)
    flat = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FIELDS)], fields=_FIELDS)
    at = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), flat)


def count_of(spans: str, kind: str) -> Column:
    """How many base spans of a kind."""
    return F.size(F.filter(F.col(spans), lambda s: s["base"] & (s["kind"] == kind))).cast("long")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order the column has."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scores(spans: str) -> Column:
    """The scores of the spans, comma-joined, in the order the column has."""
    return F.array_join(F.transform(F.col(spans), lambda s: F.format_string("%.4f", s["score"])), ",")


def base_only(spans: str) -> Column:
    return F.filter(F.col(spans), lambda s: s["base"])


class Covered:
    """The part of a text that spans cover, as intervals apart from each other; asking and adding take logarithmic time, but for moves in a list."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def meets(self, start: int, end: int) -> bool:
        """Whether a span that is not empty shares a place with one added before."""
        k = bisect_left(self.starts, end)
        return k > 0 and self.ends[k - 1] > start

    def add(self, start: int, end: int) -> None:
        i, j = bisect_left(self.ends, start), bisect_right(self.starts, end)
        if i < j:
            start, end = min(start, self.starts[i]), max(end, self.ends[j - 1])
        self.starts[i:j], self.ends[i:j] = [start], [end]


class Outermost:
    """Spans of which none lies in another, by start; both ends rise."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def holds(self, start: int, end: int) -> bool:
        """Whether a span lies in one added before, or is one of them."""
        k = bisect_right(self.starts, start)
        return k > 0 and self.ends[k - 1] >= end

    def add(self, start: int, end: int) -> None:
        """Add a span that none holds; those that it holds go."""
        i = bisect_left(self.starts, start)
        j = bisect_right(self.ends, end, i)
        self.starts[i:j], self.ends[i:j] = [start], [end]
