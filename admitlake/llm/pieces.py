"""SentencePiece encoding and decoding of merge-type (BPE) models with a prefix table.

For every prefix of a segment the encoding of that prefix ends in exactly one token. An
automaton over the vocabulary proposes the tokens that end at a position, longest first; the
first one that is compatible with the stored last token of the prefix before it is the answer.
Two neighbours are compatible if undoing their merges, latest first, never meets a merge across
their border that would have come earlier. The ids are then read off the table from the end.

Segments are what no merge can cross: a space opens a new one, and so does a character outside
the vocabulary, which is spelled in byte tokens. Runs of spaces have their own pieces, all of one
score, and are merged last; they are worked out by direct merging and remembered.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterable
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, list_array, quoted, with_columns

SPACE = "▁"
#: Segments whose ids a worker remembers in each of two generations; the older one goes when the newer is full.
REMEMBERED = 150_000
#: Neighbour pairs whose compatibility a worker remembers.
REMEMBERED_PAIRS = 300_000
_NEVER = 1 << 60


def merged(symbols: list[str], order: dict[str, tuple[float, int]]) -> list[str]:
    """Direct merging: always the best-scored neighbours, of equals the leftmost. The definition, for short inputs."""
    left, right, alive = list(range(-1, len(symbols) - 1)), list(range(1, len(symbols) + 1)), list(symbols)
    heap: list[tuple[float, int, int, str]] = []

    def offer(i: int) -> None:
        j = right[i]
        if i >= 0 and j < len(alive):
            both = alive[i] + alive[j]
            if both in order:
                heapq.heappush(heap, (order[both][0], i, j, both))

    for i in range(len(symbols) - 1):
        offer(i)
    while heap:
        _, i, j, both = heapq.heappop(heap)
        if alive[i] == "" or alive[j] == "" or alive[i] + alive[j] != both or right[i] != j:
            continue
        alive[i], alive[j] = both, ""
        right[i] = right[j]
        if right[j] < len(alive):
            left[right[j]] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    return [s for s in alive if s]


def read_tables(model: bytes) -> dict:
    """What workers need of a model: pieces, the rank of each merge, how each piece was made, neighbour merges."""
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    order: dict[str, tuple[float, int]] = {}
    pieces: list[str] = []
    octets: dict[int, int] = {}
    silent: set[int] = set()
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        pieces.append(piece)
        if sp.is_byte(i):
            octets[int(piece[3:5], 16)] = i
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            silent.add(i)
        else:
            order[piece] = (-sp.get_score(i), i)
    if len(octets) != 256:
        raise ValueError("the model has no byte pieces for all 256 bytes")
    if any("\n" in p for p in order):
        raise ValueError("the model has pieces with line feeds")
    if any(SPACE in p.lstrip(SPACE) for p in order):
        raise ValueError("the model has pieces with a space after other characters")
    runs = {p: v for p, v in order.items() if len(p) > 1 and not p.strip(SPACE)}
    plain = {p: v for p, v in order.items() if p not in runs}
    if runs and min(v[0] for v in runs.values()) <= max(v[0] for p, v in plain.items() if len(p) > 1):
        raise ValueError("pieces of spaces only must score below all others")
    ranks = {p: k for k, (_, p) in enumerate(sorted((v[0], p) for p, v in plain.items() if len(p) > 1))}
    size = len(pieces)
    rank, first, second = [-1] * size, [-1] * size, [-1] * size
    pair: dict[int, int] = {}
    found: list[str] = []
    for p, (_, i) in plain.items():
        if len(p) == 1:
            found.append(p)
            continue
        halves = [(plain[p[:k]][1], plain[p[k:]][1]) for k in range(1, len(p)) if p[:k] in plain and p[k:] in plain]
        for a, b in halves:
            pair[a << 20 | b] = ranks[p]
        ends = _last_merge(p, ranks)
        if ends is not None:
            rank[i], first[i], second[i] = ranks[p], plain[ends[0]][1], plain[ends[1]][1]
            found.append(p)
    return {"pieces": pieces, "octets": octets, "silent": silent, "runs": runs, "rank": rank, "first": first, "second": second, "pair": pair, "found": {p: plain[p][1] for p in found}, "space": order[SPACE][1], "mark": hashlib.sha256(model).hexdigest()}


def _last_merge(piece: str, ranks: dict[str, int]) -> tuple[str, str] | None:
    """The two pieces that piece is made of in the end, or None if merging its characters does not lead to it."""
    parts = list(piece)
    while len(parts) > 2:
        best = min(((ranks.get(parts[k] + parts[k + 1], _NEVER), k) for k in range(len(parts) - 1)))
        if best[0] == _NEVER:
            return None
        k = best[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


class Codec:
    """Encodes and decodes with one model's tables; remembers segments up to a bound."""

    def __init__(self, tables: dict, remembered: int = REMEMBERED) -> None:
        self.__dict__.update({k: tables[k] for k in ("pieces", "octets", "runs", "rank", "first", "second", "pair", "found", "space")})
        self.automaton = ahocorasick.Automaton()
        for p, i in self.found.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.known = {p for p in self.found if len(p) == 1}
        self.remembered = remembered
        self.seen: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}
        inner = {b for p in self.found for a, b in zip(p, p[1:]) if re.match(r"[^\W\d_]", a)}
        outer = "".join(sorted(c for c in self.known - inner if not c.isalnum() and c != SPACE))
        self.border = re.compile(f"[^\\W\\d_][{re.escape(outer)}]").search if outer else lambda _: None
        self._line_feed = array("i", [self.octets[10]]).tobytes()
        self.pairs: dict[int, bool] = {}
        self.run_ids: dict[int, list[int]] = {}
        self.shown = [p.replace(SPACE, " ") for p in self.pieces]
        for octet, i in self.octets.items():
            self.shown[i] = chr(octet) if octet < 128 else ""
        self.high = {i: octet for octet, i in self.octets.items() if octet > 127}
        self.silent = tables["silent"]
        for i in self.silent:
            self.shown[i] = " ⁇ " if self.pieces[i] == "<unk>" else ""

    def compatible(self, a: int, b: int) -> bool:
        """Whether the encoding of the texts of a and b, put together, is a, b."""
        key = a << 20 | b
        rank, bound, answer = self.rank, _NEVER, True
        while True:
            across = self.pair.get(a << 20 | b)
            if across is not None and across < bound:
                answer = False
                break
            if rank[a] > rank[b]:
                bound, a = rank[a], self.second[a]
            elif rank[b] >= 0:
                bound, b = rank[b] + 1, self.first[b]
            else:
                break
        if len(self.pairs) >= REMEMBERED_PAIRS:
            self.pairs.clear()
        self.pairs[key] = answer
        return answer

    def _known_segment(self, s: str) -> list[int]:
        last = [-1] * len(s)
        size = [0] * len(s)
        tested = self.pairs.get
        for end, (token, n) in self.automaton.iter(s):
            if last[end] >= 0:
                continue
            before = end - n
            if before >= 0:
                a = last[before]
                fits = tested(a << 20 | token)
                if fits is None:
                    fits = self.compatible(a, token)
                if not fits:
                    continue
            last[end] = token
            size[end] = n
        ids, at = [], len(s) - 1
        while at >= 0:
            ids.append(last[at])
            at -= size[at]
        ids.reverse()
        return ids

    def segment(self, s: str) -> list[int]:
        """The ids of a text that has no space but perhaps a first one."""
        if self.known.issuperset(s):
            return self._known_segment(s) if s else []
        ids: list[int] = []
        start = 0
        for k, c in enumerate(s):
            if c not in self.known:
                ids += self._known_segment(s[start:k]) if k > start else []
                ids += [self.octets[o] for o in c.encode("utf-8", "surrogatepass")]
                start = k + 1
        return ids + (self._known_segment(s[start:]) if start < len(s) else [])

    def run(self, n: int) -> list[int]:
        """The ids of n spaces with nothing to merge with."""
        ids = self.run_ids.get(n)
        if ids is None:
            ids = [self.space if p == SPACE else self.runs[p][1] for p in merged([SPACE] * n, self.runs)]
            if len(self.run_ids) < 1000:
                self.run_ids[n] = ids
        return ids

    def remember(self, unit: str) -> bytes:
        """unit: what stands between two spaces, or, with a line feed in front, after one."""
        ids = self.older.get(unit)
        if ids is None:
            if unit[0] == "\n":
                ids = self._line_feed + (self._bare(unit[1:]) if len(unit) > 1 else b"")
            elif cut := self.border(unit):
                head = unit[: cut.end() - 1]
                ids = (self.seen.get(head) or self.remember(head)) + self._bare(unit[cut.end() - 1 :])
            else:
                ids = array("i", self.segment(SPACE + unit)).tobytes()
        if len(self.seen) >= self.remembered:
            self.older, self.seen = self.seen, {}
        self.seen[unit] = ids
        return ids

    def _bare(self, s: str) -> bytes:
        """The ids of what no space opens."""
        ids = self.bare.get(s)
        if ids is None:
            if (cut := self.border(s)) and cut.end() > 1:
                ids = self._bare(s[: cut.end() - 1]) + self._bare(s[cut.end() - 1 :])
            else:
                ids = array("i", self.segment(s)).tobytes()
            if len(self.bare) >= self.remembered // 4:
                self.bare.clear()
            self.bare[s] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """All ids of a text, as little-endian 32-bit integers."""
        if not text:
            return b""
        if SPACE in text:
            text = text.replace(SPACE, " ")
        units = text.replace("\n", " \n").split(" ")
        found = list(map(self.seen.get, units))
        if None in found:
            for k, ids in enumerate(found):
                if ids is None:
                    found[k] = (unit := units[k]) and (self.seen.get(unit) or self.remember(unit))
        if "" not in units:
            return b"".join(found)
        out, spaces = [], 0
        for unit, ids in zip(units, found):
            if not unit:
                spaces += 1
                continue
            if spaces:
                if unit[0] != "\n" and ids[:4] == self._lone:
                    spaces, ids = spaces + 1, ids[4:]
                out.append(array("i", self.run(spaces)).tobytes())
                spaces = 0
            out.append(ids)
        if spaces:
            out.append(array("i", self.run(spaces)).tobytes())
        return b"".join(out)

    @property
    def _lone(self) -> bytes:
        return int(self.space).to_bytes(4, "little")

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, byte tokens put together to characters, the space that opens a text dropped."""
        if not ids:
            return ""
        if self.high.keys().isdisjoint(ids):
            text = "".join(map(self.shown.__getitem__, ids))
        else:
            parts: list[str] = []
            octets = bytearray()
            for i in ids:
                if i in self.high:
                    octets.append(self.high[i])
                    continue
                if octets:
                    parts.append(_characters(bytes(octets)))
                    octets.clear()
                parts.append(self.shown[i])
            text = "".join(parts) + (_characters(bytes(octets)) if octets else "")
        head = next((i for i in ids if i not in self.silent or self.shown[i]), ids[0])
        return text[1:] if self.pieces[head].startswith(SPACE) else text


def _characters(octets: bytes) -> str:
    """UTF-8 of octets, one replacement character for each octet that fits nowhere."""
    out, at = [], 0
    while at < len(octets):
        lead = octets[at]
        n = 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 1
        try:
            out.append(octets[at : at + n].decode("utf-8"))
            at += n
        except UnicodeDecodeError:
            out.append("�")
            at += 1
    return "".join(out)


_codecs: dict[tuple[str, int], Codec] = {}


def codec(tables: dict, remembered: int = REMEMBERED) -> Codec:
    """The worker's codec for these tables, kept from task to task."""
    key = (tables["mark"], remembered)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(tables, remembered)
    return _codecs[key]


def _ids(texts: Iterable[str | None], made: Codec) -> tuple[np.ndarray, list[int]]:
    packed = [made.encode(t or "") for t in texts]
    return np.frombuffer(b"".join(packed), "<i4"), [len(p) // 4 for p in packed]


def encode_pieces(df: DataFrame, model: str | Path, text: str = "text", ids: str = "piece_ids", decoded: str = "piece_text", remembered: int = REMEMBERED) -> DataFrame:
    """df with the ids of each whole text and the text that these ids decode to.

    model: path of a merge-type SentencePiece model with byte fallback, identity normalisation and
    no removal of extra white space; it is read on the driver and its tables (a few MB, fixed by the
    vocabulary) are broadcast. No begin or end ids. A null or empty text gives no ids and an empty
    decoded text. Rows stay as they are, repeated ones included; old columns named like the new
    ones give way. One pass without a shuffle. remembered: segments whose ids a worker keeps in each
    of two generations; fewer take less memory and more time.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(read_tables(Path(model).read_bytes()))

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def run(texts: pa.Array) -> pa.Array:
        made = codec(shared.value, remembered)
        values, sizes = _ids(texts.to_pylist(), made)
        at, back = 0, []
        for n in sizes:
            back.append(made.decode(values[at : at + n].tolist()))
            at += n
        return pa.StructArray.from_arrays([list_array(values, sizes, pa.int32()), pa.array(back, pa.string())], ["ids", "decoded"])

    both = run(F.col(quoted(text)).cast("string"))
    return with_columns(df, {ids: both["ids"], decoded: both["decoded"]})

