"""AVI motion-JPEG columns: bytes to films and back, intra-frame decoding, shot detection, timed clips.

A payload is cut into frames of 24 x 24 samples. Each frame is a lossless JPEG (SOF3, one 8-bit
component, left prediction), each film a RIFF AVI file with an idx1 index. The Huffman table
gives difference category s a code of 9 - s bits; with its s extra bits every sample then takes
9 bits, so a whole batch of frames is packed and unpacked with array operations. Lossless frames
with other sizes, predictors or tables decode too, sample by sample, and so do baseline frames:
Huffman codes, dequantisation and the inverse cosine transform, of which the luminance is kept.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, quoted, utf8_list, with_columns

SIDE = 24
FRAME = SIDE * SIDE
FILL = 255
RATE = 24
#: Shots: histogram bins, differences on either side that set the local level, deviations above it, least difference.
BINS, NEAR, DEVIATIONS, LEAST = 32, 8, 2.0, 0.12

_BITS = 9
_CODED = FRAME * _BITS // 8
_LENGTHS, _VALUES = [1] * 9 + [0] * 7, list(range(8, -1, -1))


def _canonical(lengths: list[int], values: list[int]) -> dict[tuple[int, int], int]:
    """(code length, code) to value, as the format derives codes from their counts by length."""
    out, code, k = {}, 0, 0
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            out[n, code] = values[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _tables() -> tuple[np.ndarray, np.ndarray]:
    to_code, to_difference = np.zeros(511, np.uint16), np.zeros(512, np.int16)
    codes = {v: (n, c) for (n, c), v in _canonical(_LENGTHS, _VALUES).items()}
    for d in range(-255, 256):
        s = abs(d).bit_length()
        n, c = codes[s]
        assert n + s == _BITS
        word = c << s | (d if d > 0 else d + (1 << s) - 1 if d else 0)
        to_code[d + 255], to_difference[word] = word, d
    return to_code, to_difference


_TO_CODE, _TO_DIFFERENCE = _tables()
_HEAD = (
    b"\xff\xd8"
    + b"\xff\xc3" + struct.pack(">HBHHBBBB", 11, 8, SIDE, SIDE, 1, 1, 0x11, 0)
    + b"\xff\xc4" + struct.pack(">HB", 28, 0) + bytes(_LENGTHS) + bytes(_VALUES)
    + b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 1, 0, 0)
)
_END = b"\xff\xd9"
_RESTARTS = re.compile(rb"\xff[\xd0-\xd7]")


def padded(payload: bytes) -> bytes:
    """payload filled up to a positive multiple of a frame."""
    return payload + bytes([FILL]) * (max(FRAME, -(-len(payload) // FRAME) * FRAME) - len(payload))


def _coded(samples: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The entropy-coded segments of frames of samples, put together, and where each starts."""
    x = samples.astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    c = _TO_CODE[d.reshape(-1, 8) + 255]
    out = np.empty((len(c), _BITS), np.uint8)
    out[:, 0] = c[:, 0] >> 1
    for k in range(1, 8):
        out[:, k] = (c[:, k - 1] << (8 - k)) | (c[:, k] >> (k + 1))
    out[:, 8] = c[:, 7]
    flat = out.reshape(-1)
    full = np.flatnonzero(flat == 255)
    sizes = np.full(len(x), _CODED, np.int64) + np.bincount(full // _CODED, minlength=len(x))
    return np.insert(flat, full + 1, 0).tobytes(), np.concatenate(([0], np.cumsum(sizes)))


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def _film(frames: list[bytes]) -> bytes:
    largest = max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // RATE, largest * RATE, 0, 0x10, len(frames), 0, 1, largest, SIDE, SIDE, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, RATE, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    image = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", image)))
    body = b"".join([b"00dc" + struct.pack("<I", len(f)) + f + b"\0" * (len(f) & 1) for f in frames])
    index = np.empty((len(frames), 4), "<u4")
    sizes = np.fromiter(map(len, frames), np.int64, len(frames))
    index[:, 0], index[:, 1], index[:, 3] = int.from_bytes(b"00dc", "little"), 0x10, sizes
    index[:, 2] = 4 + np.concatenate(([0], np.cumsum(8 + sizes + (sizes & 1))[:-1]))
    return _chunk(b"RIFF", b"AVI " + header + _chunk(b"LIST", b"movi" + body) + _chunk(b"idx1", index.tobytes()))


def films(payloads: list[bytes]) -> list[bytes]:
    """An AVI file for each payload, which is filled up to whole frames first."""
    if not payloads:
        return []
    filled = [padded(p) for p in payloads]
    samples = np.frombuffer(b"".join(filled), np.uint8).reshape(-1, SIDE, SIDE)
    coded, at = _coded(samples)
    starts = at.tolist()
    frames = [_HEAD + coded[a:b] + _END for a, b in zip(starts, starts[1:])]
    out, k = [], 0
    for p in filled:
        n = len(p) // FRAME
        out.append(_film(frames[k : k + n]))
        k += n
    return out


@dataclass(frozen=True)
class Frame:
    """A JPEG frame as its headers describe it."""

    width: int
    height: int
    predictor: int
    codes: tuple[tuple[tuple[int, int], int], ...]
    start: int


def read_headers(jpeg: bytes) -> Frame:
    """Headers up to the entropy-coded segment, which begins at start."""
    at, size, codes = 2, None, None
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    while at + 4 <= len(jpeg):
        mark, n = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + n]
        if mark == 0xC3:
            bits, height, width, parts = struct.unpack_from(">BHHB", body)
            if bits != 8 or parts != 1:
                raise ValueError("only frames of one 8-bit component")
            size = width, height
        elif mark == 0xC4:
            codes = tuple(_canonical(list(body[1:17]), list(body[17:])).items())
        elif mark == 0xDA:
            if size is None or codes is None:
                raise ValueError("a scan without its headers")
            return Frame(*size, body[3], codes, at + 2 + n)
        at += 2 + n
    raise ValueError("a frame without a scan")


def _stepwise(head: Frame, coded: bytes) -> np.ndarray:
    """The samples of a frame with any table and predictor."""
    codes, raw = dict(head.codes), coded.replace(b"\xff\x00", b"\xff")
    bits, at = int.from_bytes(raw, "big"), len(raw) * 8

    def take(n: int) -> int:
        nonlocal at
        at -= n
        return bits >> at & (1 << n) - 1

    x = np.zeros((head.height, head.width), np.int64)
    for r in range(head.height):
        for c in range(head.width):
            n = code = 0
            while (n, code) not in codes:
                n, code = n + 1, code << 1 | take(1)
                if n > 16:
                    raise ValueError("no such code")
            s = codes[n, code]
            d = take(s) if s else 0
            d -= 0 if not s or d >> (s - 1) else (1 << s) - 1
            if not r:
                p = x[r, c - 1] if c else 128
            elif not c:
                p = x[r - 1, c]
            else:
                a, b, ab = int(x[r, c - 1]), int(x[r - 1, c]), int(x[r - 1, c - 1])
                p = (0, a, b, ab, a + b - ab, a + (b - ab >> 1), b + (a - ab >> 1), a + b >> 1)[head.predictor]
            x[r, c] = (p + d) & 0xFFFF
    return x.astype(np.uint8)


#: Places of a block's coefficients in the order of the file: diagonal by diagonal, up and down by turns.
_ZIGZAG = [r * 8 + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))]
_COSINES = np.array([[np.sqrt((1 if u else 0.5) / 4) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


class _Bits:
    """Bits of an entropy-coded segment, from the top."""

    def __init__(self, raw: bytes) -> None:
        self.raw, self.at, self.held, self.n = raw.replace(b"\xff\x00", b"\xff"), 0, 0, 0

    def take(self, n: int) -> int:
        while self.n < n:
            if self.at >= len(self.raw):
                raise ValueError("a frame that ends too soon")
            self.held, self.n, self.at = (self.held << 8 | self.raw[self.at]) & 0xFFFFFFFF, self.n + 8, self.at + 1
        self.n -= n
        return self.held >> self.n & (1 << n) - 1

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in codes:
                return codes[n, code]
        raise ValueError("no such code")

    def number(self, size: int) -> int:
        x = self.take(size) if size else 0
        return x if not size or x >> (size - 1) else x - (1 << size) + 1


def _baseline(jpeg: bytes) -> np.ndarray:
    """The luminance samples of a baseline frame with its own Huffman tables."""
    tables: dict[int, dict] = {}
    quantisers: dict[int, np.ndarray] = {}
    parts: list[tuple[int, int, int, int]] = []
    width = height = every = start = 0
    at, scan = 2, {}
    while not start:
        if at + 4 > len(jpeg):
            raise ValueError("a frame without a scan")
        mark, n = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body, k = jpeg[at + 4 : at + 2 + n], 0
        if mark == 0xDB:
            while k < len(body):
                wide = body[k] >> 4
                quantisers[body[k] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, k + 1).astype(np.int64)
                k += 129 if wide else 65
        elif mark == 0xC4:
            while k < len(body):
                lengths = list(body[k + 1 : k + 17])
                tables[body[k]] = _canonical(lengths, list(body[k + 17 : k + 17 + sum(lengths)]))
                k += 17 + sum(lengths)
        elif mark in (0xC0, 0xC1):
            bits, height, width, count = struct.unpack_from(">BHHB", body)
            if bits != 8 or not width or not height:
                raise ValueError("only 8-bit frames of known size")
            parts = [(body[6 + 3 * j], body[7 + 3 * j] >> 4, body[7 + 3 * j] & 15, body[8 + 3 * j]) for j in range(count)]
        elif mark == 0xDD:
            every = struct.unpack(">H", body[:2])[0]
        elif mark == 0xDA:
            scan = {body[1 + 2 * j]: (tables.get(body[2 + 2 * j] >> 4), tables.get(16 + (body[2 + 2 * j] & 15))) for j in range(body[0])}
            start = at + 2 + n
        at += 2 + n
    if not parts or set(scan) != {p[0] for p in parts} or any(t is None for pair in scan.values() for t in pair) or any(p[3] not in quantisers for p in parts):
        raise ValueError("a scan without its headers")
    if len(parts) == 1:
        parts = [(parts[0][0], 1, 1, parts[0][3])]
    across, down = max(p[1] for p in parts), max(p[2] for p in parts)
    columns, rows = -(-width // (8 * across)), -(-height // (8 * down))
    first = np.zeros((rows * parts[0][2], columns * parts[0][1], 64), np.int64)
    segments = _RESTARTS.split(jpeg[start : jpeg.rindex(_END)])
    reader, last, units = _Bits(segments[0]), [0] * len(parts), 0
    for y in range(rows):
        for x in range(columns):
            if every and units and units % every == 0:
                if units // every >= len(segments):
                    raise ValueError("a frame that ends too soon")
                reader, last = _Bits(segments[units // every]), [0] * len(parts)
            units += 1
            for j, (name, h, v, _) in enumerate(parts):
                for block in range(h * v):
                    found = _block(reader, *scan[name])
                    last[j] = found[0] = found[0] + last[j]
                    if not j:
                        first[y * v + block // h, x * h + block % h] = found
    spread = np.zeros_like(first)
    spread[:, :, _ZIGZAG] = first * quantisers[parts[0][3]]
    samples = np.einsum("ux,yzuv,vw->yxzw", _COSINES, spread.reshape(*first.shape[:2], 8, 8), _COSINES) + 128
    plane = np.clip(np.rint(samples), 0, 255).astype(np.uint8).reshape(first.shape[0] * 8, -1)
    return plane[: -(-height * parts[0][2] // down), : -(-width * parts[0][1] // across)]


def _block(reader: _Bits, direct: dict, others: dict) -> list[int]:
    """A block's coefficients in the order of the file; the first as a difference."""
    out, k = [0] * 64, 1
    out[0] = reader.number(reader.symbol(direct))
    while k < 64:
        zeros, size = divmod(reader.symbol(others), 16)
        if not size:
            if zeros != 15:
                break
            k += 16
            continue
        k += zeros
        if k > 63:
            raise ValueError("a block that is too long")
        out[k] = reader.number(size)
        k += 1
    return out


def decode_frame(jpeg: bytes) -> np.ndarray:
    """The samples of a lossless or baseline frame; a ValueError for others."""
    if jpeg[:2] != b"\xff\xd8" or _END not in jpeg:
        raise ValueError("not a JPEG frame")
    at = 2
    while at + 4 <= len(jpeg) and jpeg[at] == 255 and jpeg[at + 1] != 0xDA:
        if jpeg[at + 1] in (0xC0, 0xC1):
            return _baseline(jpeg)
        if jpeg[at + 1] == 0xC3:
            head = read_headers(jpeg)
            return _stepwise(head, jpeg[head.start : jpeg.rindex(_END)])
        at += 2 + struct.unpack_from(">H", jpeg, at + 2)[0]
    raise ValueError("neither a lossless nor a baseline frame")


def _together(coded: list[bytes]) -> np.ndarray:
    """The samples of many frames with this module's table."""
    raw = np.frombuffer(b"".join(coded), np.uint8)
    stuffed = np.zeros(len(raw), bool)
    np.logical_and(raw[1:] == 0, raw[:-1] == 255, out=stuffed[1:])
    starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)))))
    if np.any(np.diff(starts) - np.add.reduceat(stuffed, starts[:-1], dtype=np.int64) != _CODED):
        raise ValueError("a frame of another length")
    b = raw[~stuffed].reshape(-1, _BITS).astype(np.uint16)
    c = np.empty((len(b), 8), np.uint16)
    for k in range(8):
        c[:, k] = (b[:, k] << (k + 1) | b[:, k + 1] >> (7 - k)) & 511
    d = _TO_DIFFERENCE[c].reshape(-1, SIDE, SIDE)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1, dtype=np.int16)
    return np.cumsum(d, axis=2, dtype=np.int16).astype(np.uint8)


@dataclass
class Film:
    """What a film's headers and index say: frames a second, and each frame's bytes."""

    rate: float
    frames: list[bytes]


def read_film(media: bytes) -> Film:
    """Parse a RIFF AVI file by its idx1 index, or frame by frame if it has none."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI film")
    rate, movi, index, at = float(RATE), None, None, 12
    while at + 8 <= len(media):
        name, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"LIST" and media[at + 8 : at + 12] == b"hdrl":
            found = media.find(b"strh", at, at + 8 + n)
            if found > 0:
                scale, per = struct.unpack_from("<II", media, found + 8 + 20)
                rate = per / scale if scale else rate
        elif name == b"LIST" and media[at + 8 : at + 12] == b"movi":
            movi = at + 8, at + 8 + n
        elif name == b"idx1":
            index = np.frombuffer(media, "<u4", n // 16 * 4, at + 8).reshape(-1, 4)
        at += 8 + n + (n & 1)
    if movi is None:
        raise ValueError("an AVI film without frames")
    frames = []
    if index is not None and len(index):
        video = index[(index[:, 0] >> 16) == int.from_bytes(b"dc", "little")]
        from_list = not len(video) or media[movi[0] + int(video[0, 2]) : movi[0] + int(video[0, 2]) + 4][2:] == b"dc"
        base = movi[0] if from_list else 0
        frames = [media[base + o + 8 : base + o + 8 + n] for o, n in video[:, 2:].tolist()]
    else:
        at = movi[0] + 4
        while at + 8 <= movi[1]:
            n = struct.unpack_from("<I", media, at + 4)[0]
            if media[at + 2 : at + 4] == b"dc":
                frames.append(media[at + 8 : at + 8 + n])
            at += 8 + n + (n & 1)
    return Film(rate, frames)


def decode_films(media: list[bytes]) -> tuple[list[Film], list[list[np.ndarray] | np.ndarray | str]]:
    """The films and, for each, its decoded frames, or what is wrong with it."""
    parsed, plain, where, out = [], [], [], []
    for i, raw in enumerate(media):
        try:
            film, images = read_film(raw), None
            own = all(f.startswith(_HEAD) and f.endswith(_END) and len(f) - f.count(b"\xff\x00", len(_HEAD)) == len(_HEAD) + _CODED + 2 for f in film.frames)
            if not own:
                images = [decode_frame(f) for f in film.frames]
        except (ValueError, IndexError, KeyError, struct.error) as wrong:
            film, own, images = Film(float(RATE), []), False, f"{wrong}"
        parsed.append(film)
        if own and film.frames:
            plain += [f[len(_HEAD) : -2] for f in film.frames]
            where.append(i)
        out.append(None if own and film.frames else images if images is not None else [])
    if plain:
        samples, k = _together(plain), 0
        for i in where:
            n = len(parsed[i].frames)
            out[i] = samples[k : k + n]
            k += n
    return parsed, out


def shots(frames: np.ndarray | list[np.ndarray]) -> tuple[list[int], list[float]]:
    """The first frame of each shot, and each shot's mean sample.

    A cut lies where the histogram difference of two neighbours exceeds the mean of the
    differences around it by DEVIATIONS standard deviations, and LEAST at any rate.
    """
    n = len(frames)
    if not n:
        return [], []
    if isinstance(frames, np.ndarray):
        bins = (frames.reshape(n, -1) >> 3).astype(np.int64) + np.arange(n)[:, None] * BINS
        counts = np.bincount(bins.ravel(), minlength=n * BINS).reshape(n, BINS) / frames[0].size
        means = frames.reshape(n, -1).mean(1)
    else:
        counts = np.array([np.bincount(f.ravel() >> 3, minlength=BINS) / f.size for f in frames])
        means = np.array([f.mean() for f in frames])
    cuts = np.zeros(0, np.int64)
    if n > 2:
        d = np.abs(np.diff(counts, axis=0)).sum(1) / 2
        sums = np.concatenate(([0.0], np.cumsum(d)))
        squares = np.concatenate(([0.0], np.cumsum(d * d)))
        k = np.arange(len(d))
        low, high = np.maximum(k - NEAR, 0), np.minimum(k + NEAR + 1, len(d))
        others = np.maximum(high - low - 1, 1)
        mean = (sums[high] - sums[low] - d) / others
        spread = np.sqrt(np.maximum((squares[high] - squares[low] - d * d) / others - mean * mean, 0))
        cuts = np.flatnonzero((d > mean + DEVIATIONS * spread) & (d > LEAST)) + 1
    firsts = np.concatenate(([0], cuts))
    sizes = np.diff(np.append(firsts, n))
    return firsts.tolist(), (np.add.reduceat(means, firsts) / sizes).tolist()


_CLIP = pa.struct([("clip", pa.int32()), ("first_frame", pa.int32()), ("n_frames", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("mean_sample", pa.float64())])


def store_as_film(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """df with each whole text stored as an AVI film, losslessly.

    A text's UTF-8 bytes are filled with bytes 255 up to a positive multiple of 576; a null text
    counts as empty and fills one frame. Equal texts give equal films. Rows stay as they are; an
    old column named like the new one gives way.
    """
    bounded_batches(df.sparkSession)

    @F.arrow_udf("binary")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(films(utf8_list(texts)), pa.binary())

    return with_columns(df, {media: run(F.col(quoted(text)).cast("string"))})


def read_films(df: DataFrame, media: str = "media", payload: str = "payload", clips: str = "clips", error: str = "film_error") -> DataFrame:
    """df with the decoded samples of each film (row by row of its frames) and its timed clips.

    A null film gives an empty payload and no clips. Bytes that are no film of lossless or baseline
    frames give a null payload, no clips, and in `error` what is wrong with them (null in other rows).
    Of a baseline frame the luminance is kept. Rows stay as they are; old columns named like the new ones give way.
    """
    bounded_batches(df.sparkSession)
    kind = "struct<payload:binary,clips:array<struct<clip:int,first_frame:int,n_frames:int,start_s:double,end_s:double,mean_sample:double>>,error:string>"

    @F.arrow_udf(kind)
    def run(media: pa.Array) -> pa.Array:
        raw = media.to_pylist()
        some = [m for m in raw if m is not None]
        parsed, frames = decode_films(some)
        made = iter(zip(parsed, frames))
        payloads, rows, sizes, errors = [], [], [], []
        for m in raw:
            if m is None:
                payloads.append(b"")
                sizes.append(0)
                errors.append(None)
                continue
            film, images = next(made)
            if isinstance(images, str):
                payloads.append(None)
                sizes.append(0)
                errors.append(images)
                continue
            errors.append(None)
            payloads.append(images.tobytes() if isinstance(images, np.ndarray) else b"".join(x.tobytes() for x in images))
            firsts, means = shots(images)
            ends = [*firsts[1:], len(images)] if firsts else []
            rows += [(k, a, b - a, a / film.rate, b / film.rate, mean) for k, (a, b, mean) in enumerate(zip(firsts, ends, means))]
            sizes.append(len(firsts))
        columns = list(zip(*rows)) if rows else [[]] * 6
        flat = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _CLIP)], fields=list(_CLIP))
        at = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
        return pa.StructArray.from_arrays([pa.array(payloads, pa.binary()), pa.ListArray.from_arrays(at, flat), pa.array(errors, pa.string())], ["payload", "clips", "error"])

    both = run(F.col(quoted(media)))
    return with_columns(df, {payload: both["payload"], clips: both["clips"], error: both["error"]})


def clip_rows(df: DataFrame, clips: str = "clips") -> DataFrame:
    """One row for each clip of each row of df, with the clip's number, frames and times.

    Rows without clips (null or none) give no row; columns of df named like a clip's give way to them.
    """
    exploded = df.select(*[F.col(quoted(c)) for c in df.columns if c.lower() != clips.lower()], F.explode(quoted(clips)).alias("clip"))
    rest = [F.col(quoted(c)) for c in df.columns if c.lower() not in {clips.lower(), *(f.name for f in _CLIP)}]
    return exploded.select(*rest, *[F.col("clip")[f.name].alias(f.name) for f in _CLIP])


