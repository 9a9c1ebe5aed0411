"""Secrets: base patterns, and a character convolutional network over every other candidate and its context.

The network is trained in numpy on labelled findings that this module makes from a seed (secrets of
several shapes in several contexts against identifiers, file names, numbers and the like). Its
scores are calibrated on findings held out, and its threshold is the highest one that still finds
RECALL of the secrets among them.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, quoted, with_columns
from .spans import SPANS, Covered, span_array

#: Kinds in the order that breaks ties at one start; the first three are the base.
KINDS = ("assign", "access", "hex", "model")
BASE = 3
#: The network's window: characters before a piece of a candidate, of the piece, and after it; a long candidate's pieces
#: start STEP characters apart. Candidates have CANDIDATE characters or more.
BEFORE, INSIDE, AFTER, STEP, CANDIDATE = 24, 40, 12, 20, 16
RECALL = 0.95

_ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{CANDIDATE},}}")
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base patterns' spans, kind by kind."""
    out: list[tuple[str, int, int]] = []
    if ":" in text or "=" in text:
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return out


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of key characters that mix digits and letters."""
    return [m.span() for m in _CANDIDATE.finditer(text) if _DIGIT.search(m[0]) and _LETTER.search(m[0])]


_ALPHABET = np.zeros(128, np.int8)
for _k, _c in enumerate(string.ascii_lowercase + string.ascii_uppercase + string.digits + "_-+/=:\"' ."):
    _ALPHABET[ord(_c)] = _k + 1
_SYMBOLS = int(_ALPHABET.max()) + 2


def pieces(start: int, end: int) -> Iterator[tuple[int, int]]:
    """Overlapping pieces of INSIDE characters that cover a candidate, the last one at its end; a short one is one piece."""
    at = start
    while at + INSIDE < end:
        yield at, at + INSIDE
        at = min(at + STEP, end - INSIDE)
    yield at, end


def window(text: str, start: int, end: int) -> np.ndarray:
    """Symbol numbers of the window of a candidate's first piece; 0 outside the text, the last number for other characters."""
    end = min(end, start + INSIDE)
    raw = (text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0") + text[start:end].ljust(INSIDE, "\0") + text[end : end + AFTER].ljust(AFTER, "\0")).encode("utf-32-le")
    points = np.frombuffer(raw, "<u4")
    return np.where(points < 128, _ALPHABET[np.minimum(points, 127)], 0).astype(np.int64) + (_SYMBOLS - 1) * ((points >= 128) | (points < 128) & (points > 0) & (_ALPHABET[np.minimum(points, 127)] == 0))


@dataclass
class Network:
    """Embedding, one convolution with largest-value pooling, a dense layer; scale and shift calibrate its scores."""

    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    offset: float
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    width = 5

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        e = self.embed[x]
        steps = x.shape[1] - self.width + 1
        columns = np.concatenate([e[:, k : k + steps] for k in range(self.width)], axis=2)
        h = columns @ self.kernel + self.bias
        best = h.argmax(1)
        top = np.take_along_axis(h, best[:, None, :], 1)[:, 0]
        pooled = np.maximum(top, 0)
        mean = np.maximum(h, 0).mean(1)
        return columns, h, best, np.concatenate([pooled, mean], 1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return self._forward(x)[3] @ self.dense + self.offset if len(x) else np.zeros(0)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.shift, -30, 30)))

    def step(self, x: np.ndarray, y: np.ndarray, rate: float) -> None:
        columns, h, best, features = self._forward(x)
        n, steps, filters = h.shape
        p = 1 / (1 + np.exp(-np.clip(features @ self.dense + self.offset, -30, 30)))
        g = (p - y) / n
        to_features = g[:, None] * self.dense[None]
        to_h = np.where(h > 0, to_features[:, None, filters:] / steps, 0)
        alive = np.take_along_axis(h, best[:, None, :], 1)[:, 0] > 0
        at = np.arange(n)[:, None], best, np.arange(filters)[None]
        to_h[at] += to_features[:, :filters] * alive
        flat = to_h.reshape(-1, filters)
        to_columns = (flat @ self.kernel.T).reshape(n, steps, self.width, -1)
        to_embed = np.zeros_like(self.embed)
        for k in range(self.width):
            np.add.at(to_embed, x[:, k : k + steps].ravel(), to_columns[:, :, k].reshape(n * steps, -1))
        self.kernel -= rate * (columns.reshape(-1, columns.shape[2]).T @ flat)
        self.bias -= rate * flat.sum(0)
        self.embed -= rate * to_embed
        self.dense -= rate * (features.T @ g)
        self.offset -= rate * float(g.sum())


def labelled_findings(n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """Text, start, end and label of n findings, half of them secrets."""
    pick = random.Random(seed)
    words = "the of and in report school student annual table chapter version build session order item archive release page course grade figure".split()

    def word() -> str:
        return pick.choice(words) if pick.random() < 0.5 else "".join(pick.choice(string.ascii_lowercase) for _ in range(pick.randint(2, 9)))

    def of(chars: str, low: int, high: int) -> str:
        return "".join(pick.choice(chars) for _ in range(pick.randint(low, high)))

    mixed = string.ascii_letters + string.digits
    secrets = (
        lambda: of("0123456789abcdef", 32, 64), lambda: of(mixed, 20, 48), lambda: of(mixed + "+/", 40, 64) + "==", lambda: "AKIA" + of(string.ascii_uppercase + string.digits, 16, 16),
        lambda: pick.choice(("sk-", "ghp_", "xoxb-", "glpat-", "pk_live_")) + of(mixed, 24, 40), lambda: "eyJ" + of(mixed + "_-", 40, 80), lambda: of("0123456789ABCDEF", 32, 40),
    )
    plain = (
        lambda: "-".join(word() for _ in range(4)) + f"-{pick.randint(1, 2030)}", lambda: f"{word()}_{word()}_{word()}_{pick.randint(0, 99):02d}", lambda: f"{pick.randint(1990, 2030)}-{pick.randint(1, 12):02d}-{pick.randint(1, 28):02d}T{pick.randint(0, 23):02d}{pick.randint(0, 59):02d}00Z",
        lambda: "/".join((word(), word(), f"{word()}{pick.randint(1, 40)}", word())), lambda: word() * 3 + str(pick.randint(10, 9999)), lambda: pick.choice("0123456789") * pick.randint(15, 30) + pick.choice("abcxyz"),
        lambda: f"{word().upper()}-{word().upper()}-{pick.randint(1000, 999999)}-{word()}", lambda: f"{word()}{word().title()}{word().title()}{word().title()}{pick.randint(1, 12)}", lambda: "=" * pick.randint(12, 30) + f"v{pick.randint(1, 9)}" + "=" * 8,
    )
    opens = ("key: ", 'key="', "Authorization: Bearer ", "credential ", "auth = '", "access ", "signed with ", "export KEY=", "", "login ")
    neutral = ("see ", "file ", "in ", "id ", "from ", "the ", "", "chapter ", "at ", "version ")
    out = []
    for k in range(n):
        secret = k % 2
        body = pick.choice(secrets if secret else plain)()
        lead = " ".join(word() for _ in range(pick.randint(0, 6))) + " " + pick.choice(opens if pick.random() < (0.7 if secret else 0.25) else neutral)
        text = f"{lead}{body} {word()} {word()}"
        runs = [s for s in candidates(text) if s[0] >= len(lead) - 12]
        if runs:
            out.append((text, *max(runs, key=lambda s: s[1] - s[0]), secret))
    return out


@lru_cache(maxsize=4)
def trained(findings: int = 3000, seed: int = 11, epochs: int = 8) -> Network:
    """The network, fitted on four fifths of the findings, calibrated and given its threshold on the rest."""
    rows = labelled_findings(findings, seed)
    cut = [(k, window(t, *piece), label) for k, (t, a, b, label) in enumerate(rows) for piece in pieces(a, b)]
    of, x, y = np.array([k for k, *_ in cut]), np.array([w for _, w, _ in cut]), np.array([label for *_, label in cut], float)
    held = of % 5 == 4
    draw = np.random.default_rng(seed)
    size, filters = 8, 16
    net = Network(draw.normal(0, 0.3, (_SYMBOLS, size)), draw.normal(0, 0.2, (Network.width * size, filters)), np.zeros(filters), draw.normal(0, 0.2, 2 * filters), 0.0)
    xs, ys = x[~held], y[~held]
    for epoch in range(epochs):
        order = draw.permutation(len(xs))
        for k in range(0, len(xs), 32):
            net.step(xs[order[k : k + 32]], ys[order[k : k + 32]], 0.8 / (1 + epoch / 4))
    heads = np.flatnonzero(np.diff(of[held], prepend=-1))
    z, t = np.maximum.reduceat(net.logits(x[held]), heads), y[held][heads]
    for _ in range(20):  # Newton's method for scale and shift
        p = 1 / (1 + np.exp(-np.clip(net.scale * z + net.shift, -30, 30)))
        w = p * (1 - p) + 1e-6
        g = np.array([((p - t) * z).sum() + 1e-3 * (net.scale - 1), (p - t).sum()])
        hessian = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        net.scale, net.shift = np.array([net.scale, net.shift]) - np.linalg.solve(hessian, g)
    secret = np.sort(np.maximum.reduceat(net.scores(x[held]), heads)[t == 1])
    net.threshold = float(max(0.5, secret[int((1 - RECALL) * len(secret))]))
    return net


def scan(texts: list[str], net: Network) -> list[list[tuple[str, int, int, float, bool]]]:
    """Spans of each text by start, then kind: base ones (score 1), and candidates outside them that the network accepts: by the largest score of their pieces."""
    out: list[list[tuple[str, int, int, float, bool]]] = []
    windows: list[np.ndarray] = []
    where: list[tuple[int, int, int]] = []
    best: dict[tuple[int, int, int], float] = {}

    def settle() -> None:
        for at, p in zip(where, net.scores(np.array(windows)).tolist()):
            best[at] = max(p, best.get(at, 0.0))
        windows.clear(), where.clear()

    for i, text in enumerate(texts):
        base = base_spans(text)
        out.append([(k, a, b, 1.0, True) for k, a, b in base])
        taken = Covered()
        for _, a, b in base:
            taken.add(a, b)
        for a, b in candidates(text):
            if not taken.meets(a, b):
                for piece in pieces(a, b):
                    windows.append(window(text, *piece))
                    where.append((i, a, b))
                    if len(where) == 512:
                        settle()
    if where:
        settle()
    for (i, a, b), p in best.items():
        if p >= net.threshold:
            out[i].append(("model", a, b, round(p, 6), False))
    for spans in out:
        spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return out


def find_secrets(df: DataFrame, text: str = "text", spans: str = "secrets", findings: int = 3000) -> DataFrame:
    """df with the secrets found in each whole text: kind, start, end, score, base.

    findings: how many labelled findings the network is fitted on (on the driver, once a session).
    A null or empty text has no spans. Rows stay as they are, repeated ones included; an old column
    named like the new one gives way. One pass without a shuffle.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(trained(findings))

    @F.arrow_udf(SPANS)
    def run(texts: pa.Array) -> pa.Array:
        found = scan([t or "" for t in texts.to_pylist()], shared.value)
        return span_array([s for one in found for s in one], [len(one) for one in found])

    return with_columns(df, {spans: run(F.col(quoted(text)).cast("string"))})
