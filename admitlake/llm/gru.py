"""A gated recurrent language model in numpy: trained by truncated backpropagation, class-factored output.

Vocabulary: the most frequent words of the training documents, an end, and "other" for the rest. A
word's probability is that of its class given the state, times that of the word given class and
state; "other" is shared out among the words outside the vocabulary by their counts. Documents are
scored whole and many at a time: sorted by length, all that still run take a step together, and
states pass from window to window.

Training: all training documents are dealt out, by a hash of id and text, to rounds and to parts of
about PART tokens; in each round every part trains a copy of the parameters, and the copies are
averaged by tokens. Parts follow from the documents alone, so scores do not depend on how rows lie
in partitions (but for the rounding of sums). Word counts cover all training documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, quoted, stored, utf8_list

#: Words with a place in the vocabulary; words whose counts travel to every task (the others are joined); state size; classes.
VOCABULARY, FREQUENT, STATE, CLASSES = 1000, 200_000, 16, 32
#: Rounds, among which the training documents are dealt out; tokens of a part in a round; texts side by side; steps of a window.
ROUNDS, PART, LANES, WINDOW = 2, 1_000_000, 256, 16
#: Partitions at most that the parts of a round are shuffled to.
TASKS = 8192
#: Multiplications of one matrix product; larger products would wake BLAS threads beside the task's own.
SINGLE = 1 << 17
#: Tokens that are scored together.
TOGETHER = 4_000_000
#: Distinct words that a task counts before it hands them on.
COUNTED = 400_000

END, OTHER = 0, 1


def words_of(raw: bytes) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space."""
    return raw.lower().split()


def trains(key: Column) -> Column:
    """Whether a document belongs to the training part: crc32 of its id as text, modulo 5, is not 1; without an id it does not."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 != 1, F.lit(False))


def count_words(df: DataFrame, text: str) -> DataFrame:
    """word (bytes), n: how often each word stands in the texts; an end for each text is not in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for raw in utf8_list(batch.column(0)):
                total.update(words_of(raw))
                if len(total) > COUNTED:
                    yield handed()
                    total.clear()
        if total:
            yield handed()

    return df.select(F.col(quoted(text)).cast("string").alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Parameters, where each vocabulary word stands in its class, and how many tokens the parameters are trained on."""

    of_class: np.ndarray
    params: dict[str, np.ndarray] = field(default_factory=dict)
    trained: int = 0

    @classmethod
    def new(cls, counts: list[int], seed: int = 7) -> Model:
        """counts: of the end, of "other", of each word by falling frequency. Classes share out the square roots of the counts."""
        size = len(counts)
        roots = np.sqrt(np.maximum(np.array(counts, float), 1e-9))
        of_class = np.zeros(size, np.int64)
        of_class[OTHER] = 1
        if size > 2:
            share = np.cumsum(roots[2:]) / roots[2:].sum()
            bins = np.minimum((share * (CLASSES - 2) - 1e-9).astype(np.int64), CLASSES - 3)
            of_class[2:] = 2 + np.unique(bins, return_inverse=True)[1]
        draw, n = np.random.default_rng(seed), STATE
        params = {
            "input": draw.normal(0, 0.1, (size, 3 * n)), "state": draw.normal(0, 0.2, (n, 3 * n)), "class": draw.normal(0, 0.1, (n, of_class.max() + 1)),
            "class_bias": np.log(np.bincount(of_class, np.maximum(counts, 0.5))), "word": draw.normal(0, 0.1, (size, n)), "word_bias": np.log(np.maximum(np.array(counts, float), 0.5)),
        }
        params["class_bias"] -= params["class_bias"].max()
        params["word_bias"] -= params["word_bias"].max()
        return cls(of_class, {k: v.astype(np.float32) for k, v in params.items()})

    def members(self) -> list[np.ndarray]:
        return [np.flatnonzero(self.of_class == c) for c in range(self.of_class.max() + 1)]

    def advance(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        n = STATE
        a, b = self.params["input"][x], _times(h, self.params["state"])
        gates = 1 / (1 + np.exp(-(a[:, : 2 * n] + b[:, : 2 * n])))
        z, r = gates[:, :n], gates[:, n:]
        new = np.tanh(a[:, 2 * n :] + r * b[:, 2 * n :])
        return new + z * (h - new), z, r, new, b[:, 2 * n :]

    def log_probabilities(self, h: np.ndarray, y: np.ndarray, members: list[np.ndarray]) -> np.ndarray:
        """Natural logs of the probability of each y after state h."""
        p = self.params
        c = self.of_class[y]
        out = _log_softmax(h, p["class"].T, p["class_bias"], c)
        order = np.argsort(c, kind="stable")
        borders = np.searchsorted(c[order], np.arange(len(members) + 1))
        for k, own in enumerate(members):
            rows = order[borders[k] : borders[k + 1]]
            if len(own) > 1 and len(rows):
                out[rows] += _log_softmax(h[rows], p["word"][own], p["word_bias"][own], np.searchsorted(own, y[rows]))
        return out

    def score(self, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The natural log-probability of each text, given as its tokens in flat (ends included)."""
        found, order, members = np.zeros(len(sizes)), np.argsort(-sizes, kind="stable"), self.members()
        starts, sizes = starts[order], sizes[order]
        h = np.zeros((len(sizes), STATE), np.float32)
        live = np.searchsorted(-sizes, -np.arange(sizes.max() if len(sizes) else 0), "left")
        states, targets, rows = [], [], []
        held = 0

        def settle() -> None:
            nonlocal held
            if held:
                values = self.log_probabilities(np.concatenate(states), np.concatenate(targets), members)
                found[:] += np.bincount(np.concatenate(rows), values, len(found))
                states.clear(), targets.clear(), rows.clear()
                held = 0

        for t, k in enumerate(live.tolist()):
            y = flat[starts[:k] + t]
            states.append(h[:k].copy())
            targets.append(y)
            rows.append(np.arange(k))
            held += k
            h[:k] = self.advance(y, h[:k])[0]
            if held > 200_000:
                settle()
        settle()
        out = np.zeros(len(sizes))
        out[order] = found
        return out

    def train(self, flat: np.ndarray, rate: float) -> None:
        """One pass over a stream of tokens cut into LANES pieces, fewer of a short stream; windows of WINDOW steps, gradients clipped, AdaGrad."""
        lanes = max(1, min(LANES, len(flat) // (4 * WINDOW)))
        steps = -(-len(flat) // lanes)
        x = np.append(flat, np.full(lanes * steps - len(flat), END, flat.dtype)).reshape(lanes, steps)
        members, p, n = self.members(), self.params, STATE
        memory = {k: np.full_like(v, 1e-3) for k, v in p.items()}
        h = np.zeros((lanes, n), np.float32)
        for begin in range(0, steps, WINDOW):
            part = x[:, begin : begin + WINDOW]
            saved, states = [], []
            for t in range(part.shape[1]):
                states.append(h)
                following, *rest = self.advance(part[:, t], h)
                going = (part[:, t] != END)[:, None].astype(np.float32)
                saved.append((h, going, *rest))
                h = following * going
            every, y = np.concatenate(states), part.T.ravel()
            grads, to_h = self._output_gradients(every, y, members)
            to_h = to_h.reshape(part.shape[1], lanes, n)
            carry, turned = np.zeros((lanes, n), np.float32), p["state"].T
            to_input, to_gates = np.empty((part.shape[1], lanes, 3 * n), np.float32), np.empty((part.shape[1], lanes, 3 * n), np.float32)
            for t in reversed(range(part.shape[1])):
                old, going, z, r, new, inner = saved[t]
                g, own = carry * going, to_input[t]
                gz = g * z
                to_new = (g - gz) * (1 - new * new)
                own[:, :n] = gz * (old - new) * (1 - z)
                own[:, n : 2 * n] = to_new * inner * r * (1 - r)
                own[:, 2 * n :] = to_new
                to_gates[t] = own
                to_gates[t, :, 2 * n :] *= r
                carry = gz + _times(to_gates[t], turned) + to_h[t]
            to_state = _across(every, to_gates.reshape(-1, 3 * n))
            grads["state"] = to_state
            flat_input = np.zeros_like(p["input"])
            order = np.argsort(y, kind="stable")
            heads = np.flatnonzero(np.diff(y[order], prepend=-1))
            flat_input[y[order[heads]]] = np.add.reduceat(to_input.reshape(-1, 3 * n)[order], heads, axis=0)
            grads["input"] = flat_input
            for name, g in grads.items():
                g = np.clip(g / lanes, -1, 1)
                memory[name] += g * g
                p[name] -= (rate * g / np.sqrt(memory[name])).astype(np.float32)

    def _output_gradients(self, h: np.ndarray, y: np.ndarray, members: list[np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray]:
        p, c = self.params, self.of_class[y]
        q = _softmax(_times(h, p["class"]) + p["class_bias"])
        q[np.arange(len(y)), c] -= 1
        to_h = _times(q, p["class"].T)
        grads = {"class": _across(h, q), "class_bias": q.sum(0), "word": np.zeros_like(p["word"]), "word_bias": np.zeros_like(p["word_bias"])}
        order = np.argsort(c, kind="stable")
        borders = np.searchsorted(c[order], np.arange(len(members) + 1))
        for k, own in enumerate(members):
            rows = order[borders[k] : borders[k + 1]]
            if len(own) > 1 and len(rows):
                part, words = h[rows], p["word"][own]
                q = _softmax(_times(part, words.T) + p["word_bias"][own])
                q[np.arange(len(rows)), np.searchsorted(own, y[rows])] -= 1
                grads["word"][own] = _across(q, part)
                grads["word_bias"][own] = q.sum(0)
                to_h[rows] += _times(q, words)
        return grads, to_h


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b, some rows of a at a time."""
    each = max(1, SINGLE // b.size)
    n = len(a) // each * each
    if n in (0, len(a)) and n <= each:
        return a @ b
    out = np.empty((len(a), b.shape[1]), a.dtype)
    np.matmul(a[:n].reshape(-1, each, a.shape[1]), b, out=out[:n].reshape(-1, each, b.shape[1]))
    out[n:] = a[n:] @ b
    return out


def _across(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b, some rows of both at a time."""
    each = max(1, SINGLE // (a.shape[1] * b.shape[1]))
    n = len(a) // each * each
    left, right = a[:n].reshape(-1, each, a.shape[1]), b[:n].reshape(-1, each, b.shape[1])
    return np.matmul(left.transpose(0, 2, 1), right).sum(0) + a[n:].T @ b[n:]


def _log_softmax(h: np.ndarray, weights: np.ndarray, bias: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural logs of the softmax of weights @ h + bias at y for each row of h: some rows at a time, each a column, so that sums run along memory."""
    out, each = np.empty(len(h), np.float32), max(1, SINGLE // weights.size)
    column = bias[:, None]
    for k in range(0, len(h), each):
        x = weights @ h[k : k + each].T + column
        at, top = x[y[k : k + each], np.arange(x.shape[1])], x.max(0)
        x -= top
        out[k : k + each] = at - top - np.log(np.exp(x, out=x).sum(0))
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1)[:, None])
    return e / e.sum(1)[:, None]


class Lexicon:
    """Frequent words by falling count, ties by bytes, and numbers of all training tokens."""

    def __init__(self, words: list[bytes], counts: list[int], tokens: int, distinct: int, ends: int) -> None:
        self.words, self.counts, self.tokens, self.distinct, self.ends = words, np.array(counts, float), tokens, distinct, ends
        self.vocabulary = min(VOCABULARY, len(words))
        self.rank: dict[bytes, int] | None = None
        self.rest_tokens = tokens - ends - int(self.counts[: self.vocabulary].sum())
        self.rest_distinct = max(0, distinct - (ends > 0) - self.vocabulary)

    def log10(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))

    def log10_rest(self, counts: np.ndarray) -> np.ndarray:
        """Of a word outside the vocabulary, given that it is one."""
        return np.log10((counts + 0.5) / (self.rest_tokens + 0.5 * (self.rest_distinct + 1)))

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Each word's place, -1 for words that are not frequent."""
        if self.rank is None:
            self.rank = {w: k for k, w in enumerate(self.words)}
        return np.fromiter(map(self.rank.get, words, repeat(-1)), np.int32, len(words))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rank": None}


def _tokens(ranks: np.ndarray, vocabulary: int) -> np.ndarray:
    return np.append(np.where((ranks >= 0) & (ranks < vocabulary), ranks + 2, OTHER), END).astype("<u2")


_ENCODED = "key {kind}, h long, digest binary, tokens binary, n_known long, base_score double, more double, rare array<struct<word:binary,n:int>>"


def encode(keyed: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Of rows (key, text): h (a hash of both), digest of the text, its tokens as 2-byte numbers, and what the lexicon says of its words.

    n_known and base_score are about words with a place in the lexicon and the end, more is the log10
    probability, given "other", of such words outside the vocabulary; rare holds the words it lacks.
    """
    shared = keyed.sparkSession.sparkContext.broadcast(lexicon)
    schema = _ENCODED.format(kind=keyed.schema["key"].dataType.simpleString())
    names = [f.strip().split()[0] for f in "key, h, digest, tokens, n_known, base_score, more, rare".split(",")]
    kind = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        plain, rest = known.log10(known.counts), known.log10_rest(known.counts)
        end = float(known.log10(np.array([float(known.ends)]))[0])
        for batch in batches:
            rows = []
            for raw in utf8_list(batch.column(1)):
                words = words_of(raw)
                ranks = known.ranks(words)
                often = ranks[ranks >= 0]
                few = Counter([w for w, r in zip(words, ranks.tolist()) if r < 0]) if len(often) < len(words) else {}
                outside = often[often >= known.vocabulary]
                rows.append((
                    xxhash.xxh3_128_digest(raw), _tokens(ranks, known.vocabulary).tobytes(), len(often) + (known.ends > 0), float(plain[often].sum()) + end,
                    float(rest[outside].sum()), [{"word": w, "n": n} for w, n in few.items()],
                ))
            digest, tokens, found, base, more, rare = zip(*rows) if rows else ([],) * 6
            out = [pa.array(digest, pa.binary()), pa.array(tokens, pa.binary()), pa.array(found, pa.int64()), pa.array(base, pa.float64()), pa.array(more, pa.float64()), pa.array(rare, kind)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *out], names)

    return keyed.select("key", "text", F.xxhash64("key", "text").alias("h")).mapInArrow(run, schema)


def fit(encoded: DataFrame, lexicon: Lexicon, rounds: int = ROUNDS, part: int = PART) -> Model:
    """A model from all rows (h, tokens): each is trained on once, in the round and part that its h names.

    So copies of a text with keys of their own spread over rounds and parts. A part is read in the order of h and
    digest; a row that is repeated with its key stays in one part, which is read in pieces of TOGETHER tokens.
    """
    spark = encoded.sparkSession
    counts = [lexicon.ends, max(lexicon.rest_tokens, 0), *lexicon.counts[: lexicon.vocabulary].astype(int).tolist()]
    model = Model.new(counts)
    names = sorted(model.params)
    parts = max(1, -(-lexicon.tokens // (rounds * part)))
    place = F.pmod("h", F.lit(rounds * parts))
    dealt = encoded.select(F.pmod(place, F.lit(rounds)).alias("round"), F.floor(place / rounds).alias("part"), "h", "tokens")
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def train(batches: Iterator[pa.RecordBatch], shared=shared, rate=0.3 / (1 + k)) -> Iterator[pa.RecordBatch]:
            held: list[bytes] = []
            own, seen, now, size = None, 0, None, 0

            def settle() -> None:
                nonlocal own, seen, size
                own = own or Model(shared.value.of_class, {n: v.copy() for n, v in shared.value.params.items()})
                flat = np.frombuffer(b"".join(held), "<u2").astype(np.int64)
                own.train(flat, rate)
                seen, size = seen + len(flat), 0
                held.clear()

            def closed() -> pa.RecordBatch:
                nonlocal own, seen
                if held:
                    settle()
                flat = np.concatenate([own.params[n].ravel() for n in names]).astype("<f8") * seen
                out = pa.RecordBatch.from_arrays([pa.array([now % 64], pa.int32()), pa.array([seen], pa.int64()), pa.array([flat.tobytes()], pa.binary())], ["part", "n", "params"])
                own, seen = None, 0
                return out

            for batch in batches:
                for at, raw in zip(batch.column(0).to_pylist(), utf8_list(batch.column(1))):
                    if now is not None and at != now:
                        yield closed()
                    now = at
                    held.append(raw)
                    size += len(raw) // 2
                    if size >= TOGETHER:
                        settle()
            if now is not None:
                yield closed()

        def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = 0, 0.0
            for batch in batches:
                for m, flat in zip(batch.column("n").to_pylist(), batch.column("params")):
                    n, total = n + m, total + np.frombuffer(flat.as_py(), "<f8")
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["n", "params"])

        chosen = dealt.where(F.col("round") == k).repartition(min(parts, TASKS), "part").sortWithinPartitions("part", "h").select("part", "tokens")
        n, total = 0, 0.0
        for row in chosen.mapInArrow(train, "part int, n long, params binary").groupBy("part").applyInArrow(add, "n long, params binary").toLocalIterator():
            n, total = n + row["n"], total + np.frombuffer(bytes(row["params"]), "<f8")
        if n:
            flat, at, new = total / n, 0, {}
            for name in names:
                old = model.params[name]
                new[name] = flat[at : at + old.size].reshape(old.shape).astype(np.float32)
                at += old.size
            model = Model(model.of_class, new, model.trained + n)
    return model


def learn_lexicon(counts: DataFrame, ends: int, frequent: int = FREQUENT) -> Lexicon:
    """counts: word, n over all training texts; ends: how many texts.

    The words that come to the driver are the most frequent ones down to a step of counts, so many
    steps that they are `frequent` words at most: no task has to gather or sort all words.
    """
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    step = F.floor(F.log2("n") * 64).cast("int")
    least, words = None, 0
    for row in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("step")).collect():
        words += row["words"]
        if words > frequent:
            break
        least = row["step"]
    chosen = counts.where(step >= least) if least is not None else counts.limit(0)
    rows = sorted(zip(*(c.to_pylist() for c in chosen.select("n", "word").toArrow().columns)), key=lambda r: (-r[0], r[1]))
    return Lexicon([w for _, w in rows], [n for n, _ in rows], total["n"] + ends, total["v"] + (ends > 0), ends)


def score_texts(df: DataFrame, key: str = "doc_id", text: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """For each row its key, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Learns from rows whose crc32 of the id as text, modulo 5, is not 1 (held_out: it is 1; rows with
    a null id neither train nor are held out). base_score sums the add-half log10 probabilities of a
    text's words and its end over all training counts, score the model's. A null or empty text is
    its end alone. A row for each row of df, repeated ones included; no other column is kept.

    Counts of the `frequent` most frequent words travel to the tasks; each text's other words are
    joined to the table of all counts and their sums added. Two passes over the texts, the counts and
    the tokens; training and scoring read the stored tokens.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    keyed = df.select(F.col(quoted(key)).alias("key"), F.col(quoted(text)).cast("string").alias("text"))
    training = keyed.where(trains(F.col("key")))
    counts = stored(count_words(training, "text"))
    lexicon = learn_lexicon(counts, training.count(), frequent)
    encoded = stored(encode(keyed, lexicon))
    shared = spark.sparkContext.broadcast(fit(encoded.where(trains(F.col("key"))), lexicon))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def settle() -> pa.RecordBatch:
            raws = [raw for batch in held for raw in utf8_list(batch.column(0))]
            sizes = np.fromiter(map(len, raws), np.int64, len(raws)) // 2
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            found = shared.value.score(np.frombuffer(b"".join(raws), "<u2").astype(np.int32), starts, sizes) / np.log(10)
            rest = [pa.concat_arrays([batch.column(k) for batch in held]) for k in range(1, 6)]
            more = rest.pop().to_numpy()
            return pa.RecordBatch.from_arrays([*rest, pa.array(sizes), pa.array(found + more)], ["key", "digest", "n_known", "base_score", "n_tokens", "score"])

        for batch in batches:
            held.append(batch)
            size += sum(map(len, utf8_list(batch.column(0)))) // 2
            if size >= TOGETHER:
                yield settle()
                held, size = [], 0
        if any(batch.num_rows for batch in held):
            yield settle()

    kind = keyed.schema["key"].dataType.simpleString()
    scored = encoded.select("tokens", "key", "digest", "n_known", "base_score", "more").mapInArrow(run, f"key {kind}, digest binary, n_known long, base_score double, n_tokens long, score double")
    few = encoded.select("digest", F.explode("rare").alias("r")).select("digest", "r.word", F.col("r.n").alias("times"))
    joined = few.join(counts.withColumnRenamed("n", "count"), "word", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    base = F.log10((F.col("count") + 0.5) / F.lit(float(lexicon.tokens + 0.5 * (lexicon.distinct + 1))))
    rest = F.log10((F.col("count") + 0.5) / F.lit(float(lexicon.rest_tokens + 0.5 * (lexicon.rest_distinct + 1))))
    sums = joined.groupBy("digest").agg(F.sum(F.when(F.col("count") > 0, F.col("times")).otherwise(0)).alias("more_known"), F.sum(F.col("times") * base).alias("more_base"), F.sum(F.col("times") * rest).alias("more_score"))
    copies = encoded.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"))
    sums = stored(sums.join(copies, "digest").select("digest", *[(F.col(c) / F.col("copies")).alias(c) for c in ("more_known", "more_base", "more_score")]))
    out = scored.join(sums, "digest", "left")

    def plus(a: str, b: str) -> Column:
        return F.col(a) + F.coalesce(F.col(b), F.lit(0.0))

    held_out = F.coalesce(F.crc32(F.col("key").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    return out.select(
        F.col("key").alias(key), held_out.alias("held_out"), "n_tokens", F.round(plus("n_known", "more_known")).cast("long").alias("n_known"),
        F.lit(lexicon.tokens).cast("long").alias("train_tokens"), plus("base_score", "more_base").alias("base_score"), plus("score", "more_score").alias("score"),
    )
