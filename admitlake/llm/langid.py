"""Language identification by fusing evidence: the text, its declared markup language, its address, its host.

Text likelihoods come from hashed letter trigrams, fitted on a bounded sample of labelled rows of
each language. The other evidence enters as likelihoods and priors: how often a declaration is true
(counted over rows outside that sample), which languages an address suffix stands for, and what the
host's other rows are written in. Host priors are counts over all rows, smoothed towards the counts
of the host's suffix, which are smoothed towards those of all rows. A background model, even over
all trigrams, takes what is no language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, free_name, list_array, quoted, stored, utf8_list, utf8_parts, with_columns

#: Trigrams are hashed to this many buckets.
BUCKETS = 1 << 15
#: Expected number of labelled rows of each language that the text model is fitted on.
ROWS_EACH = 2000
#: A text counts as this many trigrams at most, so that other evidence can weigh against it.
LENGTH = 60
#: Share of true declarations to begin with, and the rows that this is worth; weight of a suffix's own languages; prior of the background.
DECLARED, DECLARED_ROWS, SUFFIX, BACKGROUND = 0.9, 20.0, 0.5, 0.02
#: Rows that a suffix's prior is worth for a host, and the prior of all rows for a suffix.
HOST_SMOOTHING, SUFFIX_SMOOTHING = 20.0, 100.0
#: Hosts whose priors may travel to every task in one piece. Of more, those with over 1 / HOT of all rows travel, and the others are joined.
BROADCAST_HOSTS, HOT = 20_000, 1000
#: Least probability of an accepted language.
ENOUGH = 0.5
UNKNOWN = "und"
#: Languages that a country suffix stands for.
SUFFIXES = {"at": "de", "au": "en", "ca": "en", "ch": "de", "cl": "es", "co": "es", "de": "de", "es": "es", "fr": "fr", "ie": "en", "mx": "es", "nz": "en", "pe": "es", "uk": "en", "us": "en"}

_CLASS = np.zeros(256, np.uint32)
for _b in range(256):
    _CLASS[_b] = _b + 32 if 65 <= _b <= 90 else _b if 97 <= _b <= 122 or _b >= 128 else 0
_MARKUP = re.compile(rb"<html[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.IGNORECASE)


@dataclass
class Profiles:
    """Languages in order, for each the log-probability of every bucket, times 256, and the share of its rows that it was fitted on."""

    names: list[str]
    table: np.ndarray
    share: dict[str, float]


def _buckets(raw: np.ndarray) -> np.ndarray:
    """The bucket of the trigram that starts at each byte but the last two; BUCKETS where it has no letter."""
    c = _CLASS[raw]
    if len(c) < 3:
        return np.zeros(0, np.int32)
    t = c[:-2] << np.uint32(16) | c[1:-1] << np.uint32(8) | c[2:]
    return np.where(t == 0, BUCKETS, (t * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int32)


def likelihoods(raw: np.ndarray, at: np.ndarray, profiles: Profiles) -> tuple[np.ndarray, np.ndarray]:
    """For each text and language, then the background, the log-likelihood of its trigrams; and their number."""
    width = len(profiles.names) + 1
    out, count = np.zeros((len(at) - 1, width)), np.zeros(len(at) - 1, np.int64)
    low, high = at[:-1], np.maximum(at[1:] - 2, at[:-1])
    step, i = 1 << 20, 0
    while i < len(low):
        j = max(i + 1, int(np.searchsorted(at, at[i] + step, "right")) - 1)
        part = raw[at[i] : at[j]]
        found = np.append(_buckets(part), np.full(min(2, len(part)), BUCKETS, np.int32))
        a, b = np.minimum(low[i:j] - at[i], len(found)), np.minimum(high[i:j] - at[i], len(found))
        for k in range(width):
            total = np.concatenate(([0], np.cumsum(profiles.table[k][found], dtype=np.int64)))
            out[i:j, k] = (total[b] - total[a]) / 256
        total = np.concatenate(([0], np.cumsum(found < BUCKETS, dtype=np.int64)))
        count[i:j] = total[b] - total[a]
        i = j
    return out, count


def language_of(tag: Column) -> Column:
    """The language of a tag such as en-US: its first two or three letters, lower-cased; null for what is no such tag."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(tag.cast("string"))), "^([a-z]{2,3})([-_].*)?$", 1), F.lit(""))


def _draw(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(1 << 20)) / F.lit(float(1 << 20))


def fit_profiles(df: DataFrame, label: str, text: str, rows_each: int = ROWS_EACH) -> Profiles:
    """Profiles of all languages that labels name, from labelled rows chosen by the text's hash, rows_each of a language to be expected.

    Tags count as their language (en-US as en); labels of another form and empty texts are passed over. There
    are as many profiles, of BUCKETS numbers of two bytes, as language codes among the labels. Without labelled
    rows there are no languages.
    """
    column = F.col(quoted(text)).cast("string")
    rows = df.select(language_of(F.col(quoted(label))).alias("label"), column.alias("text")).where("label is not null and text is not null and text <> ''")
    share = {r["label"]: min(1.0, rows_each / r["count"]) for r in rows.groupBy("label").count().collect()}
    names = sorted(share)
    if not names:
        return Profiles([], np.full((1, BUCKETS + 1), 0, np.int16), {})
    limit = F.create_map(*[F.lit(x) for n in names for x in (n, float(share[n]))])
    chosen = rows.where(_draw(F.col("text")) < F.coalesce(F.try_element_at(limit, F.col("label")), F.lit(0.0)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), utf8_list(batch.column(1))):
                total.setdefault(name, np.zeros(BUCKETS + 1, np.int64))
                total[name] += np.bincount(_buckets(np.frombuffer(raw, np.uint8)), minlength=BUCKETS + 1)
        for name, counts in total.items():
            at = np.flatnonzero(counts)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at.astype("<u4").tobytes()], pa.binary()), pa.array([counts[at].astype("<i8").tobytes()], pa.binary())], ["label", "at", "n"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for at, n in zip(batch.column("at"), batch.column("n")):
                total[np.frombuffer(at.as_py(), "<u4")] += np.frombuffer(n.as_py(), "<i8")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([total.astype("<i8").tobytes()], pa.binary())], ["label", "n"])

    summed = chosen.mapInArrow(count, "label string, at binary, n binary").groupBy("label").applyInArrow(add, "label string, n binary").collect()
    found = {r["label"]: np.frombuffer(bytes(r["n"]), "<i8")[:BUCKETS] for r in summed}
    names = [n for n in names if n in found]
    table = np.zeros((len(names) + 1, BUCKETS + 1), np.int16)
    for k, n in enumerate(names):
        p = (found[n] + 0.1) / (found[n].sum() + 0.1 * BUCKETS)
        table[k, :BUCKETS] = np.round(np.log(p) * 256)
    table[-1, :BUCKETS] = round(-np.log(BUCKETS) * 256)
    return Profiles(names, table, share)


def suffix_of(address: Column) -> Column:
    """The last label of an address's host, lower-cased; empty if it has no dot or is null."""
    host = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(address.cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", ""), r"[/?#:].*$", ""))
    return F.when(host.contains("."), F.substring_index(host, ".", -1)).otherwise("")


def host_of(address: Column) -> Column:
    """An address's host, lower-cased; the whole if it is not an address, empty if it is null."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(address.cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", ""), r"[/?#:].*$", ""))


def host_priors(counted: DataFrame, size: int) -> tuple[DataFrame, list[float]]:
    """Of stored counts n of rows by (host, suffix, best): n and the log prior of each host as an array of `size` languages, and the log prior of all rows.

    best is the number of a row's language by its text alone; counts are added up by host, suffix and
    all rows, each level smoothed towards the next.
    """
    every = {r["best"]: r["n"] for r in counted.groupBy("best").agg(F.sum("n").alias("n")).collect()}
    total = sum(every.values())
    world = [(every.get(k, 0) + 1) / (total + size) for k in range(size)]
    places = F.sequence(F.lit(0), F.lit(size - 1))

    def summed(rows: DataFrame, *keys: str) -> DataFrame:
        """By keys: their rows, and a map from language to its rows (no more entries than languages)."""
        each = rows.groupBy(*keys, "best").agg(F.sum("n").alias("n"))
        return each.groupBy(*keys).agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("best", "n"))).alias("by"))

    def smoothed(above: Column, worth: float) -> Column:
        return F.transform(places, lambda k: (F.coalesce(F.try_element_at(F.col("by"), k), F.lit(0)) + worth * F.element_at(above, k + 1)) / (F.col("n") + worth))

    suffixes = summed(counted, "suffix").select("suffix", smoothed(F.array(*map(F.lit, world)), SUFFIX_SMOOTHING).alias("level"))
    sites = summed(counted, "host", "suffix").join(suffixes, "suffix")
    prior = F.transform(smoothed(F.col("level"), HOST_SMOOTHING), lambda p: F.log(p))
    return sites.select("host", "suffix", "n", prior.alias("prior")), [float(np.log(w)) for w in world]


def _with_priors(made: DataFrame, table: DataFrame, keys: list[str], prior: str, spread: Column, broadcast_hosts: int) -> DataFrame:
    """made with each row's host prior, null for hosts without one."""
    if table.count() <= broadcast_hosts:
        return made.join(F.broadcast(table.drop("n")), keys, "left")
    total = table.agg(F.sum("n")).scalar()
    hot = table.where(F.col("n") * HOT > total).select(*keys, F.col(prior).alias(f"{prior}_hot"))
    made = made.join(F.broadcast(hot), keys, "left")
    rest = table.where(F.col("n") * HOT <= total).select(F.concat_ws("\n", *keys).alias(f"{prior}_key"), prior)
    key = F.when(F.col(f"{prior}_hot").isNull(), F.concat_ws("\n", *keys)).otherwise(F.concat(F.lit("\n\n"), spread.cast("string")))
    joined = made.withColumn(f"{prior}_key", key).join(rest, f"{prior}_key", "left")
    return joined.withColumn(prior, F.coalesce(f"{prior}_hot", prior)).drop(f"{prior}_hot", f"{prior}_key")


def identify_language(
    df: DataFrame, text: str = "text", declared: str | None = "lang", address: str | None = "source", label: str | None = None,
    profiles: Profiles | None = None, language: str = "language", probability: str = "probability", text_language: str = "text_language",
    rows_each: int = ROWS_EACH, broadcast_hosts: int = BROADCAST_HOSTS,
) -> DataFrame:
    """df with each whole text's language, its probability, and the language by the text alone.

    declared: column of declared languages (a lang attribute of an html element in the text goes
    before it); address: column of addresses or host names; label: column of labels that the text
    model is fitted on, declared if not given. Tags stand for their language (en-US for en);
    declarations outside the fitted languages count as none. A declaration is as reliable as
    declarations agree with the texts of rows that the model was not fitted on; hosts with a large
    share of all rows are not gathered. A text without trigrams that hold a letter (null and empty ones too) is "und" with
    probability 0, and so, with its probability, is one that the background explains best; ties go
    to the alphabet's first. Rows stay as they are, repeated ones included; old columns named like
    the new ones give way. Three passes over the texts: the sample, the hosts, the result.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    shared_profiles = profiles or fit_profiles(df, label or declared or "lang", text, rows_each)
    names, size = shared_profiles.names, len(shared_profiles.names)
    model = spark.sparkContext.broadcast(shared_profiles)
    column = F.col(quoted(text)).cast("string")

    @F.arrow_udf("struct<evidence:array<double>,best:int,markup:string>")
    def weigh(texts: pa.Array) -> pa.Array:
        raw, at = utf8_parts(texts)
        found, count = likelihoods(raw, at, model.value)
        found *= np.minimum(1.0, LENGTH / np.maximum(count, 1))[:, None]
        best = np.where((count > 0) & (found[:, :-1].max(1) > found[:, -1]), found[:, :-1].argmax(1), -1) if size else np.full(len(count), -1)
        marks = [m[1].decode().lower() if raw[:1] == b"<" and (m := _MARKUP.search(raw)) else None for raw in (x.lstrip() for x in utf8_list(texts))]
        known = count > 0
        evidence = list_array(found[known].ravel(), np.where(known, size + 1, 0), pa.float64())
        return pa.StructArray.from_arrays([evidence, pa.array(best, pa.int32(), mask=best < 0), pa.array(marks, pa.string())], ["evidence", "best", "markup"])

    where = F.col(quoted(address)) if address else F.lit(None)
    mark, host, suffix, prior = (free_name(df, n) for n in ("weighed", "host_key", "suffix_key", "host_prior"))
    made = df.withColumns({mark: weigh(column), host: host_of(where), suffix: suffix_of(where)})
    claim = F.coalesce(language_of(F.col(mark)["markup"]), language_of(F.col(quoted(declared))) if declared else F.lit(None).cast("string"))
    numbers = F.create_map(*[F.lit(x) for k, n in enumerate(names) for x in (n, k)]) if size else None
    world, true = [], DECLARED
    if size:
        of_label = language_of(F.col(quoted(label or declared or "lang"))) if profiles is None else F.lit(None).cast("string")
        fitted = F.coalesce(_draw(column) < F.try_element_at(F.create_map(*[F.lit(x) for n in names for x in (n, float(shared_profiles.share.get(n, 0.0)))]), of_label), F.lit(False))
        best, said = F.col(mark)["best"], F.try_element_at(numbers, claim)
        sites = made.where(best.isNotNull()).select(F.col(host).alias("host"), F.col(suffix).alias("suffix"), best.alias("best"), F.when(~fitted, (said == best).cast("int")).alias("agrees"))
        counted = stored(sites.groupBy("host", "suffix", "best").agg(F.count(F.lit(1)).alias("n"), F.sum("agrees").alias("agree"), F.count("agrees").alias("asked")))
        asked = counted.agg(F.coalesce(F.sum("agree"), F.lit(0)).alias("agree"), F.coalesce(F.sum("asked"), F.lit(0)).alias("asked")).first()
        true = min(0.99, max(1.0 / size, (asked["agree"] + DECLARED * DECLARED_ROWS) / (asked["asked"] + DECLARED_ROWS)))
        table, world = host_priors(counted, size)
        table = stored(table.select(F.col("host").alias(host), F.col("suffix").alias(suffix), "n", F.col("prior").alias(prior)))
        made = _with_priors(made, table, [host, suffix], prior, F.xxhash64(column), broadcast_hosts)
    else:
        made = made.withColumn(prior, F.lit(None).cast("array<double>"))
    said, own = (free_name(made, n) for n in ("claimed", "suffix_language"))
    weights, known = free_name(df, "weights"), F.size(F.col(mark)["evidence"]) > 0
    if size:
        stands = {s: names.index(n) for s, n in SUFFIXES.items() if n in names}
        lands = F.create_map(*[F.lit(x) for item in stands.items() for x in item]) if stands else F.create_map().cast("map<string,int>")
        made = made.withColumns({said: F.try_element_at(numbers, claim), own: F.try_element_at(lands, F.col(suffix))})
        base, other = F.array(*map(F.lit, world)), (1 - true) / max(1, size - 1)

        def fused(e: Column, k: Column) -> Column:
            by_claim = F.when(F.col(said) == k, float(np.log(true))).when(F.col(said).isNotNull(), float(np.log(max(other, 1e-9)))).otherwise(0.0)
            by_land = F.when(F.col(own) == k, float(np.log(SUFFIX + (1 - SUFFIX) / size))).when(F.col(own).isNotNull(), float(np.log((1 - SUFFIX) / size))).otherwise(0.0)
            return e + F.coalesce(F.get(F.col(prior), k), F.get(base, k)) + float(np.log(1 - BACKGROUND)) + by_claim + by_land

        evidence = F.col(mark)["evidence"]
        none = F.get(evidence, F.lit(size)) + float(np.log(BACKGROUND))
        made = made.withColumn(weights, F.when(known, F.concat(F.transform(F.slice(evidence, 1, size), fused), F.array(none))))
    else:
        made = made.withColumns({weights: F.when(known, F.array(F.lit(float(np.log(BACKGROUND))))), said: F.lit(None), own: F.lit(None)})
    top = F.array_max(weights)
    spoken = F.array(*map(F.lit, [*names, UNKNOWN]))
    out = {
        language: F.when(known, F.element_at(spoken, F.array_position(weights, top).cast("int"))).otherwise(UNKNOWN),
        probability: F.when(known, 1 / F.aggregate(F.transform(weights, lambda w: F.exp(w - top)), F.lit(0.0), lambda a, x: a + x)).otherwise(0.0),
        text_language: F.coalesce(F.element_at(spoken, (F.col(mark)["best"] + 1)), F.lit(UNKNOWN)),
    }
    return with_columns(made, out).drop(mark, host, suffix, prior, weights, said, own)
