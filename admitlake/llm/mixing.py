"""Mixing sources to target weights: blocks of words dealt to sources, and within them to shards, by highest quotients.

Targets come from water-filling: each source's weight shares out the words of the mix, no source beyond
`most` times its size. Sainte-Laguë apportionment turns targets into whole numbers of equal blocks: the
seat after s seats goes to the highest votes / (2 s + 1). A source's blocks are apportioned again among
its shards by their words. In a shard, documents stand end to end in an order that a seed fixes, and the
shard's blocks are the first ones there, starting anew where the words end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.placing import placed
from .common import stored, words_of

WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 1.5, 2, 13
#: Words and rows that a shard holds about; buckets that shards are made of; most words of a block, and how many blocks the smallest target has at least where blocks are longer than one word.
SHARD, BUCKETS, BLOCK, LEAST_BLOCKS = 1 << 18, 1 << 16, 1024, 64


def source_targets(sources: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sources (skey, known, source, words) with `place`, `weight` and `target`.

    Sources take the weights in turn, by code points, the null source last. Together they get share
    times all words; none gets more than most times its own, and what it leaves goes to the others by
    weight, until none is above. The rate of words for each weight rises from round to round, so a round
    is one aggregate of a few sums; there are at most as many as sources.
    """
    if share > most:
        raise ValueError("a mix cannot hold more than most times all words")
    turn = F.array(*map(F.lit, weights))
    placed_ = stored(placed(sources, F.desc("known"), "source").withColumn("weight", F.element_at(turn, ((F.col("place") - 1) % len(weights) + 1).cast("int"))))
    every = placed_.agg(F.sum("words").alias("words"), F.sum("weight").alias("weight")).first()
    all_words, rate, before = every["words"] or 0, (share * every["words"] / every["weight"] if every["words"] else 0.0), None
    while rate != before:
        above = F.col("weight") * F.lit(rate) > most * F.col("words")
        sums = placed_.agg(F.sum(F.when(above, most * F.col("words")).otherwise(0)).alias("full"), F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("open")).first()
        before, rate = rate, (share * all_words - sums["full"]) / sums["open"] if sums["open"] else rate
    return placed_.withColumn("target", F.least(F.col("weight") * F.lit(rate), (most * F.col("words")).cast("double")))


def apportioned(units: DataFrame, group: str | None, votes: str, order: str) -> DataFrame:
    """units with `quota`: the group's `seats` given to its units by highest quotients votes / (2 s + 1), of equal ones by `order`.

    group: the column that units of a group share; None makes all units one group, ranked without a
    task that sees them all. Seats that a unit has under any divisor that can come out are not ranked:
    about four for each unit are. Units without votes get none; order must differ within a group.
    """
    part = Window.partitionBy(*([group] if group else []))
    if group:
        sums = [F.sum(votes).over(part), F.sum(F.when(F.col(votes) > 0, 1).otherwise(0)).over(part)]
    else:
        about = units.agg(F.sum(votes), F.sum(F.when(F.col(votes) > 0, 1).otherwise(0))).first()
        sums = [F.lit(float(about[0] or 0)), F.lit(about[1] or 0)]
    known = units.withColumns({"_votes": F.col(votes).cast("double"), "_all": sums[0].cast("double"), "_units": sums[1]})
    low = F.greatest(F.floor(F.col("_votes") * (F.col("seats") - F.col("_units") / 2) / F.col("_all") - 1.5), F.lit(0))
    high = F.ceil(F.col("_votes") * (F.col("seats") + F.col("_units") / 2) / F.col("_all") + 1.5)
    known = known.withColumns({"_low": F.when(F.col("_votes") > 0, low).otherwise(0).cast("long"), "_high": F.when(F.col("_votes") > 0, high).otherwise(0).cast("long")})
    if not group:
        known = stored(known)
        sure = F.lit(known.agg(F.sum("_low")).first()[0] or 0)
    else:
        sure = F.sum("_low").over(part)
    seats = known.where("_votes > 0 and seats > 0").withColumn("_left", F.col("seats") - sure).withColumn("_seat", F.explode(F.sequence("_low", F.col("_high") - 1)))
    seats = seats.withColumn("_quotient", F.col("_votes") / (2 * F.col("_seat") + 1))
    ranked = placed(seats, F.desc("_quotient"), order, "_seat", name="_rank") if not group else seats.withColumn("_rank", F.row_number().over(part.orderBy(F.desc("_quotient"), order)))
    key = [group, order] if group else [order]
    won = ranked.where(F.col("_rank") <= F.col("_left")).groupBy(*key).agg(F.count(F.lit(1)).alias("_won"))
    quota = F.when((F.col("_votes") > 0) & (F.col("seats") > 0), F.col("_low") + F.coalesce("_won", F.lit(0))).otherwise(0)
    return known.join(won, key, "left").withColumn("quota", quota.cast("long")).drop("_votes", "_all", "_units", "_low", "_high", "_won")


def block_words(smallest: float | None) -> int:
    """Words of a block: the largest power of two up to BLOCK of which the smallest target above 0 holds LEAST_BLOCKS, or 1."""
    size = 1
    while 2 * size <= BLOCK and 2 * size * LEAST_BLOCKS <= (smallest or 0):
        size *= 2
    return size


def _drawn(seed: int) -> Column:
    """64 hexadecimal digits that a row's id and the seed fix; rows without an id go by their text."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.sha2(F.coalesce("text", F.lit("")), 256)))
    return F.sha2(F.concat(F.lit(f"{seed}:"), name), 256)


def mix_sources(docs: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, shard, copies, part, taken) of every row of docs (doc_id, text, source).

    The mix takes a document `copies` times whole and once more its first `part` words: taken =
    copies * size + part, at most most * size; whole documents but for one in each shard. Sums by source
    differ from the target by about a block, of which the smallest target has LEAST_BLOCKS at least.
    size counts words, of a null text 0; such a document is never taken. The null source is one of its
    own, other than the empty one. Rows that repeat an id are taken for themselves; which of them is cut
    follows from size. No documents, no rows. Columns besides the three are passed over. The same rows
    give the same mix, however they are dealt out.
    """
    bucket = F.conv(F.substring("drawn", 1, 4), 16, 10).cast("int") % BUCKETS
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))  # equal for null sources, too
    rows = docs.select("doc_id", "source", F.size(words_of(F.col("text"))).cast("long").alias("size"), _drawn(seed).alias("drawn"))
    rows = stored(rows.select("doc_id", "source", "size", "drawn", key.alias("skey"), bucket.alias("bucket")))
    buckets = stored(rows.groupBy("skey", "bucket").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"), F.first("source").alias("source")))
    sources = buckets.groupBy("skey").agg(F.sum("words").alias("words"), F.sum("n").alias("n"), F.first("source").alias("source")).withColumn("known", F.col("source").isNotNull())
    targets = stored(source_targets(sources, share, most, weights))
    about = targets.agg(F.sum("words").alias("words"), F.min(F.when(F.col("target") > 0, F.col("target"))).alias("least")).first()
    block = block_words(about["least"])
    seats = int(share * (about["words"] or 0) / block + 0.5)
    dealt = apportioned(targets.withColumn("seats", F.lit(seats).cast("long")), None, "target", "place")
    needed = F.ceil((F.col("words") + F.col("n")) / F.lit(float(shard)))
    shards = F.least(F.pow(F.lit(2.0), F.ceil(F.log2(needed.cast("double")))), F.lit(float(BUCKETS))).cast("int")
    dealt = dealt.select("skey", "target", F.col("words").alias("source_size"), F.col("quota").alias("seats"), shards.alias("shards"))
    cut = stored(buckets.select("skey", "bucket", "words").join(dealt, "skey").withColumn("shard", F.col("bucket") % F.col("shards")))
    units = cut.groupBy("skey", "shard").agg(F.sum("words").alias("shard_words"), F.first("seats").alias("seats"))
    quotas = apportioned(units, "skey", "shard_words", "shard").select("skey", "shard", "shard_words", "quota")
    told = cut.select("skey", "bucket", "shard", "target", "source_size").join(quotas, ["skey", "shard"])
    whole = rows.join(told, ["skey", "bucket"])
    before = F.coalesce(F.sum("size").over(Window.partitionBy("skey", "shard").orderBy("drawn", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = whole.withColumn("before", before)
    takes = F.least(F.col("quota") * block, most * F.col("shard_words"))
    laps = F.when(F.col("shard_words") > 0, F.expr(f"least(quota * {block}, {most} * shard_words) div greatest(shard_words, 1L)")).otherwise(0)
    part = F.greatest(F.least(takes - laps * F.col("shard_words") - F.col("before"), F.col("size")), F.lit(0))
    whole = whole.select("doc_id", "source", "size", "source_size", "target", "shard", laps.cast("int").alias("copies"), part.cast("long").alias("part"))
    full = (F.col("part") == F.col("size")) & (F.col("size") > 0)
    whole = whole.withColumns({"copies": F.col("copies") + F.when(full, 1).otherwise(0), "part": F.when(full, 0).otherwise(F.col("part"))})
    return whole.withColumn("taken", F.col("copies") * F.col("size") + F.col("part"))


def taken_words(text: Column, copies: Column, part: Column) -> Column:
    """What the mix takes of a text, as a list of texts: its copies, and its first words where a part is taken."""
    first = F.array(F.array_join(F.slice(words_of(text), F.lit(1), part.cast("int")), " "))
    return F.concat(F.array_repeat(F.coalesce(text, F.lit("")), copies), F.when(part > 0, first).otherwise(F.array().cast("array<string>")))
