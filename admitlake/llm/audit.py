"""What five document filters remove in each of their 120 orders, from a histogram of failure masks.

Whether a filter fails a document does not depend on the order of filters, so a document is one of 32
masks. Native expressions build the mask; the copy filter takes the smallest id of each text from a
grouped aggregate. Counts by part and mask (at most 32 cells a part) hold all that any order needs.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, words_of

FILTERS = "ABCDE"
#: Fewest words; distinct words and capital letters in hundredths; characters of junk.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, JUNK = 50, 65, 5, r"[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_COPY = 1 << FILTERS.index("E")


def failure_masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of every row of docs (doc_id, text, source): bit k of mask is set if filter k of FILTERS fails the text.

    A: fewer than 50 words; B: fewer than 65 % of the words distinct; C: more than 5 % of the code points
    are capital letters A-Z; D: it holds one of # $ % & * |; E: a smaller doc_id has the same text. Null
    text counts as empty, a null source as the empty part. A row without an id neither is nor makes a
    copy; rows that repeat an id are copies of other ids only, and each counts. Texts are told apart by
    their SHA-256. Columns besides the three are passed over.
    """
    text = F.coalesce("text", F.lit(""))
    read = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"), words_of(text).alias("words"))
    failed = [
        F.size("words") < LEAST_WORDS,
        100 * F.size(F.array_distinct("words")) < LEAST_DISTINCT * F.size("words"),
        100 * (F.char_length("text") - F.char_length(F.translate("text", CAPITALS, ""))) > MOST_CAPITALS * F.char_length("text"),
        F.col("text").rlike(JUNK),
    ]
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failed)), F.lit(0))
    rows = stored(read.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.cast("int").alias("mask")))
    named = rows.where("doc_id is not null")
    # Joined on text and id, so that the copies of one text share out over partitions.
    first = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copies = named.join(first, ["digest", "doc_id"], "left").select("doc_id", "part", F.when(F.col("first"), F.col("mask")).otherwise(F.col("mask") + _COPY).alias("mask"))
    return copies.unionByName(rows.where("doc_id is null").select("doc_id", "part", "mask"))


def mask_cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of a mask, those with a label of quality 1 and those with one of toxic 1.

    An id with several labels is good or toxic if one of them says so; labels without an id count for none.
    """
    said = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    count = lambda c: F.count(F.when(F.col(c), 1)).alias(c)
    known = masks.where("doc_id is not null").join(said, "doc_id", "left").select("part", "mask", "good", "toxic")
    unknown = masks.where("doc_id is null").select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    return known.unionByName(unknown).groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), count("good"), count("toxic"))


def filter_orders(cells: DataFrame) -> DataFrame:
    """For every part, order of FILTERS and step what the step's filter does, from cells (part, mask, n, good, toxic).

    kept after the step; removed by it; redundant: failing it but gone before; unique_fails: failing it
    alone; good_lost and toxic_lost among the removed; shapley: removed by this filter, summed over all
    orders. A document of m failures is removed by each of its filters in 120 / m orders, which is that sum.
    """
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = parts.select("part", "cells", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    place = {k: F.instr("filter_order", letter) for k, letter in enumerate(FILTERS)}
    bits = lambda held: sum((F.when(held(at), 1 << k).otherwise(0) for k, at in place.items()), F.lit(0))
    steps = steps.select("*", bits(lambda at: at == F.col("step")).alias("own"), bits(lambda at: at < F.col("step")).alias("before"))
    own, before = F.col("own"), F.col("before")

    def total(name: str, of: str, holds) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda t, c: t + F.when(holds(c["mask"]), c[of]).otherwise(0)).alias(name)

    here = lambda m: (m.bitwiseAND(before) == 0) & (m.bitwiseAND(own) != 0)
    each = F.array(*[F.lit(0)] + [F.lit(120 // m) for m in range(1, 6)])  # orders in which a given one of m filters comes first
    shapley = F.aggregate("cells", F.lit(0).cast("long"), lambda t, c: t + F.when(c["mask"].bitwiseAND(own) != 0, c["n"] * each[F.bit_count(c["mask"])]).otherwise(0))
    return steps.select(
        "part", "filter_order", "step", total("kept", "n", lambda m: m.bitwiseAND(before.bitwiseOR(own)) == 0), total("removed", "n", here),
        total("redundant", "n", lambda m: (m.bitwiseAND(before) != 0) & (m.bitwiseAND(own) != 0)), total("unique_fails", "n", lambda m: m == own),
        total("good_lost", "good", here), total("toxic_lost", "toxic", here), shapley.alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """filter_orders over all of docs (doc_id, text, source) and labels (doc_id, quality, toxic); no documents, no rows."""
    return filter_orders(mask_cells(failure_masks(docs), labels))
