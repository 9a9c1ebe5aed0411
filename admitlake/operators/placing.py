"""Places of rows in an order over all of them, and medians, without a task that sees everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written

#: Distinct values that come to the driver; ranges that a value range is cut into.
HELD, RANGES = 10_000, 1024


def placed(df: DataFrame, *order: str | Column, name: str = "place") -> DataFrame:
    """df with each row's place in the order, from 1. Rows equal in all of `order` get different places.

    Rows are sorted by ranges and written; a row's place is its place in its partition and the rows
    of the partitions before, of which there is one count each. Many rows of one value share out
    over partitions if a later column of the order tells them apart.
    """
    at, part = F.monotonically_increasing_id(), F.shiftright("_at", 33)
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at))
    counts = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_part", before.alias("_before"))
    here = F.col("_at") - F.shiftleft(F.col("_part"), 33)
    return rows.withColumn("_part", part).join(F.broadcast(counts), "_part").withColumn(name, here + F.col("_before") + 1).drop("_part", "_at", "_before")


def exact_median(df: DataFrame, column: str) -> float | None:
    """The median, of two middle values their mean; null and NaN count as nothing, and of nothing it is None.

    Values are counted, and the range that holds the middle is cut until it has few distinct values.
    """
    value = F.col(column).cast("double")
    counts = written(df.select(value.alias("v")).where("v is not null and not isnan(v)").groupBy("v").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return None
    return sum(_nth(counts, k) for k in ((total - 1) // 2, total // 2)) / 2


def _nth(counts: DataFrame, k: int) -> float:
    """The k-th (from 0) of values v that stand n times each."""
    while True:
        about = counts.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("distinct")).first()
        if about["distinct"] <= HELD:
            for v, n in sorted(map(tuple, counts.select("v", "n").collect())):
                if k < n:
                    return v
                k -= n
        width = (about["high"] - about["low"]) / RANGES
        place = F.least(F.floor((F.col("v") - about["low"]) / width), F.lit(RANGES - 1))
        for row in sorted(counts.groupBy(place.alias("at")).agg(F.sum("n").alias("n")).collect()):
            if k < row["n"]:
                counts = counts.where(place == row["at"])
                break
            k -= row["n"]
