"""Reports on a corpus of records and what they lead to: deletions, renames, merges of keys, reshaped tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import canonical_key
from ..storage import tasks_for
from .placing import placed


def duplicate_report(df: DataFrame, group: str, url: str, digest: str) -> DataFrame:
    """Per group: rows, addresses of two rows or more with a repeated digest, and rows beyond the first of each (address, digest). Blank addresses count as one. Rows are shuffled once by address, to as many tasks as their size asks for."""
    rows = df.select(group, F.coalesce(url, F.lit("")).alias("_url"), digest)
    each = rows.repartition(tasks_for(df), group, "_url").groupBy(group, "_url", digest).agg(F.count(F.lit(1)).alias("n"))
    by_url = each.groupBy(group, "_url").agg(F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("extra"))
    return by_url.groupBy(group).agg(
        F.sum("n").alias("total"), F.sum((F.col("extra") > 0).cast("long")).alias("urls_with_duplicates"), F.sum("extra").alias("duplicates"), F.count(F.lit(1)).alias("unique_urls")
    )


def duplicates_by_url(df: DataFrame, url: str, digest: str) -> DataFrame:
    """Addresses with repeated rows, and how many."""
    each = df.groupBy(url, digest).agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy(url).agg(F.sum(F.col("n") - 1).alias("duplicates")).where("duplicates > 0")


def extra_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The rows to delete: of each group of equal keys all but the first in the order."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_place > 1").drop("_place")


def without_groups(df: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """df without all rows of the keys in gone; rows with a null key stay."""
    return df.join(gone.select(key).distinct(), key, "left_anti")


def foreign_rows(df: DataFrame, host: Column, suffix: str) -> DataFrame:
    """The rows to delete: whose host does not end with the suffix. Null hosts (blank addresses) stay, empty ones (no address at all) go."""
    return df.where(host.isNotNull() & ~F.endswith(host, F.lit(suffix)))


def renamed_values(df: DataFrame, column: str, pairs: DataFrame) -> DataFrame:
    """df with each value of `column` that stands in pairs (old, new) renamed; blank pairs and pairs of equal values count as none, of several new values the least stands."""
    real = pairs.where("trim(old) <> '' and trim(new) <> '' and old <> new").groupBy(F.col("old").alias("_old")).agg(F.min("new").alias("_new"))
    return df.join(real, F.col(column) == F.col("_old"), "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")


def last_by_key(df: DataFrame, key: Column, value: str, *order: Column, name: str = "key") -> DataFrame:
    """(key, value): of rows with one key the value of the last in the order, as writing them one by one into a dictionary leaves it."""
    place = F.row_number().over(Window.partitionBy(name).orderBy(*[o for o in order]))
    rows = df.select(key.alias(name), F.struct("*").alias("_row")).select(name, "_row.*").where(f"`{name}` is not null")
    last = F.count(F.lit(1)).over(Window.partitionBy(name))
    return rows.withColumn("_place", place).withColumn("_last", last).where("_place = _last").select(name, value)


def fanned_out(wanted: DataFrame, index: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Every wanted name with its facts: names are resolved to ids, facts fetched once for each id, and handed to every spelling.

    wanted: (name); index: (name, key); facts: one row for each key. Names without an id are left out.
    """
    resolved = wanted.select("name").distinct().join(index, "name")
    fetched = facts.join(resolved.select(key).distinct(), key, "left_semi")
    return resolved.join(fetched, key)


def majority(df: DataFrame, group: str, value: str) -> DataFrame:
    """Each group's most frequent value that is not null, of equals the least."""
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(group).agg(F.min_by(value, F.struct((-F.col("n")).alias("n"), F.col(value))).alias(value), F.max("n").alias("n"))


def migrated(df: DataFrame, rename: dict[str, str], add: dict[str, str], drop: tuple[str, ...] = ()) -> DataFrame:
    """df under a newer schema: columns renamed where the new name is not there yet, missing columns added as nulls, old ones dropped. A second run changes nothing."""
    out = df
    for old, new in rename.items():
        if old in out.columns and new not in out.columns:
            out = out.withColumnRenamed(old, new)
    for name, kind in add.items():
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    return out.drop(*drop)


def new_links(links: DataFrame, *known: DataFrame) -> DataFrame:
    """Links (url) that none of the known sets of addresses holds, each once."""
    out = links.select("url").where("url is not null").distinct()
    for k in known:
        out = out.join(k.select("url"), "url", "left_anti")
    return out


def tallied(log: DataFrame, **counters: Column) -> DataFrame:
    """One row of counters: how many rows of the log meet each condition."""
    return log.agg(*[F.count_if(c).alias(n) for n, c in counters.items()])


def accuracies(df: DataFrame, **checks: Column) -> DataFrame:
    """One row: the share of rows that pass each check, over the rows where it is not null, and how many rows there are."""
    return df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c.cast("int")).alias(name) for name, c in checks.items()])


def paced(log: DataFrame, key: str, at: str, order: str, delay: float) -> DataFrame:
    """Per row the moment it may start if rows of one key start at least `delay` apart, in the order of arrival: the latest of what earlier rows allow.

    A row waits for the row before it: start(k) = max(at(k), start(k - 1) + delay), so start(k) is k * delay and the greatest at(j) - j * delay of the rows so far.
    """
    w = Window.partitionBy(key).orderBy(at, order)
    k = F.row_number().over(w) - 1
    rows = log.withColumn("_k", k).withColumn("_slack", F.col(at) - F.col("_k") * delay)
    return rows.withColumn("start", F.max("_slack").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("_k") * delay).drop("_k", "_slack")


def newest_first(df: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first rows of the order: a list of stated size."""
    return df.orderBy(*order).limit(most)


def options(names: DataFrame, typed: str, chosen: DataFrame, most: int = 100) -> DataFrame:
    """Names that hold what is typed, in any case, without those chosen already, in order whatever their case; the first `most`."""
    found = names.select("name").distinct().where(F.lower("name").contains(typed.lower()))
    return found.join(chosen.select("name"), "name", "left_anti").orderBy(F.lower("name"), "name").limit(most)


def renamed_by_url(known: DataFrame, other: DataFrame) -> DataFrame:
    """(name, other_name, key): rows of known and other (name, url, place) that share an address, under names which differ by more than case.

    Addresses are compared by canonical_key; of several rows of other with one address the first by place counts. Rows without an address meet none.
    """
    key = F.nullif(canonical_key(F.col("url")), F.lit(""))
    first = other.select(key.alias("key"), "name", "place").where("key is not null").groupBy("key").agg(F.min_by("name", F.struct("place", "name")).alias("other_name"))
    rows = known.select("name", key.alias("key")).join(first, "key").where(F.lower("name") != F.lower("other_name"))
    return rows.select("name", "other_name", "key")


def option_list(rows: DataFrame, column: str, fallback: tuple[str, ...]) -> DataFrame:
    """The distinct trimmed values of a column that are not blank, as `option`; if there are none, the fallback."""
    found = rows.select(F.trim(column).alias("option")).where("option <> ''").distinct()
    none = found.limit(1).agg(F.count(F.lit(1)).alias("n"))
    spare = none.where("n = 0").select(F.explode(F.array(*map(F.lit, fallback))).alias("option"))
    return found.unionByName(spare)


def skipped_first(work: DataFrame, done: DataFrame, key: str, size: str) -> DataFrame:
    """What of the work is done already, with its `place` by rising size, those without a size first; of equals by key."""
    return placed(work.join(done.select(key).distinct(), key, "left_semi"), F.asc_nulls_first(size), key)
