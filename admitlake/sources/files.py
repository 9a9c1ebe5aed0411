"""Seed and name files, exports, event-stream lines, JSON inside pages."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import held

# Header names that a seed file may use.
NAME_HEADERS = ("name", "college_name", "university_name", "school_name")
URL_HEADERS = ("url", "website", "link", "college_url", "university_url")


def _column(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first of the names that df has, whatever its case; null if it has none."""
    have = {c.strip().lower(): c for c in reversed(df.columns)}
    found = next((have[n] for n in names if n in have), None)
    return F.lit(None).cast("string") if found is None else F.trim(F.col(f"`{found}`").cast("string"))


def seeds(df: DataFrame, order: str | None = None) -> DataFrame:
    """(name, url) of rows under any known header: trimmed, https:// before bare addresses, blanks out, one row per address.

    Of equal addresses the first by `order` stays, by name where none is given.
    """
    name, url = _column(df, NAME_HEADERS), _column(df, URL_HEADERS)
    full = F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url))
    rows = df.select(name.alias("name"), F.when(url != "", full).alias("url"), (F.col(order) if order else name).alias("_order"))
    kept = rows.where((F.col("name") != "") & F.col("url").isNotNull())
    return kept.groupBy("url").agg(F.min(F.struct("_order", "name"))["name"].alias("name")).select("name", "url")


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Seeds of one CSV file or of all that a pattern names; headers may differ between files of different calls, not within one."""
    return seeds(spark.read.csv(path, header=True))


def read_names(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Distinct trimmed names of several CSV files, each with headers of its own, in order."""
    found = None
    for path in paths:
        df = spark.read.csv(path, header=True)
        rows = df.select(_column(df, NAME_HEADERS).alias("name"))
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return spark.createDataFrame([], "name string")
    return found.where(F.col("name") != "").distinct().orderBy("name")


def export(df: DataFrame, path: str, fmt: str = "parquet") -> bool:
    """Writes Parquet or CSV; an empty frame writes nothing. Returns whether anything was written."""
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"unknown format: {fmt}")
    if df.isEmpty():
        return False
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)
    return True


def sample_seeds(spark: SparkSession) -> DataFrame:
    """Three seeds to begin with where there is no seed file."""
    return spark.createDataFrame([("Example University", "https://www.example.edu"), ("Sample College", "https://www.sample.edu"), ("Test Institute", "https://www.test.edu")], "name string, url string")


def seeds_or_sample(spark: SparkSession, path: str) -> DataFrame:
    """The seeds of a file or pattern; where there is none, the sample, which is written there first."""
    try:
        return read_seeds(spark, path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        sample = sample_seeds(spark)
        export(sample, path, "csv")
        return sample


def copied(source: DataFrame, path: str, key: str = "id") -> DataFrame:
    """All rows of a store whose key is not blank, written to another, and read there."""
    source.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").write.mode("overwrite").parquet(path)
    return source.sparkSession.read.schema(source.schema).parquet(path)


def golden_set(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The questions of a JSON array."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """(name, school) of a JSON object from name to school; empty where there is no file."""
    try:
        whole = spark.read.text(path, wholetext=True)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], "name string, school string")
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("name", "school"))


def write_overrides(pairs: DataFrame, path: str) -> None:
    """(name, school) as one JSON object; of a name that stands twice the last school by order stays."""
    last = pairs.groupBy("name").agg(F.max("school").alias("school"))
    last.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "school"))))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def origins(configured: Column, defaults: tuple[str, ...]) -> Column:
    """Allowed origins: the configured ones (comma-separated) first, then the defaults, each once."""
    own = F.filter(F.transform(F.split(F.coalesce(configured, F.lit("")), ","), lambda o: F.trim(o)), lambda o: o != "")
    return F.array_distinct(F.concat(own, F.array(*map(F.lit, defaults))))


def latest_state(log: DataFrame, key: str, at: str) -> DataFrame:
    """The newest row of each key of an append-only state log; of equal times, the one of the largest row."""
    newest = Window.partitionBy(key).orderBy(F.desc(at), *[F.desc(c) for c in log.columns if c not in (key, at)])
    return log.withColumn("_place", F.row_number().over(newest)).where("_place = 1").drop("_place")


def event_lines(*columns: Column) -> Column:
    """One server-sent event: a data line with the columns as JSON, and an empty line."""
    return F.concat(F.lit("data: "), F.to_json(F.struct(*columns)), F.lit("\n\n"))


def parsed_events(body: Column, schema: str) -> Column:
    """The data lines of a response as an array of structs; malformed lines are left out."""
    lines = F.filter(F.split(body, r"\r?\n"), lambda s: s.startswith("data: "))
    bodies = F.transform(lines, lambda s: F.substring(s, F.lit(7), F.length(s)))
    sound = F.filter(bodies, lambda s: F.try_parse_json(s).isNotNull())
    return F.transform(sound, lambda s: F.from_json(s, schema))


def embedded_state(html: Column) -> Column:
    """JSON that a page carries for its scripts: the preloaded state, else the next-data element; null if neither is JSON."""
    pattern = (r"(?s)window\.__PRELOADED_STATE__\s*=\s*(\{.*?\})\s*;?\s*</script>", r'(?s)<script[^>]*id="__NEXT_DATA__"[^>]*>\s*(\{.*?\})\s*</script>')
    return F.coalesce(*[held(F.regexp_extract(html, p, 1), lambda x: F.when(F.try_parse_json(x).isNotNull(), x)) for p in pattern])


def fenced_json(answer: Column, schema: str) -> Column:
    """A model's JSON answer, with or without a code fence, as a struct; null if it is none."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.trim(answer), r"^```(?:json)?\s*", ""), r"\s*```$", ""))
    return F.when(F.try_parse_json(plain).isNotNull(), F.from_json(plain, schema))
