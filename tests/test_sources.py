"""Sources, sinks, streams, chunks and models on small inputs, against plain Python where there is a rule to repeat."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from admitlake.functions import text
from admitlake.operators import learning, matching
from admitlake.operators.blocks import in_blocks
from admitlake.sources import files
from admitlake.sources.paged import paged_source
from admitlake.streaming import crawl


def loop_chunks(body: str, size: int, carried: int) -> list[str]:
    out, held = [], []
    for s in (s for s in re.split(r"(?<=[.!?])\s+", body) if s.strip()):
        w = s.split()
        if len(w) > size:
            out += [" ".join(held)] if held else []
            held, at = [], 0
            while True:
                out.append(" ".join(w[at : at + size]))
                if at + size >= len(w):
                    break
                at += size - 50
            continue
        if held and sum(len(h.split()) for h in held) + len(w) > size:
            out.append(" ".join(held))
            held = held[-carried:] if carried else []
        held.append(s)
    return out + ([" ".join(held)] if held else [])


@pytest.mark.parametrize("carried", [0, 1, 2])
def test_sentence_chunks(spark, carried):
    r = random.Random(7)
    bodies = [" ".join(" ".join(f"w{r.randrange(9)}" for _ in range(r.choice([1, 5, 20, 70, 300]))) + r.choice([".", "!", "?"]) for _ in range(r.randrange(12))) for _ in range(60)]
    got = spark.createDataFrame([(b,) for b in bodies + [None]], "t string").select("t", text.sentence_chunks(F.col("t"), 80, carried).alias("c")).collect()
    for row in got:
        assert row.c == loop_chunks(row.t or "", 80, carried)


def test_seed_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Website,College_Name\n a.edu , A \nhttps://a.edu,Z\n,B\nc.edu,\nhttp://d.edu,D\n")
    (tmp_path / "b.csv").write_text("name,x\nD,1\nE,2\n")
    assert sorted(map(tuple, files.read_seeds(spark, str(tmp_path / "a.csv")).collect())) == [("A", "https://a.edu"), ("D", "http://d.edu")]
    assert [r.name for r in files.read_names(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).collect()] == ["A", "B", "D", "E", "Z"]
    df = spark.range(3)
    assert files.export(df, str(tmp_path / "o"), "csv") and not files.export(df.limit(0), str(tmp_path / "none"))
    assert spark.read.csv(str(tmp_path / "o"), header=True).count() == 3 and not (tmp_path / "none").exists()
    with pytest.raises(ValueError):
        files.export(df, str(tmp_path / "x"), "xml")


def test_json_in_text(spark):
    df = spark.createDataFrame([('data: {"a": 1}\n\ndata: oops\n\ndata: {"a": 2}\n\n', '```json\n{"a": 3}\n```', '<script id="__NEXT_DATA__" x>{"a": 4}</script>'), (None, "no", "<p>")], "e string, f string, h string")
    one, two = df.select(files.parsed_events(F.col("e"), "a int").alias("e"), files.fenced_json(F.col("f"), "a int").alias("f"), files.embedded_state(F.col("h")).alias("h")).collect()
    assert [x.a for x in one.e] == [1, 2] and one.f.a == 3 and one.h == '{"a": 4}'
    assert two.e is None and two.f is None and two.h is None
    assert spark.range(1).select(files.event_lines(F.col("id"))).first()[0] == 'data: {"id":0}\n\n'


def test_latest_state(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "p"), ("b", 1, "q")], "k string, at int, v string")
    assert sorted(map(tuple, files.latest_state(df, "k", "at").collect())) == [("a", 2, "y"), ("b", 1, "q")]


def test_paged_source(spark):
    def fetch(page, size):
        return (500, 0.0, []) if page == 1 else (200, 0.0, [{"id": page * size + k} for k in range(size if page < 2 else 3)])

    spark.dataSource.register(paged_source("pages_of_ten", fetch, 23, 10))
    got = spark.read.format("pages_of_ten").load().select("page", F.get_json_object("record", "$.id").cast("int").alias("id")).collect()
    assert sorted(r.id for r in got if r.id is not None) == [*range(10), 20, 21, 22]
    assert [r.page for r in got if r.id is None] == [1]


def test_streams(spark, tmp_path):
    rows = [("h", float(t)) for t in [0.0] * 8 + [10.0]] + [("g", 1.0)]
    spark.createDataFrame(rows, "host string, at double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("host string, at double").parquet(str(tmp_path / "in"))
    q = crawl.write_batches(crawl.token_bucket(stream, "host", "at"), str(tmp_path / "out"), str(tmp_path / "check"))
    assert q.awaitTermination(120)
    got = [(r.wait, r.left_over) for r in spark.read.parquet(str(tmp_path / "out")).where("key = 'h'").orderBy("at", "wait", F.desc("left_over")).collect()]
    assert got == [(0.0, k) for k in (5.0, 4.0, 3.0, 2.0, 1.0, 0.0)] + [(0.5, 0.0)] * 2 + [(0.0, 5.0)]
    df = spark.createDataFrame([([1], [2]), ([1], [2, 3]), (None, [1])], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(crawl.aligned(["a", "b"])).collect()] == [True, False, False]


def test_first_copies(spark, tmp_path):
    spark.sql("select id % 3 as k, timestamp'2020-01-01' + make_interval(0, 0, 0, 0, 0, 0, id) as at from range(9)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, at timestamp").parquet(str(tmp_path / "in"))
    assert crawl.write_batches(crawl.first_copies(stream, "k", "at"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2]


def test_matching_and_blocks(spark):
    names = spark.createDataFrame([("University of X - Main Campus",), ("X of University",), ("Universty of Xanadu",), (None,), ("",), ("zzz",)], "name string")
    schools = spark.createDataFrame([("University of X",), ("University of Xanadu",)], "name string")
    got = {r.name: r.school for r in matching.best_matches(names, schools).collect()}
    assert got == {"University of X - Main Campus": "University of X", "X of University": "University of X", "Universty of Xanadu": "University of Xanadu"}
    ids = spark.range(100)
    assert in_blocks(ids.withColumnRenamed("id", "k"), "k", lambda b: ids.join(b, ids.id == b.k), 7).count() == 100


def test_labels(spark):
    df = spark.createDataFrame([("St. John's Col - Main Campus", ["a", "b", "c"])], "n string, l array<string>")
    row = df.select(text.slug(F.col("n")), text.listed(F.col("l")), text.as_percent(F.lit(0.1234)), text.as_money(F.lit(1234.9)), text.as_ratio(F.lit(2.5)), text.outcome(F.lit("Denied")), text.residency(F.lit("Out of state")), text.plain_words(F.lit("a-b, c"))).first()
    assert tuple(row) == ("st-johns-col", "a, b and **c**", "12.3%", "$1,234", "2:1", "rejected", "outOfState", "a b c")


def test_booster_and_calibration(spark):
    df = spark.range(400).selectExpr("id % 2 = 0 as even", "cast(id % 100 as double) as x", "cast(if(id % 7 = 0, null, id % 13) as double) as z", "cast(id % 100 > 50 as double) as y", "if(id % 2 = 0, 'reach', 'safety') as bucket", "1.0 as w")
    models = learning.fit_by_bucket(df, "bucket", ["x", "z"], "y", weight="w", maxIter=2)
    got = learning.scored_by_bucket(models, df.unionByName(df.limit(1).withColumn("bucket", F.lit("none"))), "bucket")
    assert sorted(models) == ["reach", "safety"] and got.where("score is null").count() == 1
    assert got.where("score is not null").agg(F.avg(((F.col("score") > 0.5) == (F.col("y") == 1)).cast("int"))).first()[0] > 0.95
    kind, model = learning.calibrate(got.where("score is not null"), "score", "y")
    assert learning.calibrated(got.where("score is not null"), kind, model, "score").where("calibrated < 0 or calibrated > 1").isEmpty()
