"""Filter audit, centroid clustering and source mixing against brute force and SQL, on small and awkward inputs."""

from __future__ import annotations

import hashlib
import heapq
import re
from collections import Counter
from itertools import permutations
from math import ceil, floor, isfinite, log2

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_queries import rows as plain_rows

from admitlake.llm import audit, centroids, mixing, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{k}" for k in range(60))
DOCS = [
    (1, LONG, "a"), (2, LONG, "a"), (2, LONG, "b"), (3, LONG + " #", "a"), (4, None, None), (5, "", ""), (6, " \t\n", "c"), (7, "SHOUTING " * 60, "a"), (8, "one two " * 40, "b"), (None, LONG, "b"),
    (None, None, None), (9, "é😀 Ab | x", "b"), (10, "word " * 30000, "hot"), (11, LONG, "hot"), (11, "Ä" * 200, "hot"), (12, "$", "z"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, 1), (7, 1, None), (None, 1, 1), (99, 1, 1), (11, 1, 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "clash", 1) for r in DOCS], "doc_id long, text string, source string, MASK string, Words int").repartition(3)


def audited(docs, labels):
    """Every order applied to every document, one filter after the other."""
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    ids = {}
    for i, t, _ in docs:
        if i is not None:
            ids[t or ""] = min(i, ids.get(t or "", i))
    fails = {}
    for k, (i, t, _) in enumerate(docs):
        t = t or ""
        w = WORD.findall(t)
        checks = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > ids[t]]
        fails[k] = {c for c, f in zip("ABCDE", checks) if f}
    found, total = {}, Counter()
    for part in {s or "" for _, _, s in docs}:
        for order in permutations("ABCDE"):
            left, gone = [k for k, r in enumerate(docs) if (r[2] or "") == part], []
            for step, f in enumerate(order, 1):
                here = [k for k in left if f in fails[k]]
                redundant, left = sum(f in fails[k] for k in gone), [k for k in left if f not in fails[k]]
                alone = sum(fails[k] == {f} for k, r in enumerate(docs) if (r[2] or "") == part)
                found[part, "".join(order), step] = (len(left), len(here), redundant, alone, *[sum(docs[k][0] in s and docs[k][0] is not None for k in here) for s in (good, toxic)])
                total[part, f] += len(here)
                gone += here
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in found.items()}


def test_audit_is_what_every_order_does(spark, docs):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    found = audit.audit_filters(docs, labels).collect()
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in found} == audited(DOCS, LABELS)
    assert len(found) == 600 * len({s or "" for _, _, s in DOCS})
    assert audit.audit_filters(docs.limit(0), labels).count() == 0
    assert {r["good_lost"] for r in audit.audit_filters(docs, labels.limit(0)).collect()} == {0}


def test_audit_plan_is_native(spark, docs):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    plan = audit.audit_filters(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Nested" not in plan and "Cartesian" not in plan


def clustered(rows, k, rounds, size, scale, seed):
    """The contract, one vector and one centroid at a time."""
    kept = [(i, [floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    found = [list(v) for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(found))

    for _ in range(rounds):
        held = {}
        for _, v in kept:
            held.setdefault(nearest(v)[1], []).append(v)
        for j, own in held.items():
            found[j] = [sum(x) // len(own) for x in zip(*own)]
    out = [(i, *nearest(v)[::-1]) for i, v in kept]
    sums = Counter()
    for _, c, d in out:
        sums[c] += d
    return sorted([(i, c, d, sums[c], sum(sums.values()), found[c]) for i, c, d in out], key=str)


@pytest.mark.parametrize(("k", "rounds", "size"), [(16, 3, 4), (1, 2, 3), (16, 0, 4), (40, 6, 2)])
def test_clusters_are_the_nearest_centroids(spark, k, rounds, size):
    rng = np.random.default_rng(k)
    rows = [(i, np.round(rng.choice([-1.5, 0.25, 2.0], size) + rng.integers(-3, 4, size) / 8, 3).tolist()) for i in range(400)]
    rows += [(i % 7, [0.5] * size) for i in range(150)] + [(None, [1.0] * size), (None, [1.0] * size), (901, None), (902, [0.0] * (size + 1)), (903, []), (904, [float("nan")] * size), (905, [float("inf")] * size), (906, [None] * size)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, Cluster string").repartition(5)
    found = [tuple(r) for r in centroids.cluster_vectors(table, k, rounds, size, 8, 3).collect()]
    assert sorted(found, key=str) == clustered(rows, k, rounds, size, 8, 3)


def test_search_measures_only_the_ball():
    rng = np.random.default_rng(1)
    spots = rng.integers(-2000, 2000, (64, 3))
    v = spots[rng.integers(0, 64, 3000)] + rng.integers(-20, 21, (3000, 3))
    own = centroids.Ball(spots).search(v, np.zeros(3000, np.int64), np.full(3000, np.inf))[0]
    measured, plain = [], centroids._squared

    def counted(a, b):
        measured.append(len(a) * len(b))
        return plain(a, b)

    ball = centroids.Ball(spots)
    upper = np.sqrt(((v - spots[own]) ** 2).sum(1).astype(float)) * (1 + centroids.SAFE)
    centroids._squared = counted
    try:
        again, best, second = ball.search(v, own, upper)
    finally:
        centroids._squared = plain
    far = np.sort(plain(v, spots), axis=1)
    assert (again == own).all() and (best == far[:, 0]).all() and np.allclose(second, np.sqrt(far[:, 1].astype(float)), rtol=1e-9)
    assert sum(measured) < 0.4 * len(v) * len(spots)


def test_large_components_are_exact_or_refused(spark):
    rows = [(1, [1.0e6, -1.0e6]), (2, [1.0e6, 1.0e6]), (3, [1000000.25, -1.0e6])]
    found = centroids.cluster_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 2, 2, 2, 64, 1)
    assert sorted([tuple(r) for r in found.collect()], key=str) == clustered(rows, 2, 2, 2, 64, 1)
    with pytest.raises(Exception, match="larger than"):
        centroids.cluster_vectors(spark.createDataFrame([(1, [1.0e7, 0.0])], "vec_id long, embedding array<double>"), 2, 2, 2, 64, 1).count()
    assert centroids.cluster_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def targets(sizes, share=1.5, most=2, weights=(5, 2, 1)):
    """Water-filling as the contract says it: share out, cut, reshare what is left."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight, full = {s: weights[k % len(weights)] for k, s in enumerate(order)}, set()
    while True:
        left, open_ = share * sum(sizes.values()) - sum(most * sizes[s] for s in full), [s for s in order if s not in full]
        rate = left / sum(weight[s] for s in open_) if open_ else 0
        above = {s for s in open_ if weight[s] * rate > most * sizes[s]}
        if not above:
            return {s: most * sizes[s] if s in full else weight[s] * rate for s in order}
        full |= above


def highest_quotients(votes, seats):
    heap, got = [(-v, k, 0) for k, v in enumerate(votes) if v > 0], [0] * len(votes)
    heapq.heapify(heap)
    for _ in range(seats if heap else 0):
        _, k, s = heapq.heappop(heap)
        got[k] += 1
        heapq.heappush(heap, (-votes[k] / (2 * s + 3), k, s + 1))
    return got


@pytest.mark.parametrize("shard", [1 << 24, 40])
def test_mix_comes_near_its_targets(spark, docs, shard):
    found = [r.asDict() for r in mixing.mix_sources(docs, shard=shard).collect()]
    sizes = Counter()
    for _, t, s in DOCS:
        sizes[s] += len(WORD.findall(t or ""))
    want = targets(sizes)
    assert sorted([(r["doc_id"], r["source"], r["size"]) for r in found], key=str) == sorted([(i, s, len(WORD.findall(t or ""))) for i, t, s in DOCS], key=str)
    assert all(r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]]) for r in found)
    assert all(0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"] + r["part"] for r in found)
    taken = Counter()
    for r in found:
        taken[r["source"]] += r["taken"]
    block = mixing.block_words(min(t for t in want.values() if t > 0))
    quota = highest_quotients([want[s] for s in want], int(1.5 * sum(sizes.values()) / block + 0.5))
    for s, q in zip(want, quota):
        shards = len({r["shard"] for r in found if r["source"] == s})
        assert min(q * block, 2 * sizes[s]) - shards * block <= taken[s] <= q * block and abs(taken[s] - want[s]) <= (shards + 1) * block
    again = [r.asDict() for r in mixing.mix_sources(docs.repartition(5), shard=shard).collect()]
    assert sorted(map(str, found)) == sorted(map(str, again))
    for key in {(r["source"], r["shard"]) for r in found}:
        cut = [r for r in found if (r["source"], r["shard"]) == key and r["part"]]
        assert len(cut) <= 1


def test_many_sources_and_nothing(spark):
    rng = np.random.default_rng(3)
    rows = [(k, " ".join("w" * int(n)), f"s{rng.integers(0, 60)}") for k, n in enumerate(rng.integers(0, 90, 900))]
    found = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), shard=200).groupBy("source", "target").agg(F.sum("taken").alias("taken"), F.max("shard").alias("shards")).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = targets(sizes)
    block = mixing.block_words(min(t for t in want.values() if t > 0))
    for r in found:
        assert r["target"] == pytest.approx(want[r["source"]]) and abs(r["taken"] - r["target"]) <= (r["shards"] + 2) * block
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_sources(none).count() == 0
    blank = spark.createDataFrame([(1, " ", "a"), (None, None, None)], "doc_id long, text string, source string")
    assert [(r["size"], r["target"], r["taken"]) for r in mixing.mix_sources(blank).collect()] == [(0, 0.0, 0)] * 2


@pytest.mark.parametrize("seats", [0, 1, 7, 100, 5000])
def test_seats_go_to_the_highest_quotients(spark, seats):
    rng = np.random.default_rng(seats)
    votes = [float(v) for v in rng.integers(0, 40, 50)] + [1000.0, 0.5, 0.5]
    table = spark.createDataFrame([("g", k, v, seats) for k, v in enumerate(votes)] + [("h", k, v, 3) for k, v in enumerate((2.0, 2.0, 2.0, 1.0))], "g string, k int, v double, seats long")
    want = {("g", k): q for k, q in enumerate(highest_quotients(votes, seats))} | {("h", k): q for k, q in enumerate(highest_quotients([2.0, 2.0, 2.0, 1.0], 3))}
    assert {(r["g"], r["k"]): r["quota"] for r in mixing.apportioned(table, "g", "v", "k").collect()} == want
    one = mixing.apportioned(table.where("g = 'g'"), None, "v", "k").collect()
    assert {(r["g"], r["k"]): r["quota"] for r in one} == {k: q for k, q in want.items() if k[0] == "g"}


def test_taken_words_are_the_document_and_its_start(spark):
    row = spark.createDataFrame([("a b\n c d", 1, 3), ("a b", 2, 0), (None, 0, 0)], "t string, c int, p long")
    assert [r[0] for r in row.select(mixing.taken_words(F.col("t"), F.col("c"), F.col("p"))).collect()] == [["a b\n c d", "a b c"], ["a b", "a b"], []]
    assert mixing.block_words(None) == 1 and all(mixing.block_words(t) == 2 ** max(0, min(10, floor(log2(t / 64)))) for t in (64, 127, 128, 5000, ceil(1e9)))


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_centroids", "op13_source_mix"])
def test_queries_agree_with_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.SQL[name]).df()
    assert plain_rows(got) == plain_rows(want)
