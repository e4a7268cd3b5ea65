"""Stored indexes against brute force: exact results, and how much of the index a query reads."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from docloom.operators import nearest, postings
from docloom.sources.tables import kept, new_dir


def vectors(spark, points, first=0, part=lambda i: "a"):
    rows = [(first + i, None if p is None else [None if x is None else float(x) for x in p], part(i), 7) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "chunk_id long, vector array<float>, kb string, block int")


def asked(df, step=40):
    return df.filter(f"chunk_id % {step} = 0").withColumnRenamed("chunk_id", "query_id")


def brute(rows, queries, k, same=False):
    good = [(i, np.array(v, float), kb) for i, v, kb, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for i, q, kb in [(i, v, kb) for i, v, kb in good if i in queries]:
        scores = sorted((-round(float(np.dot(q, v)), 6), j) for j, v, other in good if not same or kb == other and kb is not None)
        out |= {(i, n + 1): (j, -s) for n, (s, j) in enumerate(scores[:k])}
    return out


def result(df):
    return {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in df.collect()}


def close(got, want):
    assert got.keys() == want.keys()
    for key, (i, s) in want.items():
        assert got[key][0] == i and abs(got[key][1] - s) < 2e-6


@pytest.fixture(scope="module")
def clustered():
    r = np.random.default_rng(7)
    centres = r.normal(size=(50, 12)) * 3
    return (centres[np.arange(3_000) % 50] + 0.1 * r.normal(size=(3_000, 12))).astype(np.float32)


def test_vectors_of_clusters_read_under_a_fifth(spark, clustered):
    rows = vectors(spark, clustered)
    index = nearest.build(rows, new_dir(spark, "test"), block=32)
    queries = asked(rows)
    best, seen = nearest.searched(index, queries, 10)
    close(result(best), brute([tuple(r) for r in rows.collect()], {r.query_id for r in queries.collect()}, 10))
    scored = seen.join(index.blocks(), "block").selectExpr("sum(n) as n").first()["n"]
    assert 0 < scored < 0.2 * queries.count() * rows.count()
    assert seen.count() == seen.distinct().count()
    sizes = index.blocks().selectExpr("max(n) as most", "sum(n) as n").first()
    assert sizes["most"] <= 32 and sizes["n"] == 3_000


def test_vectors_without_order_ties_and_repeats(spark):
    r = np.random.default_rng(8)
    points = [*np.round(r.normal(size=(700, 6)), 1), *[np.ones(6)] * 300, *np.zeros((20, 6))]
    rows = vectors(spark, points)
    index = nearest.build(rows, new_dir(spark, "test"), block=8)
    close(result(nearest.search(index, asked(rows, 100), 7)), brute([tuple(x) for x in rows.collect()], set(range(0, 1020, 100)), 7))


def test_vectors_in_parts_and_added_later(spark):
    r = np.random.default_rng(9)
    part = lambda i: [None, "a", "b", "b", "b", "c"][i % 6] if i != 5 else "alone"
    first = vectors(spark, r.normal(size=(400, 5)), part=part)
    odd = [None, [1, None, 2, 3, 4], [float("nan")] * 5, [float("inf")] * 5, *r.normal(size=(200, 5))]
    second = vectors(spark, odd, 400, part)
    index = nearest.build(first, new_dir(spark, "test"), "kb", block=16).add(second, "kb", 16)
    rows = [tuple(x) for x in first.unionByName(second).collect()]
    queries = first.unionByName(second).filter("chunk_id % 5 = 0").withColumnRenamed("chunk_id", "query_id")
    close(result(nearest.search(index, queries, 30, "kb")), brute(rows, set(range(0, 604, 5)), 30, True))
    assert nearest.search(index, queries.filter("false"), 3, "kb").count() == 0
    empty = nearest.build(first.filter("false"), new_dir(spark, "test"))
    assert nearest.search(empty, queries, 3).count() == 0


WORD = re.compile(r"[^\W_]+")


def texts(spark, n, first=0, seed=1):
    r = random.Random(seed)
    common, rare = [f"w{i}" for i in range(30)], [f"Rare{i}" for i in range(400)]
    one = lambda: " ".join(r.choice(rare) if r.random() < 0.15 else r.choice(common) for _ in range(r.choice([3, 8, 20, 80])))
    rows = [(first + i, None if i == 3 else "" if i == 4 else one(), None if i == 7 else f"kb{i % 4}", 1) for i in range(n)]
    return spark.createDataFrame(rows, "chunk_id long, content string, kb string, bucket int")


def bm25(rows, queries, k, same=False):
    docs = {i: (Counter(WORD.findall((c or "").lower())), kb) for i, c, kb, _ in rows}
    n, mean = len(docs), sum(sum(t.values()) for t, _ in docs.values()) / len(docs)
    df = Counter(x for t, kb in docs.values() if not same or kb is not None for x in t)
    out = {}
    for q, text, kb in queries:
        scores = []
        for i, (t, other) in docs.items():
            hit = [x for x in set(WORD.findall((text or "").lower())) if x in t]
            if hit and (not same or kb == other and kb is not None):
                length = sum(t.values())
                s = sum(math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * t[x] * 2.2 / (t[x] + 1.2 * (0.25 + 0.75 * length / mean)) for x in hit)
                scores.append((-round(s, 6), i))
        out |= {(q, r + 1): (i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])}
    return out


def test_postings_read_ranges_by_bounds(spark):
    rows = texts(spark, 900)
    index = postings.build(rows, new_dir(spark, "test"), size=16)
    wanted = [(1, "RARE7 rare9 rare7", "kb1"), (2, "rare1", "kb1"), (3, "rare200 rare201 rare202 rare203", "kb2"), (4, "unheard of", "kb1"), (5, None, "kb1"), (6, "", "kb1"), (7, "w1 w2", None), (8, "rare11 w3", "kb3")]
    queries = spark.createDataFrame(wanted, "query_id long, query string, kb string")
    data = [tuple(r) for r in rows.collect()]
    best, seen = postings.searched(index, queries, 5)
    close(result(best), bm25(data, wanted, 5))
    assert seen.count() == seen.distinct().count() < 0.6 * index.ranges().count() * 6
    again = postings.load(spark, index.folder)
    for near in (1, 1_000):  # the last takes all ranges at once
        close(result(postings.searched(again, queries, 50, near=near)[0]), bm25(data, wanted, 50))


def test_postings_in_parts_and_added_later(spark):
    first, second = texts(spark, 300), texts(spark, 200, 300, seed=2)
    index = postings.build(first, new_dir(spark, "test"), "kb", size=8).add(second, "kb", 8)
    wanted = [(1, "rare7 rare9 w1", "kb1"), (2, "rare1", "kb0"), (3, "w5", "kb3"), (4, "w5", "no such"), (5, "w5", None)]
    queries = spark.createDataFrame(wanted, "query_id long, query string, kb string")
    data = [tuple(r) for r in first.unionByName(second).collect()]
    close(result(postings.search(index, queries, 9, "kb")), bm25(data, wanted, 9, True))
    assert index.ranges().selectExpr("sum(n) as n").first()["n"] == 500
    none = postings.build(first.filter("false"), new_dir(spark, "test"))
    assert postings.search(none, queries, 3).count() == 0


def test_what_is_kept_is_made_once(spark):
    made = []
    make = lambda folder: made.append(spark.range(3).write.parquet(folder))
    name = f"kept-{random.random()}"
    folders = {kept(spark, name, make) for _ in range(3)}
    assert len(folders) == 1 and len(made) == 1 and spark.read.parquet(folders.pop()).count() == 3
