"""Sketches by step: rollups and windows against all rows, late rows, null and empty input."""

import datetime
import random

from docloom.operators import sketches

SCHEMA = "g string, at timestamp, v double, k long"
START = datetime.datetime(2024, 1, 1)


def rows(n, seed, days=40):
    rng = random.Random(seed)
    return [(rng.choice(["a", "a", "b", None]), START + datetime.timedelta(minutes=rng.randrange(days * 1440)), rng.gammavariate(2, 10), rng.randrange(3000)) for _ in range(n)]


def windows(spark, *spans):
    first = int((START - datetime.datetime(1970, 1, 1)).total_seconds()) // 60
    return spark.createDataFrame([(i, first + a, first + b) for i, (a, b) in enumerate(spans)], "window_id long, start long, end long")


SPANS = ((0, 40 * 1440), (17, 18), (59, 61), (30, 5000), (1441, 2880), (700, 700), (1439, 30 * 1440 + 7))


def table(spark, data):
    return sketches.levels(sketches.by_step(spark.createDataFrame(data, SCHEMA), "g", "at", "v", "k"))


def agrees(found, data):
    """Each figure of each window against the rows themselves."""
    expected = {}
    for g, at, v, k in data:
        minute = int((at - START).total_seconds()) // 60
        for i, (a, b) in enumerate(SPANS):
            if a <= minute < b:
                expected.setdefault((g, i), []).append((v, k))
    assert {(r["group"], r["window_id"]) for r in found} == set(expected)
    for r in found:
        mine = expected[r["group"], r["window_id"]]
        values, keys = sorted(v for v, _ in mine), len({k for _, k in mine})
        n = len(values)
        assert (r["n"], r["least"], r["most"]) == (n, values[0], values[-1])
        assert r["keys_low"] <= keys <= r["keys_high"]
        for p, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
            assert sum(v < r[p] for v in values) <= n * (q + r["rank_error"]) + 1
            assert sum(v <= r[p] for v in values) >= n * (q - r["rank_error"]) - 1


def test_windows_from_levels(spark):
    data = rows(20_000, 1)
    found = sketches.figures(sketches.over(table(spark, data), windows(spark, *SPANS)), "group", "window_id").collect()
    agrees(found, data)


def test_late_rows_are_merged(spark):
    early, late = rows(6_000, 2), rows(6_000, 3)
    both = sketches.extended(table(spark, early), table(spark, late))
    assert both.count() == both.select("level", "group", "step").distinct().count()
    agrees(sketches.figures(sketches.over(both, windows(spark, *SPANS)), "group", "window_id").collect(), early + late)


def test_cover_is_exact_and_small(spark):
    rng = random.Random(4)
    spans = [(a, a + rng.randrange(0, 600_000)) for a in (rng.randrange(10_000) for _ in range(60))]
    asked = spark.createDataFrame(spans, "a long, b long")
    for r in asked.select("a", "b", sketches.covered(asked["a"], asked["b"]).alias("c")).collect():
        size = {0: 1, 1: 60, 2: 1440}
        pieces = sorted((p["step"] * size[p["level"]], (p["step"] + 1) * size[p["level"]]) for p in r["c"])
        at = r["a"]
        for start, end in pieces:
            assert start == at
            at = end
        assert at == r["b"]
        assert len(pieces) <= 2 * 60 + 2 * 24 + (r["b"] - r["a"]) // 1440


def test_odd_rows(spark):
    odd = [("a", START, None, None), ("a", START, float("nan"), 1), (None, None, 1.0, 1), ("b", START, 2.0, None)]
    found = {r["group"]: r for r in sketches.figures(sketches.over(table(spark, odd), windows(spark, (0, 1))), "group").collect()}
    assert set(found) == {"a", "b"}
    assert (found["a"]["n"], found["a"]["p50"], found["a"]["keys"]) == (0, None, 1)
    assert (found["b"]["n"], found["b"]["p50"], found["b"]["keys"]) == (1, 2.0, 0)
    assert sketches.over(table(spark, []), windows(spark, (0, 1))).count() == 0
