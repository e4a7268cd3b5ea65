"""Passages against texts by brute force, on whole texts."""

import difflib
import random

import pytest
from docloom.operators import passages
from pyspark.sql import functions as F

ROWS, GOLDEN = "chunk_id long, content string", "item_id long, passage string"


def brute(rows, golden, threshold=0.75, shortest=20):
    inside, near = set(), set()
    for j, p in golden:
        if p is None or len(p) < shortest:
            continue
        p = p.lower()
        for i, c in rows:
            c = (c or "").lower()
            if p in c:
                inside.add((i, j))
            m = difflib.SequenceMatcher(None, p, c)
            if c and m.real_quick_ratio() >= threshold and m.quick_ratio() >= threshold and m.ratio() >= threshold:
                near.add((i, j))
    return inside, near


def tables():
    r = random.Random(12)
    words = ["alpha", "Beta", "gamma", "the", "of", "naïve", "中文查询", "delta", "EPSILON", "zeta,", "x1"]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    boiler = "All rights are reserved by nobody at all."
    golden = [(i, prose(r.choice([3, 6, 20, 60, 200]))) for i in range(130)] + [(900, None), (901, ""), (902, "short one"), (903, boiler), (904, "x" * 25), (905, "中文查询" * 6)]

    def changed(text):
        out = list(text)
        for _ in range(int(len(out) * r.choice([0.02, 0.1, 0.2, 0.3]))):
            k = r.randrange(len(out))
            out[k : k + 1] = r.choice(["", "q", "é", out[k] * 2])
        return "".join(out)

    rows = [(i, prose(r.choice([2, 5, 20, 70, 220, 900]))) for i in range(350)]
    rows += [(1_000 + i, changed(p)) for i, p in golden[:200]]
    rows += [(2_000 + i, f"{prose(r.randrange(40))} {p.upper()} {prose(r.randrange(400))}") for i, p in golden[:150]]
    rows += [(3_000 + i, f"{boiler} {prose(8)}") for i in range(60)] + [(4_000, None), (4_001, ""), (4_002, "x" * 4_000), (4_003, boiler), (4_003, boiler), (4_004, "中文查询" * 7)]
    return rows, golden


def test_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(passages, "BLOCK_ROWS", 50)
    monkeypatch.setattr(passages, "BLOCK_PASSAGES", 20)
    rows, golden = tables()
    inside, near = brute(rows, golden)
    r, g = spark.createDataFrame(rows, ROWS), spark.createDataFrame(golden, GOLDEN)
    got = passages.passage_matches(r, g).collect()
    assert len(got) == len({(x.chunk_id, x.item_id) for x in got})
    assert {(x.chunk_id, x.item_id) for x in got} == inside | near
    assert {(x.chunk_id, x.item_id) for x in got if x.contained} == inside
    assert near - inside and inside - near


def test_blocks_hold_no_more_than_they_may(spark, monkeypatch):
    monkeypatch.setattr(passages, "BLOCK_ROWS", 64)
    rows = spark.createDataFrame([(i, "same words in every text of this table") for i in range(1_000)], "id long, t string").withColumn("n", F.length("t"))
    blocks = passages._blocks(rows, passages.BLOCK_ROWS, "test").select("block", F.size("ids").alias("n")).collect()
    assert max(b.n for b in blocks) <= 64 and sum(b.n for b in blocks) == 1_000 and len({b.block for b in blocks}) == len(blocks)


def test_nothing_and_short_passages(spark):
    r, g = spark.createDataFrame([], ROWS), spark.createDataFrame([(1, "a passage of some length here")], GOLDEN)
    assert passages.passage_matches(r, g).count() == 0
    assert passages.passage_matches(spark.createDataFrame([(1, "text")], ROWS), spark.createDataFrame([], GOLDEN)).count() == 0
    with pytest.raises(ValueError):
        passages.contained(r, g, 10)


def test_bounds_never_exclude(spark):
    r = random.Random(3)
    for _ in range(1_500):
        a = "".join(r.choice("abc de") for _ in range(r.randrange(20, 60)))
        b = list(a)
        for _ in range(r.randrange(0, 30)):
            k = r.randrange(len(b))
            b[k : k + 1] = r.choice(["", "z", "b", "ab"])
            b = b or ["a"]
        b = "".join(b) or "a"
        ratio = difflib.SequenceMatcher(None, a, b).ratio()
        assert (list(passages.alike_pairs([a], [b], 0.75)) == [(0, 0)]) == (ratio >= 0.75)
