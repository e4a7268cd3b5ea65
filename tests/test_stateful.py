"""Folds with keyed state: by definition over tables, and the same rows from streams that are started again."""

import random

import pytest
from docloom.functions.text import tokens_of_memory
from docloom.sources.tables import new_dir
from docloom.streaming import stateful, streams
from pyspark.sql import functions as F

REQUESTS = "event_id long, user_id long, ms long"


def requests(n=400):
    r = random.Random(4)
    times = sorted(r.randrange(1_000, 9_000) for _ in range(n))
    return [(i, r.choice([None, 0, 1, 1, 2, 7]), t) for i, t in enumerate(times)]


def by_definition(rows, limit, window):
    taken, out = {}, []
    for i, k, t in sorted(rows, key=lambda x: (x[2], x[0])):
        live = [x for x in taken.get(k, []) if x > t - window]
        ok = len(live) < limit
        taken[k] = [*live, t] if ok else live
        out.append((i, k, t, ok, limit - len(taken[k]), 0 if ok else window))
    return sorted(out)


def timed(df):
    return df.withColumn("ts", F.timestamp_millis("ms"))


def cut_at(df, *ends):
    edges = [None, *ends, None]
    return [df.filter((F.lit(True) if a is None else F.col("ms") > a) & (F.lit(True) if b is None else F.col("ms") <= b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def test_limiter_with_null_keys(spark):
    rows = requests() + [(1_000 + i, None, 5_000) for i in range(9)]
    got = stateful.limited(spark.createDataFrame(rows, REQUESTS), limit=3, window_ms=700)
    assert sorted(tuple(r) for r in got.collect()) == by_definition(rows, 3, 700)
    assert sum(not ok for _, k, _, ok, _, _ in by_definition(rows, 3, 700) if k is None) > 0
    assert stateful.limited(spark.createDataFrame([], REQUESTS)).count() == 0


@pytest.mark.parametrize("ends", [(3_000, 3_100, 8_999), (5_000,)])
def test_limiter_as_a_stream_started_again(spark, ends):
    rows = requests()
    parts = cut_at(timed(spark.createDataFrame(rows, REQUESTS)), *ends)
    got = streams.in_turns(parts, lambda s: stateful.limited_stream(s, limit=3, window_ms=700), new_dir(spark, "test"))
    assert sorted(tuple(r) for r in got.select("event_id", "user_id", "ms", "allowed", "remaining", "retry_after_ms").collect()) == by_definition(rows, 3, 700)


MESSAGES = "conv_id long, id long, ms long, role string, text string"


def summary(old, messages):
    if "boom" in messages[-1][1]:
        raise RuntimeError("no model")
    return None if "empty" in messages[-1][1] else f"{old}[{' '.join(t for _, t in messages)}]"


RULES = stateful.Rules(summary, most=4, tokens=60, ttl_ms=1_000)


def messages():
    r, out = random.Random(6), []
    for c in range(12):
        t = r.randrange(1, 500)
        for i in range(r.randrange(1, 25)):
            t += r.choice([10, 50, 200, 999, 1_000, 1_500])
            out.append((c, i * 2, t, r.choice(["user", "assistant"]), r.choice(["a b", "boom", "empty", None, "word " * 30, "中文字" * 25, f"t{i}"])))
    return out


def folded(rows, until):
    """The rules told once more, a conversation at a time."""
    size = lambda s: (w := sum(c > "⺀" for c in s)) + -(-(len(s) - w) // 4)
    out = []
    for c in {r[0] for r in rows}:
        held, mark, old, above, last = [], 0, "", -1, None
        for _, i, t, role, text in sorted((r for r in rows if r[0] == c), key=lambda r: r[1]):
            if last is not None and t - last[1] >= 1_000 and (held or mark):
                out.append((c, last[0], "expired", above, len(held), None))
                held, mark = [], 0
            held, last = [*held, (i, text or "")], (i, t)
            if len(held) + mark >= 4 or sum(size(x) for _, x in held) >= 60:
                if "boom" in held[-1][1] or "empty" in held[-1][1]:
                    out.append((c, i, "failed", above, len(held), None))
                else:
                    old = f"{old}[{' '.join(x for _, x in held)}]"
                    above = i
                    out.append((c, i, "rolled", above, len(held), old))
                    held, mark = [], 1
        if until is not None and until - last[1] >= 1_000 and (held or mark):
            out.append((c, last[0], "expired", above, len(held), None))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("conv_id", "id", "kind", "watermark", "messages", "summary").collect()), key=str)


@pytest.mark.parametrize("until", [None, 4_000, 10**9])
def test_memory_by_the_rules(spark, until):
    rows = messages()
    twice = spark.createDataFrame(rows + rows[::3], MESSAGES)
    want = folded(rows, until)
    assert rows_of(stateful.remembered(twice, RULES, until)) == want
    assert {k for _, _, k, *_ in want} == {"rolled", "failed", "expired"}


def test_memory_as_a_stream_started_again(spark):
    rows = messages()
    last = max(r[2] for r in rows)
    parts = cut_at(timed(spark.createDataFrame(rows, MESSAGES)), last // 4, last // 3, last // 2)
    parts[2] = parts[2].unionByName(parts[2].limit(5))  # delivered twice
    got = streams.in_turns(parts, lambda s: stateful.remembered_stream(s, RULES), new_dir(spark, "test"))
    assert rows_of(got) == folded(rows, last)


def test_tokens_are_those_of_the_column(spark):
    texts = ["", "abc", "abcd efgh", "中文", "a中", "ﬀ豈Ａ", "😀" * 9]
    df = spark.createDataFrame([(x,) for x in texts], "s string").select("s", tokens_of_memory(F.col("s")).alias("n"))
    assert all(stateful.tokens(r.s) == r.n for r in df.collect())
