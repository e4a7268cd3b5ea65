"""Suffix dedup: grams that stand very often stay in packs by block, and bytes decide where hashes agree."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np

from docloom.llm import suffixes

from .support import rows, table
from .test_texts import brute_suffixes


def _lines(n):
    r = random.Random(21)
    line = "a line of well over sixty bytes that stands in each and every one of the documents."
    return rows([f"{r.randrange(10**9):030d}{line}{r.randrange(10**12):035d}" for _ in range(n)])


def test_frequent_grams_make_no_rows_of_windows(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", 64)
    made, plain = {}, suffixes.written

    def counting(df, name, by=None):
        out = plain(df, name, by)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(suffixes, "written", counting)
    for n in (1_000, 4_000):
        data = _lines(n)
        got = [tuple(x) for x in suffixes.digests(table(spark, data), block_bytes=60_000).collect()]
        assert Counter(got) == Counter(brute_suffixes([(x[0], x[1]) for x in data]))
        blocks = n * 150 // 60_000 + 5
        assert all(made[t] <= 2 * blocks for t in made if t != "spans")


def test_windows_of_equal_hash_are_told_apart(monkeypatch):
    texts = np.frombuffer(b"".join(f"{i % 7:080d}".encode() for i in range(40)), np.uint8).reshape(40, 80)
    monkeypatch.setattr(suffixes, "rolling", lambda x, n: np.full((len(x), x.shape[1] - n + 1), 5, np.uint64))
    own = np.zeros((40, 31), bool)
    own[:, 30] = True
    w = suffixes.Windows(np.arange(40), texts, own, 50, 8)
    assert all((w.data[w.group[i]] == texts[i, 30:]).all() for i in range(40))
    assert (w.least[w.group] <= w.doc).all()
