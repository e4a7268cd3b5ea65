"""Periodic runs against their definition."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import periods

from . import support

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_definition(w, least=6, exponent=4):
    found = {}
    for q in range(1, len(w)):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((a, n, q) for (a, n), q in found.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=4), st.integers(1, 9), st.integers(0, 3)), max_size=8), st.sampled_from([2, 3, 4]), st.sampled_from([2, 6]))
def test_runs_by_definition(parts, exponent, least):
    w = [x for unit, n, more in parts for x in (unit * n + unit[:more])]
    w = w + w[len(w) // 3 :]
    got = periods.runs(np.array(w, np.int64), least, exponent)
    assert [tuple(r) for r in got.tolist()] == by_definition(w, least, exponent)


def test_longest_previous_factors():
    r = np.random.default_rng(3)
    for _ in range(50):
        w = r.integers(0, 3, 60)
        length, source = periods.previous_factors(periods.Suffixes(w))
        for i in range(60):
            shared = [next((k for k in range(60 - i) if w[i + k] != w[j + k]), 60 - i) for j in range(i)]
            assert length[i] == max(shared, default=0)
            assert (source[i] < 0) == (length[i] == 0) and (source[i] < 0 or shared[source[i]] == length[i])


def test_one_word_a_million_times():
    assert periods.runs(np.zeros(1_000_000, np.int64)).tolist() == [[0, 1_000_000, 1]]
    assert len(periods.runs(np.arange(300_000))) == 0


def expected(doc_id, text):
    w = WORD.findall(text or "")
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = by_definition(w)
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    four = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(found), *four, digest("".join(f"{a},{n},{q}\n" for a, n, q in found)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


def documents():
    loops = ["a b " * 9 + "x " + "a b " * 9, "spam " * 400, "la la la la la la", "one two three " * 5 + "one two", "x y z\n" * 8 + "end " * 6, "p q p q p q p q " * 3 + "r"]
    return support.odd_rows() + support.rows(loops + [" ".join(f"w{(i * k) % 7}" for i in range(90)) for k in range(60)], start=1_000)


@pytest.mark.parametrize("group", [1, 200, periods.GROUP])
def test_query_by_definition(spark, monkeypatch, group):
    monkeypatch.setattr(periods, "STRETCH", 50)
    rows = documents()
    got = periods.digests(support.table(spark, rows))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted((expected(r[0], r[1]) for r in rows), key=str)
    found = periods.find(support.table(spark, rows), group=group).collect()
    collapsed = {(r.doc_id, r.n_words): r for r in found if r.doc_id and r.doc_id >= 1_000}
    assert collapsed[(1_001, 400)].collapsed == "spam" and [tuple(x) for x in collapsed[(1_001, 400)].runs] == [(0, 400, 1)]
    assert all(r.collapsed_sha256 == hashlib.sha256(r.collapsed.encode()).hexdigest() for r in found)


def test_no_documents(spark):
    assert periods.digests(support.none(spark)).count() == 0
