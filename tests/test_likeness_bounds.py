"""Passages: what cannot be alike never reaches the comparison, and grams that no passage has leave no worker."""

import difflib
import random

import numpy as np
import pyarrow as pa

from docloom.operators import passages


def test_longest_common_subsequence():
    r = random.Random(3)
    for _ in range(200):
        a, b = ("".join(r.choice("abcd é") for _ in range(r.randrange(0, 90))) for _ in range(2))
        line = [0] * (len(b) + 1)
        for x in a:
            line, above = [0], line
            for j, y in enumerate(b):
                line.append(above[j] + 1 if x == y else max(line[j], above[j + 1]))
        assert passages.common(passages._rows_of(a), b) == line[-1]


def test_texts_of_the_same_letters_are_not_compared(monkeypatch):
    r = random.Random(4)
    words = [w * 2 for w in "the of and to in is was for on that with as it by at from".split()]
    made = [" ".join(r.choice(words) for _ in range(60)) for _ in range(60)]
    texts = [t[: len(t) // 2] + "x" + t[len(t) // 2 :] for t in made[:5]] + made[20:]
    want = [(i, j) for i, p in enumerate(made[:20]) for j, t in enumerate(texts) if difflib.SequenceMatcher(None, p, t).ratio() >= 0.75]
    compared, plain = [], difflib.SequenceMatcher
    monkeypatch.setattr(passages.difflib, "SequenceMatcher", lambda *a: compared.append(a) or plain(*a))
    assert sorted(passages.alike_pairs(made[:20], texts, 0.75)) == sorted(want)
    assert len(compared) <= 3 * len(want) + 20


def test_only_grams_of_passages_are_given_back():
    passage = b"a passage of more than twenty bytes"
    only = passages.chosen(passage)
    text = b"other words before; " + passage + b"; and many other words behind it, none of them asked for"
    assert set(only) <= set(passages.chosen(text)) and np.array_equal(passages.chosen(text, only), only)
    batch = pa.RecordBatch.from_pydict({"id": [1, 2], "t": [text.decode(), "nothing that any passage holds at all"]})
    got = pa.Table.from_batches(list(passages._grams([batch], pa.int64(), only)))
    assert got["id"].unique().to_pylist() == [1] and got.num_rows == len(only)
    assert len(passages.chosen(text, only[:0])) == 0
