"""Small tables for the operators: the usual columns, others whose names clash with what operators use inside, and every odd text."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, block int, part string, h long, n int, class string, host string"


def rows(texts, start=0, source=lambda i: f"s{i % 3}"):
    return [(start + i, t, "en", source(i), len(t) if t is not None else None, "k", 7, "p", 5, 3, "c", "h") for i, t in enumerate(texts)]


def odd_rows():
    """Null and empty texts, blanks, one word, copies, ties on doc_id, a null doc_id, null source, characters of all widths, and a long text."""
    r = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "naïve", "中文", "😀", "Über", "don't", "x1"]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n)) + "."
    long = prose(6000)
    texts = [None, "", " \t\n ", "word", "two words", prose(40), prose(40), long, long, "a" * 3000, "\n\n  spaces   and\ttabs \r\n", "<|endoftext|> special <|endoftext|>", "café ﬁ Ⅷ", "  lead", "ab" * 60]
    out = rows(texts + [texts[5], texts[5] + " tail"])
    out += [(3, "word", "fr", None, 4, None, None, None, None, None, None, None), (None, "no id here at all", None, None, None, None, None, None, None, None, None, None)]
    return out


def table(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def odd(spark):
    return table(spark, odd_rows())


def none(spark):
    return table(spark, [])
