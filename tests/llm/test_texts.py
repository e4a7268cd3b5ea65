"""Encoding, token files, suffix dedup, n-gram join, sharding, mixing and licences against plain Python."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from docloom.llm import ans, bpe, licenses, mixing, ngrams, sharding, suffixes
from docloom.llm.queries import vocabulary_path
from pyspark.sql import functions as F

from ..conftest import MIDDLE
from .support import none, odd, odd_rows, rows, table

BYTES, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"


@pytest.fixture(scope="module")
def documents(spark):
    df = spark.read.parquet(f"{MIDDLE}/documents.parquet").cache()
    return df, [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def both(documents, spark):
    return [(documents[0], documents[1]), (odd(spark), [(r[0], r[1]) for r in odd_rows()])]


def little(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


# Encoding


def test_bpe_as_the_library(spark, documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path(BYTES))
    t.no_padding(), t.no_truncation()
    for df, plain in both(documents, spark):
        want = []
        for d, text in plain:
            ids = t.encode(text or "", add_special_tokens=False).ids
            want.append((d, len(ids), hashlib.sha256(little(ids)).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        got = [tuple(r) for r in bpe.digests(df, vocabulary_path(BYTES)).collect()]
        assert Counter(got) == Counter(want)
    assert bpe.digests(none(spark), vocabulary_path(BYTES)).count() == 0


def test_bpe_random_strings():
    from tokenizers import Tokenizer

    path, r = vocabulary_path(BYTES), random.Random(3)
    t, f = Tokenizer.from_file(path), bpe.Pieces(bpe.vocabulary(path))
    signs = [*"\x1c\x1f\x85\u3000\u200b\u180e\u2028à", *"abcdeEST  \n\t'._-0123456789éüß中😀 ‍́\x00", "'s", "'re", "<|endoftext|>", "<|", "   ", "\r\n"]
    for _ in range(3000):
        text = "".join(r.choice(signs) for _ in range(r.randrange(40)))
        assert b"".join(bpe.encode_texts([text], f)) == little(t.encode(text, add_special_tokens=False).ids), repr(text)


def test_no_token_crosses_a_certain_cut():
    v = bpe.vocabulary(vocabulary_path(BYTES))
    assert 0 < v.inside.sum() < 65536
    for token in v.bytes.values():
        assert all(v.inside[a * 256 + b] for a, b in zip(token, token[1:]))


# Token files


def test_token_files_as_the_library(spark, documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path(WORDS))
    t.no_padding(), t.no_truncation()
    for df, plain in both(documents, spark):
        at, want = 0, []
        coded = [(d, little([*t.encode(x or "", add_special_tokens=False).ids, 2])) for d, x in plain]
        for d, ids in sorted(coded, key=lambda x: (x[0] is not None, x[0] or 0, zlib.crc32(x[1]))):
            want.append((d, at, len(ids) // 4, zlib.crc32(ids)))
            at += len(ids) // 4
        got = [tuple(r) for r in ans.round_trip(df, vocabulary_path(WORDS), block_tokens=40_000).collect()]
        assert Counter(got) == Counter(want)
    assert ans.round_trip(none(spark), vocabulary_path(WORDS)).count() == 0


def test_other_vocabularies_are_encoded_whole_or_refused(spark, tmp_path):
    import json

    from tokenizers import Tokenizer

    spec = json.load(open(vocabulary_path(WORDS), encoding="utf-8"))
    assert ans.short_way(vocabulary_path(WORDS))
    spec["normalizer"] = None  # keeps upper case, which the short way would lower
    path = str(tmp_path / "other.json")
    json.dump(spec, open(path, "w", encoding="utf-8"))
    assert not ans.short_way(path)
    text = "Some UPPER words, and more of them"
    [row] = ans.round_trip(table(spark, rows([text])), path).collect()
    ids = [*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 2]
    assert (row.n_tokens, row.ids_crc32) == (len(ids), zlib.crc32(little(ids)))
    assert ids[:-1] != Tokenizer.from_file(vocabulary_path(WORDS)).encode(text, add_special_tokens=False).ids
    with pytest.raises(ValueError, match="byte-level"):
        bpe.vocabulary(path)


def test_a_spoilt_file_is_noticed(spark, documents, tmp_path):
    import numpy as np

    freq = np.array([5, 0, (1 << ans.SCALE) - 6, 1])
    start = np.concatenate([[0], np.cumsum(freq)[:-1]])
    ids = np.array([0, 2, 2, 3, 2] * 70_000)
    payload, marks = ans.encode_block(ids, freq, start)
    symbol = np.repeat(np.arange(4), freq)
    f, s = freq.astype(np.uint64), start.astype(np.uint64)
    whole = np.concatenate([ans.decode_stretch(payload, len(ids), *m, symbol, f, s) for m in marks])
    assert (whole == ids).all() and len(marks) > 1
    bad = bytearray(payload)
    bad[len(bad) // 2] ^= 1
    again = np.concatenate([ans.decode_stretch(bytes(bad), len(ids), *m, symbol, f, s) for m in marks])
    assert (again != ids).any()


def test_crc_of_joined_stretches():
    a, b = b"some bytes", b"and more of them" * 9
    assert ans.crc32_combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


# Suffix dedup


def brute_suffixes(plain, width=50):
    first = {}
    texts = [(2**63 if d is None else d, d, (x or "").encode()) for d, x in plain]
    for k, _, raw in texts:
        for i in range(len(raw) - width + 1):
            w = raw[i : i + width]
            first[w] = min(k, first.get(w, k))
    for k, d, raw in texts:
        gone = bytearray(len(raw))
        for i in range(len(raw) - width + 1):
            if first[raw[i : i + width]] < k:
                gone[i : i + width] = b"\1" * width
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        yield d, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()


def test_suffixes_as_brute_force(spark, documents):
    df, plain = documents
    few = df.filter("doc_id < 250")
    got = [tuple(r) for r in suffixes.digests(few, block_bytes=100_000).collect()]
    assert Counter(got) == Counter(brute_suffixes([x for x in plain if x[0] < 250]))


def test_suffixes_on_odd_and_periodic_texts(spark):
    r = random.Random(11)
    base = "".join(r.choice("ab") for _ in range(400))
    made = rows([base[i : i + r.randrange(30, 200)] + r.choice(["", "aaaa" * 40, base[: r.randrange(100)]]) for i in range(0, 240, 4)], start=100)
    data = odd_rows() + made
    got = [tuple(x) for x in suffixes.digests(table(spark, data), block_bytes=3_000).collect()]
    assert Counter(got) == Counter(brute_suffixes([(x[0], x[1]) for x in data]))
    assert suffixes.digests(none(spark)).count() == 0


@pytest.mark.parametrize("often", [False, True])
def test_suffixes_of_grams_in_very_many_surroundings(spark, monkeypatch, often):
    """A phrase of 20 bytes and a line of 60 in thousands of distinct surroundings, with and without the passes for frequent grams."""
    monkeypatch.setattr(suffixes, "HOT", 64 if often else 1 << 40)
    r = random.Random(12)
    phrase, line = "phrase of 20 bytes!!", "a line of sixty bytes that a third of all documents hold ok."
    made = [f"{r.randrange(10**9):030d}{r.choice([phrase, line, line + phrase])}{r.randrange(10**12):035d}" for _ in range(20_000)]
    made += [made[r.randrange(20_000)][r.randrange(20) :] for _ in range(300)]
    data = rows(made)
    got = [tuple(x) for x in suffixes.digests(table(spark, data), block_bytes=200_000).collect()]
    assert Counter(got) == Counter(brute_suffixes([(x[0], x[1]) for x in data]))


def test_suffixes_of_long_runs_and_periods(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SLICE", 700)
    texts = ["=" * 4000, "=" * 70 + "x", "ab" * 900, "b" + "ab" * 300 + "c", "abc" * 500, "z" + "=" * 49, "z" + "=" * 50 + "ab" * 25]
    data = rows(texts + texts[::-1])
    for often in (64, 4096):
        monkeypatch.setattr(suffixes, "HOT", often)
        got = [tuple(x) for x in suffixes.digests(table(spark, data), block_bytes=3_000).collect()]
        assert Counter(got) == Counter(brute_suffixes([(x[0], x[1]) for x in data]))


def test_digits_drop_rows_that_are_alone():
    key = [b"aaaaaaaaxx", b"aaaaaaaaxx", b"aaaaaaaayy", b"aaaaaaaayy", b"bbbbbbbbxx"]
    left, group = suffixes.by_digits(np.zeros(5, np.int64), np.array([1, 2, 3, 3, 1]), iter(suffixes.words(np.array([list(k) for k in key], np.uint8))))
    assert left.tolist() == [0, 1] and group[0] == group[1]


def test_trimmed_rows_keep_the_columns(spark):
    passage = "this passage is long enough to be found again in another document, word for word"
    df = table(spark, rows([passage + " one", "two é \ufffd " + passage]))
    names = {"__kept": "a", "__n_removed": 3, "row": "r", "kept": b"k", "n_removed": 9, "spans": 1}
    for c, v in names.items():
        df = df.withColumn(c, F.lit(v))
    out = {r.doc_id: r for r in suffixes.trimmed_rows(df).collect()}
    assert suffixes.trimmed_rows(df).columns == df.columns
    assert out[0].text == passage + " one" and out[1].text == "two é \ufffd " and out[1].n_chars == 8 and out[1]["class"] == "c"
    assert all(x[c] == v for x in out.values() for c, v in names.items())


def test_a_character_cut_in_two_goes(spark):
    tail = "".join(chr(0x4E00 + i) for i in range(30))
    df = table(spark, rows(["\u4e8c" + tail, "\u4ecc" + tail + " end", "\u4ec0" + tail]))
    out = {r.doc_id: r.text for r in suffixes.trimmed_rows(df).collect()}
    assert out == {0: "\u4e8c" + tail, 1: " end", 2: "\u4ec0"}


# N-gram join


def shingle_set(text, n):
    words = [w for w in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])


def brute_classes(plain, n, num, den):
    sets = [(d, shingle_set(t, n)) for d, t in plain]
    root = {d: d for d, _ in sets if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(list)
    for i, (d, s) in enumerate(sets):
        if d is not None:
            for g in s:
                by[g].append(i)
    common = Counter((i, j) for v in by.values() for a, i in enumerate(v) for j in v[a + 1 :])
    for (i, j), c in common.items():
        if den * c >= num * (len(sets[i][1]) + len(sets[j][1]) - c):
            a, b = find(sets[i][0]), find(sets[j][0])
            root[max(a, b)] = min(a, b)
    return [(d, len(s), None if d is None else find(d)) for d, s in sets]


@pytest.mark.parametrize(("n", "num", "den"), [(3, 90, 100), (5, 8, 10)])
def test_ngrams_as_brute_force(spark, documents, n, num, den):
    df, plain = documents
    got = [tuple(r) for r in ngrams.classes(df, n, (num, den), block_bytes=150_000).collect()]
    assert Counter(got) == Counter(brute_classes(plain, n, num, den))


def test_ngrams_on_odd_texts_chains_and_large_groups(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(60):  # chains of near copies around the threshold
        now = [r.choice(words) for _ in range(r.randrange(3, 90))]
        for _ in range(r.randrange(1, 7)):
            texts.append(" ".join(now))
            now = [*now]
            now[r.randrange(len(now))] = "changed"
    hot = "the very same text that thousands of documents hold because a template made them all"
    data = odd_rows() + rows(texts, start=100) + rows([hot] * 1500 + [hot + f" and {i}" for i in range(900)], start=10_000)
    got = [tuple(x) for x in ngrams.classes(table(spark, data), 3, (90, 100), block_bytes=20_000).collect()]
    assert Counter(got) == Counter(brute_classes([(x[0], x[1]) for x in data], 3, 90, 100))
    assert ngrams.classes(none(spark)).count() == 0


def test_cells_over_their_size_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "CELL", 16)
    r = random.Random(4)
    base = [f"w{i}" for i in range(40)]
    texts = []
    for _ in range(160):
        now = [*base]
        for _ in range(r.randrange(4)):
            now[r.randrange(40)] = f"x{r.randrange(30)}"
        texts.append(" ".join(now))
    data = rows(texts)
    got = [tuple(x) for x in ngrams.classes(table(spark, data), 3, (80, 100), block_bytes=4_000).collect()]
    assert Counter(got) == Counter(brute_classes([(x[0], x[1]) for x in data], 3, 80, 100))


def keys_of(sets, similarity):
    """For each set the elements by which it meets others, with counts over these sets."""
    sizes = np.array([len(x) for x in sets])
    h, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, at, count = np.unique(h, return_inverse=True, return_counts=True)
    chosen = ngrams.rare(h, row, sizes, np.ceil(np.log2(count))[at].astype(np.uint8), similarity)
    return [set(h[chosen][row[chosen] == i].tolist()) for i in range(len(sets))]


def test_unlike_sets_have_no_keys():
    r = np.random.default_rng(3)
    lines = [r.integers(0, 1 << 48, 20, dtype=np.uint64) for _ in range(5)]
    sets = [np.unique(np.concatenate([r.integers(0, 1 << 48, 200, dtype=np.uint64), *(lines[i] for i in r.permutation(5)[:3])])) for _ in range(300)]
    assert not any(keys_of(sets, (8, 10)))


@pytest.mark.parametrize("similarity", [(8, 10), (9, 10), (5, 10)])
def test_similar_sets_share_a_key_and_their_bound_is_open(similarity):
    num, den = similarity
    r = np.random.default_rng(4)
    for size in [*range(1, 40), *r.integers(40, 900, 60).tolist()]:
        a = np.unique(r.integers(0, 1 << 48, size, dtype=np.uint64))
        drop = len(a) - -(-len(a) * num // den) if size % 2 else 0
        b = a[drop:] if drop else np.unique(np.concatenate([a[: len(a) - 2 * len(a) * (den - num) // (den + num) // 2], r.integers(0, 1 << 48, 2 * len(a) * (den - num) // (den + num) // 2, dtype=np.uint64)]))
        common = len(np.intersect1d(a, b))
        if common * den < num * (len(a) + len(b) - common):
            continue
        one, two = keys_of([a, b, a[: len(a) // 2], r.permutation(b)[: len(b) // 3]], similarity)[:2]
        assert one & two
        points = ngrams.coded(np.concatenate([ngrams.count_vectors(x, np.zeros(len(x), np.int64), 1) for x in (a, b)]))
        assert len(ngrams.tied(np.array([5, 5], np.uint64), np.array([1, 2]), np.array([len(a), len(b)]), points, similarity)[0])


def test_ties_of_a_key_have_the_components_of_all_its_pairs():
    r = np.random.default_rng(8)
    key, doc, sizes, points = np.sort(r.integers(0, 40, 400)).astype(np.uint64), np.arange(400), r.integers(6, 30, 400), None
    points = np.stack([np.bincount(r.integers(0, 6, n), minlength=ngrams.GROUPS) for n in sizes])
    a, b = ngrams.tied(key, doc, sizes, ngrams.coded(points), (8, 10))
    got = dict(zip(*ngrams.forest(a, b), strict=True))
    near = [(i, j) for i in range(400) for j in range(i) if key[i] == key[j] and np.minimum(points[i], points[j]).sum() * 18 >= 8 * (sizes[i] + sizes[j])]
    assert got == dict(zip(*ngrams.forest(*map(np.array, zip(*near, strict=True))), strict=True))


def test_thousands_of_unlike_documents_with_common_lines(spark):
    r = random.Random(7)
    lines = [" ".join(f"line{i}w{k}" for k in range(r.randrange(6, 14))) for i in range(12)]
    texts = []
    for i in range(5_000):
        own = [f"own{i}x{r.randrange(9)}" for _ in range(3 if i % 2 else 30)]
        texts.append(" ".join([*r.sample(lines, r.randrange(1, 6)), *own]))
    texts[7::500] = [f"{texts[3]} and {i}" for i in range(10)]
    data = rows(texts)
    got = {x.doc_id: x.component_id for x in ngrams.classes(table(spark, data), 5, (8, 10), block_bytes=60_000).collect()}
    sets = [shingle_set(t, 5) for t in texts]
    by = defaultdict(list)
    for i, s in enumerate(sets):
        by[len(s)].append(i)
    links = [(i, j) for i, s in enumerate(sets) for n in range(-(-len(s) * 8 // 10), len(s) + 1) for j in by[n] if j < i and 10 * (c := len(s & sets[j])) >= 8 * (len(s) + n - c)]
    want = dict(zip(*(x.tolist() for x in ngrams.forest(*map(np.array, zip(*links, strict=True)))), strict=True))
    assert got == {i: want.get(i, i) for i in range(5_000)}


def test_large_classes_of_different_sizes_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "CELL", 8)
    r = random.Random(6)
    texts = []
    for _ in range(120):
        now = [f"w{i}" for i in range(r.randrange(12, 60))]
        for _ in range(r.randrange(5)):
            now[r.randrange(len(now))] = f"x{r.randrange(30)}"
        texts.append(" ".join(now))
    data = rows(texts)
    got = [tuple(x) for x in ngrams.classes(table(spark, data), 3, (80, 100), block_bytes=3_000).collect()]
    assert Counter(got) == Counter(brute_classes([(x[0], x[1]) for x in data], 3, 80, 100))


def test_representatives(spark):
    near = " ".join(f"w{i}" for i in range(80))
    df = table(spark, rows([near, near + " end", "another one", None, near]))
    out = ngrams.representatives(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [0, 2, 3]


# Sharding


def test_sharding(spark, documents):
    for df, plain in both(documents, spark):
        got = sharding.assign(df).collect()
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in plain)
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
            assert 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40) and r.law == "key"
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.assign(none(spark)).count() == 0


def least_draw(key, level, names, weights):
    """The child with the least weighted draw, hashed with the xxhash library as the engine hashes three columns."""
    best = None
    for name, weight in zip(names, weights, strict=True):
        seed = 42
        for part in (key.encode(), level.encode(), struct.pack("<i", name)):
            seed = xxhash.xxh64_intdigest(part, seed)
        draw = -math.log(((seed >> 12) + 0.5) / 2**52) / weight
        best = min(best or (draw, name), (draw, name))
    return best[1]


def plain_shard(key, n_shards):
    """32 shards as 2 regions of 4 racks of 4, every further one a region and rack of its own; no code of the operator."""
    single = n_shards - 32
    region = least_draw(key, "region", range(2 + single), [16.0] * 2 + [1.0] * single)
    if region >= 2:
        return 30 + region
    rack = least_draw(key, "rack", range(4 * region, 4 * region + 4), [4.0] * 4)
    return least_draw(key, "shard", range(4 * rack, 4 * rack + 4), [1.0] * 4)


def test_every_draw_as_in_plain_python(spark, documents):
    for df, plain in both(documents, spark):
        got = Counter((r.doc_id, r.shard, r.grown_shard) for r in sharding.assign(df).collect())
        keys = ["null" if d is None else str(d) for d, _ in plain]
        assert got == Counter((d, plain_shard(k, 40), plain_shard(k, 41)) for (d, _), k in zip(plain, keys, strict=True))


def test_growth_takes_rows_only_into_the_new_shards(spark):
    counts = (40, 41, 42, 43)
    ids = spark.range(5_000).select(F.col("id").cast("string").alias("k"))
    got = ids.select("k", *[sharding.shard_of(F.col("k"), sharding.balanced(n)).alias(f"s{n}") for n in counts]).collect()
    for r in got:
        shards = [r[f"s{n}"] for n in counts]
        assert shards == [plain_shard(r.k, n) for n in counts]
        assert all(b == a or b == n for n, a, b in zip(counts, shards, shards[1:], strict=False))


def test_changed_weights_move_rows_of_their_subtree_only(spark):
    from pyspark.sql import functions as F

    tree = sharding.balanced(32)
    regions = [list(map(list, x)) for x in tree.regions]
    regions[1][2] = [(s, 2.0) for s, _ in regions[1][2]]
    heavier = sharding.Tree(tuple(tuple(tuple(map(tuple, [*rack])) for rack in x) for x in regions))
    ids = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    got = ids.select(sharding.shard_of(F.col("k"), tree).alias("a"), sharding.shard_of(F.col("k"), heavier).alias("b")).collect()
    changed = {s for s, _ in tree.regions[1][2]}
    region = {s for rack in tree.regions[1] for s, _ in rack}
    moved = [r for r in got if r.a != r.b]
    assert moved and all(r.b in changed or (r.a not in region and r.b in region) for r in moved)
    counts = Counter(r.a for r in got)
    assert len(counts) == 32 and max(counts.values()) < 1.35 * min(counts.values())


# Mixing


def test_mixing_meets_its_targets(spark, documents):
    for df in (documents[0], odd(spark)):
        got = mixing.mix(df).collect()
        again = mixing.mix(df).collect()
        assert Counter(map(tuple, got)) == Counter(map(tuple, again))
        assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    taken, target, largest = Counter(), {}, Counter()
    source = {r.doc_id: r.source for r in documents[0].collect()}
    for r in mixing.mix(documents[0]).collect():
        s = source[r.doc_id]
        taken[s] += r.taken
        target[s], largest[s] = r.target, max(largest[s], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    assert abs(sum(target.values()) - sum(r["size"] for r in mixing.mix(documents[0]).collect())) < 1e-3
    assert mixing.mix(none(spark)).count() == 0


def test_rising_budgets_are_nested(spark):
    sized = mixing.plan(table(spark, rows([f"a b c {i}" for i in range(300)], source=lambda i: "one")))[0]
    kept = []
    for rest in (50, 200, 700):
        budget = spark.createDataFrame([("sone", float(rest))], "key string, rest double")
        below = mixing.thresholds(sized, budget).first()["below"]
        kept.append({r.doc_id for r in sized.filter(f"h < {below}").collect()})
        assert abs(4 * len(kept[-1]) - rest) <= 4
    assert kept[0] < kept[1] < kept[2]


def test_mixed_rows_keep_clashing_columns(spark):
    df = table(spark, rows([f"some words of text {i}" for i in range(60)]))
    names = {"__h": 5, "__key": "x", "__id_key": 1, "__passes": 2, "__below": 3, "row": "r", "below": 4, "col": "c"}
    for c, v in names.items():
        df = df.withColumn(c, F.lit(v))
    out = mixing.mix_rows(df)
    got = out.collect()
    assert out.columns == df.columns and len(got) > 30 and all(r[c] == v for r in got for c, v in names.items())
    taken = Counter(r.doc_id for r in got)
    assert all(taken[r.doc_id] * r["size"] == r.taken for r in mixing.mix(df).collect())


def test_mixed_rows_repeat(spark):
    df = odd(spark)
    want = {(r.doc_id, r["size"]): r.taken for r in mixing.mix(df).collect()}
    got = Counter(r.doc_id for r in mixing.mix_rows(df).collect())
    assert mixing.mix_rows(df).columns == df.columns
    assert all(want[d, s] == s * got[d] for d, s in want if d is not None and d != 3 and s)


# Licences


def test_licences(spark, documents):
    texts = [
        "Licensed under the MIT License. And more.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\nAll rights reserved",
        "# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n",
        "Permission is granted to smile. Rights of way.",
        None, "", "x" * 20_000,
        "All rights reserved. All rights reserved.",
        "This work is licensed under the\nGNU General Public License version 3.",
    ]
    got = {r.doc_id: (r.n_sentences, r.licenses, r.first_license) for r in licenses.scan(table(spark, rows(texts))).collect()}
    assert got[0] == (1, "MIT", "MIT")
    assert got[1] == (2, "all-rights-reserved", "all-rights-reserved")
    assert got[2] == (3, "Apache-2.0", "Apache-2.0")
    assert got[3] == got[4] == got[5] == got[6] == (0, "", None)
    assert got[7] == (2, "all-rights-reserved", "all-rights-reserved")
    assert got[8] == (1, "GPL-3.0", "GPL-3.0")
    assert licenses.scan(none(spark)).count() == 0 and licenses.scan(odd(spark)).count() == len(odd_rows())


NOTICES = {
    0: "This work is licensed under the GNU General Public License, version 3.",
    1: "This work is licensed under the GNU General Public License, version 2.",
    2: "All rights reserved.",
    3: "Licensed under CC BY-NC 4.0.",
    4: "Licensed under CC BY 4.0.",
    5: "Licensed under CC BY-SA 4.0.",
    6: "Released under the MIT License.",
    7: "Licensed under the MIT License.",
    8: "Licensed under the Apache License, Version 2.0.",
    9: 'Licensed under the Apache License, Version 2.0 (the "License");',
    10: "you may not use this file except in compliance with the License.",
    11: "You may obtain a copy of the License at",
    12: 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    13: "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    14: 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    15: "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    16: "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    17: "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    18: "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    19: "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    20: "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    21: "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    22: "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    23: "SPDX-License-Identifier: MIT",
    24: "SPDX-License-Identifier: Apache-2.0",
    25: "SPDX-License-Identifier: GPL-3.0-only",
    26: "SPDX-License-Identifier: BSD-3-Clause",
}


# What each of the notices above says, alone.
SAYS = {0: "GPL-3.0", 1: "GPL-2.0", 2: "all-rights-reserved", 3: "CC-BY-NC-4.0", 4: "CC-BY-4.0", 5: "CC-BY-SA-4.0", 6: "MIT", 7: "MIT", 8: "Apache-2.0", 19: "ISC", 20: "GPL-3.0-or-later", 22: "MPL-2.0", 23: "MIT", 24: "Apache-2.0", 25: "GPL-3.0-only", 26: "BSD-3-Clause"}
LONG = [("BSD-3-Clause", (15, 16, 17, 18)), ("MIT", (12, 13, 14)), ("BSD-2-Clause", (15, 16, 17)), ("Apache-2.0", (9, 10, 11)), ("GPL-3.0-or-later", (20, 21)), ("MIT", (12, 13))]


def scanned(spark, texts):
    return {r.doc_id: r for r in licenses.scan(table(spark, rows(texts))).collect()}


def test_each_notice_is_found_as_it_stands(spark):
    cases = LONG + [(name, (i,)) for i, name in SAYS.items()]
    texts = ["Some words first.\n" + "\n".join(NOTICES[i] for i in ids) + "\nand more" for _, ids in cases]
    texts += ["SPDX-License-Identifier: unknown. MIT", "Public version 2.0. MIT", "Mozilla Public License, v. 2.0."]
    got = scanned(spark, texts)
    for i, (name, ids) in enumerate(cases):
        assert (got[i].licenses, got[i].first_license) == (name, name) and got[i].n_sentences >= len(ids), ids
    assert all((got[len(cases) + i].n_sentences, got[len(cases) + i].licenses) == (0, "") for i in range(3))
    assert got[len(cases)].n_unknown == 1  # a tag that is not known


def wrapped(text, width):
    out, line = [], ""
    for w in text.split(" "):
        if len(line) + len(w) >= width:
            out, line = [*out, line], ""
        line = f"{line} {w}".strip()
    return "\n".join([*out, line])


def test_every_rule_is_reached_by_its_wording_on_one_line_and_wrapped(spark):
    holder = lambda t: t.replace("{holder}", "Foo Corp. Ltd".replace(". ", " "))
    cases = [(name, " ".join(holder(licenses.NOTICES[n]) for n in names)) for name, names in licenses.RULES]
    cases += [(name, holder(licenses.NOTICES[n])) for n, name in licenses.ALONE.items()]
    cases += [(name, text) for name, text in licenses.gnu_notices().values()]
    texts = [t for _, t in cases] + [wrapped(t, 72) for _, t in cases]
    got = scanned(spark, texts)
    for i, (name, _) in enumerate(cases):
        assert got[i].licenses == got[i + len(cases)].licenses == name, (name, texts[i])


def test_statements_slots_and_tags(spark):
    rules = licenses.Rules()
    assert len(rules.known) > 500
    cases = {
        "Released under the MIT License by Foo Corp.": "MIT",
        "This software is distributed under the terms of the MIT license.": "MIT",
        "The source code of it is made available under the GNU General Public License, version 2.": "GPL-2.0",
        "This library is licensed under the LGPL v2.1 or later.": "LGPL-2.1-or-later",
        "Licensed under LGPL version 2.1 or later": "LGPL-2.1-or-later",
        "This article is published under a Creative Commons Attribution-ShareAlike 3.0 Unported License.": "CC-BY-SA-3.0",
        "This file is not licensed under the MIT License.": None,
        "Copyright (c) 2020 Jane Doe\nAll rights reserved.": "all-rights-reserved",
        "Licensed under the Foo License, version 7.": None,
        "1. Redistributions only.": None,
    }
    got = scanned(spark, list(cases))
    for i, (text, name) in enumerate(cases.items()):
        assert got[i].licenses == (name or ""), text
    assert got[6].n_unknown == got[8].n_unknown == 1
    tags = sorted({x for x in rules.alone.values() if x != "all-rights-reserved"} - {"MIT-0", "0BSD"})
    got = scanned(spark, [f"// SPDX-License-Identifier: {x}\nint x;" for x in tags])
    assert all(got[i].licenses == x for i, x in enumerate(tags))


def test_rules_need_their_sentences_side_by_side(spark):
    grant, notice = NOTICES[12], NOTICES[13]
    far = " ".join(f"Unrelated sentence number {i} about something." for i in range(200))
    texts = [f"{grant} {notice}", f"{grant} {far} {notice}", f"{grant} 1. {notice}", f"Copyright (c) 2001 A. {grant} {notice}", f"{grant} A licence of another kind. {notice}"]
    got = scanned(spark, texts)
    assert [got[i].licenses for i in range(5)] == ["MIT", "", "MIT", "MIT", ""]
    assert all(got[i].n_sentences == 2 for i in range(5)) and got[4].n_unknown == 1


def brute_licence(text, rules):
    """The same in plain Python, by a walk over lists instead of columns and patterns."""

    def tokens(t):
        out = []
        spared = re.sub(r"(?i)spdx-license-identifier:[ \t]*", "SPDX-License-Identifier ", re.sub(r"(?i)\bv\. +(?=[0-9])", "v", t))
        for x in re.split("[.!?;:]+[\x20\x09-\x0d]+", spared + " "):
            s = licenses.reduced(x)
            like = re.search(licenses.LIKE, s, re.A) and any(a in s for a in licenses.ANCHORS)
            if s in rules.known:
                out.append(rules.known[s])
            elif not re.match(licenses._PASSED, s):
                out.append("?" if like else "-")
        return out

    both = [tokens(re.sub("[\n\r]+", ". ", text)), tokens(text)]
    known = [sum(isinstance(x, int) for x in b) for b in both]
    whole, found = [*both[0], "|", *both[1]], []
    for name, ids in rules.several:
        i = 0
        while i + len(ids) <= len(whole):
            if tuple(whole[i : i + len(ids)]) == ids:
                whole[i : i + len(ids)] = ["|"]
                found.append(name)
            i += 1
    found += [rules.alone[x] for x in whole if x in rules.alone]
    return max(known), both[known[1] >= known[0]].count("?"), ",".join(sorted(set(found)))


def test_licences_of_all_documents(spark, documents):
    rules = licenses.Rules()
    got = {r.doc_id: (r.n_sentences, r.n_unknown, r.licenses) for r in licenses.scan(documents[0]).collect()}
    want = {d: brute_licence(t or "", rules) for d, t in documents[1]}
    assert {d: (x[0], x[2]) for d, x in got.items()} == {d: (x[0], x[2]) for d, x in want.items()}
    assert all(got[d][1] == want[d][1] for d in got if got[d][0])
    assert sum(n for n, _, _ in got.values()) > 0
