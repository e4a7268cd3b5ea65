"""Top-k search, embedding dedup, components and the quality classifier against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from docloom.llm import balltree, hnsw, quality
from docloom.llm.components import components

from ..conftest import MIDDLE
from .support import none, odd, odd_rows

SCHEMA = "vec_id long, embedding array<float>, label int, shard int, dim string, v string"


def vectors(seed=1, n=260, groups=12, dim=16):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, dim))
    out = []
    for i in range(n):
        v = centres[r.integers(groups)] + r.normal(size=dim) * r.choice([0, 0.02, 0.08, 0.4])
        out.append((int(i), (v / np.linalg.norm(v)).astype(np.float32).tolist(), int(r.integers(3)), 1, "d", "v"))
    nan, inf = float("nan"), float("inf")
    out += [(n + i, v, 1, None, None, None) for i, v in enumerate([None, [], [None] + [0.5] * 15, [nan] * 16, [inf] * 16, [0.0] * 16, [1.0, 2.0], [2.0, 4.0]])]
    return [*out, (n + 20, out[0][1], None, 1, "d", "v"), (n + 21, out[0][1], out[0][2], 1, "d", "v")]


def usable(v):
    return v and all(x is not None and math.isfinite(x) for x in v)


def brute_top(data, k, every, scale):
    rows = [(i, [math.floor(scale * x) for x in v]) for i, v, *_ in data if usable(v)]
    out = []
    for i, q in rows:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in rows if j != i and len(v) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return out


def test_top_k_in_one_shard_and_in_many(spark):
    data = vectors()
    df = spark.createDataFrame(data, SCHEMA)
    want = Counter(brute_top(data, 20, 20, 64))
    assert Counter(map(tuple, balltree.integer_top_k(df).collect())) == want
    rows = balltree.usable(df, "vec_id", "embedding")
    from pyspark.sql import functions as F

    ints = rows.withColumn("v", F.transform("v", lambda x: F.floor(x * 64).cast("double")))
    for threshold in ("10m", "-1"):  # the plan may or may not broadcast
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        got = balltree.top_k(ints, ints.filter("id % 20 = 0"), 20, shard_rows=40, block_rows=4, leaf=8)
        assert Counter((r.query_id, r["rank"], r.vec_id, int(r.score)) for r in got.collect()) == want
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert balltree.integer_top_k(spark.createDataFrame([], SCHEMA)).count() == 0


def test_the_bound_prunes():
    data = np.random.default_rng(0).normal(size=(4000, 3))
    tree = balltree.BallTree(np.arange(4000), data, 32)
    [(i, ids, scores)] = tree.search(data[:1] * 5, np.array([-1]), np.array([-np.inf]), 10)
    assert set(ids.tolist()) == set(np.argsort(-(data @ data[0]), kind="stable")[:10].tolist())
    assert list(tree.search(data[:1] * 5, np.array([-1]), np.array([1e9]), 10)) == []


def brute_links(data, threshold=0.98):
    rows = [(i, np.array(v, float) / np.linalg.norm(v), lab) for i, v, lab, *_ in data if usable(v) and lab is not None and any(v)]
    links, root = Counter(), {x[0]: x[0] for x in data}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, u, x) in enumerate(rows):
        for j, v, y in rows[a + 1 :]:
            if x == y and len(u) == len(v) and float(u @ v) >= threshold:
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return [(x[0], links[x[0]], find(x[0]), find(x[0]) == x[0]) for x in data]


@pytest.mark.parametrize("shard_rows", [10_000, 30])
def test_near_duplicates(spark, shard_rows):
    data = vectors(seed=4)
    got = hnsw.near_duplicates(spark.createDataFrame(data, SCHEMA), shard_rows=shard_rows).collect()
    assert Counter(tuple(r)[:4] for r in got) == Counter(brute_links(data))
    assert all(r.recall is None or r.recall >= 0.98 for r in got) and any(r.recall for r in got)
    assert hnsw.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def spread(n, per, seed=9, dim=32, noise=0.07):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(max(1, n // per), dim))
    x = centres[r.integers(len(centres), size=n)] + noise * r.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize(("n", "per"), [(50, 5), (50, 50), (600, 3), (5000, 12), (5000, 2), (5000, 2500)])
def test_the_graph_finds_what_brute_force_finds(n, per):
    """Groups of 50 and of 5,000, sparse and dense: the graph is searched at every size, and no point counts as its own link."""
    x = spread(n, per)
    truth = x @ x.T >= 0.98
    np.fill_diagonal(truth, False)
    _, links, root, recall = hnsw.linked_within(x, np.ones(n, np.int64), 0.98, 24)
    want, have = truth.sum(axis=1), truth.any(axis=1)
    assert (links <= want).all() and recall >= 0.98
    assert (links[have] / want[have]).mean() >= 0.95
    assert links.sum() % 2 == 0  # a pair counts for both ends


def test_every_point_finds_itself():
    x = spread(3000, 6)
    seen = np.concatenate([q[q == row] for _, q, row in hnsw.neighbours(hnsw.Graph(x), x, 0.98, 24)])
    assert len(np.unique(seen)) >= 2950


@pytest.mark.parametrize("shard_rows", [10_000, 700])
def test_recall_of_the_whole_table(spark, shard_rows):
    x = spread(4000, 4, seed=3)
    data = [(int(i), v.tolist(), 0, 0, "d", "v") for i, v in enumerate(x)]
    got = {r.vec_id: r.n_links for r in hnsw.near_duplicates(spark.createDataFrame(data, SCHEMA), shard_rows=shard_rows).collect()}
    kept = np.array([v.astype(np.float32) for v in x], np.float64)
    kept /= np.linalg.norm(kept, axis=1)[:, None]
    truth = (kept @ kept.T >= 0.98).sum(axis=1) - 1
    links = np.array([got[i] for i in range(4000)])
    assert (links <= truth).all() and links.sum() >= 0.95 * truth.sum()


@pytest.mark.parametrize("shard_rows", [10_000, 2])
def test_rows_that_share_a_vec_id(spark, shard_rows):
    near = lambda e: [1.0, float(e), 0.0]
    data = [(1, near(0), 1), (1, near(0), 1), (2, near(0.01), 1), (3, [0.0, 1.0, 0.0], 1), (3, near(0.02), 1), (4, [0.0, 1.0, 0.01], 1), (5, near(0), 2)]
    got = hnsw.near_duplicates(spark.createDataFrame([(*x, 0, "d", "v") for x in data], SCHEMA), shard_rows=shard_rows)
    assert Counter(tuple(r)[:4] for r in got.collect()) == Counter([(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (3, 1, 1, False), (4, 1, 1, False), (5, 0, 5, True)])


def test_components(spark):
    r = random.Random(8)
    edges = [(i, i + 1) for i in range(300)] + [(r.randrange(1000, 2000), r.randrange(1000, 2000)) for _ in range(700)] + [(5000, 5000 + i) for i in range(1, 400)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long").repartition(9)).collect()}
    assert all(got.get(x, x) == find(x) for x in root)


# Quality


def labelled(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    return docs, spark.read.parquet(f"{MIDDLE}/labels.parquet")


def test_held_out_accuracy(spark):
    docs, labels = labelled(spark)
    learn, held = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1").select("doc_id", "quality")
    got = quality.classify(docs, learn).join(held, "doc_id").select("quality", "kept", "posterior").collect()
    good = [r.kept for r in got if r.quality == 1]
    bad = [not r.kept for r in got if r.quality == 0]
    assert len(bad) > 10 and sum(good) / len(good) >= 0.97 and sum(bad) / len(bad) >= 0.85


def test_top_word_counts_all_words():
    words = [f"w{i}" for i in range(100)]
    words[1:8] = ["junk"] * 7  # stands at none of every 14th place
    assert quality.figures_of(" ".join(words))[quality.FIGURES.index("top_word")] == 0.07


def test_sparse_sites_shrink(spark):
    scored = spark.createDataFrame([("h1", "p1", 4.0)] * 200 + [("h1", "p2", -4.0)] + [("h2", "p1", -4.0)] * 200 + [("h3", "p9", 0.0)], "host string, path string, z double")
    priors, _, mean = quality.site_rates(scored)
    by = {(r.host, r.path): r.prior for r in priors.collect()}
    assert by["h1", "p1"] > 0.8 > mean > 0.2 > by["h2", "p1"] and by["h1", "p2"] == by["h1", "p1"]
    assert by["h2", "p1"] < by["h3", "p9"] < by["h1", "p1"]


def brute_posteriors(rows, threshold=0.5):
    """rows: (host, path, z). The posterior of each row in plain Python, by the definition."""
    prob = lambda z: 1 / (1 + math.exp(-z))
    odds = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    mean = sum(prob(z) for *_, z in rows) / len(rows)

    def by(key):
        out = {}
        for r in rows:
            n, s = out.get(key(r), (0, 0.0))
            out[key(r)] = (n + 1, s + prob(r[2]))
        return out

    def strength(groups, prior):
        m = [prior(k) * (1 - prior(k)) for k in groups]
        spread = sum((s / n - prior(k)) ** 2 for k, (n, s) in groups.items()) / len(groups) - sum(x / n for x, (n, _) in zip(m, groups.values(), strict=True)) / len(groups)
        return min(1e4, max(1.0, sum(m) / len(m) / max(spread, 1e-6) - 1))

    hosts, paths = by(lambda r: r[0]), by(lambda r: (r[0], r[1]))
    k = strength(hosts, lambda h: mean)
    prior = {h: (s + k * mean) / (n + k) for h, (n, s) in hosts.items()}
    k2 = strength(paths, lambda p: prior[p[0]])
    out = []
    for h, p, z in rows:
        n, s = paths[h, p]
        site = (s - prob(z) + k2 * prior[h]) / (n - 1 + k2)
        out.append(prob(z + odds(site) - odds(mean)))
    return out


def test_posteriors_as_brute_force(spark):
    r = random.Random(7)
    made = [(f"h{int(r.random() ** 3 * 40)}", f"p{int(r.random() ** 2 * 60)}") for _ in range(3000)]  # most paths hold a few rows
    lean = {x: r.gauss(0, 1.5) for x in sorted({h for h, _ in made})}
    data = [(h, p, max(-30.0, min(30.0, r.gauss(lean[h], 3)))) for h, p in made]
    scored = spark.createDataFrame([(*x, i) for i, x in enumerate(data)], "host string, path string, z double, i int")
    got = {x.i: (x.posterior, x.kept) for x in quality.judged(scored, quality.site_rates(scored)).collect()}
    want = brute_posteriors(data)
    assert all(abs(got[i][0] - w) < 1e-9 and got[i][1] == (w >= 0.5) for i, w in enumerate(want))
    sparse = Counter((h, p) for h, p, _ in data)
    assert sum(n <= 3 for n in sparse.values()) > 100


def test_figures_and_sites_of_whole_texts(spark):
    docs, labels = labelled(spark)
    model = quality.fit(docs, labels)
    scored = [(f"s{r.source}" if r.source is not None else "n", f"s{r.lang}" if r.lang is not None else "n", max(-30.0, min(30.0, model.bias + sum(w * x for w, x in zip(model.weights, quality.figures_of(r.text), strict=True)))), r.doc_id) for r in docs.collect()]
    want = dict(zip([x[3] for x in scored], brute_posteriors([x[:3] for x in scored]), strict=True))
    got = {r.doc_id: r.posterior for r in quality.classify(docs, labels).collect()}
    assert all(abs(got[d] - w) < 1e-6 for d, w in want.items())


def test_quality_on_odd_rows(spark):
    _, labels = labelled(spark)
    strange = spark.createDataFrame([(5, None, 1), (None, 1, 0), (6, 7, 0), (7, 1, 0), (8, 0, 1), (8, 1, 1)], "doc_id long, quality int, toxic int")
    for given in (labels, strange, strange.filter("false")):
        out = quality.classify(odd(spark), given)
        rows = out.collect()
        assert len(rows) == len(odd_rows()) and all(0 <= r.posterior <= 1 for r in rows)
    assert all(r.kept for r in quality.classify(odd(spark), strange.filter("false")).collect())
    kept = quality.keep_rows(odd(spark), labels)
    assert kept.columns == odd(spark).columns
    assert quality.classify(none(spark), labels).count() == 0 and quality.keep_rows(none(spark), labels).count() == 0
