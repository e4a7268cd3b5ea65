"""N-gram Jaccard join over count vectors in R-trees.

A document's set is its distinct word n-grams, hashed to 48 bits. Hashing the set into groups gives count
vectors; two documents share at most the sum over groups of the smaller counts, which bounds their overlap.
The join has four steps.

1. Counts. Blocks exchange their distinct hashes and learn in how many documents each stands, as a power of
   two. A document of which fewer than a share t of the set stands elsewhere has no similar document.
2. Shared rare elements. In the order of (count, hash), two sets of at least similarity t share one of the
   first ``size - ceil(t * size) + 1`` elements of each. Those elements are the keys by which documents meet;
   elements of one document alone need not be sent. At a key, documents whose count vectors allow similarity
   are tied; documents of a key that over ``HOT`` documents hold are tied to the smallest of them.
3. R-trees. Classes of tied documents are the cells. In each, count vectors are points of a packed R-tree,
   and each document descends it with the bound by summed coordinate minima against what similarity t asks
   of the node's smallest set.
4. Verification. Pairs that survive are checked on their sets; only these links make components.

Nothing is sampled or capped. Equal sets of a block are linked on the spot. A cell over ``CELL`` documents or
``WEIGHT`` elements is packed into tiles by size and least element, whose upper corners are the higher levels
of its R-tree. Each tile is joined with the cell's smallest document; documents that are then not joined to
it descend from the upper level to the tiles that their bound allows, and ask there in bounded pieces. So a
group of copies of any size costs its size, not its square; only documents that share rare elements, agree
in their counts and yet are no copies meet in many pairs.

Defined cases: only A-Z are lowered; fewer words than n form one gram; a null, empty or blank text has an
empty set and links with nothing; a null doc_id is counted but links with nothing (component null); rows
with one doc_id share a component; an empty table gives no rows; extra columns, whatever their names, come
back from ``representatives`` and are ignored by ``classes``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK_BYTES, STEPS, _by_part, _key_bytes, _keys, _split, counts_of, mix64, packed, parts_of, runs, texts, unseal, with_counts
from .common import discard, freed, partitions, written
from .components import components, forest

GROUPS = 64
LEAF = 16
CELL = 1_024
#: Elements of all sets of a cell that one task holds.
WEIGHT = 4_000_000
#: Documents of a key that are compared there; a power of two.
HOT = 256
#: Tiles under one node of the upper level.
FAN = 256
Similarity = tuple[int, int]


class _Words(dict):
    """64-bit hashes of words; forgets when it grows too large."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 150_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_words = _Words()


def shingles(rows: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct 48-bit n-gram hashes of each row, ascending by row and hash; their rows; and the size of each row's set."""
    raw, ends = texts(rows)
    lowered = raw.tobytes().lower()
    found: list[int] = []
    counts = np.zeros(len(ends) - 1, np.int64)
    get = _words.__getitem__
    for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        words = lowered[a:b].split()
        counts[i] = len(words)
        found += map(get, words)
    w = np.array(found, np.uint64)
    begin = np.cumsum(counts) - counts
    grams = np.where(counts >= n, counts - n + 1, 0)
    row = np.repeat(np.arange(len(counts)), grams)
    at = np.arange(len(row)) - np.repeat(np.cumsum(grams) - grams, grams) + np.repeat(begin, grams)
    h = np.zeros(len(row), np.uint64)
    for k in range(n):
        h = mix64(h * np.uint64(31) + w[at + k])
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        s = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            more = counts[short] > k
            s[more] = mix64(s[more] * np.uint64(31) + w[begin[short[more]] + k])
        row, h = np.concatenate([row, short]), np.concatenate([h, mix64(s + np.uint64(7))])
    both = np.sort((row.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16)))
    both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
    row = (both >> np.uint64(48)).astype(np.int64)
    return both & np.uint64((1 << 48) - 1), row, np.bincount(row, minlength=len(counts))


def needed(similarity: Similarity, sizes: np.ndarray) -> np.ndarray:
    """The least number of a set's own elements that a similar set shares."""
    num, den = similarity
    return -(-num * sizes // den)


def count_vectors(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """How many elements of each of n rows fall into each group."""
    return np.bincount(row * GROUPS + (h % np.uint64(GROUPS)).astype(np.int64), minlength=n * GROUPS).reshape(n, GROUPS)


def coded(counts: np.ndarray) -> np.ndarray:
    """Counts in one byte, rounded up where large, so that bounds stay bounds."""
    return np.searchsorted(STEPS, counts).astype(np.uint8)


def rare(h: np.ndarray, row: np.ndarray, sizes: np.ndarray, code: np.ndarray, similarity: Similarity) -> np.ndarray:
    """Places of the elements by which rows can meet a similar one: the first of each row by (code, hash), without those of code 0, that no other document holds."""
    live = np.bincount(row, code > 0, len(sizes)) >= needed(similarity, sizes)
    at = np.flatnonzero(live[row])
    at = at[np.lexsort((h[at], code[at], row[at]))]
    begin = np.concatenate([[0], np.cumsum(np.where(live, sizes, 0))[:-1]])
    rank = np.arange(len(at)) - begin[row[at]]
    return at[(rank < (sizes - needed(similarity, sizes) + 1)[row[at]]) & (code[at] > 0)]


def tied(key: np.ndarray, doc: np.ndarray, sizes: np.ndarray, points: np.ndarray, similarity: Similarity) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) with the components of all pairs of one key whose count vectors allow similarity.

    Each key's documents are a leaf of points: in round k the k-th of each key is held against those after it
    that are not joined with it yet. Where all are near, the first round ends it.
    """
    num, den = similarity
    order = np.lexsort((doc, sizes, key))
    key, doc, sizes, points = key[order], doc[order], sizes[order], points[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, len(key)))
    keep = np.repeat(length > 1, length)
    key, doc, sizes, points = key[keep], doc[keep], sizes[keep], points[keep]
    length = length[length > 1]
    start = np.cumsum(length) - length
    label, a, b, k = np.arange(len(key)), [], [], 0
    while len(start):
        mates = length - k - 1
        pivot = np.repeat(start + k, mates)
        at = np.arange(len(pivot)) - np.repeat(np.cumsum(mates) - mates, mates) + pivot + 1
        # sizes ascend, so a mate too large for its pivot is left out first
        open_ = (label[at] != label[pivot]) & (num * sizes[at] <= den * sizes[pivot])
        at, pivot = at[open_], pivot[open_]
        near = np.empty(len(at), bool)
        for x in range(0, len(at), 100_000):
            part = slice(x, x + 100_000)
            common = STEPS[np.minimum(points[at[part]], points[pivot[part]])].sum(axis=1)
            near[part] = common * (num + den) >= num * (sizes[at[part]] + sizes[pivot[part]])
        at, pivot = at[near], pivot[near]
        a.append(doc[at])
        b.append(doc[pivot])
        if len(at):
            low, new_label = np.arange(len(label)), np.arange(len(label))
            np.minimum.at(low, pivot, np.minimum(label[at], label[pivot]))
            np.minimum.at(new_label, label[at], low[pivot])
            np.minimum.at(new_label, label[pivot], low[pivot])
            label = new_label[label]
        k += 1
        edges, padded = np.stack([start, start + length], axis=1).ravel(), np.append(label, 0)
        joined_ = np.minimum.reduceat(padded, edges)[::2] == np.maximum.reduceat(padded, edges)[::2]
        go = (length > k + 1) & ~joined_
        start, length = start[go], length[go]
    return np.concatenate([np.empty(0, np.int64), *a]), np.concatenate([np.empty(0, np.int64), *b])


def firsts(h: np.ndarray, row: np.ndarray, sizes: np.ndarray, ids: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """For each row the row that stands for its equal sets in the block: the one of smallest id."""
    mixed = mix64(h ^ np.uint64(0x2545F4914F6CDD1D))
    low = np.bincount(row, (mixed & np.uint64(0xFFFFFFFF)).astype(float), len(sizes)).astype(np.uint64)
    high = np.bincount(row, (mixed >> np.uint64(32)).astype(float), len(sizes)).astype(np.uint64)
    order = np.lexsort((ids, high, low, sizes, ~ok))
    same = np.concatenate([[False], (low[order][1:] == low[order][:-1]) & (high[order][1:] == high[order][:-1]) & (sizes[order][1:] == sizes[order][:-1])]) & ok[order]
    same[1:] &= ok[order][:-1]
    run = np.cumsum(~same) - 1
    head = order[np.flatnonzero(~same)]
    out = np.empty(len(sizes), np.int64)
    out[order] = head[run]
    return out


def _set_bytes(h: np.ndarray) -> bytes:
    return _key_bytes(h)


def _set(raw: bytes) -> np.ndarray:
    return _keys(raw, 0)


class RTree:
    """Points packed by size and then by their largest spread, in leaves and one level above; a node knows its upper corner and smallest set."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        spread = points.std(axis=0).argsort()[::-1][:2]
        self.order = np.lexsort((points[:, spread[1]] if len(spread) > 1 else sizes, points[:, spread[0]], sizes))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.leaf_corner, self.leaf_least = self._up(self.points, self.sizes)
        self.node_corner, self.node_least = self._up(self.leaf_corner, self.leaf_least)

    @staticmethod
    def _up(corner: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(0, len(corner), LEAF)
        return np.maximum.reduceat(corner, at, axis=0), np.minimum.reduceat(least, at)

    def search(self, point: np.ndarray, size: int, similarity: Similarity) -> np.ndarray:
        """Places (in the given order of points) whose bound allows similarity with a set of that point and size."""

        def open_(corner: np.ndarray, least: np.ndarray) -> np.ndarray:
            num, den = similarity
            # overlap / (size + other - overlap) >= num / den for the least other that the node holds
            return np.minimum(corner, point).sum(axis=1) * (num + den) >= num * (size + least)

        nodes = np.flatnonzero(open_(self.node_corner, self.node_least))
        leaves = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
        leaves = leaves[leaves < len(self.leaf_least)]
        leaves = leaves[open_(self.leaf_corner[leaves], self.leaf_least[leaves])]
        rows = (leaves[:, None] * LEAF + np.arange(LEAF)).ravel()
        rows = rows[rows < len(self.sizes)]
        return self.order[rows[open_(self.points[rows], self.sizes[rows])]]


def joined(ids: np.ndarray, sets: list[np.ndarray], similarity: Similarity, ask: np.ndarray | None = None) -> np.ndarray:
    """For each document of a cell the smallest place of its component. ask: only these documents descend the tree."""
    num, den = similarity
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    whole = np.concatenate(sets)
    points = count_vectors(whole, owner, len(sets))
    tree, root = RTree(points, sizes), list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(sets)) if ask is None else ask.tolist():
        mine = sets[i]
        for j in tree.search(points[i], int(sizes[i]), similarity).tolist():
            a, b = find(i), find(j)
            if a == b or (ask is None and j > i):
                continue
            common = len(np.intersect1d(mine, sets[j], assume_unique=True))
            if common * den >= num * (len(mine) + len(sets[j]) - common):
                root[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(len(sets))], np.int64)


def _cells(placed: DataFrame, similarity: Similarity, keys: tuple[str, ...] = ("class",), ask: bool = False) -> DataFrame:
    """placed: (*keys, id, blob[, asks]), the keys name a cell. Links (a, b): a document and the smallest of its component in the cell."""
    names = ["id", "blob"] + ["asks"] * ask

    def settle(ids: list[int], blobs: list[bytes], asks: list[bool]) -> pd.DataFrame:
        order = np.argsort(np.array(ids, np.int64), kind="stable")
        ids_ = np.array(ids, np.int64)[order]
        root = joined(ids_, [_set(blobs[i]) for i in order], similarity, np.flatnonzero(np.array(asks)[order]) if ask else None)
        moved = root != np.arange(len(root))
        return pd.DataFrame({"a": ids_[moved], "b": ids_[root[moved]]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        now, held = None, ([], [], [])
        for batch in batches:
            cell = zip(*(batch.column(c).to_pylist() for c in keys), strict=True)
            columns = [batch.column(c).to_pylist() for c in names] + [[True] * batch.num_rows] * (not ask)
            for key, i, blob, asks in zip(cell, *columns, strict=True):
                if key != now:
                    if len(held[0]) > 1:
                        yield settle(*held)
                    now, held = key, ([], [], [])
                for x, y in zip(held, (i, blob, asks), strict=True):
                    x.append(y)
        if len(held[0]) > 1:
            yield settle(*held)

    def arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pdf in run(batches):
            if len(pdf):
                yield pa.RecordBatch.from_pandas(pdf, preserve_index=False)

    dealt = placed.select(*keys, *names).repartition(partitions(placed.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(freed(arrow), "a long, b long")


_LOOKED = "kind int, block long, place int, part int, a long, b long, n long, blob binary"


def _looked(blocks: DataFrame, n: int, similarity: Similarity) -> DataFrame:
    """One pass over blocks with counts, written by kind.

    0: a document (a: id, n: size of its set). 1: keys with their documents, by part. 2: a candidate's set.
    3: a link between equal sets. 4: a hot key (b) and its smallest document in the block. 5: a tie by a hot key in the block.
    """
    parts = parts_of(blocks.sparkSession)

    def hashes(rows: pa.RecordBatch) -> np.ndarray:
        h, row, _, _, ok, first = _read(rows, n)
        return mix64(h[(ok & (first == np.arange(len(first))))[row]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data, replies in zip(batch.column("block").to_pylist(), batch.column("data"), batch.column("replies"), strict=True):
                rows = unseal(data.as_py())
                h, row, sizes, ids, ok, first = _read(rows, n)
                place, null = np.arange(len(ids)), [None] * len(ids)
                yield _rows(0, block, place, null, rows.column("doc_id").to_pylist(), null, sizes, null)
                used = (ok & (first == place))[row]
                h, row = h[used], row[used]
                code = counts_of(mix64(h), replies.as_py(), parts)
                at = rare(h, row, np.where(first == place, sizes, 0), code, similarity)
                chosen = np.unique(row[at])
                mine = np.isin(row, chosen)
                h_, sizes_ = h[mine], sizes[chosen]
                points = coded(count_vectors(h_, np.repeat(np.arange(len(chosen)), sizes_), len(chosen)))
                owner, key, hot = np.searchsorted(chosen, row[at]), h[at], (1 << code[at].astype(int)) > HOT
                part, counts, blobs = _key_rows(key[~hot], owner[~hot], ids[chosen], sizes_, points, parts)
                none = [None] * len(part)
                yield _rows(1, block, none, part, none, none, counts, blobs)
                none, ends = [None] * len(chosen), np.cumsum(sizes_)
                yield _rows(2, block, chosen, none, ids[chosen], none, sizes_, [_set_bytes(h_[e - s : e]) for e, s in zip(ends, sizes_, strict=True)])
                other = np.flatnonzero(ok & (first != place))
                none = [None] * len(other)
                yield _rows(3, block, none, none, ids[other], ids[first[other]], none, none)
                key, doc = key[hot], ids[chosen][owner[hot]]
                order = np.lexsort((doc, key))
                key, doc = key[order], doc[order]
                new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else []
                none = [None] * len(new)
                yield _rows(4, block, none, none, doc[new], key[new].astype(np.int64), none, none)
                head = np.repeat(doc[new], np.diff(np.append(new, len(key)))) if len(key) else doc
                a, b = _pairs(doc[doc != head], head[doc != head])
                none = [None] * len(a)
                yield _rows(5, block, none, none, a, b, none, none)

    return written_by_kind(with_counts(blocks, hashes).mapInArrow(freed(run), _LOOKED))


def _key_rows(keys: np.ndarray, owner: np.ndarray, ids: np.ndarray, sizes: np.ndarray, points: np.ndarray, parts: int) -> tuple[list[int], list[int], list[bytes]]:
    """Keys with id, size and point of their documents, by part of the exchange: parts, counts, bytes."""
    distinct, at, _ = _split(mix64(keys), parts)
    order = np.argsort(at.ravel(), kind="stable")
    whole, owner = distinct[at.ravel()[order]], owner[order]
    cut = list(_by_part(whole))
    pack = lambda a, b: b"".join([_key_bytes(whole[a:b]), ids[owner[a:b]].astype("<i8").tobytes(), sizes[owner[a:b]].astype("<i8").tobytes(), points[owner[a:b]].tobytes()])
    return [p for p, _, _ in cut], [b - a for _, a, b in cut], [pack(a, b) for _, a, b in cut]


def _read(rows: pa.RecordBatch, n: int):
    h, row, sizes = shingles(rows, n)
    doc = rows.column("doc_id")
    ids = np.array([0 if i is None else i for i in doc.to_pylist()], np.int64)
    ok = (sizes > 0) & np.array(doc.is_valid().to_pylist(), bool)
    return h, row, sizes, ids, ok, firsts(h, row, sizes, ids, ok)


def _rows(kind: int, block: int, place, part, a, b, n, blob) -> pa.RecordBatch:
    m = len(place)
    columns = [([kind] * m, pa.int32()), ([block] * m, pa.int64()), (place, pa.int32()), (part, pa.int32()), (a, pa.int64()), (b, pa.int64()), (n, pa.int64()), (blob, pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], names=[f.split()[0] for f in _LOOKED.split(", ")])


def written_by_kind(df: DataFrame) -> DataFrame:
    return written(df, "looked", by="kind")


def _ties(looked: DataFrame, similarity: Similarity) -> DataFrame:
    """Links (a, b) whose classes hold all similar pairs: documents of one key whose count vectors allow similarity, and all of a hot key."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in runs(batches, "part", ("n", "blob")):
            key, doc, size, point = [], [], [], []
            for n, blob in rows:
                key.append(_keys(blob[: 6 * n], part))
                doc.append(np.frombuffer(blob, "<i8", n, 6 * n))
                size.append(np.frombuffer(blob, "<i8", n, 14 * n))
                point.append(np.frombuffer(blob, np.uint8, GROUPS * n, 22 * n).reshape(n, GROUPS))
            a, b = tied(np.concatenate(key), np.concatenate(doc), np.concatenate(size), np.concatenate(point), similarity)
            if len(a):
                a, b = forest(a, b)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    keys = looked.filter("kind = 1").select("part", "n", "blob")
    near = keys.repartition(partitions(keys.sparkSession), "part").sortWithinPartitions("part").mapInArrow(freed(meet), "a long, b long")
    hot = looked.filter("kind = 4").select("a", "b")
    heads = hot.groupBy(F.col("b").alias("key")).agg(F.min("a").alias("head"))
    over = hot.join(heads.hint("merge"), F.col("b") == F.col("key")).filter("a <> head").select("a", F.col("head").alias("b"))
    return near.unionByName(over).unionByName(looked.filter("kind = 5").select("a", "b"))


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once."""
    order = np.lexsort((a, b))
    a, b = a[order], b[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.empty(0, bool)
    return a[new], b[new]


_TILED = "class long, tile long, id long, n long, blob binary, point binary"


def _tiles(large: DataFrame) -> DataFrame:
    """large: (class, id, n, blob). The same in tiles of at most CELL documents and WEIGHT elements, near in size and least element, with count vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        now, held, weight, number = None, 0, 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            tile, points = [], []
            for own, n, blob in zip(*(batch.column(c).to_pylist() for c in ("class", "n", "blob")), strict=True):
                if now is not None and (own != now or held >= CELL or weight + n > WEIGHT):
                    number, held, weight = number + 1, 0, 0
                now, held, weight = own, held + 1, weight + n
                tile.append(number)
                points.append(coded(count_vectors(_set(blob), np.zeros(n, np.int64), 1)).tobytes())
            columns = [batch.column("class"), pa.array(tile, pa.int64()), batch.column("id"), batch.column("n"), batch.column("blob"), pa.array(points, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _TILED.split(", ")])

    order = ["class", F.floor(F.log("n") * 10), F.substring("blob", 1, 6), "id"]
    dealt = large.select("class", "id", "n", "blob").repartitionByRange(partitions(large.sparkSession), *order).sortWithinPartitions(*order)
    return written(dealt.mapInArrow(freed(run), _TILED), "tiles")


def _nodes(tiles: DataFrame) -> DataFrame:
    """The upper levels of each large cell's R-tree: (class, node, number, least, corner), the tiles' smallest sizes and upper corners, FAN tiles to a node."""

    def corner(pdf: pd.DataFrame) -> pd.DataFrame:
        top = np.max([np.frombuffer(p, np.uint8) for p in pdf["point"]], axis=0)
        return pd.DataFrame({"class": pdf["class"][:1], "tile": pdf["tile"][:1], "least": [pdf["n"].min()], "corner": [top.tobytes()]})

    each = tiles.select("class", "tile", "n", "point").groupBy("class", "tile").applyInPandas(corner, "class long, tile long, least long, corner binary")
    node = F.col("tile") - F.pmod("tile", F.lit(FAN))
    return each.groupBy("class", node.alias("node")).agg(F.collect_list(F.struct("tile", "least", "corner")).alias("tiles"))


def _descended(asking: DataFrame, nodes: DataFrame, similarity: Similarity) -> DataFrame:
    """asking: (class, id, n, point). (class, tile, id) of the tiles whose corner allows similarity."""
    num, den = similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for own, i, n, point, tiles in zip(*(batch.column(c).to_pylist() for c in ("class", "id", "n", "point", "tiles")), strict=True):
                corners = STEPS[np.stack([np.frombuffer(t["corner"], np.uint8) for t in tiles])]
                mine, least = STEPS[np.frombuffer(point, np.uint8)], np.array([t["least"] for t in tiles])
                open_ = np.minimum(corners, mine).sum(axis=1) * (num + den) >= num * (n + least)
                out += [(own, tiles[k]["tile"], i) for k in np.flatnonzero(open_)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["class", "tile", "id"])

    return asking.join(nodes.hint("merge"), "class").select("class", "id", "n", "point", "tiles").mapInArrow(freed(run), "class long, tile long, id long")


def _large(large: DataFrame, similarity: Similarity) -> DataFrame:
    """Links of the cells over CELL or WEIGHT: (class, id, n, blob)."""
    tiles = _tiles(large)
    heads = tiles.filter("id = class").select("class", "id", "blob").join(tiles.select("class", "tile").distinct().hint("merge"), "class")
    inner = tiles.filter("id <> class").select("class", "tile", "id", "blob").unionByName(heads)
    found = written(_cells(inner, similarity, ("class", "tile")), "tile-links")
    roots = components(found, thin=False).select(F.col("node").alias("id"), "component")
    apart = tiles.join(roots.hint("merge"), "id", "left").filter(F.coalesce("component", "id") != F.col("class")).drop("component", "tile")
    apart = written(apart, "apart")
    if not apart.limit(1).count():
        return found
    asks = written(_descended(apart.select("class", "id", "n", "point"), _nodes(tiles), similarity), "asks")
    pieces = asks.groupBy("class", "tile").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("pieces"))
    dealt = asks.join(pieces.hint("merge"), ["class", "tile"]).withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")).drop("pieces")
    asking = dealt.join(apart.select("id", "blob").hint("merge"), "id").withColumn("asks", F.lit(True))
    there = tiles.join(pieces.hint("merge"), ["class", "tile"]).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    there = there.select("class", "tile", "piece", "id", "blob").withColumn("asks", F.lit(False))
    return found.unionByName(_cells(asking.select(there.columns).unionByName(there), similarity, ("class", "tile", "piece"), ask=True))


def links(looked: DataFrame, similarity: Similarity) -> DataFrame:
    """Links (a, b) with the components of all similar pairs."""
    sets = looked.filter("kind = 2").select(F.col("a").alias("id"), "n", "blob")
    # Classes and sets grow with the input: they meet by shuffle at every size, never as a broadcast.
    classes = components(_ties(looked, similarity), thin=False).hint("merge")
    placed = written(sets.join(classes, F.col("id") == F.col("node")).select(F.col("component").alias("class"), "id", "n", "blob"), "cells")
    over = placed.groupBy("class").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("weight")).filter((F.col("rows") > CELL) | (F.col("weight") > WEIGHT))
    over = written(over.select("class"), "large")
    found = looked.filter("kind = 3").select("a", "b")
    if not over.limit(1).count():
        return found.unionByName(_cells(placed, similarity))
    small = _cells(placed.join(over.hint("merge"), "class", "left_anti"), similarity)
    return found.unionByName(small).unionByName(_large(placed.join(over.hint("merge"), "class", "left_semi"), similarity))


def classes(docs: DataFrame, n: int = 5, similarity: Similarity = (8, 10), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    blocks = packed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), block_bytes)
    looked = _looked(blocks, n, similarity)
    discard(blocks)
    found = components(links(looked, similarity), thin=False)
    rows = looked.filter("kind = 0").select(F.col("a").alias("doc_id"), F.col("n").alias("n_shingles"))
    return rows.join(found, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, n: int = 5, similarity: Similarity = (8, 10), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that stay: of each group of linked documents the one of smallest doc_id, all columns as they were."""
    blocks = packed(docs, block_bytes)
    looked = _looked(blocks, n, similarity)
    found = components(links(looked, similarity), thin=False).filter("node <> component")
    rows = looked.filter("kind = 0").select("block", "place", F.col("a").alias("node"))
    gone = rows.join(found, "node", "left_semi").groupBy("block").agg(F.collect_list("place").alias("gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, places in zip(batch.column("data"), batch.column("gone"), strict=True):
                rows = unseal(data.as_py())
                stays = np.ones(rows.num_rows, bool)
                stays[places.as_py() or []] = False
                yield rows.filter(pa.array(stays))

    return blocks.join(gone, "block", "left").mapInArrow(freed(run), docs.schema)
