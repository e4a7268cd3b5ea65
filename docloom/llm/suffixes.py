"""Suffix-array dedup of byte windows by a depth-limited radix sort, most significant digits first.

A byte goes when a ``width``-byte string over it also starts in a document of smaller doc_id. Suffixes need
ordering only through ``width`` bytes, and only groups of equal prefixes matter, so each pass sorts by a
further digit and drops what is alone. Every window picks a gram of ``GRAM`` bytes from itself, the one of
least hash: equal windows pick equal grams at equal places, so only suffixes at picked grams take part, and a
window is the gram's digit with bytes right of it and bytes left of it.

1. Blocks exchange hashes of the picked grams and learn how often each stands; grams that stand once go.
2. Survivors travel to their gram's part with the bytes around them. There the digits of the gram, eight bytes
   a pass, group them by the bytes themselves; then eight bytes a pass of what stands right and left settle
   whole surroundings; what is still open is sorted byte by byte, right of the gram and left of it, and the
   groups at depth j to the right and ``width - GRAM - j`` to the left are the repeated windows.
3. Grams found more than ``HOT`` times are not sent to one part. Blocks exchange hashes of longer strings around
   them, common to ``RANGE`` windows, and what stands once goes. Of what is left each block sends its distinct
   windows once, with their smallest doc_id, to parts by the whole window: a part gets a window at most once from
   a block, however often it stands, and answers with a bit.

Hashes only choose grams and parts; windows count as equal by their bytes. Within a block, equal surroundings
are settled on the spot and only those of the smallest doc_id are sent; equal surroundings of one document
that follow each other closely (runs of a byte, short periods) are one row.

Defined cases: a null or empty text has no windows and nothing removed; texts under ``width`` bytes neither;
rows with one doc_id never take from each other; a null doc_id counts as larger than all others; an empty
table gives no rows; all columns of the documents come back, whatever their names; texts of any length are
worked through in stretches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import BLOCK_BYTES, counts_of, mix64, packed, parts_of, runs, seal, texts, unseal, with_counts
from .common import freed, kept, partitions, written

WIDTH = 50
GRAM = 20
STRETCH = 1 << 20
#: Places of one gram that one task sorts, a power of two; and places whose surroundings are looked at together.
HOT = 4_096
#: Neighbouring windows around a gram found often that are looked for together.
RANGE = 8
SLICE = 50_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_LAST = 2**63 - 1
_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}
kept("powers", _cache.clear)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if n not in _cache:
        one = np.ones(1, np.uint64)
        _cache.clear()
        _cache[n] = tuple(np.concatenate([one, np.cumprod(np.full(n, b, np.uint64))]) for b in (_BASE, _INVERSE))
    return _cache[n]


def _over(x: np.ndarray, n: int, f) -> np.ndarray:
    """f over each n neighbouring values."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x, have = f(x[:-step], x[step:]), have + step
    return x


def rolling(x: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n neighbouring bytes, along the last axis."""
    size = x.shape[-1]
    up, down = powers(max(STRETCH + WIDTH, size))
    sums = np.zeros((*x.shape[:-1], size + 1), np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[:size], axis=-1, out=sums[..., 1:])
    return mix64((sums[..., n:] - sums[..., :-n]) * down[: size - n + 1])


def picked(data: np.ndarray, ends: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places (ascending) of the grams that the windows inside documents pick, and the grams' hashes. ends: 0 and each document's end."""
    span = width - gram + 1
    inside = np.zeros(len(data) + 1, bool)
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        inside[a : max(a, b - width + 1)] = True
    places, found = [], []
    for s in range(0, max(0, len(data) - width + 1), STRETCH):
        x = data[s : s + STRETCH + width - 1]
        h = rolling(x, gram)
        least = _over(h, span, np.minimum)
        least[~inside[s : s + len(least)]] = 0
        pad = np.zeros(span - 1, np.uint64)
        at = np.flatnonzero((_over(np.concatenate([pad, least, pad]), span, np.maximum) == h) & (h > 0))
        places.append(at + s)
        found.append(h[at])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    place, hashes = np.concatenate(places), np.concatenate(found)
    place, first = np.unique(place, return_index=True)
    return place, hashes[first]


def _hash_rows(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of bytes."""
    up, _ = powers(STRETCH + WIDTH)
    return mix64(((rows.astype(np.uint64) + np.uint64(1)) * up[: rows.shape[1]]).sum(axis=1, dtype=np.uint64))


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and touching stretches joined."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]]) if len(start) else np.empty(0, bool)
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]]) if len(start) else np.empty(0, int)
    return start[new], end[last]


def _first_of_runs(*sorted_keys: np.ndarray) -> np.ndarray:
    """Number of the run of equal keys at each place."""
    n = len(sorted_keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new) - 1


def groups(*keys: np.ndarray) -> np.ndarray:
    """The same number for rows with the same keys."""
    order = np.lexsort(keys[::-1])
    out = np.empty(len(order), np.int64)
    out[order] = _first_of_runs(*(k[order] for k in keys))
    return out


def least_of(group: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The least value of each row's group."""
    least = np.full(int(group.max()) + 1 if len(group) else 0, _LAST, np.int64)
    np.minimum.at(least, group, values)
    return least[group]


def by_digits(group: np.ndarray, doc: np.ndarray, digits: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Radix passes: groups divided by one digit after the other. Rows without another document in their group drop out; returns the rows left and their groups."""
    left = np.arange(len(group))
    for digit in (None, *digits):
        if digit is not None:
            group = groups(group, digit[left])
        most = -least_of(group, -doc[left])
        stays = least_of(group, doc[left]) < most
        left, group = left[stays], group[stays]
    return left, group


def words(rows: np.ndarray) -> list[np.ndarray]:
    """Rows of bytes as digits of eight bytes, first bytes first."""
    whole = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    whole[:, : rows.shape[1]] = rows
    return list(whole.view(">u8").astype(np.uint64).T)


def _divided(group: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return np.unique(group * 256 + byte, return_inverse=True)[1].ravel()


def refine(around: np.ndarray, left: np.ndarray, right: np.ndarray, gram_group: np.ndarray, doc: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, window) of the windows that also stand in a row of smaller doc; window j covers bytes j to j + width of the surroundings."""
    side, n = width - gram, len(doc)
    after, before = [gram_group.astype(np.int64)], [np.zeros(n, np.int64)]
    for d in range(side):
        after.append(_divided(after[-1], around[:, side + gram + d]))
        before.append(_divided(before[-1], around[:, side - 1 - d]))
    rows, windows = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for j in range(side + 1):
        ok = np.flatnonzero((side - j <= left) & (j <= right))
        group = np.unique(after[j][ok] * n + before[side - j][ok], return_inverse=True)[1].ravel()
        covered = ok[doc[ok] > least_of(group, doc[ok])]
        rows.append(covered)
        windows.append(np.full(len(covered), j))
    return np.concatenate(rows), np.concatenate(windows)


_SENT = "kind int, part int, block long, n int, data binary"
_ARROW = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
_NAMES = ["kind", "part", "block", "n", "data"]
SETTLED, OPEN, OFTEN = 0, 1, 2


def _dense(*arrays: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


class Places:
    """Places of grams with what stands around them: rows of doc, place, run (from the first to the last place that the row stands for), left and right (bytes at hand), around."""

    def __init__(self, doc, place, run, left, right, around):
        self.doc, self.place, self.run, self.left, self.right, self.around = doc, place, run, left, right, around

    def __getitem__(self, at) -> Places:
        return Places(*(x[at] for x in (self.doc, self.place, self.run, self.left, self.right, self.around)))

    def __len__(self) -> int:
        return len(self.doc)

    def packed(self) -> bytes:
        return _dense(self.doc, self.place, self.run, self.left.astype(np.uint8), self.right.astype(np.uint8), self.around)

    @classmethod
    def of(cls, n: int, data: bytes, size: int) -> Places:
        import zstandard

        raw = zstandard.ZstdDecompressor().decompress(data)
        doc, place, run = (np.frombuffer(raw, "<i8", n, 8 * n * i) for i in range(3))
        left, right = (np.frombuffer(raw, np.uint8, n, 24 * n + n * i).astype(np.int64) for i in range(2))
        return cls(doc, place, run, left, right, np.frombuffer(raw, np.uint8, n * size, 26 * n).reshape(n, size))

    def equal(self, hashes: np.ndarray) -> np.ndarray:
        """Groups of equal surroundings: found by hash, and told apart by bytes where hashes agree by chance."""
        group = groups(hashes, _hash_rows(self.around), self.left * 256 + self.right)
        _, first = np.unique(group, return_index=True)
        other = np.flatnonzero((self.around != self.around[first[group]]).any(axis=1))
        group[other] = len(group) + np.arange(len(other))
        return np.unique(group, return_inverse=True)[1].ravel()


def look_around(raw: np.ndarray, ends: np.ndarray, place: np.ndarray, hashes: np.ndarray, ids: np.ndarray, width: int, gram: int) -> tuple[Places, np.ndarray]:
    """The surroundings of places, and the gram's hash of each row. Slice by slice, equal ones of one document at most a window apart become one row."""
    side = width - gram
    size = 2 * side + gram
    padded = np.concatenate([np.zeros(side, np.uint8), raw, np.zeros(side, np.uint8)])
    step, found, kept = np.arange(size)[None, :], [], []
    for x in range(0, len(place), SLICE):
        at = place[x : x + SLICE]
        owner = np.searchsorted(ends, at, side="right") - 1
        left, right = np.minimum(side, at - ends[owner]), np.minimum(side, ends[owner + 1] - at - gram)
        around = np.lib.stride_tricks.sliding_window_view(padded, size)[at]
        around[(step < side - left[:, None]) | (step >= side + gram + right[:, None])] = 0
        rows = Places(ids[owner], at, np.zeros(len(at), np.int64), left, right, around)
        same = groups(rows.equal(hashes[x : x + SLICE]), owner)
        order = np.argsort(same, kind="stable")
        new = np.concatenate([[True], (same[order][1:] != same[order][:-1]) | (np.diff(at[order]) > width)])
        first, last = order[new], order[np.append(np.flatnonzero(new)[1:], len(order)) - 1]
        rows.run[first] = at[last] - at[first]
        found.append(rows[first])
        kept.append(hashes[x : x + SLICE][first])
    return Places(*(np.concatenate([getattr(r, c) for r in found]) for c in ("doc", "place", "run", "left", "right", "around"))), np.concatenate(kept)


def _surroundings(counted: DataFrame, parts: int, width: int, gram: int) -> DataFrame:
    """From blocks with counts: what the block itself settles, the other repeated grams' surroundings by part, and those of grams found often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data, replies in zip(batch.column("block").to_pylist(), batch.column("data"), batch.column("replies"), strict=True):
                rows = unseal(data.as_py())
                raw, ends = texts(rows)
                place, hashes = picked(raw, ends, width, gram)
                code = counts_of(hashes, replies.as_py(), parts)
                place, hashes, code = place[code > 0], hashes[code > 0], code[code > 0]
                if not len(place):
                    continue
                ids = np.array([_LAST if d is None else d for d in rows.column("doc_id").to_pylist()], np.int64)
                code_of, at = np.unique(hashes, return_index=True)
                code = code[at]
                found, hashes = look_around(raw, ends, place, hashes, ids, width, gram)
                often = (1 << code[np.searchsorted(code_of, hashes)].astype(int)) > HOT
                settled = found.doc > least_of(found.equal(hashes), found.doc)
                done = found[settled]
                a, b = merged(done.place - done.left, done.place + done.run + gram + done.right)
                out = [(SETTLED, block % parts, block, len(a), _dense(a, b))] if len(a) else []
                if len(more := found[often & ~settled]):
                    out += [(OFTEN, block % parts, block, len(more), more.packed())]
                part = ((hashes & np.uint64(0xFFFF)) % np.uint64(parts)).astype(np.int64)
                keep = np.flatnonzero(~settled & ~often)
                keep = keep[np.argsort(part[keep], kind="stable")]
                edges = np.flatnonzero(np.concatenate([[True], part[keep][1:] != part[keep][:-1], [True]])) if len(keep) else [0]
                out += [(OPEN, int(part[keep[x]]), block, y - x, found[keep[x:y]].packed()) for x, y in zip(edges[:-1], edges[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _ARROW, strict=True)], names=_NAMES)

    return counted.mapInArrow(freed(run), _SENT).repartition(partitions(counted.sparkSession), "part")


def _by_block(block: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.argsort(block, kind="stable")
    block, start, end = block[order], start[order], end[order]
    edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])) if len(block) else [0]
    out = []
    for x, y in zip(edges[:-1], edges[1:], strict=True):
        a, b = merged(start[x:y], end[x:y])
        out.append((SETTLED, None, int(block[x]), len(a), _dense(a, b)))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _ARROW, strict=True)], names=_NAMES)


def settle(held: list[tuple[int, int, bytes]], width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """held: (block, n, data) of a part. (block, start, end) of the stretches to remove."""
    side = width - gram
    each = [Places.of(n, data, 2 * side + gram) for _, n, data in held]
    rows = Places(*(np.concatenate([getattr(r, c) for r in each]) for c in ("doc", "place", "run", "left", "right", "around")))
    block = np.repeat([b for b, _, _ in held], [n for _, n, _ in held])
    # Digits of the gram: rows left share all its bytes with another document.
    left, gram_group = by_digits(np.zeros(len(rows), np.int64), rows.doc, iter(words(rows.around[:, side : side + gram])))
    rows, block = rows[left], block[left]
    # Digits right and left of it: rows left have their whole surroundings in another document.
    both = np.concatenate([rows.around[:, side + gram :], rows.around[:, :side][:, ::-1]], axis=1)
    whole, same = by_digits(groups(gram_group, rows.left * 256 + rows.right), rows.doc, iter(words(both)))
    covered = np.zeros(len(rows), bool)
    covered[whole] = rows.doc[whole] > least_of(same, rows.doc[whole])
    done = rows[covered]
    found = [(block[covered], done.place - done.left, done.place + done.run + gram + done.right)]
    # What is open meets byte by byte, unless the whole surroundings are all that the gram has.
    kind = len(rows) + np.arange(len(rows))
    kind[whole] = same
    open_ = np.flatnonzero(~covered)
    varied = np.zeros(int(gram_group.max()) + 1 if len(rows) else 0, np.int64)
    _, first = np.unique(kind[open_], return_index=True)
    np.add.at(varied, gram_group[open_[first]], 1)
    open_ = open_[varied[gram_group[open_]] > 1]
    open_ = open_[np.argsort(gram_group[open_], kind="stable")]
    at = 0
    while at < len(open_):  # grams go in turns
        end = min(len(open_), at + 40_000)
        end = int(np.searchsorted(gram_group[open_], gram_group[open_[end - 1]], side="right"))
        k = open_[at:end]
        row, j = refine(rows.around[k], rows.left[k], rows.right[k], gram_group[k], rows.doc[k], width, gram)
        start = rows.place[k[row]] - side + j
        found.append((block[k[row]], start, start + rows.run[k[row]] + width))
        at = end
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _covered(sent: DataFrame, width: int, gram: int) -> DataFrame:
    """Stretches of each block's bytes to remove, as starts and ends (kind SETTLED), and the rows of grams found often as they came, written by kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: list[pa.RecordBatch] = []

        def opened() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                is_open = pa.compute.equal(batch.column("kind"), OPEN)
                passed.append(batch.filter(pa.compute.invert(is_open)))
                yield batch.filter(is_open)

        for _, held in runs(opened(), "part", ("block", "n", "data")):
            yield from passed
            passed.clear()
            yield from _by_block(*settle(held, width, gram))
        yield from passed

    return written(sent.sortWithinPartitions("part").mapInArrow(freed(run), _SENT), "spans", by="kind")


def own_windows(p: Places, width: int, gram: int) -> np.ndarray:
    """For each row and window of its surroundings whether it stands inside the document and picks the row's gram."""
    side = width - gram
    h = rolling(p.around, gram)
    j = np.arange(side + 1)
    inside = (side - p.left[:, None] <= j) & (j <= p.right[:, None])
    return inside & (_over(h.T, side + 1, np.minimum).T == h[:, side : side + 1])


def _packed_places(doc, place, run, around, own) -> bytes:
    columns = [pa.array(x, pa.int64()) for x in (doc, place, run)]
    columns += [pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.shape[1]), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]) for x in (around, own.astype(np.uint8))]
    return seal(pa.RecordBatch.from_arrays(columns, names=["doc", "place", "run", "around", "own"]))


def _unpacked(rows: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    def bytes_of(c: pa.Array) -> np.ndarray:
        size = c.type.byte_width
        return np.frombuffer(c.buffers()[1], np.uint8)[c.offset * size : (c.offset + len(c)) * size].reshape(len(c), size)

    return *(rows.column(c).to_numpy() for c in ("doc", "place", "run")), bytes_of(rows.column("around")), bytes_of(rows.column("own")) > 0


def common_strings(around: np.ndarray, own: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, int, int, np.ndarray]]:
    """(rows, from, to, hash): for each RANGE of neighbouring windows the rows that have one of them, and the bytes common to the range."""
    for lo in range(0, own.shape[1], RANGE):
        hi = min(own.shape[1], lo + RANGE)
        rows = np.flatnonzero(own[:, lo:hi].any(axis=1))
        yield rows, lo, hi, rolling(around[rows, hi - 1 : lo + width], width - (hi - 1 - lo)).ravel()


class Windows:
    """The distinct windows of a pack: group (of each row and window, as row and at), and of each group least (the smallest doc), part and data. In order of parts."""

    def __init__(self, doc: np.ndarray, around: np.ndarray, own: np.ndarray, width: int, parts: int):
        self.row, self.at = np.nonzero(own)
        step = np.arange(width)
        h = np.concatenate([np.empty(0, np.uint64), *(rolling(around[x : x + SLICE], width)[own[x : x + SLICE]] for x in range(0, len(own), SLICE))])
        part = (h & np.uint64(0xFFFF)) % np.uint64(parts)
        order = np.lexsort((h, part))
        self.group = np.empty(len(h), np.int64)
        self.group[order] = _first_of_runs(h[order])
        _, first = np.unique(self.group, return_index=True)
        other = []  # of equal hash by chance: groups of their own, which bytes settle in their part
        for x in range(0, len(h), SLICE):
            k = np.arange(x, min(len(h), x + SLICE))
            f = first[self.group[k]]
            other.append(k[(around[self.row[k, None], self.at[k, None] + step] != around[self.row[f, None], self.at[f, None] + step]).any(axis=1)])
        if other and len(other := np.concatenate(other)):
            alone = np.zeros(len(h), np.int64)
            alone[other] = 1 + np.arange(len(other))
            self.group = groups(part.astype(np.int64), self.group, alone)
            _, first = np.unique(self.group, return_index=True)
        self.part = part[first].astype(np.int64)
        self.data = around[self.row[first, None], self.at[first, None] + step]
        self.doc = doc[self.row]
        self.least = np.full(len(first), _LAST, np.int64)
        np.minimum.at(self.least, self.group, self.doc)

    def by_part(self) -> Iterator[tuple[int, int, int]]:
        edges = np.flatnonzero(np.concatenate([[True], self.part[1:] != self.part[:-1], [True]])) if len(self.part) else [0]
        yield from ((int(self.part[a]), int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True))


def _often(rows: DataFrame, width: int, gram: int) -> DataFrame:
    """rows: those of grams found often, in packs by block. (kind, part, block, n, data): their stretches to remove.

    Packs stay packs: first they exchange hashes of what RANGE neighbouring windows have in common, and windows whose
    common bytes stand once go. Then each pack sends its distinct windows once, with the smallest doc, to parts by
    their hash, where bytes decide, and gets a bit for each: whether another pack has it in a smaller doc.
    """
    spark, side, parts = rows.sparkSession, width - gram, parts_of(rows.sparkSession)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, n, data in zip(*(batch.column(c).to_pylist() for c in ("block", "n", "data")), strict=True):
                p = Places.of(n, data, 2 * side + gram)
                own = np.concatenate([own_windows(p[x : x + SLICE], width, gram) for x in range(0, n, SLICE)])
                some = own.any(axis=1)
                if some.any():
                    packed_ = _packed_places(p.doc[some], p.place[some], p.run[some], p.around[some], own[some])
                    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([packed_], pa.binary())], names=["block", "data"])

    def hashes(batch: pa.RecordBatch) -> np.ndarray:
        *_, around, own = _unpacked(batch)
        return np.concatenate([h for *_, h in common_strings(around, own, width)])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data, replies in zip(batch.column("block").to_pylist(), batch.column("data"), batch.column("replies"), strict=True):
                doc, place, run, around, own = _unpacked(unseal(data.as_py()))
                ranges, own = list(common_strings(around, own, width)), own.copy()
                code = counts_of(np.concatenate([h for *_, h in ranges]), replies.as_py(), parts)
                for k, lo, hi, h in ranges:
                    own[k[code[: len(h)] == 0], lo:hi] = False
                    code = code[len(h) :]
                some = own.any(axis=1)
                if some.any():
                    packed_ = _packed_places(doc[some], place[some], run[some], around[some], own[some])
                    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([packed_], pa.binary())], names=["block", "data"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data"), strict=True):
                doc, _, _, around, own = _unpacked(unseal(data.as_py()))
                w = Windows(doc, around, own, width, parts)
                out = [(OFTEN, p, block, b - a, _dense(w.least[a:b], w.data[a:b])) for p, a, b in w.by_part()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _ARROW, strict=True)], names=_NAMES)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for part, held in runs(batches, "part", ("block", "n", "data")):
            raw = [zstandard.ZstdDecompressor().decompress(d) for *_, d in held]
            least = np.concatenate([np.frombuffer(r, "<i8", n) for (_, n, _), r in zip(held, raw, strict=True)])
            found = np.concatenate([np.frombuffer(r, np.uint8, n * width, 8 * n) for (_, n, _), r in zip(held, raw, strict=True)]).reshape(-1, width)
            covered = least > least_of(groups(*words(found)), least)
            ends = np.cumsum([n for _, n, _ in held]).tolist()
            bits = [np.packbits(covered[e - n : e]).tobytes() for e, (_, n, _) in zip(ends, held, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in held], pa.int64()), pa.array([part] * len(held), pa.int32()), pa.array(bits, pa.binary())], names=["block", "part", "bits"])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data, replies in zip(batch.column("block").to_pylist(), batch.column("data"), batch.column("replies"), strict=True):
                doc, place, run, around, own = _unpacked(unseal(data.as_py()))
                w, bits = Windows(doc, around, own, width, parts), {r["part"]: r["bits"] for r in replies.as_py()}
                elsewhere = np.concatenate([np.unpackbits(np.frombuffer(bits[p], np.uint8), count=b - a) for p, a, b in w.by_part()]) > 0
                gone = elsewhere[w.group] | (w.doc > w.least[w.group])
                row, start = w.row[gone], place[w.row[gone]] - side + w.at[gone]
                yield from _by_block(np.full(len(row), block), start, start + run[row] + width)

    packs = written(rows.mapInArrow(freed(unpack), "block long, data binary"), "often")
    packs = written(with_counts(packs, hashes).mapInArrow(freed(again), "block long, data binary"), "again")
    sent = packs.mapInArrow(freed(send), _SENT).repartition(partitions(spark), "part").sortWithinPartitions("part")
    replies = sent.mapInArrow(freed(meet), "block long, part int, bits binary").groupBy("block").agg(F.collect_list(F.struct("part", "bits")).alias("replies"))
    return packs.join(replies.hint("merge"), "block").mapInArrow(freed(told), _SENT)


def _marked(docs: DataFrame, width: int, gram: int, block_bytes: int, whole_signs: bool) -> DataFrame:
    """(row, n_bytes, n_removed, n_spans, kept): each row of docs, as a struct, with what goes and what is left of its bytes. whole_signs: UTF-8 sequences cut in two go wholly from kept."""
    spark = docs.sparkSession
    blocks = packed(docs, block_bytes)
    parts = parts_of(spark)
    counted = with_counts(blocks, lambda rows: picked(*texts(rows), width, gram)[1])
    found = _covered(_surroundings(counted, parts, width, gram), width, gram)
    spans, often = found.filter(f"kind = {SETTLED}"), found.filter(f"kind = {OFTEN}")
    if often.limit(1).count():
        spans = spans.unionByName(_often(often, width, gram))
    spans = spans.groupBy("block").agg(F.collect_list("data").alias("spans"))
    counts = ("n_bytes", "n_removed", "n_spans")
    schema = T.StructType([T.StructField("row", docs.schema), *[T.StructField(c, T.LongType()) for c in counts], T.StructField("kept", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for data, spans in zip(batch.column("data"), batch.column("spans"), strict=True):
                rows = unseal(data.as_py())
                raw, ends = texts(rows)
                change = np.zeros(len(raw) + 1, np.int32)
                for span in spans.as_py() or []:
                    both = np.frombuffer(zstandard.ZstdDecompressor().decompress(span), np.int64).reshape(2, -1)
                    np.add.at(change, both[0], 1)
                    np.add.at(change, both[1], -1)
                gone = np.cumsum(change[:-1]) > 0
                total = np.concatenate([[0], np.cumsum(gone)])
                out = []
                for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    if n := int(total[b] - total[a]):
                        mask = gone[a:b]
                        spans_ = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
                        if whole_signs:
                            sign = np.cumsum((raw[a:b] & 0xC0) != 0x80)
                            mask = np.bincount(sign, mask)[sign] > 0
                        out.append((b - a, n, spans_, raw[a:b][~mask].tobytes()))
                    else:
                        out.append((b - a, 0, 0, raw[a:b].tobytes()))
                added = zip(*out, strict=True) if out else ([], [], [], [])
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                row = pa.StructArray.from_arrays(rows.columns, fields=list(rows.schema))
                yield pa.RecordBatch.from_arrays([row, *[pa.array(c, t) for c, t in zip(added, kinds, strict=True)]], names=schema.names)

    return blocks.join(spans.hint("merge"), "block", "left").mapInArrow(freed(run), schema)


def removed(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row, n_bytes, n_removed, n_spans, kept): each row of docs as a struct, its bytes, the bytes that go, their runs, and the bytes left."""
    return _marked(docs, width, gram, block_bytes, False)


def digests(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    out = removed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), block_bytes=block_bytes)
    return out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def trimmed_rows(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents with their texts cut to what is kept; a character cut in two goes. n_chars follows the text where it is a column."""
    out = _marked(docs, WIDTH, GRAM, block_bytes, True)
    cut, text = F.col("n_removed") > 0, F.col("kept").cast("string")
    fields = {f.name: F.col("row").getField(f.name) for f in docs.schema}
    fields["text"] = F.when(cut, text).otherwise(fields["text"])
    if "n_chars" in fields:
        fields["n_chars"] = F.when(cut, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(fields["n_chars"])
    return out.select(*[c.alias(name) for name, c in fields.items()])
