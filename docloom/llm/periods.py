"""Periodic runs of words in each text, and texts with their repetitions collapsed.

A run is a stretch of words with a least period q that no neighbouring word extends. Main's way finds all of them:

1. Suffixes of the words are put in order by doubling; what a level of the doubling leaves together stays as that
   level's groups, from which common prefixes and suffixes of any two places are read. They give the LCP array.
2. The longest previous factor of each place is the larger LCP with the nearest earlier place above and below it
   in that order. Taken from left to right, these factors are the blocks of the Lempel-Ziv parse.
3. Every run that does not lie inside a block with a neighbour on both sides touches a border of blocks. With the
   blocks before and after it of lengths p and f, its period is p + f at most: a run's places from its second
   period on repeat earlier ones to its end, so at most one block starts among them, and it reaches the end. So at
   each border all periods up to p + f are tried, about twice the words in all, and what agrees there is extended
   to both sides.
4. Runs inside a block are copies of runs inside its earlier occurrence: runs are kept in buckets by start, blocks
   are gone through from left to right, and each takes over the buckets of its source.

The documents of a batch are worked on together, as one string in which words of different documents differ. Words
are compared as dictionary codes, so nothing depends on hashes. A task holds one group of about ``GROUP`` bytes of
text, or one longer text.

Defined cases: words are what stands between spaces and the control characters 9 to 13; a null, empty or blank text
has no words, no runs and collapses to nothing; rows are handled one by one, whatever their ids, so repeated rows
give the same result; a null id is never altered by the plant; an empty table gives no rows; other columns take no
part, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import texts
from .common import Batches, freed

GROUP = 2 << 20
#: Words whose bytes are put together at a time.
STRETCH = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def cut(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the words, and the number of words before each document's end; no word spans documents."""
    word = ~_SPACE[raw]
    before = np.concatenate([[False], word[:-1]])
    after = np.concatenate([word[1:], [False]])
    inner = ends[1:-1][(ends[1:-1] > 0) & (ends[1:-1] < len(raw))]
    before[inner] = False
    after[inner - 1] = False
    start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return start, end - start, np.searchsorted(start, ends[1:])


def codes(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The same number for the same word."""
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[start] = 1
    inside[start + length] -= 1
    packed = raw[np.cumsum(inside[:-1]) > 0] if len(raw) else raw
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


class Suffixes:
    """Order and common prefixes of the suffixes of a string of numbers.

    Level k tells places apart by their first 2**k numbers. Of each level from 1 on only the places that share
    theirs are kept, in order, with their group; a place that is not among them agrees with no other.
    """

    def __init__(self, string: np.ndarray):
        n = self.n = len(string)
        self.order = np.argsort(string, kind="stable")
        ranked = string[self.order]
        first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        self.lcp = np.where(first, 0, -1)
        rank = np.empty(n, np.int64)
        rank[self.order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        self.whole = rank.copy()
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        slot = np.flatnonzero(~first | ~np.append(first[1:], True))
        while len(slot):
            at, step = self.order[slot], 1 << len(self.levels)
            group = rank[at]
            next_ = np.where(at + step < n, rank[np.minimum(at + step, n - 1)] + 1, 0)
            by = np.lexsort((next_, group))
            at, group, next_ = at[by], group[by], next_[by]
            self.order[slot] = at
            new_group = np.concatenate([[True], group[1:] != group[:-1]])
            first = new_group | np.concatenate([[True], next_[1:] != next_[:-1]])
            apart = np.flatnonzero(first & ~new_group)
            self.lcp[slot[apart]] = step + self.common(at[apart - 1] + step, at[apart] + step)
            rank[at] = slot[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
            open_ = np.flatnonzero(~first | ~np.append(first[1:], True))
            slot, at = slot[open_], at[open_]
            along = np.argsort(at)
            self.levels.append((at[along], rank[at][along]))

    def _same(self, level: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the 2**level numbers from x and from y agree; False outside of the string."""
        ok = (np.minimum(x, y) >= 0) & (np.maximum(x, y) < self.n)
        if level == 0:
            return ok & (self.whole[np.where(ok, x, 0)] == self.whole[np.where(ok, y, 0)])
        at, group = self.levels[level - 1]
        if not len(at):
            return np.zeros(len(x), bool)
        i, j = (np.minimum(np.searchsorted(at, z), len(at) - 1) for z in (x, y))
        return ok & (at[i] == x) & (at[j] == y) & (group[i] == group[j])

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of what two different places share from there on."""
        total, x, y = np.zeros(len(x), np.int64), x.copy(), y.copy()
        left = np.flatnonzero(self._same(0, x, y)) if len(x) else np.empty(0, np.int64)
        for level in range(len(self.levels), -1, -1):
            if not len(left):
                break
            hit = left[self._same(level, x[left], y[left])]
            for a in (total, x, y):
                a[hit] += 1 << level
        return total

    def common_before(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of what stands before two places and is shared."""
        total, x, y = np.zeros(len(x), np.int64), x.copy(), y.copy()
        for level in range(len(self.levels), -1, -1):
            hit = np.flatnonzero(self._same(level, x - (1 << level), y - (1 << level)))
            total[hit] += 1 << level
            x[hit] -= 1 << level
            y[hit] -= 1 << level
        return total


def _toward(order: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place in the order the nearest before it that is earlier in the string (-1: none), and what both share. lcp[i]: what i and i - 1 share."""
    n = len(order)
    at, least = np.arange(n) - 1, lcp.copy()
    open_ = np.flatnonzero((least > 0) & (at >= 0))
    open_ = open_[order[at[open_]] > order[open_]]
    while len(open_):
        # All between at and the place are later in the string than it, so what holds for at may be skipped too.
        over = at[open_]
        least[open_] = np.minimum(least[open_], least[over])
        at[open_] = at[over]
        open_ = open_[(least[open_] > 0) & (at[open_] >= 0)]
        open_ = open_[order[at[open_]] > order[open_]]
    found = (at >= 0) & (least > 0)
    return np.where(found, order[at], -1), np.where(found, least, 0)


def previous_factors(s: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """For each place the length of the longest factor from there that also starts earlier, and where it does (-1: nowhere)."""
    above, shared_above = _toward(s.order, s.lcp)
    back = np.concatenate([[0], s.lcp[:0:-1]]) if s.n else s.lcp
    below, shared_below = (x[::-1] for x in _toward(s.order[::-1], back))
    length, source = np.empty(s.n, np.int64), np.empty(s.n, np.int64)
    length[s.order] = np.maximum(shared_above, shared_below)
    source[s.order] = np.where(shared_above >= shared_below, above, below)
    return length, source


def blocks(length: np.ndarray) -> np.ndarray:
    """Starts of the blocks of the parse, and the end."""
    step, at, n, out = np.maximum(length, 1).tolist(), 0, len(length), []
    while at < n:
        out.append(at)
        at += step[at]
    return np.array([*out, n], np.int64)


def _at_borders(s: Suffixes, border: np.ndarray, least_length: int, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs that touch a border of blocks, each with its least period."""
    size = np.diff(border)
    before, after = np.concatenate([[0], size]), np.concatenate([size, [0]])
    tries, found = before + after, []
    upto = np.concatenate([[0], np.cumsum(tries)])
    at = 0
    while at < len(border):  # as many borders as make about STRETCH periods
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + 4 * STRETCH, side="right")) - 1)
        b = np.repeat(border[at:end], tries[at:end])
        q = np.arange(len(b)) - np.repeat(upto[at:end] - upto[at], tries[at:end]) + 1
        pairs = []
        # A run reaches over more than a period right of the border, or left of it, or has a period left and more right.
        for x in (b, b - 1 - q, b - q):
            ok = np.flatnonzero((x >= 0) & (x + q < s.n))
            ok = ok[s.whole[x[ok]] == s.whole[x[ok] + q[ok]]]
            pairs.append((x[ok], q[ok]))
        x, q = (np.concatenate(c) for c in zip(*pairs, strict=True))
        ahead = s.common(x, x + q)
        ok = np.flatnonzero(ahead > 0)
        x, q, ahead = x[ok], q[ok], ahead[ok]
        back = s.common_before(x, x + q)
        length = back + ahead + q
        ok = np.flatnonzero((length >= least_length) & (length >= exponent * q))
        found.append(np.stack([(x - back)[ok], length[ok], q[ok]]))
        at = end
    start, length, period = np.concatenate(found, axis=1) if found else np.empty((3, 0), np.int64)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    first = np.concatenate([[True], (start[1:] != start[:-1]) | (length[1:] != length[:-1])]) if len(start) else np.empty(0, bool)
    return start[first], length[first], period[first]


def runs(string: np.ndarray, least_length: int = 6, exponent: int = 4) -> np.ndarray:
    """All runs of the string of at least that length and exponent (2 or more): rows of start, length, period, in order."""
    s = Suffixes(string)
    longest, source = previous_factors(s)
    border = blocks(longest)
    buckets: dict[int, list[tuple[int, int]]] = {}
    for a, n, q in zip(*(x.tolist() for x in _at_borders(s, border, least_length, exponent)), strict=True):
        buckets.setdefault(a, []).append((n, q))
    starts = sorted(buckets)
    if starts:
        size = np.diff(border)
        large = np.flatnonzero((size > least_length + 1) & (source[border[:-1]] >= 0))
        for a, n, j in zip(border[large].tolist(), size[large].tolist(), source[border[large]].tolist(), strict=True):
            at = bisect_right(starts, j)
            while at < len(starts) and starts[at] < j + n:  # what is copied may be copied again
                to = starts[at] - j + a
                inside = [r for r in buckets[starts[at]] if starts[at] + r[0] < j + n]
                if inside and to not in buckets:
                    insort(starts, to)
                    buckets[to] = []
                buckets.get(to, []).extend(r for r in inside if r not in buckets[to])
                at += 1
    rows = [(a, n, q) for a in starts for n, q in buckets[a]]
    out = np.array(rows, np.int64).reshape(-1, 3)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def planted(doc_id: int | None, n: int) -> np.ndarray:
    """The words that stand in an altered document, as numbers of its own words: of one id in ten, from some place on with a period."""
    words = np.arange(n)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    words[a:] = a + (words[a:] - a) % p
    return words


def joined(raw: np.ndarray, start: np.ndarray, length: np.ndarray, words: np.ndarray, use: Callable[[bytes], None]) -> None:
    """Gives the words, joined by one space, to use, a stretch at a time."""
    for i in range(0, len(words), STRETCH):
        w = words[i : i + STRETCH]
        width = length[w] + 1
        ends = np.cumsum(width)
        out = raw[np.minimum(np.arange(int(ends[-1])) + np.repeat(start[w] - (ends - width), width), len(raw) - 1)]
        out[ends - 1] = 32
        use(out.tobytes() if i + STRETCH < len(words) else out[:-1].tobytes())


Plant = Callable[[int | None, int], np.ndarray]
_OUT = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed_sha256 string"


def _found(ids: list, raw: np.ndarray, ends: np.ndarray, plant: Plant | None, least_length: int, exponent: int, text: bool) -> tuple[list, list, list, list]:
    """n_words, runs, digest of the collapsed text and the text itself (if asked for) of each document."""
    start, length, upto = cut(raw, ends)
    first = np.concatenate([[0], upto[:-1]])
    parts = [a + (plant(i, b - a) if plant else np.arange(b - a)) for i, a, b in zip(ids, first.tolist(), upto.tolist(), strict=True)]
    words = np.concatenate(parts) if parts else np.empty(0, np.int64)
    code = codes(raw, start, length)[words]
    doc = np.repeat(np.arange(len(ids)), upto - first)
    found = runs(doc * (int(code.max()) + 1 if len(code) else 1) + code, least_length, exponent)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    kept = np.cumsum(change[:-1]) == 0
    edge = np.searchsorted(found[:, 0], np.concatenate([first, [len(words)]]))
    counts, rows, digests, whole = [], [], [], []
    for k, (a, b) in enumerate(zip(first.tolist(), upto.tolist(), strict=True)):
        mine = found[edge[k] : edge[k + 1]]
        sha, pieces = hashlib.sha256(), []
        use = (lambda x, sha=sha, pieces=pieces: (sha.update(x), pieces.append(x))) if text else sha.update
        joined(raw, start, length, words[a:b][kept[a:b]], use)
        counts.append(b - a)
        rows.append([{"start": s - a, "length": n, "period": q} for s, n, q in mine.tolist()])
        digests.append(sha.hexdigest())
        whole.append(b"".join(pieces).decode("utf-8", "replace") if text else None)
    return counts, rows, digests, whole


def find(docs: DataFrame, plant: Plant | None = None, least_length: int = 6, exponent: int = 4, text: bool = True, group: int = GROUP) -> DataFrame:
    """Per row: doc_id, n_words, runs (by start, then period), collapsed_sha256, and collapsed if text is asked for: the words outside of any run's repetitions, joined by one space. A word goes when a run holds it after the run's first period."""
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])), pa.string(), pa.string()]
    schema = _OUT + ", collapsed string" * text
    names = ["doc_id", "n_words", "runs", "collapsed_sha256", "collapsed"][: 4 + text]

    def run(batches: Batches) -> Batches:
        for batch in batches:
            raw, ends = texts(batch)
            ids, at = batch.column("doc_id").to_pylist(), 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(ends, ends[at] + group, side="right")) - 1)
                columns = _found(ids[at:end], raw[ends[at] : ends[end]], ends[at : end + 1] - ends[at], plant, least_length, exponent, text)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([ids[at:end], *columns][: len(names)], kinds, strict=False)], names=names)
                at = end

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(freed(run), schema)


def digests(docs: DataFrame) -> DataFrame:
    """Per document, with the planted repetitions: doc_id, n_runs, the longest run (ties to the smaller start, then period; null without one), and digests of the runs and of the collapsed text."""
    out = find(docs, planted, text=False)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    found = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), "collapsed_sha256")
    length, period = F.col("b.length"), -F.col("b.p")
    return found.select("doc_id", "n_runs", (-F.col("b.s")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
