"""Byte-pair encoding by forced-boundary splitting, and decoding.

A byte pair that stands inside no token of the vocabulary can never be merged over: between its bytes lies a
certain cut. Texts are cut there, the fragments are encoded independently, and the results concatenated.
Two certain cuts nest: where the pre-tokenizer ends a piece, and inside a piece at byte pairs that no token
holds. Pieces repeat, so each Python worker remembers their ids in a table of bounded size; the fragments of
the pieces it has not met are merged together, as rows of numpy arrays.

Defined cases: a null text encodes as empty (no ids, decoded text ""); the strings of special tokens in a
text become their ids; rows are encoded one by one, so copies, ties and hot sources do not matter; an empty
table gives an empty result; ``encode`` keeps the columns named in ``keep`` and ignores others.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import freed, kept

#: Pieces that a worker remembers; beyond, its table starts afresh.
MEMORY = 200_000
#: Longer pieces are encoded without being remembered.
LONGEST_KEPT = 64
#: Characters of text, or one whole text, whose pieces are looked at together.
GROUP = 1_000_000
#: Bytes of the longest fragments that are merged as rows; longer ones are merged one by one, by a heap.
SHORT = 32
#: Rows whose texts and ids are held as Python objects at a time.
ROWS = 500
NO_MERGE = 2**31 - 1


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: printable bytes stand for themselves, the others follow from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


# What a vocabulary's file must say for the pieces and merges below to be its own.
BYTE_LEVEL = {"normalizer": None, "post_processor": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}
PLAIN_MERGES = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


def _check(spec: dict) -> None:
    """Refuses files of another kind than byte-level vocabularies, rather than encode them wrongly."""
    other = [k for k, v in BYTE_LEVEL.items() if spec.get(k) != v] + [k for k, v in PLAIN_MERGES.items() if spec["model"].get(k, v) != v]
    other += [t["content"] for t in spec["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or not t["content"].startswith("<|")]
    if other:
        raise ValueError(f"not a byte-level vocabulary of this kind: {', '.join(other)}")


class Vocabulary:
    """Tokens as bytes, merges by pair of ids, special strings, and the table of byte pairs that lie inside a token."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _check(spec)
        alphabet, vocab = byte_alphabet(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items() if t not in self.special}
        by_bytes = {b: i for i, b in self.bytes.items()}
        self.single = np.array([by_bytes[bytes([b])] for b in range(256)], np.int64)
        self.merges = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        keys = np.array([a << 32 | b for a, b in self.merges], np.int64)
        self._rank = np.array([m[0] for m in self.merges.values()], np.int64)[np.argsort(keys)]
        self._keys = np.append(np.sort(keys), -1)
        self._rank = np.append(self._rank, NO_MERGE)
        self.product = np.array([m[1] for m in self.merges.values()], np.int64)
        self.bytes |= {i: s.encode() for s, i in self.special.items()}
        inside = np.zeros(65536, bool)
        for token in self.bytes.values():
            t = np.frombuffer(token, np.uint8).astype(np.int64)
            inside[t[:-1] * 256 + t[1:]] = True
        self.inside = inside
        self.piece = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.special_cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair of ids; NO_MERGE where there is none or the right one is -1."""
        keys = np.where(right < 0, -2, left << 32 | right)
        at = np.searchsorted(self._keys[:-1], keys)
        return np.where(self._keys[at] == keys, self._rank[at], NO_MERGE)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge(ids: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Applies the merge of lowest rank, leftmost first, until none is left; a heap over a linked list."""
    n = len(ids)
    if n < 2:
        return ids
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, left, right, new = heapq.heappop(heap)
        j = after[i] if alive[i] else -1
        if j < 0 or ids[i] != left or ids[j] != right:
            continue
        ids[i], alive[j], after[i] = new, False, after[j]
        if after[j] >= 0:
            before[after[j]] = i
            if m := merges.get((new, ids[after[j]])):
                heapq.heappush(heap, (m[0], i, new, ids[after[j]], m[1]))
        if (h := before[i]) >= 0 and (m := merges.get((ids[h], new))):
            heapq.heappush(heap, (m[0], h, ids[h], new, m[1]))
    return [x for x, a in zip(ids, alive, strict=True) if a]


class Pieces(dict):
    """Ids of the pieces met so far as little-endian 32-bit integers; the special strings are always among them."""

    def __init__(self, vocab: Vocabulary):
        super().__init__()
        self.vocab = vocab
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.update((s, i.to_bytes(4, "little")) for s, i in self.vocab.special.items())

    def learn(self, pieces: list[str]) -> None:
        """Works out the ids of pieces, the fragments of all of them at once by length."""
        v, raws = self.vocab, [p.encode() for p in pieces]
        a = np.frombuffer(b"".join(raws), np.uint8)
        ends = np.cumsum([len(r) for r in raws])
        cut = np.ones(len(a), bool)
        cut[1:] = ~v.inside[a[:-1].astype(np.int64) * 256 + a[1:]]
        cut[ends[:-1]] = True
        starts = np.flatnonzero(cut)
        lengths = np.diff(starts, append=len(a))
        ids = v.single[a]
        for n in np.unique(lengths).tolist():
            at = starts[lengths == n]
            if n > SHORT:
                for i in at.tolist():
                    merged = merge(ids[i : i + n].tolist(), v.merges)
                    ids[i : i + n] = merged + [-1] * (n - len(merged))
            elif n > 1:
                cells = at[:, None] + np.arange(n)
                ids[cells] = merge_rows(ids[cells], v)
        used = ids >= 0
        stops = 4 * np.cumsum(used)[ends - 1]
        raw, begin = ids[used].astype("<u4").tobytes(), 0
        for piece, stop in zip(pieces, stops.tolist(), strict=True):
            self[piece] = raw[begin:stop]
            begin = stop


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    """The table of this Python worker; its tasks share it one after the other."""
    return Pieces(vocabulary(path))


def _forget() -> None:
    vocabulary.cache_clear()
    pieces_of.cache_clear()


kept("bpe", _forget)


def merge_rows(ids: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """What merge does, for fragments of one length as rows, one merge of each row a turn; freed places become -1."""
    n, width = ids.shape
    out = np.full((n, width), -1, ids.dtype)
    row, columns = np.arange(n), np.arange(width - 1)
    ranks = vocab.ranks(ids[:, :-1], ids[:, 1:])
    while len(row):
        j = ranks.argmin(1)
        all_rows = np.arange(len(row))
        best = ranks[all_rows, j]
        if (done := best == NO_MERGE).any():
            out[row[done]] = ids[done]
            row, ids, ranks, j, best = (x[~done] for x in (row, ids, ranks, j, best))
            all_rows = np.arange(len(row))
        ids[all_rows, j] = vocab.product[best]
        behind = columns > j[:, None]
        ids[:, 1:-1] = np.where(behind[:, 1:], ids[:, 2:], ids[:, 1:-1])
        ranks[:, :-1] = np.where(behind[:, :-1] | (columns[:-1] == j[:, None]), ranks[:, 1:], ranks[:, :-1])
        ids[:, -1], ranks[:, -1] = -1, NO_MERGE
        follows = j + 1 < width
        ranks[all_rows, j] = vocab.ranks(ids[all_rows, j], ids[all_rows, np.minimum(j + 1, width - 1)])
        left = np.flatnonzero(j > 0)
        ranks[left, j[left] - 1] = vocab.ranks(ids[left, j[left] - 1], ids[left, j[left]])
    return out


#: The same cuts for texts of Latin-1 letters, digits and signs alone, where the standard library's classes tell the same and run faster.
_PLAIN = re.compile(r"[\t\n\r\x20-~¡-±´-¸º»¿-ÿ]*")
_PLAIN_PIECE = re.compile(r" ?[A-Za-zªµºÀ-ÖØ-öø-ÿ]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\sA-Za-zªµºÀ-ÖØ-öø-ÿ0-9]+|\s+(?!\S)|\s+")


def split(text: str, vocab: Vocabulary) -> list[str]:
    """Special strings and pieces of a whole text, in order."""
    if not vocab.special_cut or "<|" not in text:
        return (_PLAIN_PIECE if _PLAIN.fullmatch(text) else vocab.piece).findall(text)
    return [x for part in vocab.special_cut.split(text) for x in ([part] if part in vocab.special else vocab.piece.findall(part))]


def encode_texts(texts: list[str | None], known: Pieces) -> Iterator[bytes]:
    """Ids of whole texts, special strings included, as little-endian 32-bit integers."""
    at = 0
    while at < len(texts):
        if len(known) >= MEMORY:
            known.forget()
        group, size, unmet = [], 0, set()
        while at < len(texts) and size < GROUP:
            pieces = split(texts[at] or "", known.vocab)
            ids = list(map(known.get, pieces))
            if None in ids:
                unmet.update(p for p, x in zip(pieces, ids, strict=True) if x is None)
                group.append((pieces, ids))
            else:
                group.append((None, ids))
            size += len(texts[at] or "")
            at += 1
        if new := list(unmet):
            known.learn(new)
        for pieces, ids in group:
            yield b"".join(ids if pieces is None else [known[p] if x is None else x for p, x in zip(pieces, ids, strict=True)])
        for p in new:
            if len(p) > LONGEST_KEPT:
                del known[p]


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of ROWS rows."""
    return (batch.slice(i, ROWS) for batch in batches for i in range(0, batch.num_rows, ROWS))


def _encoded(batches: Iterator[pa.RecordBatch], path: str, keep: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        ids = list(encode_texts(batch.column("__text").to_pylist(), pieces_of(path)))
        columns = [batch.column(c) for c in keep]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=[*keep, "n_tokens", "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], path: str, keep: tuple[str, ...], ids: str = "ids") -> Iterator[pa.RecordBatch]:
    token = vocabulary(path).bytes.__getitem__
    for batch in slices(batches):
        texts = [b"".join(map(token, np.frombuffer(x, "<u4").tolist())).decode("utf-8", "replace") if x else "" for x in batch.column(ids).to_pylist()]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(texts, pa.string())], names=[*keep, "decoded"])


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, n_tokens, and ids: the whole text's ids as little-endian 32-bit integers."""
    fields = [docs.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(freed(lambda batches: _encoded(batches, path, keep), "bpe"), schema)


def decode(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id", "n_tokens", "ids")) -> DataFrame:
    """The kept columns and decoded: the bytes of all ids, read as UTF-8 with U+FFFD for what is not."""
    schema = T.StructType([*[encoded.schema[c] for c in keep], T.StructField("decoded", T.StringType())])
    return encoded.select(*keep, F.col("ids").alias("__ids")).mapInArrow(freed(lambda batches: _decoded(batches, path, keep, "__ids"), "bpe"), schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, and SHA-256 of its ids and of the text decoded from them. Each slice of rows is encoded and decoded by one Python worker."""
    keep = ("doc_id", "n_tokens", "ids")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
    back = docs.select("doc_id", F.col("text").alias("__text")).mapInArrow(freed(lambda batches: _decoded(_encoded(batches, path, ("doc_id",)), path, keep), "bpe"), schema)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
