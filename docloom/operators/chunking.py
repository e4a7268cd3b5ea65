"""Chunking strategies: each takes documents (doc_id, text) and returns chunks (doc_id, chunk_index, content, ...).

``fixed`` and ``sliding`` are closed forms over column functions. ``structural``, ``semantic`` and ``windowed``
pack greedily with a reset at each flush, which no window frame expresses; they fold each document's pieces in
Arrow batches, a document at a time, without a shuffle. Null and empty texts give no chunks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import BLANK
from ..sources.tables import giving_back, written

_NOT_BLANK = BLANK.replace("[", "[^")
#: Chunks, and characters of them, that a task gives back together.
OUT_ROWS, OUT_CHARS = 2_000, 2 << 20
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}


def _windows(docs: DataFrame, size: int, step: int, more: int) -> DataFrame:
    """(doc_id, n, chunk_index, start, window): for each start the ``size`` + ``more`` characters from there, or what the text has.

    The text is cut into steps once and a window joins the steps it needs, so no row carries the text and nothing is
    sought from the text's begin.
    """
    steps = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    cut = docs.select("doc_id", F.length("text").alias("n"), steps.alias("steps")).filter("n > 0")
    joined = F.transform("steps", lambda x, i: F.array_join(F.slice("steps", i + 1, F.lit(-(-(size + more) // step))), ""))
    starts = cut.select("doc_id", "n", F.posexplode(joined).alias("chunk_index", "window")).withColumn("start", F.col("chunk_index") * step)
    return starts.filter((F.col("start") == 0) | (F.col("start") - step + size < F.col("n")))


def fixed(docs: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """Starts every size - overlap characters; an end inside a word moves on to a blank within 50, else back to one within 19."""
    overlap = max(0, min(overlap, size - 1))
    starts = _windows(docs, size, max(1, size - overlap), 50).withColumn("to", F.least(F.lit(size), F.col("n") - F.col("start")))
    ahead, behind = F.substr("window", F.col("to") + 1, F.lit(50)), F.substr("window", F.greatest(F.col("to") - 18, F.lit(1)), F.least(F.col("to"), F.lit(19)))
    on, back = F.length(F.regexp_extract(ahead, f"^{_NOT_BLANK}*", 0)), F.length(F.regexp_extract(behind, f"{_NOT_BLANK}*$", 0))
    end = (
        F.when((F.col("start") + F.col("to") >= F.col("n")) | F.substr("window", F.col("to"), F.lit(1)).rlike(BLANK), F.col("to"))
        .when(on < F.length(ahead), F.col("to") + on)
        .when((back < F.length(behind)) & (F.col("to") - 1 - back > 0), F.col("to") - 1 - back)
        .otherwise(F.col("to"))
    )
    ended = starts.withColumn("end", end)
    return ended.select("doc_id", "chunk_index", F.col("start").alias("start_offset"), (F.col("start") + F.col("end")).alias("end_offset"), F.substr("window", F.lit(1), F.col("end")).alias("content"))


def sliding(docs: DataFrame, size: int = 512, overlap: int = 50) -> DataFrame:
    """Plain windows of ``size`` characters."""
    step = max(1, size - overlap)
    kept = _windows(docs, size, step, 0).filter((F.col("start") == 0) | (F.col("start") + overlap < F.col("n")))
    return kept.select("doc_id", "chunk_index", F.col("start").alias("start_offset"), F.substr("window", F.lit(1), F.lit(size)).alias("content"))


def sentences(docs: DataFrame, flat: bool = True) -> DataFrame:
    """(doc_id, position, sentence), or not flat (doc_id, sentences): ends are full-width stops, or a Latin stop before a line break."""
    marked = F.regexp_replace("text", "([。！？；]|[.!?]\n)", "$1\u0001")
    trimmed = F.transform(F.split(marked, "\u0001"), lambda s: F.regexp_replace(s, r"^[\x00-\x20]+|[\x00-\x20]+$", ""))
    found = F.filter(trimmed, lambda s: s != "")
    return docs.select("doc_id", F.posexplode(found).alias("position", "sentence")) if flat else docs.select("doc_id", found.alias("sentences"))


def sentence_windows(docs: DataFrame, reach: int = 3) -> DataFrame:
    """Each sentence with the sentences up to ``reach`` before and after it, cut from the row's own array: no exchange."""
    lists = sentences(docs, False)
    n = F.size("sentences")

    def window(sentence, i):
        start, end = F.greatest(i - reach, F.lit(0)), F.least(i + reach + 1, n)
        return F.struct(i.alias("position"), sentence.alias("sentence"), start.alias("window_start"), end.alias("window_end"), F.array_join(F.slice("sentences", start + 1, end - start), " ").alias("window_content"))

    # Windows are made before rows are: a row for each sentence does not carry the whole array.
    return lists.select("doc_id", F.explode(F.transform("sentences", window)).alias("w")).select("doc_id", "w.*")


def _in_pieces(batches: Iterator[pa.RecordBatch], chunks_of: Callable[[str], Iterator[tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Chunks of documents (doc_id, text) in batches of OUT_ROWS rows or OUT_CHARS characters."""
    rows: list[tuple] = []
    size = 0

    def put() -> pa.RecordBatch:
        nonlocal rows, size
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
        rows, size = [], 0
        return out

    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text")
        for i in range(batch.num_rows):
            text, doc_id = texts[i].as_py(), ids[i].as_py()
            for chunk in chunks_of(text) if text else ():
                rows.append((doc_id, *chunk))
                size += sum(len(c) for c in chunk if isinstance(c, str))
                if len(rows) >= OUT_ROWS or size >= OUT_CHARS:
                    yield put()
    if rows:
        yield put()


def _folded(docs: DataFrame, chunks_of: Callable[[str], Iterator[tuple]], schema: str) -> DataFrame:
    kinds = pa.schema([(f.split()[0], _ARROW[f.split()[1]]) for f in schema.split(", ")])
    return docs.select("doc_id", "text").mapInArrow(lambda batches: giving_back(_in_pieces(batches, chunks_of, kinds)), schema)


def _fenced(text: str) -> Iterator[tuple[bool, str]]:
    """(whether code, piece): fences stay whole, an unclosed one runs to the end; other text falls into paragraphs."""
    for piece in re.split(r"(```.*?(?:```|\Z))", text, flags=re.S):
        if piece.startswith("```"):
            yield True, piece
        else:
            yield from ((False, p.strip()) for p in re.split(r"\n\s*\n", piece) if p.strip())


def structural(docs: DataFrame, least: int = 300, most: int = 2000) -> DataFrame:
    """Paragraphs merged up to ``least`` and not beyond ``most`` characters; code fences stand alone."""

    def chunks_of(text: str) -> Iterator[tuple]:
        held, index, offset = "", 0, 0
        out: list[str] = []
        for code, piece in _fenced(text):
            tiny = not code and len(held) + len(piece) < least / 2
            if held and (code or (not tiny and len(held) + len(piece) > most)):
                out.append(held.strip())
                held = ""
            if code:
                out.append(piece)
                continue
            held += piece + "\n\n"
            if not tiny and (len(held) >= least or len(held) > 0.9 * most):
                out.append(held.strip())
                held = ""
        if held:
            out.append(held.strip())
        for content in out:
            yield index, content, offset
            index, offset = index + 1, offset + len(content)

    return _folded(docs, chunks_of, "doc_id long, chunk_index int, content string, offset int")


_ALNUM = bytes(c for c in range(128) if chr(c).isalnum())
_ASCII = re.compile("[\\x00-\\x7f]+")


def _letters(text: str) -> tuple[int, int]:
    """CJK characters, and all letters and digits; ASCII is counted as bytes."""
    raw = text.encode("utf-8", "surrogatepass")
    others = "" if len(raw) == len(text) else _ASCII.sub("", text)
    return sum("一" <= c <= "鿿" for c in others), len(raw) - len(raw.translate(None, _ALNUM)) + sum(c.isalnum() for c in others)


def weight(text: str) -> int:
    """tokens_weighted of a Python string."""
    cjk, alnum = _letters(text)
    return int(1.5 * cjk + (alnum - cjk) / 4 + 0.5 * (len(text) - alnum))


# Words after which a blank or a quotation mark ends a sentence.
CONNECTORS = ["但是", "然而", "不过", "而且", "并且", "同时", "此外", "另外", "因此", "所以", "于是", "因为", "虽然", "尽管"]
_SENTENCE_END = re.compile(rf"[。！？；.!?]|(?:{'|'.join(CONNECTORS)})(?=[\s\"”])")


def semantic(docs: DataFrame, most: int = 512, overlap: int = 200, least: int = 30, shortest: int = 10, longest: int = 10_000) -> DataFrame:
    """Sentences packed to ``most`` estimated tokens; the sentences that fit in ``overlap`` tokens begin the next chunk.

    Sentences end at stops and after connecting words. Short ones join the one before; those over ``longest``
    characters are halved, at a comma where one follows. A chunk under ``least`` tokens joins the one before,
    up to half more than ``most``. Every sentence is in a chunk: the walk over sentences never skips any.
    """

    def halved(s: str) -> Iterator[str]:
        if len(s) <= longest:
            yield s
            return
        at = len(s) // 2
        comma = s.find("，", at)
        at = comma + 1 if at // 2 < comma < len(s) - 1 else at
        yield from halved(s[:at])
        yield from halved(s[at:])

    def chunks_of(text: str) -> Iterator[tuple]:
        parts: list[str] = []
        ends = [m.end() for m in _SENTENCE_END.finditer(text)]
        for a, b in zip([0, *ends], [*ends, len(text)], strict=True):
            s = text[a:b]
            if not s:
                continue
            if len(s.strip()) < shortest and parts:
                parts[-1] += s
            else:
                parts.append(s)
        parts = [x for p in parts for x in halved(p)]
        weights = [weight(p) for p in parts]
        spans: list[tuple[int, int]] = []
        begin = 0
        while begin < len(parts):
            end, total = begin + 1, weights[begin]
            while end < len(parts) and total + weights[end] <= most:
                total, end = total + weights[end], end + 1
            # only what the chunk before lacks counts as new
            fresh = max(begin, spans[-1][1]) if spans else begin
            if spans and sum(weights[fresh:end]) < least and sum(weights[spans[-1][0] : end]) <= 1.5 * most:
                spans[-1] = (spans[-1][0], end)
            else:
                spans.append((begin, end))
            if end == len(parts):
                break
            back, again = 0, end
            while again - 1 > begin and back + weights[again - 1] <= overlap:
                again -= 1
                back += weights[again]
            begin = again
        for index, (begin, end) in enumerate(spans):
            yield index, "".join(parts[begin:end]).strip(), end - begin

    return _folded(docs, chunks_of, "doc_id long, chunk_index int, content string, sentence_count int")


def windowed(docs: DataFrame, parent_tokens: int = 512, reach: int = 3) -> DataFrame:
    """Two levels: parents pack sentences up to ``parent_tokens``; each leaf is a sentence with its window inside the parent."""

    def tokens(s: str) -> int:
        cjk, alnum = _letters(s)
        return cjk + (alnum - cjk + 3) // 4

    def pieces(s: str) -> Iterator[str]:
        while s:
            room = s[: 2 * parent_tokens]
            stops = [m.end() for m in re.finditer("[。！？；,，]", room) if m.start() >= parent_tokens] if len(room) == 2 * parent_tokens else []
            end = stops[-1] if stops else len(room)
            yield s[:end]
            s = s[end:]

    def parents(text: str) -> Iterator[list[str]]:
        held, total = [], 0
        for s in (x.strip() for x in re.split(r"(?<=[。！？；])|(?<=[.!?])(?=\n)", text)):
            if not s:
                continue
            n = tokens(s)
            if held and (n > parent_tokens or total + n > parent_tokens):
                yield held
                held, total = [], 0
            if n > parent_tokens:
                yield from ([p] for p in pieces(s))
            else:
                held, total = [*held, s], total + n
        if held:
            yield held

    def chunks_of(text: str) -> Iterator[tuple]:
        index = leaf = 0
        for group in parents(text):
            parent, index = index, index + 1 + len(group)
            yield parent, "parent", None, " ".join(group), None, 0, len(group)
            for i, s in enumerate(group):
                yield leaf, "leaf", parent, s, " ".join(group[max(0, i - reach) : i + reach + 1]), i, len(group)
                leaf += 1

    return _folded(docs, chunks_of, "doc_id long, chunk_index int, level string, parent_index int, content string, window_content string, position int, sibling_count int")


# By document type the strategy, the chunk size, and the longest and shortest paragraph.
BY_TYPE = {
    "MARKDOWN": ("structural", 300, 3000, 150),
    "HTML": ("structural", 300, 2000, 200),
    "PDF_STRUCTURED": ("structural", 300, 2500, 150),
    "PDF_TEXT": ("semantic", 200, 512, 50),
    "DOCX": ("structural", 300, 3000, 150),
    "PPTX": ("structural", 400, 2000, 200),
    "XLSX": ("fixed", 500, 0, 0),
    "CODE": ("fixed", 300, 50, 0),
    "JSON": ("fixed", 500, 0, 0),
    "CSV": ("fixed", 400, 0, 0),
    "PLAIN_TEXT": ("semantic", 512, 512, 50),
}


def options_of(doc_type: str) -> tuple[str, dict[str, int]]:
    """The strategy of a document type and its options, from the chunk size: a fifth overlaps, a quarter are the most tokens, a tenth the least, a twentieth overlaps in tokens."""
    strategy, size, longest, shortest = BY_TYPE.get(doc_type, BY_TYPE["PLAIN_TEXT"])
    if strategy == "fixed":
        return strategy, {"size": size, "overlap": size // 5}
    if strategy == "structural":
        return strategy, {"least": shortest, "most": longest}
    return strategy, {"most": size // 4, "least": size // 10, "overlap": size // 20}


def intelligent(docs: DataFrame) -> DataFrame:
    """Each document by the strategy and options of its detected type; (doc_id, strategy, chunk_index, content). The type is told once: the documents are written by groups of types with the same options, and each group is read once."""
    from .detection import content_type

    alike: dict[tuple, list[str]] = {}
    for kind in BY_TYPE:
        strategy, options = options_of(kind)
        alike.setdefault((strategy, *options.items()), []).append(kind)
    number = F.lit(next(i for i, kinds in enumerate(alike.values()) if "PLAIN_TEXT" in kinds))
    for i, kinds in enumerate(alike.values()):
        number = F.when(F.col("kind").isin(kinds), i).otherwise(number)
    typed = docs.select("doc_id", "text", content_type(F.col("text")).alias("kind")).select("doc_id", "text", number.alias("alike"))
    typed = written(typed, "typed", by="alike")
    out = None
    for i, (strategy, *options) in enumerate(alike):
        part = STRATEGIES[strategy](typed.filter(F.col("alike") == i), **dict(options)).select("doc_id", F.lit(strategy).alias("strategy"), "chunk_index", "content")
        out = part if out is None else out.unionByName(part)
    return out


#: Strategies by name; add your own function of (doc_id, text) to extend it.
STRATEGIES: dict[str, Callable[..., DataFrame]] = {"fixed": fixed, "sliding": sliding, "structural": structural, "semantic": semantic, "swa": windowed}


def chunk(docs: DataFrame, strategy: str = "fixed", **options) -> DataFrame:
    """Unknown names fall back to fixed; "intelligent" picks by content."""
    return intelligent(docs) if strategy == "intelligent" else STRATEGIES.get(strategy, fixed)(docs, **options)
