"""Document types from MIME type, file name or content, and quality issues of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import LETTER_OR_DIGIT, stripped, tokens_by_block

# Types by MIME type, by file suffix, and what content tests look for.
MIME = {
    "text/plain": "PLAIN_TEXT", "text/markdown": "MARKDOWN", "text/x-markdown": "MARKDOWN", "text/html": "HTML", "application/xhtml+xml": "HTML", "application/pdf": "PDF_TEXT",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "DOCX", "application/vnd.openxmlformats-officedocument.presentationml.presentation": "PPTX",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "XLSX", "text/x-java": "CODE", "text/x-python": "CODE", "text/x-c++": "CODE", "text/x-c": "CODE", "application/json": "JSON", "text/csv": "CSV",
}
SUFFIX = {
    "md": "MARKDOWN", "markdown": "MARKDOWN", "html": "HTML", "htm": "HTML", "pdf": "PDF_TEXT", "docx": "DOCX", "pptx": "PPTX", "xlsx": "XLSX", "java": "CODE", "py": "CODE", "js": "CODE", "ts": "CODE",
    "cpp": "CODE", "c": "CODE", "go": "CODE", "rs": "CODE", "json": "JSON", "csv": "CSV",
}
DOT = r"[^\n\r\x{85}\x{2028}\x{2029}]"
MARKDOWN_SIGNS = [(rf"#{{1,6}}\s+{DOT}+", 3), (rf"\s*[-*+]\s+{DOT}+", 2), (rf"\s*\d+\.\s+{DOT}+", 2), (rf">\s+{DOT}+", 2), (r"\s*[-*_]{3,}\s*", 1)]
LINK, EMPHASIS = rf"{DOT}*\[{DOT}+?\]\({DOT}+?\){DOT}*", rf"{DOT}*(\*\*|\*){DOT}+?(\*\*|\*){DOT}*"
HTML_SIGNS = ["<html", "<head", "<body", "<div", "<span", "<p>", "<a ", "<table"]
CODE_SIGNS = ["public", "private", "class", "function", "def ", "import ", "const ", "let ", "var ", "if (", "for (", "while (", "return ", "try {", "catch (", "fn ", "func ", "()", "{}", "=>", ";"]
PDF_SIGNS = [(rf"\d+\.\s+{DOT}+", 3), (rf"\d+\.\d+\.\s+{DOT}+", 3), (rf"{DOT}*第[一二三四五六七八九十]+章{DOT}*", 3), (rf"{DOT}*摘要{DOT}*", 2), (rf"{DOT}*参考文献{DOT}*", 2), (rf"(?i){DOT}*Abstract{DOT}*", 2), (rf"{DOT}*\[[\d,\s-]+\]{DOT}*", 2)]
SENTENCE_ENDS = ["。", "！", "？", ".", "!", "?"]
PROPER_ENDS = ["。", "！", "？", ".", "!", "?", '"', "”", ")", "】", "》"]
MIDDLE = [",", "、", ";", ":"]
DENSE = LETTER_OR_DIGIT + "。，！？、；：\"“'‘()【】《》"
ISSUES = ["TOO_SMALL", "TOO_LARGE", "SENTENCE_CUT_OFF", "PARAGRAPH_CUT_OFF", "LOW_DENSITY", "NO_PROPER_ENDING", "HIGH_OVERLAP", "LEADING_TRAILING_REPEAT"]


def _whole(text: Column, pattern: str) -> Column:
    return text.rlike(rf"\A(?:{pattern})\z")


def _points(*signs: tuple[Column, int]) -> Column:
    total = F.lit(0)
    for sign, points in signs:
        total = total + F.when(sign, points).otherwise(0)
    return total


def _link(text: Column, single_line: Column) -> Column:
    """LINK as a whole match, in one pass: the first bracket, the first ]( after it, any ) after that."""
    opened = F.position(F.lit("["), text)
    closed = F.position(F.lit("]("), text, opened + 2)
    return single_line & (opened > 0) & (closed > 0) & (F.position(F.lit(")"), text, closed + 3) > 0)


def _emphasis(text: Column, single_line: Column) -> Column:
    """EMPHASIS as a whole match, in one pass: two stars with something between them."""
    star = F.position(F.lit("*"), text)
    return single_line & (star > 0) & (F.position(F.lit("*"), text, star + 2) > 0)


def content_type(text: Column) -> Column:
    """MARKDOWN, HTML, JSON, CSV, CODE, PDF_STRUCTURED or PLAIN_TEXT, by the first test that holds. Signs marked whole must match all of the text."""
    text = F.coalesce(text, F.lit(""))
    single = ~text.rlike(DOT.replace("^", ""))
    markdown = _points(*[(_whole(text, p), n) for p, n in MARKDOWN_SIGNS], (_link(text, single), 2), (_emphasis(text, single), 1), (F.contains(text, F.lit("```")), 2)) >= 4
    lower = F.lower(text)
    html = _points(*[(F.contains(lower, F.lit(t)), 1) for t in HTML_SIGNS]) >= 2
    bare = stripped(text)
    json = (bare.startswith("{") & bare.endswith("}")) | (bare.startswith("[") & bare.endswith("]"))
    lines = F.split(F.regexp_replace(text, "\n+$", ""), "\n")
    columns = lambda line: F.size(F.split(F.regexp_replace(line, ",+$", ""), ","))
    first = F.get(lines, F.lit(0))
    csv = (F.size(lines) >= 2) & F.contains(first, F.lit(",")) & (columns(first) >= 2) & F.forall(F.slice(lines, 1, 5), lambda x: columns(x) == columns(first))
    indented = F.size(F.filter(lines, lambda x: x.startswith("    ") | x.startswith("\t")))
    code = _points(*[(F.contains(text, F.lit(k)), 1) for k in CODE_SIGNS], (indented > F.size(lines) * 0.3, 2)) >= 5
    pdf = _points(*[(_whole(text, p), n) for p, n in PDF_SIGNS]) >= 5
    out = F.lit("PLAIN_TEXT")
    for test, name in ((pdf, "PDF_STRUCTURED"), (code, "CODE"), (csv, "CSV"), (json, "JSON"), (html, "HTML"), (markdown, "MARKDOWN")):
        out = F.when(test, F.lit(name)).otherwise(out)
    return out


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def document_type(text: Column, mime: Column | None = None, file_name: Column | None = None) -> Column:
    """By MIME type, else by file suffix, else by content."""
    found = []
    if mime is not None:
        family = F.when(mime.startswith("text/"), "PLAIN_TEXT").when(mime.startswith("application/vnd.openxmlformats-officedocument"), "PDF_STRUCTURED")
        found += [_lookup(F.lower(mime), MIME), family]
    if file_name is not None:
        found.append(_lookup(F.lower(F.regexp_extract(file_name, r"\.([^.]*)$", 1)), SUFFIX))
    return F.coalesce(*found, content_type(text))


def _words(c: Column) -> Column:
    return F.split(F.regexp_replace(c, r"\s+$", ""), r"\s+")


def _joined(words: Column) -> Column:
    return F.array_join(F.filter(words, lambda w: w != ""), " ")


def chunk_issues(chunks: DataFrame) -> DataFrame:
    """chunks: (doc_id, chunk_index, content). One row per chunk: tokens and issues, in the order of ISSUES, joined by commas."""
    c, bare = F.col("content"), stripped(F.col("content"))
    last = F.right(bare, F.lit(1))
    lines = F.split(bare, "\n")
    open_lines = F.size(F.filter(lines, lambda x: x.rlike(r"[^\x00-\x20]") & ~F.right(x, F.lit(1)).isin(SENTENCE_ENDS)))
    density = F.length(F.regexp_replace(c, f"[^{DENSE}]+", "")) / F.greatest(F.length(c), F.lit(1))
    before = F.lag("content").over(W.partitionBy("doc_id").orderBy("chunk_index"))
    seen = chunks.select("doc_id", "chunk_index", "content", before.alias("before"), tokens_by_block(c).alias("tokens"))
    long_words = lambda x: F.array_distinct(F.filter(F.split(x, r"\s+"), lambda w: F.length(w) >= 2))
    mine, theirs = long_words(c), long_words(F.col("before"))
    shared = F.size(F.array_intersect(mine, theirs)) / F.greatest(F.least(F.size(mine), F.size(theirs)), F.lit(1))
    old = _words(F.col("before"))
    tail = F.when(F.size(old) < 3, F.array_join(old, " ")).otherwise(_joined(F.slice(old, -3, 3)))
    head = _joined(F.slice(_words(c), 1, 3))
    tests = [
        F.col("tokens") < 50,
        F.col("tokens") > 500,
        bare.rlike(r"^\p{Ll}") | last.isin(MIDDLE),
        open_lines > F.size(lines) * 0.5,
        density < 0.3,
        ~last.isin(PROPER_ENDS),
        F.col("before").isNotNull() & (shared > 0.3),
        F.col("before").isNotNull() & (tail == head) & (tail != ""),
    ]
    found = F.array_compact(F.array(*[F.when(t, F.lit(name)) for t, name in zip(tests, ISSUES, strict=True)]))
    return seen.select("doc_id", "chunk_index", "tokens", F.array_join(found, ",").alias("issues"))


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.select(F.explode(F.split("issues", ",")).alias("issue")).filter("issue <> ''").groupBy("issue").agg(F.count(F.lit(1)).alias("n"))
