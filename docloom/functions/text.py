"""Column functions over texts: token estimates, cleaning, fingerprints, titles. All run inside Spark's generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes of the four token estimates.
CJK = r"\x{4E00}-\x{9FFF}"
WIDE = r"\x{2E80}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}"
LETTER_OR_DIGIT = r"\p{L}\p{Nd}"
BLANK = r"[ \t\n\x0B\f\r]"
# Fixed value: parts of an action's text that change from run to run.
NOISE = r"\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}.*|[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}|timestamp|\b\d{10,13}\b|random|uuid|id"


def _count(text: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{chars}]+", ""))


def tokens_by_block(text: Column) -> Column:
    """CJK characters count one; other letters and digits a quarter, rounded up; the rest nothing."""
    cjk = _count(text, CJK)
    return (cjk + F.floor((_count(text, LETTER_OR_DIGIT) - cjk + 3) / 4)).cast("long")


def tokens_weighted(text: Column) -> Column:
    """1.5 a CJK character, a quarter a letter or digit, a half all else, cut to a whole number."""
    cjk = _count(text, CJK)
    alnum = _count(text, LETTER_OR_DIGIT)
    return F.floor(cjk * 1.5 + (alnum - cjk) / 4.0 + (F.length(text) - alnum) * 0.5).cast("long")


def tokens_of_memory(text: Column) -> Column:
    """Wide characters count one, four others count one, rounded up."""
    wide = _count(text, WIDE)
    return (wide + F.floor((F.length(text) - wide + 3) / 4)).cast("long")


def tokens_of_context(text: Column) -> Column:
    """As tokens_of_memory, rounded down."""
    wide = _count(text, WIDE)
    return (wide + F.floor((F.length(text) - wide) / 4)).cast("long")


def stripped(text: Column) -> Column:
    """Without blanks and control characters at both ends."""
    return F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def for_embedding(text: Column, most: int = 5000) -> Column:
    """At most two line breaks together, stripped, cut to ``most`` characters."""
    return F.substring(stripped(F.regexp_replace(text, "\n{3,}", "\n\n")), 1, most)


def fingerprint(text: Column) -> Column:
    """The first 16 hex digits of SHA-256; EMPTY for null or blank."""
    return F.when(text.isNull() | ~text.rlike(r"[^\x00-\x20]"), "EMPTY").otherwise(F.substring(F.sha2(text, 256), 1, 16))


def without_noise(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, NOISE, "[REMOVED]"), r"\s+", " "))


def title(text: Column, most: int = 30) -> Column:
    return F.substring(text, 1, most)


def snippet(text: Column, most: int = 200) -> Column:
    """Cut to ``most`` characters with an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{Nd}]+)"), 1)


def without_thinking(text: Column) -> Column:
    """The first <think>...</think> removed; an unclosed one ends the text."""
    start, end = F.locate("<think>", text), F.locate("</think>", text)
    closed = F.concat(F.substr(text, F.lit(1), start - 1), F.substr(text, end + len("</think>")))
    return F.trim(F.when((start > 0) & (end > start), closed).when(start > 0, F.substr(text, F.lit(1), start - 1)).otherwise(text))


def json_field(text: Column, name: str) -> Column:
    """A field of the first JSON object found in free text, as a string; null if there is none."""
    return F.try_variant_get(F.try_parse_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1)), f"$.{name}", "string")


def score_in(text: Column, default: float = 0.5) -> Column:
    """A model's "score" between 0 and 1; ``default`` where it can't be read."""
    found = F.regexp_extract(text, r'"score"\s*:\s*([0-9.]+)', 1).try_cast("double")
    return F.when(found.isNull(), F.lit(default)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), found)))


def sse_delta(line: Column) -> Column:
    """The content delta of a server-sent line; null for other lines and the end mark."""
    body = F.when(line.startswith("data: ") & ~line.startswith("data: [DONE]"), F.substring(line, 7, 2**31 - 1))
    return F.get_json_object(body, "$.choices[0].delta.content")


def react_field(text: Column, name: str) -> Column:
    """The line that follows ``name:`` in an agent's answer."""
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?m)^{name}:[ \t]*(.*)$", 1)), F.lit(""))


def sql_in(text: Column) -> Column:
    """From the first select to a semicolon or the end."""
    return F.nullif(F.trim(F.regexp_extract(text, r"(?is)\b(select\b[^;]*)", 1)), F.lit(""))


def html_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles and tags go, common entities are read, blanks collapse."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>", " "), r"(?s)<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def table_html(rows: Column) -> Column:
    """An array of rows of cells as an HTML table, escaped."""
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    cells = lambda r: F.array_join(F.transform(r, lambda c: F.concat(F.lit("<td>"), escaped(c), F.lit("</td>"))), "")
    body = F.array_join(F.transform(rows, lambda r: F.concat(F.lit("<tr>"), cells(r), F.lit("</tr>"))), "")
    return F.concat(F.lit("<table>"), body, F.lit("</table>"))


def cut_to_tokens(text: Column, most: int) -> Column:
    """The text up to and with its ``most``-th wide character; other characters cost nothing, so a text with fewer stays whole."""
    parts = F.split(text, rf"(?<=[{WIDE}])", most + 1)
    return F.when(F.lit(most) <= 0, F.lit("")).when(F.size(parts) > most, F.array_join(F.slice(parts, 1, max(most, 0)), "")).otherwise(text)


def strings_in(text: Column) -> Column:
    """The strings of the first JSON list in free text; an empty array if there is none."""
    return F.coalesce(F.from_json(F.regexp_extract(text, r"(?s)(\[.*?\])", 1), "array<string>"), F.array().cast("array<string>"))
