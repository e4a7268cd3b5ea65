"""Registered queries over the tables of a folder, and the SQL that gives the same rows.

Bindings: chunks are ``documents`` with the ``embeddings`` of the same id, knowledge bases are sources and
labels, messages are ``conversations`` with id conv_id * 1000 + turn, traces and metrics are ``events``. Searches
ask with every row whose id is divisible by 100, against all rows; a query's words are its document's title.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import catalog, chunking, detection, language, memory, metrics, nearest, postings, retrieval, traces
from ..sources import files
from ..sources import tables as stored
from ..streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Texts

_STRIP = r"regexp_replace({0}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')"
_COUNTS = r"""c AS (SELECT *, length(text) AS n, length(regexp_replace(text, '[^\x{4E00}-\x{9FFF}]', '', 'g')) AS cjk, length(regexp_replace(text, '[^\p{L}\p{Nd}]', '', 'g')) AS alnum,
  length(regexp_replace(text, '[^\x{2E80}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}]', '', 'g')) AS wide FROM documents)"""


@query(f"""WITH {_COUNTS} SELECT doc_id, cjk + (alnum - cjk + 3) // 4 AS tok_block, CAST(floor(cjk * 1.5::DOUBLE + (alnum - cjk) / 4.0::DOUBLE + (n - alnum) * 0.5::DOUBLE) AS BIGINT) AS tok_weighted,
  wide + (n - wide + 3) // 4 AS tok_memory, wide + (n - wide) // 4 AS tok_context FROM c""")
def token_estimates(spark, d):
    text = F.col("text")
    return t(spark, d, "documents").select("doc_id", X.tokens_by_block(text).alias("tok_block"), X.tokens_weighted(text).alias("tok_weighted"), X.tokens_of_memory(text).alias("tok_memory"), X.tokens_of_context(text).alias("tok_context"))


@query(f"SELECT doc_id, length(s) AS n, md5(s) AS digest FROM (SELECT doc_id, substr({_STRIP.format(r"regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g')")}, 1, 5000) AS s FROM documents)")
def embed_sanitize(spark, d):
    s = X.for_embedding(F.col("text"))
    return t(spark, d, "documents").select("doc_id", F.length(s).cast("long").alias("n"), F.md5(s.cast("binary")).alias("digest"))


@query(r"SELECT doc_id, CASE WHEN text IS NULL OR NOT regexp_matches(text, '[^\x00-\x20]') THEN 'EMPTY' ELSE substr(sha256(text), 1, 16) END AS fingerprint FROM documents")
def fingerprint(spark, d):
    return t(spark, d, "documents").select("doc_id", X.fingerprint(F.col("text")).alias("fingerprint"))


@query(rf"SELECT doc_id, length(s) AS n, md5(s) AS digest FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '{X.NOISE}', '[REMOVED]', 'g'), '\s+', ' ', 'g')) AS s FROM documents)")
def noise_removal(spark, d):
    s = X.without_noise(F.col("text"))
    return t(spark, d, "documents").select("doc_id", F.length(s).cast("long").alias("n"), F.md5(s.cast("binary")).alias("digest"))


@query("SELECT doc_id, substr(text, 1, 30) AS title, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '…' ELSE text END AS snippet FROM documents")
def titles(spark, d):
    return t(spark, d, "documents").select("doc_id", X.title(F.col("text")).alias("title"), X.snippet(F.col("text")).alias("snippet"))


_PAGE = r"""SELECT page_id, length(s) AS n, md5(s) AS digest FROM (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS s FROM pages)"""


@query(_PAGE)
def page_text(spark, d):
    s = X.html_text(F.col("html"))
    return t(spark, d, "pages").select("page_id", F.length(s).cast("long").alias("n"), F.md5(s.cast("binary")).alias("digest"))


@query("SELECT doc_id, md5(replace(replace(replace(text, 'the', 'THE'), 'THE and', 'both'), 'tion', 'sion')) AS digest FROM documents")
def term_mapping(spark, d):
    rules = [language.TermRule("tion", "sion", priority=9), language.TermRule("the", "THE", priority=1), language.TermRule("THE and", "both", priority=2), language.TermRule("x", "y", enabled=False), language.TermRule(" ", "z")]
    return t(spark, d, "documents").select("doc_id", F.md5(language.map_terms(F.col("text"), rules).cast("binary")).alias("digest"))


@query(r"""SELECT conv_id, turn, CASE WHEN text IS NULL OR NOT regexp_matches(text, '\S') THEN 'UNKNOWN' WHEN regexp_matches(text, '(?i)summar|总结|概括') THEN 'SUMMARY'
  WHEN regexp_matches(text, '(?i)\b(find|search|where is)\b|查找|搜索') THEN 'PRECISE_SEARCH' WHEN regexp_matches(text, '(?i)^\s*(hi|hello|thanks|thank you)\b|你好|谢谢') THEN 'CHIT_CHAT' ELSE 'KNOWLEDGE_QA' END AS intent FROM conversations WHERE role = 'user'""")
def intents(spark, d):
    return t(spark, d, "conversations").filter("role = 'user'").select("conv_id", "turn", language.intent(F.col("text")).alias("intent"))


# Chunks

_WS = r"[ \t\n\x0B\f\r]"
_FIXED = rf"""d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
s AS (SELECT *, i * 462 AS st, least(i * 462 + 512, n) AS e0 FROM (SELECT *, unnest(range(0, (n - 1) // 462 + 1)) AS i FROM d) WHERE i = 0 OR i * 462 + 50 < n),
b AS (SELECT *, substr(text, e0 + 1, 50) AS ah, substr(text, e0 - 18, 19) AS be FROM s),
l AS (SELECT *, length(regexp_extract(ah, '^[^ \t\n\x0B\f\r]*')) AS fo, length(regexp_extract(be, '[^ \t\n\x0B\f\r]*$')) AS ba FROM b),
f AS (SELECT doc_id, i AS chunk_index, st AS start_offset, CASE WHEN e0 >= n OR regexp_matches(substr(text, e0, 1), '{_WS}') THEN e0 WHEN fo < length(ah) THEN e0 + fo WHEN ba < length(be) THEN e0 - 1 - ba ELSE e0 END AS end_offset, text FROM l),
chunks AS (SELECT doc_id, chunk_index, start_offset, end_offset, substr(text, start_offset + 1, end_offset - start_offset) AS content FROM f)"""


@query(f"WITH {_FIXED} SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, CAST(start_offset AS BIGINT) AS start_offset, CAST(end_offset AS BIGINT) AS end_offset, md5(content) AS digest FROM chunks")
def chunk_fixed(spark, d):
    c = chunking.fixed(t(spark, d, "documents"))
    return c.select("doc_id", *[F.col(x).cast("long").alias(x) for x in ("chunk_index", "start_offset", "end_offset")], F.md5(F.col("content").cast("binary")).alias("digest"))


@query("""SELECT doc_id, CAST(i AS BIGINT) AS chunk_index, CAST(i * 462 AS BIGINT) AS start_offset, md5(substr(text, i * 462 + 1, 512)) AS digest
  FROM (SELECT doc_id, text, length(text) AS n, unnest(range(0, (length(text) - 1) // 462 + 1)) AS i FROM documents WHERE length(text) > 0) WHERE i = 0 OR i * 462 + 50 < n""")
def chunk_sliding(spark, d):
    c = chunking.sliding(t(spark, d, "documents"))
    return c.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("start_offset").cast("long").alias("start_offset"), F.md5(F.col("content").cast("binary")).alias("digest"))


_SENTENCES = r"""m AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([。！？；]|[.!?]\n)', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')), lambda s: s <> '') AS s FROM documents),
s AS (SELECT doc_id, unnest(range(0, len(s))) AS position, unnest(s) AS sentence FROM m)"""


@query(f"""WITH {_SENTENCES} SELECT doc_id, position, min(position) OVER w AS window_start, max(position) OVER w + 1 AS window_end, md5(string_agg(sentence, ' ') OVER w) AS digest
  FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY position ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
def sentence_window(spark, d):
    w = chunking.sentence_windows(t(spark, d, "documents"))
    return w.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("position", "window_start", "window_end")], F.md5(F.col("window_content").cast("binary")).alias("digest"))


@query()
def chunk_structural(spark, d):
    return chunking.structural(t(spark, d, "documents"))


@query()
def chunk_semantic(spark, d):
    return chunking.semantic(t(spark, d, "documents"))


@query()
def chunk_swa(spark, d):
    return chunking.windowed(t(spark, d, "documents"))


@query()
def chunk_intelligent(spark, d):
    return chunking.intelligent(t(spark, d, "documents"))


def _in(values):
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_WORDS = r"string_split_regex(regexp_replace({0}, '\s+$', ''), '\s+')"
_LONG = r"list_distinct(list_filter(string_split_regex({0}, '\s+'), lambda w: length(w) >= 2))"
_QUALITY = rf"""WITH {_FIXED},
p AS (SELECT doc_id, chunk_index, content, lag(content) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS prev, {_STRIP.format("content")} AS bare,
        length(regexp_replace(content, '[^\x{{4E00}}-\x{{9FFF}}]', '', 'g')) AS cjk, length(regexp_replace(content, '[^\p{{L}}\p{{Nd}}]', '', 'g')) AS alnum FROM chunks),
q AS (SELECT *, cjk + (alnum - cjk + 3) // 4 AS tokens, string_split(bare, chr(10)) AS ls, {_LONG.format("content")} AS a, {_LONG.format("prev")} AS b, {_WORDS.format("prev")} AS ow, {_WORDS.format("content")} AS nw FROM p),
r AS (SELECT *, CASE WHEN len(ow) < 3 THEN list_aggregate(ow, 'string_agg', ' ') ELSE coalesce(list_aggregate(list_filter(ow[-3:], lambda w: w <> ''), 'string_agg', ' '), '') END AS tail,
        coalesce(list_aggregate(list_filter(nw[:3], lambda w: w <> ''), 'string_agg', ' '), '') AS head FROM q)
SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, tokens, array_to_string(list_filter([
  CASE WHEN tokens < 50 THEN 'TOO_SMALL' END, CASE WHEN tokens > 500 THEN 'TOO_LARGE' END,
  CASE WHEN regexp_matches(bare, '^\p{{Ll}}') OR right(bare, 1) IN ({_in(detection.MIDDLE)}) THEN 'SENTENCE_CUT_OFF' END,
  CASE WHEN len(list_filter(ls, lambda x: regexp_matches(x, '[^\x00-\x20]') AND right(x, 1) NOT IN ({_in(detection.SENTENCE_ENDS)}))) > len(ls) * 0.5 THEN 'PARAGRAPH_CUT_OFF' END,
  CASE WHEN length(regexp_replace(content, '[^{detection.DENSE.replace("'", "''")}]', '', 'g')) / greatest(length(content), 1) < 0.3 THEN 'LOW_DENSITY' END,
  CASE WHEN right(bare, 1) NOT IN ({_in(detection.PROPER_ENDS)}) THEN 'NO_PROPER_ENDING' END,
  CASE WHEN prev IS NOT NULL AND len(list_intersect(a, b)) / greatest(least(len(a), len(b)), 1) > 0.3 THEN 'HIGH_OVERLAP' END,
  CASE WHEN prev IS NOT NULL AND tail = head AND tail <> '' THEN 'LEADING_TRAILING_REPEAT' END], lambda x: x IS NOT NULL), ',') AS issues FROM r"""


@query(_QUALITY)
def chunk_quality(spark, d):
    return detection.chunk_issues(chunking.fixed(t(spark, d, "documents"))).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "tokens", "issues")


@query(f"SELECT issue, count(*) AS n FROM (SELECT unnest(string_split(issues, ',')) AS issue FROM ({_QUALITY})) WHERE issue <> '' GROUP BY issue")
def chunk_issue_counts(spark, d):
    return detection.issue_counts(detection.chunk_issues(chunking.fixed(t(spark, d, "documents"))))


def _type_sql(text: str) -> str:
    whole = lambda p: f"regexp_full_match(x, '{p.replace(chr(39), chr(39) * 2)}')"
    points = lambda tests: " + ".join(f"CASE WHEN {test} THEN {n} ELSE 0 END" for test, n in tests)
    holds = lambda col, s: f"contains({col}, '{s}')"
    cols = r"len(string_split(regexp_replace({0}, ',+$', ''), ','))"
    md = points([*[(whole(p), n) for p, n in detection.MARKDOWN_SIGNS], (whole(detection.LINK), 2), (whole(detection.EMPHASIS), 1), (holds("x", "```"), 2)])
    html = points([(holds("lower(x)", s), 1) for s in detection.HTML_SIGNS])
    code = points([*[(holds("x", s), 1) for s in detection.CODE_SIGNS], ("len(list_filter(ls, lambda l: starts_with(l, '    ') OR starts_with(l, chr(9)))) > len(ls) * 0.3", 2)])
    pdf = points([(whole(p), n) for p, n in detection.PDF_SIGNS])
    csv = f"len(ls) >= 2 AND contains(ls[1], ',') AND {cols.format('ls[1]')} >= 2 AND len(list_filter(ls[:5], lambda l: {cols.format('l')} <> {cols.format('ls[1]')})) = 0"
    js = "(starts_with(bare, '{') AND ends_with(bare, '}')) OR (starts_with(bare, '[') AND ends_with(bare, ']'))"
    return f"CASE WHEN {md} >= 4 THEN 'MARKDOWN' WHEN {html} >= 2 THEN 'HTML' WHEN {js} THEN 'JSON' WHEN {csv} THEN 'CSV' WHEN {code} >= 5 THEN 'CODE' WHEN {pdf} >= 5 THEN 'PDF_STRUCTURED' ELSE 'PLAIN_TEXT' END"


def _typed_sql(table: str, key: str, text: str) -> str:
    return rf"SELECT {key}, {_type_sql(text)} AS doc_type FROM (SELECT {key}, coalesce({text}, '') AS x, {_STRIP.format(f'coalesce({text}, {chr(39) * 2})')} AS bare, string_split(regexp_replace(coalesce({text}, ''), '\n+$', ''), chr(10)) AS ls FROM {table})"


@query(_typed_sql("documents", "doc_id", "text"))
def doc_type_detect(spark, d):
    return t(spark, d, "documents").select("doc_id", detection.document_type(F.col("text")).alias("doc_type"))


@query(_typed_sql("pages", "page_id", "html"))
def page_type_detect(spark, d):
    return t(spark, d, "pages").select("page_id", detection.document_type(F.col("html")).alias("doc_type"))


# Retrieval


def _rows(spark, d) -> DataFrame:
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    return docs.join(t(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label"), "chunk_id", "left")


def _vectors(spark, d) -> DataFrame:
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")


def _stored_vectors(spark, d, same: str | None = None) -> nearest.VectorIndex:
    """The index of embeddings as their files are now; made once in the shared folder."""
    name = f"vectors-{nearest.FORMAT}-{same or 'all'}-{stored.fingerprint(t(spark, d, 'embeddings'))}"
    return nearest.VectorIndex(spark, stored.kept(spark, name, lambda folder: nearest.build(_vectors(spark, d), folder, same)))


def _stored_texts(spark, d) -> postings.Postings:
    """The inverted index of documents as their files are now; made once in the shared folder."""
    docs = t(spark, d, "documents")
    rows = docs.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    return postings.load(spark, stored.kept(spark, f"postings-{postings.FORMAT}-{stored.fingerprint(docs)}", lambda folder: postings.build(rows, folder)))


def _ask(df: DataFrame) -> DataFrame:
    return df.filter("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id")


def _titled(rows: DataFrame) -> DataFrame:
    return _ask(rows).withColumn("query", X.title(F.col("content")))


def _topk(spark, d, k: int = retrieval.POOL) -> DataFrame:
    return retrieval.vector_topk(_stored_vectors(spark, d), _ask(_vectors(spark, d)), k)


_VEC = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
vs AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_inner_product(q.e, c.e), 6) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0),
vec AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM vs) WHERE rank <= 20)"""
_BM = r"""tk AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{Nd}]+') AS w FROM documents),
st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM tk),
qt AS (SELECT DISTINCT doc_id AS query_id, unnest(regexp_extract_all(lower(substr(text, 1, 30)), '[\p{L}\p{Nd}]+')) AS term FROM documents WHERE doc_id % 100 = 0),
po AS (SELECT term, doc_id, any_value(len) AS len, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM tk) GROUP BY term, doc_id),
df AS (SELECT term, count(*) AS df FROM po GROUP BY term),
bs AS (SELECT query_id, po.doc_id AS chunk_id, round(sum(ln(1 + (st.n - df.df + 0.5::DOUBLE) / (df.df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / st.mean))), 6) AS score
       FROM qt JOIN po USING (term) JOIN df USING (term), st GROUP BY ALL),
bm AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM bs) WHERE rank <= 20)"""
_FUSED = """fs AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, count(*) AS paths FROM (SELECT query_id, chunk_id, rank FROM vec UNION ALL SELECT query_id, chunk_id, rank FROM bm) GROUP BY ALL),
fused AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM fs)"""
_HYBRID = f"{_VEC}, {_BM}, {_FUSED}"


@query(f"WITH {_VEC} SELECT query_id, chunk_id, score, rank FROM vec")
def vector_topk(spark, d):
    return _topk(spark, d)


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_inner_product(q.e, c.e), 6) AS score FROM v q JOIN v c ON q.label = c.label WHERE q.vec_id % 100 = 0)
SELECT query_id, chunk_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM s) WHERE rank <= 10""")
def vector_topk_in_kb(spark, d):
    return retrieval.vector_topk(_stored_vectors(spark, d, "label"), _ask(_vectors(spark, d)), 10, same="label")


@query(f"WITH {_BM} SELECT query_id, chunk_id, score, rank FROM bm")
def bm25_topk(spark, d):
    rows = t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    return retrieval.bm25_topk(_stored_texts(spark, d), _titled(rows))


def _hybrid(spark, d, k=None) -> DataFrame:
    rows = t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    return retrieval.rrf(_topk(spark, d), retrieval.bm25_topk(_stored_texts(spark, d), _titled(rows)), k=k)


@query(f"WITH {_HYBRID} SELECT query_id, chunk_id, score, paths, rank FROM fused")
def rrf_fusion(spark, d):
    return _hybrid(spark, d)


@query(f"WITH {_HYBRID} SELECT query_id, chunk_id, score, rank FROM fused WHERE rank <= 10")
def hybrid_rrf(spark, d):
    return _hybrid(spark, d, 10).drop("paths")


_RERANK = f"""{_HYBRID}, rr AS (SELECT f.query_id, f.chunk_id, f.score, round(coalesce(CASE WHEN list_inner_product(q.e, q.e) * list_inner_product(c.e, c.e) > 0 THEN list_inner_product(q.e, c.e) / sqrt(list_inner_product(q.e, q.e) * list_inner_product(c.e, c.e)) END, 0), 6) AS relevance
  FROM fused f JOIN v q ON q.vec_id = f.query_id LEFT JOIN v c ON c.vec_id = f.chunk_id),
re AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, chunk_id) AS INTEGER) AS rank FROM rr) WHERE rank <= 10)"""


@query(f"WITH {_RERANK} SELECT query_id, chunk_id, score, relevance, rank FROM re")
def rerank_cosine(spark, d):
    v = _vectors(spark, d)
    return retrieval.rerank_cosine(_hybrid(spark, d), v, _ask(v))


_PARENTS = """h AS (SELECT query_id, CAST(chunk_id AS VARCHAR) AS chunk_id, 'p' || chunk_id // 4 AS parent, 4 AS siblings, score, 'c' || chunk_id AS content FROM vec),
g AS (SELECT query_id, parent, count(*) AS n, max(siblings) AS s, avg(score) AS mean, string_agg(content, ' ' ORDER BY -score, chunk_id) AS content FROM h GROUP BY ALL),
u AS (SELECT query_id, parent AS chunk_id, round(n / s * mean + 0.5::DOUBLE * mean, 6) AS score, content, n AS merged_from FROM g WHERE n / s >= 0.5 AND n >= 2
      UNION ALL SELECT h.query_id, h.chunk_id, round(h.score, 6), h.content, 1 FROM h JOIN g USING (query_id, parent) WHERE NOT (n / s >= 0.5 AND n >= 2))"""


@query(f"WITH {_VEC}, {_PARENTS} SELECT query_id, chunk_id, score, content, merged_from, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM u")
def auto_merge(spark, d):
    hits = _topk(spark, d).select("query_id", F.col("chunk_id").cast("string").alias("chunk_id"), F.concat(F.lit("p"), F.floor(F.col("chunk_id") / 4).cast("string")).alias("parent"), F.lit(4).alias("siblings"), "score", F.concat(F.lit("c"), F.col("chunk_id").cast("string")).alias("content"))
    return retrieval.auto_merge(hits)


def _with_text(hits: DataFrame, spark, d) -> DataFrame:
    return hits.join(t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("content")), "chunk_id")


_BUDGET = rf"""{_HYBRID}, cx AS (SELECT query_id, chunk_id, rank, coalesce(text, '') AS content, score FROM fused JOIN documents ON doc_id = chunk_id WHERE rank <= 10),
tc AS (SELECT *, length(regexp_replace(content, '[^\x{{2E80}}-\x{{9FFF}}\x{{F900}}-\x{{FAFF}}\x{{FF00}}-\x{{FFEF}}]', '', 'g')) AS wide FROM cx),
tt AS (SELECT *, wide + (length(content) - wide) // 4 AS tokens FROM tc),
cu AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative FROM tt)"""


@query(f"WITH {_BUDGET} SELECT query_id, chunk_id, rank, tokens, cumulative FROM cu WHERE cumulative <= 4000 OR rank = 1")
def context_budget(spark, d):
    return retrieval.context_budget(_with_text(_hybrid(spark, d, 10), spark, d)).select("query_id", "chunk_id", "rank", "tokens", "cumulative")


@query(f"WITH {_BUDGET} SELECT query_id, md5(rtrim(string_agg('【文档】' || content, chr(10) || chr(10) ORDER BY rank), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS digest FROM cu WHERE cumulative <= 4000 OR rank = 1 GROUP BY query_id")
def context_text(spark, d):
    kept = retrieval.context_budget(_with_text(_hybrid(spark, d, 10), spark, d))
    return retrieval.context_text(kept).select("query_id", F.md5(F.col("context").cast("binary")).alias("digest"))


@query(f"WITH {_BUDGET} SELECT query_id, rank, chunk_id, CASE WHEN length(content) > 200 THEN substr(content, 1, 200) || '…' ELSE content END AS snippet, score FROM cu")
def citation_list(spark, d):
    return retrieval.citations(_with_text(_hybrid(spark, d, 10), spark, d))


@query(f"WITH {_HYBRID}, a AS (SELECT query_id, chunk_id, min(rank) AS first_rank FROM (SELECT * FROM vec UNION ALL SELECT * FROM bm) GROUP BY ALL) SELECT query_id, chunk_id, first_rank, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY first_rank, chunk_id) AS INTEGER) AS place FROM a) WHERE place <= 5")
def first_sources(spark, d):
    rows = t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    return retrieval.first_sources(_topk(spark, d).unionByName(retrieval.bm25_topk(_stored_texts(spark, d), _titled(rows))))


@query("SELECT DISTINCT doc_id AS chunk_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, substr(b.text, 1, 60)) OR contains(d.text, right(b.text, 60))")
def golden_hits(spark, d):
    rows = t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    return retrieval.golden_hits(rows, t(spark, d, "benchmark").select("item_id", F.col("text").alias("passage")))


# Quality figures

_JUDGED = f"""{_VEC}, jd AS (SELECT vec.*, q.label = c.label AS rel FROM vec JOIN v q ON q.vec_id = query_id JOIN v c ON c.vec_id = chunk_id),
gold AS (SELECT q.vec_id AS query_id, count(*) AS n_golden FROM v q JOIN v c ON q.label = c.label WHERE q.vec_id % 100 = 0 GROUP BY ALL),
per AS (SELECT query_id, n_golden, max(CAST(rel AND rank <= 3 AS INT)) AS hit_3, max(CAST(rel AND rank <= 5 AS INT)) AS hit_5, max(CAST(rel AND rank <= 10 AS INT)) AS hit_10, min(CASE WHEN rel THEN rank END) AS first,
  sum(CASE WHEN rel AND rank <= 10 THEN 1 ELSE 0 END) AS found, sum(CASE WHEN rel AND rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS l, sum(CASE WHEN rel AND rank <= 10 THEN 1 / sqrt(rank + 1) ELSE 0 END) AS s, sum(CASE WHEN rel AND rank <= 10 THEN 1.0::DOUBLE / rank ELSE 0 END) AS g
  FROM gold LEFT JOIN jd USING (query_id) GROUP BY ALL),
qq AS (SELECT query_id, hit_3, hit_5, hit_10, round(coalesce(1.0::DOUBLE / first, 0), 6) AS rr, round(coalesce(l / list_sum(list_transform(range(1, CAST(found AS INT) + 1), lambda i: 1 / log2(i + 1))), 0), 6) AS ndcg_log2,
  round(coalesce(s / list_sum(list_transform(range(1, least(n_golden, 10) + 1), lambda i: 1 / sqrt(i + 1))), 0), 6) AS ndcg_sqrt, round(coalesce(g / list_sum(list_transform(range(1, least(n_golden, 10) + 1), lambda i: 1.0::DOUBLE / i)), 0), 6) AS ndcg_gain FROM per)"""


def _quality(spark, d) -> DataFrame:
    v = _vectors(spark, d)
    asked = _ask(v).select("query_id", F.col("label").alias("want"))
    hits = _topk(spark, d).join(asked, "query_id").join(v.select("chunk_id", "label"), "chunk_id").select("query_id", "rank", (F.col("label") == F.col("want")).alias("relevant"))
    sizes = v.groupBy("label").agg(F.count(F.lit(1)).alias("n_golden"))
    return metrics.query_quality(hits, asked.join(sizes, F.col("want") == F.col("label")).select("query_id", "n_golden"))


@query(f"WITH {_JUDGED} SELECT * FROM qq")
def ranking_quality(spark, d):
    return _quality(spark, d)


@query(f"""WITH {_JUDGED} SELECT count(*) AS n, round(avg(hit_3), 6) AS hit_3, round(avg(hit_5), 6) AS hit_5, round(avg(hit_10), 6) AS hit_10, round(avg(ndcg_log2), 6) AS ndcg_log2, round(avg(ndcg_sqrt), 6) AS ndcg_sqrt, round(avg(ndcg_gain), 6) AS ndcg_gain,
  round(avg(rr), 6) AS mrr, round(avg(CASE WHEN rr > 0 THEN rr END), 6) AS mrr_answered FROM qq""")
def ranking_report(spark, d):
    return metrics.report(_quality(spark, d))


@query(f"WITH {_RERANK}, ch AS (SELECT DISTINCT coalesce(a.query_id, b.query_id) AS query_id FROM (SELECT * FROM fused WHERE rank <= 10) a FULL JOIN re b ON a.query_id = b.query_id AND a.rank = b.rank WHERE a.chunk_id IS DISTINCT FROM b.chunk_id) SELECT count(*) AS n_reordered FROM ch")
def rerank_reordered(spark, d):
    v = _vectors(spark, d)
    fused = _hybrid(spark, d)
    return metrics.reordered(fused.filter("rank <= 10"), retrieval.rerank_cosine(fused.drop("rank"), v, _ask(v)))


def _pct(*ps):
    return ", ".join(f"list_sort(list(value))[CAST(floor(count(*) * {p}::DOUBLE) AS BIGINT) + 1] AS floor_p{round(100 * p)}, list_sort(list(value))[CAST(ceil(count(*) * {p}::DOUBLE) AS BIGINT)] AS nearest_p{round(100 * p)}" for p in ps)


@query(f"SELECT event_type, count(*) AS n, {_pct(0.5, 0.95, 0.99)} FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    return metrics.percentiles(t(spark, d, "events"), "event_type", "value")


@query("""SELECT source, count(*) AS n, floor(avg(0.3::DOUBLE * quality + 0.3::DOUBLE * (1 - toxic) + 0.2::DOUBLE * quality + 0.2::DOUBLE * (1 - toxic)) * 1000 + 0.5) / 1000 AS mean_score FROM documents JOIN labels USING (doc_id) GROUP BY source""")
def answer_scores(spark, d):
    q, clean = F.col("quality"), 1 - F.col("toxic")
    joined = t(spark, d, "documents").select("doc_id", "source").join(t(spark, d, "labels"), "doc_id")
    return joined.withColumn("s", metrics.answer_score(q, clean, q, clean)).groupBy("source").agg(F.count(F.lit(1)).alias("n"), metrics.round_half_up(F.avg("s"), 3).alias("mean_score"))


# Traces and dashboards

_RATE = "floor(1000.0::DOUBLE * {0} / count(*) + 0.5) / 10"


@query(f"""SELECT CAST(ts AS DATE) AS day, count(*) AS total, count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed, {_RATE.format("count(*) FILTER (event_type <> 'error')")} AS success_rate,
  round(avg(value) FILTER (value > 0), 9) AS mean_value, list_sort(list(value) FILTER (value > 0))[CAST(ceil(count(*) FILTER (value > 0) * 0.95::DOUBLE) AS BIGINT)] AS p95 FROM events GROUP BY ALL""")
def trace_stats(spark, d):
    return traces.run_stats(t(spark, d, "events"))


@query("SELECT user_id, count(*) AS n, arg_max(event_id, {'v': value, 'i': -event_id}) AS event_id, max(value) AS value FROM events GROUP BY user_id")
def trace_slowest(spark, d):
    return traces.slowest(t(spark, d, "events"))


@query("""WITH a AS (SELECT event_id, user_id, value, epoch_us(ts) / 1000 AS ms FROM events), b AS (SELECT *, min(ms) OVER (PARTITION BY user_id) AS st, max(ms + value) OVER (PARTITION BY user_id) AS en FROM a)
SELECT event_id, user_id, round(ms - st, 3) AS offset_ms, round(100.0::DOUBLE * (ms - st) / greatest(en - st, 1), 4) AS left_pct, round(greatest(0.5::DOUBLE, least(100.0::DOUBLE, 100.0::DOUBLE * value / greatest(en - st, 1))), 4) AS width_pct FROM b""")
def trace_timeline(spark, d):
    return traces.timeline(t(spark, d, "events"))


@query("""WITH a AS (SELECT CAST(ts AS DATE) AS day, count(*) AS events, count(DISTINCT user_id) AS active_users FROM events GROUP BY ALL), b AS (SELECT *, lag(events) OVER (ORDER BY day) AS p FROM a)
SELECT day, events, active_users, events - p AS delta, round(100.0::DOUBLE * (events - p) / p, 9) AS delta_pct FROM b""")
def kpi_delta(spark, d):
    return traces.kpi_delta(t(spark, d, "events"))


@query(f"""WITH a AS (SELECT event_type AS mode, count(*) AS n, round(avg(value), 9) AS mean_value, {_RATE.format("count(*) FILTER (value <= 0)")} AS empty_rate, {_RATE.format("count(*) FILTER (value > 20)")} AS slow_rate FROM events GROUP BY ALL)
SELECT *, CASE WHEN slow_rate > 50 THEN 'critical' WHEN slow_rate > 20 THEN 'attention' ELSE 'healthy' END AS health FROM a""")
def perf_rates(spark, d):
    return traces.performance(t(spark, d, "events"))


def _trend_sql(unit: str) -> str:
    return f"""WITH f AS (SELECT date_trunc('{unit}', ts) AS bucket, count(*) AS events, count(DISTINCT user_id) AS users, round(avg(value), 9) AS mean_value FROM events GROUP BY ALL),
b AS (SELECT unnest(generate_series((SELECT min(date_trunc('{unit}', ts)) FROM events), (SELECT max(date_trunc('{unit}', ts)) FROM events), INTERVAL 1 {unit})) AS bucket)
SELECT CAST(b.bucket AS TIMESTAMPTZ) AS bucket, coalesce(events, 0) AS events, coalesce(users, 0) AS users, mean_value FROM b LEFT JOIN f USING (bucket)"""


@query(_trend_sql("day").replace("CAST(b.bucket AS TIMESTAMPTZ)", "CAST(b.bucket AS TIMESTAMP)"))
def trends_daily(spark, d):
    return traces.trend(t(spark, d, "events"), "day").withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query(_trend_sql("hour").replace("CAST(b.bucket AS TIMESTAMPTZ)", "CAST(b.bucket AS TIMESTAMP)"))
def trends_hourly(spark, d):
    return traces.trend(t(spark, d, "events"), "hour").withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query("""SELECT date_trunc('hour', ts) - to_hours(k) AS window_start, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors FROM events, (VALUES (0), (1)) o(k) GROUP BY ALL""")
def rate_sliding(spark, d):
    return traces.sliding_rate(t(spark, d, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM a)
SELECT user_id, min(ts) AS session_start, count(*) AS events, min(event_id) AS first_event FROM b GROUP BY user_id, s""")
def sessionize(spark, d):
    return traces.sessions(t(spark, d, "events")).withColumn("session_start", F.col("session_start").cast("timestamp_ntz"))


@query("SELECT user_id, arg_max(event_type, event_id) AS state, max(event_id) AS event_id, count(DISTINCT event_type) AS states FROM events GROUP BY user_id")
def state_machine_latest(spark, d):
    return traces.latest_state(t(spark, d, "events"))


@query("""WITH a AS (SELECT *, last_value(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS action FROM events),
b AS (SELECT *, max(CASE WHEN event_type <> action THEN event_id END) OVER (PARTITION BY user_id) AS other FROM a)
SELECT user_id, action, count(*) AS run_length, count(*) >= 3 AS is_loop FROM b WHERE other IS NULL OR event_id > other GROUP BY user_id, action""")
def loop_runs(spark, d):
    return traces.trailing_runs(t(spark, d, "events"))


# Memory

_MSG = r"""m AS (SELECT conv_id, conv_id * 1000 + turn AS id, role, text, length(regexp_replace(coalesce(text, ''), '[^\x{2E80}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}]', '', 'g')) AS wide, length(coalesce(text, '')) AS n FROM conversations),
mt AS (SELECT *, wide + (n - wide + 3) // 4 AS tokens FROM m)"""


def _messages(spark, d) -> DataFrame:
    return t(spark, d, "conversations").select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", "text")


@query(f"WITH {_MSG}, c AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY conv_id ORDER BY id DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative FROM mt) SELECT conv_id, id, role, tokens, cumulative FROM c WHERE cumulative <= 300")
def memory_budget_prefix(spark, d):
    return memory.budget_prefix(_messages(spark, d), 300).select("conv_id", "id", "role", "tokens", "cumulative")


@query(f"WITH {_MSG} SELECT conv_id, id, role, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY id DESC) AS INTEGER) AS place FROM m) WHERE place <= 3")
def memory_latest_n(spark, d):
    return memory.latest(_messages(spark, d), 3).select("conv_id", "id", "role", "place")


@query(f"WITH {_MSG}, w AS (SELECT conv_id, min(id) AS watermark FROM m GROUP BY conv_id), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY id DESC) AS place FROM m) SELECT conv_id, id, role FROM r JOIN w USING (conv_id) WHERE id > watermark AND place > 2")
def memory_gap_fill(spark, d):
    m = _messages(spark, d)
    return memory.gap(m, memory.latest(m, 2), m.groupBy("conv_id").agg(F.min("id").alias("watermark"))).select("conv_id", "id", "role")


@query(f"WITH {_MSG} SELECT conv_id, count(*) AS messages, CAST(sum(tokens) AS BIGINT) AS tokens, max(id) AS watermark, count(*) >= 8 OR sum(tokens) >= 2500 AS due FROM mt GROUP BY conv_id")
def summary_trigger(spark, d):
    return memory.summary_due(_messages(spark, d))


@query(f"WITH {_MSG} SELECT conv_id, md5(string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY id)) AS digest FROM m GROUP BY conv_id")
def memory_prompt(spark, d):
    return memory.prompt(_messages(spark, d)).select("conv_id", F.md5(F.col("prompt").cast("binary")).alias("digest"))


@query("SELECT count(*) AS total, count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed FROM events")
def upload_tally(spark, d):
    return memory.tally(t(spark, d, "events").select((F.col("event_type") != "error").alias("ok")))


# Catalogue

@query("SELECT n_nationkey, n_name, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def kb_doc_counts(spark, d):
    kids = t(spark, d, "customer").select(F.col("c_nationkey").alias("n_nationkey"))
    return catalog.counts_per(t(spark, d, "nation").select("n_nationkey", "n_name"), kids, "n_nationkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def owner_semi_join(spark, d):
    owned = catalog.matching(t(spark, d, "customer"), c_mktsegment="BUILDING")
    return t(spark, d, "orders").select("o_orderkey", "o_custkey").join(owned.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join_gap(spark, d):
    return t(spark, d, "customer").select("c_custkey", "c_name").join(t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def latest_order(spark, d):
    return catalog.latest_per(t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey")


@query("SELECT doc_id, source, n_chars FROM documents ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 10 OFFSET 20")
def paginate_docs(spark, d):
    return catalog.page(t(spark, d, "documents").select("doc_id", "source", "n_chars"), [F.col("n_chars").desc_nulls_last(), F.col("doc_id")], 3, 10)


@query("SELECT count(*) AS total, CAST(ceil(count(*) / 10.0) AS BIGINT) AS pages FROM documents")
def page_totals(spark, d):
    return catalog.page_totals(t(spark, d, "documents"), 10)


@query("SELECT doc_id, source FROM documents WHERE contains(text, 'licen') ORDER BY doc_id LIMIT 8")
def keyword_search(spark, d):
    return catalog.page(catalog.like_any(t(spark, d, "documents"), "licen", "text").select("doc_id", "source"), [F.col("doc_id")], 1, 8)


@query("SELECT p_partkey, p_name FROM part WHERE (contains(lower(p_name), 'a') OR contains(lower(p_type), 'steel')) AND p_size IN (1, 5, 9)")
def optional_like(spark, d):
    return catalog.like_any(catalog.matching(t(spark, d, "part"), p_size=[1, 5, 9], p_brand=None), "a", "p_name", ignore_case=True).unionByName(
        catalog.like_any(catalog.matching(t(spark, d, "part"), p_size=[1, 5, 9]), "steel", "p_type", ignore_case=True)
    ).select("p_partkey", "p_name").distinct()


@query("""WITH RECURSIVE n AS (SELECT 'r' || r_regionkey AS code, '' AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
t AS (SELECT code, 0 AS depth, code AS path FROM n WHERE parent = '' UNION ALL SELECT n.code, t.depth + 1, t.path || '/' || n.code FROM t JOIN n ON n.parent = t.code) SELECT code, depth, path FROM t""")
def tree_recursive(spark, d):
    node = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nodes = t(spark, d, "region").select(node("r", "r_regionkey").alias("code"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("sort"))
    nodes = nodes.unionByName(t(spark, d, "nation").select(node("n", "n_nationkey").alias("code"), node("r", "n_regionkey").alias("parent"), F.lit(0).alias("sort")))
    return catalog.tree(nodes.unionByName(t(spark, d, "supplier").select(node("s", "s_suppkey").alias("code"), node("n", "s_nationkey").alias("parent"), F.lit(0).alias("sort"))))


@query("SELECT o_orderkey, count(l_linenumber) AS n_lines, coalesce(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey, l_quantity), '') AS parts FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def run_with_nodes(spark, d):
    lines = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_quantity")
    out = catalog.with_children(t(spark, d, "orders").select("o_orderkey"), lines, "o_orderkey", "l_linenumber")
    return out.select("o_orderkey", F.size("children").cast("long").alias("n_lines"), F.array_join(F.transform("children", lambda c: c["l_partkey"].cast("string")), ",").alias("parts"))


@query("SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src2') AND lower(lang) = 'en'")
def filter_in_list(spark, d):
    return catalog.matching(t(spark, d, "documents"), source=["src1", "src2"]).filter(F.lower("lang") == "en").select("doc_id", "source")


@query("SELECT c_custkey, c_nationkey = 3 OR c_custkey % 50 = 0 AS may_read FROM customer")
def access_predicate(spark, d):
    return t(spark, d, "customer").select("c_custkey", catalog.accessible(F.col("c_nationkey"), F.lit(3), F.col("c_custkey") % 50 == 0).alias("may_read"))


# Guarded SQL: statements that both engines read alike

TPCH = {"region", "nation", "customer", "supplier", "part", "orders", "lineitem"}
STATEMENTS = {
    "sql_join_agg": "SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "sql_semi": "SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 0)",
    "sql_anti": "SELECT p_brand, count(*) AS n FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45) GROUP BY p_brand",
    "sql_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "sql_rollup": "SELECT r_name, n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
    "sql_setops": "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1",
    "sql_window": "SELECT * FROM (SELECT c_nationkey, c_custkey, round(c_acctbal, 2) AS balance, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer) AS w WHERE place <= 3",
    "sql_pricing": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "sql_cte": "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS spent FROM orders GROUP BY o_custkey) SELECT c_mktsegment, count(*) AS n, round(max(spent), 2) AS most FROM big JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment",
}


def _statement(name: str, sql: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        files.tables(spark, d, sorted(TPCH))
        bare = sql if sql.upper().startswith(("SELECT", "WITH")) else f"SELECT * FROM ({sql}) AS q"
        return language.guarded_sql(spark, bare, TPCH)

    run.__name__ = name
    return run


for _name, _sql in STATEMENTS.items():
    QUERIES[_name] = _statement(_name, _sql)
    ORACLE[_name] = _sql.replace("row_number() OVER", "CAST(row_number() OVER").replace("c_custkey) AS place", "c_custkey) AS INTEGER) AS place")


# Streams


def _stream_dir(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(shared or tempfile.mkdtemp(prefix='docloom-stream-')).rstrip('/')}/stream-{uuid.uuid4().hex}"


def _streamed(spark, d, operator, mode: str) -> DataFrame:
    schema = t(spark, d, "events").schema
    folder = _stream_dir(spark)
    events = spark.readStream.schema(schema).parquet(f"{d}/events.parqu*").withColumn("ts", F.col("ts").cast("timestamp"))
    streams.run_available(operator(events), f"{folder}/out", f"{folder}/checkpoint", mode)
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/out")


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    return _streamed(spark, d, streams.tumbling, "complete").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events")
def stream_once(spark, d):
    return _streamed(spark, d, lambda e: streams.once(e.union(e)), "append").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("""WITH s AS (SELECT user_id AS doc_id, CASE arg_max(event_type, event_id) WHEN 'signup' THEN 'PENDING' WHEN 'view' THEN 'PARSED' WHEN 'click' THEN 'CHUNKED' WHEN 'purchase' THEN 'COMPLETED' ELSE 'FAILED' END AS status, max(event_id) AS seq, max(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS chunks FROM events GROUP BY user_id)
SELECT doc_id, CASE WHEN status = 'COMPLETED' AND chunks = 0 THEN 'FAILED' ELSE status END AS status, seq, chunks FROM s""")
def document_states(spark, d):
    status = F.when(F.col("event_type") == "signup", "PENDING").when(F.col("event_type") == "view", "PARSED").when(F.col("event_type") == "click", "CHUNKED").when(F.col("event_type") == "purchase", "COMPLETED").otherwise("FAILED")
    changes = t(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), status.alias("status"), F.when(F.col("value") > 50, 1).otherwise(0).alias("chunks"))
    return streams.document_states(changes)
