"""More registered queries: composed retrieval, ingestion, cache, memory and dashboard operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import catalog, chunking, detection, ingest, language, memory, metrics, passages, retrieval, traces
from ..sources import files
from .queries import _BM, _FUSED, _HYBRID, _MSG, _RERANK, _VEC, _ask, _hybrid, _messages, _stored_texts, _stored_vectors, _stream_dir, _titled, _topk, _vectors, query, t

_RANK = "CAST(row_number() OVER (PARTITION BY query_id ORDER BY {0} DESC, chunk_id) AS INTEGER) AS rank"
#: A model's score of a pair, made from the ids.
_SCORE = "(chunk_id * 37 + query_id * 11) % 101 / 100.0::DOUBLE"


def _scores(hits):
    made = (F.col("chunk_id") * 37 + F.col("query_id") * 11) % 101 / 100.0
    return hits.filter("chunk_id % 5 <> 0").select("query_id", "chunk_id", made.alias("new_score"))


def _contents(spark, d):
    return t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))


# Retrieval


@query(f"WITH {_VEC}, r AS (SELECT query_id, chunk_id, score, CASE WHEN chunk_id % 5 <> 0 THEN {_SCORE} ELSE score END AS relevance FROM vec) SELECT * FROM (SELECT *, {_RANK.format('relevance')} FROM r) WHERE rank <= 10")
def search_with_rerank(spark, d):
    return retrieval.search_with_rerank(_stored_vectors(spark, d), _ask(_vectors(spark, d)), _scores(_topk(spark, d)))


@query(f"WITH {_VEC} SELECT query_id, chunk_id, score, score AS relevance, rank FROM vec")
def search_rerank_fallback(spark, d):
    return retrieval.search_with_rerank(_stored_vectors(spark, d), _ask(_vectors(spark, d)), strict_limit=False)


@query(f"WITH {_HYBRID}, r AS (SELECT query_id, chunk_id, score, CASE WHEN chunk_id % 5 <> 0 THEN {_SCORE} ELSE score END AS relevance FROM fused) SELECT * FROM (SELECT *, {_RANK.format('relevance')} FROM r) WHERE rank <= 10")
def strategy_route(spark, d):
    fused = _hybrid(spark, d)
    return retrieval.route({"hybrid": fused}, "hybrid", _scores(fused))


_LEAVES = "lv AS (SELECT doc_id AS chunk_id, doc_id // 4 AS p, 'c' || doc_id AS content, CASE WHEN doc_id % 2 = 0 THEN 'w' || doc_id ELSE '' END AS window_content FROM documents)"
_HIER = f"""{_VEC}, {_BM}, {_FUSED}, {_LEAVES}, h AS (SELECT query_id, CAST(chunk_id AS VARCHAR) AS chunk_id, 'p' || p AS parent, score, content, window_content FROM fused JOIN lv USING (chunk_id) WHERE rank <= 60),
g AS (SELECT query_id, parent, count(*) AS n, avg(score) AS mean, string_agg(content, ' ' ORDER BY -score, chunk_id) AS content FROM h GROUP BY ALL),
u AS (SELECT query_id, parent AS chunk_id, round(n / 4 * mean + 0.5::DOUBLE * mean, 6) AS score, content, n AS merged_from FROM g WHERE n / 4 >= 0.5 AND n >= 2
      UNION ALL SELECT h.query_id, h.chunk_id, round(h.score, 6), h.content, 1 FROM h JOIN g USING (query_id, parent) WHERE NOT (n / 4 >= 0.5 AND n >= 2)),
m AS (SELECT * FROM (SELECT *, {_RANK.format('score')} FROM u) WHERE rank <= 40),
e AS (SELECT query_id, m.chunk_id, score, CASE WHEN window_content <> '' THEN window_content ELSE m.content END AS content, merged_from, coalesce(window_content <> '', false) AS window_applied FROM m LEFT JOIN lv ON CAST(lv.chunk_id AS VARCHAR) = m.chunk_id)"""


@query(f"WITH {_HIER} SELECT * FROM (SELECT *, {_RANK.format('score')} FROM e) WHERE rank <= 20")
def hierarchical_retrieval(spark, d):
    name = F.col("doc_id").cast("string")
    window = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("w"), name)).otherwise("")
    parent = F.concat(F.lit("p"), F.floor(F.col("doc_id") / 4).cast("string"))
    leaves = t(spark, d, "documents").select(name.alias("chunk_id"), parent.alias("parent"), F.lit(4).alias("siblings"), F.lit("leaf").alias("level"), F.concat(F.lit("c"), name).alias("content"), window.alias("window_content"))
    hits = _hybrid(spark, d, 60).select("query_id", F.col("chunk_id").cast("string").alias("chunk_id"), "score")
    return retrieval.hierarchical(leaves, hits)


@query(f"WITH {_VEC} SELECT query_id, chunk_id, CASE WHEN chunk_id % 2 = 0 THEN 'w' || chunk_id ELSE 'c' || chunk_id END AS content, CASE WHEN chunk_id % 2 = 0 THEN 'c' || chunk_id END AS original_content, chunk_id % 2 = 0 AS window_applied FROM vec")
def window_expansion(spark, d):
    name = F.col("chunk_id").cast("string")
    hits = _topk(spark, d).select("query_id", "chunk_id", F.lit("leaf").alias("level"), F.concat(F.lit("c"), name).alias("content"), F.when(F.col("chunk_id") % 2 == 0, F.concat(F.lit("w"), name)).alias("window_content"))
    return retrieval.expand_window(hits).select("query_id", "chunk_id", "content", "original_content", "window_applied")


@query(f"""WITH {_VEC}, r AS (SELECT query_id, chunk_id, score, CASE WHEN count(*) OVER (PARTITION BY query_id) <= 2 THEN score WHEN chunk_id % 5 <> 0 THEN {_SCORE} ELSE score END AS relevance FROM vec WHERE query_id % 200 = 0 OR rank <= 2)
SELECT * FROM (SELECT *, {_RANK.format('relevance')} FROM r) WHERE rank <= 10""")
def rerank_by_model(spark, d):
    hits = _topk(spark, d).filter("query_id % 200 = 0 or rank <= 2").drop("rank")
    return retrieval.rerank_scores(hits, _scores(hits))


_SAID = """um AS (SELECT doc_id AS query_id, CASE WHEN doc_id % 300 = 0 AND trim(substr(text, 1, 20)) <> '' THEN substr(text, 1, 20) ELSE substr(text, 1, 30) END AS said FROM documents WHERE doc_id % 100 = 0 AND text IS NOT NULL),
uq AS (SELECT query_id, replace(said, 'the', 'THE') || CASE WHEN query_id % 200 = 0 THEN ' data' ELSE '' END AS query,
  list_concat(list_concat(CASE WHEN query_id % 300 = 0 AND trim(said) <> '' THEN ['condense'] ELSE [] END, CASE WHEN replace(said, 'the', 'THE') <> said THEN ['map'] ELSE [] END), CASE WHEN query_id % 200 = 0 THEN ['expand'] ELSE [] END) AS steps FROM um)"""


def _said(spark, d):
    rows = t(spark, d, "documents").filter("doc_id % 100 = 0 and text is not null")
    short = F.substring("text", 1, 20)
    condensed = F.when((F.col("doc_id") % 300 == 0) & (F.trim(short) != ""), short)
    return rows.select(F.col("doc_id").alias("query_id"), X.title(F.col("text")).alias("message"), condensed.alias("condensed"), F.when(F.col("doc_id") % 200 == 0, F.array(F.lit("data"))).alias("expansions"))


@query(f"WITH {_SAID} SELECT query_id, query, array_to_string(steps, ',') AS steps FROM uq")
def query_understanding(spark, d):
    return retrieval.understood(_said(spark, d), [language.TermRule("the", "THE")]).withColumn("steps", F.array_join("steps", ","))


_CONTEXT = _RERANK.replace(_BM, _BM.replace("qt AS (SELECT DISTINCT doc_id AS query_id, unnest(regexp_extract_all(lower(substr(text, 1, 30)), '[\\p{L}\\p{Nd}]+')) AS term FROM documents WHERE doc_id % 100 = 0)", f"{_SAID}, qt AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{Nd}}]+')) AS term FROM uq)"))
_CONTEXT_SQL = rf"""WITH {_CONTEXT}, cx AS (SELECT query_id, chunk_id, rank, coalesce(text, '') AS content FROM re JOIN documents ON doc_id = chunk_id WHERE rank <= 5),
tc AS (SELECT *, length(regexp_replace(content, '[^\x{{2E80}}-\x{{9FFF}}\x{{F900}}-\x{{FAFF}}\x{{FF00}}-\x{{FFEF}}]', '', 'g')) AS wide FROM cx),
cu AS (SELECT *, sum(wide + (length(content) - wide) // 4) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS cumulative FROM tc),
kp AS (SELECT query_id, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY rank) AS sources, rtrim(string_agg('【文档】' || content, chr(10) || chr(10) ORDER BY rank), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS context FROM cu WHERE cumulative <= 4000 OR rank = 1 GROUP BY query_id)
SELECT query_id, array_to_string(CASE WHEN sources IS NULL THEN steps ELSE list_append(steps, 'retrieve') END, ',') AS steps, coalesce(sources, '') AS sources, md5(coalesce(context, '')) AS digest FROM uq LEFT JOIN kp USING (query_id)"""


@query(_CONTEXT_SQL)
def context_pipeline(spark, d):
    v = _vectors(spark, d)
    out = retrieval.retrieval_context(_said(spark, d), [language.TermRule("the", "THE")], _contents(spark, d), v, _ask(v).select("query_id", "vector"), indexes=(_stored_vectors(spark, d), _stored_texts(spark, d)))
    sources = F.array_join(F.transform("sources", lambda x: x.cast("string")), ",")
    return out.select("query_id", F.array_join("steps", ",").alias("steps"), sources.alias("sources"), F.md5(F.col("context").cast("binary")).alias("digest"))


@query(f"WITH {_HYBRID} SELECT query_id, md5(string_agg('[' || chunk_id || '] ' || coalesce(text, ''), chr(10) ORDER BY rank)) AS digest FROM fused JOIN documents ON doc_id = chunk_id GROUP BY query_id")
def action_knowledge(spark, d):
    hits = _hybrid(spark, d).join(_contents(spark, d), "chunk_id")
    return retrieval.knowledge_action(hits).select("query_id", F.md5(F.col("answer").cast("binary")).alias("digest"))


def _golden(spark, d):
    return t(spark, d, "benchmark").select("item_id", F.col("text").alias("passage"))


@query()
def passage_matches(spark, d):
    """Passages against whole documents and against misspelt passages."""
    golden = _golden(spark, d)
    misspelt = golden.select((-1 - F.col("item_id")).alias("chunk_id"), F.translate("passage", "aeT", "ea").alias("content"))
    return passages.passage_matches(_contents(spark, d).unionByName(misspelt), golden)


@query("SELECT doc_id AS chunk_id, item_id FROM documents d JOIN benchmark b ON length(b.text) >= 20 AND contains(lower(d.text), lower(b.text))")
def passage_containment(spark, d):
    return passages.contained(_contents(spark, d), _golden(spark, d))


# Ingestion and cache


def _uploads(spark, d):
    events = t(spark, d, "documents").select(F.col("doc_id").alias("event_id"), (F.col("doc_id") * 2 % 1500).alias("doc_id"))
    docs = t(spark, d, "documents").select("doc_id", "text", (F.col("doc_id") % 7 == 0).alias("deleted"))
    return ingest.staged(events.unionByName(events), docs)


_STAGED = r"""fd AS (SELECT doc_id, text, coalesce(regexp_matches(text, '\S'), false) AS parsed FROM documents WHERE doc_id IN (SELECT doc_id * 2 % 1500 FROM documents) AND doc_id % 7 <> 0)"""


def _staged_sql(fixed: str) -> str:
    return rf"""WITH {_STAGED}, {fixed}, n AS (SELECT doc_id, count(*) AS chunks FROM chunks WHERE regexp_matches(content, '\S') GROUP BY doc_id)
SELECT doc_id, CASE WHEN parsed AND chunks > 0 THEN 'COMPLETED' ELSE 'FAILED' END AS status, CASE WHEN NOT parsed THEN 'parse' WHEN coalesce(chunks, 0) = 0 THEN 'chunk' ELSE 'index' END AS stage, CASE WHEN parsed THEN coalesce(chunks, 0) ELSE 0 END AS chunks FROM fd LEFT JOIN n USING (doc_id)"""


def _register_staged():
    from .queries import _FIXED

    @query(_staged_sql(_FIXED))
    def ingest_stages(spark, d):
        return _uploads(spark, d)[0]

    @query(rf"WITH {_STAGED}, {_FIXED} SELECT md5(doc_id || ':fixed:' || chunk_index) AS chunk_id, doc_id, CAST(chunk_index AS BIGINT) AS chunk_index FROM chunks WHERE regexp_matches(content, '\S') AND doc_id IN (SELECT doc_id FROM fd WHERE parsed)")
    def ingest_chunk_ids(spark, d):
        return _uploads(spark, d)[1].select("chunk_id", "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"))


_register_staged()


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
h AS (SELECT vec_id AS entry_id, vec_id % 90 AS key, vec_id // 3 * 30000 AS made, e, row_number() OVER (ORDER BY vec_id // 3 * 30000, vec_id DESC) AS place FROM v WHERE vec_id % 2 = 1),
a AS (SELECT vec_id AS action_id, vec_id % 90 // 2 * 2 + 1 AS key, vec_id * 10000 + 5 AS asked, e, (SELECT count(*) FROM h WHERE made <= v.vec_id * 10000 + 5) AS seen FROM v WHERE vec_id % 2 = 0),
m AS (SELECT action_id, entry_id, made, a.key = h.key AS exact, round(coalesce(list_inner_product(a.e, h.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(h.e, h.e)), 0), 9) AS alike
  FROM a JOIN h ON place <= seen AND place > seen - 50 AND asked - made <= 3600000)
SELECT action_id, arg_min(entry_id, {'a': NOT exact, 'b': CASE WHEN exact THEN -made::DOUBLE ELSE -alike END, 'c': entry_id}) AS entry_id, CASE WHEN bool_or(exact) THEN 'exact' ELSE 'similar' END AS kind FROM m WHERE exact OR alike > 0.95 GROUP BY action_id""")
def action_cache(spark, d):
    v = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 90).alias("key"), F.col("embedding").alias("vector"))
    odd = F.floor(F.col("key") / 2) * 2 + 1
    actions = v.filter("id % 2 = 0").select(F.col("id").alias("action_id"), odd.alias("key"), (F.col("id") * 10_000 + 5).alias("at_ms"), "vector")
    entries = v.filter("id % 2 = 1").select(F.col("id").alias("entry_id"), "key", (F.floor(F.col("id") / 3) * 30_000).alias("made_ms"), "vector")
    return ingest.cached(actions, entries, capacity=50)


@query("SELECT doc_id, text IS NULL OR doc_id % 3 = 0 AS replaced, length(CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, 100) ELSE text END) AS n FROM documents WHERE doc_id % 5 <> 0")
def store_upsert_delete(spark, d):
    docs = t(spark, d, "documents").select("doc_id", F.col("text").alias("content"), F.col("text").isNull().alias("replaced"))
    new = docs.filter("doc_id % 3 = 0").withColumn("replaced", F.lit(True))
    kept = files.deleted(files.upserted(docs, new, "doc_id", 100), docs.filter("doc_id % 5 = 0"), "doc_id")
    return kept.select("doc_id", "replaced", F.length("content").cast("long").alias("n"))


@query("SELECT doc_id, text IS NOT NULL AS has_text, length(text) AS n FROM documents WHERE regexp_matches(text, '\\S')")
def chunk_files_round_trip(spark, d):
    path = f"{_stream_dir(spark)}/chunks"
    docs = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("doc_id").cast("string").alias("document_id"), F.col("text").alias("content"), F.lit(1).alias("token_count"), F.lit(0).alias("chunk_index"), F.create_map(F.lit("a"), F.lit("b")).alias("metadata"))
    files.write_chunks(docs, path)
    return files.read_chunks(spark, path, "kb", lines=True).select(F.col("document_id").cast("long").alias("doc_id"), F.col("content").isNotNull().alias("has_text"), F.length("content").cast("long").alias("n"))


@query("SELECT n_nationkey AS id, n_nationkey NOT IN (3, 5, 8) OR n_nationkey = 8 AS enabled FROM nation")
def bulk_enable(spark, d):
    rows = t(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.lit(True).alias("enabled"), (F.col("n_nationkey") == 8).alias("deleted"))
    return catalog.set_enabled(rows, [3, 5, 8], False).select("id", "enabled")


# Texts


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'MARKDOWN' WHEN 1 THEN 'HTML' WHEN 2 THEN 'JSON' WHEN 3 THEN 'CSV' WHEN 4 THEN 'MARKDOWN' ELSE 'PLAIN_TEXT' END AS doc_type FROM documents")
def doc_type_by_name(spark, d):
    i = F.col("doc_id") % 6
    mime = F.when(i == 0, "text/markdown").when(i == 1, "TEXT/HTML").when(i == 5, "text/unheard-of")
    name = F.when(i == 2, "a.b.JSON").when(i == 3, "x.csv").when(i == 4, "README.md")
    return t(spark, d, "documents").select("doc_id", detection.document_type(F.lit(""), mime, name).alias("doc_type"))


@query(r"SELECT doc_id, md5(CASE doc_id % 3 WHEN 0 THEN trim('before' || ' after ' || doc_id) WHEN 1 THEN 'open' ELSE 'plain ' || doc_id END) AS digest FROM documents")
def think_tags(spark, d):
    i, n = F.col("doc_id") % 3, F.col("doc_id").cast("string")
    said = F.when(i == 0, F.concat(F.lit("before<think>"), F.substring("text", 1, 50), F.lit("</think> after "), n)).when(i == 1, F.concat(F.lit("open <think>"), n)).otherwise(F.concat(F.lit("plain "), n))
    clean = t(spark, d, "documents").withColumn("text", F.coalesce(F.replace("text", F.lit("<"), F.lit("(")), F.lit("")))
    return clean.select("doc_id", F.md5(X.without_thinking(said).cast("binary")).alias("digest"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 0.5::DOUBLE ELSE least(1.0, doc_id % 13 / 10.0::DOUBLE) END AS score, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 2 END AS strings, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'q' || doc_id END AS query FROM documents")
def model_answers(spark, d):
    n = F.col("doc_id").cast("string")
    bad = F.lit("the model said nothing useful")
    said = F.when(F.col("doc_id") % 4 == 0, bad).otherwise(F.concat(F.lit('Sure: {"score": '), (F.col("doc_id") % 13 / 10.0).cast("string"), F.lit(', "query": "q'), n, F.lit('"} and more')))
    strings = F.when(F.col("doc_id") % 4 == 0, bad).otherwise(F.concat(F.lit('see ["a", "'), n, F.lit('"] end')))
    return t(spark, d, "documents").select("doc_id", X.score_in(said).alias("score"), F.size(X.strings_in(strings)).alias("strings"), X.json_field(said, "query").alias("query"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'tok' || doc_id END AS delta, '<table><tr><td>' || doc_id || '</td><td>a&amp;b</td></tr></table>' AS html FROM documents")
def streamed_deltas(spark, d):
    n = F.col("doc_id").cast("string")
    line = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('data: {"choices":[{"delta":{"content":"tok'), n, F.lit('"}}]}'))).otherwise("data: [DONE]")
    cells = F.array(F.array(n, F.lit("a&b")))
    return t(spark, d, "documents").select("doc_id", X.sse_delta(line).alias("delta"), X.table_html(cells).alias("html"))


@query("SELECT doc_id, 'search' AS action, CASE WHEN doc_id % 2 = 0 THEN 'SELECT ' || doc_id || ' AS a' END AS sql FROM documents")
def agent_fields(spark, d):
    n = F.col("doc_id").cast("string")
    said = F.concat(F.lit("Thought: x\nAction:  search \nInput: "), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("SELECT "), n, F.lit(" AS a; drop"))).otherwise(n))
    return t(spark, d, "documents").select("doc_id", X.react_field(said, "Action").alias("action"), X.sql_in(said).alias("sql"))


@query(r"SELECT doc_id, md5(coalesce(nullif(regexp_extract(text, '(?s)^([^\x{2E80}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}]*[\x{2E80}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}]){40}'), ''), text)) AS digest FROM documents")
def token_cut(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5(X.cut_to_tokens(F.col("text"), 40).cast("binary")).alias("digest"))


@query(r"""WITH i AS (SELECT conv_id, turn, CASE WHEN text IS NULL OR NOT regexp_matches(text, '\S') THEN 'UNKNOWN' WHEN regexp_matches(text, '(?i)summar|总结|概括') THEN 'SUMMARY'
  WHEN regexp_matches(text, '(?i)\b(find|search|where is)\b|查找|搜索') THEN 'PRECISE_SEARCH' WHEN regexp_matches(text, '(?i)^\s*(hi|hello|thanks|thank you)\b|你好|谢谢') THEN 'CHIT_CHAT' ELSE 'KNOWLEDGE_QA' END AS intent FROM conversations)
SELECT conv_id, turn, intent NOT IN ('UNKNOWN', 'CHIT_CHAT') AS needs_retrieval, intent <> 'CHIT_CHAT' AS knowledge_qa FROM i""")
def retrieval_need(spark, d):
    intent = language.intent(F.col("text"))
    return t(spark, d, "conversations").select("conv_id", "turn", language.needs_retrieval(intent).alias("needs_retrieval"), language.is_knowledge_qa(intent).alias("knowledge_qa"))


# Catalogue


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders WHERE o_orderkey > 1000) WHERE r <= 2")
def newest_above_watermark(spark, d):
    rows = t(spark, d, "orders").filter("o_orderkey > 1000").select(F.col("o_custkey").alias("conv_id"), F.col("o_orderkey").alias("id"))
    return memory.latest(rows, 2).select(F.col("conv_id").alias("o_custkey"), F.col("id").alias("o_orderkey"))


@query("SELECT n_regionkey, n_name, CAST(row_number() OVER (ORDER BY n_regionkey, n_name) AS INTEGER) AS place FROM nation")
def nodes_in_order(spark, d):
    from pyspark.sql import Window as W

    first = catalog.page(t(spark, d, "nation").select("n_regionkey", "n_name"), [F.col("n_regionkey"), F.col("n_name")], 1, 100)
    return first.withColumn("place", F.row_number().over(W.orderBy("n_regionkey", "n_name")))


@query("SELECT conv_id, turn, role, label FROM conversations LEFT JOIN embeddings ON vec_id = conv_id * 7 + turn")
def message_sources(spark, d):
    sources = t(spark, d, "embeddings").select(F.col("vec_id").alias("source"), "label")
    messages = t(spark, d, "conversations").withColumn("source", F.col("conv_id") * 7 + F.col("turn"))
    return messages.join(sources, "source", "left").select("conv_id", "turn", "role", "label")


@query("SELECT c_custkey, c_nationkey = 3 OR c_custkey % 50 = 0 AS may_read FROM customer")
def access_private(spark, d):
    return t(spark, d, "customer").select("c_custkey", catalog.accessible(F.col("c_nationkey"), F.lit(3), F.col("c_custkey") % 50 == 0, public=False).alias("may_read"))


# Memory

_WIDE = r"[^\x{2E80}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}]"
_SUMMARY = rf"""sm AS (SELECT conv_id, string_agg(coalesce(text, ''), ' ' ORDER BY id) AS full_text FROM m WHERE id % 1000 <= 1 GROUP BY conv_id),
st AS (SELECT *, length(regexp_replace(full_text, '{_WIDE}', '', 'g')) AS sw, length(full_text) AS sn FROM sm),
su AS (SELECT conv_id, least(sw + (sn - sw + 3) // 4, 100) AS stok, CASE WHEN sw + (sn - sw + 3) // 4 > 100 THEN coalesce(nullif(regexp_extract(full_text, '(?s)^({_WIDE}*[\x{{2E80}}-\x{{9FFF}}\x{{F900}}-\x{{FAFF}}\x{{FF00}}-\x{{FFEF}}]){{100}}'), ''), full_text) ELSE full_text END AS summary FROM st)"""


def _summaries(spark, d):
    m = _messages(spark, d).filter("id % 1000 <= 1")
    ordered = F.array_sort(F.collect_list(F.struct("id", F.coalesce("text", F.lit("")).alias("text"))))
    return m.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("summary"))


@query(rf"""WITH {_MSG}, {_SUMMARY}, c AS (SELECT mt.*, coalesce(stok, 0) AS stok, coalesce(summary, '') AS summary, sum(tokens) OVER (PARTITION BY mt.conv_id ORDER BY id DESC ROWS UNBOUNDED PRECEDING) AS cum FROM mt LEFT JOIN su USING (conv_id)),
k AS (SELECT *, cum <= 100 - stok AND cum - tokens < 100 - stok AS kept FROM c)
SELECT conv_id, md5(any_value(summary)) AS digest, any_value(stok) AS summary_tokens, coalesce(string_agg(CASE WHEN kept THEN CAST(id AS VARCHAR) END, ',' ORDER BY id), '') AS ids, CAST(any_value(stok) + coalesce(sum(tokens) FILTER (kept), 0) AS BIGINT) AS used FROM k GROUP BY conv_id""")
def memory_summary_first(spark, d):
    out = memory.bounded(_messages(spark, d), _summaries(spark, d), 100)
    ids = F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")
    return out.select("conv_id", F.md5(F.col("summary").cast("binary")).alias("digest"), "summary_tokens", ids.alias("ids"), "used")


@query(f"""WITH {_MSG}, w AS (SELECT conv_id, min(id) AS watermark FROM m WHERE conv_id % 2 = 0 GROUP BY conv_id), a AS (SELECT mt.* FROM mt LEFT JOIN w USING (conv_id) WHERE id > coalesce(watermark, -1)),
d AS (SELECT conv_id, count(*) AS messages, max(id) AS reached FROM a GROUP BY conv_id HAVING count(*) >= 3 OR sum(tokens) >= 2500)
SELECT conv_id, messages, conv_id % 3 <> 0 AS rolled, CASE WHEN conv_id % 3 <> 0 THEN reached ELSE coalesce(watermark, -1) END AS watermark, CASE WHEN conv_id % 3 <> 0 THEN 's' || conv_id END AS summary FROM d LEFT JOIN w USING (conv_id)""")
def summary_rolled(spark, d):
    m = _messages(spark, d)
    marks = m.filter("conv_id % 2 = 0").groupBy("conv_id").agg(F.min("id").alias("watermark"))
    new = m.filter("conv_id % 3 <> 0").select("conv_id", F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("new_summary")).distinct()
    return memory.rolled(m, marks, new, most=3)


@query(f"""WITH {_MSG}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY id DESC) AS place FROM m WHERE id % 1000 > 0), n AS (SELECT conv_id, count(*) AS expected FROM m GROUP BY conv_id),
p AS (SELECT conv_id, least(count(*), 2) AS present FROM m GROUP BY conv_id)
SELECT r.conv_id, id, role FROM r JOIN n USING (conv_id) JOIN p USING (conv_id) WHERE present < expected AND place <= greatest(10, expected) AND id NOT IN (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY conv_id ORDER BY id DESC) AS q FROM m) WHERE q <= 2)""")
def memory_restored(spark, d):
    m = _messages(spark, d)
    marks = m.select("conv_id", (F.col("conv_id") * 1000).alias("watermark")).distinct()
    return memory.restored(m, memory.latest(m, 2), m.groupBy("conv_id").agg(F.count(F.lit(1)).alias("expected")), marks).select("conv_id", "id", "role")


@query(rf"""WITH {_MSG}, {_SUMMARY}, f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY id) AS r FROM m), p AS (SELECT conv_id, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY id) AS body FROM f WHERE r <= 3 GROUP BY conv_id)
SELECT conv_id, md5(CASE WHEN coalesce(full_text, '') <> '' THEN full_text || chr(10) ELSE '' END || body) AS digest FROM p LEFT JOIN sm USING (conv_id)""")
def action_history(spark, d):
    return memory.history(_messages(spark, d), _summaries(spark, d), 3).select("conv_id", F.md5(F.col("answer").cast("binary")).alias("digest"))


@query(rf"""WITH {_MSG}, {_SUMMARY}, p AS (SELECT conv_id, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY id) AS body FROM m GROUP BY conv_id)
SELECT conv_id, md5(CASE WHEN coalesce(full_text, '') <> '' THEN '## summary' || chr(10) || full_text || chr(10) || chr(10) ELSE '' END || '## messages' || chr(10) || body) AS digest FROM p LEFT JOIN sm USING (conv_id)""")
def prompt_sections(spark, d):
    m = _messages(spark, d)
    parts = memory.prompt(m).withColumnRenamed("prompt", "messages").join(_summaries(spark, d), "conv_id", "left").withColumn("context", F.lit(""))
    return memory.sectioned(parts, ("summary", "context", "messages")).select("conv_id", F.md5(F.col("prompt").cast("binary")).alias("digest"))


# Figures


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), a AS (SELECT q.vec_id AS answer_id, q.e AS q, n.e AS n FROM v q LEFT JOIN v n ON n.vec_id = q.vec_id + 1 AND q.vec_id % 3 <> 0),
c AS (SELECT *, list_inner_product(q, n) / sqrt(list_inner_product(q, q) * list_inner_product(n, n)) AS cs FROM a)
SELECT answer_id, round(CASE WHEN answer_id % 5 > 0 THEN least(answer_id % 7, answer_id % 5) / (answer_id % 5) ELSE 0 END, 6) AS faithfulness, round(CASE WHEN cs IS NULL THEN 0.5::DOUBLE ELSE least(1, (cs + 1) / 2) END, 6) AS relevancy,
  CASE WHEN answer_id % 2 = 0 THEN 0.5::DOUBLE ELSE 1 END AS precision, round(CASE WHEN answer_id % 4 > 0 THEN 1 / (answer_id % 4) ELSE 0 END, 6) AS recall FROM c""")
def judged_figures(spark, d):
    v = t(spark, d, "embeddings").select(F.col("vec_id").alias("answer_id"), F.col("embedding").alias("question"))
    after = v.select((F.col("answer_id") - 1).alias("answer_id"), F.col("question").alias("next")).filter("answer_id % 3 <> 0")
    i = F.col("answer_id")
    inferred = F.when(F.col("next").isNull(), F.array().cast("array<array<float>>")).otherwise(F.array("next", "question"))
    verdicts = F.when(i % 2 == 0, F.array(F.lit("True, it holds"), F.lit("no"))).otherwise(F.array(F.lit("true")))
    given = v.join(after, "answer_id", "left").select("answer_id", "question", inferred.alias("inferred"), verdicts.alias("verdicts"), F.least(i % 7, i % 5).alias("supported"), (i % 5).alias("claims"), F.least(i % 4, F.lit(1)).alias("found"), (i % 4).alias("truths"))
    return metrics.judged(given)


_EDGES = (5.0, 10.0, 20.0, 50.0, 100.0)
_HISTOGRAM = "h AS (SELECT event_type, le, CASE WHEN le IS NULL THEN count(value) ELSE count(*) FILTER (value <= le) END AS count FROM events, (VALUES (5.0::DOUBLE), (10.0), (20.0), (50.0), (100.0), (NULL)) b(le) GROUP BY event_type, le)"


@query(f"WITH {_HISTOGRAM} SELECT event_type, le, count FROM h")
def latency_histogram(spark, d):
    return metrics.histogram(t(spark, d, "events"), "event_type", "value", _EDGES)


@query(f"""WITH {_HISTOGRAM}, r AS (SELECT *, max(count) OVER (PARTITION BY event_type) AS total, coalesce(lag(count) OVER w, 0) AS below, coalesce(lag(le) OVER w, 0) AS lo FROM h WINDOW w AS (PARTITION BY event_type ORDER BY le NULLS LAST)),
b AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY le NULLS LAST) AS n FROM r WHERE count >= total * 0.95::DOUBLE)
SELECT event_type, round(CASE WHEN le IS NULL OR count = below THEN lo ELSE lo + (le - lo) * (total * 0.95::DOUBLE - below) / (count - below) END, 6) AS quantile FROM b WHERE n = 1""")
def histogram_p95(spark, d):
    return metrics.histogram_quantile(metrics.histogram(t(spark, d, "events"), "event_type", "value", _EDGES), "event_type", 0.95)


@query("""WITH s AS (SELECT event_type, epoch_us(ts) // 86400000000 AS step, count(*) AS c FROM events GROUP BY ALL)
SELECT a.event_type, a.step, CAST(sum(b.c) FILTER (b.step = a.step) AS BIGINT) AS increase_1, round(sum(b.c) FILTER (b.step = a.step) / 86400, 9) AS rate_1, CAST(sum(b.c) FILTER (b.step > a.step - 2) AS BIGINT) AS increase_2, round(sum(b.c) FILTER (b.step > a.step - 2) / 172800, 9) AS rate_2,
  CAST(sum(b.c) AS BIGINT) AS increase_5, round(sum(b.c) / 432000, 9) AS rate_5 FROM s a JOIN s b ON a.event_type = b.event_type AND b.step BETWEEN a.step - 4 AND a.step GROUP BY ALL""")
def counter_rates(spark, d):
    return traces.counter_rates(t(spark, d, "events"), (1, 2, 5), "day")


_PCT = "floor(1000.0::DOUBLE * {0} / count(*) + 0.5) / 10"


@query(f"""WITH a AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(avg(value), 9) AS mean_value, {_PCT.format("count(*) FILTER (event_type <> 'error')")} AS success_rate, {_PCT.format("count(*) FILTER (event_type = 'error')")} AS error_rate,
  {_PCT.format("count(*) FILTER (value <= 0)")} AS empty_rate, {_PCT.format("count(*) FILTER (value > 20)")} AS slow_rate, list_sort(list(value))[CAST(ceil(count(*) * 0.95::DOUBLE) AS BIGINT)] AS p95 FROM events GROUP BY ALL)
SELECT *, CASE WHEN error_rate > 5 OR success_rate < 95 THEN 'critical' WHEN empty_rate > 20 THEN 'attention' ELSE 'healthy' END AS health, CASE WHEN mean_value > 15 THEN 'latency' WHEN error_rate > 5 THEN 'errors' WHEN empty_rate > 20 THEN 'no documents' ELSE 'none' END AS insight FROM a""")
def performance_report(spark, d):
    return traces.performance_report(t(spark, d, "events").withColumn("day", F.to_date("ts")), "day")


@query("""SELECT user_id AS doc_id, round(coalesce(sum(value) FILTER (event_type = 'view'), 0), 6) AS extract_ms, round(coalesce(sum(value) FILTER (event_type = 'click'), 0), 6) AS chunk_ms, round(coalesce(sum(value) FILTER (event_type = 'purchase'), 0), 6) AS embed_ms, round(sum(value), 6) AS total_ms FROM events GROUP BY user_id""")
def stage_durations(spark, d):
    e = F.col("event_type")
    stage = F.when(e == "view", "extract").when(e == "click", "chunk").when(e == "purchase", "embed").otherwise("other")
    out = traces.stage_durations(t(spark, d, "events").select(F.col("user_id").alias("doc_id"), stage.alias("stage"), F.col("value").alias("ms")))
    return out.select("doc_id", *[F.round(c, 6).alias(c) for c in ("extract_ms", "chunk_ms", "embed_ms", "total_ms")])


@query("""WITH n AS (SELECT user_id AS task_id, event_type = 'error' AS bad, event_id * 10 AS s, CASE WHEN event_id % 97 = 0 THEN NULL ELSE event_id * 10 + 5 END AS e FROM events)
SELECT task_id, count(*) AS nodes, count(*) FILTER (bad) AS failed, CASE WHEN bool_or(bad) THEN 'FAILED' WHEN bool_or(e IS NULL) THEN 'RUNNING' ELSE 'DONE' END AS status, CASE WHEN NOT bool_or(e IS NULL) THEN max(e) - min(s) END AS duration_ms FROM n GROUP BY task_id""")
def ingestion_nodes(spark, d):
    e = t(spark, d, "events")
    end = F.when(F.col("event_id") % 97 != 0, F.col("event_id") * 10 + 5)
    return traces.node_report(e.select(F.col("user_id").alias("task_id"), F.col("event_id").alias("node_id"), F.when(F.col("event_type") == "error", "FAILED").otherwise("DONE").alias("status"), (F.col("event_id") * 10).alias("start_ms"), end.alias("end_ms")))


@query("""WITH q AS (SELECT event_type AS mode, value AS latency, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS hit_5, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1.0::DOUBLE / (event_id % 3) END AS rr FROM events)
SELECT mode, round(avg(latency), 6) AS mean, max(latency) AS most, round(avg(hit_5), 6) AS hit_5, round(avg(rr), 6) AS mrr, count(*) AS n, """ + ", ".join(f"list_sort(list(latency))[CAST(floor(count(*) * {p}::DOUBLE) AS BIGINT) + 1] AS floor_p{round(100 * p)}, list_sort(list(latency))[CAST(ceil(count(*) * {p}::DOUBLE) AS BIGINT)] AS nearest_p{round(100 * p)}" for p in (0.5, 0.95, 0.99)) + " FROM q GROUP BY mode")
def bench_by_mode(spark, d):
    i = F.col("event_id") % 3
    per = t(spark, d, "events").select(F.col("event_type").alias("mode"), F.col("value").alias("latency"), F.when(i == 0, 0).otherwise(1).alias("hit_5"), F.when(i == 0, 0.0).otherwise(1.0 / i).alias("rr"))
    return metrics.by_mode(per)
