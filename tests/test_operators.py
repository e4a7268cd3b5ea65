"""Literal cases of the operators, and invariants of the chunkers and memory."""

import random

import pytest
from docloom.functions import text as X
from docloom.operators import catalog, chunking, detection, language, memory, metrics, retrieval
from docloom.sources import files
from docloom.streaming import stateful, streams
from pyspark.sql import functions as F


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")


def test_token_estimates(spark):
    df = texts(spark, "中文ab c.", "", "abcd efgh")
    got = df.select(X.tokens_by_block(F.col("text")), X.tokens_weighted(F.col("text")), X.tokens_of_memory(F.col("text")), X.tokens_of_context(F.col("text"))).collect()
    assert [tuple(r) for r in got] == [(3, 4, 4, 3), (0, 0, 0, 0), (2, 2, 3, 2)]


def test_small_parsers(spark):
    df = texts(spark, "<think>a</think> b", "x <think>open", 'data: {"choices":[{"delta":{"content":"hi"}}]}', 'so {"score": 0.8}', "Reasoning: why\nAction: sql\n", "please select 1 from t; drop")
    got = df.select(X.without_thinking(F.col("text")), X.sse_delta(F.col("text")), X.score_in(F.col("text")), X.react_field(F.col("text"), "Action"), X.sql_in(F.col("text"))).collect()
    assert [r[0] for r in got[:2]] == ["b", "x"] and got[2][1] == "hi" and got[0][1] is None
    assert got[3][2] == 0.8 and got[0][2] == 0.5 and got[4][3] == "sql" and got[0][3] is None and got[5][4] == "select 1 from t"
    table = spark.sql("select array(array('a<b', 'c&d')) as r").select(X.table_html(F.col("r"))).first()[0]
    assert table == "<table><tr><td>a&lt;b</td><td>c&amp;d</td></tr></table>"


def test_fixed_chunks_cover_the_text(spark):
    r = random.Random(1)
    values = ["".join(r.choice("abc \n") * r.randrange(1, 9) for _ in range(r.randrange(1, 400))) for _ in range(30)] + ["", None, "x" * 1500]
    rows = chunking.fixed(texts(spark, *values)).collect()
    by = {}
    for c in sorted(rows, key=lambda c: (c.doc_id, c.chunk_index)):
        assert c.content == values[c.doc_id][c.start_offset : c.end_offset] and c.start_offset == 462 * c.chunk_index
        by.setdefault(c.doc_id, []).append(c)
    assert set(by) == {i for i, v in enumerate(values) if v}
    assert all(cs[-1].end_offset == len(values[i]) and all(c.end_offset < len(values[i]) for c in cs[:-1]) for i, cs in by.items())


def test_folded_chunkers(spark):
    prose = " ".join(f"Sentence number {i} has several words in it." for i in range(200))
    fenced = "# Head\n\npara one\n\n```\ncode\n\nmore\n```\n\n" + "\n\n".join("p" * 400 for _ in range(8)) + "\n\n```open"
    df = texts(spark, prose, fenced, "", None, "一二三。四五六！" * 300)
    semantic = chunking.semantic(df).filter("doc_id = 0").orderBy("chunk_index").collect()
    assert len(semantic) > 1 and all(f"number {i} " in "".join(c.content for c in semantic) for i in range(200))
    pieces = [c.content for c in chunking.structural(df).filter("doc_id = 1").orderBy("chunk_index").collect()]
    assert "```\ncode\n\nmore\n```" in pieces and pieces[-1] == "```open" and sum(p.count("p" * 400) for p in pieces) == 8
    swa = chunking.windowed(df).filter("doc_id = 4").collect()
    parents = {c.chunk_index for c in swa if c.level == "parent"}
    leaves = [c for c in swa if c.level == "leaf"]
    assert len(leaves) == 600 and len(parents) > 1 and all(c.parent_index in parents and c.content in c.window_content for c in leaves)
    assert {r.strategy for r in chunking.chunk(df, "intelligent").select("strategy").collect()} <= set(chunking.STRATEGIES)
    assert chunking.chunk(df, "no such name").count() == chunking.fixed(df).count()


def test_types(spark):
    cases = [("# Title", "PLAIN_TEXT"), ("<html><body>x</body></html>", "HTML"), ('{"a": 1}', "JSON"), ("a,b\n1,2\n3,4", "CSV"), ("public class A {\n    private void f() {\n        return x;\n    }\n}", "CODE"), ("```\n[a](b) *c*", "PLAIN_TEXT"), ("``` [a](b)", "MARKDOWN"), (None, "PLAIN_TEXT")]
    got = [r[0] for r in texts(spark, *[c for c, _ in cases]).orderBy("doc_id").select(detection.content_type(F.col("text"))).collect()]
    assert got == [k for _, k in cases]
    named = spark.createDataFrame([("x", "text/html", None), ("x", None, "Main.java"), ("x", "text/other", None), ("x", None, "document.md")], "t string, m string, f string")
    assert [r[0] for r in named.select(detection.document_type(F.col("t"), F.col("m"), F.col("f"))).collect()] == ["HTML", "CODE", "PLAIN_TEXT", "MARKDOWN"]


HIT = "query_id int, chunk_id string, parent string, siblings int, score double, content string"


def test_auto_merge(spark):
    merged = retrieval.auto_merge(spark.createDataFrame([(1, f"l{i}", "p1", 4, 0.03, f"t{i}") for i in (1, 2, 3)], HIT)).collect()
    assert [(r.chunk_id, r.score, r.content, r.merged_from) for r in merged] == [("p1", 0.0375, "t1 t2 t3", 3)]
    kept = retrieval.auto_merge(spark.createDataFrame([(1, "l1", "p1", 4, 0.03, "t"), (1, "c1", None, None, 0.02, "o"), (1, "c2", None, None, 0.01, "o")], HIT)).collect()
    assert [r.chunk_id for r in sorted(kept, key=lambda r: r["rank"])] == ["l1", "c1", "c2"]


def test_window_expansion(spark):
    hits = spark.createDataFrame([("leaf", "单个句子。", "前一句。 单个句子。 后一句。"), ("leaf", "x", None), ("parent", "y", "z")], "level string, content string, window_content string")
    got = retrieval.expand_window(hits).select("content", "window_applied", "original_content").collect()
    assert [tuple(r) for r in got] == [("前一句。 单个句子。 后一句。", True, "单个句子。"), ("x", False, None), ("y", False, None)]


def test_fusion_and_rerank(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, chunk_id int, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id int, chunk_id int, rank int")
    fused = retrieval.rrf(a, b)
    assert [(r.chunk_id, r.score) for r in fused.orderBy("rank").collect()] == [(11, round(1 / 62 + 1 / 61, 9)), (10, round(1 / 61, 9)), (12, round(1 / 62, 9))]
    scores = spark.createDataFrame([(1, 12, 9.0)], "query_id int, chunk_id int, new_score double")
    assert [r.chunk_id for r in retrieval.rerank_scores(fused.drop("rank"), scores).orderBy("rank").collect()][0] == 12
    assert [r.chunk_id for r in retrieval.rerank_scores(a.withColumn("score", 1.0 / F.col("rank")).drop("rank"), scores).orderBy("rank").collect()] == [10, 11]


def test_percentiles_and_scores(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 10)] + [("b", 5.0)], "g string, v double")
    got = {r.g: r for r in metrics.percentiles(df, "g", "v", (0.5, 0.95)).collect()}
    assert (got["a"].floor_p50, got["a"].nearest_p50, got["a"].floor_p95, got["a"].nearest_p95) == (2, 2, 10, 10) and got["b"].nearest_p95 == 5
    assert spark.range(1).select(metrics.answer_score(F.lit(0.9), F.lit(0.8), F.lit(0.64), F.lit(0.7))).first()[0] == 0.78


def test_term_rules(spark):
    rules = [language.TermRule("AI", "artificial intelligence", whole_word=True, priority=1), language.TermRule("intelligence", "X")]
    got = [r[0] for r in texts(spark, "AI MAIL 用AI吗 $1").select(language.map_terms(F.col("text"), rules)).collect()]
    assert got == ["artificial X MAIL 用artificial X吗 $1"]


def test_sql_guard(spark):
    spark.range(500).createOrReplaceTempView("numbers")
    assert language.guarded_sql(spark, "select id from numbers", {"numbers"}).count() == 100
    assert language.guarded_sql(spark, "with x as (select id from numbers) select count(*) from x", {"numbers"}).first()[0] == 500
    for bad in ("drop table numbers", "select 1; select 2", "select 1 -- x", "select /* x */ 1"):
        with pytest.raises(language.RejectedSql):
            language.guarded_sql(spark, bad)
    with pytest.raises(language.RejectedSql):
        language.guarded_sql(spark, "select 1 from numbers a, numbers b", {"other"})


def test_memory_loses_nothing(spark):
    r = random.Random(6)
    data = [(c, c * 1000 + i, "user", "w" * r.randrange(1, 900)) for c in range(30) for i in range(r.randrange(1, 20))]
    m = spark.createDataFrame(data, "conv_id long, id long, role string, text string")
    marks = {c: r.choice([None, c * 1000 + r.randrange(5)]) for c in range(30)}
    water = spark.createDataFrame([(c, w) for c, w in marks.items() if w is not None], "conv_id long, watermark long")
    window = memory.latest(m, 3)
    lost = {x.id for x in memory.gap(m, window, water).collect()}
    have = {x.id for x in window.collect()}
    above = {i for c, i, *_ in data if i > (-1 if marks[c] is None else marks[c])}
    assert lost == above - have
    kept = memory.budget_prefix(m, 300).collect()
    assert all(x.cumulative <= 300 for x in kept)
    assert memory.budget_prefix(spark.createDataFrame([(1, 1, "user", "中" * 30_000)], m.schema), 3000).count() == 0


def test_limiter(spark):
    r = random.Random(3)
    data = [(i, r.randrange(4), r.randrange(1000)) for i in range(600)]
    got = {x.event_id: x.allowed for x in stateful.limited(spark.createDataFrame(data, "event_id long, user_id long, ms long"), limit=5, window_ms=100).collect()}
    taken = {}
    for i, k, at in sorted(data, key=lambda x: (x[1], x[2], x[0])):
        live = [x for x in taken.get(k, []) if x > at - 100]
        assert got[i] == (len(live) < 5)
        taken[k] = live + [at] * got[i]


def test_pages_trees_and_children(spark):
    df = spark.range(25).withColumnRenamed("id", "code")
    assert [r.code for r in catalog.page(df, [F.col("code").desc()], 3, 10).collect()] == [4, 3, 2, 1, 0] and tuple(catalog.page_totals(df).first()) == (25, 3)
    nodes = spark.createDataFrame([("a", None, 1), ("b", "a", 1), ("c", "b", 1), ("lost", "gone", 1)], "code string, parent string, sort int")
    assert {(r.code, r.depth, r.path) for r in catalog.tree(nodes).collect()} == {("a", 0, "a"), ("b", 1, "a/b"), ("c", 2, "a/b/c")}


def test_files_round_trip(spark, tmp_path):
    chunks = spark.createDataFrame([("1", "d", "text", 3, 0, {"k": "中\"x"}), ("2", "d", "  ", 0, 1, None)], files.CHUNK)
    files.write_chunks(chunks, str(tmp_path / "chunks"))
    back = spark.read.schema(files.CHUNK).json(str(tmp_path / "chunks"))
    assert back.filter("chunk_id = '1'").first().metadata == {"k": "中\"x"} and back.count() == 2
    (tmp_path / "one.json").write_text('[{"chunk_id": "1", "content": "a"}, {"chunk_id": "2", "content": " "}]')
    assert [(r.chunk_id, r.kb_id) for r in files.read_chunks(spark, str(tmp_path / "one.json"), "kb").collect()] == [("1", "kb")]
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/x.txt").write_bytes(b"ok \xff")
    assert files.read_texts(spark, str(tmp_path / "raw")).first().text == "ok �"
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, content string")
    new = files.upserted(old, spark.createDataFrame([(2, "c" * 70_000)], old.schema), "id")
    assert {(r.id, len(r.content)) for r in new.collect()} == {(1, 1), (2, 60_000)}


def test_streams_are_waited_for_or_raise():
    from unittest.mock import MagicMock

    import pytest

    stream = MagicMock()
    query = stream.writeStream.outputMode().option().trigger().foreachBatch().start()
    query.awaitTermination.return_value = False
    with pytest.raises(TimeoutError):
        streams.run_available(stream, "target", "checkpoint", timeout=5)
    query.stop.assert_called_once()
    streams.run_available(stream, "target", "checkpoint")
    query.awaitTermination.assert_called_with()
