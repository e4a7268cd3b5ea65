"""The SQL guard against statements that write or reach past it, chunkers by their rules, and percentiles by brute force."""

import math
import random

import pytest
from docloom.functions import text as X
from docloom.operators import chunking, language, metrics
from pyspark.sql import functions as F


@pytest.fixture
def guarded(spark, tmp_path):
    spark.sql(f"create table if not exists guard_target (a int) using parquet location '{tmp_path}/t'")
    spark.range(5).createOrReplaceTempView("nums")
    spark.sql("create or replace temporary view hidden_view as select a from guard_target")
    yield spark
    spark.sql("drop table guard_target")


@pytest.mark.parametrize(
    "statement",
    [
        "with x as (select 1 as a) insert into guard_target select a from x",
        "select count(*) from guard_target where exists (with guard_target as (select 1 as a) select a from guard_target)",
        "with guard_target as (select a from guard_target) select * from guard_target",
        "select * from nums, guard_target",
        "select * from spark_catalog.default.guard_target",
        "select (select max(a) from guard_target) as m",
        "select transform(id) using 'cat' as (x string) from nums",
        "select reflect('java.lang.System', 'currentTimeMillis')",
        "select * from identifier('guard_target')",
        "select * from identifier('guard' || '_target')",
        "select * from nums where id in (select a from identifier('guard' || '_target'))",
        "select `reflect`('java.lang.System', 'getProperty', 'user.home') from nums",
        "select identifier('reflect')('java.lang.System', 'getProperty', 'user.home') from nums",
        "select identifier('re' || 'flect')('java.lang.System', 'getProperty', 'user.home') from nums",
        "select `try_reflect`('java.lang.System', 'getProperty', 'user.home') from nums",
        "select case when id > 0 then `java_method`('java.lang.System', 'exit', 1) end as x from nums",
        "select system.builtin.reflect('java.lang.System', 'getProperty', 'user.home') from nums",
        "select transform(array(1), x -> `reflect`('java.lang.System', 'getProperty', 'user.home')) as a from nums",
        "select id from nums order by `reflect`('java.lang.System', 'getProperty', 'user.home')",
        "select id from nums lateral view `reflect`('java.lang.System') as b",
        "select * from parquet.`/etc`",
        "select * from range(3)",
        "select input_file_name() as f from nums",
        "select * from hidden_view",
        "select 1; drop table guard_target",
        "drop table guard_target",
    ],
)
def test_refused_statements_run_nothing(guarded, statement):
    with pytest.raises(language.RejectedSql):
        language.guarded_sql(guarded, statement, {"nums"})
    assert guarded.table("guard_target").count() == 0


def test_writes_are_refused_without_a_list_of_tables(guarded):
    with pytest.raises(language.RejectedSql):
        language.guarded_sql(guarded, "with x as (select 1 as a) insert into guard_target select a from x")
    assert guarded.table("guard_target").count() == 0


def test_what_a_view_hides_is_the_view_alone(guarded):
    assert language.guarded_sql(guarded, "select count(*) as n from hidden_view", {"hidden_view"}).first()["n"] == 0
    df = guarded.sql("select * from nums join guard_target on a = id where id in (select a from hidden_view)")
    assert language.relations_resolved(df) == {"nums", "guard_target", "hidden_view"}


@pytest.mark.parametrize(
    "statement",
    [
        "select case when id is not null and id between 1 and 3 or not id in (1, 2) then cast(id as string) || 'x' else trim(upper('a')) end as t, sum(id) over (partition by id % 2 order by id rows between 1 preceding and current row) as s from nums order by id desc nulls last limit 3 offset 1",
        "select count(distinct id) as n, count(*) filter (where id > 1) as m, max(date '2020-01-01' + interval 1 day) as d from nums having count(*) > 1",
        "select e, substring('abc' from 2 for 1) as b, extract(year from timestamp '2020-01-02 00:00:00') as y from nums lateral view explode(sequence(1, id)) as e",
        "select id, a from nums join (values (1), (2)) v(a) on id = a union all select id, 0 from nums where exists (select 1 from nums n where n.id > nums.id)",
        "select sum(id) over w as s, transform(array(id), x -> x + 1)[0] as t from nums window w as (order by id)",
    ],
)
def test_what_the_lists_hold_passes(guarded, statement):
    assert language.guarded_sql(guarded, statement, {"nums"}).count() > 0


@pytest.mark.parametrize(
    "statement",
    [
        "select sum(id) as s from nums",
        "with a as (select id from nums), b as (select id from a) select count(*) as n from b, a",
        "select id from nums where id in (with inner_ as (select 1 as id) select id from inner_)",
        "with recursive r(n) as (select 1 union all select n + 1 from r where n < 4) select n from r",
    ],
)
def test_queries_pass(guarded, statement):
    assert language.guarded_sql(guarded, statement, {"nums"}).count() > 0


def signs(n):
    return "".join(chr(0x4E00 + i * 7919 % 20_000) for i in range(n))


def prose(r, n):
    words = ["data", "中文", "stream", "查询", "然而 ", "x"]
    return "".join(r.choice(words) + r.choice([" ", "", "，", "。", ". ", "! "]) for _ in range(n))


def test_semantic_chunks_keep_every_sentence(spark):
    r = random.Random(3)
    texts = [prose(r, n) for n in (0, 1, 5, 60, 900, 4000)] + ["".join(f"{i:05d}" for i in range(5_000)), signs(20_000)[:12_000] + "，" + signs(20_000)[12_000:]]
    df = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string")
    for most, overlap, least in ((128, 25, 51), (512, 200, 30), (40, 0, 0)):
        got = {}
        for c in chunking.semantic(df, most=most, overlap=overlap, least=least).orderBy("doc_id", "chunk_index").collect():
            got.setdefault(c.doc_id, []).append(c.content)
            assert c.sentence_count == 1 or chunking.weight(c.content) <= 1.5 * most + c.sentence_count
        assert 99 not in got and 0 not in got
        for i, text in enumerate(texts):
            at = 0
            for c in got.get(i, []):  # in order, and with no gap but blanks
                found = text.find(c, 0 if overlap else at)
                assert found >= 0 and text[at:found].strip() == ""
                at = max(at, found + len(c))
            assert text[at:].strip() == ""


def test_sentences_end_after_connectors(spark):
    df = spark.createDataFrame([(0, "这是一个很长的句子然而 后面的句子也很长很长。")], "doc_id long, text string")
    [one] = chunking.semantic(df, most=1, overlap=0, least=0).filter("chunk_index = 0").collect()
    assert one.content == "这是一个很长的句子然而"


def test_intelligent_uses_the_options_of_the_type(spark):
    assert chunking.options_of("CODE") == ("fixed", {"size": 300, "overlap": 60})
    assert chunking.options_of("PLAIN_TEXT") == ("semantic", {"most": 128, "least": 51, "overlap": 25})
    assert chunking.options_of("HTML") == ("structural", {"least": 200, "most": 2000})
    csv = "a,b\n" + "1,2\n" * 400
    plain = "Some plain words here. " * 90
    df = spark.createDataFrame([(0, csv), (1, plain), (2, None), (3, "")], "doc_id long, text string")
    got = chunking.intelligent(df).orderBy("doc_id", "chunk_index").collect()
    want = [(r.doc_id, "fixed", r.chunk_index, r.content) for r in chunking.fixed(df.filter("doc_id = 0"), 400, 80).collect()]
    want += [(r.doc_id, "semantic", r.chunk_index, r.content) for r in chunking.semantic(df.filter("doc_id = 1"), most=128, least=51, overlap=25).collect()]
    assert [tuple(r) for r in got] == sorted(want)


def test_percentiles_of_ties_and_hot_groups(spark):
    r = random.Random(6)
    data = [("hot", float(r.choice([1, 1, 1, 2, r.random()]))) for _ in range(20_000)] + [("one", 3.0), ("two", 1.0), ("two", 2.0), (None, 5.0), ("none", None)]
    got = {x.g: x.asDict() for x in metrics.percentiles(spark.createDataFrame(data, "g string, v double"), "g", "v", (0.0001, 0.5, 0.95, 0.99)).collect()}
    assert "none" not in got
    for g in ("hot", "one", "two", None):
        v = sorted(x for k, x in data if k == g and x is not None)
        assert got[g]["n"] == len(v)
        for p in (0.0001, 0.5, 0.95, 0.99):
            tag = f"p{round(100 * p)}"
            assert got[g][f"floor_{tag}"] == v[int(len(v) * p)] and got[g][f"nearest_{tag}"] == v[max(0, math.ceil(len(v) * p) - 1)]


def test_cut_to_tokens(spark):
    df = spark.createDataFrame([("ab中c文d",), ("abc",), ("中文",), ("",), (None,)], "s string")
    assert [x[0] for x in df.select(X.cut_to_tokens(F.col("s"), 1)).collect()] == ["ab中", "abc", "中", "", None]
    assert [x[0] for x in df.select(X.cut_to_tokens(F.col("s"), 2)).collect()] == ["ab中c文", "abc", "中文", "", None]
    assert [x[0] for x in df.select(X.cut_to_tokens(F.col("s"), 0)).collect()] == ["", "", "", "", ""]
