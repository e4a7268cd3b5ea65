"""The registered queries and the pipeline, over the smallest tables and against their SQL."""

import duckdb
import pytest

from ..conftest import SMALL


@pytest.fixture(scope="module")
def entry():
    import __spark_entry__

    return __spark_entry__


def test_all_are_registered(entry):
    names = list(entry.queries())
    for n in range(1, 14):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names


@pytest.mark.parametrize("name", ["op2_topk", "op8_mixing", "op11_warc", "op13_merkle"])
def test_against_sql(spark, entry, name):
    sql = entry.oracle_sql()[name]
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    got = entry.queries()[name](spark, SMALL)
    columns = sorted(got.columns)
    want = con.sql(sql)
    assert sorted(want.columns) == columns
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(want.select(", ".join(columns)).fetchall())


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [f.__name__ for _, f in p.STAGES] == ["keep_good", "keep_distinct", "cut_repeats", "mix_sources", "encode"]
    counts = [docs.count()]
    for i, (_, stage) in enumerate(p.STAGES):
        out = p.written(stage(spark, docs, SMALL), "test-stage")
        if i < len(p.STAGES) - 1:
            assert out.columns == docs.columns
        counts.append(out.count())
        docs = out
    assert counts[0] > counts[1] >= counts[2] == counts[3] and counts[4] == counts[5] > 0
    empty = spark.read.parquet(f"{SMALL}/documents.parquet").filter("false")
    for _, stage in p.STAGES:
        empty = p.written(stage(spark, empty, SMALL), "test-stage")
    assert empty.count() == 0
