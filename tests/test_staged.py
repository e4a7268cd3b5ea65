"""Staged batches: a run killed anywhere, and batches sent again, give the rows of one clean run."""

import pytest
from docloom.sources.tables import new_dir
from docloom.streaming import staged
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, deleted boolean"


def documents(spark, more=()):
    rows = [(i, f"Text {i}. " * (i + 1), i == 5) for i in range(12)] + [(20, None, False), (21, " \n ", False), (22, "bad words", None)]
    return spark.createDataFrame(rows + list(more), DOCS)


def stages(spark, docs):
    return staged.ingestion(docs, refused=F.when(F.contains("content", F.lit("bad")), "refused by the store"))


def deliver(spark, pipeline, folder, ids, first):
    part = spark.createDataFrame([(first + n, i) for n, i in enumerate(ids)], "event_id long, doc_id long")
    part.coalesce(1).write.mode("append").parquet(f"{folder}/uploads")
    go_on(spark, pipeline, folder)


def go_on(spark, pipeline, folder):
    staged.run(spark.readStream.schema("event_id long, doc_id long").parquet(f"{folder}/uploads"), pipeline, f"{folder}/checkpoint")


PARTS = [[0, 1, 2, 5, 20], [3, 99, 22, 22, 21], [2, 4, 11]]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def results(p):
    index = p.current("index").select("chunk_id", "doc_id", "chunk_index", "content", "error")
    return rows(p.status()), rows(index), rows(p.failed()), rows(p.ledger().orderBy("batch", "stage"))


@pytest.fixture(scope="module")
def clean(spark):
    folder = new_dir(spark, "clean")
    p = staged.Staged(spark, folder, stages(spark, documents(spark)))
    for n, part in enumerate(PARTS):
        deliver(spark, p, folder, part, 100 * n)
    return results(p)


def test_clean_run(clean):
    status, index, failed, ledger = clean
    state = {r[0]: r[2:4] for r in status}
    assert set(state) == {0, 1, 2, 3, 4, 11, 20, 21, 22}  # 5 is deleted, 99 is not there
    assert state[0] == ("COMPLETED", "index") and state[20] == state[21] == ("FAILED", "parse") and state[22] == ("FAILED", "index")
    assert {(r[0], r[2], r[3]) for r in failed} == {(20, "parse", "blank"), (21, "parse", "blank"), (22, "index", "refused by the store")}
    assert len({r[0] for r in index}) == len(index) and len(ledger) == 9
    assert {r[1] for r in status if r[0] == 2} == {2 * staged._STEP}


@pytest.mark.parametrize("where,when", [("chunk", "before"), ("index", "before"), ("parse", "after"), ("chunk", "after")])
def test_killed_between_stages(spark, clean, where, when):
    folder, calls = new_dir(spark, "killed"), []

    def broken(stage):
        def run(df):
            calls.append(stage.name)
            out = stage.run(df)
            if stage.name == where and calls.count(where) == 2:
                if when == "after":  # a part of the rows is left behind, and nothing tells of it
                    out.limit(1).write.mode("overwrite").parquet(f"{folder}/{where}/batch={staged._STEP}")
                raise RuntimeError("killed")
            return out

        return staged.Stage(stage.name, run)

    p = staged.Staged(spark, folder, tuple(broken(s) for s in stages(spark, documents(spark))))
    deliver(spark, p, folder, PARTS[0], 0)
    with pytest.raises(Exception, match="killed"):
        deliver(spark, p, folder, PARTS[1], 100)
    assert {r.batch for r in p.table("parse").select("batch").distinct().collect()} <= {0, staged._STEP}
    go_on(spark, p, folder)
    deliver(spark, p, folder, PARTS[2], 200)
    assert results(p) == clean
    names = [s.name for s in p.stages]
    again = {n: calls.count(n) for n in names}
    assert again == {n: 3 + (n == where) for n in names}  # what was whole was not done twice


def test_delivered_twice(spark, clean):
    folder = new_dir(spark, "twice")
    p = staged.Staged(spark, folder, stages(spark, documents(spark)))
    for n, part in enumerate(PARTS):
        batch = spark.createDataFrame([(100 * n + k, i) for k, i in enumerate(part)], "event_id long, doc_id long")
        for _ in range(2):
            p.deliver(batch, n)
    p.deliver(spark.createDataFrame([], "event_id long, doc_id long"), 0)
    assert results(p) == clean


def test_replay_and_sent_again(spark):
    folder, refuse = new_dir(spark, "replay"), ["Text"]
    docs = documents(spark)
    make = lambda: staged.Staged(spark, folder, staged.ingestion(docs, refused=F.when(F.contains("content", F.lit(refuse[0])), "no")))
    p = make()
    p.deliver(spark.createDataFrame([(1, 1), (2, 2), (3, 20)], "event_id long, doc_id long"), 0)
    assert {r.status for r in p.status().collect()} == {"FAILED"} and p.current("index").filter("error is null").count() == 0
    refuse[0] = "nothing at all"
    p = make()
    number = p.next_number()
    for _ in range(2):
        p.replay(docs.filter("doc_id <> 2"), number, "chunk")
    assert {r.doc_id: r.status for r in p.status().collect()} == {1: "COMPLETED", 2: "FAILED", 20: "FAILED"}
    assert [r.doc_id for r in p.current("index").filter("error is null").collect()] == [1]
    assert p.next_number() == number + 1
    # A changed document that is sent again takes the place of its rows; one that is blank now has none.
    new = spark.createDataFrame([(1, "Other", False), (2, "", False)], DOCS)
    q = staged.Staged(spark, folder, staged.ingestion(new))
    q.deliver(spark.createDataFrame([(9, 1), (10, 2)], "event_id long, doc_id long"), 1)
    assert [(r.doc_id, r.content) for r in q.current("index").filter("error is null").collect()] == [(1, "Other")]
