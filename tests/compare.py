"""Runs registered queries against their SQL in DuckDB: python -m tests.compare [folder] [name...]"""

from __future__ import annotations

import datetime
import math
import sys
import time

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, datetime.datetime) and v.tzinfo:
        return v.replace(tzinfo=None)
    return v


def kind(t) -> str:
    t = str(t).lower()
    for a, b in (("large_string", "string"), ("timestamp", "timestamp"), ("int32", "int"), ("int64", "int"), ("decimal", "decimal")):
        if t.startswith(a):
            return b
    return t


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def differences(spark, con, folder: str, run, sql: str) -> list[str]:
    df = run(spark, folder)
    names = sorted(df.columns)
    got_table = df.select(*names).toArrow()
    want_table = con.execute(f"select {', '.join(names)} from ({sql})").to_arrow_table()
    have = con.execute(f"describe {sql}").fetchall()
    out = []
    if sorted(r[0] for r in have) != names:
        out.append(f"columns {names} and {sorted(r[0] for r in have)}")
    kinds = [(f.name, kind(f.type), kind(g.type)) for f, g in zip(got_table.schema, want_table.schema, strict=True) if kind(f.type) != kind(g.type)]
    if kinds:
        out.append(f"types {kinds}")
    rows = [sorted((tuple(plain(v) for v in r.values()) for r in x.to_pylist()), key=repr) for x in (got_table, want_table)]
    if rows[0] != rows[1]:
        only = [[r for r in a if r not in set(b)][:2] for a, b in (rows, rows[::-1])]
        out.append(f"{len(rows[0])} and {len(rows[1])} rows; only Spark {only[0]}, only SQL {only[1]}")
    return out


def main() -> int:
    from docloom.session import session
    import __spark_entry__ as entry

    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.001"
    spark = session("compare", master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(folder), 0
    sqls = entry.oracle_sql()
    for name, run in entry.queries().items():
        if args and name not in args or not args and (name.startswith("op") and "_" in name[:5] or name == "pipeline"):
            continue
        began = time.time()
        try:
            found = differences(spark, con, folder, run, sqls[name]) if name in sqls else [] if run(spark, folder).count() >= 0 else ["none"]
        except Exception as e:  # noqa: BLE001
            found = [f"{type(e).__name__}: {str(e)[:600]}"]
        bad += bool(found)
        print(f"{'BAD ' if found else 'ok  '} {name} {time.time() - began:.1f}s", *found, flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
