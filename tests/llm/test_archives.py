"""WARC archives and the Merkle manifest: whole round trips, odd tables, and the definitions in plain Python."""

import base64
import gzip
import hashlib
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docloom.llm import merkle, warc

from . import support

PAGES = "page_id long, url string, html string, chunk long, copy int, sha1 string, size long, n string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 5, 3, "x", 8, "y") for i, u, h in rows], PAGES)


def odd_pages():
    long = "<p>längere Seite 😀</p>" * 3_000
    rows = [(1, "http://a/b c\r\nX: y", "one"), (2, None, "one"), (3, "http://c", None), (4, "http://d", ""), (5, "u", long), (9, "u", long), (7, "u", "WARC/1.1\r\n\r\n"), (None, "u", "nobody"), (None, None, "nobody"), (None, None, None)]
    return rows + [(5, "u", long), (8, "u", "eight"), (8, "v", "eight"), (8, "v", "other"), (6, "u", "six"), (6, "u", "six"), (6, "u", "six")]


def expected(rows, least=0):
    """(page_id, bytes, digest, type, refers_to) of every row, by definition."""
    out, seen = [], set()
    raw = lambda h: (h or "").encode()
    below = lambda i, u: (i is not None, i or 0, u is not None, u or "")
    for i, u, h in rows:
        best = max(((j, v) for j, v, k in rows if raw(k) == raw(h)), key=lambda x: below(*x))
        first = (i, u, h) not in seen and (i, u) == best
        seen.add((i, u, h))
        same = len(raw(h)) >= least and not first
        out.append((i, len(raw(h)), base64.b32encode(hashlib.sha1(raw(h)).digest()).decode(), "revisit" if same else "response", best[0] if same else None))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


@pytest.mark.parametrize("least,chunk,archive_bytes", [(0, 1_000, 1 << 30), (4, 7, 2_000), (10**6, 64 << 10, 1)])
def test_warc_round_trip_of_odd_pages(spark, tmp_path, least, chunk, archive_bytes):
    rows = odd_pages()
    got = warc.round_trip(pages(spark, rows), str(tmp_path / "w"), least=least, chunk=chunk, archive_bytes=archive_bytes)
    assert result(got) == expected(rows, least)


def test_warc_files_and_chunks(spark, tmp_path):
    rows, folder = odd_pages(), str(tmp_path / "w")
    manifest = warc.write(pages(spark, rows), folder, chunk=1_000)
    table = warc.read(manifest, folder, chunk=777)
    by_record = {}
    for r in sorted(table.collect(), key=lambda r: (r.file, r.record_id, r.chunk)):
        assert len(r.data) == r.n <= 777
        before = by_record.setdefault(r.record_id, b"")
        assert r.at == len(before) == 777 * r.chunk
        by_record[r.record_id] = before + r.data
        if r.record_type == "response":
            assert r.sha1 == base64.b32encode(hashlib.sha1(before + r.data).digest()).decode()
            assert r.last == (len(before + r.data) == r.size)
    payloads = {x for x in by_record.values()}
    assert {(h or "").encode() for _, _, h in rows} <= payloads
    # Each record is a gzip member, and the plain text of the archives is read like the packed one.
    (tmp_path / "w" / "plain").mkdir()
    for f in Path(folder).glob("*.gz"):
        data = f.read_bytes()
        assert data.count(b"\x1f\x8b\x08") >= manifest.filter(F.col("file") == f.name).first()["records"]
        (tmp_path / "w" / "plain" / f.stem).write_bytes(gzip.decompress(data))
    plain = warc.read(manifest.withColumn("file", F.expr("concat('plain/', replace(file, '.gz', ''))")), folder, with_data=False)
    assert result(plain.filter("last and record_type <> 'warcinfo'").select("page_id", F.col("size").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), "record_type", "refers_to")) == expected(rows)


def test_warc_damage_raises(spark, tmp_path):
    folder = str(tmp_path / "w")
    manifest = warc.write(pages(spark, [(1, "u", "payload " * 50)]), folder)
    file = next(Path(folder).glob("*.gz"))
    plain = gzip.decompress(file.read_bytes())
    file.write_bytes(gzip.compress(plain.replace(b"payload payload", b"payload Payload")))
    with pytest.raises(Exception, match="digest of the payload"):
        warc.read(manifest, folder).collect()
    file.write_bytes(gzip.compress(plain[:-20]))
    with pytest.raises(Exception, match="ends in a record"):
        warc.read(manifest, folder).collect()


def test_warc_of_nothing_and_one_payload_for_all(spark, tmp_path):
    assert warc.round_trip(pages(spark, []), str(tmp_path / "none")).count() == 0
    rows = [(i, f"http://x/{i}", "same for all") for i in range(500)]
    assert result(warc.round_trip(pages(spark, rows), str(tmp_path / "hot"))) == expected(rows)


def plain_manifest(rows, fan=8):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows of (doc_id, source, lang, n_chars, text)."""
    H = lambda s: hashlib.sha256(s.encode()).hexdigest()
    leaf = lambda r: H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))
    low = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)

    def tree(h):
        levels = [h]
        while len(levels[-1]) > 1:
            levels.append([H("".join(levels[-1][i : i + fan])) for i in range(0, len(levels[-1]), fan)])
        return levels

    def path(levels, i):
        out = []
        for level in levels[:-1]:
            run = level[i // fan * fan : i // fan * fan + fan]
            out.append(("".join(run[: i % fan]), "".join(run[i % fan + 1 :])))
            i //= fan
        return out

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    by = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    trees = {x: tree([leaf(r) for r in by[x]]) for x in langs}
    top = tree([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for i, r in enumerate(by[x]):
            siblings = path(trees[x], i) + path(top, k)
            altered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            h = leaf((*r[:4], low(r[4]))) if altered else leaf(r)
            for a, b in siblings:
                h = H(a + h + b)
            out.append((r[0], leaf(r), trees[x][-1][0], top[-1][0], H("".join(a + b for a, b in siblings)), h, h == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("fan", [2, 3, 8])
def test_merkle_by_definition(spark, fan):
    rows = support.odd_rows() + support.rows([f"Text {i}" if i % 5 else f"text {i}" for i in range(90)], start=100)
    rows = [(*r[:2], [None, "", "de", "ZZ", "en", "é", "en", "en"][i % 8] if i > 40 else r[2], *r[3:]) for i, r in enumerate(rows)]
    rows += [(500, "alone", "xx", "s", 5, *rows[0][5:])]
    got = merkle.manifest(support.table(spark, rows).withColumn("pos", F.lit("clash")).withColumn("hash", F.lit(1)).withColumn("group", F.lit(2)), fan)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = plain_manifest([(r[0], r[3], r[2], r[4], r[1]) for r in rows], fan)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert {True, False} == {w[-1] for w in want}


def test_merkle_of_nothing_one_row_and_one_language(spark):
    assert merkle.manifest(support.none(spark)).count() == 0
    for rows in (support.rows(["Only"]), support.rows([f"t{i}" for i in range(20)]), [(i, "x", f"l{i}", "s", 1, "k", 7, "p", 5, 3, "c", "h") for i in range(20)], support.rows(["same"] * 9, start=0)[:1] * 9):
        got = merkle.manifest(support.table(spark, rows))
        assert sorted((tuple(r) for r in got.collect()), key=str) == plain_manifest([(r[0], r[3], r[2], r[4], r[1]) for r in rows])
