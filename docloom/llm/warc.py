"""WARC archives written and read as a table of chunks, so that no task holds a whole payload.

A payload is a row for each ``CHUNK`` bytes, told by its record and the number of the chunk. Writing: the rows of
pages are cut into such chunks, the plan (which records are responses, which ones revisits of which) joins them as
rows that stand before their chunks, and one pass over rows in order streams every record into its own gzip member
while the digest grows with the chunks. Reading streams the archives and gives the chunks back, each with the
digest of its payload up to and with it; the last one's is the payload's.

1. Digests: one narrow row for each different (page_id, url, payload), counted, so repeated rows are one.
2. Of the records with equal payloads the one with the largest page_id (then url) is the response. Groups meet
   their rows in ``SALTS`` parts by hash, as many as a group fills, so a payload that very many pages share is
   spread and never a single task's.
3. Plan rows and chunk rows are dealt by record and put in order; a task writes one archive after the other of
   about ``ARCHIVE_BYTES``. Names are new for each attempt, and the manifest, committed by Spark, lists only files of
   attempts that ended well: a lost executor leaves files that nobody reads.
4. Reading: a task takes whole archives of the manifest and holds a few buffers, whatever the length of a payload.

The archives lie in a folder that pyarrow's file systems can open (file, hdfs, s3, gs), as spark.checkpoint.dir names it.

Defined cases: a null payload is empty; rows without page_id are records like others and stand below every
page_id; rows alike in page_id, url and payload are copies: the first is what the record is, the others revisit it
(responses, for payloads under the least size); rows of one page_id with different payloads are records of their
own; a null url is left out; signs of a url that may not stand in a header are percent-encoded; an empty table
gives no archive and no rows; other columns take no part, whatever their names. A stretch that does not agree
with its digest raises.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, discard, freed, partitions, shared_dir, utf8, written

CHUNK = 64 << 10
ARCHIVE_BYTES = 1 << 30
SALTS = 64
LEVEL = 4
#: Bytes that the reader inflates at a time, and the longest header it takes.
PIECE = 64 << 10
LONGEST_HEADER = 1 << 20
_KEY = ["page_id", "url", "sha1"]
_END = b"\r\n\r\n"
_IN_URL = "!#$%&'()*+,/:;=?@[]~-._"
# Fixed values of the format.
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(digest: bytes) -> str:
    """As upper-case letters and digits; 20 bytes need no padding."""
    return base64.b32encode(digest).decode()


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def payloads(pages: DataFrame, column: str = "html") -> DataFrame:
    """(page_id, url, payload, sha1, size)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), utf8(column).alias("payload"))
    return rows.withColumns({"sha1": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})


def plan(rows: DataFrame, least: int = 0) -> DataFrame:
    """rows: those of ``payloads``. (page_id, url, sha1, size, copies, small, of_page, of_url, revisit): every different record, and the response with the same payload. small: the payload, if under the least size."""
    small = F.max(F.when(F.col("size") < least, F.col("payload"))) if least > 0 else F.max(F.lit(None).cast("binary"))
    counted = rows.groupBy(*_KEY, "size").agg(F.count(F.lit(1)).alias("copies"), small.alias("small"))
    records = written(counted.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")), "records")
    by_salt = records.groupBy("sha1", "size", "salt").agg(F.max(F.struct("page_id", "url")).alias("best"))
    found = by_salt.groupBy("sha1", "size").agg(F.max("best").alias("best"), F.collect_set("salt").alias("salts"))
    joined = records.join(found.withColumn("salt", F.explode("salts")).drop("salts"), ["sha1", "size", "salt"])
    itself = F.col("page_id").eqNullSafe(F.col("best.page_id")) & F.col("url").eqNullSafe(F.col("best.url"))
    out = joined.select(*_KEY, "size", "copies", "small", F.col("best.page_id").alias("of_page"), F.col("best.url").alias("of_url"), (~itself & (F.col("size") >= least)).alias("revisit"))
    out.written_to = records.written_to
    return out


def chunks(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(page_id, url, sha1, chunk, data): at least one chunk a payload."""
    last = F.greatest(F.ceil(F.col("size") / chunk), F.lit(1)) - 1
    numbered = rows.select(*_KEY, "payload", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("chunk"))
    return numbered.select(*_KEY, "chunk", F.substring("payload", (F.col("chunk") * chunk + 1).cast("int"), F.lit(chunk)).alias("data"))


def record_id(page_id: int | None, url: str | None, digest: str, copy: int) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}:{digest}:{zlib.crc32((url or '').encode()):08x}{'' if url is None else 'u'}:{copy}>"


def _page_of(record: str) -> int | None:
    page = record.split(":")[2]
    return None if page == "null" else int(page)


def head(kind: str, record: str, date: str, length: int, fields: dict[str, str | None]) -> bytes:
    lines = {"WARC-Type": kind, "WARC-Record-ID": record, "WARC-Date": date, **fields, "Content-Length": str(length)}
    return "\r\n".join([VERSION, *[f"{k}: {v}" for k, v in lines.items() if v is not None]]).encode() + _END


class Archive:
    """One archive file: each record is a gzip member, given piece by piece."""

    def __init__(self, folder: str, name: str, date: str):
        self.system, place = opened(folder)
        self.name, self.date, self.bytes, self.records = name, date, 0, 0
        self.system.create_dir(place, recursive=True)
        self.out = self.system.open_output_stream(f"{place}/{name}", compression=None)
        about = b"format: WARC File Format 1.1\r\n"
        self.begin(head("warcinfo", f"<urn:archive:{name}>", date, len(about), {"Content-Type": "application/warc-fields"}) + about)
        self.end()

    def begin(self, start: bytes) -> None:
        self.packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        self.add(start)

    def add(self, piece: bytes) -> None:
        self._put(self.packer.compress(piece))

    def end(self) -> None:
        self._put(self.packer.compress(_END) + self.packer.flush())
        self.records += 1

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def start(self, row: dict, copy: int, revisit: bool) -> None:
        """The headers of a record: of a response, whose payload follows, or of a revisit."""
        digest = base32(bytes.fromhex(row["sha1"]))
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['size']}\r\n\r\n".encode()
        uri = None if row["url"] is None else quote(row["url"], safe=_IN_URL)
        fields = {"WARC-Target-URI": uri, "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response"}
        if revisit:
            fields |= {"WARC-Profile": SAME_PAYLOAD, "WARC-Refers-To": record_id(row["of_page"], row["of_url"], digest, 0)}
        kind, body = ("revisit", len(http)) if revisit else ("response", len(http) + row["size"])
        self.begin(head(kind, record_id(row["page_id"], row["url"], digest, copy), self.date, body, fields) + http)

    def whole(self, row: dict, copy: int, revisit: bool, payload: bytes = b"") -> None:
        self.start(row, copy, revisit)
        self.add(payload)
        self.end()

    def close(self) -> dict:
        self.out.close()
        return {"file": self.name, "records": self.records, "bytes": self.bytes}


_MANIFEST = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


def _write(batches: Batches, folder: str, date: str, chunk: int, archive_bytes: int) -> Batches:
    """Rows in order: a record's plan (chunk -1), then its chunks."""
    from pyspark import TaskContext

    task = TaskContext.get()
    archive: Archive | None = None
    number, row, due, left, sha = 0, {}, 0, 0, hashlib.sha1()
    for batch in batches:
        names = batch.schema.names
        for values in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            now = dict(zip(names, values, strict=True))
            if now["chunk"] < 0:
                if archive and archive.bytes >= archive_bytes:
                    yield pa.RecordBatch.from_pylist([archive.close()], schema=_MANIFEST)
                    archive = None
                if archive is None:
                    archive, number = Archive(folder, f"archive-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.gz", date), number + 1
                row, due, left, sha = now, 0, 0, hashlib.sha1()
                if row["small"] is not None:
                    for copy in range(row["copies"]):
                        archive.whole(row, copy, False, row["small"])
                    continue
                for copy in range(0 if row["revisit"] else 1, row["copies"]):
                    archive.whole(row, copy, True)
                if not row["revisit"]:
                    archive.start(row, 0, False)
                    left = max(1, -(-row["size"] // chunk))
            elif left and now["chunk"] == due:  # repeated rows bring a chunk again
                sha.update(now["data"])
                archive.add(now["data"])
                due, left = due + 1, left - 1
                if not left:
                    if sha.hexdigest() != row["sha1"]:
                        raise ValueError(f"page {row['page_id']}: digest of the chunks")
                    archive.end()
    if archive:
        yield pa.RecordBatch.from_pylist([archive.close()], schema=_MANIFEST)


def write(pages: DataFrame, folder: str, column: str = "html", least: int = 0, date: str = "1970-01-01T00:00:00Z", chunk: int = CHUNK, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the pages' archives to folder; returns their manifest (file, records, bytes), which is kept in folder/manifest."""
    spark = pages.sparkSession
    rows = payloads(pages, column)
    records = plan(rows, least)
    pieces = chunks(rows.filter(F.col("size") >= least), chunk)
    both = records.withColumn("chunk", F.lit(-1).cast("long")).unionByName(pieces, allowMissingColumns=True)
    ordered = both.repartition(partitions(spark), *_KEY).sortWithinPartitions(*_KEY, "chunk")
    manifest = ordered.mapInArrow(freed(lambda batches: _write(batches, folder, date, chunk, archive_bytes)), "file string, records long, bytes long")
    manifest.write.parquet(f"{folder}/manifest")
    discard(records)
    return spark.read.parquet(f"{folder}/manifest")


class Inflated:
    """The text of an archive as a stream: gzip members or plain bytes, a piece at a time."""

    def __init__(self, stream: pa.NativeFile, packed: bool = True):
        self.stream, self.packed = stream, packed
        self.raw, self.held, self.unpacker = b"", b"", zlib.decompressobj(31)

    def more(self) -> bool:
        """Takes in another piece; False at the end."""
        while True:
            if not self.raw:
                self.raw = self.stream.read(PIECE)
                if not self.raw:
                    return False
            if not self.packed:
                self.held, self.raw = self.held + self.raw, b""
                return True
            piece = self.unpacker.decompress(self.raw, PIECE)
            self.raw = self.unpacker.unconsumed_tail
            if self.unpacker.eof:
                self.raw, self.unpacker = self.unpacker.unused_data, zlib.decompressobj(31)
            if piece:
                self.held += piece
                return True

    def until(self, mark: bytes) -> bytes | None:
        """What stands before the mark, which is passed over; None if nothing is left."""
        searched = 0
        while (at := self.held.find(mark, max(0, searched - len(mark)))) < 0:
            searched = len(self.held)
            if searched > LONGEST_HEADER:
                raise ValueError("a header without end")
            if not self.more():
                if self.held:
                    raise ValueError("an archive that ends in a header")
                return None
        out, self.held = self.held[:at], self.held[at + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.more():
                raise ValueError("an archive that ends in a record")
        out, self.held = self.held[:n], self.held[n:]
        return out


def _fields(lines: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines.decode("utf-8", "replace").split("\r\n")[1:])}


_CHUNKS = "file string, record_id string, record_type string, uri string, page_id long, refers_to long, http string, size long, chunk long, at long, n long, sha1 string, last boolean"


def record_chunks(source: Inflated, chunk: int) -> Iterator[tuple]:
    """The rows of an archive, in order, without its name, each with its data."""
    while (lines := source.until(_END)) is not None:
        fields = _fields(lines)
        length, kind, record = int(fields["content-length"]), fields["warc-type"], fields["warc-record-id"]
        http, size = None, length
        if fields.get("content-type", "").startswith("application/http"):
            raw = source.until(_END) or b""
            http, length = raw.decode("utf-8", "replace"), length - len(raw) - len(_END)
            size = int(_fields(raw).get("content-length", length)) if kind == "revisit" else length
        page = _page_of(record) if record.startswith("<urn:page:") else None
        refers = fields.get("warc-refers-to")
        told = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
        sha, at, number = hashlib.sha1(), 0, 0
        while True:
            data = source.take(min(chunk, length - at))
            sha.update(data)
            last = at + len(data) == length
            so_far = told if kind == "revisit" else base32(sha.digest())
            if last and kind == "response" and told and so_far != told:
                raise ValueError(f"{record}: digest of the payload")
            yield record, kind, fields.get("warc-target-uri"), page, _page_of(refers) if refers else None, http, size, number, at, len(data), so_far, last, data
            at, number = at + len(data), number + 1
            if last:
                break
        if source.take(len(_END)) != _END:
            raise ValueError(f"{record}: no end of the record")


def read(manifest: DataFrame, folder: str, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunk table of the archives that the manifest lists: file, record_id, record_type, uri, page_id, refers_to, http, size (of the whole payload, a revisit's as its response has it), chunk, at, n (bytes), sha1 (of the payload up to and with the chunk), last, and data unless not asked for. Records of other types come as they are."""
    schema = _CHUNKS + ", data binary" * with_data
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    types = [kinds[f.split()[1]] for f in schema.split(", ")]

    def run(batches: Batches) -> Batches:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for name in batch.column("file").to_pylist():
                system, place = opened(folder)
                held, size = [], 0
                with system.open_input_stream(f"{place}/{name}", compression=None) as stream:
                    for row in record_chunks(Inflated(stream, name.endswith(".gz")), chunk):
                        held.append((name, *row[: len(names) - 1]))
                        size += row[9] * with_data + 400
                        if size >= 4 << 20:
                            yield batch_of(held)
                            held, size = [], 0
                if held:
                    yield batch_of(held)

    files = manifest.select("file").repartitionByRange(partitions(manifest.sparkSession), "file")
    return files.mapInArrow(freed(run), schema)


def round_trip(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Writes the pages' archives and reads them back: page_id, payload_bytes, payload_digest, record_type and refers_to (a response's page_id) of every record."""
    spark: SparkSession = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/docloom/archives-{uuid.uuid4().hex}"
    manifest = write(pages, folder, **options)
    ends = read(manifest, folder, with_data=False).filter(F.col("last") & F.col("record_type").isin("response", "revisit"))
    return ends.select("page_id", F.col("size").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), "record_type", "refers_to")


#: The bytes of the digest as eight five-bit digits a time, from SQL's hex.
ORACLE = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS s FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (instr('0123456789abcdef', substr(s, i, 1)) - 1) + 1, 4)), '') AS bits FROM d),
f AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(0, 5), lambda j: CAST(substr(bits, 5 * i + j + 1, 1) AS INTEGER) << (4 - j))) AS BIGINT), 1)), '') AS digest FROM b),
r AS (SELECT *, max(page_id) OVER (PARTITION BY s, n) AS best FROM f)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to FROM r"""
