"""Merkle manifest of a table of documents: levels built bottom-up and kept, proofs pushed top-down.

Each row is a leaf, the SHA-256 of its columns. The leaves of a language stand in ascending order of doc_id; every
``fan`` neighbours become one node until one is left, the language's subroot, and the subroots become the root
in the same way. Digests are lowercase hex and are joined as text.

1. Places without a sort in one task: rows are dealt by ranges of (language, doc_id), numbered inside their
   range, and moved by the counts of the ranges before, of which there are as many as partitions.
2. Each level is a grouping by (language, place // fan), at most ``fan`` rows a group, written before the next.
   Of the leaf level the rows keep doc_id and the digest to be checked, so a leaf meets its proof without a join.
3. From the root down each level joins its parents: a child puts its own siblings, those left of it and those
   right of it, before the proof that its parent holds. What travels is one proof for ``fan`` leaves.

Defined cases: a null column is "-" in the leaf; a null language is a tree of its own and stands first; null
doc_ids stand before all others of their language; rows of one doc_id stand in the order of their leaves, equal
ones next to each other; a row alone in its language is the subroot, a subroot alone the root; a proof without
siblings is the digest of nothing; an empty table gives no rows; other columns take no part, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, partitions, written

FAN = 8
#: The columns of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NO_PATH = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(columns: dict[str, Column]) -> Column:
    """The digest of a row: each value as its count of UTF-8 bytes, a colon and itself."""
    parts = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in (columns[name].cast("string") for name in FIELDS)]
    return digest(F.concat(*parts))


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def tampered(doc_id: Column) -> Column:
    """Whether a document is one of those that are altered for the check: 3 divides the CRC-32 of its id; never a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """(group, doc_id, hash, checked): checked is the leaf of the altered document, null where it is not altered or the same."""
    columns = {name: F.col(name) for name in FIELDS}
    other = lowered(F.col("text"))
    altered = tampered(F.col("doc_id")) & (other != F.col("text"))
    # "-" stands before "=", so a null language is first and the others follow by their bytes.
    group = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-"))
    return docs.select(group.alias("group"), "doc_id", leaf(columns).alias("hash"), F.when(altered, leaf(columns | {"text": other})).alias("checked"))


def numbered(rows: DataFrame, by: list[str]) -> DataFrame:
    """Adds pos, the place within the group by the given columns from 0 without gaps, and cnt, the rows of the group. Equal rows keep the order of the scan."""
    keys = [F.col(c).asc_nulls_first() for c in ("group", *by, "row")]
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    placed = written(dealt.drop("row").withColumn("range", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "ranges")
    counts = placed.groupBy("group", "range").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(W.partitionBy("group").orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select("group", "range", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(W.partitionBy("group")).alias("cnt"))
    out = placed.join(starts, ["group", "range"]).withColumn("pos", F.col("at") + F.col("shift")).drop("range", "at", "shift")
    out.written_to = placed.written_to
    return out


def build(nodes: DataFrame, carry: tuple[str, ...] = (), fan: int = FAN) -> tuple[list[DataFrame], list[DataFrame]]:
    """nodes: (group, pos, cnt, hash and the carried columns). The written levels (group, pos, cnt, children, hash), lowest first, and for each height from 0 the nodes that are alone in their group there."""
    levels, tops = [], [nodes.filter("cnt = 1")]
    most = nodes.agg(F.max("cnt").alias("m")).first()["m"] or 0
    while most > 1:
        members = F.array_sort(F.collect_list(F.struct("pos", "hash", *carry)))
        grouped = nodes.filter("cnt > 1").groupBy("group", F.floor(F.col("pos") / fan).alias("pos"), F.ceil(F.col("cnt") / fan).alias("cnt")).agg(members.alias("children"))
        levels.append(written(grouped.withColumn("hash", digest(F.array_join("children.hash", ""))), "level"))
        nodes, carry, most = levels[-1].select("group", "pos", "cnt", "hash"), (), -(-most // fan)
        tops.append(nodes.filter("cnt = 1"))
    return levels, tops


def push(levels: list[DataFrame], starts: list[DataFrame], carry: tuple[str, ...] = ()) -> DataFrame:
    """Proofs of all leaves of the levels. starts: for each height the nodes (group, pos, hash, path, root, subroot, and on height 0 the carried columns) whose proof is known; the same columns come back for the leaves."""
    known = starts[-1]
    for height in range(len(levels) - 1, -1, -1):
        kept = carry if height == 0 else ()
        joined = levels[height].select("group", "pos", "children").join(known.select("group", "pos", "path", "root", "subroot"), ["group", "pos"])
        beside = lambda a, n: F.array_join(F.slice("children.hash", a, n), "")
        size = F.size("children")
        child = lambda c, i: F.struct(c["pos"].alias("pos"), c["hash"].alias("hash"), *[c[k].alias(k) for k in kept], F.struct(beside(F.lit(1), i).alias("left"), beside(i + 2, size - i).alias("right")).alias("siblings"))  # noqa: E731,B023
        children = joined.select("group", "path", "root", "subroot", F.explode(F.transform("children", child)).alias("c"))
        pushed = children.select("group", "c.pos", "c.hash", F.concat(F.array("c.siblings"), "path").alias("path"), "root", "subroot", *[f"c.{k}" for k in kept])
        known = pushed.unionByName(starts[height].select(*pushed.columns))
    return known


def folded(leaf_: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf_, lambda h, s: digest(F.concat(s["left"], h, s["right"])))


def proofs(docs: DataFrame, fan: int = FAN) -> DataFrame:
    """Per row: doc_id, lang, leaf, checked, path (siblings left and right, level by level up to the root), subroot and root."""
    places = numbered(leaves(docs), ["doc_id", "hash"])
    levels, tops = build(places, ("doc_id", "checked"), fan)
    tops[0] = written(tops[0], "leaves")
    discard(places)
    subroots = tops[0].select("group", "hash")
    for top in tops[1:]:
        subroots = subroots.unionByName(top.select("group", "hash"))
    upper = numbered(subroots.select(F.lit("").alias("group"), F.col("group").alias("language"), "hash"), ["language"])
    upper_levels, upper_tops = build(upper, ("language",), fan)
    no_path = F.array().cast(_NO_PATH)
    ends = [t.withColumn("path", no_path).withColumn("root", F.col("hash")).withColumn("subroot", F.lit(None).cast("string")) for t in upper_tops]
    above = written(push(upper_levels, ends, ("language",)).select(F.col("language").alias("group"), "path", "root", F.col("hash").alias("subroot")), "subroots")
    discard(upper, *upper_levels)
    starts = [t.join(above, "group") for t in tops]
    found = push(levels, starts, ("doc_id", "checked"))
    language = F.when(F.col("group") != "-", F.substr("group", F.lit(2)))
    return found.select("doc_id", language.alias("lang"), F.col("hash").alias("leaf"), "checked", "path", "subroot", "root")


def manifest(docs: DataFrame, fan: int = FAN) -> DataFrame:
    """Per document: doc_id, leaf, subroot, root, proof_sha256, and what its altered (else original) leaf folds to."""
    proof = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    back = folded(F.coalesce("checked", "leaf"), F.col("path"))
    out = proofs(docs, fan).select("doc_id", "leaf", "subroot", "root", digest(proof).alias("proof_sha256"), back.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _oracle(depth: int = 10) -> str:
    """The same in SQL, for up to FAN ** depth rows a language and languages."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    row = lambda text: "sha256(" + " || ".join(field(text if c == "text" else c) for c in FIELDS) + ")"
    lower = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    crc = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(d) + 1), lambda i: CAST(ascii(substr(d, i, 1)) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)))"
    sql = [
        "d AS (SELECT *, CAST(doc_id AS VARCHAR) AS d, coalesce('=' || lang, '-') AS g FROM documents)",
        f"l AS (SELECT doc_id, g, {row('text')} AS leaf, CASE WHEN d IS NOT NULL AND {crc} % 3 = 0 THEN {row(lower)} END AS checked FROM d)",
        "p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS cnt FROM l)",
    ]

    def tree(tag: str, first: str) -> None:
        sql.append(f"{tag}0 AS ({first})")
        for i in range(depth):
            sql.append(f"{tag}{i + 1} AS (SELECT g, pos // {FAN} AS pos, (cnt + {FAN - 1}) // {FAN} AS cnt, CASE WHEN cnt > 1 THEN sha256(string_agg(h, '' ORDER BY {tag}{i}.pos)) ELSE any_value(h) END AS h FROM {tag}{i} GROUP BY g, {tag}{i}.pos // {FAN}, cnt)")

    tree("a", "SELECT g, pos, cnt, leaf AS h FROM p")
    tree("b", f"SELECT 0 AS g, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS cnt, h, g AS lang FROM a{depth}")
    sql.append(f"f0 AS (SELECT p.*, b0.pos AS bpos, b0.h AS subroot, (SELECT h FROM b{depth}) AS root, '' AS proof, coalesce(checked, leaf) AS fold FROM p JOIN b0 ON b0.lang = p.g)")
    step = 0
    for tag, place, group in (("a", "pos", "f.g"), ("b", "bpos", "0")):
        for i in range(depth):
            at = f"f.{place} // {FAN**i}"
            side = lambda sign: f"(SELECT string_agg(n.h, '' ORDER BY n.pos) FROM {tag}{i} n WHERE n.g = {group} AND n.pos // {FAN} = f.{place} // {FAN ** (i + 1)} AND n.pos {sign} {at})"  # noqa: E731,B023
            more = f"(SELECT any_value(n.cnt) FROM {tag}{i} n WHERE n.g = {group}) > 1"
            sql.append(f"e{step} AS (SELECT f.*, coalesce({side('<')}, '') AS lft, coalesce({side('>')}, '') AS rgt, {more} AS up FROM f{step} f)")
            sql.append(f"f{step + 1} AS (SELECT * EXCLUDE (lft, rgt, up) REPLACE (CASE WHEN up THEN proof || lft || rgt ELSE proof END AS proof, CASE WHEN up THEN sha256(lft || fold || rgt) ELSE fold END AS fold) FROM e{step})")
            step += 1
    return f"WITH {', '.join(sql)} SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified FROM f{step}"


ORACLE = _oracle(6)
