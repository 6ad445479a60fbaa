"""Exact dedup by deterministic block naming, with DataFrame functions only.

Texts are lower-cased (A-Z only) and cut into blocks of ``BLOCK`` bytes. The distinct blocks are
sorted and numbered; neighbouring numbers are paired, the distinct pairs sorted and numbered
again, until each text has one number. Numbers stand for contents, not for hashes of them, so
texts of one length are equal if and only if their last numbers are. Every document is named.

A number is a bucket, given by a hash, and the place in the bucket's sorted distinct blocks. It
depends on the blocks of the table only, not on how they are partitioned or on which executor is
lost. Buckets hold about ``BUCKET`` blocks and are merged in every task before they are shuffled,
so a block that a third of the texts have is sent once by each task.

Rows find the numbers of their first blocks by MD5, so that contents are shuffled once; this is
exact, as the digests of the distinct blocks are checked to differ. If two agreed, rows would be
joined by the blocks themselves. A group's largest id is found by partial aggregation and
written: so the join back to the group's rows is a plain one, which Spark splits when one group
holds most rows.

Null texts count as empty. Repeated rows count in ``group_size``; rows that repeat the id that
stays all stay. A null doc_id is smaller than any other.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.runtime import compacted, materialize

#: Bytes in a block of the first level, and about how many distinct ones share a bucket.
BLOCK, BUCKET = 4096, 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEPT = ["row", "doc_id", "sha", "n"]


def normalized(text: str | Column = "text") -> Column:
    """A-Z lower-cased, null as empty; lower() does the same, and faster, where all is ASCII."""
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def number(rows: DataFrame, key: Column, most: int, per_bucket: int = BUCKET) -> DataFrame:
    """key, name of each distinct ``key``, of which there are at most ``most``."""
    hashed = F.pmod(F.xxhash64("key"), F.lit(max(1, ceil(most / per_bucket))).cast("long"))
    buckets = rows.select(key.alias("key")).groupBy(hashed.alias("bucket")).agg(F.array_sort(F.collect_set("key")).alias("keys"))
    placed = buckets.select("bucket", F.posexplode("keys").alias("place", "key"))
    return placed.select("key", (F.shiftleft("bucket", 32) + F.col("place")).alias("name"))


def _first_level(docs: DataFrame, block: int) -> DataFrame:
    """row, doc_id, sha, n, blocks, i and block of every block of every row of ``docs``."""
    data = normalized().cast("binary")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", data.alias("data"))
    rows = rows.select("row", "doc_id", F.sha2("data", 256).alias("sha"), F.octet_length("data").alias("n"), "data")
    blocks = F.greatest(F.ceil(F.col("n") / block), F.lit(1)).cast("int")
    rows = rows.select(*_KEPT, blocks.alias("blocks"), "data", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("i"))
    return rows.select(*_KEPT, "blocks", "i", F.substring("data", F.col("i") * block + 1, F.lit(block)).alias("block"))


def identities(docs: DataFrame, block: int = BLOCK, digest: Callable[[Column], Column] = F.md5) -> DataFrame:
    """row, doc_id, sha, n, name of every row; equal (n, name) means equal normalised text."""
    first = _first_level(docs, block)
    rows = materialize(first.select(*_KEPT, "blocks", "i", digest(F.col("block")).alias("digest")), like=docs)
    longest, total, many = rows.agg(F.max("blocks"), F.count("*"), F.count_if(F.col("blocks") > 1)).first()
    # only the digests of named blocks are written, but all contents are compared to be named
    names = materialize(number(first, F.col("block"), total).select(digest(F.col("key")).alias("digest"), "name"), like=docs)
    if not names.groupBy("digest").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
        return identities(docs, block, lambda b: b)
    rows = materialize(rows.join(names, "digest").drop("digest"), rows=total)
    done = [rows.where("blocks = 1").select(*_KEPT, "name")]
    for _ in range(ceil(log2(longest or 1))):
        left, right = F.when(F.col("i") % 2 == 0, F.col("name")), F.when(F.col("i") % 2 == 1, F.col("name"))
        pairs = rows.where("blocks > 1").groupBy(*_KEPT, "blocks", F.floor(F.col("i") / 2).cast("int").alias("i")).agg(F.max(left).alias("a"), F.coalesce(F.max(right), F.lit(-1).cast("long")).alias("b"))
        pairs = materialize(pairs, rows=many)
        names = number(pairs, F.struct("a", "b"), many, 16 * BUCKET).select("key.*", "name")
        rows = materialize(pairs.join(names, ["a", "b"]).select(*_KEPT, F.ceil(F.col("blocks") / 2).cast("int").alias("blocks"), "i", "name"), rows=many)
        done.append(rows.where("blocks = 1").select(*_KEPT, "name"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def classes(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    members = identities(docs, block)
    groups = materialize(members.groupBy("n", "name").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), rows=members.count())
    out = members.join(groups, ["n", "name"])
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Rows are told apart by id and text."""
    gone = classes(docs, block).where("not kept").select(F.col("doc_id").alias("__d"), F.col("text_sha256").alias("__s")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.sha2(normalized().cast("binary"), 256) == F.col("__s"))
    return compacted(docs.join(gone.hint("shuffle_hash"), same, "left_anti"), docs)


ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""
