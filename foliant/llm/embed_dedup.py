"""Embedding near-dedup with randomised-rotation binary codes and their correction factors.

Vectors are scaled to length 1 and rotated at random, short ones several times, so that a code has
about ``CODE_BITS`` bits or more. Stored of each vector x, once: the signs as a binary code c, scaled
to length 1; the correction factor f = <c, x>; how far c strays from x, as a spread; and the components
of x in 4 bits. For any x and the code of y, <x, c> / f estimates their cosine without bias, and it errs by
at most ``SIGMAS`` spreads but with negligible probability; what the 4 bits add to the error is bounded
for certain. Only pairs for which the bounds of both directions reach the threshold are
recomputed, in double precision.

Pairs meet in tables of buckets, keyed by some bits of further rotations. The number of bits
grows with the number of vectors, so that buckets keep their mean size, and the number of tables
such that a pair at the threshold shares no bucket with a probability of ``MISS``. First only the
codes are dealt to the buckets; vectors follow for those members of a bucket that have a pair within
the bounds. Equal vectors are one class beforehand. Buckets of more than ``CHUNK`` classes are
compared in blocks; blocks give members, counts and the edges that join components, never all
pairs. A pair that meets in several tables counts in the first one.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and
so do vectors of different lengths. Rows that repeat a vec_id are vectors of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.batches import bounds, groups
from foliant.llm.components import components
from foliant.runtime import materialize

SIGMAS, MISS, CHUNK, BUCKET, CODE_BITS = 6.0, 1e-5, 512, 64, 256

_rotations: dict[tuple, np.ndarray] = {}


def rotation(dim: int, columns: int, seed: int) -> np.ndarray:
    """``columns`` random directions; each ``dim`` of them in a row are orthogonal."""
    key = (dim, columns, seed)
    if key not in _rotations:
        random = np.random.Generator(np.random.PCG64(seed))
        parts = []
        for _ in range(ceil(columns / dim)):
            q, r = np.linalg.qr(random.standard_normal((dim, dim)))
            parts.append(q * np.sign(np.diag(r)))
        _rotations[key] = np.concatenate(parts, 1)[:, :columns]
    return _rotations[key]


def units(rows: list | np.ndarray) -> np.ndarray:
    """Rows of one length, scaled to length 1; the largest component is divided out first."""
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def plan(n: int, cosine: float) -> tuple[int, int]:
    """Bits of a bucket key, and number of tables, for n vectors."""
    bits = max(2, round(log2(max(2, n) / BUCKET)))
    same = 1 - acos(cosine) / pi
    return bits, ceil(log(MISS) / log(1 - same**bits))


def bucket_keys(x: np.ndarray, bits: int, tables: int, seed: int = 7) -> np.ndarray:
    """The bucket of each unit vector in each table."""
    d = x.shape[1]
    signs = x @ rotation(d, tables * bits, seed + 1) > 0
    return signs.reshape(len(x), tables, bits) @ (1 << np.arange(bits)) + (d << bits)


def _directions(d: int, seed: int = 7) -> np.ndarray:
    """The directions whose signs make a code, scaled such that they keep lengths: d rows."""
    times = -(-CODE_BITS // d)
    return rotation(d, d * times, seed) / np.sqrt(times)


def encoded(x: np.ndarray) -> np.ndarray:
    """A row of bytes for each unit vector: signs, 4-bit components, and factor, spread, low and step as float32."""
    d = x.shape[1]
    r = _directions(d)
    y = x @ r
    code = np.where(y > 0, 1.0, -1.0) / np.sqrt(y.shape[1])
    factor = (y * code).sum(1)
    stray = np.linalg.norm(code @ r.T - factor[:, None] * x, axis=1)
    spread = stray / factor / np.sqrt(max(1, d - 1))
    low = x.min(1)
    step = np.maximum((x.max(1) - low) / 15, 1e-30)
    q = np.rint((x - low[:, None]) / step[:, None]).clip(0, 15).astype(np.uint8)
    q = np.concatenate([q, np.zeros((len(x), d % 2), np.uint8)], 1)
    tail = np.stack([factor, spread, low, step], 1).astype(np.float32).view(np.uint8)
    return np.concatenate([np.packbits(y > 0, axis=1), q[:, ::2] << 4 | q[:, 1::2], tail], 1)


def within_bounds(code: np.ndarray, d: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Indexes i < j of codes whose estimates may belong to vectors with at least this cosine."""
    r = _directions(d).astype(np.float32)
    bits = r.shape[1]
    c, q = -(-bits // 8), -(-d // 2)
    sign = np.unpackbits(code[:, :c], axis=1, count=bits).astype(np.float32) * 2 - 1
    packed = code[:, c : c + q]
    factor, spread, low, step = np.ascontiguousarray(code[:, c + q :]).view(np.float32).T
    x = np.stack([packed >> 4, packed & 15], 2).reshape(len(code), -1)[:, :d] * step[:, None] + low[:, None]
    estimate = (x @ r) @ (sign.T / (np.sqrt(bits) * factor).astype(np.float32))
    rounded = step[:, None] / 2 * np.sqrt(d) / factor
    may = estimate + SIGMAS * spread + rounded + 1e-4 >= cosine
    return np.nonzero(np.triu(may & may.T, 1))


def _vectors(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and unit vectors for each length of the lists of a column that has no nulls."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(sizes := np.asarray(pc.list_value_length(column)))
    out = []
    for d in np.unique(sizes):
        own = np.flatnonzero(sizes == d)
        out.append((own, units(flat[(ends[own] - d)[:, None] + np.arange(d)])))
    return out


def codes(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """rep, copies, code and keys (the buckets in all tables) of rows (rep, copies, embedding)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            keys, code = np.zeros((n, tables), np.int64), [b""] * n
            for own, x in _vectors(batch.column("embedding")):
                keys[own] = bucket_keys(x, bits, tables)
                for i, c in zip(own.tolist(), encoded(x), strict=True):
                    code[i] = c.tobytes()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * tables), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("copies"), pa.array(code, pa.binary()), lists], ["rep", "copies", "code", "keys"])

    return classes.select("rep", "copies", "embedding").mapInArrow(run, "rep long, copies long, code binary, keys array<long>")


_BLOCK = ["t", "key", "i", "j"]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, int, int, np.ndarray]]:
    """Blocks of at least two members: table, start, stop and the members' codes."""
    for table in groups(batches, _BLOCK):
        table = table.combine_chunks()
        cuts = bounds(table, _BLOCK)
        code = table.column("code").chunk(0)
        at = np.frombuffer(code.buffers()[1], np.int32, len(code) + 1, code.offset * 4)
        data = np.frombuffer(code.buffers()[2], np.uint8)
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if e - s > 1:
                yield table, s, e, data[at[s] : at[e]].reshape(e - s, -1)


def _pairs(table: pa.Table, s: int, e: int, code: np.ndarray, bits: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a block within the bounds; in a block of two chunks only those between them."""
    i, j = within_bounds(code, table.column("key")[s].as_py() >> bits, cosine)
    if table.column("i")[s] != table.column("j")[s]:
        chunk = table.column("chunk").slice(s, e - s).to_numpy()
        cross = chunk[i] != chunk[j]
        i, j = i[cross], j[cross]
    return i, j


def _candidates(cosine: float, bits: int):
    """The members of blocks that have a pair within the bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, s, e, code in _blocks(batches):
            i, j = _pairs(table, s, e, code, bits, cosine)
            if len(i):
                yield table.slice(s, e - s).take(pa.array(np.unique(np.concatenate([i, j])))).combine_chunks().to_batches()[0]

    return run


def _compare(cosine: float, bits: int, tables: int):
    """Counts of links (a, null, n) and edges (a, b, 0) that join components, for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, s, e, code in _blocks(batches):
            i, j = _pairs(table, s, e, code, bits, cosine)
            if not len(i):
                continue
            part = table.slice(s, e - s)
            [(_, x)] = _vectors(part.column("embedding").combine_chunks())
            keep = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
            keys = bucket_keys(x[used], bits, tables)[at].reshape(2, len(i), tables)
            first = (keys[0] == keys[1]).argmax(1) == part.column("t")[0].as_py()
            i, j = i[first], j[first]
            rep, copies = part.column("rep").to_numpy(), part.column("copies").to_numpy()
            counts = np.bincount(i, copies[j], e - s) + np.bincount(j, copies[i], e - s)
            has = np.flatnonzero(counts)
            a, b, n = rep[has].tolist(), [None] * len(has), counts[has].astype(np.int64).tolist()
            parent: dict[int, int] = {}

            def find(v: int, parent: dict[int, int] = parent) -> int:
                while parent.get(v, v) != v:
                    parent[v] = v = parent.get(parent[v], parent[v])
                return v

            for x, y in zip(rep[i].tolist(), rep[j].tolist(), strict=True):
                p, q = find(x), find(y)
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    a.append(x)
                    b.append(y)
                    n.append(0)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "n"])

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``vectors``."""
    e = F.col("embedding")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.coalesce(finite & F.exists(e, lambda v: v != 0), F.lit(False))
    rows = vectors.select("vec_id", "embedding").where(usable & F.col("vec_id").isNotNull())
    classes = rows.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()))
    member = materialize(rows.join(classes, "embedding").select("vec_id", "cls"))
    n = classes.count()
    bits, tables = plan(n, cosine)
    coded = materialize(codes(classes.select(F.col("cls").alias("rep"), "copies", "embedding"), bits, tables), like=classes)
    slim = coded.select("rep", F.posexplode("keys").alias("t", "key"))
    sizes = slim.groupBy("t", "key").agg(F.count("*").alias("size")).where("size > 1")
    met = slim.join(sizes, ["t", "key"]).withColumn("chunks", F.ceil(F.col("size") / CHUNK).cast("int"))
    met = met.withColumn("chunk", F.pmod(F.xxhash64(F.lit(5), "rep"), "chunks").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.select("t", "key", F.least("chunk", "o").alias("i"), F.greatest("chunk", "o").alias("j"), "chunk", "rep")
    deal = lambda df: df.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK, "rep")
    member_of = "t int, key long, i int, j int, chunk int, rep long, copies long, code binary"
    likely = materialize(deal(met.join(coded.drop("keys"), "rep").select(*_BLOCK, "chunk", "rep", "copies", "code")).mapInArrow(_candidates(cosine, bits), member_of))
    vectors_of = classes.select(F.col("cls").alias("rep"), "embedding")
    found = materialize(deal(likely.join(vectors_of, "rep")).mapInArrow(_compare(cosine, bits, tables), "a long, b long, n long"))
    counts = found.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("others"))
    roots = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "cls")
    nodes = classes.select("cls", "rep", "copies").join(counts, "cls", "left").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    nodes = materialize(nodes, rows=n)
    lowest = nodes.groupBy("root").agg(F.min("rep").alias("c"))
    nodes = nodes.join(lowest, "root").select("cls", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n"), "c")
    per = member.join(nodes, "cls").select(F.col("vec_id").alias("v"), "n", "c")
    rest = vectors.where(~usable | F.col("vec_id").isNull()).select(F.col("vec_id").alias("v"), F.lit(0).cast("long").alias("n"), F.col("vec_id").alias("c"))
    out = per.unionByName(rest)
    return out.select(F.col("v").alias("vec_id"), F.col("n").cast("long").alias("n_links"), F.col("c").alias("component_id"), F.col("v").eqNullSafe(F.col("c")).alias("kept"))
