"""MinHash near-dedup: one-permutation hashing, banded buckets, star-shaped candidate edges.

1. Each text's set of word shingles is hashed once per shingle into ``BANDS * ROWS`` bins with
   optimal densification. Bands of ``ROWS`` bins give bucket keys. Two sets of similarity 0.8
   share no bucket with a probability of (1 - 0.8^ROWS)^BANDS = 6e-5.
2. Sets with the same size and digest are candidates of one representative, which stands for them.
3. In each bucket the other representatives are edges to the smallest one: as many candidates as
   rows, whatever the bucket's size. All candidates are confirmed on the full sets of words.
4. Buckets whose members the links so far leave in several components are compared in full, in
   blocks: members outside of the bucket's first component against all. A block gives the edges
   that join components, never all its pairs; they are found by hashes of shingles, and confirmed
   on the full sets as well. So no link between documents of one bucket is missed.
5. Components come by contraction.

Nothing is capped: a bucket that holds a third of the rows is summed in every task first, its
join may be split, and its blocks are dealt over many tasks. Blocks are bounded by documents and
by shingles; of a hub's members ``MEMBERS`` at most meet in a task with its text, which is sent
once for them.

Null and empty texts have no shingles and link with nothing; a text of fewer than k words is one
shingle. Rows that repeat a doc_id are compared each with its own text, and are linked by the id;
they all have the size of their own text's set. Rows whose doc_id is null link with nothing and stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.batches import bounds, groups
from foliant.llm.components import components
from foliant.llm.keys import keyed
from foliant.llm.minhash_sets import band_keys, one_permutation, set_digests, shingle_set, shingles
from foliant.runtime import by_rows, compacted, join_dimension, materialize

BANDS, ROWS = 32, 6
#: Characters that are hashed together, and documents on each side of a compared block.
PIECE, CHUNK = 1_500_000, 256
#: Shingles that weigh as much as one more document in a block, and members that meet a hub in one task.
HEAVY, MEMBERS = 1000, 4096
#: Columns of the 0/1 matrix that is multiplied at a time.
COLUMNS = 8192
#: Hashes of a block that are numbered at a time.
PART = 1_000_000


def _runs(texts: list[str], most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Cuts of a list of texts into runs of about ``most`` characters."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > most:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def signatures(docs: DataFrame, k: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc, doc_id, n_shingles, one, two (digests of the set) and keys (a bucket key per band)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for i, j in _runs(texts):
                doc, h = shingles(texts[i:j], k)
                n, one, two = set_digests(doc, h, j - i)
                keys = band_keys(one_permutation(doc, h, j - i, bands * rows), bands)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n, pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), lists], ["doc", "doc_id", "n_shingles", "one", "two", "keys"])

    return docs.select("doc", "doc_id", "text").mapInArrow(run, "doc long, doc_id long, n_shingles long, one long, two long, keys array<long>")


def similar(common: np.ndarray | int, total: np.ndarray | int, percent: int) -> np.ndarray | bool:
    """Whether 100 * intersection >= percent * union; total: sizes of both sets together."""
    return 100 * common >= percent * (total - common)


def confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b of rows (a, b) whose full sets are similar; ``texts``: doc, text of all a and b.

    A hub b meets its members in groups of about ``MEMBERS``; its text comes once for each group.
    """
    most = pairs.count()
    sizes = materialize(pairs.groupBy("b").agg(F.ceil(F.count("*") / MEMBERS).alias("parts")).where("parts > 1"), rows=most)
    dealt = join_dimension(pairs, sizes, ["b"], "left")
    dealt = materialize(dealt.select("b", F.pmod(F.xxhash64(F.lit(11), "a"), F.coalesce("parts", F.lit(1))).alias("part"), "a"), rows=most)
    rows = dealt.select("b", "part", F.lit(1).alias("side"), F.col("a").alias("doc")).unionByName(dealt.select("b", "part", F.lit(0).alias("side"), F.col("b").alias("doc")).distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub_text, hub = "", set()
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            side, text = batch.column("side").to_pylist(), batch.column("text")
            for i in range(batch.num_rows):
                own = text[i].as_py() or ""
                if side[i] == 0:
                    hub_text, hub = own, shingle_set(own, k)
                elif own == hub_text:
                    keep[i] = bool(hub)
                else:
                    other = shingle_set(own, k)
                    keep[i] = similar(len(hub & other), len(hub) + len(other), percent)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    met = by_rows(rows, 2 * most).join(texts, "doc").repartition("b", "part").sortWithinPartitions("b", "part", "side", "doc")
    return met.select("b", "doc", "side", "text").mapInArrow(run, "a long, b long")


def _common(part: pa.Table, left: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the sets of a block's texts, and how many members those of ``left`` share with all.

    Texts are shingled in runs, and shingles numbered in parts by hash, so memory is bounded by
    ``PIECE`` and ``PART`` but for 16 bytes for each shingle of the block.
    """
    n = part.num_rows
    docs, hashes = [], []
    column = part.column("text")
    lengths = [len(t.as_py() or "") for t in column] if n <= 4 * CHUNK else [PIECE] * n
    start = 0
    while start < n:
        stop, total = start + 1, lengths[start]
        while stop < n and total + lengths[stop] <= PIECE:
            total += lengths[stop]
            stop += 1
        doc, h = shingles([t or "" for t in column.slice(start, stop - start).to_pylist()], k)
        docs.append(doc + start)
        hashes.append(h)
        start = stop
    doc, h = np.concatenate(docs), np.concatenate(hashes)
    common = np.zeros((len(left), n), np.int64)
    parts = -(-len(h) // PART) or 1
    for p in range(parts):
        mine = h % np.uint64(parts) == p if parts > 1 else np.ones(len(h), bool)
        d, own = doc[mine], h[mine]
        _, element, times = np.unique(own, return_inverse=True, return_counts=True)
        often = times > 1
        place = np.cumsum(often) - 1
        used = often[element]
        d, e = d[used], place[element[used]]
        width = int(often.sum())
        for c in range(0, width, COLUMNS):
            here = (e >= c) & (e < c + COLUMNS)
            m = np.zeros((n, min(COLUMNS, width - c)), np.float32)
            m[d[here], e[here] - c] = 1
            common += (m[left] @ m.T).astype(np.int64)
    return np.bincount(doc, minlength=n), common


def _joining(table: pa.Table, start: int, stop: int, k: int, percent: int, out: list[tuple[int, int]]) -> None:
    """Append the edges that join components in one block; rows of side 0 are compared to all."""
    part = table.slice(start, stop - start)
    ids, side = part.column("doc").to_numpy(), part.column("side").to_numpy()
    root = dict(zip(ids.tolist(), part.column("root").to_pylist(), strict=True))
    left = np.flatnonzero(side != 1)
    size, common = _common(part, left, k)
    x, y = np.nonzero(similar(common, size[left][:, None] + size[None, :], percent) & (size[left][:, None] > 0))
    parent: dict[int, int] = {}

    def find(v: int) -> int:
        while parent.get(v, v) != v:
            parent[v] = v = parent.get(parent[v], parent[v])
        return v

    for i, j in zip(left[x].tolist(), y.tolist(), strict=True):
        if i != j:
            p, q = find(root[int(ids[i])]), find(root[int(ids[j])])
            if p != q:
                parent[max(p, q)] = min(p, q)
                out.append((int(ids[i]), int(ids[j])))


def compare_blocks(blocks: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b: edges that join components, of rows (bucket, i, j, side, doc, root, text)."""
    keys = ["bucket", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, keys):
            cuts, found = bounds(table, keys), []
            for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
                _joining(table, int(start), int(stop), k, percent, found)
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    return blocks.repartition(*keys).sortWithinPartitions(*keys, "doc").mapInArrow(run, "a long, b long")


def _blocks(members: DataFrame) -> DataFrame:
    """Deal rows (bucket, doc, n_shingles, root, first) into blocks (i, j). ``first``: the bucket's first root.

    Members of other components (side 0) meet each other and all members of the first (side 1).
    """
    other = F.col("root") != F.col("first")
    weight = 1 + F.floor(F.col("n_shingles") / HEAVY)
    total = lambda c: F.coalesce(F.sum(F.when(c, weight)), F.lit(0))
    sizes = materialize(members.groupBy("bucket").agg(total(other).alias("others"), total(~other).alias("firsts")), rows=members.count())
    rows = join_dimension(members.drop("n_shingles"), sizes, ["bucket"]).withColumn("chunks", F.ceil(F.col("others") / CHUNK).cast("int"))
    spread = lambda n: F.pmod(F.xxhash64(F.lit(3), "doc"), n).cast("int")
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    own = spread(F.col("chunks"))
    # side 0: chunk c stands in the blocks (c, j) and (i, c) with i <= j
    outer = rows.where(other).withColumn("c", own).withColumn("o", F.explode(every))
    outer = outer.select("bucket", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), F.lit(0).alias("side"), "doc", "root")
    # the left side of a block against members of the first component: j < 0
    parts = F.ceil(F.col("firsts") / CHUNK).cast("int")
    inner = rows.where(~other).withColumn("j", -1 - spread(parts)).withColumn("i", F.explode(every)).select("bucket", "i", "j", F.lit(1).alias("side"), "doc", "root")
    left = rows.where(other & (F.col("firsts") > 0)).withColumn("i", own).withColumn("j", F.explode(F.sequence(-parts, F.lit(-1)))).select("bucket", "i", "j", F.lit(0).alias("side"), "doc", "root")
    return outer.unionByName(inner).unionByName(left)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document."""
    read, plain = keyed(docs)
    made = materialize(signatures(read, k, bands, rows), like=docs)
    n = made.count()
    sets = made.where("n_shingles > 0 and doc_id is not null").dropDuplicates(["doc"]) if not plain else made.where("n_shingles > 0")
    # what joins back to the rows of hot groups is written first, so that Spark may split the join
    first = materialize(sets.groupBy("n_shingles", "one", "two").agg(F.min("doc").alias("rep")), rows=n)
    equal = sets.select("doc", "n_shingles", "one", "two").join(by_rows(first, n), ["n_shingles", "one", "two"])
    equal = materialize(equal.select(F.col("doc").alias("a"), F.col("rep").alias("b")), rows=n)
    reps = equal.where("a = b").select(F.col("a").alias("doc"))
    keys = materialize(sets.select("doc", F.explode("keys").alias("key")).join(reps.hint("shuffle_hash"), "doc", "left_semi").select("key", "doc"), rows=n * bands)
    hubs = materialize(keys.groupBy("key").agg(F.min("doc").alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", "hub"), rows=n * bands)
    near = materialize(keys.join(by_rows(hubs, hubs.count()), "key").select("key", "doc", "hub"), rows=n * bands)
    met = near.count()
    pairs = near.where("doc != hub").select(F.col("doc").alias("a"), F.col("hub").alias("b")).distinct().unionByName(equal.where("a != b"))
    pairs = materialize(pairs, rows=met + n)
    wanted = pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct()
    texts = read.select("doc", "text").join(wanted.hint("shuffle_hash"), "doc", "left_semi")
    texts = materialize(texts if plain else texts.dropDuplicates(["doc"]), like=docs)
    links = confirm(pairs, texts, k, percent)
    if not plain:
        same = made.where("doc_id is not null").select("doc", "doc_id").distinct()
        links = links.unionByName(same.join(same.groupBy("doc_id").agg(F.min("doc").alias("b")), "doc_id").select(F.col("doc").alias("a"), "b").where("a != b"))
    links = materialize(links, like=docs)
    linked = links.count()
    roots = components(links, linked)
    # buckets that the links leave in several components, once for each set of members
    rooted = near.join(by_rows(roots.withColumnRenamed("node", "doc"), linked), "doc", "left").select("key", "doc", "hub", F.coalesce("root", "doc").alias("root"))
    mark = F.xxhash64(F.lit(7), "doc").cast("decimal(38,0)")
    split = rooted.groupBy("key").agg(F.min("root").alias("first"), F.max("root").alias("last"), F.count("*").alias("n"), F.sum(mark).alias("mark")).where("first != last")
    split = materialize(split.groupBy("n", "mark", "first").agg(F.min("key").alias("key")).select("key", "first"), rows=met)
    members = rooted.join(by_rows(split, split.count()), "key").select(F.col("key").alias("bucket"), "doc", "root", "first")
    members = materialize(members.join(sets.select("doc", "n_shingles").hint("shuffle_hash"), "doc"), rows=met)
    dealt = materialize(_blocks(members), like=docs)
    blocks = by_rows(dealt, dealt.count()).join(texts, "doc")
    more = materialize(compare_blocks(blocks, k, percent), like=docs)
    if not more.isEmpty():
        found = materialize(more.distinct(), rows=more.count())
        links = links.unionByName(materialize(confirm(found, texts, k, percent), like=docs))
        linked = links.count()
        roots = components(links, linked)
    final = roots.select(F.col("node").alias("doc"), "root")
    if plain:
        final = final.withColumnRenamed("root", "component")
    else:
        ids = made.where("doc_id is not null").groupBy("doc").agg(F.min("doc_id").alias("component"))
        final = final.join(ids.withColumnRenamed("doc", "root"), "root").select("doc", "component")
    out = made.select("doc", "doc_id", "n_shingles").join(by_rows(final, linked), "doc", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group stays, with all columns; of repeated rows of it, all."""
    gone = near_duplicates(docs, k, percent).where("not kept").select("doc_id").distinct()
    return compacted(docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti"), docs)
