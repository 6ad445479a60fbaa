"""Mixing sources to target weights, with DataFrame functions only.

1. Each source's documents are laid out in pseudorandom order and cut into blocks of ``BLOCK``
   words; only the last block of a source may be shorter.
2. A source's target is its share by weight, at most ``most`` times its size; what exceeds that
   is shared again by weight (closed form over the sources sorted by size per weight).
3. The target gives the source's number of output slots. Every slot draws its output shard
   uniformly; so the counts of sources in a shard are multinomial, given that the totals are met.
4. Slot j of a source takes block P(j mod blocks), where P is a pseudorandom permutation of the
   indexes, another one in each pass over the source (swap-or-not: see ``permuted``). The last
   slot may take only the first words of its block, so that the target is met to the word.
5. Slots and blocks are joined by (source, index).

Positions come from sums in hash buckets of bounded size and sums over the buckets, so a source
that holds a third of all rows is dealt over many tasks.

Null texts and texts without words have size 0 and are never taken. A null source is a source.
Repeated rows are rows of their own. Ties in the order go by hash, then id, then size. Results
depend on the rows and ``seed`` only, not on how they are partitioned.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.runtime import compacted, join_dimension, materialize

BLOCK, SHARD_SLOTS, ROUNDS = 512, 1024, 24
WEIGHTS = (5.0, 2.0, 1.0)
WORD = r"[^\x20\x09-\x0D]+"
_CHUNK = 1024
#: Output slots that a task makes.
SLOTS_A_TASK = 16 * _CHUNK


def size(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _key(source: str = "source") -> Column:
    """The source as a key that joins, null included."""
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))


def permuted(x: Column, n: Column, seed: int, *keys: Column) -> Column:
    """Place of x under a pseudorandom permutation of 0..n-1, another one for each ``keys``.

    In each round x and its partner k - x (mod n) change places if a hash of the larger of the
    two says so: a swap, whatever n is. n must not be 0.
    """

    def step(v: Column, r: Column) -> Column:
        k = F.pmod(F.xxhash64(F.lit(seed), F.lit("k"), r, *keys), n)
        other = F.pmod(k - v, n)
        return F.when(F.xxhash64(F.lit(seed), F.lit("s"), r, F.greatest(v, other), *keys).bitwiseAND(F.lit(1)) == 1, other).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), step)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """source, key, source_size, n_docs, weight, target of each source of rows (source, size).

    Sources in code point order, null last, weigh ``weights``, repeating. The one unpartitioned
    window is over a row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    at = ((F.row_number().over(order) - 1) % len(weights)).cast("int")
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), at + 1))
    by = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(W.unboundedPreceding, -1)
    capped = F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0.0))
    rest = F.sum("weight").over(by.rowsBetween(0, W.unboundedFollowing))
    per = per.withColumn("level", (F.sum("source_size").over(W.partitionBy()) - capped) / rest)
    per = per.withColumn("target", F.least(most * F.col("source_size"), F.col("weight") * F.max("level").over(W.partitionBy())))
    return per.select("source", _key().alias("key"), "source_size", "n_docs", "weight", "target")


def plan(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds to each source: full blocks, tail words, blocks, passes, and what the last pass takes."""
    size, words = F.col("source_size"), F.round("target").cast("long")
    out = sources.withColumns({"full": F.floor(size / block).cast("long"), "tail": size % block, "words": words})
    out = out.withColumn("blocks", F.col("full") + F.when(F.col("tail") > 0, 1).otherwise(0))
    out = out.withColumn("passes", F.when(size > 0, F.floor(F.col("words") / size)).otherwise(0).cast("long"))
    out = out.withColumn("left", F.col("words") - F.col("passes") * size)
    out = out.withColumns({"last_full": F.floor(F.col("left") / block).cast("long"), "part": F.col("left") % block})
    return out.withColumn("slots", F.col("passes") * F.col("blocks") + F.col("last_full") + F.when(F.col("part") > 0, 1).otherwise(0))


def slots(planned: DataFrame, seed: int, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """key, slot, shard, block_no, words: which block each output slot takes, and how many of its words.

    Slot numbers are made in three steps, so that no row holds all numbers of a source.
    """
    chunk = _CHUNK * _CHUNK
    total = F.sum("slots").over(W.partitionBy())
    rows = planned.where("slots > 0").withColumn("shards", F.ceil(total / shard_slots).cast("long"))
    rows = rows.select("key", "full", "tail", "blocks", "passes", "part", "slots", "shards", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / chunk).cast("long"))).alias("a"))
    rows = rows.repartition("key", "a").withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(_CHUNK - 1).cast("long"), F.floor((F.col("slots") - 1 - F.col("a") * chunk) / _CHUNK).cast("long")))))
    # by an explicit number: a few rows here become very many
    tasks = max(1, ceil((planned.agg(F.sum("slots")).first()[0] or 0) / SLOTS_A_TASK))
    rows = rows.repartition(tasks, "key", "a", "b")
    first = F.col("a") * chunk + F.col("b") * _CHUNK
    rows = rows.withColumn("slot", F.explode(F.sequence(first, F.least(first + (_CHUNK - 1), F.col("slots") - 1)))).drop("a", "b")
    rows = rows.withColumns({"pass": F.floor(F.col("slot") / F.col("blocks")).cast("long"), "j": F.col("slot") % F.col("blocks")})
    index = F.when(F.col("j") >= F.col("full"), F.col("full")).otherwise(permuted(F.col("j"), F.greatest(F.col("full"), F.lit(1)), seed, F.col("key"), F.col("pass")))
    whole = F.when(F.col("j") >= F.col("full"), F.col("tail")).otherwise(F.lit(block))
    words = F.when((F.col("slot") == F.col("slots") - 1) & (F.col("part") > 0), F.col("part")).otherwise(whole)
    return rows.select("key", "slot", F.pmod(F.xxhash64(F.lit(seed), F.lit("shard"), "key", "slot"), F.col("shards")).alias("shard"), index.alias("block_no"), words.cast("long").alias("words"))


def placed(sizes: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Adds to rows (doc_id, source, size, ...): key, and ``start``, the row's first word in its source."""
    n = F.col("n_docs")
    buckets = F.greatest(F.lit(1.0), F.ceil(F.least(n / 256, 4 * F.sqrt(n))))
    rows = join_dimension(sizes.withColumn("key", _key()), sources.select("key", buckets.cast("long").alias("buckets")), ["key"])
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "key", "doc_id")).withColumn("bucket", F.pmod(F.xxhash64("h"), F.col("buckets"))).drop("buckets")
    totals = rows.groupBy("key", "bucket").agg(F.sum("size").alias("t"))
    before = W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("key", "bucket", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("first"))
    own = W.partitionBy("key", "bucket").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("size").over(own), F.lit(0)))
    rows = rows.withColumn("nth", F.row_number().over(W.partitionBy("key", "bucket").orderBy("h", "doc_id", "size")))
    return rows.join(starts, ["key", "bucket"]).withColumn("start", F.col("start") + F.col("first")).drop("first", "h")


def _pieces(rows: DataFrame, block: int) -> DataFrame:
    """A row for each block that a document reaches into: block_no, and the words [a, b) of the source."""
    last = F.floor((F.col("start") + F.col("size") - 1) / block).cast("long")
    out = rows.withColumn("block_no", F.explode(F.sequence(F.floor(F.col("start") / block).cast("long"), last)))
    return out.withColumns({"a": F.greatest("start", F.col("block_no") * block), "b": F.least(F.col("start") + F.col("size"), (F.col("block_no") + 1) * block)})


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row of ``docs``."""
    sizes = materialize(docs.select("doc_id", "source", size().alias("size")), like=docs)
    sources = materialize(plan(targets(sizes, weights, most), block), rows=sizes.count())
    rows = placed(sizes, sources, seed)
    part = F.col("words") < F.when(F.col("block_no") >= F.col("full"), F.col("tail")).otherwise(F.lit(block))
    taken = join_dimension(slots(sources, seed, block), sources.select("key", "full", "tail"), ["key"])
    taken = taken.groupBy("key", "block_no").agg(F.sum(F.when(part, 0).otherwise(1)).alias("times"), F.max(F.when(part, F.col("words")).otherwise(0)).alias("some"))
    pieces = _pieces(rows.where("size > 0"), block).join(taken, ["key", "block_no"])
    edge = F.greatest(F.lit(0), F.least(F.col("b"), F.col("block_no") * block + F.col("some")) - F.col("a"))
    words = pieces.groupBy("key", "bucket", "nth", "doc_id", "source", "size").agg(F.sum((F.col("b") - F.col("a")) * F.col("times") + edge).alias("taken"))
    # rows that take nothing come in by a union, so that all rows need no second join
    every = words.unionByName(rows.select("key", "bucket", "nth", "doc_id", "source", "size", F.lit(0).cast("long").alias("taken")))
    every = every.groupBy("key", "bucket", "nth", "doc_id", "source", "size").agg(F.sum("taken").alias("taken"))
    return join_dimension(every, sources.select("key", "source_size", "target"), ["key"]).select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_blocks(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """The mix itself: shard, source, slot, block_no, words and text (words joined by spaces)."""
    read = docs.select("doc_id", "source", size().alias("size"), "text")
    sources = materialize(plan(targets(read.select("source", "size"), weights, most), block))
    pieces = _pieces(placed(read, sources, seed).where("size > 0"), block)
    words = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), (F.col("a") - F.col("start") + 1).cast("int"), (F.col("b") - F.col("a")).cast("int"))
    blocks = pieces.select("key", "source", "block_no", F.struct("a", words.alias("w")).alias("p")).groupBy("key", "source", "block_no").agg(F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["w"])).alias("w"))
    out = slots(sources, seed, block).join(blocks, ["key", "block_no"])
    return out.select("shard", "source", "slot", "block_no", "words", F.concat_ws(" ", F.slice("w", F.lit(1), F.col("words").cast("int"))).alias("text"))


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """Whole documents, each as often as the mix takes its words: rows of ``docs``, some repeated.

    The part of a document that is taken less often than the rest is rounded by a hash of its id.
    Rows that repeat both id and source share what the mix takes of them.
    """
    per = mix(docs, weights, most, seed, block).groupBy("doc_id", "source").agg(F.sum("size").alias("__z"), F.sum("taken").alias("__t"))
    rest = (F.col("__t") % F.col("__z")) / F.col("__z")
    chance = F.pmod(F.xxhash64(F.lit(seed), F.lit("copy"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    times = (F.floor(F.col("__t") / F.col("__z")) + F.when(chance < rest, 1).otherwise(0)).cast("int")
    times = per.where("__t > 0").select(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), times.alias("__times")).where("__times > 0")
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("source").eqNullSafe(F.col("__s"))
    return compacted(docs.join(times, same).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns), docs)
