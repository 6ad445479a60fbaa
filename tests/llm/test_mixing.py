from __future__ import annotations

from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm import mixing, queries
from tests.llm import brute
from tests.llm.fixtures import SCHEMA, edge_rows, with_nulls


def check(rows, docs):
    """Rows of mix() against sizes and targets worked out by hand; docs: (doc_id, text, source)."""
    sizes = defaultdict(int)
    for _, t, s in docs:
        sizes[s] += len(brute.WORD.findall(t or ""))
    want = brute.targets(dict(sizes))
    taken = defaultdict(int)
    own = Counter((d, s, len(brute.WORD.findall(t or ""))) for d, t, s in docs)
    assert Counter((r.doc_id, r.source, r.size) for r in rows) == own
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        assert r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.5 + 1e-9


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = mixing.mix(docs).collect()
    check(first, [(r.doc_id, r.text, r.source) for r in docs.collect()])
    again = queries.op1_mixing(spark, sf_dir)
    assert again.columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert {(r.doc_id, r.taken) for r in again.collect()} == {(r.doc_id, r.taken) for r in first}


def test_edges_and_partitions(spark):
    for rows in (edge_rows(), with_nulls()):
        docs = spark.createDataFrame(rows, SCHEMA)
        got = mixing.mix(docs, block=64).collect()
        check(got, [(r[0], r[1], r[3]) for r in rows])
        other = mixing.mix(docs.repartition(7), block=64).collect()
        assert Counter(map(tuple, got)) == Counter(map(tuple, other))


def test_taken_counts_words_one_by_one(spark, sf_dir):
    """What each document gives, counted word by word from the slots and the places of documents."""
    odd = spark.createDataFrame(with_nulls(), SCHEMA).select("doc_id", "source", "text")
    for docs, block in ((spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"), 512), (odd, 64)):
        sizes = docs.select("doc_id", "source", mixing.size().alias("size"))
        sources = mixing.plan(mixing.targets(sizes), block)
        words = {r.key: [0] * r.source_size for r in sources.collect()}
        for s in mixing.slots(sources, 42, block).collect():
            for w in range(s.block_no * block, s.block_no * block + s.words):
                words[s.key][w] += 1
        want = Counter((r.doc_id, r.source, r.size, sum(words[r.key][r.start : r.start + r.size])) for r in mixing.placed(sizes, sources, 42).collect())
        got = Counter((r.doc_id, r.source, r.size, r.taken) for r in mixing.mix(docs, block=block).collect())
        assert got == want


def test_slots_are_made_in_many_tasks(spark):
    sizes = spark.createDataFrame([(1, "a", 40 * mixing.SLOTS_A_TASK)], "doc_id long, source string, size long")
    made = mixing.slots(mixing.plan(mixing.targets(sizes), 1), 42, 1)
    assert made.rdd.getNumPartitions() == 40
    assert made.count() == 40 * mixing.SLOTS_A_TASK


def test_rows_that_repeat_an_id_in_two_sources_are_mixed_apart(spark):
    rows = [(1, "w " * 600, "a"), (1, "v " * 5, "b"), (2, "u " * 600, "a"), (3, "x " * 5, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {(r.doc_id, r.source): (r.size, r.taken) for r in mixing.mix(docs).collect()}
    times = Counter((r.doc_id, r.source) for r in mixing.mix_documents(docs).collect())
    for k, (size, t) in taken.items():
        assert t // size <= times[k] <= -(-t // size)


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(docs).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, None, None, "a", None, 1, "", 0.0, 1, 1)], SCHEMA)).first().taken == 0
    assert mixing.mix_documents(docs).columns == docs.columns


def test_documents_come_as_often_as_their_words(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    per = {r.doc_id: (r.size, r.taken) for r in mixing.mix(docs).collect()}
    times = Counter(r.doc_id for r in mixing.mix_documents(docs).select("doc_id").collect())
    for d, (size, taken) in per.items():
        if size:
            assert taken // size <= times[d] <= -(-taken // size)


def test_blocks(spark, sf_dir):
    """The mix itself has the words that mix() counts, and shards of about the same size."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    blocks = mixing.mixed_blocks(docs, block=128).collect()
    target = {r.source: round(r.target) for r in mixing.mix(docs, block=128).select("source", "target").distinct().collect()}
    words = Counter()
    for b in blocks:
        assert len(brute.WORD.findall(b.text)) == b.words
        words[b.source] += b.words
    assert words == Counter(target)


def test_permutation(spark):
    for n in (1, 2, 7, 100, 1000):
        from pyspark.sql import functions as F

        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), 5, F.lit("k"))).collect()]
        assert sorted(got) == list(range(n))
        assert n < 100 or got != list(range(n))


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(0, 20), st.integers(0, 10_000), min_size=1, max_size=12))
def test_targets_never_pass_their_caps(sizes):
    t = brute.targets(sizes)
    assert all(v <= 3 * sizes[s] + 1e-6 for s, v in t.items())
    assert abs(sum(t.values()) - sum(sizes.values())) < 1e-6 * max(1, sum(sizes.values()))
