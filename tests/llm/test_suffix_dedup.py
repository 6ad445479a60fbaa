from __future__ import annotations

import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant import runtime
from foliant.llm import anchors, queries, suffix_dedup
from foliant.llm.suffixes import common_prefixes, suffix_array
from tests.llm import brute
from tests.llm.fixtures import SCHEMA, edge_rows, with_nulls


def as_dict(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert as_dict(queries.op3_substrings(spark, sf_dir)) == brute.removed(docs)


def test_edges(spark):
    rows = edge_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    own = {(r[0], r[1]) for r in rows}
    got = suffix_dedup.digests(docs)
    assert got.count() == len(rows)
    assert as_dict(got) == brute.removed(list(own))


def test_null_and_repeated_ids(spark):
    rows = with_nulls() + [(None, "z" * 150, None, "s", None, 1, "", 0.0, 1, 1), (4, "z" * 120, None, "s", None, 1, "", 0.0, 1, 1)]
    got = suffix_dedup.digests(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    # a null id comes first; of one text all but the first 100 bytes repeat what starts earlier
    assert sorted((r.n_bytes, r.n_removed) for r in got if r.n_bytes in (120, 150)) == [(120, 120), (150, 149)]


def test_hot_anchors(spark):
    """Anchors with very many different runs are counted by digest, with the same result."""
    rows = edge_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    assert as_dict(suffix_dedup.digests(docs, hot_runs=1)) == brute.removed(list({(r[0], r[1]) for r in rows}))


def test_hashes_that_agree_are_not_trusted(spark, monkeypatch):
    """Run hashes of two bits collide all the time; bytes decide, with the same result."""
    rows = edge_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    want = brute.removed(list({(r[0], r[1]) for r in rows}))
    assert as_dict(suffix_dedup.digests(docs, hash_bits=2)) == want
    assert as_dict(suffix_dedup.digests(docs.repartition(9), hash_bits=2, hot_runs=3)) == want


def test_members_of_a_run_meet_their_leader_in_parts():
    import pyarrow as pa

    n = 3 * suffix_dedup.MEMBERS
    rows = suffix_dedup._batch(np.zeros(n), np.arange(n), np.full(n, 5), np.full(n, 6), np.zeros(n), np.ones(n))
    out = pa.Table.from_batches(suffix_dedup._match_runs(100, iter([rows]))).to_pandas()
    members, leaders = out[out.kind == suffix_dedup.EQUAL], out[out.kind == suffix_dedup.LEADER]
    assert len(members) == n - 1 and members.groupby("part").size().max() <= suffix_dedup.MEMBERS
    assert set(members.part) == set(leaders.part) and set(leaders.doc) == {0} and leaders.part.is_unique


def test_shuffle_files_go_as_soon_as_a_table_is_written(spark, monkeypatch):
    """Runs, texts and runs' bytes are shuffled one after the other, and no table finds the files of those before."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        found = files.getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    write, left, there = suffix_dedup.materialize, [], shuffled()

    def watched(df, **options):
        out, end = write(df, **options), time.time() + 5
        while (now := shuffled() - there) and time.time() < end:  # Spark removes them in the background
            time.sleep(0.05)
        left.append(now)
        return out

    monkeypatch.setattr(suffix_dedup, "materialize", watched)
    docs = spark.createDataFrame(edge_rows(), SCHEMA).select(F.col("doc_id").alias("doc"), "text").distinct()
    setting = spark.conf.get(runtime.SHUFFLE_CLEANUP)
    suffix_dedup.removed_windows(docs)
    assert left == [set()] * 3
    assert spark.conf.get(runtime.SHUFFLE_CLEANUP) == setting


def test_empty_and_kept_bytes(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup.digests(docs).count() == 0
    passage = "".join(chr(97 + i * i % 26) for i in range(140))
    docs = spark.createDataFrame([(1, passage), (2, "head " + passage + " tail")], "doc_id long, text string")
    kept = {r.doc_id: (bytes(r.kept), [(s.start, s.end) for s in r.spans]) for r in suffix_dedup.kept_bytes(docs).collect()}
    want = brute.removed([(1, passage), (2, "head " + passage + " tail")])
    assert {d: (len(k), brute.sha(k)) for d, (k, _) in kept.items()} == {d: (w[0] - w[1], w[3]) for d, w in want.items()}


@settings(max_examples=60, deadline=None)
@given(st.text("abc", max_size=300))
def test_suffix_array(s):
    t = np.frombuffer(s.encode() + b"\0", np.uint8)
    depth = 12
    order = suffix_array(t, depth)
    data = bytes(t)
    assert sorted(order.tolist()) == list(range(len(t)))
    cut = [data[i : i + depth] for i in order]
    assert cut == sorted(cut)
    common = common_prefixes(t, order, depth)
    for i in range(1, len(order)):
        a, b = data[order[i - 1] :] + b"\0" * depth, data[order[i] :] + b"\0" * depth
        n = next((k for k in range(depth) if a[k] != b[k]), depth)
        assert common[i] == n


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=0, max_size=400))
def test_equal_windows_have_equal_anchors(data):
    t = np.frombuffer(data + data, np.uint8)
    first, last, at, h, _ = anchors.runs(t, np.array([len(t)]), window=20, k=6)
    anchor = {}
    for a, b, p, x in zip(first, last, at, h, strict=True):
        for i in range(a, b + 1):
            key = bytes(t[i : i + 20])
            assert anchor.setdefault(key, (p - i, x)) == (p - i, x)
