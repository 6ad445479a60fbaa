from __future__ import annotations

from collections import Counter

import duckdb

from foliant.llm import exact_dedup, queries
from tests.llm import brute
from tests.llm.fixtures import SCHEMA, edge_rows, with_nulls


def as_dict(df):
    return {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()}


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = as_dict(queries.op4_exact(spark, sf_dir))
    assert got == brute.exact(docs)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    rows = con.execute(f"select doc_id, keep_id, group_size, kept, text_sha256 from ({exact_dedup.ORACLE})").fetchall()
    assert {r[0]: r[1:] for r in rows} == got


def test_edges_in_small_blocks(spark):
    """Blocks of 7 bytes take many levels of names."""
    rows = edge_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    got = as_dict(exact_dedup.classes(docs, block=7))
    want = brute.exact([(r[0], r[1]) for r in rows])
    assert got == {d: (k, n, kept, s) for d, (k, n, kept, s) in want.items()}
    assert exact_dedup.classes(docs).count() == len(rows)


def test_names_depend_on_the_blocks_only(spark):
    rows = [(i, t) for i, (_, t) in enumerate(edge_rows_texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first, other = ({r.doc_id: (r.n, r.name) for r in exact_dedup.identities(d, 64).collect()} for d in (docs, docs.repartition(9)))
    assert first == other and len(first) == len(rows)


def test_digests_that_agree_are_not_trusted(spark):
    from pyspark.sql import functions as F

    rows = [(i, t) for i, (_, t) in enumerate(edge_rows_texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n, r.name) for r in exact_dedup.identities(docs, 64, digest=lambda b: F.lit("all the same")).collect()}
    want = {r.doc_id: (r.n, r.name) for r in exact_dedup.identities(docs, 64).collect()}
    assert got == want


def edge_rows_texts():
    return [(r[0], r[1]) for r in edge_rows()]


def test_null_ids(spark):
    rows = with_nulls()
    got = Counter(map(tuple, exact_dedup.classes(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "keep_id", "group_size", "kept").collect()))
    assert got[(None, None, 2, True)] == 2
    assert got[(4, 4, 1, True)] == 1 and got[(4, 5, 2, False)] == 1
    kept = [tuple(r) for r in exact_dedup.drop_copies(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert ("one",) not in {(r[1],) for r in kept} and any(r[:2] == (4, "another text of the same id") for r in kept)
    assert sum(r[1] == "no id here at all" for r in kept) == 2


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.classes(docs).count() == 0
    assert exact_dedup.drop_copies(docs).columns == docs.columns


def test_no_copies(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert [r.kept for r in exact_dedup.classes(docs).collect()] == [True, True]
