from __future__ import annotations

import random

import numpy as np
import pytest

from foliant.llm import minhash, queries
from foliant.llm.components import components
from foliant.llm.minhash_sets import one_permutation, shingle_set, shingles
from tests.llm import brute
from tests.llm.fixtures import SCHEMA, edge_rows, with_nulls


def as_dict(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def want(docs, k):
    return {d: (n, c, d == c) for d, (n, c) in brute.near(docs, k).items()}


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert as_dict(queries.op10_minhash(spark, sf_dir)) == want(docs, 2)


def test_edges(spark):
    rows = edge_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    got = minhash.near_duplicates(docs, k=2)
    assert got.count() == len(rows)
    assert as_dict(got) == want(list({(r[0], r[1]) for r in rows}), 2)


def test_null_ids_and_empty_tables(spark):
    rows = with_nulls()
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), k=2).collect()
    assert len(got) == len(rows)
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    none = spark.createDataFrame([], SCHEMA)
    assert minhash.near_duplicates(none).count() == 0
    kept = minhash.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == none.columns and kept.where("doc_id is null").count() == 3


def test_ids_that_repeat_are_linked_by_each_of_their_texts(spark):
    same = " ".join(f"w{i}" for i in range(40))
    rows = [(1, "a text that sorts first"), (1, same), (2, same + " tail"), (3, "far from all of them"), (None, same), (1, same)]
    got = [(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, True)] * 3 + [(2, 1, False), (3, 3, True), (None, None, True)], key=str)


def test_confirming_needs_the_full_sets(spark):
    """Candidates whose digests agree are compared by words; a hub's members come in several parts."""
    texts = [(i, " ".join(f"w{(i // 50) * 100 + j}" for j in range(30))) for i in range(100)]
    docs = spark.createDataFrame(texts, "doc long, text string")
    pairs = spark.createDataFrame([(i, 0) for i in range(1, 100)], "a long, b long")
    found = {(r.a, r.b) for r in minhash.confirm(pairs, docs, 2, 80).collect()}
    assert found == {(i, 0) for i in range(1, 50)}


def test_a_block_of_long_texts_is_shingled_in_bounded_parts(monkeypatch):
    """Runs of texts and parts of hashes give what all at once gives."""
    import pyarrow as pa

    r = random.Random(4)
    texts = [" ".join(r.choice(["a", "b", "c", "d", "e"]) for _ in range(200)) for _ in range(60)]
    part = pa.table({"text": texts})
    left = np.arange(0, 60, 3)
    size, common = minhash._common(part, left, 5)
    sets = [shingle_set(t, 5) for t in texts]
    assert size.tolist() == [len(s) for s in sets]
    others = left[:, None] != np.arange(60)
    assert (common == np.array([[len(sets[i] & s) for s in sets] for i in left]))[others].all()
    monkeypatch.setattr(minhash, "PIECE", 1000)
    monkeypatch.setattr(minhash, "PART", 700)
    monkeypatch.setattr(minhash, "COLUMNS", 50)
    again = minhash._common(part, left, 5)
    assert (again[0] == size).all() and (again[1] == common).all()


def near_copies(n: int, seed: int = 1) -> list[tuple[int, str]]:
    """Variants of one text that differ in some words: chains of links, pairs just below 0.8."""
    r = random.Random(seed)
    base = [f"w{i}" for i in range(60)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randrange(0, 12)):
            w[r.randrange(60)] = f"v{r.randrange(40)}"
        out.append((i, " ".join(w)))
    return out


def test_chains_in_large_buckets(spark, monkeypatch):
    docs = near_copies(700)
    got = as_dict(minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), k=2))
    assert got == want(docs, 2)
    assert 1 < len({c for _, c, _ in got.values()}) < 700


def test_one_permutation_estimates_similarity():
    r = random.Random(5)
    for shared, own in ((40, 5), (10, 1), (300, 30)):
        hits = []
        for trial in range(30):
            common = [f"c{trial}-{i}" for i in range(shared)]
            texts = [" ".join(r.sample(common + [f"{side}{trial}-{i}" for i in range(own)], shared + own)) for side in "ab"]
            doc, h = shingles(texts, 1)
            sig = one_permutation(doc, h, 2, 192)
            hits.append((sig[0] == sig[1]).mean())
        assert np.mean(hits) == pytest.approx(shared / (shared + 2 * own), abs=0.06)


def test_shingles_agree_with_sets():
    for k in (1, 2, 5):
        texts = ["", "a", "A a a a b", "x  y\tz\nx y z", "é É " * 9]
        doc, h = shingles(texts, k)
        assert [int((doc == i).sum()) for i in range(len(texts))] == [len(shingle_set(t, k)) for t in texts]
        assert [shingle_set(t, k) for t in texts] == [{tuple(w.encode() for w in s) for s in brute.shingles(t, k)} for t in texts]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150), (7, 7), (300, 301), (301, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = brute.roots({x for e in edges for x in e}, edges)
    assert got == {n: r for n, r in root.items() if n != r}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
