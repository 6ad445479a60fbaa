from __future__ import annotations

import zlib

import numpy as np
import pytest

from foliant.llm import quality, queries, trees
from tests.llm import brute
from tests.llm.fixtures import SCHEMA, edge_rows, with_nulls


def test_query(spark, sf_dir):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = queries.op2_quality(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)
    again = {r.doc_id: r.score for r in queries.op2_quality(spark, sf_dir).collect()}
    assert again == {r.doc_id: r.score for r in rows}


def test_held_out_labels_are_never_read(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    from pyspark.sql import functions as F

    other = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.train(docs, labels), quality.train(docs, other)
    assert np.array_equal(a.value, b.value) and np.array_equal(a.feature, b.feature)


def test_edges(spark):
    rows = with_nulls()
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 0), (4, 1), (None, 1), (6, None), (8, 1), (17, 0), (18, 0)], "doc_id long, quality int")
    got = quality.score(docs, quality.train(docs, labels))
    assert got.columns == docs.columns and got.count() == len(rows)
    assert all(0 <= r.score <= 1 for r in got.collect())


def test_no_labels_and_no_documents(spark):
    docs = spark.createDataFrame(edge_rows(), SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    forest = quality.train(docs, none)
    assert {r.score for r in quality.score(docs, forest).collect()} == {0.5}
    assert quality.score(docs.limit(0), forest).count() == 0
    assert quality.train(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, quality int")).score(np.zeros((1, 26)))[0] == 0.5


def test_sample_bound(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    forest = quality.train(docs, labels, sample_rows=40)
    assert forest.value.shape[1] == 16


def test_bounded_sample(spark):
    from foliant.llm.batches import bounded_sample

    df = spark.range(30_000).withColumnRenamed("id", "k")
    got = [r.k for r in bounded_sample(df, 1000, ["k"]).collect()]
    assert len(set(got)) == 1000
    assert got == [r.k for r in bounded_sample(df.repartition(9), 1000, ["k"]).collect()]
    assert set(r.k for r in bounded_sample(df, 100, ["k"]).collect()) == set(got[:100])
    assert bounded_sample(df.limit(50), 1000, ["k"]).count() == 50 and bounded_sample(df.limit(0), 5, ["k"]).count() == 0


def test_trees_learn_and_flatten():
    r = np.random.default_rng(1)
    x = r.standard_normal((2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = trees.fit(x[:1500], y[:1500])
    assert ((forest.score(x[1500:]) >= 0.5) == y[1500:]).mean() > 0.97
    one = forest.score(x[:1])
    assert one[0] == forest.score(x[:10])[0]
    assert np.isfinite(trees.fit(x[:10], np.ones(10)).score(x)).all()


def test_flat_traversal_is_a_walk_through_the_trees():
    from foliant.llm.trees import fit

    r = np.random.default_rng(6)
    x = np.round(r.standard_normal((400, 5)), 1)
    y = (x[:, 0] * x[:, 1] + 0.3 * r.standard_normal(400) > 0).astype(float)
    forest = fit(x, y, trees=25, depth=3)
    got = forest.score(x)
    assert np.allclose(got, [brute.walked(forest, row) for row in x.tolist()], atol=1e-9)
    # more trees fit better; equal rows score equally
    loss = lambda f: -np.mean(np.log(np.where(y == 1, f.score(x), 1 - f.score(x))))
    assert loss(fit(x, y, trees=1, depth=3)) > loss(forest) > 0
    assert (forest.score(np.concatenate([x, x]))[400:] == got).all()


def test_one_split_is_the_best_of_all():
    """A single tree of depth 1 against trying every cut of every feature."""
    from foliant.llm.trees import fit

    r = np.random.default_rng(7)
    x = r.integers(0, 6, (60, 3)).astype(float)
    y = (x[:, 2] > 2).astype(float)
    y[:6] = 1 - y[:6]
    f = fit(x, y, trees=1, depth=1, bins=64)
    p = (y.sum() + 0.5) / 61
    grad, hess = y - p, np.full(60, p * (1 - p))
    gain = lambda m: grad[m].sum() ** 2 / (hess[m].sum() + 1)
    best = max(((gain(x[:, j] <= c) + gain(x[:, j] > c), j, c) for j in range(3) for c in np.unique(x[:, j])[:-1]), key=lambda t: t[0])
    assert f.feature[0, 0] == best[1]
    assert ((x[:, best[1]] > f.cut[0, 0]) == (x[:, best[1]] > best[2])).all()


def test_very_long_and_tied_texts_have_defined_scores(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    forest = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = [(1, "word and other words. " * 50_000), (2, None), (3, ""), (4, "same"), (5, "same"), (None, "same")]
    got = [(r.doc_id, r.score) for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string"), forest).collect()]
    want = forest.score(np.array([quality.statistics(t or "") for _, t in rows]))
    assert [s for _, s in got] == pytest.approx(want.tolist()) and got[1][1] == got[2][1] and got[3][1] == got[4][1] == got[5][1]
