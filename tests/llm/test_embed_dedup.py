from __future__ import annotations

import numpy as np

from foliant.llm import embed_dedup, queries
from tests.llm import brute


def as_dict(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


def want(vectors):
    return {v: (n, c, v == c) for v, (n, c) in brute.cosines(vectors).items()}


def clusters(n: int, seed: int = 2, dim: int = 64) -> list[tuple[int, list[float]]]:
    r = np.random.default_rng(seed)
    centres = r.standard_normal((n // 40, dim))
    x = centres[r.integers(0, len(centres), n)] + r.standard_normal((n, dim)) * r.uniform(0, 0.35, (n, 1))
    return [(i, row.tolist()) for i, row in enumerate(x)]


def test_query(spark, sf_dir):
    v = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert as_dict(queries.op9_embeddings(spark, sf_dir)) == want(v)


def test_planted_clusters(spark):
    """Pairs around the threshold, and buckets that are compared in several blocks."""
    v = clusters(3000)
    got = as_dict(embed_dedup.near_duplicates(spark.createDataFrame(v, "vec_id long, embedding array<double>")))
    expected = want(v)
    assert got == expected
    assert sum(n for n, _, _ in expected.values()) > 10_000


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    one = [1.0, 2.0, 3.0]
    v = [(1, one), (2, [2.0, 4.0, 6.0]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 3.0]), (7, [1.0, nan, 3.0]), (8, [inf, 1.0, 1.0]),
         (9, [1.0, 2.0]), (10, one), (11, [-1.0, -2.0, -3.0]), (12, [1e-300, 2e-300, 3e-300]), (13, [1e300, 2e300, 3e300])]
    df = spark.createDataFrame([(i, e, 0, "x") for i, e in v], "vec_id long, embedding array<double>, label int, rep string")
    assert as_dict(embed_dedup.near_duplicates(df)) == want(v)


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (5, [1.0, 0.0]), (5, [1.0, 0.01]), (6, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, embed_dedup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 0, None, True), (5, 1, 5, True), (5, 1, 5, True), (6, 0, 6, True)], key=str)
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_bounds_hold_and_spare_most_pairs():
    x = embed_dedup.units([e for _, e in clusters(1500, seed=9)])
    i, j = embed_dedup.within_bounds(embed_dedup.encoded(x), x.shape[1], 0.95)
    a, b = np.nonzero(np.triu(np.einsum("ik,jk->ij", x, x) >= 0.95, 1))
    assert set(zip(a.tolist(), b.tolist(), strict=True)) <= set(zip(i.tolist(), j.tolist(), strict=True))
    assert len(i) < 0.1 * len(x) * (len(x) - 1) / 2


def test_codes_of_any_length():
    """Odd lengths, one component, and equal components; a vector always stays within the bounds of itself."""
    r = np.random.default_rng(8)
    for d in (1, 2, 3, 7, 8, 9, 33):
        x = embed_dedup.units([*r.standard_normal((6, d)).tolist(), [1.0] * d])
        twice = np.concatenate([x, x])
        i, j = embed_dedup.within_bounds(embed_dedup.encoded(twice), d, 0.95)
        assert {(k, k + 7) for k in range(7)} <= set(zip(i.tolist(), j.tolist(), strict=True))


def test_recall_of_the_index(spark):
    """Buckets of small tables: recall of pairs at the threshold, against brute force."""
    r = np.random.default_rng(4)
    a = r.standard_normal((4000, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o = r.standard_normal(a.shape)
    o -= (o * a).sum(1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    b = 0.9501 * a + np.sqrt(1 - 0.9501**2) * o
    v = [(i, row.tolist()) for i, row in enumerate(np.concatenate([a, b]))]
    got = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(spark.createDataFrame(v, "vec_id long, embedding array<double>")).collect()}
    assert sum(got.values()) >= 0.999 * 8000
