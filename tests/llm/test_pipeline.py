"""The stages one after the other, against plain versions of each."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from foliant.llm import bpe, mixing, quality
from foliant.llm.queries import vocabulary
from tests.llm import brute
from tests.llm.fixtures import SCHEMA, with_nulls


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "exact_dedup", "minhash_near_dedup", "mixing_sources", "bpe_encoding"]

    def texts(df):
        return [(r.doc_id, r.text) for r in df.collect()]

    good = stages["quality_classifier"](spark, docs, sf_dir)
    assert good.columns == columns
    scores = {r.doc_id: r.score for r in quality.score(docs, quality.train(docs, labels)).select("doc_id", "score").collect()}
    assert {d for d, _ in texts(good)} == {d for d, s in scores.items() if s >= 0.5}
    good = corpus_pipeline.materialize(good)

    exact = stages["exact_dedup"](spark, good, sf_dir)
    assert exact.columns == columns
    assert {d for d, _ in texts(exact)} == {d for d, (_, _, kept, _) in brute.exact(texts(good)).items() if kept}
    exact = corpus_pipeline.materialize(exact)

    near = stages["minhash_near_dedup"](spark, exact, sf_dir)
    assert near.columns == columns
    assert {d for d, _ in texts(near)} == {d for d, (_, c) in brute.near(texts(exact), 5).items() if d == c}
    near = corpus_pipeline.materialize(near)

    mix = stages["mixing_sources"](spark, near, sf_dir)
    assert mix.columns == columns
    taken = {r.doc_id: (r.size, r.taken) for r in mixing.mix(near).collect()}
    times = Counter(d for d, _ in texts(mix))
    assert all(t // max(1, n) <= times[d] <= -(-t // max(1, n)) for d, (n, t) in taken.items())
    mix = corpus_pipeline.materialize(mix)

    out = stages["bpe_encoding"](spark, mix, sf_dir)
    model = bpe.BPE(vocabulary())
    want = Counter()
    for d, t in texts(mix):
        ids = model.encode(t or "")
        want[(d, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(model.decode(ids)))] += 1
    assert Counter(map(tuple, out.collect())) == want


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_rows(spark, sf_dir, k):
    docs = spark.createDataFrame([r[:5] for r in with_nulls()], ", ".join(SCHEMA.split(", ")[:5]))
    name, stage = corpus_pipeline.STAGES[k]
    for rows in (docs, docs.limit(0)):
        out = stage(spark, rows, sf_dir)
        assert name == "bpe_encoding" or out.columns == docs.columns
        out.count()
