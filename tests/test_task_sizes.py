"""Tasks that get more, not larger, as a table grows."""

from __future__ import annotations

import pytest

from foliant import runtime
from foliant.operators import layout
from foliant.plans import QUERIES
from foliant.plans.shared import boxes


@pytest.mark.parametrize("name", ["joined_rulings", "edge_clusters", "grid_validate", "table_reindex"])
def test_pages_are_dealt_into_tasks_of_bounded_size(spark, sf_dir, monkeypatch, name):
    want = sorted(map(tuple, QUERIES[name](spark, sf_dir).collect()))
    monkeypatch.setattr(runtime, "SORT_BYTES", 5000)
    parts = -(-runtime._size(runtime.table(spark, sf_dir, "lineitem")) // 5000)
    assert parts > 2 * spark.sparkContext.defaultParallelism
    assert boxes(spark, sf_dir).rdd.getNumPartitions() == parts
    got = QUERIES[name](spark, sf_dir)
    assert got.rdd.getNumPartitions() == parts  # what follows by page is dealt no other way
    assert sorted(map(tuple, got.collect())) == want


def test_lines_of_rects_are_made_without_another_shuffle(spark):
    rows = [(1, 1, 0, 10, 5), (1, 2, 12, 40, 6), (1, 3, 50, 52, 6), (1, 4, 0, 9, 9), (1, 5, 30, None, 9), (2, 1, 7, 7, 0), (None, 1, 0, 6, 1)]
    rects = spark.createDataFrame(rows, "page_id long, obj_id long, x0 long, x1 long, c long")
    got = layout.rect_lines(rects, within=2, gap=3, least=5)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, got.collect()), key=str) == [(1, 5, 0, 40), (1, 9, 0, 9), (None, 1, 0, 6)]
