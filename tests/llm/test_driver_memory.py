"""What the driver's JVM holds while tables are written."""

from __future__ import annotations

from functools import partial

from foliant import runtime
from foliant.llm.components import components
from foliant.llm.minhash import near_duplicates
from foliant.runtime import materialize


def test_a_grown_heap_is_collected_before_a_table_is_written(spark):
    jvm = spark._jvm
    heap, beans = jvm.java.lang.Runtime.getRuntime(), jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = next(b for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    held, piece = [], heap.maxMemory() // 256  # longs, so a thirty-second of the heap
    while 2 * heap.totalMemory() <= heap.maxMemory():
        held.append(spark.sparkContext._gateway.new_array(jvm.long, piece))
    before = full.getCollectionCount()
    assert materialize(spark.range(10)).count() == 10
    assert full.getCollectionCount() > before


def _written_plans(monkeypatch):
    """Of each table that ``materialize`` writes, the broadcast joins in its plan before it runs."""
    seen = []
    write = runtime.materialize

    def note(df, *args, **kwargs):
        seen.append([x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in x])
        return write(df, *args, **kwargs)

    for module in ("foliant.llm.components", "foliant.llm.minhash"):
        monkeypatch.setattr(f"{module}.materialize", note)
    return seen


def test_links_are_broadcast_by_their_rows_not_by_the_bytes_of_their_files(spark, monkeypatch):
    """A million packed numbers take few bytes on disk; the driver would take them all in."""
    docs = spark.createDataFrame([(i, f"w{i // 2} and more words that are said {i // 2} times over") for i in range(60)], "doc_id long, text string")
    edges = spark.range(1, 400).selectExpr("id AS a", "id - 1 AS b")
    runs = (lambda: components(edges), lambda: near_duplicates(docs, 2))
    want = [sorted(map(tuple, run().collect())) for run in runs]
    assert want[0] == [(i, 0) for i in range(1, 400)]
    assert {r[0]: r[2] for r in want[1]} == {i: i - i % 2 for i in range(60)}
    seen = _written_plans(monkeypatch)
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 0)  # no table is small
    monkeypatch.setattr("foliant.llm.minhash.join_dimension", partial(runtime.join_dimension, rows=-1))
    assert [sorted(map(tuple, run().collect())) for run in runs] == want
    assert len(seen) > 10
    assert sum(seen, []) == []
