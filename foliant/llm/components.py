"""Connected components of an edge table, by contraction; nothing reaches the driver but counts.

Each round hooks every node to its smallest neighbour, follows the hooks to their ends by
doubling, and contracts the edges. The rounds grow with the logarithm of the longest path.
Every step is an aggregation or an equi-join with one row per key on one side, so a node with
very many neighbours is summed in each task first, and its join may be split. No table has more
rows than the edges (labels: than those of all rounds), so tasks get fewer as edges do, and joins
are broadcast by counts (``by_rows``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.runtime import by_rows, materialize


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """node, root of rows (a, b): for each node that isn't the smallest it can reach, the smallest one.

    ``most``: no fewer than the edges, where that is known.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = materialize(edges.where("a != b").select(high.alias("a"), low.alias("b")).distinct(), rows=most)
    labels, labelled = None, 0
    while n := edges.count():
        hooks = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")), rows=n)
        while True:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
            moved = hooks.join(by_rows(up, n), "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved"))
            moved = materialize(moved, rows=n)
            hooks = moved.select("node", "root")
            if moved.where("moved").isEmpty():
                break
        labelled += n
        if labels is None:
            labels = hooks
        else:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
            known = labels.join(by_rows(up, n), "root", "left").select("node", F.coalesce("above", "root").alias("root"))
            labels = materialize(known.unionByName(hooks.join(by_rows(labels.select("node"), labelled), "node", "left_anti")), rows=labelled)
        a, b = hooks.select(F.col("node").alias("a"), F.col("root").alias("ra")), hooks.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = edges.join(by_rows(a, n), "a", "left").join(by_rows(b, n), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a != b")
        edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), rows=n)
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
