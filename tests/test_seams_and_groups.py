"""Seams without pairs of cells, and groups of a tree taken out at once."""

from __future__ import annotations

import random

from foliant.operators import seams, tree


def _matches(upper, lower, within=5):
    """one_to_many cell by cell."""
    out = []
    for seam in {s for s, *_ in lower}:
        a, b = [r[1:] for r in upper if r[0] == seam], sorted({r[1:] for r in lower if r[0] == seam})
        under = {c: min((u for u in a if c[1] >= u[1] - within and c[2] <= u[2] + within), default=None) for c in b}
        if not a or None in under.values():
            continue
        groups = {u: [c for c in b if under[c] == u] for u in a}
        if all(g and min(c[1] for c in g) <= u[1] and max(c[2] for c in g) >= u[2] for u, g in groups.items()):
            out += [(seam, u[0], c[0], len(g)) for u, g in groups.items() for c in g]
    return sorted(out)


def test_one_to_many_makes_no_pairs(spark):
    rng = random.Random(5)
    upper, lower = [], []
    for seam in range(60):
        x, n = 0, rng.randint(1, 4)
        for place in range(n):
            w = rng.choice((8, 20, 40))
            upper.append((seam, place, x, x + w))
            parts, off = rng.randint(1, 3), rng.choice((0, 0, 0, 2, 9))
            lower += [(seam, place * 10 + p, x + w * p // parts + (off if p else 0), x + w * (p + 1) // parts) for p in range(parts)]
            x += w
    lower += lower[:9] + [(77, 1, 0, 5)]
    upper.append((78, 1, 0, 5))
    kinds = "seam long, place long, x0 long, x1 long"
    got = seams.one_to_many(spark.createDataFrame(upper, kinds), spark.createDataFrame(lower + [(None, 1, 0, 5)], kinds))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    want = _matches(upper, lower)
    assert sorted(map(tuple, got.collect())) == want and len({s for s, *_ in want}) > 10


def test_groups_are_followed_without_writing_all_nodes_each_round(spark, monkeypatch):
    nodes = [(d, i, i // 2 if i > 1 else None, i % 3 != 1 if d else i < 60, f"p{i}") for d in (0, 1) for i in range(1, 64)] + [(None, 5, 1, False, "x")]
    df = spark.createDataFrame(nodes, "doc_id long, node_id long, parent_id long, grp boolean, path string")
    held = {(d, i): (p, g) for d, i, p, g, _ in nodes}
    want = []
    for d, i, p, g, path in nodes:
        if not g:
            while (d, p) in held and held[d, p][1] and d is not None:
                p = held[d, p][0]
            want.append((d, i, p, g, path))
    written, write = [], tree.materialize

    def note(x, *args, **kwargs):
        written.append(x.columns)
        return write(x, *args, **kwargs)

    monkeypatch.setattr(tree, "materialize", note)
    from pyspark.sql import functions as F

    got = tree.expanded(df, F.col("grp")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum("path" in c for c in written) == 1 and len(written) < 6  # a path of five groups takes three rounds and one to see that it's done
