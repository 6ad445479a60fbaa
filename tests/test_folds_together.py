"""Short groups that are folded together, against the same folds one by one."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant import grouped
from foliant.functions import geometry as g
from foliant.functions import text as tx
from foliant.operators import contents, layout, seams


def _pages(spark):
    rng = np.random.default_rng(3)
    rows = []
    for page in range(80):
        for obj in range(int(rng.integers(1, 9)) if page else 40):
            x, y, w, h = (int(v) for v in (*rng.integers(0, 30, 2), *rng.integers(0, 25, 2)))
            kind = ("a", "b", None)[rng.integers(3)]
            rows.append((page or None, obj, x, y, x + w, y + h, kind, int(rng.integers(40)), float(rng.integers(4))))
    return spark.createDataFrame(rows, "page_id long, obj_id long, x0 long, y0 long, x1 long, y1 long, kind string, red long, score double").repartition(3)


@pytest.mark.parametrize("operator", [layout.nms, layout.xy_cut, lambda d: layout.without_duplicates(d, ["red"], 25, 0.4, 0.5)])
def test_as_one_by_one(spark, monkeypatch, operator):
    pages = _pages(spark)
    got = sorted(map(tuple, operator(pages).collect()), key=str)
    alone = grouped.fold_groups
    monkeypatch.setattr(layout, "fold_groups", lambda *a: alone(*a[:7]))
    assert got == sorted(map(tuple, operator(pages).collect()), key=str)
    monkeypatch.setattr(layout, "fold_groups", lambda df, key, order, reads, keeps, fold, *a: alone(df, key, order, reads, keeps, _never, *a))
    few = pages.where("page_id is not null")
    assert sorted((r for r in got if r[0] is not None), key=str) == sorted(map(tuple, operator(few).collect()), key=str)


def _never(page):
    raise AssertionError("a short page was folded alone")


def test_cuts_of_short_pages_are_those_of_arrays():
    rng = np.random.default_rng(8)
    for _ in range(2000):
        lo = rng.integers(0, 12, (rng.integers(1, 9), 2))
        b = np.hstack([lo, lo + rng.integers(0, 5, lo.shape)]).astype(float)
        assert layout.short_cut_order(b.tolist()) == layout.cut_order(b)


def test_the_centre_of_a_quad_is_found_once(spark):
    q = F.array(*(F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("a", "b"), ("a", "d"), ("c", "d"), ("c", "b"))))
    rows = spark.createDataFrame([(0.0, 0.0, 4.0, 2.0), (1.0, 1.0, None, 3.0)], "a double, b double, c double, d double")
    turned, wide = g.quad_rotate(q, 90), g.quad_scale(q, 2, 0.5)
    got = rows.select(turned.alias("t"), wide.alias("w"), g.quad_rotate(F.lit(None).cast("array<struct<x:double,y:double>>"), 90).alias("n")).first()
    assert [tuple(p) for p in got.t] == [(3.0, -1.0), (1.0, -1.0), (1.0, 3.0), (3.0, 3.0)]
    assert [tuple(p) for p in got.w] == [(-2.0, 0.5), (-2.0, 1.5), (6.0, 1.5), (6.0, 0.5)] and got.n is None
    text = rows.select(turned.alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("array_max(") == 2  # once for each axis


def _settled_alone(verdict, like_left, like_right):
    """Cell by cell, with all verdicts of each pair."""
    n = len(verdict)
    merged, by = [None] * n, ["rest"] * n
    for k, name in enumerate(seams.CASES):
        for i in range(n):
            if merged[i] is None and verdict[i][k] is not None:
                merged[i], by[i] = verdict[i][k], name
        for i in range(n):
            for beside, like in ((i - 1, like_left[i]), (i + 1, like_right[i])):
                if merged[i] is None and 0 <= beside < n and like and merged[beside] is not None:
                    merged[i], by[i] = merged[beside], "neighbour"
    return [any(x is True for x in merged) if x is None else x for x in merged], by


def test_seams_are_settled_together_by_first_verdicts():
    rng = np.random.default_rng(4)
    for n in range(1, 6):
        verdict = [[[(None, None, None, None, None, None, None, True, False)[v] for v in row] for row in seam] for seam in rng.integers(0, 9, (200, n, len(seams.CASES)))]
        left, right = rng.integers(0, 2, (2, 200, n)) == 1
        first = np.array([[next((2 * k + v for k, v in enumerate(row) if v is not None), -1) for row in seam] for seam in verdict])
        merged, by = seams.settled(first, left, right)
        for i in range(200):
            assert (merged[i].tolist(), by[i].tolist()) == _settled_alone(verdict[i], left[i], right[i])


def test_matches_are_searched_in_the_text_not_in_copies_of_its_rest(spark):
    rows = spark.createDataFrame([("aeebe",), ("",), (None,), ("é𝄞e e ee",), ("xyz",)], "t string")
    got = rows.select(tx.find_all(F.col("t"), "e+").alias("f"), tx.find_all(F.col("t"), "e*").alias("g"))
    assert "substring" not in got._jdf.queryExecution().optimizedPlan().toString()
    f, g = zip(*((r.f and [tuple(x) for x in r.f], r.g and [tuple(x) for x in r.g]) for r in got.collect()), strict=True)
    assert f == ([(1, "ee"), (4, "e")], [], None, [(2, "e"), (4, "e"), (6, "ee")], [])
    assert g[0][:3] == [(0, ""), (1, "ee"), (3, "")] and g[0][-2][1] == "e"


def test_titles_without_a_head_in_common_are_not_compared(spark, monkeypatch):
    rng = np.random.default_rng(6)
    words = [*("".join(rng.choice(list("ab1. x"), rng.integers(0, 7))) for _ in range(60)), "1.2 abba", "#abba", "abba", "xabba", "a", "ab", None, "(1) ab", "é𝄞e", "𝄞e"]
    texts = spark.createDataFrame([(1, i, w) for i, w in enumerate(words)], "doc_id long, seq long, text string")
    items = spark.createDataFrame([(1, i, w) for i, w in enumerate(words)], "doc_id long, item long, title string")
    got = {(r.item, r.seq): r.score for r in contents.title_scores(items, texts).collect()}
    t, x = (df.withColumn("f", tx.title_forms(F.col(c))) for df, c in ((items, "title"), (texts, "text")))
    every = t.join(x.withColumnRenamed("f", "s"), "doc_id").select("item", "seq", tx.title_score(F.col("s"), F.col("f")).alias("score")).collect()
    assert got == {(r.item, r.seq): r.score for r in every} and len({*got.values()}) > 5
    compared = contents.title_scores(items, texts).select("score")._jdf.queryExecution().optimizedPlan().toString()
    assert "hash(" in compared
