"""Operators over pages, repeats, label files and grounded answers, on hand-made rows."""

from __future__ import annotations

import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant import training
from foliant.functions import text as tx
from foliant.operators import flow, repeats
from foliant.sources import markup


def test_chains_and_sections(spark):
    t = spark.createDataFrame([(1, 1, 1, 0.0, 100.0), (1, 2, 2, 4.0, 95.0), (1, 3, 2, 50.0, 95.0), (1, 4, 4, 50.0, 95.0)], "doc_id long, n long, page int, x0 double, x1 double")
    assert [r.chain for r in flow.table_chains(t, "doc_id", "n", "page").orderBy("n").collect()] == [1, 1, 2, 3]
    o = spark.createDataFrame([(1, 0, 0.0, 90.0, 100.0, 99.0), (1, 1, 0.0, 50.0, 40.0, 80.0), (1, 2, 60.0, 50.0, 99.0, 79.0), (1, 3, 0.0, 0.0, 100.0, 10.0)], "page_id long, obj_id long, x0 double, y0 double, x1 double, y1 double")
    assert [(r.columns, r.section) for r in flow.sections(o, F.lit(50)).orderBy("obj_id").collect()] == [(1, 1), (2, 2), (2, 2), (1, 3)]
    s = spark.createDataFrame([(1, 1, 300.0), (1, 2, 10.0), (1, 3, 0.0)], "doc_id long, page_no int, y0 double")
    assert [r.start for r in flow.section_starts(s, "doc_id", ["page_no"]).orderBy("page_no").collect()] == ["page", "page", "continuous"]


def test_chapters(spark):
    one = lambda a, b: spark.range(1).select(flow.page_range(F.lit(a), F.lit(b), F.lit(10))).first()[0]
    assert tuple(one(-3, -1)) == (8, 10) and tuple(one(2, 0)) == (2, 10) and one(9, 3) is None and tuple(one(0, 99)) == (1, 10)
    c = spark.createDataFrame([(1, 0, 9), (1, 0, 3), (1, 5, None), (1, 8, 7)], "doc_id long, start long, end long")
    assert sorted(map(tuple, flow.normalized_chapters(c, F.lit(20)).collect())) == [(1, 0, 4), (1, 5, 7)]
    kv = spark.createDataFrame([(1, i, t) for i, t in enumerate(["intro", "Name: Ann", "Lee", "Age: 7"])], "doc_id long, n long, text string")
    assert [(r.key, r.value) for r in flow.key_value_rows(kv, ["doc_id"], "n").orderBy("entry").collect()] == [("Name", "Ann Lee"), ("Age", "7")]


def test_refine():
    scores = iter([50, 70, 60, 65, 99])
    best, score = flow.refine(lambda b, s, i: s, lambda p: (next(scores), []), threshold=90, patience=2)
    assert score == 70
    assert flow.refine(lambda b, s, i: "x", lambda p: (95, []))[1] == 95


@settings(max_examples=150, deadline=None)
@given(st.text("ab", max_size=40), st.integers(1, 4), st.integers(2, 4))
def test_suffix_units(s, least, times):
    want = None
    for u in range(least, len(s) // times + 1):
        unit, n = s[len(s) - u :], 1
        while s.endswith(unit * (n + 1)):
            n += 1
        if n >= times:
            want = (u, n)
            break
    assert repeats.suffix_unit(s, least, times) == want


def test_truncated(spark):
    long = "start " + "again and " * 500
    df = spark.createDataFrame([(1, long), (2, "short short "), (3, None)], "id long, text string")
    assert [r.text for r in repeats.truncated(df).orderBy("id").collect()] == ["start again and ", "short short ", None]
    assert repeats.repeated_suffixes(df).where("id = 3").first().unit_length is None


def test_marks(spark):
    one = lambda t: spark.range(1).select(tx.md_mark(F.lit(t), "**")).first()[0]
    assert [one(t) for t in (" a ", "b.", "b. ", "  ", "")] == [" **a** ", "**b.** ", "**b.** ", "  ", ""]


def test_label_files(spark):
    shapes = [{"label": "table", "points": [[10, 20], [0, 5]], "shape_type": "rectangle"}, {"label": "new", "points": [[0, 0], [1, 1]], "shape_type": "rectangle"}, {"label": "table", "points": [[0, 0]], "shape_type": "point"}]
    files = spark.createDataFrame([("b.json", json.dumps({"imagePath": "b.png", "shapes": shapes})), ("a.json", json.dumps({"shapes": shapes[:1]}))], "path string, json string")
    got = training.coco(training.annotations(files, ["table"])).orderBy("image_id").collect()
    assert [(r.path, r.image_id, r.category_id, r.x, r.y, r.w, r.h, r.area) for r in got] == [("a.json", 1, 1, 0, 5, 10, 15, 150), ("b.json", 2, 1, 0, 5, 10, 15, 150)]
    assert training.annotations(files, ["table"], add_new=True).count() == 3
    assert {(r.label, r.n, r.skipped) for r in training.statistics(files, ["table"]).collect()} == {("table", 3, False), ("new", 1, True)}


def test_grounded_answers(spark):
    said = "<|ref|>title<|/ref|><|det|>[[0, 0, 999, 100]]<|/det|>\nHello\n<|ref|>text<|/ref|><|det|>[[5,5,5,9]]<|/det|>empty box"
    df = spark.createDataFrame([(1, said, 200.0, 100.0), (2, None, 1.0, 1.0)], "page_id long, text string, width double, height double")
    rows = markup.grounded_objects(df).collect()
    assert [(r.page_id, r.type, r.text) for r in rows] == [(1, "title", "Hello")]
    assert (round(rows[0].box.x1, 3), round(rows[0].box.y1, 3)) == (200.0, 100.0)
