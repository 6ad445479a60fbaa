"""Operators on hand-made rows, folds against plain versions, and streams against batches."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from foliant.functions import lists
from foliant.functions import text as tx
from foliant.operators import contents, layout, quality, regions, sequence, spatial, tables, tree
from foliant.runtime import is_small, join_dimension, numbered
from foliant.streaming import tasks

BOX = "page_id long, obj_id long, kind string, score double, x0 double, y0 double, x1 double, y1 double"


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def arr(*v):
    return F.array(*map(F.lit, v))


def random_boxes(pages=40, seed=1):
    r = random.Random(seed)
    out = []
    for p in range(pages):
        for i in range(r.randrange(1, 14)):
            x, y = r.randrange(80), r.randrange(80)
            out.append((p, i, r.choice("ab"), r.randrange(10) / 10, float(x), float(y), float(x + r.randrange(1, 40)), float(y + r.randrange(1, 30))))
    return out


def plain_overlap(a, b, small=False):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    common = max(0, w) * max(0, h)
    area = lambda c: (c[2] - c[0]) * (c[3] - c[1])
    return common / (min(area(a), area(b)) if small else area(a) + area(b) - common)


def by_page(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_suppression(spark, parts):
    rows = random_boxes()
    df = spark.createDataFrame(rows, BOX).repartition(parts)
    want = set()
    for p, objects in by_page(rows).items():
        kept = []
        for o in sorted(objects, key=lambda o: (-o[3], o[1])):
            if all(plain_overlap(o[4:], k[4:]) < (0.3 if o[2] == k[2] else 0.6) for k in kept):
                kept.append(o)
        want |= {(p, o[1]) for o in kept}
    assert {tuple(r) for r in layout.nms(df, 0.3, 0.6).collect()} == want
    want = set()
    for p, objects in by_page(rows).items():
        kept = []
        for o in sorted(objects, key=lambda o: (-(o[6] - o[4]) * (o[7] - o[5]), o[1])):
            if all(plain_overlap(o[4:], k[4:], small=True) < 0.7 for k in kept):
                kept.append(o)
        want |= {(p, o[1]) for o in kept}
    assert {tuple(r) for r in layout.without_contained(df).collect()} == want


def test_cuts_and_columns(spark):
    rows = [(1, 0, "", 0.0, 0, 90, 100, 100), (1, 1, "", 0.0, 0, 50, 45, 80), (1, 2, "", 0.0, 55, 50, 100, 85), (1, 3, "", 0.0, 0, 20, 45, 45), (1, 4, "", 0.0, 55, 20, 100, 48), (1, 5, "", 0.0, 0, 0, 100, 10), (None, 7, "", 0.0, 0, 0, 1, 1)]
    df = spark.createDataFrame([r[:4] + tuple(map(float, r[4:])) for r in rows], BOX)
    order = lambda out: [r.obj_id for r in out.where("page_id = 1").orderBy("place").collect()]
    assert order(layout.xy_cut(df)) == [0, 1, 2, 3, 4, 5]  # the last object keeps the columns from being cut
    assert order(layout.xy_cut(df.where("obj_id < 5"))) == [0, 1, 3, 2, 4]
    assert order(layout.two_columns(df, 100)) == [0, 1, 3, 2, 4, 5]
    assert layout.xy_cut(df).count() == 7  # a page without a number is a page
    assert [(r.row, r.place, r.obj_id) for r in layout.visual_rows(df).where("page_id = 1").orderBy("row", "place").collect()] == [(0, 0, 0), (1, 0, 1), (1, 1, 2), (2, 0, 3), (2, 1, 4), (3, 0, 5)]
    assert layout.xy_cut(df.limit(0)).count() == 0


def test_grid_of_rulings(spark):
    h = [(1, 0.0, y, 20.0, y) for y in (0.0, 20.0)] + [(1, 0.0, 10.0, 10.0, 10.0)]
    v = [(1, x, 0.0, x, 20.0) for x in (0.0, 10.0, 20.0)]
    df = spark.createDataFrame(h + v, "page_id long, x0 double, y0 double, x1 double, y1 double")
    assert sorted((r.row, r.col, r.row_span, r.col_span) for r in layout.line_grid(df).collect()) == [(0, 0, 1, 1), (0, 1, 2, 1), (1, 0, 1, 1)]


def test_regions_merge_and_slots(spark):
    df = spark.createDataFrame([(1, 0, "", 0.0, 0.0, 0.0, 5.0, 5.0), (1, 1, "", 0.0, 4.0, 4.0, 9.0, 9.0), (1, 2, "", 0.0, 50.0, 1.0, 60.0, 10.0)], BOX)
    assert sorted(tuple(r) for r in layout.merge_regions(df).collect()) == [(1, 0, 0, 60, 10)]
    cells = spark.createDataFrame([(1, 0, 0, 2, 2), (1, 0, 1, 1, 2), (1, 1, 2, 1, 1), (1, 1, 1, 2, 2)], "table_id long, row int, col int, row_span int, col_span int")
    assert sorted(tuple(r) for r in layout.resolved_slots(cells).collect()) == [(1, 0, 0, 2, 2), (1, 1, 2, 1, 1)]


def test_captions_and_notes(spark):
    texts = ["Table 3 Sales", "Figure 2. It shows that.", "(in millions)", "Source: own", "1) note", "body", "2) note", "Notes: x", "图3 销售"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, line_no int, text string")
    got = [r[0] for r in df.orderBy("line_no").select(regions.caption_kind(F.col("text"))).collect()]
    assert got == ["title", None, "unit", "source", None, None, None, "source", "title"]
    assert [r.source for r in regions.sources(df, ["doc_id"], "line_no").orderBy("line_no").collect()] == [False, False, False, True, True, False, False, True, False]


def test_footers_above_the_middle_do_not_count(spark):
    rows = [(1, 0, "footer", 0.0, 0.0, 0.0, 10.0, 20.0), (1, 1, "footer", 0.0, 0.0, 300.0, 10.0, 320.0), (1, 2, "header", 0.0, 0.0, 780.0, 10.0, 800.0), (2, 0, "text", 0.0, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, BOX)
    assert [tuple(r) for r in regions.footer_bands(df).collect()] == [(1, 0, 0, 10, 20)]
    assert [tuple(r) for r in regions.header_bands(df).collect()] == [(1, 0, 780, 10, 800)]


def test_contents(spark):
    lines = [(1, 1, 0, "Contents"), (1, 1, 1, "One ..... 3"), (1, 1, 2, "Two with a long"), (1, 1, 3, "title ..... 5"), (1, 3, 4, "x 1"), (1, 3, 5, "y 2")]
    df = spark.createDataFrame(lines, "doc_id long, page_no int, line_no long, text string")
    ref = contents.has_page_ref(F.col("text"))
    assert [tuple(r) for r in contents.contents_ranges(df, F.lit(True), ref, 2, 2).orderBy("first_page").collect()] == [(1, 1, 1), (1, 3, 3)]
    joined = contents.joined_lines(df.where("page_no = 1 and line_no > 0"), ref)
    assert [r.text for r in joined.orderBy("item").collect()] == ["One ..... 3", "Two with a long title ..... 5"]
    item = spark.range(1).select(tree.toc_item(F.lit("1.2 Long title ..... 17")).alias("t")).first().t
    assert tuple(item) == ("1.2", "Long title", 17, 2)


def test_tree(spark):
    heads = spark.createDataFrame([(1, i, s) for i, s in enumerate("ABCBAC")], "doc_id long, seq long, style string")
    assert [r.level for r in tree.infer_levels(heads).orderBy("seq").collect()] == [1, 2, 3, 2, 1, 2]
    nodes = spark.createDataFrame([(i, i - 1 if i else None) for i in range(20)], "node_id long, parent_id long")
    assert {r.node_id: r.depth for r in tree.depths(nodes).collect()} == {i: i for i in range(20)}
    assert one(spark, tree.is_ancestor(F.lit("1/4"), F.lit("1/4/9"))) and not one(spark, tree.is_ancestor(F.lit("1/4"), F.lit("1/40")))


def test_tables(spark):
    cells = spark.createDataFrame([(1, 0, 0, 1, 1, ""), (1, 1, 1, 1, 1, "a"), (1, 2, 2, 1, 1, " ")], "table_id long, row int, col int, row_span int, col_span int, text string")
    assert [tuple(r) for r in tables.strip(cells).collect()] == [(1, 0, 0, 1, 1, "a")]
    assert tuple(tables.stripped_size(cells).first()) == (1, 1, 1)
    types = [("12", "34", False), ("12", "", True), ("a", "a", False), ("", "", None), ("a", "b", None)]
    for a, b, want in types:
        kind = lambda t: F.lit("int" if t.isdigit() else "text")
        assert one(spark, tables.seam_merge(F.lit(a), F.lit(b), kind(a), kind(b), F.lit("text"))) is want


def test_lists(spark):
    assert one(spark, lists.without_first(arr(1, 2, 1, 3), arr(1, 3))) == [2, 1]
    assert one(spark, lists.replace_all(arr(1, 2, 3, 2, 4), arr(2), arr(9, 8))) == [1, 3, 9, 8, 4]
    assert one(spark, lists.replace_all(arr(1, 2), arr(7), arr(9))) == [1, 2]
    assert one(spark, lists.insert_at(arr(1, 4), 1, arr(2, 3))) == [1, 2, 3, 4]
    assert one(spark, lists.without_places(arr(5, 6, 7), [0, 2])) == [6]
    assert one(spark, lists.chunks(arr(1, 2, 3), 2)) == [[1, 2], [3]]
    assert one(spark, lists.balanced_chunks(arr(1, 2, 3, 4, 5), 3)) == [[1, 2], [3, 4], [5]]
    parts = one(spark, lists.partition(arr(1, 2, 3), lambda x: x > 1))
    assert (parts.kept, parts.removed) == ([1], [2, 3])
    assert one(spark, lists.merge_counts(F.create_map(F.lit("a"), F.lit(1)), F.create_map(F.lit("a"), F.lit(2), F.lit("b"), F.lit(5)))) == {"a": 3, "b": 5}


def test_positions_and_ligatures(spark):
    text = F.lit("　ａ b\tc")
    assert one(spark, tx.positions(text)) == [1, 3, 5]
    assert tuple(one(spark, tx.original_range(tx.positions(text), F.lit(1), F.lit(3)))) == (3, 6)
    assert one(spark, tx.original_range(tx.positions(text), F.lit(2), F.lit(9))) is None
    assert one(spark, tx.expand_ligatures(F.lit("oﬃce…"))) == "office..."
    assert one(spark, tx.to_ligature(F.lit("ffi"))) == "ﬃ" and one(spark, tx.is_ligature(F.lit("ﬁ")))
    assert one(spark, tx.split_dotted(F.lit("a.'b.c'.d"))) == ["a", "b.c", "d"]
    assert one(spark, tx.dominant_color(arr("r", "g", "g", "b"))) == "g"


def test_intervals_and_splits(spark):
    whole = spark.createDataFrame([(1, 0.0, 10.0)], "g long, lo double, hi double")
    parts = spark.createDataFrame([(1, 2.0, 3.0), (1, 2.5, 5.0), (1, 9.0, 12.0)], "g long, lo double, hi double")
    assert sorted((r.gap_start, r.gap_end) for r in sequence.subtract_intervals(whole, parts, ["g"]).collect()) == [(0, 2), (5, 9)]
    rows = spark.createDataFrame([(1, i) for i in range(10)], "g long, k long")
    split = sequence.seeded_split(rows, ["g"], "k", 0.25, 3)
    assert split.where("validation").count() == 2 and split.collect() == sequence.seeded_split(rows, ["g"], "k", 0.25, 3).collect()
    values = spark.createDataFrame([(1, float(v)) for v in (0, 6, 12, 18)], "g long, v double")
    assert sequence.cluster_by_last(values, ["g"], "v", 6).count() == 1
    assert sequence.cluster_by_first(values, ["g"], "v", 8).first().clusters == [[0, 6], [12, 18]]
    waiting = spark.createDataFrame([(i, i % 2, i) for i in range(10)], "id long, priority int, arrival long")
    assert [r.id for r in sequence.admit(waiting, {0: 1, 1: 3}, 3).collect()] == [0, 1, 3]
    assert sequence.multiset_minus(values, values.limit(1)).count() == 3


def test_quality_folds(spark):
    assert one(spark, quality.dominant_line(F.lit("a\na\na\nb\na"))) == "a"
    assert one(spark, quality.dominant_line(F.lit("a\nb"))) == "a\nb"
    assert one(spark, quality.dominant_line(F.lit("b\na\nb\na\nb\na"), share=0.5)) == "b"
    assert one(spark, quality.dominant_line(F.lit(""))) == "" and one(spark, quality.dominant_line(F.lit(None).cast("string"))) is None


def test_spatial(spark):
    objects = spark.createDataFrame([(1, 0, "", 0.0, 0.0, 0.0, 10.0, 10.0), (1, 1, "", 0.0, 20.0, 0.0, 30.0, 10.0)], BOX)
    flat = spark.createDataFrame([(1, 7, 0.0, 0.0, 0.0, 10.0)], "page_id long, region_id long, x0 double, y0 double, x1 double, y1 double")
    assert spatial.region_select(objects, flat, 0.1).count() == 0  # an empty region holds nothing
    wide = flat.withColumn("x1", F.lit(12.0))
    assert [r.obj_id for r in spatial.region_select(objects, wide, 1.0).collect()] == [0]
    assert spatial.region_select(objects, wide, 1.0, exclude=objects.limit(1)).count() == 0


def test_dimension_joins(spark):
    big = spark.range(1000).selectExpr("id", "case when id < 700 then 0 else id end as k")
    small = spark.range(1000).selectExpr("id as k", "id * 2 as v")
    assert is_small(small, 1000) and not is_small(small, 999)
    plain = sorted(map(tuple, join_dimension(big, small, ["k"]).collect()))
    assert plain == sorted(map(tuple, join_dimension(big, small, ["k"], rows=10, salts=7).select("k", "id", "v").collect()))
    plan = join_dimension(big, small, ["k"], rows=10)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan.lower()


def test_numbers_without_gaps(spark):
    rows = spark.range(2000).selectExpr("id % 700 as a", "cast(id % 3 as string) as b").repartition(7)
    got = numbered(rows, ["a", "b"], "n", first=0).orderBy("n").collect()
    assert [r.n for r in got] == list(range(len(got)))
    assert [(r.a, r.b) for r in got] == sorted({(i % 700, str(i % 3)) for i in range(2000)})
    assert numbered(rows.limit(0), ["a"], "n").count() == 0


def test_streams(spark, tmp_path):
    """Files arrive in two batches; windows and task states come out as a batch run gives them."""
    src = tmp_path / "events"
    rows = [(1, "submit", "2024-01-01 00:00:00"), (1, "start", "2024-01-01 00:01:00"), (2, "submit", "2024-01-01 00:00:00"), (1, "finish", "2024-01-01 00:02:00"), (1, "fetch", "2024-01-01 00:03:00")]
    later = [(3, "submit", "2024-01-01 02:00:00"), (4, "submit", "2024-01-01 04:00:00")]
    schema = "id long, kind string, ts timestamp"
    for n, part in enumerate((rows, later, [(5, "submit", "2024-01-01 06:00:00")])):
        spark.createDataFrame([(i, k, t) for i, k, t in part], "id long, kind string, ts string").selectExpr("id", "kind", "cast(ts as timestamp) ts").coalesce(1).write.parquet(str(src / str(n)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(src))
    q = tasks.life_cycle(stream).writeStream.format("memory").queryName("life").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {}
    for r in spark.table("life").orderBy("id", "at").collect():
        got.setdefault(r.id, []).append(r.status)
    assert got[1] == ["waiting", "running", "done", "fetched"]
    assert got[2] == ["waiting", "failed"]
    events = spark.createDataFrame([(1, 3, 10, 5), (1, 7, 10, 6)], "id long, progress long, total long, ts long")
    assert tuple(tasks.latest_progress(events).first()) == (1, 7, 10, 70.0)
