"""Column functions on hand-made values."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from foliant.functions import geometry as g
from foliant.functions import numbers as num
from foliant.functions import text as tx


def one(spark, column, value=None):
    return spark.range(1).select(F.lit(value).alias("v")).select(column(F.col("v")) if callable(column) else column).first()[0]


@pytest.mark.parametrize(("f", "given", "want"), [
    (tx.half_width, "ＡＢ１！　x", "AB1! x"), (tx.full_width, "A 1", "Ａ　１"), (tx.canonical, " Ａ　b\tc\n", "Abc"), (tx.normalize_space, "　a \t b\n", "a b"),
    (tx.unify_dashes, "a—b–c−d", "a-b-c-d"), (tx.ascii_roman, "Ⅳ、ⅸ", "IV、ix"), (tx.content_length, " a b　c ", 3), (tx.content_length, "", 0),
    (tx.md_escape, "a*b_[c](d)#", r"a\*b\_\[c\](d)\#"), (tx.md_unescape, "## **bold** *it* ~~no~~ `code` [link](u) \\*", "bold it no code link *"),
    (tx.strip_math, "$$ x^2 $$", "x^2"), (tx.strip_math, r"\(a\)", "a"), (tx.strip_math, "no $x$ math", "no $x$ math"), (tx.valid_char, "a", True), (tx.valid_char, "", False), (tx.valid_char, "�", False),
    (tx.shortest_period, "abcabcabc", "abc"), (tx.shortest_period, "abcab", None), (lambda c: tx.collapse_repeats(c, 2, 3), "x" + "ab" * 5 + "y", "xaby"),
    (tx.strip_page_ref, "Chapter one ....... 12", "Chapter one"), (tx.strip_number, "1.2.3 Title", "Title"), (tx.strip_number, "(三) 标题", "标题"), (tx.colon_index, "键：值", 2), (tx.colon_index, "none", None),
    (tx.format_size, 512, "512 B"), (tx.format_size, 2048, "2.0 KB"), (tx.format_size, 5 * 1024**2, "5.0 MB"), (lambda c: tx.truncate_middle(c, 6, "~"), "abcdefghij", "abcd~ij"), (lambda c: tx.truncate_middle(c, 10, "~"), "abcdefghij", "abcdefghij"),
    (num.roman_value, "MCMXCIV", 1994), (num.roman_value, "iv", 4), (num.is_roman, "IIII", False), (num.is_roman, "XL", True), (num.chinese_value, "二十三", 23), (num.chinese_value, "十", 10), (num.chinese_value, "三百零五", 305), (num.chinese_value, "二〇二四", 2024), (num.chinese_value, "x", None),
    (num.alpha_value, "a", 1), (num.alpha_value, "AA", 27), (num.alpha_value, "ab", -1), (num.alpha_value, "1", None), (num.symbol_value, "⑳", 20), (num.symbol_value, "⑴", 1), (num.symbol_value, "x", None), (num.dotted_level, "1.2.3", 3),
    (num.page_numbers, "1-3,5,2", [1, 2, 3, 5]), (num.page_numbers, "", []), (num.priority, 500, 3), (num.priority, 19, 0), (num.style_rank, "dotted3", 5), (num.style_rank, "?", 10),
    (lambda c: num.convert_length(c, "inch", "pt"), 2.0, 144.0), (lambda c: num.convert_length(c, "cm", "mm"), 1.5, 15.0),
])
def test_text_and_numbers(spark, f, given, want):
    got = one(spark, f, given)
    assert got == pytest.approx(want) if isinstance(want, float) else got == want


def test_matches(spark):
    rules = [("number", r"^\d+$"), ("word", r"[a-z]"), ("any", ".")]
    assert [one(spark, lambda c: tx.first_match(c, rules, "none"), v) for v in ("12", "1a", "?", "")] == ["number", "word", "any", "none"]
    assert [one(spark, lambda c: tx.any_match(c, ["a+", "b"], whole=True), v) for v in ("aa", "ab", "b")] == [True, False, True]
    assert one(spark, tx.key_value, "Name： Ann") == ("Name", "Ann")
    assert one(spark, tx.key_value, "a, b: c") is None
    assert one(spark, num.section_number, " 3.1.4 Title") == ("3.1.4", ["3", "1", "4"], 3, 4)
    assert spark.sql("select array(1,1,0,1,2,2,0) a").select(tx.collapse_ctc(F.col("a"))).first()[0] == [1, 1, 2]
    pairs = [("In tro", "Intro"), ("1.2 Intro", "Intro"), ("#Intro", "Intro"), ("Xntroduction", "Introduction"), ("Introd", "Introduction"), ("1. Introduction all", "2. Introduction"), ("The Intro", "Intro"), ("", "Intro")]
    scores = [spark.createDataFrame([(a, b)], "a string, b string").select(tx.title_forms(F.col("a")).alias("a"), tx.title_forms(F.col("b")).alias("b")).select(tx.title_score(F.col("a"), F.col("b"))).first()[0] for a, b in pairs]
    assert scores == [100, 95, 92, 90, 85, 80, 0, 0]


def box(*edges):
    return g.bbox(*map(F.lit, edges))


def test_boxes(spark):
    assert tuple(one(spark, box(10, 20, 5, 0))) == (5, 0, 10, 20)
    assert one(spark, g.area2(box(0, 0, 0, 10))) == 10
    assert one(spark, g.intersect(box(0, 0, 5, 5), box(6, 6, 9, 9))) is None
    assert tuple(one(spark, g.intersect(box(0, 0, 5, 5), box(5, 0, 9, 9)))) == (5, 0, 5, 5)
    assert one(spark, g.intersects(box(0, 0, 5, 5), box(5, 5, 9, 9)))
    assert one(spark, g.iou(box(0, 0, 2, 2), box(1, 0, 3, 2))) == pytest.approx(1 / 3)
    assert one(spark, g.contained_ratio(box(0, 0, 10, 10), box(5, 0, 15, 10))) == pytest.approx(0.5)
    assert one(spark, g.overlap_ratio(box(0, 0, 5, 5), box(5, 0, 9, 5))) == 0
    assert tuple(one(spark, g.expand(box(0, 0, 10, 4), -3, -3))) == (3, 0, 7, 4)
    assert tuple(one(spark, g.adjust(box(0, 0, 10, 4), x0=20))) == (0, 0, 10, 4)
    assert [tuple(b) for b in one(spark, g.split("x", box(0, 0, 10, 4), [1, 3, 1]))] == [(0, 0, 2, 4), (2, 0, 8, 4), (8, 0, 10, 4)]
    assert one(spark, g.rounded(box(0.25, 0.35, 1.05, 2.0))) == [0.2, 0.4, 1.1, 2.0] or one(spark, g.rounded(box(0.25, 0.75, 1.5, 2.0)))[:2] == [0.2, 0.8]
    assert tuple(one(spark, g.outset(box(0.2, 0.8, 1.1, 2.0)))) == (0, 0, 2, 2)
    assert one(spark, g.over("x", box(0, 0, 10, 1), box(8, 0, 20, 1), 2, 2)) and not one(spark, g.over("x", box(0, 0, 10, 1), box(9, 0, 20, 1), 2, 2))
    assert tuple(one(spark, g.flip(box(1, 2, 3, 4), F.lit(10), 2, 2))) == (2, 12, 6, 16)
    df = spark.createDataFrame([(0, 0, 1, 1), (5, -2, 6, 3)], "x0 int, y0 int, x1 int, y1 int")
    assert tuple(df.agg(g.union_agg(F.struct("x0", "y0", "x1", "y1"))).first()[0]) == (0, -2, 6, 3)
    assert df.limit(0).agg(g.union_agg(F.struct("x0", "y0", "x1", "y1"))).first()[0] is None


def test_matrices_and_quads(spark):
    m = g.matrix(*map(F.lit, (2.0, 0.0, 0.0, 3.0, 5.0, 7.0)))
    assert tuple(one(spark, g.compose(m, g.inverse(m)))) == pytest.approx((1, 0, 0, 1, 0, 0))
    assert tuple(one(spark, g.transform(box(0.0, 0.0, 1.0, 1.0), m))) == (5, 7, 7, 10)
    assert abs(one(spark, g.angle(g.rotation(30)))) == pytest.approx(30)
    q = g.quad(box(0.0, 0.0, 4.0, 2.0))
    assert one(spark, g.quad_area(q)) == 8 and one(spark, g.quad_is_rect(q))
    turned = g.quad_rotate(q, 90)
    assert one(spark, g.quad_area(turned)) == pytest.approx(8)
    assert tuple(one(spark, g.quad_bbox(turned))) == pytest.approx((1, -1, 3, 3))
    assert tuple(one(spark, g.quad_bbox(g.quad_scale(q, 0.5, 2)))) == pytest.approx((1, -1, 3, 3))
    assert one(spark, g.distance(F.lit(0.0), F.lit(0.0), F.lit(3.0), F.lit(4.0))) == 5
    assert math.isclose(one(spark, g.quad_angle(q)) % 180, 0, abs_tol=1e-9)
