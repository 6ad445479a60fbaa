"""Seams of tables that go on over pages: which parts join, which cells face each other, and which
of those are one cell. (TAB-38, TAB-39, JON-15, JON-17, JON-18, WIN-11)

The verdict of each case on each pair of facing cells is a column expression; Catalyst looks at them in
order up to the first that decides. What a case leaves open may follow a neighbour; this depends on
the order of cases and cells, and is a fold over a seam's few pairs, of many seams together.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions.numbers import CELL_TYPES
from foliant.functions.text import any_match, first_match
from foliant.grouped import fold_groups

SERIAL = r"^([0-9]+|第[0-9]+项)$"
PERCENT = r"^-?[0-9.]+%$"
GROUPED = r"^-?\d{1,3}(,\d{3})*(\.\d+)?$"
NOTHING = ("-", "--", "/")


def join_mode(a_width: Column, b_width: Column, a_page: Column, b_page: Column, a_page_width: Column, b_page_width: Column, same_section: Column, a_column: Column, b_column: Column, columns: Column, a_top: Column, b_top: Column) -> Column:
    """no, page, column or page_column: how a table may go on in the next one. (JON-15)

    ``same_section``: of one page, the sections are one; of two pages, they are alike. Columns are
    numbered from 0, null outside of all; ``a_top`` and ``b_top`` are the tops of the two columns.
    """
    placed = a_column.isNotNull() & b_column.isNotNull() & same_section & (F.abs(a_width - b_width) < 10)
    beside = (a_page == b_page) & (a_column + 1 == b_column) & (b_top > a_top - 30)
    turned = (a_page + 1 == b_page) & (F.abs(a_page_width - b_page_width) < 5)
    return (
        F.when(~F.coalesce(placed, F.lit(False)), "no")
        .when(beside, "column")
        .when(turned & (a_column == 0) & (b_column == 0), "page")
        .when(turned & (a_column + 1 == columns) & (b_column == 0), "page_column")
        .otherwise("no")
    )


def join_score(aligned: Column, shared_header: Column) -> Column:
    """1 for tables that are aligned and share a header, 0.5 without one, -1 for others. (WIN-11)"""
    return F.when(~aligned, -1.0).when(shared_header, 1.0).otherwise(0.5)


def is_continued(text: Column) -> Column:
    """A line that may stand between two parts of a table. (WIN-11)"""
    return text.rlike("^(续表|注:.+)$")


def one_to_many(upper: DataFrame, lower: DataFrame, within: float = 5) -> DataFrame:
    """seam, upper, lower, n: each lower cell with the upper cell that it lies under, and how many do. (JON-18)

    ``upper`` and ``lower`` have (seam, place, x0, x1), measured from their tables' left edges. A
    seam is left out altogether unless every cell of both rows takes part, and every upper cell
    is filled from edge to edge.
    """
    named = lambda df, side: df.select("seam", F.lit(side).alias("side"), "place", "x0", "x1")
    return facing(named(upper, 0).unionByName(named(lower, 1)), within)


def facing(cells: DataFrame, within: float = 5) -> DataFrame:
    """``one_to_many`` of the cells of both rows in one table (seam, side, place, x0, x1); side 0 is the upper row.

    Windows by seam: each lower cell sees the upper row as an array, and no pairs of cells are made.
    """
    seam = W.partitionBy("seam")
    above = F.col("side") == 0
    row = F.collect_list(F.when(above, F.struct(F.col("place").alias("upper"), F.col("x0").alias("a0"), F.col("x1").alias("a1")))).over(seam)
    # a lower cell that fits under two goes to the first
    fits = F.filter("row", lambda u: (F.col("x0") >= u["a0"] - within) & (F.col("x1") <= u["a1"] + within))
    met = cells.where("seam is not null").withColumn("row", row).where(~above & (F.size("row") > 0))
    met = met.select("seam", F.col("place").alias("lower"), F.col("x0").alias("b0"), F.col("x1").alias("b1"), F.size("row").alias("uppers"), F.array_min(fits).alias("u"))
    met = met.select("seam", "lower", "b0", "b1", "uppers", "u.*")
    group = W.partitionBy("seam", "upper", "a0", "a1")
    own, before = F.struct("lower", "b0", "b1"), group.orderBy("lower", "b0", "b1")
    # of cells that are there twice, one
    met = met.withColumn("again", F.coalesce(F.lag(own).over(before) == own, F.lit(False))).where("not again")
    met = met.withColumns({"n": F.count("*").over(group), "lo": F.min("b0").over(group), "hi": F.max("b1").over(group), "first": F.row_number().over(before) == 1})
    filled = F.col("upper").isNotNull() & (F.col("lo") <= F.col("a0")) & (F.col("hi") >= F.col("a1"))
    whole = {"covered": F.count_if("first").over(seam), "ok": F.bool_and(filled).over(seam)}
    return met.withColumns(whole).where("ok and covered = uppers").select("seam", "upper", "lower", "n")


def header_verdicts(matches: DataFrame) -> DataFrame:
    """Add ``merged`` to rows of ``one_to_many`` where the first part is one row of header: a lower cell
    goes on from an upper one that it fills alone. (TAB-39, header)"""
    return matches.withColumn("merged", F.col("n") == 1)


def _fraction(c: Column) -> Column:
    """Number of decimals of a grouped number, null for other texts."""
    return F.when(c.rlike(GROUPED), F.greatest(F.length(F.regexp_extract(c, r"(\.\d+)$", 1)) - 1, F.lit(0)))


def verdicts() -> list[tuple[str, Column]]:
    """Of each case, in order, whether it makes the cells a (above) and b (below) one; null leaves it open.

    Reads, with the prefixes a_ and b_: text (without white space), row_span, col_span, rows (of
    the table), whole (spans all columns), layout, blank (holds nothing), figure (holds pictures
    only), left, right, above and below (room around the content, null without), others (texts
    of the column's other cells), blanks (the column has another blank cell), phrase (a known
    phrase); and b_gaps (the column of b counts up with blanks between), near_start, serial and
    item (the column is one of the first two, is headed by a serial number, by an item), both_phrase.
    """
    a, b = F.col("a_text"), F.col("b_text")
    both, texts = F.concat(a, b), (a != "") & (b != "")
    a_type, b_type = first_match(a, CELL_TYPES), first_match(b, CELL_TYPES)
    typed = lambda c: any_match(c, [p for _, p in CELL_TYPES])
    known = F.array_union("a_others", "b_others")
    full = lambda *names: F.greatest(*(F.col(n) for n in names))
    spans = (F.col("a_row_span") > 1) | (F.col("b_row_span") > 1)
    yes, no = F.lit(True), F.lit(False)
    return [
        ("layout", F.when(F.col("a_layout") & F.col("b_layout") & (F.col("a_col_span") == 1) & (F.col("b_col_span") == 1), yes)),
        ("rows", F.when(F.col("a_whole") & F.col("b_whole") & texts & (F.col("a_right") >= 20) & (F.col("b_right") >= 20), no)),
        (
            "serial",
            F.when(
                F.col("serial") | F.col("near_start"),
                F.when(a.rlike(SERIAL) & b.rlike(SERIAL), no)
                .when(a.rlike(SERIAL) & F.col("b_blank"), F.when(~F.col("b_gaps"), yes))
                .when(~F.col("a_blank") & ~F.col("b_blank") & both.rlike(SERIAL), yes),
            ),
        ),
        ("equal", F.when((a == b) & texts, no)),
        (
            "number",
            F.when(
                texts,
                F.when(_fraction(both) == 2, a != "-")
                .when(a.rlike(PERCENT) & b.rlike(PERCENT), no)
                .when(a.rlike(GROUPED) & b.rlike(GROUPED), no)  # whatever their decimals
                .when((a.rlike(GROUPED) & b.isin(*NOTHING)) | (b.rlike(GROUPED) & a.isin(*NOTHING)), no),
            ),
        ),
        ("recurs", F.when(texts, F.when(F.array_contains(known, both), yes).when(F.array_contains(known, b) | F.array_contains(known, a), no))),
        ("type", F.when(texts, F.when(typed(a) & (a_type == b_type), no).when(typed(both), yes).when(typed(a) | typed(b), no))),
        ("phrase", F.when(texts & F.col("item"), F.when(F.col("both_phrase"), yes).when(F.col("a_phrase") & F.col("b_phrase"), no))),
        ("picture", F.when((a != "") & ~F.col("a_figure") & (b == "") & F.col("b_figure"), no)),
        ("spans", F.when((F.col("a_row_span") > 1) & (F.col("b_row_span") > 1) & ~F.col("a_blank") & ~F.col("b_blank"), F.coalesce(F.col("b_below") >= F.col("b_above") + 10, no))),
        (
            "blank",
            F.when((a != "") & (b == "") & spans, yes)
            .when(~F.col("a_blank") & F.col("b_blank") & ~F.col("a_blanks") & ~F.col("b_blanks"), yes)
            .when((F.col("a_rows") == 1) & F.col("a_blank") & F.col("b_blank"), yes),
        ),
        ("pictures", F.when(F.col("a_figure") & F.col("b_figure"), no)),
        ("room", F.when(texts & F.col("a_right").isNotNull() & F.col("b_right").isNotNull(), F.when((F.col("a_row_span") == 1) & (F.col("a_right") >= 20), no).when((F.col("b_row_span") == 1) & (F.col("b_above") >= 10) & (F.col("b_below") >= 10), no))),
        ("top", F.when(texts & (full("a_left", "a_right", "a_above", "a_below") <= 6) & (F.col("b_above") <= 5) & (F.col("b_below") >= 20), yes)),
    ]


CASES = ["layout", "rows", "serial", "equal", "number", "recurs", "type", "phrase", "picture", "spans", "blank", "pictures", "room", "top"]


def settled(first: np.ndarray, like_left: np.ndarray, like_right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each pair of a seam is one cell, and what decided: a case, a neighbour, or the rest.

    A row of each array is a seam, all of one length. ``first`` has twice the number of the first case that
    decides a pair, and 1 more if it merges; -1 where none does. ``like_left`` and ``like_right`` tell whether
    the rows next to the seam put a pair and its neighbour side by side in the same way.
    """
    n = first.shape[1]
    merged, by = np.full(first.shape, -1), np.full(first.shape, "rest", object)
    for k, name in enumerate(CASES):
        new = (merged < 0) & (first >> 1 == k)
        merged[new], by[new] = first[new] & 1, name
        for i in range(n):
            for beside, like in ((i - 1, like_left), (i + 1, like_right)):
                if 0 <= beside < n:
                    takes = (merged[:, i] < 0) & like[:, i] & (merged[:, beside] >= 0)
                    merged[takes, i], by[takes, i] = merged[takes, beside], "neighbour"
        if (merged >= 0).all():
            break
    rest = (merged == 1).any(1, keepdims=True)
    return np.where(merged < 0, rest, merged == 1), by


def cascade(pairs: DataFrame) -> DataFrame:
    """seam, place, merged, decided_by of each pair of facing cells. (TAB-39, TAB-41)

    ``pairs`` has seam, place (the order along the seam), like_left, like_right, a_header (the first
    part is but a header) and what ``verdicts`` reads. Under a header nothing merges.

    A pair's later verdicts count for nothing once a case has decided it, so they aren't looked at.
    """
    first = F.coalesce(*(v.cast("int") + 2 * k for k, (_, v) in enumerate(verdicts())), F.lit(-1))
    marked = pairs.select("seam", "place", "like_left", "like_right", "a_header", first.alias("first"))

    def together(p):
        yes = {c: np.asarray(p[c] == True, bool) for c in ("like_left", "like_right", "a_header")}  # noqa: E712 (nulls are no)
        merged, by = settled(p["first"], yes["like_left"], yes["like_right"])
        header = yes["a_header"].any(1)
        merged[header], by[header] = False, "header"
        return np.ones(merged.shape, bool), {"merged": merged, "decided_by": by}

    def fold(p):
        _, more = together({c: v[None, :] for c, v in p.items()})
        return range(len(p["first"])), {c: v[0].tolist() for c, v in more.items()}

    return fold_groups(marked, "seam", ["place"], ["first", "like_left", "like_right", "a_header"], ["seam", "place"], fold, {"merged": "boolean", "decided_by": "string"}, together)


def merged_rows(upper: DataFrame, lower: DataFrame, decided: DataFrame) -> DataFrame:
    """Cells of both parts as one table: seam, row, col, row_span, col_span, text. (TAB-38)

    ``upper`` and ``lower`` have (seam, row, col, row_span, col_span, text); rows of the lower part go on
    after the upper one's. ``decided`` (seam, a_col, b_col, merged) has the facing cells of the last row
    and the first one: a lower cell that is one with an upper cell gives it its text and rows.
    """
    height = upper.groupBy("seam").agg(F.max(F.col("row") + F.col("row_span")).alias("__h"))
    pairs = decided.where("merged").select("seam", "a_col", "b_col")
    low = lower.join(height, "seam", "left").withColumn("__h", F.coalesce("__h", F.lit(0)))
    first = low.where("row = 0").select("seam", F.col("col").alias("b_col"), F.col("text").alias("__t"), F.col("row_span").alias("__s"))
    more = pairs.join(first, ["seam", "b_col"]).groupBy("seam", F.col("a_col").alias("col")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b_col", "__t"))), lambda x: x["__t"]), "").alias("__t"), F.max("__s").alias("__s"))
    last = F.col("row") + F.col("row_span") == F.col("__h")
    up = upper.join(height, "seam").join(more, ["seam", "col"], "left")
    grown = last & F.col("__s").isNotNull()
    up = up.select("seam", "row", "col", F.when(grown, F.col("row_span") + F.col("__s")).otherwise(F.col("row_span")).alias("row_span"), "col_span", F.when(grown, F.concat("text", "__t")).otherwise(F.col("text")).alias("text"))
    gone = pairs.select("seam", F.col("b_col").alias("col"), F.lit(0).alias("row"))
    down = low.join(gone, ["seam", "row", "col"], "left_anti").select("seam", (F.col("row") + F.col("__h")).alias("row"), "col", "row_span", "col_span", "text")
    return up.unionByName(down)
