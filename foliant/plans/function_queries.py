"""Queries that apply single functions to rows of the driver's tables, with the same in SQL.

Inputs are written by one rule in Spark and in SQL; what SQL expects is stated on its own, not
made from the implementation's tables. Docstrings name the survey's operators.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import geometry as g
from foliant.functions import lists, numbers
from foliant.functions import text as tx
from foliant.operators import regions, spatial, tables, tree
from foliant.plans.box_queries import _CELLS, _cells, _pairs
from foliant.plans.shared import BOXES, LINES, boxes, lines, with_sql
from foliant.runtime import ship, table
from foliant.sources import files, markup

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_ID = ("page_id", "obj_id")
_NEXT = "FROM boxes a JOIN boxes b ON a.page_id = b.page_id AND b.obj_id = a.obj_id + 1"


def _next(s, d):
    return _pairs(s, d).where("b_obj_id = a_obj_id + 1")


def _ab():
    return spatial.box("a_"), spatial.box("b_")


def _double():
    return F.struct(*(F.col(e).cast("double").alias(e) for e in spatial.EDGES))


def _milli(c, name):
    """Thousandths as integers, so that both sides print one value."""
    return F.round(c * 1000).cast("long").alias(name)


# boxes, quads, matrices


@query(with_sql(BOXES) + f"SELECT a.page_id, a.obj_id, least(a.x0, b.x0) AS x0, least(a.y0, b.y0) AS y0, greatest(a.x1, b.x1) AS x1, greatest(a.y1, b.y1) AS y1 {_NEXT}")
def box_unions(s, d):
    """GEO-05: the box of two boxes."""
    return _next(s, d).select("page_id", F.col("a_obj_id").alias("obj_id"), g.union(*_ab()).alias("u")).select(*_ID, "u.*")


@query(with_sql(BOXES) + "SELECT kind, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM boxes GROUP BY kind")
def box_union_by_kind(s, d):
    """AGG-02, GEO-27: the box of all boxes of a group, as an aggregate."""
    return boxes(s, d).groupBy("kind").agg(g.union_agg(spatial.box()).alias("u")).select("kind", "u.*")


@query(with_sql(BOXES) + "SELECT page_id, obj_id, CASE WHEN x1 >= 50 AND y0 <= 150 THEN 50 ELSE x0 END AS x0, y0, x1, CASE WHEN x1 >= 50 AND y0 <= 150 THEN 150 ELSE y1 END AS y1 FROM boxes")
def box_adjusted(s, d):
    """GEO-11, GEO-12: edges set by name, unless they would cross."""
    return boxes(s, d).select(*_ID, g.adjust(spatial.box(), x0=50, y1=150).alias("u")).select(*_ID, "u.*")


@query(with_sql(BOXES) + "SELECT page_id, obj_id, NOT (x1 - x0 < y1 - y0) AS h, x1 - x0 < y1 - y0 AS v, x1 - x0 >= 40 AND x1 - x0 <= 160 AS medium, y1 - y0 <= 60 AS low FROM boxes")
def box_shapes(s, d):
    """GEO-13, GEO-14, GEO-16: direction and checked lengths."""
    b = spatial.box()
    return boxes(s, d).select(*_ID, g.is_h(b).alias("h"), g.is_v(b).alias("v"), g.check_length("x", b, 40, 160).alias("medium"), g.check_length("y", b, None, 60).alias("low"))


@query(with_sql(BOXES) + """SELECT page_id, obj_id, CAST(floor(x0 / 8.0) AS BIGINT) AS x0, CAST(floor(y0 / 8.0) AS BIGINT) AS y0, CAST(ceil(x1 / 8.0) AS BIGINT) AS x1, CAST(ceil(y1 / 8.0) AS BIGINT) AS y1,
  CAST(round(round_even(CAST(x0 AS DOUBLE) / 8, 1) * 10) AS BIGINT) AS tenths FROM boxes""")
def box_rounding(s, d):
    """GEO-17, GEO-18: grown to whole numbers; rounded to a digit, half to even."""
    b = F.struct(*((F.col(e) / 8.0).alias(e) for e in spatial.EDGES))
    rows = boxes(s, d).select(*_ID, g.outset(b).alias("u"), g.rounded(b).alias("r"))
    return rows.select(*_ID, *(F.col(f"u.{e}").cast("long").alias(e) for e in spatial.EDGES), F.round(F.col("r")[0] * 10).cast("long").alias("tenths"))


@query(with_sql(BOXES) + """SELECT page_id, obj_id, (x1 - x0) * (y1 - y0) AS area, x0 AS left_most, x1 + 5 AS right_most, false AS slanted_is_rect, true AS plain_is_rect,
  CAST(round(1000 * CASE WHEN x1 - x0 >= sqrt(25 + (y1 - y0) * (y1 - y0)) THEN 0 ELSE degrees(atan2(CAST(y1 - y0 AS DOUBLE), 5)) END) AS BIGINT) AS angle FROM boxes""")
def quad_metrics(s, d):
    """GEO-19 to GEO-23: a quad of a box, slanted by 5: its area, box, shape and angle."""
    slanted = F.transform(g.quad(_double()), lambda p: F.struct((p["x"] + F.when(p["y"] == F.col("y1"), 5.0).otherwise(0.0)).alias("x"), p["y"].alias("y")))
    rows = boxes(s, d).select(*_ID, slanted.alias("q"), g.quad(_double()).alias("p"))
    q = F.col("q")
    box = g.quad_bbox(q)
    return rows.select(*_ID, F.round(g.quad_area(q)).cast("long").alias("area"), box["x0"].cast("long").alias("left_most"), box["x1"].cast("long").alias("right_most"), g.quad_is_rect(q).alias("slanted_is_rect"), g.quad_is_rect(F.col("p")).alias("plain_is_rect"), _milli(g.quad_angle(q), "angle"))


@query(with_sql(BOXES) + """SELECT page_id, obj_id, 500 * (x0 + x1) + 500 * (y1 - y0) AS turned_x, 500 * (y0 + y1) - 500 * (x1 - x0) AS turned_y, 500 * (x0 + x1) - 1000 * (x1 - x0) AS wide_x, 500 * (y0 + y1) - 250 * (y1 - y0) AS wide_y FROM boxes""")
def quad_turned(s, d):
    """GEO-25, GEO-26: a quad turned by a quarter, and scaled, about its centre; the first corner."""
    q = g.quad(_double())
    rows = boxes(s, d).select(*_ID, g.quad_rotate(q, 90).alias("turned"), g.quad_scale(q, 2, 0.5).alias("wide"))
    turned, wide = F.col("turned"), F.col("wide")
    return rows.select(*_ID, _milli(turned[0]["x"], "turned_x"), _milli(turned[0]["y"], "turned_y"), _milli(wide[0]["x"], "wide_x"), _milli(wide[0]["y"], "wide_y"))


@query(with_sql(BOXES) + "SELECT page_id, obj_id, 2 AS a, 2 AS b, 0 AS c, 4 AS d, x0 + 3 AS e, x0 + y0 + 5 AS f, -2 * x0 AS inverse_e, -y0 AS inverse_f, 90000 AS quarter FROM boxes")
def matrix_products(s, d):
    """GEO-30 to GEO-33: two matrices one after the other, an inverse, a rotation and its angle."""
    m = g.matrix(2, 0, 0, 4, F.col("x0"), F.col("y0"))
    both, back = g.compose(m, g.matrix(1, 1, 0, 1, 3, 5)), g.inverse(m)
    rows = boxes(s, d).select(*_ID, both.alias("m"), back.alias("i"))
    whole = [F.col(f"m.{k}").cast("long").alias(k) for k in "abcdef"]
    return rows.select(*_ID, *whole, (F.col("i.e") * 4).cast("long").alias("inverse_e"), (F.col("i.f") * 4).cast("long").alias("inverse_f"), _milli(g.angle(g.rotation(90)), "quarter"))


@query(with_sql(BOXES) + f"SELECT a.page_id, a.obj_id, CAST(round(1000 * sqrt(CAST((a.x0 - b.x0) * (a.x0 - b.x0) + (a.y0 - b.y0) * (a.y0 - b.y0) AS DOUBLE))) AS BIGINT) AS apart {_NEXT}")
def corner_distance(s, d):
    """GEO-34: how far two points are apart."""
    a, b = _ab()
    return _next(s, d).select("page_id", F.col("a_obj_id").alias("obj_id"), _milli(g.distance(a["x0"], a["y0"], b["x0"], b["y0"]), "apart"))


_PLAIN = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
_OWN = "CAST((a.x1 - a.x0) * (a.y1 - a.y0) AS DOUBLE)"
_OTHER = "CAST((b.x1 - b.x0) * (b.y1 - b.y0) AS DOUBLE)"


@query(with_sql(BOXES) + f"SELECT a.page_id, a.obj_id, CAST(round(1000 * ({_PLAIN} / least({_OWN}, {_OTHER}))) AS BIGINT) AS small, CAST(round(1000 * ({_PLAIN} / greatest({_OWN}, {_OTHER}))) AS BIGINT) AS large, CAST(round(1000 * ({_PLAIN} / ({_OWN} + {_OTHER} - {_PLAIN}))) AS BIGINT) AS whole {_NEXT}")
def plain_overlap(s, d):
    """GEO-35: overlap over the small area, the large one and the union."""
    modes = (("small", "small"), ("large", "large"), ("union", "whole"))
    return _next(s, d).select("page_id", F.col("a_obj_id").alias("obj_id"), *(_milli(g.overlap_ratio(*_ab(), mode), name) for mode, name in modes))


@query(with_sql(BOXES) + "SELECT page_id, obj_id, CAST(round(1000 * (x0 / CAST(999 AS DOUBLE) * 600)) AS BIGINT) AS x0, CAST(round(1000 * (800 - y1 / CAST(999 AS DOUBLE) * 800)) AS BIGINT) AS y0, CAST(round(1000 * (x1 / CAST(999 AS DOUBLE) * 600)) AS BIGINT) AS x1 FROM boxes")
def from_thousandths(s, d):
    """GEO-37: boxes that a model gives in thousandths, from the top left."""
    b = g.from_thousandths(_double(), F.lit(600.0), F.lit(800.0))
    return boxes(s, d).select(*_ID, b.alias("b")).select(*_ID, *(_milli(F.col(f"b.{e}"), e) for e in ("x0", "y0", "x1")))


# texts


_WORD = "regexp_extract(text, '[A-Za-z]+', 0)"
_WORDS = f"words AS (SELECT doc_id, line_no, {_WORD} AS w, doc_id % 5 AS k FROM lines WHERE {_WORD} <> '')"


def _words(s, d):
    word = F.regexp_extract("text", "[A-Za-z]+", 0)
    return lines(s, d).select("doc_id", "line_no", word.alias("w"), F.pmod("doc_id", F.lit(5)).alias("k")).where("w <> ''")


def _case(*values):
    """One of several texts, by k."""
    out = F.lit(None).cast("string")
    for i, v in enumerate(values):
        out = F.when(F.col("k") == i, v).otherwise(out)
    return out


def _join(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


_W = F.col


@query(with_sql(LINES) + "SELECT doc_id, line_no, md5(array_to_string(list_transform(list_filter(string_split(text, ''), lambda x: x <> ''), lambda x: CASE WHEN x = ' ' THEN chr(12288) WHEN ord(x) BETWEEN 33 AND 126 THEN chr(ord(x) + 65248) ELSE x END), '')) AS digest FROM lines")
def full_widths(s, d):
    """STR-01: half-width characters as full-width ones."""
    return lines(s, d).select("doc_id", "line_no", F.md5(tx.full_width(F.col("text")).cast("binary")).alias("digest"))


@query(with_sql(LINES, _WORDS) + "SELECT doc_id, line_no, CASE k WHEN 0 THEN 'I' WHEN 1 THEN 'IV' WHEN 2 THEN 'xii' WHEN 3 THEN 'M' ELSE 'viii' END || w AS said FROM words")
def roman_characters(s, d):
    """STR-06: Roman numeral characters as letters."""
    return _words(s, d).select("doc_id", "line_no", tx.ascii_roman(F.concat(_case(*map(F.lit, "ⅠⅣⅻⅯⅷ")), "w")).alias("said"))


@query(with_sql(LINES, _WORDS) + "SELECT doc_id, line_no, w AS said FROM words")
def formulas_bared(s, d):
    """STR-14: a formula without its delimiters."""
    w = F.col("w")
    forms = _case(_join("$", w, "$"), _join("$$", w, "$$"), _join("\\[ ", w, " \\]"), _join("\\(", w, "\\)"), _join("  ", w, " "))
    return _words(s, d).select("doc_id", "line_no", tx.strip_math(forms).alias("said"))


@query(with_sql(LINES, _WORDS) + "SELECT doc_id, line_no, 'ab ' || w || '-0123456789' || '.' AS said, list_min(list_filter(range(1, length(w) + 1), lambda p: length(w) % p = 0 AND repeat(left(w, CAST(p AS INTEGER)), CAST(length(w) // p AS INTEGER)) = w)) AS unit FROM words")
def repeats_collapsed(s, d):
    """STR-15, STR-16, WIN-15: one of a unit that follows itself, and the shortest unit of a text."""
    run = _join("ab ", F.repeat(F.concat("w", F.lit("-0123456789")), F.lit(12)), ".")
    unit = tx.shortest_period(F.repeat("w", F.lit(3)))
    return _words(s, d).select("doc_id", "line_no", tx.collapse_repeats(run).alias("said"), F.length(unit).cast("long").alias("unit"))


@query(with_sql(LINES, _WORDS) + "SELECT doc_id, line_no, w AS without_page, w AS without_number FROM words")
def lines_without_numbers(s, d):
    """STR-17, STR-18: a contents line without its page, a heading without its number."""
    w = F.col("w")
    paged = _case(_join(w, " ..... 12"), _join(w, "……3"), _join(w, " (44)"), _join(w, "·····[5] "), _join(w, "  901"))
    headed = _case(_join("1. ", w), _join("1.2.3 ", w), _join("(4) ", w), _join("（五）", w), _join(" 12、", w))
    return _words(s, d).select("doc_id", "line_no", tx.strip_page_ref(paged).alias("without_page"), tx.strip_number(headed).alias("without_number"))


@query(with_sql(LINES) + r"SELECT doc_id, line_no, md5(trim(regexp_replace(text || ' ', '[\s\x0b\x1c-\x1f\x85\p{Z}]+', ' ', 'g'))) AS digest FROM lines")
def spaces_normalized(s, d):
    """STR-19: runs of white space as one space, none at the ends."""
    return lines(s, d).select("doc_id", "line_no", F.md5(tx.normalize_space(F.concat("text", F.lit(" "))).cast("binary")).alias("digest"))


@query(with_sql(LINES, _WORDS) + "SELECT doc_id, line_no, replace(w, 'e', '-') || '-' AS said FROM words")
def dashes_unified(s, d):
    """STR-21: dashes of all kinds as hyphens."""
    return _words(s, d).select("doc_id", "line_no", tx.unify_dashes(F.concat(F.replace("w", F.lit("e"), F.lit("—")), _case(*map(F.lit, "‐–−－﹣")))).alias("said"))


@query(with_sql(LINES, _WORDS) + """SELECT doc_id, line_no, w || '...' AS said, CASE k WHEN 0 THEN 'ﬁ' WHEN 1 THEN 'ﬀ' WHEN 2 THEN 'ﬃ' WHEN 3 THEN 'ﬂ' END AS joined, k < 4 AS is_one FROM words""")
def ligatures(s, d):
    """STR-23, STR-24: typographic ligatures as letters, and letters as a ligature."""
    one = _case(*map(F.lit, ("fi", "ff", "ffi", "fl", "xy")))
    split = F.replace(F.replace("w", F.lit("ffi"), F.lit("ﬃ")), F.lit("fi"), F.lit("ﬁ"))
    return _words(s, d).select("doc_id", "line_no", tx.expand_ligatures(F.concat(split, F.lit("…"))).alias("said"), tx.to_ligature(one).alias("joined"), tx.is_ligature(_case(*map(F.lit, "ﬁﬀﬃﬂx"))).alias("is_one"))


@query("SELECT doc_id, CASE WHEN n < 1024 THEN CAST(n AS VARCHAR) || ' B' WHEN n < 1048576 THEN format('{:,.1f} KB', n / CAST(1024 AS DOUBLE)) WHEN n < 1073741824 THEN format('{:,.1f} MB', n / CAST(1048576 AS DOUBLE)) ELSE format('{:,.1f} GB', n / CAST(1073741824 AS DOUBLE)) END AS said FROM (SELECT doc_id, n_chars * (CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 512 WHEN 2 THEN 65536 ELSE 4194304 END) AS n FROM documents)")
def sizes_written(s, d):
    """STR-27: bytes with a unit."""
    by = F.when(F.col("doc_id") % 4 == 0, 1).when(F.col("doc_id") % 4 == 1, 512).when(F.col("doc_id") % 4 == 2, 65536).otherwise(4194304)
    return table(s, d, "documents").select("doc_id", tx.format_size(F.col("n_chars") * by).alias("said"))


@query(with_sql(LINES, _WORDS) + "SELECT doc_id, line_no, CASE k WHEN 0 THEN w || '|b|c' WHEN 1 THEN w || '|b.c|d' WHEN 2 THEN w WHEN 3 THEN 'a|' || w || '.x' ELSE 'a|' || w END AS said FROM words")
def dotted_paths(s, d):
    """STR-28: parts of a dotted path; quotes keep dots."""
    w = F.col("w")
    paths = _case(_join(w, ".b.c"), _join(w, '."b.c".d'), w, _join("a.'", w, ".x'"), _join("a . ", w))
    return _words(s, d).select("doc_id", "line_no", F.array_join(tx.split_dotted(paths), "|").alias("said"))


@query(with_sql(LINES) + "SELECT doc_id, line_no, CASE WHEN h = 0 AND f = 0 THEN NULL WHEN h = 0 THEN f WHEN f = 0 THEN h ELSE least(h, f) END AS place FROM (SELECT doc_id, line_no, strpos(t, ':') AS h, strpos(t, '：') AS f FROM (SELECT doc_id, line_no, CASE line_no % 3 WHEN 0 THEN text WHEN 1 THEN replace(text, ' ', ':') ELSE replace(text, 'a', '：') END AS t FROM lines))")
def colon_places(s, d):
    """STR-32: the first half- or full-width colon."""
    t = F.when(F.col("line_no") % 3 == 0, F.col("text")).when(F.col("line_no") % 3 == 1, F.replace("text", F.lit(" "), F.lit(":"))).otherwise(F.replace("text", F.lit("a"), F.lit("：")))
    return lines(s, d).select("doc_id", "line_no", tx.colon_index(t).cast("long").alias("place"))


@query(with_sql(LINES, _WORDS, "i AS (SELECT doc_id, line_no, list_transform(list_filter(string_split(w, ''), lambda x: x <> ''), lambda x: ascii(x) % 4) AS ids FROM words)") + "SELECT doc_id, line_no, array_to_string(list_transform(list_filter(range(1, len(ids) + 1), lambda i: ids[i] <> 0 AND (i = 1 OR ids[i] <> ids[i - 1])), lambda i: ids[i]), ',') AS said FROM i")
def ctc_collapsed(s, d):
    """STR-36: greedy decoding: repeats go, then blanks."""
    ids = F.transform(F.filter(F.split("w", ""), lambda x: x != ""), lambda x: F.ascii(x) % 4)
    return _words(s, d).select("doc_id", "line_no", ids.alias("ids")).select("doc_id", "line_no", F.array_join(tx.collapse_ctc(F.col("ids")), ",").alias("said"))


_SPACE = r"'^[\s\x0b\x1c-\x1f\x85\p{Z}]$'"


@query(with_sql(LINES, f"p AS (SELECT doc_id, line_no, list_filter(range(length(text)), lambda i: NOT regexp_matches(substr(text, CAST(i + 1 AS INTEGER), 1), {_SPACE})) AS ps FROM lines)") + 'SELECT doc_id, line_no, CASE WHEN len(ps) >= 5 THEN ps[3] END AS "start", CASE WHEN len(ps) >= 5 THEN ps[5] + 1 END AS "end" FROM p')
def original_ranges(s, d):
    """STR-03, STR-04: where a range of the canonical text stands in the original."""
    found = tx.original_range(tx.positions(F.col("text")), F.lit(2), F.lit(5))
    return lines(s, d).select("doc_id", "line_no", found.alias("f")).select("doc_id", "line_no", F.col("f.start").cast("long").alias("start"), F.col("f.end").cast("long").alias("end"))


@query(with_sql(LINES, _WORDS) + "SELECT doc_id, line_no, k < 2 AS valid FROM words")
def valid_characters(s, d):
    """PRJ-06: neither the replacement character nor private use."""
    return _words(s, d).select("doc_id", "line_no", tx.valid_char(F.concat("w", _case(*map(F.lit, ("a", "é", "�", "", ""))))).alias("valid"))


@query(with_sql(BOXES, "k AS (SELECT page_id, obj_id, ['text', 'table', 'header', 'footer', 'figure', 'code', 'title'][1 + (x0 + y0) % 7] AS t, CASE WHEN x0 % 3 = 0 THEN 'header_image' WHEN x0 % 3 = 1 THEN 'image' END AS raw FROM boxes)") + "SELECT page_id, obj_id, t NOT IN ('table', 'figure') AS is_text, t = 'header' OR (raw IS NOT NULL AND raw = 'header_image') AS is_header FROM k")
def region_kinds(s, d):
    """PRJ-03, PRJ-04: types that hold text, and headers by type or raw type."""
    kinds = F.array(*map(F.lit, ("text", "table", "header", "footer", "figure", "code", "title")))
    kind = F.element_at(kinds, (1 + (F.col("x0") + F.col("y0")) % 7).cast("int"))
    raw = F.when(F.col("x0") % 3 == 0, "header_image").when(F.col("x0") % 3 == 1, "image")
    return boxes(s, d).select(*_ID, kind.alias("t"), raw.alias("raw")).select(*_ID, regions.is_text(F.col("t")).alias("is_text"), regions.is_header(F.col("t"), F.col("raw")).alias("is_header"))


@query(with_sql(LINES, "t AS (SELECT doc_id, line_no, length(text) % 4 AS k FROM lines)", "o AS (SELECT *, max(CASE WHEN k = 3 THEN line_no END) OVER w AS other, max(CASE WHEN k = 0 THEN line_no END) OVER w AS last FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))") + "SELECT doc_id, line_no, coalesce(last > coalesce(other, -1), false) AS source FROM o")
def source_lines(s, d):
    """PRJ-05: source lines, and numbered notes that follow them without a break."""
    k = F.length("text") % 4
    said = F.when(k == 0, "Source: a").when(k == 1, "1. a note").when(k == 2, "[2] a note").otherwise("other words")
    return regions.sources(lines(s, d).select("doc_id", "line_no", said.alias("text")), ["doc_id"], "line_no").select("doc_id", "line_no", "source")


# lists and counts


_LISTS = "l AS (SELECT page_id, list(x0 % 7 ORDER BY obj_id) AS a FROM boxes GROUP BY page_id)"


def _lists(s, d):
    items = F.transform(F.array_sort(F.collect_list(F.struct("obj_id", (F.col("x0") % 7).alias("v")))), lambda x: x["v"])
    return boxes(s, d).groupBy("page_id").agg(items.alias("a"))


def _said(c):
    return F.array_join(c, ",")


@query(with_sql(BOXES, _LISTS) + """SELECT page_id, array_to_string(list_filter(a, lambda x: x % 2 = 0), ',') AS kept, array_to_string(list_filter(a, lambda x: x % 2 = 1), ',') AS removed,
  array_to_string(list_concat(list_concat(a[:2], [100, 200]), a[3:]), ',') AS inserted, array_to_string(list_transform(list_filter(range(1, len(a) + 1), lambda i: i NOT IN (1, 3)), lambda i: a[i]), ',') AS popped FROM l""")
def list_edits(s, d):
    """SET-05, SET-07, SET-08, SET-09: split by a test, insertion, removal by place."""
    a, long = F.col("a"), lambda *v: F.array(*(F.lit(x).cast("long") for x in v))
    parts = lists.partition(a, lambda x: x % 2 == 1)
    return _lists(s, d).select("page_id", _said(parts["kept"]).alias("kept"), _said(parts["removed"]).alias("removed"), _said(lists.insert_at(a, 2, long(100, 200))).alias("inserted"), _said(lists.without_places(a, [0, 2])).alias("popped"))


@query(with_sql(BOXES, _LISTS, "p AS (SELECT page_id, a, list_max(list_filter(range(1, len(a) + 1), lambda i: a[i] IN (1, 2, 3))) AS z FROM l)") + "SELECT page_id, array_to_string(CASE WHEN z IS NULL THEN a ELSE list_concat(list_concat(list_filter(a[:z], lambda x: x NOT IN (1, 2, 3)), [9, 8]), list_filter(a[z + 1:], lambda x: x NOT IN (1, 2, 3))) END, ',') AS replaced FROM p")
def list_replaced(s, d):
    """SET-06: values taken out, others put where the last of them stood."""
    long = lambda *v: F.array(*(F.lit(x).cast("long") for x in v))
    return _lists(s, d).select("page_id", _said(lists.replace_all(F.col("a"), long(1, 2, 3), long(9, 8))).alias("replaced"))


@query(with_sql(BOXES, "v AS (SELECT page_id, obj_id, x0 % 7 AS v, row_number() OVER (PARTITION BY page_id, x0 % 7 ORDER BY obj_id) AS n FROM boxes)") + "SELECT page_id, coalesce(string_agg(CAST(v AS VARCHAR), ',' ORDER BY obj_id) FILTER (WHERE n > CASE v WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END), '') AS rest FROM v GROUP BY page_id")
def list_difference(s, d):
    """SET-04: a multiset difference that keeps the order."""
    return _lists(s, d).select("page_id", _said(lists.without_first(F.col("a"), F.array(*(F.lit(x).cast("long") for x in (0, 0, 1))))).alias("rest"))


@query(with_sql(BOXES) + "SELECT page_id, obj_id, k, sum(v) AS n FROM (SELECT page_id, obj_id, unnest(['x', 'y', 'y', 'z']) AS k, unnest([x0, y0, x1, y1]) AS v FROM boxes) GROUP BY 1, 2, 3")
def counts_merged(s, d):
    """AGG-07: two maps of counts as one of sums."""
    one, two = F.create_map(F.lit("x"), "x0", F.lit("y"), "y0"), F.create_map(F.lit("y"), "x1", F.lit("z"), "y1")
    return boxes(s, d).select(*_ID, F.explode(lists.merge_counts(one, two)).alias("k", "n"))


@query(with_sql(BOXES, "c AS (SELECT page_id, x0 % 5 AS v, count(*) AS n FROM boxes GROUP BY 1, 2)") + "SELECT page_id, arg_max(v, n * 10 - v) AS color FROM c GROUP BY page_id")
def dominant_colors(s, d):
    """AGG-15: the most common value, the smallest of equals."""
    return boxes(s, d).groupBy("page_id").agg(F.collect_list(F.col("x0") % 5).alias("c")).select("page_id", tx.dominant_color(F.col("c")).alias("color"))


# numbers


@query("SELECT doc_id, 1 + doc_id % 9999 AS by_unit, 1 + doc_id % 9999 AS in_a_row, NULL AS other FROM documents".replace("NULL", "CAST(NULL AS BIGINT)"))
def chinese_numbers(s, d):
    """NUM-01, NUM-02, NUM-07, NUM-08: Chinese and Japanese numerals, with units and digit by digit."""
    n = (1 + F.col("doc_id") % 9999).cast("int")
    digit = lambda v: F.substring(F.lit("一二三四五六七八九"), v.cast("int"), F.lit(1))
    place = lambda power, unit: F.when(F.floor(n / power) % 10 > 0, F.concat(digit(F.floor(n / power) % 10), F.lit(unit))).otherwise("")
    zero = F.when((n > 100) & (n % 100 < 10) & (n % 100 > 0), "零").otherwise("")
    by_unit = F.concat(place(1000, "千"), place(100, "百"), zero, place(10, "十"), place(1, ""))
    row = F.translate(n.cast("string"), "0123456789", "〇一二三四五六七八九")
    value = lambda c: numbers.chinese_value(c).cast("long")
    return table(s, d, "documents").select("doc_id", value(by_unit).alias("by_unit"), value(row).alias("in_a_row"), value(F.concat(row, F.lit("x"))).alias("other"))


@query("SELECT doc_id, 1 + doc_id % 26 + 26 * (doc_id % 3) AS letters, CASE WHEN doc_id % 26 = 0 THEN 1 ELSE -1 END AS mixed, 1 + doc_id % 20 AS circled, 1 + doc_id % 20 AS bracketed FROM documents")
def letter_and_symbol_numbers(s, d):
    """NUM-10, NUM-11, NUM-18: letters, repeated ones count on; circled and bracketed numbers."""
    letter = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (1 + F.col("doc_id") % 26).cast("int"), F.lit(1))
    repeated = F.repeat(letter, (1 + F.col("doc_id") % 3).cast("int"))
    mixed = F.when(F.col("doc_id") % 26 == 0, F.lit("a")).otherwise(F.concat(F.lit("a"), letter))
    nth = lambda chars: F.substring(F.lit(chars), (1 + F.col("doc_id") % 20).cast("int"), F.lit(1))
    symbols = (("circled", "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"), ("bracketed", "⑴⑵⑶⑷⑸⑹⑺⑻⑼⑽⑾⑿⒀⒁⒂⒃⒄⒅⒆⒇"))
    return table(s, d, "documents").select("doc_id", numbers.alpha_value(repeated).cast("long").alias("letters"), numbers.alpha_value(mixed).cast("long").alias("mixed"), *(numbers.symbol_value(nth(c)).cast("long").alias(n) for n, c in symbols))


@query(with_sql(LINES, _WORDS) + "SELECT doc_id, line_no, k IN (0, 2, 4) AS roman FROM words")
def roman_checked(s, d):
    """NUM-12: numerals that are written right."""
    return _words(s, d).select("doc_id", "line_no", numbers.is_roman(_case(*map(F.lit, ("xiv", "IIII", "MCMXCIX", "VX", "d")))).alias("roman"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN a WHEN 1 THEN a || '.' || b ELSE a || '.' || b || '.' || a END AS said, doc_id % 3 + 1 AS level, CAST(CASE doc_id % 3 WHEN 1 THEN b ELSE a END AS BIGINT) AS value FROM (SELECT doc_id, CAST(doc_id % 12 AS VARCHAR) AS a, CAST(n_chars % 40 AS VARCHAR) AS b FROM documents)")
def section_numbers(s, d):
    """NUM-06, NUM-15: the dotted number that a heading begins with, its level and last value."""
    a, b, k = (F.col("doc_id") % 12).cast("string"), (F.col("n_chars") % 40).cast("string"), F.col("doc_id") % 3
    head = F.when(k == 0, a).when(k == 1, F.concat_ws(".", a, b)).otherwise(F.concat_ws(".", a, b, a))
    rows = table(s, d, "documents").select("doc_id", numbers.section_number(F.concat(F.lit(" "), head, F.lit(" Title 7"))).alias("n"))
    return rows.select("doc_id", F.col("n.text").alias("said"), F.col("n.level").cast("long").alias("level"), F.col("n.value").cast("long").alias("value"))


@query(with_sql(BOXES) + "SELECT page_id, obj_id, x0 * 12700 AS emu, y0 * 72 AS pt, x1 * 20 AS twips, y1 * 10 AS mm FROM boxes")
def lengths_converted(s, d):
    """NUM-23, NUM-24: lengths between units."""
    to = (("x0", "pt", "emu", "emu"), ("y0", "inch", "pt", "pt"), ("x1", "pt", "twip", "twips"), ("y1", "cm", "mm", "mm"))
    return boxes(s, d).select(*_ID, *(F.round(numbers.convert_length(F.col(c), a, b)).cast("long").alias(n) for c, a, b, n in to))


# tables, trees, sources


@query(with_sql(BOXES, _CELLS) + "SELECT table_id, \"row\" - 2 AS \"row\", col, text, CASE WHEN \"row\" - 2 < 1 THEN 'header' ELSE 'body' END AS part FROM cells WHERE \"row\" >= 2 AND \"row\" < 4")
def table_rows(s, d):
    """TAB-03, TAB-06, TAB-08: some rows of each table, numbered anew, with header and body."""
    return tables.set_header(tables.select_rows(_cells(s, d), 2, 4), 1).select("table_id", "row", "col", "text", "part")


_OTSL = """SELECT doc_id AS table_id, r AS "row", c AS col, rs AS row_span, cs AS col_span, CASE n WHEN 0 THEN w WHEN 1 THEN 'two' WHEN 2 THEN '' WHEN 3 THEN 'wide ' || w END AS text FROM (SELECT doc_id, w, unnest([0, 0, 0, 1]) AS r, unnest([0, 1, 2, 1]) AS c, unnest([2, 1, 1, 1]) AS rs, unnest([1, 1, 1, 2]) AS cs, unnest([0, 1, 2, 3]) AS n FROM words WHERE line_no = 0)"""


@query(with_sql(LINES, _WORDS) + _OTSL)
def otsl_tables(s, d):
    """SRC-20, TAB-42, TAB-43: tables in OTSL; the first row is padded."""
    ship(s)
    text = _join("<fcel>", F.col("w"), "<fcel>two<nl><ucel><fcel>wide ", F.col("w"), "<lcel><nl>")
    return markup.cells(_words(s, d).where("line_no = 0").select(F.col("doc_id").alias("table_id"), text.alias("text")), markup.otsl_cells)


@query(with_sql(LINES, _WORDS) + """SELECT doc_id AS table_id, r AS "row", c AS col, rs AS row_span, cs AS col_span, CASE n WHEN 0 THEN w WHEN 1 THEN 'a & b' ELSE 'last' END AS text FROM (SELECT doc_id, w, unnest([0, 0, 1]) AS r, unnest([0, 1, 1]) AS c, unnest([2, 1, 1]) AS rs, unnest([1, 2, 1]) AS cs, unnest([0, 1, 2]) AS n FROM words WHERE line_no = 0)""")
def html_tables(s, d):
    """SRC-19: tables in HTML; a slot that a span takes is skipped."""
    ship(s)
    text = _join('<table><tr><td rowspan="2">', F.col("w"), '</td><th colspan="2">a &amp; b</th></tr><tr><td>last</td></tr></table>')
    return markup.cells(_words(s, d).where("line_no = 0").select(F.col("doc_id").alias("table_id"), text.alias("text")), markup.html_cells)


@query("SELECT a.o_orderkey AS one, b.o_orderkey AS other FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND CAST(b.o_orderkey AS VARCHAR) LIKE CAST(a.o_orderkey AS VARCHAR) || '%'")
def ancestor_paths(s, d):
    """TRE-05: paths that lie below another one; a path is the digits of a key."""
    orders = table(s, d, "orders")
    path = F.array_join(F.filter(F.split(F.col("o_orderkey").cast("string"), ""), lambda x: x != ""), "/")
    a = orders.select("o_custkey", F.col("o_orderkey").alias("one"), path.alias("p"))
    b = orders.select("o_custkey", F.col("o_orderkey").alias("other"), path.alias("q"))
    return a.join(b, "o_custkey").where(tree.is_ancestor(F.col("p"), F.col("q"))).select("one", "other")


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'png' WHEN 2 THEN 'jpg' WHEN 3 THEN 'jpg' WHEN 4 THEN 'bmp' END AS filetype FROM documents")
def file_types(s, d):
    """SRC-02: types by first bytes, then by suffix."""
    k = F.col("doc_id") % 6
    heads = F.when(k == 0, F.unhex(F.lit("255044462D312E37"))).when(k == 1, F.unhex(F.lit("89504E470D0A1A0A"))).when(k == 2, F.unhex(F.lit("FFD8FFE000104A46"))).otherwise(F.lit("plain").cast("binary"))
    paths = F.when(k == 3, "/a/b.JPEG").when(k == 4, "/a.x/c.bmp").when(k == 5, "/a/d.txt").otherwise("/a/e")
    return table(s, d, "documents").select("doc_id", files.file_type(heads, paths).alias("filetype"))


@query("SELECT conv_id // 10 AS doc, turn AS page_no, conv_id % 2 = 0 AS pending FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id // 10, turn ORDER BY conv_id) AS n FROM conversations WHERE turn < 3) WHERE n = 1")
def pages_pending(s, d):
    """PRJ-02, SRC-03: the wanted pages that exist, and which are not done yet."""
    turns = table(s, d, "conversations").where("turn < 5").groupBy(F.floor(F.col("conv_id") / 10).alias("doc"), F.col("turn").alias("page_no")).agg(F.min("conv_id").alias("c"))
    wanted = turns.where("page_no < 3").select("doc", "page_no").unionByName(turns.limit(0).select("doc", "page_no"))
    return files.select_pages(turns, wanted, turns.where("c % 2 = 1")).select("doc", "page_no", "pending")
