"""Queries over the structure of pages, contents and tables, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import geometry as g
from foliant.functions import lists
from foliant.functions import text as tx
from foliant.operators import contents, layout, quality, regions, sequence, spatial, tables, tree
from foliant.plans.box_queries import _CELLS, _cells, _fold
from foliant.plans.shared import BOXES, COMMON, LINES, area2, boxes, lines, md5, with_sql
from foliant.plans.text_queries import _HEADS, _heads
from foliant.runtime import ship, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Boxes with a type: the line's status and flag stand for header, footer and others.
_TYPED = "typed AS (SELECT page_id, obj_id, CASE kind WHEN 'A' THEN 'header' WHEN 'R' THEN 'footer' ELSE 'text' END AS kind, x0, y0, x1, y1 FROM boxes)"
_PAGED = "paged AS (SELECT *, min(x0) OVER w AS px0, min(y0) OVER w AS py0, max(x1) OVER w AS px1, max(y1) OVER w AS py1 FROM typed WINDOW w AS (PARTITION BY page_id))"


def _typed(s, d):
    kind = F.when(F.col("kind") == "A", "header").when(F.col("kind") == "R", "footer").otherwise("text")
    return boxes(s, d).withColumn("kind", kind)


@query(with_sql(BOXES, _TYPED, _PAGED, "m AS (SELECT *, (x1 - x0) * (y1 - y0) > 0.3 * (px1 - px0) * (py1 - py0) AS large FROM paged)") + "SELECT page_id, obj_id FROM (SELECT *, count(*) FILTER (WHERE NOT large) OVER (PARTITION BY page_id) AS k FROM m) WHERE NOT large OR k = 0")
def large_boxes_dropped(s, d):
    return regions.without_large(_typed(s, d), 0.3).select("page_id", "obj_id")


_HEADER = "band AS (SELECT page_id, min(px0) AS x0, min(CASE WHEN kind = 'header' AND py1 - y1 <= 120 THEN y0 END) AS y0, max(px1) AS x1, max(py1) AS y1 FROM paged GROUP BY 1)"
_FOOTER = "band AS (SELECT page_id, min(px0) AS x0, min(py0) AS y0, max(px1) AS x1, max(CASE WHEN kind = 'footer' AND y1 - py0 <= least(200, (py1 - py0) / 2) THEN y1 END) AS y1 FROM paged GROUP BY 1)"


@query(with_sql(BOXES, _TYPED, _PAGED, _HEADER) + "SELECT * FROM band WHERE y0 IS NOT NULL")
def page_headers(s, d):
    return regions.header_bands(_typed(s, d))


@query(with_sql(BOXES, _TYPED, _PAGED, _FOOTER) + "SELECT * FROM band WHERE y1 IS NOT NULL")
def page_footers(s, d):
    return regions.footer_bands(_typed(s, d))


@query(with_sql(BOXES, _TYPED, _PAGED, _HEADER) + f"SELECT b.page_id, b.obj_id FROM band a JOIN typed b ON a.page_id = b.page_id AND a.y0 IS NOT NULL WHERE ({COMMON}) / {area2('b')} >= 0.5")
def header_objects(s, d):
    typed = _typed(s, d)
    return regions.absorbed(typed, regions.header_bands(typed))


@query(with_sql(BOXES, _TYPED, _PAGED) + "SELECT page_id, obj_id FROM paged WHERE y1 - y0 <= 30 AND y0 <= py0 + 0.28 * (py1 - py0) AND x1 - x0 >= 20 AND x1 - x0 <= 0.75 * (px1 - px0)")
def footnote_rules(s, d):
    return regions.footnote_rules(_typed(s, d)).select("page_id", "obj_id")


_COLUMNS = "cols AS (SELECT page_id, unnest([1, 2]) AS column_no, unnest([px0, (px0 + px1) / 2]) AS x0, min(py0) AS y0, unnest([(px0 + px1) / 2, px1]) AS x1, max(py1) AS y1 FROM paged GROUP BY page_id, px0, px1)"


@query(with_sql(BOXES, _TYPED, _PAGED, _COLUMNS) + f"SELECT b.page_id, b.obj_id, min(CASE WHEN ({COMMON}) / {area2('b')} >= 0.8 THEN column_no END) AS column_no FROM typed b JOIN cols a ON a.page_id = b.page_id GROUP BY 1, 2")
def column_of(s, d):
    typed = _typed(s, d)
    p = regions.page_boxes(typed)
    half = (F.col("p_x0") + F.col("p_x1")) / 2
    both = F.explode(F.array(F.struct(F.lit(1).alias("column_no"), F.col("p_x0").cast("double").alias("x0"), half.alias("x1")), F.struct(F.lit(2).alias("column_no"), half.alias("x0"), F.col("p_x1").cast("double").alias("x1"))))
    columns = p.select("page_id", F.col("p_y0").alias("y0"), F.col("p_y1").alias("y1"), both.alias("c")).select("page_id", "c.*", "y0", "y1")
    return regions.column_of(typed, columns)


@query(with_sql(BOXES, "r AS (SELECT *, sum(CASE WHEN y0 - p <= 10 THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY y0, obj_id) AS rw FROM (SELECT *, lag(y0) OVER (PARTITION BY page_id ORDER BY y0, obj_id) AS p FROM boxes))") + 'SELECT page_id, obj_id, CAST(rw AS BIGINT) AS "row", row_number() OVER (PARTITION BY page_id, rw ORDER BY x0, obj_id) AS place FROM r')
def reading_rows(s, d):
    return regions.reading_rows(boxes(s, d)).select("page_id", "obj_id", F.col("row").cast("long").alias("row"), F.col("place").cast("long").alias("place"))


_CAPTIONED = "texts AS (SELECT page_id, obj_id, CASE obj_id % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'unit' ELSE 'source' END AS kind, x0, y0, x1, y1 FROM boxes)"


@query(with_sql(BOXES, _CAPTIONED, "f AS (SELECT a.page_id, a.obj_id, t.obj_id AS text_id, t.kind, CASE WHEN t.kind = 'source' THEN a.y0 - t.y1 ELSE t.y0 - a.y1 END AS gap FROM boxes a JOIN texts t ON a.page_id = t.page_id AND a.obj_id <> t.obj_id AND a.x0 < t.x1 AND t.x0 < a.x1)",
  "w AS (SELECT *, count(*) FILTER (WHERE kind = 'title') OVER (PARTITION BY page_id, obj_id) AS titles FROM f WHERE gap BETWEEN 0 AND 50)") + "SELECT page_id, obj_id, text_id, kind, gap FROM w WHERE kind <> 'unit' OR titles > 0")
def caption_candidates(s, d):
    b = boxes(s, d)
    n = F.col("obj_id") % 3
    return regions.candidates(b, b.withColumn("kind", F.when(n == 0, "title").when(n == 1, "unit").otherwise("source")))


_CAPTION = rf"CASE WHEN regexp_matches(text, '{regions.UNIT}') THEN 'unit' WHEN regexp_matches(text, '{regions.SOURCE}') THEN 'source' WHEN regexp_matches(text, '{'|'.join(f'(?:{p})' for _, p in regions.TITLES)}') AND NOT regexp_matches(text, '[.;]\s*$') THEN 'title' END"


@query(with_sql(LINES) + f"SELECT coalesce(k, 'none') AS kind, count(*) AS n FROM (SELECT {_CAPTION} AS k FROM lines) GROUP BY 1")
def caption_kinds(s, d):
    return lines(s, d).select(F.coalesce(regions.caption_kind(F.col("text")), F.lit("none")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query(with_sql(BOXES, "c AS (SELECT page_id, obj_id, x0, x0 - lag(x0) OVER (PARTITION BY page_id ORDER BY x0) > 20 AS n FROM boxes)", "k AS (SELECT *, sum(CASE WHEN coalesce(n, true) THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY x0) AS c FROM c)")
  + "SELECT page_id, obj_id, round(avg(x0) OVER (PARTITION BY page_id, c), 4) AS x0 FROM k")
def snapped_edges(s, d):
    cells = boxes(s, d).select(F.col("page_id").alias("table_id"), "obj_id", F.col("x0").cast("double").alias("x0"))
    return tables.snapped(cells, "x0", 20).select(F.col("table_id").alias("page_id"), "obj_id", F.round("x0", 4).alias("x0"))


_PLACED = 'placed AS (SELECT page_id AS table_id, CAST((obj_id - 1) // 3 AS INTEGER) AS "row", CAST((obj_id - 1) % 3 AS INTEGER) AS col, x0, x1 FROM boxes)'
_AXES = "axes AS (SELECT table_id, col, coalesce((lag(hi) OVER w + lo) / 2, lo) AS x0, coalesce((hi + lead(lo) OVER w) / 2, hi) AS x1 FROM (SELECT table_id, col, min(x0) AS lo, max(x1) AS hi FROM placed GROUP BY 1, 2) WINDOW w AS (PARTITION BY table_id ORDER BY col))"


def _placed(s, d):
    n = F.col("obj_id") - 1
    return boxes(s, d).select(F.col("page_id").alias("table_id"), F.floor(n / 3).cast("int").alias("row"), (n % 3).cast("int").alias("col"), "x0", "x1")


@query(with_sql(BOXES, _PLACED, _AXES) + "SELECT * FROM axes")
def shared_edges(s, d):
    out = tables.shared_edges(_placed(s, d))
    return out.select("table_id", "col", F.col("x0").cast("double").alias("x0"), F.col("x1").cast("double").alias("x1"))


@query(with_sql(BOXES, _PLACED, _AXES) + "SELECT table_id, bool_and(greatest(0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) >= 0.8 * (c.x1 - c.x0)) AS fits FROM placed c JOIN axes a USING (table_id, col) GROUP BY 1")
def aligned_tables(s, d):
    placed = _placed(s, d)
    return tables.aligned(placed, tables.shared_edges(placed))


@query(with_sql(BOXES, _CELLS, 'slots AS (SELECT table_id, r, unnest(range(col, col + col_span)) AS c, text, row_span, col_span FROM (SELECT *, unnest(range("row", "row" + row_span)) AS r FROM cells))')
  + """SELECT table_id, "rows", cols FROM (SELECT table_id, count(*) FILTER (WHERE h) AS "rows" FROM (SELECT table_id, r, bool_or(text <> '' OR row_span > 1) AS h FROM slots GROUP BY 1, 2) GROUP BY 1)
JOIN (SELECT table_id, count(*) FILTER (WHERE h) AS cols FROM (SELECT table_id, c, bool_or(text <> '' OR col_span > 1) AS h FROM slots GROUP BY 1, 2) GROUP BY 1) USING (table_id)""")  # fmt: skip
def stripped_size(s, d):
    return tables.stripped_size(_cells(s, d))


@query(with_sql(BOXES, _CELLS) + 'SELECT table_id, "row", col FROM cells WHERE "row" <= 1 AND "row" + row_span > 1 AND col <= 2 AND col + col_span > 2')
def cell_at(s, d):
    return tables.cell_at(_cells(s, d), 1, 2).select("table_id", "row", "col")


@query(with_sql(BOXES, _CELLS) + 'SELECT table_id, count(*) FILTER (WHERE "row" < 2) AS head, count(*) FILTER (WHERE "row" >= 2) AS body, count(*) FILTER (WHERE "row" < 2 AND "row" + row_span > 2) AS cut FROM cells GROUP BY 1')
def table_split(s, d):
    parts = zip(("head", "body", "cut"), tables.split_at(_cells(s, d), 2), strict=True)
    head, body, cut = (df.select("table_id", F.lit(n).alias("part")) for n, df in parts)
    every = head.unionByName(body).unionByName(cut)
    return every.groupBy("table_id").agg(*(F.count_if(F.col("part") == n).alias(n) for n in ("head", "body", "cut")))


_SEAM = "seam AS (SELECT page_id, page_id // 4 AS chain, obj_id, x0, x1, kind || CAST(obj_id % 2 AS VARCHAR) AS text, lead_page FROM (SELECT *, max(page_id) OVER (PARTITION BY page_id // 4) AS lead_page FROM boxes))"


@query(with_sql(BOXES, _SEAM) + """SELECT a.chain, a.page_id, a.obj_id, b.page_id AS next_page, b.obj_id AS next_obj,
  CASE WHEN a.text = b.text OR left(a.text, 1) <> left(b.text, 1) THEN false END AS merged
FROM seam a JOIN seam b ON a.chain = b.chain AND a.page_id < b.page_id AND abs(a.x0 - b.x0) <= 5 AND abs(a.x1 - b.x1) <= 5""")  # fmt: skip
def seam_pairs(s, d):
    rows = boxes(s, d).select(F.floor(F.col("page_id") / 4).alias("chain"), "page_id", "obj_id", "x0", "x1", F.concat("kind", (F.col("obj_id") % 2).cast("string")).alias("text"))
    found = tables.seam_pairs(rows, rows, ["chain"]).where("a_page_id < b_page_id")
    kind = lambda c: F.left(c, F.lit(1))
    merged = tables.seam_merge(F.col("a_text"), F.col("b_text"), kind(F.col("a_text")), kind(F.col("b_text")), F.lit("text"))
    return found.select("chain", F.col("a_page_id").alias("page_id"), F.col("a_obj_id").alias("obj_id"), F.col("b_page_id").alias("next_page"), F.col("b_obj_id").alias("next_obj"), merged.alias("merged"))


@query(with_sql(BOXES) + "SELECT page_id, max(abs((y1 - y0) - m)) AS spread FROM (SELECT *, median(y1 - y0) OVER (PARTITION BY page_id) AS m FROM boxes) GROUP BY 1")
def height_spread(s, d):
    return quality.spread(boxes(s, d).withColumn("h", F.col("y1") - F.col("y0")), "page_id", "h")


@query(with_sql(BOXES, "i AS (SELECT page_id, y0, x0 AS lo, x1 AS hi, sum(CASE WHEN x0 <= e + 3 THEN 0 ELSE 1 END) OVER (PARTITION BY page_id, y0 ORDER BY x0, x1) AS island FROM (SELECT page_id, y0, x0, x1, max(x1) OVER (PARTITION BY page_id, y0 ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM boxes))")
  + "SELECT page_id, y0, CAST(island AS BIGINT) AS island, count(*) AS n, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY 1, 2, 3")
def joined_rulings(s, d):
    return sequence.merge_intervals(boxes(s, d), ["page_id", "y0"], "x0", "x1", 3)


@query(with_sql(BOXES) + "SELECT page_id, obj_id, part, round(x0 + (x1 - x0) * (part / 4.0), 4) AS lo, round(x0 + (x1 - x0) * ((part + CASE part WHEN 0 THEN 1 ELSE 3 END) / 4.0), 4) AS hi FROM boxes, (SELECT unnest([0, 1]) AS part)")
def bbox_split(s, d):
    parts = boxes(s, d).select("page_id", "obj_id", F.posexplode(g.split("x", spatial.box(), [1, 3])).alias("part", "b"))
    return parts.select("page_id", "obj_id", "part", F.round("b.x0", 4).alias("lo"), F.round("b.x1", 4).alias("hi"))


@query(with_sql(BOXES) + "SELECT page_id, obj_id, round(least(greatest((x0 - 10) / 0.5, 0), 640), 4) AS x0, round(least(greatest((y1 - 20) / 0.5, 0), 480), 4) AS y1 FROM boxes")
def unletterboxed(s, d):
    b = g.unletterbox(spatial.box(), F.lit(0.5), F.lit(10), F.lit(20), F.lit(640.0), F.lit(480.0))
    return boxes(s, d).select("page_id", "obj_id", b.alias("b")).select("page_id", "obj_id", F.round("b.x0", 4).alias("x0"), F.round("b.y1", 4).alias("y1"))


@query(with_sql(LINES) + r"SELECT doc_id, line_no, md5(array_to_string(list_filter(range(length(text)), lambda i: NOT regexp_matches(substr(text, CAST(i + 1 AS INTEGER), 1), '^[ \t\n\r\f\x0b\x1c-\x1f\x85\xa0\x{2028}\x{2029}\x{3000}\x{2000}-\x{200a}\x{202f}\x{205f}\x{1680}]$')), ',')) AS digest FROM lines")
def text_positions(s, d):
    places = F.array_join(tx.positions(F.col("text")).cast("array<string>"), ",")
    return lines(s, d).select("doc_id", F.col("line_no").cast("long").alias("line_no"), places.alias("t")).select("doc_id", "line_no", md5("t"))


@query(with_sql(LINES) + r"SELECT doc_id, line_no, trim(left(text, place - 1)) AS k, md5(trim(substr(text, place + 1))) AS digest FROM (SELECT *, instr(text, ':') AS place FROM lines) WHERE place > 1 AND length(trim(left(text, place - 1))) BETWEEN 1 AND 24 AND NOT regexp_matches(trim(left(text, place - 1)), '[,;。，；]')")
def key_values(s, d):
    kv = tx.key_value(F.col("text"))
    return lines(s, d).select("doc_id", F.col("line_no").cast("long").alias("line_no"), kv.alias("kv")).where("kv is not null").select("doc_id", "line_no", F.col("kv.key").alias("k"), F.md5(F.col("kv.value").cast("binary")).alias("digest"))


_ITEM = r"regexp_matches(text, '[0-9]')"


@query(with_sql(LINES, f"p AS (SELECT doc_id, page_no FROM lines GROUP BY 1, 2 HAVING count(*) FILTER (WHERE {_ITEM}) >= 1 AND count(*) FILTER (WHERE length(text) > 20) >= 2)", "k AS (SELECT *, page_no - row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS k FROM p)") + "SELECT doc_id, min(page_no) AS first_page, max(page_no) AS last_page FROM k GROUP BY doc_id, k")
def contents_ranges(s, d):
    return contents.contents_ranges(lines(s, d), F.col("text").rlike("[0-9]"), F.length("text") > 20, items=1, refs=2)


@query(with_sql(LINES, r"e AS (SELECT *, coalesce(sum(CASE WHEN regexp_matches(text, '[.!?]\s*$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS item FROM lines)") + "SELECT doc_id, CAST(item AS BIGINT) AS item, min(line_no) AS first_line, md5(string_agg(text, ' ' ORDER BY line_no)) AS digest FROM e GROUP BY 1, 2")
def wrapped_lines(s, d):
    rows = lines(s, d).withColumn("line_no", F.col("line_no").cast("long"))
    return contents.joined_lines(rows, F.col("text").rlike(r"[.!?]\s*$")).select("doc_id", "item", "first_line", md5("text"))


_NUMBERED = "(level % 2 = 0)"


@query(with_sql(LINES, _HEADS) + f"SELECT doc_id, seq, CASE WHEN {_NUMBERED} THEN level + coalesce(max(CASE WHEN NOT {_NUMBERED} THEN 1 END) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE 1 END AS level FROM heads")
def unnumbered_levels(s, d):
    heads = _heads(s, d)[0]
    return contents.below_unnumbered(heads, F.col("level") % 2 == 0, F.col("level")).select("doc_id", "seq", "level")


@query(with_sql(LINES, _HEADS) + "SELECT doc_id, seq, EXISTS (SELECT 1 FROM heads o WHERE o.doc_id = h.doc_id AND o.seq < h.seq AND length(o.title) = length(h.title) - 1) AS seen FROM heads h")
def number_before(s, d):
    n = F.length("title")
    return contents.seen_before(_heads(s, d)[0], n - 1, n).select("doc_id", "seq", "seen")


_BACK = "w AS (SELECT doc_id, seq, max(CASE WHEN level = 1 THEN seq END) OVER b AS hit, max(CASE WHEN level = 2 THEN seq END) OVER b AS stop FROM heads WINDOW b AS (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))"


@query(with_sql(LINES, _HEADS, _BACK) + "SELECT doc_id, seq, CASE WHEN hit > coalesce(stop, -1) THEN hit END AS parent FROM w")
def compact_parent(s, d):
    heads = _heads(s, d)[0]
    return contents.look_back(heads, F.col("level") == 1, F.col("level") == 2).select("doc_id", "seq", "parent")


_RANGES = 'r AS (SELECT doc_id, seq AS start, coalesce(lead(seq) OVER (PARTITION BY doc_id ORDER BY seq) - 1, last) AS "end" FROM heads JOIN ends USING (doc_id) WHERE level = 1)'


@query(with_sql(LINES, _HEADS, _RANGES) + 'SELECT l.doc_id, r.start AS chapter, count(*) AS lines FROM lines l LEFT JOIN r ON l.doc_id = r.doc_id AND l.line_no BETWEEN r.start AND r."end" GROUP BY 1, 2')
def chapter_lines(s, d):
    heads, ends = _heads(s, d)
    rows = lines(s, d).select("doc_id", F.col("line_no").cast("long").alias("seq"))
    found = contents.attach(rows, tree.chapter_ranges(heads.where("level = 1"), ends))
    return found.groupBy("doc_id", "chapter").agg(F.count("*").alias("lines"))


@query(with_sql(LINES, _HEADS) + "SELECT doc_id, md5(string_agg(repeat('#', CAST(level AS INTEGER)) || ' ' || title, chr(10) || chr(10) ORDER BY seq)) AS digest FROM heads GROUP BY 1")
def tree_markdown(s, d):
    rows = _heads(s, d)[0].withColumn("body", F.lit(""))
    return tree.tree_markdown(rows).select("doc_id", md5("markdown"))


@query("SELECT doc_id, len(ls) AS headings, md5(array_to_string(ls, '|')) AS digest FROM (SELECT doc_id, list_filter(list_transform(string_split('# ' || replace(text, chr(10), chr(10) || '## '), chr(10)), lambda x: regexp_extract(x, '^#{1,6}[ \\t\\n\\f\\r\\x0b]+(.*)$', 1)), lambda x: true) AS ls FROM documents WHERE text IS NOT NULL)")
def markdown_headings(s, d):
    md = F.concat(F.lit("# "), F.replace("text", F.lit("\n"), F.lit("\n## ")))
    found = tree.markdown_headings(md)
    docs = table(s, d, "documents").where("text is not null").select("doc_id", found.alias("h"))
    return docs.select("doc_id", F.size("h").cast("long").alias("headings"), F.md5(F.array_join(F.transform("h", lambda h: h["title"]), "|").cast("binary")).alias("digest"))


@query(with_sql(LINES, "p AS (SELECT doc_id, page_no, count(*) AS n FROM lines GROUP BY 1, 2)") + "SELECT doc_id, page_no, n > a AND a >= coalesce(b, 0) AS pattern FROM (SELECT *, lead(n) OVER w AS a, lead(n, 2) OVER w AS b FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY page_no)) WHERE a IS NOT NULL")
def page_pattern(s, d):
    w = W.partitionBy("doc_id").orderBy("page_no")
    p = lines(s, d).groupBy("doc_id", "page_no").agg(F.count("*").alias("n"))
    p = p.withColumns({"a": F.lead("n").over(w), "b": F.lead("n", 2).over(w)}).where("a is not null")
    return p.select("doc_id", "page_no", ((F.col("n") > F.col("a")) & (F.col("a") >= F.coalesce("b", F.lit(0)))).alias("pattern"))


_ISSUES = "issues AS (SELECT doc_id, 'short' AS issue FROM documents WHERE length(text) < 200 UNION ALL SELECT doc_id, 'loud' FROM documents WHERE contains(text, '!!') UNION ALL SELECT doc_id, 'other' FROM documents WHERE source IS NULL OR lang = 'de')"


@query(with_sql(_ISSUES) + "SELECT doc_id, greatest(0, 100 - sum(CASE issue WHEN 'short' THEN 60 WHEN 'loud' THEN 50 ELSE 0 END)) AS score FROM (SELECT DISTINCT * FROM issues) GROUP BY 1")
def issue_score(s, d):
    docs = table(s, d, "documents")
    found = [("short", F.length("text") < 200), ("loud", F.contains("text", F.lit("!!"))), ("other", F.col("source").isNull() | (F.col("lang") == "de"))]
    issues = docs.select("doc_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in found]))).alias("issue"))
    return quality.rule_score(issues, {"short": 60, "loud": 50})


@query("SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(CASE WHEN epoch(ts) - epoch(p) < 1800 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY user_id, k")
def event_sessions(s, d):
    w = F.session_window("ts", "30 minutes")
    return table(s, d, "events").groupBy(w, "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


@query("SELECT user_id AS id, max_by(event_type, {'t': ts, 'e': event_id}) AS status FROM events GROUP BY 1")
def latest_state(s, d):
    return table(s, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))


@query("SELECT event_type AS status, count(*) AS n, min(event_id) AS oldest FROM events GROUP BY 1")
def queue_state(s, d):
    return table(s, d, "events").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"), F.min("event_id").alias("oldest"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id), doc_id) <= least(greatest(round(count(*) OVER (PARTITION BY lang) * 0.2), 1), count(*) OVER (PARTITION BY lang) - 1) AS validation FROM documents")
def seeded_split(s, d):
    return sequence.seeded_split(table(s, d, "documents").select("doc_id", "lang"), ["lang"], "doc_id", 0.2, 7).select("doc_id", "validation")


@query("SELECT conv_id, (count(*) + 2) // 3 AS chunks, CAST(count(*) - 3 * ((count(*) + 2) // 3 - 1) AS INTEGER) AS last_size FROM conversations GROUP BY 1")
def turn_chunks(s, d):
    turns = table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("t"))
    parts = turns.select("conv_id", lists.chunks(F.col("t"), 3).alias("c"))
    return parts.select("conv_id", F.size("c").cast("long").alias("chunks"), F.size(F.element_at("c", -1)).alias("last_size"))


@query(_fold("(x1 - x0) * (y1 - y0) DESC, obj_id", "len(list_filter(r.kept, lambda m: greatest(0, least(m.x1, o.x1) - greatest(m.x0, o.x0)) * greatest(0, least(m.y1, o.y1) - greatest(m.y0, o.y0)) >= 0.7 * CAST((o.x1 - o.x0) * (o.y1 - o.y0) AS DOUBLE))) = 0"))
def contained_suppression(s, d):
    ship(s)
    return layout.without_contained(boxes(s, d))


#: Cells of a table in order; each takes the largest free rectangle at its corner, of equals the flattest.
_PLACED = f"""WITH RECURSIVE {BOXES}, {_CELLS},
o AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY "row", col) AS k FROM cells),
h AS (SELECT table_id, k, unnest(range(1, row_span + 1)) AS h FROM o), w AS (SELECT table_id, k, h, unnest(range(1, col_span + 1)) AS w FROM h JOIN o USING (table_id, k)),
s AS (SELECT table_id, k, h * w AS area, h, w, list_sort(list_distinct(flatten(list_transform(range(o."row", o."row" + h), lambda y: list_transform(range(o.col, o.col + w), lambda x: y * 1000 + x))))) AS slots FROM w JOIN o USING (table_id, k)),
c AS (SELECT table_id, k, list({{'area': area, 'h': h, 'w': w, 'slots': slots}} ORDER BY area DESC, h DESC, w DESC) AS options FROM s GROUP BY 1, 2),
r AS (SELECT table_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS h, CAST(NULL AS BIGINT) AS w FROM o WHERE k = 1
  UNION ALL SELECT table_id, k, CASE WHEN z IS NULL THEN taken ELSE list_concat(taken, z.slots) END, z.h, z.w
  FROM (SELECT c.table_id, c.k, r.taken, list_filter(c.options, lambda p: NOT list_has_any(p.slots, r.taken))[1] AS z FROM r JOIN c ON c.table_id = r.table_id AND c.k = r.k + 1))
SELECT r.table_id, o."row", o.col, r.h AS row_span, r.w AS col_span FROM r JOIN o USING (table_id, k) WHERE r.h IS NOT NULL"""


@query(_PLACED)
def slot_overlaps(s, d):
    ship(s)
    return layout.resolved_slots(_cells(s, d))


@query(with_sql(BOXES) + "SELECT page_id, kind, count(*) AS n, sum(CAST((x1 - x0) * (y1 - y0) AS BIGINT)) AS area FROM boxes GROUP BY 1, 2")
def object_stats(s, d):
    return boxes(s, d).groupBy("page_id", "kind").agg(F.count("*").alias("n"), F.sum(g.area(spatial.box())).alias("area"))
