"""Queries over what goes on from page to page, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import numbers as num
from foliant.functions import text as tx
from foliant.operators import flow, repeats, spatial, tree
from foliant.plans.shared import BOXES, LINES, boxes, lines, md5, with_sql
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


_TABLES = "tables AS (SELECT page_id // 16 AS chain_group, page_id, min(x0) AS x0, max(x1) AS x1 FROM boxes GROUP BY 1, 2)"


@query(with_sql(BOXES, _TABLES, "j AS (SELECT *, coalesce(page_id - lag(page_id) OVER w BETWEEN 0 AND 1 AND abs(lag(x0) OVER w - x0) < 60 AND abs(lag(x1) OVER w - x1) < 60, false) AS j FROM tables WINDOW w AS (PARTITION BY chain_group ORDER BY page_id))")
  + "SELECT chain_group, page_id, CAST(sum(CASE WHEN j THEN 0 ELSE 1 END) OVER (PARTITION BY chain_group ORDER BY page_id) AS BIGINT) AS chain FROM j")
def table_chains(s, d):
    t = spatial.page_union(boxes(s, d)).select(F.floor(F.col("page_id") / 16).alias("chain_group"), "page_id", "x0", "x1")
    return flow.table_chains(t, "chain_group", "page_id", "page_id", 60).select("chain_group", "page_id", "chain")


_FIRST_CELLS = "first AS (SELECT page_id, obj_id, CASE WHEN x0 % 5 = 0 THEN '' WHEN x0 % 5 = 1 THEN 'a' ELSE CAST(obj_id AS VARCHAR) END AS text FROM boxes)"


@query(with_sql(BOXES, _FIRST_CELLS) + """SELECT page_id, obj_id, CASE WHEN lag(text) OVER o IS NULL THEN false WHEN regexp_matches(text, '^[0-9]+$') THEN false
  ELSE text = '' OR count(*) FILTER (WHERE regexp_matches(text, '^[0-9]+$')) OVER p * 2 > count(*) OVER p END AS merged FROM first WINDOW o AS (PARTITION BY page_id ORDER BY obj_id), p AS (PARTITION BY page_id)""")
def serial_seams(s, d):
    r = F.col("x0") % 5
    cells = boxes(s, d).select("page_id", "obj_id", F.when(r == 0, "").when(r == 1, "a").otherwise(F.col("obj_id").cast("string")).alias("text"))
    return flow.serial_seams(cells, "page_id", "obj_id").select("page_id", "obj_id", "merged")


@query(with_sql(BOXES, "c AS (SELECT *, CASE WHEN x1 <= 200 OR x0 >= 200 THEN 2 ELSE 1 END AS k FROM boxes)", "n AS (SELECT *, CASE WHEN k = lag(k) OVER (PARTITION BY page_id ORDER BY y1 DESC, obj_id) THEN 0 ELSE 1 END AS n FROM c)")
  + "SELECT page_id, obj_id, k AS \"columns\", CAST(sum(n) OVER (PARTITION BY page_id ORDER BY y1 DESC, obj_id) AS BIGINT) AS section FROM n")
def page_sections(s, d):
    return flow.sections(boxes(s, d), F.lit(200)).select("page_id", "obj_id", "columns", "section")


_BOTTOM = "p AS (SELECT doc_id, page_no, min(y0) AS y0 FROM lines GROUP BY 1, 2)"


@query(with_sql(LINES, _BOTTOM) + "SELECT doc_id, page_no, CASE WHEN lag(page_no) OVER w IS NULL OR lag(y0) OVER w >= 200 THEN 'page' ELSE 'continuous' END AS start FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY page_no)")
def section_starts(s, d):
    p = lines(s, d).groupBy("doc_id", "page_no").agg(F.min("y0").alias("y0"))
    return flow.section_starts(p, "doc_id", ["page_no"]).select("doc_id", "page_no", "start")


_CANON = r"lower(regexp_replace({}, '[ \t\n\r\f\x0b\x1c-\x1f\x85\xa0\x{{2028}}\x{{2029}}\x{{3000}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{205f}}\x{{1680}}]+', '', 'g'))"


@query(with_sql(LINES, "o AS (SELECT doc_id, page_no, line_no AS node, CASE WHEN line_no % 2 = 0 THEN text ELSE '#' || substr(text, 2) END AS title FROM lines WHERE text <> '')", f"a AS (SELECT doc_id, page_no, node, {_CANON.format('title')} AS t FROM o)", f"b AS (SELECT doc_id, page_no, line_no AS seq, {_CANON.format('text')} AS u FROM lines)")
  + "SELECT a.doc_id, node, min(seq) AS seq FROM a JOIN b ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND (t = u OR (length(t) >= 5 AND length(t) = length(u) AND substr(t, 2) = substr(u, 2))) GROUP BY 1, 2")
def outline_matches(s, d):
    rows = lines(s, d).withColumn("seq", F.col("line_no").cast("long"))
    outline = rows.where(F.col("text") != "").select("doc_id", "page_no", F.col("seq").alias("node"), F.when(F.col("seq") % 2 == 0, F.col("text")).otherwise(F.concat(F.lit("#"), F.substring("text", F.lit(2), F.length("text")))).alias("title"))
    return flow.outline_matches(outline, rows)


RULES = [("a_list", "^[0-9]+[.] "), ("b_secret", "password|token"), ("c_capital", "^[A-Z][a-z]+ "), ("d_any", "[a-z]")]
_RULES = " UNION ALL ".join(f"SELECT doc_id, min(line_no) AS start, '{n}' AS rule FROM lines WHERE regexp_matches(text, '{p}') GROUP BY 1" for n, p in RULES)


@query(with_sql(LINES, f"h AS ({_RULES})", "g AS (SELECT doc_id, start, min(rule) AS rule FROM h GROUP BY 1, 2)", "e AS (SELECT doc_id, max(line_no) AS last FROM lines GROUP BY 1)")
  + 'SELECT doc_id, rule, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start) - 1, last) AS "end" FROM g JOIN e USING (doc_id)')
def rule_chapters(s, d):
    rows = lines(s, d).select("doc_id", F.col("line_no").cast("long").alias("seq"), "text")
    return flow.chapters_by_titles(rows, RULES)


@query(with_sql(LINES, _HEADS, 'c AS (SELECT doc_id, seq // 3 * 3 AS start, max(seq + level * 2) AS "end" FROM heads GROUP BY 1, 2)', 'k AS (SELECT doc_id, start, "end", coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start) - 1, last) AS b FROM c JOIN ends USING (doc_id))')
  + 'SELECT doc_id, start, least("end", b) AS "end" FROM k WHERE least("end", b) >= start')
def normalized_chapters(s, d):
    heads, ends = _heads(s, d)
    rows = heads.join(ends, "doc_id").select("doc_id", (F.floor(F.col("seq") / 3) * 3).alias("start"), (F.col("seq") + F.col("level") * 2).alias("end"), "last")
    return flow.normalized_chapters(rows, F.col("last"))


@query(with_sql(LINES, "p AS (SELECT doc_id, max(page_no) AS n, min(length(text)) AS m FROM lines GROUP BY 1)", "r AS (SELECT doc_id, n, CAST(doc_id % 5 AS INTEGER) - 2 AS a, CAST(doc_id % 3 AS INTEGER) - 1 AS b FROM p)",
  'k AS (SELECT doc_id, greatest(CASE WHEN a < 0 THEN n + a + 1 WHEN a = 0 THEN 1 ELSE a END, 1) AS lo, least(CASE WHEN b < 0 THEN n + b + 1 WHEN b = 0 THEN n ELSE b END, n) AS hi FROM r)') + "SELECT doc_id, lo AS first_page, hi AS last_page FROM k WHERE lo <= hi")
def page_ranges(s, d):
    pages = lines(s, d).groupBy("doc_id").agg(F.max("page_no").alias("n"))
    r = flow.page_range((F.col("doc_id") % 5).cast("int") - 2, (F.col("doc_id") % 3).cast("int") - 1, F.col("n"))
    return pages.select("doc_id", r.alias("r")).where("r is not null").select("doc_id", F.col("r.first").alias("first_page"), F.col("r.last").alias("last_page"))


_LABELLED = "labelled AS (SELECT doc_id, line_no, CASE WHEN line_no % 3 = 0 THEN 'Key ' || line_no || ': ' || text ELSE replace(text, ':', ' ') END AS text FROM lines)"


@query(with_sql(LINES, _LABELLED, "e AS (SELECT *, CASE WHEN line_no % 3 = 0 THEN 1 ELSE 0 END AS n FROM labelled)", "k AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY line_no) AS entry, sum(n) OVER (PARTITION BY doc_id) AS labels FROM e)")
  + "SELECT doc_id, CAST(entry AS BIGINT) AS entry, 'Key ' || min(line_no) AS k, md5(string_agg(trim(CASE WHEN n = 1 THEN substr(text, instr(text, ':') + 1) ELSE text END), ' ' ORDER BY line_no)) AS digest FROM k WHERE labels >= 2 GROUP BY doc_id, entry")
def key_value_rows(s, d):
    n = F.col("line_no").cast("long")
    text = F.when(n % 3 == 0, F.concat(F.lit("Key "), n.cast("string"), F.lit(": "), F.col("text"))).otherwise(F.replace("text", F.lit(":"), F.lit(" ")))
    rows = lines(s, d).select("doc_id", n.alias("line_no"), text.alias("text"))
    return flow.key_value_rows(rows, ["doc_id"], "line_no").select("doc_id", "entry", F.col("key").alias("k"), F.md5(F.col("value").cast("binary")).alias("digest"))


_STYLE = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p, _ in num.NUMBER_STYLES) + " ELSE 'none' END"
_RANK = "CASE style " + " ".join(f"WHEN '{n}' THEN {r}" for n, _, r in num.NUMBER_STYLES) + " ELSE 10 END"


@query(with_sql(LINES) + f"SELECT style, {_RANK} AS rank, count(*) AS n FROM (SELECT {_STYLE} AS style FROM lines) GROUP BY 1, 2")
def number_styles(s, d):
    style = tx.first_match(F.col("text"), [(n, p) for n, p, _ in num.NUMBER_STYLES], "none")
    return lines(s, d).select(style.alias("style")).groupBy("style").agg(F.count("*").alias("n")).select("style", num.style_rank(F.col("style")).alias("rank"), "n")


@query(with_sql(LINES, r"t AS (SELECT doc_id, line_no, regexp_replace(text, '[\s\x0b\x1c-\x1f\x85\p{Z}.·…]+$', '') AS title FROM lines WHERE regexp_matches(text, '^[A-Za-z]'))") + "SELECT doc_id, line_no, line_no + 1 AS page, 2 AS level, '7.' || line_no % 9 AS no, md5(title) AS title FROM t")
def toc_items(s, d):
    n = F.col("line_no").cast("long")
    rows = lines(s, d).where(F.col("text").rlike("^[A-Za-z]")).select("doc_id", n.alias("line_no"), F.concat(F.lit("7."), (n % 9).cast("string"), F.lit(" "), F.col("text"), F.lit(" ..... "), (n + 1).cast("string")).alias("text"))
    return rows.select("doc_id", "line_no", tree.toc_item(F.col("text")).alias("t")).select("doc_id", "line_no", F.col("t.page").cast("long").alias("page"), F.col("t.level").alias("level"), F.col("t.no").alias("no"), F.md5(F.col("t.title").cast("binary")).alias("title"))


_SPACE = r"[ \t\n\r\f\x0b\x1c-\x1f\x85\xa0\x{2028}\x{2029}\x{3000}\x{2000}-\x{200a}\x{202f}\x{205f}\x{1680}]"


@query(with_sql(LINES, f"c AS (SELECT *, regexp_replace(text, '^{_SPACE}+|{_SPACE}+$', '', 'g') AS core, regexp_extract(text, '^({_SPACE}*)', 1) AS h, regexp_extract(text, '({_SPACE}*)$', 1) AS t FROM lines)")
  + r"SELECT doc_id, line_no, md5(CASE WHEN core = '' THEN text ELSE h || '**' || core || '**' || CASE WHEN t = '' AND regexp_matches(core, '[[:punct:]]$') THEN ' ' ELSE '' END || t END) AS digest FROM c")
def marked_lines(s, d):
    return lines(s, d).select("doc_id", F.col("line_no").cast("long").alias("line_no"), tx.md_mark(F.col("text"), "**").alias("t")).select("doc_id", "line_no", md5("t"))


@query()
def repeating_suffixes(s, d):
    ship(s)
    return repeats.repeated_suffixes(table(s, d, "documents").select("doc_id", "text"), "text", least=10, times=2).select("doc_id", "unit_length", "times")
