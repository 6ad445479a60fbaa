"""Queries over titles, section numbers, vetoes, trees and records, with the same in SQL.

SQL states the rules on its own; only inputs are written by one rule on both sides.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import geometry as g
from foliant.functions import numbers
from foliant.functions import text as tx
from foliant.operators import contents, tables, tree
from foliant.plans.box_queries import _CELLS, _cells
from foliant.plans.function_queries import _ID, _WORDS, _case, _double, _join, _milli, _words
from foliant.plans.shared import BOXES, LINES, boxes, lines, with_sql
from foliant.runtime import ship, table

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


# titles

_TITLES = """i AS (SELECT doc_id, line_no AS item, page_no AS page, CASE line_no % 5 WHEN 0 THEN text WHEN 1 THEN '1.2 ' || text WHEN 2 THEN '#' || substr(text, 2) WHEN 3 THEN left(text, 10) ELSE '.' || text END AS title FROM lines WHERE length(text) BETWEEN 1 AND 200)"""
_GAPS = r"'[\s\x0b\x1c-\x1f\x85\p{Z}]+'"
_NUMBERED = r"'^[\s\x0b\x1c-\x1f\x85\p{Z}]*([0-9]+([.][0-9]+)*[.、)]?|[(（][\p{L}\p{N}_]{1,3}[)）])[\s\x0b\x1c-\x1f\x85\p{Z}]*'"


def _tolerant(a: str, b: str) -> str:
    odd = lambda c: f"regexp_matches({c}, '^[\\p{{P}}\\p{{S}}\\p{{C}}]')"
    return f"""CASE WHEN {a} = '' OR {b} = '' OR {a} = {b} THEN 0 WHEN length({a}) > 1 AND substr({a}, 2) = {b} THEN CASE WHEN length({b}) >= 4 OR {odd(a)} THEN 92 ELSE 0 END
  WHEN length({b}) > 1 AND substr({b}, 2) = {a} THEN CASE WHEN length({a}) >= 4 OR {odd(b)} THEN 92 ELSE 0 END
  WHEN length({a}) = length({b}) AND length({a}) > 1 AND substr({a}, 2) = substr({b}, 2) AND (length({a}) >= 5 OR {odd(a)} OR {odd(b)}) THEN 90 ELSE 0 END"""


_SCORED = f"""a AS (SELECT *, regexp_replace(title, {_GAPS}, '', 'g') AS t, regexp_replace(regexp_replace(title, {_NUMBERED}, ''), {_GAPS}, '', 'g') AS t2 FROM i),
b AS (SELECT doc_id, line_no AS seq, page_no, regexp_replace(text, {_GAPS}, '', 'g') AS s, regexp_replace(regexp_replace(text, {_NUMBERED}, ''), {_GAPS}, '', 'g') AS s2 FROM lines),
m AS (SELECT a.doc_id, item, seq, abs(page_no - page) AS away, CASE WHEN s = '' OR t = '' THEN 0 WHEN s = t THEN 100 WHEN s2 = t2 AND t2 <> '' THEN 95 WHEN ({_tolerant("s", "t")}) > 0 THEN ({_tolerant("s", "t")})
  WHEN t2 <> '' AND ({_tolerant("s2", "t2")}) > 0 THEN least(({_tolerant("s2", "t2")}), 90) WHEN starts_with(s, t) OR starts_with(t, s) THEN 85 WHEN t2 <> '' AND s2 <> '' AND (starts_with(s2, t2) OR starts_with(t2, s2)) THEN 80 ELSE 0 END AS score FROM a JOIN b USING (doc_id))"""


def _titles(s, d):
    rows = lines(s, d).withColumn("seq", F.col("line_no").cast("long"))
    k, text = F.col("seq") % 5, F.col("text")
    title = F.when(k == 0, text).when(k == 1, F.concat(F.lit("1.2 "), text)).when(k == 2, F.concat(F.lit("#"), F.substring(text, F.lit(2), F.length(text)))).when(k == 3, F.left(text, F.lit(10))).otherwise(F.concat(F.lit("."), text))
    items = rows.where(F.length("text").between(1, 200)).select("doc_id", F.col("seq").alias("item"), F.col("page_no").alias("page"), title.alias("title"))
    return items, rows.select("doc_id", "seq", "page_no", "text")


@query(with_sql(LINES, _TITLES, _SCORED) + "SELECT doc_id, item, seq, score FROM m WHERE abs(item - seq) <= 3 AND score > 0")
def title_scores(s, d):
    """STR-37: how well a text is a title."""
    items, texts = _titles(s, d)
    return contents.title_scores(items, texts).where("abs(item - seq) <= 3 and score > 0").select("doc_id", "item", "seq", "score")


@query("WITH RECURSIVE " + with_sql(LINES, _TITLES, _SCORED, """c AS (SELECT doc_id, item, list({'seq': seq, 'score': score + CASE WHEN away = 0 THEN 5 WHEN away <= 3 THEN 2 ELSE 0 END} ORDER BY seq) AS c FROM m WHERE score > 0 GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY item) AS k FROM c),
r AS (SELECT doc_id, CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS start, CAST(NULL AS BIGINT) AS item, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS score FROM n WHERE k = 1
  UNION ALL SELECT doc_id, k, CASE WHEN best.score >= 70 THEN best.seq ELSE start END, item, CASE WHEN best.score >= 70 THEN best.seq END, best.score
  FROM (SELECT doc_id, k, start, item, CASE WHEN len(list_filter(f, lambda x: x.score >= 100)) > 0 THEN list_filter(f, lambda x: x.score >= 100)[1] ELSE list_filter(f, lambda x: x.score = list_max(list_transform(f, lambda y: y.score)))[1] END AS best
    FROM (SELECT n.doc_id, n.k, r.start, n.item, list_filter(n.c, lambda x: x.seq > r.start) AS f FROM r JOIN n ON n.doc_id = r.doc_id AND n.k = r.k + 1)))""")[5:] + " SELECT doc_id, item, seq, score FROM r WHERE seq IS NOT NULL")
def title_matches(s, d):
    """JON-13: contents items and the texts that they stand for, in order."""
    ship(s)
    return contents.title_matches(*_titles(s, d)).select("doc_id", "item", "seq", F.col("score").cast("long").alias("score"))


@query(with_sql(LINES, "h AS (SELECT doc_id, page_no, line_no, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY line_no) AS p, regexp_matches(lower(regexp_replace(text, '[ -]', '', 'g')), '^[a-h]') AS hit FROM lines)") + "SELECT doc_id, page_no, min(line_no) AS seq FROM h WHERE p <= 5 AND hit GROUP BY 1, 2")
def contents_heading_at(s, d):
    """LAY-16, STR-20: a heading among the first five objects of a page."""
    rows = lines(s, d).withColumn("seq", F.col("line_no").cast("long"))
    return contents.contents_heading_at(rows, tx.contents_heading(F.col("text")).rlike("^[a-h]"))


@query(with_sql(LINES, _WORDS) + "SELECT doc_id, line_no, lower(w) || CASE k WHEN 1 THEN 'b' WHEN 4 THEN 'toc' ELSE '' END AS said FROM words")
def contents_headings(s, d):
    """STR-20: a heading of contents as it is compared."""
    w = F.col("w")
    return _words(s, d).select("doc_id", "line_no", tx.contents_heading(_case(_join(" ", w, " :"), _join(w, " - B"), _join(w, "："), _join("— ", w, "_"), _join(w, " TOC"))).alias("said"))


# section numbers

_NUMBERS = ["第一章", "第3节", "第七条", "第2部分", "1.2.3", "1.2.", "5、", "5.", "三、", "三.", "(4)", "(四)", "(b)", "①", "⑵", "iv.", "XX、", "c.", "plain", "第十款"]


@query("SELECT doc_id, family, CASE WHEN family IN ('第#章', '第#部分') THEN 1 WHEN family IN ('第#节', '第#条', '第#款', 'chinese、', 'chinese.', 'roman.') THEN 2 WHEN family = 'paren.chinese' THEN 3 WHEN family LIKE 'number%' THEN 4 WHEN family LIKE '%alpha%' THEN 6 WHEN family LIKE 'paren%' OR family LIKE 'circled%' THEN 5 ELSE 10 END AS level FROM (SELECT doc_id, ['第#章', '第#节', '第#条', '第#部分', 'number.dotted', 'number.dotted', 'number、', 'number.', 'chinese、', 'chinese.', 'paren.number', 'paren.chinese', 'paren.alpha', 'circled.number', 'paren.circled.number', 'roman.', 'roman.', 'alpha.', 'plain', '第#款'][1 + doc_id % 20] AS family FROM documents)")
def number_families(s, d):
    """NUM-13, NUM-14: the family of a heading's number, and its level."""
    number = F.element_at(F.array(*map(F.lit, _NUMBERS)), (1 + F.col("doc_id") % 20).cast("int"))
    family = numbers.number_family(tx.canonical(number))
    return table(s, d, "documents").select("doc_id", family.alias("family")).select("doc_id", "family", numbers.family_level(F.col("family")).alias("level"))


@query("SELECT doc_id, [1, 10, 12, 9, 0, 0][1 + doc_id % 6] AS korean, CASE doc_id % 4 WHEN 0 THEN 4 WHEN 1 THEN NULL WHEN 2 THEN 9 END AS roman, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id % 50 AS BIGINT) ELSE 7 END AS setting FROM documents")
def other_numbers(s, d):
    """NUM-03, NUM-25, NUM-19: Korean numerals, Roman ones that look like letters, and settings."""
    pick = lambda n, *v: F.element_at(F.array(*map(F.lit, v)), (1 + F.col("doc_id") % n).cast("int"))
    raw = F.when(F.col("doc_id") % 3 == 0, (F.col("doc_id") % 50).cast("string")).when(F.col("doc_id") % 3 == 1, F.lit("many"))
    korean = numbers.korean_value(pick(6, "일", "십", " 십이", "구", "이십", "x"))
    return table(s, d, "documents").select("doc_id", korean.alias("korean"), numbers.as_roman(pick(4, "iv", "a.b", "i.ii.ix", "1.2")).alias("roman"), numbers.setting(raw, "long", 7).alias("setting"))


_HEADS = ["第三章 x", "第12节 y", "1.2.4 z", "7. a", "8、b", "四、c", "(5) d", "（六）e", "③ f", "c) g", "none"]


@query("SELECT doc_id, ['第三章', '第12节', '1.2.4', '7.', '8、', '四、', '(5)', '（六）', '③', 'c)', NULL][1 + doc_id % 11] AS prefix, [3, 12, 4, 7, 8, 4, 5, 6, 3, 3, NULL][1 + doc_id % 11] AS value, ['chapter', 'chapter_number', 'dotted', 'number', 'number', 'chinese', 'bracketed', 'bracketed_chinese', 'circled', 'alpha', NULL][1 + doc_id % 11] AS rule FROM documents")
def number_prefixes(s, d):
    """NUM-05: the first rule that reads a number at the beginning of a text."""
    head = F.element_at(F.array(*map(F.lit, _HEADS)), (1 + F.col("doc_id") % 11).cast("int"))
    return table(s, d, "documents").select("doc_id", numbers.number_prefix(head).alias("n")).select("doc_id", "n.prefix", "n.value", "n.rule")


# vetoes and texts


_LONG = "length(w) + CASE k WHEN 0 THEN 34 WHEN 1 THEN 47 WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE 9 END > 60"


@query(with_sql(LINES, _WORDS, f"v AS (SELECT *, k IN (0, 3) AND length(w) <= 12 AS field, NOT ({_LONG}) AND (k = 2 OR length(w) % 3 = 0) AS heading FROM words)") + "SELECT doc_id, line_no, field, heading, field OR heading OR (k = 4 AND length(w) <= 32) AS vetoed FROM v")
def merge_vetoes(s, d):
    """PRJ-14, PRJ-15, PRJ-16: field lines, starts of headings, and vetoes of paragraph merges."""
    w = F.col("w")
    said = _case(_join(w, ": value of it, that is long enough"), _join(w, " goes on and on without a stop and has no field"), _join("第一 ", w), _join(w, "：值"), _join(w, " is said!"))
    centred, one = F.length("w") % 3 == 0, F.lit(1)
    rows = _words(s, d).withColumn("said", said)
    vetoed = tx.merge_vetoed(F.col("said"), F.lit("then some words that go on and on"), one, one, centred, F.lit(False))
    return rows.select("doc_id", "line_no", tx.field_line(F.col("said"), one).alias("field"), tx.title_start(F.col("said"), centred).alias("heading"), vetoed.alias("vetoed"))


@query(with_sql(LINES, _WORDS) + "SELECT doc_id, line_no, CASE k WHEN 0 THEN 'Table 1 ' || w || '|Table 2 b' WHEN 1 THEN w || '|Figure 3|表4 c' WHEN 2 THEN 'Table 1 ' || w WHEN 3 THEN w ELSE '图 1|图 2 ' || w END AS said FROM words")
def captions_split(s, d):
    """STR-31: the captions that one line holds."""
    w = F.col("w")
    said = _case(_join("Table 1 ", w, " Table 2 b"), _join(w, " Figure 3 表4 c"), _join("Table 1 ", w), w, _join("图 1 图 2 ", w))
    return _words(s, d).select("doc_id", "line_no", F.array_join(tx.split_captions(said), "|").alias("said"))


@query(with_sql(LINES, "t AS (SELECT doc_id, line_no, text, regexp_extract_all(text, '[a-z]+e[a-z]*') AS ms FROM lines)") + "SELECT doc_id, line_no, len(ms) AS n, md5(array_to_string(ms, ',')) AS digest, CASE WHEN len(ms) > 0 THEN strpos(text, ms[1]) - 1 END AS first FROM t")
def matches_found(s, d):
    """STR-09, STR-10: matches that don't overlap, and where they start."""
    found = tx.find_all(F.col("text"), "[a-z]+e[a-z]*")
    rows = lines(s, d).select("doc_id", "line_no", found.alias("f"))
    return rows.select("doc_id", "line_no", F.size("f").cast("long").alias("n"), F.md5(F.array_join(F.transform("f", lambda x: x["text"]), ",").cast("binary")).alias("digest"), F.get("f", F.lit(0))["start"].cast("long").alias("first"))


@query(with_sql(LINES, _WORDS) + "SELECT doc_id, line_no, w || CASE k WHEN 0 THEN '2' WHEN 1 THEN '1' WHEN 2 THEN 'A' WHEN 3 THEN ' ' ELSE '(' END AS said FROM words")
def compatible_characters(s, d):
    """STR-22: compatibility characters as plain ones."""
    return _words(s, d).select("doc_id", "line_no", tx.compatible(F.concat("w", _case(*map(F.lit, ("²", "₁", "Ａ", "　", "（"))))).alias("said"))


# lists, quads, tables, trees


@query(with_sql(BOXES, "l AS (SELECT page_id, list(x0 ORDER BY obj_id) AS a, list(y0 ORDER BY obj_id) AS b FROM boxes GROUP BY 1)") + "SELECT page_id, array_to_string(list_concat(a, b), ',') AS joined, array_to_string(list_concat(list_concat(a, [1]), b), ',') AS flat, len(list_filter(a, lambda x: x % 2 = 0)) AS present FROM l")
def sequences_joined(s, d):
    """SET-01, SET-02, SET-03: sequences one after the other, flattened once, and without nulls."""
    at = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("obj_id", c))), lambda x: x[c])
    rows = boxes(s, d).groupBy("page_id").agg(at("x0").alias("a"), at("y0").alias("b"))
    some = F.array_compact(F.transform("a", lambda x: F.when(x % 2 == 0, x)))
    return rows.select("page_id", F.array_join(F.concat("a", "b"), ",").alias("joined"), F.array_join(F.flatten(F.array("a", F.array(F.lit(1).cast("long")), "b")), ",").alias("flat"), F.size(some).cast("long").alias("present"))


@query(with_sql(BOXES) + "SELECT page_id, obj_id, 4000 * x0 AS first_x, 1000 * y0 * 4 + 1000 * (y1 - y0) AS first_top, 4000 * x0 + 1000 * (x1 - x0) AS second_right FROM boxes")
def quads_split(s, d):
    """GEO-24: a quad cut by weights along its first edge, and along its base."""
    q = g.quad(_double())
    up, along = g.quad_split(q, "x", [1, 2, 1]), g.quad_split(q, "y", [1, 3])
    return boxes(s, d).select(*_ID, _milli(up[0][0]["x"] * 4, "first_x"), _milli(up[0][1]["y"] * 4, "first_top"), _milli(along[1][0]["x"] * 4, "second_right"))


_COLORS = """WITH RECURSIVE {boxes},
o AS (SELECT *, x0 % 40 AS red, row_number() OVER (PARTITION BY page_id ORDER BY (x1 - x0) * (y1 - y0) DESC, y0, x0, y1, x1, obj_id) AS k FROM boxes),
r AS (SELECT page_id, k, [obj_id] AS ids, [{{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'red': red}}] AS kept FROM o WHERE k = 1
  UNION ALL SELECT page_id, k, CASE WHEN dup THEN ids ELSE list_append(ids, obj_id) END, CASE WHEN dup THEN kept ELSE list_append(kept, own) END
  FROM (SELECT o.page_id, o.k, o.obj_id, r.ids, r.kept, {{'x0': o.x0, 'y0': o.y0, 'x1': o.x1, 'y1': o.y1, 'red': o.red}} AS own,
    len(list_filter(r.kept, lambda m: abs(m.red - o.red) <= 18 AND (greatest(0, least(m.x1, o.x1) - greatest(m.x0, o.x0)) * greatest(0, least(m.y1, o.y1) - greatest(m.y0, o.y0))) >= 0.82 * least((m.x1 - m.x0) * (m.y1 - m.y0), (o.x1 - o.x0) * (o.y1 - o.y0)))) > 0 AS dup FROM r JOIN o ON o.page_id = r.page_id AND o.k = r.k + 1)),
f AS (SELECT page_id, max_by(ids, k) AS ids FROM r GROUP BY 1) SELECT page_id, unnest(ids) AS obj_id FROM f"""


@query(_COLORS.format(boxes=BOXES))
def color_blocks(s, d):
    """AGG-23: from the largest down, a block goes if a kept one has nearly its colour and its place."""
    from foliant.operators import layout

    ship(s)
    return layout.without_duplicates(boxes(s, d).withColumn("red", F.col("x0") % 40), ["red"])


@query(with_sql(BOXES, _CELLS) + 'SELECT table_id, "row", col - 2 AS col, text FROM cells WHERE col >= 2 AND col < 4')
def table_columns(s, d):
    """TAB-04."""
    return tables.select_columns(_cells(s, d), 2, 4).select("table_id", "row", "col", "text")


@query(with_sql(BOXES, _CELLS, 'g AS (SELECT table_id, "row", col, text, r, unnest(range(col, col + col_span)) AS c FROM (SELECT *, unnest(range("row", "row" + row_span)) AS r FROM cells))')
  + "SELECT table_id, 'row' AS part, r, min(c) AS c, text FROM g WHERE r = 1 AND c BETWEEN 0 AND 3 GROUP BY table_id, \"row\", col, text, r UNION ALL SELECT table_id, 'block', r, c, text FROM g WHERE r BETWEEN 0 AND 1 AND c BETWEEN 1 AND 2")
def table_blocks(s, d):
    """TAB-21: of one row a spanning cell once, of a block each slot."""
    cells, of = _cells(s, d), lambda part: [F.col("table_id"), F.lit(part).alias("part"), F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col("text")]
    return tables.block(cells, (1, 2), (0, 4)).select(*of("row")).unionByName(tables.block(cells, (0, 2), (1, 3)).select(*of("block")))


_SIZE = 's AS (SELECT table_id, max("row" + row_span) AS n, max(col + col_span) AS m FROM cells GROUP BY 1)'


@query(with_sql(BOXES, _CELLS, _SIZE) + 'SELECT table_id, "row", col, CAST(round(col * 600000 / m) AS BIGINT) AS x0, CAST(round((col + col_span) * 600000 / m) AS BIGINT) AS x1, CAST(round(300000 - "row" * 300000 / n) AS BIGINT) AS y1 FROM cells JOIN s USING (table_id)')
def tables_placed(s, d):
    """TAB-16, TAB-19: cells with estimated boxes."""
    return tables.placed(_cells(s, d), 600.0, 300.0).select("table_id", "row", "col", _milli(F.col("x0"), "x0"), _milli(F.col("x1"), "x1"), _milli(F.col("y1"), "y1"))


@query(with_sql(BOXES, _CELLS, _SIZE) + """SELECT table_id, 'table' AS type, n AS row_num, m AS col_num, count(*) AS cells, string_agg(text, '|' ORDER BY "row", col) AS texts FROM cells JOIN s USING (table_id) GROUP BY ALL""")
def table_records(s, d):
    """SNK-14: a table as one record."""
    r = tables.as_record(_cells(s, d)).select("table_id", "record.*")
    return r.select("table_id", "type", F.col("row_num").cast("long").alias("row_num"), F.col("col_num").cast("long").alias("col_num"), F.size("cells").cast("long").alias("cells"), F.array_join(F.transform("cells", lambda c: c["text"]), "|").alias("texts"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 7, o_orderkey % 3, o_orderkey) - 1 AS number FROM orders")
def depth_first_numbers(s, d):
    """WIN-14, TRE-02, TRE-03: nodes numbered as they are met from the root."""
    path = F.array(F.col("o_orderkey") % 7, F.col("o_orderkey") % 3, F.col("o_orderkey"))
    return tree.in_depth_first_order(table(s, d, "orders").withColumn("path", path), "o_custkey").select("o_custkey", "o_orderkey", "number")


_NODES = "n AS (SELECT page_id AS doc_id, obj_id AS node_id, CASE WHEN obj_id > 1 THEN obj_id // 2 END AS parent_id, x0 % 3 = 0 AS grp FROM boxes)"


@query("WITH RECURSIVE " + with_sql(BOXES, _NODES, """u AS (SELECT n.doc_id, n.node_id, n.parent_id AS up FROM n WHERE NOT n.grp UNION ALL SELECT u.doc_id, u.node_id, p.parent_id FROM u JOIN n p ON p.doc_id = u.doc_id AND p.node_id = u.up WHERE p.grp)""")[5:]
  + " SELECT doc_id, node_id, parent_id FROM (SELECT u.doc_id, u.node_id, u.up AS parent_id FROM u LEFT JOIN n p ON p.doc_id = u.doc_id AND p.node_id = u.up WHERE p.grp IS NULL OR NOT p.grp)")
def groups_expanded(s, d):
    """TRE-25: groups go, and their children hang on what they hung on."""
    n = F.col("obj_id")
    nodes = boxes(s, d).select(F.col("page_id").alias("doc_id"), n.alias("node_id"), F.when(n > 1, F.floor(n / 2)).alias("parent_id"), (F.col("x0") % 3 == 0).alias("grp"))
    return tree.expanded(nodes, F.col("grp")).select("doc_id", "node_id", "parent_id")


@query(with_sql(BOXES) + "SELECT page_id AS doc_id, obj_id, CASE WHEN (obj_id + 1) // 2 % 2 = 1 THEN (obj_id + 1) // 2 END AS node_id FROM boxes")
def nodes_of_objects(s, d):
    """TRE-06: the node that an object of a page belongs to."""
    objects = boxes(s, d).select(F.col("page_id").alias("doc_id"), "obj_id")
    node = F.floor((F.col("obj_id") + 1) / 2)
    nodes = objects.groupBy("doc_id", node.alias("node_id")).agg(F.collect_list("obj_id").alias("objects")).where("node_id % 2 = 1")
    return tree.node_of(objects, nodes)


@query(with_sql(BOXES) + "SELECT page_id, obj_id, row_number() OVER (PARTITION BY page_id ORDER BY x0 % 4, y0 DESC, obj_id) AS place FROM boxes")
def given_order(s, d):
    """SRT-06: the order that a model gives, ties by a second key."""
    w = W.partitionBy("page_id").orderBy(F.col("x0") % 4, F.desc("y0"), "obj_id")
    return boxes(s, d).select(*_ID, F.row_number().over(w).alias("place"))


_VERSIONS = {"v2": "v3", "v3": "v3", "l": "l", "plus_l": "plus_l"}


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'v3' WHEN 1 THEN 'v3' WHEN 2 THEN 'l' WHEN 3 THEN 'plus_l' END AS mapping, CASE WHEN doc_id % 3 = 0 THEN 'given' WHEN doc_id % 3 = 1 THEN 'beside' END AS config FROM documents")
def model_settings(s, d):
    """PRJ-10, AGG-20: the mapping of a model's version, and the first configuration that is there."""
    version = F.element_at(F.array(*map(F.lit, ("v2", "v3", "l", "plus_l", "none"))), (1 + F.col("doc_id") % 5).cast("int"))
    mapping = F.create_map(*[F.lit(x) for kv in _VERSIONS.items() for x in kv])
    config = F.coalesce(F.when(F.col("doc_id") % 3 == 0, "given"), F.when(F.col("doc_id") % 3 == 1, "beside"))
    return table(s, d, "documents").select("doc_id", mapping[version].alias("mapping"), config.alias("config"))


@query(with_sql(BOXES, "r AS (SELECT page_id, count(*) AS n, count(*) FILTER (WHERE x0 % 2 = 0) AS k, median(x0) AS mx, median(x1) AS my FROM boxes GROUP BY 1)",
  "e AS (SELECT page_id, any_value(n) AS n, any_value(k) AS k, any_value(mx) AS mx, any_value(my) AS my, max(abs(x0 - mx)) AS sx, max(abs(x1 - my)) AS sy FROM boxes JOIN r USING (page_id) GROUP BY 1)")
  + "SELECT page_id, CAST(round(100000 * (least(k / CAST(8 AS DOUBLE), 1) * CAST(0.35 AS DOUBLE) + k / CAST(n AS DOUBLE) * CAST(0.25 AS DOUBLE) + greatest(0, 1 - (sx + sy) / CAST(150 AS DOUBLE)) * CAST(0.25 AS DOUBLE) + CASE WHEN mx < my THEN CAST(1 AS DOUBLE) ELSE CAST(0.4 AS DOUBLE) END * CAST(0.15 AS DOUBLE))) AS BIGINT) AS score FROM e")
def region_scores(s, d):
    """AGG-12: how much a region looks like keys and values."""
    from foliant.operators import quality

    rows = boxes(s, d).select("page_id", "x0", "x1", (F.col("x0") % 2 == 0).alias("kv"))
    scored = quality.region_score(rows, "page_id", F.col("kv"), "x0", "x1", 600)
    return scored.select("page_id", F.round(F.col("score") * 100000).cast("long").alias("score"))
