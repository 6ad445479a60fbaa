"""Queries over parts of pages, texts that go on, jobs and rulings, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import layout, quality, regions, sequence
from foliant.plans.shared import BOXES, LINES, boxes, lines, with_sql
from foliant.runtime import materialize, ship, table

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


_SCENE = """t AS (SELECT page_id, obj_id, page_id % 3 = 0 AS first_page, x1 - x0 < 50 AS narrow, kind, CASE WHEN x0 < 280 THEN x0 // 100 END AS col, 1 + y0 % 3 AS n, x1 % 2 = 0 AS whole, y1 % 3 = 0 AS aligned, x0 % 5 < 3 AS alike, y0 % 4 = 0 AS stop, x1 % 5 = 0 AS indent FROM boxes),
p AS (SELECT a.page_id, a.obj_id, b.page_id AS next_page, b.obj_id AS next_obj, a.whole, a.aligned, a.alike, a.stop, a.indent AS ia, b.indent AS ib,
  CASE WHEN a.kind <> b.kind OR a.col IS NULL OR b.col IS NULL THEN NULL WHEN a.page_id = b.page_id THEN CASE WHEN a.first_page OR a.narrow THEN NULL WHEN a.col = b.col THEN 'same_column' WHEN a.col + 1 = b.col THEN 'next_column' END
    WHEN a.page_id + 1 = b.page_id AND b.col = 0 AND a.col = 0 AND a.n = 1 THEN 'page_same_column' WHEN a.page_id + 1 = b.page_id AND b.col = 0 AND a.col + 1 = a.n THEN 'page_next_column' END AS scene
  FROM t a JOIN t b ON a.page_id // 2 = b.page_id // 2 AND (a.page_id < b.page_id OR a.page_id = b.page_id AND a.obj_id + 1 = b.obj_id)),
q AS (SELECT *, CASE scene WHEN 'same_column' THEN 0 WHEN 'page_next_column' THEN 3 ELSE 2 END + CASE WHEN whole THEN 2 ELSE -3 END + CASE WHEN aligned THEN 2 ELSE 0 END + CASE WHEN alike THEN 1 ELSE 0 END + CASE WHEN stop THEN -2 ELSE 1 END
  + CASE WHEN ib THEN -2 ELSE 0 END + CASE WHEN ia AND ib THEN -2 ELSE 0 END AS score FROM p WHERE scene IS NOT NULL)"""


@query(with_sql(BOXES, _SCENE) + "SELECT page_id, obj_id, next_page, next_obj, scene, score, CASE scene WHEN 'page_next_column' THEN score >= 7 ELSE score >= 6 END AS goes_on FROM q")
def text_continuity(s, d):
    """WIN-07, WIN-08, WIN-09: scenes, scores and thresholds of texts that follow each other."""
    t = boxes(s, d).selectExpr("page_id div 2 AS pair", "page_id", "obj_id", "page_id % 3 = 0 AS first_page", "x1 - x0 < 50 AS narrow", "kind", "CASE WHEN x0 < 280 THEN x0 div 100 END AS col", "1 + y0 % 3 AS n", "x1 % 2 = 0 AS whole", "y1 % 3 = 0 AS aligned", "x0 % 5 < 3 AS alike", "y0 % 4 = 0 AS stop", "x1 % 5 = 0 AS indent")
    a, b = (t.select("pair", *(F.col(c).alias(f"{p}_{c}") for c in t.columns if c != "pair")) for p in "ab")
    c = F.col
    follows = (c("a_page_id") < c("b_page_id")) | ((c("a_page_id") == c("b_page_id")) & (c("a_obj_id") + 1 == c("b_obj_id")))
    scene = sequence.merge_scene(c("a_page_id"), c("b_page_id"), c("a_kind") == c("b_kind"), c("a_col"), c("b_col"), c("a_n"), c("a_first_page"), c("a_narrow"))
    rows = a.join(b, "pair").where(follows).withColumn("scene", scene).where("scene is not null")
    rows = rows.withColumn("score", sequence.continuity_score(c("scene"), c("a_whole"), c("a_aligned"), c("a_alike"), c("a_stop"), c("a_indent"), c("b_indent")))
    return rows.select(c("a_page_id").alias("page_id"), c("a_obj_id").alias("obj_id"), c("b_page_id").alias("next_page"), c("b_obj_id").alias("next_obj"), "scene", "score", sequence.goes_on(c("scene"), c("score")).alias("goes_on"))


_SORTED = f"""WITH RECURSIVE {BOXES},
o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y0, x0, obj_id) AS k FROM boxes),
r AS (SELECT page_id, k, [{{'id': obj_id, 'x': x0, 'y': y0}}] AS done FROM o WHERE k = 1
  UNION ALL SELECT page_id, k, list_concat(list_append(done[:z], own), done[z + 1:]) FROM (SELECT o.page_id, o.k, r.done, {{'id': o.obj_id, 'x': o.x0, 'y': o.y0}} AS own,
    coalesce(list_max(list_filter(range(1, len(r.done) + 1), lambda j: NOT (abs(o.y0 - r.done[j].y) < 10 AND o.x0 < r.done[j].x))), 0) AS z FROM r JOIN o ON o.page_id = r.page_id AND o.k = r.k + 1)),
f AS (SELECT page_id, max_by(done, k) AS done FROM r GROUP BY 1)
SELECT page_id, unnest(list_transform(done, lambda m: m.id)) AS obj_id, unnest(range(len(done))) AS place FROM f"""


@query(_SORTED)
def line_order(s, d):
    """SRT-07: from the top, objects of nearly one height from left to right."""
    ship(s)
    return layout.line_order(boxes(s, d)).select("page_id", "obj_id", F.col("place").cast("long").alias("place"))


_CAPTIONS = """k AS (SELECT *, CASE WHEN obj_id <= 2 THEN 'table' WHEN obj_id % 2 = 1 THEN 'title' ELSE 'source' END AS part FROM boxes),
c AS (SELECT a.page_id, a.obj_id, b.part, b.x0, b.y0, b.x1, b.y1, row_number() OVER (PARTITION BY a.page_id, a.obj_id, b.part ORDER BY CASE b.part WHEN 'title' THEN b.y0 - a.y1 ELSE a.y0 - b.y1 END, b.obj_id) AS n
  FROM k a JOIN k b ON a.page_id = b.page_id AND a.part = 'table' AND b.part <> 'table' AND a.x0 < b.x1 AND b.x0 < a.x1 AND CASE b.part WHEN 'title' THEN b.y0 - a.y1 ELSE a.y0 - b.y1 END BETWEEN 0 AND 50),
u AS (SELECT page_id, obj_id, x0, y0, x1, y1, 0 AS parts FROM k WHERE part = 'table' UNION ALL SELECT page_id, obj_id, x0, y0, x1, y1, 1 FROM c WHERE n = 1)"""


@query(with_sql(BOXES, _CAPTIONS) + "SELECT page_id, obj_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, CAST(sum(parts) AS BIGINT) AS captions FROM u GROUP BY 1, 2")
def blocks(s, d):
    """LAY-01: an object with its nearest title above and source below, as one block."""
    part = F.when(F.col("obj_id") <= 2, "table").when(F.col("obj_id") % 2 == 1, "title").otherwise("source")
    rows = boxes(s, d).withColumn("part", part)
    return regions.blocks(rows.where("part = 'table'"), rows.where("part != 'table'").withColumn("kind", F.col("part")))


@query(with_sql(BOXES, "e AS (SELECT *, max(y1) OVER (PARTITION BY page_id ORDER BY y0, y1, obj_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM boxes)", "r AS (SELECT *, sum(CASE WHEN top IS NULL OR y0 >= top THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY y0, y1, obj_id ROWS UNBOUNDED PRECEDING) AS n FROM e)")
  + 'SELECT page_id, obj_id, max(n) OVER (PARTITION BY page_id) - n AS "row", row_number() OVER (PARTITION BY page_id, n ORDER BY x0, obj_id) - 1 AS col FROM r')
def part_rows(s, d):
    """LAY-02, LAY-03: parts whose heights overlap stand in one row of a layout table."""
    return regions.part_rows(boxes(s, d)).select("page_id", "obj_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))


_JOBS = "j AS (SELECT user_id AS job, event_id AS item, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"


@query(with_sql(_JOBS) + "SELECT job, item, n <= CAST(ceil(500 / CAST((SELECT count(DISTINCT user_id) FROM events) AS DOUBLE)) AS BIGINT) AS admitted FROM j")
def fair_share(s, d):
    """STM-01, STM-02: what each job may have in flight."""
    rows = table(s, d, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("item"), F.col("ts").alias("at"))
    return sequence.fair_share(rows, 500)


@query("SELECT user_id AS job, count(*) AS items, count(*) FILTER (WHERE event_type = 'purchase') AS done, max(event_id) AS last, count(*) FILTER (WHERE value IS NULL OR value < 1) AS failed FROM events GROUP BY 1")
def job_progress(s, d):
    """STM-03, STM-10: progress of jobs, and what failed."""
    done, failed = F.col("event_type") == "purchase", F.col("value").isNull() | (F.col("value") < 1)
    return quality.job_progress(table(s, d, "events"), "user_id", "event_id", done, failed).withColumnRenamed("user_id", "job")


_HIT = ["[0-9]", "^[A-Z]", "the ", "[!?]", "zz"]


@query(with_sql(LINES) + " UNION ALL ".join(f"SELECT '{p}' AS pattern, count(*) FILTER (WHERE regexp_matches(text, '{p}')) AS hits, count(*) FILTER (WHERE NOT regexp_matches(text, '{p}')) AS misses FROM lines" for p in _HIT))
def pattern_stats(s, d):
    """AGG-17: how often patterns match and miss, in one pass."""
    return quality.pattern_stats(lines(s, d), F.col("text"), _HIT)


@query("SELECT * FROM nation")
def cached_stage(s, d):
    """SRC-16, SNK-10: a stage's result, written and read back."""
    return materialize(table(s, d, "nation"))


_THIN = f"""WITH RECURSIVE {BOXES},
t AS (SELECT page_id, obj_id, x0, x1, y0 AS c FROM boxes WHERE x1 - x0 > 8),
o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY c, x0, obj_id) AS k FROM t),
r AS (SELECT page_id, k, c AS first, CAST(1 AS BIGINT) AS g FROM o WHERE k = 1
  UNION ALL SELECT o.page_id, o.k, CASE WHEN o.c - r.first > 20 THEN o.c ELSE r.first END, r.g + CASE WHEN o.c - r.first > 20 THEN 1 ELSE 0 END FROM r JOIN o ON o.page_id = r.page_id AND o.k = r.k + 1),
e AS (SELECT o.page_id, r.first, o.x0, o.x1, max(o.x1) OVER (PARTITION BY o.page_id, r.g ORDER BY o.x0, o.x1, o.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, r.g, o.k FROM o JOIN r USING (page_id, k)),
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR x0 > reach + 3 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, g ORDER BY x0, x1, k ROWS UNBOUNDED PRECEDING) AS i FROM e)
SELECT page_id, any_value(first) AS y, min(x0) AS x0, max(x1) AS x1 FROM n GROUP BY page_id, g, i HAVING max(x1) - min(x0) >= 30"""


@query(_THIN)
def thin_rects(s, d):
    """TAB-25: flat rectangles as lines: grouped by height, joined over small gaps, short ones left out."""
    rows = boxes(s, d).where("x1 - x0 > 8").select("page_id", "obj_id", "x0", "x1", F.col("y0").alias("c"))
    ship(s)
    return layout.rect_lines(rows, within=20, gap=3, least=30)
