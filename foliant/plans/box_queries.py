"""Queries over boxes on pages, grids and tables, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import geometry as g
from foliant.operators import layout, sequence, spatial, tables
from foliant.plans.shared import BOXES, COMMON, area2, boxes, with_sql
from foliant.runtime import ship, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_A2, _B2 = area2("a"), area2("b")
_PAIR = "FROM boxes a JOIN boxes b ON a.page_id = b.page_id AND a.obj_id < b.obj_id"
_CONTAINED = f"({COMMON}) / {_B2}"  # a holds b
#: Regions of a page: its first two objects, grown by 60; the rest are its objects.
_REGIONS = "regions AS (SELECT page_id, obj_id AS region_id, x0 - 60 AS x0, y0 - 60 AS y0, x1 + 60 AS x1, y1 + 60 AS y1 FROM boxes WHERE obj_id <= 2), objects AS (SELECT * FROM boxes WHERE obj_id > 2)"
_HITS = f"hits AS (SELECT b.page_id, a.region_id, b.obj_id, b.y1, {_CONTAINED} AS share FROM regions a JOIN objects b ON a.page_id = b.page_id)"


def _regions(s, d):
    b = boxes(s, d)
    grown = [(F.col(e) + by).alias(e) for e, by in (("x0", -60), ("y0", -60), ("x1", 60), ("y1", 60))]
    return b.where("obj_id > 2"), b.where("obj_id <= 2").select("page_id", F.col("obj_id").alias("region_id"), *grown)


def _pairs(s, d):
    b = boxes(s, d)
    return spatial.pairs(b, b, F.col("a_obj_id") < F.col("b_obj_id"))


def _ab():
    return spatial.box("a_"), spatial.box("b_")


@query(with_sql(BOXES) + f"SELECT page_id, obj_id, (x1 - x0) * (y1 - y0) AS area, {_A2} AS area2, x1 - x0 >= y1 - y0 AS is_h FROM boxes a")
def bbox_metrics(s, d):
    b = spatial.box()
    return boxes(s, d).select("page_id", "obj_id", g.area(b).alias("area"), g.area2(b).alias("area2"), g.is_h(b).alias("is_h"))


@query(with_sql(BOXES) + "SELECT page_id, count(*) AS objects, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM boxes GROUP BY page_id")
def bbox_union_page(s, d):
    return spatial.page_union(boxes(s, d))


@query(with_sql(BOXES) + f"SELECT a.page_id, a.obj_id AS a_obj_id, b.obj_id AS b_obj_id, {COMMON} AS common {_PAIR} WHERE {COMMON} > 0")
def bbox_overlap_pairs(s, d):
    common = g.intersection_area2(*_ab())
    return _pairs(s, d).withColumn("common", common).where("common > 0").select("page_id", "a_obj_id", "b_obj_id", "common")


@query(with_sql(BOXES) + f"SELECT a.page_id, a.obj_id AS a_obj_id, b.obj_id AS b_obj_id, CAST(floor(1000 * ({COMMON}) / ({_A2} + {_B2} - ({COMMON}))) AS BIGINT) AS permille {_PAIR}")
def bbox_iou(s, d):
    a, b = _ab()
    common = g.intersection_area2(a, b)
    return _pairs(s, d).select("page_id", "a_obj_id", "b_obj_id", F.floor(1000 * common / (g.area2(a) + g.area2(b) - common)).alias("permille"))


@query(with_sql(BOXES) + f"SELECT a.page_id, a.obj_id AS a_obj_id, b.obj_id AS b_obj_id {_PAIR} WHERE a.x0 <= b.x0 AND a.y0 <= b.y0 AND a.x1 >= b.x1 AND a.y1 >= b.y1")
def bbox_contains_pairs(s, d):
    return _pairs(s, d).where(g.contains(*_ab())).select("page_id", "a_obj_id", "b_obj_id")


@query(with_sql(BOXES) + f"SELECT a.page_id, a.obj_id AS a_obj_id, b.obj_id AS b_obj_id {_PAIR} WHERE b.x1 - a.x0 >= least(10, a.x1 - a.x0, b.x1 - b.x0) AND a.x1 - b.x0 >= least(10, a.x1 - a.x0, b.x1 - b.x0)")
def axis_over_pairs(s, d):
    return _pairs(s, d).where(g.over("x", *_ab(), 10, 10)).select("page_id", "a_obj_id", "b_obj_id")


@query(with_sql(BOXES) + f"SELECT a.page_id, a.obj_id AS a_obj_id, b.obj_id AS b_obj_id {_PAIR} WHERE abs(a.x0 - b.x0) <= 25 AND abs(a.x1 - b.x1) <= 25")
def axis_align_pairs(s, d):
    return _pairs(s, d).where(g.align("x", *_ab(), 25)).select("page_id", "a_obj_id", "b_obj_id")


@query(with_sql(BOXES, _REGIONS, _HITS) + "SELECT page_id, region_id, obj_id, row_number() OVER (PARTITION BY page_id, region_id ORDER BY y1 DESC, obj_id) AS rank FROM hits WHERE share >= 0.7")
def region_select(s, d):
    return spatial.region_select(*_regions(s, d), 0.7).withColumn("rank", F.col("rank").cast("long"))


@query(with_sql(BOXES, _REGIONS, _HITS) + "SELECT page_id, min(region_id) AS region_id, obj_id FROM hits WHERE share >= 0.7 GROUP BY page_id, obj_id")
def region_select_consume(s, d):
    return spatial.region_claim(*_regions(s, d), 0.7)


@query(with_sql(BOXES, _REGIONS, _HITS, "one AS (SELECT page_id, min(region_id) AS region_id, obj_id FROM hits WHERE share >= 0.7 GROUP BY page_id, obj_id)") + """SELECT *, 1 AS pass FROM one UNION ALL
SELECT page_id, min(region_id), obj_id, 2 FROM hits h WHERE share >= 0.4 AND NOT EXISTS (SELECT 1 FROM one o WHERE o.page_id = h.page_id AND o.obj_id = h.obj_id) GROUP BY page_id, obj_id""")
def two_pass_assign(s, d):
    return spatial.two_pass_claim(*_regions(s, d))


@query(with_sql(BOXES, _REGIONS, _HITS) + "SELECT page_id, region_id, obj_id FROM (SELECT *, row_number() OVER (PARTITION BY page_id, obj_id ORDER BY share DESC, region_id) AS n FROM hits WHERE share >= 0.5) WHERE n = 1")
def best_region(s, d):
    return spatial.best_region(*_regions(s, d), 0.5)


_OTHER = f"FROM boxes b WHERE a.page_id = b.page_id AND a.obj_id <> b.obj_id AND ({COMMON}) / least({_A2}, {_B2})"


@query(with_sql(BOXES) + f"SELECT page_id, obj_id FROM boxes a WHERE EXISTS (SELECT 1 {_OTHER} > 0.2)")
def overlap_semi(s, d):
    b = boxes(s, d)
    return spatial.overlap_semi(b, b, 0.2).select("page_id", "obj_id")


@query(with_sql(BOXES) + f"SELECT page_id, obj_id FROM boxes a WHERE NOT EXISTS (SELECT 1 {_OTHER} > 0.2)")
def overlap_anti(s, d):
    b = boxes(s, d)
    return spatial.overlap_anti(b, b, 0.2).select("page_id", "obj_id")


@query(with_sql(BOXES) + f"SELECT page_id, obj_id FROM boxes a WHERE NOT EXISTS (SELECT 1 {_OTHER} <= 0.2)")
def overlap_all(s, d):
    b = boxes(s, d)
    return spatial.overlap_all(b, b, 0.2).select("page_id", "obj_id")


def _near(gap: str) -> str:
    return with_sql(BOXES) + f"""SELECT page_id, obj_id, near_id, distance FROM (SELECT a.page_id, a.obj_id, b.obj_id AS near_id, {gap} AS distance,
      row_number() OVER (PARTITION BY a.page_id, a.obj_id ORDER BY {gap}, b.obj_id) AS n
      FROM boxes a JOIN boxes b ON a.page_id = b.page_id AND a.obj_id <> b.obj_id AND a.x0 < b.x1 AND b.x0 < a.x1 AND {gap} >= 0) WHERE n = 1"""


@query(_near("b.y0 - a.y1"))
def nearest_above(s, d):
    b = boxes(s, d)
    return spatial.nearest(b, b, above=True)


@query(_near("a.y0 - b.y1"))
def nearest_below(s, d):
    b = boxes(s, d)
    return spatial.nearest(b, b, above=False)


@query(with_sql(BOXES) + f"""SELECT page_id, obj_id, color FROM (SELECT *, row_number() OVER (PARTITION BY page_id, obj_id ORDER BY s DESC, color DESC) AS n FROM (
  SELECT a.page_id, a.obj_id, b.kind AS color, sum({COMMON}) AS s FROM boxes a JOIN boxes b ON a.page_id = b.page_id AND b.obj_id > 2 AND a.obj_id <= 2 WHERE ({COMMON}) / least({_A2}, {_B2}) >= 0.3 GROUP BY 1, 2, 3)) WHERE n = 1""")
def cell_fill_color(s, d):
    b = boxes(s, d)
    return spatial.fill_color(b.where("obj_id <= 2"), b.where("obj_id > 2").withColumnRenamed("kind", "color"), 0.3)


_ISLANDS = "i AS (SELECT page_id, x0 AS lo, x1 AS hi, sum(CASE WHEN x0 <= e THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY x0, x1) AS island FROM (SELECT page_id, x0, x1, max(x1) OVER (PARTITION BY page_id ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM boxes)), m AS (SELECT page_id, island, count(*) AS n, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY 1, 2)"
_GAPS = "g AS (SELECT page_id, hi AS gap_start, lead(lo) OVER (PARTITION BY page_id ORDER BY island) AS gap_end FROM m)"


@query(with_sql(BOXES, _ISLANDS) + "SELECT page_id, CAST(island AS BIGINT) AS island, n, lo, hi FROM m")
def interval_merge(s, d):
    return sequence.merge_intervals(boxes(s, d), ["page_id"], "x0", "x1")


@query(with_sql(BOXES, _ISLANDS, _GAPS) + "SELECT * FROM g WHERE gap_end - gap_start >= 3")
def column_gaps(s, d):
    return sequence.gaps(boxes(s, d), ["page_id"], "x0", "x1", 3)


@query(with_sql(BOXES, _ISLANDS, _GAPS) + "SELECT page_id, gap_start, gap_end FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY gap_end - gap_start DESC, gap_start) AS n FROM g WHERE gap_end - gap_start >= 6) WHERE n = 1")
def widest_gap_split(s, d):
    return sequence.widest_gap(boxes(s, d), ["page_id"], "x0", "x1", 6)


@query(with_sql(BOXES) + "SELECT page_id, CAST(c AS BIGINT) AS cluster, count(*) AS n, round(avg(x0), 4) AS mean FROM (SELECT page_id, x0, sum(CASE WHEN x0 - p <= 20 THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY x0) AS c FROM (SELECT page_id, x0, lag(x0) OVER (PARTITION BY page_id ORDER BY x0) AS p FROM boxes)) GROUP BY 1, 2")
def edge_clusters(s, d):
    return sequence.cluster_by_last(boxes(s, d), ["page_id"], "x0", 20).withColumn("mean", F.round("mean", 4))


# cells: a slot for each place of a 4 x 4 table, spans from the quantity
_CELLS = """cells AS (SELECT page_id AS table_id, CAST(((obj_id - 1) // 3) * 2 AS INTEGER) AS "row", CAST((obj_id - 1) % 3 * 2 AS INTEGER) AS col, CAST(1 + x0 % 2 AS INTEGER) AS row_span, CAST(1 + y0 % 3 AS INTEGER) AS col_span, CASE WHEN x0 % 4 = 0 THEN '' ELSE kind || '<' || CAST(x0 AS VARCHAR) END AS text FROM boxes)"""
_SLOTS = 'slots AS (SELECT table_id, r, unnest(range(col, col + col_span)) AS c FROM (SELECT table_id, col, col_span, unnest(range("row", "row" + row_span)) AS r FROM cells))'
_SHAPE = 'shape AS (SELECT table_id, max("row" + row_span) AS rows, max(col + col_span) AS cols FROM cells GROUP BY 1)'


def _cells(s, d):
    n = F.col("obj_id") - 1
    span = lambda c, k: (1 + F.col(c) % k).cast("int")
    text = F.when(F.col("x0") % 4 == 0, "").otherwise(F.concat("kind", F.lit("<"), F.col("x0").cast("string")))
    return boxes(s, d).select(F.col("page_id").alias("table_id"), (F.floor(n / 3) * 2).cast("int").alias("row"), (n % 3 * 2).cast("int").alias("col"), span("x0", 2).alias("row_span"), span("y0", 3).alias("col_span"), text.alias("text"))


@query(with_sql(BOXES, _CELLS, _SLOTS) + "SELECT table_id, r, c, count(*) AS n FROM slots GROUP BY 1, 2, 3")
def grid_explode(s, d):
    return tables.grid(_cells(s, d)).groupBy("table_id", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c")).agg(F.count("*").alias("n"))


@query(with_sql(BOXES, _CELLS, _SLOTS, _SHAPE) + 'SELECT table_id, "overlaps", rows * cols - filled AS missing FROM shape JOIN (SELECT table_id, count(*) AS filled, count(*) FILTER (WHERE n > 1) AS "overlaps" FROM (SELECT table_id, r, c, count(*) AS n FROM slots GROUP BY 1, 2, 3) GROUP BY 1) USING (table_id)')
def grid_validate(s, d):
    return tables.validate(_cells(s, d))


@query(with_sql(BOXES, _CELLS, _SLOTS, _SHAPE, "e AS (SELECT table_id, r, unnest(range(cols)) AS c FROM (SELECT table_id, cols, unnest(range(rows)) AS r FROM shape))") + "SELECT table_id, r, c FROM e EXCEPT SELECT table_id, r, c FROM slots")
def grid_missing(s, d):
    return tables.missing(_cells(s, d)).select("table_id", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"))


_EDGE = """e AS (SELECT table_id, min("row") AS r0, max("row" + row_span - 1) AS r1, min(col) AS c0, max(col + col_span - 1) AS c1 FROM cells WHERE text <> '' GROUP BY 1)"""


@query(with_sql(BOXES, _CELLS, _EDGE) + 'SELECT table_id, "row" - coalesce(r0, 0) AS "row", col - coalesce(c0, 0) AS col, row_span, col_span, text FROM cells LEFT JOIN e USING (table_id) WHERE r0 IS NULL OR ("row" BETWEEN r0 AND r1 AND col BETWEEN c0 AND c1)')
def table_strip(s, d):
    return tables.strip(_cells(s, d))


_TD = """'<td' || CASE WHEN row_span > 1 THEN ' rowspan="' || row_span || '"' ELSE '' END || CASE WHEN col_span > 1 THEN ' colspan="' || col_span || '"' ELSE '' END || '>' || replace(text, '<', '&lt;') || '</td>'"""


@query(with_sql(BOXES, _CELLS, f'tr AS (SELECT table_id, "row", \'<tr>\' || string_agg({_TD}, \'\' ORDER BY col) || \'</tr>\' AS tr FROM cells GROUP BY 1, 2)') + "SELECT table_id, '<table>' || string_agg(tr, '' ORDER BY \"row\") || '</table>' AS html FROM tr GROUP BY 1")
def table_html(s, d):
    return tables.html(_cells(s, d))


@query(with_sql(BOXES, _CELLS, """h AS (SELECT table_id // 8 AS chain, table_id, list(col || kind ORDER BY col) AS h FROM (SELECT table_id, CAST(col AS VARCHAR) AS col, left(text, 1) AS kind FROM cells WHERE "row" = 0) GROUP BY 1, 2)""") + "SELECT chain, table_id, coalesce(lag(h) OVER (PARTITION BY chain ORDER BY table_id) = h, false) AS repeats FROM h")
def header_repeat(s, d):
    cells = _cells(s, d).withColumn("chain", F.floor(F.col("table_id") / 8)).withColumn("text", F.substring_index("text", "<", 1))
    return tables.repeated_header(cells, "chain")


@query(with_sql(BOXES, _CELLS, "w AS (SELECT table_id, col, greatest(max(length(text)), 1) AS n FROM cells GROUP BY 1, 2)") + "SELECT table_id, col, round((sum(n) OVER (PARTITION BY table_id ORDER BY col) - n) / sum(n) OVER (PARTITION BY table_id) * 600, 3) AS x0, round(sum(n) OVER (PARTITION BY table_id ORDER BY col) / sum(n) OVER (PARTITION BY table_id) * 600, 3) AS x1 FROM w")
def column_widths(s, d):
    return tables.column_widths(_cells(s, d), 600).select("table_id", "col", F.round("x0", 3).alias("x0"), F.round("x1", 3).alias("x1"))


@query(with_sql(BOXES, _CELLS) + 'SELECT table_id, dense_rank() OVER (PARTITION BY table_id ORDER BY "row") - 1 AS "row", dense_rank() OVER (PARTITION BY table_id ORDER BY col) - 1 AS col, row_span, col_span, text FROM cells')
def table_reindex(s, d):
    out = tables.reindex(_cells(s, d))
    return out.select("table_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "row_span", "col_span", "text")


@query(with_sql(BOXES) + "SELECT page_id, round(median(m), 3) AS size FROM (SELECT page_id, kind, median(y1 - y0) AS m FROM boxes GROUP BY 1, 2) GROUP BY 1")
def body_size(s, d):
    from foliant.operators import quality

    return quality.body_size(boxes(s, d).withColumn("h", F.col("y1") - F.col("y0")), "page_id", "kind", "h").withColumn("size", F.round("size", 3))


@query(with_sql(BOXES) + "SELECT page_id, obj_id, x0 * 2 AS x0, (400 - y1) * 2 AS y0, x1 * 2 AS x1, (400 - y0) * 2 AS y1 FROM boxes")
def origin_flip(s, d):
    return boxes(s, d).select("page_id", "obj_id", g.flip(spatial.box(), F.lit(400), 2, 2).alias("b")).select("page_id", "obj_id", "b.*")


@query(with_sql(BOXES) + "SELECT page_id, obj_id, CASE WHEN x1 - x0 > 60 THEN x0 + 30 ELSE x0 END AS x0, y0 - 5 AS y0, CASE WHEN x1 - x0 > 60 THEN x1 - 30 ELSE x1 END AS x1, y1 + 5 AS y1 FROM boxes")
def bbox_expand(s, d):
    return boxes(s, d).select("page_id", "obj_id", g.expand(spatial.box(), -30, 5).alias("b")).select("page_id", "obj_id", "b.*")


@query(with_sql(BOXES) + "SELECT page_id, obj_id, CAST((x1 - x0) * (y1 - y0) AS DOUBLE) AS area, -y1 AS x0, x0 AS y0, -y0 AS x1, x1 AS y1 FROM boxes")
def bbox_transform(s, d):
    m = g.matrix(0, 1, -1, 0, 0, 0)
    b = g.transform(spatial.box(), m)
    return boxes(s, d).select("page_id", "obj_id", g.quad_area(g.quad(F.struct(*(F.col(e).cast("double").alias(e) for e in spatial.EDGES)))).alias("area"), b.alias("b")).select("page_id", "obj_id", "area", *(F.col(f"b.{e}").cast("long").alias(e) for e in spatial.EDGES))


# SQL of folds: a page's objects one by one, with what is kept so far as a list


def _fold(order: str, keep: str, extra: str = "") -> str:
    """page_id, obj_id that a greedy pass keeps: ``keep`` tells of an object o and the list r.kept."""
    own = "{'x0': o.x0, 'y0': o.y0, 'x1': o.x1, 'y1': o.y1, 'kind': o.kind, 'id': o.obj_id}"
    return f"""WITH RECURSIVE {BOXES},
o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY {order}) AS k FROM boxes),
r AS (SELECT page_id, k, [{own}] AS kept FROM o WHERE k = 1
  UNION ALL SELECT o.page_id, o.k, CASE WHEN {keep} THEN list_append(r.kept, {own}) ELSE r.kept END FROM r JOIN o ON o.page_id = r.page_id AND o.k = r.k + 1),
f AS (SELECT page_id, max_by(kept, k) AS kept FROM r GROUP BY page_id)
SELECT page_id, unnest(list_transform(kept, lambda m: m.id)) AS obj_id FROM f"""


_SHARED = "greatest(0, least(m.x1, o.x1) - greatest(m.x0, o.x0)) * greatest(0, least(m.y1, o.y1) - greatest(m.y0, o.y0))"
_BOTH = f"((m.x1 - m.x0) * (m.y1 - m.y0) + (o.x1 - o.x0) * (o.y1 - o.y0) - {_SHARED})"
_NMS = _fold("(x0 * 31 + y0 * 17) % 1000 DESC, obj_id", f"len(list_filter(r.kept, lambda m: {_SHARED} >= (CASE WHEN m.kind = o.kind THEN 0.6 ELSE 0.98 END) * {_BOTH})) = 0")
#: Pairs (i, j) of a page in the order in which they are looked at; j = i tests for slivers.
_SUPPRESS = f"""WITH RECURSIVE {BOXES},
n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY obj_id) AS q FROM boxes),
p AS (SELECT o.page_id, o.q AS i, m.q AS j, row_number() OVER (PARTITION BY o.page_id ORDER BY o.q, m.q) AS k, least(o.x1 - o.x0, o.y1 - o.y0) < 6 AS sliver,
    {_SHARED} > 0.7 * least((o.x1 - o.x0) * (o.y1 - o.y0), (m.x1 - m.x0) * (m.y1 - m.y0)) AS over, (o.x1 - o.x0) * (o.y1 - o.y0) >= (m.x1 - m.x0) * (m.y1 - m.y0) AS larger
  FROM n o JOIN n m ON o.page_id = m.page_id AND m.q >= o.q),
r AS (SELECT page_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS gone FROM p WHERE k = 1
  UNION ALL SELECT p.page_id, p.k, CASE WHEN list_contains(r.gone, p.i) OR list_contains(r.gone, p.j) THEN r.gone
    WHEN p.i = p.j THEN CASE WHEN p.sliver THEN list_append(r.gone, p.i) ELSE r.gone END
    WHEN p.over THEN list_append(r.gone, CASE WHEN p.larger THEN p.j ELSE p.i END) ELSE r.gone END
  FROM r JOIN p ON p.page_id = r.page_id AND p.k = r.k + 1),
f AS (SELECT page_id, max_by(gone, k) AS gone FROM r GROUP BY page_id)
SELECT n.page_id, n.obj_id FROM n JOIN f USING (page_id) WHERE NOT list_contains(f.gone, n.q)"""
_TOUCH = "(greatest(m.x0, o.x0) <= least(m.x1, o.x1) AND greatest(m.y0, o.y0) <= least(m.y1, o.y1)) OR (abs(m.y0 - o.y0) <= 3 AND abs(m.y1 - o.y1) <= 3)"
_MERGE = f"""WITH RECURSIVE {BOXES},
o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY obj_id) AS k FROM boxes),
r AS (SELECT page_id, k, [{{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}] AS done FROM o WHERE k = 1
  UNION ALL SELECT page_id, k, CASE WHEN z IS NULL THEN list_append(done, {{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}})
    ELSE list_concat(list_append(done[:z - 1], {{'x0': least(done[z].x0, x0), 'y0': least(done[z].y0, y0), 'x1': greatest(done[z].x1, x1), 'y1': greatest(done[z].y1, y1)}}), done[z + 1:]) END
  FROM (SELECT o.page_id, o.k, o.x0, o.y0, o.x1, o.y1, r.done, list_position(list_transform(r.done, lambda m: {_TOUCH}), true) AS z FROM r JOIN o ON o.page_id = r.page_id AND o.k = r.k + 1)),
f AS (SELECT page_id, max_by(done, k) AS done FROM r GROUP BY page_id), u AS (SELECT page_id, unnest(done) AS m FROM f)
SELECT page_id, CAST(m.x0 AS DOUBLE) AS x0, CAST(m.y0 AS DOUBLE) AS y0, CAST(m.x1 AS DOUBLE) AS x1, CAST(m.y1 AS DOUBLE) AS y1 FROM u"""
_FIRSTS = f"""WITH RECURSIVE {BOXES},
o AS (SELECT page_id, x0, row_number() OVER (PARTITION BY page_id ORDER BY x0) AS k FROM boxes),
r AS (SELECT page_id, k, x0 AS first, CAST(1 AS BIGINT) AS n FROM o WHERE k = 1
  UNION ALL SELECT o.page_id, o.k, CASE WHEN o.x0 - r.first > 20 THEN o.x0 ELSE r.first END, r.n + CASE WHEN o.x0 - r.first > 20 THEN 1 ELSE 0 END FROM r JOIN o ON o.page_id = r.page_id AND o.k = r.k + 1)
SELECT page_id, max(n) AS clusters FROM r GROUP BY page_id"""
_COLUMNS = "s AS (SELECT *, CASE WHEN x1 <= 250 THEN 0 WHEN x0 >= 250 THEN 1 ELSE 2 END AS side FROM boxes), p AS (SELECT *, count(*) FILTER (WHERE side = 2) OVER (PARTITION BY page_id ORDER BY y1 DESC, obj_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - CASE WHEN side = 2 THEN 1 ELSE 0 END AS part FROM s)"


@query(_NMS)
def nms_boxes(s, d):
    """SRT-08, SRT-09."""
    ship(s)
    scored = boxes(s, d).withColumn("score", ((F.col("x0") * 31 + F.col("y0") * 17) % 1000 / 1000).cast("double"))
    return layout.nms(scored)


@query()
def xy_cut_order(s, d):
    ship(s)
    return layout.xy_cut(boxes(s, d))


@query()
def visual_rows(s, d):
    ship(s)
    return layout.visual_rows(boxes(s, d))


@query(with_sql(BOXES, _COLUMNS) + "SELECT page_id, obj_id, row_number() OVER (PARTITION BY page_id ORDER BY part, side, y1 DESC, obj_id) - 1 AS place FROM p")
def two_column_order(s, d):
    return layout.two_columns(boxes(s, d), 500)


@query(_SUPPRESS)
def overlap_suppression(s, d):
    ship(s)
    return layout.without_overlaps(boxes(s, d))


@query(_MERGE)
def region_merge(s, d):
    ship(s)
    return layout.merge_regions(boxes(s, d))


@query(_FIRSTS)
def first_value_clusters(s, d):
    return sequence.cluster_by_first(boxes(s, d), ["page_id"], "x0", 20).select("page_id", F.size("clusters").alias("clusters"))


@query(with_sql(BOXES) + "SELECT page_id, obj_id, ntile(3) OVER (PARTITION BY page_id ORDER BY y1 DESC, obj_id) AS part FROM boxes")
def page_thirds(s, d):
    return sequence.balanced_split(boxes(s, d), ["page_id"], [F.desc("y1"), F.col("obj_id")], 3).select("page_id", "obj_id", F.col("part").cast("long").alias("part"))


@query(with_sql(BOXES) + "SELECT kind, obj_id, count(*) AS n, CAST(grouping(kind) AS INTEGER) AS level FROM boxes GROUP BY ROLLUP (kind, obj_id)")
def kind_rollup(s, d):
    return boxes(s, d).rollup("kind", "obj_id").agg(F.count("*").alias("n"), F.grouping("kind").cast("int").alias("level"))
