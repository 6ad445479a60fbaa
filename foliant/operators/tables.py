"""Tables as cells (table_id, row, col, row_span, col_span, text): grids, checks, strips, HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = "table_id"


def grid(cells: DataFrame) -> DataFrame:
    """A row for each slot (r, c) that a cell covers."""
    rows = F.explode(F.sequence(F.col("row"), F.col("row") + F.col("row_span") - 1)).alias("r")
    return cells.select("*", rows).withColumn("c", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("col_span") - 1)))


def shape(cells: DataFrame) -> DataFrame:
    return cells.groupBy(KEY).agg(F.max(F.col("row") + F.col("row_span")).alias("rows"), F.max(F.col("col") + F.col("col_span")).alias("cols"))


def validate(cells: DataFrame) -> DataFrame:
    """table_id, overlaps, missing: slots covered twice, and not at all; sound tables have 0 and 0."""
    slots = grid(cells).groupBy(KEY, "r", "c").agg(F.count("*").alias("n"))
    filled = slots.groupBy(KEY).agg(F.count("*").alias("filled"), F.count_if(F.col("n") > 1).alias("overlaps"))
    return shape(cells).join(filled, KEY).select(KEY, "overlaps", (F.col("rows").cast("long") * F.col("cols") - F.col("filled")).alias("missing"))


def missing(cells: DataFrame) -> DataFrame:
    """table_id, r, c of slots that no cell covers."""
    every = shape(cells).select(KEY, "cols", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("r")).select(KEY, "r", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("c"))
    return every.join(grid(cells).select(KEY, "r", "c").distinct(), [KEY, "r", "c"], "left_anti")


def strip(cells: DataFrame) -> DataFrame:
    """Cells without the blank rows and columns at the edges, numbered anew; all stay if none holds text."""
    w = W.partitionBy(KEY)
    full = F.trim(F.coalesce("text", F.lit(""))) != ""
    edge = lambda f, c: f(F.when(full, c)).over(w)
    lo_r, hi_r = edge(F.min, F.col("row")), edge(F.max, F.col("row") + F.col("row_span") - 1)
    lo_c, hi_c = edge(F.min, F.col("col")), edge(F.max, F.col("col") + F.col("col_span") - 1)
    out = cells.withColumns({"__r": lo_r, "__r1": hi_r, "__c": lo_c, "__c1": hi_c})
    inside = F.col("__r").isNull() | (F.col("row").between(F.col("__r"), F.col("__r1")) & F.col("col").between(F.col("__c"), F.col("__c1")))
    out = out.where(inside).withColumns({"row": F.col("row") - F.coalesce("__r", F.lit(0)), "col": F.col("col") - F.coalesce("__c", F.lit(0))})
    return out.drop("__r", "__r1", "__c", "__c1")


def reindex(cells: DataFrame) -> DataFrame:
    """Rows and columns numbered without holes."""
    rank = lambda c: (F.dense_rank().over(W.partitionBy(KEY).orderBy(c)) - 1).cast("int")
    return cells.withColumns({"__r": rank("row"), "__c": rank("col")}).drop("row", "col").withColumnsRenamed({"__r": "row", "__c": "col"})


def select_rows(cells: DataFrame, start: int, end: int) -> DataFrame:
    return cells.where((F.col("row") >= start) & (F.col("row") < end)).withColumn("row", F.col("row") - start)


def set_header(cells: DataFrame, rows: int) -> DataFrame:
    """Add ``part``, header or body."""
    return cells.withColumn("part", F.when(F.col("row") < rows, "header").otherwise("body"))


def escape_html(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def html(cells: DataFrame) -> DataFrame:
    """table_id, html. Rows are put together before tables, so that sums are partial."""
    span = lambda name, c: F.when(F.col(c) > 1, F.concat(F.lit(f' {name}="'), F.col(c).cast("string"), F.lit('"'))).otherwise("")
    cell = F.concat(F.lit("<td"), span("rowspan", "row_span"), span("colspan", "col_span"), F.lit(">"), escape_html(F.coalesce("text", F.lit(""))), F.lit("</td>"))
    joined = lambda key, v: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), v.alias("v")))), lambda x: x["v"]), "")
    rows = cells.groupBy(KEY, "row").agg(F.concat(F.lit("<tr>"), joined("col", cell), F.lit("</tr>")).alias("tr"))
    return rows.groupBy(KEY).agg(F.concat(F.lit("<table>"), joined("row", F.col("tr")), F.lit("</table>")).alias("html"))


def repeated_header(cells: DataFrame, chain: str) -> DataFrame:
    """chain, table_id, repeats: whether a table's first row says what the first row of the one before says.

    ``cells`` has ``chain``, what the tables follow on each other in, by table_id.
    """
    first = cells.where("row = 0").groupBy(chain, KEY).agg(F.array_sort(F.collect_list(F.struct("col", F.regexp_replace("text", r"(?U)\s+", "").alias("t")))).alias("h"))
    w = W.partitionBy(chain).orderBy(KEY)
    return first.select(chain, KEY, F.coalesce(F.lag("h").over(w) == F.col("h"), F.lit(False)).alias("repeats"))


def column_widths(cells: DataFrame, width: float) -> DataFrame:
    """table_id, col, x0, x1: columns share a width by their longest text."""
    per = cells.groupBy(KEY, "col").agg(F.greatest(F.max(F.length("text")), F.lit(1)).alias("n"))
    w = W.partitionBy(KEY)
    upto = F.sum("n").over(w.orderBy("col").rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("n").over(w)
    return per.select(KEY, "col", ((upto - F.col("n")) / total * width).alias("x0"), (upto / total * width).alias("x1"))


def stripped_size(cells: DataFrame) -> DataFrame:
    """table_id, rows, cols without the blank ones, inner ones too, that no span crosses."""
    slots = grid(cells).withColumn("__full", F.trim(F.coalesce("text", F.lit(""))) != "")

    def lines(at: str, span: str) -> DataFrame:
        held = F.bool_or(F.col("__full") | (F.col(span) > 1))
        return slots.groupBy(KEY, at).agg(held.alias("h")).groupBy(KEY).agg(F.count_if("h").alias({"r": "rows", "c": "cols"}[at]))

    return lines("r", "row_span").join(lines("c", "col_span"), KEY)


def cell_at(cells: DataFrame, row: int, col: int) -> DataFrame:
    """The cells that cover one slot of each table."""
    inside = lambda at, span, v: (F.col(at) <= v) & (F.col(at) + F.col(span) > v)
    return cells.where(inside("row", "row_span", row) & inside("col", "col_span", col))


def split_at(cells: DataFrame, row: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cells above a row, cells from it on (numbered anew), and the cells whose span would be cut."""
    cut = (F.col("row") < row) & (F.col("row") + F.col("row_span") > row)
    return cells.where(F.col("row") < row), cells.where(F.col("row") >= row).withColumn("row", F.col("row") - row), cells.where(cut)


def shared_edges(cells: DataFrame) -> DataFrame:
    """table_id, col, x0, x1: neighbouring columns meet halfway between their cells."""
    per = cells.groupBy(KEY, "col").agg(F.min("x0").alias("lo"), F.max("x1").alias("hi"))
    w = W.partitionBy(KEY).orderBy("col")
    before, after = F.lag("hi").over(w), F.lead("lo").over(w)
    return per.select(KEY, "col", F.coalesce((before + F.col("lo")) / 2, F.col("lo")).alias("x0"), F.coalesce((F.col("hi") + after) / 2, F.col("hi")).alias("x1"))


def aligned(cells: DataFrame, axes: DataFrame, least: float = 0.8) -> DataFrame:
    """table_id, fits: whether cells may move to new column edges (table_id, col, x0, x1): refused if
    any would hold less than a share of its content's width."""
    a = axes.select(KEY, "col", F.col("x0").alias("a0"), F.col("x1").alias("a1"))
    held = F.greatest(F.lit(0), F.least("a1", "x1") - F.greatest("a0", "x0")) >= least * (F.col("x1") - F.col("x0"))
    return cells.join(a, [KEY, "col"], "left").groupBy(KEY).agg(F.bool_and(F.coalesce(held, F.lit(False))).alias("fits"))


def snapped(cells: DataFrame, value: str, tolerance: float) -> DataFrame:
    """Edges of each table moved to the mean of their cluster (each within a tolerance of the one before)."""
    w = W.partitionBy(KEY).orderBy(value)
    new = F.coalesce(F.col(value) - F.lag(value).over(w) > tolerance, F.lit(True)).cast("int")
    marked = cells.withColumn("__n", new).withColumn("__c", F.sum("__n").over(w.rangeBetween(W.unboundedPreceding, 0)))
    return marked.withColumn(value, F.avg(value).over(W.partitionBy(KEY, "__c"))).drop("__n", "__c")


def seam_pairs(last: DataFrame, first: DataFrame, on: list[str], within: float = 5) -> DataFrame:
    """Cells of one row and of the next part's first row that stand at the same place (both edges within
    a distance). Columns get the prefixes a_ and b_."""
    a = last.select(*on, *(F.col(c).alias(f"a_{c}") for c in last.columns if c not in on))
    b = first.select(*on, *(F.col(c).alias(f"b_{c}") for c in first.columns if c not in on))
    near = (F.abs(F.col("a_x0") - F.col("b_x0")) <= within) & (F.abs(F.col("a_x1") - F.col("b_x1")) <= within)
    return a.join(b, on).where(near)


def seam_merge(a: Column, b: Column, type_a: Column, type_b: Column, type_both: Column) -> Column:
    """Whether two cells at a seam are one, by their texts alone: a blank continuation, or pieces of one
    value are; two numbers, equal texts, or texts of different kinds, aren't; null leaves it open.
    ``seams.cascade`` has all cases."""
    number = r"^\d+$"
    return (
        F.when((a == "") & (b == ""), None)
        .when(a.rlike(number) & b.rlike(number), False)
        .when(a.rlike(number) & (b == ""), True)
        .when(a == b, False)
        .when(b == "", True)
        .when((type_both != "text") & (type_a != type_both), True)
        .when(type_a != type_b, False)
    )


def select_columns(cells: DataFrame, start: int, end: int) -> DataFrame:
    """Cells that begin in some columns, numbered anew. (TAB-04)"""
    return cells.where((F.col("col") >= start) & (F.col("col") < end)).withColumn("col", F.col("col") - start)


def block(cells: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """Slots of a block of each table, with the cell that covers each: one row or column gives a
    spanning cell once, a larger block repeats it. (TAB-21)"""
    inside = grid(cells).where(F.col("r").between(rows[0], rows[1] - 1) & F.col("c").between(cols[0], cols[1] - 1))
    if rows[1] - rows[0] == 1 or cols[1] - cols[0] == 1:
        first = F.struct("r", "c")
        inside = inside.groupBy(KEY, "row", "col", "row_span", "col_span", "text").agg(F.min(first).alias("f")).select("*", "f.*").drop("f")
    return inside


def placed(cells: DataFrame, width: float, height: float) -> DataFrame:
    """Cells with estimated boxes: rows and columns share the table's box evenly, from the top. (TAB-16, TAB-19)"""
    w = shape(cells)
    at = cells.join(w, KEY)
    x = lambda c: F.col(c) * width / F.col("cols")
    y = lambda c: height - F.col(c) * height / F.col("rows")
    ends = at.withColumns({"__c": F.col("col") + F.col("col_span"), "__r": F.col("row") + F.col("row_span")})
    return ends.select(*cells.columns, x("col").alias("x0"), y("__r").alias("y0"), x("__c").alias("x1"), y("row").alias("y1"))


def as_record(cells: DataFrame) -> DataFrame:
    """table_id and the table as one struct: type, row_num, col_num and cells in order. (SNK-14)"""
    cell = F.struct("row", "col", "row_span", "col_span", "text")
    rows, cols = F.max(F.col("row") + F.col("row_span")), F.max(F.col("col") + F.col("col_span"))
    return cells.groupBy(KEY).agg(F.struct(F.lit("table").alias("type"), rows.alias("row_num"), cols.alias("col_num"), F.array_sort(F.collect_list(cell)).alias("cells")).alias("record"))
