"""Parts of pages: headers, footers, footnote rules, captions, columns, and what belongs to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import geometry as g
from foliant.operators.spatial import EDGES, box, prefixed

TEXT_TYPES = ("text", "title", "toc", "other_text", "code", "header", "footer", "footnote")

#: Caption patterns in order; the last one vetoes.
TITLES = [("numbered", r"^(Table|Figure|Fig\.|Chart|Tab\.)\s*\d+"), ("chinese", "^[表图]\\s*[0-9一二三四五六七八九十]+"), ("exhibit", r"^(Exhibit|Box)\s+\w+")]
UNIT = r"(?i)^\(?\s*(units?|in (millions|thousands)|单位)\s*[:：]?"
SOURCE = r"(?i)^(source|sources|note|notes|资料来源|注)\s*[:：]"
NUMBERED_NOTE = r"^[(\[]?\d{1,2}[)\].]\s"


def is_text(kind: Column) -> Column:
    return kind.isin(*TEXT_TYPES)


def is_header(kind: Column, raw: Column) -> Column:
    return (kind == "header") | F.coalesce(raw == "header_image", F.lit(False))


def caption_kind(text: Column) -> Column:
    """title, unit or source, the first that a line looks like; null for other lines."""
    title = text.rlike("|".join(f"(?:{p})" for _, p in TITLES)) & ~text.rlike(r"[.;]\s*$")
    return F.when(text.rlike(UNIT), "unit").when(text.rlike(SOURCE), "source").when(title, "title")


def sources(lines: DataFrame, group: list[str], order: str, text: str = "text") -> DataFrame:
    """Add ``source``: a source line, or a numbered note that goes on from one without a break."""
    kind, note = caption_kind(F.col(text)), F.col(text).rlike(NUMBERED_NOTE)
    w = W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    # where the last line that is neither stands, against the last source line
    other = F.max(F.when(~(F.coalesce(kind == "source", F.lit(False)) | note), F.col(order))).over(w)
    last = F.max(F.when(kind == "source", F.col(order))).over(w)
    return lines.withColumn("source", F.coalesce((last > F.coalesce(other, F.lit(-1))), F.lit(False)))


def page_boxes(objects: DataFrame) -> DataFrame:
    return objects.groupBy("page_id").agg(F.min("x0").alias("p_x0"), F.min("y0").alias("p_y0"), F.max("x1").alias("p_x1"), F.max("y1").alias("p_y1"))


def with_page(objects: DataFrame) -> DataFrame:
    """Add the page's box as p_x0 .. p_y1 to its objects; a window, so nothing is joined."""
    w = W.partitionBy("page_id")
    return objects.withColumns({"p_x0": F.min("x0").over(w), "p_y0": F.min("y0").over(w), "p_x1": F.max("x1").over(w), "p_y1": F.max("y1").over(w)})


def without_large(objects: DataFrame, share: float) -> DataFrame:
    """Objects that cover at most a share of their page; a page where that leaves none keeps all."""
    paged = with_page(objects)
    whole = (F.col("p_x1") - F.col("p_x0")) * (F.col("p_y1") - F.col("p_y0"))
    large = g.area(box()) > share * whole
    kept = F.count_if(~F.col("__large")).over(W.partitionBy("page_id"))
    marked = paged.withColumn("__large", large)
    return marked.withColumn("__kept", kept).where(~F.col("__large") | (F.col("__kept") == 0)).select(*objects.columns)


def header_bands(objects: DataFrame, within: float = 120) -> DataFrame:
    """page_id, x0, y0, x1, y1: from the lowest header object near the page's top up, as wide as the page."""
    paged = with_page(objects)
    near = F.when((F.col("kind") == "header") & (F.col("p_y1") - F.col("y1") <= within), F.col("y0"))
    band = paged.groupBy("page_id").agg(F.first("p_x0").alias("x0"), F.min(near).alias("y0"), F.first("p_x1").alias("x1"), F.first("p_y1").alias("y1"))
    return band.where("y0 is not null")


def footer_bands(objects: DataFrame, most: float = 200) -> DataFrame:
    """As header_bands, from the page's bottom; footers above ``most`` or the page's middle don't count."""
    paged = with_page(objects)
    limit = F.least(F.lit(most), (F.col("p_y1") - F.col("p_y0")) / 2)
    near = F.when((F.col("kind") == "footer") & (F.col("y1") - F.col("p_y0") <= limit), F.col("y1"))
    band = paged.groupBy("page_id").agg(F.first("p_x0").alias("x0"), F.first("p_y0").alias("y0"), F.first("p_x1").alias("x1"), F.max(near).alias("y1"))
    return band.where("y1 is not null")


def absorbed(objects: DataFrame, bands: DataFrame, least: float = 0.5) -> DataFrame:
    """page_id, obj_id of the objects that lie in a page's band by a share of their area."""
    found = objects.join(prefixed(bands, "b_"), "page_id")
    return found.where(g.contained_ratio(box("b_"), box()) >= least).select("page_id", "obj_id")


def footnote_rules(objects: DataFrame, bottom: float = 0.28, narrow: float = 20, wide: float = 0.75, thin: float = 30) -> DataFrame:
    """Flat objects in the lowest part of a page, neither short nor nearly as wide as the page."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    low = F.col("y0") <= F.col("p_y0") + bottom * (F.col("p_y1") - F.col("p_y0"))
    paged = with_page(objects)
    return paged.where((h <= thin) & low & (w >= narrow) & (w <= wide * (F.col("p_x1") - F.col("p_x0")))).select(*objects.columns)


def column_of(objects: DataFrame, columns: DataFrame, least: float = 0.8) -> DataFrame:
    """page_id, obj_id, column_no: the first column that holds a share of an object's area; null for none."""
    c = prefixed(columns.select("page_id", "column_no", *EDGES), "c_")
    found = objects.select("page_id", "obj_id", *EDGES).join(c, "page_id", "left")
    holds = F.when(g.contained_ratio(box("c_"), box()) >= least, F.col("c_column_no"))
    return found.groupBy("page_id", "obj_id").agg(F.min(holds).alias("column_no"))


def reading_rows(objects: DataFrame, within: float = 10) -> DataFrame:
    """page_id, obj_id, row, place: tops within a distance of the one before make a row, ordered by x."""
    w = W.partitionBy("page_id").orderBy("y0", "obj_id")
    new = F.coalesce(F.col("y0") - F.lag("y0").over(w) > within, F.lit(True)).cast("int")
    rows = objects.select("page_id", "obj_id", "x0", "y0", new.alias("__n"))
    rows = rows.withColumn("row", F.sum("__n").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.select("page_id", "obj_id", "row", F.row_number().over(W.partitionBy("page_id", "row").orderBy("x0", "obj_id")).alias("place"))


def candidates(main: DataFrame, texts: DataFrame, window: float = 50) -> DataFrame:
    """page_id, obj_id, text_id, kind, gap: caption lines above (titles, units) or below (sources) an
    object that overlap it in x and stand within a window; units only count beside a title."""
    t = prefixed(texts.select("page_id", "obj_id", "kind", *EDGES), "t_")
    found = main.select("page_id", "obj_id", *EDGES).join(t, "page_id")
    above, below = F.col("t_y0") - F.col("y1"), F.col("y0") - F.col("t_y1")
    gap = F.when(F.col("t_kind").isin("title", "unit"), above).otherwise(below)
    found = found.withColumn("gap", gap).where(F.col("gap").between(0, window) & (F.col("x0") < F.col("t_x1")) & (F.col("t_x0") < F.col("x1")) & (F.col("obj_id") != F.col("t_obj_id")))
    titles = F.count_if(F.col("t_kind") == "title").over(W.partitionBy("page_id", "obj_id"))
    found = found.withColumn("__t", titles).where((F.col("t_kind") != "unit") | (F.col("__t") > 0))
    return found.select("page_id", "obj_id", F.col("t_obj_id").alias("text_id"), F.col("t_kind").alias("kind"), "gap")


def blocks(main: DataFrame, texts: DataFrame, window: float = 50) -> DataFrame:
    """page_id, obj_id, x0, y0, x1, y1, captions: objects together with the nearest title above and the nearest
    source below. (LAY-01)"""
    met = candidates(main, texts, window).where(F.col("kind").isin("title", "source"))
    nth = F.row_number().over(W.partitionBy("page_id", "obj_id", "kind").orderBy("gap", "text_id"))
    near = met.withColumn("__n", nth).where("__n = 1").select("page_id", "obj_id", "text_id")
    boxes = near.join(texts.select("page_id", F.col("obj_id").alias("text_id"), *EDGES), ["page_id", "text_id"]).select("page_id", "obj_id", *EDGES, F.lit(1).alias("__c"))
    every = main.select("page_id", "obj_id", *EDGES, F.lit(0).alias("__c")).unionByName(boxes)
    edges = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    return every.groupBy("page_id", "obj_id").agg(*edges, F.sum("__c").alias("captions"))


def part_rows(parts: DataFrame) -> DataFrame:
    """page_id, obj_id, row, col: parts whose heights overlap, directly or by others, are a row from the top; in
    a row they go from left to right. (LAY-02, LAY-03)"""
    up = W.partitionBy("page_id").orderBy("y0", "y1", "obj_id")
    top = F.max("y1").over(up.rowsBetween(W.unboundedPreceding, -1))
    marked = parts.withColumn("__new", F.coalesce((F.col("y0") >= top), F.lit(True)).cast("int"))
    marked = marked.withColumn("__n", F.sum("__new").over(up.rowsBetween(W.unboundedPreceding, 0)))
    row = F.max("__n").over(W.partitionBy("page_id")) - F.col("__n")
    return marked.select("page_id", "obj_id", row.alias("row"), (F.row_number().over(W.partitionBy("page_id", "__n").orderBy("x0", "obj_id")) - 1).alias("col"))
