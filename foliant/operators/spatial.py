"""Joins of boxes on a page: containment, overlap, nearest, best region, consume-once.

Every join has the page as its equi-key, so Spark plans a hash or sort-merge join and the
inequalities are its residual; pages are dealt over the cluster and never compared to each other.
Inputs have page_id, obj_id and the edges x0, y0, x1, y1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import geometry as g

EDGES = ("x0", "y0", "x1", "y1")


def box(prefix: str = "") -> Column:
    return F.struct(*(F.col(prefix + e).alias(e) for e in EDGES))


def prefixed(df: DataFrame, prefix: str, keep: str = "page_id") -> DataFrame:
    return df.select(keep, *(F.col(c).alias(prefix + c) for c in df.columns if c != keep))


def pairs(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    """Inner join by page; columns get the prefixes a_ and b_."""
    return prefixed(left, "a_").join(prefixed(right, "b_"), "page_id").where(condition)


def region_select(objects: DataFrame, regions: DataFrame, ratio: float = 1.0, exclude: DataFrame | None = None) -> DataFrame:
    """page_id, region_id, obj_id, rank of objects that lie in a region by a share of their area.

    ``regions`` has region_id. Objects of ``exclude`` (page_id, obj_id) are left out. Rank goes
    from the top down.
    """
    if exclude is not None:
        objects = objects.join(exclude.select("page_id", "obj_id"), ["page_id", "obj_id"], "left_anti")
    r = prefixed(regions.select("page_id", "region_id", *EDGES), "r_")
    hit = (g.area(box("r_")) > 0) & (g.contained_ratio(box("r_"), box()) >= ratio)
    top = W.partitionBy("page_id", "r_region_id").orderBy(F.desc("y1"), "obj_id")
    found = objects.select("page_id", "obj_id", *EDGES).join(r, "page_id").where(hit)
    return found.select("page_id", F.col("r_region_id").alias("region_id"), "obj_id", F.row_number().over(top).alias("rank"))


def region_claim(objects: DataFrame, regions: DataFrame, ratio: float) -> DataFrame:
    """As region_select, but an object goes to the first region (by region_id) that holds it."""
    found = region_select(objects, regions, ratio)
    first = F.row_number().over(W.partitionBy("page_id", "obj_id").orderBy("region_id"))
    return found.select("page_id", "region_id", "obj_id", first.alias("__n")).where("__n = 1").drop("__n")


def two_pass_claim(objects: DataFrame, regions: DataFrame, first: float = 0.7, second: float = 0.4) -> DataFrame:
    """page_id, region_id, obj_id, pass: what the strict pass leaves goes by the lax one. One join: a
    window prefers the strict pass, then the first region. (JON-06)"""
    r = prefixed(regions.select("page_id", "region_id", *EDGES), "r_")
    share = F.when(g.area(box("r_")) > 0, g.contained_ratio(box("r_"), box()))
    found = objects.select("page_id", "obj_id", *EDGES).join(r, "page_id").withColumn("__s", share).where(F.col("__s") >= min(first, second))
    found = found.withColumn("pass", F.when(F.col("__s") >= first, 1).otherwise(2))
    n = F.row_number().over(W.partitionBy("page_id", "obj_id").orderBy("pass", "r_region_id"))
    return found.withColumn("__n", n).where("__n = 1").select("page_id", F.col("r_region_id").alias("region_id"), "obj_id", "pass")


def best_region(objects: DataFrame, regions: DataFrame, least: float = 0.5) -> DataFrame:
    """page_id, region_id, obj_id of the region with the largest share of each object."""
    r = prefixed(regions.select("page_id", "region_id", *EDGES), "r_")
    share = g.contained_ratio(box("r_"), box())
    found = objects.select("page_id", "obj_id", *EDGES).join(r, "page_id").withColumn("share", share).where(F.col("share") >= least)
    n = F.row_number().over(W.partitionBy("page_id", "obj_id").orderBy(F.desc("share"), "r_region_id"))
    return found.withColumn("n", n).where("n = 1").select("page_id", F.col("r_region_id").alias("region_id"), "obj_id")


def _overlaps(ratio: float) -> Column:
    return g.overlap_small(box(), box("o_")) > ratio


def overlap_semi(objects: DataFrame, others: DataFrame, ratio: float = 0.0) -> DataFrame:
    """Objects that some other overlaps by more than a share of the smaller area."""
    o = prefixed(others.select("page_id", "obj_id", *EDGES), "o_")
    return objects.join(o, (objects.page_id == o.page_id) & (F.col("obj_id") != F.col("o_obj_id")) & _overlaps(ratio), "left_semi")


def overlap_anti(objects: DataFrame, others: DataFrame, ratio: float = 0.0) -> DataFrame:
    """Objects that no other overlaps so."""
    o = prefixed(others.select("page_id", "obj_id", *EDGES), "o_")
    return objects.join(o, (objects.page_id == o.page_id) & (F.col("obj_id") != F.col("o_obj_id")) & _overlaps(ratio), "left_anti")


def overlap_all(objects: DataFrame, others: DataFrame, ratio: float = 0.0) -> DataFrame:
    """Objects that every other of the page overlaps so; a page without others counts."""
    o = prefixed(others.select("page_id", "obj_id", *EDGES), "o_")
    return objects.join(o, (objects.page_id == o.page_id) & (F.col("obj_id") != F.col("o_obj_id")) & ~_overlaps(ratio), "left_anti")


def nearest(objects: DataFrame, candidates: DataFrame, above: bool = True) -> DataFrame:
    """page_id, obj_id, near_id, distance of the nearest candidate above or below that overlaps in x."""
    c = prefixed(candidates.select("page_id", "obj_id", *EDGES), "c_")
    gap = F.col("c_y0") - F.col("y1") if above else F.col("y0") - F.col("c_y1")
    found = objects.select("page_id", "obj_id", *EDGES).join(c, "page_id").where((F.col("c_obj_id") != F.col("obj_id")) & (gap >= 0) & (F.col("x0") < F.col("c_x1")) & (F.col("c_x0") < F.col("x1")))
    n = F.row_number().over(W.partitionBy("page_id", "obj_id").orderBy("distance", "c_obj_id"))
    return found.withColumn("distance", gap).withColumn("n", n).where("n = 1").select("page_id", "obj_id", F.col("c_obj_id").alias("near_id"), "distance")


def page_union(objects: DataFrame) -> DataFrame:
    """page_id, objects, and the box of all; partial sums before the shuffle."""
    return objects.groupBy("page_id").agg(F.count("*").alias("objects"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def fill_color(cells: DataFrame, rects: DataFrame, least: float = 0.5) -> DataFrame:
    """page_id, obj_id, color: the colour whose rects share most area with a cell."""
    r = prefixed(rects.select("page_id", "obj_id", "color", *EDGES), "r_")
    found = cells.select("page_id", "obj_id", *EDGES).join(r, "page_id").withColumn("common", g.intersection_area2(box(), box("r_")))
    found = found.where(F.col("common") / F.least(g.area2(box()), g.area2(box("r_"))) >= least)
    return found.groupBy("page_id", "obj_id", "r_color").agg(F.sum("common").alias("a")).groupBy("page_id", "obj_id").agg(F.max_by("r_color", F.struct("a", "r_color")).alias("color"))
