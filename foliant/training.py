"""Training sets for detectors: annotations from label files, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.runtime import join_dimension, numbered

LABELS = "imagePath string, imageWidth int, imageHeight int, shapes array<struct<label string, points array<array<double>>, shape_type string>>"


def annotations(files: DataFrame, known: list[str], add_new: bool = False) -> DataFrame:
    """path, label, x, y, w, h of the rectangles in label files (path, json).

    Shapes that aren't boxes are left out, and so are labels that aren't known unless new ones may be added.
    """
    shapes = files.select("path", F.from_json("json", LABELS).alias("p")).select("path", F.explode("p.shapes").alias("s"))
    xs, ys = F.transform("s.points", lambda p: p[0]), F.transform("s.points", lambda p: p[1])
    boxes = shapes.where((F.col("s.shape_type") == "rectangle") & (F.size("s.points") >= 2))
    out = boxes.select("path", F.col("s.label").alias("label"), F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("w"), (F.array_max(ys) - F.array_min(ys)).alias("h"))
    return out.where("w > 0 and h > 0") if add_new else out.where((F.col("w") > 0) & (F.col("h") > 0) & F.col("label").isin(*known))


def coco(found: DataFrame) -> DataFrame:
    """Adds image_id and category_id, numbered from 1 in order of path and label, and each box's area."""
    images, labels = numbered(found, ["path"], "image_id"), numbered(found, ["label"], "category_id")
    return join_dimension(found.join(images, "path"), labels, ["label"]).withColumn("area", F.col("w") * F.col("h"))


def statistics(files: DataFrame, known: list[str]) -> DataFrame:
    """label, n, skipped of all shapes: how often it comes, and whether ``annotations`` leaves it out."""
    shapes = files.select(F.explode(F.from_json("json", LABELS)["shapes"]).alias("s"))
    return shapes.groupBy(F.col("s.label").alias("label")).agg(F.count("*").alias("n")).withColumn("skipped", ~F.col("label").isin(*known))
