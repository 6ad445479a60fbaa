"""Shared parts of the queries: adapters in Spark and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.runtime import table
from foliant.sources import adapters

BOXES = """boxes AS (
  SELECT page_id, obj_id, kind, x0, y0, x0 + w AS x1, y0 + h AS y1 FROM (
    SELECT l_orderkey AS page_id,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS obj_id,
      l_returnflag AS kind, CAST(l_partkey AS BIGINT) * 7 % 300 AS x0, CAST(l_suppkey AS BIGINT) * 13 % 200 AS y0,
      CAST(l_quantity AS BIGINT) * 4 AS w, CAST(l_linenumber AS BIGINT) * 20 AS h FROM lineitem))"""
LINES = """lines AS (
  SELECT doc_id, line_no, CAST(line_no // 40 + 1 AS INTEGER) AS page_no, text, 0 AS x0, 800 - 12 * (line_no % 40) - 10 AS y0, 6 * length(text) AS x1, 800 - 12 * (line_no % 40) AS y1 FROM (
    SELECT doc_id, unnest(range(len(t))) AS line_no, unnest(t) AS text FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS t FROM documents)))"""
#: Width and height that count as 1 when 0, of the intersection of a and b.
COMMON = """CASE WHEN least(a.x1, b.x1) < greatest(a.x0, b.x0) OR least(a.y1, b.y1) < greatest(a.y0, b.y0) THEN 0
  ELSE (CASE WHEN least(a.x1, b.x1) = greatest(a.x0, b.x0) THEN 1 ELSE least(a.x1, b.x1) - greatest(a.x0, b.x0) END)
     * (CASE WHEN least(a.y1, b.y1) = greatest(a.y0, b.y0) THEN 1 ELSE least(a.y1, b.y1) - greatest(a.y0, b.y0) END) END"""


def area2(t: str) -> str:
    return f"((CASE WHEN {t}.x1 = {t}.x0 THEN 1 ELSE {t}.x1 - {t}.x0 END) * (CASE WHEN {t}.y1 = {t}.y0 THEN 1 ELSE {t}.y1 - {t}.y0 END))"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.boxes(table(spark, sf_dir, "lineitem"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.doc_lines(table(spark, sf_dir, "documents"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def md5(name: str):
    return F.md5(F.col(name).cast("binary")).alias("digest")


def with_sql(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
