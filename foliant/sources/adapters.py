"""Document-shaped tables from plain ones: positioned lines, boxes, HTML nodes."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.runtime import dealt

#: Lines of a page, and the measures of the line grid.
PAGE_LINES, LINE_HEIGHT, CHAR_WIDTH, TOP = 40, 12, 6, 800


def doc_lines(documents: DataFrame) -> DataFrame:
    """doc_id, line_no, page_no, text and box of each line; no shuffle."""
    lines = documents.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "text"))
    y1 = TOP - LINE_HEIGHT * F.pmod(F.col("line_no"), F.lit(PAGE_LINES))
    return lines.select(
        "doc_id", "line_no", (F.floor(F.col("line_no") / PAGE_LINES) + 1).cast("int").alias("page_no"), "text",
        F.lit(0).alias("x0"), (y1 - 10).alias("y0"), (CHAR_WIDTH * F.length("text")).alias("x1"), y1.alias("y1"),
    )


def boxes(lineitem: DataFrame) -> DataFrame:
    """page_id, obj_id, kind, x0, y0, x1, y1: a page for each order, all integers.

    The number within the page orders by all columns, since the line number isn't unique. One
    shuffle by page; what follows by page needs no other. Its tasks get more as the table grows, not larger.
    """
    lineitem = dealt(lineitem, "l_orderkey")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]
    n = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order)).cast("long")
    part, supp, quantity, line = (F.col(c).cast("long") for c in ("l_partkey", "l_suppkey", "l_quantity", "l_linenumber"))
    rows = lineitem.select(F.col("l_orderkey").alias("page_id"), n.alias("obj_id"), F.col("l_returnflag").alias("kind"), (part * 7 % 300).alias("x0"), (supp * 13 % 200).alias("y0"), (quantity * 4).alias("w"), (line * 20).alias("h"))
    return rows.select("page_id", "obj_id", "kind", "x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("h")).alias("y1"))


class _Nodes(HTMLParser):
    _void = {"br", "img", "hr", "meta", "link", "input"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[dict] = []
        self.nodes: list[dict] = []

    def handle_starttag(self, tag, attrs):
        node = {"seq": len(self.nodes), "tag": tag, "depth": len(self.open), "text": "", "href": dict(attrs).get("href")}
        self.nodes.append(node)
        if tag not in self._void:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in self._void:
            self.open.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i]["tag"] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        if self.open and data.strip():
            own = self.open[-1]
            own["text"] = f"{own['text']} {data.strip()}".strip()


NODES = "page_id long, seq int, tag string, depth int, text string, href string"


def html_nodes(pages: DataFrame) -> DataFrame:
    """Elements of each page in order, with their own text and link target."""
    schema = pa.schema([("page_id", pa.int64()), ("seq", pa.int32()), ("tag", pa.string()), ("depth", pa.int32()), ("text", pa.string()), ("href", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parser = _Nodes()
                parser.feed(html or "")
                rows += [{"page_id": page, **n} for n in parser.nodes]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return pages.select("page_id", "html").mapInArrow(run, NODES)
