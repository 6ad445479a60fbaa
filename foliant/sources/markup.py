"""Tables out of HTML and OTSL texts, as cells (row, col, row_span, col_span, text)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import geometry as g

CELL = "row int, col int, row_span int, col_span int, text string"
_TOKENS = {"<fcel>": "full", "<ecel>": "empty", "<lcel>": "left", "<ucel>": "up", "<xcel>": "cross", "<nl>": "end"}
_TOKEN = re.compile("|".join(_TOKENS))


class _Table(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.cells: list[dict] = []
        self.taken: set[tuple[int, int]] = set()
        self.row, self.col, self.open = -1, 0, None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.row, self.col, self.open = self.row + 1, 0, None
        elif tag in ("td", "th"):
            if self.row < 0:
                self.row = 0
            span = {k: max(1, int(v)) if (v or "").isdigit() else 1 for k, v in attrs if k in ("rowspan", "colspan")}
            while (self.row, self.col) in self.taken:
                self.col += 1
            r, c = span.get("rowspan", 1), span.get("colspan", 1)
            self.taken |= {(self.row + i, self.col + j) for i in range(r) for j in range(c)}
            self.open = {"row": self.row, "col": self.col, "row_span": r, "col_span": c, "text": ""}
            self.cells.append(self.open)
            self.col += c

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.open = None

    def handle_data(self, data):
        if self.open is not None:
            self.open["text"] = f"{self.open['text']} {data.strip()}".strip()


def html_cells(html: str) -> list[dict]:
    """Cells of the table in an HTML text; a slot that a span takes is skipped."""
    parser = _Table()
    parser.feed(html)
    return parser.cells


def otsl_grid(text: str) -> list[list[tuple[str, str]]]:
    """Rows of (kind, text), padded with empty cells to one length."""
    marks = list(_TOKEN.finditer(text))
    rows: list[list[tuple[str, str]]] = [[]]
    for m, after in zip(marks, [*marks[1:], None], strict=True):
        kind = _TOKENS[m[0]]
        if kind == "end":
            rows.append([])
        else:
            rows[-1].append((kind, text[m.end() : after.start() if after else len(text)].strip()))
    rows = [r for r in rows if r]
    width = max(map(len, rows), default=0)
    return [r + [("empty", "")] * (width - len(r)) for r in rows]


def otsl_cells(text: str) -> list[dict]:
    """Cells of an OTSL text; left, up and cross cells belong to the cell they extend."""
    rows = otsl_grid(text)
    out = []
    for r, row in enumerate(rows):
        for c, (kind, said) in enumerate(row):
            if kind not in ("full", "empty"):
                continue
            w = h = 1
            while c + w < len(row) and row[c + w][0] in ("left", "cross"):
                w += 1
            while r + h < len(rows) and rows[r + h][c][0] in ("up", "cross"):
                h += 1
            out.append({"row": r, "col": c, "row_span": h, "col_span": w, "text": said})
    return out


def cells(tables: DataFrame, parse: Callable[[str], list[dict]], key: str = "table_id", text: str = "text") -> DataFrame:
    """key and the cells of each row's text."""
    schema = pa.schema([(key, pa.int64()), ("row", pa.int32()), ("col", pa.int32()), ("row_span", pa.int32()), ("col_span", pa.int32()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{key: k, **c} for k, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for c in parse(t or "")]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return tables.select(key, text).mapInArrow(run, f"{key} long, {CELL}")


#: How a chat model marks an object: its type, its box in thousandths, and its text.
GROUNDED = r"(?s)<\|ref\|>(.*?)<\|/ref\|><\|det\|>\[\[(\d+(?:\s*,\s*\d+){3})\]\]<\|/det\|>(.*?)(?=<\|ref\|>|$)"


def grounded_objects(pages: DataFrame, text: str = "text", width: Column | None = None, height: Column | None = None) -> DataFrame:
    """page_id, seq, type, text, box of the objects in a model's answer; boxes that are empty are left out."""
    w, h = F.col("width") if width is None else width, F.col("height") if height is None else height
    part = lambda i: F.regexp_extract_all(text, F.lit(GROUNDED), F.lit(i))
    rows = pages.select("page_id", w.alias("__w"), h.alias("__h"), F.posexplode(F.arrays_zip(part(1).alias("type"), part(2).alias("box"), part(3).alias("text"))).alias("seq", "o"))
    bare = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    edges = F.transform(F.split(F.col("o.box"), r"\s*,\s*"), lambda x: x.cast("double"))
    box = F.struct(*(edges[i].alias(e) for i, e in enumerate(("x0", "y0", "x1", "y1"))))
    placed = g.from_thousandths(box, F.col("__w"), F.col("__h"))
    return rows.select("page_id", "seq", bare("o.type").alias("type"), bare("o.text").alias("text"), placed.alias("box")).where("box is not null")
