"""Documents out: Markdown, JSON and HTML columns, and bundles of files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import md_escape


def _joined(order: str, value: Column, between: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), value.alias("v")))), lambda x: x["v"]), between)


def page_markdown(objects: DataFrame) -> DataFrame:
    """doc_id, page_no, markdown of objects (seq, type, text, level, latex, html) in reading order."""
    md = (
        F.when(F.col("type") == "title", F.concat(F.repeat(F.lit("#"), F.coalesce("level", F.lit(1))), F.lit(" "), md_escape(F.col("text"))))
        .when(F.col("type") == "formula", F.concat(F.lit("$$\n"), F.col("latex"), F.lit("\n$$")))
        .when(F.col("type") == "table", F.col("html"))
        .when(F.col("type") == "figure", F.concat(F.lit("![]("), F.col("text"), F.lit(")")))
        .otherwise(md_escape(F.col("text")))
    )
    return objects.groupBy("doc_id", "page_no").agg(_joined("seq", F.coalesce(md, F.lit("")), "\n\n").alias("markdown"))


def document_markdown(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(_joined("page_no", F.col("markdown"), "\n\n").alias("markdown"))


def page_json(objects: DataFrame) -> DataFrame:
    """doc_id, page_no, json; null keys are left out."""
    box = F.array(*(F.bround(F.col(e).cast("double"), 1) for e in ("x0", "y0", "x1", "y1"))).alias("bbox")
    obj = F.struct("seq", F.struct("type", box, "text").alias("o"))
    listed = F.transform(F.array_sort(F.collect_list(obj)), lambda x: x["o"])
    return objects.groupBy("doc_id", "page_no").agg(listed.alias("objects")).select("doc_id", "page_no", F.to_json(F.struct(F.col("page_no").alias("number"), "objects")).alias("json"))


def document_json(pages: DataFrame) -> DataFrame:
    """doc_id, json of pages in order."""
    return pages.groupBy("doc_id").agg(F.concat(F.lit('{"pages":['), _joined("page_no", F.col("json"), ","), F.lit("]}")).alias("json"))


def page_html(objects: DataFrame, scale: float = 1.0) -> DataFrame:
    """doc_id, page_no, html: positioned blocks, top-left by the page's height."""
    text = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    px = lambda c: F.concat(F.bround(c * scale, 1).cast("string"), F.lit("px"))
    div = F.concat(F.lit('<div style="position:absolute;left:'), px(F.col("x0")), F.lit(";top:"), px(F.col("height") - F.col("y1")), F.lit('">'), text, F.lit("</div>"))
    return objects.groupBy("doc_id", "page_no").agg(F.concat(F.lit('<section class="page">'), _joined("seq", div, ""), F.lit("</section>")).alias("html"))


def bundle_names(defaults: Sequence[str], requested: Column) -> Column:
    """What is asked for, of what there is; all defaults where nothing is asked for."""
    every = F.array(*map(F.lit, defaults))
    return F.when(requested.isNull() | (F.size(requested) == 0), every).otherwise(F.array_intersect(every, requested))


def bundles(files: DataFrame) -> DataFrame:
    """doc_id, zip of rows (doc_id, files: map of name to text); names in order, fixed times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for files in batch.column("files").to_pylist():
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                    for name, text in sorted(files or []):
                        z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text)
                out.append(buffer.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "zip"])

    return files.select("doc_id", "files").mapInArrow(run, "doc_id long, zip binary")
