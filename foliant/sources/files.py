"""Documents from files: types, page lists, layout and OCR results, phrase dictionaries."""

from __future__ import annotations

import io
import json
import re
import zipfile
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_SUFFIXES = ("png", "jpg", "jpeg", "webp", "bmp")
_MAGIC = [("pdf", "25504446"), ("png", "89504E470D0A1A0A"), ("jpg", "FFD8FF"), ("bmp", "424D")]

LAYOUT = "number int, width double, height double, objects array<struct<type string, raw_type string, score double, bbox array<double>, quad array<array<double>>>>"
OCR = "width double, height double, spans array<struct<text string, score double, quad array<array<double>>, bbox array<double>>>"

#: Names that a layout model gives, and the types they stand for.
TYPES = {
    "paragraph_title": "title", "doc_title": "title", "figure_title": "title", "text": "text", "abstract": "text", "reference_content": "text", "content": "toc",
    "image": "figure", "chart": "chart", "table": "table", "seal": "seal", "display_formula": "formula", "inline_formula": "inline_formula",
    "header": "header", "footer": "footer", "number": "footer", "footnote": "footnote", "vision_footnote": "text", "header_image": "header_figure", "footer_image": "footer_figure", "algorithm": "code",
}


def file_type(content: Column, path: Column) -> Column:
    """By the first bytes; the suffix only where they tell nothing. Null for other files."""
    head = F.hex(F.substring(content, 1, 12))
    by_head = F.when(head.rlike("^52494646.{8}57454250"), "webp")
    for name, magic in _MAGIC:
        by_head = by_head.when(head.startswith(magic), name)
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(by_head, F.when(suffix == "jpeg", "jpg").when(suffix.isin("pdf", "png", "jpg", "webp", "bmp"), suffix))


def read_documents(spark: SparkSession, directory: str, glob: str = "*.{pdf,png,jpg,jpeg,webp,bmp}") -> DataFrame:
    """path, filetype, length, content of the files of a folder; dot files are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(directory)
    files = files.where(~F.col("path").rlike(r"/\.[^/]*$"))
    return files.select("path", file_type(F.col("content"), F.col("path")).alias("filetype"), "length", "content").where("filetype is not null")


def page_images(files: DataFrame) -> DataFrame:
    """doc (a folder), page_no, path: a folder of images named by number is one document."""
    stem, suffix = F.regexp_extract("path", r"/(\d+)\.[^./]+$", 1), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.where((stem != "") & suffix.isin(*PAGE_SUFFIXES)).select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("doc"), stem.cast("int").alias("page_no"), "path")


def select_pages(pages: DataFrame, wanted: DataFrame, done: DataFrame) -> DataFrame:
    """Add ``pending`` to the wanted pages that exist: those not done yet."""
    known = done.select("doc", "page_no").distinct().withColumn("__d", F.lit(True))
    found = pages.join(wanted.select("doc", "page_no").distinct(), ["doc", "page_no"], "left_semi")
    return found.join(known, ["doc", "page_no"], "left").withColumn("pending", F.col("__d").isNull()).drop("__d")


def rotated(pages: DataFrame) -> DataFrame:
    """Width and height change places at 90 and 270 degrees; measures to one digit."""
    turn = F.pmod(F.col("rotation"), F.lit(360))
    side = turn.isin(90, 270)
    return pages.withColumns({"rotation": turn, "width": F.bround(F.when(side, F.col("height")).otherwise(F.col("width")), 1), "height": F.bround(F.when(side, F.col("width")).otherwise(F.col("height")), 1)})


def load_layout(results: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """Objects of detector results (page_id, json), flipped to a bottom-left origin."""
    parsed = results.select("page_id", F.from_json("json", LAYOUT).alias("p")).select("page_id", F.col("p.height").alias("h"), F.posexplode("p.objects").alias("obj_id", "o"))
    xs = F.transform(F.col("o.quad"), lambda p: p[0])
    ys = F.transform(F.col("o.quad"), lambda p: p[1])
    edge = lambda i, v, f: F.coalesce(F.col("o.bbox")[i], f(v))
    names = F.create_map(*[F.lit(v) for kv in TYPES.items() for v in kv])
    out = parsed.select("page_id", F.col("obj_id").cast("long").alias("obj_id"), F.coalesce(names[F.col("o.type")], F.col("o.type")).alias("type"), F.coalesce("o.raw_type", "o.type").alias("raw_type"), "o.score",
        edge(0, xs, F.array_min).alias("x0"), (F.col("h") - edge(3, ys, F.array_max)).alias("y0"), edge(2, xs, F.array_max).alias("x1"), (F.col("h") - edge(1, ys, F.array_min)).alias("y1"))
    return out if types is None else out.where(F.col("type").isin(*types))


def load_ocr(results: DataFrame) -> DataFrame:
    """Spans of OCR results (page_id, json), flipped to a bottom-left origin."""
    parsed = results.select("page_id", F.from_json("json", OCR).alias("p")).select("page_id", F.col("p.height").alias("h"), F.posexplode("p.spans").alias("seq", "s"))
    xs, ys = F.transform(F.col("s.quad"), lambda p: p[0]), F.transform(F.col("s.quad"), lambda p: p[1])
    return parsed.select("page_id", "seq", "s.text", "s.score", F.coalesce(F.col("s.bbox")[0], F.array_min(xs)).alias("x0"), (F.col("h") - F.coalesce(F.col("s.bbox")[3], F.array_max(ys))).alias("y0"), F.coalesce(F.col("s.bbox")[2], F.array_max(xs)).alias("x1"), (F.col("h") - F.coalesce(F.col("s.bbox")[1], F.array_min(ys))).alias("y1"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """kind (text or pattern), value of a dictionary file: sections begin with #text or #pattern."""
    lines = spark.read.option("wholetext", True).text(path).select(F.posexplode(F.split("value", "\n")).alias("n", "v"))
    kind = F.regexp_extract("v", "^#(text|pattern)$", 1)
    from pyspark.sql import Window as W

    order = W.orderBy("n").rowsBetween(W.unboundedPreceding, 0)  # one small file
    marked = lines.withColumn("kind", F.last(F.nullif(kind, F.lit("")), ignorenulls=True).over(order))
    return marked.where(~F.col("v").startswith("#") & (F.trim("v") != "")).select(F.coalesce("kind", F.lit("text")).alias("kind"), F.trim("v").alias("value"))


class TooLarge(ValueError):
    """An archive holds more than is allowed."""


def unzip(data: bytes, most_files: int, most_bytes: int, names: str = r"[^/\\]+") -> list[tuple[str, bytes]]:
    """Files of a flat archive within limits; folders and other names are left out."""
    out: list[tuple[str, bytes]] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for info in z.infolist():
            if info.is_dir() or not re.fullmatch(names, info.filename):
                continue
            if len(out) == most_files:
                raise TooLarge("too many files")
            with z.open(info) as f:
                content = f.read(most_bytes + 1)
            if len(content) > most_bytes:
                raise TooLarge(info.filename)
            out.append((info.filename, content))
    return out


def gunzip(data: bytes, most_bytes: int) -> bytes:
    d = zlib.decompressobj(31)
    out = d.decompress(data, most_bytes + 1)
    if len(out) > most_bytes:
        raise TooLarge("gzip")
    return out


def unzip_files(files: DataFrame, most_files: int, most_bytes: int) -> DataFrame:
    """path, name, content of the files in each archive (path, content)."""
    schema = pa.schema([("path", pa.string()), ("name", pa.string()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.RecordBatch.from_pylist([{"path": path, "name": n, "content": c} for n, c in unzip(content, most_files, most_bytes)], schema)

    return files.select("path", "content").mapInArrow(run, "path string, name string, content binary")


def page_count(content: bytes) -> int:
    """Pages of a PDF by the count in its page tree; an error where none is found."""
    counts = [int(m[1]) for m in re.finditer(rb"/Type\s*/Pages\b[^>]*?/Count\s+(\d+)|/Count\s+(\d+)[^>]*?/Type\s*/Pages\b", content) if m[1]] + [int(m[1]) for m in re.finditer(rb"/Count\s+(\d+)[^>]*?/Type\s*/Pages\b", content)]
    leaves = len(re.findall(rb"/Type\s*/Page\b(?!s)", content))
    if not content.startswith(b"%PDF") or not (counts or leaves):
        raise ValueError("not a valid PDF")
    return max([leaves, *counts])


def merge_settings(base: dict, dotted: dict[str, object]) -> dict:
    """A copy of nested settings with values set by dotted keys."""
    out = json.loads(json.dumps(base))
    for key, value in dotted.items():
        at, parts = out, key.split(".")
        for p in parts[:-1]:
            at = at.setdefault(p, {})
        at[parts[-1]] = value
    return out


def parse_assignments(items: Sequence[str]) -> dict[str, object]:
    """``key=value`` with JSON values; what isn't JSON is text."""
    out: dict[str, object] = {}
    for item in items:
        key, _, value = item.partition("=")
        try:
            out[key.strip()] = json.loads(value)
        except ValueError:
            out[key.strip()] = value
    return out
