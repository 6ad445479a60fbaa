"""Sources, sinks, models and plug-ins on hand-made inputs."""

from __future__ import annotations

import gzip
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from foliant import features, models
from foliant.sources import adapters, files, markup, sinks


def test_file_types_and_folders(spark, tmp_path):
    (tmp_path / "doc").mkdir()
    samples = {"a.pdf": b"%PDF-1.4 x", "b.bin.png": b"\x89PNG\r\n\x1a\n..", "c.png": b"%PDF-1.7", ".hidden.pdf": b"%PDF", "d.txt": b"hello", "e.jpeg": b"unknown"}
    for name, data in samples.items():
        (tmp_path / name).write_bytes(data)
    docs = {r.path.rpartition("/")[2]: r.filetype for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert docs == {"a.pdf": "pdf", "b.bin.png": "png", "c.png": "pdf", "e.jpeg": "jpg"}
    rows = spark.createDataFrame([("/x/doc/10.png",), ("/x/doc/2.JPG",), ("/x/doc/cover.png",), ("/x/doc/3.txt",)], "path string")
    assert sorted(map(tuple, files.page_images(rows).select("doc", "page_no").collect())) == [("/x/doc", 2), ("/x/doc", 10)]


def test_page_selection(spark):
    pages = spark.createDataFrame([("d", i) for i in range(1, 5)], "doc string, page_no int")
    wanted = spark.createDataFrame([("d", 2), ("d", 3), ("d", 9)], "doc string, page_no int")
    done = spark.createDataFrame([("d", 3)], "doc string, page_no int")
    assert sorted(map(tuple, files.select_pages(pages, wanted, done).collect())) == [("d", 2, True), ("d", 3, False)]
    turned = files.rotated(spark.createDataFrame([(-90, 10.06, 20.0)], "rotation int, width double, height double")).first()
    assert (turned.rotation, turned.width, turned.height) == (270, 20.0, 10.1)


def test_layout_and_ocr(spark):
    layout = {"number": 1, "width": 100, "height": 200, "objects": [{"type": "doc_title", "score": 0.9, "bbox": [1, 10, 50, 30]}, {"type": "image", "quad": [[5, 5], [9, 5], [9, 8], [5, 8]]}]}
    rows = spark.createDataFrame([(1, json.dumps(layout))], "page_id long, json string")
    got = [(r.type, r.raw_type, r.x0, r.y0, r.x1, r.y1) for r in files.load_layout(rows).orderBy("obj_id").collect()]
    assert got == [("title", "doc_title", 1, 170, 50, 190), ("figure", "image", 5, 192, 9, 195)]
    assert files.load_layout(rows, ["figure"]).count() == 1
    ocr = {"width": 100, "height": 50, "spans": [{"text": "hi", "score": 1.0, "quad": [[0, 0], [10, 0], [10, 8], [0, 8]]}]}
    r = files.load_ocr(spark.createDataFrame([(1, json.dumps(ocr))], "page_id long, json string")).first()
    assert (r.text, r.x0, r.y0, r.x1, r.y1) == ("hi", 0, 42, 10, 50)


def test_archives(spark):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("a.txt", "one")
        z.writestr("sub/b.txt", "two")
    assert files.unzip(data.getvalue(), 5, 100) == [("a.txt", b"one")]
    with pytest.raises(files.TooLarge):
        files.unzip(data.getvalue(), 5, 2)
    assert files.gunzip(gzip.compress(b"x" * 10), 10) == b"x" * 10
    with pytest.raises(files.TooLarge):
        files.gunzip(gzip.compress(b"x" * 11), 10)
    df = spark.createDataFrame([("p", bytearray(data.getvalue()))], "path string, content binary")
    assert [(r.name, bytes(r.content)) for r in files.unzip_files(df, 5, 100).collect()] == [("a.txt", b"one")]
    assert files.page_count(b"%PDF-1.4 << /Type /Pages /Kids [] /Count 3 >>") == 3
    with pytest.raises(ValueError, match="not a valid PDF"):
        files.page_count(b"hello")


def test_dictionary_and_settings(spark, tmp_path):
    (tmp_path / "d.txt").write_text("plain\n#pattern\na+b\n\n#text\nmore\n# note\n")
    assert sorted(map(tuple, files.read_dictionary(spark, str(tmp_path / "d.txt")).collect())) == [("pattern", "a+b"), ("text", "more"), ("text", "plain")]
    assert files.merge_settings({"a": {"b": 1}}, {"a.c": 2, "d": 3}) == {"a": {"b": 1, "c": 2}, "d": 3}
    assert files.parse_assignments(["a=1", "b = x y", "c=[1,2]"]) == {"a": 1, "b": " x y", "c": [1, 2]}


def test_table_markup(spark):
    html = '<table><tr><td rowspan="2">a</td><td>b</td></tr><tr><td colspan=x>c &amp; d</td></tr></table>'
    assert [(c["row"], c["col"], c["row_span"], c["col_span"], c["text"]) for c in markup.html_cells(html)] == [(0, 0, 2, 1, "a"), (0, 1, 1, 1, "b"), (1, 1, 1, 1, "c & d")]
    otsl = "<fcel>a<lcel><nl><fcel>b<fcel>c<nl><ucel><ecel>"
    assert [(c["row"], c["col"], c["row_span"], c["col_span"], c["text"]) for c in markup.otsl_cells(otsl)] == [(0, 0, 1, 2, "a"), (1, 0, 2, 1, "b"), (1, 1, 1, 1, "c"), (2, 1, 1, 1, "")]
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "table_id long, text string")
    assert markup.cells(df, markup.html_cells).count() == 3


def test_html_nodes(spark):
    pages = spark.createDataFrame([(1, "<html><title>T</title><body><p>a <b>c</b> d<br></p><a href='/x'>l</a></body></html>"), (2, None)], "page_id long, html string")
    rows = [(r.tag, r.depth, r.text, r.href) for r in adapters.html_nodes(pages).orderBy("seq").collect()]
    assert rows == [("html", 0, "", None), ("title", 1, "T", None), ("body", 1, "", None), ("p", 2, "a d", None), ("b", 3, "c", None), ("br", 3, "", None), ("a", 2, "l", "/x")]


def test_sinks(spark):
    schema = "doc_id long, page_no int, seq int, type string, text string, level int, latex string, html string, x0 double, y0 double, x1 double, y1 double, height double"
    rows = [(1, 1, 2, "text", "a*b", None, None, None, 0.0, 0.0, 5.25, 5.0, 100.0), (1, 1, 1, "title", "T", 2, None, None, 0.0, 10.0, 5.0, 20.0, 100.0), (1, 2, 1, "formula", "", None, "x^2", None, 0.0, 0.0, 1.0, 1.0, 100.0)]
    objects = spark.createDataFrame(rows, schema)
    assert sinks.document_markdown(sinks.page_markdown(objects)).first().markdown == "## T\n\na\\*b\n\n$$\nx^2\n$$"
    doc = json.loads(sinks.document_json(sinks.page_json(objects)).first().json)
    assert [p["number"] for p in doc["pages"]] == [1, 2] and doc["pages"][0]["objects"][1]["bbox"] == [0.0, 0.0, 5.2, 5.0]
    html = sinks.page_html(objects).where("page_no = 1").first().html
    assert html.startswith('<section class="page"><div style="position:absolute;left:0.0px;top:80.0px">T</div>')
    files_ = spark.createDataFrame([(1, {"b.md": "two", "a.md": "one"})], "doc_id long, files map<string,string>")
    with zipfile.ZipFile(io.BytesIO(bytes(sinks.bundles(files_).first().zip))) as z:
        assert z.namelist() == ["a.md", "b.md"]
    asked = spark.createDataFrame([(["doc.md", "x"],), ([],), (None,)], "r array<string>")
    assert [r[0] for r in asked.select(sinks.bundle_names(["doc.md", "doc.json"], F.col("r"))).collect()] == [["doc.md"], ["doc.md", "doc.json"], ["doc.md", "doc.json"]]


def test_models_and_features(spark):
    df = spark.createDataFrame([(1, bytearray(b"abc")), (2, None)], "id long, content binary")
    got = {r.id: r.result for r in models.apply(df, models.MockModel, params={"k": 1}).collect()}
    assert json.loads(got[1]) == {"bytes": 3, "digest": "900150983cd24fb0d6963f7d28e17f72", "k": 1} and got[2] is None
    models.as_function(spark, "mock_model", models.MockModel)
    assert json.loads(df.where("id = 1").selectExpr("mock_model(content)").first()[0])["bytes"] == 3
    with pytest.raises(KeyError):
        models.create("nothing")
    lines = spark.createDataFrame([(1, "Name: Ann"), (1, "Age: 7"), (1, "x"), (2, "One: 1")], "doc_id long, text string")
    with pytest.warns(UserWarning):
        out = features.apply(lines, ["kv", "unknown"])
    assert {(r.text, r.kv is not None) for r in out.collect()} == {("Name: Ann", True), ("Age: 7", True), ("x", False), ("One: 1", False)}
