"""Round trips of the file formats, on small hand-made files."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from docwright.functions import exchange
from docwright.operators import extraction
from docwright.sources import mindmaps, office, openapi, sinks, stored
from docwright.streaming import upserts

TREE = [{"title": "S", "rootTopic": {"id": "r", "title": "Root", "children": {"attached": [
    {"id": "a", "title": "case： one", "labels": ["x", "x", " y "], "notes": {"plain": {"content": " n "}}, "markers": [{"markerId": "p1"}],
     "children": {"attached": [{"title": "merge_key: 1", "children": {"attached": [{"title": "below"}]}}, {"title": ""}]}},
    {"id": "b", "title": "two  words"}]}}}]
XML = """<xmap-content xmlns="urn:xmind:xmap:xmlns:content:2.0" xmlns:xlink="http://www.w3.org/1999/xlink"><sheet><title>T</title><topic id="r"><title>Root</title>
<children><topics type="attached"><topic id="a" xlink:href="http://e.org"><title>A</title><labels><label>l</label></labels><notes><plain>n</plain></notes></topic></topics>
<topics type="detached"><topic id="z"><title>Z</title></topic></topics></children></topic></sheet></xmap-content>"""


def archive(path, name, body):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr(name, body)


def test_mindmaps_both_forms_and_bad_files(spark, tmp_path):
    archive(tmp_path / "a.xmind", "content.json", json.dumps(TREE))
    archive(tmp_path / "b.XMIND", "content.xml", XML)
    archive(tmp_path / "c.xmind", "other", "")
    (tmp_path / "d.xmind").write_bytes(b"no zip")
    rows = mindmaps.read(spark, str(tmp_path)).collect()
    by = lambda x: sorted((r for r in rows if r.file.endswith(x)), key=lambda r: r.seq or 0)
    assert [(r.title, r.depth, r.ord, r.parent_seq) for r in by("a.xmind")] == [
        ("Root", 0, 0, None), ("case： one", 1, 1, 0), ("merge_key: 1", 2, 1, 1), ("below", 3, 1, 2), ("", 2, 2, 1), ("two words", 1, 2, 0)]
    assert by("a.xmind")[1].labels == ["x", "y"] and by("a.xmind")[1].notes == ["n"] and by("a.xmind")[1].markers == ["p1"]
    assert by("a.xmind")[4].path == ["Root", "case： one"]
    assert [(r.title, r.href, r.labels) for r in by("b.XMIND")] == [("Root", None, []), ("A", "http://e.org", ["l"])]
    assert all(len(by(x)) == 1 and by(x)[0].error for x in ("c.xmind", "d.xmind"))


def test_mindmaps_written_and_read_again(spark, tmp_path):
    (tmp_path / "in").mkdir()
    archive(tmp_path / "in/a.xmind", "content.json", json.dumps(TREE))
    topics = mindmaps.read(spark, str(tmp_path / "in"))
    assert mindmaps.write(topics, str(tmp_path / "same")).first().n_topics == 6
    assert mindmaps.write(topics, str(tmp_path / "cut"), "merge_key:").first().n_topics == 4
    same = mindmaps.read(spark, str(tmp_path / "same"))
    key = ["seq", "parent_seq", "depth", "ord", "title", "path", "labels", "notes"]
    assert same.select(key).orderBy("seq").collect() == topics.select(key).orderBy("seq").collect()
    assert [r.title for r in mindmaps.read(spark, str(tmp_path / "cut")).orderBy("seq").collect()] == ["Root", "case： one", "", "two words"]


HTML = """<html><title>t</title><script>x</script><h2>Bet &amp; Win</h2><p>one<br>two <a href="/x">link</a></p><pre>a
  b</pre><table><tr><th>Parameter</th><th>Type</th><th>Require</th></tr><tr><td>mode</td><td>string</td><td><ul class="inline-task-list">
<li class="checked">Slot</li><li>Live</li></ul></td></tr><tr><td></td><td>int</td><td>Y</td></tr></table></html>"""


def test_html_mime_and_docx(spark, tmp_path):
    (tmp_path / "a.html").write_text(HTML)
    (tmp_path / "b.doc").write_text('MIME-Version: 1.0\nContent-Type: multipart/related; boundary="B"\n\n--B\nContent-Type: text/html; charset="unicode"\nContent-Transfer-Encoding: base64\n\n'
                                    + __import__("base64").b64encode("<p>hé</p>".encode("utf-16")).decode() + "\n--B--\n")
    (tmp_path / "c.doc").write_bytes(b"\xd0\xcf\x11\xe0binary")
    w = office.WORD[1:-1]
    body = f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Ti</w:t></w:r><w:r><w:t>tle</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    archive(tmp_path / "d.docx", "word/document.xml", body)
    (tmp_path / "e.txt").write_text("no")
    read = office.read(spark, str(tmp_path))
    rows = read.orderBy("file", "pos").collect()
    of = lambda f, kind: [r for r in rows if r.file.endswith(f) and r.kind == kind]
    assert [(r.style, r.text) for r in of("a.html", "paragraph")][:3] == [("h2", "Bet & Win"), ("p", "one two link"), ("pre", "a\n  b")]
    assert [(r.href, r.text) for r in of("a.html", "link")] == [("/x", "link")]
    tasks = [r for r in of("a.html", "cell") if r.tasks]
    assert [[(t.text, t.checked) for t in r.tasks] for r in tasks] == [[("Slot", True), ("Live", False)]] and tasks[0].checked
    assert of("b.doc", "paragraph")[0].text == "hé"
    assert len(of("c.doc", "error")) == 1
    assert [(r.style, r.text) for r in of("d.docx", "paragraph")] == [("Heading1", "Title")] and of("d.docx", "cell")[0].text == "x"
    assert not [r for r in rows if r.file.endswith(".txt")]
    found = office.parameter_rows(read).collect()
    assert [(r.fields["name"], r.fields["type"]) for r in found] == [("mode", "string")]


def test_rules_of_formats(spark):
    rows = spark.createDataFrame([(0, 0, "a.txt", "x"), (2, 99, "b.JSON", ""), (2, 100, "c", '{"openapi": "3"}'), (10, 199, "d", "{"), (10, 200, "e", None)], "n int, c int, f string, t string")
    got = rows.select(office.pdf_status(F.col("n"), F.col("c")), office.is_openapi(F.col("f"), F.col("t"))).collect()
    assert [r[0] for r in got] == ["ocr_required", "ocr_required", "readable", "ocr_required", "readable"]
    assert [r[1] for r in got] == [False, True, True, False, False]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "x|y"), ("a", 2, None), ("b", 3, "l\nm")], "slug string, pos int, t string")
    sinks.write_chunks(rows, "slug", str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).select("slug", "pos", "t").orderBy("pos").collect() == rows.orderBy("pos").collect()
    assert [r.file for r in sinks.section_files(rows.withColumn("d", F.lit(1)), "slug", ["pos"], ["d"]).orderBy("pos").collect()] == ["a.json", "a_2.json", "b.json"]
    assert [r.line for r in sinks.table_lines(rows, ["slug", "t"]).orderBy("pos").collect()] == ["| a | x\\|y |", "| a |  |", "| b | l m |"]


def test_streamed_upserts(spark, tmp_path):
    schema = "k long, v string, digest string"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    go = lambda: upserts.run(spark.readStream.schema(schema).json(str(tmp_path / "in")), str(tmp_path / "state"), str(tmp_path / "cp"), "k", "digest").awaitTermination()
    put([(1, "a", "h1"), (2, "b", "h2"), (1, "a", "h1")])
    go()
    put([(2, "c", "h3"), (9, "d", "h4")])
    go()
    got = upserts.latest(spark, str(tmp_path / "state"), 99).orderBy("k").collect()
    assert [(r.k, r.number, r.v) for r in got] == [(1, 1, "a"), (2, 2, "c"), (9, 3, "d")]


def test_stored_cases_keep_the_first_of_each_identity(spark, tmp_path):
    schema = "id string, name string"
    assert stored.read_cases(spark, str(tmp_path / "none"), schema, "id").count() == 0
    (tmp_path / "a.json").write_text(json.dumps([{"id": "1", "name": "a"}, {"id": "1", "name": "b"}, {"name": "free"}]))
    (tmp_path / "b.json").write_text(json.dumps([{"id": "1", "name": "c"}, {"id": "2", "name": "d"}, {"name": "free"}]))
    (tmp_path / "c.json").write_text("{broken")
    got = sorted((r.id or "", r.name) for r in stored.read_cases(spark, str(tmp_path), schema, "id").collect())
    assert got == [("", "free"), ("", "free"), ("1", "a"), ("2", "d")]


def test_openapi_of_broken_and_empty_documents(spark):
    rows = spark.createDataFrame([("{}",), ("no json",), (None,), ('{"paths": {"/a": null}}',)], "d string")
    got = [r.m for r in rows.select(openapi.markdown(F.col("d"), F.lit("u")).alias("m")).collect()]
    assert got == ["# OpenAPI Document\n\nSource URL: u\n"] * 4


def test_extraction_of_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "A\nlicense\nB")], "k int, text string")
    got = sorted((r.k, r.section_no, r.n_lines, r.body) for r in extraction.slices(docs, "k", "text", ["^[AB]$", "^A"]).collect())
    assert got == [(3, "SEC_001", 3, "A\nlicense\nB"), (3, "SEC_002", 2, "A\nlicense"), (3, "SEC_003", 1, "B")]
    assert extraction.endpoints(docs, "k", [F.col("text")], "/x").count() == 0
    assert extraction.slices(docs.limit(0), "k", "text", ["A"]).count() == 0
    assert docs.select(exchange.markdown_codes(F.col("text")).alias("c")).filter("size(c) > 0").count() == 0
