"""Word and HTML documents as paragraph, cell and link rows.

One row schema serves all: ``kind`` is paragraph, cell, link or error; paragraphs and links are
numbered by ``pos``, cells by table, row and column. Cells with an inline task list have their tasks
and ``checked`` (any task is), which is null without tasks.
"""

from __future__ import annotations

import email
import email.policy
import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = "file string, kind string, pos int, style string, text string, href string, tbl int, row int, col int, tasks array<struct<text:string,checked:boolean>>, checked boolean"
NAMES = ["file", "kind", "pos", "style", "text", "href", "tbl", "row", "col", "tasks", "checked"]
#: The namespace of word-processing documents; other names of character sets; what is tried after the named one.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
CHARSETS = {"unicode": "utf-16", "utf8": "utf-8", "utf16": "utf-16"}
FALLBACKS = ["utf-8", "utf-16", "cp950"]
BLOCKS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "pre"}


def decoded(payload: bytes, charset: str | None) -> str:
    named = (charset or "utf-8").strip().strip('"').lower()
    for name in [CHARSETS.get(named, named), *FALLBACKS]:
        try:
            return payload.decode(name, errors="replace")
        except LookupError:
            continue
    raise AssertionError("utf-8 is always known")


def html_of(content: bytes) -> str:
    """The HTML of a page or of the first HTML part of a MIME message; raises on other bytes."""
    head = content[:512].lower()
    if b"mime-version" in head or b"content-type: multipart" in head:
        for part in email.message_from_bytes(content, policy=email.policy.compat32).walk():
            if part.get_content_type() == "text/html":
                return decoded(part.get_payload(decode=True) or b"", part.get_content_charset())
        raise ValueError("a MIME message without an HTML part")
    if b"<" not in head or content[:4] == b"\xd0\xcf\x11\xe0":
        raise ValueError("neither HTML nor MIME")
    return decoded(content, "utf-8")


class _Page(HTMLParser):
    """Gathers the texts of open blocks, cells, links and tasks."""

    def __init__(self, file: str):
        super().__init__(convert_charrefs=True)
        self.file, self.rows, self.open, self.hidden, self.n_tables = file, [], [], 0, 0
        self.tables: list[list[int]] = []
        self.tasks: list[list[dict]] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "br":
            self.handle_data("\n")
        elif tag == "table":
            self.tables.append([self.n_tables, -1, -1])
            self.n_tables += 1
        elif tag == "tr" and self.tables:
            self.tables[-1][1:] = [self.tables[-1][1] + 1, -1]
        elif tag in ("td", "th") and self.tables:
            self.tables[-1][2] += 1
            self.tasks.append([])
            self.open.append((tag, [], list(self.tables[-1])))
        elif tag in BLOCKS or tag == "a" and "href" in a:
            if tag in ("p", "li"):
                self._close({tag} if tag == "li" else {"p"}, top_only=True)
            self.open.append((tag, [], a.get("href") if tag == "a" else "checked" in (a.get("class") or "").split() if tag == "li" and self.tasks else None))

    def handle_data(self, data):
        if not self.hidden:
            for _, held, _ in self.open:
                held.append(data)

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "table" and self.tables:
            self.tables.pop()
        elif tag in BLOCKS or tag in ("a", "td", "th"):
            self._close({tag})

    def _close(self, tags, top_only=False):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in tags:
                tag, held, more = self.open.pop(i)
                self._emit(tag, "".join(held), more)
                return
            if top_only:
                return

    def _emit(self, tag, raw, more):
        row = dict.fromkeys(NAMES) | {"file": self.file}
        lines = [re.sub(r"\s+", " ", x).strip() for x in raw.split("\n")]
        if tag == "a":
            self.rows.append(row | {"kind": "link", "href": more, "text": " ".join(" ".join(lines).split())})
        elif tag in ("td", "th"):
            tasks = self.tasks.pop()
            self.rows.append(row | {"kind": "cell", "style": tag, "text": "\n".join(x for x in lines if x), "tbl": more[0], "row": more[1], "col": more[2], "tasks": tasks, "checked": any(t["checked"] for t in tasks) if tasks else None})
        else:
            text = raw.strip("\n") if tag == "pre" else " ".join(" ".join(lines).split())
            if tag == "li" and self.tasks and more is not None:
                self.tasks[-1].append({"text": text, "checked": more})
            if text.strip():
                self.rows.append(row | {"kind": "paragraph", "style": tag, "text": text})


def html_rows(file: str, html: str) -> list[dict]:
    page = _Page(file)
    page.feed(html)
    page.close()
    while page.open:
        page._close({page.open[-1][0]})
    return page.rows


def docx_rows(file: str, content: bytes) -> list[dict]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{WORD}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{WORD}t")).strip()
    rows = []
    n = 0
    for e in body:
        row = dict.fromkeys(NAMES) | {"file": file}
        if e.tag == f"{WORD}p" and text(e):
            style = e.find(f"{WORD}pPr/{WORD}pStyle")
            rows.append(row | {"kind": "paragraph", "style": "" if style is None else style.get(f"{WORD}val"), "text": text(e)})
        elif e.tag == f"{WORD}tbl":
            for r, tr in enumerate(e.findall(f"{WORD}tr")):
                for c, tc in enumerate(tr.findall(f"{WORD}tc")):
                    rows.append(row | {"kind": "cell", "tbl": n, "row": r, "col": c, "tasks": [], "text": "\n".join(text(p) for p in tc.findall(f"{WORD}p")).strip()})
            n += 1
    return rows


def document_rows(file: str, content: bytes) -> list[dict]:
    """Rows of one file by its ending; what can't be read gives one row of kind ``error``."""
    try:
        rows = docx_rows(file, content) if file.lower().endswith(".docx") else html_rows(file, html_of(content))
    except (ValueError, KeyError, AttributeError, zipfile.BadZipFile, ElementTree.ParseError) as wrong:
        rows = [dict.fromkeys(NAMES) | {"file": file, "kind": "error", "text": f"{type(wrong).__name__}: {wrong}"}]
    return [r | {"pos": i} for i, r in enumerate(rows)]


def _framed(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=NAMES).astype({c: "Int32" for c in ("pos", "tbl", "row", "col")} | {"checked": "boolean"})


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows of every .doc, .docx, .htm and .html file under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                yield _framed(document_rows(file, content))

    return files.filter(F.lower("path").rlike(r"\.(docx?|html?)$")).select("path", "content").mapInPandas(run, PARTS)


def parameter_rows(cells: DataFrame) -> DataFrame:
    """(file, tbl, row, fields) of tables whose header has Parameter and Type; rows without a name go.

    Headers are lower case with _ for blanks; parameter is called name and require required.
    """
    cell = cells.filter("kind = 'cell'")
    header = F.regexp_replace(F.lower(F.trim("text")), r"\s+", "_")
    header = F.when(header == "parameter", "name").when(header == "require", "required").otherwise(header)
    heads = cell.filter("row = 0").groupBy("file", "tbl").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("col", header)))).alias("heads"))
    wanted = heads.filter(F.size(F.array_intersect(F.map_values("heads"), F.array(F.lit("name"), F.lit("type")))) == 2)
    rows = cell.filter("row > 0").join(wanted, ["file", "tbl"]).withColumn("h", F.try_element_at("heads", "col")).filter("h <> ''")
    pairs = F.sort_array(F.collect_list(F.struct("col", F.col("h").alias("key"), F.col("text").alias("value"))))
    by_name = F.map_from_entries(F.transform(pairs, lambda p: F.struct(p.key, p.value)))
    return rows.groupBy("file", "tbl", "row").agg(by_name.alias("fields")).filter("coalesce(fields['name'], '') <> ''")


def pdf_status(pages: Column, characters: Column) -> Column:
    """readable with pages and at least 20 characters a page, 100 in all; else ocr_required."""
    return F.when((pages > 0) & (characters >= F.greatest(F.lit(100), pages * 20)), "readable").otherwise("ocr_required")


def is_openapi(file: Column, text: Column) -> Column:
    """Whether a file is an OpenAPI description: by its ending, or as a JSON object with one of three keys."""
    ending = F.lower(file).rlike(r"\.(json|ya?ml)$")
    key = lambda k: F.get_json_object(text, f"$.{k}").isNotNull()
    return ending | F.coalesce(key("openapi") | key("swagger") | key("paths"), F.lit(False))
