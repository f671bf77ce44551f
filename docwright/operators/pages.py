"""Web pages as Markdown, and JSON objects inside free texts. Python reads one row at a time in Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DROPPED = {"script", "style", "noscript", "svg", "canvas", "nav", "footer", "aside", "title"}
LINES = {"p", "div", "section", "article"}


def fragments_of(text: str | None) -> list[str]:
    """The JSON objects in a text, as they are written, from left to right and outermost.

    A brace that opens no valid object is passed over. Objects nested too deep to read count as none.
    """
    found, decoder, at = [], json.JSONDecoder(), 0
    text = text or ""
    while (begin := text.find("{", at)) >= 0:
        try:
            _, at = decoder.raw_decode(text, begin)
            found.append(text[begin:at])
        except (ValueError, RecursionError):
            at = begin + 1
    return found


def repaired(text: str | None) -> str:
    """``text`` without the commas that stand right before a closing brace or bracket."""
    return re.sub(r",(?=\s*[}\]])", "", text or "")


class _Markdown(HTMLParser):
    """Headings, lists, pipe rows, fenced and inline code, and links; the rest is text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.cells: list[list[str]] | None = None
        self.links: list[str] = []
        self.dropped, self.fenced, self.head = 0, 0, False

    def put(self, text: str) -> None:
        if self.cells:
            self.cells[-1].append(" " if text.isspace() else text)
        else:
            self.out.append(text)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in DROPPED:
            self.dropped += 1
        elif re.fullmatch("h[1-6]", tag):
            self.put(f"\n\n{'#' * int(tag[1])} ")
        elif tag in LINES or tag in {"br", "ul", "ol"}:
            self.put("\n")
        elif tag == "li":
            self.put("\n- ")
        elif tag == "tr":
            self.cells = []
        elif tag in {"td", "th"} and self.cells is not None:
            self.cells.append([])
        elif tag == "pre":
            self.fenced += 1
            self.put("\n\n```text\n")
        elif tag == "code" and not self.fenced:
            self.put("`")
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.put("[" if self.links[-1] else "")

    def handle_endtag(self, tag: str) -> None:
        if tag in DROPPED:
            self.dropped = max(0, self.dropped - 1)
        elif re.fullmatch("h[1-6]", tag) or tag in LINES:
            self.put("\n")
        elif tag == "tr" and self.cells is not None:
            cells, self.cells = [" ".join("".join(c).split()) for c in self.cells], None
            if cells:
                self.put(f"\n| {' | '.join(cells)} |")
        elif tag == "pre":
            self.fenced = max(0, self.fenced - 1)
            self.put("\n```\n")
        elif tag == "code" and not self.fenced:
            self.put("`")
        elif tag == "a" and self.links:
            target = self.links.pop()
            self.put(f"]({target})" if target else "")

    def handle_data(self, data: str) -> None:
        if not self.dropped and (self.fenced or data.strip()):
            self.put(data if self.fenced else re.sub(r"\s+", " ", data))


def markdown_of(page: str | None, address: str | None) -> str:
    """A page's main, article or body part as Markdown under its address; no page gives the address alone."""
    page = page or ""
    for tag in ("main", "article", "body"):
        opened = re.search(rf"<{tag}\b[^>]*>", page, re.I)
        if opened:
            closed = re.compile(rf"</{tag}\s*>", re.I).search(page, opened.end())
            page = page[opened.end() : closed.start() if closed else len(page)]
            break
    reader = _Markdown()
    reader.feed(page)
    reader.close()
    text = re.sub("[​-‏﻿]", "", "".join(reader.out).replace("\r\n", "\n").replace("\r", "\n"))
    lines = "\n".join(x.rstrip() for x in re.sub(r"\n{3,}", "\n\n", text).split("\n")).strip()
    if address and address not in lines[:500]:
        lines = f"# Source URL\n\n{address}\n\n{lines}"
    return lines.strip() + "\n"


def markdown(pages: DataFrame, keep: list[str], html: str = "html", url: str = "url") -> DataFrame:
    """``keep`` with ``markdown``, each whole page converted."""
    read = pages.select(*keep, F.col(html).alias("_html"), F.col(url).alias("_url"))
    schema = T.StructType([*pages.select(*keep).schema.fields, T.StructField("markdown", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = zip(batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array([markdown_of(h, u) for h, u in given], pa.string())], schema.names)

    return read.mapInArrow(run, schema)


def json_fragments(rows: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, ``place`` (from 0) and ``fragment``: a row for each JSON object inside a text."""
    read = rows.select(*keep, F.col(text).alias("_text"))
    schema = T.StructType([*rows.select(*keep).schema.fields, T.StructField("found", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fragments_of(x) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(pa.string()))], schema.names)

    return read.mapInArrow(run, schema).select(*keep, F.posexplode("found").alias("place", "fragment"))
