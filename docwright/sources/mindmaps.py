"""Mind-map archives (``.xmind``) as topic rows, a row a topic.

Spark lists and splits the files; each file is unpacked where it is read. A file that can't be read
gives one row with ``error`` and no topic. Titles have single blanks; ``seq`` is the place in
document order, ``ord`` the place among its siblings (from 1; a root has 0), ``path`` the titles
from the root to the topic without empty ones.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

TOPICS = (
    "file string, sheet int, sheet_title string, topic_id string, parent_seq int, seq int, depth int, ord int, title string, "
    "path array<string>, markers array<string>, notes array<string>, labels array<string>, href string, error string"
)
NAMES = [field.split()[0] for field in TOPICS.split(", ")]
#: Namespaces of the older XML form.
CONTENT = "{urn:xmind:xmap:xmlns:content:2.0}"
LINK = "{http://www.w3.org/1999/xlink}href"


def _clean(text: object) -> str:
    lines = re.sub(r"\r\n?", "\n", str(text or "")).split("\n")
    return "\n".join(re.sub(r"[ \t]+", " ", x).strip() for x in lines).strip()


def _texts(found: object) -> list[str]:
    """A string, a dictionary with a content or a title, or a list of these as clean distinct strings."""
    if isinstance(found, dict):
        plain = found.get("plain") or found
        found = [plain.get("content") or plain.get("title") or ""] if isinstance(plain, dict) else [plain]
    if isinstance(found, str):
        found = [found]
    texts = [_clean(x if isinstance(x, str) else x.get("markerId") or x.get("title") or "") for x in found or []]
    return list(dict.fromkeys(t for t in texts if t))


def _from_json(topic: dict) -> tuple[dict, list]:
    held = {
        "topic_id": topic.get("id"), "title": _clean(topic.get("title")), "markers": _texts(topic.get("markers")),
        "notes": _texts(topic.get("notes")), "labels": _texts(topic.get("labels")), "href": topic.get("href"),
    }
    return held, (topic.get("children") or {}).get("attached") or []


def _from_xml(topic: ElementTree.Element) -> tuple[dict, list]:
    text = lambda path: [x.text or "" for x in topic.findall(path)]
    held = {
        "topic_id": topic.get("id"), "title": _clean(topic.findtext(f"{CONTENT}title")),
        "markers": _texts([x.get("marker-id") or "" for x in topic.findall(f"{CONTENT}marker-refs/{CONTENT}marker-ref")]),
        "notes": _texts(text(f"{CONTENT}notes/{CONTENT}plain")), "labels": _texts(text(f"{CONTENT}labels/{CONTENT}label")),
        "href": topic.get(LINK) or topic.get("href"),
    }
    return held, topic.findall(f"{CONTENT}children/{CONTENT}topics[@type='attached']/{CONTENT}topic")


def _sheets(archive: zipfile.ZipFile) -> list[tuple]:
    """(title, root topic, function that gives a topic's fields and children) of each sheet."""
    names = archive.namelist()
    if "content.json" in names:
        return [(s.get("title"), s.get("rootTopic") or {}, _from_json) for s in json.loads(archive.read("content.json").decode("utf-8"))]
    if "content.xml" in names:
        root = ElementTree.fromstring(archive.read("content.xml"))
        found = [(s.findtext(f"{CONTENT}title"), s.find(f"{CONTENT}topic"), _from_xml) for s in root.findall(f"{CONTENT}sheet")]
        return [x for x in found if x[1] is not None]
    raise ValueError("neither content.json nor content.xml in the archive")


def topic_rows(file: str, content: bytes) -> list[dict]:
    """All topics of one archive; a stack, so deep trees don't exhaust recursion."""
    try:
        rows: list[dict] = []
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            for n, (title, root, fields) in enumerate(_sheets(archive)):
                stack = [(root, None, 0, 0, [])]
                seq = 0
                while stack:
                    topic, parent, depth, ord_, above = stack.pop()
                    held, children = fields(topic)
                    path = above + ([held["title"]] if held["title"] else [])
                    rows.append(held | {"file": file, "sheet": n, "sheet_title": _clean(title) or "Missing Sheet Title", "parent_seq": parent, "seq": seq, "depth": depth, "ord": ord_, "path": path, "error": None})
                    stack += [(c, seq, depth + 1, len(children) - k, path) for k, c in enumerate(reversed(children))]
                    seq += 1
        return rows
    except (zipfile.BadZipFile, ValueError, KeyError, AttributeError, TypeError, ElementTree.ParseError) as wrong:
        return [dict.fromkeys(NAMES) | {"file": file, "error": f"{type(wrong).__name__}: {wrong}"}]


def read(spark: SparkSession, path: str) -> DataFrame:
    """Topic rows of every ``.xmind`` file under ``path``, in any case of the ending."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[xX][mM][iI][nN][dD]").load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                frame = pd.DataFrame(topic_rows(file, content), columns=NAMES)
                ints = {c: "Int32" for c in ("sheet", "parent_seq", "seq", "depth", "ord")}
                yield frame.astype(ints)

    return files.select("path", "content").mapInPandas(run, TOPICS)


def write(topics: DataFrame, folder: str, drop_prefix: str | None = None) -> DataFrame:
    """One archive a file of ``topics``, written under ``folder`` of a file system that all executors share.

    Rows (file, seq, parent_seq, title, labels, notes) of a file are gathered, as an archive is one
    object. Topics whose title starts with ``drop_prefix`` go with everything below them. Identifiers
    are digests of file and place, so a retry gives the same bytes. Gives (file, n_topics).
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        import hashlib
        import os

        rows = rows.sort_values("seq")
        made: dict[int, dict] = {}
        sheets: list[dict] = []
        file = rows["file"].iloc[0]
        for r in rows.itertuples():
            up = None if pd.isna(r.parent_seq) else int(r.parent_seq)
            if drop_prefix and (r.title or "").startswith(drop_prefix) or up is not None and up not in made:
                continue
            made[r.seq] = {"id": hashlib.sha256(f"{file}:{r.seq}".encode()).hexdigest()[:26], "class": "topic", "title": r.title or ""}
            if r.labels is not None and len(r.labels):
                made[r.seq]["labels"] = list(r.labels)
            if r.notes is not None and len(r.notes):
                made[r.seq]["notes"] = {"plain": {"content": "\n".join(r.notes)}}
            if up is None:
                sheets.append({"id": f"s{r.seq}", "class": "sheet", "title": r.title or "", "rootTopic": made[r.seq]})
            else:
                made[up].setdefault("children", {"attached": []})["attached"].append(made[r.seq])
        target = f"{folder}/{os.path.basename(file)}"
        os.makedirs(folder, exist_ok=True)
        with zipfile.ZipFile(f"{target}.part", "w", zipfile.ZIP_DEFLATED) as archive:
            for name, body in (("content.json", sheets), ("metadata.json", {}), ("manifest.json", {"file-entries": {"content.json": {}, "metadata.json": {}}})):
                archive.writestr(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), json.dumps(body, ensure_ascii=False))
        os.replace(f"{target}.part", target)
        return pd.DataFrame([{"file": target, "n_topics": len(made)}])

    rows = topics.select("file", "seq", "parent_seq", "title", "labels", "notes")
    return rows.groupBy("file").applyInPandas(run, "file string, n_topics long")
