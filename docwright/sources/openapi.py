"""OpenAPI documents as Markdown, composed inside the row that holds the document.

A null or broken document gives its heading alone. A request body is shown as its JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATION = (
    "struct<summary:string,operationId:string,parameters:array<struct<name:string,`in`:string,required:boolean,schema:struct<type:string>,"
    "description:string>>,requestBody:string,responses:map<string,struct<description:string>>>"
)
SCHEMA = f"struct<info:struct<title:string>,paths:map<string,map<string,{OPERATION}>>>"
METHODS = ["get", "post", "put", "delete", "patch"]


def clean(text: Column) -> Column:
    """One line, single blanks, bars escaped."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")
    return F.btrim(F.replace(plain, F.lit("|"), F.lit("\\|")))


def name_from_path(path: Column) -> Column:
    """The last segment as capitalised words and ``API``."""
    last = F.regexp_extract(F.rtrim(path, F.lit("/")), r"([^/]*)$", 1)
    words = F.filter(F.split(F.when(last == "", "api").otherwise(last), r"[_\-.{}]+", -1), lambda w: w != "")
    return F.concat(F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), " "), F.lit(" API"))


def _part(title: str, head: str, rows: Column) -> Column:
    """A section with a table, or nothing without rows."""
    return F.when(F.size(rows) > 0, F.concat(F.lit(f"### {title}\n\n{head}\n"), F.array_join(rows, "\n"), F.lit("\n\n"))).otherwise("")


def _operation(path: Column, method: Column, op: Column) -> Column:
    said = lambda c: F.coalesce(c, F.lit(""))
    name = F.coalesce(F.nullif(op["summary"], F.lit("")), F.nullif(op["operationId"], F.lit("")), name_from_path(path))
    asked = F.transform(F.coalesce(op["parameters"], F.array()), lambda p: F.concat(
        F.lit("| "), F.concat_ws(" | ", said(p["name"]), said(p["in"]), F.when(p["required"], "True").otherwise("False"), said(p["schema"]["type"]), clean(p["description"])), F.lit(" |"),
    ))
    given = F.transform(F.map_entries(F.coalesce(op["responses"], F.create_map())), lambda e: F.concat(
        F.lit("| "), e["key"], F.lit(" | "), clean(e["value"]["description"]), F.lit(" |")))
    body = F.when(F.length(op["requestBody"]) > 2, F.concat(F.lit("### Request Body\n\n```json\n"), clean(op["requestBody"]), F.lit("\n```\n\n"))).otherwise("")
    return F.concat(
        F.lit("## "), name, F.lit("\n\nMethod: "), F.upper(method), F.lit("\n\nEndpoint: "), path, F.lit("\n\n"),
        _part("Request Parameters", "| Name | In | Required | Type | Description |\n|---|---|---|---|---|", asked), body,
        _part("Responses", "| Code | Description |\n|---|---|", given),
    )


def markdown(document: Column, url: Column) -> Column:
    """The Markdown of a whole document."""
    parsed = F.from_json(document, SCHEMA)
    none = F.array().cast("array<string>")
    paths = F.coalesce(F.map_entries(parsed["paths"]), F.array())

    def operations(entry: Column) -> Column:
        kept = F.filter(F.map_entries(entry["value"]), lambda m: F.lower(m["key"]).isin(METHODS))
        return F.coalesce(F.array_join(F.transform(kept, lambda m: _operation(entry["key"], m["key"], m["value"])), ""), F.lit(""))

    body = F.array_join(F.coalesce(F.transform(paths, operations), none), "")
    title = F.coalesce(F.nullif(parsed["info"]["title"], F.lit("")), F.lit("OpenAPI Document"))
    return F.concat(F.rtrim(F.concat(F.lit("# "), title, F.lit("\n\nSource URL: "), url, F.lit("\n\n"), body), F.lit("\n")), F.lit("\n"))
