"""Parsing of small exchange formats and canonical paths inside a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docwright.functions.text import let

LEAF = r"<([A-Za-z][A-Za-z0-9_]*)>([^<]*)</\1>"


def xml_children(fragment: Column, parent: str) -> Column:
    """Map of lower-case tag to text of the leaves below ``parent``; the last of equal tags stands; empty if absent."""
    body = F.regexp_extract(F.coalesce(fragment, F.lit("")), f"(?is)<{parent}>(.*?)</{parent}>", 1)
    names = F.transform(F.regexp_extract_all(body, F.lit(LEAF), 1), F.lower)
    pairs = F.arrays_zip(names.alias("k"), F.regexp_extract_all(body, F.lit(LEAF), 2).alias("v"))

    def last_of(held: Column) -> Column:
        tags = F.array_distinct(F.transform(held, lambda e: e["k"]))
        return F.map_from_arrays(tags, F.transform(tags, lambda t: F.element_at(F.filter(held, lambda e: e["k"] == t), -1)["v"]))

    return let(pairs, last_of)


def canonical_path(path: Column) -> Column:
    """Segments split on dots and slashes, lower case, letters and digits only, joined by dots."""
    parts = F.transform(F.split(path, "[./]+", -1), lambda p: F.regexp_replace(F.lower(p), "[^a-z0-9]", ""))
    return F.array_join(F.filter(parts, lambda p: p != ""), ".")


def markdown_codes(text: Column) -> Column:
    """Array of (code, message) of the first Markdown table with a code and a message column; numeric codes only."""
    cells = lambda row: F.transform(F.split(F.btrim(F.btrim(row), F.lit("|")), r"\|", -1), lambda c: F.btrim(c))
    names = lambda row: F.transform(cells(row), lambda c: F.lower(c))
    table = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?im)^((?=[^\n]*\|\s*code\s*\|)(?=[^\n]*\|\s*(?:message|description)\s*\|)\|[^\n]*(?:\n\|[^\n]*)*)", 1)

    def read(rows: Column) -> Column:
        head = names(F.get(rows, F.lit(0)))
        code, message = F.array_position(head, F.lit("code")), F.greatest(F.array_position(head, F.lit("message")), F.array_position(head, F.lit("description")))
        made = F.transform(F.slice(rows, F.lit(3), F.greatest(F.lit(0), F.size(rows) - 2)), lambda r: F.struct(
            F.get(cells(r), code.cast("int") - 1).alias("code"), F.get(cells(r), message.cast("int") - 1).alias("message"),
        ))
        return F.filter(made, lambda e: e["code"].rlike("^-?[0-9]+$"))

    return let(F.split(table, "\n", -1), read)


def sample_value(kind: Column, example: Column, name: Column) -> Column:
    """The documented example, else a value by kind, else a mark to confirm."""
    guess = F.when(kind.isin("int", "integer", "long"), "1").when(kind.isin("decimal", "number", "amount"), "100.00").when(kind == "boolean", "true")
    return F.coalesce(F.nullif(example, F.lit("")), guess, F.concat(F.lit("<confirm "), name, F.lit(">")))


def wrong_value(kind: Column, value: Column) -> Column:
    """A value of another type than ``kind``."""
    return F.when(kind.isin("int", "integer", "long", "decimal", "number", "amount", "boolean"), F.concat(F.lit('"'), value, F.lit('x"'))).otherwise("12345")


XML_EXCHANGE = r"(?is)<EXTSYSTEM\b[^>]*>.*?</EXTSYSTEM>"


def xml_exchanges(text: Column) -> Column:
    """(request, response): the leaves of each exchange in a text as maps, which are empty where a side is missing.

    An exchange whose tags don't match is passed over.
    """
    # most texts hold no tag, and a search for one letter is cheaper than that for the pattern
    found = F.when(F.contains(text, F.lit("<")), F.regexp_extract_all(text, F.lit(XML_EXCHANGE), F.lit(0))).otherwise(F.array().cast("array<string>"))
    both = F.transform(found, lambda x: F.struct(xml_children(x, "REQUEST").alias("request"), xml_children(x, "RESPONSE").alias("response")))
    return F.filter(both, lambda x: (F.size(x.request) > 0) | (F.size(x.response) > 0))


def query_values(text: Column) -> Column:
    """Map of the decoded names and values of a query part in the first line and of name=value lines below it; empty without one.

    Blank values stay; the last value of a name counts, at the place of its first.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    plain = lambda x: F.coalesce(F.try_url_decode(x), x)

    def read(ls: Column) -> Column:
        first = F.regexp_extract(F.get(ls, F.lit(0)), r"\?([^#]*)", 1)
        more = F.filter(F.transform(F.slice(ls, F.lit(2), F.size(ls)), lambda x: F.regexp_replace(x, r"^[&?]+\s*", "")), lambda x: x.rlike(r"^[^=&\s]+\s*="))
        parts = F.filter(F.split(F.array_join(F.concat(F.array(first), more), "&"), "&", -1), lambda p: p != "")
        pairs = F.transform(parts, lambda p: F.struct(plain(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"), plain(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v")))
        named = F.filter(pairs, lambda e: ~e.k.isin("", "?"))

        def last_of(held: Column) -> Column:
            names = F.array_distinct(F.transform(held, lambda e: e.k))
            return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(held, lambda e: e.k == n), -1).v))

        return F.when(F.contains(F.get(ls, F.lit(0)), F.lit("?")), let(named, last_of)).otherwise(none)

    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.when(F.contains(text, F.lit("?")), let(lines, read)).otherwise(none)
