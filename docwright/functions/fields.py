"""Scalar functions on titles, names, keys, amounts and query strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_text(text: Column) -> Column:
    """Unix newlines, single blanks, at most one empty line, no outer white space."""
    unix = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "[ \t]+", " ")
    return F.btrim(F.regexp_replace(F.regexp_replace(unix, " ?\n ?", "\n"), "\n{3,}", "\n\n"), F.lit(" \n"))


def label_of(title: Column) -> Column:
    """What stands before the first ASCII or full-width colon; null without one."""
    found = F.regexp_extract(title, r"(?s)^\s*([^：:]+?)\s*[：:]\s*(.*)$", 1)
    return F.when(title.rlike(r"(?s)^\s*[^：:]+\s*[：:]"), found)


def value_of(title: Column) -> Column:
    """What stands after the first colon, trimmed; null without one."""
    found = F.btrim(F.regexp_extract(title, r"(?s)^\s*([^：:]+?)\s*[：:]\s*(.*)$", 2), F.lit(" \t\r\n"))
    return F.when(title.rlike(r"(?s)^\s*[^：:]+\s*[：:]"), found)


def slug(text: Column, default: str = "unclassified") -> Column:
    """Lower case, runs of anything but letters a-z, digits and CJK to one underscore."""
    plain = F.btrim(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9一-鿿]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(plain, F.lit("")), F.lit(default))


def stable_key(kind: str, *parts: Column) -> Column:
    """``kind::slug::...::hash``, with the first 8 hex digits of the SHA-1 of the parts."""
    joined = F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])
    return F.concat_ws("::", F.lit(kind), *[slug(p) for p in parts], F.substring(F.sha1(joined), 1, 8))


def account(name: Column, as_of: str) -> Column:
    """First three letters, padded with x, and the date as YYMMDD."""
    letters = F.substring(F.regexp_replace(F.lower(name), "[^a-z]", ""), 1, 3)
    return F.concat(F.rpad(letters, 3, "x"), F.date_format(F.lit(as_of).cast("date"), "yyMMdd"))


def query_pairs(url: Column) -> Column:
    """Pairs key=value of a URL's query part, blank values kept."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return F.filter(F.split(query, "&", -1), lambda p: F.length(p) > 0)


def boundary_values(scale: Column) -> Column:
    """A value with exactly ``scale`` decimals and one with a decimal too many."""
    digits = lambda n: F.repeat(F.lit("123456789"), (n / 9 + 1).cast("int"))
    made = lambda n: F.concat(F.lit("100."), F.substring(digits(n), F.lit(1), n))
    return F.struct(made(scale).alias("valid"), made(scale + 1).alias("invalid"))


def has_segments(path: Column, wanted: Column) -> Column:
    """Whether ``wanted`` is a contiguous run of segments of ``path`` (both arrays)."""
    starts = F.sequence(F.lit(1), F.size(path) - F.size(wanted) + 1)
    fits = F.size(wanted).between(1, F.size(path))
    return F.when(fits, F.exists(starts, lambda i: F.slice(path, i, F.size(wanted)) == wanted)).otherwise(F.lit(False))


def drop_empty(pairs: Column) -> Column:
    """Entries of a map whose value is neither null nor empty."""
    return F.map_filter(pairs, lambda _, v: v.isNotNull() & (v != ""))


def string_list(text: Column) -> Column:
    """Clean distinct strings, in order, of a JSON array, of a JSON object's content, title or name, or of a comma list."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")))
    inside = [F.get_json_object(trimmed, f"$.{k}") for k in ("content", "title", "name")]
    read = (
        F.when(F.startswith(trimmed, F.lit("[")), F.from_json(trimmed, "array<string>"))
        .when(F.startswith(trimmed, F.lit("{")), F.array(F.coalesce(*inside)))
        .otherwise(F.split(trimmed, ",", -1))
    )
    clean = F.transform(F.coalesce(read, F.array().cast("array<string>")), lambda x: F.btrim(x))
    return F.array_distinct(F.filter(clean, lambda x: x != ""))
