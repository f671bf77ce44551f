"""Sinks: chunked JSON, Markdown reports, section names without clashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def write_chunks(rows: DataFrame, chunk: str, folder: str) -> None:
    """One folder of JSON lines a chunk; the rows of a chunk are never gathered. Null fields are left out."""
    rows.write.partitionBy(chunk).mode("overwrite").json(folder)


def section_files(sections: DataFrame, slug: str, order: list[str], by: list[str]) -> DataFrame:
    """``file``: the slug, with _2, _3 and so on for later sections of the same document with that slug."""
    n = F.row_number().over(Window.partitionBy(*by, slug).orderBy(*order))
    return sections.withColumn("file", F.concat(slug, F.when(n > 1, F.concat(F.lit("_"), n)).otherwise(""), F.lit(".json")))


def escaped(cell: Column) -> Column:
    """A Markdown table cell: no newline, no bare pipe."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(cell.cast("string"), F.lit("")), r"\|", r"\\|"), r"[\r\n]+", " ")


def table_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A Markdown table row (``line``) for each row."""
    parts = [escaped(F.col(c)) for c in columns]
    return rows.select("*", F.concat(F.lit("| "), F.concat_ws(" | ", *parts), F.lit(" |")).alias("line"))


def write_reports(reports: dict[str, DataFrame], vendor: str, folder: str) -> None:
    """Every report as JSON lines under its name, one folder a vendor; null fields are left out."""
    for name, rows in reports.items():
        write_chunks(rows, vendor, f"{folder}/{name}")
