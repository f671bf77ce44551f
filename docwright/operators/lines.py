"""Documents as lines: headings carried forward, sections, contexts.

All lines of a document lie in its row, so they are cut and met there as arrays: nothing is shuffled, documents
with equal or null keys stay apart, and a very long document costs its own task alone.

Defined results: a null text is one empty line; equal rows are kept; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwright.functions.text import let

Test = Callable[[Column], Column]


def _split(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1).alias("ls"))


def places(ls: Column, test: Test) -> Column:
    """Numbers, from 0, of the lines that pass ``test``."""
    return F.array_compact(F.transform(ls, lambda x, i: F.when(test(x), i)))


def _cuts(ls: Column, is_heading: Test) -> Column:
    """(section, title, start, n_lines) from heading to heading; section 0 are the lines before the first, if there are any."""

    def made(at: Column) -> Column:
        def one(k: Column) -> Column:
            start = F.when(k == 0, F.lit(0)).otherwise(F.get(at, k - 1))
            end = F.coalesce(F.get(at, k), F.size(ls))
            return F.struct(k.cast("bigint").alias("section"), F.when(k > 0, F.get(ls, start)).alias("title"), start.alias("start"), (end - start).cast("bigint").alias("n_lines"))

        return F.filter(F.transform(F.sequence(F.lit(0), F.size(at)), one), lambda s: s.n_lines > 0)

    return let(places(ls, is_heading), made)


def sections(docs: DataFrame, key: str, is_heading: Test, before: str = "Overview", text: str = "text") -> DataFrame:
    """A row a section: its number, title, first line and number of lines; lines before the first heading are ``before``."""
    cut = _split(docs, key, text).select(key, F.inline(_cuts(F.col("ls"), is_heading)))
    return cut.withColumn("title", F.coalesce("title", F.lit(before)))


def with_heading(docs: DataFrame, key: str, is_heading: Test, text: str = "text") -> DataFrame:
    """(key, line_no, line, heading) of every line with the last heading at or before it."""

    def carried(s: Column) -> Column:
        own = F.slice("ls", s.start + 1, s.n_lines.cast("int"))
        return F.transform(own, lambda x, i: F.struct((s.start + i).alias("line_no"), x.alias("line"), s.title.alias("heading")))

    return _split(docs, key, text).select(key, F.inline(F.flatten(F.transform(_cuts(F.col("ls"), is_heading), carried))))


def contexts(docs: DataFrame, key: str, wanted: Test, before: int, after: int, text: str = "text") -> DataFrame:
    """Each wanted line with the lines around it, joined by newlines."""

    def around(i: Column) -> Column:
        low = F.greatest(F.lit(0), i - before)
        return F.struct(i.alias("line_no"), F.array_join(F.slice("ls", low + 1, i + after + 1 - low), "\n").alias("context"))

    return _split(docs, key, text).select(key, F.inline(F.transform(places(F.col("ls"), wanted), around)))
