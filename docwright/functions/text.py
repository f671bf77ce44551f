"""Text expressions shared by the operators; all are built-in column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space, fixed by the word definition ``[^\x20\x09-\x0D]+``.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and bind it inside ``body``, also where ``body`` uses it in lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The runs of non-space characters of ``text`` in order; null or blank text has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    empty = F.array().cast("array<string>")
    return F.when(trimmed == "", empty).otherwise(F.split(trimmed, SPACE_RUN, -1))


def sum_of(numbers: Column) -> Column:
    """Sum of an array of bigint; 0 for an empty array."""
    return F.aggregate(numbers, F.lit(0).cast("bigint"), lambda total, x: total + x)
