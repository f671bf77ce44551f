"""Sharing out rows whose processing is dear beside their size on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Partitions a core, so that cores that finish early find more to do.
PARTS = 4


def spread(rows: DataFrame, parts: int = PARTS) -> DataFrame:
    """``rows`` dealt evenly over ``parts`` partitions a core of the session.

    A file of keys is a split or two however many documents are made of them, and what runs inside a row
    has no exchange that would deal them out. Give it the few columns that are needed: they are all it shuffles.
    """
    return rows.repartition(parts * max(1, rows.sparkSession.sparkContext.defaultParallelism))
