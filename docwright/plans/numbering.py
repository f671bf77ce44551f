"""Numbering rows of a whole table without bringing them into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docwright.plans.durable import durable


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their place, from 1, in the total order of the columns ``order``.

    Rows are dealt by ranges and sorted there; only one count a partition meets in one task. The dealt
    rows are durable, so a lost executor can't deal them anew with other bounds.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = durable(dealt.select("*", F.monotonically_increasing_id().alias("_m")))
    part, place = F.shiftright("_m", 33).alias("_p"), F.col("_m").bitwiseAND((1 << 33) - 1) + 1
    counts = placed.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    # One row a partition stands in this window, never the rows themselves.
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    met = placed.withColumn("_p", F.shiftright("_m", 33)).join(starts, "_p")
    return met.withColumn(name, F.col("_start") + place).drop("_m", "_p", "_start")
