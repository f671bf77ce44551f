"""Profiles over open schemas: which fields occur, how often labels do, how deep trees go, and the first paths of cases.

Field sets and counts are combined before the shuffle; the first paths come from a bounded top-k of
each partition. No table is collected.

Defined results: null and empty values are no field; topics without a colon name themselves; of equal
places the smaller path comes first; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docwright.operators.topics import CASE

#: Paths of cases that a profile shows.
FIRST_PATHS = 20


def fields_present(rows: DataFrame, group: list[str], fields: str) -> DataFrame:
    """``group`` and ``present``, the sorted names under which the map ``fields`` holds something in any row of the group."""
    named = F.explode_outer(F.map_keys(F.map_filter(F.col(fields), lambda _, v: v.isNotNull() & (v != ""))))
    once = rows.select(*group, named.alias("field")).distinct()
    return once.groupBy(*group).agg(F.array_sort(F.collect_list("field")).alias("present"))


def label_profile(topics: DataFrame, order: list[str], first: int = FIRST_PATHS) -> DataFrame:
    """(kind, value, n): labels of case fields and titles of roots with their counts, the greatest depth, and the ``first`` case paths with their places.

    ``topics`` has file, topic_id, parent_id, title and path; ``order`` is the total order of topics.
    """
    own = F.trim("title").rlike(f"(?i){CASE}")
    cases = topics.filter(own)
    label = F.regexp_extract("title", "^([^：:]*)", 1)
    below = topics.join(cases.select("file", F.col("topic_id").alias("parent_id")), ["file", "parent_id"], "left_semi")
    labels = below.filter(label != "").groupBy(label.alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("label").alias("kind"), "value", "n")
    roots = topics.filter("parent_id is null").groupBy(F.col("title").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("root").alias("kind"), "value", "n")
    depth = topics.agg(F.max(F.size("path")).cast("bigint").alias("n")).filter("n is not null").select(F.lit("depth").alias("kind"), F.lit("").alias("value"), "n")
    path = F.array_join("path", " > ")
    top = cases.select(*order, path.alias("value")).orderBy(*order, "value").limit(first).agg(F.array_sort(F.collect_list(F.struct(*order, "value"))).alias("all"))
    paths = top.select(F.posexplode("all").alias("n", "x")).select(F.lit("path").alias("kind"), F.col("x.value").alias("value"), (F.col("n") + 1).cast("bigint").alias("n"))
    return labels.unionByName(roots).unionByName(depth).unionByName(paths)
