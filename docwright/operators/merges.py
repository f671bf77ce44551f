"""Keyed merges, overlays, reconciliation and joins with rule tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docwright.plans.numbering import numbered


def keep_first(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return ranked.filter("_rank = 1").drop("_rank")


def best_of(rows: DataFrame, key: list[str], order: Column, take: list[str]) -> DataFrame:
    """Columns ``take`` of the row with the largest ``order``; aggregates before the shuffle."""
    return rows.groupBy(*key).agg(*[F.max_by(c, order).alias(c) for c in take])


def changes(before: DataFrame, now: DataFrame, key: str, digest: str) -> DataFrame:
    """key and status of each row: new, unchanged, changed or kept (only before)."""
    a = before.select(F.col(key).alias("_key"), F.col(digest).alias("_old"))
    b = now.select(key, F.col(digest).alias("_new"))
    met = b.join(a, F.col(key) == F.col("_key"), "full_outer")
    status = (
        F.when(F.col("_key").isNull(), "new").when(F.col(key).isNull(), "kept")
        .when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("changed")
    )
    return met.select(F.coalesce(key, "_key").alias(key), status.alias("status"))


def upsert(before: DataFrame, now: DataFrame, key: str, digest: str, number: str) -> DataFrame:
    """Rows of ``before`` with those of ``now`` laid over; the old number stays, new rows get the next ones.

    Numbers are given by rank of the key among the new rows; nothing is deleted.
    """
    rest = [c for c in now.columns if c not in (key, number)]
    a = before.select(F.col(key).alias("_key"), F.col(number).alias("_number"), F.struct(*rest).alias("_a"))
    b = now.select(key, F.struct(*rest).alias("_b"))
    met = b.join(a, F.col(key) == F.col("_key"), "full_outer")
    same = F.col(f"_a.{digest}").eqNullSafe(F.col(f"_b.{digest}"))
    chosen = F.when(F.col("_b").isNull() | (F.col("_a").isNotNull() & same), F.col("_a")).otherwise(F.col("_b"))
    known = met.select(F.coalesce(key, "_key").alias(key), F.col("_number").alias(number), chosen.alias("_c"))
    fresh = numbered(known.filter(F.col(number).isNull()).select(key), [key], "_n")
    top = before.agg(F.coalesce(F.max(number), F.lit(0)).alias("_top"))
    given = fresh.withColumn("_one", F.lit(1)).join(F.broadcast(top.withColumn("_one", F.lit(1))), "_one")
    given = given.select(F.col(key).alias("_fresh"), (F.col("_top") + F.col("_n")).alias("_next"))
    out = known.join(given, F.col(key) == F.col("_fresh"), "left")
    return out.select(key, F.coalesce(number, "_next").cast("bigint").alias(number), "_c.*")


def overlay(base: DataFrame, human: DataFrame, manifest: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Three-way merge: base rows with a human's fields laid over.

    A row without a human counterpart is deleted if the manifest says that the human had it before,
    and kept otherwise; rows only the human has are added. ``overridden`` lists the fields that differ.
    """
    a = base.select(F.col(key).alias("_a"), *[F.col(f).alias(f"_a_{f}") for f in fields])
    b = human.select(F.col(key).alias("_b"), *[F.col(f).alias(f"_b_{f}") for f in fields])
    had = manifest.select(F.col(key).alias("_m")).distinct()
    met = a.join(b, F.col("_a") == F.col("_b"), "full_outer").join(had, F.coalesce("_a", "_b") == F.col("_m"), "left")
    gone = F.col("_b").isNull() & F.col("_m").isNotNull()
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    differ = F.array_compact(F.array(*[F.when(both & ~F.col(f"_a_{f}").eqNullSafe(F.col(f"_b_{f}")), f) for f in fields]))
    status = (
        F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "kept")
        .when(F.size(differ) > 0, "overridden").otherwise("same")
    )
    values = [F.when(F.col("_b").isNull(), F.col(f"_a_{f}")).otherwise(F.col(f"_b_{f}")).alias(f) for f in fields]
    return met.filter(~gone).select(
        F.coalesce("_a", "_b").alias(key), *values, status.alias("status"), F.array_join(differ, ",").alias("overridden")
    )


def longest_text(left: DataFrame, right: DataFrame, key: str, text: str, only_right: list[str]) -> DataFrame:
    """Full outer merge in which the longer text stays (ties: left); ``only_right`` is attached."""
    b = right.select(F.col(key).alias("_key"), F.col(text).alias("_text"), *only_right)
    met = left.select(key, text).join(b, F.col(key) == F.col("_key"), "full_outer")
    longer = F.length(F.coalesce("_text", F.lit(""))) > F.length(F.coalesce(text, F.lit("")))
    return met.select(F.coalesce(key, "_key").alias(key), F.when(longer, F.col("_text")).otherwise(F.col(text)).alias(text), *only_right)


def append_absent(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """``first`` and the rows of ``second`` whose key it has not."""
    return first.unionByName(second.join(first.select(*key).distinct(), key, "left_anti"))


def zip_rows(left: DataFrame, right: DataFrame, by: list[str], left_order: list[str], right_order: list[str]) -> DataFrame:
    """Rows paired by place within each group; the longer side is cut."""
    place = lambda order: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    a, b = left.withColumn("place", place(left_order)), right.withColumn("place", place(right_order))
    return a.join(b, [*by, "place"])


def decreases(before: DataFrame, now: DataFrame, key: list[str], count: str, limit: float) -> DataFrame:
    """Groups whose count fell by strictly more than ``limit``, lost ones among them."""
    a = before.select(*key, F.col(count).alias("before"))
    met = a.join(now.select(*key, F.col(count).alias("now")), key, "left").withColumn("now", F.coalesce("now", F.lit(0)))
    return met.filter((F.col("before") - F.col("now")) > limit * F.col("before"))


def matching_paths(paths: DataFrame, rules: DataFrame, path: str, rule: str, order: str) -> DataFrame:
    """``paths`` with the first rule (by ``order``) whose segments fit the path's last segments.

    ``{x}`` stands for any segment on either side. Paths and rules are met by number of segments and
    last segment, or by ``{}`` where one of them is a wildcard, so no pair is made that can't fit.
    """
    cut = lambda c: F.filter(F.split(F.regexp_replace(F.lower(c), r"\{[^}]*\}", "{}"), "/", -1), lambda s: s != "")
    last = lambda a: F.element_at(a, -1)
    r = rules.select(F.struct(*rules.columns).alias("rule"), cut(F.col(rule)).alias("rs")).filter(F.size("rs") > 0)
    p = paths.select(path).distinct().withColumn("ps", cut(F.col(path))).filter(F.size("ps") > 0)
    both = F.when(last(F.col("rs")) == "{}", F.array(F.lit("*"))).otherwise(F.array(last(F.col("rs")), F.lit("{}")))
    mine = F.when(last(F.col("ps")) == "{}", F.array(F.lit("{}"), F.lit("*"))).otherwise(F.array(last(F.col("ps")), F.lit("*")))
    met = p.withColumn("k", F.explode(mine)).join(r.withColumn("k", F.explode(both)), "k")
    n = F.least(F.size("ps"), F.size("rs"))
    tail = lambda a: F.slice(a, F.size(a) - n + 1, n)
    fits = F.forall(F.zip_with(tail(F.col("ps")), tail(F.col("rs")), lambda a, b: (a == b) | (a == "{}") | (b == "{}")), lambda x: x)
    first = met.filter(fits).groupBy(path).agg(F.min_by("rule", F.col(f"rule.{order}")).alias("rule"))
    return paths.join(first.withColumnRenamed(path, "_path"), F.col(path) == F.col("_path"), "left").drop("_path")
