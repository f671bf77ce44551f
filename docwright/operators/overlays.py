"""Cases edited by people laid over generated ones: scenario, steps and markers, with deletions, additions and doubled keys.

Defined results: null keys meet nothing and are kept, or added; null texts are empty, null arrays have no
elements; of human cases with one key the first by ``place`` is matched; empty tables give the other side; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docwright.functions.canonical import json_text

#: The section whose steps stay as generated; the kind of new keys and the name of a missing module.
API_SECTION = "API parameter test"
HUMAN, NO_MODULE = "human", "human_added"
STEP = T.ArrayType(T.StructType([T.StructField("step", T.StringType()), T.StructField("expected", T.StringType())]))
CASE = ["case_key", "place", "section", "module", "scenario", "steps", "markers"]


def normal(text: Column) -> Column:
    """One kind of colon, single blanks, trimmed, lower case."""
    return F.lower(F.btrim(F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("："), F.lit(":")), r"\s+", " ")))


def title(text: Column) -> Column:
    """A scenario to compare by, without the mark of a case before it."""
    return normal(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)^\s*(case|用例)\s*[：:]\s*", ""))


def _slug(text: Column) -> Column:
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_")), F.lit("")), F.lit("unknown"))


def clean_markers(markers: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.coalesce(markers, F.array().cast("array<string>")), lambda m: F.btrim(m)), lambda m: m != ""))


def _plain_steps(steps: Column) -> Column:
    return F.transform(F.coalesce(steps, F.array().cast("array<struct<step:string,expected:string>>")), lambda s: F.struct(
        F.coalesce(s.step, F.lit("")).alias("step"), F.coalesce(s.expected, F.lit("")).alias("expected")))


def _comparable(steps: Column) -> Column:
    return F.transform(steps, lambda s: F.struct(normal(s.step).alias("step"), normal(s.expected).alias("expected")))


def human_index(human: DataFrame) -> DataFrame:
    """Human cases with ``standing``: matched (first of its key), duplicate (same title as the first) or regenerated (another title, so a key of its own).

    The first of a key is found by an aggregate before the shuffle, so a key with a third of all cases gathers nothing.
    """
    held = human.select(*CASE).withColumn("steps", _plain_steps(F.col("steps")))
    first = held.groupBy(F.col("case_key").alias("_key")).agg(F.min(F.struct("place", title(F.col("scenario")).alias("title"))).alias("_first"))
    met = held.join(first, F.col("case_key") == F.col("_key"), "left")
    module = _slug(F.coalesce(F.nullif("section", F.lit("")), F.nullif("module", F.lit("")), F.lit(NO_MODULE)))
    seed = F.concat_ws("|", "case_key", module, F.coalesce("scenario", F.lit("")), json_text(F.col("steps"), STEP))
    standing = F.when(F.col("_key").isNull() | (F.col("place") == F.col("_first.place")), "matched").when(title(F.col("scenario")) == F.col("_first.title"), "duplicate").otherwise("regenerated")
    fresh = F.concat_ws("::", F.lit(HUMAN), module, F.substring(F.sha1(seed), 1, 8))
    return (
        met.withColumn("standing", standing).withColumn("original_key", F.when(F.col("standing") == "regenerated", F.col("case_key")))
        .withColumn("case_key", F.when(F.col("standing") == "regenerated", fresh).otherwise(F.col("case_key"))).select(*CASE, "standing", "original_key")
    )


def overlay_cases(base: DataFrame, human: DataFrame, manifest: DataFrame | None) -> DataFrame:
    """Every case of both sides with what becomes of it.

    Base and human have ``CASE``; ``manifest`` has the ``case_key`` of the last merge, or is None if there was
    none. ``status``: same or overridden (with ``overrides``, the fields laid over), deleted (the manifest
    knows it and the human has it no more), new (the manifest doesn't know it), base_only (no manifest), added, duplicate.
    ``warning`` says that a human emptied steps, which then stay. ``final`` are the cases that remain.
    """
    found = human_index(human)
    h = found.filter("standing <> 'duplicate'").select(F.col("case_key").alias("_h"), *[F.col(c).alias(f"_{c}") for c in ("scenario", "steps", "markers")], F.lit(True).alias("_met"))
    # keys that were made anew may coincide; they never meet base cases, so one of them is enough
    once = h.groupBy("_h").agg(F.first("_met").alias("_met"), *[F.min_by(c, F.xxhash64("_scenario", "_steps", "_markers")).alias(c) for c in ("_scenario", "_steps", "_markers")])
    b = base.select(*CASE).withColumn("steps", _plain_steps(F.col("steps")))
    met = b.join(once, F.col("case_key") == F.col("_h"), "left")
    if manifest is None:
        known, left = met.withColumn("_had", F.lit(False)), F.lit("base_only")
    else:
        had = manifest.filter("case_key is not null").select(F.col("case_key").alias("_m")).distinct()
        known = met.join(had, F.col("case_key") == F.col("_m"), "left").withColumn("_had", F.col("_m").isNotNull())
        left = F.when(F.col("_had"), "deleted").otherwise("new")
    both, api = F.coalesce("_met", F.lit(False)), F.coalesce(F.col("section") == API_SECTION, F.lit(False))
    said = F.btrim(F.coalesce("_scenario", F.lit("")))
    own, theirs = clean_markers(F.col("markers")), clean_markers(F.col("_markers"))
    emptied = both & ~api & (F.size("_steps") == 0) & (F.size("steps") > 0)
    new = {
        "markers": (both & (own != theirs), theirs, F.col("markers")),
        "scenario": (both & (said != "") & (said != F.btrim(F.coalesce("scenario", F.lit("")))), said, F.col("scenario")),
        "steps": (both & ~api & ~emptied & (_comparable(F.col("_steps")) != _comparable(F.col("steps"))), F.col("_steps"), F.col("steps")),
    }
    overrides = F.array_compact(F.array(*[F.when(changed, f) for f, (changed, *_) in new.items()]))
    status = F.when(~both, left).when(F.size(overrides) > 0, "overridden").otherwise("same")
    merged = known.select(
        "case_key", "place", "section", "module", *[F.when(c, v).otherwise(o).alias(f) for f, (c, v, o) in new.items()], status.alias("status"), overrides.alias("overrides"),
        F.when(emptied, "human_steps_empty").alias("warning"), F.lit(None).cast("string").alias("original_key"),
    )
    used = base.filter("case_key is not null").select(F.col("case_key").alias("_b")).distinct()
    rest = found.join(used, F.col("case_key") == F.col("_b"), "left").filter("_b is null or standing = 'duplicate'")
    added = rest.select(
        "case_key", "place", "section", "module", *[(clean_markers(F.col(f)) if f == "markers" else F.col(f)).alias(f) for f in new],
        F.when(F.col("standing") == "duplicate", "duplicate").otherwise("added").alias("status"), F.array().cast("array<string>").alias("overrides"), F.lit(None).cast("string").alias("warning"), "original_key",
    )
    return merged.unionByName(added)


def final(overlaid: DataFrame) -> DataFrame:
    """The cases that remain: all but deleted and duplicate ones."""
    return overlaid.filter("status not in ('deleted', 'duplicate')")
