"""Drafts: assembly a vendor, ordered lists, vendor scenarios, manifests and merge reports, and the rules' summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docwright.operators import routing, validation
from docwright.operators.generation import NEGATIVE

#: The section and category of scenarios that name none, and the tag of all of them.
SCENARIO_SECTION, SCENARIO_CATEGORY, SCENARIO_TAG = "User Behavior > Bet and Settle", "vendor_provided", "vendor_provided"
#: Rows of the merge report's summary, by name of the count.
REPORT_ROWS = {
    "base_cases": "Base cases", "human_cases": "Human copy cases", "overridden": "Overridden by human", "added_from_human": "Added from human",
    "deleted_by_human": "Deleted by human", "new_from_base": "New from base", "base_only_without_manifest": "Base-only kept because manifest missing",
    "regenerated_human_ids": "Regenerated human IDs", "duplicate_same_title": "Duplicate same title skipped", "warnings": "Warnings", "conflicts": "Conflicts",
}


def assemble(vendors: DataFrame, key: str, single: dict[str, DataFrame], listed: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """One nested row a vendor: ``single`` parts as structs, ``listed`` parts as arrays of structs in their order.

    What a vendor's documents hold is gathered in one row, which is what a draft is; a vendor without a
    part has null or an empty array there.
    """
    drafts = vendors
    for name, part in single.items():
        fields = [c for c in part.columns if c != key]
        drafts = drafts.join(part.select(key, F.struct(*fields).alias(name)), key, "left")
    for name, (part, order) in listed.items():
        fields = [c for c in part.columns if c != key]
        pair = F.struct(F.struct(*order).alias("at"), F.struct(*fields).alias("row"))
        rows = F.transform(F.array_sort(F.collect_list(pair)), lambda x: x.row)
        held = part.groupBy(key).agg(rows.alias(name))
        drafts = drafts.join(held, key, "left").withColumn(name, F.coalesce(name, F.array().cast(held.schema[name].dataType)))
    return drafts


def by_priority(names: Column, priority: list[str]) -> Column:
    """Distinct names, those of ``priority`` first and in its order, then the others by name."""
    ranks = F.array(*[F.lit(p) for p in priority])
    rank = lambda x: F.coalesce(F.nullif(F.array_position(ranks, x), F.lit(0)), F.lit(len(priority) + 1))
    keyed = F.transform(F.array_distinct(names), lambda x: F.struct(rank(x).alias("rank"), x.alias("name")))
    return F.transform(F.array_sort(keyed), lambda x: x["name"])


def by_example(names: Column, keys: Column) -> Column:
    """Names in the order of an example's keys, in any case of letters; unknown names after them, in their own order."""
    low = F.transform(keys, F.lower)
    rank = lambda x: F.coalesce(F.nullif(F.array_position(low, F.lower(x)), F.lit(0)), F.size(low).cast("bigint") + 1)
    keyed = F.transform(names, lambda x, i: F.struct(rank(x).alias("rank"), i.alias("place"), x.alias("name")))
    return F.transform(F.array_sort(keyed), lambda x: x["name"])


def display_name(endpoint: Column) -> Column:
    """The last segment of an endpoint that is no path parameter."""
    parts = F.filter(F.split(F.coalesce(endpoint, F.lit("")), "/", -1), lambda s: s != "")
    plain = F.filter(parts, lambda s: ~s.rlike(r"^\{.*\}$"))
    return F.coalesce(F.get(plain, F.size(plain) - 1), F.get(parts, F.size(parts) - 1), F.lit("unknown"))


def vendor_scenarios(items: DataFrame, endpoints: DataFrame, keep: list[str], error: str) -> DataFrame:
    """Cases of the scenarios that a vendor hands over, with defaults; those of the parameter section go.

    ``items`` has place, output_section, category, scenario, module, endpoint, priority, ``tags`` (array) and
    error_code; ``endpoints`` has endpoint and role, each endpoint once. A scenario of failure without an
    error gets ``error``, a column of ``items``.
    """
    said = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), other)
    roles = endpoints.select(F.col("endpoint").alias("_endpoint"), "role")
    held = items.withColumn("output_section", said("output_section", F.lit(SCENARIO_SECTION))).filter(F.col("output_section") != validation.PARAMETERS)
    met = held.join(roles, F.col("endpoint") == F.col("_endpoint"), "left")
    told, fails = F.lower(F.concat_ws("\n", "category", "scenario")), F.lit(False)
    for word in NEGATIVE:
        fails = fails | told.contains(word)
    return met.select(
        *keep, F.format_string("vendor-scenario-%02d", "place").alias("id"), "output_section", said("category", F.lit(SCENARIO_CATEGORY)).alias("category"),
        said("scenario", F.concat(F.lit("Vendor scenario "), "place")).alias("scenario"), said("module", display_name(F.col("endpoint"))).alias("module"),
        F.coalesce("role", F.lit("")).alias("endpoint_group"), F.array_union(F.coalesce("tags", F.array().cast("array<string>")), F.array(F.lit(SCENARIO_TAG))).alias("tags"),
        said("priority", F.lit("P2")).alias("priority"), said("error_code", F.when(fails, F.col(error))).alias("error_code"),
    )


def manifest(cases: DataFrame, vendor: str, key: str, order: list[str], shown: list[str]) -> DataFrame:
    """A row a vendor: ``final_case_keys`` in order, and ``case_index`` from key to the fields ``shown``."""
    shown_as = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in shown])
    at = F.struct(*order)
    # a key's places and its first case are found before the vendor's keys come together, so no list is searched
    by_key = cases.groupBy(vendor, F.col(key).alias("key")).agg(F.collect_list(at).alias("places"), F.min_by(shown_as, at).alias("shown"), F.min(at).alias("first"))
    held = by_key.groupBy(vendor).agg(
        F.array_sort(F.flatten(F.collect_list(F.transform("places", lambda p: F.struct(p.alias("at"), F.col("key").alias("key")))))).alias("every"),
        F.array_sort(F.collect_list(F.when(F.col("key").isNotNull(), F.struct("first", "key", "shown")))).alias("firsts"),
    )
    return held.select(
        vendor, F.transform("every", lambda x: x.key).alias("final_case_keys"), F.map_from_entries(F.transform("firsts", lambda x: F.struct(x.key, x.shown))).alias("case_index")
    )


def report_lines(counts: DataFrame, vendor: str, status: str = "success") -> DataFrame:
    """vendor and ``report``: the merge report's head and summary as Markdown; counts that are absent are 0."""
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("0")) if c in counts.columns else F.lit("0")
    name = F.coalesce(F.nullif(F.col(vendor).cast("string"), F.lit("")), F.lit("Vendor"))
    head = [F.concat(F.lit("# "), name, F.lit(" Human XMind Merge Report")), *map(F.lit, ("", f"Status: {status}", "", "## Summary", "", "| Item | Count |", "|---|---:|"))]
    rows = [F.concat(F.lit(f"| {label} | "), number(c), F.lit(" |")) for c, label in REPORT_ROWS.items()]
    return counts.select(vendor, F.concat(F.concat_ws("\n", *head, *rows), F.lit("\n")).alias("report"))


def summary(spark: SparkSession) -> DataFrame:
    """name and values of the rules that drafts and cases are held against."""
    rules = {
        "required_test_case_fields": validation.REQUIRED, "preconditions_label": [validation.PRECONDITIONS], "remarks_label": [validation.REMARKS],
        "canonical_sections": [validation.PARAMETERS, *routing.LEAVES], "mapping_rule_ids": list(dict.fromkeys(r for r, *_ in routing.ROUTES)), "negative_keywords": NEGATIVE,
        **{f"categories of {s}": c for s, c in validation.CATEGORIES.items()},
    }
    return spark.createDataFrame(list(rules.items()), "name string, values array<string>")
