"""Case records as compact knowledge: 19 fields, with the lines that validate and those that look at stored data.

Everything but the generated ids is computed inside the record's row; ids are places in a total order that no
single task sorts.

Defined results: null texts and arrays are empty; empty fields count as missing in the content hash; equal
rows are kept and numbered apart; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwright.functions.canonical import content_hash
from docwright.operators.rules import tags_of
from docwright.plans.numbering import numbered

#: Words in lines that look at stored data, and in lines that validate.
DB_WORDS = ["db", "database", "sql", "opensearch", "gabo", "vendor bo", "record"]
VALIDATION_WORDS = ["check", "verify", "response", "error code", "balance", "record", "must", "equals", "equal", "show"]
NO_MODULE = "unclassified"


def compact(text: Column) -> Column:
    """Trimmed, with at most one empty line in a row."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""), r"\n{3,}", "\n\n")


def lines_with(lines: Column, words: list[str]) -> Column:
    """The distinct lines that hold any of the words, in any case of letters."""
    return F.array_distinct(F.filter(lines, lambda x: F.lower(x).rlike("|".join(words)) & (x != "")))


def knowledge_cases(records: DataFrame, order: list[str]) -> DataFrame:
    """A row a case with the fields of its knowledge, in the total order of the columns ``order``.

    ``records`` has file, sheet, topic_id, name, case_id, preconditions, module_title, module_path, path, steps (step, expected), remarks and priority.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    said = lambda f: F.transform(F.filter(F.coalesce("steps", F.array()), lambda s: F.coalesce(s[f], F.lit("")) != ""), lambda s: compact(s[f]))
    parts = F.filter(F.transform(F.split(text("module_path"), ">", -1), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    module = F.when(text("module_title") != "", compact(F.col("module_title"))).otherwise(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(NO_MODULE)))
    api = F.regexp_extract(F.concat_ws("\n", text("preconditions"), text("module_path")), r"(/api/[^\s<]+)", 1)
    path = F.coalesce("path", F.array().cast("array<string>"))
    read = numbered(records, order, "_place").select(
        *order, "_place", text("case_id").alias("own_id"), module.alias("module"), api.alias("_api"), compact(F.col("name")).alias("scenario"), text("module_path").alias("path"),
        F.size(F.filter(path, lambda p: p != "")).alias("level"), F.coalesce(F.get(path, F.size(path) - 2), F.lit("")).alias("parent_topic"), compact(F.col("preconditions")).alias("preconditions"),
        said("step").alias("steps"), said("expected").alias("expected_results"), text("priority").alias("priority"),
        F.struct(text("file").alias("xmind_file"), text("sheet").alias("sheet"), text("topic_id").alias("topic_id")).alias("source"),
        F.concat_ws(" ", text("name"), text("module_path"), text("preconditions"), text("remarks")).alias("_said"),
    )
    generated = F.format_string("TC_%04d", F.col("_place"))
    every = F.concat("steps", "expected_results")
    made = read.select(
        *order, F.when(F.col("own_id") != "", F.col("own_id")).otherwise(generated).alias("id"), F.when(F.col("own_id").isin("") | (F.col("own_id") == generated), "").otherwise(generated).alias("generated_id"),
        F.when(F.col("_api") != "", F.col("_api")).otherwise(F.col("module")).alias("api_name"), "module", "scenario", F.col("scenario").alias("title"), "path", "level", "parent_topic", F.col("scenario").alias("child_topic"),
        "preconditions", "steps", "expected_results", lines_with(every, VALIDATION_WORDS).alias("validation_points"), lines_with(every, DB_WORDS).alias("db_checks"),
        tags_of(F.concat_ws(" ", "_said", F.array_join("steps", " "), F.array_join("expected_results", " "))).alias("tags"), "priority", "source",
    )
    known = {f.name: f.dataType.typeName() for f in made.schema.fields}
    missing = lambda c: F.when(F.size(c) > 0, F.col(c)) if known[c] == "array" else F.nullif(F.col(c), F.lit("")) if known[c] == "string" else F.col(c)
    hashed = made.withColumns({c: missing(c) for c in known if c not in order})
    return hashed.withColumn("content_hash", content_hash(hashed))
