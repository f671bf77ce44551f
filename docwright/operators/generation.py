"""Generated cases: sections, rewritten steps, path parameters, dependency cases, expected errors, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of failure.
NEGATIVE = [
    "fail", "failed", "failure", "reject", "rejected", "error", "invalid", "missing", "duplicate", "timeout", "not found", "exceed", "negative",
]
#: Fixed value: the section of parameter cases.
API_SECTION = "API parameter test"


def automation_tag(section: Column) -> Column:
    """``ui_auto`` below a game section, else ``api_auto``."""
    return F.when(F.lower(section).rlike("(^|/)game(/|$)"), "ui_auto").otherwise("api_auto")


def rewrite_steps(steps: Column, expected: Column, targets: dict[str, str], default: str) -> Column:
    """Array of (step, expected); endpoint texts are replaced where their target is not empty, missing results by ``default``."""

    def said(x: Column) -> Column:
        for old, new in targets.items():
            x = F.replace(x, F.lit(old), F.lit(new)) if new else x
        return x

    return F.transform(steps, lambda s, i: F.struct(said(s).alias("step"), F.coalesce(F.get(expected, i), F.lit(default)).alias("expected")))


def path_parameters(path: Column) -> Column:
    """Names in braces, in order."""
    return F.array_distinct(F.regexp_extract_all(path, F.lit(r"\{([^{}]+)\}"), 1))


def dependency_cases(rules: DataFrame, parameters: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each step of each rule: required 2, optional 1, forbidden 1, and 1 for a constraint; unknown parameters give an error row."""
    met = rules.join(parameters.select(*keys).distinct().withColumn("_known", F.lit(True)), keys, "left")
    by_state = (
        F.when(F.col("_known").isNull(), F.array(F.lit("unknown parameter")))
        .when(F.col("state") == "required", F.array(F.lit("missing"), F.lit("valid")))
        .when(F.col("state") == "optional", F.array(F.lit("valid without")))
        .otherwise(F.array(F.lit("sent though forbidden")))
    )
    violated = F.when(F.col("_known") & F.col("constraint").isNotNull(), F.array(F.lit("constraint violated"))).otherwise(F.array().cast("array<string>"))
    steps = met.select(*rules.columns, F.posexplode(F.concat(by_state, violated)).alias("_n", "step"))
    return steps.withColumn("step_no", F.col("_n") + 1).drop("_n")


def expected_errors(wanted: DataFrame, responses: DataFrame, key: str, group: str) -> DataFrame:
    """``wanted`` with the error of its own endpoint, else the first of its group by place, else ``{}``."""
    own = responses.groupBy(key).agg(F.min_by("error", F.struct("place", "error")).alias("_own"))
    other = responses.groupBy(group).agg(F.min_by("error", F.struct("place", "error")).alias("_other"))
    met = wanted.join(own, key, "left").join(other, group, "left")
    rank = F.when(F.col("_own").isNotNull(), 0).when(F.col("_other").isNotNull(), 1).otherwise(2)
    return met.select(*wanted.columns, F.coalesce("_own", "_other", F.lit("{}")).alias("error"), rank.alias("rank"))


def diagnosis(runs: DataFrame, key: str) -> DataFrame:
    """Counts of a key's stages and the message of its first failed stage."""
    bad = F.col("ok") == F.lit(False)
    return runs.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_stages"), F.count_if(bad).alias("n_failed"), F.min_by("message", F.when(bad, F.struct("stage", "message"))).alias("first_failure")
    )


def ambiguous(names: DataFrame, name: str) -> DataFrame:
    """Names that are equal but for case, with the number of spellings."""
    return names.groupBy(F.lower(name).alias("folded")).agg(F.count_distinct(name).alias("n_spellings"), F.min(name).alias("first")).filter("n_spellings > 1")


def replace_generated(existing: DataFrame, generated: list[DataFrame], origin: str, ours: list[str], section: str, tag: str) -> DataFrame:
    """``existing`` without rows of our origins, then the generated rows, each with one automation tag."""
    made = generated[0]
    for more in generated[1:]:
        made = made.unionByName(more)
    kept = existing.filter(~F.coalesce(F.col(origin), F.lit("")).isin(ours))
    return kept.unionByName(made.withColumn(tag, automation_tag(F.coalesce(F.col(section), F.lit("")))))


def looks_negative(*texts: Column) -> Column:
    """Whether any of the texts holds a word of failure."""
    return F.lower(F.concat_ws(" ", *texts)).rlike("|".join(NEGATIVE))


def output_section(module_path: Column) -> Column:
    """From ``User Behavior`` on, else the last two parts, else the part, else ``Human Added``."""
    parts = F.filter(F.transform(F.split(F.coalesce(module_path, F.lit("")), ">", -1), lambda p: F.btrim(p)), lambda p: p != "")
    at = F.array_position(parts, F.lit("User Behavior")).cast("int")
    n = F.size(parts)
    tail = F.when(at > 0, F.slice(parts, F.greatest(at, F.lit(1)), n)).otherwise(F.slice(parts, F.greatest(n - 1, F.lit(1)), F.lit(2)))
    return F.when(n == 0, "Human Added").when(F.array_contains(parts, API_SECTION), API_SECTION).otherwise(F.array_join(tail, " > "))
