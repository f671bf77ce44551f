"""Topic trees as rows (topic_id, parent_id, title, ord): paths, cases and their fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docwright.functions.fields import label_of, value_of
from docwright.plans.durable import durable
from docwright.plans.spread import PARTS

CASE = "^(case|用例)[：:]"


#: Topics of a level that is sent whole to all tasks, so that the many topics below a few don't meet in a few tasks.
FEW = 10_000


def flatten(topics: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Every topic with ``depth`` and ``path``, the titles from its root, and the columns ``keep``.

    One join a level; a level is made durable, so a deep tree does not grow the plan. The topics are dealt by their parent once,
    not for each level. A topic that comes again among its own ancestors ends its branch, so that repeated ids can't go round.
    """
    more = keep or []
    columns = dict.fromkeys(["topic_id", "parent_id", "title", "ord", *more])
    parts = PARTS * max(1, topics.sparkSession.sparkContext.defaultParallelism)
    dealt = durable(topics.select(*columns).filter("parent_id is not null").repartition(parts, "parent_id"))
    level = durable(
        topics.filter("parent_id is null").select("topic_id", "title", "ord", *more, F.lit(0).alias("depth"), F.array("title").alias("path"), F.array("topic_id").alias("_ids"))
    )
    out = level
    while True:
        up = level.select(F.col("topic_id").alias("_up"), F.col("depth").alias("_depth"), F.col("path").alias("_path"), "_ids")
        up = F.broadcast(up) if level.limit(FEW + 1).count() <= FEW else up
        level = durable(
            dealt.join(up, F.col("parent_id") == F.col("_up")).filter(~F.array_contains("_ids", F.col("topic_id"))).select(
                "topic_id", "title", "ord", *more, (F.col("_depth") + 1).alias("depth"), F.concat("_path", F.array("title")).alias("path"), F.concat("_ids", F.array("topic_id")).alias("_ids")
            )
        )
        if level.limit(1).count() == 0:
            return out.drop("_ids")
        out = out.unionByName(level)


def cases(topics: DataFrame, fields: dict[str, str]) -> DataFrame:
    """A row a case topic; ``fields`` maps output columns to the labels of its children, of which the last wins."""
    found = topics.filter(F.lower(F.trim("title")).rlike(CASE)).select("topic_id", F.trim(value_of(F.col("title"))).alias("name"))
    child = topics.select(
        F.col("parent_id").alias("_case"), label_of(F.col("title")).alias("_label"), value_of(F.col("title")).alias("_value"), "ord"
    )
    met = found.join(child, F.col("topic_id") == F.col("_case"), "left")
    picked = [F.max_by("_value", F.when(F.col("_label") == label, F.col("ord"))).alias(out) for out, label in fields.items()]
    return met.groupBy("topic_id", "name").agg(*picked)


#: Labels of a case's fields, of its steps and of what a step should give; labels that name a case, the first that has a value counts.
FIELDS = {"preconditions": "前置条件", "module_title": "所属模块", "label": "标签", "remarks": "备注", "priority": "用例等级"}
STEPS, EXPECTED = "步骤描述", "预期结果"
IDS = ["merge_key", "case_key", "case_id", "ID"]
STEP = "struct<index:int,step:string,expected:string,topic_id:string>"


def case_records(topics: DataFrame, tree: list[str]) -> DataFrame:
    """``tree`` and a row a case: topic_id, name, case_id, fields, module_path, labels and steps.

    ``topics`` has the columns ``tree`` (file and sheet, say), topic_id, parent_id, title, ord, path and labels. Fields are the children with a
    label, of which the last wins. Steps are below the last child labelled so, in order; what is below
    a step is what it should give, a line each. Steps and lines are gathered by step and by case alone, never by tree.
    """
    key = [*tree, "topic_id"]
    child = topics.select(*tree, F.col("parent_id").alias("_up"), F.col("topic_id").alias("_id"), F.col("title").alias("_title"), F.col("ord").alias("_ord"))
    label, value = F.coalesce(label_of(F.col("_title")), F.lit("")), F.btrim(F.coalesce(value_of(F.col("_title")), F.lit("")), F.lit(" \t\r\n"))
    cases = topics.filter(F.trim("title").rlike(f"(?i){CASE}"))
    plain = F.trim(value_of(F.col("title")))
    below = cases.select(*key).withColumnRenamed("topic_id", "_up").join(child, [*tree, "_up"]).withColumn("_label", label).withColumn("_value", value)
    is_steps = (F.col("_label") == STEPS) | (F.btrim("_title") == STEPS)
    last = lambda name: F.coalesce(F.max_by("_value", F.when((F.col("_label") == name) & ~is_steps, F.col("_ord"))), F.lit(""))
    fields = below.groupBy(*tree, "_up").agg(*[last(name).alias(out) for out, name in FIELDS.items()], *[last(i).alias(f"_{i}") for i in IDS], F.max_by("_id", F.when(is_steps, F.col("_ord"))).alias("_root"))

    under = lambda rows, up: rows.join(child, [F.col(f"_t_{c}") == F.col(c) for c in tree] + [F.col(up) == F.col("_up")])
    roots = fields.filter("_root is not null").select(*[F.col(c).alias(f"_t_{c}") for c in tree], F.col("_up").alias("_case"), "_root")
    steps = under(roots, "_root").select(*[f"_t_{c}" for c in tree], "_case", F.col("_id").alias("_step"), F.col("_ord").alias("_place"), F.when(value != "", value).otherwise(F.col("_title")).alias("_text"))
    given = child.select(*[F.col(c).alias(f"_g_{c}") for c in tree], F.col("_up").alias("_of"), F.col("_ord").alias("_at"), F.when(label == EXPECTED, value).otherwise(F.col("_title")).alias("_line"))
    met = steps.join(given, [F.col(f"_t_{c}") == F.col(f"_g_{c}") for c in tree] + [F.col("_step") == F.col("_of")], "left")
    lines = F.array_sort(F.collect_list(F.when(F.col("_line") != "", F.struct("_at", "_line"))))
    said = met.groupBy(*[f"_t_{c}" for c in tree], "_case", "_step", "_place", "_text").agg(F.array_join(F.transform(lines, lambda x: x["_line"]), "\n").alias("_expected"))
    gathered = said.groupBy(*[f"_t_{c}" for c in tree], "_case").agg(F.array_sort(F.collect_list(F.struct("_place", "_step", "_text", "_expected"))).alias("_steps"))
    numbered = F.transform("_steps", lambda s, i: F.struct((i + 1).alias("index"), s["_text"].alias("step"), s["_expected"].alias("expected"), s["_step"].alias("topic_id")))
    all_steps = gathered.select(*[f"_t_{c}" for c in tree], "_case", numbered.alias("steps"))

    a = cases.select(*[F.col(c).alias(f"_c_{c}") for c in tree], F.col("topic_id").alias("_c"), plain.alias("name"), "path", F.coalesce("labels", F.array().cast("array<string>")).alias("_labels"))
    whole = a.join(fields, [F.col(f"_c_{c}") == F.col(c) for c in tree] + [F.col("_c") == F.col("_up")], "left").drop(*tree)
    done = whole.join(all_steps, [F.col(f"_c_{c}") == F.col(f"_t_{c}") for c in tree] + [F.col("_c") == F.col("_case")], "left")
    text = lambda c: F.coalesce(c, F.lit(""))
    own = F.coalesce(*[F.when(text(F.col(f"_{i}")) != "", F.col(f"_{i}")) for i in IDS], F.lit(""))
    labels = F.when(text(F.col("label")) != "", F.concat("_labels", F.array("label"))).otherwise(F.col("_labels"))
    # the root's title is no part of a case's module
    return done.select(
        *[F.col(f"_c_{c}").alias(c) for c in tree], F.col("_c").alias("topic_id"), "name", own.alias("case_id"), *[text(F.col(f)).alias(f) for f in FIELDS if f != "label"],
        F.array_join(F.slice("path", F.lit(2), F.greatest(F.lit(0), F.size("path") - 2)), " > ").alias("module_path"), labels.alias("labels"), F.coalesce("steps", F.array().cast(f"array<{STEP}>")).alias("steps"),
    )
