"""Extraction from lines, sections and tables: endpoints, variants, examples, checklists, codes, actions.

Lines of a document are met as arrays in its row; everything else is a projection or an aggregate that
combines before the shuffle. Null texts have no lines, no endpoints and no codes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docwright.functions.text import let
from docwright.operators.lines import Test, places
from docwright.plans.numbering import numbered

ENABLED = ["y", "yes", "true", "1", "enabled", "on"]
DISABLED = ["n", "no", "false", "0", "disabled", "off"]
#: Lines before and after an anchor that stand for an empty section.
BEFORE, AFTER = 8, 30
#: A heading at most so many lines above an action starts its section.
NEAR = 8


def knowledge(cases: DataFrame, order: list[str], preconditions: Column, path: Column, module: Column) -> DataFrame:
    """``cases`` with case_id, api_name, module and level; the id is the place in the total order of ``order``."""
    last = F.get(path, F.size(path) - 1)
    held = F.coalesce(F.nullif(module, F.lit("")), F.nullif(last, F.lit("")), F.lit("unclassified"))
    api = F.nullif(F.regexp_extract(F.concat_ws(" ", preconditions, path), r"/api/[^\s<]+", 0), F.lit(""))
    made = cases.select("*", held.alias("module"), F.coalesce(api, held).alias("api_name"), F.size(path).alias("level"))
    return numbered(made, order, "_place").withColumn("case_id", F.format_string("TC_%04d", "_place")).drop("_place")


def endpoints(rows: DataFrame, key: str, sources: list[Column], pattern: str) -> DataFrame:
    """Distinct endpoints of each ``key`` and the first source, from 1, that names them."""

    def named(text: Column, n: int) -> Column:
        found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 0)
        return F.transform(found, lambda e: F.struct(e.alias("endpoint"), F.lit(n).alias("source")))

    every = F.concat(*[named(text, n) for n, text in enumerate(sources, 1)])
    return rows.select(key, F.inline(F.array_distinct(every))).groupBy(key, "endpoint").agg(F.min("source").alias("source"))


def variants(docs: DataFrame, key: str, is_heading: Test, is_example: Test, text: str = "text") -> DataFrame:
    """Blocks of lines from heading to heading; kept where a document has several, or one with several examples."""
    split = docs.select(key, F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1).alias("ls"))

    def blocks(at: Column) -> Column:
        def one(i: Column, n: Column) -> Column:
            own = F.slice("ls", i + 1, F.coalesce(F.get(at, n + 1), F.size("ls")) - i)
            count = lambda xs: F.size(xs).cast("bigint")
            return F.struct((n + 1).cast("bigint").alias("block"), F.get("ls", i).alias("title"), count(F.filter(own, is_example)).alias("n_examples"), count(own).alias("n_lines"))

        return F.transform(at, one)

    made = let(places(F.col("ls"), is_heading), blocks)
    return split.select(key, F.inline(let(made, lambda bs: F.filter(bs, lambda x: (F.size(bs) > 1) | (x.n_examples > 1)))))


def slotted(rows: DataFrame, key: str, place: str, mode: Column, example: Column) -> DataFrame:
    """The first example of each slot; a row without a mode takes the mode before it."""
    carried = F.last(mode, ignorenulls=True).over(Window.partitionBy(key).orderBy(place))
    held = rows.select(key, place, carried.alias("slot"), example.alias("example")).filter("slot is not null and example is not null")
    return held.groupBy(key, "slot").agg(F.min_by("example", F.struct(place, "example")).alias("example"))


def enabled(value: Column) -> Column:
    """True, false, or null for what says neither."""
    low = F.lower(F.btrim(value))
    return F.when(low.isin(ENABLED), F.lit(True)).when(low.isin(DISABLED), F.lit(False))


def checklist(rows: DataFrame, name: str, value: str, skipped: list[str]) -> DataFrame:
    """``rows`` of named settings with ``enabled``, without skipped names and thresholds."""
    wanted = (F.btrim(name) != "") & ~F.lower(F.btrim(name)).isin([s.lower() for s in skipped]) & ~F.lower(name).contains("threshold")
    return rows.filter(wanted).withColumn("enabled", enabled(F.col(value)))


def first_codes(rows: DataFrame, key: str, place: str, code: Column, fallback: dict[str, str]) -> DataFrame:
    """The first documented code of each ``key``, else its fallback, else null."""
    other = F.coalesce(*[F.when(F.col(key) == k, v) for k, v in fallback.items()], F.lit(None).cast("string"))
    found = rows.groupBy(key).agg(F.min_by(code, F.when(code.isNotNull(), F.col(place))).alias("code"))
    return found.select(key, F.coalesce("code", other).alias("code"))


def error_codes(tiers: list[DataFrame], last_resort: DataFrame, key: str, place: str) -> DataFrame:
    """(key, code, message, tier): the first tier wins a code; the last resort serves keys without any code."""
    columns = [key, "code", "message", place]
    best = lambda df: df.groupBy(key, "code").agg(
        F.min_by("message", F.struct("tier", place, "message")).alias("message"), F.min("tier").alias("tier")
    )
    every = tiers[0].select(*columns, F.lit(1).alias("tier"))
    for n, tier in enumerate(tiers[1:], 2):
        every = every.unionByName(tier.select(*columns, F.lit(n).alias("tier")))
    found = best(every)
    rest = last_resort.select(*columns, F.lit(len(tiers) + 1).alias("tier")).join(found.select(key).distinct(), key, "left_anti")
    return found.unionByName(best(rest))


def capabilities(docs: DataFrame, key: str, text: str, words: dict[str, list[str]], settings: DataFrame) -> DataFrame:
    """(key, capability, enabled, origin): from keywords, overridden by ``settings`` (key, capability, enabled)."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    said = [F.struct(F.lit(c).alias("capability"), low.rlike("|".join(w)).alias("said")) for c, w in words.items()]
    held = settings.groupBy(key, "capability").agg(F.bool_or("enabled").alias("set"))
    met = docs.select(key, F.inline(F.array(*said))).join(held, [key, "capability"], "left")
    origin = F.when(F.col("set").isNotNull(), "checklist").otherwise("text")
    return met.select(key, "capability", F.coalesce("set", "said").alias("enabled"), origin.alias("origin"))


def action_index(docs: DataFrame, key: str, is_action: Test, is_heading: Test, text: str = "text") -> DataFrame:
    """The first line of each action of a document, in any case of letters, and where its section starts."""
    split = docs.select(key, F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1).alias("ls"))
    placed = split.select(key, "ls", places(F.col("ls"), is_heading).alias("heads"), places(F.col("ls"), is_action).alias("at"))
    action = lambda i: F.lower(F.get("ls", i))

    def one(i: Column, n: Column) -> Column:
        head = F.try_element_at(F.filter("heads", lambda h: h <= i), F.lit(-1))
        start = F.when(i - head <= NEAR, head).otherwise(i)
        is_first = ~F.exists(F.slice("at", F.lit(1), n), lambda j: action(j) == action(i))
        return F.when(is_first, F.struct(action(i).alias("action"), i.alias("line_no"), start.alias("start")))

    return placed.select(key, F.inline(F.array_compact(F.transform("at", one))))


def slices(docs: DataFrame, key: str, text: str, patterns: list[str]) -> DataFrame:
    """(key, section_no, start, n_lines, body) from each anchor to the next; an empty section takes lines about its anchor.

    A line is an anchor once for each pattern it matches. All happens inside the row, so no text is shuffled.
    """

    def places(pattern: str) -> Column:
        return F.array_compact(F.transform("ls", lambda x, i: F.when(x.rlike(pattern), i)))

    def cut(start: Column, n: Column) -> Column:
        end, size = F.coalesce(F.get("at", n + 1), F.size("ls")), F.size("ls")
        low = F.when(end > start, start).otherwise(F.greatest(F.lit(0), start - BEFORE))
        high = F.when(end > start, end).otherwise(F.least(size, start + AFTER))
        body = F.array_join(F.slice("ls", low + 1, high - low), "\n")
        return F.struct(F.format_string("SEC_%03d", n + 1).alias("section_no"), start.alias("start"), (high - low).alias("n_lines"), body.alias("body"))

    split = docs.select(key, F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1).alias("ls"))
    placed = split.select(key, "ls", F.sort_array(F.concat(*map(places, patterns))).alias("at"))
    return placed.select(key, F.inline_outer(F.transform("at", cut))).filter("start is not null")


def categorised(cases: DataFrame, key: str, module: str, path: str, selectors: DataFrame) -> DataFrame:
    """(key, category) of the first category by ``ord`` with a selector for the case; ``selectors`` is broadcast if its size allows."""
    fits = (F.col(module) == F.col("_module")) & F.col(path).contains(F.col("fragment"))
    met = cases.select(key, module, path).join(selectors.withColumnRenamed("module", "_module"), fits)
    return met.groupBy(key).agg(F.min_by("category", F.struct("ord", "category")).alias("category"))


def zip_places(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Rows of both sides with the same place in their total orders; the longer side is cut."""
    return numbered(left, left_order, "place").join(numbered(right, right_order, "place"), "place")
