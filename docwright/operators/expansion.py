"""Request parameters of an endpoint as its example shows them: types, order, and parameters inside of others.

Everything stays in the endpoint's row; one Arrow function reads its example.

Defined results: a null or unreadable example changes nothing; parameters without a name go; of equal
names the first stays; equal rows are kept; an empty table gives an empty table; extra columns are passed by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwright.functions import nested
from docwright.functions.text import let


def by_variant(endpoints: DataFrame) -> DataFrame:
    """A row for each operation variant that has parameters, with the variant's fields in place of the endpoint's; endpoints without such stay.

    ``endpoints`` has endpoint, parameters, example and variants (operation, parameters, example).
    """
    own = F.filter(F.coalesce("variants", F.array()), lambda v: F.size(v.parameters) > 0)
    rest = [c for c in endpoints.columns if c not in ("parameters", "example", "variants")]
    each = endpoints.select(*rest, "parameters", "example", F.explode_outer(own).alias("_v"))
    return each.select(*rest, F.coalesce("_v.parameters", "parameters").alias("parameters"), F.coalesce("_v.example", "example").alias("example"), F.coalesce("_v.operation", F.lit("")).alias("operation"))


def path_parameters(endpoint: Column) -> Column:
    """Parameters that stand in braces in the path, each once."""
    names = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(F.coalesce(endpoint, F.lit("")), F.lit(r"\{([^{}]+)\}"), 1), lambda n: F.btrim(n)), lambda n: n != ""))
    said = lambda n: F.concat(F.lit("Path parameter in endpoint URL: "), n, F.lit("."))
    return F.transform(names, lambda n: F.struct(n.alias("name"), F.lit("string").alias("type"), F.lit("Y").alias("required"), said(n).alias("description"), F.lit(None).cast("string").alias("parent"), F.lit("path_parameter").alias("source")))


def expand(endpoints: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, place and the fields of each parameter.

    A parameter without a type gets that of an object or array in the example. Parameters follow the
    keys of the example, unknown ones after them in their own order. Children come after their parent, named parent/child; a parameter
    that is only a child's last name, and no key of the example itself, goes.
    """
    given = F.filter("parameters", lambda p: F.btrim(F.coalesce(p["name"], F.lit(""))) != "")
    held = endpoints.select(*keep, "example", given.alias("ps"))
    read = held.withColumn("seen", nested.expanded(F.col("example"), F.transform("ps", lambda p: F.btrim(p["name"])))).withColumn(
        "keys", F.transform(F.coalesce(F.json_object_keys("example"), F.array().cast("array<string>")), lambda k: F.lower(k)))
    blank = lambda c: F.btrim(F.coalesce(c, F.lit(""))) == ""

    def own(p: Column, i: Column) -> Column:
        seen = F.get("seen", i)
        at = F.when(F.array_contains("keys", F.lower(F.btrim(p["name"]))), F.array_position("keys", F.lower(F.btrim(p["name"]))) - 1).otherwise(F.size("keys") + i)
        children = F.transform(seen.children, lambda c: F.struct(
            c["name"].alias("name"), c.type.alias("type"), F.coalesce(p.required, F.lit("")).alias("required"),
            F.concat(F.lit("Child parameter inferred from request example under "), F.btrim(p["name"]), F.lit(".")).alias("description"),
            F.btrim(p["name"]).alias("parent"), F.lit("request_example_child").alias("source")))
        me = F.struct(p["name"].alias("name"), F.when(blank(p.type) & seen.type.isNotNull(), seen.type).otherwise(p.type).alias("type"), p.required.alias("required"), p.description.alias("description"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("source"))
        return F.struct(at.cast("int").alias("at"), i.alias("i"), F.struct(me.alias("me"), children.alias("children")).alias("x"))

    placed = read.withColumn("ordered", F.transform(F.array_sort(F.transform("ps", own)), lambda o: o.x))
    # children of equal names are those of the last parameter of that name
    leaves = F.array_distinct(F.transform(F.flatten(F.transform("ordered", lambda x: x.children)), lambda c: F.element_at(F.split(c["name"], "/"), -1)))
    folded = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    inner = placed.withColumn("leaves", leaves)
    only_inner = lambda x: F.array_contains("leaves", F.btrim(x.me["name"])) & ~F.exists("keys", lambda k: folded(k) == folded(x.me["name"]))
    last = lambda x: F.element_at(F.filter("ordered", lambda y: F.btrim(y.me["name"]) == F.btrim(x.me["name"])), -1).children
    every = F.flatten(F.transform(F.filter("ordered", lambda x: ~only_inner(x)), lambda x: F.concat(F.array(x.me), last(x))))
    once = let(every, lambda es: F.filter(F.transform(es, lambda e, i: F.when(~F.exists(F.slice(es, F.lit(1), i), lambda d: F.btrim(d["name"]) == F.btrim(e["name"])), e)), lambda e: e.isNotNull()))
    return inner.select(*keep, F.posexplode(once).alias("place", "p")).select(*keep, "place", "p.*")
