"""Parameter dependencies: one formal line a parameter, compiled to rules that hold or close the endpoint.

``Dependency: when mode in [A,B] => Y; when mode = C => N(omit); error=BAD_REQUEST``. Each clause
between semicolons is a condition with its outcome, ``otherwise`` with its outcome, or ``error=``
and ``group=``. A clause of another form, a missing error, an unknown outcome or an unknown
selector closes the whole endpoint: none of its rules remain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwright.plans.spread import PARTS

OUTCOME = r"(Y|N)(?:\((value *(?:>=|<=|=|>|<) *-?[0-9.]+|optional|omit|forbidden)\))?"
WHEN = rf"^when +([A-Za-z0-9_./]+) +(present|absent|true|false|in \[[^\]]*\]|= *[^ =>]+) *=> *{OUTCOME}$"
OTHERWISE = rf"^otherwise *=> *{OUTCOME}$"
SETTING = r"^(error|group) *= *([A-Za-z0-9_]+)$"
HEADING = r"(?i)^(required?|optional|omit|forbidden)\s+when\s*:?[ \t]*$"
EQUALS = r"^([A-Za-z_][\w./-]*)\s*=\s*([^=]+?)\s*$"
TOKEN = r"^[A-Za-z][A-Za-z0-9_.-]*$"
#: Words that mark a list of allowed values, and the error of human blocks.
ALLOWED = ["allowed values", "following values", "one of"]
HUMAN_ERROR = "BAD_REQUEST"
LINE = r"(?im)^ *dependency: *(.+?) *$"


def clauses(remark: Column) -> Column:
    """The trimmed clauses of a remark's dependency line; none without one."""
    line = F.regexp_extract(F.coalesce(remark, F.lit("")), LINE, 1)
    return F.filter(F.transform(F.split(line, ";", -1), lambda c: F.btrim(c)), lambda c: c != "")


def state(letter: Column, detail: Column) -> Column:
    """required, forbidden or optional."""
    return F.when(letter == "Y", "required").when(detail.isin("omit", "forbidden"), "forbidden").otherwise("optional")


def compile_rules(parameters: DataFrame, endpoint: str, name: str, remark: str) -> DataFrame:
    """(endpoint, name, ord, selector, condition, state, constraint, error) of the endpoints without a fault.

    Extra columns are ignored; a null or plain remark has no rules; names are met in any case.
    """
    lines = parameters.select(F.col(endpoint).alias("endpoint"), F.col(name).alias("name"), clauses(F.col(remark)).alias("clauses"))
    error = F.filter("clauses", lambda c: c.rlike(r"^error *="))
    held = lines.filter(F.size("clauses") > 0).select(
        "endpoint", "name",
        F.when(F.size(error) == 1, F.regexp_extract(F.get(error, F.lit(0)), SETTING, 2)).alias("error"),
        F.posexplode("clauses").alias("ord", "clause"),
    )
    c = F.col("clause")
    rules = held.filter(~c.rlike(SETTING)).select(
        "endpoint", "name", "ord",
        F.nullif(F.regexp_extract(c, WHEN, 1), F.lit("")).alias("selector"),
        F.when(c.rlike(OTHERWISE), "otherwise").otherwise(F.nullif(F.regexp_extract(c, WHEN, 2), F.lit(""))).alias("condition"),
        F.when(c.rlike(OTHERWISE), F.regexp_extract(c, OTHERWISE, 1)).otherwise(F.regexp_extract(c, WHEN, 3)).alias("letter"),
        F.when(c.rlike(OTHERWISE), F.regexp_extract(c, OTHERWISE, 2)).otherwise(F.regexp_extract(c, WHEN, 4)).alias("detail"),
        "error",
    )
    known = lines.select(F.col("endpoint").alias("_e"), F.lower("name").alias("_s")).distinct()
    met = rules.join(known, (F.col("endpoint") == F.col("_e")) & (F.lower("selector") == F.col("_s")), "left")
    fault = F.col("condition").isNull() | F.coalesce(F.col("error"), F.lit("")).eqNullSafe("") | (F.col("selector").isNotNull() & F.col("_s").isNull())
    closed = met.filter(fault).select(F.col("endpoint").alias("_closed")).distinct()
    open_ = met.join(closed, F.col("endpoint") == F.col("_closed"), "left_anti")
    constraint = F.when(F.startswith("detail", F.lit("value")), F.col("detail"))
    return open_.select("endpoint", "name", "ord", "selector", "condition", state(F.col("letter"), F.col("detail")).alias("state"), constraint.alias("constraint"), "error")


def dotted(name: Column) -> Column:
    return F.array_join(F.filter(F.split(F.trim(name), "[/.]"), lambda p: p != ""), ".")


def human_rules(parameters: DataFrame, errors: DataFrame, code: str = "code") -> DataFrame:
    """(endpoint, name, ord, selector, value, state, error, inferred) of ``Required when:`` and ``Optional when:`` blocks.

    ``parameters`` has endpoint, name, required, description and remark. Blocks are read for parameters of kind Y/N
    without a formal line, and only if ``errors`` documents BAD_REQUEST. A condition is ``selector = value`` or a plain
    token, whose selector is the one named in the same remark, else the one other parameter that lists every token
    among its allowed values. A parameter with a line of another form, an unknown or doubtful selector, or without both
    a required and another block has no rules; the endpoint's other parameters keep theirs. The parameters of an endpoint meet in one row.
    """
    documented = errors.filter(F.trim(code) == HUMAN_ERROR).select(F.lit(HUMAN_ERROR).alias("error")).distinct()
    remark = F.coalesce("remark", F.lit(""))
    held = F.filter(F.transform(F.split(remark, r"\r\n|[\r\n]"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    said = F.transform(held, lambda x, i: F.struct(i.alias("pos"), x.alias("line")))
    asks = (F.upper(F.trim("required")) == "Y/N") & ~remark.rlike(r"(?i)\bdependency\s*[:：]")
    marked = lambda x: F.when(F.lower(x).rlike("|".join(ALLOWED)), x)
    evidence = F.concat_ws("\n", marked(F.col("description")), marked(remark))
    all_ = parameters.withColumn("error", F.lit(HUMAN_ERROR)).join(F.broadcast(documented), "error", "left_semi").select("endpoint", F.struct(dotted(F.col("name")).alias("name"), evidence.alias("evidence"), F.when(asks, said).alias("said")).alias("p")).filter("p.name <> ''")
    parts = PARTS * max(1, parameters.sparkSession.sparkContext.defaultParallelism)
    # the one exchange: what follows is computed inside the row of an endpoint
    known = all_.repartition(parts, "endpoint").groupBy("endpoint").agg(F.collect_list("p").alias("ps"))
    own = F.array_distinct(F.transform(F.filter("ps", lambda p: F.size(p.said) > 0), lambda p: p["name"]))
    one = known.select("endpoint", "ps", F.explode(own).alias("name"))
    lines = F.array_sort(F.flatten(F.transform(F.filter("ps", lambda p: (F.size(p.said) > 0) & (p["name"] == F.col("name"))), lambda p: p.said)))

    def meant(line: Column) -> Column:
        word = F.lower(F.nullif(F.regexp_extract(line, HEADING, 1), F.lit("")))
        return F.when(word.startswith("require"), "required").when(word == "optional", "optional").when(word.isNotNull(), "forbidden")

    def rule(pos: Column, line: Column, state_: Column) -> Column:
        plain = F.when(line.rlike(EQUALS), F.regexp_extract(line, EQUALS, 2)).otherwise(line)
        value = F.regexp_replace(F.regexp_replace(F.trim(plain), "^['\"]+|['\"]+$", ""), r"\.+$", "")
        return F.struct(pos.alias("pos"), F.when(line.rlike(EQUALS), dotted(F.regexp_extract(line, EQUALS, 1))).alias("selector"), value.alias("value"), state_.alias("state"))

    # each line under the last heading before it
    start = F.struct(F.lit(None).cast("string").alias("state"), F.array().cast("array<struct<pos:int,line:string,state:string>>").alias("under"))
    step = lambda acc, x: F.struct(F.coalesce(x.heading, acc.state).alias("state"), F.when(x.heading.isNotNull(), acc.under).otherwise(F.concat(acc.under, F.array(F.struct(x.pos, x.line, acc.state)))).alias("under"))
    headed = F.transform(lines, lambda x: F.struct(x.pos.alias("pos"), x.line.alias("line"), meant(x.line).alias("heading")))
    rules = F.sort_array(F.transform(F.aggregate(headed, start, step)["under"], lambda x: rule(x.pos, x.line, x.state)))
    # as the one row of a generator, so that the conditions below don't compute the rules anew
    ruled = one.select("endpoint", "ps", "name", F.explode(F.array(rules)).alias("rules"))
    fault = F.exists("rules", lambda r: r.state.isNull() | (r.value == "") | (r.selector.isNull() & ~r.value.rlike(TOKEN)))
    both = F.exists("rules", lambda r: r.state == "required") & F.exists("rules", lambda r: r.state != "required")
    named = F.array_distinct(F.transform(F.filter("rules", lambda r: r.selector.isNotNull()), lambda r: r.selector))
    bare = F.array_distinct(F.transform(F.filter("rules", lambda r: r.selector.isNull()), lambda r: r.value))
    sound = ruled.filter(~fault & both).withColumn("named", named).withColumn("bare", bare).filter("size(bare) = 0 OR size(named) < 2")
    whole = lambda v: F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), v, F.lit(r"\E(?![A-Za-z0-9_])"))
    listing = lambda p: (p.evidence != "") & (p["name"] != F.col("name")) & F.forall("bare", lambda v: F.regexp_like(p.evidence, whole(v)))
    owners = F.array_distinct(F.transform(F.filter("ps", listing), lambda p: p["name"]))
    owned = sound.withColumn("owners", F.when((F.size("bare") > 0) & (F.size("named") == 0), owners))
    owner = F.coalesce(F.when(F.size("owners") == 1, F.get("owners", F.lit(0))), F.get("named", F.lit(0)))
    meets = F.forall("rules", lambda r: F.coalesce(F.exists("ps", lambda p: p["name"] == F.coalesce(r.selector, F.col("owner"))), F.lit(False)))
    flat = owned.withColumn("owner", owner).filter(meets).select("endpoint", "name", F.posexplode("rules").alias("ord", "r"), "owner")
    return flat.select(
        "endpoint", "name", (F.col("ord") + 1).alias("ord"), F.coalesce("r.selector", "owner").alias("selector"), F.col("r.value").alias("value"),
        F.col("r.state").alias("state"), F.lit(HUMAN_ERROR).alias("error"), F.col("r.selector").isNull().alias("inferred"))
