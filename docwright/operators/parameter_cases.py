"""Cases of request parameters: each parameter's kind chooses step templates, which are data.

A parameter is one row; its kind is decided in a fixed order (path, array, object, hash, amount, scalar)
and its steps come from one array of literal templates, so no row meets a table of steps. In the
templates ``{n}`` is the name, ``{v}`` the value of the example, ``{s}`` that value as bare text,
``{d}`` and ``{e}`` the allowed decimals and one more, ``{p}`` and ``{q}`` amounts with so many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Decimals of an amount where no document names them.
DECIMALS = 8
#: Wording of results.
FAILED, PASSED = "The API returns a {l} error with error code {c}.", "The API returns successful response."
#: Kind, whether the parameter must be optional (None: either), further condition, title,
#: request line, and result ("error", "ok" or, for required parameters alone, "error" as "need").
STEPS = [
    ("path", None, None, "{n} input wrong value", "Correct url: {u}\nTest url: {w}", "error"),
    *[("array", None, None, "{n} " + t, line, "need") for t, line in (
        ("doesn't set", '// "{n}": [ valid {n} parameters ]'), ("leave blank array", '"{n}": []'), ("input null", '"{n}": null'),
        ("input wrong data type", '"{n}": "test"'), ("input object instead of array", '"{n}": { valid {n} parameters }'),
        ("input empty object item", '"{n}": [\n  {}\n]'),
        ("input item with missing required field", '"{n}": [\n  { valid {n} parameters {m} }\n]'),
    )],
    ("object", None, None, "{n} doesn't set", '// "{n}": {v}', "need"),
    *[("object", None, None, "{n} " + t, line, "error") for t, line in (
        ("input null", '"{n}": null'), ("input empty object", '"{n}": {}'), ("input array instead of object", '"{n}": []'),
        ("input string instead of object", '"{n}": "test"'), ("input number instead of object", '"{n}": 123'),
    )],
    *[("hash", False, None, "{n} " + t, line, "error") for t, line in (
        ("doesn't set", '// "{n}": {v}'), ("leave blank", '"{n}": ""'), ("input space", '"{n}": " {s} "'), ("input int", '"{n}": 123'),
    )],
    ("amount", False, None, "{n} doesn't set", '// "{n}": {v}', "error"),
    ("amount", True, None, "{n} doesn't set", '"{f}": 0', "ok"),
    ("amount", None, None, "{n} Input blank", '"{n}": ""', "need"),
    ("amount", None, None, "{n} Input exceed 20 digit numbers", '"{n}": {g}123456789012345678901{g}', "need"),
    ("amount", None, None, "{n} Input {d} decimal numbers", '"{n}": {g}{p}{g}', "ok"),
    ("amount", None, None, "{n} Input {e} decimal numbers", '"{n}": {g}{q}{g}', "error"),
    ("amount", None, None, "{n} Input negative number", '"{n}": {g}-100.0{g}', "funds"),
    ("amount", None, None, "{n} Input space", '"{n}": " {s} "', "need"),
    ("amount", None, None, "{n} Input string", '"{n}": "test"', "need"),
    ("amount", None, "rollback", "{n} Input lower than bet_amount", '"{n}": 1', "ok"),
    ("scalar", None, None, "{n} doesn't set", '// "{n}": {v}', "need"),
    ("scalar", None, None, "{n} leave blank", '"{n}": ""', "need"),
    ("scalar", None, None, "{n} input space", '"{n}": " {s} "', "user"),
    ("scalar", False, "currency", "{n} Input invalid currency", '"{n}": "TWD"', "currency"),
    ("scalar", None, "typed", "{n} input {t}", '"{n}": {x}', "need"),
    ("scalar", False, "timestamp", "{n} Input shorter timestamp", '"{n}": 1722345', "error"),
    *[("scalar", False, "piped", "{n} amount " + t, '"{n}": "' + value + '|{k}"', "error") for t, value in (
        ("doesn't set", ""), ("input string", "abc"), ("input negative number", "-1"), ("Input exceed 20 digit numbers", "123456789012345678901"),
        ("Input {d} decimal numbers", "{p}"), ("Input {e} decimal numbers", "{q}"),
    )],
    ("scalar", False, "action", "{n} input uppercase", '"{n}": "{a}"', "error"),
]
#: Names of parameters that hold an action.
ACTIONS = ["action", "method", "operation", "command", "type", "requesttype", "transactiontype", "subtype"]
DECIMAL_PATTERNS = [
    r"(?:must\s+always\s+have|always\s+have|has|with|up\s+to|maximum(?:\s+of)?|max(?:imum)?)\s+(\d+)\s+(?:digits?\s+after\s+(?:the\s+)?decimal|decimal\s+places?)",
    r"(\d+)\s+(?:digits?\s+after\s+(?:the\s+)?decimal|decimal\s+places?)", r"(?:scale|precision)\s*[:=]?\s*(\d+)",
]


def kind_of(name: Column, given: Column, source: Column) -> Column:
    leaf = F.regexp_replace(F.lower(F.element_at(F.split(name, "/", -1), -1)), "[^a-z0-9]", "")
    return (
        F.when(source == "path_parameter", "path").when(given.rlike("array|list"), "array").when(given.rlike("object|dict|map"), "object")
        .when(F.lower(name).isin("hmac", "hash"), "hash").when(leaf.contains("amount"), "amount").otherwise("scalar")
    )


def decimals_of(text: Column, default: int = DECIMALS) -> Column:
    """Decimals that a description allows, by the first pattern that is met in it."""
    low = F.regexp_replace(F.lower(text), r"\s+", " ")
    return F.coalesce(*[F.nullif(F.regexp_extract(low, p, 1), F.lit("")).cast("int") for p in DECIMAL_PATTERNS], F.lit(default))


def boundary(places: Column) -> Column:
    """100 with so many decimals, 1 to 9 again and again."""
    return F.concat(F.lit("100."), F.substring(F.repeat(F.lit("123456789"), 8), F.lit(1), places))


def parameter_steps(parameters: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, kind, place, step and expected: the steps of each parameter's case.

    ``parameters`` has endpoint, role, name, type, required, description, remark, source, value (JSON of the
    example's value), missing (a required field of an array's item), children (names of required fields of an object),
    code and response of the documented error, ``codes`` (map of other errors: funds, currency, user) and success.
    Nulls count as empty; a row without a code has no error steps.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    low = lambda c: F.lower(text(c))
    name, given = text("name"), low("type")
    leaf = F.regexp_replace(F.lower(F.element_at(F.split(name, "/", -1), -1)), "[^a-z0-9]", "")
    about = F.lower(F.concat_ws(" ", "name", "description", "remark"))
    string, number = given.rlike("string|uuid"), given.rlike("int|long|float|decimal|number|double") | given.contains("bool")
    stamp = low("name").contains("timestamp") | (low("name") == "time") | low("description").rlike("unix time|timestamp")
    bare = F.coalesce(F.nullif(F.regexp_extract(text("value"), '^"(.*)"$', 1), F.lit("")), text("value"))
    plain = F.regexp_replace(low("name"), "[^a-z0-9]", "")
    wanted = F.upper(F.btrim(text("required")))
    places = decimals_of(F.concat_ws(" ", "name", "type", "description", "remark"))
    pipe = F.split(bare, r"\|", 2)
    path_value = F.concat(F.lit("<valid "), name, F.lit(">"))
    braces = F.concat(F.lit("{"), name, F.lit("}"))
    row = parameters.select(
        *keep, kind_of(name, given, text("source")).alias("kind"),
        (wanted.isin("N", "NO", "FALSE", "0", "OPTIONAL") | wanted.startswith("N ")).alias("_optional"),
        F.struct(
            (low("role").rlike("rollback|cancel_bet") | low("endpoint").rlike("rollback|refund|cancel")).alias("rollback"), (leaf == "currency").alias("currency"),
            stamp.alias("timestamp"), (about.contains("transactionid") & about.contains("amount") & about.contains("|")).alias("piped"),
            (plain.isin(ACTIONS) | (plain.isin("type", "subtype") & low("description").rlike("action|operation|command"))).alias("action"),
        ).alias("_is"),
        F.create_map(
            F.lit("{n}"), name, F.lit("{f}"), F.element_at(F.split(name, "/", -1), -1), F.lit("{v}"), text("value"), F.lit("{s}"), bare,
            F.lit("{t}"), F.when(string, "int").when(number, "string").otherwise("wrong data type"), F.lit("{x}"), F.when(~string & number, '"test"').otherwise("123"),
            F.lit("{d}"), places.cast("string"), F.lit("{e}"), (places + 1).cast("string"), F.lit("{p}"), boundary(places), F.lit("{q}"), boundary(places + 1),
            F.lit("{g}"), F.when(string, '"').otherwise(""), F.lit("{u}"), F.replace(text("endpoint"), braces, path_value),
            F.lit("{w}"), F.replace(text("endpoint"), braces, F.concat(F.lit("invalid-"), path_value)),
            F.lit("{m}"), F.concat(F.when(text("missing") == "", "with ").otherwise("without "), F.when(text("missing") == "", "missing required field").otherwise(text("missing"))),
            F.lit("{k}"), F.coalesce(F.nullif(F.get(pipe, F.lit(1)), F.lit("")), F.concat(F.lit("<confirm "), name, F.lit(">"))),
            F.lit("{a}"), F.when(F.upper(bare) == "", F.upper(plain)).otherwise(F.upper(bare)),
        ).alias("_words"),
        F.when(F.lower(name).isin("hmac", "hash"), "encryption/signature validation").otherwise("parameter validation").alias("_label"),
        text("code").alias("_code"), text("response").alias("_response"), text("success").alias("_success"), F.col("codes").alias("_codes"),
        leaf.alias("_leaf"), F.coalesce("children", F.array().cast("array<string>")).alias("_children"),
    )
    fitting = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.lit(o).cast("boolean").alias("optional"), F.lit(c).cast("string").alias("only"), F.lit(t).alias("title"), F.lit(line).alias("line"), F.lit(r).alias("result"))
        for k, o, c, t, line, r in STEPS
    ])
    holds = lambda only: (
        F.when(only.isNull(), True).when(only == "typed", F.col("_optional") | ~F.col("_is.currency"))
        .when(only == "timestamp", F.col("_is.timestamp") & ~F.col("_is.currency")).when(only == "rollback", F.col("_is.rollback"))
        .when(only == "currency", F.col("_is.currency")).when(only == "piped", F.col("_is.piped")).otherwise(F.col("_is.action"))
    )
    # A hash that is optional has the steps of an optional scalar.
    kind = F.when((F.col("kind") == "hash") & F.col("_optional"), "scalar").otherwise(F.col("kind"))
    mine = F.filter(fitting, lambda s: (s.kind == kind) & (s.optional.isNull() | (s.optional == F.col("_optional"))) & holds(s.only))
    child = F.transform(
        F.when(F.col("kind") == "object", F.col("_children")).otherwise(F.array().cast("array<string>")),
        lambda c: F.struct(F.lit("object").alias("kind"), F.lit(None).cast("boolean").alias("optional"), F.lit(None).cast("string").alias("only"),
                           F.concat(F.lit("{n} object missing required field "), c).alias("title"), F.concat(F.lit('"{n}": { without '), c, F.lit(" }")).alias("line"), F.lit("error").alias("result")),
    )
    rows = row.select("*", F.posexplode(F.concat(mine, child)).alias("place", "_step"))
    step = F.concat(F.col("_step.title"), F.lit("\n"), F.col("_step.line"))
    for mark in ("{n}", "{f}", "{v}", "{s}", "{t}", "{x}", "{d}", "{e}", "{p}", "{q}", "{g}", "{u}", "{w}", "{m}", "{k}", "{a}"):
        step = F.replace(step, F.lit(mark), F.element_at("_words", F.lit(mark)))
    result = F.col("_step.result")
    passes = (result == "ok") | (F.col("_optional") & result.isin("need", "user"))
    other = F.when((result == "user") & (F.col("_leaf") != "userid"), F.lit(None)).otherwise(F.element_at("_codes", result))
    code = F.coalesce(other, F.col("_code"))
    failed = F.replace(F.replace(F.lit(FAILED), F.lit("{l}"), F.col("_label")), F.lit("{c}"), code)
    expected = F.when(passes, F.concat(F.lit(PASSED + "\n"), F.col("_success"))).otherwise(
        F.concat(failed, F.when(F.col("_response").isin("", "{}"), "").otherwise(F.concat(F.lit("\n"), F.col("_response"))))
    )
    return rows.filter(passes | (code != "")).select(*keep, "kind", "place", step.alias("step"), expected.alias("expected"))
