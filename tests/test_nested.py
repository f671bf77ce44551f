"""Nested JSON values and human dependency blocks on hand-made rows."""

from pyspark.sql import functions as F

from docwright.functions import nested
from docwright.operators import dependencies


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()[0]


def test_values_by_folded_names(spark):
    find = lambda text, name: one(spark, nested.find_value(F.lit(text), F.lit(name)))
    assert find('{"a": {"game_Session-ID": 7}}', "gameSessionID") == "7"
    assert find('{"Id": 1, "id": 2}', "id") == "2"
    assert find('[{"x": null}, {"x": "é"}]', "X") == '"é"'
    assert find('{"d": [1, {"id": 3}, {"id": 4}]}', "D/ID") == "3"
    assert find('{"d": 1}', "d/id") is None and find("{bad", "d") is None and find(None, "d") is None and find('{"d": 1}', "") is None


def test_written_and_removed_values(spark):
    put = lambda text, path, value: one(spark, nested.set_value(F.lit(text), F.lit(path), F.lit(value)))
    assert put('{"a": 1}', "a.b", "[2]") == '{"a": {"b": [2]}}'
    assert put(None, "a/b", "plain") == '{"a": {"b": "plain"}}'
    assert put("[1]", "", "1") == "{}"
    gone = lambda text, path: one(spark, nested.remove_value(F.lit(text), F.lit(path)))
    assert gone('{"a": {"b": 1, "c": 2}}', "a.b") == '{"a": {"c": 2}}'
    assert gone('{"a": [1]}', "a.b") == '{"a": [1]}' and gone(None, "a") is None


def test_no_children_of_plain_values(spark):
    assert one(spark, nested.children(F.lit('{"a": 1}'), F.lit("a"))) == []


def test_human_blocks(spark):
    schema = "endpoint string, name string, required string, description string, remark string, state string"
    both = "Required when:\nBET\nOptional when:\nWIN"
    rows = [
        ("e1", "kind", "Y", "allowed values: BET, WIN", None, None), ("e1", "x", "y/n ", None, both, None), ("e1", "other", "N", "BET or WIN", "", None),
        ("e2", "kind", "Y", "one of BET, WIN", None, None), ("e2", "kind2", "Y", "one of BET, WIN", None, None), ("e2", "x", "Y/N", None, both, None),
        ("e3", "kind", "Y", None, None, None), ("e3", "x", "Y/N", None, "Required when:\nkind = 'BET'\nWIN\nForbidden when:\nkind = LOSE.", None),
        ("e4", "x", "Y/N", None, None, None), ("e5", "kind", "Y", None, None, None), ("e5", "x", "Y/N", None, "Dependency: when kind present => Y; error=E", None),
    ]
    made = spark.createDataFrame(rows, schema)
    errors = spark.createDataFrame([("BAD_REQUEST",), ("BAD_REQUEST",), (None,)], "code string")
    got = dependencies.human_rules(made, errors).orderBy("endpoint", "ord").collect()
    assert [(r.endpoint, r.ord, r.selector, r.value, r.state, r.inferred) for r in got] == [
        ("e1", 1, "kind", "BET", "required", True), ("e1", 2, "kind", "WIN", "optional", True),
        ("e3", 1, "kind", "BET", "required", False), ("e3", 2, "kind", "WIN", "required", True), ("e3", 3, "kind", "LOSE", "forbidden", False)]
    assert dependencies.human_rules(made, errors.filter("code IS NULL")).count() == 0
