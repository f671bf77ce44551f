"""Operators of cases, pages and baselines on hand-made rows."""

import json

from docwright.operators import baselines, drafts, pages, routing, validation
from docwright.sources import sinks


def test_fragments_are_found_in_free_text():
    assert pages.fragments_of('a {"x": 1} b {bad {"y": [{"z": 2}]} {"open": ') == ['{"x": 1}', '{"y": [{"z": 2}]}']
    assert pages.fragments_of(None) == pages.fragments_of("") == []
    deep = '{"a":' * 3000 + "1" + "}" * 3000
    assert all(json.loads(x) for x in pages.fragments_of(deep + ' {"b": 2}')[-1:])


def test_markdown_of_a_page():
    page = """<html><head><title>T</title></head><body><nav>menu</nav><main><h2>Head &amp; more</h2><p>One <b>two</b> <a href="/x">three</a></p>
      <ul><li>first</li><li>second</li></ul><table><tr><th>a</th><th>b</th></tr><tr><td> 1 </td><td>2</td></tr></table><pre><code>x = 1
y</code></pre><p>use <code>f</code></p></main></body></html>"""
    got = pages.markdown_of(page, "http://e.org/1")
    assert got.startswith("# Source URL\n\nhttp://e.org/1\n\n## Head & more\n")
    for part in ("One two[three](/x)", "- first\n- second", "| a | b |\n| 1 | 2 |", "```text\nx = 1\ny\n```", "use `f`"):
        assert part in got, part
    assert "menu" not in got and pages.markdown_of(None, None) == "\n"


def test_inventory_accounts_for_every_case(spark):
    rows = [(0, None, None, None, None), (1, "", "Launch Game", "x", ""), (2, "inventory", "?", "a > Special test cases", "t"), (3, "inventory", "rollback", "", "")]
    df = spark.createDataFrame(rows, "id int, category string, module string, path string, title string")
    routed = {r.id: (r.rule_id, r.status) for r in routing.route(df, ["id"]).collect()}
    assert routed == {0: ("unmapped.no_rule", "unmapped"), 1: ("direct.launch_game", "mapped"), 2: ("excluded.special_test_cases", "excluded"), 3: ("fallback.rollback_config", "mapped")}
    assert sum(r.n for r in routing.inventory(routing.route(df, ["id"])).collect()) == 4


def test_root_of_a_draft(spark):
    fields = ["schema_version", "vendor", "capability_profile", "endpoint_roles", "generation_mapping", "test_cases"]
    full = {c: s for s, names in validation.CATEGORIES.items() for c in names}
    rows = [("good", fields, "v1", full, 3, 3, "m1"), ("bad", fields[1:], "v0", {**full, "bet": "elsewhere"}, 3, 2, "m0"), ("bare", fields, "v1", None, None, None, None)]
    df = spark.createDataFrame(rows, "id string, fields array<string>, schema_version string, mapping map<string,string>, total int, accounted int, contract_version string")
    got = [(r.id, r.severity, r.rule) for r in validation.root_issues(df, "id", "v1", "m1").collect()]
    assert sorted(x for x in got if x[0] == "bad") == [("bad", "error", "accounted"), ("bad", "error", "required"), ("bad", "error", "section"), ("bad", "error", "version"), ("bad", "error", "version")]
    assert not [x for x in got if x[0] == "good"]
    assert {x[1:] for x in got if x[0] == "bare"} == {("warning", "recommended")}


def test_coverage_by_path_or_leaf(spark):
    frame = lambda rows, *more: spark.createDataFrame(rows, ", ".join(["endpoint string, parameter string", *more]))
    wanted = frame([("e", "a/b"), ("e", "c"), ("e", "d/C"), ("f", "c")])
    left = baselines.uncovered(wanted, frame([("e", "C")]), frame([("f", "c", " "), ("e", "A/B", "why")], "reason string"), "endpoint", "parameter", "reason")
    assert [tuple(r) for r in left.collect()] == [("f", "c")]


def test_summary_and_reports(spark, tmp_path):
    held = {r.name: r["values"] for r in drafts.summary(spark).collect()}
    assert held["required_test_case_fields"] == validation.REQUIRED and len(held["mapping_rule_ids"]) == 22
    rows = spark.createDataFrame([("v", 1, None), ("w", 2, "x")], "vendor string, n int, note string")
    sinks.write_reports({"errors": rows, "codes": rows.limit(1)}, "vendor", str(tmp_path))
    back = spark.read.json(str(tmp_path / "errors"))
    assert sorted((r.vendor, r.n, r.note) for r in back.collect()) == [("v", 1, None), ("w", 2, "x")]


def test_parameters_of_one_file_are_dealt_over_the_cores(spark):
    from docwright.extraction_queries import QUERIES

    plan = QUERIES["c10_parameter_cases"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert f"RoundRobinPartitioning({4 * spark.sparkContext.defaultParallelism})" in plan
