"""Overlays, topology, profiles, canonical JSON, best candidates and expanded parameters on small hard rows."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from docwright.functions import canonical, fields
from docwright.operators import endpoints, expansion, knowledge, overlays, profiles, topics, topology

CASE = "case_key string, place int, section string, module string, scenario string, steps array<struct<step:string,expected:string>>, markers array<string>"
ONE, TWO = [("Call bet", "200")], [("call  BET", "200")]


def laid(spark, base, human, manifest=None):
    frame = lambda rows: spark.createDataFrame(rows, CASE)
    known = None if manifest is None else spark.createDataFrame([(m,) for m in manifest], "case_key string")
    got = overlays.overlay_cases(frame(base), frame(human), known)
    return {(r.case_key, r.place): r for r in got.collect()}


def test_overlay_fields_and_sections(spark):
    base = [
        ("a", 1, "S", "m", "Bet", ONE, ["p1"]), ("b", 2, "S", "m", "Bet", ONE, None), ("c", 3, "API parameter test", "m", "Bet", ONE, []), ("d", 4, "S", "m", "Bet", [], None), ("e", 5, None, None, None, None, None),
    ]
    human = [
        ("a", 1, "S", "m", " Bet ", TWO, [" p1", "p1", ""]), ("b", 2, "S", "m", "Other", [], ["x"]), ("c", 3, "S", "m", "", [("new", "")], []), ("d", 4, "S", "m", "Bet", ONE, None), ("e", 5, None, None, None, [(None, None)], None),
    ]
    got = laid(spark, base, human)
    assert got["a", 1].status == "same" and got["a", 1].steps == [tuple(ONE[0])]
    assert (got["b", 2].overrides, got["b", 2].scenario, got["b", 2].warning, len(got["b", 2].steps)) == (["markers", "scenario"], "Other", "human_steps_empty", 1)
    assert got["c", 3].status == "same"  # steps of parameter cases stay, an empty scenario says nothing
    assert got["d", 4].overrides == ["steps"] and got["e", 5].overrides == ["steps"]


def test_overlay_deletes_by_manifest_alone(spark):
    base = [(k, i, "S", "m", "x", ONE, None) for i, k in enumerate(["had", "fresh", None])]
    assert {k[0]: r.status for k, r in laid(spark, base, []).items()} == {"had": "base_only", "fresh": "base_only", None: "base_only"}
    got = laid(spark, base, [("own", 9, "S", "m", "y", ONE, None), (None, 10, "S", "m", "z", ONE, None)], ["had", "own", None])
    assert {k[0]: r.status for k, r in got.items() if k[1] < 9} == {"had": "deleted", "fresh": "new", None: "new"}
    assert got["own", 9].status == got[None, 10].status == "added"


def test_doubled_human_keys(spark):
    human = [("k", 3, "", "M o", "用例： Bet", ONE, None), ("k", 1, "Sec A", "m", "bet", ONE, None), ("k", 2, "Sec A", "m", 'Oth"er', [("s\n", "e")], None), ("k", 4, "", "", "New", [], None)]
    got = laid(spark, [("k", 0, "S", "m", "Bet", ONE, None)], human)
    assert got["k", 0].scenario == "bet" and got["k", 3].status == "duplicate"
    seed = "|".join(["k", "sec_a", 'Oth"er', json.dumps([{"step": "s\n", "expected": "e"}], ensure_ascii=False, sort_keys=True)])
    key = "human::sec_a::" + hashlib.sha1(seed.encode()).hexdigest()[:8]
    assert got[key, 2].status == "added" and got[key, 2].original_key == "k"
    assert [k for k in got if k[1] == 4][0][0].startswith("human::human_added::")


def test_overlay_of_empty_sides(spark):
    assert laid(spark, [], []) == {}
    (only,) = laid(spark, [], [("a", 1, "S", "m", "x", None, [" m "])]).values()
    assert only.status == "added" and only.markers == ["m"] and only.steps == []


def test_canonical_json_is_pythons(spark):
    ddl = "z string, a struct<y:int,b:array<map<string,boolean>>>, m map<string,array<string>>, n bigint, e array<string>"
    rows = [('q"\\\n\t\x01\x1f é😀/', (1, [{"k": True, "a\n": None}, None, {}]), {"b": ["x", None], "a": None}, -5, []), (None, None, None, None, None), ("", (None, None), {}, 2**62, [None])]
    df = spark.createDataFrame(rows, ddl)
    got = df.select(canonical.json_text(F.struct(*df.columns), df.schema).alias("j"), canonical.content_hash(df, ["z", "missing", "e"]).alias("h")).collect()
    for r, (z, a, m, n, e) in zip(got, rows, strict=True):
        want = {"z": z, "a": None if a is None else {"y": a[0], "b": a[1]}, "m": m, "n": n, "e": e}
        assert r.j == json.dumps(want, ensure_ascii=False, sort_keys=True)
        assert r.h == hashlib.sha256(json.dumps({"z": z, "missing": None, "e": e}, ensure_ascii=False, sort_keys=True).encode()).hexdigest()
    with pytest.raises(TypeError):
        canonical.json_text(F.col("x"), spark.createDataFrame([], "x double").schema["x"].dataType)


def test_topology_counts_names_and_evidence(spark):
    p = lambda *names: [{"name": n} for n in names]
    rows = [
        ("v", "/b", "bet", "s", [*p(" Type ", "x"), {"name": "q", "description": "the Free-Spin count"}, {"name": None}]), ("v", "/s", "settlement", None, p("isFinished", "JP-Win", "Status", "is_finished")),
        ("v", "/a", "authentication", "Token is required: " + "y" * 200, None), ("w", "/c", "combined_bet_settlement", "", [{"name": "roundId", "description": None}]), ("w", "/b1", "bet", "", None), ("w", "/b2", "bet", "", None), (None, None, None, None, None),
    ]
    errors = [("v", "401", "Unauthorized call"), ("v", None, "must authenticate"), ("v", "5", "fine"), ("w", "1", "invalid TOKEN"), ("only", "1", "invalid token")]
    got = {r.vendor: r for r in topology.analyse(
        spark.createDataFrame(rows, "vendor string, endpoint string, role string, section string, parameters array<map<string,string>>"), spark.createDataFrame(errors, "vendor string, code string, context string")).collect()}
    v, w = got["v"], got["w"]
    assert set(got) == {"v", "w", None}
    assert (v.bet_mode, v.action_parameters, v.free_spin_parameters) == ("one_bet_endpoint_with_action_parameter", ["Type"], ["q"])
    assert v.round_end_parameters == ["isFinished", "is_finished"] and v.jackpot_parameters == ["JP-Win"] and v.settlement_status and v.jackpot_control
    assert v.evidence == ["endpoint:/a:Token is required: " + "y" * 101, "error_code:401:Unauthorized call", "error_code::must authenticate"] and v.authentication_required
    assert (w.bet_mode, w.combined_mode, w.n_settle, w.round_identifier, w.idempotency_key, w.authentication_required) == ("two_bet_endpoint", "combined_endpoint", 1, True, True, False)


def test_field_sets_and_profiles(spark):
    rows = spark.createDataFrame([("a", {"x": "1", "y": ""}), ("a", {"x": "2", "z": "3"}), ("b", {}), ("b", None), (None, {"q": "1"})], "g string, f map<string,string>")
    assert {r.g: r.present for r in profiles.fields_present(rows, ["g"], "f").collect()} == {"a": ["x", "z"], "b": [], None: ["q"]}
    tree = [("f", "r", None, "Root", ["Root"]), *[("f", f"c{i:02}", "r", f"CASE: {i}", ["Root", f"CASE: {i}"]) for i in range(30)], ("f", "l", "c00", "步骤：a：b", ["Root", "x", "y"]), ("f", "n", "c01", "：none", ["Root", "x", "y"]), ("g", "r", None, "Root", ["Root"])]
    got = [tuple(r) for r in profiles.label_profile(spark.createDataFrame(tree, "file string, topic_id string, parent_id string, title string, path array<string>").repartition(3), ["file", "topic_id"], 5).collect()]
    assert set(got) == {("label", "步骤", 1), ("root", "Root", 2), ("depth", "", 3), *[("path", f"Root > CASE: {i}", i + 1) for i in range(5)]}
    assert profiles.label_profile(spark.createDataFrame([], "file string, topic_id string, parent_id string, title string, path array<string>"), ["file"]).collect() == []


def test_best_candidates(spark):
    rows = [
        (1, 1, "GET", "/a", "", 0.9), (1, 2, "get", "/A", "Name", 0.8), (1, 3, "get", "/a", "page 2", 0.85), (1, 4, "get", "/a", "x", 0.8), (1, 5, "POST", "/a", None, 0.1),
        (1, 6, "GET", "/{Partner_base_URL}", "Bet", 0.5), (1, 7, "GET", "/{Partner_base_URL}", "refund", 0.5), (1, 8, "GET", "/{Partner_base_URL}", "odd", 0.5), (1, 9, "GET", "/{partner_base_url}", "other", 0.4), (None, 1, "GET", "/a", "", 0.9),
    ]
    got = endpoints.best_candidates(spark.createDataFrame(rows, "d int, line_no int, method string, endpoint string, api_name string, confidence double"), ["d"])
    assert sorted((r.d or 0, r.line_no) for r in got.collect()) == [(0, 1), (1, 4), (1, 5), (1, 6), (1, 7), (1, 8)]


PARAMETER = "struct<name:string,type:string,required:string,description:string>"


def test_expanded_parameters(spark):
    example = '{"list": [1, {"id": 1, "in": {"x": true}}], "obj": {"id": "s"}, "B": 2}'
    named = lambda *ns: [(n, t, "Y", None) for n, t in ns]
    rows = [
        (1, "/e", named(("z", ""), ("b", "int"), ("id", ""), ("OBJ", None), ("list", " "), ("b", "again"), ("", "x"), (None, "y")), example, None), (2, "/e", named(("a", "")), "no json", None), (3, "/e", None, example, None),
        (4, "/e", named(("own", "")), None, [("op", named(("obj", "")), example), ("none", [], example)]),
    ]
    df = spark.createDataFrame(rows, f"k int, endpoint string, parameters array<{PARAMETER}>, example string, variants array<struct<operation:string,parameters:array<{PARAMETER}>,example:string>>")
    got = expansion.expand(expansion.by_variant(df), ["k", "operation"]).orderBy("k", "place").collect()
    assert [(r.name, r.type) for r in got if r.k == 1] == [("list", "array"), ("list/id", "int"), ("list/in/x", "bool"), ("OBJ", "object"), ("OBJ/id", "string"), ("b", "int"), ("z", "")]
    assert [(r.k, r.operation, r.name) for r in got if r.k > 1] == [(2, "", "a"), (4, "op", "obj"), (4, "op", "obj/id")]
    assert [p["name"] for p in spark.range(1).select(expansion.path_parameters(F.lit("/a/{id}/{ x }/{id}/{}")).alias("p")).first().p] == ["id", "x"]


def test_deep_trees_and_ids_that_go_round(spark):
    chain = [("t0", None, "0", 1), *[(f"t{i}", f"t{i - 1}", str(i), 1) for i in range(1, 90)], ("t5", "t9", "again", 2), ("loop", "loop", "self", 1)]
    got = topics.flatten(spark.createDataFrame(chain, "topic_id string, parent_id string, title string, ord long")).collect()
    assert len(got) == 90 and max(r.depth for r in got) == 89


def test_boundaries_of_any_scale(spark):
    got = spark.createDataFrame([(2,), (40,)], "n int").select(fields.boundary_values(F.col("n")).alias("b")).collect()
    assert [(len(r.b.valid), len(r.b.invalid)) for r in got] == [(6, 7), (44, 45)] and got[0].b.valid == "100.12"


RECORD = "file string, sheet string, topic_id string, name string, case_id string, preconditions string, module_title string, module_path string, path array<string>, steps array<struct<step:string,expected:string>>, remarks string, priority string"


def test_knowledge_of_records(spark):
    rows = [
        ("f", "s", "1", " A ", "", "GET /api/x<b", None, "R > M ", ["Root", "R", "A"], [("Check  it\n\n\n\nnow", "ok"), ("", "SQL row"), (None, None), ("Check  it\n\n\n\nnow", "SQL row")], "timeout", "P1"),
        ("f", None, "2", "B", "OWN", None, " Title ", None, None, None, None, None), (*[None] * 12,), ("f", "s", "3", "C", "TC_0004", "", "", " > ", ["", "x"], [("plain", "")], "", ""),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"n int, {RECORD}").repartition(3)
    a, b, none, c = knowledge.knowledge_cases(df, ["n"]).orderBy("n").collect()
    assert (a.id, a.generated_id, a.api_name, a.module, a.scenario, a.level, a.parent_topic) == ("TC_0001", None, "/api/x", "M", "A", 3, "R")
    assert a.steps == ["Check  it\n\nnow"] * 2 and a.expected_results == ["ok", "SQL row", "SQL row"] and a.validation_points == ["Check  it\n\nnow"] and a.db_checks == ["SQL row"]
    assert a.tags == ["api_check", "db_check", "positive", "timeout"]
    assert (b.id, b.generated_id, b.module, b.api_name, b.steps, b.level, b.tags) == ("OWN", "TC_0002", "Title", "Title", None, 0, ["unclassified"])
    assert (none.id, none.module, c.id, c.generated_id, c.module, c.validation_points) == ("TC_0003", "unclassified", "TC_0004", None, "unclassified", None)
    payload = {k: getattr(a, k) for k in canonical.CASE_FIELDS} | {"source": {"xmind_file": "f", "sheet": "s", "topic_id": "1"}}
    assert a.content_hash == hashlib.sha256(json.dumps(payload, ensure_ascii=False, sort_keys=True).encode()).hexdigest()
    assert knowledge.knowledge_cases(spark.createDataFrame([], f"n int, {RECORD}"), ["n"]).collect() == []


def test_case_records_of_small_trees(spark):
    t = [
        ("c", None, "Case: A", 1, ["Root", "M", "Case: A"], ["l"]), ("a", "c", "ID：i", 1, [], None), ("b", "c", "merge_key: ", 2, [], None), ("d", "c", "标签：x", 3, [], None), ("d2", "c", "标签：y", 4, [], None), ("s", "c", "步骤描述", 5, [], None),
        ("s2", "s", "步骤：two", 2, [], None), ("s1", "s", "one: first", 1, [], None), ("e", "s2", "预期结果：ok", 2, [], None), ("e0", "s2", "raw", 1, [], None), ("e1", "s2", "", 3, [], None), ("z", None, "用例：B", 1, ["用例：B"], None),
    ]
    df = spark.createDataFrame([(f, *r) for f in ("f", "g") for r in t], "file string, topic_id string, parent_id string, title string, ord long, path array<string>, labels array<string>")
    got = sorted(topics.case_records(df, ["file"]).collect(), key=lambda r: (r.file, r.topic_id))
    assert [(r.file, r.name, r.case_id, r.module_path, r.labels) for r in got] == [(f, *x) for f in ("f", "g") for x in (("A", "i", "M", ["l", "y"]), ("B", "", "", []))]
    assert [(s["index"], s.step, s.expected) for s in got[0].steps] == [(1, "first", ""), (2, "two", "raw\nok")] and got[1].steps == []


def test_flatten_keeps_each_topics_own_columns(spark):
    """An id under two parents is two rows with their own parents and paths; the level below a few topics is joined without a shuffle of the many."""
    rows = [("r", None, "Root", 0), ("a", "r", "A", 1), ("b", "r", "B", 2), ("x", "a", "X", 1), ("x", "b", "X", 2)]
    found = topics.flatten(spark.createDataFrame(rows, "topic_id string, parent_id string, title string, ord long"), ["parent_id"])
    got = sorted((r.topic_id, r.parent_id or "", r.depth, tuple(r.path)) for r in found.collect())
    assert got == [("a", "r", 1, ("Root", "A")), ("b", "r", 1, ("Root", "B")), ("r", "", 0, ("Root",)), ("x", "a", 2, ("Root", "A", "X")), ("x", "b", 2, ("Root", "B", "X"))]


def test_human_rules_meet_once_an_endpoint(spark):
    """One exchange, by endpoint, and no sort or window over parameters or their lines."""
    from docwright.operators import dependencies

    rows = [("e", "mode", "Y", "One of: A, B", None), ("e", "x/y", "Y/N", None, "Required when:\nA\nOptional when:\nmode = B."), ("f", "x", "Y/N", None, "Required when:\nA")]
    given = spark.createDataFrame(rows, "endpoint string, name string, required string, description string, remark string")
    found = dependencies.human_rules(given, spark.createDataFrame([("BAD_REQUEST",)], "code string"))
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan and plan.count("REPARTITION") <= 1
    got = sorted(tuple(r) for r in found.collect())
    assert got == [("e", "x.y", 1, "mode", "A", "required", "BAD_REQUEST", True), ("e", "x.y", 2, "mode", "B", "optional", "BAD_REQUEST", False)]
