"""Registered queries of routing, parameter cases, validation, baselines, pages and fragments, with their SQL.

The tables hold no test cases, so each part stands for one, with texts chosen by its key.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docwright.operators import baselines, drafts, pages, parameter_cases, routing, validation
from docwright.operators.generation import NEGATIVE
from docwright.oracles import ORACLES
from docwright.plans.spread import spread
from docwright.queries import query

CATEGORIES = ["inventory", "launch_game", "balance", "authenticate", "rollback_bet", "freespin", "cancel_settlement_adjustment", "modify_settlement_adjustment", "authentication_is_necessary", "rollback", "jackpot"]
MODULES = ["Bet and Settle", " Cancel  Bet ", "Slot Game", "Launch Game", "Video bingo", "authenticate", "rollback"]
PATHS = [
    "Mandatory > Cancel Bet > Cancel config", "Game category > x", "A > Special accounts", "A > Player /  Game status", "A > main flow", "A > Bet config", "A > settle config",
    "A > BetAndSettle config", "A > Adjustment config", "B > Special test cases > Special accounts", "Authenticate > Authentication is necessary > y", "Plain", "Plain > more",
]
TITLES = ["Check timeout  player", "when game status is abnornal", "nothing of note", "Result0 USER sees 0"]


def one_of(values: list[str], key: str = "p_partkey") -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values)).cast("int"))


def listed(values: list[str], key: str = "p_partkey") -> str:
    return f"([{', '.join(chr(39) + v + chr(39) for v in values)}])[{key} % {len(values)} + 1]"


def behavior_cases(t):
    return t("part").select("p_partkey", one_of(CATEGORIES).alias("category"), one_of(MODULES).alias("module"), one_of(PATHS).alias("path"), one_of(TITLES).alias("title"))


@query
def c02_behavior_routes(t, spark):
    return routing.route(behavior_cases(t), ["p_partkey"])


@query
def c02_inventory(t, spark):
    return routing.inventory(routing.route(behavior_cases(t), ["p_partkey"]))


#: Case of a parameter by key: endpoint, role, name, type, required, description, source, value, children, and other codes.
PARAMETERS = [
    ("/x/{id}", "bet", "id", "string", "Y", "", "path_parameter", '"7"', "", ""), ("/x", "bet", "items", "array", "Y", "", "", "", "", ""), ("/x", "bet", "detail", "object", "N", "", "", '{"a":1}', "a", ""),
    ("/x", "bet", "hash", "string", "Y", "", "", '"ab"', "", ""), ("/x/refund", "bet", "amount", "decimal", "Y", "Maximum 3 decimal places", "", "100.0", "", "402"), ("/x", "bet", "a/winAmount", "string", "N", "scale: 2", "", '"5"', "", ""),
    ("/x", "bet", "currency", "string", "Y", "", "", '"EUR"', "", ""), ("/x", "bet", "userId", "string", "Y", "", "", '"u1"', "", "309"), ("/x", "bet", "sentTime", "long", "Y", "unix time", "", "17", "", ""),
]
#: Places, steps and results of the parameters above: parameter, title, line, and the code ("" for success).
EXPECTED_STEPS = [
    (0, "id input wrong value", "Correct url: /x/<valid id>\nTest url: /x/invalid-<valid id>", "E"),
    (1, "items doesn't set", '// "items": [ valid items parameters ]', "E"), (1, "items leave blank array", '"items": []', "E"), (1, "items input null", '"items": null', "E"),
    (1, "items input wrong data type", '"items": "test"', "E"), (1, "items input object instead of array", '"items": { valid items parameters }', "E"), (1, "items input empty object item", '"items": [\n  {}\n]', "E"),
    (1, "items input item with missing required field", '"items": [\n  { valid items parameters with missing required field }\n]', "E"),
    (2, "detail doesn't set", '// "detail": {"a":1}', ""), (2, "detail input null", '"detail": null', "E"), (2, "detail input empty object", '"detail": {}', "E"), (2, "detail input array instead of object", '"detail": []', "E"),
    (2, "detail input string instead of object", '"detail": "test"', "E"), (2, "detail input number instead of object", '"detail": 123', "E"), (2, "detail object missing required field a", '"detail": { without a }', "E"),
    (3, "hash doesn't set", '// "hash": "ab"', "H"), (3, "hash leave blank", '"hash": ""', "H"), (3, "hash input space", '"hash": " ab "', "H"), (3, "hash input int", '"hash": 123', "H"),
    (4, "amount doesn't set", '// "amount": 100.0', "E"), (4, "amount Input blank", '"amount": ""', "E"), (4, "amount Input exceed 20 digit numbers", '"amount": 123456789012345678901', "E"),
    (4, "amount Input 3 decimal numbers", '"amount": 100.123', ""), (4, "amount Input 4 decimal numbers", '"amount": 100.1234', "E"), (4, "amount Input negative number", '"amount": -100.0', "402"),
    (4, "amount Input space", '"amount": " 100.0 "', "E"), (4, "amount Input string", '"amount": "test"', "E"), (4, "amount Input lower than bet_amount", '"amount": 1', ""),
    (5, "a/winAmount doesn't set", '"winAmount": 0', ""), (5, "a/winAmount Input blank", '"a/winAmount": ""', ""), (5, "a/winAmount Input exceed 20 digit numbers", '"a/winAmount": "123456789012345678901"', ""),
    (5, "a/winAmount Input 2 decimal numbers", '"a/winAmount": "100.12"', ""), (5, "a/winAmount Input 3 decimal numbers", '"a/winAmount": "100.123"', "E"), (5, "a/winAmount Input negative number", '"a/winAmount": "-100.0"', "E"),
    (5, "a/winAmount Input space", '"a/winAmount": " 5 "', ""), (5, "a/winAmount Input string", '"a/winAmount": "test"', ""),
    (6, "currency doesn't set", '// "currency": "EUR"', "E"), (6, "currency leave blank", '"currency": ""', "E"), (6, "currency input space", '"currency": " EUR "', "E"), (6, "currency Input invalid currency", '"currency": "TWD"', "E"),
    (7, "userId doesn't set", '// "userId": "u1"', "E"), (7, "userId leave blank", '"userId": ""', "E"), (7, "userId input space", '"userId": " u1 "', "309"), (7, "userId input int", '"userId": 123', "E"),
    (8, "sentTime doesn't set", '// "sentTime": 17', "E"), (8, "sentTime leave blank", '"sentTime": ""', "E"), (8, "sentTime input space", '"sentTime": " 17 "', "E"), (8, "sentTime input string", '"sentTime": "test"', "E"),
    (8, "sentTime Input shorter timestamp", '"sentTime": 1722345', "E"),
]


@query
def c10_parameter_cases(t, spark):
    names = ["endpoint", "role", "name", "type", "required", "description", "source", "value", "child", "other"]
    parts = spread(t("part").select("p_partkey", "p_size"))
    given = parts.select("p_partkey", *[one_of([p[i] for p in PARAMETERS]).alias(n) for i, n in enumerate(names)], F.concat(F.lit("E"), "p_size").alias("code"), F.lit('{"x":1}').alias("response"), F.lit("{}").alias("success"))
    ready = given.withColumns({
        "remark": F.lit(""), "missing": F.lit(""), "children": F.when(F.col("child") != "", F.array("child")).otherwise(F.array().cast("array<string>")),
        "codes": F.create_map(F.lit("funds"), F.nullif(F.when(F.col("name") == "amount", F.col("other")), F.lit("")), F.lit("user"), F.nullif(F.when(F.col("name") == "userId", F.col("other")), F.lit(""))),
    })
    return parameter_cases.parameter_steps(ready, ["p_partkey"]).select("p_partkey", "place", "step", "expected")


@query
def c17_case_issues(t, spark):
    k = F.col("p_partkey")
    pick = lambda n, bad, good: F.when(k % n == 1, F.lit(bad).cast("string")).otherwise(good)
    behavior = F.lit(validation.BET + " > Bet config")
    cases = t("part").select(
        "p_partkey", F.when(k % 9 == 1, "same").otherwise(F.concat(F.lit("c"), k)).alias("id"),
        F.when(k % 2 == 0, validation.PARAMETERS).when(k % 5 == 1, "User Behavior > Adjustment").when(k % 7 == 1, "User Behavior > Cancel Debit > Cancel config").otherwise(behavior).alias("output_section"),
        F.when(k % 2 == 0, "parameter_validation").otherwise("bet").alias("category"), F.lit("/api/pay").alias("endpoint"), F.lit(None).cast("string").alias("endpoint_name"), F.lit("pay").alias("module"),
        F.when(k % 4 == 0, F.lit("mode")).otherwise("").alias("parameter"), F.when(k % 8 == 0, "case：check the mode validation").otherwise("case：other").alias("scenario"),
        pick(11, "none", F.lit("前置条件：x")).alias("preconditions"), pick(13, None, F.lit("备注：步驟")).alias("remarks"),
        F.when(k % 17 == 1, F.array().cast("array<struct<step:string,expected:string>>")).otherwise(F.array(F.struct(F.lit("go").alias("step"), pick(19, "", F.lit("fails")).alias("expected")))).alias("steps"),
        F.when(k % 3 == 0, F.struct(pick(6, "", F.lit("9")).alias("code"), F.lit("inferred").alias("source"), F.lit("").alias("inference_reason"), F.create_map(F.lit("code"), F.lit("9")).alias("response"))).alias("expected_error"),
        F.struct(F.lit(validation.GENERATOR).alias("generated_by"), F.lit("m").alias("source_module"), F.lit("p").alias("source_path"), pick(23, "no.rule", F.lit("bet.bet_config")).alias("mapping_rule_id"), pick(29, "unmapped", F.lit("mapped")).alias("mapping_status")).alias("source_reference"),
        F.when(k % 12 == 0, F.array(F.lit("scenario"))).alias("edited"),
    )
    return validation.case_issues(cases, "p_partkey", NEGATIVE, ["code", "source"], ["inferred"])


@query
def f09_json_fragments(t, spark):
    said = t("events").select("event_id", F.concat(F.lit("sent "), "props", F.lit(' got { "bad": '), "props", F.lit(" } and {broken "), "props").alias("text"))
    return pages.json_fragments(said, ["event_id"])


@query
def f13_page_markdown(t, spark):
    return pages.markdown(t("pages"), ["page_id"])


@query
def j11_covered_parameters(t, spark):
    """Parameters without a case: not generated, nor skipped with a reason, by whole path or by last segment."""
    path = lambda n: F.concat_ws("/", "p_brand", F.concat(F.lit("p"), (F.col("p_size") % n).cast("string")))
    part = t("part")
    wanted = part.select(F.col("p_type").alias("endpoint"), path(12).alias("parameter")).distinct()
    made = part.filter("p_partkey % 3 = 0").select(F.col("p_type").alias("endpoint"), F.upper(path(12)).alias("parameter"))
    skipped = part.filter("p_partkey % 5 = 0").select(F.col("p_type").alias("endpoint"), F.concat(F.lit("p"), (F.col("p_size") % 12).cast("string")).alias("parameter"), F.when(F.col("p_partkey") % 10 == 0, "why").otherwise(" ").alias("reason"))
    return baselines.uncovered(wanted, made, skipped, "endpoint", "parameter", "reason")


@query
def j12_profile_errors(t, spark):
    """Profiles of years by priority before and after some orders are left out, against all rules of the comparison."""
    o = t("orders").select(F.year("o_orderdate").cast("string").alias("vendor"), F.col("o_orderpriority").alias("endpoint"), "o_orderkey", "o_orderstatus")
    now = o.filter("o_orderkey % 8 <> cast(vendor as int) % 8 and not (vendor = '1995' and endpoint like '1-%')")
    profile = lambda rows: rows.groupBy("vendor", "endpoint").agg(F.count(F.lit(1)).alias("cases"), F.max("o_orderstatus").alias("code"))
    return baselines.profile_errors(profile(now), profile(o), "vendor", "endpoint", "cases", "code")


@query
def c05_drafts(t, spark):
    """Nations as vendors, their suppliers as endpoints and the richest customers as error codes."""
    vendors = t("nation").select(F.col("n_nationkey").alias("vendor"), "n_name")
    endpoints = t("supplier").select(F.col("s_nationkey").alias("vendor"), F.col("s_name").alias("endpoint"), "s_suppkey")
    codes = t("customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("vendor"), "c_custkey", F.col("c_name").alias("code"))
    profile = t("nation").select(F.col("n_nationkey").alias("vendor"), "n_regionkey")
    made = drafts.assemble(vendors, "vendor", {"capability_profile": profile}, {"endpoint_roles": (endpoints, ["endpoint", "s_suppkey"]), "error_codes": (codes, ["c_custkey"])})
    return made.select(
        "vendor", "n_name", F.col("capability_profile.n_regionkey").alias("region"), F.array_join("endpoint_roles.endpoint", ",").alias("endpoints"), F.array_join("error_codes.code", ",").alias("codes")
    )


@query
def c13_vendor_scenarios(t, spark):
    k = F.col("p_partkey")
    maybe = lambda n, x: F.when(k % n == 0, x).otherwise("")
    items = t("part").select(
        k.alias("place"), F.when(k % 4 == 1, "API parameter test").when(k % 4 == 2, "").otherwise("User Behavior > Cancel Bet").alias("output_section"), maybe(3, F.lit("bet")).alias("category"),
        maybe(5, F.lit("Invalid bet")).alias("scenario"), maybe(7, F.lit("m")).alias("module"), F.concat(F.lit("/v1/"), "p_brand", F.lit("/{id}")).alias("endpoint"), maybe(2, F.lit("P1")).alias("priority"),
        F.when(k % 6 == 0, F.array(F.lit("x"))).alias("tags"), maybe(10, F.lit("77")).alias("error_code"), F.lit("400").alias("fallback"),
    )
    roles = t("part").filter("p_size > 40").select(F.concat(F.lit("/v1/"), "p_brand", F.lit("/{id}")).alias("endpoint")).distinct().withColumn("role", F.lit("bet"))
    made = drafts.vendor_scenarios(items, roles, ["place"], "fallback")
    return made.withColumn("tags", F.array_join("tags", ","))


@query
def c16_manifests(t, spark):
    cases = t("customer").select("c_nationkey", "c_custkey", F.concat(F.lit("k"), F.col("c_custkey") % 7).alias("key"), "c_name", "c_mktsegment")
    made = drafts.manifest(cases, "c_nationkey", "key", ["c_custkey"], ["c_name", "c_mktsegment"])
    return made.select("c_nationkey", F.array_join("final_case_keys", ",").alias("keys"), F.size("case_index").alias("n"), F.element_at("case_index", F.get("final_case_keys", F.lit(0)))["c_name"].alias("first_name"))


@query
def c16_merge_reports(t, spark):
    counts = t("orders").groupBy(F.col("o_orderpriority").alias("vendor")).agg(F.count(F.lit(1)).alias("base_cases"), F.count_if(F.col("o_orderstatus") == "F").alias("overridden"))
    return drafts.report_lines(counts, "vendor")


@query
def o01_ordered_names(t, spark):
    """Types of each brand by priority, and names in the order of an example's keys."""
    held = t("part").groupBy("p_brand").agg(F.collect_set("p_type").alias("types"), F.array_sort(F.collect_set("p_name")).alias("names"))
    keys = F.array(F.lit("Small Gear"), F.lit("LARGE bolt"))
    return held.select("p_brand", F.array_join(drafts.by_priority(F.col("types"), ["PROMO", "STANDARD"]), ",").alias("types"), F.array_join(drafts.by_example(F.col("names"), keys), ",").alias("names"))


_ROUTE = rf"""WITH b AS (SELECT p_partkey, {listed(CATEGORIES)} AS category, regexp_replace(trim(lower({listed(MODULES)})), '\s+', ' ', 'g') AS module,
    list_transform(string_split({listed(PATHS)}, '>'), lambda s: trim(regexp_replace(lower(s), '\s+', ' ', 'g'))) AS parts, regexp_replace(lower({listed(TITLES)}), '\s+', ' ', 'g') AS title FROM part),
  s AS (SELECT *, parts[len(parts)] AS leaf, module IN ('cancel bet', 'rollback') OR category LIKE 'rollback%' OR category = 'cancel_settlement_adjustment' OR parts[1:2] = ['mandatory', 'cancel bet'] AS c FROM b),
  d AS (SELECT *, CASE WHEN list_contains(parts, 'special test cases') THEN 'excluded.special_test_cases' WHEN category = 'launch_game' OR module = 'launch game' THEN 'direct.launch_game'
    WHEN category = 'balance' THEN 'direct.balance' WHEN 'authenticate' IN (category, module) THEN 'direct.authenticate'
    WHEN module IN ('slot game', 'video bingo') AND parts[1] = 'game category' THEN 'game_category.module'
    WHEN leaf = 'special accounts' THEN 'X.special_accounts' WHEN leaf = 'player / game status' THEN 'X.player_game_status' WHEN leaf = 'main flow' THEN 'X.main_flow'
    WHEN leaf = 'cancel config' THEN 'cancel.cancel_config' WHEN leaf = 'bet config' THEN 'bet.bet_config' WHEN leaf = 'settle config' THEN 'bet.settle_config'
    WHEN leaf = 'betandsettle config' THEN 'bet.bet_and_settle_config' WHEN leaf = 'adjustment config' THEN CASE WHEN c THEN 'cancel.cancel_config' ELSE 'bet.settle_config' END
    WHEN category = 'authentication_is_necessary' OR parts[1:2] = ['authenticate', 'authentication is necessary'] THEN 'bet.authentication_required'
    WHEN title LIKE '%timeout player%' OR title LIKE '%result0 user%' THEN 'legacy.title_special_accounts' WHEN title LIKE '%status is abnornal%' THEN 'legacy.title_player_game_status'
    WHEN category IN ('freespin', 'jackpot') THEN 'fallback.freespin_jackpot_main_flow' WHEN category LIKE '%settlement_adjustment' THEN 'fallback.adjustment_config'
    WHEN c THEN 'fallback.rollback_config' ELSE 'unmapped.no_rule' END AS r FROM s),
  o AS (SELECT p_partkey, replace(r, 'X.', CASE WHEN c THEN 'cancel.' ELSE 'bet.' END) AS rule_id, CASE WHEN c THEN 'Cancel Bet' ELSE 'Bet and Settle' END AS side, c, module, r FROM d),
  z AS (SELECT p_partkey, 'User Behavior > ' || CASE WHEN r IN ('direct.launch_game', 'direct.authenticate') THEN 'Launch Game' WHEN r = 'direct.balance' THEN 'Get Player balance'
    WHEN r = 'game_category.module' THEN 'Bet and Settle > Game type > Game category > ' || CASE module WHEN 'slot game' THEN 'Slot game' ELSE 'Video Bingo' END
    WHEN r LIKE '%special_accounts' THEN side || ' > Special accounts' WHEN r LIKE '%player_game_status' THEN side || ' > Player / Game status'
    WHEN r = 'fallback.freespin_jackpot_main_flow' OR (r = 'X.main_flow' AND NOT c) THEN 'Bet and Settle > Game type > Main flow' WHEN r = 'X.main_flow' THEN 'Cancel Bet > Main flow'
    WHEN r IN ('cancel.cancel_config', 'fallback.rollback_config') OR (r = 'fallback.adjustment_config' AND c) THEN 'Cancel Bet > Cancel config'
    WHEN r IN ('bet.bet_config', 'bet.authentication_required') THEN 'Bet and Settle > Bet config' WHEN r IN ('bet.settle_config', 'fallback.adjustment_config') THEN 'Bet and Settle > Settle config'
    WHEN r = 'bet.bet_and_settle_config' THEN 'Bet and Settle > BetAndSettle config' END AS section, rule_id,
    CASE WHEN r LIKE 'excluded%' THEN 'excluded' WHEN r LIKE 'unmapped%' THEN 'unmapped' ELSE 'mapped' END AS status FROM o)"""


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_place: dict[int, int] = {}
_rows = []
for _k, _title, _line, _code in EXPECTED_STEPS:
    _place[_k] = _place.get(_k, -1) + 1
    _rows.append(f"({_k}, {_place[_k]}, {_text(_title)}, {_text(_line)}, {_text(_code)})")

ORACLES.update({
    "c02_behavior_routes": f"{_ROUTE} SELECT p_partkey, section, rule_id, status FROM z",
    "c02_inventory": f"{_ROUTE} SELECT status, rule_id, count(*) AS n FROM z GROUP BY status, rule_id",
    "c05_drafts": """SELECT n_nationkey AS vendor, n_name, n_regionkey AS region, coalesce((SELECT string_agg(s_name, ',' ORDER BY s_name, s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey), '') AS endpoints,
        coalesce((SELECT string_agg(c_name, ',' ORDER BY c_custkey) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9000), '') AS codes FROM nation""",
    "c13_vendor_scenarios": """WITH r AS (SELECT DISTINCT p_brand FROM part WHERE p_size > 40), i AS (SELECT p_partkey AS k, p_brand, p_brand IN (SELECT p_brand FROM r) AS known FROM part WHERE p_partkey % 4 <> 1)
        SELECT k AS place, printf('vendor-scenario-%02d', k) AS id, CASE WHEN k % 4 = 2 THEN 'User Behavior > Bet and Settle' ELSE 'User Behavior > Cancel Bet' END AS output_section,
        CASE WHEN k % 3 = 0 THEN 'bet' ELSE 'vendor_provided' END AS category, CASE WHEN k % 5 = 0 THEN 'Invalid bet' ELSE 'Vendor scenario ' || k END AS scenario, CASE WHEN k % 7 = 0 THEN 'm' ELSE p_brand END AS module,
        CASE WHEN known THEN 'bet' ELSE '' END AS endpoint_group, CASE WHEN k % 6 = 0 THEN 'x,' ELSE '' END || 'vendor_provided' AS tags, CASE WHEN k % 2 = 0 THEN 'P1' ELSE 'P2' END AS priority,
        CASE WHEN k % 10 = 0 THEN '77' WHEN k % 5 = 0 THEN '400' END AS error_code FROM i""",
    "c16_manifests": """SELECT c_nationkey, string_agg('k' || c_custkey % 7, ',' ORDER BY c_custkey) AS keys, CAST(count(DISTINCT c_custkey % 7) AS INTEGER) AS n, arg_min(c_name, c_custkey) AS first_name
        FROM customer GROUP BY c_nationkey""",
    "c16_merge_reports": f"""SELECT o_orderpriority AS vendor, '# ' || o_orderpriority || ' Human XMind Merge Report' || {"chr(10) || chr(10) || 'Status: success' || chr(10) || chr(10) || '## Summary' || chr(10) || chr(10)"}
        || '| Item | Count |' || chr(10) || '|---|---:|' || chr(10) || {" || ".join("'| " + label + " | ' || " + {"base_cases": "count(*)", "overridden": "count(*) FILTER (WHERE o_orderstatus = 'F')"}.get(c, "'0'") + " || ' |' || chr(10)" for c, label in drafts.REPORT_ROWS.items())}
        AS report FROM orders GROUP BY o_orderpriority""",
    "o01_ordered_names": """SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY CASE p_type WHEN 'PROMO' THEN '0' WHEN 'STANDARD' THEN '1' ELSE '2' || p_type END) AS types,
        string_agg(DISTINCT p_name, ',' ORDER BY CASE p_name WHEN 'small gear' THEN '0' WHEN 'large bolt' THEN '1' ELSE '2' || p_name END) AS names FROM part GROUP BY p_brand""",
    "c10_parameter_cases": f"""SELECT p_partkey, place, title || chr(10) || line AS step, CASE WHEN code = '' THEN 'The API returns successful response.' || chr(10) || '{{}}'
        ELSE 'The API returns a ' || CASE WHEN code = 'H' THEN 'encryption/signature' ELSE 'parameter' END || ' validation error with error code ' ||
        CASE WHEN code IN ('E', 'H') THEN 'E' || p_size ELSE code END || '.' || chr(10) || '{{"x":1}}' END AS expected
        FROM part JOIN (VALUES {", ".join(_rows)}) v(k, place, title, line, code) ON p_partkey % {len(PARAMETERS)} = k""",
    "c17_case_issues": f"""WITH p AS (SELECT p_partkey AS k FROM part), i AS (SELECT unnest([{", ".join(
        f"CASE WHEN {condition} THEN {{'severity': '{severity}', 'path': '{path}', 'rule': '{rule}'}} END" for severity, path, rule, condition in (
            ("error", "$.remarks", "required", "k % 13 = 1"), ("error", "$.steps", "required", "k % 17 = 1"), ("error", "$.id", "unique", "k % 9 = 1 AND k > 1"),
            ("error", "$.output_section", "allowed", "k % 2 = 1 AND k % 5 = 1"), ("error", "$.output_section", "category", "k % 2 = 1 AND (k % 5 = 1 OR k % 7 = 1)"),
            ("error", "$.parameter", "parameter case", "k % 4 = 2"), ("error", "$.scenario", "title", "k % 8 = 4 AND k % 12 <> 0"), ("warning", "$.scenario", "edited title", "k % 8 = 4 AND k % 12 = 0"),
            ("error", "$.preconditions", "label", "k % 11 = 1"), ("error", "$.steps", "empty", "k % 17 = 1"), ("error", "$.expected_error", "failure", "k % 3 <> 0 AND k % 17 <> 1 AND k % 19 <> 1"),
            ("warning", "$.expected_error.inference_reason", "inferred", "k % 3 = 0"), ("error", "$.source_reference.mapping_rule_id", "known rule", "k % 23 = 1"),
            ("error", "$.source_reference.mapping_status", "mapped", "k % 29 = 1"), ("warning", "$.remarks", "labels", "k % 13 <> 1"), ("error", "$.steps[0].expected", "required", "k % 19 = 1 AND k % 17 <> 1"),
        ))}]) AS x, k FROM p) SELECT k AS p_partkey, x.severity AS severity, x.path AS path, x.rule AS rule FROM i WHERE x IS NOT NULL""",
    "f09_json_fragments": """SELECT event_id, place, CASE place WHEN 1 THEN '{ "bad": ' || props || ' }' ELSE props END AS fragment
        FROM events, (VALUES (0), (1), (2)) v(place) WHERE props IS NOT NULL""",
    "f13_page_markdown": r"""WITH a AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '>\s+<', '><', 'g'), '\s+', ' ', 'g') AS h FROM pages),
        b AS (SELECT page_id, url, replace(replace(regexp_replace(replace(h, '<h1>', chr(10) || chr(10) || '# '), '</h1>|</?p>|<br>', chr(10), 'g'), '<b>', ''), '&quot;', '"') AS m FROM a),
        c AS (SELECT page_id, url, regexp_replace(regexp_replace(replace(replace(replace(m, '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), '\n{3,}', chr(10) || chr(10), 'g'), '[ ]+\n', chr(10), 'g') AS m FROM b)
        SELECT page_id, '# Source URL' || chr(10) || chr(10) || url || chr(10) || chr(10) || trim(m, ' ' || chr(10)) || chr(10) AS markdown FROM c""",
    "j11_covered_parameters": """WITH w AS (SELECT p_partkey AS k, p_type AS endpoint, p_brand || '/p' || p_size % 12 AS parameter, 'p' || p_size % 12 AS leaf FROM part)
        SELECT DISTINCT endpoint, parameter FROM w WHERE (endpoint, parameter) NOT IN (SELECT endpoint, parameter FROM w WHERE k % 3 = 0)
        AND (endpoint, leaf) NOT IN (SELECT endpoint, leaf FROM w WHERE k % 10 = 0)""",
    "j12_profile_errors": """WITH o AS (SELECT CAST(year(o_orderdate) AS VARCHAR) AS vendor, o_orderpriority AS endpoint, o_orderkey, o_orderstatus,
          o_orderkey % 8 <> year(o_orderdate) % 8 AND NOT (year(o_orderdate) = 1995 AND o_orderpriority LIKE '1-%') AS stays FROM orders),
        e AS (SELECT vendor, endpoint, count(*) AS b, count(*) FILTER (WHERE stays) AS n, max(o_orderstatus) AS cb, max(o_orderstatus) FILTER (WHERE stays) AS cn FROM o GROUP BY 1, 2),
        t AS (SELECT vendor, sum(b) AS b, sum(n) AS n FROM e GROUP BY 1)
        SELECT vendor, '' AS endpoint, 'total' AS rule, CAST(b AS BIGINT) AS "before", CAST(n AS BIGINT) AS now FROM t WHERE b - n > 0.1 * b
        UNION ALL SELECT vendor, endpoint, 'missing', b, 0 FROM e WHERE n = 0 UNION ALL SELECT vendor, endpoint, 'cases', b, n FROM e WHERE n > 0 AND b - n > 0.05 * b
        UNION ALL SELECT vendor, endpoint, 'code', NULL, NULL FROM e WHERE n > 0 AND cb <> cn""",
})
