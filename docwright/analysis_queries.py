"""Registered queries of human overlays, topology, profiles, canonical hashes, best candidates and expanded parameters, with their SQL.

Keys of orders and parts choose texts from the lists below by remainders that don't divide one another,
so combinations go on changing as tables grow. The SQL reads the same lists and computes by its own means.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docwright.case_queries import listed, one_of
from docwright.functions import canonical
from docwright.operators import endpoints, expansion, knowledge, overlays, profiles, topics, topology
from docwright.operators.rules import TAGS
from docwright.oracles import ORACLES, tag_pattern
from docwright.queries import query, topic_rows


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, list):
        return f"[{', '.join(map(_sql, value))}]"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


# ---- human overlays

SECTIONS = ["API parameter test", "User Behavior > Bet", "", "User Behavior > Win", "User Behavior > Cancel: Bet"]
SCENARIOS = ["Bet fails", " Bet  fails ", "bet FAILS", "", "Case： Bet fails", "Win \"twice\"\n"]
STEPS = [[], [["Call  bet", "200"]], [["call bet ", "200"]], [["call bet", "201"]], [["call bet", "200"], ["check：balance", ""]], [["Call bet", "200"], ["Check:Balance", ""]]]
MARKERS = [[], ["p1"], [" p1", "", "p1 "], ["p1", "flag"], ["flag", "p1"]]


def _steps(place: Column) -> Column:
    step = lambda s: F.struct(F.lit(s[0]).alias("step"), F.lit(s[1]).alias("expected"))
    made = [F.array(*map(step, v)) if v else F.array().cast("array<struct<step:string,expected:string>>") for v in STEPS]
    return F.get(F.array(*made), (place % len(STEPS)).cast("int"))


def _side(t, keep: Column, key: Column, shift: int, place: Column):
    """Cases of one side; human ones are shifted in every list, so fields agree for some keys and differ for others."""
    k = F.col("o_orderkey")
    markers = F.get(F.array(*[F.array(*map(F.lit, m)) if m else F.array().cast("array<string>") for m in MARKERS]), ((k + 2 * shift) % len(MARKERS)).cast("int"))
    at = lambda values, n: F.get(F.array(*map(F.lit, values)), (F.floor(n) % len(values)).cast("int"))
    return t("orders").filter(keep).select(
        key.alias("case_key"), place.alias("place"), at(SECTIONS, k / 3).alias("section"), F.col("o_orderstatus").alias("module"), at(SCENARIOS, k / 7 + shift).alias("scenario"), _steps(F.floor(k / 2) + 3 * shift).alias("steps"), markers.alias("markers"),
    )


@query
def j06_case_overlay(t, spark):
    """Human copies of some orders' cases, some of them doubled under one key with the same or another title."""
    k = F.col("o_orderkey")
    name = F.concat(F.lit("ub::"), k.cast("string"))
    base = _side(t, k % 11 != 0, name, 0, k)
    human = _side(t, k % 7 != 0, name, 1, 10 * k).unionByName(_side(t, k % 5 == 0, name, 2, 10 * k + 1)).unionByName(_side(t, k % 9 == 0, name, 1, 10 * k + 2))
    manifest = t("orders").filter(k % 2 == 0).select(name.alias("case_key"))
    laid = overlays.overlay_cases(base, human, manifest)
    steps = F.array_join(F.transform("steps", lambda s: F.concat_ws("=", s.step, s.expected)), ";")
    return laid.select("case_key", "status", "section", "scenario", steps.alias("steps"), F.array_join("markers", ",").alias("markers"), F.array_join("overrides", ",").alias("overrides"), F.coalesce("warning", F.lit("")).alias("warning"), F.coalesce("original_key", F.lit("")).alias("original_key"))


_NORMAL = lambda c: f"lower(trim(regexp_replace(replace({c}, '：', ':'), '\\s+', ' ', 'g')))"
_PICK = lambda values, n: f"({_sql(values)})[CAST(floor({n}) AS BIGINT) % {len(values)} + 1]"
_STEP_LISTS = ", ".join("[" + ", ".join(f"{{'s': {_sql(a)}, 'e': {_sql(b)}}}" for a, b in v) + "]" for v in STEPS)
_MARK_LISTS = ", ".join(f"CAST({_sql(m)} AS VARCHAR[])" for m in MARKERS)
_CLEAN = lambda c: f"list_filter(list_transform({c}, lambda m: trim(m)), lambda m, i: m <> '' AND list_position(list_transform({c}, lambda x: trim(x)), m) = i)"
_SIDE = lambda keep, shift, place: f"""SELECT 'ub::' || o_orderkey AS key, {place} AS place, {_PICK(SECTIONS, 'o_orderkey / 3')} AS section, o_orderstatus AS module, {_PICK(SCENARIOS, f'o_orderkey / 7 + {shift}')} AS scenario,
  ([{_STEP_LISTS}])[(o_orderkey // 2 + {3 * shift}) % {len(STEPS)} + 1] AS steps, ([{_MARK_LISTS}])[(o_orderkey + {2 * shift}) % {len(MARKERS)} + 1] AS markers FROM orders WHERE {keep}"""  # noqa: E731
_JSON_STEPS = """'[' || array_to_string([('{"expected": ' || to_json(x.e) || ', "step": ' || to_json(x.s) || '}') FOR x IN steps], ', ') || ']'"""
_NORMAL_STEPS = lambda c: f"[({_NORMAL('x.s')} || chr(1) || {_NORMAL('x.e')}) FOR x IN {c}]"
_TITLE = lambda c: _NORMAL(f"regexp_replace({c}, '(?i)^\\s*(case|用例)\\s*[：:]\\s*', '')")
ORACLES["j06_case_overlay"] = rf"""WITH base AS ({_SIDE('o_orderkey % 11 <> 0', 0, 'o_orderkey')}),
  h0 AS ({_SIDE('o_orderkey % 7 <> 0', 1, '10 * o_orderkey')} UNION ALL {_SIDE('o_orderkey % 5 = 0', 2, '10 * o_orderkey + 1')} UNION ALL {_SIDE('o_orderkey % 9 = 0', 1, '10 * o_orderkey + 2')}),
  h1 AS (SELECT *, row_number() OVER w AS n, first_value({_TITLE('scenario')}) OVER w AS lead FROM h0 WINDOW w AS (PARTITION BY key ORDER BY place)),
  h2 AS (SELECT *, CASE WHEN n = 1 THEN 'matched' WHEN {_TITLE('scenario')} = lead THEN 'duplicate' ELSE 'regenerated' END AS standing,
      trim(regexp_replace(lower(coalesce(nullif(section, ''), module)), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM h1),
  h3 AS (SELECT * EXCLUDE (key), key AS old, CASE WHEN standing = 'regenerated' THEN 'human::' || slug || '::' || substr(sha1(key || '|' || slug || '|' || scenario || '|' || {_JSON_STEPS}), 1, 8) ELSE key END AS key FROM h2),
  m AS (SELECT b.*, h.key IS NOT NULL AS met, trim(h.scenario) AS hs, h.steps AS hp, {_CLEAN('h.markers')} AS hm, {_CLEAN('b.markers')} AS bm, CAST(substr(b.key, 5) AS BIGINT) % 2 = 0 AS had,
      b.section = 'API parameter test' AS api FROM base b LEFT JOIN h3 h ON h.key = b.key AND h.standing = 'matched'),
  c AS (SELECT *, met AND hm <> bm AS cm, met AND trim(hs, ' ' || chr(10)) <> '' AND hs <> trim(scenario) AS cs, met AND NOT api AND len(hp) = 0 AND len(steps) > 0 AS emptied,
      met AND NOT api AND NOT (len(hp) = 0 AND len(steps) > 0) AND {_NORMAL_STEPS('hp')} <> {_NORMAL_STEPS('steps')} AS cp FROM m),
  f AS (SELECT key, CASE WHEN NOT met THEN CASE WHEN had THEN 'deleted' ELSE 'new' END WHEN cm OR cs OR cp THEN 'overridden' ELSE 'same' END AS status, section, CASE WHEN cs THEN hs ELSE scenario END AS scenario,
      CASE WHEN cp THEN hp ELSE steps END AS steps, CASE WHEN cm THEN hm ELSE markers END AS markers, concat_ws(',', CASE WHEN cm THEN 'markers' END, CASE WHEN cs THEN 'scenario' END, CASE WHEN cp THEN 'steps' END) AS overrides,
      CASE WHEN emptied THEN 'human_steps_empty' ELSE '' END AS warning, '' AS original_key FROM c
    UNION ALL SELECT key, CASE WHEN standing = 'duplicate' THEN 'duplicate' ELSE 'added' END, section, scenario, steps, {_CLEAN('markers')}, '', '', CASE WHEN standing = 'regenerated' THEN old ELSE '' END
      FROM h3 WHERE standing = 'duplicate' OR key NOT IN (SELECT key FROM base))
  SELECT key AS case_key, status, section, scenario, array_to_string([(x.s || '=' || x.e) FOR x IN steps], ';') AS steps, array_to_string(markers, ',') AS markers, overrides, warning, original_key FROM f"""

# ---- topology

ROLES = ["bet", "settlement", "authentication", "balance", "combined_bet_settlement", None, "bet"]
NOTES = ["plain", "Token  required", "Session is required here", "", "call Authenticate before all"]
NAMES = ["Round-ID", " type ", "isFinished", "JackpotWin", "", "userId", "bet_status", "BonusCode", "TxId", "completed"]
SAID = ["text", "holds the free spins left", "missing token", None]


def _of_vendor(t):
    k = F.col("p_partkey")
    one = lambda shift: F.create_map(F.lit("name"), F.get(F.array(*map(F.lit, NAMES)), ((k + shift) % len(NAMES)).cast("int")), F.lit("description"), F.get(F.array(*map(F.lit, SAID)), ((k / 3 + shift).cast("int") % len(SAID)).cast("int")))
    return t("part").select(
        F.floor(k / 5).alias("vendor"), F.concat(F.lit("/e/"), k.cast("string")).alias("endpoint"), one_of(ROLES).alias("role"), F.get(F.array(*map(F.lit, NOTES)), (F.floor(k / 11) % len(NOTES)).cast("int")).alias("section"),
        F.when(k % 13 != 0, F.array(one(0), one(3))).alias("parameters"),
    )


@query
def g06_vendor_topology(t, spark):
    k = F.col("p_partkey")
    errors = t("part").filter("p_partkey % 4 = 1").select(F.floor(k / 5).alias("vendor"), (k % 10).cast("string").alias("code"), F.get(F.array(*map(F.lit, NOTES)), (k % len(NOTES)).cast("int")).alias("context"))
    found = topology.analyse(_of_vendor(t), errors)
    lists = [f.name for f in found.schema.fields if f.dataType.typeName() == "array"]
    return found.select(*[F.array_join(c, ",").alias(c) if c in lists else F.col(c) for c in found.columns])


_FOLD = lambda c: f"regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_HAS = lambda m: f"list_contains({_sql(topology.MEANINGS[m])}, {_FOLD('nm')})"
_JOINED = lambda where: f"coalesce(string_agg(DISTINCT trim(nm), ',' ORDER BY trim(nm)) FILTER (WHERE {where}), '')"
_NEEDS = lambda c: f"regexp_matches(lower({c}), '{'|'.join(topology.REQUIRED)}')"
ORACLES["g06_vendor_topology"] = f"""WITH e AS (SELECT p_partkey AS k, p_partkey // 5 AS vendor, '/e/' || p_partkey AS endpoint, ({_sql(ROLES)})[p_partkey % {len(ROLES)} + 1] AS role, ({_sql(NOTES)})[p_partkey // 11 % {len(NOTES)} + 1] AS section FROM part),
  p AS (SELECT e.*, ({_sql(NAMES)})[(k + s) % {len(NAMES)} + 1] AS nm, ({_sql(SAID)})[(k // 3 + s) % {len(SAID)} + 1] AS ds FROM e, (VALUES (0), (3)) v(s) WHERE k % 13 <> 0),
  q AS (SELECT vendor, {_JOINED("role = 'bet' AND " + _HAS('action'))} AS action_parameters,
      {_JOINED(f"role IN ('bet', 'settlement', 'combined_bet_settlement') AND trim(nm) <> '' AND regexp_matches({_FOLD('concat(nm, ds)')}, '{'|'.join(topology.MEANINGS['free_spin'])}')")} AS free_spin_parameters,
      {', '.join(f"{_JOINED(f'''role IN ('settlement', 'combined_bet_settlement') AND {_HAS(m)}''')} AS {m}_parameters" for m in ('round_end', 'status', 'jackpot'))},
      {', '.join(f"bool_or({_HAS(m)}) AS any_{m}" for m in ('action', 'round_id', 'idempotency'))} FROM p GROUP BY vendor),
  a AS (SELECT k, string_agg(concat_ws(' ', nm, ds), ' ') AS said FROM p GROUP BY k),
  v AS (SELECT vendor, 'endpoint:' || endpoint || CASE WHEN section <> '' THEN ':' || section ELSE '' END AS x FROM e LEFT JOIN a USING (k) WHERE {_NEEDS("concat_ws(' ', endpoint, role, section, said)")}
    UNION SELECT vendor, x FROM (SELECT p_partkey // 5 AS vendor, ({_sql(NOTES)})[p_partkey % {len(NOTES)} + 1] AS c, 'error_code:' || p_partkey % 10 || CASE WHEN c <> '' THEN ':' || c ELSE '' END AS x FROM part WHERE p_partkey % 4 = 1) WHERE {_NEEDS('c')}),
  w AS (SELECT vendor, string_agg(x, ',' ORDER BY x) AS evidence FROM v GROUP BY vendor),
  c AS (SELECT vendor, count(*) FILTER (WHERE role = 'authentication') AS n_auth, count(*) FILTER (WHERE role = 'bet') AS n_bet, count(*) FILTER (WHERE role IN ('settlement', 'combined_bet_settlement')) AS n_settle,
      count(*) FILTER (WHERE role = 'combined_bet_settlement') AS n_combined FROM e GROUP BY vendor)
  SELECT vendor, CASE WHEN n_auth > 0 THEN 'endpoint_present' ELSE 'missing_authenticate_endpoint' END AS authenticate_mode, n_auth, coalesce(evidence, '') AS evidence,
    CASE WHEN n_bet >= 2 THEN 'two_bet_endpoint' WHEN n_bet = 1 AND coalesce(action_parameters, '') <> '' THEN 'one_bet_endpoint_with_action_parameter' WHEN n_bet = 1 THEN 'one_bet_endpoint' ELSE 'missing_bet_endpoint' END AS bet_mode, n_bet,
    coalesce(action_parameters, '') AS action_parameters, coalesce(free_spin_parameters, '') AS free_spin_parameters,
    CASE WHEN coalesce(round_end_parameters, '') <> '' THEN 'has_round_end_control_parameter' ELSE 'no_round_end_control_parameter' END AS settlement_mode, n_settle,
    coalesce(round_end_parameters, '') AS round_end_parameters, coalesce(status_parameters, '') AS status_parameters, coalesce(jackpot_parameters, '') AS jackpot_parameters,
    CASE WHEN n_combined > 0 THEN 'combined_endpoint' ELSE 'missing_combined_endpoint' END AS combined_mode, n_combined, coalesce(any_action, false) AS action_control, coalesce(round_end_parameters, '') <> '' AS round_end_control,
    coalesce(status_parameters, '') <> '' AS settlement_status, coalesce(any_round_id, false) AS round_identifier, coalesce(any_idempotency, false) AS idempotency_key, n_combined > 0 AS combined_bet_settlement, n_auth > 0 AS authentication,
    n_auth > 0 AND evidence IS NOT NULL AS authentication_required, coalesce(jackpot_parameters, '') <> '' AS jackpot_control, coalesce(free_spin_parameters, '') <> '' AS free_spin_control
  FROM c LEFT JOIN q USING (vendor) LEFT JOIN w USING (vendor)"""

# ---- profiles and hashes


@query
def g03_fields_by_size(t, spark):
    k = F.col("p_partkey")
    fields = F.create_map(F.concat(F.lit("size_"), (k % 17).cast("string")), F.when(k % 3 != 0, F.col("p_name")), F.concat(F.lit("kind_"), F.lower("p_type")), F.when(k % 4 != 0, F.col("p_brand")).otherwise(""), F.lit("none"), F.lit(None).cast("string"))
    found = profiles.fields_present(t("part").select("p_size", fields.alias("fields")), ["p_size"], "fields")
    return found.select("p_size", F.array_join("present", ",").alias("present"))


@query
def g04_label_profile(t, spark):
    rows = topic_rows(t)
    flat = topics.flatten(rows, ["parent_id"]).withColumn("file", F.lit("f"))
    return profiles.label_profile(flat, ["topic_id"])


@query
def f07_case_hash(t, spark):
    k = F.col("p_partkey")
    made = t("part").select(
        "p_partkey", F.concat(F.lit('say "'), "p_name", F.lit('"\n\\')).alias("scenario"), F.when(k % 3 != 0, F.col("p_brand")).alias("module"), F.array(F.col("p_type"), F.when(k % 2 == 0, F.col("p_name"))).alias("path"),
        F.transform(F.sequence(F.lit(1), (k % 4 + 1).cast("int")), lambda i: F.struct(F.concat(F.lit("step "), i.cast("string")).alias("step"), (i * 2).alias("expected"))).alias("steps"),
        F.create_map(F.lit("z"), (k % 2 == 0), F.lit("a"), F.lit(None).cast("boolean")).alias("db_checks"), F.array().cast("array<string>").alias("tags"), F.lit("not counted").alias("extra"),
    )
    return made.select("p_partkey", canonical.content_hash(made).alias("digest"))


ORACLES["g03_fields_by_size"] = """WITH e AS (SELECT p_size, 'size_' || p_partkey % 17 AS f, p_partkey % 3 <> 0 AS ok FROM part UNION ALL SELECT p_size, 'kind_' || lower(p_type), p_partkey % 4 <> 0 FROM part)
    SELECT p_size, coalesce(string_agg(DISTINCT f, ',' ORDER BY f) FILTER (WHERE ok), '') AS present FROM e GROUP BY p_size"""
ORACLES["g04_label_profile"] = """WITH c AS (SELECT 'c' || c_custkey AS id, r_name || ' > ' || n_name || ' > Case： ' || c_name AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT 'label' AS kind, '标签' AS value, count(*) + count(*) FILTER (WHERE c_custkey % 2 = 0) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT 'label', '前置条件', count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT 'root', r_name, count(*) FROM region GROUP BY r_name UNION ALL SELECT 'depth', '', 4
    UNION ALL SELECT 'path', path, n FROM (SELECT path, row_number() OVER (ORDER BY id, path) AS n FROM c) WHERE n <= 20"""
ORACLES["f07_case_hash"] = """SELECT p_partkey, sha256('{"api_name": null, "db_checks": {"a": null, "z": ' || CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'false' END || '}, "expected_results": null, "module": ' ||
      CASE WHEN p_partkey % 3 <> 0 THEN to_json(p_brand) ELSE 'null' END || ', "path": [' || to_json(p_type) || ', ' || CASE WHEN p_partkey % 2 = 0 THEN to_json(p_name) ELSE 'null' END ||
      '], "preconditions": null, "priority": null, "scenario": ' || to_json('say "' || p_name || '"' || chr(10) || chr(92)) || ', "source": null, "steps": [' ||
      array_to_string([('{"expected": ' || 2 * i || ', "step": "step ' || i || '"}') FOR i IN range(1, p_partkey % 4 + 2)], ', ') || '], "tags": [], "validation_points": null}') AS digest FROM part"""

# ---- best candidates

ADDRESSES = ["/v1/bet", "/V1/Bet", "/{Partner_base_URL}", "/{partner_base_url}/", "/v1/win"]
TITLES = ["Bet", "Refund", "Page 3", "", "Something", None, "bet"]
METHODS = ["GET", "get", "POST", "unknown"]


@query
def w01_best_candidates(t, spark):
    k = F.col("o_orderkey")
    made = t("orders").select(
        F.col("o_custkey"), k.alias("line_no"), one_of(METHODS, "o_orderkey").alias("method"), one_of(ADDRESSES, "o_orderkey").alias("endpoint"), F.get(F.array(*map(F.lit, TITLES)), (F.floor(k / 3) % len(TITLES)).cast("int")).alias("api_name"),
        ((k * 7 % 5 + 5) / 10).alias("confidence"),
    )
    return endpoints.best_candidates(made, ["o_custkey"])


ORACLES["w01_best_candidates"] = f"""WITH c AS (SELECT o_custkey, o_orderkey AS line_no, {listed(METHODS, 'o_orderkey')} AS method, {listed(ADDRESSES, 'o_orderkey')} AS endpoint, ({_sql(TITLES)})[o_orderkey // 3 % {len(TITLES)} + 1] AS api_name,
      (o_orderkey * 7 % 5 + 5) / 10 AS confidence FROM orders)
    SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey, lower(method), lower(endpoint), CASE WHEN lower(endpoint) LIKE '/{{partner_base_url}}%' AND lower(api_name) IN ('bet', 'refund') THEN lower(api_name) END
      ORDER BY confidence + CASE WHEN coalesce(api_name, '') = '' OR lower(api_name) LIKE 'page %' THEN 0 ELSE 0.1 END DESC, line_no DESC) = 1"""

# ---- expanded parameters

#: Examples with their keys, and for each parameter met in them its type (if object or array) and its children; None is no JSON.
EXAMPLES: list[tuple[str | None, list[str], dict[str, tuple[str | None, list[tuple[str, str]]]]]] = [
    ('{"b": 1, "details": [7, {"id": 1, "deep": {"x": 1.5, "y": []}}, {"z": 2}], "A": "t"}', ["b", "details", "a"], {"details": ("array", [("id", "int"), ("deep/x", "decimal"), ("deep/y", "array")])}),
    ('{"outer": {"a": {"id": true, "none": {}}}, "id": "s"}', ["outer", "id"], {"outer": ("object", [("a/id", "bool")]), "a": ("object", [("id", "bool")])}),
    (None, [], {}),
    ('{"outer": {"id": null, "b": [1]}}', ["outer"], {"outer": ("object", [("id", "string"), ("b", "array")]), "b": ("array", [])}),
]
PARAMETERS = [["a", "", "Y"], ["id", "string", "Y"], [" details ", "", "N"], ["outer", "  ", None], ["", "int", "Y"], ["b", "int", ""], ["a", "int", "N"]]


@query
def c09_expanded_parameters(t, spark):
    k = F.col("p_partkey")
    named = lambda p: F.struct(F.lit(p[0]).alias("name"), F.lit(p[1]).alias("type"), F.lit(p[2]).cast("string").alias("required"), F.lit("").alias("description"))
    pick = lambda j: F.get(F.array(*map(named, PARAMETERS)), ((k + j * (1 + k % 3)) % len(PARAMETERS)).cast("int"))
    listed_ = lambda n: F.transform(F.sequence(F.lit(0), n), pick)
    example = lambda n: F.get(F.array(*[F.lit(e[0]).cast("string") for e in EXAMPLES]), (n % len(EXAMPLES)).cast("int"))
    variant = F.struct(F.concat(F.lit("v"), (k % 4).cast("string")).alias("operation"), listed_((k % 4).cast("int")).alias("parameters"), F.when(k % 5 != 0, example(k + 1)).alias("example"))
    made = t("part").select("p_partkey", listed_((k % 5).cast("int")).alias("parameters"), example(k).alias("example"), F.when(k % 3 == 0, F.array(variant)).alias("variants"))
    return expansion.expand(expansion.by_variant(made), ["p_partkey", "operation"]).select("p_partkey", "operation", "place", "name", "type", F.coalesce("required", F.lit("")).alias("required"), F.coalesce("parent", F.lit("")).alias("parent"))


_FACTS = ", ".join(f"({i}, {_sql(n)}, {_sql(kind)}, {_sql([p for p, _ in c])}::VARCHAR[], {_sql([x for _, x in c])}::VARCHAR[])" for i, (_, _, facts) in enumerate(EXAMPLES) for n, (kind, c) in facts.items())
_KEYS = ", ".join(f"({i}, {_sql(keys)}::VARCHAR[])" for i, (_, keys, _) in enumerate(EXAMPLES))
ORACLES["c09_expanded_parameters"] = f"""WITH keys(ex, ks) AS (VALUES {_KEYS}), facts(ex, nm, kind, paths, kinds) AS (VALUES {_FACTS}),
  e AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'v' || p_partkey % 4 ELSE '' END AS op, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 4 ELSE p_partkey % 5 END AS n,
      CASE WHEN p_partkey % 3 = 0 AND p_partkey % 5 <> 0 AND ({_sql([e[0] or '' for e in EXAMPLES])})[(p_partkey + 1) % {len(EXAMPLES)} + 1] <> '' THEN (p_partkey + 1) % {len(EXAMPLES)} ELSE p_partkey % {len(EXAMPLES)} END AS ex FROM part),
  p AS (SELECT e.*, j, ([{', '.join(f"{{'n': {_sql(a)}, 't': {_sql(b)}, 'r': {_sql(c or '')}}}" for a, b, c in PARAMETERS)}])[(k + j * (1 + k % 3)) % {len(PARAMETERS)} + 1] AS q FROM (SELECT *, unnest(range(n + 1)) AS j FROM e) e),
  r AS (SELECT k, op, ex, q.n AS name, trim(q.n) AS nm, q.t AS t, q.r AS rq, row_number() OVER (PARTITION BY k ORDER BY j) - 1 AS i FROM p WHERE trim(q.n) <> ''),
  s AS (SELECT r.*, ks, coalesce(list_position(ks, lower(nm)) - 1, len(ks) + i) AS pos, kind, coalesce(paths, []) AS paths, coalesce(kinds, []) AS kinds FROM r JOIN keys USING (ex) LEFT JOIN facts USING (ex, nm)),
  o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pos, i) AS o FROM s),
  l AS (SELECT k, list(DISTINCT string_split(x, '/')[-1]) AS leaves FROM (SELECT k, unnest(paths) AS x FROM o) GROUP BY k),
  c AS (SELECT k, op, o, 0 AS ci, name, CASE WHEN trim(t) = '' AND kind IS NOT NULL THEN kind ELSE t END AS type, rq, '' AS parent FROM o LEFT JOIN l USING (k) WHERE NOT (coalesce(list_contains(leaves, nm), false) AND NOT list_contains(ks, nm))
    UNION ALL SELECT k, op, o, ci, nm || '/' || paths[ci], kinds[ci], last_rq, nm FROM (SELECT o.*, ci, arg_max(z.rq, z.o) AS last_rq FROM (SELECT *, unnest(range(1, len(paths) + 1)) AS ci FROM o LEFT JOIN l USING (k) WHERE NOT (coalesce(list_contains(leaves, nm), false) AND NOT list_contains(ks, nm))) o
      JOIN (SELECT k AS zk, nm AS znm, rq, o FROM o) z ON zk = k AND znm = nm GROUP BY ALL)),
  f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY k, trim(name) ORDER BY o, ci) = 1)
  SELECT k AS p_partkey, op AS operation, CAST(row_number() OVER (PARTITION BY k ORDER BY o, ci) - 1 AS INTEGER) AS place, name, type, rq AS required, parent FROM f"""

# ---- case records


@query
def p03_case_records(t, spark):
    """The topics of each customer with ids, labels, a module and steps below them, some doubled, some missing."""
    k = F.col("c_custkey")
    id_ = lambda kind: F.concat(F.lit(kind), k.cast("string"))
    row = lambda here, i, up, title, ord_: F.when(here, F.struct(id_(i).alias("topic_id"), id_(up).alias("parent_id"), title.alias("title"), F.lit(ord_).cast("bigint").alias("ord")))
    always = k.isNotNull()
    more = [
        row(k % 3 == 0, "x", "c", F.concat(F.lit("ID: i"), k.cast("string")), 5), row(k % 4 == 0, "k", "c", F.concat(F.lit("case_key： k"), k.cast("string")), 6), row(k % 4 == 1, "e", "c", F.lit("case_key："), 6),
        row(k % 5 != 0, "d", "c", F.lit("步骤描述"), 7), row(k % 7 == 0, "D", "c", F.lit("步骤描述: again"), 8), row(k % 2 == 0, "q", "d", F.concat(F.lit("步骤：Call "), "c_mktsegment"), 2), row(always, "g", "d", F.lit("no label here"), 1),
        row(always, "G", "D", F.lit("步骤："), 1), row(k % 3 != 1, "y", "q", F.concat(F.lit("预期结果：is "), k.cast("string")), 2), row(always, "z", "q", F.lit("then more"), 1), row(k % 2 == 1, "w", "g", F.lit("预期结果："), 1),
    ]
    rows = topic_rows(t).unionByName(t("customer").select(F.inline(F.array_compact(F.array(*more)))))
    flat = topics.flatten(rows, ["parent_id"])
    labels = F.when(F.col("topic_id").endswith("5"), F.array(F.lit("own")))
    found = topics.case_records(flat.withColumn("file", F.lit("f")).withColumn("labels", labels), ["file"])
    steps = F.array_join(F.transform("steps", lambda s: F.concat_ws("|", s["index"].cast("string"), s.step, s.expected, s.topic_id)), ";")
    return found.select("topic_id", "name", "case_id", "preconditions", "module_title", "remarks", "priority", "module_path", F.array_join("labels", ",").alias("labels"), steps.alias("steps"))


ORACLES["p03_case_records"] = """WITH c AS (SELECT c_custkey AS k, c_name, c_mktsegment AS m, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
    s AS (SELECT k, 1 AS i, 'no label here' AS t, '' AS e, 'g' || k AS id FROM c WHERE k % 5 <> 0 AND k % 7 <> 0
      UNION ALL SELECT k, 2, 'Call ' || m, 'then more' || CASE WHEN k % 3 <> 1 THEN chr(10) || 'is ' || k ELSE '' END, 'q' || k FROM c WHERE k % 5 <> 0 AND k % 7 <> 0 AND k % 2 = 0
      UNION ALL SELECT k, 1, '步骤：', '', 'G' || k FROM c WHERE k % 7 = 0),
    g AS (SELECT k, string_agg(concat_ws('|', i, t, e, id), ';' ORDER BY i) AS steps FROM s GROUP BY k)
    SELECT 'c' || k AS topic_id, c_name AS name, CASE WHEN k % 4 = 0 THEN 'k' || k WHEN k % 3 = 0 THEN 'i' || k ELSE '' END AS case_id, '/api/' || lower(m) AS preconditions, '' AS module_title, '' AS remarks, '' AS priority,
      n_name AS module_path, CASE WHEN k % 10 = 5 THEN 'own,' ELSE '' END || CASE WHEN k % 2 = 0 THEN m ELSE 'first ' || m END AS labels, coalesce(steps, '') AS steps FROM c LEFT JOIN g USING (k)"""

# ---- knowledge

DO = ["Call  the wallet", "check DB record", "", "Verify the balance\n\n\n\nagain", "bet", "retry it", "check DB record"]
GIVES = ["200", "must show an error code", None, "sql row", "", "200"]


@query
def p04_knowledge_cases(t, spark):
    """Records with steps, modules and ids made from the keys of parts."""
    k = F.col("p_partkey")
    at = lambda values, n: F.get(F.array(*[F.lit(v).cast("string") for v in values]), (n % len(values)).cast("int"))
    steps = F.transform(F.slice(F.sequence(F.lit(0).cast("bigint"), F.lit(5).cast("bigint")), F.lit(1), (k % 6).cast("int")), lambda i: F.struct(at(DO, k + 3 * i).alias("step"), at(GIVES, k + 5 * i).alias("expected")))
    made = t("part").select(
        "p_partkey", F.lit("f.xmind").alias("file"), F.when(k % 2 == 0, "S").alias("sheet"), k.cast("string").alias("topic_id"), F.concat(F.lit(" "), "p_name", F.lit(" ")).alias("name"), F.when(k % 3 == 0, F.concat(F.lit("X"), k.cast("string"))).when(k % 3 == 1, "").alias("case_id"),
        F.when(k % 5 == 0, "call /api/v1/x<br>").alias("preconditions"), F.when(k % 4 == 0, F.col("p_brand")).alias("module_title"), F.when(k % 7 != 0, F.concat_ws(" > ", "p_type", "p_brand")).alias("module_path"),
        F.array(F.lit("Root"), F.col("p_type"), F.lit(""), F.col("p_name")).alias("path"), steps.alias("steps"), F.when(k % 11 == 0, "an invalid signature").alias("remarks"), F.when(k % 2 == 1, "P1").alias("priority"),
    )
    found = knowledge.knowledge_cases(made, ["p_partkey"])
    lists = [f.name for f in found.schema.fields if f.dataType.typeName() == "array"]
    return found.select(*[F.array_join(c, "|").alias(c) if c in lists else F.col(c) for c in found.columns if c != "source"])


_TAG_OF = ", ".join(f"CASE WHEN regexp_matches(lower(said), '{tag_pattern(w)}') THEN '{tag}' END" for tag, w in sorted(TAGS.items()))
_JSON_LIST = lambda c: f"CASE WHEN len({c}) > 0 THEN '[' || array_to_string([CAST(to_json(x) AS VARCHAR) FOR x IN {c}], ', ') || ']' ELSE 'null' END"
_JSON_TEXT = lambda c: f"coalesce(CAST(to_json(nullif({c}, '')) AS VARCHAR), 'null')"
_ANY = lambda words: f"list_filter(ev, lambda x, i: regexp_matches(lower(x), '{'|'.join(words)}') AND list_position(ev, x) = i)"
ORACLES["p04_knowledge_cases"] = rf"""WITH p AS (SELECT *, p_partkey AS k, row_number() OVER (ORDER BY p_partkey) AS place FROM part),
  s AS (SELECT k, i, regexp_replace(trim(({_sql(DO)})[(k + 3 * i) % {len(DO)} + 1]), '\n{{3,}}', chr(10) || chr(10), 'g') AS step, trim(({_sql(GIVES)})[(k + 5 * i) % {len(GIVES)} + 1]) AS gives FROM (SELECT k, unnest(range(k % 6)) AS i FROM p)),
  g AS (SELECT k, coalesce(list(step ORDER BY i) FILTER (WHERE step <> ''), []) AS steps, coalesce(list(gives ORDER BY i) FILTER (WHERE gives <> ''), []) AS gives FROM s GROUP BY k),
  a AS (SELECT p.*, CASE WHEN k % 3 = 0 THEN 'X' || k ELSE '' END AS own, format('TC_{{:04d}}', place) AS gen, coalesce(steps, []) AS steps, coalesce(gives, []) AS gives, list_concat(coalesce(steps, []), coalesce(gives, [])) AS ev,
      CASE WHEN k % 7 <> 0 THEN p_type || ' > ' || p_brand ELSE '' END AS mp, CASE WHEN k % 5 = 0 THEN 'call /api/v1/x<br>' ELSE '' END AS pre, CASE WHEN k % 4 = 0 OR k % 7 <> 0 THEN p_brand ELSE 'unclassified' END AS module FROM p LEFT JOIN g USING (k)),
  b AS (SELECT *, CASE WHEN k % 5 = 0 THEN '/api/v1/x' ELSE module END AS api, {_ANY(knowledge.VALIDATION_WORDS)} AS vp, {_ANY(knowledge.DB_WORDS)} AS dbs, CASE WHEN k % 2 = 1 THEN 'P1' ELSE '' END AS pr,
      ' ' || p_name || '  ' || mp || ' ' || pre || ' ' || CASE WHEN k % 11 = 0 THEN 'an invalid signature' ELSE '' END || ' ' || array_to_string(steps, ' ') || ' ' || array_to_string(gives, ' ') AS said FROM a),
  c AS (SELECT *, list_filter([{_TAG_OF}], lambda x: x IS NOT NULL) AS found FROM b), d AS (SELECT *, CASE WHEN len(found) > 0 THEN found ELSE ['unclassified'] END AS tags FROM c)
  SELECT p_partkey, CASE WHEN own <> '' THEN own ELSE gen END AS id, CASE WHEN own <> '' THEN gen END AS generated_id, api AS api_name, module, p_name AS scenario, p_name AS title, nullif(mp, '') AS path, 3 AS level, NULL::VARCHAR AS parent_topic, p_name AS child_topic,
    nullif(pre, '') AS preconditions, {', '.join(f"CASE WHEN len({c}) > 0 THEN array_to_string({c}, '|') END AS {n}" for c, n in (('steps', 'steps'), ('gives', 'expected_results'), ('vp', 'validation_points'), ('dbs', 'db_checks'), ('tags', 'tags')))}, nullif(pr, '') AS priority,
    sha256('{{"api_name": ' || {_JSON_TEXT('api')} || ', "db_checks": ' || {_JSON_LIST('dbs')} || ', "expected_results": ' || {_JSON_LIST('gives')} || ', "module": ' || {_JSON_TEXT('module')} || ', "path": ' || {_JSON_TEXT('mp')} ||
      ', "preconditions": ' || {_JSON_TEXT('pre')} || ', "priority": ' || {_JSON_TEXT('pr')} || ', "scenario": ' || {_JSON_TEXT('p_name')} || ', "source": {{"sheet": "' || CASE WHEN k % 2 = 0 THEN 'S' ELSE '' END || '", "topic_id": "' || k ||
      '", "xmind_file": "f.xmind"}}, "steps": ' || {_JSON_LIST('steps')} || ', "tags": ' || {_JSON_LIST('tags')} || ', "validation_points": ' || {_JSON_LIST('vp')} || '}}') AS content_hash FROM d"""
