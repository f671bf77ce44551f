"""Registered queries of extraction, exchange formats and generated cases, each with its SQL, added to ``docwright.queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from docwright.functions import exchange, fields, nested
from docwright.operators import dependencies, extraction, generation, similar
from docwright.oracles import HEADING, LINES, ORACLES, PATH
from docwright.queries import QUERIES, path_of, query
from docwright.sources import openapi

NL = "chr(10)"
#: Lines without a comma stand for headings of variants; the tables hold few real ones.
PLAIN = "^[A-Z][^,]{0,80}$"
#: Category, order, module and path fragment.
SELECTORS = [("launch", 1, "ECONOMY", "bolt"), ("balance", 2, "ECONOMY", "small"), ("bet", 3, "PROMO", ""), ("rest", 4, "STANDARD", "gear")]
#: Capability and keywords.
CAPABILITIES = {"license": ["license", "licence"], "record": ["record", "database"], "token": ["token", "secret"]}


@query
def p04_knowledge(t, spark):
    made = t("customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("call /api/"), F.lower("c_mktsegment"), F.lit(" now"))).alias("pre"),
        F.array(F.col("c_nationkey").cast("string"), F.col("c_mktsegment")).alias("path"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("title"),
    )
    known = extraction.knowledge(made, ["c_custkey"], F.col("pre"), F.col("path"), F.col("title"))
    return known.select("c_custkey", "case_id", "api_name", "module", "level")


@query
def p09_endpoints(t, spark):
    return extraction.endpoints(t("pages"), "page_id", [path_of(F.col("url")), F.col("html")], "/[a-z]+/[0-9a-z-]+")


@query
def p10_variants(t, spark):
    return extraction.variants(t("documents"), "doc_id", lambda x: x.rlike(PLAIN), lambda x: x.contains("."))


@query
def p11_examples(t, spark):
    mode = F.when(F.col("turn") % 3 == 0, F.col("role"))
    return extraction.slotted(t("conversations"), "conv_id", "turn", mode, F.when(F.instr("text", ",") > 0, F.col("text")))


@query
def p12_checklist(t, spark):
    say = F.element_at(F.array(*map(F.lit, ["Yes", "no ", "1", "maybe", ""])), F.col("p_size") % 5 + 1)
    return extraction.checklist(t("part").withColumn("say", say), "p_name", "say", ["small gear", "hot bolt"]).select("p_partkey", "p_name", "enabled")


@query
def p13_codes(t, spark):
    code = F.when(F.col("p_size") < 5, F.concat_ws("-", "p_type", "p_size"))
    return extraction.first_codes(t("part"), "p_brand", "p_partkey", code, {"Brand#13": "G13", "Brand#5": "G5"})


@query
def p14_error_codes(t, spark):
    """Stand-ins for tables, token streams and plain text are slices of events."""
    e = t("events").select("user_id", "event_id", F.get_json_object("props", "$.k").alias("code"), F.col("event_type").alias("message"))
    return extraction.error_codes([e.filter("message = 'error'"), e.filter("message = 'purchase' and event_id % 2 = 0")], e, "user_id", "event_id")


@query
def p15_capabilities(t, spark):
    held = t("labels").select("doc_id", F.lit("license").alias("capability"), (F.col("quality") == 1).alias("enabled"))
    return extraction.capabilities(t("documents"), "doc_id", "text", CAPABILITIES, held)


@query
def p17_action_index(t, spark):
    return extraction.action_index(t("documents"), "doc_id", lambda x: F.lower(x).rlike("license|licence"), lambda x: x.rlike(HEADING))


@query
def w03_slices(t, spark):
    return extraction.slices(t("documents"), "doc_id", "text", [HEADING, "[Ll]icense"])


@query
def j07_category_cases(t, spark):
    held = spark.createDataFrame(SELECTORS, "category string, ord int, module string, fragment string")
    return extraction.categorised(t("part"), "p_partkey", "p_type", "p_name", held)


@query
def j10_zip_places(t, spark):
    left = t("supplier").select("s_suppkey", "s_acctbal")
    right = t("customer").select("c_custkey", "c_acctbal")
    return extraction.zip_places(left, right, ["s_acctbal", "s_suppkey"], ["c_acctbal", "c_custkey"]).select("place", "s_suppkey", "c_custkey")


@query
def f11_xml_exchange(t, spark):
    made = F.concat(
        F.lit("<EXTSYSTEM><REQUEST><NAME>"), "p_name", F.lit("</NAME><Name>"), "p_type", F.lit("</Name></REQUEST><RESPONSE><SIZE>"), F.col("p_size").cast("string"),
        F.when(F.col("p_partkey") % 7 == 0, "</RESPONSE>").otherwise("</SIZE></RESPONSE></EXTSYSTEM>"),
    )
    parsed = t("part").select("p_partkey", exchange.xml_children(made, "REQUEST").alias("q"), exchange.xml_children(made, "RESPONSE").alias("a"))
    return parsed.select("p_partkey", F.size("q").alias("n"), F.col("q")["name"].alias("name"), F.col("a")["size"].alias("size"))


@query
def f15_markdown_codes(t, spark):
    head = F.when(F.col("p_partkey") % 2 == 0, "| Code | Message |").otherwise("| Message | Code | Note |")
    row = F.when(F.col("p_partkey") % 2 == 0, F.concat_ws(" | ", "p_size", "p_name")).otherwise(F.concat_ws(" | ", "p_name", "p_size", F.lit("x")))
    text = F.concat(F.lit("intro\n| a | b |\n\n"), head, F.lit("\n|---|---|\n| "), row, F.lit(" |\n| no | none |\n\nend"))
    return t("part").select("p_partkey", F.inline(exchange.markdown_codes(text)))


@query
def f17_canonical_paths(t, spark):
    return t("pages").select("page_id", exchange.canonical_path(F.col("url")).alias("path"))


@query
def f19_sample_values(t, spark):
    kind = F.element_at(F.array(*map(F.lit, ["int", "amount", "boolean", "string"])), F.col("p_size") % 4 + 1)
    value = exchange.sample_value(kind, F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")), F.col("p_name"))
    return t("part").select("p_partkey", value.alias("value"), exchange.wrong_value(kind, value).alias("wrong"))


@query
def c03_sections(t, spark):
    section = F.concat_ws("/", F.when(F.col("p_size") % 2 == 0, "Game"), "p_type")
    return t("part").select("p_partkey", generation.automation_tag(section).alias("tag"), F.col("p_type").isin("ECONOMY", "PROMO").alias("allowed"))


@query
def c08_rewrite(t, spark):
    steps = F.array(F.concat(F.lit("POST /api/bet "), "p_name"), F.concat(F.lit("GET /api/balance "), "p_brand"), F.lit("check"))
    made = generation.rewrite_steps(steps, F.array("p_type", F.lit("200")), {"/api/bet": "/v2/wager", "/api/balance": ""}, "as documented")
    return t("part").select("p_partkey", F.posexplode(made).alias("place", "s")).select("p_partkey", "place", "s.step", "s.expected")


@query
def c09_path_parameters(t, spark):
    path = F.concat(F.lit("/api/{brand}/"), F.when(F.col("p_size") % 2 == 0, "{id}/{brand}").otherwise(F.col("p_type")))
    return t("part").select("p_partkey", F.array_join(generation.path_parameters(path), ",").alias("parameters"))


@query
def c11_dependency_cases(t, spark):
    remark = F.when(F.col("p_partkey") % 4 == 0, "Dependency: when mode in [A,B] => Y; otherwise => N(omit); error=BAD").when(
        F.col("p_partkey") % 4 == 1, "Dependency: when mode present => Y(value >= 3); error=E1")
    made = t("part").filter("p_partkey % 4 < 2").select(F.col("p_partkey").cast("string").alias("endpoint"), F.lit("mode").alias("name"), remark.alias("remark"))
    rules = dependencies.compile_rules(made, "endpoint", "name", "remark")
    held = made.filter("endpoint not like '%5'").select("endpoint", "name")
    return generation.dependency_cases(rules, held, ["endpoint", "name"]).select("endpoint", "ord", "step_no", "step")


@query
def c12_expected_errors(t, spark):
    wanted = t("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    said = t("events").filter("event_type = 'error'").select(
        F.col("user_id").alias("o_custkey"), F.concat(F.element_at(F.array(*map(F.lit, "1235")), (F.col("user_id") % 4 + 1).cast("int")), F.lit("-X")).alias("o_orderpriority"),
        F.col("event_id").alias("place"), F.col("props").alias("error"))
    return generation.expected_errors(wanted, said, "o_custkey", "o_orderpriority").select("o_orderkey", "error", "rank")


@query
def k07_diagnosis(t, spark):
    runs = t("lineitem").select("l_orderkey", F.col("l_linenumber").alias("stage"), (F.col("l_returnflag") != "R").alias("ok"), F.concat_ws(" ", "l_linestatus", "l_partkey").alias("message"))
    return generation.diagnosis(runs, "l_orderkey")


@query
def s14_ambiguous_names(t, spark):
    names = t("part").select(F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("vendor"))
    return generation.ambiguous(names, "vendor")


@query
def f03_string_lists(t, spark):
    text = (
        F.when(F.col("p_partkey") % 3 == 0, F.to_json(F.array("p_name", F.lit(" x "), "p_name", F.lit(""))))
        .when(F.col("p_partkey") % 3 == 1, F.to_json(F.struct(F.col("p_name").alias("title"))))
        .otherwise(F.concat("p_name", F.lit(", b,,"), "p_name"))
    )
    return t("part").select("p_partkey", F.array_join(fields.string_list(text), ",").alias("items"))


@query
def f14_openapi_markdown(t, spark):
    document = F.concat(
        F.lit('{"info": {"title": "'), "p_name", F.lit('"}, "paths": {"/v1/get_item": {"get": {"parameters": [{"name": "id", "in": "query", "required": true, "schema": {"type": "'),
        "p_type", F.lit('"}, "description": "a|b  c"}], "responses": {"200": {"description": "OK"}, "404": {"description": "'), "p_brand",
        F.lit('"}}}, "trace": {"summary": "left out"}}, "/v1/items": {"post": {"summary": "Add item"}}}}'),
    )
    url = F.concat(F.lit("http://e.org/"), F.col("p_partkey").cast("string"))
    return t("part").select("p_partkey", openapi.markdown(document, url).alias("markdown"))


@query
def c07_replace_generated(t, spark):
    o = t("orders").select("o_orderkey", F.col("o_orderpriority").alias("origin"), F.concat_ws("/", "o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, "Game")).alias("section"))
    ours = ["1-X", "2-X"]
    old = o.withColumn("tag", F.lit("old"))
    return generation.replace_generated(old, [o.filter("o_orderkey % 5 = 0"), o.filter("o_orderkey % 7 = 0")], "origin", ours, "section", "tag")


@query
def c15_human_cases(t, spark):
    module = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("Root > User Behavior > "), "p_type")).when(F.col("p_size") % 4 == 1, F.concat_ws(" > ", F.lit("A"), "p_brand", "p_type")).when(
        F.col("p_size") % 4 == 2, F.lit("API parameter test > x"))
    said = F.when(F.col("p_partkey") % 3 == 0, "Amount Exceeds")
    return t("part").select("p_partkey", generation.output_section(module).alias("section"), generation.looks_negative(F.col("p_name"), said).alias("negative"))


@query
def f17_nested_values(t, spark):
    text = F.to_json(F.struct(F.struct(F.col("p_name").alias("P-Name"), F.array(F.struct("p_size")).alias("rows")).alias("outer")))
    made = t("part").select("p_partkey", "p_brand", text.alias("text"))
    changed = nested.remove_value(nested.set_value(F.col("text"), F.lit("outer.new.brand"), F.col("p_brand")), F.lit("outer.rows"))
    return made.select("p_partkey", nested.find_value(F.col("text"), F.lit("pname")).alias("name"), nested.find_value(F.col("text"), F.lit("Rows/P_SIZE")).alias("size"), changed.alias("changed"))


@query
def c09_example_children(t, spark):
    example = F.concat(F.lit('{"a": [{"Details": {"id": '), "p_size", F.lit(', "deep": {"x": 1.5, "y": [1]}, "rows": [2, {"k": true}, {"z": 1}], "none": {}}}]}'))
    return t("part").select("p_partkey", F.posexplode(nested.children(example, F.lit("details"))).alias("ord", "c")).select("p_partkey", "ord", "c.name", "c.type")


@query
def c01_human_blocks(t, spark):
    k = F.col("p_partkey") % 6
    remark = (
        F.when(k == 0, "Required when:\nmode = A\nOptional when:\nmode = B.").when(k == 1, "Require when\r\n A\n\nOmit when:\n'B'").when(k == 2, "A\nRequired when:\nB")
        .when(k == 3, "Required when:\nother = A\nOptional when:\nmode = B").when(k == 4, "Required when:\nC\nOptional when:\nA").otherwise("Required when:\nmode = A")
    )
    row = lambda name, required, description, said: F.struct(F.lit(name).alias("name"), F.lit(required).alias("required"), F.lit(description).alias("description"), said.alias("remark"))
    both = F.array(row("mode", "Y", "One of: A, B, C2", F.lit(None).cast("string")), row("x/y", "Y/N", None, remark))
    made = t("part").select(F.col("p_partkey").cast("string").alias("endpoint"), F.explode(both).alias("p")).select("endpoint", "p.*")
    return dependencies.human_rules(made, t("region").select(F.when(F.col("r_regionkey") == 0, "BAD_REQUEST").alias("code")))


@query
def w04_near_duplicates(t, spark):
    cases = t("pages").select("page_id", F.lower("url").alias("signature"))
    return similar.nearest_earlier(cases, "page_id", "signature")


#: Queries whose measure has no SQL form; tests hold their operators against brute force.
WITHOUT_SQL = {"w04_near_duplicates"}

_KIND = "CASE p_size % 4 WHEN 0 THEN 'int' WHEN 1 THEN 'amount' WHEN 2 THEN 'boolean' ELSE 'string' END"
_SAID = ", ".join(f"('{c}', '{'|'.join(w)}')" for c, w in CAPABILITIES.items())
_ROWS = ", ".join(str(s) for s in SELECTORS)
ORACLES.update({
    "f17_nested_values": """SELECT p_partkey, '"' || p_name || '"' AS name, CAST(p_size AS VARCHAR) AS size,
        '{"outer": {"P-Name": "' || p_name || '", "new": {"brand": "' || p_brand || '"}}}' AS changed FROM part""",
    "c09_example_children": """SELECT p_partkey, ord, name, type FROM part, (VALUES (0, 'details/id', 'int'), (1, 'details/deep/x', 'decimal'), (2, 'details/deep/y', 'array'),
        (3, 'details/rows/k', 'bool')) v(ord, name, type)""",
    "c01_human_blocks": """SELECT CAST(p_partkey AS VARCHAR) AS endpoint, 'x.y' AS name, ord, 'mode' AS selector, value, state, 'BAD_REQUEST' AS error, p_partkey % 6 = 1 AS inferred
        FROM part JOIN (VALUES (0, 1, 'A', 'required'), (0, 2, 'B', 'optional'), (1, 1, 'A', 'required'), (1, 2, 'B', 'forbidden')) v(k, ord, value, state) ON p_partkey % 6 = k""",
    "p04_knowledge": """SELECT c_custkey, printf('TC_%04d', row_number() OVER (ORDER BY c_custkey)) AS case_id,
        CASE WHEN c_custkey % 3 = 0 THEN '/api/' || lower(c_mktsegment) ELSE m END AS api_name, m AS module, 2 AS level
        FROM (SELECT *, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment END AS m FROM customer)""",
    "p09_endpoints": f"""WITH e AS (SELECT page_id, 1 AS source, unnest(regexp_extract_all({PATH}, '/[a-z]+/[0-9a-z-]+')) AS endpoint FROM pages
        UNION ALL SELECT page_id, 2, unnest(regexp_extract_all(html, '/[a-z]+/[0-9a-z-]+')) FROM pages)
        SELECT page_id, endpoint, min(source) AS source FROM e GROUP BY page_id, endpoint""",
    "p10_variants": f"""WITH {LINES}, h AS (SELECT *, regexp_matches(line, '{PLAIN}') AS is_h FROM l),
        b AS (SELECT *, CAST(sum(CASE WHEN is_h THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS block FROM h),
        g AS (SELECT doc_id, block, max(CASE WHEN is_h THEN line END) AS title, count(*) FILTER (WHERE strpos(line, '.') > 0) AS n_examples, count(*) AS n_lines
          FROM b WHERE block > 0 GROUP BY doc_id, block)
        SELECT doc_id, block, title, n_examples, n_lines FROM g QUALIFY count(*) OVER (PARTITION BY doc_id) > 1 OR n_examples > 1""",
    "p11_examples": """WITH c AS (SELECT conv_id, turn, text, last_value(CASE WHEN turn % 3 = 0 THEN role END IGNORE NULLS) OVER
          (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS slot FROM conversations)
        SELECT conv_id, slot, arg_min(text, turn) AS example FROM c WHERE slot IS NOT NULL AND strpos(text, ',') > 0 GROUP BY conv_id, slot""",
    "p12_checklist": """SELECT p_partkey, p_name, CASE p_size % 5 WHEN 0 THEN true WHEN 2 THEN true WHEN 1 THEN false END AS enabled FROM part
        WHERE p_name NOT IN ('small gear', 'hot bolt')""",
    "p13_codes": """SELECT p_brand, coalesce(arg_min(p_type || '-' || p_size, p_partkey) FILTER (WHERE p_size < 5),
        CASE p_brand WHEN 'Brand#13' THEN 'G13' WHEN 'Brand#5' THEN 'G5' END) AS code FROM part GROUP BY p_brand""",
    "p14_error_codes": """WITH e AS (SELECT user_id, event_id, json_extract_string(props, '$.k') AS code, event_type AS message FROM events),
        a AS (SELECT *, 1 AS tier FROM e WHERE message = 'error' UNION ALL SELECT *, 2 FROM e WHERE message = 'purchase' AND event_id % 2 = 0),
        r AS (SELECT * FROM a UNION ALL SELECT *, 3 FROM e WHERE user_id NOT IN (SELECT user_id FROM a))
        SELECT user_id, code, arg_min(message, (tier, event_id)) AS message, min(tier) AS tier FROM r GROUP BY user_id, code""",
    "p15_capabilities": f"""WITH s AS (SELECT doc_id, bool_or(quality = 1) AS q FROM labels GROUP BY doc_id),
        d AS (SELECT doc_id, capability, regexp_matches(lower(coalesce(text, '')), words) AS said FROM documents, (VALUES {_SAID}) v(capability, words))
        SELECT d.doc_id, capability, coalesce(q, said) AS enabled, CASE WHEN q IS NULL THEN 'text' ELSE 'checklist' END AS origin
        FROM d LEFT JOIN s ON d.doc_id = s.doc_id AND capability = 'license'""",
    "p17_action_index": f"""WITH {LINES}, h AS (SELECT *, max(CASE WHEN regexp_matches(line, '{HEADING}') THEN line_no END) OVER
          (PARTITION BY doc_id ORDER BY line_no) AS hn FROM l),
        f AS (SELECT doc_id, lower(line) AS action, line_no, hn FROM h WHERE regexp_matches(lower(line), 'license|licence')
          QUALIFY row_number() OVER (PARTITION BY doc_id, lower(line) ORDER BY line_no) = 1)
        SELECT doc_id, action, CAST(line_no AS INTEGER) AS line_no, CAST(CASE WHEN line_no - hn <= 8 THEN hn ELSE line_no END AS INTEGER) AS start FROM f""",
    "w03_slices": f"""WITH {LINES}, a AS (SELECT doc_id, line_no FROM l WHERE regexp_matches(line, '{HEADING}')
          UNION ALL SELECT doc_id, line_no FROM l WHERE regexp_matches(line, '[Ll]icense')),
        n AS (SELECT doc_id, string_split(coalesce(text, ''), {NL}) AS ls FROM documents),
        e AS (SELECT doc_id, line_no, ls, len(ls) AS m, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k,
          coalesce(lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no), len(ls)) AS nx FROM a JOIN n USING (doc_id)),
        w AS (SELECT doc_id, k, line_no, ls, CASE WHEN nx > line_no THEN line_no ELSE greatest(0, line_no - 8) END AS lo,
          CASE WHEN nx > line_no THEN nx ELSE least(m, line_no + 30) END AS hi FROM e)
        SELECT doc_id, printf('SEC_%03d', k) AS section_no, CAST(line_no AS INTEGER) AS start, CAST(hi - lo AS INTEGER) AS n_lines,
          array_to_string(ls[lo + 1:hi], {NL}) AS body FROM w""",
    "j07_category_cases": f"""SELECT p_partkey, arg_min(category, ord) AS category FROM part JOIN (VALUES {_ROWS}) v(category, ord, module, fragment)
        ON p_type = module AND contains(p_name, fragment) GROUP BY p_partkey""",
    "j10_zip_places": """SELECT place, s_suppkey, c_custkey FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS place FROM supplier)
        JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS place FROM customer) USING (place)""",
    "f11_xml_exchange": "SELECT p_partkey, 1 AS n, p_type AS name, CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_size AS VARCHAR) END AS size FROM part",
    "f15_markdown_codes": "SELECT p_partkey, CAST(p_size AS VARCHAR) AS code, p_name AS message FROM part",
    "f17_canonical_paths": """SELECT page_id, array_to_string(list_filter(list_transform(regexp_split_to_array(url, '[./]+'),
        lambda p: regexp_replace(lower(p), '[^a-z0-9]', '', 'g')), lambda p: p <> ''), '.') AS path FROM pages""",
    "f19_sample_values": f"""SELECT p_partkey, value, CASE WHEN kind = 'string' THEN '12345' ELSE '"' || value || 'x"' END AS wrong FROM (SELECT p_partkey, kind,
        CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN kind = 'int' THEN '1' WHEN kind = 'amount' THEN '100.00' WHEN kind = 'boolean' THEN 'true'
        ELSE '<confirm ' || p_name || '>' END AS value FROM (SELECT *, {_KIND} AS kind FROM part))""",
    "f03_string_lists": """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || ',x' WHEN 1 THEN p_name ELSE p_name || ',b' END AS items FROM part""",
    "f14_openapi_markdown": f"""SELECT p_partkey, array_to_string(['# ' || p_name, '', 'Source URL: http://e.org/' || p_partkey, '', '## Get Item API', '', 'Method: GET', '',
        'Endpoint: /v1/get_item', '', '### Request Parameters', '', '| Name | In | Required | Type | Description |', '|---|---|---|---|---|',
        '| id | query | True | ' || p_type || ' | a\\|b c |', '', '### Responses', '', '| Code | Description |', '|---|---|', '| 200 | OK |', '| 404 | ' || p_brand || ' |', '',
        '## Add item', '', 'Method: POST', '', 'Endpoint: /v1/items', ''], {NL}) AS markdown FROM part""",
    "c07_replace_generated": """WITH o AS (SELECT o_orderkey, o_orderpriority AS origin,
          o_orderstatus || CASE WHEN o_orderkey % 2 = 0 THEN '/Game' ELSE '' END AS section, CASE WHEN o_orderkey % 2 = 0 THEN 'ui_auto' ELSE 'api_auto' END AS tag FROM orders)
        SELECT o_orderkey, origin, section, 'old' AS tag FROM o WHERE origin NOT IN ('1-X', '2-X') UNION ALL SELECT * FROM o WHERE o_orderkey % 5 = 0
        UNION ALL SELECT * FROM o WHERE o_orderkey % 7 = 0""",
    "c15_human_cases": """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'User Behavior > ' || p_type WHEN 1 THEN p_brand || ' > ' || p_type
        WHEN 2 THEN 'API parameter test' ELSE 'Human Added' END AS section, p_partkey % 3 = 0 AS negative FROM part""",
    "c03_sections": """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'ui_auto' ELSE 'api_auto' END AS tag, p_type IN ('ECONOMY', 'PROMO') AS allowed FROM part""",
    "c08_rewrite": """SELECT p_partkey, 0 AS place, 'POST /v2/wager ' || p_name AS step, p_type AS expected FROM part
        UNION ALL SELECT p_partkey, 1, 'GET /api/balance ' || p_brand, '200' FROM part UNION ALL SELECT p_partkey, 2, 'check', 'as documented' FROM part""",
    "c09_path_parameters": "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'brand,id' ELSE 'brand' END AS parameters FROM part",
    "c11_dependency_cases": """WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS endpoint, p_partkey % 4 AS k FROM part WHERE p_partkey % 4 < 2),
        s AS (SELECT * FROM (VALUES (0, 0, 1, 'missing'), (0, 0, 2, 'valid'), (0, 1, 1, 'sent though forbidden'), (1, 0, 1, 'missing'), (1, 0, 2, 'valid'),
          (1, 0, 3, 'constraint violated')) v(k, ord, step_no, step)),
        u AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0)) v(k, ord))
        SELECT endpoint, ord, step_no, step FROM p JOIN s USING (k) WHERE endpoint NOT LIKE '%5'
        UNION ALL SELECT endpoint, ord, 1, 'unknown parameter' FROM p JOIN u USING (k) WHERE endpoint LIKE '%5'""",
    "c12_expected_errors": """WITH r AS (SELECT user_id, substr('1235', CAST(user_id % 4 + 1 AS INTEGER), 1) || '-X' AS pr, event_id, props FROM events WHERE event_type = 'error'),
        a AS (SELECT user_id AS o_custkey, arg_min(props, event_id) AS own FROM r GROUP BY 1),
        b AS (SELECT pr AS o_orderpriority, arg_min(props, event_id) AS other FROM r GROUP BY 1)
        SELECT o_orderkey, coalesce(own, other, '{}') AS error, CASE WHEN own IS NOT NULL THEN 0 WHEN other IS NOT NULL THEN 1 ELSE 2 END AS rank
        FROM orders LEFT JOIN a USING (o_custkey) LEFT JOIN b USING (o_orderpriority)""",
    "k07_diagnosis": """SELECT l_orderkey, count(*) AS n_stages, count(*) FILTER (WHERE l_returnflag = 'R') AS n_failed,
        arg_min(l_linestatus || ' ' || l_partkey, (l_linenumber, l_linestatus || ' ' || l_partkey)) FILTER (WHERE l_returnflag = 'R') AS first_failure FROM lineitem GROUP BY l_orderkey""",
    "s14_ambiguous_names": """SELECT lower(v) AS folded, count(DISTINCT v) AS n_spellings, min(v) AS first FROM
        (SELECT CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS v FROM part) GROUP BY 1 HAVING count(DISTINCT v) > 1""",
})

from docwright import analysis_queries, case_queries, endpoint_queries, selection_queries, vendor_queries  # noqa: E402, F401

__all__ = ["ORACLES", "QUERIES", "WITHOUT_SQL"]
