"""Registered queries of interface documents, with their SQL.

Each part gives one document: how many paragraphs and tables it has and which ones come in which
order follows from its key, so no two stretches of keys look alike. Texts come from the vocabulary below; the JSON
objects, query parts and exchanges that a text holds are stated beside it for the SQL, which never parses them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docwright.operators import vendor_docs
from docwright.oracles import ORACLES
from docwright.plans.spread import spread
from docwright.queries import query

A, B = "/api/v1/wallet/bet", "/api/v1/wallet/win"
GOOD, WRONG, ASK, BLANK = '{"status": 1, "balance": 10}', '{"error": {"code": 3}}', '{"type": "BET", "promoType": "", "action": "go"}', "{}"
WALLET, BOTH = '{"balance": 1, "currency": "EUR", "denomination": 1, "buffer": 0}', '{"retry": true, "status": 0, "type": true}'
XML = "<EXTSYSTEM><REQUEST><USERID>u1</USERID></REQUEST>\n<RESPONSE><RESULT>{}</RESULT></RESPONSE></EXTSYSTEM>"

#: style, text, its JSON objects as written, with trailing commas repaired, its query part as JSON, request and response of its exchange as JSON.
Said = tuple[str, str, list[str], list[str], str, str, str]


def said(style: str, text: str, json: list[str] = (), repaired: list[str] | None = None, asked: str = "", request: str = "", response: str = "") -> Said:
    return style, text, list(json), list(json if repaired is None else repaired), asked, request, response


#: Paragraphs of documents by remainder of the key: token streams; third-level headings with labels; sections with examples and loose codes.
PARAGRAPHS: list[list[Said]] = [
    [
        said("h2", "Error Codes"), said("p", "Error code"), said("p", " Message "), said("p", "101"), said("p", "low funds"), said("p", "Related Exceptions"), said("h3", "Errors"),
        said("p", "Invalid Hash"), said("p", "BAD_HASH"), said("p", "Description (text)"), said("p", "1234567"), said("heading 2", "Notes"), said("p", ""), said("p", "x"), said("p", "9"),
        said("p", "session expired"), said("p", "not a code, far too long to be one because it goes on and on and on beyond eighty characters"), said("h4", "More"), said("p", "101"),
    ],
    [
        said("h3", f"POST {A} (Bet)"), said("h4", "Request"), said("h4", "Example request"), said("pre", ASK, [ASK]), said("h5", "Response"), said("h4", "example response "),
        said("pre", GOOD + WALLET, [GOOD, WALLET]), said("h6", "Error response example"), said("pre", "{not json} " + WRONG, [WRONG]), said("Heading 4", "Request example"),
        said("pre", BOTH, [BOTH]), said("h3", f"get {B} - Win"), said("h2", "General"), said("p", "plain words"), said("heading 3 b", f"{A}"), said("pre", '{"a": 1,}', [], ['{"a": 1}']),
        said("h3", "No endpoint here"), said("h1", f"{A} as a chapter"), said("p", ASK + ASK, [ASK, ASK]),
    ],
    [
        said("h2", f"1.1 {A} (Bet)"), said("h2", f"1.2 {B} and {A}"), said("h3", "Shared"), said("p", f"call {A} or {B}"), said("p", "Request example"), said("p", "API  Response"),
        said("p", "error response of it"), said("pre", "https://h.e/x?\n&userId=u%201\n&hash=a+b\n&userId=u2", asked='{"userId":"u2","hash":"a b"}'), said("pre", XML.format("ERROR"), request='{"userid":"u1"}', response='{"result":"ERROR"}'),
        said("pre", XML.format("OK"), request='{"userid":"u1"}', response='{"result":"OK"}'), said("pre", "win request " + BOTH, [BOTH]), said("pre", GOOD, [GOOD]), said("pre", "cancel example"), said("pre", BLANK, [BLANK]),
        said("pre", '{"?": ""}', ['{"?": ""}'], asked='{"\\": \\"\\"}":""}'), said("pre", '{"rows": [1, 2,],}', [], ['{"rows": [1, 2]}']), said("p", "a failed call gives status: 404 or\ncode=77 at once"), said("p", "Bet response: " + WRONG, [WRONG]), said("p", "error ABC"),
    ],
]
HEADS = [
    ["Error ID (no)", "Description"], ["Parameter", "Type", "Require", "Game  Type"], ["Message", "Related Exceptions"], ["Code", "Message", "Related exceptions"], ["type", "parameter", "type"], ["Name", "Value"], ["Status Code", "Note"],
]
ROWS = [["12", "twelve "], ["userId", "String", "Y"], ["", "none"], ["Invalid token", "thrown"], ["BAD", "bad one", "E1"], ["7"], ["hash", "int", "N", "x", "beyond"], ["failed", ""]]


def _docs(t):
    """(p_partkey, paragraphs, tables, plain_text) of each part."""
    k = F.col("p_partkey")

    def pick(values: list, kind: str, place: Column) -> Column:
        return F.get(F.array(*values).cast(kind), (place % len(values)).cast("int"))

    def paragraph(j: Column) -> Column:
        place = k * 7 + j * (3 + k % 11) + (k * j) % 13 + F.floor(k / 17)
        made = [[F.struct(F.lit(s).alias("style"), F.lit(x).alias("text")) for s, x, *_ in kind] for kind in PARAGRAPHS]
        one = [pick(m, "array<struct<style:string,text:string>>", place) for m in made]
        return F.when(k % 3 == 0, one[0]).when(k % 3 == 1, one[1]).otherwise(one[2])

    def lists(values: list[list[str]]) -> list[Column]:
        return [F.array(*map(F.lit, v)) for v in values]

    def table(i: Column) -> Column:
        rows = F.transform(F.slice(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint")), F.lit(1), ((k + i) % 5).cast("int")), lambda r: pick(lists(ROWS), "array<array<string>>", k + 5 * i + 7 * r))
        return F.concat(F.array(pick(lists(HEADS), "array<array<string>>", k + 3 * i + F.floor(k / 7))), rows)

    paragraphs = F.transform(F.sequence(F.lit(0).cast("bigint"), 3 + k % 29), paragraph)
    tables = F.transform(F.slice(F.sequence(F.lit(0).cast("bigint"), F.lit(6).cast("bigint")), F.lit(1), F.when(k % 3 == 2, k % 2).otherwise(k % 7).cast("int")), table)
    made = spread(t("part").select("p_partkey")).select("p_partkey", paragraphs.alias("paragraphs"), tables.alias("tables"))
    return vendor_docs.read_json(made.withColumn("plain_text", F.array_join(F.transform("paragraphs", lambda p: p.text), "\n")))


@query
def p14_document_codes(t, spark):
    return vendor_docs.error_codes(_docs(t), ["p_partkey"])


@query
def j01_endpoint_tables(t, spark):
    found = vendor_docs.endpoint_tables(_docs(t), ["p_partkey"])
    text = lambda c: F.array_join(F.transform(c, lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e.key, F.lit("="), e.value)), "&")), "\n")
    return found.select("p_partkey", "endpoint", F.size("request").alias("n_request"), text("request").alias("request"), text("response").alias("response"))


@query
def p10_operation_variants(t, spark):
    found = vendor_docs.operation_variants(_docs(t), ["p_partkey"])
    names = lambda c: F.array_join(F.transform(c, lambda m: m["name"]), ",")
    return found.select(
        "p_partkey", "place", "endpoint", "method", "operation", "title", names("request_parameters").alias("request_names"), names("response_parameters").alias("response_names"),
        F.array_join(F.transform("requests", lambda r: F.concat(r.label, F.lit("="), r.example)), "\n").alias("requests"), F.array_join("successes", "\n").alias("successes"), F.array_join("errors", "\n").alias("errors"),
    )


@query
def p11_example_slots(t, spark):
    vendor = F.when(F.col("p_partkey") % 4 == 0, "Soft-Gaming").otherwise("other")
    found = vendor_docs.example_slots(_docs(t).withColumn("vendor", vendor), ["p_partkey"], "vendor")
    return found.select("p_partkey", "endpoint", "slot", "label", "example", F.row_number().over(Window.partitionBy("p_partkey", "endpoint", "slot").orderBy("place")).alias("n"))


def _quoted(x) -> str:
    if isinstance(x, (list, tuple)):
        return f"CAST([{', '.join(map(_quoted, x))}] AS VARCHAR[])"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


_VOCABULARY = ", ".join(f"({f}, {i}, {', '.join(map(_quoted, x))})" for f, kind in enumerate(PARAGRAPHS) for i, x in enumerate(kind))
_SIZES = " ".join(f"WHEN {f} THEN {len(kind)}" for f, kind in enumerate(PARAGRAPHS))
_EP = f"'{vendor_docs.ENDPOINT}'"
_PLAIN = lambda c: f"trim(regexp_replace(lower({c}), '\\s+', ' ', 'g'))"
_NAMES = ", ".join(f"('{a}', '{b}')" for a, b in vendor_docs.HEADERS.items())
#: v vocabulary; par paragraphs; con content lines of sections; sec sections; cell cells of tables; kept the parameter tables.
_MADE = f"""WITH RECURSIVE v(f, i, style, x, js, rs, asked, req, res) AS (VALUES {_VOCABULARY}), names(bare, name) AS (VALUES {_NAMES}),
  par AS (SELECT k, j, v.* FROM (SELECT p_partkey AS k, unnest(range(4 + p_partkey % 29)) AS j FROM part) JOIN v
    ON f = k % 3 AND i = (k * 7 + j * (3 + k % 11) + (k * j) % 13 + k // 17) % CASE f {_SIZES} END),
  mark AS (SELECT *, regexp_full_match(lower(style), 'h[1-4]|heading.*') AS head FROM par),
  num AS (SELECT *, count(*) FILTER (WHERE head) OVER (PARTITION BY k ORDER BY j) AS sn FROM mark),
  con AS (SELECT *, row_number() OVER (PARTITION BY k, sn ORDER BY j) AS b FROM num WHERE NOT head),
  sec AS (SELECT k, sn, coalesce(max(x) FILTER (WHERE head), 'Overview') AS title, count(*) FILTER (WHERE NOT head) AS n FROM num GROUP BY k, sn
    QUALIFY n > 0 OR (sn = max(sn) OVER (PARTITION BY k) AND title <> 'Overview')),
  tab AS (SELECT p_partkey AS k, unnest(range(CASE WHEN p_partkey % 3 = 2 THEN p_partkey % 2 ELSE p_partkey % 7 END)) AS tn FROM part),
  lin AS (SELECT k, tn, 0 AS rn, ([{', '.join(map(_quoted, HEADS))}])[(k + 3 * tn + k // 7) % {len(HEADS)} + 1] AS cells FROM tab
    UNION ALL SELECT k, tn, rn + 1, ([{', '.join(map(_quoted, ROWS))}])[(k + 5 * tn + 7 * rn) % {len(ROWS)} + 1] FROM (SELECT k, tn, unnest(range((k + tn) % 5)) AS rn FROM tab)),
  cell AS (SELECT k, tn, rn, unnest(cells) AS y, generate_subscripts(cells, 1) AS c, len(cells) AS width FROM lin),
  hd AS (SELECT k, tn, c, {_PLAIN('y')} AS h FROM cell WHERE rn = 0),
  ptab AS (SELECT k, tn, row_number() OVER (PARTITION BY k ORDER BY tn) - 1 AS pn FROM hd GROUP BY k, tn HAVING bool_or(h = 'parameter') AND bool_or(h = 'type')),
  fld AS (SELECT k, pn, rn, CASE h WHEN 'parameter' THEN 'name' WHEN 'require' THEN 'required' ELSE replace(h, ' ', '_') END AS name, arg_max(y, c) AS y
    FROM ptab JOIN hd USING (k, tn) JOIN cell USING (k, tn, c) WHERE rn > 0 GROUP BY k, pn, rn, name),
  prow AS (SELECT k, pn, rn, string_agg(name || '=' || y, '&' ORDER BY name) AS line, max(y) FILTER (WHERE name = 'name') AS nm FROM fld GROUP BY k, pn, rn HAVING nm <> ''),
  pt AS (SELECT k, pn, coalesce(count(line), 0) AS n, coalesce(string_agg(line, chr(10) ORDER BY rn), '') AS lines, coalesce(string_agg(nm, ',' ORDER BY rn), '') AS nms FROM ptab LEFT JOIN prow USING (k, pn) GROUP BY k, pn)"""

_CODE = f"'{vendor_docs.CODE}'"
_IS_CODE = """regexp_full_match(t, '[0-9]{1,6}') OR (length(t) <= 80 AND ((mode = 'code' AND regexp_full_match(t, '[A-Za-z][A-Za-z0-9_.-]{2,}'))
  OR (mode = 'message' AND regexp_matches(lower(t), 'error|invalid|failed|expired|funds|signature'))))"""
_BARE = lambda c: f"trim(regexp_replace({_PLAIN(c)}, '\\s*\\([^)]*\\)\\s*', ' ', 'g'))"
ORACLES["p14_document_codes"] = _MADE + rf""",
  eh AS (SELECT k, tn, c, coalesce(name, {_BARE('y')}) AS h FROM cell LEFT JOIN names ON bare = {_BARE('y')} WHERE rn = 0),
  col AS (SELECT k, tn, min(c) FILTER (WHERE h = 'code') AS code, coalesce(min(c) FILTER (WHERE h = 'message'), min(c) FILTER (WHERE h = 'description'), min(c) FILTER (WHERE h = 'context')) AS said,
      min(c) FILTER (WHERE h = 'message') AS msg, min(c) FILTER (WHERE h = 'related exceptions') AS exc,
      coalesce(min(c) FILTER (WHERE h = 'related exception'), min(c) FILTER (WHERE h = 'related exceptions'), min(c) FILTER (WHERE h = 'description'), min(c) FILTER (WHERE h = 'context')) AS oth FROM eh GROUP BY k, tn),
  trow AS (SELECT k, 1 AS tier, tn AS o1, rn AS o2, trim(cells[code]) AS t, 'code' AS mode, trim(cells[said]) || CASE WHEN trim(coalesce(cells[exc], '')) <> '' THEN ' | ' || trim(cells[exc]) ELSE '' END AS ctx
      FROM col JOIN lin USING (k, tn) WHERE rn > 0 AND code IS NOT NULL AND said IS NOT NULL AND len(cells) >= greatest(code, said)
    UNION ALL SELECT k, 1, tn, rn, trim(cells[msg]), 'message', trim(coalesce(cells[oth], '')) FROM col JOIN lin USING (k, tn)
      WHERE rn > 0 AND (code IS NULL OR said IS NULL) AND msg IS NOT NULL AND oth IS NOT NULL AND len(cells) >= msg),
  csec AS (SELECT k, sn FROM sec JOIN (SELECT k, sn, lower(string_agg(x, ' ' ORDER BY b) FILTER (WHERE b <= 8)) AS pre FROM con GROUP BY k, sn) USING (k, sn)
    WHERE contains({_PLAIN('title')}, 'error code') OR {_PLAIN('title')} = 'errors' OR (contains(pre, 'error code') AND regexp_matches(pre, 'message|description'))),
  tok AS (SELECT k, sn, trim(x) AS t, row_number() OVER (PARTITION BY k, sn ORDER BY b) AS n FROM con JOIN csec USING (k, sn) WHERE trim(x) <> ''),
  tkh AS (SELECT tok.*, coalesce(name, {_BARE('t')}) AS h FROM tok LEFT JOIN names ON bare = {_BARE('t')}),
  md AS (SELECT k, sn, CASE WHEN bool_or(h = 'code') THEN 'code' WHEN bool_or(h = 'message') AND bool_or(h LIKE 'related exception%') THEN 'message' ELSE 'digits' END AS mode FROM tkh WHERE n <= 8 GROUP BY k, sn),
  fl AS (SELECT *, {_IS_CODE} AS is_code FROM tkh JOIN md USING (k, sn)),
  gr AS (SELECT *, count(*) FILTER (WHERE is_code) OVER (PARTITION BY k, sn ORDER BY n) AS g FROM fl),
  st AS (SELECT k, 2 AS tier, sn AS o1, g AS o2, max(t) FILTER (WHERE is_code) AS t, coalesce(string_agg(t, ' | ' ORDER BY n) FILTER (WHERE NOT is_code AND h NOT IN ('code', 'message', 'description', 'context')), '') AS ctx
    FROM gr WHERE g > 0 GROUP BY k, sn, g),
  fd AS (SELECT k, tier, o1, o2, t, ctx FROM trow WHERE {_IS_CODE} UNION ALL SELECT * FROM st),
  doc AS (SELECT k, string_agg(x, chr(10) ORDER BY j) AS body FROM par WHERE k NOT IN (SELECT k FROM fd) GROUP BY k),
  sc AS (SELECT k, body, 0 AS done, 0 AS n, '' AS m, 0 AS pos FROM doc UNION ALL
    SELECT k, body, done + p - 1 + length(m2), n + 1, m2, done + p - 1 FROM (SELECT k, body, done, n, regexp_extract(substr(body, done + 1), {_CODE}, 0) AS m2, strpos(substr(body, done + 1), regexp_extract(substr(body, done + 1), {_CODE}, 0)) AS p FROM sc) WHERE m2 <> ''),
  tx AS (SELECT k, 3 AS tier, 0 AS o1, n AS o2, regexp_extract(m, {_CODE}, 1) AS t, trim(replace(substr(body, greatest(0, pos - 120) + 1, pos + length(m) + 180 - greatest(0, pos - 120)), chr(10), ' ')) AS ctx FROM sc WHERE n > 0),
  al AS (SELECT * FROM fd UNION ALL SELECT * FROM tx WHERE regexp_full_match(t, '[0-9]{{1,6}}')),
  fs AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY tier, o1, o2) AS o FROM al QUALIFY row_number() OVER (PARTITION BY k, t ORDER BY tier, o1, o2) = 1)
  SELECT k AS p_partkey, CAST(row_number() OVER (PARTITION BY k ORDER BY NOT regexp_full_match(t, '[0-9]+'), CASE WHEN regexp_full_match(t, '[0-9]+') THEN CAST(t AS BIGINT) END, lower(t), o) - 1 AS INTEGER) AS place,
    t AS code, ctx AS context, CAST(tier AS INTEGER) AS tier FROM fs"""

ORACLES["j01_endpoint_tables"] = _MADE + rf""",
  ns AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY sn) - 1 AS p, list_distinct(regexp_extract_all(title, {_EP}, 1)) AS es FROM sec WHERE regexp_matches(title, {_EP})),
  el AS (SELECT k, endpoint, max(p) AS p FROM (SELECT k, unnest(es) AS endpoint, p FROM ns) GROUP BY k, endpoint)
  SELECT el.k AS p_partkey, endpoint, CASE WHEN a.pn IS NULL THEN NULL ELSE CAST(a.n AS INTEGER) END AS n_request, a.lines AS request, b.lines AS response
  FROM el LEFT JOIN pt a ON a.k = el.k AND a.pn = 2 * p LEFT JOIN pt b ON b.k = el.k AND b.pn = 2 * p + 1"""

_METHOD = "upper(regexp_extract(title, '(?i)\\b(GET|POST|PUT|PATCH|DELETE)\\b', 1))"
_OPERATION = "CASE WHEN regexp_matches(title, '\\([^()]+\\)\\s*$') THEN trim(regexp_extract(title, '\\(([^()]+)\\)\\s*$', 1)) WHEN contains(title, '-') THEN trim(regexp_extract(title, '-([^-]*)$', 1)) ELSE '' END"
_ANSWERS = lambda e: f"(list_has_any(json_keys({e}), ['status', 'data', 'error', 'result']) OR list_has_all(json_keys({e}), ['balance', 'currency', 'denomination', 'buffer'])) AND NOT list_has_any(json_keys({e}), ['post_params', 'retry', 'game_result'])"
_LABEL = """coalesce(nullif(array_to_string([CASE WHEN json_type(e, '$.' || n) = 'BOOLEAN' THEN upper(json_extract_string(e, '$.' || n)[1]) || substr(json_extract_string(e, '$.' || n), 2) ELSE json_extract_string(e, '$.' || n) END
  FOR n IN ['type', 'promoType', 'action', 'operation'] IF coalesce(json_extract_string(e, '$.' || n), '') <> ''], ' / '), ''), 'request') || '=' || e"""
ORACLES["p10_operation_variants"] = _MADE + rf""",
  kind AS (SELECT *, regexp_full_match(lower(style), 'h3|heading 3.*') AND regexp_matches(x, {_EP}) AS opens, regexp_full_match(lower(style), 'h[123]|heading 3.*') AS closes,
      regexp_full_match(lower(style), 'h[456]|heading 4.*') AS labels FROM par),
  open AS (SELECT *, count(*) FILTER (WHERE closes) OVER (PARTITION BY k ORDER BY j) AS bn FROM kind),
  blk AS (SELECT k, bn, x AS title FROM open WHERE opens),
  lab AS (SELECT o.*, count(*) FILTER (WHERE labels) OVER (PARTITION BY k, bn ORDER BY j) AS ln FROM open o JOIN blk USING (k, bn) WHERE NOT closes),
  lnm AS (SELECT k, bn, ln, trim(lower(x)) AS label, j AS lj FROM lab WHERE labels),
  use AS (SELECT k, bn, title, CAST(coalesce(bool_or(label = 'request'), false) AS INTEGER) AS rq, CAST(coalesce(bool_or(label = 'response'), false) AS INTEGER) AS rs FROM blk LEFT JOIN lnm USING (k, bn) GROUP BY k, bn, title),
  cur AS (SELECT *, coalesce(sum(rq + rs) OVER (PARTITION BY k ORDER BY bn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM use),
  ex AS (SELECT k, bn, label, min(lj) OVER (PARTITION BY k, bn, label) AS lo, j, unnest(js) AS e, generate_subscripts(js, 1) AS en FROM lnm JOIN lab USING (k, bn, ln) WHERE NOT labels),
  exs AS (SELECT k, bn, string_agg({_LABEL}, chr(10) ORDER BY lo, j, en) FILTER (WHERE label IN ('example request', 'request example') AND NOT ({_ANSWERS('e')})) AS requests,
      count(*) FILTER (WHERE label IN ('example request', 'request example') AND NOT ({_ANSWERS('e')})) AS nr,
      string_agg(e, chr(10) ORDER BY lo, j, en) FILTER (WHERE label IN ('example response', 'response example')) AS successes,
      string_agg(e, chr(10) ORDER BY lo, j, en) FILTER (WHERE label IN ('example error response', 'error response example')) AS errors FROM ex GROUP BY k, bn),
  a AS (SELECT cur.k, 0 AS o1, bn AS o2, title, CASE WHEN rq = 1 THEN coalesce(q.nms, '') ELSE '' END AS qn, CASE WHEN rs = 1 THEN coalesce(r.nms, '') ELSE '' END AS rn, coalesce(nr, 0) AS nr,
      coalesce(requests, '') AS requests, coalesce(successes, '') AS successes, coalesce(errors, '') AS errors
    FROM cur LEFT JOIN exs USING (k, bn) LEFT JOIN pt q ON q.k = cur.k AND q.pn = used LEFT JOIN pt r ON r.k = cur.k AND r.pn = used + rq),
  ns AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY sn) - 1 AS p FROM sec WHERE regexp_matches(title, {_EP})),
  sx AS (SELECT k, sn, b, 1 AS o, asked AS e, 'q' AS w FROM con WHERE asked <> ''
    UNION ALL SELECT k, sn, b, 2, req, 'q' FROM con WHERE req <> ''
    UNION ALL SELECT k, sn, b, 3, res, CASE WHEN upper(json_extract_string(res, '$.result')) = 'ERROR' THEN 'x' ELSE 's' END FROM con WHERE res <> ''),
  sxs AS (SELECT k, sn, string_agg({_LABEL}, chr(10) ORDER BY b, o) FILTER (WHERE w = 'q') AS requests, count(*) FILTER (WHERE w = 'q') AS nr, string_agg(e, chr(10) ORDER BY b) FILTER (WHERE w = 's') AS successes,
      string_agg(e, chr(10) ORDER BY b) FILTER (WHERE w = 'x') AS errors FROM sx GROUP BY k, sn),
  s AS (SELECT ns.k, 1 AS o1, p AS o2, title, coalesce(q.nms, '') AS qn, coalesce(r.nms, '') AS rn, coalesce(nr, 0) AS nr, coalesce(requests, '') AS requests, coalesce(successes, '') AS successes, coalesce(errors, '') AS errors
    FROM ns LEFT JOIN sxs USING (k, sn) LEFT JOIN pt q ON q.k = ns.k AND q.pn = 2 * p LEFT JOIN pt r ON r.k = ns.k AND r.pn = 2 * p + 1),
  un AS (SELECT *, regexp_extract(title, {_EP}, 1) AS endpoint FROM (SELECT * FROM a UNION ALL SELECT * FROM s)),
  fit AS (SELECT * FROM un u WHERE o1 = 0 OR NOT EXISTS (SELECT 1 FROM un z WHERE z.k = u.k AND z.endpoint = u.endpoint AND z.o1 = 0)),
  two AS (SELECT *, count(*) OVER (PARTITION BY k, endpoint) AS nv FROM fit)
  SELECT k AS p_partkey, CAST(row_number() OVER (PARTITION BY k ORDER BY o1, o2) - 1 AS INTEGER) AS place, endpoint, {_METHOD} AS method, {_OPERATION} AS operation, title, qn AS request_names, rn AS response_names,
    requests, successes, errors FROM two WHERE nv > 1 OR nr > 1"""

_ASKS = f"({_PLAIN('x')} IN ('request', 'api request', 'request body') OR contains({_PLAIN('x')}, 'request example') OR (contains({_PLAIN('x')}, 'example') AND regexp_matches({_PLAIN('x')}, 'rollback|cancel')))"
_MODE = f"CASE WHEN {_ASKS} THEN 'request' WHEN contains({_PLAIN('x')}, 'error response') THEN 'error' WHEN {_PLAIN('x')} IN ('response', 'api response', 'response body') OR contains({_PLAIN('x')}, 'response example') THEN 'response' ELSE '' END"
_SLOT = f"""CASE WHEN contains(pl, 'error') AND contains(pl, 'response') THEN 'error' WHEN contains(pl, 'request') THEN 'request' WHEN list_contains(json_keys(e), 'error') THEN 'error'
  WHEN contains(pl, 'response') THEN 'success' WHEN mode = 'response' THEN 'success' WHEN mode <> '' THEN mode WHEN {_ANSWERS('e')} THEN 'success' ELSE 'request' END"""
_ENTRY = "{'e': %s, 's': CASE WHEN k %% 4 = 0 AND %s = 'request' AND regexp_matches(%s, 'rollback|cancel') THEN 'additional' ELSE %s END, 'l': CASE WHEN k %% 4 = 0 AND %s = 'request' AND regexp_matches(%s, 'rollback|cancel') THEN trim(%s) ELSE '' END, 'x': %s}"
_EMPTY = "CAST([] AS STRUCT(e VARCHAR, s VARCHAR, l VARCHAR, x VARCHAR)[])"
ORACLES["p11_example_slots"] = _MADE + rf""",
  fact AS (SELECT k, sn, title, CASE WHEN regexp_matches(title, {_EP}) THEN regexp_extract_all(title, {_EP}, 1) ELSE es END AS raw
    FROM sec LEFT JOIN (SELECT k, sn, regexp_extract_all(string_agg(x, chr(10) ORDER BY b), {_EP}, 1) AS es FROM con GROUP BY k, sn) USING (k, sn)),
  eps AS (SELECT k, sn, title, list_filter(raw, lambda z, i: list_position(raw, z) = i) AS es, row_number() OVER (PARTITION BY k ORDER BY sn) AS so FROM fact WHERE len(raw) > 0),
  step AS (SELECT k, sn, 0 AS b, coalesce(nullif(regexp_extract(title, {_EP}, 1), ''), es[1]) AS cur, '' AS led, '' AS mode, '' AS label, {_EMPTY} AS got FROM eps
    UNION ALL SELECT k, sn, b, CASE WHEN len(parsed) > 0 THEN coalesce(nullif(named, ''), cur) ELSE coalesce(nullif(regexp_extract(x, {_EP}, 1), ''), cur) END,
      CASE WHEN len(parsed) = 0 THEN led WHEN list_contains([y.t FOR y IN slots], 'request') THEN target ELSE led2 END, mode, CASE WHEN len(parsed) > 0 THEN '' ELSE wait END,
      CASE WHEN req <> '' THEN [{_ENTRY % ('bef', "'request'", _PLAIN('wait'), "'request'", "'request'", _PLAIN('wait'), 'wait', 'req')}] ELSE [] END ||
      CASE WHEN res <> '' THEN [{_ENTRY % ('bef', "'answer'", "''", "CASE WHEN upper(json_extract_string(res, '$.result')) = 'ERROR' THEN 'error' ELSE 'success' END", "'answer'", "''", "''", 'res')}] ELSE [] END ||
      [{_ENTRY % ('target', 'y.t', 'pl', 'y.t', 'y.t', 'pl', 'lab', 'y.v')} FOR y IN slots]
    FROM (SELECT *, [{{'t': {_SLOT}, 'v': e}} FOR e IN parsed] AS slots, coalesce(nullif(led2, ''), cur) AS target FROM (
      SELECT *, coalesce(nullif(named, ''), led) AS led2, coalesce(nullif(led, ''), cur) AS bef, {_PLAIN('lab')} AS pl FROM (
        SELECT *, CASE WHEN w = '' THEN '' ELSE coalesce(list_filter(es, lambda z: list_contains(string_split(w, ' '), lower(string_split(rtrim(z, '/'), '/')[-1])))[1], '') END AS named FROM (
          SELECT *, trim(regexp_replace(lower(lab), '[^a-z0-9_/]+', ' ', 'g')) AS w FROM (
            SELECT *, CASE WHEN contains(x, '{{') AND trim(split_part(x, '{{', 1)) <> '' THEN lower(trim(split_part(x, '{{', 1))) ELSE wait END AS lab FROM (
              SELECT s.k, s.sn, c.b, s.cur, s.led, c.x, p.es, c.req, c.res, CASE WHEN len(c.rs) > 0 THEN c.rs WHEN c.asked <> '' THEN [c.asked] ELSE [] END AS parsed,
                CASE WHEN {_MODE} <> '' THEN {_MODE} ELSE s.mode END AS mode, CASE WHEN {_MODE} <> '' THEN c.x ELSE s.label END AS wait
              FROM step s JOIN con c ON c.k = s.k AND c.sn = s.sn AND c.b = s.b + 1 JOIN eps p ON p.k = s.k AND p.sn = s.sn))))))),
  outs AS (SELECT k, sn, so, es, list(got ORDER BY step.b) AS gots FROM step JOIN eps USING (k, sn) GROUP BY k, sn, so, es),
  flat AS (SELECT k, so, es, flatten(gots) AS got FROM outs),
  fold AS (SELECT DISTINCT k, 0::BIGINT AS so, {_EMPTY} AS ent FROM eps
    UNION ALL SELECT k, so, ent2 || CASE WHEN len(es) > 1 AND src IS NOT NULL THEN flatten([[{{'e': z, 's': o.s, 'l': o.l, 'x': o.x}} FOR o IN ent2 IF o.e = src AND len(list_filter(ent2, lambda q: q.e = z AND q.s = o.s)) = 0] FOR z IN es IF z <> src])
      ELSE {_EMPTY} END FROM (SELECT *, list_filter(es, lambda z: list_contains([o.e FOR o IN ent2], z))[1] AS src FROM (
        SELECT k, so, es, list_filter([CASE WHEN y.s = 'additional' THEN y WHEN len(list_filter(whole[:i - 1], lambda q: q.e = y.e AND q.s = y.s)) = 0
            THEN coalesce(list_filter(whole, lambda q: q.e = y.e AND q.s = y.s AND NOT regexp_full_match(q.x, '\{{\s*\}}|\{{\s*"\?"\s*:\s*""\s*\}}'))[1], list_filter(whole, lambda q: q.e = y.e AND q.s = y.s)[-1]) END FOR y, i IN whole],
            lambda q: q IS NOT NULL) AS ent2 FROM (SELECT f.k, t.so, t.es, f.ent || t.got AS whole FROM fold f JOIN flat t ON t.k = f.k AND t.so = f.so + 1)))),
  las AS (SELECT k, unnest(ent) AS q, generate_subscripts(ent, 1) AS o FROM (SELECT k, ent FROM fold QUALIFY so = max(so) OVER (PARTITION BY k)))
  SELECT k AS p_partkey, q.e AS endpoint, q.s AS slot, q.l AS label, q.x AS example, CAST(row_number() OVER (PARTITION BY k, q.e, q.s ORDER BY o) AS INTEGER) AS n FROM las"""

# ---- endpoints, checklists, games, capabilities and actions

CHECK_HEADS = [["Name", "Description", "Remark", "Enable (Y/N)"], ["Game Code", "GameType", "Game  Name"], ["x", "is enabled", " NAME "], ["Game Name", "Game code"], ["Name", "Value"]]
CHECK_ROWS = [
    ["Freespin", "d", "", "checked"], ["Jackpot", "No", "Multiple Bet", "unchecked"], ["Result Type", "YES", "Process Endround", "y"], ["Bet Threshold", "1", "Win Threshold"], ["Process Endround", "maybe", "Adjustment", ""],
    ["Adjustment", "", "Jackpot", "ask us"], ["", " Disabled ", " "], ["Freespin", "0", "Multiple Win", "n", "x"],
]
SPOKEN = ["We settle twice in the same round.", "ROLLBACK and refund of bets", "call POST /api/v1/cancel/x then", "Free Game or JackPot", "nothing", "GET /api/v1/balance", "a re-try with cash"]
ACTION_LINES = ["# **Bet_and win?** calls", "Action: betAndWin", "x action:CANCELwin2 y", "plain", "use put here", "", "action : bet", "### Balance", "ACTION: Bet", "transaction: no", "the get of it", "more", "and more", "still more"]


def _checklists(t):
    """(p_partkey, paragraphs, tables, tasks, plain_text): tables of settings and games, and lines that speak of capabilities."""
    k = F.col("p_partkey")
    at = lambda values, n: F.get(F.array(*values), (n % len(values)).cast("int"))
    lists = lambda values: [F.array(*map(F.lit, v)) for v in values]
    upto = lambda n: F.slice(F.sequence(F.lit(0).cast("bigint"), F.lit(9).cast("bigint")), F.lit(1), n.cast("int"))
    table = lambda i: F.concat(F.array(at(lists(CHECK_HEADS), k + i * 2)), F.transform(upto((k + i) % 6), lambda r: at(lists(CHECK_ROWS), F.floor(k / 3) + 5 * i + 3 * r)))
    task = lambda r: F.array(F.struct(F.concat(F.lit(" Slot "), r.cast("string")).alias("text"), (r % 2 == 0).alias("checked")), F.struct(F.lit("Live").alias("text"), F.lit(True).alias("checked")), F.struct(F.lit(" ").alias("text"), F.lit(True).alias("checked")))
    none = F.array().cast("array<struct<text:string,checked:boolean>>")
    tasks = F.transform(upto(k % 4), lambda i: F.transform(upto((k + i) % 6 + 1), lambda r: F.transform(upto(F.lit(4)), lambda c: F.when((k + i + r + c) % 3 == 0, task(r)).otherwise(none))))
    paragraphs = F.transform(upto(k % 5), lambda j: F.struct(F.when((k + j) % 4 == 0, "h2").otherwise("p").alias("style"), at(list(map(F.lit, SPOKEN)), k * 3 + j * (1 + k % 5)).alias("text")))
    made = spread(t("part").select("p_partkey")).select("p_partkey", paragraphs.alias("paragraphs"), F.transform(upto(k % 4), table).alias("tables"), tasks.alias("tasks"))
    return vendor_docs.read_json(made.withColumn("plain_text", F.array_join(F.transform("paragraphs", lambda p: p.text), "\n")))


@query
def p09_document_endpoints(t, spark):
    found = vendor_docs.document_endpoints(_docs(t), ["p_partkey"])
    return found.select("p_partkey", "endpoint", "section", F.array_join("methods", ",").alias("methods"), F.array_join("keywords", ",").alias("keywords"), F.size("request").alias("n_request"), F.size("response").alias("n_response"))


@query
def p12_document_checklist(t, spark):
    found = _checklists(t).select("p_partkey", F.posexplode(vendor_docs.checklist(F.col("tables"), F.col("tasks"))).alias("place", "s"))
    return found.select("p_partkey", "place", "s.name", "s.description", "s.remark", "s.value", "s.enabled", "s.capability", F.array_join("s.available", ",").alias("available"), F.array_join("s.selected", ",").alias("selected"))


@query
def p13_game_codes(t, spark):
    return _checklists(t).select("p_partkey", F.posexplode(vendor_docs.game_codes(F.col("tables"))).alias("place", "g")).select("p_partkey", "place", "g.*")


@query
def p15_capability_profile(t, spark):
    found = vendor_docs.capability_profile(_checklists(t), ["p_partkey"])
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e.key, e.value.cast("string"))), ",")
    return found.select("p_partkey", listed("supports").alias("supports"), listed("origins").alias("origins"), listed("keyword_counts").alias("keyword_counts"))


@query
def p17_actions(t, spark):
    k = F.col("p_partkey")
    line = lambda j: F.get(F.array(*map(F.lit, ACTION_LINES)), ((k * 3 + j * (1 + k % 13) + (k * j) % 5) % len(ACTION_LINES)).cast("int"))
    made = spread(t("part").select("p_partkey")).select("p_partkey", F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), k % 31), line), "\n").alias("text"))
    found = vendor_docs.actions(made, ["p_partkey"])
    return found.withColumn("keywords", F.array_join("keywords", ","))


_WORDS_OF = lambda c: f"list_filter(['balance', 'bet', 'settle', 'result', 'rollback', 'cancel', 'auth', 'token', 'jackpot', 'free_spin', 'adjustment'], lambda w: contains(lower({c}), replace(w, '_', ' ')))"
_ENDPOINTS = rf""",
  src AS (SELECT k, sn AS o, 0 AS o2, title AS section, '' AS line, CASE WHEN regexp_matches(title, {_EP}) THEN regexp_extract_all(title, {_EP}, 1) ELSE regexp_extract_all(coalesce(body, ''), {_EP}, 1) END AS es
      FROM sec LEFT JOIN (SELECT k, sn, string_agg(x, chr(10) ORDER BY b) AS body FROM con GROUP BY k, sn) USING (k, sn)
    UNION ALL SELECT k, 1000 + tn, rn, 'table', array_to_string(cells, ' '), regexp_extract_all(array_to_string(cells, ' '), {_EP}, 1) FROM lin),
  nm AS (SELECT k, o, o2, section, line, unnest(es) AS endpoint, generate_subscripts(es, 1) AS n FROM src),
  fst AS (SELECT * FROM nm QUALIFY row_number() OVER (PARTITION BY k, endpoint ORDER BY o, o2, n) = 1),
  txt AS (SELECT k, string_agg(x, chr(10) ORDER BY j) AS body FROM par GROUP BY k),
  ctx AS (SELECT fst.*, CASE WHEN strpos(coalesce(body, ''), endpoint) > 0 THEN substr(body, greatest(1, strpos(body, endpoint) - 700), strpos(body, endpoint) + length(endpoint) + 700 - greatest(1, strpos(body, endpoint) - 700)) ELSE line END AS around FROM fst LEFT JOIN txt USING (k)),
  epw AS (SELECT *, list_sort(list_distinct([upper(q) FOR q IN regexp_extract_all(around, '(?i)\b(GET|POST|PUT|PATCH|DELETE)\b\s*' || regexp_escape(endpoint), 1)])) AS methods,
      list_concat({_WORDS_OF('endpoint')}, list_filter({_WORDS_OF('around')}, lambda w: NOT list_contains({_WORDS_OF('endpoint')}, w))) AS words FROM ctx)"""
ORACLES["p09_document_endpoints"] = _MADE + _ENDPOINTS + rf""",
  ns AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY sn) - 1 AS p, list_distinct(regexp_extract_all(title, {_EP}, 1)) AS es FROM sec WHERE regexp_matches(title, {_EP})),
  el AS (SELECT k, endpoint, max(p) AS p FROM (SELECT k, unnest(es) AS endpoint, p FROM ns) GROUP BY k, endpoint)
  SELECT e.k AS p_partkey, endpoint, section, array_to_string(methods, ',') AS methods, array_to_string(words, ',') AS keywords, CASE WHEN a.pn IS NOT NULL THEN CAST(a.n AS INTEGER) END AS n_request,
    CASE WHEN b.pn IS NOT NULL THEN CAST(b.n AS INTEGER) END AS n_response FROM epw e LEFT JOIN el USING (k, endpoint) LEFT JOIN pt a ON a.k = e.k AND a.pn = 2 * p LEFT JOIN pt b ON b.k = e.k AND b.pn = 2 * p + 1"""
_CHECKED = rf"""WITH tab AS (SELECT p_partkey AS k, unnest(range(p_partkey % 4)) AS tn FROM part),
  lin AS (SELECT k, tn, 0 AS rn, ([{', '.join(map(_quoted, CHECK_HEADS))}])[(k + tn * 2) % {len(CHECK_HEADS)} + 1] AS cells FROM tab
    UNION ALL SELECT k, tn, rn + 1, ([{', '.join(map(_quoted, CHECK_ROWS))}])[(k // 3 + 5 * tn + 3 * rn) % {len(CHECK_ROWS)} + 1] FROM (SELECT k, tn, unnest(range((k + tn) % 6)) AS rn FROM tab)),
  hd AS (SELECT k, tn, [{_PLAIN('y')} FOR y IN cells] AS hs FROM lin WHERE rn = 0),
  loc AS (SELECT k, tn, list_position(hs, 'name') AS nm, list_position([contains(h, 'enable') FOR h IN hs], true) AS en, list_position(hs, 'description') AS ds, list_position(hs, 'remark') AS rm,
      list_position(hs, 'game code') AS gc, list_position(hs, 'gametype') AS gt, list_position(hs, 'game name') AS gn FROM hd),
  st AS (SELECT k, tn, rn, en, trim(cells[nm]) AS name, trim(coalesce(cells[ds], '')) AS description, trim(coalesce(cells[rm], '')) AS remark, trim(cells[en]) AS value,
      coalesce(map([{', '.join(_quoted(x) for x in vendor_docs.BY_NAME)}], [{', '.join(_quoted(x) for x in vendor_docs.BY_NAME.values())}])[trim(cells[nm])], '') AS capability
    FROM loc JOIN lin USING (k, tn) WHERE rn > 0 AND nm IS NOT NULL AND en IS NOT NULL AND len(cells) >= greatest(nm, en) AND trim(cells[nm]) NOT IN ('', {', '.join(map(_quoted, vendor_docs.SKIPPED))}) AND NOT contains(cells[nm], 'Threshold')),
  se AS (SELECT *, CASE WHEN lower(value) IN ('checked', 'y', 'yes', 'true', '1', 'enabled') THEN true WHEN lower(value) IN ('unchecked', 'n', 'no', 'false', '0', 'disabled') THEN false END AS enabled,
      row_number() OVER (PARTITION BY k ORDER BY tn, rn) - 1 AS place FROM st)"""
ORACLES["p12_document_checklist"] = _CHECKED + """ SELECT k AS p_partkey, CAST(place AS INTEGER) AS place, name, description, remark, value, enabled, capability,
    CASE WHEN en <= 4 AND (k + tn + rn + en - 1) % 3 = 0 THEN 'Slot ' || rn || ',Live' ELSE '' END AS available, CASE WHEN en <= 4 AND (k + tn + rn + en - 1) % 3 = 0 THEN CASE WHEN rn % 2 = 0 THEN 'Slot ' || rn || ',' ELSE '' END || 'Live' ELSE '' END AS selected FROM se"""
ORACLES["p13_game_codes"] = _CHECKED + """ SELECT k AS p_partkey, CAST(row_number() OVER (PARTITION BY k ORDER BY tn, rn) - 1 AS INTEGER) AS place, trim(coalesce(cells[gt], '')) AS game_type, trim(coalesce(cells[gn], '')) AS game_name, trim(cells[gc]) AS game_code
    FROM loc JOIN lin USING (k, tn) WHERE rn > 0 AND len(cells) >= gc AND (trim(coalesce(cells[gn], '')) <> '' OR trim(cells[gc]) <> '')"""
_CAPABLE = ", ".join(f"({_quoted(c)}, {_quoted(ws)})" for c, ws in vendor_docs.CAPABILITIES.items())
ORACLES["p15_capability_profile"] = _CHECKED + rf""",
  par AS (SELECT k, j, CASE WHEN (k + j) % 4 = 0 THEN 'h2' ELSE 'p' END AS style, ([{', '.join(map(_quoted, SPOKEN))}])[(k * 3 + j * (1 + k % 5)) % {len(SPOKEN)} + 1] AS x FROM (SELECT p_partkey AS k, unnest(range(p_partkey % 5)) AS j FROM part)),
  num AS (SELECT *, style = 'h2' AS head, count(*) FILTER (WHERE style = 'h2') OVER (PARTITION BY k ORDER BY j) AS sn FROM par),
  con AS (SELECT *, row_number() OVER (PARTITION BY k, sn ORDER BY j) AS b FROM num WHERE NOT head),
  sec AS (SELECT k, sn, coalesce(max(x) FILTER (WHERE head), 'Overview') AS title, count(*) FILTER (WHERE NOT head) AS n FROM num GROUP BY k, sn QUALIFY n > 0 OR (sn = max(sn) OVER (PARTITION BY k) AND title <> 'Overview')){_ENDPOINTS},
  wc AS (SELECT k, string_agg(w || '=' || n, ',' ORDER BY w) AS keyword_counts FROM (SELECT k, w, count(*) AS n FROM (SELECT k, unnest(words) AS w FROM epw) GROUP BY k, w) GROUP BY k),
  cap AS (SELECT p_partkey AS k, c, len(list_filter(ws, lambda w: contains(lower(coalesce(body, '')), w))) > 0 AS said FROM part CROSS JOIN (VALUES {_CAPABLE}) v(c, ws) LEFT JOIN txt ON txt.k = p_partkey),
  own AS (SELECT k, capability AS c, arg_max(coalesce(enabled, true), place) AS own FROM se WHERE capability <> '' AND value <> '' GROUP BY k, capability),
  al AS (SELECT coalesce(cap.k, own.k) AS k, coalesce(cap.c, own.c) AS c, coalesce(own, said) AS yes, CASE WHEN own IS NULL THEN 'keyword' ELSE 'vendor_master_checklist' END AS origin FROM cap FULL JOIN own ON cap.k = own.k AND cap.c = own.c)
  SELECT al.k AS p_partkey, string_agg(c || '=' || yes, ',' ORDER BY c) AS supports, string_agg(c || '=' || origin, ',' ORDER BY c) AS origins, coalesce(any_value(keyword_counts), '') AS keyword_counts FROM al LEFT JOIN wc USING (k) GROUP BY al.k"""
_ROLE_OF = ", ".join(f"'{k}': '{v}'" for k, v in vendor_docs.ACTION_ROLES.items())
ORACLES["p17_actions"] = rf"""WITH l AS (SELECT k, j, ([{', '.join(map(_quoted, ACTION_LINES))}])[(k * 3 + j * (1 + k % 13) + (k * j) % 5) % {len(ACTION_LINES)} + 1] AS x FROM (SELECT p_partkey AS k, unnest(range(p_partkey % 31 + 1)) AS j FROM part)),
  w AS (SELECT *, last_value(CASE WHEN x LIKE '#%' THEN j END IGNORE NULLS) OVER (PARTITION BY k ORDER BY j) AS hj, last_value(CASE WHEN x LIKE '#%' THEN ltrim(x, '# ') END IGNORE NULLS) OVER (PARTITION BY k ORDER BY j) AS head,
      upper(regexp_extract(string_agg(x, ' ') OVER (PARTITION BY k ORDER BY j ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), '(?i)\b(GET|POST|PUT|DELETE|PATCH)\b', 1)) AS near, regexp_extract(x, '(?i)\baction\s*:\s*([A-Za-z][A-Za-z0-9_]*)', 1) AS a FROM l),
  f AS (SELECT * FROM w WHERE a <> '' QUALIFY row_number() OVER (PARTITION BY k, lower(a) ORDER BY j) = 1),
  n AS (SELECT *, CASE WHEN head IS NULL THEN CASE a WHEN 'betAndWin' THEN 'Bet And Win Action' WHEN 'CANCELwin2' THEN 'Cance Lwin 2 Action' ELSE 'Bet Action' END ELSE trim(regexp_replace(head, '[*_`?]+', '', 'g')) END AS name, coalesce(MAP {{{_ROLE_OF}}}[lower(a)], '') AS role FROM f),
  s AS (SELECT *, list_concat(CASE WHEN role <> '' THEN [role] ELSE [] END, regexp_extract_all(lower(name || ' ' || a), '[a-z][a-z0-9_]{{2,}}')) AS ws FROM n)
  SELECT k AS p_partkey, name AS api_name, CASE WHEN near <> '' THEN near ELSE 'POST' END AS method, 'action:' || a AS endpoint, role, array_to_string(list_filter(ws, lambda x, i: list_position(ws, x) = i)[1:12], ',') AS keywords,
    0.9::DOUBLE AS confidence, CAST(CASE WHEN j - hj <= 8 THEN hj ELSE j END AS INTEGER) AS line_no FROM s"""
