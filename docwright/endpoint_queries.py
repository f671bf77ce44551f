"""Registered queries of endpoints, with their SQL. The tables hold no interface documents, so each part stands for one, with lines chosen by its key."""

from __future__ import annotations

from pyspark.sql import functions as F

from docwright.case_queries import listed, one_of
from docwright.operators import endpoints
from docwright.oracles import ORACLES
from docwright.plans.spread import spread
from docwright.queries import query

PLACES = ["/v1/wallet/bet/", "{baseUri}/reverse/withdraw", "request:Wager", "keyword:nothing", "https://h.example/credit?x=1", "/games/list", "/play/BetAndResult", "/v2/transfer"]
NAMES = ["Refund", "", "Player Window", "GetBalance", "List of games"]
TEXTS = ["", "asks for the balance_now of a player, url path", "cancels what the response held"]
#: Line of a document; method, endpoint, label and role that it gives ("": the method of the rows below it).
LINES = [
    ("call POST /wallet/bet/7 now", "POST", "/wallet/bet/7", 0, 1), ("Endpoint: https://host.example/v1/credit?x=7.", "", "https://host.example/v1/credit?x=7", 1, 1),
    ("| post | **/games/list/7** |", "POST", "/games/list/7", 0, 0), ("see /api/v1/rollback/7", "", "/api/v1/rollback/7", 0, 1),
    ("| URL | {baseUri}/withdraw |", "", "{baseUri}/withdraw", 1, 1), ("nothing /here", "", "", 0, 0), ("Path:\n\nhttps://host.example/win/", "", "https://host.example/win/", 0, 1),
]
PARAMETER = {
    "name": ["Signature", "time", "items", "transactionId|amount", "designHash", "eventTimestamp"],
    "kind": ["String", "array<int>", "long", "Object map", "", "uuid", "Decimal(2)"],
    "description": ["sign of all", "", "unix time of the bet", "amount | TransactionId", "plain"],
    "required": ["Y", "no", " y if set ", "N when empty", "", "optional", "TRUE"],
    "remark": ["", "a|b", "amount"],
}


@query
def p16_endpoint_candidates(t, spark):
    """The endpoints of a document of each part: a heading for each third, a line, and a table row with a method for each second."""
    k = F.col("p_partkey")
    text = F.concat(
        F.when(k % 3 == 0, F.concat(F.lit("## 1.2 **"), "p_name", F.lit("**\n"))).otherwise("\n"),
        one_of([x[0] for x in LINES]), F.when(k % 2 == 0, "\n\n| **Method** | Put |").otherwise("\n\n"),
    )
    found = endpoints.candidates(spread(t("part").select("p_partkey", "p_name")).select("p_partkey", text.alias("text")), "p_partkey")
    return found.select("p_partkey", "line_no", "api_name", "method", "endpoint", "confidence", F.length("context").alias("n_context"))


@query
def p18_endpoint_roles(t, spark):
    return t("part").select("p_partkey", endpoints.role(one_of(PLACES), one_of(NAMES), one_of(TEXTS)).alias("role"))


@query
def p19_keywords(t, spark):
    made = t("part").select("p_partkey", one_of(PLACES).alias("e"), one_of(NAMES).alias("n"), F.concat_ws(" ", one_of(TEXTS), "p_name", "p_type").alias("c"))
    return made.select("p_partkey", F.array_join(endpoints.keywords(F.col("n"), F.col("e"), F.col("c")), ",").alias("keywords"))


@query
def p21_parameter_predicates(t, spark):
    given = t("part").select("p_partkey", *[one_of(v).alias(c) for c, v in PARAMETER.items()], one_of(PLACES).alias("endpoint"), one_of(["bet", "cancel_bet_x", None, "balance", ""]).alias("role"))
    said = endpoints.predicates(*[F.col(c) for c in PARAMETER])
    return given.select("p_partkey", *[c.alias(n) for n, c in said.items()], endpoints.is_rollback(F.col("role"), F.col("endpoint")).alias("is_rollback"))


@query
def f12_endpoint_context(t, spark):
    """Context, methods and keywords of a place named in the middle of each document."""
    needle = one_of(PLACES, "doc_id")
    half = (F.char_length("text") / 2).cast("int")
    text = F.concat(F.substring(F.col("text"), F.lit(1), half), F.lit(" post "), needle, F.lit(" GET\n"), needle, F.lit(" "), F.expr("substring(text, cast(char_length(text) / 2 as int) + 1)"))
    made = t("documents").filter("doc_id is not null and text is not null").select("doc_id", needle.alias("needle"), text.alias("text"))
    near = made.select("doc_id", "needle", "text", endpoints.context_around(F.col("text"), F.col("needle")).alias("context"))
    words = F.array_union(endpoints.context_keywords(F.col("needle")), endpoints.context_keywords(F.col("context")))
    return near.select("doc_id", "context", F.array_join(endpoints.methods_before(F.col("text"), F.col("needle")), ",").alias("methods"), F.array_join(words, ",").alias("keywords"))


_ROLES = ", ".join(f"('{k}', '{r}')" for k, r in endpoints.ROLES.items())
_WORDS = " ".join(f"WHEN contains(s, '{w}') THEN '{r}'" for w, r in endpoints.ROLE_WORDS)
_RESOLVED = f"""m(k, r) AS (VALUES {_ROLES}), i AS (SELECT *, lower(e) AS low, lower(n || ' ' || e || ' ' || c) AS s FROM g),
h AS (SELECT i.*, a.r AS r1, b.r AS r2, d.r AS r3, q.r AS r0 FROM i LEFT JOIN m a ON a.k = string_split(rtrim(string_split(low, '?')[1], '/'), '/')[-1]
  LEFT JOIN m b ON contains(low, '{{baseuri}}/') AND b.k = low LEFT JOIN m d ON d.k = lower(n) LEFT JOIN m q ON q.k = split_part(low, ':', 2)),
o AS (SELECT *, CASE WHEN low LIKE 'request:%' OR low LIKE 'keyword:%' THEN coalesce(r0, '') ELSE coalesce(r1, r2, r3, CASE {_WORDS} ELSE '' END) END AS role FROM h)"""
_FIELDS = ", ".join(f"{listed(v)} AS {c}" for c, v in PARAMETER.items())
_FOUND = ", ".join(f"({i}, {x[1]!r}, {x[2]!r}, {x[3]}, {x[4]}, {2 if x[0].startswith('Path') else 0})" for i, x in enumerate(LINES) if x[2])
_HAS = ", ".join(f"CASE WHEN contains(lower(%s), '{w}') THEN '{w.replace(' ', '_')}' END" for w in endpoints.CONTEXT_WORDS)
_TITLES = ["7 API", "Credit?x=7 API", "7 API", "7 API", "Withdraw API", "", "Win API"]
_SIZES = [len(x[0]) for x in LINES]
ORACLES.update({
    "p16_endpoint_candidates": f"""WITH f(i, m, e, label, r, down) AS (VALUES {_FOUND}), w AS (SELECT p_partkey AS k, p_name, f.* FROM part JOIN f ON f.i = p_partkey % {len(LINES)})
        SELECT k AS p_partkey, CAST(1 + down AS INTEGER) AS line_no, CASE WHEN k % 3 = 0 THEN p_name ELSE {listed(_TITLES, 'k')} END AS api_name,
          CASE WHEN m <> '' THEN m WHEN k % 2 = 0 THEN 'PUT' ELSE 'unknown' END AS method, e AS endpoint,
          round(least(0.95, 0.55 + CASE WHEN m <> '' OR k % 2 = 0 THEN 0.2 ELSE 0 END + 0.1 * label + 0.1 + 0.05 * r), 2)::DOUBLE AS confidence,
          CAST(CASE WHEN k % 3 = 0 THEN length(p_name) + 12 ELSE 1 END + ([{', '.join(map(str, _SIZES))}])[i + 1] + CASE WHEN k % 2 = 0 THEN 22 ELSE 2 END AS INTEGER) AS n_context FROM w""",
    "p18_endpoint_roles": f"""WITH g AS (SELECT p_partkey, {listed(PLACES)} AS e, {listed(NAMES)} AS n, {listed(TEXTS)} AS c FROM part), {_RESOLVED} SELECT p_partkey, role FROM o""",
    "p19_keywords": f"""WITH g AS (SELECT p_partkey, {listed(PLACES)} AS e, {listed(NAMES)} AS n, {listed(TEXTS)} || ' ' || p_name || ' ' || p_type AS c FROM part), {_RESOLVED},
        w AS (SELECT p_partkey, list_concat(list_filter([role], lambda x: x <> ''), list_filter(regexp_extract_all(s, '[a-z][a-z0-9_]{{2,}}'), lambda x: NOT list_contains({endpoints.STOP!r}, x))) AS ws FROM o)
        SELECT p_partkey, array_to_string(list_filter(ws, lambda x, i: list_position(ws, x) = i)[1:12], ',') AS keywords FROM w""",
    "p21_parameter_predicates": f"""WITH g AS (SELECT p_partkey, {_FIELDS}, {listed(PLACES)} AS endpoint, p_partkey % 5 = 1 AS cancels FROM part),
        l AS (SELECT *, lower(kind) AS k, lower(name) AS n, lower(description) AS d, upper(trim(required)) AS r, lower(name || ' ' || description || ' ' || remark) AS a FROM g)
        SELECT p_partkey, regexp_matches(n || ' ' || d, '(^|[^a-z])(hmac|signature|sign|hash|encrypt|decrypt)($|[^a-z])') AS is_encryption,
          a LIKE '%transactionid%' AND a LIKE '%amount%' AND a LIKE '%|%' AS is_pipe_amount, n LIKE '%timestamp%' OR n = 'time' OR d LIKE '%unix time%' OR d LIKE '%timestamp%' AS is_timestamp,
          k LIKE '%array%' OR k LIKE '%list%' AS is_array, k LIKE '%object%' OR k LIKE '%dict%' OR k LIKE '%map%' AS is_object,
          r IN ('N', 'NO', 'FALSE', '0', 'OPTIONAL') OR r LIKE 'N %' AS is_optional, r IN ('Y', 'YES', 'TRUE', '1', 'REQUIRED') OR r LIKE 'Y %' AS is_required,
          k LIKE '%string%' OR k LIKE '%uuid%' AS is_string, regexp_matches(k, 'int|long|float|decimal|number|double') AS is_numeric,
          cancels OR regexp_matches(lower(endpoint), 'rollback|refund|cancel') AS is_rollback FROM l""",
    "f12_endpoint_context": f"""WITH g AS (SELECT doc_id, {listed(PLACES, 'doc_id')} AS e, text AS x, CAST(floor(length(text) / 2) AS INTEGER) AS h FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
        j AS (SELECT doc_id, e, substr(x, 1, h) || ' post ' || e || ' GET' || chr(10) || e || ' ' || substr(x, h + 1) AS x FROM g),
        n AS (SELECT *, strpos(x, e) AS p FROM j), c AS (SELECT *, substr(x, greatest(1, p - 700), p + length(e) + 700 - greatest(1, p - 700)) AS context FROM n)
        SELECT doc_id, context, 'GET,POST' AS methods, array_to_string(list_concat(list_filter([{_HAS % (('e',) * 11)}], lambda w: w IS NOT NULL),
          list_filter([{_HAS % (('context',) * 11)}], lambda w: w IS NOT NULL AND NOT contains(replace(lower(e), ' ', '_'), w))), ',') AS keywords FROM c""",
})

#: Lines of documents: text, methods and cleaned endpoints written in it, whether a label stands before them, and the requests it names without an address
#: (name, endpoint, lines of context before and after, confidence, and the method where none is named: D the document's, P post, F always post).
TEXT_LINES: list[tuple[str, list[tuple[str, str]], int, list[tuple[str, str, int, int, float, str]]]] = [
    ("# 1.2 **Wallet** calls", [], 0, []), ("POST /v1/bet and get **/v1/win**", [("POST", "/v1/bet"), ("GET", "/v1/win")], 0, []), ("Endpoints https://h.e/v1/", [("", "https://h.e/v1/")], 0, []),
    ("Endpoints https://h.e/v1/ tail_part of it", [("", "https://h.e/v1/")], 0, []), ("| **Method** | Put |", [], 0, []), ("Source URL: https://x.y/z post /q", [], 0, []), ("see /api/v1/loose.", [("", "/api/v1/loose")], 0, []), ("the URL: /v3/x-y_z", [("", "/v3/x-y_z")], 1, []),
    ("Path:", [], 0, []), ("https://h.e/alone", [("", "https://h.e/alone")], 0, []), ("", [], 0, []), ("words that delete nothing", [], 0, []), ("WAGER and  RESULT", [], 0, [("Wager And Result", "request:wagerAndResult", 0, 12, 0.9, "D")]),
    ("HTTP Method: patch", [], 0, []), ("ask with request = getBalance2 here", [], 0, [("Get Balance 2", "request:getBalance2", 4, 8, 0.85, "D")]), ("## **Bet**", [], 0, [("Bet", "base", 0, 15, 0.9, "P")]),
    ("### Credit &  Refund", [], 0, [("Credit", "keyword:credit", 0, 24, 0.88, "P"), ("Refund", "keyword:refund", 0, 24, 0.88, "P")]), ("| x | Auth Token |", [], 0, [("Auth", "keyword:auth", 4, 8, 0.78, "F")]),
    ('"put /not/base"', [("PUT", "/not/base")], 0, []), ("nothing", [], 0, []), ("more words", [], 0, []), ("still more", [], 0, []),
]


@query
def p16_document_candidates(t, spark):
    """Endpoints and requests of documents of up to 40 lines, one a part; which lines follow one another depends on its key."""
    k = F.col("p_partkey")
    line = lambda j: F.get(F.array(*[F.lit(x[0]) for x in TEXT_LINES]), ((k * 5 + j * (2 + k % 17) + (k * j) % 7) % len(TEXT_LINES)).cast("int"))
    made = spread(t("part").select("p_partkey")).select("p_partkey", F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), k % 40), line), "\n").alias("text"))
    found = endpoints.candidates(made, "p_partkey")
    return found.select("p_partkey", "line_no", "api_name", "method", "endpoint", F.md5("context").alias("context"), "confidence")


def _string(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_TEXTS = ", ".join(f"({i}, {_string(x[0])}, {x[2]})" for i, x in enumerate(TEXT_LINES))
_WRITTEN = ", ".join(f"({i}, {n}, '{m}', '{e}')" for i, x in enumerate(TEXT_LINES) for n, (m, e) in enumerate(x[1]))
_MEANT = ", ".join(f"({i}, {10 + n}, '{a}', '{e}', {b}, {f}, {c}, '{d}')" for i, x in enumerate(TEXT_LINES) for n, (a, e, b, f, c, d) in enumerate(x[3]))
_ABOUT = lambda before, after, mark="' '": f"string_agg(x, {mark}) OVER (PARTITION BY k ORDER BY j ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING)"
_FRAMES = sorted({(b, f - 1) for x in TEXT_LINES for *_, b, f, _, _ in [(n, e, b, f, c, d) for n, e, b, f, c, d in x[3]]})
_LAST = "string_split(rtrim(endpoint, '/'), '/')[-1]"
ORACLES["p16_document_candidates"] = rf"""WITH v(i, x, label) AS (VALUES {_TEXTS}), w(i, n, m, e) AS (VALUES {_WRITTEN}), q(i, n, api, e, before, after, sure, other) AS (VALUES {_MEANT}),
  l AS (SELECT k, j, v.* FROM (SELECT p_partkey AS k, unnest(range(p_partkey % 40 + 1)) AS j FROM part) JOIN v ON i = (k * 5 + j * (2 + k % 17) + (k * j) % 7) % {len(TEXT_LINES)}),
  a AS (SELECT *, regexp_extract({_ABOUT(4, 7)}, '(?i)\b(GET|POST|PUT|PATCH|DELETE)\b', 1) AS near, upper(regexp_extract({_ABOUT(0, 7, 'chr(10)')}, '(?i)\|[^\S\n]*(?:\*\*)?Method(?:\*\*)?[^\S\n]*\|[^\S\n]*(GET|POST|PUT|PATCH|DELETE)[^\S\n]*\|', 1)) AS tabled,
      {_ABOUT(6, 7, 'chr(10)')} AS ctx, {', '.join(f"{_ABOUT(b, f, 'chr(10)')} AS c{b}_{f}" for b, f in _FRAMES)},
      coalesce(last_value(CASE WHEN x LIKE '#%' THEN regexp_extract(x, '^#+\s+(.+?)\s*$', 1) END IGNORE NULLS) OVER (PARTITION BY k ORDER BY j), '') AS heading,
      coalesce(last_value(nullif(trim(x), '') IGNORE NULLS) OVER (PARTITION BY k ORDER BY j ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), '') = 'Path:' AS labelled,
      coalesce(last_value(CASE WHEN x LIKE 'POST /v1%' THEN '/v1/bet' WHEN x LIKE 'Source%' THEN '/q' END IGNORE NULLS) OVER (PARTITION BY k ORDER BY j ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING), '/{{Partner_base_URL}}/Bet') AS base,
      bool_or(x LIKE 'HTTP Method%') OVER (PARTITION BY k) AS told FROM l),
  g AS (SELECT k, j, n, heading, label, coalesce(nullif(m, ''), nullif(tabled, ''), nullif(upper(near), ''), 'unknown') AS method, ctx,
      CASE WHEN e LIKE '%/' THEN e || ltrim(regexp_extract(ctx, '(?i)(?:Endpoints|端點地址)\s+https://h\.e/v1/\s+([A-Za-z][A-Za-z0-9_/-]*)', 1), '/') ELSE e END AS endpoint FROM a JOIN w USING (i) WHERE e <> 'https://h.e/alone' OR labelled),
  h AS (SELECT *, trim(regexp_replace(regexp_replace(heading, '[*_`]+', '', 'g'), '^\d+(?:\.\d+)*\s*', '')) AS plain, array_to_string([upper(y[1]) || lower(y[2:]) FOR y IN regexp_split_to_array({_LAST}, '[_\-.]+') IF y <> ''], ' ') || ' API' AS own FROM g)
  SELECT k AS p_partkey, CAST(j AS INTEGER) AS line_no, CASE WHEN plain <> '' THEN plain ELSE own END AS api_name, method, endpoint, md5(ctx) AS context,
    round(least(0.95, 0.55 + CASE WHEN method <> 'unknown' THEN 0.2 ELSE 0 END + 0.1 * label + 0.1 + CASE WHEN regexp_matches(lower(endpoint), 'bet|win|wager|result|credit|auth|refund') THEN 0.05 ELSE 0 END), 2)::DOUBLE AS confidence FROM h
  UNION ALL SELECT k, CAST(j AS INTEGER), api, CASE WHEN other = 'F' THEN 'POST' WHEN near <> '' THEN near WHEN other = 'P' THEN 'POST' WHEN told THEN 'PATCH' ELSE 'GET' END, CASE WHEN e = 'base' THEN base ELSE e END,
    md5(CASE before * 100 + after {' '.join(f"WHEN {b * 100 + f + 1} THEN c{b}_{f}" for b, f in _FRAMES)} END), sure::DOUBLE FROM a JOIN q USING (i)"""
