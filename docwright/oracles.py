"""SQL for DuckDB that gives the rows of the registered queries, by another road than the DataFrame code."""

from __future__ import annotations

from docwright.operators.rules import LOOSE, PRIMARY, TAGS

NL = "chr(10)"
HEADING = "^[A-Z][^.]{0,40}$"
LINES = f"""l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no
  FROM (SELECT doc_id, string_split(coalesce(text, ''), {NL}) AS ls FROM documents))"""
PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
SNAPSHOTS = """a AS (SELECT c_custkey, c_mktsegment, sha1(c_mktsegment) AS digest, c_custkey + 1 AS number FROM customer WHERE c_custkey % 3 <> 0),
b AS (SELECT c_custkey, s AS c_mktsegment, sha1(s) AS digest
  FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'NEW' ELSE c_mktsegment END AS s FROM customer WHERE c_custkey % 4 <> 0))"""


def tag_pattern(keywords: list[str]) -> str:
    """One pattern a tag: loose keywords anywhere, the others as whole words."""
    whole = "|".join(k for k in keywords if not LOOSE.search(k))
    parts = [rf"(?:^|[^\p{{L}}\p{{N}}_])(?:{whole})(?:$|[^\p{{L}}\p{{N}}_])"] if whole else []
    return "|".join([*parts, *(k for k in keywords if LOOSE.search(k))])


_FOUND = ", ".join(f"CASE WHEN regexp_matches(lower(text), '{tag_pattern(w)}') THEN '{tag}' END" for tag, w in sorted(TAGS.items()))
TAGGED = f"""f AS (SELECT doc_id, lang, list_filter([{_FOUND}], lambda x: x IS NOT NULL) AS found FROM documents),
g AS (SELECT doc_id, lang, CASE WHEN len(found) > 0 THEN found ELSE ['unclassified'] END AS tags FROM f)"""
_FIRST = " ".join(f"WHEN list_contains(tags, '{p}') THEN '{p}'" for p in PRIMARY)
_STRIPPED = "html"
for _tag in ("script", "style", "nav", "footer", "aside"):
    _STRIPPED = f"regexp_replace({_STRIPPED}, '(?is)<{_tag}[ >].*?</{_tag}>', ' ', 'g')"


def _slug(x: str) -> str:
    return f"coalesce(nullif(trim(regexp_replace(lower(trim({x})), '[^a-z0-9一-鿿]+', '_', 'g'), '_'), ''), 'unclassified')"


ORACLES = {
    "f01_clean_text": f"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', {NL}, 'g'), '[ \t]+', ' ', 'g'),
        ' ?\n ?', {NL}, 'g'), '\n{{3,}}', {NL} || {NL}, 'g'), ' ' || {NL}) AS cleaned FROM documents""",
    "f02_labels": "SELECT conv_id, turn, role AS label, trim(text, ' \t\r\n') AS value FROM conversations",
    "f04_slugs": f"""SELECT p_partkey, {_slug("p_name || ' / ' || p_brand")} AS slug FROM part""",
    "f05_url_names": f"""SELECT page_id, host, split_part(host, '.', 1) AS vendor, path FROM
        (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, {PATH} AS path FROM pages)""",
    "f06_drop_empty": """SELECT c_custkey, concat_ws(',', 'name=' || c_name, CASE WHEN c_mktsegment <> 'BUILDING' THEN 'segment=' || c_mktsegment END,
        CASE WHEN c_acctbal < 0 THEN 'debt=yes' END) AS kept FROM customer""",
    "f07_content_hash": """SELECT o_orderkey, sha256(concat_ws('|', o_orderkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(15,2)), o_orderpriority))
        AS content_hash FROM orders""",
    "f08_stable_keys": f"""SELECT o_orderkey, concat_ws('::', 'param', {_slug("o_orderpriority")}, {_slug("o_orderstatus")},
        substr(sha1(o_orderpriority || '|' || o_orderstatus), 1, 8)) AS stable_key FROM orders""",
    "f09_json_props": """SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, max(k) AS most FROM
        (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type""",
    "f10_query_params": """WITH q AS (SELECT page_id, list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: length(x) > 0) AS ps FROM pages),
        e AS (SELECT page_id, unnest(ps) AS pair, generate_subscripts(ps, 1) AS pos FROM q)
        SELECT page_id, split_part(pair, '=', 1) AS name, arg_max(regexp_extract(pair, '=(.*)$', 1), pos) AS value FROM e GROUP BY 1, 2""",
    "f12_context_window": """SELECT doc_id, substr(text, greatest(1, n - 70), 140) AS context FROM
        (SELECT doc_id, text, strpos(lower(text), 'license') AS n FROM documents) WHERE n > 0""",
    "f16_account_stamp": """SELECT c_custkey, rpad(substr(regexp_replace(lower(c_mktsegment), '[^a-z]', '', 'g'), 1, 3), 3, 'x') || '260817' AS account FROM customer""",
    "f18_decimal_boundary": """SELECT p_partkey, '100.' || substr('123456789123456789', 1, p_size % 9) AS valid,
        '100.' || substr('123456789123456789', 1, p_size % 9 + 1) AS invalid FROM part""",
    "g01_tag_counts": f"WITH {TAGGED} SELECT lang, tag, count(*) AS n FROM (SELECT lang, unnest(tags) AS tag FROM g) GROUP BY lang, tag",
    "g02_chunks": f"""SELECT {_slug("source")} AS chunk, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, min(doc_id) AS first_id, max(doc_id) AS last_id
        FROM documents GROUP BY 1""",
    "g03_field_presence": f"""SELECT role, bool_or(length(text) > 0) AS has_text, bool_or(turn > 3) AS has_late_turn, bool_or(strpos(text, {NL}) > 0) AS has_lines
        FROM conversations GROUP BY role""",
    "g04_profile": """SELECT p_brand, CAST(max(len(string_split(p_type, ' '))) AS INTEGER) AS depth, count(*) AS n, count(DISTINCT p_type) AS n_types,
        min(p_name) AS first_name FROM part GROUP BY p_brand""",
    "g05_case_profile": """SELECT CAST(year(l_shipdate) AS INTEGER) AS year, l_returnflag, count(*) AS n, count(*) FILTER (WHERE l_discount > 0.05) AS n_discounted,
        string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS statuses FROM lineitem GROUP BY 1, 2""",
    "g06_topology": """SELECT user_id, n_purchase, has_error, CASE WHEN n_purchase >= 2 THEN 'two' WHEN n_purchase = 1 THEN 'one' ELSE 'missing' END AS mode FROM
        (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS n_purchase, bool_or(event_type = 'error') AS has_error FROM events GROUP BY user_id)""",
    "g07_summary": """SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 100) AS n_over, count(DISTINCT user_id) AS n_users FROM events GROUP BY event_type""",
    "g08_reconcile": """SELECT lang, count(*) AS n_unlabelled, min(doc_id) AS first_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY lang""",
    "j01_positional_zip": """WITH a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events),
        b AS (SELECT o_custkey AS user_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders)
        SELECT user_id, CAST(place AS INTEGER) AS place, event_id, o_orderkey FROM a JOIN b USING (user_id, place)""",
    "j02_wildcard_paths": f"""WITH p AS (SELECT DISTINCT path, list_filter(string_split(lower(path), '/'), lambda s: s <> '') AS ps FROM (SELECT {PATH} AS path FROM pages)),
        r AS (SELECT rule, ord, string_split(seg, '/') AS rs FROM (VALUES ('english_page', 'en/{{}}', 1), ('spanish_page', 'es/{{}}', 2),
          ('numbered_page', '{{}}/{{}}', 3)) v(rule, seg, ord)),
        m AS (SELECT path, arg_min(rule, ord) AS rule FROM p, r WHERE len(ps) > 0 AND len(list_filter(range(1, least(len(ps), len(rs)) + 1),
          lambda i: NOT (ps[-i] = rs[-i] OR ps[-i] = '{{}}' OR rs[-i] = '{{}}'))) = 0 GROUP BY path)
        SELECT page_id, x.path, rule FROM (SELECT page_id, {PATH} AS path FROM pages) x LEFT JOIN m USING (path)""",
    "j03_longest_text": """WITH b AS (SELECT s_nationkey AS code, max(s_name) AS context, min(s_suppkey) AS response FROM supplier GROUP BY 1)
        SELECT coalesce(n_nationkey, code) AS code, CASE WHEN length(coalesce(context, '')) > length(coalesce(n_name, '')) THEN context ELSE n_name END AS context,
        response FROM nation FULL JOIN b ON n_nationkey = code""",
    "j04_upsert": f"""WITH {SNAPSHOTS}, f AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) + (SELECT max(number) FROM a) AS number
          FROM b WHERE c_custkey NOT IN (SELECT c_custkey FROM a))
        SELECT a.c_custkey, number, coalesce(b.c_mktsegment, a.c_mktsegment) AS c_mktsegment, coalesce(b.digest, a.digest) AS digest FROM a LEFT JOIN b USING (c_custkey)
        UNION ALL SELECT c_custkey, number, c_mktsegment, digest FROM f JOIN b USING (c_custkey)""",
    "j05_change_stats": f"""WITH {SNAPSHOTS} SELECT status, count(*) AS n FROM (SELECT CASE WHEN a.c_custkey IS NULL THEN 'new' WHEN b.c_custkey IS NULL THEN 'kept'
        WHEN a.digest = b.digest THEN 'unchanged' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.c_custkey = b.c_custkey) GROUP BY status""",
    "j06_overlay": """WITH o AS (SELECT o_orderkey, o_orderstatus, o_orderpriority AS p, CASE WHEN o_orderkey % 5 = 0 THEN '0-HUMAN' ELSE o_orderpriority END AS h,
          o_orderkey % 11 <> 0 AS based, o_orderkey % 7 <> 0 AS human, o_orderkey % 2 = 0 AS had FROM orders)
        SELECT o_orderkey, CASE WHEN human THEN h ELSE p END AS o_orderpriority, o_orderstatus,
        CASE WHEN NOT based THEN 'added' WHEN NOT human THEN 'kept' WHEN p <> h THEN 'overridden' ELSE 'same' END AS status,
        CASE WHEN based AND human AND p <> h THEN 'o_orderpriority' ELSE '' END AS overridden FROM o WHERE human OR (based AND NOT had)""",
    "j08_preferred": """SELECT c_mktsegment, c_nationkey, arg_min(c_custkey, CAST(r AS BIGINT) * 1000000000 + c_custkey) AS c_custkey, min(r) AS rank FROM (SELECT *,
        CASE WHEN c_acctbal > 5000 THEN 1 WHEN c_acctbal > 0 THEN 2 ELSE 3 END AS r FROM customer) GROUP BY 1, 2""",
    "j09_append_absent": """SELECT DISTINCT c_nationkey AS nation, c_mktsegment AS segment FROM customer WHERE c_nationkey < 10
        UNION SELECT n_nationkey, 'FURNITURE' FROM nation""",
    "j11_coverage": """SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
        AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 10)""",
    "j12_decreases": """SELECT * FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority, count(*) AS "before",
        count(*) FILTER (WHERE o_orderkey % 8 <> year(o_orderdate) % 8) AS now FROM orders GROUP BY 1, 2) WHERE "before" - now > 0.1 * "before" """,
    "j13_overlap": """SELECT p_partkey, CAST(n AS INTEGER) AS n_keys FROM (SELECT p_partkey, len(list_distinct(list_intersect(
        list_concat(string_split(p_type, ' '), string_split(p_name, ' '), [p_brand]), ['ECONOMY', 'widget', 'Brand#13']))) AS n FROM part) WHERE n > 0""",
    "o02_mixed_codes": """SELECT p_partkey, code, row_number() OVER (ORDER BY n IS NULL, n, code, p_partkey) AS place FROM (SELECT *, TRY_CAST(code AS BIGINT) AS n
        FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS VARCHAR) ELSE p_brand END AS code FROM part))""",
    "p01_topic_paths": """WITH n AS (SELECT n_nationkey, r_name || ' > ' || n_name AS p FROM nation JOIN region ON n_regionkey = r_regionkey),
        c AS (SELECT *, p || ' > Case： ' || c_name AS q FROM customer JOIN n ON c_nationkey = n_nationkey)
        SELECT 'r' || r_regionkey AS topic_id, 0 AS depth, r_name AS path FROM region UNION ALL SELECT 'n' || n_nationkey, 1, p FROM n
        UNION ALL SELECT 'c' || c_custkey, 2, q FROM c UNION ALL SELECT 's' || c_custkey, 3, q || ' > 标签：first ' || c_mktsegment FROM c
        UNION ALL SELECT 'u' || c_custkey, 3, q || ' > 标签: ' || c_mktsegment FROM c WHERE c_custkey % 2 = 0
        UNION ALL SELECT 'p' || c_custkey, 3, q || ' > 前置条件： /api/' || lower(c_mktsegment) FROM c""",
    "p03_cases": """SELECT 'c' || c_custkey AS topic_id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'first ' || c_mktsegment END AS labels,
        '/api/' || lower(c_mktsegment) AS precondition FROM customer""",
    "p05_keyword_tags": f"""WITH {TAGGED} SELECT doc_id, array_to_string(tags, ',') AS tags, CASE {_FIRST} ELSE tags[1] END AS primary_tag FROM g""",
    "p06_evidence": f"""WITH e AS (SELECT conv_id, turn, unnest(ls) AS s, generate_subscripts(ls, 1) AS pos FROM
          (SELECT conv_id, turn, string_split(text, {NL}) AS ls FROM conversations)),
        d AS (SELECT conv_id, turn, s, min(pos) AS pos FROM e WHERE regexp_matches(lower(s), 'error|note:|the |license|record') GROUP BY 1, 2, 3),
        a AS (SELECT conv_id, turn, count(*) AS n, string_agg(s, {NL} ORDER BY pos) AS evidence FROM d GROUP BY 1, 2)
        SELECT conv_id, turn, CAST(coalesce(n, 0) AS INTEGER) AS n, coalesce(evidence, '') AS evidence FROM conversations LEFT JOIN a USING (conv_id, turn)""",
    "p07_sections": f"""WITH {LINES}, s AS (SELECT *, sum(CASE WHEN regexp_matches(line, '{HEADING}') THEN 1 ELSE 0 END)
          OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM l)
        SELECT doc_id, CAST(section AS BIGINT) AS section, CASE WHEN section = 0 THEN 'Overview' ELSE arg_min(line, line_no) END AS title,
        CAST(min(line_no) AS INTEGER) AS "start", count(*) AS n_lines FROM s GROUP BY doc_id, section""",
    "p16_line_context": f"""WITH {LINES}, w AS (SELECT *, string_agg(line, {NL}) OVER (PARTITION BY doc_id ORDER BY line_no
          ROWS BETWEEN 6 PRECEDING AND 7 FOLLOWING) AS context FROM l)
        SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, context FROM w WHERE regexp_matches(lower(line), 'license|licence')""",
    "p18_roles": f"""SELECT page_id, segment, CASE segment WHEN 'de' THEN 'german' WHEN 'es' THEN 'spanish' WHEN 'fr' THEN 'french' WHEN 'en' THEN 'english'
        ELSE 'supporting_page' END AS role FROM (SELECT page_id, lower(regexp_extract({PATH}, '^/([^/]+)', 1)) AS segment FROM pages)""",
    "p19_confidence": """SELECT page_id, round(least(0.95::DOUBLE, 0.55::DOUBLE + CASE WHEN html LIKE '%<article%' THEN 0.2 ELSE 0 END
        + CASE WHEN html LIKE '%<table%' THEN 0.1 ELSE 0 END + CASE WHEN html LIKE '%<nav%' THEN 0.1 ELSE 0 END
        + CASE WHEN url LIKE '%?%' THEN 0.05 ELSE 0 END), 2) AS confidence FROM pages""",
    "p20_path_segments": "SELECT p_partkey, ' ' || lower(p_type || ' ' || p_name) || ' ' LIKE '% economy small %' AS matches FROM part",
    "p21_predicates": """SELECT p_partkey, ' ' || lower(p_type) || ' ' SIMILAR TO '.* (small|medium|large) .*' AS is_sized, lower(p_type) IN ('economy', 'standard') AS is_plain,
        p_size <= 10 AS is_optional, regexp_matches(p_name, '(^|[^a-z])(widget|gear)([^a-z]|$)') AS is_object FROM part""",
    "w01_keep_first": """SELECT user_id, event_type, event_id FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""",
    "w01_best": """SELECT o_custkey, o_orderkey, o_orderstatus FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) = 1""",
    "w02_headings": f"""WITH {LINES}, w AS (SELECT *, last_value(CASE WHEN regexp_matches(line, '{HEADING}') THEN line END IGNORE NULLS)
          OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM l)
        SELECT doc_id, heading, count(*) AS n_lines, CAST(max(line_no) AS INTEGER) AS last_line FROM w GROUP BY doc_id, heading""",
    "c01_dependency_rules": """WITH p AS (SELECT p_brand || '/' || right(CAST(p_partkey AS VARCHAR), 1) AS endpoint, p_partkey AS k, p_size FROM part),
        closed AS (SELECT endpoint FROM p WHERE k % 97 = 2 AND k % 4 NOT IN (0, 1)),
        r AS (SELECT endpoint, 0 AS ord, 'mode' AS selector, 'in [A,B]' AS condition, 'required' AS state, NULL AS "constraint", 'BAD_' || p_size AS error FROM p WHERE k % 4 = 0
          UNION ALL SELECT endpoint, 1, NULL, 'otherwise', 'forbidden', NULL, 'BAD_' || p_size FROM p WHERE k % 4 = 0
          UNION ALL SELECT endpoint, 0, 'mode', 'present', 'required', 'value >= 3', 'E1' FROM p WHERE k % 4 = 1)
        SELECT endpoint, 'mode' AS name, ord, selector, condition, state, "constraint", error, count(*) AS n FROM r
        WHERE endpoint NOT IN (SELECT endpoint FROM closed) GROUP BY ALL""",
    "c02_routes": """SELECT p_partkey, CASE WHEN p_name LIKE '%bolt%' AND p_size < 5 THEN 'excluded' WHEN p_type = 'ECONOMY' THEN 'economy'
        WHEN p_name LIKE 'small %' THEN 'small' WHEN p_retailprice > 950 THEN 'dear' ELSE 'unmapped' END AS target,
        CASE WHEN p_name LIKE '%bolt%' AND p_size < 5 THEN 'R1' WHEN p_type = 'ECONOMY' THEN 'R2' WHEN p_name LIKE 'small %' THEN 'R3'
        WHEN p_retailprice > 950 THEN 'R4' ELSE 'none' END AS rule_id FROM part""",
    "c04_categories": """SELECT p_partkey, concat_ws(',', 'balance', 'launch', CASE WHEN p_name LIKE '%gear' THEN 'live' END, CASE WHEN p_type = 'PROMO' THEN 'promo' END,
        CASE WHEN p_size > 25 THEN 'slots' END) AS categories FROM part""",
    "c06_errors": """SELECT p_brand, p_partkey, tier FROM (SELECT *, CASE WHEN p_name LIKE 'small %' THEN 1 WHEN p_type = 'PROMO' THEN 2 END AS tier FROM part)
        WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY tier, p_partkey) = 1""",
    "c10_steps": """SELECT p_partkey, step_no, kind, p_name || ' - ' || step AS title FROM (SELECT *, CASE WHEN p_size % 5 = 0 THEN 'array'
        WHEN p_type = 'ECONOMY' THEN 'amount' ELSE 'string' END AS kind FROM part) JOIN (VALUES ('string', 1, 'missing'), ('string', 2, 'empty'),
        ('string', 3, 'wrong type'), ('amount', 1, 'missing'), ('amount', 2, 'negative'), ('amount', 3, 'too many decimals'), ('amount', 4, 'zero'),
        ('array', 1, 'missing'), ('array', 2, 'empty list')) s(kind, step_no, step) USING (kind)""",
    "c14_reword": """SELECT doc_id, regexp_replace(regexp_replace(text, '\\bthe\\b', 'Debit', 'gi'), '\\b(settle|and)\\b', 'Credit', 'gi') AS text FROM documents""",
    "c17_issues": f"""SELECT conv_id, turn, 'error' AS severity, '$.text' AS path FROM conversations WHERE length(text) < 40
        UNION ALL SELECT conv_id, turn, 'warning', '$.role' FROM conversations WHERE role = 'system' UNION ALL SELECT conv_id, turn, 'error', '$.turn'
        FROM conversations WHERE turn > 6 UNION ALL SELECT conv_id, turn, 'warning', '$.text.lines' FROM conversations WHERE strpos(text, {NL}) = 0""",
    "c19_change_gate": """SELECT o_custkey, CASE WHEN b = 0 THEN 'full' WHEN b = n AND one THEN 'skip_equal' WHEN b = n THEN 'raw_only' WHEN n < b THEN 'preserve_decrease'
        ELSE 'incremental' END AS decision FROM (SELECT o_custkey, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS b, count(*) FILTER (WHERE o_orderkey % 2 = 1) AS n,
        min(o_orderstatus) = max(o_orderstatus) AS one FROM orders GROUP BY o_custkey)""",
}
