"""SQL for DuckDB of the operators that SQL can express; the others are held against brute force in tests."""

from __future__ import annotations

from docwright.llm import license_scan, url_filter


def _url_filter() -> str:
    events = ", ".join(f"('{e}', '{c}', '{a}', DATE '{d}', {n})" for e, c, a, d, n in url_filter.LIST)
    return f"""WITH ev AS (SELECT * FROM (VALUES {events}) v(entry, category, action, since, seq)),
      sp AS (SELECT *, coalesce(lead(since) OVER (PARTITION BY entry, category ORDER BY since, seq), DATE '9999-12-31') AS until FROM ev),
      ac AS (SELECT entry, category, since, until, split_part(entry, '/', 1) AS domain,
        CASE WHEN strpos(entry, '/') > 0 THEN substr(entry, strpos(entry, '/') + 1) ELSE '' END AS prefix FROM sp WHERE action = 'add' AND since < until),
      c AS (SELECT page_id, url, nullif(rtrim(lower(regexp_extract(url, '{url_filter.HOST}', 1)), '.'), '') AS host,
        regexp_extract(url, '{url_filter.PATH}', 1) AS path, CAST(DATE '2024-01-01' + CAST(page_id % 730 AS INTEGER) AS DATE) AS fetch_day FROM pages),
      h AS (SELECT page_id, entry, category FROM c JOIN ac ON (host = domain OR ends_with(host, '.' || domain)) AND since <= fetch_day AND fetch_day < until
        AND (prefix = '' OR path = prefix OR starts_with(path, prefix || '/'))
        QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(entry) DESC, entry, category) = 1)
      SELECT page_id, url, host, fetch_day, entry IS NOT NULL AS blocked, entry, category FROM c LEFT JOIN h USING (page_id)"""


def _license_scan() -> str:
    """The operator's program without look-arounds: marks are doubled, and identifiers have their own spaces, so that neighbours share none."""
    ls = license_scan
    known = ", ".join(f"('{ls.normalised(s)}', '{i}')" for i, s in ls.SENTENCES)
    any_of = "|".join(map(ls.wrapped, sorted((s for _, s in ls.SENTENCES), key=lambda s: -len(ls.normalised(s)))))
    named = [ls.normalised(s).split(ls.HOLDER) for _, s in ls.SENTENCES if ls.HOLDER in ls.normalised(s)]
    holders = " ".join(f"WHEN starts_with(one, '{a}') AND ends_with(one, '{z}') THEN '{a}{ls.HOLDER}{z}'" for a, z in named)
    joined = "  ".join
    granting = "|".join(joined(ids) for _, kind, ids in ls.RULES if kind != "restricted")

    def hit(name: str, ids: list[str]) -> str:
        left = "line"
        for other, _, longer in ls.RULES:
            if other != name and longer[: len(ids)] == ids and len(longer) > len(ids):
                left = f"replace({left}, ' {joined(longer)} ', ' - ')"
        return f"contains({left}, ' {joined(ids)} ')"

    hits = lambda place, want: " OR ".join(hit(r[0], r[2]) for r in ls.RULES if r[place] == want)
    listed = ", ".join(f"CASE WHEN {hits(0, n)} THEN '{n}' END" for n in dict.fromkeys(name for name, _, _ in ls.RULES))
    strict = " ".join(f"WHEN {hits(1, k)} THEN '{k}'" for k in ("restricted", "copyleft", "permissive"))
    return rf"""WITH t AS (SELECT doc_id, row_number() OVER () AS rid, replace(replace(coalesce(text, ''), chr(2), ' '), chr(3), ' ') AS x FROM documents),
      c AS (SELECT doc_id, rid, regexp_replace(regexp_replace(x, '(?m)^[\x20\t]*(?i:dnl|rem)([\x20\t\r\n])', '\1', 'g'), '[.!?:]+([\x20\x09-\x0D]|$)', chr(3) || '\1', 'g') AS x FROM t),
      m AS (SELECT doc_id, rid, regexp_replace(lower(replace(regexp_replace(x, '(?:\n[^\p{{L}}\p{{N}}\n]*)+\n', chr(1) || chr(10), 'g'), chr(10), chr(2))), '[^\p{{L}}\p{{N}}\x01-\x03]+', ' ', 'g') AS x FROM c),
      f AS (SELECT doc_id, rid, regexp_extract_all(regexp_replace(x, '([\x01-\x03])', '\1\1', 'g'), '(?:^|[\x01-\x03])\x20?({any_of})(?:\x20?(?:[\x01-\x03]|$))', 1) AS ms FROM m),
      e AS (SELECT rid, n, trim(regexp_replace(w, '[\x20\x01-\x03]+', ' ', 'g')) AS whole FROM (SELECT rid, unnest(ms) AS w, generate_subscripts(ms, 1) AS n FROM f)),
      b AS (SELECT *, regexp_replace(whole, '^{ls.SUBJECT}({'|'.join(ls.VERBS)})', '\1') AS one FROM e),
      v(p, id) AS (VALUES {known}),
      k AS (SELECT rid, n, coalesce(v1.id, v2.id) AS id FROM b LEFT JOIN v v1 ON v1.p = CASE {holders} ELSE one END LEFT JOIN v v2 ON v2.p = whole),
      g AS (SELECT rid, count(*) AS n, string_agg(id, ',' ORDER BY k.n) AS ids, string_agg(' ' || id || ' ', '' ORDER BY k.n) AS ln FROM k GROUP BY rid),
      a AS (SELECT doc_id, coalesce(n, 0) AS n_known, coalesce(ids, '') AS sentence_ids, regexp_replace(coalesce(ln, ''), '(?:\x20{ls.RESERVED}\x20)+(\x20(?:{granting})\x20)', '\1', 'g') AS line FROM t LEFT JOIN g USING (rid))
      SELECT doc_id, n_known, sentence_ids, concat_ws(',', {listed}) AS licenses, CASE {strict} ELSE 'none' END AS license_class FROM a"""


def _filter_audit() -> str:
    return r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
      l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
      f AS (SELECT part, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t),
          regexp_matches(t, '[#$%&*|]'), coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)] AS bad, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
        FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
      m AS (SELECT part, bad, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS x FROM f GROUP BY part, bad),
      v AS (SELECT unnest(range(1, 6)) AS i),
      o AS (SELECT [a.i, b.i, c.i, e.i, h.i] AS ord FROM v a, v b, v c, v e, v h WHERE len(list_distinct([a.i, b.i, c.i, e.i, h.i])) = 5),
      s AS (SELECT ord, i AS step, ord[i] AS f, ord[:i - 1] AS before FROM o, v),
      r AS (SELECT part, ord, step, f,
          sum(CASE WHEN NOT bad[f] AND coalesce(list_sum([bad[j]::INT FOR j IN before]), 0) = 0 THEN n ELSE 0 END) AS kept,
          sum(CASE WHEN bad[f] AND coalesce(list_sum([bad[j]::INT FOR j IN before]), 0) = 0 THEN n ELSE 0 END) AS removed,
          sum(CASE WHEN bad[f] AND coalesce(list_sum([bad[j]::INT FOR j IN before]), 0) > 0 THEN n ELSE 0 END) AS redundant,
          sum(CASE WHEN bad[f] AND list_sum([b::INT FOR b IN bad]) = 1 THEN n ELSE 0 END) AS unique_fails,
          sum(CASE WHEN bad[f] AND coalesce(list_sum([bad[j]::INT FOR j IN before]), 0) = 0 THEN g ELSE 0 END) AS good_lost,
          sum(CASE WHEN bad[f] AND coalesce(list_sum([bad[j]::INT FOR j IN before]), 0) = 0 THEN x ELSE 0 END) AS toxic_lost
        FROM m, s GROUP BY part, ord, step, f)
      SELECT part, array_to_string([substr('ABCDE', j::INT, 1) FOR j IN ord], '') AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept,
        CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
        CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r"""


ORACLES = {"op3_url_filter": _url_filter(), "op10_license_scan": _license_scan(), "op11_filter_audit": _filter_audit()}
