"""Endpoints in documents: candidates of lines, their roles, keywords and confidence, the text around them, and predicates over parameters.

Null texts are empty; a text or line without an endpoint gives no row or an empty value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwright.functions.text import let

#: Role of a last segment, request, name or whole path.
ROLES = {
    "authenticate": "authentication", "auth": "authentication", "gen-signature": "authentication", "gensignature": "authentication", "getaccount": "authentication",
    "getbalance": "balance", "balance": "balance", "wallet": "balance",
    "bet": "bet", "debit": "bet", "revision": "rollback", "wager": "bet", "wagerbybatch": "bet",
    "settle": "settlement", "settlement": "settlement", "credit": "settlement", "result": "settlement", "win": "settlement",
    "betandresult": "bet_and_settle", "wagerandresult": "bet_and_settle",
    "cancel": "rollback", "cancelbet": "rollback", "rollback": "rollback", "reversewin": "rollback", "rollbackrollback": "rollback", "refund": "rollback",
    "{baseuri}/authenticate": "authentication", "{baseuri}/defence-code": "refresh_token", "{baseuri}/terminate": "terminate_session", "{baseuri}/balance": "balance",
    "{baseuri}/debit": "bet", "{baseuri}/withdraw": "bet", "{baseuri}/credit": "settlement", "{baseuri}/deposit": "settlement", "{baseuri}/reverse/withdraw": "rollback",
}
#: Words looked for last, in order, and their roles.
ROLE_WORDS = [
    ("debit", "bet"), ("revision", "rollback"), ("credit", "settlement"), ("refund", "rollback"), ("auth", "authentication"), ("bet", "bet"), ("wager", "bet"),
    ("settle", "settlement"), ("win", "settlement"), ("result", "settlement"), ("cancel", "rollback"), ("rollback", "rollback"), ("balance", "balance"), ("authenticate", "authentication"),
]
#: Words that are no keywords; keywords of a context; methods; characters of a path; headings that name nothing.
STOP = ["api", "http", "https", "request", "response", "endpoint", "method", "path", "url"]
CONTEXT_WORDS = ["balance", "bet", "settle", "result", "rollback", "cancel", "auth", "token", "jackpot", "free spin", "adjustment"]
METHODS = "GET|POST|PUT|PATCH|DELETE"
PATH_CHARS = r"A-Za-z0-9_./{}:?\-&=%"
GENERIC = ["endpoint", "endpoints", "request", "response", "request body", "response body"]
#: Pattern, group of the method (0: none) and of the endpoint; the last only where no other is found.
FAMILIES = [
    (rf"\b({METHODS})\s+\*{{0,2}}(/[{PATH_CHARS}]+)\*{{0,2}}", 1, 2),
    (rf"\b({METHODS})\s+(https?://[^\s|<>`]+)", 1, 2),
    (rf"\b(?:endpoint|endpoints|url|path|端點地址)\s*[:：\s]*(?:({METHODS})\s+)?(https?://[^\s|<>`]+|(?:\{{baseUri\}}|\{{Interface-URL\}})/[{PATH_CHARS}]+|/[{PATH_CHARS}]+)", 1, 2),
    (rf"\|\s*(?:({METHODS})|(?:\*\*)?URL(?:\*\*)?)\s*\|\s*\*{{0,2}}((?:\{{baseUri\}}|https?://[^/\s|<>]+)?/[{PATH_CHARS}]+)\*{{0,2}}\s*\|", 1, 2),
]
BARE = (rf"(?<![\w.])(/api/[{PATH_CHARS}]+)", 0, 1)
LABEL_LINE = r"(?iU)^(?:path|endpoint|endpoints|url|端點地址)\s*[:：]?\s*$"
#: Lines around a candidate, and those before it that may name its method.
BEFORE, AFTER, METHOD_BEFORE = 6, 7, 4
#: First lines that may name the document's method, lines above a heading that may name its address.
HEAD_LINES, BASE_BEFORE = 80, 40
#: Headings of transactions with the requests they stand for; headings of requests that share an address.
TRANSACTIONS = {
    "get account": "getaccount", "get balance": "getbalance", "wager": "wager", "result": "result", "wager and result": "wagerAndResult", "rollback": "rollback", "jackpot": "jackpot",
    "rollback on result": "reversewin", "rollback on rollback": "rollbackrollback", "bet by batch": "wagerbybatch",
}
SEAMLESS = ["GetBalance", "Bet", "Win", "Refund", "Rollback", "Settle"]
RADIUS = 700


def _role_of(value: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair]), value)


def role(endpoint: Column, api_name: Column | None = None, context: Column | None = None) -> Column:
    """The role by the request's name, the last segment, the whole path, the API's name, or else the first known word; empty if none."""
    name = F.lit("") if api_name is None else F.coalesce(api_name, F.lit(""))
    around = F.lit("") if context is None else F.coalesce(context, F.lit(""))
    given = F.coalesce(endpoint, F.lit(""))
    low = F.lower(given)
    pseudo = F.regexp_extract(low, "(?s)^(?:request|keyword):(.*)$", 1)
    path = F.rtrim(F.substring_index(low, "?", 1), F.lit("/"))
    based = F.concat(F.lit("{baseuri}/"), F.regexp_extract(low, r"(?s)\{baseuri\}/(.*)$", 1))
    scan = F.lower(F.concat_ws(" ", name, given, around))
    return F.when(low.rlike("^(?:request|keyword):"), F.coalesce(_role_of(pseudo), F.lit(""))).otherwise(F.coalesce(
        _role_of(F.substring_index(path, "/", -1)),
        F.when(low.contains("{baseuri}/"), _role_of(based)),
        _role_of(F.lower(name)),
        *[F.when(scan.contains(w), r) for w, r in ROLE_WORDS],
        F.lit(""),
    ))


def keywords(api_name: Column, endpoint: Column, context: Column, most: int = 12) -> Column:
    """The role and then the first distinct words, ``most`` in all."""
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", api_name, endpoint, context)), F.lit("[a-z][a-z0-9_]{2,}"), F.lit(0))
    first = F.filter(F.array(role(endpoint, api_name, context)), lambda r: r != "")
    return F.slice(F.array_distinct(F.concat(first, F.filter(words, lambda w: ~w.isin(STOP)))), 1, most)


def confidence(method: Column, line: Column, heading: Column, endpoint: Column) -> Column:
    """0.55 and more for a method, a label in the line, a heading and a role, 0.95 at most."""
    label = line.rlike(r"(?iU)\b(endpoint|url|path)\b") | line.contains("|**URL**|")
    score = F.lit(0.55)
    for found, worth in ((~method.isin("", "unknown"), 0.2), (label, 0.1), (heading != "", 0.1), (role(endpoint) != "", 0.05)):
        score = score + F.when(found, worth).otherwise(0.0)
    return F.round(F.least(score, F.lit(0.95)), 2)


def name_of(endpoint: Column) -> Column:
    """A title from the last segment of an endpoint."""
    last = F.substring_index(F.rtrim(endpoint, F.lit("/")), "/", -1)
    words = F.btrim(F.regexp_replace(F.when(last == "", "api").otherwise(last), r"[_\-.]+", " "))
    return F.concat(F.initcap(words), F.lit(" API"))


def cleaned(endpoint: Column) -> Column:
    """An endpoint without marks at its end; empty where it is neither a path nor an address."""
    plain = F.replace(F.regexp_replace(F.rtrim(F.btrim(endpoint), F.lit(".,;)")), r"/\s+", "/"), F.lit("\\"), F.lit("/"))
    based = lambda x: F.concat(F.lit("{baseUri}/"), F.regexp_extract(x, "(?s)/(.*)$", 1))
    return let(plain, lambda x: F.when(F.lower(x).startswith("{baseuri}/"), based(x)).when(x.rlike("^(?:https?://|/)"), x).otherwise(""))


def _found(line: Column, pattern: str, method: int, endpoint: int) -> Column:
    """(method, endpoint) of every match of a family in a line; the method is empty where the family has none."""
    ends = F.regexp_extract_all(line, F.lit(f"(?iU){pattern}"), F.lit(endpoint))
    if not method:
        return F.transform(ends, lambda e: F.struct(F.lit("").alias("method"), e.alias("endpoint")))
    own = F.regexp_extract_all(line, F.lit(f"(?iU){pattern}"), F.lit(method))
    return F.zip_with(own, ends, lambda m, e: F.struct(m.alias("method"), e.alias("endpoint")))


def _window(ls: Column, begin: Column, end: Column) -> Column:
    """The lines from place ``begin`` up to ``end``, both from 0, cut at the ends of the document."""
    low = F.greatest(F.lit(0), begin)
    return F.slice(ls, low + 1, F.greatest(F.lit(0), F.least(end, F.size(ls)) - low))


def _joined(ls: Column, begin: Column, end: Column, mark: str = "\n") -> Column:
    return F.array_join(_window(ls, begin, end), mark)


def repaired(endpoint: Column, context: Column) -> Column:
    """An endpoint that ends in a slash with the word that stands after it in a labelled place of its context, as where a line was cut."""
    literal = F.concat(F.lit("\\Q"), F.replace(endpoint, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    tail = F.call_function("regexp_extract", context, F.concat(F.lit(r"(?iU)(?:Endpoints|端點地址)\s+"), literal, F.lit(r"\s+([A-Za-z][A-Za-z0-9_/-]*)")), F.lit(1))
    return F.when(F.endswith(endpoint, F.lit("/")), F.concat(endpoint, F.ltrim(tail, F.lit("/")))).otherwise(endpoint)


def _request_name(request: Column) -> Column:
    words = F.transform(F.regexp_extract_all(request, F.lit(r"([A-Z]?[a-z]+|[A-Z]+(?=[A-Z]|$)|\d+)"), F.lit(1)), lambda w: F.initcap(w))
    return F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(request)


def candidates(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no, api_name, method, endpoint, context, confidence) of each endpoint found in a line.

    A line's method is its own, else one of a table row below it, else one named near it. Beside paths
    and addresses, headings of transactions and of known requests, ``request=`` parameters and fields of
    callbacks are candidates: they take the document's method, the last address named above them, or a name alone.
    Lines are an array in the document's row, so nothing is shuffled and documents with one key stay apart.
    """
    split = docs.select(key, F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1).alias("ls"))
    title = lambda x: F.regexp_extract(F.btrim(x), r"^#{1,6}\s+(.+?)\s*$", 1)
    headings = F.filter(F.transform("ls", lambda x, i: F.struct(i.alias("i"), title(x).alias("title"))), lambda h: h.title != "")
    told = F.upper(F.regexp_extract(_joined(F.col("ls"), F.lit(0), F.lit(HEAD_LINES)), rf"(?iU)\bHTTP Method:[^\S\n]*({METHODS})\b", 1))
    ls, none = F.col("ls"), F.array().cast("array<struct<method:string,endpoint:string>>")
    blank = F.array().cast("array<struct<heading:string,method:string,endpoint:string,context:string,line:string,api_name:string,confidence:double>>")

    def near(i: Column) -> Column:
        return F.regexp_extract(_joined(ls, i - METHOD_BEFORE, i + 8, " "), rf"(?iU)\b({METHODS})\b", 1)

    def written(x: Column, i: Column, doc: Column) -> Column:
        """Paths and addresses in a line."""
        labels = F.filter(F.transform(_window(ls, i - BEFORE, i), lambda y: F.btrim(y)), lambda y: y != "")
        alone = F.regexp_extract(x, r"(?iU)^\s*(https?://[^\s|<>`]+)\s*$", 1)
        labelled = (alone != "") & F.coalesce(F.try_element_at(labels, F.lit(-1)), F.lit("")).rlike(LABEL_LINE)
        some = F.concat(*[_found(x, *f) for f in FAMILIES], F.when(labelled, F.array(F.struct(F.lit("").alias("method"), alone.alias("endpoint")))).otherwise(none))
        table = F.regexp_extract(_joined(ls, i, i + 8), rf"(?iU)\|[^\S\n]*(?:\*\*)?Method(?:\*\*)?[^\S\n]*\|[^\S\n]*({METHODS})[^\S\n]*\|", 1)
        heading = F.coalesce(F.try_element_at(F.filter(doc.headings, lambda h: h.i <= i), F.lit(-1)).getField("title"), F.lit(""))
        around = _joined(ls, i - BEFORE, i + AFTER + 1)

        def all_made(ms: Column) -> Column:
            """Candidates of a line, whose surroundings are read once."""

            def of(a: Column) -> Column:
                def made(m: Column) -> Column:
                    method = F.coalesce(F.nullif(m.method, F.lit("")), F.nullif(a.table, F.lit("")), F.nullif(a.near, F.lit("")))
                    return F.struct(
                        a.heading.alias("heading"), F.coalesce(F.upper(method), F.lit("unknown")).alias("method"), repaired(m.endpoint, a.around).alias("endpoint"), a.around.alias("context"),
                        x.alias("line"), F.lit(None).cast("string").alias("api_name"), F.lit(None).cast("double").alias("confidence"),
                    )

                return F.transform(ms, made)

            return F.when(F.size(ms) > 0, let(F.struct(heading.alias("heading"), table.alias("table"), near(i).alias("near"), around.alias("around")), of)).otherwise(blank)

        taken = let(some, lambda s: F.when(F.size(s) > 0, s).otherwise(_found(x, *BARE)))
        kept = F.filter(F.transform(taken, lambda m: F.struct(m.method.alias("method"), cleaned(m.endpoint).alias("endpoint"))), lambda m: m.endpoint != "")
        return let(kept, all_made)

    def named(name: Column, method: Column, endpoint: Column, i: Column, before: int, after: int, sure: float) -> Column:
        return F.struct(
            F.lit("").alias("heading"), method.alias("method"), endpoint.alias("endpoint"), _joined(ls, i - before, i + after).alias("context"), F.lit("").alias("line"),
            name.alias("api_name"), F.lit(sure).alias("confidence"),
        )

    def meant(x: Column, i: Column, doc: Column) -> Column:
        """Requests that a line names without an address."""
        transaction = F.try_element_at(F.create_map(*[F.lit(y) for pair in TRANSACTIONS.items() for y in pair]), F.regexp_replace(F.lower(F.btrim(x)), r"\s+", " "))
        known = F.regexp_replace(F.lower(F.regexp_extract(F.btrim(x), r"(?i)^#{1,6}\s+(?:[⦁•]\s*)?\*{0,2}\s*(Auth|Debit|Revision|Credit(?:\s*&\s*Refund)?|Refund)\s*\*{0,2}\s*$", 1)), r"\s+", " ")
        read = F.struct(
            transaction.alias("transaction"), F.regexp_extract(x, r"(?iU)\brequest\s*=\s*([A-Za-z][A-Za-z0-9_]*)", 1).alias("request"),
            F.regexp_extract(F.btrim(x), rf"(?i)^#{{1,6}}\s+\*{{0,2}}\s*({'|'.join(SEAMLESS)})\s*\*{{0,2}}\s*$", 1).alias("seamless"), known.alias("known"),
            F.lower(F.regexp_extract(x, r"(?i)\|\s*Auth\s+(Debit|Credit|Token)\s*\|", 1)).alias("field"),
        )

        def of(r: Column) -> Column:
            known, seamless = r.known, r.seamless
            words = F.when(known == "", F.array().cast("array<string>")).when(known == "credit & refund", F.array(F.lit("credit"), F.lit("refund"))).otherwise(F.array(F.replace(known, F.lit(" "), F.lit("_"))))
            callback = F.when(r.field == "token", "auth").otherwise(r.field)
            above = F.filter(
                F.transform(F.filter(_window(ls, i - BASE_BEFORE, i), lambda y: ~F.btrim(y).rlike('^(?:```|\\{|")')), lambda y: F.regexp_extract(y, f"(?iU){FAMILIES[0][0]}", 2)), lambda e: e != ""
            )
            base = F.coalesce(F.try_element_at(above, F.lit(-1)), F.concat(F.lit("/{Partner_base_URL}/"), seamless))

            def each(own: Column) -> Column:
                asked, posted = F.coalesce(own, F.nullif(doc.told, F.lit("")), F.lit("GET")), F.coalesce(own, F.lit("POST"))
                ones = [
                    F.when(r.transaction.isNotNull(), named(F.initcap(F.regexp_replace(F.lower(F.btrim(x)), r"\s+", " ")), asked, F.concat(F.lit("request:"), r.transaction), i, 0, 12, 0.9)),
                    F.when(r.request != "", named(_request_name(r.request), asked, F.concat(F.lit("request:"), r.request), i, 4, 8, 0.85)),
                    F.when(seamless != "", named(seamless, posted, base, i, 0, 15, 0.9)),
                ]
                keywords = F.transform(words, lambda w: named(F.initcap(w), posted, F.concat(F.lit("keyword:"), w), i, 0, 24, 0.88))
                last = F.when(callback != "", named(F.initcap(callback), F.lit("POST"), F.concat(F.lit("keyword:"), callback), i, 4, 8, 0.78))
                return F.concat(F.array_compact(F.array(*ones)), keywords, F.array_compact(F.array(last)))

            some = r.transaction.isNotNull() | (r.request != "") | (seamless != "") | (known != "") | (r.field != "")
            return F.when(some, let(F.nullif(near(i), F.lit("")), each)).otherwise(blank)

        return let(read, of)

    def of_line(x: Column, i: Column, doc: Column) -> Column:
        low = F.lower(F.btrim(x))
        speaks = low.startswith("#") | low.contains("request") | (low.contains("|") & low.contains("auth")) | low.rlike("^(?:get|wager|result|rollback|jackpot|bet) ?[a-z ]*$")
        every = F.concat(F.when(x.contains("/"), written(x, i, doc)).otherwise(blank), F.when(speaks, meant(x, i, doc)).otherwise(blank))
        return F.transform(F.when(low.startswith("source url:"), blank).otherwise(every), lambda c: F.struct(i.alias("line_no"), c.alias("c")))

    # bound here and not in a select of its own, which the optimizer would move into the lambda, to be read again for each line
    whole = F.struct(headings.alias("headings"), told.alias("told"))
    every = let(whole, lambda doc: F.flatten(F.transform("ls", lambda x, i: of_line(x, i, doc))))
    found = split.select(key, F.inline(every)).select(key, "line_no", "c.*")
    plain = F.btrim(F.regexp_replace(F.replace(F.regexp_replace("heading", "[*_`]+", ""), F.lit("¶"), F.lit("")), r"^\d+(?:\.\d+)*\s*", ""))
    telling = (plain != "") & ~F.lower(plain).isin(GENERIC) & (F.char_length(plain) <= 80)
    own_title = F.coalesce(F.nullif("heading", F.lit("")), name_of(F.col("endpoint")))
    sure = F.coalesce("confidence", confidence(F.col("method"), F.col("line"), own_title, F.col("endpoint")))
    return found.select(
        key, "line_no", F.coalesce("api_name", F.when(telling, plain).otherwise(name_of(F.col("endpoint")))).alias("api_name"), "method", "endpoint", "context", sure.alias("confidence")
    )


def context_around(text: Column, needle: Column, radius: int = RADIUS) -> Column:
    """The text from ``radius`` before to ``radius`` after the first ``needle``; empty without one."""

    def cut(at: Column) -> Column:
        start = F.greatest(F.lit(1), at - radius)
        return F.when(at > 0, F.substring(text, start, at + F.char_length(needle) + radius - start)).otherwise("")

    return let(F.position(needle, text), cut)


def methods_before(text: Column, endpoint: Column) -> Column:
    """The methods that stand directly before ``endpoint``, sorted."""
    literal = F.concat(F.lit("\\Q"), F.replace(endpoint, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    pattern = F.concat(F.lit(rf"(?iU)\b({METHODS})\b\s*"), literal)
    return F.sort_array(F.array_distinct(F.transform(F.regexp_extract_all(text, pattern, F.lit(1)), lambda m: F.upper(m))))


def context_keywords(text: Column) -> Column:
    """The known keywords that a text holds, in their own order."""
    return let(F.lower(text), lambda low: F.array_compact(F.array(*[F.when(low.contains(w), w.replace(" ", "_")) for w in CONTEXT_WORDS])))


def predicates(name: Column, kind: Column, description: Column, required: Column, remark: Column) -> dict[str, Column]:
    """What a parameter's texts say of it, by name of the predicate."""
    name, kind, description, required, remark = (F.coalesce(c, F.lit("")) for c in (name, kind, description, required, remark))
    low_kind, low_name, low_text, need = F.lower(kind), F.lower(name), F.lower(description), F.upper(F.btrim(required))
    tokens = F.regexp_extract_all(F.lower(F.concat_ws(" ", name, description)), F.lit("[a-z]+"), F.lit(0))
    piped = F.lower(F.concat_ws(" ", name, description, remark))

    def any_in(text: Column, words: list[str]) -> Column:
        return text.rlike("|".join(words))

    return {
        "is_encryption": F.arrays_overlap(tokens, F.array(*map(F.lit, ["hmac", "signature", "sign", "hash", "encrypt", "decrypt"]))),
        "is_pipe_amount": piped.contains("transactionid") & piped.contains("amount") & piped.contains("|"),
        "is_timestamp": low_name.contains("timestamp") | (low_name == "time") | any_in(low_text, ["unix time", "timestamp"]),
        "is_array": any_in(low_kind, ["array", "list"]),
        "is_object": any_in(low_kind, ["object", "dict", "map"]),
        "is_optional": need.isin("N", "NO", "FALSE", "0", "OPTIONAL") | need.startswith("N "),
        "is_required": need.isin("Y", "YES", "TRUE", "1", "REQUIRED") | need.startswith("Y "),
        "is_string": any_in(low_kind, ["string", "uuid"]),
        "is_numeric": any_in(low_kind, ["int", "long", "float", "decimal", "number", "double"]),
    }


def is_rollback(role_: Column, endpoint: Column) -> Column:
    """Whether an endpoint takes something back, by its role or path."""
    return F.lower(F.coalesce(role_, F.lit(""))).rlike("rollback|cancel_bet") | F.lower(F.coalesce(endpoint, F.lit(""))).rlike("rollback|refund|cancel")


#: Addresses that several requests share, what a heading adds to a candidate's confidence, and how headings that name pages begin.
SHARED = ["/{partner_base_url}", "/{partner_base_url}/"]
HEADING_BONUS, PAGE = 0.1, "page "


def best_candidates(rows: DataFrame, key: list[str], place: str = "line_no") -> DataFrame:
    """One candidate for each method and endpoint of a ``key``, in any case of letters: the surest, then the last by ``place``.

    Requests with a known role that share one address are told apart by their names. Only candidates
    that could win travel: the best of each key is found before the shuffle.
    """
    low, name = F.lower("endpoint"), F.lower(F.coalesce("api_name", F.lit("")))
    apart = low.isin(SHARED) & _role_of(name).isNotNull()
    one = F.when(apart, F.concat_ws("#", low, name)).otherwise(low)
    bonus = F.when((name != "") & ~F.startswith(name, F.lit(PAGE)), HEADING_BONUS).otherwise(0.0)
    rank = F.struct((F.col("confidence") + bonus).alias("sure"), F.col(place).alias("last"))
    held = rows.select(*key, F.lower("method").alias("_m"), one.alias("_e"), rank.alias("_rank"), F.struct(*[c for c in rows.columns if c not in key]).alias("_row"))
    best = held.groupBy(*key, "_m", "_e").agg(F.max_by("_row", F.struct("_rank", -F.xxhash64("_row"))).alias("_row"))
    return best.select(*key, "_row.*")
