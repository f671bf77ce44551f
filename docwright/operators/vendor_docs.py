"""Interface documents, one a row: sections, parameter tables, error codes, operation variants and example slots.

A document is a row with ``paragraphs`` (style, text and the JSON objects in the text), ``tables``
(rows of cells) and ``plain_text``. Its order is that of the arrays, so everything is computed inside the
row by higher-order functions: nothing is exploded, shuffled or windowed, and documents with equal or
null keys stay apart.

Defined results: null arrays are empty, null styles and texts are empty strings; ties go to what
stands first; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docwright.functions.exchange import query_values, xml_exchanges
from docwright.functions.text import let
from docwright.operators import endpoints as endpoint_parts
from docwright.operators.pages import fragments_of, repaired

PARAGRAPHS = "array<struct<style:string,text:string,json:array<string>,repaired:array<string>>>"
#: Patterns of endpoints and of codes in plain text.
ENDPOINT = r"(?i)\b(?:GET|POST|PUT|PATCH|DELETE)?\s*(/api/[A-Za-z0-9_./{}?=&:-]+)"
CODE = r"(?i)\b(?:code|error|status)[\s:=\"]+([A-Z_]*\d{2,}|[A-Z_]{3,})"
#: Characters of plain text before and after a code that are its context.
BEFORE, AFTER = 120, 180
#: Names that headers of error tables have, by what they mean.
HEADERS = {
    "error code": "code", "error codes": "code", "error id": "code", "status code": "code", "response code": "code", "message": "message",
    "error message": "message", "description": "description", "desc": "description", "context": "context",
}
CONTEXTS = ["message", "description", "context"]
EXCEPTIONS = ["related exception", "related exceptions"]
#: Words that make a message a code, tokens that name the columns of a stream.
MESSAGE_WORDS = ["error", "invalid", "failed", "expired", "funds", "signature"]
COLUMN_WORDS = ["code", "message", "description", "context"]
#: Names of parameter fields by header.
FIELDS = {"parameter": "name", "type": "type", "require": "required", "description": "description", "remark": "remark"}
#: Labels of example blocks, fields that name an example, and keys that tell responses from requests.
REQUEST_LABELS, SUCCESS_LABELS = ["example request", "request example"], ["example response", "response example"]
ERROR_LABELS = ["example error response", "error response example"]
NAMING = ["type", "promoType", "action", "operation"]
RESPONSE_KEYS, WALLET_KEYS = ["status", "data", "error", "result"], ["balance", "currency", "denomination", "buffer"]
REQUEST_KEYS = ["post_params", "retry", "game_result"]
#: Whole lines that start requests and responses.
REQUEST_LINES, RESPONSE_LINES = ["request", "api request", "request body"], ["response", "api response", "response body"]
REVERSALS = ["rollback", "cancel"]
#: Fixed value: the vendor whose reversing requests are listed beside the others.
LISTS_REVERSALS = "softgaming"

EXAMPLE = "struct<endpoint:string,slot:string,label:string,example:string>"


def _either(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def _has(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def plain(text: Column) -> Column:
    """Lower case, single blanks, trimmed."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _when_empty(value: Column, other: Column) -> Column:
    return F.when(value != "", value).otherwise(other)


def _first(values: Column, test) -> Column:
    return F.get(F.filter(values, test), F.lit(0))


def read_json(docs: DataFrame, paragraphs: str = "paragraphs") -> DataFrame:
    """``docs`` with the JSON objects of each paragraph, as written and with trailing commas left out."""
    rest = [c for c in docs.columns if c != paragraphs]
    schema = T.StructType([*docs.select(*rest).schema.fields, T.StructField(paragraphs, T._parse_datatype_string(PARAGRAPHS))])
    lists = pa.list_(pa.string())

    def read(batch: pa.RecordBatch) -> pa.Array:
        """The paragraphs of a batch; a text that comes again in it is read once."""
        held = batch.column(len(rest))
        ends = np.cumsum(pc.fill_null(pc.list_value_length(held), 0).to_numpy(zero_copy_only=False))
        flat = held.flatten()
        style, text = (pc.fill_null(pc.struct_field(flat, [name]), "") for name in ("style", "text"))
        coded = text.dictionary_encode()
        texts = coded.dictionary.to_pylist()
        found = [pa.array([fragments_of(x) for x in xs], lists).take(coded.indices) for xs in (texts, map(repaired, texts))]
        made = pa.StructArray.from_arrays([style, text, *found], ["style", "text", "json", "repaired"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], read(batch)], schema.names)

    return docs.select(*rest, paragraphs).mapInArrow(run, schema)


def from_rows(rows: DataFrame) -> DataFrame:
    """(file, paragraphs, tables, plain_text) from the paragraph and cell rows of ``sources.office``; a file's rows are one document."""
    cell = rows.filter("kind = 'cell'").groupBy("file", "tbl", "row").agg(F.sort_array(F.collect_list(F.struct("col", "text"))).alias("cells"))
    line = cell.groupBy("file", "tbl").agg(F.sort_array(F.collect_list(F.struct("row", F.col("cells.text").alias("cells")))).alias("lines"))
    tables = line.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("tbl", F.col("lines.cells").alias("lines")))).alias("t"))
    said = rows.filter("kind = 'paragraph'").groupBy("file").agg(F.sort_array(F.collect_list(F.struct("pos", "style", "text"))).alias("p"))
    met = said.join(tables, "file", "full")
    text = F.array_join(F.concat(F.coalesce("p.text", F.array()), F.transform(F.flatten(F.coalesce("t.lines", F.array())), lambda c: F.array_join(c, " | "))), "\n")
    return met.select(
        "file", F.transform("p", lambda x: F.struct(x.style.alias("style"), x.text.alias("text"))).alias("paragraphs"), F.col("t.lines").alias("tables"), text.alias("plain_text")
    )


def first_endpoint(text: Column) -> Column:
    """The first endpoint in a text; empty without one."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), ENDPOINT, 1)


def all_endpoints(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ENDPOINT), F.lit(1)))


def _endpoints_of(s: Column) -> Column:
    """The endpoints of a section's title, else those in its lines."""
    lines = F.array_join(F.transform(s.content, lambda p: p.text), "\n")
    return let(all_endpoints(s.title), lambda es: F.when(F.size(es) > 0, es).otherwise(all_endpoints(lines)))


def _is_heading(p: Column) -> Column:
    return F.lower(p.style).isin("h1", "h2", "h3", "h4") | F.startswith(F.lower(p.style), F.lit("heading"))


def _places(values: Column, test) -> Column:
    """Places, from 0, of the elements that pass ``test``."""
    return F.array_compact(F.transform(values, lambda x, i: F.when(test(x), i)))


def _cut(values: Column, begin: Column, end: Column) -> Column:
    return F.slice(values, begin + 1, F.greatest(F.lit(0), end - begin))


def sections(paragraphs: Column) -> Column:
    """Sections in order: title, level and content; a heading right before another has none and gives way, lines before the first are Overview."""

    def made(at: Column) -> Column:
        def one(k: Column) -> Column:
            begin = F.when(k == 0, F.lit(-1)).otherwise(F.get(at, k - 1))
            end = F.coalesce(F.get(at, k), F.size(paragraphs))
            head = F.get(paragraphs, begin)
            level = F.when(k == 0, 1).when(F.lower(head.style).rlike(r"^h\d+$"), F.substring(head.style, 2, 1).cast("int")).otherwise(2)
            title = F.when(k == 0, "Overview").otherwise(F.coalesce(head.text, F.lit("")))
            return F.struct(title.alias("title"), level.alias("level"), _cut(paragraphs, begin + 1, end).alias("content"), (k == F.size(at)).alias("is_last"))

        return F.transform(F.sequence(F.lit(0), F.size(at)), one)

    cut = let(_places(paragraphs, _is_heading), made)
    kept = F.filter(cut, lambda s: (F.size(s.content) > 0) | (s.is_last & (s.title != "Overview")))
    return F.transform(kept, lambda s: F.struct(s.title.alias("title"), s.level.alias("level"), s.content.alias("content")))


# ---- tables


def _header(table: Column) -> Column:
    return F.transform(F.get(table, F.lit(0)), plain)


def parameter_tables(tables: Column) -> Column:
    """The tables with a Parameter and a Type column, each as rows of field to value; rows without a name go.

    Of equal headers the last counts; cells beyond the header and missing ones are left out.
    """
    is_one = lambda t: F.coalesce(F.size(F.array_intersect(_header(t), _either(["parameter", "type"]))) == 2, F.lit(False))
    known = F.create_map(*[F.lit(x) for pair in FIELDS.items() for x in pair])

    def rows(table: Column) -> Column:
        keys = F.transform(_header(table), lambda h: F.coalesce(F.try_element_at(known, h), F.replace(h, F.lit(" "), F.lit("_"))))

        def of(ks: Column) -> Column:
            def one(cells: Column) -> Column:
                held = F.transform(F.slice(ks, F.lit(1), F.size(cells)), lambda k, i: F.struct(k.alias("k"), F.get(cells, i).alias("v"), i.alias("i")))
                last = F.filter(held, lambda e: ~F.exists(F.slice(ks, e.i + 2, F.greatest(F.lit(0), F.least(F.size(cells), F.size(ks)) - e.i - 1)), lambda k: k == e.k))
                return F.map_from_entries(F.transform(last, lambda e: F.struct(e.k, e.v)))

            return F.filter(F.transform(F.slice(table, F.lit(2), F.size(table)), one), lambda m: F.coalesce(F.try_element_at(m, F.lit("name")), F.lit("")) != "")

        return let(keys, of)

    return F.transform(F.filter(F.coalesce(tables, F.array().cast("array<array<array<string>>>")), is_one), rows)


def _given_tables(paragraphs: Column, tables: Column) -> Column:
    """(place, endpoint, request, response): what each endpoint of a section's title takes."""

    def taken(ts: Column) -> Column:
        named = F.filter(F.transform(sections(paragraphs), lambda s: all_endpoints(s.title)), lambda es: F.size(es) > 0)
        each = F.transform(named, lambda es, i: F.transform(es, lambda e: F.struct(i.alias("place"), e.alias("endpoint"), F.get(ts, 2 * i).alias("request"), F.get(ts, 2 * i + 1).alias("response"))))
        return let(F.flatten(each), lambda es: F.filter(es, lambda x: ~F.exists(es, lambda y: (y.endpoint == x.endpoint) & (y.place > x.place))))

    return let(parameter_tables(tables), taken)


def endpoint_tables(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, endpoint, request and response rows: sections that name endpoints take parameter tables two by two, in order.

    A section that names several gives them the same tables; of several sections of one endpoint the last counts.
    """
    return docs.select(*keep, F.inline(_given_tables(F.col("paragraphs"), F.col("tables")))).drop("place")


# ---- error codes


def error_header(text: Column) -> Column:
    """A header of an error table by its meaning; a translation in parentheses is left out."""
    known = F.create_map(*[F.lit(x) for pair in HEADERS.items() for x in pair])
    return let(F.btrim(F.regexp_replace(plain(text), r"\s*\([^)]*\)\s*", " ")), lambda bare: F.coalesce(F.try_element_at(known, bare), bare))


def _signs(t: Column) -> Column:
    """What a trimmed token could be a code by: its digits, its form as a name, its words."""
    short = F.length(t) <= 80
    return F.struct(
        t.rlike(r"^\d{1,6}$").alias("digits"), (short & t.rlike(r"^[A-Za-z][A-Za-z0-9_.-]{2,}$")).alias("named"),
        (short & (t != "") & let(F.lower(t), lambda low: _has(low, MESSAGE_WORDS))).alias("told"),
    )


def _code_by(signs: Column, mode: Column) -> Column:
    return signs.digits | ((mode == "code_column") & signs.named) | ((mode == "message") & signs.told)


def is_code(text: Column, mode: Column) -> Column:
    """Whether a token is a code: digits in any mode, a name in a code column, a telling message where messages are codes."""
    return let(let(_trim(text), _signs), lambda x: _code_by(x, mode))


def _table_codes(tables: Column) -> Column:
    """(code, context) of tables with a code column and a text, or with a message column and exceptions or a text."""

    def place(heads: Column, names: list[str]) -> Column:
        return F.coalesce(*[F.when(F.array_contains(heads, n), F.array_position(heads, F.lit(n)) - 1) for n in names]).cast("int")

    def rows(table: Column) -> Column:
        def found(heads: Column) -> Column:
            wanted = {"code": ["code"], "text": CONTEXTS, "message": ["message"], "more": ["related exceptions"], "other": [*EXCEPTIONS, "description", "context"]}
            return F.struct(*[place(heads, names).alias(c) for c, names in wanted.items()])

        def of(at: Column) -> Column:
            code, text, message, more, other = at.code, at.text, at.message, at.more, at.other

            def coded(cells: Column) -> Column:
                extra = _trim(F.coalesce(F.get(cells, more), F.lit("")))
                said = _trim(F.get(cells, text))
                ok = (F.size(cells) > F.greatest(code, text)) & is_code(F.get(cells, code), F.lit("code_column"))
                return F.when(ok, F.struct(_trim(F.get(cells, code)).alias("code"), F.when(extra != "", F.concat(said, F.lit(" | "), extra)).otherwise(said).alias("context")))

            def told(cells: Column) -> Column:
                ok = (F.size(cells) > message) & is_code(F.get(cells, message), F.lit("message"))
                return F.when(ok, F.struct(_trim(F.get(cells, message)).alias("code"), _trim(F.coalesce(F.get(cells, other), F.lit(""))).alias("context")))

            by_code, by_message = code.isNotNull() & text.isNotNull(), message.isNotNull() & other.isNotNull()
            body = F.slice(table, F.lit(2), F.size(table))
            none = F.array().cast("array<struct<code:string,context:string>>")
            return F.array_compact(F.when(by_code, F.transform(body, coded)).when(by_message, F.transform(body, told)).otherwise(none))

        return let(let(F.transform(F.get(table, F.lit(0)), error_header), found), of)

    whole = F.filter(F.coalesce(tables, F.array().cast("array<array<array<string>>>")), lambda t: F.size(t) > 0)
    return F.flatten(F.transform(whole, rows))


def _stream_codes(content: Column) -> Column:
    """(code, context) of a section's lines read as a stream of tokens.

    The first eight tokens say which column holds codes. From the first code on each code opens an
    entry, and what follows up to the next code is its context, but for repeated column names.
    """
    said = F.filter(F.transform(content, lambda p: _trim(p.text)), lambda x: x != "")
    tokens = F.transform(said, lambda t: F.struct(t.alias("text"), error_header(t).alias("head"), _signs(t).alias("signs")))

    def read(ts: Column) -> Column:
        heads = F.transform(F.slice(ts, 1, 8), lambda x: x.head)
        mode = F.when(F.array_contains(heads, "code"), "code_column").when(
            F.array_contains(heads, "message") & F.arrays_overlap(heads, _either(EXCEPTIONS)), "message").otherwise("digits")

        def entries(given: Column) -> Column:
            m, at = given.mode, _places(ts, lambda x: _code_by(x.signs, given.mode))

            def cut(places: Column) -> Column:
                def one(p: Column, k: Column) -> Column:
                    rest = _cut(ts, p + 1, F.coalesce(F.get(places, k + 1), F.size(ts)))
                    said = F.transform(F.filter(rest, lambda x: ~x.head.isin(COLUMN_WORDS)), lambda x: x.text)
                    return F.struct(F.get(ts, p).text.alias("code"), _trim(F.array_join(said, " | ")).alias("context"))

                return F.transform(places, one)

            return F.when(m.isNotNull(), let(at, cut))

        return let(F.struct(mode.alias("mode")), entries)

    return let(tokens, read)


def _is_code_section(s: Column) -> Column:
    preview = F.lower(F.array_join(F.transform(F.slice(s.content, 1, 8), lambda p: p.text), " "))
    by_title = let(plain(s.title), lambda title: title.contains("error code") | (title == "errors"))
    return by_title | let(preview, lambda x: x.contains("error code") & _has(x, ["message", "description"]))


def _text_codes(text: Column) -> Column:
    """(code, context) of digits after code, error or status in plain text; matches and the gaps before them give places."""
    body = F.coalesce(text, F.lit(""))
    pairs = F.arrays_zip(
        F.split(body, CODE, -1).alias("gap"), F.regexp_extract_all(body, F.lit(CODE), F.lit(0)).alias("m"), F.regexp_extract_all(body, F.lit(CODE), F.lit(1)).alias("code")
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<code:string,context:string>>").alias("found"))

    def step(s: Column, x: Column) -> Column:
        begin = s.at + F.length(x.gap)
        end = begin + F.length(x.m)
        low = F.greatest(F.lit(0), begin - BEFORE)
        near = F.replace(F.substring(body, low + 1, end + AFTER - low), F.lit("\n"), F.lit(" "))
        found = F.when(is_code(x.code, F.lit("digits")), F.concat(s.found, F.array(F.struct(x.code.alias("code"), _trim(near).alias("context"))))).otherwise(s.found)
        return F.struct(end.alias("at"), found.alias("found"))

    return F.aggregate(F.filter(pairs, lambda x: x.m.isNotNull()), start, step).getField("found")


def error_codes(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, place, code, context and tier (1 tables, 2 token streams, 3 plain text) of each document's codes.

    The first context of a code stands; plain text serves documents without any code in tables and
    streams. Numbers come first, by value, then names in lower case.
    """
    tiered = lambda codes, n: F.transform(codes, lambda c: F.struct(c.code.alias("code"), c.context.alias("context"), F.lit(n).alias("tier")))
    streams = F.flatten(F.transform(F.filter(sections(F.col("paragraphs")), _is_code_section), lambda s: _stream_codes(s.content)))
    found = docs.select(*keep, "plain_text", F.concat(tiered(_table_codes(F.col("tables")), 1), tiered(streams, 2)).alias("found"))
    every = F.when(F.size("found") > 0, F.col("found")).otherwise(tiered(_text_codes(F.col("plain_text")), 3))

    def once(cs: Column) -> Column:
        firsts = F.filter(F.transform(cs, lambda c, i: F.struct(c.code.alias("code"), c.context.alias("context"), c.tier.alias("tier"), i.alias("i"))),
                          lambda c: ~F.exists(F.slice(cs, F.lit(1), c.i), lambda d: d.code == c.code))
        number = lambda c: F.when(c.code.rlike(r"^\d+$"), c.code.cast("bigint"))
        keyed = F.transform(firsts, lambda c: F.struct(number(c).isNull().alias("named"), number(c).alias("n"), F.lower(c.code).alias("low"), c.i.alias("i"), c.code.alias("code"), c.context.alias("context"), c.tier.alias("tier")))
        return F.sort_array(F.transform(keyed, lambda c: F.struct(c.named, c.n, F.when(c.named, c.low), c.i, c.code, c.context, c.tier)))

    placed = found.select(*keep, F.posexplode(let(every, once)).alias("place", "c"))
    return placed.select(*keep, "place", "c.code", "c.context", "c.tier")


# ---- operation variants


def _method(title: Column) -> Column:
    return F.upper(F.regexp_extract(title, r"(?i)\b(GET|POST|PUT|PATCH|DELETE)\b", 1))


def _operation(title: Column) -> Column:
    """What stands in parentheses at the end of a heading, else after its last hyphen."""
    return F.when(title.rlike(r"\([^()]+\)\s*$"), _trim(F.regexp_extract(title, r"\(([^()]+)\)\s*$", 1))).when(title.contains("-"), _trim(F.substring_index(title, "-", -1))).otherwise("")


def _keys(json: Column) -> Column:
    return F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))


def looks_like_response(json: Column) -> Column:
    """Whether an object has a key of responses, or all keys of a wallet, and none of requests."""
    return let(_keys(json), _answers)


def _answers(keys: Column) -> Column:
    wallet = F.size(F.array_intersect(keys, _either(WALLET_KEYS))) == len(WALLET_KEYS)
    return (F.arrays_overlap(keys, _either(RESPONSE_KEYS)) | wallet) & ~F.arrays_overlap(keys, _either(REQUEST_KEYS))


def _labelled(examples: Column) -> Column:
    """Request examples with the values of their naming fields."""

    def label(json: Column) -> Column:
        said = [F.get_json_object(json, f"$.{k}") for k in NAMING]
        plain_bool = [F.when(s.isin("true", "false") & ~json.rlike(f'"{k}"\\s*:\\s*"'), F.initcap(s)).otherwise(s) for k, s in zip(NAMING, said, strict=True)]
        return F.coalesce(F.nullif(F.array_join(F.filter(F.array(*plain_bool), lambda s: s != ""), " / "), F.lit("")), F.lit("request"))

    return F.transform(examples, lambda e: F.struct(label(e).alias("label"), e.alias("example")))


def _variant(title: Column, request_rows: Column, response_rows: Column, requests: Column, good: Column, wrong: Column) -> Column:
    none = F.array().cast("array<map<string,string>>")
    return F.struct(
        first_endpoint(title).alias("endpoint"), _method(title).alias("method"), _operation(title).alias("operation"), title.alias("title"),
        F.coalesce(request_rows, none).alias("request_parameters"), F.coalesce(response_rows, none).alias("response_parameters"),
        _labelled(requests).alias("requests"), good.alias("successes"), wrong.alias("errors"),
    )


def heading_variants(paragraphs: Column, tables: Column) -> Column:
    """Variants under third-level headings that name an endpoint.

    The nearest open ancestor decides: a heading of the first three levels closes a variant, one
    below opens a label in it, and a line belongs to the label last opened; lines of equal labels come together. A variant with a
    request (response) label takes the next parameter table.
    """
    third = lambda p: (F.lower(p.style) == "h3") | F.startswith(F.lower(p.style), F.lit("heading 3"))
    opens = lambda p: third(p) & (first_endpoint(p.text) != "")
    closes = lambda p: third(p) | F.lower(p.style).isin("h1", "h2")
    labels = lambda p: F.lower(p.style).isin("h4", "h5", "h6") | F.startswith(F.lower(p.style), F.lit("heading 4"))

    def blocks(ends: Column) -> Column:
        def one(at: Column) -> Column:
            body = _cut(paragraphs, at + 1, F.coalesce(_first(ends, lambda e: e > at), F.size(paragraphs)))

            def parts(b: Column) -> Column:
                def cut(ls: Column) -> Column:
                    return F.transform(ls, lambda p, k: F.struct(_trim(F.lower(F.get(b, p).text)).alias("label"), _cut(b, p + 1, F.coalesce(F.get(ls, k + 1), F.size(b))).alias("lines")))

                return let(_places(b, labels), cut)

            return F.struct(F.get(paragraphs, at).text.alias("title"), let(body, parts).alias("parts"))

        return F.transform(_places(paragraphs, opens), one)

    def finish(bs: Column) -> Column:
        says = lambda b, label: F.exists(b.parts, lambda x: x.label == label).cast("int")
        taken = lambda b: says(b, "request") + says(b, "response")

        def under(b: Column, names: list[str]) -> Column:
            """JSON objects under labels of these names, a label's lines together, labels by their first place."""
            order = F.array_distinct(F.transform(F.filter(b.parts, lambda x: x.label.isin(names)), lambda x: x.label))
            each = F.transform(order, lambda n: F.flatten(F.transform(F.filter(b.parts, lambda x: x.label == n), lambda x: F.flatten(F.transform(x.lines, lambda p: p.json)))))
            return F.flatten(each)

        def one(b: Column, i: Column) -> Column:
            used = F.aggregate(F.slice(bs, F.lit(1), i), F.lit(0), lambda s, x: s + taken(x))
            request = F.when(says(b, "request") == 1, F.get(tables, used))
            response = F.when(says(b, "response") == 1, F.get(tables, used + says(b, "request")))
            return _variant(b.title, request, response, F.filter(under(b, REQUEST_LABELS), lambda e: ~looks_like_response(e)), under(b, SUCCESS_LABELS), under(b, ERROR_LABELS))

        return F.transform(bs, one)

    return let(let(_places(paragraphs, closes), blocks), finish)


def _is_error(response: Column) -> Column:
    return F.upper(F.coalesce(F.try_element_at(response, F.lit("result")), F.lit(""))) == "ERROR"


def section_variants(held: Column, tables: Column) -> Column:
    """Variants of sections whose title names an endpoint; each takes two parameter tables, its query parts and XML exchanges are its examples."""

    def one(s: Column, i: Column) -> Column:
        def of(p: Column) -> Column:
            asked = F.filter(F.array(query_values(p.text)), lambda q: F.size(q) > 0)
            return let(xml_exchanges(p.text), lambda xs: F.struct(
                F.concat(asked, F.filter(F.transform(xs, lambda x: x.request), lambda r: F.size(r) > 0)).alias("requests"),
                F.filter(F.transform(xs, lambda x: x.response), lambda r: F.size(r) > 0).alias("responses"),
            ))

        def made(bs: Column) -> Column:
            texts = lambda maps: F.transform(F.flatten(maps), lambda m: F.to_json(m))
            kept = lambda wrong: texts(F.transform(bs, lambda b: F.filter(b.responses, lambda r: _is_error(r) == wrong)))
            return _variant(s.title, F.get(tables, 2 * i), F.get(tables, 2 * i + 1), texts(F.transform(bs, lambda b: b.requests)), kept(F.lit(False)), kept(F.lit(True)))

        return let(F.transform(s.content, of), made)

    return F.transform(F.filter(held, lambda s: first_endpoint(s.title) != ""), one)


def operation_variants(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, place and the fields of each variant, of endpoints with several variants or with one of several request examples.

    Variants of third-level headings stand before those of sections, which serve the endpoints that have none.
    """
    read = docs.select(*keep, "paragraphs", parameter_tables(F.col("tables")).alias("tables"))
    both = read.select(*keep, heading_variants(F.col("paragraphs"), F.col("tables")).alias("a"), section_variants(sections(F.col("paragraphs")), F.col("tables")).alias("b"))
    whole = F.concat("a", F.filter("b", lambda v: ~F.exists("a", lambda w: w.endpoint == v.endpoint)))
    wanted = let(whole, lambda vs: F.filter(vs, lambda v: (F.size(F.filter(vs, lambda w: w.endpoint == v.endpoint)) > 1) | (F.size(v.requests) > 1)))
    placed = both.select(*keep, F.posexplode(wanted).alias("place", "v"))
    return placed.select(*keep, "place", "v.*")


# ---- example slots


def _mode(t: Column) -> Column:
    """Which kind of example a plain line announces; empty if none."""
    asks = t.isin(REQUEST_LINES) | t.contains("request example") | (t.contains("example") & _has(t, REVERSALS))
    return F.when(asks, "request").when(t.contains("error response"), "error").when(t.isin(RESPONSE_LINES) | t.contains("response example"), "response").otherwise("")


def _slot(t: Column, mode: Column, parsed: Column) -> Column:
    """request, success or error: by the plain label, then by an error key, then by the mode, then by the keys."""
    asks, answers = t.contains("request"), t.contains("response")
    return (
        F.when(t.contains("error") & answers, "error").when(asks, "request").when(parsed.fails, "error").when(answers, "success")
        .when(mode == "response", "success").when(mode != "", mode).when(parsed.answers, "success").otherwise("request")
    )


def _tail(endpoint: Column) -> Column:
    return F.lower(F.substring_index(F.regexp_replace(endpoint, "/+$", ""), "/", -1))


def _of_label(label: Column, endpoints: Column, tails: Column) -> Column:
    """The first endpoint whose last segment is a word of the label; empty if none."""
    words = F.btrim(F.regexp_replace(F.lower(label), "[^a-z0-9_/]+", " "))

    def of(w: Column) -> Column:
        at = _first(_places(tails, lambda t: (w.whole == t) | F.array_contains(w.each, t)), lambda i: i >= 0)
        return F.when(w.whole == "", "").otherwise(F.coalesce(F.get(endpoints, at), F.lit("")))

    return let(let(words, lambda w: F.struct(w.alias("whole"), F.split(w, " ").alias("each"))), of)


def _facts(p: Column) -> Column:
    """What a line holds whatever stands before it: text, the kind it announces, endpoint, own label, exchanges and JSON objects."""
    told = lambda json: let(_keys(json), lambda ks: F.struct(json.alias("example"), F.array_contains(ks, "error").alias("fails"), _answers(ks).alias("answers")))
    asked = let(query_values(p.text), lambda q: F.when(F.size(q) > 0, F.array(F.to_json(q))).otherwise(F.array().cast("array<string>")))
    own = F.regexp_replace(F.regexp_replace(p.text, r"(?s)\{.*", ""), r"^\s+|\s+$", "")
    sides = F.transform(xml_exchanges(p.text), lambda x: F.struct(
        F.when(F.size(x.request) > 0, F.to_json(x.request)).alias("request"), F.when(F.size(x.response) > 0, F.to_json(x.response)).alias("response"), _is_error(x.response).alias("fails")))
    return F.struct(
        p.text.alias("text"), let(plain(p.text), _mode).alias("announced"), first_endpoint(p.text).alias("endpoint"), F.when(p.text.contains("{"), F.lower(own)).otherwise("").alias("own"),
        sides.alias("exchanges"), F.transform(F.when(F.size(p.repaired) > 0, p.repaired).otherwise(asked), told).alias("parsed"),
    )


def _section_examples(s: Column, lists: Column) -> Column:
    """(endpoint, slot, label, example) of a section's blocks in order, by a state folded over them.

    The state holds the endpoint named last in a text, the one named last by a label or a request,
    the mode and the label that still waits for an example. What a line holds by itself is read once, before the fold.
    """
    start = F.struct(
        F.coalesce(F.nullif(first_endpoint(s.title), F.lit("")), F.get(s.endpoints, F.lit(0))).alias("current"), F.lit("").alias("led"), F.lit("").alias("mode"), F.lit("").alias("label"),
        F.array().cast(f"array<{EXAMPLE}>").alias("out"),
    )

    def entry(endpoint: Column, slot: Column, label: Column, said: Column, example: Column) -> Column:
        made = lambda more: F.struct(endpoint.alias("endpoint"), F.when(more, "additional").otherwise(slot).alias("slot"), F.when(more, _trim(label)).otherwise("").alias("label"), example.alias("example"))
        return let(lists & (slot == "request") & _has(said, REVERSALS), made)

    def step(a: Column, f: Column) -> Column:
        has = F.size(f.parsed) > 0
        begun = F.struct(_when_empty(f.announced, a.mode).alias("mode"), F.when(f.announced != "", f.text).otherwise(a.label).alias("waiting"))

        def taken(n: Column) -> Column:
            before = _when_empty(a.led, a.current)

            def sides(x: Column) -> Column:
                ask = F.when(x.request.isNotNull(), let(plain(n.waiting), lambda w: F.array(entry(before, F.lit("request"), n.waiting, w, x.request))))
                answer = F.when(x.response.isNotNull(), F.array(F.struct(
                    before.alias("endpoint"), F.when(x.fails, "error").otherwise("success").alias("slot"), F.lit("").alias("label"), x.response.alias("example"))))
                return F.flatten(F.array_compact(F.array(ask, answer)))

            def labelled(label: Column) -> Column:
                return F.struct(
                    F.flatten(F.transform(f.exchanges, sides)).alias("exchanged"), label.alias("label"), F.when(has, plain(label)).otherwise("").alias("said"),
                    F.when(has, _of_label(label, s.endpoints, s.tails)).otherwise("").alias("named"), n.mode.alias("mode"), n.waiting.alias("waiting"),
                )

            return let(F.when(f.own != "", f.own).otherwise(n.waiting), labelled)

        def moved(r: Column) -> Column:
            def aimed(t: Column) -> Column:
                def filled(slots: Column) -> Column:
                    found = F.transform(slots, lambda e: entry(t.target, e.slot, r.label, r.said, e.example))
                    asks = F.exists(slots, lambda e: e.slot == "request")
                    return F.struct(
                        F.when(has, _when_empty(r.named, a.current)).otherwise(_when_empty(f.endpoint, a.current)).alias("current"),
                        F.when(has & asks, t.target).when(has, t.led).otherwise(a.led).alias("led"),
                        r.mode.alias("mode"), F.when(has, "").otherwise(r.waiting).alias("label"), F.concat(a.out, r.exchanged, found).alias("out"),
                    )

                return let(F.transform(f.parsed, lambda e: F.struct(_slot(r.said, r.mode, e).alias("slot"), e.example.alias("example"))), filled)

            return let(let(_when_empty(r.named, a.led), lambda led: F.struct(led.alias("led"), _when_empty(led, a.current).alias("target"))), aimed)

        return let(let(begun, taken), moved)

    return F.aggregate(F.transform(s.content, _facts), start, step).getField("out")


def _is_blank(json: Column) -> Column:
    return json.rlike(r'^\{\s*\}$') | json.rlike(r'^\{\s*"\?"\s*:\s*""\s*\}$')


def _stored(entries: Column) -> Column:
    """The first example of each endpoint and slot that is no placeholder, else the last placeholder; all listed ones."""
    same = lambda x, y: (x.endpoint == y.endpoint) & (x.slot == y.slot)

    def one(x: Column, i: Column) -> Column:
        kept = let(F.filter(entries, lambda y: same(x, y)), lambda alike: F.coalesce(_first(alike, lambda y: ~_is_blank(y.example)), F.element_at(alike, F.size(alike))))
        is_first = ~F.exists(F.slice(entries, F.lit(1), i), lambda y: same(x, y))
        return F.when(x.slot == "additional", x).when(is_first, kept)

    return F.array_compact(F.transform(entries, one))


def example_slots(docs: DataFrame, keep: list[str], vendor: str | None = None) -> DataFrame:
    """``keep``, endpoint, slot (request, success, error, additional), label and example of each document.

    A section's endpoints are those of its title, else those in its lines. After each section the first
    of its endpoints that has examples lends them to the others where a slot is empty; nothing is overwritten later.
    """
    named = F.transform(sections(F.col("paragraphs")), lambda s: F.struct(s.title.alias("title"), s.content.alias("content"), _endpoints_of(s).alias("endpoints")))
    lists = F.regexp_replace(F.lower(F.lit("") if vendor is None else F.coalesce(vendor, F.lit(""))), "[^a-z0-9]+", "") == LISTS_REVERSALS
    cut = docs.select(*keep, lists.alias("_lists"), F.filter(named, lambda s: F.size(s.endpoints) > 0).alias("held"))
    tailed = lambda s: F.struct(s.title.alias("title"), s.content.alias("content"), s.endpoints.alias("endpoints"), F.transform(s.endpoints, _tail).alias("tails"))
    told = cut.select(*keep, F.transform(F.transform("held", tailed), lambda s: F.struct(s.endpoints.alias("endpoints"), _section_examples(s, F.col("_lists")).alias("out"))).alias("held"))

    def lend(known: Column, s: Column) -> Column:
        def given(ks: Column) -> Column:
            def of(x: Column) -> Column:
                lent = F.flatten(F.transform(F.filter(s.endpoints, lambda e: e != x.source), lambda e: F.transform(
                    F.filter(x.own, lambda o: ~F.exists(ks, lambda k: (k.endpoint == e) & (k.slot == o.slot))),
                    lambda o: F.struct(e.alias("endpoint"), o.slot.alias("slot"), o.label.alias("label"), o.example.alias("example")))))
                return F.when(x.source.isNotNull(), F.concat(ks, lent)).otherwise(ks)

            own = lambda source: F.struct(source.alias("source"), F.filter(ks, lambda k: k.endpoint == source).alias("own"))
            return let(let(_first(s.endpoints, lambda e: F.exists(ks, lambda k: k.endpoint == e)), own), of)

        return let(_stored(F.concat(known, s.out)), lambda ks: F.when(F.size(s.endpoints) > 1, given(ks)).otherwise(ks))

    every = F.aggregate("held", F.array().cast(f"array<{EXAMPLE}>"), lend)
    placed = told.select(*keep, F.posexplode(every).alias("place", "e"))
    return placed.select(*keep, "place", "e.*")


# ---- endpoints of a document, its checklist, games and capabilities


def _named(paragraphs: Column, tables: Column) -> Column:
    """(endpoint, section, row) of a document's endpoints, each where it is named first, in order of the endpoint."""
    none = F.array().cast("array<array<array<string>>>")
    of_section = F.flatten(F.transform(sections(paragraphs), lambda s: F.transform(
        _endpoints_of(s), lambda e: F.struct(e.alias("endpoint"), s.title.alias("section"), F.lit("").alias("row")))))
    lines = F.transform(F.flatten(F.coalesce(tables, none)), lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " "))
    of_table = F.flatten(F.transform(lines, lambda x: F.transform(all_endpoints(x), lambda e: F.struct(e.alias("endpoint"), F.lit("table").alias("section"), x.alias("row")))))
    first = lambda xs: F.filter(F.transform(xs, lambda x, i: F.when(~F.exists(F.slice(xs, F.lit(1), i), lambda y: y.endpoint == x.endpoint), x)), lambda x: x.isNotNull())
    return F.array_sort(let(F.concat(of_section, of_table), first))


def _endpoints(named: Column, text: Column) -> Column:
    """(endpoint, section, methods, keywords) of named endpoints; both come from the text around the first mention, else from the table's row."""

    def one(x: Column) -> Column:
        def said(around: Column) -> Column:
            words = F.array_union(endpoint_parts.context_keywords(x.endpoint), endpoint_parts.context_keywords(_when_empty(around, x.endpoint)))
            return F.struct(x.endpoint.alias("endpoint"), x.section.alias("section"), endpoint_parts.methods_before(around, x.endpoint).alias("methods"), words.alias("keywords"))

        return let(let(endpoint_parts.context_around(text, x.endpoint), lambda found: _when_empty(found, x.row)), said)

    return F.transform(named, one)


def _text(name: str = "plain_text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def document_endpoints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, endpoint, section, methods, keywords, request and response rows of each endpoint a document names, in order of the endpoint.

    Section titles name endpoints, else the lines of the section, and after all sections the rows of
    tables, whose section is ``table``; the first place counts.
    """
    read = docs.select(*keep, _named(F.col("paragraphs"), F.col("tables")).alias("named"), _text().alias("text"), _given_tables(F.col("paragraphs"), F.col("tables")).alias("given"))
    each = read.select(*keep, "given", F.inline(_endpoints(F.col("named"), F.col("text"))))
    own = _first(F.col("given"), lambda g: g.endpoint == F.col("endpoint"))
    return each.select(*keep, "endpoint", "section", "methods", "keywords", own.getField("request").alias("request"), own.getField("response").alias("response"))


def _place(heads: Column, test) -> Column:
    """The first place, from 0, of a header that passes ``test``; null without one."""
    return F.get(_places(heads, test), F.lit(0))


def _cell(cells: Column, at: Column) -> Column:
    return _trim(F.coalesce(F.get(cells, at), F.lit("")))


#: Rows of a checklist that set nothing, and the part of a name that marks a threshold; what marks a switch; capabilities by name.
SKIPPED, THRESHOLD = ["Result Type", "Operator Endpoint", "Vendor Endpoint", "Process Endround"], "Threshold"
ON, OFF = ["checked", "y", "yes", "true", "1", "enabled"], ["unchecked", "n", "no", "false", "0", "disabled"]
BY_NAME = {
    "Freespin": "free_spin", "Jackpot": "jackpot", "Multiple Bet": "multiple_bets", "Multiple Win": "multiple_settlements", "Refund unsettle bet": "cancel_bet",
    "Cancel settled bet": "rollback_settlements", "Adjustment": "modify_settlements_adjustment", "Process Endround": "process_endround",
}
#: Capabilities and the phrases that speak of them.
CAPABILITIES = {
    "multiple_bets": ["multiple bet", "multiple bets", "same round", "multi bet"], "multiple_settlements": ["multiple settlement", "multiple settlements", "settle twice"],
    "rollback_settlements": ["rollback", "roll back"], "modify_settlements_adjustment": ["adjustment", "modify settlement", "adjust settlement"],
    "cancel_bet": ["cancel bet", "cancel transaction", "refund"], "free_spin": ["free spin", "freespin", "free game"], "jackpot": ["jackpot"],
    "idempotency": ["idempotency", "duplicate", "same transaction"], "retry": ["retry", "re-try"], "wallet": ["wallet", "balance", "cash"],
}


def checklist(tables: Column, tasks: Column | None = None) -> Column:
    """Settings of tables with a name and an enable column, in order: name, description, remark, value, enabled, capability, available and selected values.

    ``enabled`` is true, false, or null where the value is none of both. ``tasks`` holds the task lists
    of cells by table, row and column; a setting's available values are its tasks, selected the checked ones.
    """

    def rows(table: Column, n: Column) -> Column:
        def found(heads: Column) -> Column:
            is_ = lambda name: _place(heads, lambda h: h == name).alias(name)
            return F.struct(is_("name"), is_("description"), is_("remark"), _place(heads, lambda h: h.contains("enable")).alias("enable"))

        def of(at: Column) -> Column:
            name, enable = at["name"], at.enable

            def setting(cells: Column, r: Column) -> Column:
                value = _cell(cells, enable)
                called = _cell(cells, name)
                held = F.get(F.get(F.get(tasks, n), r + 1), enable) if tasks is not None else F.lit(None).cast("array<struct<text:string,checked:boolean>>")
                said = F.filter(F.transform(F.coalesce(held, F.array().cast("array<struct<text:string,checked:boolean>>")), lambda t: F.struct(_trim(F.coalesce(t.text, F.lit(""))).alias("text"), F.coalesce(t.checked, F.lit(False)).alias("checked"))), lambda t: t.text != "")
                low = F.lower(value)
                made = F.struct(
                    called.alias("name"), _cell(cells, at.description).alias("description"), _cell(cells, at.remark).alias("remark"),
                    value.alias("value"), F.when(low.isin(ON), F.lit(True)).when(low.isin(OFF), F.lit(False)).alias("enabled"),
                    F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in BY_NAME.items() for x in pair]), called), F.lit("")).alias("capability"),
                    F.transform(said, lambda t: t.text).alias("available"), F.transform(F.filter(said, lambda t: t.checked), lambda t: t.text).alias("selected"),
                )
                ok = (F.size(cells) > F.greatest(name, enable)) & (called != "") & ~called.isin(SKIPPED) & ~called.contains(THRESHOLD)
                return F.when(ok & name.isNotNull() & enable.isNotNull(), made)

            return F.array_compact(F.transform(F.slice(table, F.lit(2), F.size(table)), setting))

        return let(let(_header(table), found), of)

    return F.flatten(F.transform(F.coalesce(tables, F.array().cast("array<array<array<string>>>")), lambda t, n: F.coalesce(F.when(F.size(t) > 0, rows(t, n)), F.array())))


def game_codes(tables: Column) -> Column:
    """(game_type, game_name, game_code) of tables with a game code column; rows with neither name nor code go."""

    def rows(table: Column) -> Column:
        def of(heads: Column) -> Column:
            code = _place(heads, lambda h: h == "game code")
            made = lambda cells: F.struct(
                _cell(cells, _place(heads, lambda h: h == "gametype")).alias("game_type"), _cell(cells, _place(heads, lambda h: h == "game name")).alias("game_name"), _cell(cells, code).alias("game_code")
            )
            long_enough = F.filter(F.slice(table, F.lit(2), F.size(table)), lambda cells: code.isNotNull() & (F.size(cells) > code))
            return F.filter(F.transform(long_enough, made), lambda g: (g.game_name != "") | (g.game_code != ""))

        return let(_header(table), of)

    return F.flatten(F.transform(F.filter(F.coalesce(tables, F.array().cast("array<array<array<string>>>")), lambda t: F.size(t) > 0), rows))


def capability_profile(docs: DataFrame, keep: list[str], tasks: str | None = None) -> DataFrame:
    """``keep``, supports (capability to whether the document speaks of it), origins and keyword counts.

    Phrases anywhere in the text count; a setting of the checklist that says anything overrides them,
    the last one of a capability. The keyword counts are over the document's endpoints.
    """
    settings = F.filter(checklist(F.col("tables"), F.col(tasks) if tasks else None), lambda s: (s.capability != "") & (s.value != ""))
    low = F.lower(F.coalesce("plain_text", F.lit("")))
    said = F.array(*[F.struct(F.lit(c).alias("capability"), _has(low, ws).alias("said")) for c, ws in CAPABILITIES.items()])
    set_by = lambda c: F.element_at(F.filter("settings", lambda s: s.capability == c), F.size(F.filter("settings", lambda s: s.capability == c)))
    words = F.flatten(F.transform(_endpoints(_named(F.col("paragraphs"), F.col("tables")), _text()), lambda e: e.keywords))
    held = docs.select(*keep, settings.alias("settings"), said.alias("said"), words.alias("words"))
    more = F.array_distinct(F.filter(F.transform("settings", lambda s: s.capability), lambda c: ~c.isin(list(CAPABILITIES))))
    every = F.concat("said", F.transform(more, lambda c: F.struct(c.alias("capability"), F.lit(False).alias("said"))))
    is_set = lambda c: F.exists("settings", lambda s: s.capability == c)
    pairs = F.transform(every, lambda x: F.struct(x.capability.alias("key"), F.when(is_set(x.capability), F.coalesce(set_by(x.capability).enabled, F.lit(True))).otherwise(x.said).alias("value")))
    origins = F.transform(every, lambda x: F.struct(x.capability.alias("key"), F.when(is_set(x.capability), "vendor_master_checklist").otherwise("keyword").alias("value")))
    counts = F.transform(F.array_sort(F.array_distinct("words")), lambda w: F.struct(w.alias("key"), F.size(F.filter("words", lambda x: x == w)).alias("value")))
    return held.select(*keep, F.map_from_entries(pairs).alias("supports"), F.map_from_entries(origins).alias("origins"), F.map_from_entries(counts).alias("keyword_counts"))


# ---- actions


#: Roles of actions, lines around an action that may name its method, lines up to its heading, characters of a title, how sure an action is.
ACTION_ROLES = {"balance": "balance", "bet": "bet", "win": "settlement", "cancel": "rollback", "cancelwin": "rollback", "betandwin": "bet_and_settle", "cancelbetandwin": "rollback"}
METHOD_LINES, HEADING_LINES, TITLE_CHARS, ACTION_SURE = 4, 8, 80, 0.9
#: Fixed value: most keywords of an action.
MOST_KEYWORDS = 12


def actions(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, api_name, method, endpoint, role, keywords, confidence and line_no of each ``action: X`` of a text, each action once, in any case of letters.

    The line is that of the heading above, if near; the name is the heading's, else made of the action; the method is named near it, else POST.
    """
    read = docs.select(*keep, F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1).alias("ls"))
    title = lambda x: F.regexp_extract(F.btrim(x), r"^#{1,6}\s+(.+?)\s*$", 1)
    named = lambda x: F.regexp_extract(x, r"(?i)\baction\s*:\s*([A-Za-z][A-Za-z0-9_]*)", 1)
    heads = F.filter(F.transform("ls", lambda x, i: F.struct(i.alias("i"), title(x).alias("title"))), lambda h: h.title != "")
    met = F.filter(F.transform("ls", lambda x, i: F.struct(i.alias("i"), named(x).alias("action"))), lambda a: a.action != "")
    placed = read.select(*keep, "ls", heads.alias("heads"), met.alias("met"))

    def one(a: Column, n: Column) -> Column:
        head = F.try_element_at(F.filter("heads", lambda h: h.i <= a.i), F.lit(-1))
        words = F.transform(F.regexp_extract_all(a.action, F.lit(r"([A-Z]?[a-z]+|[A-Z]+(?=[A-Z]|$)|\d+)"), F.lit(1)), lambda w: F.initcap(w))
        made = F.concat(F.array_join(words, " "), F.lit(" Action"))
        plain = _trim(F.regexp_replace(F.regexp_replace(F.coalesce(head.title, made), "[\u200b-\u200f\ufeff]", ""), "[*_`?]+", ""))
        name = F.when((plain != "") & (F.length(plain) <= TITLE_CHARS), plain).otherwise(made)
        low = F.greatest(F.lit(0), a.i - METHOD_LINES)
        near = F.upper(F.regexp_extract(F.array_join(F.slice("ls", low + 1, a.i + METHOD_LINES + 1 - low), " "), r"(?i)\b(GET|POST|PUT|DELETE|PATCH)\b", 1))
        role = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in ACTION_ROLES.items() for x in pair]), F.lower(a.action)), F.lit(""))
        said = F.regexp_extract_all(F.lower(F.concat(name, F.lit(" "), a.action)), F.lit("([a-z][a-z0-9_]{2,})"), F.lit(1))
        keywords = F.slice(F.array_distinct(F.concat(F.when(role != "", F.array(role)).otherwise(F.array().cast("array<string>")), said)), 1, MOST_KEYWORDS)
        is_first = ~F.exists(F.slice("met", F.lit(1), n), lambda b: F.lower(b.action) == F.lower(a.action))
        line = F.when(a.i - head.i <= HEADING_LINES, head.i).otherwise(a.i)
        return F.when(is_first, F.struct(
            name.alias("api_name"), _when_empty(near, F.lit("POST")).alias("method"), F.concat(F.lit("action:"), a.action).alias("endpoint"), role.alias("role"), keywords.alias("keywords"),
            F.lit(ACTION_SURE).alias("confidence"), line.alias("line_no")))

    return placed.select(*keep, F.inline(F.array_compact(F.transform("met", one))))
