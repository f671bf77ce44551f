"""Interface documents as rows: sections, tables, codes, variants and examples on small documents."""

import pytest

from docwright.operators import vendor_docs
from docwright.sources import office

DDL = "k int, paragraphs array<struct<style:string,text:string>>, tables array<array<array<string>>>, plain_text string, vendor string"
REQUEST = [["Parameter", "Type", "Require", "Description"], ["userId", "String", "Y", "Player"], ["hash", "String", "Y", "Signature"]]
RESPONSE = [["Parameter", "Type", "Require", "Description"], ["balance", "Integer", "Y", "Balance"]]
XML = "<EXTSYSTEM><REQUEST><USERID>u1</USERID></REQUEST>\n <RESPONSE><RESULT>ERROR</RESULT><CODE>610</CODE></RESPONSE></EXTSYSTEM>"


def wallet():
    made = []
    for n, (title, digest) in enumerate([("(Bet)", "abc"), ("(Win)", "def")], 1):
        made += [("h2", f"2.{n} /api/v1/wallet.do {title}"), ("p", "request example:"), ("pre", f"https://example.com/api/v1/wallet.do?\n&userId=u1\n&hash={digest}"), ("pre", XML)]
    return made


@pytest.fixture
def docs(spark):
    def made(*rows):
        return vendor_docs.read_json(spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], DDL).repartition(2))

    return made


def test_two_sections_of_one_endpoint_are_two_variants(docs):
    d = docs((1, wallet(), [REQUEST, RESPONSE, REQUEST, RESPONSE]))
    a, b = vendor_docs.operation_variants(d, ["k"]).collect()
    assert [a.operation, b.operation] == ["Bet", "Win"] and a.endpoint == b.endpoint == "/api/v1/wallet.do"
    assert a.requests[0].example == '{"userId":"u1","hash":"abc"}' and a.errors == ['{"result":"ERROR","code":"610"}']
    assert [p["name"] for p in b.request_parameters] == ["userId", "hash"] and b.response_parameters == [{"name": "balance", "type": "Integer", "required": "Y", "description": "Balance"}]
    (only,) = vendor_docs.endpoint_tables(d, ["k"]).collect()
    assert only.endpoint == "/api/v1/wallet.do" and len(only.request) == 2
    slots = {r.slot: r.example for r in vendor_docs.example_slots(d, ["k"]).collect()}
    assert slots == {"request": '{"userId":"u1","hash":"abc"}', "error": '{"result":"ERROR","code":"610"}'}


def test_heading_stack_labels_and_tables(docs):
    said = [
        ("h3", "POST /api/a (One)"), ("h4", "Request"), ("h4", "Example Request"), ("p", '{"type": "x", "action": 2}'), ("h5", "Example response"), ("p", '{"status": 1}{"status": 2}'),
        ("h4", "example request"), ("p", '{"status": 9}'), ("p", '{"b": true,}'), ("h2", "closed"), ("h4", "Example request"), ("p", '{"lost": 1}'),
        ("heading 3 numbered", "see /api/a - Two"), ("heading 4", "Response"), ("h3", "put /api/a"),
    ]
    one, two, three = vendor_docs.operation_variants(docs((1, said, [RESPONSE, REQUEST])), ["k"]).collect()
    assert (one.method, one.operation, two.operation, three.operation) == ("POST", "One", "Two", "")
    assert [(r.label, r.example) for r in one.requests] == [("x / 2", '{"type": "x", "action": 2}')]  # a response under a request label, and an object with a trailing comma, are none
    assert one.successes == ['{"status": 1}', '{"status": 2}']
    assert [len(v.request_parameters) for v in (one, two, three)] == [1, 0, 0] and [len(v.response_parameters) for v in (one, two, three)] == [0, 2, 0]


def test_a_single_variant_needs_several_requests(docs):
    one = [("h3", "1 /api/a"), ("h4", "example request"), ("p", '{"a": 1}')]
    assert vendor_docs.operation_variants(docs((1, one), (2, [*one, ("p", '{"a": 2}')])), ["k"]).select("k").collect() == [(2,)]


def test_missing_and_extra_tables(docs):
    said = [("h2", "1 /api/a"), ("p", "x"), ("h2", "2 /api/b and /api/c"), ("p", "x"), ("h2", "3 /api/d"), ("p", "x")]
    got = {r.endpoint: r for r in vendor_docs.endpoint_tables(docs((1, said, [REQUEST, [["Name"]], RESPONSE, REQUEST])), ["k"]).collect()}
    assert len(got["/api/a"].response) == 1 and len(got["/api/b"].request) == len(got["/api/c"].request) == 2
    assert got["/api/b"].response is None and got["/api/d"].request is None
    extra = {r.endpoint: r for r in vendor_docs.endpoint_tables(docs((1, said[:2], [REQUEST, RESPONSE, REQUEST])), ["k"]).collect()}
    assert len(extra) == 1 and extra["/api/a"].response[0]["name"] == "balance"


def test_ragged_rows_and_repeated_headers(docs):
    table = [["Parameter", " TYPE ", "Game  Type", "type"], ["a"], ["", "int"], ["b", "int", "g", "long", "beyond"]]
    (got,) = vendor_docs.endpoint_tables(docs((1, [("h2", "1 /api/a"), ("p", "")], [table])), ["k"]).collect()
    assert got.request == [{"name": "a"}, {"name": "b", "type": "long", "game_type": "g"}]


def codes(d):
    return [(r.code, r.context, r.tier) for r in vendor_docs.error_codes(d, ["k"]).orderBy("k", "place").collect()]


def test_codes_of_tables_stand_before_streams(docs):
    tables = [
        [["Error ID (no)", "Description", "Related exceptions"], ["7", " seven ", "E7"], ["x y", "no code"], ["9"]], [["Message", "Related Exceptions"], ["Invalid token", "thrown"], ["fine", "no"]], [], [["Name"], ["1"]],
    ]
    stream = [("h2", "List of Error Codes"), ("p", "Code"), ("p", "7"), ("p", "other"), ("p", "BAD_HASH"), ("p", "Message"), ("p", "wrong"), ("p", "hash"), ("p", "11"), ("p", "BAD_HASH")]
    assert codes(docs((1, stream, tables))) == [
        ("7", "seven | E7", 1), ("11", "", 2), ("BAD_HASH", "", 2), ("Code", "", 2), ("hash", "", 2), ("Invalid token", "thrown", 1), ("Message", "", 2), ("other", "", 2), ("wrong", "", 2),
    ]


def test_stream_modes(docs):
    digits = [("h2", "Errors"), ("p", "before"), ("p", "12"), ("p", "one"), ("p", "description"), ("p", "two"), ("p", "0012345")]
    told = [("h2", "x"), ("p", "error code list"), ("p", "Message"), ("p", "Related exception"), ("p", "Invalid hash"), ("p", "A"), ("p", "B"), ("p", "Funds too low"), ("p", "C")]
    assert codes(docs((1, digits))) == [("12", "one | two | 0012345", 2)]
    assert codes(docs((2, told))) == [("error code list", "Related exception", 2), ("Funds too low", "C", 2), ("Invalid hash", "A | B", 2)]


def test_plain_text_serves_documents_without_codes(docs):
    text = "x" * 150 + " status: 404 is\nlost " + "y" * 200 + " code=ABC_12 and error 7 code 1234567 error 88"
    got = codes(docs((1, [("p", "nothing")], None, text)))
    assert [c[0] for c in got] == ["88", "404"] and all(c[2] == 3 for c in got)
    assert got[1][1] == ("x" * 119 + " status: 404 is lost " + "y" * 171)
    assert codes(docs((1, [("h2", "Errors"), ("p", "5")], None, text))) == [("5", "", 2)]


def test_examples_follow_labels_and_are_not_overwritten(docs):
    said = [
        ("h2", "Wallet /api/x/bet /api/x/win"), ("p", "Request example"), ("pre", '{"?": ""}'), ("pre", '{"a": 1}'), ("pre", '{"a": 2}'), ("p", "win response"), ("pre", '{"status": 1}'), ("pre", 'bet request {"late": 1}'),
        ("pre", '{"error": 5}'), ("h2", "Later /api/x/bet"), ("pre", '{"status": 7}'), ("h2", "Shared"), ("p", "see /api/x/bet and /api/y/new"), ("p", "text"),
    ]
    got = {(r.endpoint, r.slot): r.example for r in vendor_docs.example_slots(docs((1, said)), ["k"]).collect()}
    assert got["/api/x/bet", "request"] == '{"a": 1}' and got["/api/x/bet", "error"] == '{"error": 5}'
    assert got["/api/y/new", "request"] == '{"a": 1}' and got["/api/x/win", "request"] == '{"a": 1}'
    assert ("/api/x/bet", "success") in got


def test_one_vendors_reversals_are_listed(docs):
    said = [("h2", "1 /api/x"), ("p", "Cancel example"), ("pre", '{"a": 1}'), ("p", "rollback example"), ("pre", '{"a": 2}'), ("p", "request"), ("pre", '{"a": 3}')]
    for vendor, want in (("SoftGaming", [("additional", "Cancel example", '{"a": 1}'), ("additional", "rollback example", '{"a": 2}'), ("request", "", '{"a": 3}')]), ("x", [("request", "", '{"a": 1}')])):
        got = vendor_docs.example_slots(docs((1, said, None, None, vendor)), ["k"], "vendor").collect()
        assert [(r.slot, r.label, r.example) for r in got] == want


def test_equal_and_null_keys_empty_documents_and_no_shuffle(docs, spark):
    stream = [("h2", "Errors"), ("p", "5")]
    d = docs((1, stream), (1, [("h2", "Errors"), ("p", "6")]), (None, stream), (None, stream), (2, None), (3, [None, (None, None)], [None, []], ""))
    assert sorted(r.code for r in vendor_docs.error_codes(d, ["k"]).collect()) == ["5", "5", "5", "6"]
    for f in (vendor_docs.error_codes, vendor_docs.endpoint_tables, vendor_docs.operation_variants, vendor_docs.example_slots):
        assert "Exchange" not in f(vendor_docs.read_json(spark.createDataFrame([], DDL)), ["k"])._jdf.queryExecution().executedPlan().toString()
        assert f(docs((2, None), (3, [None, (None, None)], [None, []], "")), ["k"]).collect() == []


def test_documents_are_assembled_from_office_rows(spark):
    html = "<h2>2 /api/a (Bet)</h2><p>see below</p><table><tr><th>Parameter</th><th>Type</th></tr><tr><td>id</td><td>int</td></tr></table><h2>Errors</h2><p>12</p><p>low</p>"
    rows = office._framed([r | {"pos": i} for i, r in enumerate(office.html_rows("f.html", html))])
    d = vendor_docs.from_rows(spark.createDataFrame(rows.astype(object).where(rows.notna(), None), office.PARTS))
    read = vendor_docs.read_json(d)
    assert vendor_docs.endpoint_tables(read, ["file"]).collect()[0].request == [{"name": "id", "type": "int"}]
    assert [(r.code, r.context) for r in vendor_docs.error_codes(read, ["file"]).collect()] == [("12", "low")]


def test_checklist_values_and_tasks(spark):
    table = [["Name", "Description", "Remark", "enable"], ["Game Type", "", "", ""], ["Freespin", " d ", "r", "Checked"], ["Jackpot", "", "", "maybe"], ["Result Type", "", "", "y"], ["Loss Threshold", "", "", "y"], ["short"], ["", "", "", "y"]]
    tasks = [[[], [[], [], [], [("Slot Game", True), ("Live Game", False), (" Video Bingo ", True), (" ", True)]]]]
    df = spark.createDataFrame([([table, [], [["Name"], ["x"]]], tasks), (None, None), ([[None]], None)], "tables array<array<array<string>>>, tasks array<array<array<array<struct<text:string,checked:boolean>>>>>")
    got = [r.s for r in df.select(vendor_docs.checklist(df["tables"], df["tasks"]).alias("s")).collect()]
    assert [(s.name, s.enabled, s.capability) for s in got[0]] == [("Game Type", None, ""), ("Freespin", True, "free_spin"), ("Jackpot", None, "jackpot")]
    assert got[0][0].available == ["Slot Game", "Live Game", "Video Bingo"] and got[0][0].selected == ["Slot Game", "Video Bingo"]
    assert (got[0][1].description, got[0][1].remark) == ("d", "r") and got[1] == got[2] == []


def test_capabilities_are_overridden_by_the_checklist(docs):
    table = [["name", "Enable"], ["Jackpot", "n"], ["Process Endround", "y"], ["Freespin", ""], ["Multiple Win", "no"], ["Multiple Win", "ask"]]
    said = [("h2", "1 POST /api/x/balance"), ("p", "a Jackpot and a free spin; call GET /api/x/balance")]
    (got,) = vendor_docs.capability_profile(docs((1, said, [table], "1 POST /api/x/balance\na Jackpot and a free spin; call GET /api/x/balance")), ["k"]).collect()
    assert (got.supports["jackpot"], got.origins["jackpot"]) == (False, "vendor_master_checklist")
    assert (got.supports["free_spin"], got.origins["free_spin"]) == (True, "keyword") and got.supports["multiple_settlements"] and got.supports["wallet"]
    assert "process_endround" not in got.supports and len(got.supports) == 10  # its row is one of those that set nothing
    assert got.keyword_counts == {"balance": 1, "jackpot": 1, "free_spin": 1}
    (none,) = vendor_docs.capability_profile(docs((2, None)), ["k"]).collect()
    assert not any(none.supports.values()) and none.keyword_counts == {}


def test_endpoints_of_titles_lines_and_tables(docs):
    said = [("h2", "see post /api/b"), ("p", "GET /api/a"), ("h2", "plain"), ("p", "GET /api/a and PUT /api/c")]
    text = "post /api/b\nGET /api/a rollback\n"
    rows = vendor_docs.document_endpoints(docs((1, said, [[["x", "DELETE /api/d"], [None, "GET /api/a"]], REQUEST], text)), ["k"]).collect()
    assert [(r.endpoint, r.section, r.methods) for r in rows] == [("/api/a", "plain", ["GET"]), ("/api/b", "see post /api/b", ["POST"]), ("/api/c", "plain", []), ("/api/d", "table", ["DELETE"])]
    assert rows[0].keywords == ["rollback"] and len(rows[1].request) == 2 and rows[0].request is None


def test_game_codes(spark):
    tables = [[["Game Code", "gametype"], ["g1", " slot "], ["", ""], [" g2"]], [["x"], ["y"]], [["Game Name", "game code"], ["n", ""], ["only"]]]
    df = spark.createDataFrame([(tables,), (None,)], "t array<array<array<string>>>")
    got = [[tuple(g) for g in r.g] for r in df.select(vendor_docs.game_codes(df["t"]).alias("g")).collect()]
    assert got == [[("slot", "", "g1"), ("", "", "g2"), ("", "n", "")], []]


def test_actions_once_with_heading_and_method(spark):
    text = "# **Bet?** calls\n" + "x\n" * 3 + "action: betAndWin\nACTION : BETANDWIN\n" + "y\n" * 9 + "action:Cancel_it then\nuse PATCH"
    df = spark.createDataFrame([(1, text), (1, "action: win"), (None, None)], "k int, text string")
    got = sorted((r.k, r.line_no, r.api_name, r.method, r.endpoint, r.role) for r in vendor_docs.actions(df, ["k"]).collect())
    assert got == [(1, 0, "Bet calls", "POST", "action:betAndWin", "bet_and_settle"), (1, 0, "Win Action", "POST", "action:win", "settlement"), (1, 15, "Bet calls", "PATCH", "action:Cancel_it", "")]


def test_read_json_of_nulls_and_repeated_texts(spark):
    rows = [(1, [("p", '{"a": 1,} {"b": 2}'), None, (None, None)], None, None, None), (2, None, None, None, None), (3, [], None, None, None), (4, [("h2", '{"a": 1,} {"b": 2}')], None, None, None)]
    got = {r.k: [tuple(p) for p in r.paragraphs] for r in vendor_docs.read_json(spark.createDataFrame(rows, DDL).repartition(1)).collect()}
    read = ('{"a": 1,} {"b": 2}', ['{"b": 2}'], ['{"a": 1}', '{"b": 2}'])
    assert got == {1: [("p", *read), ("", "", [], []), ("", "", [], [])], 2: [], 3: [], 4: [("h2", *read)]}


@pytest.mark.parametrize("name", ["p09_document_endpoints", "p10_operation_variants", "p11_example_slots", "p14_document_codes", "p15_capability_profile", "p16_document_candidates", "j01_endpoint_tables"])
def test_documents_of_one_file_are_dealt_over_the_cores(spark, name):
    from docwright.extraction_queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert f"RoundRobinPartitioning({4 * spark.sparkContext.defaultParallelism})" in plan
