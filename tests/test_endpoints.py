"""Endpoint operators on small texts: fallbacks, empty and null values, and methods from nearby lines."""

from pyspark.sql import functions as F

from docwright.operators import endpoints


def test_candidates_of_small_documents(spark):
    docs = [
        (1, "# Bet API\n\nEndpoint:\n\nhttps://h.example/balance\n\nuse GET"), (2, None), (3, ""), (4, "Source URL: https://h.example/api/x"),
        (5, "POST /a/bet and PUT /a/cancel."), (6, "/api/one\n| Method | delete |"), (7, "path /b/c"), (8, "x/api/one"),
    ]
    rows = endpoints.candidates(spark.createDataFrame(docs, "id int, text string"), "id").orderBy("id", "line_no", "endpoint").collect()
    assert [(r.id, r.line_no, r.api_name, r.method, r.endpoint, r.confidence) for r in rows] == [
        (1, 4, "Bet API", "GET", "https://h.example/balance", 0.9),
        (5, 0, "Bet API", "POST", "/a/bet", 0.9), (5, 0, "Cancel API", "PUT", "/a/cancel", 0.9),
        (6, 0, "One API", "DELETE", "/api/one", 0.85), (7, 0, "C API", "unknown", "/b/c", 0.75),
    ]
    assert endpoints.candidates(spark.createDataFrame([], "id int, text string"), "id").count() == 0


def test_context_and_methods(spark):
    rows = [("ab PUT /x$1 get  /x$1 POST/x$1y", "/x$1"), ("none", "/x"), ("a" * 2000 + "/x" + "b" * 2000, "/x"), (None, "/x")]
    df = spark.createDataFrame(rows, "text string, needle string")
    got = df.select(endpoints.context_around(F.col("text"), F.col("needle")).alias("c"), endpoints.methods_before(F.col("text"), F.col("needle")).alias("m")).collect()
    assert [r.c for r in got] == [rows[0][0], "", "a" * 700 + "/x" + "b" * 700, ""]
    assert [r.m for r in got[:3]] == [["GET", "POST", "PUT"], [], []]


def test_parameters_with_nulls(spark):
    df = spark.createDataFrame([(None, None, None, None, None)], "name string, kind string, description string, required string, remark string")
    said = endpoints.predicates(*[F.col(c) for c in df.columns])
    assert not any(df.select(*[c.alias(n) for n, c in said.items()], endpoints.is_rollback(F.col("name"), F.col("kind"))).first())


def found(spark, *texts):
    rows = endpoints.candidates(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, text string"), "k").collect()
    return [[(r.line_no, r.api_name, r.method, r.endpoint, r.confidence) for r in rows if r.k == i] for i in range(len(texts))]


def test_cut_endpoints_are_repaired_from_their_context(spark):
    a, b, c = found(spark, "Endpoints /v1/games/ list/all now", "Endpoints /v1/a.b/\nlist-x", "Endpoint /v1/games/ list")
    assert [x[3] for x in a] == ["/v1/games/list/all"] and [x[3] for x in b] == ["/v1/a.b/list-x"] and [x[3] for x in c] == ["/v1/games/"]


def test_headings_requests_and_callbacks_name_endpoints(spark):
    a, b, c, d = found(
        spark, "HTTP Method: PUT\n" + "\n" * 9 + "rollback  on result", "try ?request=wagerAndResult", "|POST|**/{Base}/x**|\n```\n{ POST /skipped }\n## **GetBalance**\n\n### Credit & Refund", "| Auth Token | x |\n## • Auth",
    )
    assert a == [(10, "Rollback On Result", "PUT", "request:reversewin", 0.9)]
    assert b == [(0, "Wager And Result", "GET", "request:wagerAndResult", 0.85)]
    assert [x[1:4] for x in c if x[4] in (0.9, 0.88) and x[0] > 2] == [("GetBalance", "POST", "/{Partner_base_URL}/GetBalance"), ("Credit", "POST", "keyword:credit"), ("Refund", "POST", "keyword:refund")]
    assert [x[1:] for x in d] == [("Auth", "POST", "keyword:auth", 0.78), ("Auth", "POST", "keyword:auth", 0.88)]


def test_a_heading_takes_the_address_above_it(spark):
    (a,) = found(spark, "POST **/{Partner_base_URL}**\n" + "x\n" * 5 + "## Win\n" + "y\n" * 50 + "## Bet")
    assert [(x[1], x[3]) for x in a if x[4] == 0.9] == [("Win", "/{Partner_base_URL}"), ("Bet", "/{Partner_base_URL}/Bet")]


def test_candidates_of_equal_and_null_keys_stay_apart(spark):
    df = spark.createDataFrame([(1, "# A\nPOST /a"), (1, "# B\n\nPOST /b"), (None, "GET /c"), (None, "GET /d"), (2, None), (3, "")], "k int, text string")
    got = endpoints.candidates(df, "k")
    assert sorted((r.k or 0, r.api_name, r.line_no) for r in got.collect()) == [(0, "C API", 0), (0, "D API", 0), (1, "A", 1), (1, "B", 2)]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_headings_of_a_document_are_read_once(spark):
    """A heading's pattern stands once in the plan, outside the lambda over lines, so work grows with the lines and not with their square."""
    made = spark.createDataFrame([(1, "# Top\nPOST /v1/bet\n/api/x")], "k int, text string").repartition(1)
    got = endpoints.candidates(made, "k")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("^#{1,6}\\s+(.+?)\\s*$") < plan.index("(/[A-Za-z0-9_./{}")
    assert [(r.line_no, r.api_name) for r in got.orderBy("line_no").collect()] == [(1, "Top"), (2, "Top")]
