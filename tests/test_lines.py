"""Lines of documents: equal and null keys, empty texts, and plans without a shuffle."""

from pyspark.sql import functions as F

from docwright.operators import extraction, lines, pages

HEAD = lambda x: x.startswith("#")


def test_documents_with_one_key_stay_apart(spark):
    df = spark.createDataFrame([(1, "#a\nx\n#b"), (1, "y\n#c"), (None, "#d\nz"), (None, None), (2, "")], "k int, text string")
    got = sorted((r.k or 0, r.section, r.title, r.start, r.n_lines) for r in lines.sections(df, "k", HEAD).collect())
    assert got == sorted([(1, 1, "#a", 0, 2), (1, 2, "#b", 2, 1), (1, 0, "Overview", 0, 1), (1, 1, "#c", 1, 1), (0, 1, "#d", 0, 2), (0, 0, "Overview", 0, 1), (2, 0, "Overview", 0, 1)])
    carried = sorted((r.k or 0, r.line_no, r.line, r.heading or "") for r in lines.with_heading(df, "k", HEAD).collect())
    assert carried == sorted([(1, 0, "#a", "#a"), (1, 1, "x", "#a"), (1, 2, "#b", "#b"), (1, 0, "y", ""), (1, 1, "#c", "#c"), (0, 0, "#d", "#d"), (0, 1, "z", "#d"), (0, 0, "", ""), (2, 0, "", "")])
    near = {(r.k, r.line_no): r.context for r in lines.contexts(df, "k", lambda x: x == "x", 1, 5).collect()}
    assert near == {(1, 1): "#a\nx\n#b"}
    assert sorted((r.k, r.title, r.n_examples) for r in extraction.variants(df, "k", HEAD, lambda x: x == "x").collect()) == [(1, "#a", 1), (1, "#b", 0)]
    acts = extraction.action_index(df, "k", lambda x: F.lower(x).isin("x", "y", "z"), HEAD).collect()
    assert sorted((r.k or 0, r.action, r.line_no, r.start) for r in acts) == [(0, "z", 1, 0), (1, "x", 1, 0), (1, "y", 0, 0)]


def test_no_line_is_shuffled(spark):
    df = spark.createDataFrame([(1, "a")], "k int, text string")
    for made in (lines.sections(df, "k", HEAD), lines.with_heading(df, "k", HEAD), lines.contexts(df, "k", HEAD, 6, 7), extraction.variants(df, "k", HEAD, HEAD), extraction.action_index(df, "k", HEAD, HEAD)):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_pages_are_cut_at_their_own_tags():
    page = "<body><article><h1>İİİİİİİİİİİİ</h1><p>one</p></ARTICLE ><p>between</p><article><p>two</p></article><footer>footer</footer></body>"
    assert pages.markdown_of(page, None) == "# İİİİİİİİİİİİ\n\none\n"
    assert pages.markdown_of("<main><p>open", None) == "open\n"
