"""Selections on small tables: checked labels, and errors from examples or none at all."""

from pyspark.sql import functions as F

from docwright.operators import selection


def test_checked_types(spark):
    df = spark.createDataFrame([(1, [" Mini  Game (Instant Win)", "SLOTS", "slot game", "other", None]), (2, []), (3, None)], "id int, labels array<string>")
    got = df.select("id", selection.checked_types(F.col("labels")).alias("t")).orderBy("id").collect()
    assert [r.t for r in got] == [["instant_win", "mini_game", "slot_game"], [], None]


def test_errors(spark):
    codes = [
        ("a", 1, "1", "odd"), ("a", 2, "2", "Bad-Request"), ("b", 1, "0", None), ("b", 2, "7", "odd"), ("b", 3, "8", "Network down"), ("c", 1, "1", "x"), ("c", 2, "2", None),
        ("d", 1, None, None), ("e", 1, "1", "x"), ("e", 2, "2", "Invalid_Signature"),
    ]
    examples = [("c", 1, "FIRST"), ("c", 2, "BAD_REQUEST"), ("e", 1, "lower"), ("e", 2, "B2"), ("e", 3, "A1"), ("f", 1, None)]
    got = selection.errors(
        spark.createDataFrame(codes, "vendor string, pos int, code string, description string"), spark.createDataFrame(examples, "vendor string, pos int, value string")
    )
    assert {r.vendor: (r.code, r.encryption_code) for r in got.collect()} == {
        "a": ("2", None), "b": ("7", None), "c": ("BAD_REQUEST", None), "d": (None, None), "e": ("B2", "2"),
    }


def test_flags_may_be_null(spark):
    null = F.lit(None).cast("boolean")
    found = selection.categories({"jackpot": null}, F.lit(None).cast("string"), null, F.lit("combined_endpoint"), F.lit(None).cast("string"), null, null)
    assert spark.range(1).select(found.alias("c")).first().c == sorted([*selection.ALWAYS, "bet_and_settle"])
