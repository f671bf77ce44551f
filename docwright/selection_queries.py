"""Registered queries of selection for a vendor, with their SQL. Parts stand for vendors and their codes, with texts chosen by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from docwright.case_queries import listed, one_of
from docwright.operators import selection
from docwright.oracles import ORACLES
from docwright.queries import query

FLAGS = ["multiple_bets", "multiple_settlements", "rollback_settlements", "modify_settlements_adjustment", "cancel_bet", "idempotency", "jackpot", "free_spin"]
BET_MODES = ["one_bet_endpoint", "two_bet_endpoint", "missing", "one_bet_endpoint_with_action_parameter", "none"]
KINDS = ["Video Slot", "live", "Crash", "poker table", "instant bingo", "other", "Casino"]
CODES = ["1001", "OK", "BAD_REQUEST", "E7", "", "0", "INVALID_HMAC", "E9", "42"]
SAYINGS = ["insufficient funds", "all well", "Invalid  parameters", "strange", "token gone", "wrong hash given", "", "Network", "Parameters are missing or invalid", "game not found", "odd"]
VALUES = ["lower", "FIRST_ONE", "BAD_REQUEST", "X1", "no Code"]


def bit(i: int):
    return F.expr(f"(p_partkey * 7 >> {i}) % 2 = 1")


@query
def c04_selected_categories(t, spark):
    k = F.col("p_partkey")
    chosen = selection.categories(
        {f: bit(i) for i, f in enumerate(FLAGS)}, F.when(k % 3 == 0, "endpoint_present"), k % 2 == 0, F.when(k % 5 < 2, "combined_endpoint"),
        one_of(BET_MODES), F.when(k % 4 > 0, k % 4 == 1), k % 11 == 0,
    )
    return t("part").select("p_partkey", F.array_join(chosen, ",").alias("categories"))


@query
def c04_game_types(t, spark):
    games = t("part").select(F.floor(F.col("p_partkey") / 4).alias("vendor"), one_of(KINDS).alias("kind"), "p_name", F.when(F.col("p_partkey") % 13 == 0, "idna_7").alias("code"))
    return selection.game_types(games, "vendor", "kind", "p_name", "code").select("vendor", F.array_join("game_types", ",").alias("game_types"))


@query
def c06_selected_errors(t, spark):
    codes = t("part").select(F.floor(F.col("p_partkey") / 3).alias("vendor"), F.col("p_partkey").alias("pos"), one_of(CODES).alias("code"), one_of(SAYINGS).alias("description"))
    examples = t("part").filter("p_partkey % 6 < 2").select(F.floor(F.col("p_partkey") / 3).alias("vendor"), F.col("p_partkey").alias("pos"), one_of(VALUES).alias("value"))
    return selection.errors(codes, examples)


_BIT = {f: f"(p_partkey * 7 >> {i}) % 2 = 1" for i, f in enumerate(FLAGS)}
_CASES = [
    *[(_BIT[c], name) for c, name in selection.BY_CAPABILITY.items()],
    ("p_partkey % 3 = 0", "authenticate"), ("p_partkey % 6 = 0", "authentication_is_necessary"), ("p_partkey % 5 < 2", "bet_and_settle"),
    ("p_partkey % 5 < 2 AND p_partkey % 4 = 1", "bet_and_settle_has_round_end_control_parameter"),
    (f"{_BIT['multiple_bets']} AND p_partkey % 5 IN (0, 3)", "multiple_bets_one_bet_endpoint"), (f"{_BIT['multiple_bets']} AND p_partkey % 5 = 1", "multiple_bets_two_bet_endpoint"),
    (f"{_BIT['multiple_settlements']} AND p_partkey % 4 = 1", "multiple_settlements_has_round_end_control_parameter"),
    (f"{_BIT['multiple_settlements']} AND p_partkey % 4 <> 1", "multiple_settlements_no_round_end_control_parameter"),
    (f"{_BIT['free_spin']} OR p_partkey % 11 = 0", "freespin"),
]
_ANY = "regexp_matches({}, '{}')".format
ORACLES.update({
    "c04_selected_categories": f"""SELECT p_partkey, array_to_string(list_sort(list_filter({selection.ALWAYS!r} || [{', '.join(f"CASE WHEN {w} THEN '{c}' END" for w, c in _CASES)}], lambda x: x IS NOT NULL)), ',') AS categories FROM part""",
    "c04_game_types": f"""WITH g AS (SELECT CAST(p_partkey // 4 AS BIGINT) AS vendor, lower({listed(KINDS)} || ' ' || p_name) AS x, p_partkey % 13 = 0 AS idna FROM part),
        y AS (SELECT DISTINCT vendor, c FROM g JOIN (VALUES {', '.join(f"('{c}', '{w}')" for c, w in selection.GAMES.items())}) v(c, w) ON regexp_matches(x, w) OR (idna AND c = 'arcade_game'))
        SELECT vendor, coalesce(string_agg(c, ',' ORDER BY c), '') AS game_types FROM (SELECT DISTINCT vendor FROM g) LEFT JOIN y USING (vendor) GROUP BY vendor""",
    "c06_selected_errors": f"""WITH c AS (SELECT CAST(p_partkey // 3 AS BIGINT) AS vendor, p_partkey AS pos, {listed(CODES)} AS code, {listed(SAYINGS)} AS said FROM part),
        f AS (SELECT *, lower(code || ' ' || said) AS x FROM c),
        w AS (SELECT *, row_number() OVER (PARTITION BY vendor ORDER BY tier, pos) AS place, count(*) FILTER (WHERE tier = 2) OVER (PARTITION BY vendor) AS n FROM
          (SELECT *, CASE WHEN {_ANY("translate(x, '_-', '  ')", '|'.join(selection.PARAMETER))} THEN 1
            WHEN code NOT IN ('', '0', 'OK') AND NOT {_ANY('x', '|'.join(selection.OTHER))} THEN 2 ELSE 3 END AS tier FROM f)),
        e AS (SELECT CAST(p_partkey // 3 AS BIGINT) AS vendor, p_partkey AS pos, {listed(VALUES)} AS value FROM part WHERE p_partkey % 6 < 2),
        v AS (SELECT vendor, coalesce(max(value) FILTER (WHERE value = 'BAD_REQUEST'), arg_min(value, pos)) AS value FROM e WHERE value NOT IN ('lower', 'no Code') GROUP BY 1),
        s AS (SELECT vendor, arg_min(code, pos) AS encryption_code FROM f WHERE code <> '' AND {_ANY("replace(x, '_', ' ')", '|'.join(selection.SIGNATURE))} GROUP BY 1)
        SELECT vendor, CASE WHEN tier = 1 OR (tier = 2 AND n = 1) THEN code ELSE value END AS code,
          CASE WHEN tier = 1 OR (tier = 2 AND n = 1) THEN said WHEN value IS NOT NULL THEN '{selection.NO_EXAMPLE}' END AS description, encryption_code
        FROM w LEFT JOIN v USING (vendor) LEFT JOIN s USING (vendor) WHERE place = 1""",
})
