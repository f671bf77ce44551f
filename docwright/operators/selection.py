"""What is chosen for a vendor: categories of cases from capabilities and topology, game types, and its errors for parameters and signatures.

A null flag, mode or text counts as absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Categories that every vendor has, and those of a capability.
ALWAYS = ["launch_game", "balance", "bet", "settlement", "rollback"]
BY_CAPABILITY = {
    "multiple_bets": "multiple_bets", "multiple_settlements": "multiple_settlements", "rollback_settlements": "rollback_settled_bet",
    "modify_settlements_adjustment": "modify_settlement_adjustment", "cancel_bet": "rollback_bet", "idempotency": "idempotency", "jackpot": "jackpot",
}
#: Category and the words of a game's type, name or code.
GAMES = {
    "slot_game": "slot", "live_game": "live|casino", "arcade_game": "arcade", "mini_game": "mini|crash", "instant_win": "instant", "poker_game": "poker",
    "table_game": "table", "video_bingo": "bingo",
}
#: Label of a checked game type and its categories.
CHECKED = {
    "slot game": ["slot_game"], "slots": ["slot_game"], "mini game (instant win)": ["mini_game", "instant_win"], "mini game": ["mini_game"], "instant win": ["instant_win"],
    "poker game": ["poker_game"], "table game": ["table_game"], "live game": ["live_game"], "casino live": ["live_game"], "arcade": ["arcade_game"], "video bingo": ["video_bingo"],
}
#: Phrases of a parameter's error, words of other errors, words of a signature's error, codes of success.
PARAMETER = ["bad parameter", "bad request", "invalid request", "invalid parameter", "parameters are missing or invalid"]
OTHER = ["insufficient balance", "insufficient funds", "connection", "network", "token", "not found", "game is not found"]
SIGNATURE = ["authorization hash", "signature", "hmac", "hash", "encrypt", "decrypt"]
SUCCESS = ["0", "ok", "OK", "success", "SUCCESS"]
NO_EXAMPLE = "Documented endpoint error response example."


def categories(supports: dict[str, Column], authenticate: Column, required: Column, combined: Column, bet: Column, round_end: Column, free_spin: Column) -> Column:
    """Sorted categories by flags of ``supports``, modes of the three endpoints, and what parameters control."""
    has = lambda c: F.coalesce(supports.get(c, F.lit(False)), F.lit(False))
    ends, spins = F.coalesce(round_end, F.lit(False)), F.coalesce(free_spin, F.lit(False))
    present, joint = authenticate == "endpoint_present", combined == "combined_endpoint"
    found = [
        *map(F.lit, ALWAYS),
        *[F.when(has(c), name) for c, name in BY_CAPABILITY.items()],
        F.when(present, "authenticate"), F.when(present & required, "authentication_is_necessary"),
        F.when(joint, "bet_and_settle"), F.when(joint & ends, "bet_and_settle_has_round_end_control_parameter"),
        F.when(has("multiple_bets") & bet.isin("one_bet_endpoint", "one_bet_endpoint_with_action_parameter"), "multiple_bets_one_bet_endpoint"),
        F.when(has("multiple_bets") & (bet == "two_bet_endpoint"), "multiple_bets_two_bet_endpoint"),
        F.when(has("multiple_settlements"), F.when(ends, "multiple_settlements_has_round_end_control_parameter").otherwise("multiple_settlements_no_round_end_control_parameter")),
        F.when(has("free_spin") | spins, "freespin"),
    ]
    return F.sort_array(F.array_distinct(F.array_compact(F.array(*found))))


def game_types(games: DataFrame, vendor: str, kind: str, name: str, code: str) -> DataFrame:
    """(vendor, game_types): the sorted types that a vendor's games name."""
    text = F.lower(F.concat_ws(" ", kind, name, code))
    hits = [F.when(text.rlike(words) | (F.upper(code).startswith("IDNA_") if c == "arcade_game" else F.lit(False)), c) for c, words in GAMES.items()]
    rows = games.select(vendor, F.explode_outer(F.array_compact(F.array(*hits))).alias("_type"))
    return rows.groupBy(vendor).agg(F.sort_array(F.collect_set("_type")).alias("game_types"))


def checked_types(labels: Column) -> Column:
    """Sorted game types of checked labels; none for an empty list, and null for a missing one, where the games decide."""
    table = F.create_map(*[x for label, types in CHECKED.items() for x in (F.lit(label), F.array(*map(F.lit, types)))])
    none = F.array().cast("array<string>")
    of = F.transform(labels, lambda v: F.coalesce(F.try_element_at(table, F.btrim(F.regexp_replace(F.lower(v), r"\s+", " "))), none))
    return F.sort_array(F.array_distinct(F.flatten(of)))


def errors(codes: DataFrame, examples: DataFrame, vendor: str = "vendor") -> DataFrame:
    """(vendor, code, description, encryption_code): the documented errors for a bad parameter and a bad signature.

    For a parameter: the first code by ``pos`` that a phrase names, else the only one left when success and errors of
    other kinds go, else BAD_REQUEST or the first of the endpoints' example values. ``codes`` holds vendor, pos, code and
    description, ``examples`` vendor, pos and value. Without any the code is null, which the caller may raise on.
    """
    code, said = F.btrim(F.coalesce("code", F.lit(""))), F.coalesce("description", F.lit(""))
    text = F.lower(F.concat(code, F.lit(" "), said))
    any_of = lambda words, t: t.rlike("|".join(words))
    listed = codes.select(
        vendor, "pos", code.alias("code"), said.alias("said"), F.lit(None).cast("string").alias("value"),
        any_of(PARAMETER, F.regexp_replace(text, "[_-]+", " ")).alias("named"),
        ((code != "") & ~code.isin(SUCCESS) & ~any_of(OTHER, text)).alias("left"),
        ((code != "") & any_of(SIGNATURE, F.replace(text, F.lit("_"), F.lit(" ")))).alias("signed"),
    )
    shown = examples.filter(F.col("value").rlike(r"^[A-Z][A-Z0-9_]*\z")).select(vendor, "pos", "value")
    one = F.struct("code", "said")
    found = listed.unionByName(shown, allowMissingColumns=True).groupBy(vendor).agg(
        F.min_by(one, F.when(F.col("named"), F.col("pos"))).alias("first"),
        F.count_if("left").alias("n_left"),
        F.min_by(one, F.when(F.col("left"), F.col("pos"))).alias("only"),
        F.max(F.when(F.col("value") == "BAD_REQUEST", F.col("value"))).alias("bad"),
        F.min_by("value", F.when(F.col("value").isNotNull(), F.col("pos"))).alias("value"),
        F.min_by("code", F.when(F.col("signed"), F.col("pos"))).alias("encryption_code"),
    )
    example = F.coalesce("bad", "value")
    chosen = F.coalesce("first", F.when(F.col("n_left") == 1, F.col("only")), F.when(example.isNotNull(), F.struct(example.alias("code"), F.lit(NO_EXAMPLE).alias("said"))))
    return found.select(vendor, chosen["code"].alias("code"), chosen["said"].alias("description"), "encryption_code")
