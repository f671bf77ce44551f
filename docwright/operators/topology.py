"""What a vendor's endpoints can do: counts by role, parameters by meaning, and evidence that authentication is needed.

One pass over the endpoints and one over the error codes make small flags and names, which are summed by
vendor before the shuffle; names gathered are those of the fixed dictionaries, in the spellings met.

Defined results: null texts are empty, null parameters none; a vendor with error codes alone has no row; equal rows count each;
an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases that say that authentication is needed.
REQUIRED = [
    "authentication required", "authentication is required", "authentication is necessary", "authentication is mandatory", "authenticate required", "authenticate is required",
    "authenticate first", "must authenticate", "must call authenticate", "call authenticate before", "not authenticated", "unauthenticated", "unauthorized", "invalid token",
    "missing token", "token required", "token is required", "invalid session", "missing session", "session required", "session is required",
]
#: Names of parameters, letters and digits only, by what they mean.
MEANINGS = {
    "action": ["action", "method", "operation", "command", "type", "requesttype", "transactiontype"],
    "round_end": ["roundcompleted", "isendround", "roundend", "endround", "isroundend", "isfinished", "finished", "completed", "iscomplete", "complete"],
    "status": ["status", "playstatus", "gamestatus", "roundstatus", "betstatus", "settlementstatus"],
    "round_id": ["roundid", "gameid", "playid", "handid"],
    "idempotency": ["transactionid", "txid", "referenceid", "requestid", "orderid", "ordercode", "betid", "roundid"],
    "jackpot": ["jackpot", "jackpotamount", "jackpotaward", "jackpotcontribution", "jackpotwin", "jackpotpayout", "jackpotprize", "jackpotid", "mjpwin", "mjpcomm", "jpwin", "jpamount"],
    "free_spin": ["freespin", "freespins", "freegame", "freegames", "freebet", "freebets", "bonusid", "bonuscode", "campaignid", "campaigncode", "promotionid", "promoid", "featureid", "featurecode"],
}
#: Characters of an error's context and of a section that evidence shows.
CONTEXT_CHARS, SECTION_CHARS = 160, 120
PARAMETERS = "array<map<string,string>>"


def folded(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]", "")


def _name(p: Column) -> Column:
    return F.btrim(F.coalesce(F.try_element_at(p, F.lit("name")), F.lit("")))


def _says(p: Column) -> Column:
    return F.array_join(F.transform(F.map_values(p), lambda v: F.coalesce(v, F.lit(""))), " ")


def named(parameters: Column, meaning: str) -> Column:
    """Names of parameters that are one of a meaning's, sorted."""
    hits = F.filter(parameters, lambda p: folded(_name(p)).isin(MEANINGS[meaning]))
    return F.array_sort(F.array_distinct(F.transform(hits, _name)))


def told(parameters: Column, meaning: str) -> Column:
    """Names of parameters any of whose values holds a name of the meaning, sorted."""
    hits = F.filter(parameters, lambda p: (_name(p) != "") & folded(_says(p)).rlike("|".join(MEANINGS[meaning])))
    return F.array_sort(F.array_distinct(F.transform(hits, _name)))


def _requires(text: Column) -> Column:
    return F.lower(text).rlike("|".join(REQUIRED))


def _evidence(kind: str, first: Column, second: Column, n: int) -> Column:
    return F.btrim(F.concat_ws(":", F.lit(kind), F.btrim(F.coalesce(first, F.lit(""))), F.substring(F.btrim(F.coalesce(second, F.lit(""))), 1, n)), F.lit(":"))


def _all(column: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(column))))


def analyse(endpoints: DataFrame, errors: DataFrame, vendor: str = "vendor") -> DataFrame:
    """A row a vendor: modes, counts, parameter names, evidence and the ten meanings.

    ``endpoints`` has vendor, endpoint, role, section and parameters (maps with ``name``), ``errors`` vendor, code and context.
    """
    p = F.coalesce(F.col("parameters"), F.array().cast(PARAMETERS))
    is_ = lambda *roles: F.coalesce(F.col("role").isin(*roles), F.lit(False))
    text = F.concat_ws(" ", "endpoint", "role", "section", F.array_join(F.transform(p, _says), " "))
    own = F.when(_requires(text), _evidence("endpoint", F.col("endpoint"), F.col("section"), SECTION_CHARS))
    bets, settles = is_("bet"), is_("settlement", "combined_bet_settlement")
    none = F.array().cast("array<string>")
    read = endpoints.select(
        vendor, is_("authentication").alias("auth"), bets.alias("bet"), settles.alias("settle"), is_("combined_bet_settlement").alias("combined"), own.alias("own"),
        *[F.when(where, names).otherwise(none).alias(c) for c, where, names in (
            ("action", bets, named(p, "action")), ("round_end", settles, named(p, "round_end")), ("status", settles, named(p, "status")), ("jackpot", settles, named(p, "jackpot")),
            ("free_spin", bets | settles, told(p, "free_spin")),
        )],
        *[(F.size(named(p, m)) > 0).alias(f"any_{m}") for m in ("action", "round_id", "idempotency")],
    )
    summed = read.groupBy(vendor).agg(
        *[F.count_if(c).alias(f"n_{c}") for c in ("auth", "bet", "settle", "combined")], *[_all(F.col(c)).alias(c) for c in ("action", "round_end", "status", "jackpot", "free_spin")],
        *[F.bool_or(f"any_{m}").alias(f"any_{m}") for m in ("action", "round_id", "idempotency")], F.collect_set("own").alias("own"),
    )
    told_by = errors.filter(_requires(F.concat_ws(" ", "code", "context"))).groupBy(F.col(vendor).alias("_v")).agg(F.collect_set(_evidence("error_code", F.col("code"), F.col("context"), CONTEXT_CHARS)).alias("errors"))
    met = summed.join(told_by, F.col(vendor) == F.col("_v"), "left").withColumn("evidence", F.array_sort(F.array_union("own", F.coalesce("errors", none))))
    bet_mode = F.when(F.col("n_bet") >= 2, "two_bet_endpoint").when((F.col("n_bet") == 1) & (F.size("action") > 0), "one_bet_endpoint_with_action_parameter").when(
        F.col("n_bet") == 1, "one_bet_endpoint").otherwise("missing_bet_endpoint")
    required = (F.col("n_auth") > 0) & (F.size("evidence") > 0)
    has = lambda c: F.size(c) > 0
    return met.select(
        vendor, F.when(F.col("n_auth") > 0, "endpoint_present").otherwise("missing_authenticate_endpoint").alias("authenticate_mode"), "n_auth", "evidence", bet_mode.alias("bet_mode"), "n_bet",
        F.col("action").alias("action_parameters"), F.col("free_spin").alias("free_spin_parameters"),
        F.when(has("round_end"), "has_round_end_control_parameter").otherwise("no_round_end_control_parameter").alias("settlement_mode"), "n_settle",
        F.col("round_end").alias("round_end_parameters"), F.col("status").alias("status_parameters"), F.col("jackpot").alias("jackpot_parameters"),
        F.when(F.col("n_combined") > 0, "combined_endpoint").otherwise("missing_combined_endpoint").alias("combined_mode"), "n_combined",
        F.col("any_action").alias("action_control"), has("round_end").alias("round_end_control"), has("status").alias("settlement_status"), F.col("any_round_id").alias("round_identifier"),
        F.col("any_idempotency").alias("idempotency_key"), (F.col("n_combined") > 0).alias("combined_bet_settlement"), (F.col("n_auth") > 0).alias("authentication"),
        required.alias("authentication_required"), has("jackpot").alias("jackpot_control"), has("free_spin").alias("free_spin_control"),
    )
