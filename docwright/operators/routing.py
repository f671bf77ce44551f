"""Routing of behavior cases to sections: a decision table, its evaluation and its inventory.

The first rule that holds decides, so the order of ``ROUTES`` is meaning. A rule has an id, a status,
a section and a condition over the normalised columns of a case: ``category``, ``module``, ``parts``
(segments of its path), ``leaf`` (the last of them), ``title`` and ``cancels`` (whether the case
belongs to cancelling).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sections, game categories, and phrases of titles.
LAUNCH, BALANCE = "User Behavior > Launch Game", "User Behavior > Get Player balance"
BET, CANCEL = "User Behavior > Bet and Settle", "User Behavior > Cancel Bet"
CONFIGS = {"bet config": "Bet config", "settle config": "Settle config", "betandsettle config": "BetAndSettle config"}
CANCEL_CONFIG = f"{CANCEL} > Cancel config"
GAMES = ["Instant Win", "Live game", "Mini game", "Poker game", "Slot game", "Table game", "Video Bingo"]
GAME_CATEGORY = f"{BET} > Game type > Game category"
MAIN_FLOW = {False: f"{BET} > Game type > Main flow", True: f"{CANCEL} > Main flow"}
ACCOUNTS = {False: f"{BET} > Special accounts", True: f"{CANCEL} > Special accounts"}
STATUS = {False: f"{BET} > Player / Game status", True: f"{CANCEL} > Player / Game status"}
ACCOUNT_PHRASES = [f"{who} {kind}" for who in ("timeout", "error", "result0", "refund0", "cancel", "delay10s") for kind in ("player", "user")]
STATUS_PHRASES = [f"{who} status is {how}" for who in ("game", "player") for how in ("abnormal", "abnornal")]
LEAVES = [
    LAUNCH, BALANCE, *MAIN_FLOW.values(), *[f"{BET} > {c}" for c in CONFIGS.values()], CANCEL_CONFIG, *ACCOUNTS.values(), *STATUS.values(),
    *[f"{GAME_CATEGORY} > {g}" for g in GAMES],
]
#: Other names of two sections.
ALIASES = {"User Behavior > Debit and Credit": BET, "User Behavior > Cancel Debit": CANCEL}


def _scoped(leaf: str, name: str, sections: dict[bool, str]) -> list[tuple[str, str, str, str]]:
    return [(f"{'cancel' if c else 'bet'}.{name}", "mapped", sections[c], f"leaf = '{leaf}' and {'' if c else 'not '}cancels") for c in (True, False)]


def _said(phrases: list[str]) -> str:
    return " or ".join(f"contains(title, '{p}')" for p in phrases)


#: Rule id, status, section and condition, in order.
ROUTES = [
    ("excluded.special_test_cases", "excluded", None, "array_contains(parts, 'special test cases')"),
    ("direct.launch_game", "mapped", LAUNCH, "category = 'launch_game' or module = 'launch game'"),
    ("direct.balance", "mapped", BALANCE, "category = 'balance' or module in ('balance', 'get player balance')"),
    ("direct.authenticate", "mapped", LAUNCH, "category = 'authenticate' or module = 'authenticate'"),
    *[("game_category.module", "mapped", f"{GAME_CATEGORY} > {g}", f"module = '{g.lower()}' and get(parts, 0) = 'game category'") for g in GAMES],
    *_scoped("special accounts", "special_accounts", ACCOUNTS),
    *_scoped("player / game status", "player_game_status", STATUS),
    *_scoped("main flow", "main_flow", MAIN_FLOW),
    ("cancel.cancel_config", "mapped", CANCEL_CONFIG, "leaf = 'cancel config'"),
    ("bet.bet_config", "mapped", f"{BET} > Bet config", "leaf = 'bet config'"),
    ("bet.settle_config", "mapped", f"{BET} > Settle config", "leaf = 'settle config'"),
    ("bet.bet_and_settle_config", "mapped", f"{BET} > BetAndSettle config", "leaf = 'betandsettle config'"),
    ("cancel.cancel_config", "mapped", CANCEL_CONFIG, "leaf = 'adjustment config' and cancels"),
    ("bet.settle_config", "mapped", f"{BET} > Settle config", "leaf = 'adjustment config'"),
    ("bet.authentication_required", "mapped", f"{BET} > Bet config",
     "category = 'authentication_is_necessary' or contains(concat('>', array_join(parts, '>'), '>'), '>authenticate>authentication is necessary>')"),
    *[("legacy.title_special_accounts", "mapped", ACCOUNTS[c], f"({_said(ACCOUNT_PHRASES)}) and {'' if c else 'not '}cancels") for c in (True, False)],
    *[("legacy.title_player_game_status", "mapped", STATUS[c], f"({_said(STATUS_PHRASES)}) and {'' if c else 'not '}cancels") for c in (True, False)],
    ("fallback.freespin_jackpot_main_flow", "mapped", MAIN_FLOW[False], "category in ('freespin', 'jackpot')"),
    ("fallback.adjustment_config", "mapped", CANCEL_CONFIG, "category in ('modify_settlement_adjustment', 'cancel_settlement_adjustment') and cancels"),
    ("fallback.adjustment_config", "mapped", f"{BET} > Settle config", "category in ('modify_settlement_adjustment', 'cancel_settlement_adjustment')"),
    ("fallback.rollback_config", "mapped", CANCEL_CONFIG, "cancels or category in ('rollback', 'rollback_bet', 'rollback_settled_bet')"),
    ("unmapped.no_rule", "unmapped", None, "true"),
]
CANCELS = """module in ('cancel bet', 'rollback') or startswith(category, 'rollback') or category = 'cancel_settlement_adjustment'
    or (get(parts, 0) = 'mandatory' and get(parts, 1) = 'cancel bet')"""


def squeezed(text: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends; null is empty."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def segments(path: Column) -> Column:
    """The segments of a path ``a > b > c`` that aren't blank, squeezed."""
    return F.filter(F.transform(F.split(F.coalesce(path, F.lit("")), ">", -1), squeezed), lambda s: s != "")


def route(cases: DataFrame, keep: list[str], category: str = "category", module: str = "module", path: str = "path", title: str = "title") -> DataFrame:
    """``keep`` with the section, rule id and status of each case."""
    held = cases.select(
        F.struct(*keep).alias("_kept"), F.btrim(F.coalesce(F.col(category), F.lit(""))).alias("category"), squeezed(F.col(module)).alias("module"),
        segments(F.col(path)).alias("parts"), squeezed(F.col(title)).alias("title"),
    )
    ready = held.withColumn("leaf", F.coalesce(F.get("parts", F.size("parts") - 1), F.lit(""))).withColumn("cancels", F.coalesce(F.expr(CANCELS), F.lit(False)))
    chosen = None
    for rule, status, section, condition in ROUTES:
        value = F.struct(F.lit(section).cast("string").alias("section"), F.lit(rule).alias("rule_id"), F.lit(status).alias("status"))
        chosen = F.when(F.expr(condition), value) if chosen is None else chosen.when(F.expr(condition), value)
    return ready.select("_kept.*", chosen.alias("_route")).select(*keep, "_route.*")


def inventory(routed: DataFrame) -> DataFrame:
    """Cases by status and rule; all cases are accounted for."""
    return routed.groupBy("status", "rule_id").agg(F.count(F.lit(1)).alias("n"))


def canonical_section(section: Column) -> Column:
    """The section with its other name replaced."""
    for other, own in ALIASES.items():
        section = F.when((section == other) | section.startswith(f"{other} > "), F.concat(F.lit(own), F.substring(section, len(other) + 1, 2**31 - 1))).otherwise(section)
    return section
