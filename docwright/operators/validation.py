"""Checks of a draft's test cases: one row for each fault, with severity, path and rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwright.operators.routing import BALANCE, BET, CANCEL, LAUNCH, LEAVES, ROUTES, canonical_section

#: The section of parameter cases, labels, required fields, and words of failure.
PARAMETERS = "API parameter test"
PRECONDITIONS, REMARKS, TITLE = "前置条件：", "备注：", "case：check the {} validation"
REQUIRED = ["output_section", "category", "scenario", "preconditions", "steps", "remarks"]
TRADITIONAL = ["前置條件", "備註", "步驟", "預期結果", "標籤", "所屬模組", "用例等級"]
GENERATOR = "user-behavior-reference-generator/v1"
#: Categories of each section.
CATEGORIES = {
    PARAMETERS: ["parameter_validation", "parameter_dependency_validation", "amount_precision"],
    LAUNCH: ["launch_game", "authenticate"],
    BALANCE: ["balance"],
    BET: [
        "authentication_is_necessary", "bet", "settlement", "multiple_bets", "multiple_bets_one_bet_endpoint", "multiple_bets_two_bet_endpoint",
        "multiple_settlements", "multiple_settlements_has_round_end_control_parameter", "multiple_settlements_no_round_end_control_parameter",
        "modify_settlement_adjustment", "settle_by_round_or_settle_by_bet", "bet_and_settle", "bet_and_settle_has_round_end_control_parameter",
        "betandsettle", "idempotency", "freespin", "jackpot", "slots", "slot_game", "arcade_game", "live_game", "mini_game", "instant_win", "poker_game",
        "table_game", "video_bingo", "crash_game",
    ],
    CANCEL: [
        "cancel_settlement_adjustment", "rollback", "rollback_bet", "rollback_settled_bet", "rollback_by_round_or_rollback_by_bet",
        "rollback_bet_and_settle", "rollback_betandsettle",
    ],
}


def _blank(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) == ""


def case_issues(cases: DataFrame, key: str, negative: list[str], error_fields: list[str], inferred: list[str]) -> DataFrame:
    """key, severity, path and rule of every fault of every case.

    ``cases`` has the columns of a test case: id, output_section, category, endpoint, endpoint_name,
    module, parameter, scenario, preconditions, remarks, ``steps`` (step, expected), ``expected_error``
    (code, source, inference_reason and others; ``response`` as a map of its fields), ``source_reference``
    (generated_by, source_module, source_path, mapping_rule_id, mapping_status) and ``edited``, the names
    of fields that a person changed. ``negative`` are the words that mark a case of failure. Of several
    cases with one id all but the one with the smallest ``key`` are faulty.
    """
    first = cases.filter(~_blank("id")).groupBy(F.col("id").alias("_id")).agg(F.min(key).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    held = cases.join(first, F.col("id") == F.col("_id"), "left")
    col, no = F.col, F.lit(False)
    canonical = canonical_section(col("output_section"))
    allowed = (canonical == PARAMETERS) | canonical.isin(LEAVES)
    wanted = F.element_at(F.create_map(*[F.lit(x) for section, names in CATEGORIES.items() for n in names for x in (n, section)]), F.coalesce("category", F.lit("")))
    routed = (canonical == wanted) | canonical.startswith(F.concat(wanted, F.lit(" > ")))
    parameter = (col("output_section") == PARAMETERS) | col("category").isin("parameter_validation", "parameter_dependency_validation")
    parameter = F.coalesce(parameter, no)
    named = parameter & ~_blank("parameter")
    title = F.replace(F.lit(TITLE), F.lit("{}"), F.btrim("parameter"))
    dependent = (col("category") == "parameter_dependency_validation") & col("scenario").startswith(F.concat(F.lit("case：check the "), F.btrim("parameter"), F.lit(" validation when ")))
    mistitled = named & ~_blank("scenario") & (F.btrim("scenario") != title) & ~F.coalesce(dependent, no)
    edited = F.coalesce(F.array_contains("edited", "scenario"), no)
    module = F.coalesce(F.nullif(col("endpoint_name"), F.lit("")), F.element_at(F.split("endpoint", "/", -1), -1))
    error, reference = col("expected_error"), col("source_reference")
    texts = F.concat(F.array(*[F.coalesce(c, F.lit("")) for c in ("category", "scenario", "preconditions", "remarks")]), F.flatten(F.transform(F.coalesce("steps", F.array().cast("array<struct<step:string,expected:string>>")), lambda s: F.array(F.coalesce(s.step, F.lit("")), F.coalesce(s.expected, F.lit(""))))))
    told = F.lower(F.array_join(texts, "\n"))
    fails = F.lit(False)
    for word in negative:
        fails = fails | told.contains(word)
    generated = F.coalesce(reference.generated_by == GENERATOR, no)
    checks: list[tuple[str, str, str, Column]] = [
        *[("error", f"$.{f}", "required", col("steps").isNull() | (F.size("steps") == 0) if f == "steps" else _blank(f)) for f in REQUIRED],
        ("error", "$.id", "unique", col("_first").isNotNull() & (col(key) != col("_first"))),
        ("error", "$.output_section", "allowed", ~_blank("output_section") & ~F.coalesce(allowed, no)),
        ("error", "$.output_section", "category", wanted.isNotNull() & ~_blank("output_section") & ~F.coalesce(routed, no)),
        ("error", "$.endpoint", "parameter case", parameter & _blank(F.btrim("endpoint"))),
        ("error", "$.parameter", "parameter case", parameter & _blank(F.btrim("parameter"))),
        ("error", "$.scenario", "title", mistitled & ~edited),
        ("warning", "$.scenario", "edited title", mistitled & edited),
        ("warning", "$.module", "module", named & ~_blank("module") & ~_blank(module) & (col("module") != module)),
        ("warning", "$.expected_error.response_json", "response", named & error.isNotNull() & (F.coalesce(F.size(error.response), F.lit(0)) == 0)),
        ("error", "$.preconditions", "label", col("preconditions").isNotNull() & ~F.ltrim("preconditions").startswith(PRECONDITIONS)),
        ("error", "$.remarks", "label", col("remarks").isNotNull() & ~F.ltrim("remarks").startswith(REMARKS)),
        ("error", "$.steps", "empty", F.coalesce(F.size("steps") == 0, no)),
        ("error", "$.expected_error", "failure", fails & error.isNull()),
        *[("error", f"$.expected_error.{f}", "required", error.isNotNull() & _blank(error[f])) for f in error_fields],
        ("warning", "$.expected_error.inference_reason", "inferred", F.coalesce(error.source.isin(inferred), no) & _blank(error.inference_reason)),
        ("warning", "$.source_reference", "missing", reference.isNull()),
        *[("error", f"$.source_reference.{f}", "traceable", generated & _blank(reference[f])) for f in ("source_module", "source_path", "mapping_rule_id", "mapping_status")],
        ("error", "$.source_reference.mapping_rule_id", "known rule", generated & ~_blank(reference.mapping_rule_id) & ~F.coalesce(reference.mapping_rule_id.isin(sorted({r for r, *_ in ROUTES})), no)),
        ("error", "$.source_reference.mapping_status", "mapped", generated & reference.mapping_status.isNotNull() & (reference.mapping_status != "mapped")),
        *[("warning", f"$.{f}", "labels", F.coalesce(col(f).rlike("|".join(TRADITIONAL)), no)) for f in ("scenario", "preconditions", "remarks")],
    ]
    issue = lambda severity, path, rule: F.struct(F.lit(severity).alias("severity"), path.alias("path"), F.lit(rule).alias("rule"))
    whole = F.array(*[F.when(F.coalesce(bad, no), issue(severity, F.lit(path), rule)) for severity, path, rule, bad in checks])

    def of_step(s: Column, i: Column) -> Column:
        at = lambda f: F.concat(F.lit("$.steps["), i.cast("string"), F.lit(f"].{f}"))
        faults = [F.when(_blank(s[f]), issue("error", at(f), "required")) for f in ("step", "expected")]
        faults += [F.when(F.coalesce(s[f].rlike("|".join(TRADITIONAL)), no), issue("warning", at(f), "labels")) for f in ("step", "expected")]
        return F.array(*faults)

    each = F.coalesce(F.flatten(F.transform("steps", of_step)), F.array().cast("array<struct<severity:string,path:string,rule:string>>"))
    return held.select(key, F.inline(F.array_compact(F.concat(whole, each))))


def root_issues(drafts: DataFrame, key: str, version: str, mapping_version: str) -> DataFrame:
    """key, severity, path and rule of the faults of drafts as such.

    ``drafts`` has ``fields`` (names present), schema_version, ``mapping`` (category to section), and
    total, accounted and contract_version of the mapping report, null where there is none.
    """
    issue = lambda severity, path, rule, bad: F.when(
        F.coalesce(bad, F.lit(False)), F.struct(F.lit(severity).alias("severity"), F.lit(path).alias("path"), F.lit(rule).alias("rule"))
    )
    needed = ["schema_version", "vendor", "capability_profile", "endpoint_roles", "generation_mapping", "test_cases"]
    pairs = [(c, s) for s, names in CATEGORIES.items() for c in names]
    at = "$.generation_mapping.knowledge_category_to_xmind_section."
    held = lambda c: F.element_at(F.coalesce("mapping", F.expr("map()").cast("map<string,string>")), F.lit(c))
    checks = [
        *[issue("error", f"$.{f}", "required", ~F.array_contains("fields", f)) for f in needed],
        issue("error", "$.schema_version", "version", ~F.col("schema_version").eqNullSafe(version)),
        *[issue("warning", at + c, "recommended", held(c).isNull()) for c, _ in pairs],
        *[issue("error", at + c, "section", held(c) != s) for c, s in pairs],
        issue("error", "$.user_behavior_mapping_report.accounted", "accounted", F.col("total") != F.col("accounted")),
        issue("error", "$.user_behavior_mapping_report.contract_version", "version", F.col("total").isNotNull() & ~F.col("contract_version").eqNullSafe(mapping_version)),
    ]
    return drafts.select(key, F.inline(F.array_compact(F.array(*checks))))
