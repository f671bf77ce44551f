"""Rule tables: tags, routes, roles, checks and wording. Rules are data; order is meaning."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwright.functions.text import let

#: Tag and keywords.
TAGS = {
    "positive": ["success", "successful", "normal", "ok", "succeed", "正确", "成功"],
    "negative": ["invalid", "error", "failed", "wrong", "not found", "失败", "异常"],
    "boundary": ["boundary", "limit", "exceed", "blank", "null", "empty", "maximum", "minimum"],
    "validation": ["validation", "invalid", "parameter", "must not", "校验", "验证"],
    "idempotency": ["idempotency", "duplicate", "same transaction", "重复"],
    "retry": ["retry", "again", "re-send", "重试"],
    "timeout": ["timeout", "time out", "超时"],
    "rollback": ["rollback", "roll back", "回滚"],
    "cancel": ["cancel", "取消"],
    "free_spin": ["free spin", "freespin", "free game", "免费旋转"],
    "wallet": ["wallet", "balance", "credit", "debit", "余额"],
    "bet": ["bet", "wager", "下注"],
    "settlement": ["settlement", "settle", "payout", "winloss", "结算"],
    "jackpot": ["jackpot", "奖池"],
    "db_check": ["db", "database", "sql", "opensearch", "record created", "record"],
    "api_check": ["api", "response", "request", "endpoint"],
    "encryption": ["encrypt", "decrypt", "signature", "hash", "sign", "加密"],
}
#: The tags under which a case is filed, first match first.
PRIMARY = ["idempotency", "rollback", "boundary", "validation", "timeout", "negative", "positive"]
LOOSE = re.compile(r"[一-鿿\s_-]")


def holds_keyword(low: Column, keywords: list[str]) -> Column:
    """Whether a lower-case text holds a keyword: loose ones anywhere, the others as whole words.

    A plain search comes first; the edges of words are looked at only in texts that pass it.
    """
    either = lambda some: functools.reduce(lambda x, y: x | y, [low.contains(k) for k in some])
    whole, loose = [k for k in keywords if not LOOSE.search(k)], [k for k in keywords if LOOSE.search(k)]
    edged = rf"(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(whole)})(?![\p{{L}}\p{{N}}_])"
    found = either(loose) if loose else F.lit(False)
    return found | (either(whole) & low.rlike(edged)) if whole else found


def tags_of(text: Column, tags: dict[str, list[str]] = TAGS) -> Column:
    """Sorted tags whose keywords occur in the text; ``unclassified`` if none does."""
    named = lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("unclassified")))
    found = lambda low: F.array_compact(F.array(*[F.when(holds_keyword(low, words), tag) for tag, words in sorted(tags.items())]))
    return let(F.lower(text), lambda low: let(found(low), named))


def primary_tag(tags: Column, preferred: list[str] = PRIMARY) -> Column:
    ranked = F.array_intersect(F.array(*[F.lit(p) for p in preferred]), tags)
    return F.coalesce(F.get(ranked, F.lit(0)), F.get(tags, F.lit(0)), F.lit("unclassified"))


def first_rule(rules: list[tuple[str, str, str]], default: tuple[str, str]) -> Column:
    """(target, rule_id) of the first rule whose SQL condition holds; rules are (id, condition, target)."""
    pair = lambda target, rule: F.struct(F.lit(target).alias("target"), F.lit(rule).alias("rule_id"))
    out = None
    for rule, condition, target in rules:
        out = F.when(F.expr(condition), pair(target, rule)) if out is None else out.when(F.expr(condition), pair(target, rule))
    return out.otherwise(pair(*default))


def issues(rows: DataFrame, keys: list[str], checks: list[tuple[str, str, str]]) -> DataFrame:
    """A row for each check that a row fails; checks are (severity, path, SQL condition of failure)."""
    failed = F.array_compact(
        F.array(
            *[
                F.when(F.expr(condition), F.struct(F.lit(severity).alias("severity"), F.lit(path).alias("path")))
                for severity, path, condition in checks
            ]
        )
    )
    return rows.select(*keys, F.inline(failed))


def reword(text: Column, words: dict[str, str]) -> Column:
    """Whole words replaced in any case."""
    for old, new in words.items():
        text = F.regexp_replace(text, rf"(?i)(^|[^a-z0-9_])({old})(?=$|[^a-z0-9_])", f"$1{new}")
    return text


def change_gate(now: dict[str, Column], before: dict[str, Column], same_hash: Column) -> Column:
    """What a re-run has to do, from counts (``cases`` among them) now and before."""
    new = before["cases"].isNull()
    equal, less = F.lit(True), F.lit(False)
    for name, value in now.items():
        equal = equal & (value == before[name])
        less = less | (value < before[name])
    return (
        F.when(new, "full").when(equal & same_hash, "skip_equal").when(equal, "raw_only").when(less, "preserve_decrease")
        .when(now["cases"] > before["cases"], "incremental").otherwise("raw_only")
    )
