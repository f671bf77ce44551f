"""Coverage of parameters by cases, and comparison of case profiles with a stored baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Greatest share by which a vendor's cases and an endpoint's cases may fall.
TOTAL_LIMIT, ENDPOINT_LIMIT = 0.1, 0.05


def _folded(path: Column) -> Column:
    return F.lower(F.btrim(path))


def uncovered(wanted: DataFrame, made: DataFrame, skipped: DataFrame, endpoint: str, parameter: str, reason: str) -> DataFrame:
    """Rows of ``wanted`` whose parameter has neither a case nor a skip with a reason.

    A case or skip counts for a parameter with the same path, or, if it names no path, with that last
    segment; the case of letters doesn't count. Both keys are looked up by equality, so nothing is crossed.
    """
    known = made.select(endpoint, parameter).unionByName(skipped.filter(F.btrim(F.coalesce(reason, F.lit(""))) != "").select(endpoint, parameter))
    keys = known.select(F.col(endpoint).alias("_endpoint"), _folded(F.col(parameter)).alias("_key")).distinct()
    rows = wanted.withColumn("_path", _folded(F.col(parameter))).withColumn("_leaf", F.element_at(F.split("_path", "/", -1), -1))
    for own in ("_path", "_leaf"):
        rows = rows.join(keys, (F.col(endpoint) == F.col("_endpoint")) & (F.col(own) == F.col("_key")), "left_anti")
    return rows.drop("_path", "_leaf")


def profile_errors(now: DataFrame, before: DataFrame, vendor: str, endpoint: str, cases: str, code: str) -> DataFrame:
    """vendor, endpoint, rule, before and now of every fault against the baseline.

    Rules: ``baseline`` (a vendor without any), ``total`` (cases of a vendor fell by more than
    ``TOTAL_LIMIT``), ``missing`` (an endpoint is gone), ``cases`` (an endpoint's cases fell by more than
    ``ENDPOINT_LIMIT``) and ``code`` (its error code changed).
    """
    pair = [vendor, endpoint]
    met = before.select(*pair, F.col(cases).alias("b"), F.col(code).alias("cb")).join(now.select(*pair, F.col(cases).alias("n"), F.col(code).alias("cn")), pair, "full_outer")
    fault = lambda rule, bad, b, n: F.when(bad, F.struct(F.lit(rule).alias("rule"), b.cast("bigint").alias("before"), n.cast("bigint").alias("now")))
    b, n, none = F.col("b"), F.col("n"), F.lit(None)
    each = [
        fault("missing", b.isNotNull() & n.isNull(), b, F.lit(0)), fault("cases", b - n > ENDPOINT_LIMIT * b, b, n),
        fault("code", n.isNotNull() & F.col("cb").isNotNull() & ~F.col("cb").eqNullSafe(F.col("cn")), none, none),
    ]
    totals = met.groupBy(vendor).agg(F.sum("b").alias("b"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    whole = [fault("baseline", b.isNull(), none, n), fault("total", b - n > TOTAL_LIMIT * b, b, n)]
    inline = lambda faults: F.inline(F.array_compact(F.array(*faults)))
    return totals.select(vendor, F.lit("").alias(endpoint), inline(whole)).unionByName(met.select(vendor, endpoint, inline(each)))
