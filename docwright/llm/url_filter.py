"""URL filters by a temporal list join.

A list is a table of dated entries: entry (a domain, or domain/path-prefix), category, action (add
or remove), day and seq. Each entry's dates become validity intervals, and an as-of join holds
every capture against the entries that are active when it was fetched. A domain entry covers its
subdomains, a path entry the paths below it. Each distinct host meets the listed domains among its suffixes, captures take these
from their host, and those that have any meet the intervals by domain and path prefix, as many keys
as the address has parts. No host's or domain's entries are gathered, and in every join a key is dealt
to ``SALTS`` tasks, so that neither a suffix nor a host with a third of all rows meets in one.

Defined results: null or unparsable URLs have no host and are never blocked; a null fetch day is
never blocked; of an entry's events on one day the last ``seq`` holds; of several active entries
the longest wins, ties to the smaller entry and category; equal rows are kept; empty lists or
tables block nothing; extra columns are ignored, and a kept column with a result's name gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docwright.llm.frames import without

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/?([^?#]*)"
FOREVER = "9999-12-31"
#: Tasks over which the captures of one host are spread in the join.
SALTS = 16
#: Fixed values, the list of the registered query: entry, category, action, day, seq.
LIST = [
    ("casino-win.example.com", "gambling", "add", "2024-01-10", 1),
    ("casino-win.example.com", "gambling", "remove", "2024-06-01", 2),
    ("casino-win.example.com", "gambling", "add", "2024-09-15", 3),
    ("free-bets.example.com", "gambling", "add", "2024-03-01", 1),
    ("cheap-pills.example.com", "pharma", "add", "2023-11-05", 1),
    ("cheap-pills.example.com", "pharma", "remove", "2024-11-05", 2),
    ("example.net/de", "region", "add", "2024-02-01", 1),
    ("example.net/de", "region", "remove", "2024-02-01", 2),
    ("example.net/de", "region", "add", "2025-01-01", 3),
    ("example.net", "suffix", "add", "2025-06-01", 1),
    ("blog.tionsh.example.com", "spam", "add", "2024-05-05", 1),
    ("blog.tionsh.example.com", "malware", "add", "2024-08-01", 1),
]


def list_events(spark: SparkSession) -> DataFrame:
    frame = spark.createDataFrame(LIST, "entry string, category string, action string, day string, seq int")
    return frame.withColumn("day", F.to_date("day"))


def intervals(events: DataFrame) -> DataFrame:
    """(domain, prefix, entry, category, since, until): the times in which an entry is on the list."""
    key = Window.partitionBy("entry", "category").orderBy("day", "seq")
    clean = events.filter("entry is not null and day is not null and action in ('add', 'remove')").withColumn("entry", F.lower("entry"))
    spans = clean.select(
        "entry", "category", "action", F.col("day").alias("since"),
        F.coalesce(F.lead("day").over(key), F.to_date(F.lit(FOREVER))).alias("until"),
    )
    active = spans.filter((F.col("action") == "add") & (F.col("since") < F.col("until")))
    return active.select(
        F.substring_index("entry", "/", 1).alias("domain"),
        F.when(F.instr("entry", "/") > 0, F.expr("substring(entry, instr(entry, '/') + 1)")).otherwise("").alias("prefix"),
        "entry", "category", "since", "until",
    ).distinct()


def host_of(url: Column) -> Column:
    host = F.rtrim(F.lower(F.regexp_extract(url, HOST, 1)), F.lit("."))
    return F.when(host == "", None).otherwise(host)


def _salted(small: DataFrame) -> DataFrame:
    return small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))


def judge(captures: DataFrame, events: DataFrame, keep: list[str], url: str = "url", day: str = "fetch_day") -> DataFrame:
    """``keep``, host, day, ``blocked``, and the entry and category that block each capture."""
    keep = without(keep, ["host", day, "blocked", "entry", "category"])
    names = [f"k_{c}" for c in keep]
    seen = captures.select(
        *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)],
        host_of(F.col(url)).alias("host"), F.regexp_extract(url, PATH, 1).alias("path"), F.col(day).alias("day"), F.monotonically_increasing_id().alias("rid"),
    )
    salt = lambda *by: F.pmod(F.xxhash64(*by), F.lit(SALTS))
    spans = intervals(events)
    listed = spans.groupBy("domain").agg(F.bool_or(F.col("prefix") != "").alias("paths"))
    labels = F.split(F.col("host"), r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    hosts = seen.filter("host is not null").select("host").distinct().select("host", F.explode(suffixes).alias("domain"), salt("host").alias("_salt"))
    # as many domains as the host has labels
    held = hosts.join(_salted(listed), ["domain", "_salt"]).groupBy("host").agg(F.collect_list(F.struct("domain", "paths")).alias("domains"))
    met = seen.withColumn("_salt", salt("rid")).join(_salted(held), ["host", "_salt"], "left")

    parts = F.split(F.col("path"), "/", -1)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    below = F.when(F.col("at.paths"), F.array_distinct(F.concat(F.array(F.lit("")), prefixes))).otherwise(F.array(F.lit("")))
    found = met.filter("domains is not null").withColumn("at", F.explode("domains")).withColumn("prefix", F.explode(below)).withColumn("domain", F.col("at.domain"))
    active = (F.col("since") <= F.col("day")) & (F.col("day") < F.col("until"))
    hits = found.join(_salted(spans), ["domain", "prefix", "_salt"], "left")
    rank = F.when(active, F.struct((-F.length("entry")).alias("rank"), "entry", "category"))
    judged = hits.groupBy("rid", *names, "host", "day").agg(F.min(rank).alias("hit"))
    rest = met.filter("domains is null").select("rid", *names, "host", "day", F.lit(None).cast(judged.schema["hit"].dataType).alias("hit"))
    return judged.unionByName(rest).select(
        *[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], "host", F.col("day").alias(day),
        F.col("hit").isNotNull().alias("blocked"), F.col("hit.entry").alias("entry"), F.col("hit.category").alias("category"),
    )
