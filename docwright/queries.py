"""Registered queries of the document operators. Their SQL is in ``docwright.oracles``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docwright.functions import fields
from docwright.operators import dependencies, lines, merges, rules, topics
from docwright.oracles import ORACLES  # noqa: F401
from docwright.plans.numbering import numbered

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

HEADING = "^[A-Z][^.]{0,40}$"
LICENSE = "license|licence"
#: Phrases that mark evidence.
EVIDENCE = ["error", "note:", "the ", "license", "record"]
#: Role, path segment.
ROLES = {"de": "german", "es": "spanish", "fr": "french", "en": "english"}
#: Rule, path and order.
PATH_RULES = [("english_page", "/en/{n}", 1), ("spanish_page", "/es/{n}", 2), ("numbered_page", "/{lang}/{n}", 3)]
#: Kind of parameter, order and step.
STEPS = [
    ("string", 1, "missing"), ("string", 2, "empty"), ("string", 3, "wrong type"),
    ("amount", 1, "missing"), ("amount", 2, "negative"), ("amount", 3, "too many decimals"), ("amount", 4, "zero"),
    ("array", 1, "missing"), ("array", 2, "empty list"),
]


def query(f: Callable[[Callable[[str], DataFrame], SparkSession], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register ``f``, which takes a reader of tables and the session, under its name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark)

    QUERIES[f.__name__] = run
    return run


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1)


@query
def f01_clean_text(t, spark):
    return t("documents").select("doc_id", fields.clean_text(F.col("text")).alias("cleaned"))


@query
def f02_labels(t, spark):
    title = F.concat("role", F.lit(" ： "), "text")
    return t("conversations").select("conv_id", "turn", fields.label_of(title).alias("label"), fields.value_of(title).alias("value"))


@query
def f04_slugs(t, spark):
    return t("part").select("p_partkey", fields.slug(F.concat_ws(" / ", "p_name", "p_brand")).alias("slug"))


@query
def f05_url_names(t, spark):
    host = F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1)
    return t("pages").select(
        "page_id", host.alias("host"), F.substring_index(host, ".", 1).alias("vendor"), path_of(F.col("url")).alias("path")
    )


@query
def f06_drop_empty(t, spark):
    values = F.create_map(
        F.lit("name"), F.col("c_name"),
        F.lit("segment"), F.nullif("c_mktsegment", F.lit("BUILDING")),
        F.lit("debt"), F.when(F.col("c_acctbal") < 0, F.lit("yes")).otherwise(""),
    )
    kept = F.transform(F.map_entries(fields.drop_empty(values)), lambda e: F.concat(e.key, F.lit("="), e.value))
    return t("customer").select("c_custkey", F.array_join(kept, ",").alias("kept"))


@query
def f07_content_hash(t, spark):
    line = F.concat_ws("|", "o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(15,2)"), "o_orderpriority")
    return t("orders").select("o_orderkey", F.sha2(line, 256).alias("content_hash"))


@query
def f08_stable_keys(t, spark):
    key = fields.stable_key("param", F.col("o_orderpriority"), F.col("o_orderstatus"))
    return t("orders").select("o_orderkey", key.alias("stable_key"))


@query
def f09_json_props(t, spark):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return t("events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"), F.max(k).alias("most"))


@query
def f10_query_params(t, spark):
    pairs = t("pages").select("page_id", F.posexplode(fields.query_pairs(F.col("url"))).alias("pos", "pair"))
    cut = pairs.select("page_id", "pos", F.substring_index("pair", "=", 1).alias("name"), F.regexp_extract("pair", "=(.*)$", 1).alias("value"))
    return cut.groupBy("page_id", "name").agg(F.max_by("value", "pos").alias("value"))


@query
def f12_context_window(t, spark):
    at = F.instr(F.lower("text"), "license")
    return t("documents").filter(at > 0).select("doc_id", F.substring("text", F.greatest(F.lit(1), at - 70), F.lit(140)).alias("context"))


@query
def f16_account_stamp(t, spark):
    return t("customer").select("c_custkey", fields.account(F.col("c_mktsegment"), "2026-08-17").alias("account"))


@query
def f18_decimal_boundary(t, spark):
    values = fields.boundary_values((F.col("p_size") % 9).cast("int"))
    return t("part").select("p_partkey", values["valid"].alias("valid"), values["invalid"].alias("invalid"))


@query
def g01_tag_counts(t, spark):
    tagged = t("documents").select("lang", F.explode(rules.tags_of(F.col("text"))).alias("tag"))
    return tagged.groupBy("lang", "tag").agg(F.count(F.lit(1)).alias("n"))


@query
def g02_chunks(t, spark):
    return t("documents").groupBy(fields.slug(F.col("source")).alias("chunk")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")
    )


@query
def g03_field_presence(t, spark):
    return t("conversations").groupBy("role").agg(
        F.bool_or(F.length("text") > 0).alias("has_text"), F.bool_or(F.col("turn") > 3).alias("has_late_turn"),
        F.bool_or(F.instr("text", "\n") > 0).alias("has_lines"),
    )


@query
def g04_profile(t, spark):
    words = F.split("p_type", "[ ]+", -1)
    return t("part").groupBy("p_brand").agg(
        F.max(F.size(words)).alias("depth"), F.count(F.lit(1)).alias("n"), F.count_distinct("p_type").alias("n_types"), F.min("p_name").alias("first_name")
    )


@query
def g05_case_profile(t, spark):
    years = t("lineitem").groupBy(F.year("l_shipdate").alias("year"), "l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("n_discounted"),
        F.array_join(F.sort_array(F.collect_set("l_linestatus")), ",").alias("statuses"),
    )
    return years


@query
def g06_topology(t, spark):
    n = t("events").groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "purchase").alias("n_purchase"), F.bool_or(F.col("event_type") == "error").alias("has_error")
    )
    mode = F.when(F.col("n_purchase") >= 2, "two").when(F.col("n_purchase") == 1, "one").otherwise("missing")
    return n.select("user_id", "n_purchase", "has_error", mode.alias("mode"))


@query
def g07_summary(t, spark):
    return t("events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 100).alias("n_over"), F.count_distinct("user_id").alias("n_users")
    )


@query
def g08_reconcile(t, spark):
    left = t("documents").select("doc_id", "lang").join(t("labels").select("doc_id").distinct(), "doc_id", "left_anti")
    return left.groupBy("lang").agg(F.count(F.lit(1)).alias("n_unlabelled"), F.min("doc_id").alias("first_id"))


@query
def j01_positional_zip(t, spark):
    events = t("events").select("user_id", "event_id", "ts")
    orders = t("orders").select(F.col("o_custkey").alias("user_id"), "o_orderkey", "o_orderdate")
    met = merges.zip_rows(events, orders, ["user_id"], ["ts", "event_id"], ["o_orderdate", "o_orderkey"])
    return met.select("user_id", "place", "event_id", "o_orderkey")


@query
def j02_wildcard_paths(t, spark):
    pages = t("pages").select("page_id", path_of(F.col("url")).alias("path"))
    held = spark.createDataFrame(PATH_RULES, "rule string, pattern string, ord int")
    met = merges.matching_paths(pages, held, "path", "pattern", "ord")
    return met.select("page_id", "path", F.col("rule.rule").alias("rule"))


@query
def j03_longest_text(t, spark):
    left = t("nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("context"))
    right = t("supplier").groupBy(F.col("s_nationkey").alias("code")).agg(F.max("s_name").alias("context"), F.min("s_suppkey").alias("response"))
    return merges.longest_text(left, right, "code", "context", ["response"])


def snapshots(t) -> tuple[DataFrame, DataFrame]:
    """Customers before (two thirds of them, numbered) and now (three quarters, some with another segment)."""
    c = t("customer")
    digest = F.sha1("c_mktsegment").alias("digest")
    before = c.filter("c_custkey % 3 <> 0").select("c_custkey", "c_mktsegment", digest, (F.col("c_custkey") + 1).cast("bigint").alias("number"))
    now = c.filter("c_custkey % 4 <> 0").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 5 == 0, "NEW").otherwise(F.col("c_mktsegment")))
    return before, now.select("c_custkey", "c_mktsegment", digest)


@query
def j04_upsert(t, spark):
    before, now = snapshots(t)
    return merges.upsert(before, now, "c_custkey", "digest", "number")


@query
def j05_change_stats(t, spark):
    before, now = snapshots(t)
    return merges.changes(before, now, "c_custkey", "digest").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query
def j06_overlay(t, spark):
    o = t("orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    base = o.filter("o_orderkey % 11 <> 0")
    human = o.filter("o_orderkey % 7 <> 0").withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 5 == 0, "0-HUMAN").otherwise(F.col("o_orderpriority")))
    return merges.overlay(base, human, o.filter("o_orderkey % 2 = 0"), "o_orderkey", ["o_orderpriority", "o_orderstatus"])


@query
def j08_preferred(t, spark):
    """The first customer of each segment by balance class, then key."""
    rank = F.when(F.col("c_acctbal") > 5000, 1).when(F.col("c_acctbal") > 0, 2).otherwise(3)
    return t("customer").groupBy("c_mktsegment", "c_nationkey").agg(
        F.min_by("c_custkey", F.struct(rank, "c_custkey")).alias("c_custkey"), F.min(rank).alias("rank")
    )


@query
def j09_append_absent(t, spark):
    a = t("customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).filter("nation < 10").distinct()
    b = t("nation").select(F.col("n_nationkey").alias("nation"), F.lit("FURNITURE").alias("segment"))
    return merges.append_absent(a, b, ["nation", "segment"])


@query
def j11_coverage(t, spark):
    """Lines of orders that neither have status F nor an early, skipped part."""
    covered = t("orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    skipped = t("part").filter("p_size < 10").select(F.col("p_partkey").alias("l_partkey"))
    wanted = t("lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return wanted.join(covered, "l_orderkey", "left_anti").join(skipped, "l_partkey", "left_anti").select("l_orderkey", "l_partkey", "l_linenumber")


@query
def j12_decreases(t, spark):
    o = t("orders").select(F.year("o_orderdate").alias("year"), "o_orderpriority", "o_orderkey")
    count = lambda rows: rows.groupBy("year", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return merges.decreases(count(o), count(o.filter("o_orderkey % 8 <> year % 8")), ["year", "o_orderpriority"], "n", 0.1)


@query
def j13_overlap(t, spark):
    wanted = F.array(F.lit("ECONOMY"), F.lit("widget"), F.lit("Brand#13"))
    keys = F.concat(F.split("p_type", "[ ]+", -1), F.split("p_name", "[ ]+", -1), F.array("p_brand"))
    return t("part").filter(F.arrays_overlap(keys, wanted)).select("p_partkey", F.size(F.array_intersect(keys, wanted)).alias("n_keys"))


@query
def o02_mixed_codes(t, spark):
    """Codes sorted numbers first, by value, then the others by name."""
    number = F.expr("try_cast(code as bigint)")
    codes = t("part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_brand")).alias("code"))
    keyed = codes.withColumn("other", number.isNull()).withColumn("value", number)
    return numbered(keyed, ["other", "value", "code", "p_partkey"], "place").select("p_partkey", "code", "place")


def topic_rows(t) -> DataFrame:
    """Regions, nations, customers and two labelled titles of each customer as one tree."""
    id_ = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    row = lambda df, i, up, title, ord_: df.select(i.alias("topic_id"), up.alias("parent_id"), title.alias("title"), ord_.cast("bigint").alias("ord"))
    none = F.lit(None).cast("string")
    r, n, c = t("region"), t("nation"), t("customer")
    parts = [
        row(r, id_("r", "r_regionkey"), none, F.col("r_name"), F.col("r_regionkey")),
        row(n, id_("n", "n_nationkey"), id_("r", "n_regionkey"), F.col("n_name"), F.col("n_nationkey")),
        row(c, id_("c", "c_custkey"), id_("n", "c_nationkey"), F.concat(F.lit("Case： "), "c_name"), F.col("c_custkey")),
        row(c, id_("s", "c_custkey"), id_("c", "c_custkey"), F.concat(F.lit("标签：first "), "c_mktsegment"), F.lit(1)),
        row(c.filter("c_custkey % 2 = 0"), id_("u", "c_custkey"), id_("c", "c_custkey"), F.concat(F.lit("标签: "), "c_mktsegment"), F.lit(2)),
        row(c, id_("p", "c_custkey"), id_("c", "c_custkey"), F.concat(F.lit("前置条件： /api/"), F.lower("c_mktsegment")), F.lit(3)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query
def p01_topic_paths(t, spark):
    return topics.flatten(topic_rows(t)).select("topic_id", "depth", F.array_join("path", " > ").alias("path"))


@query
def p03_cases(t, spark):
    return topics.cases(topic_rows(t), {"labels": "标签", "precondition": "前置条件"})


@query
def p05_keyword_tags(t, spark):
    tags = rules.tags_of(F.col("text"))
    found = t("documents").select("doc_id", tags.alias("tags"))
    return found.select("doc_id", F.array_join("tags", ",").alias("tags"), rules.primary_tag(F.col("tags")).alias("primary_tag"))


@query
def p06_evidence(t, spark):
    said = F.split("text", "\n", -1)
    kept = F.filter(F.array_distinct(said), lambda x: F.lower(x).rlike("|".join(EVIDENCE)))
    return t("conversations").select("conv_id", "turn", F.size(kept).alias("n"), F.array_join(kept, "\n").alias("evidence"))


@query
def p07_sections(t, spark):
    return lines.sections(t("documents"), "doc_id", lambda x: x.rlike(HEADING))


@query
def p16_line_context(t, spark):
    return lines.contexts(t("documents"), "doc_id", lambda x: F.lower(x).rlike(LICENSE), 6, 7)


@query
def p18_roles(t, spark):
    segment = F.lower(F.regexp_extract(path_of(F.col("url")), "^/([^/]+)", 1))
    role = F.coalesce(*[F.when(segment == s, r) for s, r in ROLES.items()], F.lit("supporting_page"))
    return t("pages").select("page_id", segment.alias("segment"), role.alias("role"))


@query
def p19_confidence(t, spark):
    score = F.lit(0.55)
    for found, worth in ((F.instr("html", "<article") > 0, 0.2), (F.instr("html", "<table") > 0, 0.1), (F.instr("html", "<nav") > 0, 0.1), (F.instr("url", "?") > 0, 0.05)):
        score = score + F.when(found, worth).otherwise(0.0)
    return t("pages").select("page_id", F.round(F.least(score, F.lit(0.95)), 2).alias("confidence"))


@query
def p20_path_segments(t, spark):
    path = F.split(F.lower(F.concat_ws(" ", "p_type", "p_name")), "[ ]+", -1)
    wanted = F.array(F.lit("economy"), F.lit("small"))
    return t("part").select("p_partkey", fields.has_segments(path, wanted).alias("matches"))


@query
def p21_predicates(t, spark):
    low = F.lower("p_type")
    return t("part").select(
        "p_partkey", low.rlike("(^| )(small|medium|large)( |$)").alias("is_sized"), low.isin("economy", "standard").alias("is_plain"),
        (F.col("p_size") <= 10).alias("is_optional"), F.col("p_name").rlike("(^|[^a-z])(widget|gear)([^a-z]|$)").alias("is_object"),
    )


@query
def w01_keep_first(t, spark):
    first = merges.keep_first(t("events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")])
    return first.select("user_id", "event_type", "event_id")


@query
def w01_best(t, spark):
    best = merges.best_of(t("orders"), ["o_custkey"], F.struct("o_totalprice", "o_orderkey"), ["o_orderkey", "o_orderstatus"])
    return best.select("o_custkey", "o_orderkey", "o_orderstatus")


@query
def w02_headings(t, spark):
    headed = lines.with_heading(t("documents"), "doc_id", lambda x: x.rlike(HEADING))
    return headed.groupBy("doc_id", "heading").agg(F.count(F.lit(1)).alias("n_lines"), F.max("line_no").alias("last_line"))


@query
def c01_dependency_rules(t, spark):
    """A dependency line for each part, of four sorts; brands stand for endpoints."""
    remark = (
        F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("note\nDependency: when "), "p_name", F.lit(" in [A,B] => Y; otherwise => N(omit); error=BAD_"), "p_size"))
        .when(F.col("p_partkey") % 4 == 1, "Dependency: when mode present => Y(value >= 3); error=E1")
        .when(F.col("p_partkey") % 97 == 2, "Dependency: when mode => maybe")
    )
    made = t("part").select(
        F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string").substr(-1, 1)).alias("endpoint"), F.lit("mode").alias("name"),
        F.regexp_replace(remark, "when [a-z]+ [a-z]+ in", "when mode in").alias("remark"), "p_partkey",
    )
    return dependencies.compile_rules(made, "endpoint", "name", "remark").groupBy("endpoint", "name", "ord", "selector", "condition", "state", "constraint", "error").agg(F.count(F.lit(1)).alias("n"))


@query
def c02_routes(t, spark):
    routed = rules.first_rule(
        [
            ("R1", "p_name like '%bolt%' and p_size < 5", "excluded"), ("R2", "p_type = 'ECONOMY'", "economy"),
            ("R3", "p_name like 'small %'", "small"), ("R4", "p_retailprice > 950", "dear"),
        ],
        ("unmapped", "none"),
    )
    picked = t("part").select("p_partkey", routed.alias("r"))
    return picked.select("p_partkey", F.col("r.target").alias("target"), F.col("r.rule_id").alias("rule_id"))


@query
def c04_categories(t, spark):
    found = F.array(
        F.lit("launch"), F.lit("balance"), F.when(F.col("p_size") > 25, "slots"),
        F.when(F.col("p_type") == "PROMO", "promo"), F.when(F.col("p_name").like("%gear"), "live"), F.when(F.col("p_size") > 40, "slots"),
    )
    return t("part").select("p_partkey", F.array_join(F.sort_array(F.array_distinct(F.array_compact(found))), ",").alias("categories"))


@query
def c06_errors(t, spark):
    """The best error of each brand: by tier, then key; none for a brand without a match."""
    tier = F.when(F.col("p_name").like("small %"), 1).when(F.col("p_type") == "PROMO", 2)
    held = t("part").withColumn("tier", tier).filter("tier is not null")
    return held.groupBy("p_brand").agg(F.min_by("p_partkey", F.struct("tier", "p_partkey")).alias("p_partkey"), F.min("tier").alias("tier"))


@query
def c10_steps(t, spark):
    """A row for each step of each part as a parameter; templates are an array of literals, so nothing is crossed."""
    kind = F.when(F.col("p_size") % 5 == 0, "array").when(F.col("p_type") == "ECONOMY", "amount").otherwise("string")
    step = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("step_no"), F.lit(s).alias("step")) for k, n, s in STEPS])
    made = t("part").select("p_partkey", "p_name", kind.alias("k"))
    rows = made.select("p_partkey", "p_name", F.inline(F.filter(step, lambda s: s.kind == F.col("k"))))
    return rows.select("p_partkey", "step_no", "kind", F.concat_ws(" - ", "p_name", "step").alias("title"))


@query
def c14_reword(t, spark):
    return t("documents").select("doc_id", rules.reword(F.col("text"), {"the": "Debit", "settle|and": "Credit"}).alias("text"))


@query
def c17_issues(t, spark):
    checks = [
        ("error", "$.text", "length(text) < 40"), ("warning", "$.role", "role = 'system'"), ("error", "$.turn", "turn > 6"),
        ("warning", "$.text.lines", "instr(text, '\n') = 0"),
    ]
    return rules.issues(t("conversations"), ["conv_id", "turn"], checks)


@query
def c19_change_gate(t, spark):
    """Orders of each customer before and from 1998 against the status of a re-run."""
    n = t("orders").groupBy("o_custkey").agg(
        F.nullif(F.count_if(F.col("o_orderkey") % 2 == 0), F.lit(0)).alias("before_cases"), F.count_if(F.col("o_orderkey") % 2 == 1).alias("cases"),
        F.min("o_orderstatus").alias("a"), F.max("o_orderstatus").alias("b"),
    )
    gate = rules.change_gate({"cases": F.col("cases")}, {"cases": F.col("before_cases")}, F.col("a") == F.col("b"))
    return n.select("o_custkey", gate.alias("decision"))
