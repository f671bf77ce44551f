"""Secret scan with corpus-wide ownership frequency.

Patterns give candidate spans; the hash of every candidate value is counted by distinct owners,
distinct repositories and distinct texts over the whole corpus. A value that many owners share, or
several owners in many repositories, or very many texts, is a copied example; one owner's value looks
live in however many of that owner's repositories it stands. Base kinds are always listed with their class; the further kinds, which are
looser, are listed where the value looks live, and apart where not. Column functions only.

Defined results: null text is empty; null owners count as one owner, null repositories as none; equal rows are scanned as
separate rows; documents without a hit give zero counts and empty span lists; an empty table gives
an empty table; extra columns are ignored, and a kept column with a result's name gives way to it.

Spans are in code points, end exclusive. ``split`` and ``regexp_extract_all`` walk the same
matches, so the running sum of gaps and match lengths gives the positions.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docwright.llm.frames import without
from docwright.llm.simhash_dedup import met
from docwright.plans.durable import durable

#: Kind, pattern, group that holds the value, least characters of the value.
BASE_KINDS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
KEY_NAME = r"[A-Z0-9\x20]*PRIVATE\x20KEY(?:\x20BLOCK)?-----"
KEY_BEGIN, KEY_END = r"-----BEGIN\x20" + KEY_NAME, r"-----END\x20" + KEY_NAME
#: A key up to the next five hyphens, which must be its end: headers, escaped line ends, quotes and comment leaders may stand inside.
CLOSED_KEY = r"(?>[\s\S]*?(?=-----))" + KEY_END
#: A line end, or an escaped one, before base64.
BODY_LINE = r"(?:\n|\\n)[\\rn\x20\x09-\x0D]*[A-Za-z0-9+/=]{32}"
#: A key without an end: header lines up to the first line of base64, then base64, spaces and escaped line ends.
OPEN_KEY = (
    r"(?:(?=[\\rn\x20\x09-\x0D]*[A-Z][A-Za-z-]*:\x20)(?>[\s\S]*?(?=-----|\z|" + BODY_LINE + r"))(?=" + BODY_LINE + r"))?"
    r"[A-Za-z0-9+/=\\\x20\x09-\x0D]+"
)
#: Further kinds, which are looser. Where the ownership count takes the value for an example they are flagged.
MORE_KINDS = [
    ("key_block", KEY_BEGIN + f"(?:{CLOSED_KEY}|{OPEN_KEY})", 0, 40),
    ("provider", r"\b(?:gh[opsu]_|github_pat_|glpat-|xox[abps]-|sk_live_|sk-)[A-Za-z0-9_-]{16,}", 0, 20),
    ("url_login", r"://[^\x20\x09-\x0D/:@]+:([^\x20\x09-\x0D/:@]+)@", 1, 6),
]
KINDS = [*BASE_KINDS, *MORE_KINDS]
#: A value held by this many owners, or by two owners in this many repositories, or by this many different texts of any owners, is an example;
#: in a large corpus by this share of all owners (repositories, texts) at least.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES, EXAMPLE_DOCS = 4, 8, 100
EXAMPLE_SHARE = 1e-4


def _hits(text: Column, kind: int) -> Column:
    """Matches of one kind in order: gap before, length, whether the value is long enough, hash."""
    _, pattern, group, least = KINDS[kind]
    p = F.lit(pattern)
    found = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, p, F.lit(0)).alias("m"),
        F.regexp_extract_all(text, p, F.lit(group)).alias("v"),
    )
    rows = F.transform(
        F.filter(found, lambda x: x.m.isNotNull()),
        lambda x: F.struct(
            F.lit(kind).alias("kind"),
            F.length(x.gap).alias("gap"),
            F.length(x.m).alias("len"),
            (F.length(x.v) >= least).alias("ok"),
            F.sha2(x.v, 256).alias("h"),
        ),
    )
    none = F.array().cast("array<struct<kind:int,gap:int,len:int,ok:boolean,h:string>>")
    return F.when(text.rlike(pattern), rows).otherwise(none)


def _text(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def has_candidates(text: str = "text") -> Column:
    """Whether any pattern matches, before lengths are looked at."""
    found = F.lit(False)
    for _, pattern, _, _ in KINDS:
        found = found | _text(text).rlike(pattern)
    return found


def candidates(docs: DataFrame, keep: list[str], owner: str = "source", text: str = "text", repository: Column | None = None) -> DataFrame:
    """One row a document: a row id, ``k_<column>`` for ``keep``, the owner, the repository and its pattern hits.

    Made durable, so that texts are read once and row ids stay as they are.
    """
    return durable(
        docs.select(
            F.monotonically_increasing_id().alias("rid"),
            *[F.col(c).alias(f"k_{c}") for c in keep],
            F.xxhash64(_text(text)).alias("text_key"),
            F.col(owner).alias("owner"),
            (F.lit(None) if repository is None else repository).cast("string").alias("repository"),
            F.concat(*[_hits(_text(text), k) for k in range(len(KINDS))]).alias("hits"),
        )
    )


def ownership(spans: DataFrame) -> DataFrame:
    """(h, n_owners, n_repositories, n_docs) of candidate hashes; copies of one text are one of ``n_docs``.

    Distinct values are found before the last shuffle, so that no hash is hot.
    """
    return spans.filter("ok").groupBy("h").agg(
        F.count_distinct(F.struct("owner")).alias("n_owners"), F.count_distinct("repository").alias("n_repositories"), F.count_distinct("text_key").alias("n_docs")
    )


def example_limits(rows: DataFrame, share: float = EXAMPLE_SHARE) -> tuple[int, int, int]:
    """From how many owners, repositories and texts on a value is an example: the least numbers, or their share of all."""
    total = rows.agg(F.count_distinct(F.struct("owner")), F.count_distinct("repository"), F.count_distinct("text_key")).first()
    return tuple(max(least, math.ceil(share * n)) for least, n in zip((EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES, EXAMPLE_DOCS), total, strict=True))


def scan(
    docs: DataFrame, keep: list[str], owner: str = "source", text: str = "text", repository: Column | None = None, share: float = EXAMPLE_SHARE
) -> DataFrame:
    """One row a document: ``keep``, ``text_key`` and ``found``, an array of spans in order.

    A span has start, kind (index into ``KINDS``), end, n_owners, n_repositories, n_docs and live.
    Examples are among them, not live; from which counts on is the larger of fixed least numbers and ``share`` of the corpus. ``repository`` names the repository of a row, such as a prefix
    of its path or address.
    """
    keep = without(keep, ["text_key", "found"])
    rows = candidates(docs, keep, owner, text, repository)
    names = [f"k_{c}" for c in keep]
    each = rows.filter(F.size("hits") > 0).select(
        "rid", *names, "text_key", "owner", "repository", F.posexplode("hits").alias("pos", "hit")
    )
    walked = Window.partitionBy("rid", "hit.kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.select(
        "rid", *names, "text_key", "owner", "repository", "hit.*", F.sum(F.col("hit.gap") + F.col("hit.len")).over(walked).alias("end")
    )
    counted = met(placed, ownership(placed), "h", "rid", "left")
    owners, repositories, texts = example_limits(rows, share)
    scattered = (F.col("n_owners") > 1) & (F.col("n_repositories") >= repositories)
    live = (F.col("n_owners") < owners) & ~scattered & (F.col("n_docs") < texts)
    span = F.struct(
        (F.col("end") - F.col("len")).alias("start"), "kind", "end", "n_owners", "n_repositories", "n_docs", live.alias("live")
    )
    found = counted.groupBy("rid", *names, "text_key").agg(
        F.sort_array(F.collect_list(F.when(F.col("ok"), span))).alias("found")
    )
    empty = F.array().cast(found.schema["found"].dataType)
    bare = rows.filter(F.size("hits") == 0).select("rid", *names, "text_key", empty.alias("found"))
    return found.unionByName(bare).select(*[F.col(f"k_{c}").alias(c) for c in keep], "text_key", "found")


def _listed(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k, *_ in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s.kind), s.start.cast("string"), s.end.cast("string"))),
        ",",
    )


def _is_kind(kind: int) -> Callable[[Column], Column]:
    return lambda s: s.kind == kind


def digest(scanned: DataFrame) -> DataFrame:
    """The documents' counts and span lists in place of ``found``.

    ``spans`` holds them all, ``example_spans`` those of the further kinds that look like examples.
    """
    base = F.filter("found", lambda s: s.kind < len(BASE_KINDS))
    flagged = F.filter("found", lambda s: ~s.live & (s.kind >= len(BASE_KINDS)))
    count = lambda keep: F.size(F.filter("found", keep)).cast("bigint")
    made = [*[f"n_{KINDS[k][0]}" for k in range(len(BASE_KINDS))], "base_sha256", "spans", "n_live", "n_example", "example_spans"]
    return scanned.select(
        *[F.col(c) for c in without(scanned.columns, ["text_key", "found", *made])],
        *[count(_is_kind(k)).alias(f"n_{KINDS[k][0]}") for k in range(len(BASE_KINDS))],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("found")).alias("spans"),
        count(lambda s: s.live).alias("n_live"),
        count(lambda s: ~s.live & (s.kind < len(BASE_KINDS))).alias("n_example"),
        _listed(flagged).alias("example_spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]", owner: str = "source", key: str = "doc_id", repository: Column | None = None) -> DataFrame:
    """``docs`` with every span of ``text``, example or live, replaced by ``mark``; ``n_chars`` follows.

    Only documents with a pattern hit meet their spans in a join; the other texts aren't moved.
    Overlapping spans get one mark.
    """
    given = docs.withColumn("_repository", F.lit(None) if repository is None else repository)
    named = given.select(F.col(key).alias("_key"), F.col(owner).alias("_owner"), "text", "_repository")
    scanned = scan(named, ["_key"], "_owner", repository=F.col("_repository")).filter(F.size("found") > 0).dropDuplicates(["_key", "text_key"])
    touched, rest = docs.filter(has_candidates()), docs.filter(~has_candidates())
    spans = scanned.select("_key", "text_key", "found")
    held = touched.select(F.struct(*docs.columns).alias("_doc"), F.col(key).alias("_id"), "text", F.xxhash64(_text("text")).alias("_text_key"))
    joined = held.join(spans, F.col("_id").eqNullSafe(F.col("_key")) & (F.col("_text_key") == F.col("text_key")), "left")
    start = F.struct(F.lit(0).cast("bigint").alias("pos"), F.array().cast("array<string>").alias("parts"))

    def take(acc: Column, s: Column) -> Column:
        plain = F.substring(F.col("text"), (acc.pos + 1).cast("int"), (s.start - acc.pos).cast("int"))
        fresh = F.when(s.start >= acc.pos, F.concat(acc.parts, F.array(plain, F.lit(mark)))).otherwise(acc.parts)
        return F.struct(F.greatest(acc.pos, s.end).alias("pos"), fresh.alias("parts"))

    def finish(acc: Column) -> Column:
        return F.concat(F.array_join(acc.parts, ""), F.substring(F.col("text"), (acc.pos + 1).cast("int"), F.lit(2**31 - 1)))

    clean = F.when(F.col("found").isNull(), F.col("text")).otherwise(F.aggregate("found", start, take, finish))
    done = joined.withColumn("text", clean)
    doc = F.col("_doc").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        doc = doc.withField("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(doc.alias("_doc")).select("_doc.*").unionByName(rest)
