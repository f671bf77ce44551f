"""Mixing sources to target weights by Sainte-Lague apportionment.

Every source gets a target share of all words; targets stop at ``REPEATS`` times the source's size
and the excess is shared out again by weight. Equal blocks of words are seats: sources get them by
highest quotients target / (2 j + 1), and each source's seats go to its shards in the same way. A
shard whose seats hold q words over a size of n takes q div n full passes. The rest is filled block
by block in a seeded order: the documents of a shard stand in a line, a document belongs to the block
in which it begins, and blocks give whole documents until the last document, which is cut where the
quota ends. So a shard cuts one document at most. Column functions only.

Defined results: null text has size 0; a null source is a source, the last; equal rows are separate
documents; sources of size 0 have target 0; without any word every ``taken`` is 0; an empty table
gives an empty table; extra columns are ignored, and a kept column with a result's name gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docwright.functions.text import SPACE_RUN, SPACES
from docwright.llm.frames import without
from docwright.plans.durable import durable

WEIGHTS = [5, 2, 1]
REPEATS = 3
#: Words in a block.
BLOCK_WORDS = 16
#: Words in a shard, on average. Only sizes and keys of a shard's documents meet in one task, never texts.
SHARD_WORDS = 1 << 20
SEED = "mix-1"


def _hash(seed: str, *parts: Column | str) -> Column:
    """A number below 2 ** 60 from the seed and ``parts``."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, total, place, target) from rows with source and size.

    With sources in order of cap / weight, a source is capped if its cap is at most its share of
    what the ones before leave; the first that is not sets the level for all after it.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = sources.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    weighed = named.select(
        "source", "source_size", "place",
        F.get(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("place") - 1) % len(WEIGHTS)).alias("weight"),
        (REPEATS * F.col("source_size")).alias("cap"),
        F.sum("source_size").over(Window.partitionBy()).alias("total"),
    )
    order = [F.col("cap") / F.col("weight"), F.col("place")]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    levels = weighed.withColumn(
        "level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    ).withColumn("free", F.col("cap") > F.col("level") * F.col("weight"))
    final = F.coalesce(F.min_by(F.when(F.col("free"), F.col("level")), F.when(F.col("free"), F.struct(*order))).over(Window.partitionBy()), F.lit(0.0))
    return levels.withColumn("final", final).select(
        "source", "source_size", "total", "place",
        F.when(F.col("cap") <= F.col("final") * F.col("weight"), F.col("cap").cast("double"))
        .otherwise(F.col("final") * F.col("weight")).alias("target"),
    )


def apportion(rows: DataFrame, group: list[str], item: str, share: str, seats: str) -> DataFrame:
    """Add ``quota``: Sainte-Lague seats of each item for its ``share``, ``seats`` in all a group.

    With the divisor sum(share) / seats, rounding gives at most half an item too many or too few
    each, so an item's last seat lies in a narrow range: all seats below are given, and only those
    in the range compete by quotient. Ties go to the smaller item.
    """
    keys = Window.partitionBy(*group)
    divisor = F.sum(share).over(keys) / F.col(seats)
    guess = F.when(F.col(seats) > 0, F.round(F.col(share) / divisor)).otherwise(0.0)
    slack = F.ceil(guess * F.count(F.lit(1)).over(keys) / (2 * F.greatest(F.col(seats), F.lit(1)))) + 2
    ranged = rows.withColumn("_low", F.greatest(guess - slack, F.lit(0.0)).cast("bigint")).withColumn(
        "_high", (guess + slack).cast("bigint")
    )
    left = ranged.withColumn("_left", F.col(seats) - F.sum("_low").over(keys))
    tries = left.withColumn("_seat", F.explode(F.sequence("_low", "_high")))
    best = Window.partitionBy(*group).orderBy(F.desc(F.col(share) / (2 * F.col("_seat") + 1)), F.asc_nulls_last(item), "_seat")
    given = tries.withColumn("_won", (F.row_number().over(best) <= F.col("_left")) & (F.col(share) > 0))
    return given.groupBy(*rows.columns).agg(
        (F.min("_low") + F.sum(F.col("_won").cast("bigint"))).alias("quota")
    )


def plan(docs: DataFrame, keep: list[str], source: str = "source", key: str = "doc_id", text: str = "text", seed: str = SEED) -> DataFrame:
    """``keep`` of each document, its sizes and target, and how much of it is taken.

    ``passes`` counts full takes; ``part`` is the number of its first words that a further take has.
    """
    sized = durable(
        docs.select(
            *[F.col(c).alias(f"k_{c}") for c in without(keep, ["text_key", "size", "source_size", "target", "passes", "part"])],
            F.xxhash64(F.col(text)).alias("text_key"),
            F.col(key).alias("key"),
            F.col(source).cast("string").alias("source"),
            F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("size"),
        )
    )
    seats = source_targets(sized).withColumn("all_seats", F.round(F.col("total") / BLOCK_WORDS).cast("bigint"))
    quotas = durable(
        apportion(seats, ["total"], "place", "target", "all_seats")
        .withColumnRenamed("quota", "source_seats")
        .withColumn("n_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS)))
    )
    q = quotas.select(F.col("source").alias("q_source"), "source_size", "target", "place", "source_seats", "n_shards")
    dealt = sized.join(q, F.col("source").eqNullSafe(F.col("q_source"))).withColumn("shard", _hash(seed, "key", "text_key") % F.col("n_shards"))
    shards = dealt.groupBy("place", "shard", "source_seats").agg(F.sum("size").alias("shard_size"))
    words = F.least(F.col("quota") * BLOCK_WORDS, REPEATS * F.col("shard_size"))
    ready = apportion(shards, ["place"], "shard", "shard_size", "source_seats").select(
        F.col("place").alias("s_place"), F.col("shard").alias("s_shard"),
        F.when(F.col("shard_size") > 0, F.floor(words / F.col("shard_size"))).otherwise(0).alias("passes"),
        F.when(F.col("shard_size") > 0, words % F.col("shard_size")).otherwise(0).alias("rest"),
    )
    here = Window.partitionBy("place", "shard")
    line = here.orderBy(F.asc_nulls_last("key"), "text_key").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum("size").over(line), F.lit(0))
    laid = dealt.withColumn("block", F.floor(begin / BLOCK_WORDS))
    drawn = here.orderBy(_hash(seed, "place", "shard", "block"), "block", F.asc_nulls_last("key"), "text_key").rowsBetween(Window.unboundedPreceding, -1)
    ahead = laid.withColumn("ahead", F.coalesce(F.sum("size").over(drawn), F.lit(0)))
    met = ahead.join(ready, (F.col("place") == F.col("s_place")) & (F.col("shard") == F.col("s_shard")))
    part = F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("ahead"))).cast("bigint")
    return met.select(
        *[F.col(c).alias(c[2:]) for c in sized.columns if c.startswith("k_")], "text_key", "size", "source_size", "target", "passes", part.alias("part")
    )


def taken() -> Column:
    """Words that the mix takes of a planned document, repeats counted."""
    return F.col("passes") * F.col("size") + F.col("part")


def first_words(text: Column, n: Column) -> Column:
    """The first ``n`` words of ``text`` with the white space between them as it is."""
    trimmed = F.btrim(text, F.lit(SPACES))
    words, gaps = F.split(trimmed, SPACE_RUN, -1), F.regexp_extract_all(trimmed, F.lit(f"({SPACE_RUN})"), F.lit(1))
    before = F.zip_with(F.slice(words, 1, n - 1), F.slice(gaps, 1, n - 1), lambda w, g: F.concat(w, g))
    return F.concat(F.array_join(before, ""), F.get(words, n - 1))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", seed: str = SEED) -> DataFrame:
    """The mixed corpus with the columns of ``docs``: a row for each take of a document.

    A full take has the whole text, a further one its first words up to the quota; documents that
    aren't taken go. Rows equal in key and text get one decision.
    """
    decided = plan(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), "text"), ["key"], "source", "key", seed=seed)
    given = decided.filter(taken() > 0).dropDuplicates(["key", "text_key"]).select(F.col("key").alias("_key"), "text_key", F.struct("size", "passes", "part").alias("_take"))
    held = docs.select(F.struct(*docs.columns).alias("_doc"), F.xxhash64("text").alias("_text_key"))
    met = held.join(given, F.col(f"_doc.{key}").eqNullSafe(F.col("_key")) & (F.col("_text_key") == F.col("text_key")))
    text, part, passes = F.col("_doc.text"), F.col("_take.part").cast("int"), F.col("_take.passes").cast("int")
    cut = F.when(part == F.col("_take.size"), text).otherwise(first_words(text, part))
    further = F.when(part == 0, F.array().cast("array<string>")).otherwise(F.array(cut))
    rows = met.select("_doc", F.explode(F.concat(F.array_repeat(text, passes), further)).alias("_taken"))
    fresh = {"text": F.col("_taken")}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.length("_taken").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[fresh.get(c, F.col("_doc").getField(c)).alias(c) for c in docs.columns])
