"""SimHash near-duplicates by tiled exact comparison.

Each text gets a 64-bit fingerprint. The 64 bits are cut into more blocks than the radius: two
fingerprints within it agree on some ``blocks - radius`` of them, so comparing only fingerprints that
agree on such a choice of blocks loses no link. Each choice and value is a cell, whose fingerprints
are packed into tiles sorted by population count. Runs of a tile are compared exactly with numpy
exclusive-or and bit counts, only against runs whose counts differ by no more than the radius, since
a bit changes the count by one. A comparison gives no list of all pairs: it joins what is linked
inside and returns one edge for each fingerprint to the root of its piece. Pieces of all comparisons
are then joined by label propagation with pointer jumps, one durable frame a round.

Defined results: null text is empty; a text without words has fingerprint zero and links like any
other; equal rows and copies share a fingerprint and so a component; null ids are ignored when the
smallest id is taken; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docwright.plans.durable import durable

RADIUS = 4
SHINGLE_WORDS = 4
SEED = 42
#: Fingerprints in a tile, rows of a tile compared at once, shingles summed at once.
TILE, STRIP, CHUNK = 8192, 128, 65_536
BITS = 64
#: Parts that the links of one label are spread over when they meet it.
SALTS = 16
#: Rows of a fingerprint from which on they are spread over the salts.
MANY = 64


def fingerprint(text: bytes | None, n: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The majority bits of the XXH64 of the text's word shingles, as a signed 64-bit number.

    ``bytes.lower`` changes A-Z alone, and ``bytes.split`` splits at ASCII white space alone.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(n, len(words))
    first, last = starts[: len(words) - k + 1], ends[k - 1 :]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(first), CHUNK):
        spans = zip(first[at : at + CHUNK].tolist(), last[at : at + CHUNK].tolist(), strict=True)
        h = np.array([digest(line[a:b], seed) for a, b in spans], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(first), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` of each document and ``fp``, its fingerprint as a bigint."""
    read = docs.select(*[F.col(c) for c in keep], F.col(text).cast("binary").alias("_text"))
    schema = docs.select(*keep).schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t.as_py()) for t in batch.column(len(keep))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], fps], [*keep, "fp"])

    return read.mapInArrow(run, schema)


def choices(n: int, radius: int = RADIUS, tile: int = TILE) -> list[int]:
    """Masks of the bits that a cell fixes; fingerprints within ``radius`` agree under one of them.

    The number of blocks is the least with which ``n`` evenly spread fingerprints fill no cell beyond
    a tile; any number above the radius gives the same links.
    """
    blocks = radius + 1
    while blocks < 4 * radius and n > tile * 2 ** (BITS * (blocks - radius) / blocks):
        blocks += 1
    edges = [round(BITS * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(edges)]
    masks = (sum(c) for c in itertools.combinations(parts, blocks - radius))
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def tiles(distinct: DataFrame, radius: int = RADIUS, size: int = TILE) -> DataFrame:
    """(a, b): the fingerprints of each two parts of a cell that must be compared; ``b`` is empty for a part and itself.

    Cells beyond a tile are cut into parts by hash, and each part goes to its pairs. Cells with one
    fingerprint go.
    """
    held = durable(distinct)
    masks = choices(held.count(), radius, size)
    cells = held.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("choice", "value"))
    key = ["choice", "value"]
    large = durable(cells.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > size))
    n_parts = F.coalesce(F.ceil(F.col("n") / size), F.lit(1)).cast("long")
    sized = met(cells, large, key, "fp", "left") if large.limit(1).count() else cells.withColumn("n", F.lit(None).cast("long"))
    parted = sized.withColumn("n_parts", n_parts).withColumn("part", F.pmod(F.xxhash64("fp"), "n_parts"))
    paired = parted.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_parts") - 1)))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    side = lambda first: F.collect_list(F.when((F.col("part") == F.col("low")) == first, F.col("fp")))
    gathered = paired.select(*key, "part", low.alias("low"), high.alias("high"), "fp").groupBy(*key, "low", "high")
    return gathered.agg(side(F.lit(True)).alias("a"), side(F.lit(False)).alias("b")).filter(F.size("a") + F.size("b") > 1).select("a", "b")


def joined_pieces(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, root) that join what is within ``radius`` between ``a`` and ``b``.

    Both are sorted by population count, and a run of ``a`` meets only the run of ``b`` whose counts
    come within the radius. Links inside a piece already joined are passed over, so a dense group
    costs no more edges than it has members.
    """
    a, b = (x[np.argsort(np.bitwise_count(x), kind="stable")] for x in (a, b))
    pop_a, pop_b = np.bitwise_count(a).astype(np.int64), np.bitwise_count(b).astype(np.int64)
    nodes = np.concatenate((a, b))
    root = np.arange(len(nodes))

    def union(pairs: np.ndarray) -> None:
        for x, y in pairs.tolist():
            while root[x] != x:
                root[x] = x = root[root[x]]
            while root[y] != y:
                root[y] = y = root[root[y]]
            if x != y:
                root[max(x, y)] = min(x, y)

    def flat() -> None:
        while not np.array_equal(up := root[root], root):
            root[:] = up

    for at in range(0, len(a), STRIP):
        rows = np.arange(at, min(at + STRIP, len(a)))
        begin, end = np.searchsorted(pop_b, pop_a[rows[0]] - radius), np.searchsorted(pop_b, pop_a[rows[-1]] + radius, "right")
        cols = np.arange(len(a) + begin, len(a) + end)
        near = np.bitwise_count(a[rows][:, None] ^ b[None, begin:end]) <= radius
        if not near.any():
            continue
        while True:
            flat()
            open_ = near & (root[rows][:, None] != root[cols][None, :])
            by_col, by_row = open_.any(axis=0), open_.any(axis=1)
            if not by_col.any():
                break
            first_row = rows[open_[:, by_col].argmax(axis=0)]
            first_col = cols[open_[by_row].argmax(axis=1)]
            union(np.stack((first_row, cols[by_col]), axis=1))
            union(np.stack((rows[by_row], first_col), axis=1))
    flat()
    linked = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[linked], nodes[root[linked]]


def edges(tiled: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): edges that join every pair of distinct fingerprints within ``radius`` into pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                a, b = (np.asarray(batch.column(k)[i].values, dtype=np.int64).view(np.uint64) for k in (0, 1))
                x, y = joined_pieces(a, b if len(b) else a, radius)
                apart = x != y
                if apart.any():
                    found.append((x[apart].view(np.int64), y[apart].view(np.int64)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in zip(*found, strict=True)], ["a", "b"])

    return tiled.mapInArrow(run, "a long, b long")


def met(rows: DataFrame, small: DataFrame, key: str | list[str], by: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``rows`` joined to ``small``, which holds ``key`` once: rows of one key are spread by ``by`` over salts.

    A key with a third of all rows thus never meets its partner in one task. The merge hint keeps it so
    where ``rows`` are few: sent to ``small`` instead, they would all come out where the key's copies lie.
    """
    keys = [key] if isinstance(key, str) else key
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.hint("merge").join(repeated, [*keys, "_salt"], how).drop("_salt")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches.

    Every round takes the smallest label among neighbours (summed before the shuffle), then that
    label's own label. The driver only sees a count of changes.
    """
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both = durable(links.select(ways.alias("way")).select("way.*").distinct())  # the comparisons run once for both ways
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("root")))
    while True:
        heard = met(both, labels.select(F.col("node").alias("b"), "root"), "b", "a").groupBy("a").agg(F.min("root").alias("low"))
        lower = labels.join(heard.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("root").alias("old"), F.least("root", "low").alias("root")
        )
        of_root = lower.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = durable(met(lower, of_root, "root", "node").select("node", "old", F.least("root", "next").alias("root")))
        if new.filter("root != old").limit(1).count() == 0:
            return new.select("node", "root")
        labels = new.select("node", "root")


def rooted(firsts: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``firsts``, one row for each distinct ``fp``, with ``root``, the fingerprint that stands for its component, and ``linked``."""
    reach = components(edges(tiles(firsts.select("fp"), radius), radius))
    met_roots = firsts.join(reach.select(F.col("node").alias("fp"), "root"), "fp", "left")
    return met_roots.withColumn("linked", F.col("root").isNotNull()).withColumn("root", F.coalesce("root", "fp"))


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """key, ``fp`` and ``component_id``, the smallest key that near-duplicate links reach."""
    given = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    known = durable(fingerprints(given, ["key"]).withColumn("row", F.monotonically_increasing_id()))
    reached = durable(rooted(known.groupBy("fp").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")), radius))
    linked = reached.filter("linked")
    lowest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    alone = reached.filter(~F.col("linked")).select("fp", "n", F.col("first").alias("component_id"))
    named = met(linked, lowest, "root", "fp").select("fp", "n", "component_id").unionByName(alone)
    # Fingerprints of many rows are met over salts; each of the others has few rows.
    hot = durable(named.filter(F.col("n") > MANY).select("fp", "component_id"))
    first = met(known, hot, "fp", "row", "left")
    rest = first.filter("component_id is null").drop("component_id").join(named.filter(F.col("n") <= MANY).select("fp", "component_id"), "fp", "left")
    return first.filter("component_id is not null").unionByName(rest).select(F.col("key").alias(key), "fp", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row of each group: smallest key, nulls last, then smallest hash of the text.

    A row is known by its key and two hashes of its text, so equal or null keys of different texts
    stay apart. Of rows with the same key and text the one of the smallest hash stays, which is found before the shuffle.
    """
    identity = ["key", "h1", "h2"]
    known_by = [
        F.col(key).alias("key"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), F.col("text")).alias("h2"),
    ]
    known = durable(fingerprints(docs.select(*known_by, "text"), identity))
    alike = known.groupBy("fp", *identity).agg(F.count(F.lit(1)).alias("n"))
    firsts = alike.groupBy("fp").agg(F.min(F.struct(F.col("key").isNull().alias("last"), *identity, "n")).alias("first"))
    chosen = rooted(firsts).groupBy("root").agg(F.min("first").alias("first")).select(
        *[F.col(f"first.{c}").alias(f"c_{c}") for c in (*identity, "n")]
    )
    same = F.lit(True)
    for c in ("h1", "h2", "key"):
        same = same & F.col(c).eqNullSafe(F.col(f"c_{c}"))
    kept = docs.select(F.struct(*docs.columns).alias("_doc"), *known_by).join(chosen, same)
    hashed = F.xxhash64("_doc")
    repeated = kept.filter("c_n > 1").groupBy(*identity).agg(F.min_by("_doc", hashed).alias("_doc"))
    return kept.filter("c_n = 1").select("_doc.*").unionByName(repeated.select("_doc.*"))
