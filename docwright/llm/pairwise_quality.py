"""Quality scores by Bradley-Terry ranking.

A document's strength is a weighted sum of features of its whole text. Weights are learnt from
preference pairs, a good document preferred to a bad one, by logistic loss on the difference of their
features, so only what tells the two apart counts. All labelled documents that may be learnt from are learnt from:
each stands in at least ``PAIRS`` pairs with seeded partners, never all good with all bad. A score
quantile sets the threshold: as many labelled documents lie below it as are labelled bad. Scores are the logistic function of the strength, moved so that the quantile
gets ``THRESHOLD``.

Features are column functions over whole texts and are made durable, so texts are read once for
fit and scores. Labels are joined by id; pairs lie over all partitions, and a pass over them gives the driver sums of fixed size.
A caller may ask for a bounded sample by ``size``; the query does not.

Defined results: a null text is empty, and an empty text has features of zero and a score like any other; a null id
counts as the empty string, which is held out; label rows with a null id or a quality other than 0 and
1 are ignored, and of several label rows of one id the greatest quality counts; documents that share
an id are all learnt from; where either class has no row to learn from, every
score is 0.5; equal rows are kept and get equal scores; an empty table gives an empty table; extra
columns are passed by, and a kept column with a result's name gives way to it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwright.llm.frames import without
from docwright.llm.quality_rules import measure
from docwright.plans.durable import durable
from docwright.plans.numbering import numbered

#: Label rows of each class in a sample, where a caller asks for one, taken in order of a hash of the id.
SAMPLE = 20_000
#: Pairs in which each sampled document stands at least, and the seed of its partners.
PAIRS, SEED = 8, 13
#: Weight of the squared weights beside the mean loss of a pair, and most steps of Newton's method.
RIDGE, STEPS = 1e-4, 50
THRESHOLD = 0.3
#: Remainders of crc32 of the id by this number; 0 is held out.
FOLDS = 5

def shares() -> dict[str, Column]:
    """Features by name; each is zero for a text without words."""
    n = lambda c: F.col(c).cast("double")
    per = lambda a, b: F.when(F.col(b) > 0, n(a) / n(b)).otherwise(0.0)
    word_length = per("word_chars", "n_words")
    plain = {
        "length": F.log1p(n("n_words")),
        "word_length": word_length,
        "odd_word_length": F.when(F.col("n_words") > 0, F.abs(word_length - 5.0)).otherwise(0.0),
        "symbols": per("n_symbols", "word_chars"),
        "duplicate_lines": per("n_dup_lines", "n_lines"),
        "repetition": per("n_repeat_words", "n_words"),
        "distinct": per("n_distinct", "n_words"),
        "capitals": per("n_upper", "word_chars"),
        "shouting": per("n_shouts", "n_words"),
        "line_ends": per("n_end_lines", "n_lines"),
        "words_a_line": F.log1p(per("n_words", "n_lines")),
        "stops": per("n_stops", "n_words"),
        "digits": per("n_digits", "word_chars"),
        "marks": per("n_marks", "n_words"),
        "long_words": per("n_long", "n_words"),
    }
    # the square root lifts small shares, which tell as much as large ones
    bent = {f"{k}_root": F.sqrt(plain[k]) for k in ("symbols", "duplicate_lines", "repetition", "capitals", "shouting", "digits", "marks", "long_words")}
    return plain | bent


def featured(docs: DataFrame, text: str) -> DataFrame:
    """The columns of ``docs`` but ``text``, with ``x``, the array of ``shares()``."""
    body = F.coalesce(F.col(text), F.lit(""))
    times = lambda p: F.regexp_count(body, F.lit(p)).cast("bigint")
    more = docs.select(
        "*",
        times(r"[.!?,;:](?=[\x20\x09-\x0D]|$)").alias("n_stops"),
        times(r"\p{Nd}").alias("n_digits"),
        times(r"[\p{S}_~#@^=+*/\\|<>{}\[\]]").alias("n_marks"),
        times(r"[^\x20\x09-\x0D]{20,}").alias("n_long"),
    )
    return measure(more, text).select(*[c for c in docs.columns if c != text], F.array(*shares().values()).alias("x"))


def held_out(key: Column) -> Column:
    """Whether labels of this id are never learnt from."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def free_labels(labels: DataFrame) -> DataFrame:
    """(doc, quality): all labels that may be learnt from, one row an id."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("doc")).agg(F.max("quality").alias("quality"))
    return known.filter(~held_out(F.col("doc")))


def label_sample(labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """(doc, quality, n_class): at most ``size`` label rows of each class, and how many the class has; for who asks for a sample."""
    free = free_labels(labels)
    classes = free.groupBy("quality").agg(F.count(F.lit(1)).alias("n_class"))
    first = lambda q: free.filter(F.col("quality") == q).orderBy(F.xxhash64("doc"), "doc").limit(size)
    return first(0).unionByName(first(1)).join(F.broadcast(classes), "quality")


def fit(x: np.ndarray, good: np.ndarray, n_good: float, n_bad: float) -> tuple[np.ndarray, float]:
    """Weights of the features, and the moved threshold: strength x @ weights + shift has ``THRESHOLD`` at the quantile.

    Newton's method on the mean logistic loss of the pairs' differences, with a ridge.
    """
    spread = x.std(axis=0)
    scale = np.where(spread > 1e-12, spread, np.inf)
    z = x / scale
    better, worse = np.flatnonzero(good), np.flatnonzero(~good)
    r, n = np.random.default_rng(SEED), PAIRS * max(len(better), len(worse))
    drawn = [np.concatenate([r.permutation(rows) for _ in range(math.ceil(n / len(rows)))])[:n] for rows in (better, worse)]
    d = z[drawn[0]] - z[drawn[1]]
    w = np.zeros(x.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))  # the chance that the pair is ranked the wrong way round
        slope = -(d * p[:, None]).mean(axis=0) + RIDGE * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / n + RIDGE * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w - step * min(1.0, 10 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    strength = z @ w
    order = np.argsort(strength, kind="stable")
    share = np.where(good, n_good / good.sum(), n_bad / (~good).sum())[order]
    below = int(np.searchsorted(np.cumsum(share), n_bad * (1 - 1e-9))) + 1
    ranked = strength[order]
    cut = (ranked[below - 1] + ranked[min(below, len(ranked) - 1)]) / 2
    return w / scale, math.log(THRESHOLD / (1 - THRESHOLD)) - cut


def pairs(met: DataFrame, n_bad: int, n_good: int) -> DataFrame:
    """(n, d): differences of features, good less bad, over all rows of ``met`` (quality, x).

    Every row of the larger class meets ``PAIRS`` rows of the smaller one, and every row of the smaller class as many more
    as there are rows to meet. Pair n joins the rows at places n modulo each class's size, and each
    round over the smaller class is moved by one place more, so partners change.
    """
    at = lambda q: numbered(met.filter(F.col("quality") == q).select("x", F.xxhash64("x", F.lit(SEED)).alias("h")), ["h", "x"], "place").select((F.col("place") - 1).alias("at"), "x")
    bad, good = at(0), at(1)
    large, small, n_large, n_small = (good, bad, n_good, n_bad) if n_good >= n_bad else (bad, good, n_bad, n_good)
    turns = large.select(F.explode(F.sequence(F.lit(0), F.lit(PAIRS - 1))).alias("t"), "at", F.col("x").alias("a"))
    placed = turns.select((F.col("t").cast("long") * F.lit(n_large) + F.col("at")).alias("n"), "a")
    partner = F.pmod(F.col("n") + F.floor(F.col("n") / n_small), F.lit(n_small)).alias("at")
    sign = 1.0 if n_good >= n_bad else -1.0
    met_by = placed.select("n", "a", partner).join(small.withColumnRenamed("x", "b"), "at")
    return met_by.select("n", F.zip_with("a", "b", lambda a, b: (a - b) * F.lit(sign)).alias("d"))


def _sums(rows: DataFrame, w: list[float]) -> np.ndarray:
    """Over all pairs: the mean slope and the mean curve of the loss at ``w``, as one row of sums of each partition."""
    k = len(w)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first, weights = np.zeros(k + k * k), None, np.array(w)
        for batch in batches:
            if not batch.num_rows:
                continue
            d = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            first = int(pc.min(batch.column(0)).as_py()) if first is None else min(first, int(pc.min(batch.column(0)).as_py()))
            p = 1 / (1 + np.exp(np.clip(d @ weights, -500, 500)))  # the chance that the pair is ranked the wrong way round
            total[:k] += (d * p[:, None]).sum(axis=0)
            total[k:] += ((d * (p * (1 - p))[:, None]).T @ d).ravel()
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([total.tolist()], pa.list_(pa.float64()))], ["first", "s"])

    sums = rows.mapInArrow(part, "first bigint, s array<double>")
    # in order of the partitions' first pairs, so that runs add up alike
    whole = sums.agg(F.sort_array(F.collect_list(F.struct("first", "s"))).alias("all"))
    zero = F.array_repeat(F.lit(0.0), k + k * k)
    return np.array(whole.select(F.aggregate("all", zero, lambda t, x: F.zip_with(t, x.s, lambda a, b: a + b)).alias("s")).first().s)


def model(known: DataFrame, labels: DataFrame, size: int | None = None) -> tuple[list[float], float]:
    """Weights and shift, fitted to all labelled rows; with ``size``, to a sample of at most so many rows of each class.

    Each step of Newton's method is one pass over the pairs, which adds up a slope and a curve of fixed size.
    """
    k = len(shares())
    asked = label_sample(labels, size).select("doc", "quality") if size else free_labels(labels)
    found = known.join(asked, F.col("key") == F.col("doc")).select("quality", "x", F.xxhash64("doc", "x").alias("h"), "doc")
    if size:  # ids that stand for several documents could make the sample grow, so it is bounded again
        bounded = lambda q: found.filter(F.col("quality") == q).orderBy("h", "doc", "x").limit(size)
        found = bounded(0).unionByName(bounded(1))
    met = durable(found.select("quality", "x"))
    spread = [F.stddev_pop(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(k)]
    of = met.agg(F.count_if(F.col("quality") == 0).alias("bad"), F.count_if(F.col("quality") == 1).alias("good"), *spread).first()
    if not of.bad or not of.good:
        return [0.0] * k, 0.0
    # twelve digits, so that the order of adding up changes nothing
    scale = [float(f"{of[f's{i}']:.12g}") if of[f"s{i}"] > 1e-12 else math.inf for i in range(k)]
    z = met.select("quality", F.transform("x", lambda v, i: v / F.get(F.array(*map(F.lit, scale)), i)).alias("x"))
    rows = durable(pairs(z, of.bad, of.good).repartition("n").sortWithinPartitions("n"))
    n = PAIRS * max(of.bad, of.good)
    w = np.zeros(k)
    for _ in range(STEPS):
        s = _sums(rows, w.tolist()) / n
        step = np.linalg.solve(s[k:].reshape(k, k) + RIDGE * np.eye(k), RIDGE * w - s[:k])
        w = w - step * min(1.0, 10 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    weights = [float(f"{v:.9g}") / s for v, s in zip(w.tolist(), scale, strict=True)]
    # the quantile: as many labelled documents lie below it as are labelled bad, found by their places in the whole order
    ranked = numbered(met.select(strength_of(weights, 0.0).alias("strength")), ["strength"], "place")
    edge = ranked.filter(F.col("place").isin(of.bad, of.bad + 1)).agg(F.avg("strength").alias("cut")).first()
    return weights, math.log(THRESHOLD / (1 - THRESHOLD)) - edge.cut


def strength_of(weights: list[float], shift: float) -> Column:
    strength = F.lit(shift)
    for i, w in enumerate(weights):
        strength = strength + F.get("x", F.lit(i)) * F.lit(w)
    return strength


def classify(docs: DataFrame, labels: DataFrame, keep: list[str], key: str = "doc_id", text: str = "text", size: int | None = None) -> DataFrame:
    """``keep`` of each document with held_out, score and predicted."""
    keep = without(keep, ["held_out", "score", "predicted"])
    picked = docs.select(*[F.col(c).alias(f"k_{c}") for c in keep], F.col(key).alias("key"), F.col(text).cast("string").alias("_text"))
    known = durable(featured(picked, "_text"))
    weights, shift = model(known, labels, size)
    strength = strength_of(weights, shift)
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), strength))))
    return known.select(
        *[F.col(f"k_{c}").alias(c) for c in keep], held_out(F.col("key")).alias("held_out"), score.alias("score")
    ).withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
