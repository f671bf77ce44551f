"""Quality rules by weak supervision.

Rules vote good (2), bad (0) or abstain (1). Expectation-maximisation over the counts of vote
patterns estimates, for each rule, how it votes on good and on bad documents; the posterior of a
document's pattern replaces an all-must-pass filter. Only column functions are used: the patterns
(at most 3 ** len(RULES), whatever the corpus) meet in one row, where nested ``aggregate`` runs
the iterations until the posteriors stand still.

Defined results: null text counts as empty; a document without words fails the base rules and isn't accepted; extra
columns are ignored except those asked for, and one of these with a result's name gives way to it;
equal rows are kept as they are; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwright.functions.text import SPACES, let, sum_of, words
from docwright.llm.frames import without
from docwright.plans.durable import durable

#: Most rounds of EM, and the greatest change of a posterior at which it stops.
ROUNDS, TOLERANCE = 100, 1e-6
SMOOTHING = 1.0
#: A rule's vote for bad on good documents is taken to be at most this frequent. Without the bound, rules
#: that see a kind of junk which no other rule sees are outvoted once the iterations run to the end.
FALSE_ALARM = 0.002
ACCEPT = 0.5
#: Patterns start at this probability of being good: without and with a vote for bad.
START_GOOD, START_BAD = 0.9, 0.1

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_lines", "n_upper", "n_shouts", "n_end_lines", "n_distinct"]


def repeated_words(hashes: Column) -> Column:
    """Number of words inside a 3-word window that occurs at least twice in the document."""

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda p, k: F.least(F.lit(3), F.get(starts, k + 1) - p).cast("bigint"))
        return sum_of(gaps)

    def repeats(windows: Column) -> Column:
        def marked(ordered: Column) -> Column:
            starts = F.transform(
                ordered,
                lambda s, k: F.when(
                    F.coalesce(s.g == F.get(ordered, k - 1).g, F.lit(False))
                    | F.coalesce(s.g == F.get(ordered, k + 1).g, F.lit(False)),
                    s.i,
                ),
            )
            return let(F.sort_array(F.filter(starts, lambda i: i.isNotNull())), covered)

        pairs = F.transform(windows, lambda g, i: F.struct(g.alias("g"), i.alias("i")))
        return F.when(
            F.size(F.array_distinct(windows)) < F.size(windows), let(F.sort_array(pairs), marked)
        ).otherwise(F.lit(0).cast("bigint"))

    def windows_of(h: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(h) - 3),
            lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)),
        )

    return F.when(F.size(hashes) >= 4, let(windows_of(hashes), repeats)).otherwise(F.lit(0).cast("bigint"))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the numbers that the rules look at (``BASE`` and ``EXTRA``), from whole texts."""
    body = F.coalesce(F.col(text), F.lit(""))
    split = docs.withColumn("_words", words(F.col(text))).withColumn(
        "_lines", F.filter(F.split(body, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    )
    hashed = split.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    return hashed.select(
        *[F.col(c) for c in docs.columns],
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("_hashes")).alias("n_repeat_words"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        F.regexp_count(body, F.lit(r"\p{Lu}")).cast("bigint").alias("n_upper"),
        F.regexp_count(body, F.lit(r"[!?]{2,}")).cast("bigint").alias("n_shouts"),
        F.size(F.filter("_lines", lambda x: F.substring(F.rtrim(x), -1, 1).isin(".", "!", "?", '"')))
        .cast("bigint")
        .alias("n_end_lines"),
        F.size(F.array_distinct("_hashes")).cast("bigint").alias("n_distinct"),
    )


#: name, condition of a vote for bad, condition of a vote for good. Otherwise the rule abstains.
RULES = [
    ("length", "n_words < 50", "n_words >= 100"),
    ("word_length", "word_chars < 3 * n_words or word_chars > 10 * n_words",
     "word_chars between 4 * n_words and 7 * n_words"),
    ("symbols", "10 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    ("duplicate_lines", "10 * n_dup_lines > 3 * n_lines", "20 * n_dup_lines <= n_lines"),
    ("repetition", "100 * n_repeat_words > 20 * n_words", "100 * n_repeat_words <= 5 * n_words"),
    ("distinct_words", "10 * n_distinct < 2 * n_words", "10 * n_distinct >= 4 * n_words"),
    ("capitals", "10 * n_upper > 3 * word_chars", "10 * n_upper <= word_chars"),
    ("shouting", "20 * n_shouts > n_words", "n_shouts = 0"),
    ("line_ends", "2 * n_end_lines < n_lines", "10 * n_end_lines >= 8 * n_lines"),
]


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vote(measured: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Add ``votes``: a digit per rule, 0 bad, 1 abstains, 2 good."""
    digits = [F.when(F.expr(bad), "0").when(F.expr(good), "2").otherwise("1") for _, bad, good in rules]
    return measured.withColumn("votes", F.concat(*digits))


def label_model(votes: DataFrame, n_rules: int = len(RULES), rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """(pattern, n, p_good): the posterior of each vote pattern after EM.

    ``votes`` has the column ``votes``. The M-step smooths each rule's vote frequencies by
    ``SMOOTHING`` a cell and bounds those of votes for bad on good documents by ``FALSE_ALARM``.
    """
    digit = lambda p, j: F.substring(p, j + 1, 1).cast("int")
    patterns = votes.groupBy("votes").agg(F.count(F.lit(1)).cast("double").alias("n"))
    row = patterns.agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    F.col("votes").alias("pattern"),
                    F.col("n"),
                    F.array(*[digit(F.col("votes"), j) for j in range(n_rules)]).alias("v"),
                    F.when(F.instr("votes", "0") > 0, START_BAD).otherwise(START_GOOD).alias("p"),
                )
            )
        ).alias("cells")
    )
    zero = F.lit(0.0)

    def total(cells: Column, good: bool) -> Column:
        return F.aggregate(cells, zero, lambda s, c: s + c.n * (c.p if good else 1 - c.p))

    def tables(cells: Column, mass: Column, good: bool) -> Column:
        """Log frequency of vote k % 3 of rule k // 3 in one class, smoothed and, for good documents, bounded."""

        def cell(k: Column) -> Column:
            rule, wanted = F.floor(k / 3).cast("int"), (k % 3).cast("int")
            hits = F.aggregate(
                cells, zero,
                lambda s, c: s + F.when(F.get(c.v, rule) == wanted, c.n * (c.p if good else 1 - c.p)).otherwise(zero),
            )
            return (hits + SMOOTHING) / (mass + 3 * SMOOTHING)

        def bounded(raw: Column) -> Column:
            def one(x: Column, k: Column) -> Column:
                alarm = F.get(raw, (k - k % 3).cast("int"))
                held = F.least(alarm, F.lit(FALSE_ALARM))
                return F.log(F.when(k % 3 == 0, held).otherwise(x * (1 - held) / (1 - alarm)))

            return F.transform(raw, one)

        frequencies = F.transform(F.sequence(F.lit(0), F.lit(3 * n_rules - 1)), cell)
        return let(frequencies, bounded) if good else F.transform(frequencies, lambda x: F.log(x))

    def step(cells: Column) -> Column:
        def with_masses(m: Column) -> Column:
            def with_tables(t: Column) -> Column:
                def posterior(c: Column) -> Column:
                    side = lambda table, mass: F.aggregate(
                        F.transform(c.v, lambda v, j: F.get(table, j * 3 + v)), F.log(mass + SMOOTHING), lambda s, x: s + x
                    )
                    odds = side(t.bad, m.bad) - side(t.good, m.good)
                    p = 1 / (1 + F.exp(F.least(F.lit(700.0), odds)))
                    return F.struct(c.pattern.alias("pattern"), c.n.alias("n"), c.v.alias("v"), p.alias("p"))

                return F.transform(cells, posterior)

            both = F.struct(tables(cells, m.good, True).alias("good"), tables(cells, m.bad, False).alias("bad"))
            return let(both, with_tables)

        masses = F.struct(total(cells, True).alias("good"), total(cells, False).alias("bad"))
        return let(masses, with_masses)

    def advance(state: Column, _: Column) -> Column:
        def moved(new: Column) -> Column:
            changes = F.zip_with(state.cells, new, lambda a, b: F.abs(a.p - b.p))
            return F.struct(new.alias("cells"), F.aggregate(changes, zero, lambda most, x: F.greatest(most, x)).alias("moved"))

        return F.when(state.moved > tolerance, let(step(state.cells), moved)).otherwise(state)

    start = F.struct(F.col("cells").alias("cells"), F.lit(1.0).alias("moved"))
    fitted = row.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, advance).getField("cells").alias("cells"))
    return fitted.select(F.inline("cells")).select("pattern", "n", F.col("p").alias("p_good"))


def judge(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of every document with its numbers, votes, posterior and verdicts.

    ``accepted`` is the method's verdict on documents with words, the posterior alone; ``kept`` asks for the base rules as well. Two passes would read every text twice, so the numbers are made durable between fitting the
    label model and applying it. The broadcast side has at most 3 ** len(RULES) rows.
    """
    keep = without(keep, [*BASE, "base_failed", "kept", "accepted", "votes", "p_good"])
    columns = list(dict.fromkeys([*keep, text]))
    picked = docs.select(*[F.col(c).alias(f"d_{c}") for c in columns])
    known = vote(measure(picked, f"d_{text}"))
    known = durable(known if text in keep else known.drop(f"d_{text}"))
    model = label_model(known)
    joined = known.join(F.broadcast(model.select("pattern", "p_good")), known["votes"] == F.col("pattern"), "left")
    return joined.select(
        *[F.col(f"d_{c}").alias(c) for c in keep],
        *BASE,
        base_failed().alias("base_failed"),
        (~base_failed() & (F.col("p_good") >= ACCEPT)).alias("kept"),
        ((F.col("n_words") > 0) & (F.col("p_good") >= ACCEPT)).alias("accepted"),
        "votes",
        "p_good",
    )
