"""Filter interaction audit by decision diagrams.

Every document has a mask of the filters it fails; Spark counts the masks of each part. A part's
masks, at most 2 ** filters, become a count-weighted ordered decision diagram: level k tests the k-th
filter of an order, equal subdiagrams of a level are one node, leaves hold counts, and a node's weight is the sum
below it. All orders are reached one after the other by swaps of two neighbouring levels, which
rebuild these two levels only; the all-pass path of each order gives its steps.

Filter E compares texts table-wide without gathering copies: equal texts are counted by part, mask
and labels before and after the shuffle, with the smallest id and its rows, so that a text with a
third of all rows is a few rows.

Defined results: null text is empty; a null part is the empty string; a null id is never smaller than another, so it
never fails E and makes no other fail; rows equal in id and text are separate documents, and neither
is the smaller; a document is good (toxic) if any label row of its id says so, and null ids have no
labels; filters a part never fails give zeros; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docwright.functions.text import words

FILTERS = "ABCDE"
COUNTS = ["n", "good", "toxic"]
STEPS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def own_failures(text: Column, found: Column) -> Column:
    """The bits of A to D, which a text with the words ``found`` fails by itself."""
    n = F.size(found).cast("bigint")
    failed = [
        n < 200,
        100 * F.size(F.array_distinct(found)).cast("bigint") < 50 * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")).cast("bigint") > 3 * F.length(text),
        text.rlike("[#$%&*|]"),
    ]
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failed)]
    return sum(bits[1:], bits[0])


def mask_counts(docs: DataFrame, labels: DataFrame, part: str = "lang", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and failure mask; bit i stands for the i-th filter."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    read = docs.select(F.col(key).alias("doc"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), body.alias("text"), words(body).alias("_w"))
    thin = read.select("doc", "part", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), F.col("text")).alias("h2"), own_failures(F.col("text"), F.col("_w")).alias("mask"))
    rows = thin.groupBy(*thin.columns).agg(F.count(F.lit(1)).alias("n"))
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("l_doc")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    # Null ids have no labels; spread, they don't wait for one task.
    spread = F.when(F.col("doc").isNull(), F.pmod("h1", F.lit(997))).otherwise(0)
    met = rows.withColumn("spread", spread).join(known, (F.col("doc") == F.col("l_doc")) & (F.col("spread") == 0), "left")
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    alike = met.select("doc", "part", "h1", "h2", "mask", "n", *flags).groupBy("h1", "h2", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("doc").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
        F.min(F.when(F.col("doc").isNotNull(), F.struct("doc", "n"))).alias("low"),
    )
    first = F.min("low.doc").over(Window.partitionBy("h1", "h2"))  # a few rows a text, whatever its copies
    passing = F.col("n_null") + F.when(F.col("low.doc") == F.col("first"), F.col("low.n")).otherwise(0)
    split = alike.withColumn("first", first).withColumn("passing", passing).select(
        "part", "good", "toxic",
        F.inline(F.array(
            F.struct(F.col("mask"), F.col("passing").alias("n")),
            F.struct(F.col("mask").bitwiseOR(1 << FILTERS.index("E")).alias("mask"), (F.col("n") - F.col("passing")).alias("n")),
        )),
    )
    of = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return split.filter("n > 0").groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def plain_changes(n: int) -> Iterator[int]:
    """Places k whose swaps of k and k + 1, one after the other, visit every order of ``n`` things once."""
    if n < 2:
        return
    down, up = list(range(n - 2, -1, -1)), list(range(n - 1))
    at_front = False
    for inner in [*plain_changes(n - 1), None]:
        yield from up if at_front else down
        at_front = not at_front
        if inner is not None:
            yield inner + at_front


class Diagram:
    """A count-weighted ordered decision diagram of failure masks.

    ``levels[k]`` has the (pass, fail) children of each node of level k; nodes of the level after the last are leaves.
    """

    def __init__(self, counts: dict[int, tuple[int, ...]], n: int):
        self.order = list(range(n))
        self.weight: dict[int, tuple[int, ...]] = {}
        self.levels: list[dict[int, tuple[int, int]]] = [{} for _ in range(n)]
        self.next = 0
        none = (0,) * len(COUNTS)
        leaves: dict[tuple[int, ...], int] = {}
        below = []
        for mask in range(1 << n):
            found = counts.get(mask, none)
            if found not in leaves:
                leaves[found] = self._node(found)
            below.append(leaves[found])
        # masks that agree on the filters of the levels above stand ``1 << k`` apart
        for k in range(n - 1, -1, -1):
            held: dict[tuple[int, int], int] = {}
            below = [self._shared(k, held, below[m], below[m + (1 << k)]) for m in range(1 << k)]
        self.root = below[0]

    def _node(self, weight: tuple[int, ...]) -> int:
        self.weight[self.next] = weight
        self.next += 1
        return self.next - 1

    def _shared(self, k: int, held: dict[tuple[int, int], int], ok: int, failed: int) -> int:
        """The node of level ``k`` with these children, made if there is none."""
        if (ok, failed) not in held:
            made = self._node(tuple(a + b for a, b in zip(self.weight[ok], self.weight[failed], strict=True)))
            held[ok, failed] = made
            self.levels[k][made] = ok, failed
        return held[ok, failed]

    def swap(self, k: int) -> None:
        """Exchange levels ``k`` and ``k + 1``; nodes of level k keep their place and weight, so that nothing above changes."""
        old, self.levels[k + 1] = self.levels[k + 1], {}
        held: dict[tuple[int, int], int] = {}
        for node, (ok, failed) in self.levels[k].items():
            (a, b), (c, d) = old[ok], old[failed]
            self.levels[k][node] = self._shared(k + 1, held, a, c), self._shared(k + 1, held, b, d)
        for gone in old:
            del self.weight[gone]
        self.order[k], self.order[k + 1] = self.order[k + 1], self.order[k]

    def path(self) -> Iterator[tuple[int, tuple[int, ...], tuple[int, ...]]]:
        """The all-pass path: each level's filter, what passes it and what it removes."""
        node = self.root
        for k, tested in enumerate(self.order):
            node, failed = self.levels[k][node]
            yield tested, self.weight[node], self.weight[failed]


def steps(counts: dict[int, tuple[int, ...]], names: str = FILTERS) -> list[tuple]:
    """A row for each order and step: order, step from 1, and the counts of ``STEPS`` in their order."""
    diagram = Diagram(counts, len(names))
    walked = {}
    for k in [None, *plain_changes(len(names))]:
        if k is not None:
            diagram.swap(k)
        walked["".join(names[v] for v in diagram.order)] = list(diagram.path())
    fails, unique, total = {}, {}, dict.fromkeys(range(len(names)), 0)
    for path in walked.values():
        for place, (v, _, removed) in enumerate(path):
            total[v] += removed[0]
            if place == 0:
                fails[v] = removed[0]
            if place == len(path) - 1:
                unique[v] = removed[0]
    return [
        (order, place + 1, kept[0], removed[0], fails[v] - removed[0], unique[v], removed[1], removed[2], total[v])
        for order, path in walked.items()
        for place, (v, kept, removed) in enumerate(path)
    ]


def audit(masks: DataFrame) -> DataFrame:
    """Every order's steps of each part, from ``mask_counts``; a part has at most 2 ** filters rows."""
    columns = [c.split()[0] for c in STEPS.split(", ")]

    def of_part(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        counts = {r.mask: (r.n, r.good, r.toxic) for r in rows.itertuples()}
        return pd.DataFrame([(key[0], *r) for r in steps(counts)], columns=columns)

    return masks.groupBy("part").applyInPandas(of_part, STEPS)
