"""Approximate nearest neighbours by multiprobe p-stable hashing.

A vector's bucket in a table is the cell of ``PROJECTIONS`` Gaussian projections. A query visits its
own cell and perturbed ones, in order of the estimated chance that a near vector lies there: the
squared distances to the cell walls that a perturbation crosses, smallest first. Candidates of all
tables are ranked by exact distance.

The width of cells follows the neighbour distances of a bounded sample, and the number of probes is
the smallest of a fixed ladder that finds ``SAMPLE_RECALL`` of the sample's true neighbours. Clustered
vectors need few; vectors without any structure need many, whatever the hashing.

A row travels once a table, to the shelf of its cell (the cell of its first projections). A query
travels once to each shelf that holds cells it visits, with the list of those cells. Shelves are
dealt in blocks of bounded size on both sides, so a shelf that holds a third of all vectors or of all
queries becomes many tasks. A block gives the k best of each of its queries, never its pairs. Queries
that found fewer than k candidates are held against all rows in the same blocks.

Defined results: vectors that are null, empty or zero or hold null or non-finite components take no
part, neither as queries nor as candidates; finite vectors of any size do; vectors of different
lengths never meet; the same id with several vectors counts once, with its nearest; ties go to the
smaller id; a distance beyond the largest double is infinite; an empty table gives an empty table;
extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docwright.plans.durable import durable

K = 10
#: Tables, projections a table, first projections that make a shelf.
TABLES, PROJECTIONS, SHELF = 3, 8, 2
#: Cell width in median distances of the K-th neighbours, as the sample shows them.
WIDTH = 1.6
#: The ladder of probes a table, and the share of the sample's neighbours that the chosen number finds.
LADDER, SAMPLE_RECALL = [1, 3, 9, 27, 81, 160, 243, 320, 400, 480, 600, 729, 900, 1100, 1600, 2187, 3280, 6561], 0.92
#: Everything fitted comes from this many rows, those with the smallest hash of their id, and this many of them as queries.
SAMPLE_ROWS, SAMPLE_QUERIES = 4096, 192
#: Most vectors and most queries of a shelf in one block, on average.
BLOCK_VECTORS, BLOCK_QUERIES = 2048, 1024
SEED = 7


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def _within(vectors: np.ndarray, bound: float = 1e100) -> np.ndarray:
    """Vectors as doubles whose squares can't overflow; only hashing looks at these."""
    return np.clip(np.asarray(vectors, np.float64), -bound, bound)


class Hashing:
    """Projections for one length of vectors, with width and number of probes fitted to a bounded sample."""

    def __init__(self, sample: np.ndarray, n_rows: int, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, recall: float = SAMPLE_RECALL):
        sample = _within(sample)
        rng = np.random.default_rng([SEED, sample.shape[1]])
        self.tables, self.projections = tables, projections
        self.centre = np.median(sample, axis=0)
        axes, self.shifts = rng.standard_normal((sample.shape[1], tables * projections)), rng.random(tables * projections)
        asked = rng.permutation(len(sample))[:SAMPLE_QUERIES]
        apart = np.stack([((sample - sample[i]) ** 2).sum(axis=1) for i in asked])
        apart[np.arange(len(asked)), asked] = np.inf
        # The sample is thinner than the table: the distance of a row's K nearest is met there at a smaller rank.
        k = min(max(1, math.ceil(K * len(sample) / max(1, n_rows))), max(1, len(sample) - 1))
        near = np.argsort(apart, axis=1)[:, :k]
        reach = np.sqrt(np.take_along_axis(apart, near[:, -1:], axis=1))
        reach = reach[np.isfinite(reach) & (reach > 0)]
        self.axes = axes / (width * (float(np.median(reach)) if len(reach) else 1.0))
        moves = np.array(list(itertools.product((-1, 0, 1), repeat=projections)))
        self.moves = moves
        #: For each move, the wall costs (down, none, up by projection) that it sums.
        self.crossed = np.concatenate([moves < 0, moves > 0], axis=1).T.astype(np.float64)
        self.count = len(moves)
        if len(sample) > 1:
            self.count = self._needed(sample, asked, near, recall)

    def _needed(self, sample: np.ndarray, asked: np.ndarray, near: np.ndarray, recall: float) -> int:
        """The fewest probes of the ladder with the wanted recall on the sample."""
        cells = np.floor(self.places(sample))
        names = self.names(cells)
        first = np.full(near.shape, self.count + 1)
        for i, q in enumerate(asked):
            order, codes = self._ordered(self.places(sample[q : q + 1]), self.count)
            for t in range(self.tables):
                rank = {c: r for r, c in enumerate(codes[0, t].tolist(), 1)}
                first[i] = np.minimum(first[i], [rank.get(c, self.count + 1) for c in names[near[i], t].tolist()])
        ladder = [n for n in LADDER if n < self.count] + [self.count]
        return next((n for n in ladder if (first <= n).mean() >= recall), self.count)

    def places(self, vectors: np.ndarray) -> np.ndarray:
        """Real-valued places, by vector, table and projection."""
        at = (_within(vectors) - self.centre) @ self.axes + self.shifts
        return np.clip(at, -(2.0**50), 2.0**50).reshape(len(vectors), self.tables, self.projections)

    def names(self, cells: np.ndarray) -> np.ndarray:
        """A bigint for each cell (last axis), distinct for cells within 2 ** 7 of the centre, else folded."""
        packed = np.zeros(cells.shape[:-1], np.int64)
        for j in range(cells.shape[-1]):
            packed = (packed << 8) | (cells[..., j].astype(np.int64) & 0xFF)
        return packed

    def _ordered(self, at: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Cells and their names in order of estimated success, by vector and table."""
        cell = np.floor(at)
        low = at - cell
        cost = np.concatenate((low**2, (1 - low) ** 2), axis=-1) @ self.crossed
        if count < cost.shape[-1]:
            best = np.argpartition(cost, count - 1, axis=-1)[..., :count]
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(cost, best, -1), axis=-1, kind="stable"), -1)
        else:
            best = np.argsort(cost, axis=-1, kind="stable")
        visited = cell[:, :, None, :] + self.moves[best]
        return visited, self.names(visited)

    def buckets(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shelf and cell of each vector in each table."""
        cells = np.floor(self.places(vectors))
        return self.names(cells[..., :SHELF]), self.names(cells)

    def probes(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shelves and cells that each vector visits in each table, in order of estimated success."""
        visited, names = self._ordered(self.places(vectors), self.count)
        return self.names(visited[..., :SHELF]), names


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


#: Vectors turned into probes at once.
STRIP = 256


def _hashed(rows: DataFrame, fitted: dict[int, Hashing], asking: bool) -> DataFrame:
    """(id, dim, shelf, cells, vector): a row for each table of each vector, or for each shelf that it visits."""
    schema = T.StructType.fromDDL("id long, dim int, shelf long, cells array<long>").add("vector", rows.schema["vector"].dataType)

    def laid(own: Hashing | None, x: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
        """(row, shelf, cells) of the vectors."""
        if own is None:  # no vector of this length in the sample: one shelf
            yield from ((i, 0, [0]) for i in range(len(x)))
            return
        for at in range(0, len(x), STRIP):
            part = x[at : at + STRIP]
            if not asking:
                shelves, cells = own.buckets(part)
                for i in range(len(part)):
                    for t in range(own.tables):
                        yield at + i, int(shelves[i, t]) * own.tables + t, [int(cells[i, t])]
                continue
            shelves, cells = own.probes(part)
            for i in range(len(part)):
                for t in range(own.tables):
                    order = np.argsort(shelves[i, t], kind="stable")
                    named, begin = np.unique(shelves[i, t][order], return_index=True)
                    for shelf, mine in zip(named.tolist(), np.split(cells[i, t][order], begin[1:]), strict=True):
                        yield at + i, shelf * own.tables + t, mine.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            sizes = np.asarray(vectors.value_lengths())
            for dim in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == dim)
                held, own_ids = vectors.take(pa.array(mine)), ids.take(pa.array(mine))
                made = list(laid(fitted.get(dim), _matrix(held)))
                again = pa.array([i for i, *_ in made], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [own_ids.take(again), pa.array(np.full(len(made), dim, np.int32)), pa.array([s for _, s, _ in made], pa.int64()),
                     pa.array([c for *_, c in made], pa.list_(pa.int64())), held.take(again)],
                    schema.names,
                )

    return rows.mapInArrow(run, schema)


def fit(rows: DataFrame) -> dict[int, Hashing]:
    """Hashings by length of vector, from a bounded sample that reaches the driver."""
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).toArrow()
    n_rows = rows.count()
    by_dim: dict[int, list] = {}
    for v in sample.column("vector").to_pylist():
        by_dim.setdefault(len(v), []).append(v)
    return {dim: Hashing(np.array(vs, np.float64), n_rows * len(vs) // len(sample)) for dim, vs in by_dim.items()}


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query, each candidate once, with their rank."""
    once = pairs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    near = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= k)


def distances(vectors: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, scaled where squares would overflow or vanish."""
    apart = vectors / 2 - q / 2
    largest = np.abs(apart).max(axis=1)
    plain = np.sqrt(((vectors - q) ** 2).sum(axis=1))
    odd = (largest > 1e150) | ((largest < 1e-150) & (largest > 0))
    if odd.any():
        scale = largest[odd]
        plain[odd] = np.sqrt(((apart[odd] / scale[:, None]) ** 2).sum(axis=1)) * scale * 2
    return plain


def nearest_in(
    queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, among: list[np.ndarray] | None = None
) -> tuple[list, list, list]:
    """For each query: the k nearest of ``vectors`` but its own id, by exact distance, ties to smaller ids.

    ``among`` gives each query's candidates, as places in ``vectors``. Expanded squares choose who is
    worth an exact difference, with room for their rounding; where they aren't finite, all are.
    """
    at, found, scores = [], [], []
    with np.errstate(over="ignore", invalid="ignore"):
        lengths = (vectors**2).sum(axis=1)
        for i, q in enumerate(queries):
            some = np.flatnonzero(ids != own[i]) if among is None else among[i][ids[among[i]] != own[i]]
            if not len(some):
                continue
            rough = lengths[some] - 2 * (vectors[some] @ q) + q @ q
            near = some
            if len(some) > k and np.isfinite(rough).all():
                bound = np.partition(rough, k - 1)[k - 1]
                near = some[rough <= bound + 1e-9 * (1 + abs(bound) + q @ q + lengths[some])]
            exact = distances(vectors[near], q)
            order = np.lexsort((ids[near], exact))[:k]
            at += [own[i]] * len(order)
            found += ids[near][order].tolist()
            scores += exact[order].tolist()
    return at, found, scores


def _visited(cells: np.ndarray, visits: list[np.ndarray]) -> list[np.ndarray]:
    """For each list of cells, the places in ``cells`` that hold one of them."""
    order = np.argsort(cells, kind="stable")
    named, begin = np.unique(cells[order], return_index=True)
    end = np.append(begin[1:], len(cells))
    out = []
    for mine in visits:
        at = np.searchsorted(named, mine)
        at = at[(at < len(named))]
        at = at[np.isin(named[at], mine)]
        out.append(np.concatenate([order[begin[j] : end[j]] for j in np.unique(at)]) if len(at) else np.zeros(0, np.int64))
    return out


def _in_blocks(index: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each query in each block of the shelves it visits."""
    key = ["dim", "shelf"]
    many = index.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK_VECTORS).alias("n_parts"))
    asked = probes.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).alias("n_turns"))
    grid = durable(many.join(asked, key))
    part, turn = F.pmod(F.xxhash64("id"), "n_parts"), F.pmod(F.xxhash64("id"), "n_turns")
    vectors = index.join(grid, key).select(
        *key, part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("n_turns") - 1)).alias("turn"), "id", F.get("cells", F.lit(0)).alias("cell"), "vector"
    )
    askers = probes.join(grid, key).select(
        *key, F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("part"), turn.alias("turn"), "id", "cells", "vector"
    )
    block = [*key, "part", "turn"]

    def rank(there: pd.DataFrame, here: pd.DataFrame) -> pd.DataFrame:
        if there.empty or here.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        stacked = lambda column: np.stack(column.to_numpy()).astype(np.float64)
        ids, own = there["id"].to_numpy(), here["id"].to_numpy()
        among = _visited(there["cell"].to_numpy(), [np.asarray(c) for c in here["cells"]])
        at, found, scores = nearest_in(stacked(here["vector"]), own, stacked(there["vector"]), ids, k, among)
        return pd.DataFrame({"query_id": at, "vec_id": found, "score": scores})

    return (
        vectors.groupBy(*block).cogroup(askers.groupBy(*block)).applyInPandas(rank, "query_id long, vec_id long, score double")
    )


def _ready(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id and vector of the rows that take part; float components stay floats until they are compared."""
    element = df.schema[vector].dataType
    kind = "array<float>" if isinstance(element, T.ArrayType) and isinstance(element.elementType, T.FloatType) else "array<double>"
    return df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(kind).alias("vector")).filter(F.col("id").isNotNull() & usable(F.col("vector")))


def search(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the k nearest rows found for each query."""
    rows, asked = _ready(vectors, key, vector), _ready(queries, key, vector)
    fitted = fit(rows)
    index, visits = _hashed(rows, fitted, False), _hashed(asked, fitted, True)
    found = durable(_best(_in_blocks(index, visits, k), k))
    short = found.groupBy("query_id").count().filter(F.col("count") >= k)
    rest = durable(asked.join(short, F.col("id") == F.col("query_id"), "left_anti"))
    if rest.limit(1).count():
        one = lambda df, name: df.select("id", F.size("vector").alias("dim"), F.lit(0).cast("long").alias("shelf"), F.array(F.lit(0).cast("long")).alias("cells"), "vector")
        whole = _best(_in_blocks(one(rows, "cell"), one(rest, "cells"), k), k)
        found = found.join(rest.select("id").distinct(), F.col("query_id") == F.col("id"), "left_anti").unionByName(whole)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
