"""Approximate nearest neighbours by a forest of random-projection trees."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseek.functions.arrays import CELLS_AT_ONCE, to_matrix
from lodeseek.operators.grid import against_blocks
from lodeseek.session import load_table

TREES = 8
# Leaves are to hold about so many rows; there are 2 ** MOST_LEVELS of them at most, as every
# one should see some of the sample that sets the splits.
LEAF_ROWS, MOST_LEVELS = 512, 10
# Vectors that set the splits, and queries whose true neighbours set the search budget.
SAMPLE, TRIALS = 16_384, 128
# Share of the trials' true neighbours that the budget has to reach.
TARGET = 0.97
# Bytes of vectors (as double) that a task holds, and scores that it works on at a time.
SPLIT_BYTES, SCORES_AT_ONCE = 32 << 20, 2 << 20
# Queries whose margins to all splits are held at a time.
QUERIES_AT_ONCE = 256
# Scores that differ by less come from the order of a sum; they are computed anew.
NOISE = 1e-9

_RANGE = 1 << 40
_RESULT = "query_id long, vec_id long, score double"


@dataclass
class Forest:
    """Directions (tree, split, component) and thresholds of balanced trees, as heaps.

    Split s has children 2 s + 1 (at most the threshold) and 2 s + 2. ``filled`` is the share of all
    rows in each leaf; ``reach`` the largest norm of all vectors. A vector v counts as (v,
    sqrt(reach² - |v|²)) and a query as (q, 0) scaled to ``reach``: then a larger inner product is a
    smaller angle, whatever the norms.
    """

    directions: np.ndarray
    thresholds: np.ndarray
    filled: np.ndarray
    reach: float

    @property
    def levels(self) -> int:
        return int(self.thresholds.shape[1] + 1).bit_length() - 1

    @classmethod
    def fit(cls, sample: np.ndarray, rows: int, reach: float, trees: int = TREES, seed: int = 17) -> Forest:
        """Random directions; every threshold is the median of the sample at its split."""
        levels = int(np.clip(round(np.log2(max(rows, 2) / LEAF_ROWS)), 1, MOST_LEVELS))
        splits = 2**levels - 1
        rng = np.random.default_rng(seed)
        directions = rng.standard_normal((trees, splits, sample.shape[1] + 1))
        directions /= np.linalg.norm(directions, axis=2, keepdims=True)
        forest = cls(directions, np.zeros((trees, splits)), np.zeros((trees, splits + 1)), reach)
        points = forest._lifted(sample)
        for tree in range(trees):
            at = np.zeros(len(points), dtype=np.int64)
            for split in range(splits):
                here = np.flatnonzero(at == split)
                if len(here):
                    sides = points[here] @ directions[tree, split]
                    forest.thresholds[tree, split] = np.median(sides)
                    at[here] = 2 * split + 1 + (sides > forest.thresholds[tree, split])
            forest.filled[tree] = np.bincount(at - splits, minlength=splits + 1) / max(len(points), 1)
        return forest

    def _lifted(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.reach**2 - np.einsum("ij,ij->i", vectors, vectors), 0.0))
        return np.column_stack([vectors, rest])

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """(row, tree): the leaf each vector lies in, numbered over the whole forest."""
        points = self._lifted(vectors)
        trees, splits = self.thresholds.shape
        found = np.zeros((len(points), trees), dtype=np.int32)
        step = max(1, CELLS_AT_ONCE // points.shape[1])
        for start in range(0, len(points), step):
            part = points[start : start + step]
            for tree in range(trees):
                at = np.zeros(len(part), dtype=np.int64)
                for _ in range(self.levels):
                    side = np.einsum("ij,ij->i", part, self.directions[tree, at])
                    at = 2 * at + 1 + (side > self.thresholds[tree, at])
                found[start : start + step, tree] = at - splits + tree * (splits + 1)
        return found

    def visited(self, queries: np.ndarray, budget: float) -> Iterator[tuple[list[int], list[float]]]:
        """Per query, the leaves in the order of their visit, and the share of rows seen after each.

        All trees share one queue. A branch waits in it with the sum of the squared distances
        to the splits that were crossed on the way; the search takes the nearest branch
        of all, goes down to its leaf, and ends when the leaves hold ``budget`` times all rows
        (a row counts once per tree).
        """
        trees, splits = self.thresholds.shape
        norms = np.linalg.norm(queries, axis=1, keepdims=True)
        scaled = np.column_stack([queries * (self.reach / norms), np.zeros(len(queries))])
        flat = self.directions.reshape(trees * splits, -1).T
        for start in range(0, len(scaled), QUERIES_AT_ONCE):
            margins = scaled[start : start + QUERIES_AT_ONCE] @ flat - self.thresholds.ravel()
            for row in margins.reshape(-1, trees, splits):
                yield self._visit(row.tolist(), splits, budget)

    def _visit(self, margins: list[list[float]], splits: int, budget: float) -> tuple[list[int], list[float]]:
        queue = [(0.0, tree, 0) for tree in range(len(margins))]
        order, seen, total = [], [], 0.0
        while queue and total < budget:
            far, tree, at = heapq.heappop(queue)
            while at < splits:
                margin = margins[tree][at]
                near = 2 * at + 1 + (margin > 0)
                heapq.heappush(queue, (far + margin * margin, tree, 4 * at + 3 - near))
                at = near
            order.append(at - splits + tree * (splits + 1))
            total += float(self.filled[tree, at - splits])
            seen.append(total)
        return order, seen


def nearest(
    df: DataFrame,
    k: int,
    query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    trees: int = TREES,
    target: float = TARGET,
    seed: int = 17,
) -> DataFrame:
    """(``query_id``, ``rank``, ``vec_id``, ``score``): the ``k`` nearest found of every query.

    Queries are the rows of ``df`` for which ``query`` holds; candidates are all rows with another id.
    Nearness is the inner product of the given vectors in double precision, ties go to the
    smaller id. Vectors that are NULL, empty or zero, or hold NULL, NaN or infinity, and rows
    without id take no part. Rows that repeat id and vector count once; an id with several
    vectors stands for the nearest of them. A vector of another length is an error. Other
    columns are not read. No row, or no query, gives an empty result.

    The forest is fitted on SAMPLE vectors (16,384); every row is indexed by it. Its search
    budget is measured: TRIALS queries are compared with all rows, and the budget is what
    reaches ``target`` of their true neighbours. Vectors without structure need much of the
    table, clustered ones little.

    Documents are dealt over tasks once and put into their leaves there. Queries
    come by, a batch at a time, with the leaves that their search visits; what meets in a leaf
    is compared exactly, so the result is reranked by the true product. A task returns its
    ``k`` best per query; nothing grows on the driver but sample and trials, which are
    bounded.
    """
    if not 0 < target <= 1 or k < 1:
        raise ValueError("target is a share, k at least 1")
    found = T.StructType.fromDDL("query_id long, rank int, vec_id long, score double")
    spark = df.sparkSession
    valid = _valid(df, id_col, vector_col).withColumn("asks", F.coalesce(query, F.lit(False)))
    valid = valid.select("vec_id", "embedding", "asks")
    once = _without_repeats(valid)
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    facts = once.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("asks").alias("queries"),
        F.max(F.size("embedding")).alias("dims"),
        F.max(norm).alias("square"),
    ).first()
    if not facts.queries:
        return spark.createDataFrame([], found)
    sample = _sampled(once, facts.rows, SAMPLE, seed)
    forest = Forest.fit(_matrix(sample, facts.dims), facts.rows, float(np.sqrt(facts.square)), trees, seed)
    trials = _sampled(once.filter("asks"), facts.queries, TRIALS, seed)
    budget = _budget(once, trials, forest, k, target, facts.dims)

    splits = max(1, -(-facts.rows * facts.dims * 8 // SPLIT_BYTES))
    slots = spark.sparkContext.defaultParallelism
    # Small tables are split among the slots, as long as a split keeps a leaf's rows.
    splits = int(max(splits, min(slots, -(-facts.rows // (8 * LEAF_ROWS)))))
    asked = once.filter("asks").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    asked = asked.mapInArrow(
        _routing(forest, budget, facts.dims), "query_id long, vector array<float>, leaves array<int>"
    )
    local = against_blocks(
        once.select("vec_id", "embedding"),
        asked,
        splits,
        F.xxhash64("vec_id", "embedding"),
        _searching(forest, k, facts.dims),
        T.StructType.fromDDL(_RESULT),
    )
    return _best(local, k).select([f.name for f in found])


def _valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows that take part, with ``vec_id`` and ``embedding`` beside all columns of ``df``."""
    vector = F.col(vector_col)
    unfit = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = F.size(vector).__gt__(0) & ~F.coalesce(unfit, F.lit(True)) & F.exists(vector, lambda x: x != 0)
    return df.filter(F.col(id_col).isNotNull() & F.coalesce(fit, F.lit(False))).withColumns(
        {"vec_id": F.col(id_col).cast("long"), "embedding": vector}
    )


def _without_repeats(rows: DataFrame) -> DataFrame:
    """Rows with distinct (id, vector). Vectors are shuffled for it only if some are repeated."""
    counted = rows.groupBy("vec_id", F.xxhash64("embedding").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return rows.dropDuplicates(["vec_id", "embedding"]) if counted.filter("n > 1").take(1) else rows


def _sampled(rows: DataFrame, count: int, most: int, seed: int) -> pa.Table:
    """At most ``most`` rows, those with the smallest hashes; a filter lets few others through."""
    rank = F.pmod(F.xxhash64(F.lit(seed), "vec_id", "embedding"), F.lit(_RANGE))
    bound = min(_RANGE, int(_RANGE * 1.5 * most / count) + 1)
    return rows.select("vec_id", "embedding").filter(rank < bound).orderBy(rank, "vec_id").limit(most).toArrow()


def _matrix(table: pa.Table, dims: int) -> np.ndarray:
    return to_matrix(table.column("embedding"), dims)[0]


def _budget(rows: DataFrame, trials: pa.Table, forest: Forest, k: int, target: float, dims: int) -> float:
    """The budget that reaches ``target`` of the trials' true neighbours."""
    ids, queries = trials.column("vec_id").to_numpy(), _matrix(trials, dims)
    everything = forest.directions.shape[0] + 1.0

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            step = max(1, SCORES_AT_ONCE // max(len(ids), 1))
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                vectors = to_matrix(part.column("embedding"), dims)[0]
                which, row, score = _leading(queries @ vectors.T, ids, queries, part.column("vec_id").to_numpy(), vectors, k)
                found = pa.table([pa.array(ids[which]), part.column("vec_id").take(pa.array(row)), pa.array(score),
                                  part.column("embedding").take(pa.array(row))],
                                 names=["query_id", "vec_id", "score", "embedding"])
                kept = _kept(found if kept is None else pa.concat_tables([kept, found]), k)
        if kept is not None:
            yield from kept.to_batches()

    near = rows.select("vec_id", "embedding").mapInArrow(compare, _RESULT + ", embedding array<float>")
    near = _best(near, k, "embedding").toArrow()
    if not near.num_rows:
        return everything
    places = forest.leaves(_matrix(near, dims))
    owners = near.column("query_id").to_numpy()
    needed = []
    for one, (order, seen) in zip(ids, forest.visited(queries, everything)):
        reached = dict(zip(order, seen))
        needed += [min(reached.get(int(leaf), everything) for leaf in leaves) for leaves in places[owners == one]]
    return float(np.quantile(needed, target, method="higher")) if needed else everything


def _routing(forest: Forest, budget: float, dims: int) -> Callable:
    """Queries with the leaves that their search visits."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, QUERIES_AT_ONCE):
                part = batch.slice(start, QUERIES_AT_ONCE)
                vectors = to_matrix(part.column("vector"), dims)[0]
                visits = [order for order, _ in forest.visited(vectors, budget)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("query_id"), part.column("vector"), pa.array(visits, pa.list_(pa.int32()))],
                    names=["query_id", "vector", "leaves"],
                )

    return work


def _searching(forest: Forest, k: int, dims: int) -> Callable:
    """What a task does: its rows by leaf, then batch after batch of queries against them."""

    def work(documents: pa.Table) -> Callable[[pa.Table], Iterator[pa.RecordBatch]]:
        vectors = to_matrix(documents.column("embedding"), dims)[0]
        ids = documents.column("vec_id").to_numpy()
        placed = forest.leaves(vectors).ravel()
        order = np.argsort(placed, kind="stable")
        bounds = np.searchsorted(placed[order], np.arange(forest.filled.size + 1))
        rows_of = order // forest.directions.shape[0]

        def answer(queries: pa.Table) -> Iterator[pa.RecordBatch]:
            step = max(1, SCORES_AT_ONCE // len(ids))
            for start in range(0, queries.num_rows, step):
                part = queries.slice(start, step).combine_chunks()
                asking = to_matrix(part.column("vector"), dims)[0]
                visits = part.column("leaves").combine_chunks()
                who = np.repeat(np.arange(len(asking)), visits.value_lengths().to_numpy())
                leaf = visits.flatten().to_numpy()
                by_leaf = np.argsort(leaf, kind="stable")
                who, leaf = who[by_leaf], leaf[by_leaf]
                edges = np.flatnonzero(np.diff(leaf, prepend=-1))
                scores = np.full((len(asking), len(ids)), -np.inf)
                for a, b in zip(edges, [*edges[1:], len(leaf)]):
                    rows = rows_of[bounds[leaf[a]] : bounds[leaf[a] + 1]]
                    if len(rows):
                        scores[np.ix_(who[a:b], rows)] = asking[who[a:b]] @ vectors[rows].T
                query_ids = part.column("query_id").to_numpy()
                which, row, exact = _leading(scores, query_ids, asking, ids, vectors, k)
                found = pa.table([pa.array(query_ids[which]), pa.array(ids[row]), pa.array(exact)],
                                 names=["query_id", "vec_id", "score"])
                yield from _kept(found, k).to_batches()

        return answer

    return work


def _leading(
    scores: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query, row) that may be among the ``k`` best, with products summed in one fixed order."""
    scores[query_ids[:, None] == ids[None, :]] = -np.inf
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    else:
        least = np.full(len(scores), -np.inf)
    slack = NOISE * np.linalg.norm(queries, axis=1) * (np.linalg.norm(vectors, axis=1).max() if len(vectors) else 1.0)
    least = np.where(np.isfinite(least), least - slack, least)
    which, row = np.nonzero(np.isfinite(scores) & (scores >= least[:, None]))
    exact = np.empty(len(which))
    step = max(1, CELLS_AT_ONCE // max(queries.shape[1], 1))
    for start in range(0, len(which), step):
        part = slice(start, start + step)
        exact[part] = (queries[which[part]] * vectors[row[part]]).sum(axis=1)
    return which, row, exact + 0.0


def _kept(found: pa.Table, k: int) -> pa.Table:
    """The ``k`` best rows per query, of rows with one id the best."""
    ordered = found.sort_by([("query_id", "ascending"), ("score", "descending"), ("vec_id", "ascending")])
    query, vec = ordered.column("query_id").to_numpy(), ordered.column("vec_id").to_numpy()
    pairs = np.rec.fromarrays([query, vec])
    first = np.zeros(len(query), dtype=bool)
    first[np.unique(pairs, return_index=True)[1]] = True
    ordered, query = ordered.filter(pa.array(first)), query[first]
    place = np.arange(len(query)) - np.searchsorted(query, query, side="left")
    return ordered.filter(pa.array(place < k))


def _best(found: DataFrame, k: int, *carry: str) -> DataFrame:
    """The ``k`` best of all tasks per query, with their ``rank``."""
    best = found.groupBy("query_id", "vec_id").agg(F.max(F.struct("score", *carry)).alias("best"))
    best = best.select("query_id", "vec_id", "best.*")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k)


def op13_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id is divisible by 20."""
    return nearest(load_table(spark, sf_dir, "embeddings"), 20, F.col("vec_id") % 20 == 0)
