"""Approximate nearest vectors: search only the cells closest to the query.

Every vector belongs to the cell of its nearest centroid. A query is compared with the
vectors of the cells nearest to it, exactly. How much that finds of the true result
depends on the data: `recall` measures it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseek.functions.arrays import to_matrix, unit_rows
from lodeseek.functions.vectors import SCORE_DECIMALS, l2_normalize
from lodeseek.operators.grid import beside
from lodeseek.operators.pooling import mean_vectors
from lodeseek.operators.topk import cosine_top_k, multi_query_top_k
from lodeseek.schemas import NATURAL_KEY
from lodeseek.session import materialize

# Centroids that go to every task take at most this many bytes; more of them form two levels.
CENTROID_BYTES = 64 << 20
# Groups of cells that a two-level search looks into, for every cell it is to find.
GROUPS_PER_PROBE = 2

CENTROIDS = "cell int, centroid array<double>"


class Cells:
    """Centroids of the cells, numbered by position, small enough for every task."""

    def __init__(self, centroids: Sequence[Sequence[float]] | np.ndarray):
        matrix = np.asarray(centroids, dtype=np.float64)
        if matrix.nbytes > CENTROID_BYTES:
            raise ValueError(f"{matrix.nbytes} bytes of centroids: `CellTree` holds more than {CENTROID_BYTES}")
        self.centroids = unit_rows(matrix)

    @classmethod
    def train(
        cls,
        vectors: DataFrame,
        cells: int,
        vector: str = "embedding",
        seed: int = 17,
        iterations: int = 10,
        first: Cells | None = None,
        tolerance: float = 1e-4,
    ) -> Cells:
        """Centroids by Lloyd's steps over all vectors, by cosine distance.

        A step assigns every vector and adds up the unit vectors of each cell in the tasks;
        one row per cell reaches the driver, no more bytes than the centroids. The
        vectors are stored once, as unit vectors, before the first step. It begins
        with ``first`` (earlier centroids, say) or ``cells`` vectors chosen by hash, and ends
        when no centroid moves by more than ``tolerance``. A cell that loses all its vectors
        keeps its centroid; repeated vectors make fewer cells than wanted.
        """
        unit = vectors.filter(F.exists(vector, lambda x: x != 0)).select(
            l2_normalize(F.col(vector)).alias("embedding")
        )
        unit = materialize(unit, "unit-vectors")
        current = first or cls(_chosen(unit, cells, seed))
        for _ in range(iterations if len(current.centroids) else 0):
            moved = current.step(unit)
            change = np.abs(moved.centroids - current.centroids).max()
            current = moved
            if change <= tolerance:
                break
        return current

    def step(self, unit: DataFrame) -> Cells:
        """The centroids after one step over unit vectors."""
        placed = unit.withColumn("cell", self.assign(F.col("embedding")))
        means = mean_vectors(placed, ["cell"]).toArrow()
        moved = self.centroids.copy()
        if means.num_rows:
            matrix, _ = to_matrix(means.column("embedding"))
            # Opposite vectors can leave a mean of zero, which is nobody's direction.
            filled = (matrix != 0).any(axis=1)
            moved[means.column("cell").to_numpy()[filled]] = matrix[filled]
        return Cells(moved)

    def assign(self, vector: Column) -> Column:
        """Number of the nearest cell; the lowest of equally near ones."""
        centroids = self.centroids

        @F.arrow_udf(T.IntegerType())
        def nearest(vectors: pa.Array) -> pa.Array:
            matrix, present = to_matrix(vectors, centroids.shape[1])
            scores = np.round(unit_rows(matrix) @ centroids.T, SCORE_DECIMALS)
            return pa.array(scores.argmax(axis=1).astype(np.int32), mask=~present)

        return nearest(vector)

    def probes(self, vector: Column, count: int) -> Column:
        """The ``count`` cells nearest to a vector, nearest first."""
        centroids = self.centroids

        @F.arrow_udf(T.ArrayType(T.IntegerType()))
        def nearest(vectors: pa.Array) -> pa.Array:
            matrix, _ = to_matrix(vectors, centroids.shape[1])
            scores = np.round(unit_rows(matrix) @ centroids.T, SCORE_DECIMALS)
            best = np.argsort(-scores, axis=1, kind="stable")[:, :count]
            return pa.array(best.astype(np.int32).tolist(), pa.list_(pa.int32()))

        return nearest(vector)

    def placed(self, vectors: DataFrame, vector: str = "embedding") -> DataFrame:
        """``vectors`` with their ``cell``; NULL for a NULL vector."""
        return vectors.withColumn("cell", self.assign(F.col(vector)))

    def probing(self, queries: DataFrame, count: int, vector: str = "embedding") -> DataFrame:
        """``queries`` with ``probes``, the ``count`` cells nearest to each."""
        return queries.withColumn("probes", self.probes(F.col(vector), count))

    def probed(self, query: Sequence[float], count: int) -> list[int]:
        scores = np.round(unit_rows(np.asarray([query], dtype=np.float64)) @ self.centroids.T,
                          SCORE_DECIMALS)[0]
        return np.argsort(-scores, kind="stable")[:count].tolist()

    def table(self, spark: SparkSession) -> DataFrame:
        """The centroids as rows."""
        rows = [(n, [float(x) for x in c]) for n, c in enumerate(self.centroids)]
        return spark.createDataFrame(rows, CENTROIDS).coalesce(1)

    def write(self, vectors: DataFrame, path: str, vector: str = "embedding") -> None:
        """Store vectors in one directory per cell, so that a search reads few of them."""
        (
            self.placed(vectors, vector)
            .hint("rebalance", F.col("cell"))
            .write.mode("overwrite")
            .partitionBy("cell")
            .parquet(path)
        )

    def store(self, vectors: DataFrame, path: str, vector: str = "embedding") -> None:
        """`write` below ``path``, with the centroids, so that `load` can search it later."""
        self.save(path, vectors.sparkSession)
        self.write(vectors, f"{path}/vectors", vector)

    def save(self, path: str, spark: SparkSession) -> None:
        """The centroids, below ``path``."""
        self.table(spark).write.mode("overwrite").parquet(f"{path}/centroids")

    @classmethod
    def load_centroids(cls, spark: SparkSession, path: str) -> Cells:
        return cls(_matrix_of(spark.read.parquet(f"{path}/centroids")))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> tuple[Cells, DataFrame]:
        """The cells kept at ``path`` and the vectors in them."""
        return cls.load_centroids(spark, path), spark.read.parquet(f"{path}/vectors")

    def add(self, vectors: DataFrame, path: str, vector: str = "embedding") -> None:
        """Append vectors to the cells kept at ``path``; the centroids stay."""
        (
            self.placed(vectors, vector)
            .hint("rebalance", F.col("cell"))
            .write.mode("append")
            .partitionBy("cell")
            .parquet(f"{path}/vectors")
        )

    def split(
        self, stored: DataFrame, most: int, vector: str = "embedding", seed: int = 17
    ) -> tuple[Cells, list[int]]:
        """Cells of which none should have more than ``most`` of the ``stored`` rows, and the numbers of the split ones.

        ``stored`` has a ``cell``. Only the vectors of over-full cells are read. Each of these is
        trained on its own; its first part keeps the number, the others are added at the
        end, so that the rows of all other cells keep theirs. What cannot be told apart,
        copies of one vector, stays together.
        """
        counts = stored.filter("cell IS NOT NULL").groupBy("cell").count().filter(F.col("count") > most)
        over = sorted((r["cell"], r["count"]) for r in counts.collect())
        centroids, done = self.centroids, []
        for cell, count in over:
            inside = stored.filter(F.col("cell") == cell)
            parts = Cells.train(inside, -(-2 * count // most), vector, seed).centroids
            parts = np.unique(parts, axis=0)
            if len(parts) < 2:
                continue
            centroids = centroids.copy()
            centroids[cell] = parts[0]
            centroids = np.concatenate([centroids, parts[1:]])
            done.append(cell)
        return Cells(centroids), done

    def top_k(
        self,
        stored: DataFrame,
        query: Sequence[float],
        k: int,
        probes: int,
        key: Sequence[str] = NATURAL_KEY,
        vector: str = "embedding",
        **filters: str | None,
    ) -> DataFrame:
        """`cosine_top_k` within the nearest cells of vectors that have a ``cell``."""
        near = stored.filter(F.col("cell").isin(self.probed(query, probes)))
        return cosine_top_k(near, query, k, key, vector, **filters)

    def multi_query_top_k(
        self,
        stored: DataFrame,
        queries: DataFrame,
        k: int,
        probes: int,
        key: Sequence[str],
        query_id: str = "query_id",
        vector: str = "embedding",
        filter_columns: Sequence[str] = (),
    ) -> DataFrame:
        """`multi_query_top_k` within each query's nearest cells, with its filters."""
        probing = self.probing(queries, probes, vector)
        return multi_query_top_k(
            stored, probing, k, key, query_id, vector, filter_columns, cell="cell"
        )


class CellTree:
    """Cells in groups: more centroids than every task could hold.

    ``groups`` are `Cells` that every task holds. ``cells`` is a stored table (``group``, ``cell``,
    ``centroid``), of which a task holds the rows of one group at a time. A vector belongs
    to the nearest cell of its nearest group.
    """

    def __init__(self, groups: Cells, cells: DataFrame):
        self.groups, self.cells = groups, cells

    @classmethod
    def train(
        cls, vectors: DataFrame, cells: int, vector: str = "embedding", seed: int = 17,
        iterations: int = 10, groups: int | None = None,
    ) -> CellTree:
        """About ``cells`` cells in ``groups`` groups (the root of their number by default).

        The groups are trained over all vectors. Within each, cells start from vectors of the group
        chosen by hash and move by steps over all its vectors; groups with more vectors get
        more cells. All groups move in the same jobs.
        """
        outer = Cells.train(vectors, groups or max(1, round(cells**0.5)), vector, seed, iterations)
        unit = vectors.filter(F.exists(vector, lambda x: x != 0)).select(
            l2_normalize(F.col(vector)).alias("embedding")
        )
        unit = materialize(unit.withColumn("group", outer.assign(F.col("embedding"))), "grouped-vectors")
        sizes = unit.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
        share = F.greatest(F.lit(1), F.round(F.col("n") * cells / max(unit.count(), 1))).cast("int")
        rank = F.row_number().over(Window.partitionBy("group").orderBy("h", "embedding"))
        # A filter on the hash leaves about twice as many as are wanted of each group.
        hashed = unit.select("group", "embedding", F.pmod(F.xxhash64(F.lit(seed), "embedding"), F.lit(1 << 40)).alias("h"))
        wanted = F.broadcast(sizes.select("group", "n", share.alias("share")))  # one row per group
        begun = (
            hashed.join(wanted, "group")
            .filter(F.col("h") < (F.lit(2.0) * F.col("share") + 8) / F.col("n") * (1 << 40))
            .distinct()
            .withColumn("rank", rank)
            .filter(F.col("rank") <= F.col("share"))
        )
        inner = _numbered_cells(begun.select("group", F.col("embedding").alias("centroid")))
        for _ in range(iterations):
            tree = cls(outer, inner)
            placed = tree._placed_in(unit, "embedding")
            means = mean_vectors(placed, ["group", "cell"], name="mean")
            kept = inner.join(means.select("cell", "mean"), "cell", "left")
            inner = materialize(
                kept.select("group", "cell", F.coalesce("mean", "centroid").alias("centroid")), "cells"
            )
        return cls(outer, inner)

    def _placed_in(self, vectors: DataFrame, vector: str) -> DataFrame:
        """``vectors``, which have a ``group``, with their ``cell``."""
        schema = T.StructType([*vectors.schema.fields, T.StructField("cell", T.IntegerType())])

        def work(held: pa.Table) -> Callable[[pa.Table], Iterator[pa.RecordBatch]]:
            numbers = held.column("cell").to_numpy()
            order = np.argsort(numbers, kind="stable")
            numbers = numbers[order].astype(np.int32)
            centroids = unit_rows(to_matrix(held.column("centroid"))[0])[order]

            def answer(rows: pa.Table) -> Iterator[pa.RecordBatch]:
                matrix, _ = to_matrix(rows.column(vector), centroids.shape[1])
                scores = np.round(unit_rows(matrix) @ centroids.T, SCORE_DECIMALS)
                found = pa.array(numbers[scores.argmax(axis=1)])
                yield from rows.append_column("cell", found).to_batches()

            return answer

        return beside(self.cells, vectors, "group", work, schema, F.xxhash64(vector))

    def placed(self, vectors: DataFrame, vector: str = "embedding") -> DataFrame:
        """``vectors`` with their ``cell``; NULL for a NULL vector."""
        known = vectors.filter(F.col(vector).isNotNull())
        grouped = known.withColumn("group", self.groups.assign(F.col(vector)))
        unknown = vectors.filter(F.col(vector).isNull()).withColumn("cell", F.lit(None).cast("int"))
        return self._placed_in(grouped, vector).drop("group").unionByName(unknown)

    def probing(
        self, queries: DataFrame, count: int, vector: str = "embedding", query_id: str = "query_id"
    ) -> DataFrame:
        """``queries`` with ``probes``, the ``count`` nearest cells of the groups nearest to each."""
        looked = min(len(self.groups.centroids), GROUPS_PER_PROBE * count)
        asked = queries.select(
            query_id, vector, F.explode(self.groups.probes(F.col(vector), looked)).alias("group")
        )
        schema = T.StructType([queries.schema[query_id], *T.StructType.fromDDL("cell int, score double")])

        def work(held: pa.Table) -> Callable[[pa.Table], Iterator[pa.RecordBatch]]:
            numbers = held.column("cell").to_numpy()
            centroids = unit_rows(to_matrix(held.column("centroid"))[0])

            def answer(rows: pa.Table) -> Iterator[pa.RecordBatch]:
                matrix, _ = to_matrix(rows.column(vector), centroids.shape[1])
                scores = np.round(unit_rows(matrix) @ centroids.T, SCORE_DECIMALS)
                best = np.lexsort((np.broadcast_to(numbers, scores.shape), -scores))[:, :count]
                which = np.repeat(np.arange(len(scores)), best.shape[1])
                yield from pa.table(
                    [rows.column(query_id).take(pa.array(which)), pa.array(numbers[best.ravel()]),
                     pa.array(scores[which, best.ravel()])],
                    names=[query_id, "cell", "score"],
                ).to_batches()

            return answer

        near = beside(self.cells, asked, "group", work, schema, F.xxhash64(query_id))
        rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), "cell"))
        best = near.distinct().withColumn("rank", rank).filter(F.col("rank") <= count)
        chosen = best.groupBy(query_id).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "cell"))), lambda x: x["cell"]).alias("probes")
        )
        return queries.join(chosen, query_id)

    def multi_query_top_k(
        self,
        stored: DataFrame,
        queries: DataFrame,
        k: int,
        probes: int,
        key: Sequence[str],
        query_id: str = "query_id",
        vector: str = "embedding",
        filter_columns: Sequence[str] = (),
    ) -> DataFrame:
        """`multi_query_top_k` within each query's nearest cells, with its filters."""
        probing = self.probing(queries, probes, vector, query_id)
        return multi_query_top_k(
            stored, probing, k, key, query_id, vector, filter_columns, cell="cell"
        )

    def probed(self, query: Sequence[float], count: int) -> list[int]:
        one = self.cells.sparkSession.createDataFrame([(0, list(query))], "query_id int, embedding array<double>")
        return self.probing(one, count).first().probes

    def save(self, path: str, spark: SparkSession) -> None:
        """Centroids of groups and cells, below ``path``."""
        self.groups.table(spark).write.mode("overwrite").parquet(f"{path}/groups")
        self.cells.write.mode("overwrite").parquet(f"{path}/cells")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CellTree:
        return cls(Cells(_matrix_of(spark.read.parquet(f"{path}/groups"))), spark.read.parquet(f"{path}/cells"))


def train_cells(vectors: DataFrame, cells: int, vector: str = "embedding", **options) -> Cells | CellTree:
    """Cells on one level if every task can hold their centroids, else on two."""
    first = vectors.filter(F.col(vector).isNotNull()).select(F.size(vector).alias("n")).first()
    if cells * (first.n if first else 0) * 8 <= CENTROID_BYTES:
        return Cells.train(vectors, cells, vector, **options)
    return CellTree.train(vectors, cells, vector, **options)


def _chosen(unit: DataFrame, count: int, seed: int) -> np.ndarray:
    """Distinct vectors to begin with, those with the smallest hashes."""
    rank = F.pmod(F.xxhash64(F.lit(seed), "embedding"), F.lit(1 << 40))
    bound = min(1 << 40, int((1 << 40) * 2.0 * (count + 8) / max(unit.count(), 1)) + 1)
    few = unit.select("embedding", rank.alias("h")).filter(F.col("h") < bound).distinct()
    found = few.orderBy("h", "embedding").limit(count).toArrow()
    return to_matrix(found.column("embedding"))[0]


def _numbered_cells(centroids: DataFrame) -> DataFrame:
    """Centroids of all groups with the numbers 0, 1, ... by group and position."""
    numbered = materialize(
        centroids.orderBy("group", "centroid").withColumn("row", F.monotonically_increasing_id()), "first-cells"
    )
    part = F.shiftrightunsigned("row", 33)
    sizes = numbered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row per range partition.
    shifts = F.broadcast(sizes.select("part", (before - F.col("first")).alias("shift")))
    return materialize(
        numbered.withColumn("part", part).join(shifts, "part").select(
            "group", (F.col("row") + F.col("shift")).cast("int").alias("cell"), "centroid"
        ),
        "cells",
    )


def _matrix_of(stored: DataFrame) -> np.ndarray:
    """Centroid rows in order of their number."""
    kept = stored.select("cell", "centroid").toArrow().sort_by("cell")
    return to_matrix(kept.column("centroid"))[0]


def recall(
    exact: DataFrame, approximate: DataFrame, key: Sequence[str], query_id: str = "query_id"
) -> DataFrame:
    """Per query, the share of the exact hits that the approximate search found."""
    found = approximate.select(query_id, *key).withColumn("__found", F.lit(1))
    return (
        exact.select(query_id, *key)
        .join(found, [query_id, *key], "left")
        .groupBy(query_id)
        .agg((F.count("__found") / F.count(F.lit(1))).alias("recall"))
    )


def centroids_of(means: DataFrame, by: str, vector: str = "embedding") -> Cells:
    """Cells from one vector per value of ``by``, in its order."""
    size = means.agg(F.max(F.size(vector)), F.count(F.lit(1))).first()
    if (size[0] or 0) * size[1] * 8 > CENTROID_BYTES:
        raise ValueError(f"{size[1]} centroids exceed {CENTROID_BYTES} bytes: use `CellTree`")
    values = means.select(by, vector).toArrow().sort_by(by)
    return Cells(to_matrix(values.column(vector))[0])
