"""Compressed vectors: product-quantised residuals per cell, scanned by lookup tables.

A unit vector is its cell's centroid plus a rest. The rest is cut into equal parts, and each part is
replaced by the number of the nearest of a few code vectors. A query's product with a
compressed vector is then a sum of one table entry per part. The best by this estimate are
compared exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseek.functions.arrays import CELLS_AT_ONCE, to_matrix, unit_rows
from lodeseek.functions.vectors import SCORE_DECIMALS, cosine_similarity
from lodeseek.operators.cells import Cells
from lodeseek.operators.grid import against_blocks
from lodeseek.operators.joins import BROADCAST_BYTES
from lodeseek.session import materialize

# Vectors that the code vectors are fitted on.
SAMPLE = 65_536
# Bytes of codes and keys that a task holds while the queries come by.
SPLIT_BYTES = 128 << 20
# Estimates that a task works on at a time.
SCORES_AT_ONCE = 2 << 20


class ProductQuantiser:
    """Cells, and per part of a vector its code vectors (part, code, component)."""

    def __init__(self, cells: Cells, codebooks: np.ndarray):
        codebooks = np.asarray(codebooks, dtype=np.float64)
        parts, codes, width = codebooks.shape
        if codes > 256 or parts * width != cells.centroids.shape[1]:
            raise ValueError(f"{parts} x {codes} x {width} code vectors for {cells.centroids.shape[1]} components")
        self.cells, self.codebooks = cells, codebooks

    @classmethod
    def train(
        cls,
        vectors: DataFrame,
        cells: Cells,
        parts: int = 8,
        codes: int = 256,
        vector: str = "embedding",
        iterations: int = 10,
        sample: int = SAMPLE,
        seed: int = 17,
    ) -> ProductQuantiser:
        """Code vectors by k-means over the rests of at most ``sample`` vectors, chosen by hash.

        All vectors are compressed with them. A sample with fewer distinct rests than
        ``codes`` gives equal code vectors, of which the first is used.
        """
        rank = F.pmod(F.xxhash64(F.lit(seed), vector), F.lit(1 << 40))
        usable = vectors.filter(F.exists(vector, lambda x: x != 0)).select(F.col(vector).alias("v"), rank.alias("h"))
        bound = min(1 << 40, int((1 << 40) * 1.5 * sample / max(usable.count(), 1)) + 1)
        few = usable.filter(F.col("h") < bound).orderBy("h", "v").limit(sample).toArrow()
        if not few.num_rows:
            raise ValueError("no vector to fit code vectors on")
        rests = cls.rests(cells, to_matrix(few.column("v"))[0])[1]
        if rests.shape[1] % parts:
            raise ValueError(f"{rests.shape[1]} components in {parts} parts")
        pieces = rests.reshape(len(rests), parts, -1)
        rng = np.random.default_rng(seed)
        return cls(cells, np.stack([_code_vectors(pieces[:, p], codes, iterations, rng) for p in range(parts)]))

    @staticmethod
    def rests(cells: Cells, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells of vectors, and what the unit vectors have beside their centroids."""
        unit = unit_rows(matrix)
        cell = np.round(unit @ cells.centroids.T, SCORE_DECIMALS).argmax(axis=1)
        return cell, unit - cells.centroids[cell]

    def _codes(self, rests: np.ndarray) -> np.ndarray:
        parts, codes, width = self.codebooks.shape
        pieces = rests.reshape(len(rests), parts, width)
        found = np.empty((len(rests), parts), dtype=np.uint8)
        for part in range(parts):
            found[:, part] = _nearest(pieces[:, part], self.codebooks[part])
        return found

    def encode(self, vector: Column) -> Column:
        """struct(cell, codes): the cell and one byte per part; NULL for NULL and zero vectors."""

        @F.arrow_udf("cell int, codes binary")
        def compress(vectors: pa.Array) -> pa.Array:
            matrix, present = to_matrix(vectors, self.cells.centroids.shape[1])
            known = present & (matrix != 0).any(axis=1)
            cell, codes = np.zeros(len(matrix), dtype=np.int32), np.zeros((len(matrix), len(self.codebooks)), np.uint8)
            step = max(1, CELLS_AT_ONCE // self.codebooks.shape[1])
            for start in range(0, len(matrix), step):
                part = slice(start, start + step)
                cell[part], rest = self.rests(self.cells, matrix[part])
                codes[part] = self._codes(rest)
            columns = [pa.array(cell, mask=~known), pa.array([c.tobytes() for c in codes], pa.binary(), mask=~known)]
            return pa.StructArray.from_arrays(columns, names=["cell", "codes"])

        return compress(vector)

    def compressed(self, vectors: DataFrame, vector: str = "embedding") -> DataFrame:
        """``vectors`` without the vector, with ``cell`` and ``codes``; both NULL where it is NULL or zero."""
        made = vectors.withColumn("__compressed", self.encode(F.col(vector))).drop(vector)
        return made.select(*[c for c in made.columns if c != "__compressed"], "__compressed.cell", "__compressed.codes")

    def candidates(
        self,
        stored: DataFrame,
        queries: DataFrame,
        count: int,
        probes: int,
        key: Sequence[str],
        query_id: str = "query_id",
        vector: str = "embedding",
    ) -> DataFrame:
        """The ``count`` best of every query by estimate, ``query_id``, key, ``estimate`` and ``rank``.

        ``stored`` has the key, ``cell`` and ``codes``; rows without codes are never found. Only cells
        that the query probes are scanned. A task holds a split of the codes, grouped by
        cell, and queries come by in blocks; ties go by key.
        """
        key = list(key)
        coded = stored.filter("codes IS NOT NULL").select(*key, "cell", "codes")
        rows = coded.count()
        asked = self.cells.probing(
            queries.filter(F.exists(vector, lambda x: x != 0)).select(query_id, F.col(vector).alias("__vector")),
            probes, "__vector",
        )
        parts = len(self.codebooks)
        slots = stored.sparkSession.sparkContext.defaultParallelism
        splits = max(1, -(-rows * (parts + 64) // SPLIT_BYTES), min(slots, rows // 4096))
        schema = T.StructType(
            [queries.schema[query_id], *[coded.schema[c] for c in key], T.StructField("estimate", T.DoubleType())]
        )
        local = against_blocks(
            coded, asked, int(splits), F.xxhash64(*key), self._scan(count, key, query_id), schema
        )
        order = [F.desc("estimate"), *[F.asc_nulls_last(c) for c in key]]
        rank = F.row_number().over(Window.partitionBy(query_id).orderBy(*order))
        return local.withColumn("rank", rank).filter(F.col("rank") <= count)

    def _scan(self, count: int, key: list[str], query_id: str) -> Callable:
        def work(held: pa.Table) -> Callable[[pa.Table], Iterator[pa.RecordBatch]]:
            held = held.combine_chunks().sort_by([("cell", "ascending")])
            cell = held.column("cell").to_numpy()
            codes = np.frombuffer(b"".join(held.column("codes").to_pylist()), dtype=np.uint8)
            codes = codes.reshape(len(cell), len(self.codebooks)).astype(np.int64)
            bounds = np.searchsorted(cell, np.arange(len(self.cells.centroids) + 1))

            def answer(asked: pa.Table) -> Iterator[pa.RecordBatch]:
                asked = asked.combine_chunks()
                for start in range(0, asked.num_rows):
                    one = asked.slice(start, 1)
                    found = self._of_query(one, key, query_id, held, codes, bounds, count)
                    if found is not None:
                        yield from found.to_batches()

            return answer

        return work

    def _of_query(self, one, key, query_id, held, codes, bounds, count) -> pa.Table | None:
        """Best estimates for one query among the rows held."""
        query = unit_rows(to_matrix(one.column("__vector"))[0])[0]
        tables = np.einsum("pcw,pw->pc", self.codebooks, query.reshape(len(self.codebooks), -1))
        part = np.arange(len(self.codebooks))
        places, scores = [], []
        for cell in one.column("probes")[0].as_py():
            low, high = int(bounds[cell]), int(bounds[cell + 1])
            base = float(self.cells.centroids[cell] @ query)
            for begin in range(low, high, SCORES_AT_ONCE):
                end = min(high, begin + SCORES_AT_ONCE)
                scores.append(base + tables[part, codes[begin:end]].sum(axis=1))
                places.append(np.arange(begin, end))
        if not places:
            return None
        place, score = np.concatenate(places), np.round(np.concatenate(scores), SCORE_DECIMALS) + 0.0
        if len(score) > count:
            least = np.partition(score, len(score) - count)[len(score) - count]
            kept = score >= least
            place, score = place[kept], score[kept]
        rows = held.select(key).take(pa.array(place)).append_column("estimate", pa.array(score))
        rows = rows.sort_by([("estimate", "descending"), *[(c, "ascending") for c in key]]).slice(0, count)
        ids = one.column(query_id).take(pa.array(np.zeros(rows.num_rows, dtype=np.int64)))
        return rows.add_column(0, query_id, ids)

    def top_k(
        self,
        stored: DataFrame,
        vectors: DataFrame,
        queries: DataFrame,
        k: int,
        probes: int,
        key: Sequence[str],
        count: int | None = None,
        query_id: str = "query_id",
        vector: str = "embedding",
    ) -> DataFrame:
        """The ``k`` nearest found: ``query_id``, key, ``similarity``, ``rank``.

        The ``count`` (ten times ``k`` by default) best estimates over the compressed ``stored`` rows are
        compared exactly with their ``vectors`` (key and vector). The candidates, some per
        query, are sent to the vectors if they are few enough, else both are shuffled by key.
        """
        key = list(key)
        near = self.candidates(stored, queries, count or 10 * k, probes, key, query_id, vector)
        near = materialize(near.select(query_id, *key), "candidates")
        asked = queries.select(query_id, F.col(vector).alias("__query"))
        dims = self.cells.centroids.shape[1]
        few = near.count() * 8 * (dims + len(key) + 1) <= BROADCAST_BYTES
        wanted = near.join(asked, query_id)
        found = vectors.select(*key, F.col(vector).alias("__vector")).join(
            F.broadcast(wanted) if few else wanted, key
        )
        score = F.round(cosine_similarity(F.col("__vector"), F.col("__query")), SCORE_DECIMALS)
        scored = found.select(query_id, *key, score.alias("similarity"))
        order = [F.desc_nulls_last("similarity"), *[F.asc_nulls_last(c) for c in key]]
        rank = F.row_number().over(Window.partitionBy(query_id).orderBy(*order))
        return scored.withColumn("rank", rank).filter(F.col("rank") <= k)

    def save(self, spark: SparkSession, path: str) -> None:
        """Centroids and code vectors below ``path``."""
        self.cells.table(spark).write.mode("overwrite").parquet(f"{path}/centroids")
        rows = [
            (p, c, [float(x) for x in self.codebooks[p, c]])
            for p in range(self.codebooks.shape[0])
            for c in range(self.codebooks.shape[1])
        ]
        spark.createDataFrame(rows, "part int, code int, vector array<double>").coalesce(1).write.mode(
            "overwrite"
        ).parquet(f"{path}/codebooks")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ProductQuantiser:
        centroids = spark.read.parquet(f"{path}/centroids").orderBy("cell").toArrow()
        books = spark.read.parquet(f"{path}/codebooks").orderBy("part", "code").toArrow()
        parts = len(set(books.column("part").to_pylist()))
        matrix = to_matrix(books.column("vector"))[0]
        return cls(Cells(to_matrix(centroids.column("centroid"))[0]), matrix.reshape(parts, -1, matrix.shape[1]))


def _nearest(pieces: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Number of the nearest code vector; the lowest of equally near ones."""
    distance = np.einsum("ij,ij->i", codes, codes)[None, :] - 2.0 * pieces @ codes.T
    return np.round(distance, SCORE_DECIMALS).argmin(axis=1)


def _code_vectors(pieces: np.ndarray, codes: int, iterations: int, rng: np.random.Generator) -> np.ndarray:
    """k-means over the sampled pieces of one part, by squared distance."""
    current = pieces[rng.choice(len(pieces), codes, replace=len(pieces) < codes)]
    for _ in range(iterations):
        near = _nearest(pieces, current)
        counts = np.bincount(near, minlength=codes)
        sums = np.zeros_like(current)
        np.add.at(sums, near, pieces)
        current = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], current)
    return current
