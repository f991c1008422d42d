"""Nearest vectors by cosine similarity: one query, a full ranking, many queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseek.functions.arrays import CELLS_AT_ONCE, to_matrix, unit_rows
from lodeseek.functions.vectors import SCORE_DECIMALS, cosine_to, dot_to
from lodeseek.operators.grid import against_blocks
from lodeseek.operators.positions import number_rows
from lodeseek.schemas import HIT_COLUMNS, NATURAL_KEY
from lodeseek.session import materialize

FILTER_COLUMNS = ["repo_name", "language", "chunk_type"]

# Query vectors sent to every task, in bytes; more of them come by in blocks.
QUERY_BLOCK_BYTES = 64 << 20
# Document vectors that a task holds while the queries come by, in bytes.
SPLIT_BYTES = 64 << 20
# Documents of a split that are multiplied together.
ROWS_HELD_TOGETHER = 4096
# Values of a filter column, and cells, that a scan is told in a list.
VALUES_PUSHED, CELLS_PUSHED = 1000, 10_000
# Document-by-query scores held by a task at a time.
SCORES_AT_ONCE = 4 << 20
# Parts in which the results of the tasks for one query are merged.
MERGE_PARTS = 32


def with_filters(df: DataFrame, **wanted: str | None) -> DataFrame:
    """Equality filters, all of which must hold; None and '' mean no filter."""
    for column, value in wanted.items():
        if value:
            df = df.filter(F.col(column) == value)
    return df


def top_k(
    df: DataFrame, k: int, score: str = "similarity", key: Sequence[str] = NATURAL_KEY
) -> DataFrame:
    """The k best rows; undefined scores come last, ties in key order."""
    return df.orderBy(F.desc_nulls_last(score), *[F.asc_nulls_last(c) for c in key]).limit(k)


def cosine_top_k(
    df: DataFrame,
    query: Sequence[float],
    k: int = 10,
    key: Sequence[str] = NATURAL_KEY,
    vector: str = "embedding",
    unit: bool = False,
    **filters: str | None,
) -> DataFrame:
    """The k rows nearest to ``query``, filtered first; ``similarity`` replaces the vector.

    ``unit`` tells that stored vectors and query have length 1, which saves the norms.
    """
    score = dot_to(query) if unit else cosine_to(query)
    scored = with_filters(df, **filters).withColumn("similarity", score(F.col(vector)))
    return top_k(scored.drop(vector), k, key=key)


def search_stored(
    index: DataFrame, query: Sequence[float], k: int = 10, **filters: str | None
) -> DataFrame:
    """`cosine_top_k` over an index read from files, in two steps.

    The first step reads vectors and filter columns only and yields where the k best
    rows lie. The second opens the files of those rows, at most k, for the contents.
    """
    spark = index.sparkSession
    place = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
    )
    scored = (
        with_filters(index, **filters)
        .withColumn("similarity", cosine_to(query)(F.col("embedding")))
        .select(*NATURAL_KEY, "similarity", place.alias("place"))
    )
    best = top_k(scored, k).select("place.file", "place.row", "similarity").collect()
    found = spark.createDataFrame(
        [(b.file, b.row, b.similarity) for b in best], "file string, row bigint, similarity double"
    )
    files = sorted({b.file for b in best})
    rows = index.filter(F.col("_metadata.file_path").isin(files)).select(
        *[c for c in HIT_COLUMNS if c != "similarity"], place.alias("place")
    )
    hits = rows.join(
        F.broadcast(found),  # k rows
        (F.col("place.file") == F.col("file")) & (F.col("place.row") == F.col("row")),
    )
    return top_k(hits.select(*HIT_COLUMNS), k)


def rank_all(
    df: DataFrame,
    query: Sequence[float],
    key: Sequence[str],
    vector: str = "embedding",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Every row's key with its dot product ``score`` and its ``rank``, ties in key order.

    Only the key and the columns in ``carry`` travel through the sort. Scores are stored
    before it, so that vectors are computed once.
    """
    score = dot_to(query)(F.col(vector)).alias("score")
    scored = materialize(df.select(*key, *carry, score), "scores")
    order: list[Column] = [F.desc_nulls_last("score"), *[F.asc_nulls_last(c) for c in key]]
    return number_rows(scored, order, name="rank")


def multi_query_top_k(
    documents: DataFrame,
    queries: DataFrame,
    k: int,
    key: Sequence[str],
    query_id: str = "query_id",
    vector: str = "embedding",
    filter_columns: Sequence[str] = (),
    cell: str | None = None,
    windows: bool = False,
) -> DataFrame:
    """The k nearest documents of every query: query_id, key, similarity, rank.

    ``queries`` holds ``query_id``, the vector, and for each name in ``filter_columns``
    the value wanted of that document column (NULL or '' for any). With ``cell``, it also
    holds ``probes``, the cells to search, and a document is compared only with the
    queries that probe its cell. With ``windows``, rows with equal keys are parts of one document,
    which is as near as its nearest part.

    Every task multiplies documents with queries and keeps k rows per query, so no pairs
    travel; the second step merges these. Queries that want the same values are multiplied
    together, with the documents that have these values, and with no others. What all
    queries leave out is left out of the scan. Queries of up to QUERY_BLOCK_BYTES are sent
    to the tasks, which read the documents where they are. With more, documents are dealt over
    tasks, and queries come by in blocks: neither driver nor plan grows with them.
    """
    columns = [query_id, vector, *filter_columns, *(["probes"] if cell else [])]
    wanted = materialize(queries.select(*columns), "queries")
    count, width = wanted.agg(F.count(F.lit(1)), F.max(F.size(vector))).first()
    search = _Search(k, list(key), query_id, vector, list(filter_columns), cell, windows)
    needed = _pruned(documents.select(*search.columns), wanted, search)
    fields = {f.name: f for f in documents.schema.fields}
    schema = T.StructType(
        [wanted.schema[query_id], *[fields[c] for c in key], T.StructField("similarity", T.DoubleType())]
    )
    if count * 8 * max(width or 1, 1) <= QUERY_BLOCK_BYTES:
        local = needed.mapInArrow(search.over_batches(wanted.toArrow()), schema)
    else:
        rows = documents.select(*key).count()
        slots = documents.sparkSession.sparkContext.defaultParallelism
        splits = max(-(-rows * 8 * max(width, 1) // SPLIT_BYTES), min(slots, rows // 1024), 1)
        spread = F.xxhash64(*key, vector)
        local = against_blocks(needed, wanted, int(splits), spread, search.of_split, schema)
    if windows:
        # Parts of one document that several tasks have looked at.
        local = local.groupBy(query_id, *key).agg(F.max("similarity").alias("similarity"))
    order = [F.desc_nulls_last("similarity"), *[F.asc_nulls_last(c) for c in key]]

    def best(rows: DataFrame, *group: str | Column) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(query_id, *group).orderBy(*order))
        return rows.withColumn("rank", rank).filter(F.col("rank") <= k)

    # A query has k rows from every task: merged in parts, then the parts.
    part = F.pmod(F.xxhash64(*key), F.lit(MERGE_PARTS))
    return best(best(local, part).drop("rank"))


def _pruned(documents: DataFrame, queries: DataFrame, search: _Search) -> DataFrame:
    """``documents`` without those that no query looks at, as far as the scan can be told."""
    for column in search.filters:
        distinct = queries.select(column).distinct().limit(VALUES_PUSHED + 1).collect()
        # A query that wants any value makes all rows wanted.
        if len(distinct) <= VALUES_PUSHED and all(r[0] for r in distinct):
            documents = documents.filter(F.col(column).isin([r[0] for r in distinct]))
    if search.cell:
        probed = queries.select(F.explode("probes").alias("p")).distinct().limit(CELLS_PUSHED + 1).collect()
        if len(probed) <= CELLS_PUSHED:
            documents = documents.filter(F.col(search.cell).isin(sorted(r.p for r in probed)))
    return documents


class _Search:
    """Documents against queries inside tasks, the k best of each query kept."""

    def __init__(
        self, k: int, key: list[str], query_id: str, vector: str, filters: list[str], cell: str | None,
        windows: bool = False,
    ):
        self.k, self.key, self.query_id, self.vector = k, key, query_id, vector
        self.filters, self.cell, self.windows = filters, cell, windows
        self.columns = list(dict.fromkeys([*key, vector, *filters, *([cell] if cell else [])]))

    def over_batches(self, queries: pa.Table) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Batches of documents against one block of queries."""
        asked = _Asked(self, queries)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = _Best(self, asked)
            if not len(asked.matrix):
                return
            step = asked.rows_at_once()
            for batch in batches:
                for start in range(0, batch.num_rows, step):
                    part = pa.Table.from_batches([batch.slice(start, step)])
                    best.offer(_Held(self, part, asked.matrix.shape[1]))
            yield from best.rows()

        return run

    def of_split(self, documents: pa.Table) -> Callable[[pa.Table], Iterator[pa.RecordBatch]]:
        """Documents of a split against one block of queries after another."""
        known = documents.column(self.vector).drop_null()
        dims = len(known[0]) if len(known) else 0
        step = max(1, min(ROWS_HELD_TOGETHER, SCORES_AT_ONCE, CELLS_AT_ONCE // max(dims, 1)))
        parts = [_Held(self, documents.slice(at, step), dims) for at in range(0, documents.num_rows, step)]
        together = max(1, SCORES_AT_ONCE // step)

        def answer(queries: pa.Table) -> Iterator[pa.RecordBatch]:
            for at in range(0, queries.num_rows, together):
                best = _Best(self, _Asked(self, queries.slice(at, together)))
                for part in parts:
                    best.offer(part)
                yield from best.rows()

        return answer


class _Asked:
    """A block of queries, and which of them want which values."""

    def __init__(self, search: _Search, queries: pa.Table):
        self.ids = queries.column(search.query_id).combine_chunks()
        self.matrix, present = to_matrix(queries.column(search.vector))
        self.defined = present & (self.matrix != 0).any(axis=1)
        self.matrix = unit_rows(self.matrix)
        wanted = [queries.column(c).to_pylist() for c in search.filters]
        probes = queries.column("probes").to_pylist() if search.cell else [[None]] * len(self.ids)
        groups: dict[tuple[str, ...], dict[tuple, list[int]]] = {}
        for number, (near, *values) in enumerate(zip(probes, *wanted)):
            told = [(c, v) for c, v in zip(search.filters, values) if v]
            names = tuple(c for c, _ in told)
            for one in near or []:
                chosen = (one, *(v for _, v in told))
                groups.setdefault(names, {}).setdefault(chosen, []).append(number)
        self.groups = {n: {v: np.array(q) for v, q in by.items()} for n, by in groups.items()}

    def rows_at_once(self) -> int:
        return max(1, min(SCORES_AT_ONCE // max(len(self.ids), 1), CELLS_AT_ONCE // max(self.matrix.shape[1], 1)))


class _Held:
    """Some documents as a matrix, and their rows by the values of filter columns."""

    def __init__(self, search: _Search, rows: pa.Table, dims: int):
        self.search, self.rows = search, rows.combine_chunks()
        matrix, stored = to_matrix(self.rows.column(search.vector), dims)
        self.defined = stored & (matrix != 0).any(axis=1)
        self.matrix = unit_rows(matrix)
        self.document = _numbers_of(self.rows, search.key) if search.windows else None
        self.by_values: dict[tuple[str, ...], dict[tuple, np.ndarray]] = {}

    def having(self, names: tuple[str, ...]) -> dict[tuple, np.ndarray]:
        """Rows by cell and the values of the named columns."""
        if names not in self.by_values:
            cell = self.search.cell
            lists = [self.rows.column(cell).to_pylist() if cell else [None] * self.rows.num_rows]
            lists += [self.rows.column(c).to_pylist() for c in names]
            found: dict[tuple, list[int]] = {}
            for row, values in enumerate(zip(*lists)):
                found.setdefault(values, []).append(row)
            self.by_values[names] = {v: np.array(r) for v, r in found.items()}
        return self.by_values[names]


class _Best:
    """The k best pairs of every query so far."""

    def __init__(self, search: _Search, asked: _Asked):
        self.search, self.asked = search, asked
        self.pairs: pa.Table | None = None
        self.least = np.full(len(asked.ids), -np.inf)

    def offer(self, held: _Held) -> None:
        found = [
            self._among(held, rows, which)
            for names, by_value in self.asked.groups.items()
            for values, rows in held.having(names).items()
            if (which := by_value.get(values)) is not None
        ]
        found = [f for f in found if f is not None]
        if found:
            self._keep(pa.concat_tables(found if self.pairs is None else [self.pairs, *found]))

    def _among(self, held: _Held, rows: np.ndarray, which: np.ndarray) -> pa.Table | None:
        """Pairs that may be among the k best, given the k-th score known per query."""
        k = self.search.k
        scores = np.round(held.matrix[rows] @ self.asked.matrix[which].T, SCORE_DECIMALS) + 0.0
        # Undefined similarities rank after all others.
        scores[~(held.defined[rows][:, None] & self.asked.defined[which][None, :])] = -np.inf
        if held.document is not None:
            # Of the parts of a document the nearest; k of these are k documents.
            order = np.argsort(held.document[rows], kind="stable")
            starts = np.flatnonzero(np.diff(held.document[rows][order], prepend=-1))
            scores, rows = np.maximum.reduceat(scores[order], starts), rows[order][starts]
        bound = self.least[which]
        if len(rows) > k:
            bound = np.maximum(bound, -np.partition(-scores, k - 1, axis=0)[k - 1])
        # Ties with the k-th score stay in; the key decides between them.
        at, of = np.nonzero(scores >= bound)
        if not len(at):
            return None
        taken = [held.rows.column(c).take(pa.array(rows[at])) for c in self.search.key]
        return pa.table(
            [pa.array(which[of].astype(np.int64)), pa.array(scores[at, of]), *taken],
            names=["__query", "similarity", *self.search.key],
        )

    def _keep(self, pairs: pa.Table) -> None:
        ordered = pairs.sort_by(
            [("__query", "ascending"), ("similarity", "descending")]
            + [(c, "ascending") for c in self.search.key]
        )
        if self.search.windows:
            number = _numbers_of(ordered, ["__query", *self.search.key])
            first = np.zeros(len(number), dtype=bool)
            first[np.unique(number, return_index=True)[1]] = True
            ordered = ordered.filter(pa.array(first))
        which = ordered.column("__query").to_numpy()
        place = np.arange(len(which)) - np.searchsorted(which, which, side="left")
        last = place == self.search.k - 1
        self.least[which[last]] = ordered.column("similarity").to_numpy()[last]
        self.pairs = ordered.filter(pa.array(place < self.search.k))

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.pairs is None:
            return
        scores = self.pairs.column("similarity").to_numpy()
        out = [self.asked.ids.take(self.pairs.column("__query").combine_chunks())]
        out += [self.pairs.column(c) for c in self.search.key]
        out += [pa.array(scores, mask=np.isneginf(scores))]
        names = [self.search.query_id, *self.search.key, "similarity"]
        yield from pa.table(out, names=names).to_batches()


def _numbers_of(rows: pa.Table, columns: Sequence[str]) -> np.ndarray:
    """A number per row, equal where all columns are; NULL equals NULL."""
    number = np.zeros(rows.num_rows, dtype=np.int64)
    for column in columns:
        codes = rows.column(column).combine_chunks().dictionary_encode(null_encoding="encode").indices
        codes = codes.to_numpy().astype(np.int64)
        if len(codes):
            number = np.unique(number * (codes.max() + 1) + codes, return_inverse=True)[1]
    return number
