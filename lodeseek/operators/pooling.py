"""Sums and means of vectors over rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseek.functions.arrays import CELLS_AT_ONCE, from_matrix, to_matrix

# Components of partial sums that a task holds before it passes them on.
SUMS_HELD = 4 << 20

_SUMS = ["__total", "__weight", "__rows"]


def vector_sums(
    df: DataFrame, by: Sequence[str], vector: str = "embedding", weight: Column | None = None
) -> DataFrame:
    """Per group, ``total`` (sum of vector * weight), ``weight`` and ``rows``.

    Tasks add up the vectors of each group as matrices and send one row per group, or one
    each time that they hold SUMS_HELD components, so a group of any size comes to few rows;
    these meet in sorted order and are added up a batch at a time. Vectors are never taken
    apart into rows. NULL is a group like others. NULL vectors do not count; a NULL weight
    is 0. Vectors of different lengths are an error.
    """
    by = list(by)
    factor = F.lit(1.0) if weight is None else F.coalesce(weight.cast("double"), F.lit(0.0))
    rows = df.filter(F.col(vector).isNotNull()).select(
        *by,
        F.col(vector).cast("array<double>").alias("__total"),
        factor.alias("__weight"),
        F.lit(1).cast("long").alias("__rows"),
    )
    schema = T.StructType(
        [*[rows.schema[c] for c in by], *[T.StructField(n, rows.schema[n].dataType) for n in _SUMS]]
    )

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            for part in _weighted(batch):
                held = _added(part if held is None else pa.concat_tables([held, part]), by)
                if held.num_rows * _width(held) > SUMS_HELD:
                    yield from held.to_batches()
                    held = None
        if held is not None:
            yield from held.to_batches()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = _plain(batch)
            table = _added(table if last is None else pa.concat_tables([last, table]), by)
            # The group that the batch ends with may go on in the next one.
            yield from table.slice(0, table.num_rows - 1).to_batches()
            last = table.slice(table.num_rows - 1)
        if last is not None:
            yield from last.to_batches()

    parts = rows.mapInArrow(partial, schema)
    dealt = parts.repartition(*by).sortWithinPartitions(*by) if by else parts.coalesce(1)
    return dealt.mapInArrow(merged, schema).select(
        *by, *[F.col(n).alias(n.removeprefix("__")) for n in _SUMS]
    )


def _weighted(batch: pa.RecordBatch) -> Iterator[pa.Table]:
    """Vectors times their weights, some rows at a time."""
    width = max(1, len(batch.column("__total").flatten()) // max(batch.num_rows, 1))
    step = max(1, CELLS_AT_ONCE // width)
    for start in range(0, batch.num_rows, step):
        part = _plain(batch.slice(start, step))
        matrix, _ = to_matrix(part.column("__total"))
        weights = part.column("__weight").to_numpy()
        place = part.schema.get_field_index("__total")
        yield part.set_column(place, "__total", from_matrix(matrix * weights[:, None], dtype=np.float64))


def _plain(batch: pa.RecordBatch) -> pa.Table:
    """A batch as a table whose columns are not marked as without NULLs."""
    return pa.table(batch.columns, names=batch.schema.names)


def _width(table: pa.Table) -> int:
    return len(table.column("__total").chunk(0)[0]) if table.num_rows else 0


def _added(table: pa.Table, by: Sequence[str]) -> pa.Table:
    """One row per group, in the order in which the groups first occur."""
    table = table.combine_chunks()
    group = np.zeros(table.num_rows, dtype=np.int64)
    for column in by:
        codes = table.column(column).combine_chunks().dictionary_encode(null_encoding="encode")
        codes = codes.indices.to_numpy()
        group = np.unique(group * (codes.max() + 1) + codes, return_inverse=True)[1]
    _, first, group = np.unique(group, return_index=True, return_inverse=True)
    order = np.argsort(group, kind="stable")
    starts = np.searchsorted(group[order], np.arange(len(first)))
    matrix, _ = to_matrix(table.column("__total"))
    kept = np.argsort(first, kind="stable")
    totals = np.add.reduceat(matrix[order], starts)[kept] if len(first) else matrix
    columns = [table.column(c).take(pa.array(first[kept])) for c in by]
    columns.append(from_matrix(totals, dtype=np.float64))
    for name in _SUMS[1:]:
        values = table.column(name).to_numpy()
        columns.append(pa.array(np.add.reduceat(values[order], starts)[kept] if len(first) else values))
    return pa.table(columns, names=[*by, *_SUMS])


def mean_vectors(
    df: DataFrame,
    by: Sequence[str],
    vector: str = "embedding",
    mask: Column | None = None,
    guard: float = 1e-9,
    name: str = "embedding",
) -> DataFrame:
    """Mean vector of each group: sum(vector * mask) / sum(mask).

    A group whose mask is all zero has the zero vector.
    """
    sums = vector_sums(df, by, vector, mask)
    weight = F.greatest(F.col("weight"), F.lit(guard))
    return sums.select(*by, F.transform("total", lambda x: x / weight).alias(name))


def masked_mean(
    df: DataFrame,
    by: Sequence[str],
    vector: str = "embedding",
    mask: Column | None = None,
    guard: float = 1e-9,
) -> DataFrame:
    """`mean_vectors` as one row per group and component (``pos`` from 0, ``mean``)."""
    means = mean_vectors(df, by, vector, mask, guard, "__mean")
    return means.select(*by, F.posexplode("__mean").alias("pos", "mean"))
