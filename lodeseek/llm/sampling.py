"""Bounded samples of a table for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RANGE = 1 << 40
# How many more ids than wanted pass the first filter, on average.
_SPARE = 1.5


def sampled_ids(df: DataFrame, id_col: str, most: int) -> DataFrame:
    """(``__id``) at most ``most`` distinct ids, those with the smallest hashes; NULL is none.

    A filter on the hash, set by the number of distinct ids, lets only about half as many again
    through to the one task that orders them, however large the table is. The same table
    gives the same sample.
    """
    ids = df.select(F.col(id_col).alias("__id")).filter("__id IS NOT NULL")
    count = ids.agg(F.approx_count_distinct("__id")).first()[0]
    rank = F.pmod(F.xxhash64("__id"), F.lit(_RANGE))
    bound = min(_RANGE, int(_RANGE * _SPARE * most / max(count, 1)) + 1)
    return ids.filter(rank < bound).distinct().orderBy(rank, "__id").limit(most)
