"""Which way the small side of a join travels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A side of up to this many narrow rows (some 60 bytes each) goes to every executor.
BROADCAST_ROWS = 500_000


def counted_side(stored: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``stored`` marked for broadcast if it has at most ``most`` rows, else left to the planner.

    It has to be a stored table of narrow rows, whose count costs little. Beyond the bound
    the other side, with its texts, is shuffled and split where a key is hot.
    """
    return F.broadcast(stored) if stored.count() <= most else stored
