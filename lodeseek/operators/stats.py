"""Latency and throughput statistics of recorded requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.operators.positions import exact_percentiles


def latency_stats(
    samples: DataFrame,
    by: str = "batch_size",
    latency: str = "latency_ms",
    batch_size: str = "batch_size",
    phase: str | None = "phase",
) -> DataFrame:
    """Per configuration: iterations, mean, median, p95, p99, min, max in ms, sentences/s.

    Samples of the warm-up phase do not count, those of a NULL phase do. A NULL
    configuration, and one without any latency, is a group like others.
    """
    if phase:
        samples = samples.filter(~F.col(phase).eqNullSafe("warmup"))
    plain = samples.groupBy(by).agg(
        F.count(latency).alias("iterations"),
        F.avg(latency).alias("mean_ms"),
        F.min(latency).alias("min_ms"),
        F.max(latency).alias("max_ms"),
        F.try_divide(F.max(batch_size) * F.lit(1000.0), F.avg(latency)).alias("throughput"),
    )
    ranked = exact_percentiles(
        samples, latency, {"median_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}, [by]
    )
    return _with_percentiles(plain, ranked, by).select(
        by,
        "iterations",
        "mean_ms",
        "median_ms",
        "p95_ms",
        "p99_ms",
        "min_ms",
        "max_ms",
        "throughput",
    )


def throughput_stats(
    requests: DataFrame,
    by: str = "workers",
    start: str = "start_ts",
    end: str = "end_ts",
    sentences: str = "sentences",
) -> DataFrame:
    """Per number of workers: totals, wall time, sentences/s, mean and p95 latency.

    The rate is over the time from the first start to the last end, not over the sum of
    the latencies.
    """
    timed = requests.select(
        by,
        sentences,
        F.unix_micros(start).alias("__start"),
        F.unix_micros(end).alias("__end"),
        ((F.unix_micros(end) - F.unix_micros(start)) / 1000.0).alias("__latency"),
    )
    wall = (F.max("__end") - F.min("__start")) / 1e6
    plain = timed.groupBy(by).agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.sum(sentences).alias("total_sentences"),
        wall.alias("total_time_sec"),
        F.try_divide(F.sum(sentences).cast("double"), wall).alias("throughput"),
        F.avg("__latency").alias("mean_latency_ms"),
    )
    ranked = exact_percentiles(timed, "__latency", {"p95_latency_ms": 0.95}, [by])
    return _with_percentiles(plain, ranked, by)


def _with_percentiles(plain: DataFrame, ranked: DataFrame, by: str) -> DataFrame:
    """Groups keep their row if they have no percentile; NULL is a group."""
    named = ranked.withColumnRenamed(by, "__by")
    return plain.join(named, F.col(by).eqNullSafe(F.col("__by")), "left").drop("__by")


def batch_throughput(
    runs: DataFrame,
    batch_size: int,
    by: Sequence[str] = (),
    sentences: str = "sentences",
    elapsed: str = "elapsed_sec",
) -> DataFrame:
    """Per run of full batches: sentences encoded, sentences/s, ms per batch.

    A last batch that is not full is not encoded, and not counted.
    """
    batches = F.floor(F.col(sentences) / batch_size)
    return runs.select(
        *by,
        batches.alias("batches"),
        (batches * batch_size).alias("encoded"),
        F.try_divide((batches * batch_size).cast("double"), F.col(elapsed)).alias("throughput"),
        F.try_divide(F.col(elapsed) * 1000.0, batches.cast("double")).alias("ms_per_batch"),
    )


def index_summary(index: DataFrame) -> DataFrame:
    """Chunks and latest indexing date per repository, the largest first."""
    return (
        index.groupBy("repo_name")
        .agg(
            F.count(F.lit(1)).alias("chunks"),
            F.max("indexed_at").cast("date").alias("indexed_on"),
        )
        .orderBy(F.desc("chunks"), "repo_name")
    )


def index_total(index: DataFrame) -> DataFrame:
    return index.agg(F.count(F.lit(1)).alias("chunks"))
