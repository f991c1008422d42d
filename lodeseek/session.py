"""Session settings, table loading and materialisation to shared storage."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lodeseek import schemas

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(
    master: str | None = None, app_name: str = "lodeseek", **settings: str
) -> SparkSession:
    """A session with the settings the engine expects.

    ``master`` is given for local runs only; on a cluster spark-submit names it.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given parquet tables, read with its declared schema."""
    return spark.read.schema(schemas.TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over as many tasks as there are slots, if its scan gives fewer.

    A file of one row group is read by one task, which then does all the costly work
    per row. A table with enough splits is left alone: nothing is shuffled. The hash of
    ``keys`` places rows, so a task that runs again sends the same rows to the same place.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= slots:
        return df
    return df.repartition(slots, *keys)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``.

    Where the setting is absent a local master gets a temporary folder, and any other is
    refused: executors on other machines would not see what is written there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        configured = _local_folder()
    return configured.rstrip("/")


@cache
def _local_folder() -> str:
    """One temporary folder per driver process, for local masters."""
    return tempfile.mkdtemp(prefix="lodeseek-")


# Folders in the shared folder that are in use, until they are released.
_stored: list[str] = []


def new_folder(spark: SparkSession, label: str) -> str:
    """Path of a folder of its own in the shared folder, until `release_stored`."""
    path = f"{shared_dir(spark)}/lodeseek/{label}-{uuid.uuid4().hex}"
    _stored.append(path)
    return path


def release_stored(spark: SparkSession) -> int:
    """Delete all folders given out so far; returns their number.

    To be called when the results that were built on it have been consumed.
    """
    released = len(_stored)
    while _stored:
        delete_path(spark, _stored.pop())
    return released


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once under the shared folder and read it back.

    Cuts the lineage, so that values which depend on how rows were placed
    (``monotonically_increasing_id``) or cost much (inference) are computed once
    and outlive a lost executor. Parquet keeps later reads column-pruned. The folder
    stays until `release_stored`.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(_nullable(df.schema)).parquet(path)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
