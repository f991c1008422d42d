"""Versions of a table of Parquet files: written aside, made current in one step.

Every write goes into a folder of its own. A version is a small table that says which
write holds each group of partitions, and one small file names the current version. That
file is replaced last, so a run that fails before leaves the table as it was, and a
reader that has begun keeps the files it has seen. Folders that no version needs any more
are deleted by `vacuum` only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.session import delete_path

POINTER = "_current"


class Snapshots:
    """A partitioned table below ``path``, replaced by groups of partitions.

    ``partitions`` are the string columns that make up its folders. The first of them, ``group``, are
    replaced together. ``schema`` (DDL) holds all columns with the partitions.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, partitions: Sequence[str], group: Sequence[str]):
        if list(partitions)[: len(group)] != list(group):
            raise ValueError("a group is named by the first partition columns")
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.partitions, self.group = list(partitions), list(group)
        self._live_schema = ", ".join(f"{c} string" for c in self.group) + ", write string, folders bigint"

    # --- the pointer ----------------------------------------------------------------

    def _place(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def current(self) -> dict:
        """``version`` (0 before the first), its table of groups ``live``, and the ``notes`` kept with it."""
        place = self._place(POINTER)
        files = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(place):
            return {"version": 0, "live": None, "notes": {}}
        stream = files.open(place)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _switch(self, state: dict) -> None:
        """Put the new pointer in the old one's place, in one step."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        aside, place = self._place(f"{POINTER}-{uuid.uuid4().hex}"), self._place(POINTER)
        stream = aside.getFileSystem(conf).create(aside, True)
        try:
            stream.write(bytearray(json.dumps(state).encode()))
        finally:
            stream.close()
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), conf).rename(aside, place, how)

    # --- reading --------------------------------------------------------------------

    def live(self, state: dict | None = None) -> DataFrame:
        """The groups of a version (the current one), with the write that holds each."""
        state = state or self.current()
        if not state["version"]:
            return self.spark.createDataFrame([], self._live_schema)
        return self.spark.read.schema(self._live_schema).parquet(f"{self.path}/_live/{state['live']}")

    def read(self, choose: Callable[[DataFrame], DataFrame] | None = None, state: dict | None = None) -> DataFrame:
        """The rows of a version (the current one), with their partition columns and ``write``.

        ``choose`` picks groups from the `live` table. The driver gets one row per group to be
        read, as Spark's own list of files has one per file.
        """
        live = self.live(state)
        chosen = (choose(live) if choose else live).select(*self.group, "write", "folders").collect()
        schema = f"{self.schema}, write string"
        if not chosen:
            return self.spark.createDataFrame([], schema)
        by_write: dict[str, list] = {}
        for row in chosen:
            by_write.setdefault(row.write, []).append(row)
        paths = []
        for write, rows in sorted(by_write.items()):
            top = f"{self.path}/data/write={write}"
            # A write that is wanted as a whole is one path.
            paths += [top] if len(rows) == rows[0].folders else sorted(f"{top}/{self._folder(r)}" for r in rows)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*paths)

    @staticmethod
    def is_empty(stored: DataFrame) -> bool:
        """Whether what `read` returned has no files, and so no file columns."""
        try:
            stored.select("_metadata.file_path")
        except AnalysisException:
            return True
        return False

    def _folder(self, row) -> str:
        escape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        return "/".join(f"{c}={escape(row[c])}" for c in self.group)

    # --- writing --------------------------------------------------------------------

    def stage(self, rows: DataFrame, sort: Sequence[str] = ()) -> DataFrame:
        """Write rows aside; returns their groups as `live` rows. Nothing changes for readers.

        ``rows`` has to be a stored table, as it is read twice. Rebalancing splits a large partition over several
        tasks and files and joins small ones.
        """
        write = uuid.uuid4().hex
        (
            rows.hint("rebalance", *[F.col(c) for c in self.partitions])
            .sortWithinPartitions(*self.partitions, *sort)
            .write.partitionBy(*self.partitions)
            .parquet(f"{self.path}/data/write={write}")
        )
        groups = rows.select(*self.group).distinct()
        return groups.withColumns({"write": F.lit(write), "folders": F.lit(groups.count()).cast("bigint")})

    def commit(self, base: dict, live: DataFrame, notes: dict | None = None) -> int:
        """Make ``live`` the current version, if ``base`` still is; returns its number.

        Two writers that pass this test in the same instant can still overwrite each
        other: a table has one writer at a time.
        """
        name = uuid.uuid4().hex
        live.select(*self.group, "write", "folders").coalesce(1).write.parquet(f"{self.path}/_live/{name}")
        if self.current()["version"] != base["version"]:
            raise RuntimeError("the table was changed by another writer meanwhile")
        number = base["version"] + 1
        self._switch({"version": number, "live": name, "notes": base["notes"] if notes is None else notes})
        return number

    def vacuum(self) -> int:
        """Delete the writes and versions that the current version does not need; their number.

        Readers of older versions must have ended.
        """
        state = self.current()
        needed = {f"write={r.write}" for r in self.live(state).select("write").distinct().collect()}
        gone = 0
        for folder, kept in (("data", needed), ("_live", {state["live"]})):
            place = self._place(folder)
            files = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for status in files.listStatus(place) if files.exists(place) else []:
                if status.getPath().getName() not in kept:
                    delete_path(self.spark, status.getPath().toString())
                    gone += 1
        return gone
