"""Source trees as tables of text files.

Spark's file sources pass over every name that starts with ``_`` or ``.``, so they would
lose ``__init__.py`` or ``.github/``. Here a tree is listed and read by tasks of its own:
directories are spread over the cluster to be listed, files to be read, and between the
two all filters on names run on the listing, so that a file which is not indexed is never
opened.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseek.functions.arrays import row_ranges
from lodeseek.functions.text import (
    SKIPPED_DIRECTORIES,
    in_skipped_directory,
    language_of,
    lenient_utf8,
    not_blank,
)
from lodeseek.session import materialize

# A row cannot hold more, so a larger file is refused.
MAX_FILE_BYTES = 2**31 - 1

# Bytes of files that one task reads, and that it hands over at a time.
TASK_BYTES = 128 << 20
BATCH_BYTES = 4 << 20

_ENTRIES = pa.schema(
    [
        ("rel_path", pa.string()),
        ("is_directory", pa.bool_()),
        ("size", pa.int64()),
        ("modified_ns", pa.int64()),
        ("error", pa.string()),
    ]
)
_ENTRIES_DDL = (
    "rel_path string, is_directory boolean, size bigint, modified_ns bigint, error string"
)


def _open(root: str) -> tuple[pafs.FileSystem, str]:
    """File system and base directory of an absolute path or a URI."""
    if root.startswith("/"):
        return pafs.LocalFileSystem(), root.rstrip("/")
    system, base = pafs.FileSystem.from_uri(root)
    return system, base.rstrip("/")


def _children(system: pafs.FileSystem, base: str, directory: str) -> Iterator[tuple]:
    """Entries of one directory, without skipped and without linked directories.

    A directory that cannot be listed is one entry with the error. The root has to be
    there: a job over a mistyped one would take every repository for empty.
    """
    try:
        found = system.get_file_info(pafs.FileSelector(f"{base}/{directory}".rstrip("/")))
    except OSError as problem:
        if not directory:
            raise
        yield directory, False, 0, 0, str(problem)
        return
    local = isinstance(system, pafs.LocalFileSystem)
    for info in found:
        is_directory = info.type == pafs.FileType.Directory
        if is_directory and (
            info.base_name in SKIPPED_DIRECTORIES or local and os.path.islink(info.path)
        ):
            continue
        if is_directory or info.type == pafs.FileType.File:
            path = f"{directory}/{info.base_name}".lstrip("/")
            yield path, is_directory, info.size or 0, info.mtime_ns or 0, None


def _listing(root: str) -> Callable:
    """Replaces directories by their entries."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(root)
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out), _ENTRIES)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, schema=_ENTRIES)

        for batch in batches:
            for row in batch.to_pylist():
                for entry in _children(system, base, row["rel_path"]):
                    out.append(entry)
                    if len(out) >= 10_000:
                        yield flush()
        if out:
            yield flush()

    return expand


def list_tree(spark: SparkSession, root: str, repo_name: str | None = None) -> DataFrame:
    """All files below ``root``: repo_name, rel_path, size, modified_ns, error.

    With ``repo_name`` the root is that repository; else each directory directly below
    the root is one. The tree is listed level by level, the directories of each level
    spread over the cluster. Skipped directories are not entered. A directory that cannot
    be listed is a row with its ``error``; a root that cannot be listed fails.
    """
    _open(root)  # a root that cannot be understood fails here
    tasks = max(
        spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    )
    directories = spark.createDataFrame([("", True, 0, 0, None)], _ENTRIES_DDL)
    levels = []
    while not directories.isEmpty():
        level = materialize(directories.mapInArrow(_listing(root), _ENTRIES_DDL), "level")
        levels.append(level.filter("NOT is_directory"))
        # A given number of partitions, as they are small in bytes but not in work.
        directories = level.filter("is_directory").repartition(tasks, "rel_path")
    entries = reduce(DataFrame.unionByName, levels)
    path = F.col("rel_path")
    if repo_name is None:
        # A file beside the repositories is in none; one that cannot be listed is.
        entries = entries.filter(path.contains("/") | F.col("error").isNotNull())
        name, rest = F.substring_index(path, "/", 1), F.substring(
            path, F.locate("/", path) + 1, F.length(path)
        )
    else:
        name, rest = F.lit(repo_name), path
    return entries.select(
        name.alias("repo_name"),
        rest.alias("rel_path"),
        "size",
        "modified_ns",
        "error",
    )


def list_repositories(spark: SparkSession, root: str) -> DataFrame:
    """The directories directly below ``root`` (repo_name), also those without files."""
    top = spark.createDataFrame([("", True, 0, 0, None)], _ENTRIES_DDL)
    entries = top.mapInArrow(_listing(root), _ENTRIES_DDL).filter("is_directory")
    return entries.select(F.col("rel_path").alias("repo_name"))


def read_files(listing: DataFrame, root: str, whole_root: bool) -> DataFrame:
    """``listing`` with ``content`` (bytes), or ``error`` where a file cannot be read.

    ``whole_root`` tells that the root is one repository. The listing is stored first, to
    know how many tasks its bytes need.
    """
    listing = materialize(listing.drop("error"), "listing")
    total = listing.agg(F.sum("size")).first()[0] or 0
    slots = listing.sparkSession.sparkContext.defaultParallelism
    tasks = max(slots, -(-total // TASK_BYTES))
    schema = T.StructType(
        listing.schema.fields
        + [T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType())]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(root)
        for batch in batches:
            done, held, contents, errors = 0, 0, [], []

            def flush() -> pa.RecordBatch:
                count = len(contents)
                read_now = [pa.array(contents, pa.binary()), pa.array(errors, pa.string())]
                contents.clear()
                errors.clear()
                return pa.RecordBatch.from_arrays(
                    [*batch.slice(done, count).columns, *read_now],
                    names=[*batch.schema.names, "content", "error"],
                )

            for row in batch.select(["repo_name", "rel_path", "size"]).to_pylist():
                inside = "" if whole_root else f"{row['repo_name']}/"
                content, error = None, None
                try:
                    if row["size"] > MAX_FILE_BYTES:
                        raise OSError(f"{row['size']} bytes are more than a row can hold")
                    with system.open_input_stream(f"{base}/{inside}{row['rel_path']}") as stream:
                        content = stream.read()
                except OSError as problem:
                    error = str(problem)
                contents.append(content)
                errors.append(error)
                held += len(content or b"")
                if held >= BATCH_BYTES:
                    count = len(contents)
                    yield flush()
                    done, held = done + count, 0
            if contents:
                yield flush()

    return listing.repartition(tasks, "repo_name", "rel_path").mapInArrow(read, schema)


def write_tree(files: DataFrame, root: str) -> int:
    """Write files (repo_name, rel_path, content) below ``root``, one directory per repository.

    Returns their number. A file that is there is replaced, so a task that is run again does no
    harm. NULL as content removes the file.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(root)
        made: set[str] = set()

        def put(row: dict) -> None:
            path = f"{base}/{row['repo_name']}/{row['rel_path']}"
            folder = path.rsplit("/", 1)[0]
            if row["content"] is None:
                if system.get_file_info(path).type == pafs.FileType.File:
                    system.delete_file(path)
                return
            if folder not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            with system.open_output_stream(path) as stream:
                stream.write(row["content"])

        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("content")), 0)
            for some in row_ranges(sizes.to_numpy(zero_copy_only=False), BATCH_BYTES):
                for row in batch.slice(some.start, some.stop - some.start).to_pylist():
                    put(row)
            yield pa.RecordBatch.from_pydict({"written": pa.array([batch.num_rows], pa.int64())})

    rows = files.select("repo_name", "rel_path", F.col("content").cast("binary").alias("content"))
    return rows.mapInArrow(write, "written bigint").agg(F.sum("written")).first()[0] or 0


def scan_tree(
    spark: SparkSession,
    root: str,
    repo_name: str | None = None,
    manifest: DataFrame | None = None,
    exclude: Iterable[str] = (),
) -> DataFrame:
    """The indexable files below ``root``: repo_name, rel_path, content, language.

    ``manifest`` (repo_name, rel_path) restricts to tracked files; ``exclude`` names
    repositories to leave out. Directories that cannot be listed and files that cannot be
    read are left out; `list_tree` and `read_files` tell why.
    """
    listing = exclude_repos(list_tree(spark, root, repo_name), exclude)
    wanted = indexable(tracked_only(listing, manifest))
    return source_texts(read_files(wanted, root, repo_name is not None))


def indexable(files: DataFrame) -> DataFrame:
    """Files of a known language outside skipped directories, with that ``language``."""
    path = F.col("rel_path")
    return (
        files.filter(~in_skipped_directory(path))
        .withColumn("language", language_of(path))
        .filter(F.col("language").isNotNull())
    )


def source_texts(files: DataFrame) -> DataFrame:
    """Read files as text: decoded, without those that failed or are blank."""
    texts = files.filter(F.col("error").isNull()).withColumn(
        "content", lenient_utf8(F.col("content"))
    )
    return texts.filter(not_blank(F.col("content"))).select(
        "repo_name", "rel_path", "content", "language"
    )


def tracked_only(files: DataFrame, manifest: DataFrame | None) -> DataFrame:
    """Files in the manifest; all of them without one."""
    if manifest is None:
        return files
    return files.join(manifest, ["repo_name", "rel_path"], "left_semi")


def exclude_repos(files: DataFrame, names: Iterable[str] | DataFrame) -> DataFrame:
    """Without the repositories named in a list or in a table with ``repo_name``."""
    if isinstance(names, DataFrame):
        return files.join(names, "repo_name", "left_anti")
    names = list(names)
    return files.filter(~F.col("repo_name").isin(names)) if names else files
