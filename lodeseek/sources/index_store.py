"""The vector index: Parquet files by model, repository, bucket and cell."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.operators.cells import Cells, CellTree, train_cells
from lodeseek.operators.merging import checked, content_difference, merge_index, reconcile
from lodeseek.registry import ModelSpec, model_spec
from lodeseek.schemas import (
    INDEX_COLUMNS,
    INDEX_GROUP,
    INDEX_PARTITIONS,
    NATURAL_KEY,
    STORED_INDEX,
)
from lodeseek.session import materialize
from lodeseek.sources.snapshots import Snapshots

# Where a stored row lies: its file and its number in it.
PLACE = ["file", "row"]
# The cell of rows whose model has no cells, and of rows without a direction.
NO_CELL = "none"


class IndexStore:
    """Reading and writing the index below one directory.

    Writers write the groups (model, repository, bucket) of the rows they are given anew and
    make them current in one step (`Snapshots`): a failed run leaves the old index, and a search
    that has begun keeps the index it began with.

    ``buckets`` divides every repository by a hash of the file path. An update rewrites
    only the buckets of the files it brings; choose it so that a bucket of the largest
    repository is worth rewriting. The number is part of the partition names and has to
    stay the same for a store.

    A model may have cells (`train_cells`). They are the last level of folders, so that an approximate
    search opens the files of a few cells only, within the repositories it is limited
    to. Whatever is written later gets its cell.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 1):
        self.spark = spark
        self.path = path.rstrip("/")
        self.buckets = buckets
        self.snapshots = Snapshots(spark, self.path, STORED_INDEX, INDEX_PARTITIONS, INDEX_GROUP)

    def read(self, model: str | None = None, places: bool = False, cells: bool = False) -> DataFrame:
        """The index, or the part of one model; an index not yet written is empty.

        ``places`` adds the columns of PLACE, ``cells`` the ``cell`` (NULL for none).
        """
        stored = self.snapshots.read((lambda live: live.filter(F.col("model") == model)) if model else None)
        if model:
            stored = stored.filter(F.col("model") == model)
        extra = {}
        if places:
            extra = {"file": F.col("_metadata.file_path"), "row": F.col("_metadata.row_index")}
            if self.snapshots.is_empty(stored):
                extra = {"file": F.lit(""), "row": F.lit(0).cast("bigint")}
        if cells:
            extra["cell"] = F.expr("try_cast(cell AS int)")
        return stored.select(*INDEX_COLUMNS, *[c.alias(n) for n, c in extra.items()])

    def replace(
        self, rows: DataFrame, repos: DataFrame | None = None, model: str | None = None
    ) -> None:
        """Make ``rows`` the whole content of the repositories they belong to.

        ``repos`` (repo_name) are the repositories that were indexed, with ``model``; one
        of them without a row is emptied. All of it becomes visible in one step.
        """
        base = self.snapshots.current()
        rows = self._stored(rows, base, "replacement")
        written = self.snapshots.stage(rows, self._order())
        live = self.snapshots.live(base)
        kept = live.join(rows.select("model", "repo_name").distinct(), ["model", "repo_name"], "left_anti")
        if repos is not None:
            emptied = kept.join(repos.select("repo_name").distinct(), "repo_name", "left_semi")
            if model:
                emptied = emptied.filter(F.col("model") == model)
            kept = kept.join(emptied.select(*INDEX_GROUP), INDEX_GROUP, "left_anti")
        self.snapshots.commit(base, kept.unionByName(written))

    def clear(self, repo: str, model: str | None = None) -> None:
        """Remove a repository's rows (of the given model, else of all)."""
        base = self.snapshots.current()
        gone = F.col("repo_name") == repo
        if model:
            gone = gone & (F.col("model") == model)
        self.snapshots.commit(base, self.snapshots.live(base).filter(~gone))

    def upsert(self, rows: DataFrame) -> None:
        """Insert rows; update content, vector and time of those whose key is stored."""
        base = self.snapshots.current()
        rows = materialize(self._bucketed(rows), "batch")
        touched = materialize(rows.select(*INDEX_GROUP).distinct(), "touched")
        live = self.snapshots.live(base)
        self._check_buckets(live, touched)
        current = self.snapshots.read(
            lambda found: found.join(touched, INDEX_GROUP, "left_semi"), base
        ).select(*rows.columns)
        merged = merge_index(current, rows, ["model", "bucket", *NATURAL_KEY])
        written = self.snapshots.stage(self._stored(merged, base, "merged"), self._order())
        kept = live.join(touched, INDEX_GROUP, "left_anti")
        self.snapshots.commit(base, kept.unionByName(written))

    def copy_to(self, other: IndexStore, rows_of: DataFrame | None = None) -> DataFrame:
        """Write this store's rows to another one and compare their counts."""
        other.replace(self.read() if rows_of is None else rows_of)
        return reconcile(self.read(), other.read())

    def differences(self, other: IndexStore) -> DataFrame:
        """Rows in which this store and another one differ, see `content_difference`."""
        return content_difference(self.read(), other.read())

    def vacuum(self) -> int:
        """Delete files that the current index does not need, once older searches have ended."""
        return self.snapshots.vacuum()

    # --- cells ------------------------------------------------------------------------

    def cells(self, model: str) -> Cells | CellTree | None:
        """The cells of a model's vectors, if it has some."""
        return self._cells_of(self.snapshots.current(), model)

    def _cells_of(self, state: dict, model: str) -> Cells | CellTree | None:
        kept = state["notes"].get("cells", {}).get(model)
        if kept is None:
            return None
        path = f"{self.path}/_cells/{kept['folder']}"
        return CellTree.load(self.spark, path) if kept["levels"] == 2 else Cells.load_centroids(self.spark, path)

    def train_cells(self, model: str, cells: int, **options) -> None:
        """Divide the stored vectors of a model into about ``cells`` cells.

        Training begins with the model's earlier cells if they are as many.
        """
        before = self.cells(model)
        if isinstance(before, Cells) and len(before.centroids) == cells:
            options.setdefault("first", before)
        self.set_cells(model, train_cells(self.read(model).select("embedding"), cells, **options))

    def set_cells(
        self, model: str, cells: Cells | CellTree, choose: Callable[[DataFrame], DataFrame] | None = None
    ) -> None:
        """Put the stored vectors of a model into given cells.

        All its groups are written anew, or those that ``choose`` picks from the table of groups.
        """
        base = self.snapshots.current()
        folder = uuid.uuid4().hex
        cells.save(f"{self.path}/_cells/{folder}", self.spark)
        kept = {"folder": folder, "levels": 1 if isinstance(cells, Cells) else 2}
        notes = {**base["notes"], "cells": {**base["notes"].get("cells", {}), model: kept}}
        state = {**base, "notes": notes}
        live = self.snapshots.live(base)
        moved = live.filter(F.col("model") == model)
        moved = materialize((choose(moved) if choose else moved).select(*INDEX_GROUP), "moved")
        rows = self.snapshots.read(lambda found: found.join(moved, INDEX_GROUP, "left_semi"), base)
        written = self.snapshots.stage(self._stored(rows, state, "in-cells"), self._order())
        others = live.join(moved, INDEX_GROUP, "left_anti")
        self.snapshots.commit(base, others.unionByName(written), notes)

    def split_cells(self, model: str, most: int) -> int:
        """Split the cells of a model that hold more than ``most`` rows; the number split.

        Only groups with rows in such a cell are written anew. For cells on one level.
        """
        cells = self.cells(model)
        if not isinstance(cells, Cells):
            raise ValueError(f"{model} has no cells on one level")
        stored = self.read(model, cells=True)
        split, done = cells.split(stored.select("embedding", "cell"), most)
        if done:
            parts = self.snapshots.read(lambda live: live.filter(F.col("model") == model))
            wanted = parts.filter(F.col("cell").isin([str(c) for c in done])).select(*INDEX_GROUP).distinct()
            self.set_cells(model, split, lambda live: live.join(wanted, INDEX_GROUP, "left_semi"))
        return len(done)

    # --- layout -----------------------------------------------------------------------

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        number = F.pmod(F.xxhash64("file_path"), F.lit(self.buckets)).cast("string")
        return rows.select(*INDEX_COLUMNS).withColumn(
            "bucket", F.concat(number, F.lit(f"of{self.buckets}"))
        )

    def _stored(self, rows: DataFrame, state: dict, label: str) -> DataFrame:
        """Rows with bucket and cell, stored in the shared folder."""
        rows = rows.select(*INDEX_COLUMNS, "bucket") if "bucket" in rows.columns else self._bucketed(rows)
        models = state["notes"].get("cells", {})
        known = F.col("model").isin(list(models)) & F.exists("embedding", lambda x: x != 0)
        if not models:
            return materialize(rows.withColumn("cell", F.lit(NO_CELL)), label)
        # Several readers follow, so costly vectors are computed once.
        rows = materialize(rows, f"{label}-rows")
        parts = [rows.filter(~F.coalesce(known, F.lit(False))).withColumn("cell", F.lit(NO_CELL))]
        for model in sorted(models):
            own = rows.filter((F.col("model") == model) & known)
            placed = self._cells_of(state, model).placed(own)
            parts.append(placed.withColumn("cell", F.col("cell").cast("string")))
        stored = parts[0]
        for part in parts[1:]:
            stored = stored.unionByName(part)
        return materialize(stored, label)

    @staticmethod
    def _order() -> list[str]:
        """Row groups of one language."""
        return ["language", "file_path", "start_line"]

    def _check_buckets(self, live: DataFrame, touched: DataFrame) -> None:
        others = live.filter(~F.col("bucket").endswith(f"of{self.buckets}")).join(
            touched, ["model", "repo_name"], "left_semi"
        )
        if others.take(1):
            raise ValueError(f"the index has another number of buckets than {self.buckets}")


def index_rows(
    chunks: DataFrame, model: str | ModelSpec, vector: str = "embedding", strict: bool = True
) -> DataFrame:
    """Embedded chunks in the layout of the index, checked against the store's limits."""
    spec = model_spec(model)
    rows = chunks.withColumn("model", F.lit(spec.name))
    if "indexed_at" not in chunks.columns:
        rows = rows.withColumn("indexed_at", F.current_timestamp())
    rows = rows.withColumnRenamed(vector, "embedding").select(*INDEX_COLUMNS)
    return checked(rows, spec.dims) if strict else rows
