import numpy as np
import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from lodeseek import ModelSpec
from lodeseek.operators.cells import Cells
from lodeseek.operators.merging import content_difference
from lodeseek.operators.topk import multi_query_top_k
from lodeseek.plans.searching import search, search_many
from lodeseek.schemas import INDEX
from lodeseek.sources.index_store import IndexStore
from lodeseek.sources.snapshots import Snapshots
from test_index import row
from test_operators import unit

SMALL = ModelSpec("small", dims=16)
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()


def rows_of(spark, texts):
    """Index rows of (repo, path, text), embedded by the small model."""
    from lodeseek.operators.inference import embed

    frame = spark.createDataFrame(texts, "repo_name string, file_path string, content string")
    return frame.select(
        "file_path", F.lit("file").alias("chunk_type"), F.lit("f").alias("name"), "content",
        F.lit(1).alias("start_line"), F.lit(1).alias("end_line"),
        embed(F.col("content"), SMALL).alias("embedding"), F.lit("go").alias("language"),
        F.current_timestamp().alias("indexed_at"), F.lit("small").alias("model"), "repo_name",
    )


def many_texts(count):
    rng = np.random.default_rng(count)
    return [(f"r{i % 4}", f"p{i}", " ".join(rng.choice(WORDS, 5))) for i in range(count)]


def paths(store):
    return sorted((r.repo_name, r.file_path, r.content) for r in store.read().collect())


@pytest.mark.parametrize("step", ["stage", "live", "switch"])
def test_a_failure_between_steps_leaves_the_old_index(spark, tmp_path, monkeypatch, step):
    store = IndexStore(spark, str(tmp_path / "index"), buckets=2)
    store.replace(spark.createDataFrame([row("one", "a"), row("one", "b"), row("two", "c")], INDEX))
    before = paths(store)

    def fail(*args, **kwargs):
        raise RuntimeError("executor lost")

    with monkeypatch.context() as patched:
        if step == "stage":
            # The files are written, the version is not.
            patched.setattr(Snapshots, "commit", fail)
        elif step == "live":
            # The table of the version is written, the pointer is not.
            patched.setattr(Snapshots, "_switch", fail)
        else:
            whole = Snapshots._switch

            def half(self, state):
                # The new pointer is written aside, but not put in place.
                (tmp_path / "index" / "_current-left").write_text("{}")
                fail()

            patched.setattr(Snapshots, "_switch", half)
        for change in (store.replace, store.upsert):
            with pytest.raises(RuntimeError, match="lost"):
                change(spark.createDataFrame([row("one", "z", content="new")], INDEX))
    assert paths(store) == before
    # What failed is repeated, and what it left is removed.
    store.replace(spark.createDataFrame([row("one", "z", content="new")], INDEX))
    assert paths(store) == [("one", "z", "new"), ("two", "c", "c")]
    assert store.vacuum() > 0 and store.vacuum() == 0
    assert paths(store) == [("one", "z", "new"), ("two", "c", "c")]


def test_a_search_during_a_rewrite_keeps_its_index(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    store.replace(rows_of(spark, many_texts(40)))
    before = paths(store)
    begun = store.read("small")
    hits = search(store, "alpha beta", 5, model=SMALL)
    store.replace(rows_of(spark, [("r0", "new", "alpha beta")]))
    store.clear("r1")
    assert sorted((r.repo_name, r.file_path, r.content) for r in begun.collect()) == before
    assert hits.count() == 5 and {(r.repo_name, r.file_path) for r in hits.collect()} <= {b[:2] for b in before}
    assert {r[0] for r in paths(store)} == {"r0", "r2", "r3"}


def test_a_second_writer_is_refused(spark, tmp_path, monkeypatch):
    store, other = (IndexStore(spark, str(tmp_path / "index")) for _ in range(2))
    store.replace(spark.createDataFrame([row("one", "a")], INDEX))
    whole = Snapshots.stage

    def interrupted(self, rows, sort=()):
        monkeypatch.setattr(Snapshots, "stage", whole)
        other.upsert(spark.createDataFrame([row("two", "b")], INDEX))
        return whole(self, rows, sort)

    monkeypatch.setattr(Snapshots, "stage", interrupted)
    with pytest.raises(RuntimeError, match="another writer"):
        store.upsert(spark.createDataFrame([row("one", "c")], INDEX))
    assert [p[:2] for p in paths(store)] == [("one", "a"), ("two", "b")]


def test_writing_collects_no_values(spark, tmp_path):
    import inspect

    from lodeseek.sources import index_store

    source = inspect.getsource(index_store)
    assert ".collect()" not in source and "isin(list" in source


def test_cells_are_folders_and_searches_open_few(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"), buckets=2)
    texts = many_texts(400)
    store.replace(rows_of(spark, texts[:300]))
    with pytest.raises(ValueError, match="no cells"):
        search(store, "alpha", probes=2, model=SMALL)
    store.train_cells("small", 8, iterations=3)
    # An upsert gives cells to new rows, and new cells to changed ones.
    store.upsert(rows_of(spark, [(r, p, "alpha " + t) for r, p, t in texts[250:300]] + texts[300:]))
    store.replace(rows_of(spark, [("none", "empty", "...")]))
    cells = store.cells("small")
    stored = store.read("small", cells=True)
    assert stored.count() == 401
    for r, expected in zip(stored.collect(), cells.placed(stored.drop("cell")).collect()):
        assert (r.cell, r.file_path) == (expected.cell if any(r.embedding) else None, expected.file_path)
    hits = search(store, "alpha beta gamma", 10, repo_name="r1", model=SMALL, probes=2)
    near = store.read("small", cells=True).filter(F.col("cell").isin([0, 1])).filter("repo_name = 'r1'")
    plan = plan_of(near.select("file_path", "embedding"))
    partitions = plan[plan.index("PartitionFilters"):plan.index("PushedFilters")]
    assert "cell" in partitions and "repo_name" in partitions
    assert hits.count() == 10 and {r.repo_name for r in hits.collect()} == {"r1"}
    # With all cells probed both searches are exact.
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "xi nu mu")], "query_id int, text string")
    exact = search_many(store, asked, 7, SMALL).select("query_id", "rank", "file_path", "content", "similarity")
    everywhere = search_many(store, asked, 7, SMALL, probes=8).select(*exact.columns)
    assert sorted(map(tuple, everywhere.collect())) == sorted(map(tuple, exact.collect()))
    some = search_many(store, asked, 7, SMALL, probes=3)
    found = {(r.query_id, r.file_path) for r in some.collect()} & {(r.query_id, r.file_path) for r in exact.collect()}
    assert len(found) >= 7


def test_over_full_cells_of_a_store_are_split(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    store.replace(rows_of(spark, many_texts(200)))
    # All rows in one cell, but for those of the other's own direction.
    store.set_cells("small", Cells(np.stack([np.ones(16), -np.ones(16)])))
    before = {r.cell: r["count"] for r in store.read("small", cells=True).groupBy("cell").count().collect()}
    assert max(before.values()) > 60
    assert store.split_cells("small", 60) >= 1
    after = {r.cell: r["count"] for r in store.read("small", cells=True).groupBy("cell").count().collect()}
    assert sum(after.values()) == 200 and max(after.values()) < max(before.values())
    cells = store.cells("small")
    for r in cells.placed(store.read("small", cells=True).withColumnRenamed("cell", "kept")).collect():
        assert r.cell == r.kept
    # Training again begins with what is there.
    store.train_cells("small", len(cells.centroids), iterations=1)
    assert store.read().count() == 200


def test_differences_name_the_changed_vector(spark, tmp_path):
    first, second = (IndexStore(spark, str(tmp_path / n), buckets=2) for n in "ab")
    rows = spark.createDataFrame([row(f"r{i % 3}", f"p{i}") for i in range(60)] + [row("r1", "twice", name=None)] * 2, INDEX)
    first.replace(rows)
    assert all(r.difference == 0 for r in first.copy_to(second).collect())
    assert first.differences(second).count() == 0
    changed = rows.filter("file_path = 'p7'").withColumn("embedding", F.expr("array(1f, 0.5f)"))
    second.upsert(changed)
    # Counts are equal, and yet one vector differs.
    assert [(r.repo_name, r.file_path, r.difference) for r in first.differences(second).collect()] == [
        ("r1", "p7", "changed")
    ]
    second.clear("r2")
    second.upsert(spark.createDataFrame([row("r9", "new")], INDEX))
    second.upsert(spark.createDataFrame([row("r1", "twice", name=None)], INDEX))
    kinds = {}
    for r in first.differences(second).collect():
        kinds.setdefault(r.difference, []).append((r.repo_name, r.file_path, r.first_count, r.second_count))
    assert len(kinds["only first"]) == 20 and kinds["only second"] == [("r9", "new", 0, 1)]
    assert sorted(kinds["changed"]) == [("r1", "p7", 1, 1), ("r1", "twice", 2, 3)]


def test_equal_buckets_are_not_looked_into(spark):
    rows = spark.createDataFrame([row("r", f"p{i}") for i in range(30)], INDEX)
    assert content_difference(rows, rows.withColumn("indexed_at", F.current_timestamp())).count() == 0
    assert content_difference(rows, rows.withColumn("language", F.lit(None).cast("string"))).count() == 30
    assert content_difference(rows.limit(0), rows.limit(0)).count() == 0


def test_recall_of_stored_cells(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    store.replace(rows_of(spark, many_texts(600)))
    store.train_cells("small", 12)
    index = store.read("small", cells=True)
    asked = spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(unit(np.random.default_rng(0), 10, 16))],
        "query_id int, embedding array<float>",
    )
    exact = {(r.query_id, r.file_path) for r in multi_query_top_k(index, asked, 5, ["file_path"]).collect()}
    near = store.cells("small").multi_query_top_k(index, asked, 5, 6, ["file_path"])
    assert len({(r.query_id, r.file_path) for r in near.collect()} & exact) > 35
