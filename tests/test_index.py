from datetime import datetime
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from lodeseek import ModelSpec
from conftest import plan_of
from lodeseek.operators.merging import checked, merge_index, reconcile
from lodeseek.operators.topk import with_filters
from lodeseek.operators.stats import index_summary, index_total
from lodeseek.plans import indexing
from lodeseek.plans.indexing import index_tree
from lodeseek.plans.searching import formatted, search, search_many
from lodeseek.schemas import INDEX, INDEX_COLUMNS
from lodeseek.session import materialize, release_stored, shared_dir
from lodeseek.sources import repositories
from lodeseek.sources.index_store import IndexStore
from lodeseek.streaming import refresh
from lodeseek.streaming.refresh import MOST_BATCHES, note_changes, refresh_index, state_tables
from test_sources import tree

SMALL = ModelSpec("small", dims=64, prefix="passage: ", query_prefix="query: ")

FILES = {
    "alpha/a.py": "import os\ndef read_config(path):\n    return open(path)\n\nclass Parser:\n    pass\n",
    "alpha/b.go": "package main // sort numbers quickly",
    "beta/readme.md": "weather report for tomorrow",
    "beta/x.sql": "select count(*) from orders",
}


def row(repo, path, name="f", start=1, content="c", day=1, language="go", end=2, kind="file"):
    return (path, kind, name, content, start, end, [1.0, 0.0], language, datetime(2024, 1, day), "m", repo)


def keyed(df):
    return sorted(
        (r.repo_name, r.file_path, r.name or "", r.start_line or 0, r.content, r.end_line, r.language, r.indexed_at.day)
        for r in df.collect()
    )


def test_merge_updates_three_columns_and_inserts(spark):
    current = spark.createDataFrame(
        [row("r", "a"), row("r", "b", language=None), row("r", "n", name=None)], INDEX
    )
    batch = spark.createDataFrame(
        [
            row("r", "a", content="new", day=5, language="c", end=99),
            row("r", "b", content="new", day=5, language="c"),
            row("r", "n", name=None, content="again", day=5),
            row("r", "z", day=5),
            row("r", "z", day=6, content="later"),
        ],
        INDEX,
    )
    merged = merge_index(current, batch)
    assert merged.columns == INDEX_COLUMNS
    assert keyed(merged) == sorted(
        [
            ("r", "a", "f", 1, "new", 2, "go", 5),
            ("r", "b", "f", 1, "new", 2, None, 5),
            ("r", "n", "", 1, "c", 2, "go", 1),
            ("r", "n", "", 1, "again", 2, "go", 5),
            ("r", "z", "f", 1, "later", 2, "go", 6),
        ],
        key=lambda t: (t[:4], t[4] != "again"),
    )
    # A second time nothing with a full key changes.
    without_null = batch.filter("name is not null")
    once = merge_index(current, without_null)
    assert keyed(merge_index(once, without_null)) == keyed(once)


def test_store_replace_touches_only_its_repositories(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    assert store.read().count() == 0
    store.replace(spark.createDataFrame(
        [row("one", "a"), row("one", "b"), row("we ird:%/name", "c"), row("123", "d")], INDEX))
    store.replace(spark.createDataFrame([row("one", "z")], INDEX))
    assert sorted((r.repo_name, r.file_path) for r in store.read().collect()) == [
        ("123", "d"), ("one", "z"), ("we ird:%/name", "c"),
    ]
    # A repository that was indexed and has nothing left is emptied.
    nothing = spark.createDataFrame([], INDEX)
    store.replace(nothing, spark.createDataFrame([("we ird:%/name",)], "repo_name string"), "m")
    assert sorted(r.repo_name for r in store.read().collect()) == ["123", "one"]
    store.clear("one", "another model")
    assert store.read().count() == 2
    assert store.read("another model").count() == 0


def test_failed_replace_leaves_the_old_index(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    store.replace(spark.createDataFrame([row("one", "a")], INDEX))
    broken = spark.createDataFrame([row("one", "b")], INDEX).withColumn(
        "content", F.raise_error(F.lit("boom")).cast("string")
    )
    with pytest.raises(Exception, match="boom"):
        store.replace(broken)
    assert [r.file_path for r in store.read().collect()] == ["a"]


def test_store_upsert(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    store.upsert(spark.createDataFrame([row("one", "a"), row("two", "b")], INDEX))
    before = {r.f for r in store.read().filter("repo_name = 'two'").select(F.col("_metadata.file_path").alias("f")).collect()}
    store.upsert(spark.createDataFrame([row("one", "a", content="new", day=3), row("one", "c")], INDEX))
    assert [(t[1], t[4]) for t in keyed(store.read())] == [("a", "new"), ("c", "c"), ("b", "c")]
    after = {r.f for r in store.read().filter("repo_name = 'two'").select(F.col("_metadata.file_path").alias("f")).collect()}
    assert before == after


def test_redundant_store(spark, tmp_path):
    first, second = (IndexStore(spark, str(tmp_path / n)) for n in "ab")
    first.replace(spark.createDataFrame([row("one", "a"), row("one", "b"), row("two", "c")], INDEX))
    assert all(r.difference == 0 for r in first.copy_to(second).collect())
    second.clear("two")
    report = {r.repo_name: tuple(r)[1:] for r in reconcile(first.read(), second.read()).collect()}
    assert report == {"one": (2, 2, 0), "two": (1, 0, 1)}


@pytest.mark.parametrize(
    "change, message",
    [
        ({"embedding": "cast(array(1.0) as array<float>)"}, "has not 2 components"),
        ({"embedding": "cast(null as array<float>)"}, "has not 2 components"),
        ({"name": "repeat('x', 256)"}, "name exceeds 255"),
        ({"content": "cast(null as string)"}, "content is NULL"),
    ],
)
def test_refused_rows(spark, change, message):
    good = spark.createDataFrame([row("r", "a", name=None)], INDEX)
    assert checked(good, 2).count() == 1 and checked(good, 2).first().file_path == "a"
    with pytest.raises(Exception, match=message):
        checked(good.withColumns({c: F.expr(e) for c, e in change.items()}), 2).collect()


def test_index_and_search_a_tree(spark, tmp_path):
    root = tree(tmp_path / "src", FILES)
    store = IndexStore(spark, str(tmp_path / "index"))
    assert index_tree(spark, root, store, model=SMALL) == {"files": 4, "chunks": 5, "failed": 0}
    index = store.read("small")
    assert index_total(index).first().chunks == 5
    assert [(r.repo_name, r.chunks) for r in index_summary(index).collect()] == [("alpha", 3), ("beta", 2)]
    hits = search(store, "read config path", limit=2, model=SMALL).collect()
    assert (hits[0].name, hits[0].start_line, hits[0].end_line) == ("read_config", 2, 4)
    assert hits[0].similarity >= hits[1].similarity
    assert "class Parser" not in hits[0].content
    only = search(store, "read config path", model=SMALL, repo_name="beta", language="sql", chunk_type="").collect()
    assert [h.file_path for h in only] == ["x.sql"]

    texts = [r.text for r in formatted(search(store, "weather", model=SMALL)).orderBy("result").collect()]
    assert texts[0].startswith("[0.") and "📁 beta/readme.md :: file readme.md (L1-1)" in texts[0]
    assert len(texts) == 5

    queries = spark.createDataFrame(
        [(1, "read config path", None), (2, "read config path", "beta"), (3, "weather report", "")],
        "query_id bigint, text string, repo_name string",
    )
    many = search_many(store, queries, 2, SMALL)
    assert {(r.query_id, r.similarity) for r in many.collect()} == {
        (r.query_id, r.similarity) for r in search_many(store, queries, 2, SMALL, contents=False).collect()
    }
    one = search(store, "read config path", 2, model=SMALL).collect()
    assert [tuple(h) for h in one] == [
        tuple(r)[2:] for r in many.filter("query_id = 1").orderBy("rank").collect()
    ]
    best = {(r.query_id, r["rank"]): (r.repo_name, r.name) for r in many.collect()}
    assert best[(1, 1)] == ("alpha", "read_config")
    assert {v[0] for k, v in best.items() if k[0] == 2} == {"beta"}
    assert best[(3, 1)] == ("beta", "readme.md")


def test_reindexing_keeps_gone_chunks_until_replaced(spark, tmp_path):
    root = tree(tmp_path / "src", FILES)
    store = IndexStore(spark, str(tmp_path / "index"))
    index_tree(spark, f"{root}/alpha", store, "alpha", SMALL)
    index_tree(spark, f"{root}/beta", store, "beta", SMALL)
    (tmp_path / "src/alpha/a.py").write_text("def other(): pass\n")
    (tmp_path / "src/alpha/b.go").unlink()
    index_tree(spark, f"{root}/alpha", store, "alpha", SMALL)
    names = {r.name for r in store.read("small").filter("repo_name='alpha'").collect()}
    assert names == {"read_config", "Parser", "b.go", "other"}
    index_tree(spark, f"{root}/alpha", store, "alpha", SMALL, replace=True)
    names = {r.name for r in store.read("small").collect()}
    assert names == {"other", "readme.md", "x.sql"}
    # Nothing of the repository is left to index, though a file is still there.
    (tmp_path / "src/alpha/a.py").rename(tmp_path / "src/alpha/a.txt")
    index_tree(spark, root, store, model=SMALL, replace=True)
    assert {r.repo_name for r in store.read().collect()} == {"beta"}


def test_incremental_refresh_equals_one_run(spark, tmp_path):
    root = tree(tmp_path / "src", FILES)
    store = IndexStore(spark, str(tmp_path / "index"))

    def refresh():
        query = refresh_index(spark, root, store, str(tmp_path / "state"), model=SMALL, files_per_batch=2)
        query.awaitTermination()
        assert query.exception() is None

    refresh()
    assert store.read().count() == 5
    tree(tmp_path / "src", {"gamma/new.rb": "puts 1", "alpha/__init__.py": "def late(): pass",
                            "beta/x.sql": "select count(*) from customers"})
    refresh()
    before = store.read().agg(F.max("indexed_at")).first()[0]
    refresh()
    assert store.read().agg(F.max("indexed_at")).first()[0] == before
    whole = IndexStore(spark, str(tmp_path / "whole"))
    index_tree(spark, root, whole, model=SMALL)
    columns = [c for c in INDEX_COLUMNS if c != "indexed_at"]
    got, expected = (sorted(map(str, s.read().select(*columns).collect())) for s in (store, whole))
    assert got == expected and len(got) == 7


def test_number_of_batches_does_not_grow_with_the_changes(spark, tmp_path):
    listing = spark.range(300).select(
        F.concat(F.lit("r"), F.col("id") % 3).alias("repo_name"), F.concat(F.lit("p"), "id").alias("rel_path"),
        F.lit(1).cast("bigint").alias("size"), F.col("id").alias("modified_ns"), F.lit("go").alias("language"),
    )
    tables = state_tables(str(tmp_path / "state"))
    note_changes(listing, *tables, files_per_batch=2, buckets=4)
    assert len(list((tmp_path / "state/changes").glob("*.parquet"))) <= MOST_BATCHES
    assert spark.read.parquet(tables[0]).distinct().count() == 300
    note_changes(listing, *tables, files_per_batch=2, buckets=4)
    assert spark.read.parquet(tables[0]).count() == 300


def test_filters_prune_partitions_and_contents(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    store.replace(spark.createDataFrame([row("one", "a"), row("two", "b")], INDEX))
    found = with_filters(store.read("m"), repo_name="one", language="go", chunk_type="")
    plan = plan_of(found.select("file_path", "embedding"))
    partitions = plan[plan.index("PartitionFilters"):plan.index("PushedFilters")]
    assert "model" in partitions and "repo_name" in partitions
    assert "EqualTo(language,go)" in plan and "content" not in plan[plan.index("ReadSchema"):]
    assert found.count() == 1


def test_buckets_limit_what_an_update_rewrites(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"), buckets=8)
    paths = [f"p{i}" for i in range(40)]
    store.replace(spark.createDataFrame([row("one", p) for p in paths], INDEX))

    def files():
        place = F.col("_metadata.file_path").alias("f")
        return {r.f for r in store.read().select("file_path", place).collect()}

    before = files()
    assert len(before) > 4
    store.upsert(spark.createDataFrame([row("one", "p3", content="new", day=3)], INDEX))
    assert len(files() - before) == 1
    assert {r.file_path: r.content for r in store.read().collect()}["p3"] == "new"
    assert store.read().count() == 40
    # A replacement also empties the buckets it has no rows for.
    store.replace(spark.createDataFrame([row("one", "p1")], INDEX))
    assert [r.file_path for r in store.read().collect()] == ["p1"]
    with pytest.raises(ValueError, match="buckets"):
        IndexStore(spark, str(tmp_path / "index"), buckets=4).upsert(
            spark.createDataFrame([row("one", "p1")], INDEX)
        )


def test_merge_of_many_copies_of_one_key(spark):
    current = spark.createDataFrame([row("r", "a")], INDEX)
    copies = spark.range(20000).select(
        F.lit("a").alias("file_path"), F.lit("file").alias("chunk_type"), F.lit("f").alias("name"),
        F.lit("same").alias("content"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"),
        F.expr("array(1f, 0f)").alias("embedding"), F.lit("go").alias("language"),
        F.lit("2024-02-02").cast("timestamp").alias("indexed_at"), F.lit("m").alias("model"),
        F.lit("r").alias("repo_name"),
    )
    assert [(r.content, r.indexed_at.month) for r in merge_index(current, copies).collect()] == [("same", 2)]


def test_hits_of_many_queries_are_looked_up_by_place(spark, tmp_path):
    # Two rows without a name share their natural key; both are stored, by design.
    store = IndexStore(spark, str(tmp_path / "index"))
    rows = spark.createDataFrame(
        [("r", "a.go", "file", None, f"text {i}", 1, 2, "go", "small", [1.0, float(i)]) for i in range(2)],
        "repo_name string, file_path string, chunk_type string, name string, content string, start_line int,"
        " end_line int, language string, model string, embedding array<float>",
    ).withColumn("indexed_at", F.current_timestamp())
    store.upsert(rows.select(*INDEX_COLUMNS))
    asked = spark.createDataFrame([(1, "text"), (2, "other")], "query_id int, text string")
    two = ModelSpec("small", 2)
    found = search_many(store, asked, 2, two).collect()
    assert sorted((r.query_id, r["rank"]) for r in found) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    for query in (1, 2):
        assert {r.content for r in found if r.query_id == query} == {"text 0", "text 1"}
    assert search_many(store, asked, 2, two, contents=False).count() == 4


def test_an_emptied_repository_is_cleared(spark, tmp_path):
    root = tree(tmp_path / "src", FILES)
    store = IndexStore(spark, str(tmp_path / "index"))
    index_tree(spark, root, store, model=SMALL)
    for path in list((tmp_path / "src" / "alpha").rglob("*")):
        if path.is_file():
            path.rename(tmp_path / f"gone-{path.name}")
    index_tree(spark, root, store, model=SMALL, replace=True)
    assert {r.repo_name for r in store.read().select("repo_name").distinct().collect()} == {"beta"}


def test_a_repository_with_errors_is_not_replaced(spark, tmp_path, monkeypatch):
    root = tree(tmp_path / "src", FILES)
    store = IndexStore(spark, str(tmp_path / "index"))
    index_tree(spark, root, store, model=SMALL)
    before = store.read().filter("repo_name = 'alpha'").count()
    listed = repositories.list_tree

    def with_error(session, *args):
        bad = session.createDataFrame(
            [("alpha", "sub", 0, 0, "no permission")],
            "repo_name string, rel_path string, size bigint, modified_ns bigint, error string",
        )
        return listed(session, *args).filter("repo_name = 'beta'").unionByName(bad)

    monkeypatch.setattr(indexing, "list_tree", with_error)
    counts = index_tree(spark, root, store, model=SMALL, replace=True)
    assert counts["failed"] == 1
    assert store.read().filter("repo_name = 'alpha'").count() == before


def test_a_root_that_is_not_there_fails(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    with pytest.raises(Exception, match="nowhere"):
        index_tree(spark, str(tmp_path / "nowhere"), store, "alpha", SMALL, replace=True)


def test_a_file_that_failed_is_tried_again(spark, tmp_path, monkeypatch):
    root = tree(tmp_path / "src", FILES)
    store = IndexStore(spark, str(tmp_path / "index"))
    reading = repositories.read_files

    def failing(listing, *args):
        bad = F.col("rel_path").endswith(".sql")
        return reading(listing, *args).withColumns(
            {
                "error": F.when(bad, "busy").otherwise(F.col("error")),
                "content": F.when(~bad, F.col("content")),
            }
        )

    def run():
        query = refresh_index(spark, root, store, str(tmp_path / "state"), model=SMALL)
        query.awaitTermination()
        return {r.file_path for r in store.read().collect()}

    monkeypatch.setattr(refresh, "read_files", failing)
    assert "x.sql" not in run() and "x.sql" not in run()
    monkeypatch.setattr(refresh, "read_files", reading)
    assert "x.sql" in run()
    noted = spark.read.parquet(str(tmp_path / "state" / "changes")).count()
    run()
    assert spark.read.parquet(str(tmp_path / "state" / "changes")).count() == noted


def test_stored_results_are_released(spark):
    release_stored(spark)
    kept = materialize(spark.range(5).toDF("id"), "five")
    folder = Path(urlparse(kept.inputFiles()[0]).path).parent
    assert kept.count() == 5 and folder.exists()
    assert release_stored(spark) == 1 and not folder.exists()


class NoFolder:
    """A session on a cluster whose administrator has named no shared folder."""

    class conf:
        get = staticmethod(lambda key, default: default)

    class sparkContext:
        master = "spark://host:7077"


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(NoFolder)
    NoFolder.sparkContext.master = "local[2]"
    assert shared_dir(NoFolder) == shared_dir(NoFolder)
