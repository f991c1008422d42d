import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from lodeseek import ModelSpec
from lodeseek.functions.text import embedding_text, embedding_windows
from lodeseek.operators import inference, topk
from lodeseek.plans.indexing import embed_chunks, embed_windows
from lodeseek.schemas import NATURAL_KEY
from lodeseek.sources.repositories import list_tree, read_files, write_tree
from test_operators import unit

SMALL = ModelSpec("windows", dims=4096)
CHUNKS = "repo_name string, file_path string, chunk_type string, name string, content string, start_line int, end_line int, language string"


def chunk(path, content, kind="file", name="n"):
    return ("r", path, kind, name, content, 1, 9, "go")


@pytest.mark.parametrize("length", [0, 1, 499, 500, 501, 900, 901, 1300, 5003])
def test_windows_cover_the_whole_content(spark, length):
    content = "".join(chr(97 + i * 7 % 26) for i in range(length))
    frame = spark.createDataFrame([chunk("p", content), chunk("p", content, "class", "K")], CHUNKS)
    columns = [F.col(c) for c in ("chunk_type", "name", "content", "file_path", "language")]
    rows = frame.select(embedding_windows(*columns).alias("w"), embedding_text(*columns).alias("t")).collect()
    for r, heading in zip(rows, ["p: ", "go class K: "]):
        assert r.w[0] == r.t == heading + content[:500]
        assert r.w == [heading + content[at : at + 500] for at in range(0, max(1, length - 100), 400)]
        assert r.w[-1].endswith(content[-1:]) and len(r.w) == max(1, -(-(length - 500) // 400) + 1)


def test_a_text_that_only_its_end_finds(spark):
    filler = " ".join(f"word{i % 50}" for i in range(2000))
    rows = [chunk("long.go", filler + " zanzibar quokka nebula"), chunk("other.go", "zanzibar " + filler), chunk("short.go", "word1 word2")]
    chunks = spark.createDataFrame(rows, CHUNKS)
    asked = spark.createDataFrame([(1, "zanzibar quokka nebula")], "query_id int, text string").select(
        "query_id", inference.embed(F.col("text"), SMALL, "query").alias("embedding")
    )
    whole = topk.multi_query_top_k(embed_windows(chunks, SMALL), asked, 3, NATURAL_KEY, windows=True).collect()
    heads = topk.multi_query_top_k(embed_chunks(chunks, SMALL), asked, 3, NATURAL_KEY).collect()
    by_rank = lambda hits: [h.file_path for h in sorted(hits, key=lambda h: h["rank"])]
    assert by_rank(whole)[0] == "long.go" and len(whole) == 3
    assert by_rank(heads)[0] != "long.go"


@pytest.mark.parametrize("block", [64 << 20, 8])
@pytest.mark.parametrize("scores", [4 << 20, 60])
def test_documents_of_many_parts_against_brute_force(spark, monkeypatch, block, scores):
    monkeypatch.setattr(topk, "QUERY_BLOCK_BYTES", block)
    monkeypatch.setattr(topk, "SCORES_AT_ONCE", scores)
    rng = np.random.default_rng(3)
    parts = unit(rng, 400, 6)
    # Document 0 has a third of all parts, and a NULL key is a document as well.
    owner = [0 if i % 3 == 0 else int(rng.integers(1, 40)) for i in range(400)]
    parts[0] = 0.0
    rows = [(None if o == 39 else o, "k", [float(x) for x in p]) for o, p in zip(owner, parts)]
    rows.append((77, "k", [0.0] * 6))
    frame = spark.createDataFrame(rows, "id int, kind string, embedding array<float>").repartition(5)
    questions = unit(rng, 15, 6)
    asked = spark.createDataFrame([(i, [float(x) for x in q]) for i, q in enumerate(questions)], "query_id int, embedding array<float>")
    got = {}
    for r in sorted(topk.multi_query_top_k(frame, asked, 5, ["id", "kind"], windows=True).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.id, r.similarity))
    for q, question in enumerate(questions):
        best = {}
        for o, _, p in rows:
            p = np.float32(p).astype(float)
            norm = np.linalg.norm(p) * np.linalg.norm(np.float32(question).astype(float))
            if norm:
                score = round(float(p @ np.float32(question).astype(float) / norm), 9)
                best[o] = max(best.get(o, -2.0), score)
        expected = sorted(best.items(), key=lambda t: (-t[1], t[0] is None, t[0] or 0))[:5]
        assert [i for i, _ in got[q]] == [i for i, _ in expected]
        assert np.allclose([s for _, s in got[q]], [s for _, s in expected], atol=1e-8)
    everything = topk.multi_query_top_k(frame, asked, 100, ["id", "kind"], windows=True).collect()
    assert len(everything) == 15 * len({r[0] for r in rows})
    assert {r.similarity for r in everything if r.id == 77} == {None}


# --- a cache of scores ---------------------------------------------------------------------


def test_a_second_run_scores_nothing(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = [(i, None if i % 10 == 0 else "hot" if i % 3 else f"t{i % 20}") for i in range(300)]
    frame = spark.createDataFrame(rows, "id int, text string").repartition(4)

    def length(text):
        return F.coalesce(F.length(text), F.lit(-1))

    def never(text):
        return F.raise_error(F.concat(F.lit("scored again: "), F.coalesce(text, F.lit("NULL")))).cast("int")

    first = inference.ScoreCache(spark, path, "int", buckets=4)
    got = first.score(frame, "text", length, "n", run="one")
    assert sorted((r.id, r.n, r.run) for r in got.collect()) == [(i, len(t) if t else -1, "one") for i, t in rows]
    # Forgotten by the session, as at its end, and found again by its place.
    first.forget()
    second = inference.ScoreCache(spark, path, "int", buckets=4)
    again = second.score(frame, "text", never, "n", run="two")
    assert sorted((r.id, r.n, r.run) for r in again.collect()) == [(i, len(t) if t else -1, "one") for i, t in rows]
    more = second.score(spark.createDataFrame([(1, "new"), (2, "hot"), (3, "new")], "id int, text string"), "text", length, "n", run="two")
    assert sorted(map(tuple, more.select("id", "n", "run").collect())) == [(1, 3, "two"), (2, 3, "one"), (3, 3, "two")]
    assert second.score(frame.limit(0), "text", never, "n").count() == 0
    # The stored side is read in its buckets: nothing of it is shuffled.
    assert "Exchange" not in plan_of(second.known())


# --- trees that are written ------------------------------------------------------------------


def test_written_trees_are_listed_and_read(spark, tmp_path):
    rows = [("a", "x/one.py", "print(1)"), ("a", "__init__.py", ""), ("b b", "d/é ü.go", "ö"), ("c", "node_modules/m.js", "x")]
    frame = spark.createDataFrame(rows, "repo_name string, rel_path string, content string")
    root = str(tmp_path / "tree")
    assert write_tree(frame, root) == 4 == write_tree(frame, root)
    listing = list_tree(spark, root).filter("error IS NULL")
    assert sorted((r.repo_name, r.rel_path, r.size) for r in listing.collect()) == [
        ("a", "__init__.py", 0), ("a", "x/one.py", 8), ("b b", "d/é ü.go", 2),
    ]
    listing = spark.createDataFrame(listing.collect(), listing.schema)
    write_tree(frame.filter("repo_name = 'a'").withColumn("content", F.lit(None).cast("string")), root)
    read = {(r.repo_name, r.rel_path): (r.content, r.error is not None) for r in read_files(listing, root, False).collect()}
    assert read[("b b", "d/é ü.go")] == (bytearray("ö".encode()), False)
    assert read[("a", "x/one.py")] == (None, True) == read[("a", "__init__.py")]
