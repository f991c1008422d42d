import hashlib
import re

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import plan_of
from lodeseek import MODELS, ModelSpec, model_spec, register_model
from lodeseek.functions import formatting, text, vectors
from lodeseek.functions.hashing import hash_embed
from lodeseek.functions.text import tokens
from lodeseek.operators import cells, inference, pooling, topk
from lodeseek.operators.positions import batch_groups, exact_percentiles, number_rows
from lodeseek.operators.stats import batch_throughput, latency_stats, throughput_stats


def vector_frame(spark, matrix, start=0):
    rows = [(start + i, None if v is None else [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, "id bigint, embedding array<float>")


def unit(rng, n, dims):
    m = rng.normal(size=(n, dims)).astype(np.float32).astype(np.float64)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


# --- numbering and percentiles ------------------------------------------------------


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_numbering_of_a_hot_group_with_ties(spark, partitions):
    rows = [(None if i % 7 == 0 else "hot" if i % 3 else f"g{i % 5}", i % 4, i) for i in range(2000)]
    frame = spark.createDataFrame(rows, "g string, v int, id int").repartition(partitions)
    got = number_rows(frame, [F.desc("v"), "id"], ["g"], "n").collect()
    groups = {}
    for g, v, i in sorted(rows, key=lambda r: (-r[1], r[2])):
        groups.setdefault(g, []).append(i)
    expected = {i: n for ids in groups.values() for n, i in enumerate(ids, 1)}
    assert {r.id: r.n for r in got} == expected


def test_numbering_of_a_whole_table(spark):
    frame = spark.range(1000).select((F.col("id") % 10).alias("v"), "id").repartition(5)
    got = {r.id: r.position for r in number_rows(frame, ["v", "id"]).collect()}
    order = sorted(range(1000), key=lambda i: (i % 10, i))
    assert got == {i: n for n, i in enumerate(order, 1)}
    assert number_rows(frame.limit(0), ["v", "id"]).count() == 0


def test_percentiles_golden_and_against_the_built_in(spark):
    golden = spark.createDataFrame([("a", x) for x in (9.0, 1.0, 4.0, 2.0)] + [("b", 5.0)], "g string, v double")
    wanted = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    got = {r.g: (round(r.p50, 9), round(r.p95, 9), round(r.p99, 9)) for r in exact_percentiles(golden, "v", wanted, ["g"]).collect()}
    assert got == {"a": (3.0, 8.25, 8.85), "b": (5.0, 5.0, 5.0)}

    # Group 0 holds a third of all rows with one value.
    frame = spark.range(5003).select(
        (F.col("id") % 3).alias("g"),
        F.when(F.col("id") % 3 == 0, F.lit(2.5)).otherwise(F.hash("id") % 5000 / 7).alias("v"),
    )
    mine = exact_percentiles(frame, "v", wanted, ["g"]).orderBy("g").collect()
    built_in = frame.groupBy("g").agg(F.percentile("v", [0.5, 0.95, 0.99]).alias("p")).orderBy("g").collect()
    for m, b in zip(mine, built_in):
        assert np.allclose([m.p50, m.p95, m.p99], b.p, atol=1e-12)


def test_batches(spark):
    frame = spark.range(70).select(F.when(F.col("id") < 50, "a").otherwise("b").alias("repo"), "id")
    got = batch_groups(frame, ["id"], 16, ["repo"]).groupBy("repo", "batch").count().collect()
    assert {(r.repo, r.batch): r["count"] for r in got} == {
        ("a", 0): 16, ("a", 1): 16, ("a", 2): 16, ("a", 3): 2, ("b", 0): 16, ("b", 1): 4,
    }


def test_statistics(spark):
    samples = spark.createDataFrame(
        [(4, "warmup", 999.0)] + [(4, "measure", x) for x in (1.0, 2.0, 4.0, 9.0)],
        "batch_size int, phase string, latency_ms double",
    )
    row = latency_stats(samples).first()
    assert (row.batch_size, row.iterations, row.mean_ms, row.min_ms, row.max_ms) == (4, 4, 4.0, 1.0, 9.0)
    assert row.median_ms == 3.0 and row.throughput == 1000.0
    requests = spark.sql(
        "select 2 as workers, 4 as sentences, timestamp_millis(s) as start_ts, timestamp_millis(e) as end_ts"
        " from values (0, 100), (50, 150), (150, 2000) as t(s, e)"
    )
    row = throughput_stats(requests).first()
    assert (row.total_requests, row.total_sentences, row.total_time_sec, row.throughput) == (3, 12, 2.0, 6.0)
    assert round(row.mean_latency_ms, 6) == 683.333333
    runs = spark.createDataFrame([(1000, 2.0)], "sentences bigint, elapsed_sec double")
    assert tuple(batch_throughput(runs, 16).first())[:3] == (62, 992, 496.0)


# --- top-k ----------------------------------------------------------------------------


def brute_force(docs, queries, k):
    """(query, document) pairs of the k best by rounded cosine, undefined ones last."""
    best = {}
    for q, query in enumerate(queries):
        scored = []
        for d, doc in enumerate(docs):
            known = doc is not None and np.any(doc) and np.any(query)
            score = np.float32(doc).astype(float) @ np.float32(query).astype(float) / (
                np.linalg.norm(np.float32(doc).astype(float)) * np.linalg.norm(np.float32(query).astype(float))
            ) if known else None
            scored.append((score is None, -round(score, 9) if known else 0, d, score))
        best[q] = [(d, s) for _, _, d, s in sorted(scored, key=lambda t: t[:3])[:k]]
    return best


@pytest.mark.parametrize("block, scores", [(64 << 20, 4 << 20), (8 * 8 * 6, 50)])
@pytest.mark.parametrize("partitions", [1, 7])
def test_many_queries_against_brute_force(spark, monkeypatch, block, scores, partitions):
    # The second setting cuts the queries into blocks and the documents into slices.
    monkeypatch.setattr(topk, "QUERY_BLOCK_BYTES", block)
    monkeypatch.setattr(topk, "SCORES_AT_ONCE", scores)
    rng = np.random.default_rng(1)
    docs = list(unit(rng, 300, 8)) + [np.zeros(8), None]
    queries = list(unit(rng, 12, 8)) + [np.zeros(8)]
    # A third of the documents are copies of the best one for query 0.
    docs[:150] = [queries[0]] * 150
    frame = vector_frame(spark, docs).repartition(partitions)
    asked = vector_frame(spark, queries).withColumnRenamed("id", "query_id")
    got = {}
    for r in topk.multi_query_top_k(frame, asked, 6, ["id"]).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.id, r.similarity)
    for q, expected in brute_force(docs, queries, 6).items():
        found = [got[q][i] for i in range(1, 7)]
        assert [d for d, _ in found] == [d for d, _ in expected], q
        assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-8)
                   for (_, a), (_, b) in zip(found, expected))


def test_query_filters_and_short_results(spark):
    rng = np.random.default_rng(2)
    docs = vector_frame(spark, unit(rng, 60, 4)).withColumn("repo_name", F.concat(F.lit("r"), F.col("id") % 3))
    asked = vector_frame(spark, unit(rng, 3, 4)).select(
        F.col("id").alias("query_id"), "embedding",
        F.expr("element_at(array('r1', '', 'nowhere'), cast(id as int) + 1)").alias("repo_name"),
    )
    hits = topk.multi_query_top_k(docs, asked, 30, ["id"], filter_columns=["repo_name"]).collect()
    by_query = {q: [h.id for h in hits if h.query_id == q] for q in range(3)}
    assert len(by_query[0]) == 20 and all(i % 3 == 1 for i in by_query[0])
    assert len(by_query[1]) == 30 and by_query[2] == []


def test_plan_and_driver_do_not_grow_with_the_queries(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK_BYTES", 8 * 8 * 10)
    rng = np.random.default_rng(8)
    docs = vector_frame(spark, unit(rng, 400, 8)).repartition(3)

    def hits(count):
        asked = vector_frame(spark, unit(np.random.default_rng(9), count, 8)).withColumnRenamed("id", "query_id")
        return topk.multi_query_top_k(docs, asked, 4, ["id"])

    def nothing_collected(self):
        raise AssertionError("queries came to the driver")

    frame_type = type(docs)
    with monkeypatch.context() as patched:
        patched.setattr(frame_type, "toArrow", nothing_collected)
        ten_blocks, hundred_blocks = hits(100), hits(1000)
        plans = [re.sub(r"#?\d+L?|lodeseek/\S+", "", plan_of(h)) for h in (ten_blocks, hundred_blocks)]
        assert len(plans[0].splitlines()) == len(plans[1].splitlines())
    monkeypatch.setattr(topk, "QUERY_BLOCK_BYTES", 64 << 20)
    assert sorted(map(tuple, ten_blocks.collect())) == sorted(map(tuple, hits(100).collect()))


@pytest.mark.parametrize("block", [64 << 20, 8])
def test_no_score_of_an_unwanted_pair(spark, monkeypatch, tmp_path, block):
    monkeypatch.setattr(topk, "QUERY_BLOCK_BYTES", block)
    rng = np.random.default_rng(10)
    points, questions = unit(rng, 300, 4), unit(rng, 40, 4)
    docs = vector_frame(spark, points).withColumns(
        {"repo_name": F.concat(F.lit("r"), F.col("id") % 7), "language": F.expr("if(id % 5 = 0, null, concat('l', id % 3))")}
    )
    docs.write.partitionBy("repo_name").parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    asked = vector_frame(spark, questions).select(
        F.col("id").alias("query_id"), "embedding",
        F.concat(F.lit("r"), F.col("id") % 3).alias("repo_name"),
        F.expr("if(id % 4 = 0, null, concat('l', id % 3))").alias("language"),
    )
    wanted = {}
    for q in range(40):
        language = None if q % 4 == 0 else q % 3
        rows = [d for d in range(300) if d % 7 == q % 3 and (language is None or (d % 5 and d % 3 == language))]
        scores = {d: round(float(np.float32(points[d]).astype(float) @ np.float32(questions[q]).astype(float)), 6) for d in rows}
        wanted[q] = sorted(rows, key=lambda d: (-scores[d], d))[:5]
    hits = topk.multi_query_top_k(docs, asked, 5, ["id"], filter_columns=["repo_name", "language"])
    got = {}
    for r in sorted(hits.collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.id)
    assert got == {q: rows for q, rows in wanted.items() if rows}
    assert re.search(r"PartitionFilters: \[[^\]]*repo_name", plan_of(hits))
    # What is multiplied: documents and queries of equal values only.
    search = topk._Search(5, ["id"], "query_id", "embedding", ["repo_name", "language"], None)
    block_of = topk._Asked(search, asked.toArrow())
    held = topk._Held(search, docs.toArrow(), 4)
    pairs = sum(
        len(rows) * len(block_of.groups[names][values])
        for names in block_of.groups for values, rows in held.having(names).items() if values in block_of.groups[names]
    )
    assert pairs == sum(
        1 for q in range(40) for d in range(300)
        if d % 7 == q % 3 and (q % 4 == 0 or (d % 5 and d % 3 == q % 3))
    )


def test_single_query_is_a_prefix_of_the_ranking(spark):
    rng = np.random.default_rng(3)
    docs = vector_frame(spark, unit(rng, 200, 6))
    query = [float(x) for x in unit(rng, 1, 6)[0]]
    ranking = {r.id: r["rank"] for r in topk.rank_all(docs, query, ["id"]).collect()}
    assert sorted(ranking.values()) == list(range(1, 201))
    best = topk.cosine_top_k(docs, query, 15, ["id"]).collect()
    assert [ranking[r.id] for r in best] == list(range(1, 16))
    unit_best = topk.cosine_top_k(docs, query, 15, ["id"], unit=True).collect()
    assert [r.id for r in unit_best] == [r.id for r in best]


def test_other_dimension_is_refused(spark):
    docs = vector_frame(spark, [[1.0, 2.0], [1.0, 2.0, 3.0]])
    with pytest.raises(Exception, match="3 components, not 2"):
        topk.cosine_top_k(docs, [1.0, 0.0], 5, ["id"]).collect()


def test_column_expressions_agree_with_the_scorers(spark):
    rng = np.random.default_rng(4)
    docs = vector_frame(spark, list(unit(rng, 20, 5)) + [np.zeros(5)])
    query = [float(x) for x in np.float32(rng.normal(size=5))]
    v, same = F.col("embedding"), F.array(*[F.lit(x) for x in query])
    for r in docs.select(
        "id", "embedding", vectors.cosine_similarity(v, same).alias("a"), vectors.cosine_to(query)(v).alias("b"),
        vectors.dot(v, same).alias("c"), vectors.dot_to(query)(v).alias("d"),
        vectors.cosine_distance(v, same).alias("e"), vectors.l2_norm(v).alias("n"),
    ).collect():
        assert abs(r.c - np.dot(r.embedding, query)) < 1e-9 and abs(r.c - r.d) < 1e-8
        assert abs(r.n - np.linalg.norm(r.embedding)) < 1e-9
        if r.id == 20:
            assert (r.a, r.b, r.e) == (None, None, None)
        else:
            assert abs(r.a - r.c / r.n / np.linalg.norm(query)) < 1e-8
            assert abs(r.a - r.b) < 1e-8 and abs(r.a + r.e - 1) < 1e-12
    nulls = spark.createDataFrame([(None, [1.0]), ([2.0], None), ([2.0], [3.0]), (None, None)],
                                  "a array<float>, b array<float>")
    assert [r[0] for r in nulls.coalesce(1).select(vectors.dot(F.col("a"), F.col("b"))).collect()] == [None, None, 6.0, None]


def test_all_cells_give_the_exact_result(spark):
    rng = np.random.default_rng(5)
    docs = vector_frame(spark, unit(rng, 400, 8))
    asked = vector_frame(spark, unit(rng, 10, 8)).withColumnRenamed("id", "query_id")
    trained = cells.Cells.train(docs, 7)
    stored = docs.withColumn("cell", trained.assign(F.col("embedding")))
    exact = topk.multi_query_top_k(docs, asked, 5, ["id"])
    whole = trained.multi_query_top_k(stored, asked, 5, 7, ["id"])
    assert sorted(map(tuple, exact.collect())) == sorted(map(tuple, whole.collect()))
    found = cells.recall(exact, trained.multi_query_top_k(stored, asked, 5, 2, ["id"]), ["id"])
    values = [r.recall for r in found.collect()]
    assert len(values) == 10 and 0.2 < np.mean(values) < 1.0


def test_stored_cells_are_pruned(spark, tmp_path):
    rng = np.random.default_rng(6)
    docs = vector_frame(spark, unit(rng, 200, 8))
    trained = cells.Cells(unit(rng, 5, 8))
    trained.write(docs, str(tmp_path / "cells"))
    stored = spark.read.parquet(str(tmp_path / "cells"))
    query = [float(x) for x in unit(rng, 1, 8)[0]]
    near = trained.top_k(stored, query, 5, 2, ["id"])
    assert re.search(r"PartitionFilters: \[[^\]]*cell", plan_of(near))
    everything = trained.top_k(stored, query, 5, 5, ["id"]).drop("cell").collect()
    assert [r.id for r in everything] == [r.id for r in topk.cosine_top_k(docs, query, 5, ["id"]).collect()]


# --- vectors from text -----------------------------------------------------------------


def hashed(text, dims, limit):
    v = np.zeros(dims)
    for word in [w for w in re.split(r"[\W_]+", text.lower()) if w][:limit]:
        h = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
        v[h % dims] += 1 if (h // dims) % 2 == 0 else -1
    n = np.linalg.norm(v)
    return v / n if n else v


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(texts=st.lists(st.text(alphabet="abé Z09,.-\n_", max_size=60), min_size=1, max_size=30))
def test_hash_embedding(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "id int, t string")
    rows = {r.id: r for r in frame.select("id", hash_embed(F.col("t"), 16, 5).alias("v"),
                                          F.size(tokens(F.col("t"), 5)).alias("n")).collect()}
    assert rows.pop(-1).v is None
    for i, text in enumerate(texts):
        expected = hashed(text, 16, 5)
        assert np.allclose(rows[i].v, expected, atol=1e-6)
        assert abs(np.linalg.norm(rows[i].v) - (1 if np.any(expected) else 0)) < 1e-6
        assert rows[i].n == min(5, len([w for w in re.split(r"[\W_]+", text.lower()) if w]))


def test_normalization_and_pooling(spark):
    frame = spark.createDataFrame(
        [(1, [3.0, 4.0], [[1.0, 2.0], [3.0, 6.0], [100.0, 100.0]], [1, 1, 0]), (2, [0.0, 0.0], [[1.0, 2.0]], [0])],
        "id int, v array<float>, t array<array<float>>, m array<int>",
    )
    rows = {r.id: r for r in frame.select(
        "id", vectors.l2_normalize(F.col("v")).alias("u"), vectors.l2_normalize(F.col("v"), False).alias("raw"),
        vectors.pool_tokens(F.col("t"), F.col("m")).alias("p")).collect()}
    assert np.allclose(rows[1].u, [0.6, 0.8]) and rows[2].u == [0.0, 0.0] and rows[1].raw == [3.0, 4.0]
    assert rows[1].p == [2.0, 4.0] and rows[2].p == [0.0, 0.0]

    long = spark.createDataFrame([("a", [1.0, 2.0], 1), ("a", [5.0, 6.0], 0), ("a", [3.0, 4.0], 1), ("b", [1.0, 1.0], 0)],
                                 "g string, embedding array<float>, m int")
    means = pooling.mean_vectors(long, ["g"], mask=F.col("m"))
    assert {r.g: r.embedding for r in means.collect()} == {"a": [2.0, 3.0], "b": [0.0, 0.0]}


# --- models ----------------------------------------------------------------------------


def test_a_models_limit_holds_for_its_own_function_only(spark):
    def make():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    spec = ModelSpec("limited", 2, prefix="doc: ", max_length=3, make_predict_fn=make)
    texts = ["one, two; three four", "one", "", "é1 - ü", None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    cut = [r[0] for r in frame.select(text.first_words(F.concat(F.lit("doc: "), "t"), 3)).collect()]
    assert cut == ["doc: one, two", "doc: one", "doc: ", "doc: é1 - ü", None]
    known = frame.filter("t IS NOT NULL")
    for embedded in (inference.embed(F.col("t"), spec), inference.try_embed(F.col("t"), spec)["embedding"]):
        lengths = [round(r[0][0] / r[0][1]) for r in known.select(embedded.alias("v")).collect()]
        assert lengths == [len(c) for c in cut[:4]]
    whole = ModelSpec("unlimited", 2, make_predict_fn=make)
    assert round(known.select(inference.embed(F.col("t"), whole).alias("v")).first().v[0] * 1000) == 999
    long = spark.createDataFrame([(" ".join(f"w{i}" for i in range(20_000)),)], "t string")
    assert len(long.select(text.first_words(F.col("t"), 8192)).first()[0].split()) == 8192


def test_registered_model(spark):
    def make():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    spec = register_model(ModelSpec("lengths", 2, prefix="ab", query_prefix="", batch_size=3, make_predict_fn=make))
    try:
        assert model_spec("lengths") is spec
        frame = spark.createDataFrame([(t,) for t in ("", "x" * 5)], "t string")
        documents = [r.v for r in frame.select(inference.embed(F.col("t"), "lengths").alias("v")).collect()]
        assert np.allclose(documents, [np.array([2, 1]) / 5**0.5, np.array([7, 1]) / 50**0.5])
        query = frame.select(inference.embed(F.col("t"), "lengths", "query").alias("v")).first().v
        assert np.allclose(query, [0, 1])
    finally:
        del MODELS["lengths"]
    with pytest.raises(ValueError, match="unknown model"):
        model_spec("lengths")


@pytest.mark.parametrize("predict, message", [
    (lambda texts: np.ones((len(texts), 3)), "3 components, not 2"),
    (lambda texts: np.ones((len(texts) + 1, 2)), "1 texts went in, 2 vectors came out"),
])
def test_wrong_model_output(spark, predict, message):
    spec = ModelSpec("wrong", 2, make_predict_fn=lambda: predict)
    frame = spark.createDataFrame([("a",)], "t string")
    with pytest.raises(Exception, match=message):
        frame.select(inference.embed(F.col("t"), spec)).collect()
    row = frame.select(inference.try_embed(F.col("t"), spec).alias("r")).first().r
    assert row.embedding is None and re.search(message, row.error)


def test_one_failing_text_does_not_fail_the_others(spark):
    def make():
        def predict(texts):
            if any("bad" in t for t in texts):
                raise ValueError("cannot")
            return np.array([[1.0, len(t)] for t in texts])

        return predict

    frame = spark.createDataFrame([(i, "bad" if i == 4 else "x" * i) for i in range(10)], "id int, t string")
    result = frame.withColumn("r", inference.try_embed(F.col("t"), ModelSpec("some", 2, make_predict_fn=make)))
    good, bad = inference.split_errors(result, "r")
    assert sorted(r.id for r in good.collect()) == [0, 1, 2, 3, 5, 6, 7, 8, 9]
    assert [(r.id, r.error) for r in bad.collect()] == [(4, "not embedded: cannot")]


def test_equal_inputs_are_scored_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def score(t):
        calls.add(len(t))
        return t.str.len().astype("float64")

    frame = spark.createDataFrame([(i, None if i == 0 else "x" * (i % 4)) for i in range(200)], "id int, t string")
    rows = inference.score_once(frame, "t", score).collect()
    assert sorted((r.id, r.score) for r in rows if r.id) == [(i, float(i % 4)) for i in range(1, 200)]
    assert len(rows) == 200 and calls.value == 5


# --- result text -----------------------------------------------------------------------


def test_bar_golden_cases(spark):
    cases = {1.0: (20, 0), 0.87: (17, 3), 0.049: (0, 20), 0.0: (0, 20), -0.3: (0, 26)}
    frame = spark.createDataFrame([(s,) for s in cases], "s double")
    for r in frame.select("s", formatting.similarity_bar(F.col("s")).alias("b")).collect():
        assert (r.b.count("█"), r.b.count("░")) == cases[r.s]


RESULT_TEXTS = [
    (
        (0.5, "r", "p/q.py", "function", "f", "a\nb", 3, 9),
        "[0.500] ██████████░░░░░░░░░░\n  📁 r/p/q.py :: function f (L3-9)\n  │ a\n  │ b",
    ),
    (
        (-0.125, "r", "p/q.py", "file", None, "", None, 9),
        "[-0.125] ░░░░░░░░░░░░░░░░░░░░░░\n  📁 r/p/q.py\n  │ ",
    ),
    (
        (0.999, "r", "q.go", "file", "", "1\n2\n3\n4\n5\n6\n7\n8", 0, 9),
        "[0.999] ███████████████████░\n  📁 r/q.go\n  │ 1\n  │ 2\n  │ 3\n  │ 4\n  │ 5\n  │ 6\n  │ 7\n  │ 8",
    ),
    (
        (1.0, "r", "q.go", "class", "K", "1\n2\n3\n4\n5\n6\n7\n8\n9\n10", 1, 10),
        "[1.000] ████████████████████\n  📁 r/q.go :: class K (L1-10)\n  │ 1\n  │ 2\n  │ 3\n  │ 4\n  │ 5\n"
        "  │ 6\n  │ 7\n  │ 8\n  │ ... (1 more lines)",
    ),
    (
        (0.25, "r", "q.go", "file", "q.go", "x" * 301, 1, 1),
        "[0.250] █████░░░░░░░░░░░░░░░\n  📁 r/q.go :: file q.go (L1-1)\n  │ " + "x" * 300 + "...",
    ),
    (
        (0.25, "r", "q.go", "file", "q.go", "é" * 299 + "\n\n", 1, 3),
        "[0.250] █████░░░░░░░░░░░░░░░\n  📁 r/q.go :: file q.go (L1-3)\n  │ " + "é" * 299 + "\n  │ ...",
    ),
]


def test_result_texts(spark):
    schema = ("similarity double, repo_name string, file_path string, chunk_type string, name string,"
              " content string, start_line int, end_line int")
    frame = spark.createDataFrame([hit for hit, _ in RESULT_TEXTS], schema)
    got = [r.t for r in frame.coalesce(1).select(formatting.result_text().alias("t")).collect()]
    assert got == [text for _, text in RESULT_TEXTS]


# --- plans -----------------------------------------------------------------------------


def test_top_k_plans(spark, tmp_path):
    rng = np.random.default_rng(7)
    frame = vector_frame(spark, unit(rng, 50, 4)).withColumn("content", F.lit("c")).withColumn("language", F.lit("go"))
    frame.write.parquet(str(tmp_path / "v"))
    stored = spark.read.parquet(str(tmp_path / "v"))
    one = topk.cosine_top_k(stored.select("id", "embedding", "language"), [1.0, 0, 0, 0], 3, ["id"], language="go")
    plan = plan_of(one)
    assert "TakeOrderedAndProject" in plan and "EqualTo(language,go)" in plan and "content:" not in plan
    asked = stored.select(F.col("id").alias("query_id"), "embedding")
    plan = plan_of(topk.multi_query_top_k(stored, asked, 3, ["id"]))
    assert "WindowGroupLimit" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    assert "content:" not in plan


def test_null_groups_and_phases_are_kept_in_statistics(spark):
    frame = spark.createDataFrame(
        [(None, 1.0, "measure"), (None, 3.0, None), (4, 5.0, "warmup"), (4, 7.0, "measure"), (8, None, "measure")],
        "batch_size int, latency_ms double, phase string",
    )
    got = {r.batch_size: (r.iterations, r.median_ms) for r in latency_stats(frame).collect()}
    assert got == {None: (2, 2.0), 4: (1, 7.0), 8: (0, None)}


def test_long_texts_are_embedded_whole(spark):
    words = [f"w{i}" for i in range(2000)]
    frame = spark.createDataFrame([(" ".join(words),), (" ".join(words[:256]),)], "t string")
    whole, first = (np.array(r.v) for r in frame.coalesce(1).select(inference.embed(F.col("t"), "minilm").alias("v")).collect())
    assert whole @ first < 0.9


def test_bytes_that_are_no_text_are_null(spark):
    row = spark.createDataFrame([(bytearray(b"a\xffb"), bytearray("é".encode()))], "x binary, y binary").select(
        text.decoded_text(F.col("x")).alias("x"), text.decoded_text(F.col("y")).alias("y")
    ).first()
    assert tuple(row) == (None, "é")
