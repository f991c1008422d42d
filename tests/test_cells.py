import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseek.operators import cells, grid, joins, pooling, topk
from lodeseek.operators.cells import Cells, CellTree, train_cells
from lodeseek.operators.positions import running
from lodeseek.operators.quantising import ProductQuantiser
from test_operators import unit, vector_frame


def clustered(rng, n, dims, around):
    centres = unit(rng, around, dims)
    points = centres[rng.integers(around, size=n)] + 0.15 * rng.normal(size=(n, dims))
    return points / np.linalg.norm(points, axis=1, keepdims=True)


def queries_of(spark, points):
    return vector_frame(spark, points).withColumnRenamed("id", "query_id")


def mean_recall(exact, near):
    return np.mean([r.recall for r in cells.recall(exact, near, ["id"]).collect()])


# --- sums of vectors -------------------------------------------------------------------


@pytest.mark.parametrize("held", [4 << 20, 20])
def test_vector_sums_of_hot_and_many_groups(spark, monkeypatch, held):
    monkeypatch.setattr(pooling, "SUMS_HELD", held)
    rng = np.random.default_rng(0)
    rows, total = [], {}
    for i in range(3000):
        group = (None, "hot")[i % 2] if i % 3 else f"g{i % 500}"
        kind, weight = i % 2 if i % 5 else None, float(i % 4) if i % 7 else None
        vector = None if i % 11 == 0 else [float(x) for x in np.float32(rng.normal(size=3))]
        rows.append((group, kind, weight, vector))
        if vector is not None:
            entry = total.setdefault((group, kind), [np.zeros(3), 0.0, 0])
            entry[0] += np.array(vector) * (weight or 0.0)
            entry[1] += weight or 0.0
            entry[2] += 1
    frame = spark.createDataFrame(rows, "g string, kind int, w double, embedding array<float>").repartition(5)
    # Several batches in every task.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {(r.g, r.kind): r for r in pooling.vector_sums(frame, ["g", "kind"], weight=F.col("w")).collect()}
        unweighted = pooling.vector_sums(frame, ["g"]).agg(F.sum("rows")).first()[0]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert unweighted == sum(t[2] for t in total.values())
    assert set(got) == set(total)
    for key, (vector, weight, count) in total.items():
        assert np.allclose(got[key].total, vector) and got[key].weight == weight and got[key].rows == count
    assert pooling.vector_sums(frame.limit(0), ["g"]).count() == 0
    overall = pooling.vector_sums(frame, []).collect()
    assert len(overall) == 1 and overall[0].rows == sum(t[2] for t in total.values())


def test_sums_do_not_take_vectors_apart(spark):
    frame = vector_frame(spark, np.ones((4, 3)))
    plan = pooling.mean_vectors(frame, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("most, hot", [(1 << 20, 10), (0, 10**6), (0, 50)])
def test_side_joins_on_every_path(spark, how, most, hot):
    rows = [(i, "hot" if i % 3 == 0 else None if i % 31 == 0 else f"k{i % 40}") for i in range(900)]
    side = [(f"k{i}", i) for i in range(0, 40, 2)] + [("hot", -1), ("unused", 5)]
    known = dict(side)
    frame = spark.createDataFrame(rows, "id int, key string").repartition(4)
    got = joins.join_side(
        frame, spark.createDataFrame(side, "key string, value int"), ["key"], 16, how, most, hot, salts=4
    )
    expected = [(k, i, known.get(k)) for i, k in rows if how == "left" or k in known]
    assert sorted(map(str, (tuple(r) for r in got.select("key", "id", "value").collect()))) == sorted(map(str, expected))


def test_running_totals_over_groups_larger_than_a_partition(spark):
    rng = np.random.default_rng(4)
    rows = [(None if i % 9 == 0 else "hot" if i % 3 else f"g{i % 7}", i, int(rng.integers(1 << 40))) for i in range(4000)]
    frame = spark.createDataFrame(rows, "g string, i int, x long").repartition(6)
    totals = {"s": ("sum", "x"), "z": ("xor", "x"), "n": ("sum", F.lit(1))}
    got = {r.i: (r.s, r.z, r.n) for r in running(frame, [F.desc("i")], ["g"], totals).collect()}
    state = {}
    for g, i, x in reversed(rows):
        s, z, n = state.get(g, (0, 0, 0))
        state[g] = (s + x, z ^ x, n + 1)
        assert got.pop(i) == state[g]
    assert not got


def test_rows_meet_what_is_held_for_their_key(spark):
    import pyarrow as pa
    from pyspark.sql import types as T

    held = spark.createDataFrame([(k, k * 10 + n) for k in range(5) for n in range(3)], "key int, v int")
    rows = spark.createDataFrame([(0 if i % 2 else i % 7, i) for i in range(500)], "key int, i int").repartition(4)

    def work(table):
        total = sum(table.column("v").to_pylist())

        def answer(asked):
            yield pa.RecordBatch.from_pydict({"i": asked.column("i").to_pylist(), "t": [total] * asked.num_rows})

        return answer

    got = grid.beside(held, rows, "key", work, T.StructType.fromDDL("i bigint, t bigint"), F.xxhash64("i"), 50)
    expected = {i: 30 * k + 3 for k, i in [(0 if i % 2 else i % 7, i) for i in range(500)] if k < 5}
    assert {r.i: r.t for r in got.collect()} == expected and got.count() == len(expected)


# --- training ---------------------------------------------------------------------------


def test_steps_lower_the_distance_and_restart_where_they_ended(spark):
    rng = np.random.default_rng(1)
    points = clustered(rng, 1500, 8, 6)
    frame = vector_frame(spark, list(points) + [np.zeros(8), None])

    def fit(cells_):
        return (np.float32(points).astype(float) @ cells_.centroids.T).max(axis=1).mean()

    one = Cells.train(frame, 6, iterations=1)
    many = Cells.train(frame, 6, iterations=12)
    assert len(many.centroids) == 6 and fit(one) < fit(many)
    again = Cells.train(frame, 6, first=many, iterations=1)
    assert np.abs(again.centroids - many.centroids).max() < 0.02
    # More cells than distinct vectors, and no vector at all.
    assert len(Cells.train(vector_frame(spark, [points[0]] * 20), 4).centroids) == 1
    assert len(Cells.train(frame.limit(0), 4).centroids) == 0


def test_stored_vectors_are_read_by_the_steps(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(cells, "materialize", lambda df, label, f=cells.materialize: seen.append(label) or f(df, label))
    Cells.train(vector_frame(spark, unit(np.random.default_rng(2), 50, 4)), 3, iterations=4)
    assert seen == ["unit-vectors"]


def test_over_full_cells_are_split(spark):
    rng = np.random.default_rng(3)
    points = clustered(rng, 600, 8, 12)
    frame = vector_frame(spark, list(points) + [None])
    begun = Cells(unit(rng, 2, 8))
    stored = begun.placed(frame)
    split, done = begun.split(stored, 150)
    assert done and len(split.centroids) > 2
    counts = {r.cell: r["count"] for r in split.placed(frame).filter("cell IS NOT NULL").groupBy("cell").count().collect()}
    assert max(counts.values()) < 600 / 2 and sum(counts.values()) == 600
    # Copies of one vector cannot be told apart.
    same = begun.placed(vector_frame(spark, [points[0]] * 50))
    assert begun.split(same, 10)[1] == []


def test_two_levels_beyond_the_bound(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(cells, "CENTROID_BYTES", 8 * 8 * 12)
    rng = np.random.default_rng(5)
    points = clustered(rng, 1200, 8, 30)
    frame = vector_frame(spark, list(points) + [None])
    with pytest.raises(ValueError, match="CellTree"):
        Cells(unit(rng, 40, 8))
    tree = train_cells(frame, 40, iterations=3, groups=6)
    assert isinstance(tree, CellTree)
    numbers = sorted(r.cell for r in tree.cells.collect())
    assert numbers == list(range(len(numbers))) and 30 <= len(numbers) <= 50
    tree.save(str(tmp_path / "tree"), spark)
    tree = CellTree.load(spark, str(tmp_path / "tree"))
    stored = tree.placed(frame)
    assert stored.count() == 1201 and stored.filter("cell IS NULL").count() == 1
    # Every vector is in the nearest cell of its nearest group.
    inner = {}
    for r in tree.cells.collect():
        inner.setdefault(r.group, []).append((r.cell, np.array(r.centroid) / np.linalg.norm(r.centroid)))
    for r in stored.filter("cell IS NOT NULL").limit(200).collect():
        v = np.array(r.embedding) / np.linalg.norm(r.embedding)
        group = int(np.round(tree.groups.centroids @ v, 9).argmax())
        assert r.cell == max(sorted(inner[group]), key=lambda p: round(float(p[1] @ v), 9))[0]
    asked = queries_of(spark, points[:20])
    exact = topk.multi_query_top_k(frame, asked, 5, ["id"])
    near = tree.multi_query_top_k(stored, asked, 5, 8, ["id"])
    assert mean_recall(exact, near) > 0.85
    everything = tree.multi_query_top_k(stored.filter("cell IS NOT NULL"), asked, 5, len(numbers), ["id"])
    assert sorted(map(tuple, everything.collect())) == sorted(map(tuple, exact.collect()))


# --- compressed vectors --------------------------------------------------------------------


def brute_estimates(quantiser, points, query, probed):
    """(estimate, id) of the vectors in probed cells, from written-out sums."""
    found = []
    q = query / np.linalg.norm(query)
    for i, p in enumerate(points):
        if p is None or not np.any(p):
            continue
        p = np.float32(p).astype(float)
        p = p / np.linalg.norm(p)
        cell = int(np.round(quantiser.cells.centroids @ p, 9).argmax())
        if cell in probed:
            rest = (p - quantiser.cells.centroids[cell]).reshape(len(quantiser.codebooks), -1)
            codes = [int(np.round(((b - r) ** 2).sum(1) - (r**2).sum(), 9).argmin()) for r, b in zip(rest, quantiser.codebooks)]
            rebuilt = quantiser.cells.centroids[cell] + np.concatenate([b[c] for b, c in zip(quantiser.codebooks, codes)])
            found.append((-round(float(rebuilt @ q), 9), i))
    return sorted(found)


def test_estimates_equal_written_out_sums(spark, tmp_path):
    rng = np.random.default_rng(6)
    points = list(clustered(rng, 300, 8, 5)) + [np.zeros(8), None]
    frame = vector_frame(spark, points)
    quantiser = ProductQuantiser.train(frame, Cells.train(frame, 5), parts=4, codes=16)
    quantiser.save(spark, str(tmp_path / "codes"))
    quantiser = ProductQuantiser.load(spark, str(tmp_path / "codes"))
    compressed = quantiser.compressed(frame.repartition(3))
    assert compressed.columns == ["id", "cell", "codes"] and compressed.filter("codes IS NULL").count() == 2
    asked = np.float32(unit(rng, 6, 8)).astype(float)
    near = quantiser.candidates(compressed, queries_of(spark, list(asked) + [np.zeros(8)]), 12, 2, ["id"])
    got = {}
    for r in sorted(near.collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.id, r.estimate))
    assert set(got) == set(range(6))
    for n, query in enumerate(asked):
        expected = brute_estimates(quantiser, points, query, quantiser.cells.probed(query, 2))[:12]
        assert np.allclose([-e for e, _ in expected], [e for _, e in got[n]], atol=1e-8)
        assert len({i for _, i in expected} & {i for i, _ in got[n]}) >= 11


def test_compressed_search_finds_nearly_all_of_what_cells_hold(spark):
    rng = np.random.default_rng(7)
    points = clustered(rng, 2000, 16, 20)
    frame = vector_frame(spark, points)
    around = Cells.train(frame, 16)
    quantiser = ProductQuantiser.train(frame, around, parts=8, codes=64)
    asked = queries_of(spark, points[::100])
    exact = topk.multi_query_top_k(frame, asked, 10, ["id"])
    in_cells = around.multi_query_top_k(around.placed(frame), asked, 10, 4, ["id"])
    hits = quantiser.top_k(quantiser.compressed(frame), frame, asked, 10, 4, ["id"])
    assert mean_recall(in_cells, hits) > 0.95
    assert mean_recall(exact, hits) > 0.8
    # Similarities are those of the exact search, not estimates.
    exact_scores = {(r.query_id, r.id): r.similarity for r in exact.collect()}
    assert all(abs(exact_scores[r.query_id, r.id] - r.similarity) < 1e-8
               for r in hits.collect() if (r.query_id, r.id) in exact_scores)
    with pytest.raises(ValueError, match="no vector"):
        ProductQuantiser.train(frame.limit(0), around)
