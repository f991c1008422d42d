import numpy as np
import pytest

from pyspark.sql import functions as F

from lodeseek.llm.ann_forest import Forest, nearest
from lodeseek.session import load_table


def frame_of(spark, rows):
    return spark.createDataFrame(
        [(*r, 1, "x", 0.5) for r in rows],
        "vec_id long, embedding array<float>, rank int, leaves string, score double",
    )


def brute(rows, k, asks):
    """query -> [(id, score)] over all pairs; an id stands for the nearest of its vectors."""
    fit = [
        (i, np.array(v, dtype=np.float64))
        for i, v in rows
        if i is not None and v and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v)
    ]
    found = {}
    for i, v in fit:
        if asks(i):
            best = found.setdefault(i, {})
            for j, w in fit:
                if j != i:
                    score = float((v * w.astype(np.float32)).sum())
                    best[j] = max(best.get(j, -np.inf), score)
    return {i: sorted(b.items(), key=lambda p: (-p[1], p[0]))[:k] for i, b in found.items()}


def answers(result):
    found = {}
    for r in sorted(result.collect(), key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(found[r.query_id]) == r["rank"]
    return found


def floats(matrix):
    return [[float(x) for x in np.float32(row)] for row in matrix]


@pytest.mark.parametrize("kind", ["isotropic", "clustered", "norms"])
def test_recall_against_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    points = rng.standard_normal((3000, 24))
    if kind == "clustered":
        points = rng.standard_normal((30, 24))[rng.integers(30, size=3000)] * 4 + points * 0.3
    if kind == "norms":
        points *= rng.lognormal(0, 1, (3000, 1))
    rows = list(enumerate(floats(points)))
    got = answers(nearest(frame_of(spark, rows), 10, F.col("vec_id") % 50 == 0))
    wanted = brute(rows, 10, lambda i: i % 50 == 0)
    assert set(got) == set(wanted)
    assert all(len(got[q]) == 10 for q in got)
    assert all(got[q] == sorted(got[q], key=lambda p: (-p[1], p[0])) for q in got)
    hits = [len({i for i, _ in got[q]} & {i for i, _ in wanted[q]}) / 10 for q in wanted]
    assert np.mean(hits) >= 0.9
    exact = {q: dict(brute([(q, rows[q][1]), *[(i, rows[i][1]) for i, _ in got[q]]], 10, lambda i: i == q)[q]) for q in got}
    assert all(abs(exact[q][i] - s) < 1e-12 * max(1, abs(s)) for q in got for i, s in got[q])


def test_query_recall_on_the_given_table(spark):
    from lodeseek.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in load_table(spark, sf, "embeddings").collect()]
    wanted = brute(rows, 20, lambda i: i % 20 == 0)
    got = answers(QUERIES["op13_ann_forest"](spark, sf))
    assert set(got) == set(wanted)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in wanted[q]}) / 20 for q in got]) >= 0.9


def test_a_search_of_everything_is_exact_with_ties_and_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(1)
    one = floats(rng.standard_normal((1, 4)))[0]
    rows = [(i, v) for i, v in enumerate(floats(rng.standard_normal((60, 4))))]
    # Copies under many ids, a repeated row, one id with two vectors.
    rows += [(100 + i, one) for i in range(40)] + [(5, rows[5][1])] * 30 + [(7, one), (None, one)]
    rows += [(200, None), (201, []), (202, [0.0] * 4), (203, [1.0, None, 0.0, 0.0]), (204, [nan, 1.0, 0.0, 0.0]), (220, [inf, 1.0, 0.0, 0.0])]
    got = answers(nearest(frame_of(spark, rows), 20, F.col("vec_id") % 5 == 0, target=1.0))
    wanted = brute(rows, 20, lambda i: i % 5 == 0)
    assert {q: [i for i, _ in got[q]] for q in got} == {q: [i for i, _ in wanted[q]] for q in wanted}


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, 0.0]), (3, [0.5, 0.5]), (4, [2.0, 0.0])]
    ask = F.col("vec_id") == 0
    assert answers(nearest(frame_of(spark, rows), 20, ask)) == {0: [(4, 2.0), (3, 0.5)]}
    assert answers(nearest(frame_of(spark, rows[:1]), 20, ask)) == {}
    empty = nearest(frame_of(spark, []), 20, ask)
    assert empty.columns == ["query_id", "rank", "vec_id", "score"] and empty.count() == 0


def test_forest_visits_every_leaf_once_and_puts_rows_where_their_search_begins():
    rng = np.random.default_rng(2)
    points = rng.standard_normal((4000, 8))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    forest = Forest.fit(points, 40_000, 1.0, trees=3)
    places = forest.leaves(points)
    everything = list(range(forest.filled.size))
    for row, (order, seen) in enumerate(forest.visited(points[:20], 99.0)):
        assert sorted(order) == everything and abs(seen[-1] - 3) < 1e-9
        # A query lies on no side that was crossed: its own leaves come first.
        assert sorted(order[:3]) == sorted(places[row].tolist())
    assert np.allclose(forest.filled.sum(axis=1), 1)
    assert np.bincount(places[:, 0]).max() <= 4000 / 2**forest.levels * 1.5
