"""Approximate neighbours against all distances: recall, share compared, repeated ids and odd rows."""

import numpy as np
import pytest

from hybridlake.llm import neighbours

SCHEMA = "vec_id long, embedding array<double>, score string, LIST int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "s", 1) for i, v in rows], SCHEMA)


def all_distances(rows, queries, k=10):
    """The ``k`` nearest ids of each query id, by every distance."""
    found = {}
    for number, q in queries:
        best = {}
        for i, v in rows:
            if i != number:
                d = float(np.sqrt(((np.array(v) - np.array(q)) ** 2).sum()))
                best[i] = min(d, best.get(i, d))
        found[number] = sorted((d, i) for i, d in best.items())[:k]
    return found


def answers(frame):
    found = {}
    for r in frame.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(found[r["query_id"]])
    return found


def recall(found, exact):
    hits = [len({i for _, i in found.get(q, [])} & {i for _, i in best}) / len(best) for q, best in exact.items()]
    return float(np.mean(hits))


def clustered(n, size, groups, seed):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(groups, size))[rng.integers(groups, size=n)] * 4 + rng.normal(size=(n, size))


@pytest.mark.parametrize("data, most", [
    ("clustered", 0.3), ("gaussian4", 0.5), ("gaussian64", 1.0),
])
def test_recall_and_share(spark, data, most):
    rng = np.random.default_rng(7)
    x = {"clustered": clustered(6000, 32, 40, 7), "gaussian4": rng.normal(size=(6000, 4)),
         "gaussian64": rng.normal(size=(3000, 64))}[data]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    vectors = table(spark, rows)
    found = answers(neighbours.nearest(vectors, vectors.where("vec_id % 100 = 0")))
    exact = all_distances(rows, [r for r in rows if r[0] % 100 == 0])
    assert set(found) == set(exact) and all(len(f) == 10 for f in found.values())
    assert recall(found, exact) >= 0.95
    for q, best in found.items():
        known = {i: d for d, i in all_distances(rows, [rows[q]], len(rows))[q]} if q < 300 else {}
        assert all(known.get(i, d) == pytest.approx(d, rel=1e-12) for d, i in best)
    centroids = neighbours.fit(spark, neighbours.usable(vectors, "vec_id", "embedding"))
    assert centroids.share <= most and centroids.recall >= 0.97


def test_query_recall(spark, sf):
    """The registered query over the whole table, against every distance."""
    kept = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()
            if r["embedding"] is not None and all(c is not None and np.isfinite(c) for c in r["embedding"]) and any(r["embedding"])]
    exact = all_distances(kept, [r for r in kept if r[0] % 100 == 0])
    found = answers(neighbours.op8_neighbours(spark, sf))
    assert set(found) == set(exact) and recall(found, exact) >= 0.95


def test_repeated_ids_count_once(spark):
    """One id holds most rows around the query; the others lie far away and are still found."""
    rng = np.random.default_rng(3)
    near = [(7, (rng.normal(size=8) * 0.01).tolist()) for _ in range(2000)]
    far = [(i, (rng.normal(size=8) + 50 * i).tolist()) for i in (1, 2, 3, 4)]
    rows = [(100, [0.0] * 7 + [0.001]), *near, *far]
    vectors = table(spark, rows)
    found = answers(neighbours.nearest(vectors, vectors.where("vec_id = 100")))
    exact = all_distances(rows, [rows[0]])
    assert [i for _, i in found[100]] == [i for _, i in exact[100]] == [7, 1, 2, 3, 4]
    assert [d for d, _ in found[100]] == pytest.approx([d for d, _ in exact[100]])


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, 0.0]) for i in range(100, 140)] + [(0, [1.0, 0.0]), (1, [2.0, 0.0])]
    vectors = table(spark, rows)
    found = answers(neighbours.nearest(vectors, vectors.where("vec_id % 100 = 0")))
    assert [i for _, i in found[100]] == [0, *range(101, 110)] and {d for d, _ in found[100]} == {0.0}
    assert [i for _, i in found[0]] == list(range(100, 110))


def test_odd_rows_take_no_part(spark):
    rows = [(100, [1.0, 1.0]), (1, [1.0, 2.0]), (2, None), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]),
            (6, [float("inf"), 1.0]), (7, []), (8, [1.0]), (None, [1.0, 1.0]), (200, None), (1, [1.0, 2.0]), (9, [5.0, 1.0])]
    vectors = table(spark, rows)
    found = answers(neighbours.nearest(vectors, vectors.where("vec_id % 100 = 0")))
    assert found == {100: [(1.0, 1), (4.0, 9)]}
    nothing = vectors.where("false")
    assert neighbours.nearest(nothing, nothing).count() == 0
    assert neighbours.nearest(vectors, nothing).count() == 0
    alone = vectors.where("vec_id = 100")
    assert neighbours.nearest(alone, alone).count() == 0


def test_long_lists_and_many_queries_in_blocks(spark, monkeypatch):
    x = clustered(600, 6, 5, 1)
    vectors = table(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    whole = answers(neighbours.nearest(vectors, vectors.where("vec_id % 10 = 0")))
    monkeypatch.setattr(neighbours, "PART_VECTORS", 16)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 4)
    assert answers(neighbours.nearest(vectors, vectors.where("vec_id % 10 = 0"))) == whole
