"""The stored vector index against all pairs in numpy."""

import numpy as np
import pytest
from pyspark.sql import types as T

from hybridlake.operators import vector_index as vi
from hybridlake.operators.vector_index import Centres, VectorIndex

VECTORS = T.StructType([T.StructField("id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
QUERIES = T.StructType([T.StructField("qid", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))])


def clustered(n, size, clusters, seed, spread=0.25):
    rng = np.random.default_rng(seed)
    middles = np.random.default_rng(99).normal(size=(clusters, size))
    return (middles[rng.integers(clusters, size=n)] + spread * rng.normal(size=(n, size))).astype(np.float32)


def best(x, q, k, allowed=None):
    """[(qid, rank, id, score)] of the best k rows per query, among the rows that ``allowed`` names per query."""
    scores = np.floor((vi._units(q.astype(float)) @ vi._units(x.astype(float)).T) * 1e4 + 0.5) / 1e4
    out = []
    for i, row in enumerate(scores):
        rows = range(len(x)) if allowed is None else allowed[i]
        out += [(i, n + 1, j, row[j]) for n, j in enumerate(sorted(rows, key=lambda j: (-row[j], j))[:k])]
    return out


def hits(df):
    return sorted((r.qid, r["rank"], r.id, r.score) for r in df.collect())


def close(mine, theirs):
    assert [m[:3] for m in mine] == [t[:3] for t in theirs]
    assert np.allclose([m[3] for m in mine], [t[3] for t in theirs], atol=1e-12)


@pytest.mark.parametrize("rows, block", [(8192, 2048), (16, 3)])
def test_exact_inside_the_probed_cells(spark, tmp_path, monkeypatch, rows, block):
    """Parts and query blocks of any size, ties and equal vectors included; with all cells probed the result is exact."""
    monkeypatch.setattr(vi, "PART_ROWS", rows)
    monkeypatch.setattr(vi, "BLOCK_QUERIES", block)
    x = np.concatenate([clustered(300, 16, 9, 1), clustered(20, 16, 9, 1)])  # twenty vectors twice
    q = np.concatenate([clustered(15, 16, 9, 2), x[:3]]).astype(float)
    index = VectorIndex.build(
        spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VECTORS).repartition(3), str(tmp_path / "i"),
        Centres.of(clustered(9, 16, 9, 3)))
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], QUERIES)
    cell, probes = index.centres.nearest(x.astype(float)), index.centres.probes(q, 2)
    inside = [np.flatnonzero(np.isin(cell, p)).tolist() for p in probes]
    close(hits(index.search(asked, 2, 5)), best(x, q, 5, inside))
    close(hits(index.search(asked, 9, 5)), best(x, q, 5))
    assert len(hits(index.search(asked, 9, 400))) == 320 * 18  # more asked for than there are


def test_recall_and_share_on_clustered_vectors(spark, tmp_path):
    """Recall of at least 0.95 with under a fifth of the vectors compared, and far fewer read in full."""
    x, q = clustered(4000, 32, 40, 5), clustered(60, 32, 40, 6)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VECTORS).repartition(4)
    index = VectorIndex.build(table, str(tmp_path / "i"), VectorIndex.fit_centres(table, 48))
    assert len(index.centres.groups) == 7
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q.astype(float))], QUERIES)
    found = {(r[0], r[2]) for r in hits(index.search(asked, 4, 8))}
    right = {(r[0], r[2]) for r in best(x, q, 8)}
    sizes = np.bincount(index.centres.nearest(x.astype(float)), minlength=len(index.centres.cells))
    share = sizes[index.centres.probes(q.astype(float), 4)].sum() / (len(x) * len(q))
    assert len(found & right) / len(right) >= 0.95 and share < 0.2


def test_groups_of_centres_find_the_nearest_ones():
    x, centres = clustered(3000, 24, 200, 1), clustered(400, 24, 200, 2)
    few, all_ = Centres.of(centres, n_probes=8), Centres.of(centres, n_probes=400)
    assert (few.nearest(x.astype(float)) == all_.nearest(x.astype(float))).mean() > 0.95


def test_unprobed_cells_are_not_read(spark, tmp_path):
    x = clustered(200, 8, 6, 1)
    index = VectorIndex.build(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VECTORS), str(tmp_path / "i"),
                              Centres.of(clustered(6, 8, 6, 1)))
    asked = spark.createDataFrame([(0, x[0].astype(float).tolist())], QUERIES)
    plan = index.search(asked, 1, 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_odd_vectors(spark, tmp_path):
    """NULL, empty, zero and non-finite vectors take no part; another length is an error; empty tables give nothing."""
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 0.0]), (7, [None, 1.0]), (8, [0.0, 2.0])]
    centres = Centres.of(np.array([[1.0, 0.0]]))
    index = VectorIndex.build(spark.createDataFrame(rows, VECTORS), str(tmp_path / "i"), centres)
    asked = spark.createDataFrame([(1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0])], QUERIES)
    assert [(r[0], r[2], r[3]) for r in hits(index.search(asked, 3, 9))] == [(1, 1, 0.7071), (1, 8, 0.7071)]
    assert hits(index.search(asked.limit(0), 1)) == []
    with pytest.raises(Exception):  # vector of 3 entries in an index of 2
        VectorIndex.build(spark.createDataFrame([(1, [1.0, 2.0, 3.0])], VECTORS), str(tmp_path / "j"), centres)
    empty = VectorIndex.build(spark.createDataFrame([], VECTORS), str(tmp_path / "k"), centres)
    assert hits(empty.search(asked, 1)) == []
