"""Whitening against dense numpy on the driver."""

import numpy as np
import pytest
from pyspark.sql import types as T

from hybridlake.llm import whitening as wh

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("whitened", T.StringType()), T.StructField("Quantised", T.IntegerType()), T.StructField("x", T.IntegerType())])


def rotation(size, seed=3):
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))[0]


@pytest.mark.parametrize("values", [
    [5.0, 4.0, 3.0, 2.0, 1.0], [1.0, 1.0 - 1e-9, 1.0 - 2e-9, 0.5, 0.5 - 1e-10, 1e-3],
    [2.0, 2.0, 2.0, 1.0], [1.0, 0.0, 0.0], list(1.0 + 1e-8 * np.arange(40)) + list(np.linspace(2, 9, 24)), [0.0, 0.0], [3.0],
])
def test_refinement_separates_clusters(values):
    """Vectors that float32 cannot tell apart come out right to float64."""
    values = np.sort(np.array(values))[::-1]
    q = rotation(len(values))
    v = (q * values) @ q.T
    v = (v + v.T) / 2
    found, x = wh.eigen(v)
    size = max(1.0, abs(values).max()) * len(values)
    assert np.allclose(found, values, rtol=0, atol=1e-14 * size)
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-14 * len(values)
    assert np.abs(v @ x - x * found).max() < 2e-14 * size


def test_float32_alone_is_not_enough():
    values = np.array([1.0, 1.0 - 1e-6, 0.5])
    q = rotation(3)
    v = (q * values) @ q.T
    rough = np.linalg.eigh(v.astype(np.float32))[1][:, ::-1].astype(float)
    _, x = wh.refine(v, rough)
    right = np.abs(np.einsum("ij,ij->j", x, q))
    assert (1 - right).max() < 1e-13
    assert (1 - np.abs(np.einsum("ij,ij->j", rough, q))).max() > 1e-8


def check(rows, data):
    """Every output column against numpy over the vectors of ``data`` (id, vector)."""
    good = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in data
            if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = max(len(x) for _, x in good)
    good = [(i, x + [0] * (width - len(x))) for i, x in good]
    fit = np.array(sorted({tuple(x) for _, x in good}), dtype=np.int64)
    n, sums = len(fit), fit.sum(axis=0)
    y = fit - sums / n
    v = y.T @ y / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(rows) == len(good) * min(4, width)
    expected = {}
    for i, x in good:
        deviation = sum((n * a - int(s)) ** 2 for a, s in zip(x, sums))
        expected.setdefault(i, []).append((deviation, (np.array(x) - sums / n) @ vectors[:, :4] / np.sqrt(values[:4])))
    for k in range(min(4, width)):
        mine = sorted((str(r["vec_id"]), r["deviation"], r["whitened"]) for r in rows if r["component"] == k + 1)
        theirs = sorted((str(i), d, w[k]) for i, group in expected.items() for d, w in group)
        assert [m[:2] for m in mine] == [t[:2] for t in theirs]
        a, b = np.array([m[2] for m in mine]), np.array([t[2] for t in theirs])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9
    for r in rows:
        assert r["n"] == n and abs(r["explained"] - values[r["component"] - 1] / np.trace(v)) < 1e-12
        assert r["identity_error"] < 1e-9
    return fit


def test_query_equals_numpy(spark, sf):
    rows = wh.op12_whitening(spark, sf).collect()
    data = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(rows, data)


def test_odd_vectors(spark, tmp_path):
    """NULLs, non-finite entries, repeats, ties, a shorter vector, negative zero and clashing names."""
    rng = np.random.default_rng(1)
    base = [(i, [float(np.float32(c)) for c in rng.normal(size=5) * [4, 3, 2, 1, 0.5]]) for i in range(60)]
    base += [(60, None), (61, [1.0, None, 0.0, 0.0, 0.0]), (62, [float("nan")] * 5), (63, [float("inf"), 0.0, 0.0, 0.0, 0.0]),
             (64, base[0][1]), (0, base[1][1]), (None, base[2][1]), (65, [-0.0] * 5), (66, [0.0] * 5), (67, [0.5, -0.5])]
    base += [(70 + i, base[3][1]) for i in range(200)]
    table = spark.createDataFrame([(i, v, "s", 1, 2) for i, v in base], SCHEMA)
    table.write.parquet(str(tmp_path / "embeddings.parquet"))
    check(wh.op12_whitening(spark, str(tmp_path)).collect(), base)
    model = wh.fit(table)
    out = wh.whitened(table, model)
    assert out.columns == ["vec_id", "embedding", "Quantised", "x", "whitened", "deviation"] and out.count() == 266


def test_small_and_large_tables(spark, tmp_path):
    """No vectors, one vector, equal vectors, and entries beyond the range of exact products."""
    for name, data in {"none": [], "null": [(1, None)], "one": [(1, [1.0, 2.0])], "equal": [(1, [1.0, 2.0]), (2, [1.0, 2.0])]}.items():
        spark.createDataFrame([(i, v, "s", 1, 2) for i, v in data], SCHEMA).write.parquet(str(tmp_path / name / "embeddings.parquet"))
        rows = wh.op12_whitening(spark, str(tmp_path / name)).collect()
        assert len(rows) == 2 * len([v for _, v in data if v])
        assert all(r["whitened"] is None and r["deviation"] == 0 and r["explained"] == 0.0 for r in rows)
    huge = spark.createDataFrame([(1, [3e38, 0.0], "", 0, 0), (2, [-3e38, 1.0], "", 0, 0), (3, [1.0, 2.0], "", 0, 0)], SCHEMA)
    out = wh.whitened(huge, wh.fit(huge)).collect()
    assert len(out) == 3 and all(r["deviation"] is None or r["deviation"] >= 0 for r in out)


def test_exact_deviation_of_large_entries():
    model = wh.Whitening(3, [7, -(1 << 40)], np.ones(1), np.ones((2, 1)), 1.0)
    x = np.array([[1 << 33, 5], [0, 0], [1 << 62, 0]], dtype=np.int64)
    exact = [(3 * int(a) - 7) ** 2 + (3 * int(b) + (1 << 40)) ** 2 for a, b in x]
    assert model.deviations(x) == [e if e < 1 << 63 else None for e in exact]
