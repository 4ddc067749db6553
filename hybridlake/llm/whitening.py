"""Whitening of embeddings: covariance on the cluster, eigenvectors refined on the driver from float32 to float64.

The covariance of the distinct quantised vectors is summed where the vectors are. Its eigenvectors are found in float32
and corrected by matrix multiplications in float64 after Ogita and Aishima: each step reads the loss of orthogonality
R = I - X'X and the remaining coupling S = X'VX and moves X by X E. Pairs of eigenvalues too close for a step are
clusters: the covariance restricted to a cluster, shifted by the cluster's mean, is a small problem of its own, solved by
itself, and its solution turns the cluster's vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hybridlake.llm.stored import stored
from hybridlake.llm.texts import fresh

#: One unit of an entry is divided into this many steps.
STEPS = 256
#: Refinement steps at most; each about squares the error, so float32 vectors need two or three.
MOST_STEPS = 30
#: Eigenvalues closer than this times the remaining error are a cluster; wider gaps turn vectors by 1/64 at most.
SAFE_GAP = 32.0


# ---------------------------------------------------------------------------
# Eigenvectors (dimension x dimension, whatever the number of rows)
# ---------------------------------------------------------------------------
def refine(v: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of the symmetric ``v``, from approximate vectors ``x``."""
    v, x = np.asarray(v, dtype=np.float64), np.asarray(x, dtype=np.float64)
    size, unit = len(v), np.eye(len(v))
    scale = float(np.abs(v).max()) if size else 0.0
    if scale == 0.0:
        return np.zeros(size), unit
    v, norm = v / scale, np.linalg.norm(v / scale, 2)
    last = np.inf
    for _ in range(MOST_STEPS):
        r = unit - x.T @ x
        s = x.T @ v @ x
        s, r = (s + s.T) / 2.0, (r + r.T) / 2.0  # rounding must not look like a turn
        values = np.diag(s) / (1.0 - np.diag(r))
        near = 2.0 * (np.linalg.norm(s - np.diag(values), 2) + norm * np.linalg.norm(r, 2))
        if near > last / 2.0:  # quadratic convergence has come to its end
            break
        last = near
        close = SAFE_GAP * near
        gaps = values[None, :] - values[:, None]
        apart = np.abs(gaps) > close
        x = x + x @ np.where(apart, (s + values[None, :] * r) / np.where(apart, gaps, 1.0), r / 2.0)
        _solve_clusters(v, x, values, close)
    values = np.einsum("ij,ij->j", x, v @ x) / np.einsum("ij,ij->j", x, x)
    order = np.argsort(-values, kind="stable")
    x = x[:, order]
    return values[order] * scale, x / np.linalg.norm(x, axis=0)


def _solve_clusters(v: np.ndarray, x: np.ndarray, values: np.ndarray, close: float) -> None:
    """Turn the vectors of each run of eigenvalues not further apart than ``close``, in place."""
    order = np.argsort(-values, kind="stable")
    for cluster in np.split(order, np.flatnonzero(-np.diff(values[order]) > close) + 1):
        if len(cluster) == 1:
            continue
        basis, _ = np.linalg.qr(x[:, cluster])
        middle = float(values[cluster].mean())
        part = basis.T @ (v @ basis - middle * basis)  # only what differs inside the cluster is left
        part = (part + part.T) / 2.0
        width = float(np.abs(part).max())
        if width > len(v) * np.finfo(float).eps:  # else the values are equal as far as float64 tells: any basis serves
            _, turn = np.linalg.eigh(part / width)
            basis = basis @ turn[:, ::-1]
        x[:, cluster] = basis


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and vectors of a covariance: float32 first, then refined in float64."""
    if not len(v):
        return np.zeros(0), np.zeros((0, 0))
    scale = float(np.abs(v).max()) or 1.0
    _, start = np.linalg.eigh((v / scale).astype(np.float32))
    values, vectors = refine(v, start[:, ::-1])
    # Rounding may leave a value of rank-deficient data just below zero.
    return np.maximum(values, 0.0), vectors


# ---------------------------------------------------------------------------
# Distributed sums
# ---------------------------------------------------------------------------
def quantised(df: DataFrame, embedding: str, name: str, steps: int = STEPS) -> DataFrame:
    """Rows whose vector is whole, with ``name``: floor(steps * entry) as longs.

    Dropped: NULL vectors and those with a NULL or non-finite entry. Entries beyond the range of a long take its end.
    """
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    vector = F.col(embedding).cast("array<double>")
    rows = df.where(F.col(embedding).isNotNull() & F.forall(vector, finite))
    return rows.withColumn(name, F.transform(vector, lambda c: F.floor(c * F.lit(float(steps)))))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Longs of a list column as rows; entries that a shorter vector lacks are 0."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


CELLS = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("x", T.DoubleType())])


def _sum_cells(vectors: DataFrame, width: int, centred) -> np.ndarray:
    """Sum over rows of the outer products of ``centred(rows)``; each task sends one number per pair of dimensions."""
    arrow = to_arrow_schema(CELLS)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            y = centred(_matrix(batch.column(0), width))
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            i, j = np.triu_indices(total.shape[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], schema=arrow)

    rows = vectors.mapInArrow(partial, CELLS).groupBy("i", "j").agg(F.sum("x").alias("x")).toArrow()
    size = int(rows.column("i").to_numpy().max()) + 1 if rows.num_rows else 0
    out = np.zeros((size, size))
    i, j = rows.column("i").to_numpy(), rows.column("j").to_numpy()
    out[i, j] = out[j, i] = rows.column("x").to_numpy()
    return out


def _sums(vectors: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of every dimension; each task sends one number per dimension."""
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("s", T.DecimalType(38, 0))])
    arrow = to_arrow_schema(schema)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for batch in batches:
            x = _matrix(batch.column(0), width)
            n += len(x)
            reach = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))
            small = reach * len(x) < 1 << 62
            sums = x.sum(axis=0).tolist() if small else [sum(column) for column in x.T.tolist()]
            total = [a + b for a, b in zip(total, sums)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()),
             pa.array([Decimal(s) for s in total], arrow.field("s").type)], schema=arrow)

    rows = vectors.mapInArrow(partial, schema).groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()
    return rows[0]["n"], [int(r["s"]) for r in rows]


@dataclass
class Whitening:
    """What whitening needs to know of the fit list: size, sums, and the leading components."""

    n: int
    sums: list[int]                # exact, per dimension
    values: np.ndarray             # variances of the components, falling
    vectors: np.ndarray            # components as columns
    trace: float
    identity_error: float = 0.0    # of the whitened fit list, as measured

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Unit-variance coordinates; NaN along components without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return (x.astype(np.float64) - self.mean) @ self.vectors / np.where(self.values > 0, np.sqrt(self.values), np.nan)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n x - S)^2; None where the sum does not fit in a long."""
        reach = max((abs(int(e)) for e in (x.min(initial=0), x.max(initial=0))))
        largest = self.n * reach + max((abs(s) for s in self.sums), default=0)
        if largest ** 2 * max(1, x.shape[1]) < 1 << 63:
            y = x * np.int64(self.n) - np.array(self.sums, dtype=np.int64)
            return np.einsum("ij,ij->i", y, y).tolist()
        exact = [sum((self.n * e - s) ** 2 for e, s in zip(row, self.sums)) for row in x.tolist()]
        return [e if e < 1 << 63 else None for e in exact]


def fit(df: DataFrame, embedding: str = "embedding", components: int = 4, steps: int = STEPS) -> Whitening | None:
    """Whitening of the distinct quantised vectors of ``df``; None if no row has a whole vector.

    Shorter vectors count as filled up with zeros to the longest one. Repeated vectors count once.
    """
    x = fresh(df, "x")
    vectors = quantised(df, embedding, x, steps).select(F.col(x).alias("x"))
    fitted = stored(vectors.distinct(), "whitening")
    width = fitted.agg(F.max(F.size("x"))).first()[0]
    if not width:
        return None
    # Vectors of unequal length that are equal after filling up are one vector.
    if fitted.where(F.size("x") < width).limit(1).count():
        filled = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x")))
        fitted = stored(fitted.select(filled.alias("x")).distinct(), "whitening")
    n, sums = _sums(fitted, width)
    mean = np.array([s / n for s in sums])
    covariance = _sum_cells(fitted, width, lambda m: m.astype(np.float64) - mean) / n
    values, vectors_ = eigen(covariance)
    kept = min(components, width)
    model = Whitening(n, sums, np.where(values > width * np.finfo(float).eps * values.max(initial=0), values, 0.0)[:kept],
                      vectors_[:, :kept], float(np.trace(covariance)))
    live = np.flatnonzero(model.values > 0)
    if len(live):
        centre = _mean_whitened(fitted, width, model)
        spread = _sum_cells(fitted, width, lambda m: (model.whitened(m) - centre)[:, live]) / n
        model.identity_error = float(np.abs(spread - np.eye(len(live))).max())
    return model


def _mean_whitened(vectors: DataFrame, width: int, model: Whitening) -> np.ndarray:
    """Mean of the whitened fit list: zero but for rounding."""
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("x", T.DoubleType())])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(model.values))
        for batch in batches:
            total += np.nan_to_num(model.whitened(_matrix(batch.column(0), width))).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], schema=to_arrow_schema(schema))

    rows = vectors.mapInArrow(partial, schema).groupBy("i").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(len(model.values))
    for r in rows:
        out[r["i"]] = r["x"] / model.n
    return out


def whitened(df: DataFrame, model: Whitening, embedding: str = "embedding", steps: int = STEPS) -> DataFrame:
    """Rows with a whole vector, with ``whitened`` (array<double>, one entry per component) and ``deviation`` (long).

    ``deviation`` is the exact sum over dimensions of (n x - S)^2, NULL where it does not fit in a long. A component
    without variance has NULL. Columns of ``df`` of these names are replaced; all others, repeated rows and NULLs pass.
    """
    kept = [c for c in df.columns if c.lower() not in ("whitened", "deviation")]
    name = fresh(df, "quantised")
    rows = quantised(df, embedding, name, steps).select(*kept, name)
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != name],
                           T.StructField("whitened", T.ArrayType(T.DoubleType())), T.StructField("deviation", T.LongType())])
    arrow, width = to_arrow_schema(schema), len(model.sums)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            x = _matrix(batch.column(name), width)
            values = model.whitened(x).ravel()
            offsets = np.arange(len(x) + 1, dtype=np.int32) * len(model.values)
            lists = pa.ListArray.from_arrays(offsets, pa.array(values, pa.float64(), mask=np.isnan(values)))
            columns = [batch.column(c) for c in kept] + [lists, pa.array(model.deviations(x), pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, arrow)], schema=arrow)

    return rows.mapInArrow(batches, schema)


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    """The first four whitened coordinates of every whole vector."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    model = fit(vectors, components=4)
    if model is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, "
                                         "explained double, identity_error double")
    shares = [float(v / model.trace) if model.trace else 0.0 for v in model.values]
    rows = whitened(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return rows.select(
        "vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(F.array(*[F.lit(s) for s in shares]), F.col("k") + 1).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"))
