"""A stored index for approximate cosine search: cells around centres, int8 codes scanned first, exact re-rank.

Every vector lies in the cell of its nearest centre. Centres are found through groups of centres, so a vector is compared
with a few groups and their members instead of with all. A cell holds two tables, both partitioned by cell, so cells that no
query probes are not read: ``codes`` (one byte per dimension) and ``vectors``. A code's distance from its vector is known, so
the scan of codes gives a lower and an upper bound of each score; only vectors whose upper bound reaches the query's k-th
best lower bound are read in full. Inside the probed cells the result is exact; what is approximate is the choice of cells.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from hybridlake.schemas import MAX_RESULTS
from hybridlake.sources.store import materialize

PART_ROWS = 8192       # codes of one part of a cell: what one step compares
BLOCK_QUERIES = 2048   # queries that meet one part at once
ROUNDING = 0.0001      # scores are compared after rounding to four digits
TRAINING_ROWS = 65536  # vectors at most that centres are fitted on; all vectors are assigned


def _units(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


@dataclass
class Centres:
    """Unit centres of the cells, and the groups they are found through: as many as the square root of their number."""

    cells: np.ndarray
    groups: np.ndarray
    group_of: np.ndarray
    n_probes: int  # groups that are looked into

    @classmethod
    def of(cls, centres: np.ndarray, n_probes: int = 8, seed: int = 7) -> "Centres":
        """Groups of given centres (at least one), by a few rounds of k-means over the centres alone."""
        cells = _units(np.asarray(centres, dtype=np.float64))
        n = max(1, round(len(cells) ** 0.5))
        groups = cells[np.random.default_rng(seed).choice(len(cells), n, replace=False)]
        group_of = np.zeros(len(cells), dtype=np.int64)
        for _ in range(10):
            group_of = (cells @ groups.T).argmax(axis=1)
            for g in range(n):
                if (group_of == g).any():
                    groups[g] = _units(cells[group_of == g].mean(axis=0))
        return cls(cells, groups, group_of, n_probes)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row: the nearest centre among the members of the nearest groups; ties go to the lower one."""
        x = _units(x)
        if self.n_probes >= len(self.groups):
            return (x @ self.cells.T).argmax(axis=1)
        probed = np.argpartition(-(x @ self.groups.T), self.n_probes - 1, axis=1)[:, :self.n_probes]
        best, cell = np.full(len(x), -2.0), np.zeros(len(x), dtype=np.int64)
        for g in range(len(self.groups)):
            rows, members = np.flatnonzero((probed == g).any(axis=1)), np.flatnonzero(self.group_of == g)
            if len(rows) and len(members):
                near = x[rows] @ self.cells[members].T
                at = near.argmax(axis=1)
                found = near[np.arange(len(rows)), at]
                better = (found > best[rows]) | ((found == best[rows]) & (members[at] < cell[rows]))
                best[rows[better]], cell[rows[better]] = found[better], members[at][better]
        return cell

    def probes(self, x: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` cells nearest to each row, nearest first."""
        return np.argsort(-(_units(x) @ self.cells.T), axis=1, kind="stable")[:, :n]


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Vectors of one length as rows; another length is an error that names both."""
    lengths = np.diff(column.offsets.to_numpy())
    if (lengths != size).any():
        raise ValueError(f"vector of {int(lengths[lengths != size][0])} entries in an index of {size}")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lengths), size)


def usable(df: DataFrame, column: str) -> DataFrame:
    """Rows whose vector is there, not empty, without NULL or non-finite entries, and has a direction."""
    vector = F.col(column).cast("array<double>")
    whole = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return df.where(F.col(column).isNotNull() & (F.size(column) > 0) & whole & F.exists(vector, lambda c: c != 0)).withColumn(column, vector)


class VectorIndex:
    """The index below ``path``."""

    def __init__(self, spark: SparkSession, path: str, centres: Centres):
        self.spark, self.path, self.centres = spark, path, centres

    @staticmethod
    def fit_centres(vectors: DataFrame, n_cells: int, seed: int = 7) -> Centres:
        """k-means by cosine over at most about TRAINING_ROWS vectors."""
        rows = usable(vectors, "embedding").select(array_to_vector("embedding").alias("features"))
        share = min(1.0, TRAINING_ROWS / max(1, rows.count()))
        fitted = KMeans(k=n_cells, distanceMeasure="cosine", seed=seed, maxIter=10).fit(rows.sample(share, seed=seed) if share < 1 else rows)
        return Centres.of(np.array(fitted.clusterCenters()))

    @classmethod
    def build(cls, vectors: DataFrame, path: str, centres: Centres) -> "VectorIndex":
        """Assign all vectors (id, embedding) to cells and write both tables, by cell."""
        spark, size = vectors.sparkSession, centres.cells.shape[1]
        rows = usable(vectors, "embedding").select("id", "embedding")
        schema = T.StructType([rows.schema["id"], *_FIELDS])
        shared = spark.sparkContext.broadcast(astuple(centres))

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres = Centres(*shared.value)
            for batch in batches:
                x = _units(_matrix(batch.column(1), size))
                step = np.maximum(np.abs(x).max(axis=1), 1e-300) / 127
                code = np.rint(x / step[:, None]).astype(np.int8)
                loss = np.linalg.norm(x - code * step[:, None], axis=1)
                flat = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * size, pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(centres.nearest(x).astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()),
                     pa.array(step), pa.array(loss), flat], names=["id", "cell", "code", "step", "loss", "unit"])

        found = materialize(rows.mapInArrow(coded, schema), "coded-vectors")
        sizes = found.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("parts"))
        sizes = materialize(sizes, "cell-sizes")  # one row per cell
        placed = found.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
        placed.select("id", "code", "step", "loss", "part", "cell").repartition("cell", "part").write.partitionBy("cell").parquet(f"{path}/codes")
        placed.select("id", "unit", "cell").repartition("cell", F.pmod(F.xxhash64("id"), F.lit(16))).write.partitionBy("cell").parquet(f"{path}/vectors")
        sizes.write.parquet(f"{path}/cells")
        placed.select("id").limit(0).write.parquet(f"{path}/ids")  # the type of the ids, also where there are none
        return cls(spark, path, centres)

    def probed(self, queries: DataFrame, n_probes: int) -> DataFrame:
        """(qid, unit, cell): queries (qid, embedding) with the cells nearest to each."""
        rows = usable(queries, "embedding").select("qid", "embedding")
        schema = T.StructType([rows.schema["qid"], _UNIT, T.StructField("cells", T.ArrayType(T.IntegerType()))])
        shared, size = self.spark.sparkContext.broadcast(astuple(self.centres)), self.centres.cells.shape[1]

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres = Centres(*shared.value)
            for batch in batches:
                x = _units(_matrix(batch.column(1), size))
                flat = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * size, pa.array(x.ravel()))
                cells = pa.array(centres.probes(x, n_probes).tolist(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), flat, cells], names=["qid", "unit", "cells"])

        return rows.mapInArrow(near, schema).select("qid", "unit", F.explode("cells").alias("cell"))

    def search(self, queries: DataFrame, n_probes: int, k: int = MAX_RESULTS) -> DataFrame:
        """(qid, id, score, rank): the best k vectors of the probed cells, by cosine rounded to four digits, then id."""
        asked = materialize(self.probed(queries, n_probes), "probed")
        touched = [r["cell"] for r in asked.select("cell").distinct().collect()]  # at most the number of centres
        key = self.spark.read.parquet(f"{self.path}/ids").schema["id"].dataType.simpleString()
        in_cells = F.col("cell").isin(touched)
        codes = self.spark.read.schema(f"id {key}, code binary, step double, loss double, part int, cell int").parquet(f"{self.path}/codes").where(in_cells)
        vectors = self.spark.read.schema(f"id {key}, unit array<double>, cell int").parquet(f"{self.path}/vectors").where(in_cells)
        cells = self.spark.read.parquet(f"{self.path}/cells")

        blocks = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("blocks"))
        plan = F.broadcast(cells.join(blocks, "cell"))  # one row per cell
        left = codes.join(plan.select("cell", "blocks"), "cell").withColumn(
            "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("id", "code", "step", "loss", "cell", "part", "block")
        right = asked.join(plan, "cell").withColumn("block", F.pmod(F.xxhash64("qid"), "blocks").cast("int")).withColumn(
            "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("qid", "unit", "cell", "part", "block")
        keys = ["cell", "part", "block"]
        schema = T.StructType([asked.schema["qid"], codes.schema["id"], T.StructField("cell", T.IntegerType()),
                               T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())])
        near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_scan_codes(k), schema)
        near = materialize(near, "near-codes")

        kth = F.get(F.sort_array(F.collect_list("low"), False), k - 1)
        reach = near.groupBy("qid").agg(F.coalesce(kth, F.lit(-2.0)).alias("reach"))
        hopeful = near.join(reach, "qid").where(F.col("high") >= F.col("reach") - ROUNDING).select("qid", "id", "cell")
        units = asked.select("qid", F.col("unit").alias("q"), "cell")
        cosine = F.aggregate(F.zip_with("q", "unit", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        scored = hopeful.join(vectors, ["id", "cell"]).join(units, ["qid", "cell"]).select("qid", "id", F.round(cosine, 4).alias("score"))
        order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("id"))
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


_UNIT = T.StructField("unit", T.ArrayType(T.DoubleType()))
_FIELDS = [
    T.StructField("cell", T.IntegerType()), T.StructField("code", T.BinaryType()), T.StructField("step", T.DoubleType()),
    T.StructField("loss", T.DoubleType()), _UNIT,
]


def _scan_codes(k: int):
    """Per query of a block the codes of a part that may be among its best k: (qid, id, cell, low, high)."""

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["qid", "id", "cell", "low", "high"]
        if not left.num_rows or not right.num_rows:
            return pa.table([right["qid"].slice(0, 0), left["id"].slice(0, 0), pa.array([], pa.int32()), pa.array([], pa.float64()),
                             pa.array([], pa.float64())], names=names)
        units = right["unit"].combine_chunks()
        q = units.flatten().to_numpy().reshape(right.num_rows, -1)
        size = q.shape[1]
        code = np.frombuffer(b"".join(left["code"].to_pylist()), dtype=np.int8).reshape(-1, size)
        score = (code.astype(np.float32) @ q.T.astype(np.float32)).astype(np.float64) * left["step"].to_numpy()[:, None]
        # A unit query moves a score by no more than the code's loss; the rest covers float32 arithmetic.
        slack = left["loss"].to_numpy()[:, None] + 1e-6 * size ** 0.5
        low, high = score - slack, score + slack
        if len(low) > k:
            kth = np.partition(low, len(low) - k, axis=0)[len(low) - k]
            row, of = np.nonzero(high >= kth[None, :] - ROUNDING)
        else:
            row, of = (x.ravel() for x in np.indices(low.shape))
        cell = pa.array(np.full(len(row), left["cell"][0].as_py(), dtype=np.int32))
        return pa.table([right["qid"].take(pa.array(of)), left["id"].take(pa.array(row)), cell, pa.array(low[row, of]), pa.array(high[row, of])],
                        names=names)

    return scan


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package installed
