"""Approximate nearest neighbours over balanced posting lists.

Centroids come from a bounded sample by recursive balanced splits. Every vector goes to its nearest list, and a vector
near a boundary also to the next lists. A query finds its nearest centroids by best-first search on a graph of centroids
held in memory, keeps those whose distance is within a ratio of the nearest, and is compared with their lists exactly.
Which vectors are near a boundary and which lists are read is measured on the sample: of several boundary ratios, with the
search ratio that each needs for the recall wanted, the pair that compares the fewest vectors.
Long lists are cut into parts and many queries into blocks, so no task holds more than one part and one block.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from hybridlake.llm.stored import stored

TOP = 10
#: The centroids are fitted on the sample of least hashes; never more than this many vectors and numbers.
SAMPLE_VECTORS, SAMPLE_NUMBERS = 20_000, 4_000_000
MOST_CENTROIDS = 2048
REPLICAS = 4             # lists of a boundary vector
#: A further list's distance over the nearest one's, below which a vector also stands there; 1 is one list for each.
BOUNDARY_RATIOS = (1.0, 1.02, 1.05, 1.1, 1.2)
RECALL = 0.98            # of the sample's neighbours, what the search ratio has to reach
FIT_QUERIES = 256        # rows of the sample that are searched to measure it
EDGES = 24               # neighbours of a centroid in the graph
PART_VECTORS, BLOCK_QUERIES = 4096, 4096


@dataclass
class Centroids:
    """Centres and the graph over them: bounded by MOST_CENTROIDS, whatever the corpus.

    ``share`` is the part of the sample that a query is compared with, replicas included, ``recall`` what it finds.
    """

    centres: np.ndarray
    edges: np.ndarray
    entries: np.ndarray
    boundary: float = 1.0
    ratio: float = float("inf")
    share: float = 1.0
    recall: float = 1.0

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, (x ** 2).sum(1)[:, None] + (self.centres ** 2).sum(1)[None, :] - 2 * x @ self.centres.T))

    def lists_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and list of each entry: the nearest list, and up to REPLICAS within the boundary ratio."""
        d = self.distances(x)
        nearest = np.argsort(d, axis=1, kind="stable")[:, :REPLICAS]
        near = np.take_along_axis(d, nearest, axis=1)
        keep = near < self.boundary * near[:, :1]
        keep[:, 0] = True
        rows, at = np.nonzero(keep)
        return rows, nearest[rows, at]

    def search(self, query: np.ndarray, ratio: float) -> list[tuple[float, int]]:
        """Centroids within ``ratio`` of the nearest one, nearest first, by best-first search along the graph.

        The search goes on while the next centroid to visit could still be within the ratio.
        """
        seen = np.zeros(len(self.centres), dtype=bool)
        seen[self.entries] = True
        d = np.sqrt(((self.centres[self.entries] - query) ** 2).sum(1))
        found = [(float(x), int(i)) for x, i in zip(d, self.entries)]
        open_ = list(found)
        heapq.heapify(open_)
        best = min(found)[0]
        while open_:
            at, node = heapq.heappop(open_)
            if at > best * ratio and len(found) > 2 * EDGES:
                break
            new = self.edges[node][~seen[self.edges[node]]]
            if len(new) == 0:
                continue
            seen[new] = True
            for x, i in zip(np.sqrt(((self.centres[new] - query) ** 2).sum(1)).tolist(), new.tolist()):
                found.append((x, i))
                heapq.heappush(open_, (x, i))
                best = min(best, x)
        return sorted(f for f in found if f[0] <= best * ratio)


def balanced_centres(x: np.ndarray, n: int, seed: int = 5) -> np.ndarray:
    """About ``n`` centres by splitting the largest cluster in two equal halves along its widest axis between two means."""
    rng = np.random.Generator(np.random.PCG64(seed))
    heap = [(-len(x), 0, np.arange(len(x)))]
    order = 1
    while len(heap) < n and -heap[0][0] >= 2:
        _, _, members = heapq.heappop(heap)
        points = x[members]
        a, b = points[rng.integers(len(points))], points.mean(axis=0)
        for _ in range(4):
            side = points @ (a - b) - (a @ a - b @ b) / 2
            upper = side > np.median(side)
            if not upper.any() or upper.all():
                upper = np.arange(len(points)) < len(points) // 2
            a, b = points[upper].mean(axis=0), points[~upper].mean(axis=0)
        for half in (members[upper], members[~upper]):
            heapq.heappush(heap, (-len(half), order, half))
            order += 1
    centres = np.stack([x[m].mean(axis=0) for _, _, m in heap])
    d = (centres ** 2).sum(1)[None, :] - 2 * x @ centres.T
    nearest = d.argmin(axis=1)  # one round of means of what is nearest
    sums = np.zeros_like(centres)
    np.add.at(sums, nearest, x)
    counts = np.bincount(nearest, minlength=len(centres))
    full = counts > 0
    centres[full] = sums[full] / counts[full, None]
    return np.unique(centres, axis=0)


def centroid_graph(centres: np.ndarray) -> Centroids:
    """Each centroid's nearest ones, and entry points that lie apart from each other."""
    d = (centres ** 2).sum(1)[None, :] - 2 * centres @ centres.T + (centres ** 2).sum(1)[:, None]
    np.fill_diagonal(d, np.inf)
    edges = np.argsort(d, axis=1, kind="stable")[:, :min(EDGES, max(1, len(centres) - 1))]
    entries = [int(((centres - centres.mean(axis=0)) ** 2).sum(1).argmin())]
    while len(entries) < min(16, len(centres)):
        entries.append(int(np.min([((centres - centres[e]) ** 2).sum(1) for e in entries], axis=0).argmax()))
    return Centroids(centres, edges, np.unique(entries))


def tuned(centroids: Centroids, x: np.ndarray, k: int = TOP) -> Centroids:
    """The centroids with the boundary and search ratios that reach RECALL on the sample ``x`` at the least share compared.

    A neighbour is found if one of its lists is read, so the ratio a query needs for it is the least over its lists. All
    vectors lie closer together than the sample's, so their nearest are found at least as often.
    """
    k = min(k, len(x) - 1)
    if k < 1:
        return centroids
    chosen = np.linspace(0, len(x) - 1, min(len(x), FIT_QUERIES)).astype(int)
    asked = x[chosen]
    d = (x ** 2).sum(1)[None, :] - 2 * asked @ x.T
    d[np.arange(len(chosen)), chosen] = np.inf
    true = np.argpartition(d, k - 1, axis=1)[:, :k]
    to_lists = centroids.distances(asked)
    ratios = to_lists / np.maximum(to_lists.min(axis=1, keepdims=True), 1e-300)
    ratios[np.arange(len(chosen)), to_lists.argmin(axis=1)] = 1.0
    best = None
    for boundary in BOUNDARY_RATIOS:
        tried = replace(centroids, boundary=boundary)
        pairs = [(row + at, to) for at in range(0, len(x), 1024) for row, to in [tried.lists_of(x[at:at + 1024])]]
        rows, to = (np.concatenate(column) for column in zip(*pairs))
        lists = np.full((len(x), REPLICAS), -1)
        lists[rows, np.arange(len(rows)) - np.searchsorted(rows, rows)] = to
        of = lists[true]
        needed = np.where(of >= 0, ratios[np.arange(len(chosen))[:, None, None], of], np.inf).min(axis=2)
        ratio = float(np.quantile(needed, RECALL, method="higher")) * (1 + 1e-9)
        sizes = np.bincount(to, minlength=len(centroids.centres))
        share = float(((ratios <= ratio) @ sizes).mean() / len(x))
        if best is None or share < best.share:
            best = replace(tried, ratio=ratio, share=share, recall=float((needed <= ratio).mean()))
    return best


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``(vec_id, v)``: vectors with a key, finite, not zero, and of the commonest length (of two, the larger)."""
    v = F.col(vector).cast("array<double>")
    finite = lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))  # noqa: E731  NaN is larger than infinity here
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", finite) & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (size["n"] if size else 0)).dropDuplicates(["vec_id", "v"])


def fit(spark: SparkSession, rows: DataFrame) -> Centroids | None:
    """Centroids from the bounded sample; about the square root of all vectors, at most MOST_CENTROIDS."""
    n = rows.count()
    if n == 0:
        return None
    size = rows.select(F.size("v").alias("n")).first()["n"]
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(SAMPLE_VECTORS, max(1, SAMPLE_NUMBERS // size)))
    x = np.unique(np.array([r["v"] for r in sample.select("v").collect()]), axis=0)
    centres = balanced_centres(x, min(MOST_CENTROIDS, max(1, int(n ** 0.5) // 2), max(1, len(x) // 4)))
    return tuned(centroid_graph(centres), x)


def posting_lists(spark: SparkSession, rows: DataFrame, centroids: Centroids) -> DataFrame:
    """``(list, vec_id, v)``: every vector in its nearest list, boundary vectors in several."""
    shared = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for at in range(0, len(frame), 1024):
                part = frame.iloc[at:at + 1024]
                row, to = shared.value.lists_of(np.stack(part["v"]))
                yield pd.DataFrame({"list": to.astype("int32"), "vec_id": part["vec_id"].to_numpy()[row], "v": part["v"].to_numpy()[row]})

    return rows.mapInPandas(assign, "list int, vec_id long, v array<double>")


def nearest(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = TOP,
            ratio: float | None = None) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``queries`` its ``k`` nearest rows of ``vectors`` found.

    ``score`` is the Euclidean distance in double precision; ties go to the smaller vec_id, and a row is no neighbour of
    its own id. Vectors that are NULL, zero, not finite or of another length than most take no part, nor do rows without
    an id; a repeated id counts once, with its nearest vector, and a query id with several vectors asks with each. A query
    reads the lists within ``ratio`` of its nearest, by default the ratio measured on the sample; one that found fewer than
    ``k`` there reads all lists, so with ``k`` candidates or fewer all are returned. No vectors or queries give an empty table.
    """
    spark = vectors.sparkSession
    rows = stored(usable(vectors, key, vector), "vectors")
    centroids = fit(spark, rows)
    if centroids is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = usable(queries, key, vector).where(F.size("v") == centroids.centres.shape[1])
    index = stored(posting_lists(spark, rows, centroids), "posting-lists")
    sizes = {r["list"]: r["n"] for r in index.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # one per centroid
    probes = stored(_probes(spark, asked, centroids, sizes, centroids.ratio if ratio is None else ratio, k), "probes")
    found = stored(_ranked(spark, index, sizes, probes, k), "found")

    full = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = asked.join(full, "vec_id", "left_anti")
    if short.isEmpty():
        return found
    every = F.explode(F.lit(sorted(sizes)).cast("array<int>"))
    all_lists = stored(short.select(every.alias("list"), F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "short-probes")
    return found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").select(*found.columns).unionByName(
        _ranked(spark, index, sizes, all_lists, k))


def _ranked(spark: SparkSession, index: DataFrame, sizes: dict[int, int], probes: DataFrame, k: int) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest ids of each query in the lists it reads."""
    asking = {r["list"]: r["n"] for r in probes.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = {i: -(-n // PART_VECTORS) for i, n in sizes.items()}
    blocks = {i: -(-n // BLOCK_QUERIES) for i, n in asking.items()}
    plan = spark.createDataFrame([(i, parts[i], blocks[i]) for i in asking if i in parts], "list int, parts int, blocks int")
    cut = lambda to, *by: F.pmod(F.xxhash64(*by), F.col(to)).cast("int")
    all_of = lambda to: F.explode(F.sequence(F.lit(0), F.col(to) - 1))
    held = index.join(F.broadcast(plan), "list").select(
        "list", cut("parts", "vec_id", "v").alias("part"), all_of("blocks").alias("block"), "vec_id", "v")
    asked_of = probes.join(F.broadcast(plan), "list").select(
        "list", all_of("parts").alias("part"), cut("blocks", "query_id", "q").alias("block"), "query_id", "q")

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return closest(left, right, k)

    keys = ["list", "part", "block"]
    found = held.groupBy(*keys).cogroup(asked_of.groupBy(*keys)).applyInPandas(compare, "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _probes(spark, asked: DataFrame, centroids: Centroids, sizes: dict[int, int], ratio: float, k: int) -> DataFrame:
    """``(list, query_id, q)``: the lists each query reads."""
    shared = spark.sparkContext.broadcast((centroids, sizes))

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph, held = shared.value
        for frame in batches:
            to, of = [], []
            for row, q in enumerate(frame["v"]):
                near = [i for _, i in graph.search(q, ratio)]
                if sum(held.get(i, 0) for i in near) < REPLICAS * (k + 1):
                    near = [i for _, i in graph.search(q, float("inf"))]
                    count = np.cumsum([held.get(i, 0) for i in near])
                    near = near[:int(np.searchsorted(count, REPLICAS * (k + 1))) + 1]
                to += near
                of += [row] * len(near)
            yield pd.DataFrame({"list": np.array(to, dtype="int32"), "query_id": frame["vec_id"].to_numpy()[of], "q": frame["v"].to_numpy()[of]})

    return asked.mapInPandas(pick, "list int, query_id long, q array<double>")


def closest(held: pd.DataFrame, asked: pd.DataFrame, k: int) -> pd.DataFrame:
    """The nearest ids of one part for each query of one block, by the exact distance of their nearest vector."""
    columns = {"query_id": [], "vec_id": [], "score": []}
    if len(held) and len(asked):
        x, ids = np.stack(held["v"]), held["vec_id"].to_numpy()
        repeated = len(np.unique(ids)) < len(ids)
        squares = (x ** 2).sum(1)
        for number, q in zip(asked["query_id"], asked["q"]):
            other = ids != number
            if repeated:  # k rows may be fewer ids
                at = np.flatnonzero(other)
            else:
                rough = squares - 2 * (x @ q) + q @ q
                rough[~other] = np.inf
                n = min(k, len(rough)) - 1
                edge = np.partition(rough, n)[n]
                at = np.flatnonzero((rough <= edge + 1e-9 * (squares.max() + q @ q)) & other)
            exact = np.sqrt(((x[at] - q) ** 2).sum(1))
            best = np.lexsort((ids[at], exact))
            if repeated:
                best = best[np.sort(np.unique(ids[at][best], return_index=True)[1])]
            best = best[:k]
            columns["query_id"] += [number] * len(best)
            columns["vec_id"] += ids[at][best].tolist()
            columns["score"] += exact[best].tolist()
    return pd.DataFrame(columns).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def op8_neighbours(spark, sf_dir: str) -> DataFrame:
    """The ten nearest found of every vector whose id is divisible by 100, against all others."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))
