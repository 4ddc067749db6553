"""Connected components of a graph of links, by alternating star contraction on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hybridlake.llm.stored import stored

MAX_ROUNDS = 60


def _stars(edges: DataFrame) -> tuple[int, int]:
    """Size and digest of a set of edges, to see whether a round changed it."""
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("digest")).first()
    return row["n"], row["digest"]


def _hang(sides: DataFrame, small: bool) -> DataFrame:
    """Hang neighbours of each vertex on its least one. ``sides``: (u, v), v a neighbour of u.

    Large star: neighbours above u hang on the least of u and all its neighbours. Small star: u and its neighbours below
    hang on the least of these. The least is a partial aggregate; the join back may split a vertex with many links.
    """
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = sides.join(least, "u")
    if small:
        own = least.where("u > m").select("u", F.col("m").alias("v"))
        return joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own).distinct()
    return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(u, v)`` links of 64-bit vertices → ``(vertex, root)`` for every vertex with a link to another one.

    ``root`` is the least vertex that can be reached. Order, direction and repetition of links do not matter; links of a
    vertex to itself and links with NULL are left out. Each round is written to the shared folder, so lineage stays
    short and a lost executor costs one round at most; no vertex or link passes through the driver.
    """
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = stored(edges, "links")
    before = _stars(edges)
    for _ in range(MAX_ROUNDS):
        if before[0] == 0:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        edges = stored(_hang(_hang(both, small=False), small=True), "links")
        after = _stars(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
