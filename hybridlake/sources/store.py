"""Parquet sinks of chunks and graph tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hybridlake.operators import graph
from hybridlake.operators.joins import HOT_KEYS, hot_key_join
from hybridlake.schemas import CHUNK
from hybridlake.session import work_dir


_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SCRATCH: ContextVar[list["ChunkStore"] | None] = ContextVar("scratch", default=None)


def write(df: DataFrame, path: str, mode: str = "append", by: tuple[str, ...] = ()) -> None:
    """Write a table densely packed; the shuffle files behind it go as soon as it is written, not when the driver collects garbage."""
    conf = df.sparkSession.conf
    before = conf.get(_FREE, None)
    conf.set(_FREE, "true")
    try:
        df.write.mode(mode).option("compression", "zstd").partitionBy(*by).parquet(path)
    finally:
        conf.unset(_FREE) if before is None else conf.set(_FREE, before)


def aside(df: DataFrame, purpose: str) -> tuple[DataFrame, "ChunkStore"]:
    """Write a table to the shared working folder: the table as it is read back, and its files, to be removed when it has served."""
    spark = df.sparkSession
    files = ChunkStore(spark, work_dir(spark, purpose))
    write(df, files.path, "overwrite")
    return spark.read.schema(df.schema).parquet(files.path), files


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared working folder and read it back: it is computed once. It goes with the ``scratch`` around it."""
    return _kept(*aside(df, purpose))


def _kept(table: DataFrame, files: "ChunkStore") -> DataFrame:
    around = _SCRATCH.get()
    if around is not None:
        around.append(files)
    return table


@contextmanager
def scratch() -> Iterator[None]:
    """What is materialized inside is removed at the end, so nothing that reads it may go out."""
    made: list[ChunkStore] = []
    token = _SCRATCH.set(made)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for files in made:
            files.remove()


def alone(made: Callable[[], DataFrame], purpose: str) -> DataFrame:
    """Write the table that ``made`` gives, and remove what it materialized on the way."""
    with scratch():
        table, files = aside(made(), purpose)
    return _kept(table, files)


def first_of_id(chunks: DataFrame) -> DataFrame:
    """One chunk per id, the same one whatever the partitioning; copies are reduced before the shuffle."""
    values = [c for c in chunks.columns if c != "id"]
    order = F.struct(*[F.array_sort(F.map_entries(c)).alias(c) if c == "metadata" else F.col(c) for c in values])
    return chunks.groupBy("id").agg(F.min_by(F.struct(*values), order).alias("_c")).select(
        "id", *[F.col(f"_c.{c}") for c in values]
    ).select(*chunks.columns)


def new_chunks(chunks: DataFrame, existing: DataFrame) -> DataFrame:
    """Chunks whose id is not stored yet; only the id column of the store is read. A chunk without an id is none.

    Ids alone are counted and meet the stored ones; texts are read for the ids left over, and only those of repeated ids
    are compared. The most frequent ids stay where they are, so copies are reduced before they are shuffled.
    """
    rows = chunks.where(F.col("id").isNotNull())
    copies = rows.groupBy("id").agg(F.count(F.lit(1)).alias("_copies")).join(existing.select("id"), "id", "left_anti")
    copies = materialize(copies, "new-ids")
    once = rows.join(copies.where("_copies = 1").select("id"), "id", "left_semi").select(*chunks.columns)
    many = copies.where("_copies > 1")
    hot = many.orderBy(F.desc("_copies"), "id").limit(HOT_KEYS)
    repeated = hot_key_join(rows, many, "id", hot, ["id"]).select(*chunks.columns)
    return once.unionByName(first_of_id(repeated))


class ChunkStore:
    """Chunks as Parquet. ``source`` and ``source_type`` are columns, so filters reach the scan."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def remove(self) -> None:
        """Delete the files."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def read(self) -> DataFrame:
        if not self.exists():
            return self.spark.createDataFrame([], CHUNK)
        return self.spark.read.schema(CHUNK).parquet(self.path)

    def add(self, chunks: DataFrame) -> None:
        """Append the chunks not stored yet; running it again adds nothing."""
        with scratch():
            given = materialize(chunks.select(*CHUNK.fieldNames()), "incoming-chunks")
            write(new_chunks(given, self.read()), self.path)

    def add_made(self, rows: DataFrame, chunks_of: Callable[[DataFrame], DataFrame], id: Column) -> None:
        """Append the chunks of rows that have an ``id`` of their own each and make one chunk with that id each.

        The stored ids meet the rows, so no text is made, written aside or shuffled for a row that is stored; the first
        load is not shuffled at all.
        """
        rows = rows.where(id.isNotNull())
        if self.exists():
            held = self.read().select(F.col("id").alias("_held"))
            rows = rows.join(held, id == F.col("_held"), "left_anti")
        write(chunks_of(rows), self.path)

    def reset(self) -> None:
        """Empty the store."""
        self.spark.createDataFrame([], CHUNK).write.mode("overwrite").parquet(self.path)

    def replace(self, chunks: DataFrame) -> None:
        """Overwrite the store, also with chunks that are read from it: they are written aside first."""
        with scratch():
            write(materialize(chunks, "replace"), self.path, "overwrite")

    def count(self) -> int:
        return self.read().count()


def store_counts(**tables: DataFrame) -> DataFrame:
    """One status row with the number of rows of each table."""
    counts = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).cast("bigint").alias("n")).select(F.lit(name).alias("name"), "n")
        counts = row if counts is None else counts.unionByName(row)
    pick = lambda name: F.max(F.when(F.col("name") == name, F.col("n"))).alias(name)
    return counts.agg(*[pick(name) for name in tables])


class VectorStore:
    """Vectors of chunks beside their ids, made once when a chunk is new."""

    SCHEMA = "id string, embedding array<float>"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self._files = spark, ChunkStore(spark, path)

    def read(self) -> DataFrame:
        if not self._files.exists():
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self._files.path)

    def add(self, chunks: DataFrame, embed: Callable[[Column], Column]) -> None:
        """Embed and append the chunks (id, text) whose id has no vector yet; only they are embedded."""
        new = chunks.select("id", "text").join(self.read().select("id"), "id", "left_anti")
        write(new.select("id", embed(F.col("text")).cast("array<float>").alias("embedding")), self._files.path)

    def reset(self) -> None:
        self._files.remove()


class RejectStore:
    """Rows that no load could use: (file, line, reason, n, kind), by kind; ``n`` is how often the line stands in the file."""

    SCHEMA = "file string, line string, reason string, n bigint, kind string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self._files = spark, ChunkStore(spark, path)

    def read(self) -> DataFrame:
        if not self._files.exists():
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self._files.path)

    def add(self, rows: DataFrame, kind: str) -> None:
        """Append rows (file, line, reason). Loading a file again adds nothing."""
        rows = rows.groupBy("file", "line", "reason").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(kind))
        held = self.read()
        same = [rows[c].eqNullSafe(held[c]) for c in ("kind", "file", "line", "reason")]
        write(rows.join(held, same, "left_anti"), self._files.path, by=("kind",))


class GraphStore:
    """Facts (by tax year), nodes and edges (by relation) as Parquet, so both prune on read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.parts = {name: ChunkStore(spark, f"{path}/{name}") for name in ("facts", "nodes", "edges")}

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.parts[name].path)

    def add(self, records: DataFrame) -> None:
        """Add records whose id is not stored yet, with their edges and any new node.

        Facts are written last, so a load that broke off is taken up again without doubling anything.
        """
        if self.parts["facts"].exists():
            stored = self.read("facts").select("id")
            records = materialize(records.join(stored, "id", "left_anti"), "new-records")
        new_nodes, new_edges = graph.nodes(records), graph.edges(records)
        if self.parts["nodes"].exists():
            new_nodes = graph.nodes(records, self.read("nodes"))
        if self.parts["edges"].exists():
            held = self.read("edges").select("src", "rel")
            new_edges = new_edges.join(held, ["src", "rel"], "left_anti")
        new_nodes.write.mode("append").parquet(self.parts["nodes"].path)
        new_edges.write.mode("append").partitionBy("rel").parquet(self.parts["edges"].path)
        graph.facts(records).write.mode("append").partitionBy("tax_year").parquet(self.parts["facts"].path)

    def node_count(self) -> int:
        """Number of record nodes."""
        return self.read("facts").count() if self.parts["facts"].exists() else 0
