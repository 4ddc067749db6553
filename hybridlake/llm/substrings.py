"""Substring dedup: words covered by a 13-word window that an earlier document has too are removed.

Pass 1 counts, in a count-min sketch, the documents of each window by its anchor: the least hash among the nine five-word
runs inside the window. Equal windows have equal anchors, so the count of an anchor is never below that of a window; a
run of neighbouring windows shares one anchor, so the sketch has a fifth of the entries. Each task sketches its part;
parts are merged cell by cell in Spark. Pass 2 hands on only windows whose anchor is estimated in two documents or more
and groups these exactly, by 96 bits of their word sequence. The sketch only overestimates, so no window is lost.

The estimate also bounds the groups: windows estimated in fewer than HOT documents are grouped in one place, which then
holds fewer than HOT rows. Of the others, the hot windows, only the least doc_id is wanted, which is aggregated by parts.
A hot window stands for HOT rows or more, so this table is small; up to MOST_HOT windows of it travel to the texts, and
beyond that it is joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from hybridlake.llm.stored import stored
from hybridlake.llm.texts import ascii_words, byte_slices, documents, hashed_words, mixed, odd_numbers, spaced, trimmed

WINDOW = 13
ANCHOR = 5
DEPTH = 2
HOT = 200            # rows of one group at most
MOST_HOT = 2_000_000  # hot windows that travel to the texts, 20 bytes each
BLOCK_CELLS = 1 << 16
#: Bounds of the sketch's width. At the upper one its two bitmaps take 16 MB each; a fuller sketch lets more windows
#: through to the exact pass and changes no result.
LEAST_CELLS, MOST_CELLS = 1 << 18, 1 << 27
#: Anchors a task holds before it hands on a partial sketch.
FLUSH = 2_000_000

#: Windows hashed in one step.
STEP = 1 << 16

SEEDS = odd_numbers(DEPTH, 11)
ANCHOR_KEYS, WINDOW_KEYS = odd_numbers(ANCHOR, 12)[:, None], odd_numbers(2 * WINDOW, 13).reshape(WINDOW, 2)


def run_hashes(words: np.ndarray, at: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Hashes of the runs that start at ``at``, one per column of ``keys``: sums of word hashes times the place's key."""
    runs = np.lib.stride_tricks.sliding_window_view(words, len(keys))
    parts = [runs[at[i:i + STEP]] @ keys for i in range(0, len(at), STEP)]
    return mixed(np.concatenate(parts)) if parts else np.zeros((0, keys.shape[1]), dtype=np.uint64)


def anchors(words: np.ndarray) -> np.ndarray:
    """The anchor of every window of a document given by its word hashes."""
    if len(words) < WINDOW:
        return words[:0]
    least = run_hashes(words, np.arange(len(words) - ANCHOR + 1), ANCHOR_KEYS)[:, 0]
    width, whole = 1, WINDOW - ANCHOR + 1
    while width < whole:  # the least of ``width`` neighbours, from two overlapping halves
        step = min(width, whole - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return least


def window_hashes(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit and a 32-bit hash of the windows that start at ``at``."""
    both = run_hashes(words, at, WINDOW_KEYS)
    return np.ascontiguousarray(both[:, 0]), both[:, 1].astype(np.uint32)


def cells(found: np.ndarray, row: int, width: int) -> np.ndarray:
    return mixed(found ^ SEEDS[row]) & np.uint64(width - 1)


def sketch_width(docs: DataFrame, text: str) -> int:
    """Cells of a sketch row: about eight for each anchor of all texts, within the bounds."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return min(MOST_CELLS, max(LEAST_CELLS, 1 << int(size // 4).bit_length()))


def partial_sketches(docs: DataFrame, width: int, text: str) -> DataFrame:
    """``(block, cells)``: the cells one document each adds to, as 16-bit numbers inside a block of the sketch."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in trimmed(batches):
            for words in hashed_words(batch.column(0)):
                found = np.unique(anchors(words))
                if len(found):
                    held.append(found)
                    size += len(found)
                if size >= FLUSH:
                    yield flushed(held)
                    held, size = [], 0
        if held:
            yield flushed(held)

    def flushed(held: list[np.ndarray]) -> pa.RecordBatch:
        found, numbers, parts = np.concatenate(held), [], []
        for row in range(DEPTH):
            at = np.sort(cells(found, row, width))
            block = at >> np.uint64(16)
            starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
            ends = np.append(starts[1:], len(at))
            inside = (at & np.uint64(BLOCK_CELLS - 1)).astype(np.uint16)
            numbers += (block[starts].astype(np.int64) + row * (width // BLOCK_CELLS)).tolist()
            parts += [inside[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())]
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(parts, pa.binary())], names=["block", "cells"])

    return docs.select(text).mapInArrow(sketch, "block int, cells binary")


def merged_sketch(docs: DataFrame, width: int, text: str) -> dict[int, tuple[bytes, bytes]]:
    """Per block of the sketch the bitmaps of cells counted twice or more, and HOT times or more (b'' if none).

    At most DEPTH * width / 8 bytes of each come to the driver: a bound that does not depend on the corpus.
    """

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[int, np.ndarray] = {}
        for frame in batches:
            for block, part in zip(frame["block"], frame["cells"]):
                if block not in counts:
                    counts[block] = np.zeros(BLOCK_CELLS, dtype=np.uint32)
                np.add.at(counts[block], np.frombuffer(part, dtype=np.uint16), 1)
        for block, n in counts.items():
            hot = np.packbits(n >= HOT).tobytes() if n.max() >= HOT else b""
            yield pd.DataFrame({"block": [block], "twice": [np.packbits(n >= 2).tobytes()], "hot": [hot]})

    blocks = DEPTH * width // BLOCK_CELLS
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks // 128)
    rows = partial_sketches(docs, width, text).repartition(parts, "block").mapInPandas(merge, "block int, twice binary, hot binary")
    return {r["block"]: (bytes(r["twice"]), bytes(r["hot"])) for r in rows.toLocalIterator()}


class Sketch:
    """The merged sketch as two bitmaps per row."""

    def __init__(self, width: int, blocks: dict[int, tuple[bytes, bytes]]) -> None:
        self.width = width
        size, per_row = BLOCK_CELLS // 8, width // BLOCK_CELLS
        self.twice = np.zeros((DEPTH, width // 8), dtype=np.uint8)
        self.hot = np.zeros((DEPTH, width // 8), dtype=np.uint8) if any(h for _, h in blocks.values()) else None
        for block, (twice, hot) in blocks.items():
            row, at = divmod(block, per_row)
            self.twice[row, at * size:(at + 1) * size] = np.frombuffer(twice, dtype=np.uint8)
            if hot:
                self.hot[row, at * size:(at + 1) * size] = np.frombuffer(hot, dtype=np.uint8)

    def estimated(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether anchors are estimated in two documents or more, and in HOT or more: the least of the rows' counts."""
        twice, hot = np.ones(len(found), dtype=bool), np.full(len(found), self.hot is not None)
        for row in range(DEPTH):
            at = cells(found, row, self.width).astype(np.int64)
            byte, bit = at >> 3, (7 - (at & 7)).astype(np.uint8)
            twice &= (self.twice[row, byte] >> bit & 1).astype(bool)
            if self.hot is not None:
                hot &= (self.hot[row, byte] >> bit & 1).astype(bool)
        return twice, hot


def repeated_windows(docs: DataFrame, sketch: Broadcast, text: str, hot: bool) -> DataFrame:
    """``(first, second, doc_id)``: each different window of a document once, if its anchor is estimated in two documents
    or more; only those estimated in HOT or more, or only the others. 96 bits stand for a window's word sequence."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sketch.value
        for batch in trimmed(batches):
            ids, hashed = batch.column(0), hashed_words(batch.column(1))
            for part in byte_slices(batch.column(1)):
                columns: list[list[np.ndarray]] = [[], [], []]
                for i in range(part.start, part.stop):
                    words = next(hashed)
                    twice, often = table.estimated(anchors(words))
                    at = np.flatnonzero(often if hot else twice & ~often)
                    if len(at):
                        one, two = window_hashes(words, at)
                        one, once = np.unique(one, return_index=True)
                        two = two[once]
                        for column, values in zip(columns, (one, two, np.full(len(one), ids[i].as_py()))):
                            column.append(values)
                if columns[0]:
                    one, two, of = map(np.concatenate, columns)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(one.view(np.int64)), pa.array(two.view(np.int32)), pa.array(of.astype(np.int64))],
                        names=["first", "second", "doc_id"])

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text)
    return rows.mapInArrow(windows, "first long, second int, doc_id long")


@dataclass
class HotWindows:
    """Least doc_id of each hot window, by its hashes in order of the first."""

    first: np.ndarray
    second: np.ndarray
    least: np.ndarray

    def earlier(self, words: np.ndarray, at: np.ndarray, doc_id: int) -> np.ndarray:
        """Which of the windows that start at ``at`` stand in a document before ``doc_id``."""
        one, two = window_hashes(words, at)
        place = np.minimum(np.searchsorted(self.first, one), len(self.first) - 1)
        return (self.first[place] == one) & (self.second[place] == two) & (self.least[place] < doc_id)


@dataclass
class Removal:
    """What is to go: ``(doc_id, windows)`` rows, and the hot windows that are looked up where the texts are."""

    windows: DataFrame
    sketch: Broadcast
    hot: Broadcast | None


def windows_to_remove(docs: DataFrame, text: str = "text") -> Removal:
    """The windows of each document that one with a smaller doc_id has too."""
    width = sketch_width(docs, text)
    merged = Sketch(width, merged_sketch(docs, width, text))
    context = docs.sparkSession.sparkContext
    sketch, hot = context.broadcast(merged), None
    earliest = F.min("doc_id").over(Window.partitionBy("first", "second"))
    later = repeated_windows(docs, sketch, text, hot=False).withColumn("least", earliest).where("doc_id > least")
    if merged.hot is not None:
        many = repeated_windows(docs, sketch, text, hot=True)
        least = many.groupBy("first", "second").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
        least = stored(least.where("n > 1").drop("n"), "hot-windows")
        if least.count() <= MOST_HOT:
            hot = context.broadcast(hot_windows(least))
        else:
            later = later.unionByName(many.join(least, ["first", "second"]).where("doc_id > least"))
    return Removal(later.groupBy("doc_id").agg(F.collect_list("first").alias("windows")), sketch, hot)


def hot_windows(least: DataFrame) -> HotWindows | None:
    """At most MOST_HOT rows, as sorted arrays."""
    table = least.toArrow()
    if not len(table):
        return None
    first = table["first"].to_numpy().view(np.uint64)
    order = np.argsort(first, kind="stable")
    return HotWindows(first[order], table["second"].to_numpy().view(np.uint32)[order], table["least"].to_numpy()[order])


def covered(words: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """Whether each word lies in a window that starts at one of ``hit``."""
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(depth, hit, 1)
    np.add.at(depth, hit + WINDOW, -1)
    return np.cumsum(depth)[:-1] > 0


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept`` (the words that stay, joined by one space) beside its columns.

    Windows are judged on the input. Of documents with equal windows, the one with the smallest key keeps them; rows that
    share a key do not count against each other. A row with a NULL key keeps all its words and takes none from others.
    NULL texts have no words; texts below 13 words lose none. Columns of the added names are replaced.
    """
    kept = [c for c in docs.columns if c.lower() not in ("n_words", "n_removed", "kept")]
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    removal = windows_to_remove(plain)
    listed = removal.windows.withColumnRenamed("doc_id", "removal_id")
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).cast("long").alias("removal_key"))
    joined = whole.join(listed, F.col("removal_key") == F.col("removal_id"), "left")
    done = joined.select("row", _cut(removal, F.col("row")[text], F.col("windows"), F.col("removal_key")).alias("cut"))
    return done.select(*[F.col("row")[c].alias(c) for c in kept], "cut.n_words", "cut.n_removed", "cut.kept")


def _cut(removal: Removal, text: Column, windows: Column, key: Column) -> Column:
    sketch, hot = removal.sketch, removal.hot

    def starts(words: np.ndarray, remove: np.ndarray | None, table: HotWindows | None, doc_id: int | None) -> np.ndarray:
        """Where windows to remove start in a document given by its word hashes."""
        found = []
        if remove is not None:
            every = np.arange(len(words) - WINDOW + 1)
            listed = np.asarray(remove, dtype=np.int64).view(np.uint64)
            found.append(np.flatnonzero(np.isin(window_hashes(words, every)[0], listed)))
        if table is not None and doc_id is not None:
            _, often = sketch.value.estimated(anchors(words))
            at = np.flatnonzero(often)
            found.append(at[table.earlier(words, at, doc_id)])
        return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)

    @F.pandas_udf("n_words long, n_removed long, kept string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        table = hot.value if hot else None
        for texts, removals, keys in trimmed(batches):
            rows = []
            for body, hashed, remove, doc_id in zip(texts, hashed_words(pa.array(texts, pa.string(), from_pandas=True)), removals, keys):
                n, lost, kept = len(hashed), 0, None
                if n >= WINDOW and (remove is not None or table is not None):
                    hit = starts(hashed, remove, table, int(doc_id) if doc_id else None)
                    if len(hit):
                        gone = covered(hashed, hit)
                        lost = int(gone.sum())
                        kept = b" ".join([w for w, g in zip(ascii_words(body), gone.tolist()) if not g]).decode("utf-8")
                rows.append((n, lost, (spaced(body, n) if n else "") if kept is None else kept))
            yield pd.DataFrame(rows, columns=["n_words", "n_removed", "kept"])

    # Keys travel as text: a NULL among long values would turn a pandas column into doubles, which lose large ids.
    return cut(text, windows, F.coalesce(key.cast("string"), F.lit("")))


def op10_substrings(spark, sf_dir: str) -> DataFrame:
    """Words of every document, those removed, and the digest of those kept."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
