"""Benchmark decontamination: suffix arrays over shards of the training texts, searched with every test suffix.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased. A window is a run of
``window`` words of a benchmark item, or all words of a shorter item. The benchmark is cut into blocks of a bounded
number of words; one block travels to the training texts, which are never shuffled. Each task cuts its texts into shards,
sorts the suffixes of a shard into a suffix array, and looks every test suffix up in it by binary search: the range
found holds all places of its window, and the neighbours of the whole suffix inside the range its longest match.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hybridlake.llm.stored import stored
from hybridlake.llm.texts import byte_slices, documents, fresh

WINDOW = 10
#: Words of one block of the benchmark: the bound of what is broadcast.
BLOCK_WORDS = 1 << 20
#: UTF-8 bytes of the texts of one shard; a longer text is a shard of its own.
SHARD_BYTES = 8 << 20

_WORD_BYTES = bytes(
    ord(chr(b).lower()) if chr(b).isascii() and chr(b).isalnum() else b if b >= 0x80 else 0x20 for b in range(256)
)


def plain_words(text: str | None) -> list[bytes]:
    """Runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z, as UTF-8; none for NULL."""
    return text.encode("utf-8").translate(_WORD_BYTES).split() if text else []


class TestBlock:
    """Some benchmark items: numbered words, and their windows with the items that each stands in.

    ``words`` holds the pieces of all items, a 0 after each. A window is (start, length); equal windows are one, and
    windows of the same items share one entry of ``item_lists``.
    """

    __test__ = False  # not a test case

    def __init__(self, pieces: list[tuple[str, list[bytes]]], window: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        numbers, suffixes = [], []
        for item, words in pieces:
            first, size = len(numbers), min(window, len(words))
            numbers += [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            suffixes += [(first + i, size, len(words) - i, item) for i in range(len(words) - size + 1)]
            numbers.append(0)
        self.words = np.array(numbers or [0], dtype=np.int32)
        found: dict[bytes, int] = {}
        items: list[set[str]] = []
        windows, window_of = [], []
        for start, size, _, item in suffixes:
            at = found.setdefault(self.words[start:start + size].tobytes(), len(found))
            if at == len(windows):
                windows.append((start, size))
                items.append(set())
            items[at].add(item)
            window_of.append(at)
        self.starts, self.sizes = np.array(windows, dtype=np.int64).reshape(-1, 2).T
        lists: dict[tuple[str, ...], int] = {}
        self.list_of = np.array([lists.setdefault(tuple(sorted(s)), len(lists)) for s in items], dtype=np.int64)
        self.item_lists = list(lists)
        #: Every test suffix that starts a window: where it starts, the words to the end of its piece, window, item.
        self.suffix_starts = np.array([s[0] for s in suffixes], dtype=np.int64)
        self.suffix_words = np.array([s[2] for s in suffixes], dtype=np.int64)
        self.suffix_windows = np.array(window_of, dtype=np.int64)
        self.suffix_items = [s[3] for s in suffixes]
        #: The shortest window that starts with each word: shorter runs of known words hold none.
        self.least = np.full(len(self.vocabulary) + 1, np.iinfo(np.int32).max, dtype=np.int64)
        if windows:
            np.minimum.at(self.least, self.words[self.starts], self.sizes)
        self.deepest = int(self.suffix_words.max()) if suffixes else 0


def test_blocks(benchmark: DataFrame, item: str, text: str, window: int, block_words: int) -> Iterator[TestBlock]:
    """The benchmark in blocks of at most about ``block_words`` words; the driver holds one partition and one block.

    A longer item is cut into pieces that share ``window`` - 1 words, so no window is lost.
    """
    block_words = max(block_words, window)
    held, n = [], 0
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t"))
    for row in rows.toLocalIterator():
        words = plain_words(row["t"])
        for at in range(0, max(1, len(words) - window + 1), block_words - window + 1):
            piece = words[at:at + block_words]
            if n and n + len(piece) > block_words:
                yield TestBlock(held, window)
                held, n = [], 0
            if piece:
                held.append((row["i"], piece))
                n += len(piece)
    yield TestBlock(held, window)


test_blocks.__test__ = False


class Shard:
    """The suffix array of some texts, over those suffixes that can start a window of the block."""

    def __init__(self, texts: list[str | None], block: TestBlock) -> None:
        known = block.vocabulary.get
        parts, counts = [], []
        for text in texts:
            words = plain_words(text)
            counts.append(len(words))
            parts.append(np.fromiter(map(known, words, repeat(0)), dtype=np.int32, count=len(words)))
            parts.append(np.zeros(1, dtype=np.int32))
        self.counts = np.array(counts, dtype=np.int64)
        #: First word of each text; the texts are divided by a 0, which no test suffix holds.
        self.first = np.concatenate([[0], np.cumsum(self.counts + 1)])[:-1].astype(np.int64)
        self.words = np.concatenate([*parts, np.zeros(block.deepest + 1, dtype=np.int32)])
        n = len(self.words)
        at = np.arange(n, dtype=np.int64)
        gap = np.minimum.accumulate(np.where(self.words == 0, at, n)[::-1])[::-1]
        suffixes = np.flatnonzero((self.words > 0) & (gap - at >= block.least[self.words]))
        self.order = self._sorted(suffixes, block)

    def _sorted(self, suffixes: np.ndarray, block: TestBlock) -> np.ndarray:
        """Suffixes in order of their words, as deep as the longest test suffix.

        Several words make one sort key. Suffixes that share a key are sorted again by the following words, inside
        the places that they hold together.
        """
        bits = max(1, int(len(block.vocabulary)).bit_length())
        step = max(1, 62 // bits)
        order = suffixes.copy()
        slots = np.arange(len(order))
        group = np.zeros(len(order), dtype=np.int64)
        for depth in range(0, block.deepest, step):
            if not len(slots):
                break
            live = order[slots]
            key = np.zeros(len(live), dtype=np.int64)
            for j in range(depth, depth + step):
                key = (key << bits) | self.words[np.minimum(live + j, len(self.words) - 1)]
            by = np.argsort(key, kind="stable") if depth == 0 else np.lexsort((key, group))
            order[slots] = live[by]
            key, group = key[by], group[by]
            new = np.ones(len(key), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
            number = np.cumsum(new)
            again = np.bincount(number)[number] > 1
            slots, group = slots[again], number[again]
        return order

    def _less(self, at: np.ndarray, starts: np.ndarray, sizes: np.ndarray, block: TestBlock, or_equal: bool) -> np.ndarray:
        """Whether the suffix at each place of the array is less than a test suffix, as deep as its size."""
        less = np.full(len(at), or_equal)
        live = np.arange(len(at))
        place = self.order[at]
        for depth in range(block.deepest):
            live = live[sizes[live] > depth]
            if not len(live):
                break
            mine, theirs = self.words[place[live] + depth], block.words[starts[live] + depth]
            differ = mine != theirs
            less[live[differ]] = (mine < theirs)[differ]
            live = live[~differ]
        return less

    def _bound(self, low, high, starts, sizes, block: TestBlock, or_equal: bool) -> np.ndarray:
        low, high = low.copy(), high.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) // 2
            less = self._less(middle, starts[open_], sizes[open_], block, or_equal)
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
            open_ = open_[low[open_] < high[open_]]
        return low

    def ranges(self, block: TestBlock) -> tuple[np.ndarray, np.ndarray]:
        """For every window the range of the suffix array that holds its places."""
        firsts = self.words[self.order]
        wanted = block.words[block.starts]
        low, high = np.searchsorted(firsts, wanted, "left"), np.searchsorted(firsts, wanted, "right")
        low = self._bound(low, high, block.starts, block.sizes, block, False)
        return low, self._bound(low, high, block.starts, block.sizes, block, True)

    def places(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, place) of every occurrence."""
        sizes = high - low
        window = np.repeat(np.arange(len(low)), sizes)
        inside = np.arange(len(window)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return window, self.order[low[window] + inside]

    def text_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, places, "right") - 1

    def longest(self, block: TestBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(test suffix, words, place) of the longest match of every test suffix whose window occurs.

        The suffix next to the place where the whole test suffix would stand shares the most words with it.
        """
        low, high = self.ranges(block)
        low, high = low[block.suffix_windows], high[block.suffix_windows]
        hit = np.flatnonzero(low < high)
        low, high = low[hit], high[hit]
        starts, sizes = block.suffix_starts[hit], block.suffix_words[hit]
        stand = self._bound(low, high, starts, sizes, block, False)
        best, where = np.zeros(len(hit), dtype=np.int64), np.zeros(len(hit), dtype=np.int64)
        for beside in (np.maximum(stand - 1, low), np.minimum(stand, high - 1)):
            place = self.order[beside]
            shared, live = np.zeros(len(hit), dtype=np.int64), np.arange(len(hit))
            while len(live):
                depth = shared[live]
                live = live[(depth < sizes[live])]
                depth = shared[live]
                live = live[self.words[place[live] + depth] == block.words[starts[live] + depth]]
                shared[live] += 1
            better = shared > best
            best[better], where[better] = shared[better], place[better]
        return hit, best, where


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _shard_hits(texts: list[str | None], block: TestBlock, unions: dict) -> tuple[np.ndarray, list, list]:
    """Words, hit spans [start, end) and sorted items of each text."""
    shard = Shard(texts, block)
    window, places = shard.places(*shard.ranges(block))
    spans: list[list] = [[] for _ in texts]
    items: list[list] = [[] for _ in texts]
    if len(places):
        edge = np.bincount(places, minlength=len(shard.words) + 1).astype(np.int64)
        edge -= np.bincount(places + block.sizes[window], minlength=len(shard.words) + 1)
        hit = np.cumsum(edge) > 0
        turn = np.flatnonzero(np.diff(hit, prepend=False))
        text = shard.text_of(turn[::2])
        for t, start, end in zip(text, turn[::2] - shard.first[text], turn[1::2] - shard.first[text]):
            spans[t].append((int(start), int(end)))
        pairs = np.unique(shard.text_of(places) * len(block.item_lists) + block.list_of[window])
        text, lists = pairs // len(block.item_lists), pairs % len(block.item_lists)
        cuts = np.flatnonzero(np.diff(text)) + 1
        for t, group in zip(text[np.concatenate([[0], cuts])], np.split(lists, cuts)):
            key = tuple(group.tolist())
            if key not in unions:
                if len(unions) > 10_000:
                    unions.clear()
                unions[key] = sorted(set().union(*[block.item_lists[i] for i in key]))
            items[t] = unions[key]
    return shard.counts, spans, items


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, keep: list[str] | None = None, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs`` (its columns ``keep``, all by default) with what it shares with the benchmark.

    Adds ``n_words`` (long), ``hits`` (word spans [start, end) that windows cover, in order, none touching) and ``items``
    (ids of the items with a window there, as sorted strings), in place of columns of those names. NULL and empty texts
    have no words and no hits; an item without words has no window, rows of equal item id are one item, and a NULL
    item id is the empty string. Rows are judged one by one: repeated rows and ids, ties and NULLs in other columns
    change nothing. An empty table on either side gives no rows, or no hits.
    """
    kept = [c for c in (keep or docs.columns) if c.lower() not in ("n_words", "hits", "items")]
    source = fresh(docs, "scanned_text")
    found = docs.select(*kept, F.col(text).alias(source))
    sc = docs.sparkSession.sparkContext
    state = [T.StructField("n_words", T.LongType()), T.StructField("hits", SPANS), T.StructField("items", T.ArrayType(T.StringType()))]
    blocks = test_blocks(benchmark, item, item_text, window, block_words)
    block, first = next(blocks), True
    while block is not None:
        following = next(blocks, None)
        if not first:  # the texts pass once per block; what the blocks before found goes with them
            found = stored(found, "contamination")
        fields = [f for f in found.schema.fields if f.name not in ("n_words", "hits", "items")]
        if following is None:
            fields = [f for f in fields if f.name != source]
        schema = T.StructType([*fields, *state])
        found = found.mapInArrow(_scan(sc.broadcast(block), source, schema, first), schema)
        block, first = following, False
    return found


def _scan(shared, source: str, schema: T.StructType, first: bool):
    arrow = to_arrow_schema(schema)
    passed = [f.name for f in schema.fields[:-3]]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, unions = shared.value, {}
        for batch in batches:
            texts = batch.column(source).to_pylist()
            for part in byte_slices(texts, SHARD_BYTES):
                counts, spans, items = _shard_hits(texts[part], block, unions)
                rows = batch.slice(part.start, part.stop - part.start)
                if not first:
                    for i, (old, ids) in enumerate(zip(rows.column("hits").to_pylist(), rows.column("items").to_pylist())):
                        if old:
                            spans[i] = _merged([*spans[i], *[(s["start"], s["end"]) for s in old]])
                            items[i] = sorted({*items[i], *ids})
                pairs = [[{"start": s, "end": e} for s, e in row] for row in spans]
                found = [pa.array(counts), pa.array(pairs, arrow.field("hits").type), pa.array(items, pa.list_(pa.string()))]
                columns = [*[rows.column(c) for c in passed], *found]
                yield pa.RecordBatch.from_arrays(
                    [c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, arrow)], schema=arrow)

    return scan


def longest_matches(
    docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(item_id string, words long, item_start long, doc_id, doc_start long): the longest verbatim match of every item.

    Only matches of a window or more count. Among equally long ones the smallest document, place and item place wins,
    a NULL document first. ``item_start`` counts from the piece's start for an item longer than a block.
    """
    spark, schema = docs.sparkSession, T.StructType([
        T.StructField("item_id", T.StringType()), T.StructField("words", T.LongType()), T.StructField("item_start", T.LongType()),
        T.StructField("doc_id", docs.schema[doc].dataType), T.StructField("doc_start", T.LongType())])
    arrow = to_arrow_schema(schema)
    found = spark.createDataFrame([], schema)
    for block in test_blocks(benchmark, item, item_text, window, block_words):
        shared = spark.sparkContext.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            ends = np.concatenate([[-1], np.flatnonzero(block.words == 0)])
            for batch in batches:
                texts, ids = batch.column("t").to_pylist(), batch.column("d").to_pylist()
                for part in byte_slices(texts, SHARD_BYTES):
                    shard = Shard(texts[part], block)
                    suffix, words, place = shard.longest(block)
                    texts_at = shard.text_of(place)
                    best: dict[str, tuple] = {}
                    for s, n, t, p in zip(suffix.tolist(), words.tolist(), texts_at.tolist(), place.tolist()):
                        start = int(block.suffix_starts[s])
                        start -= int(ends[np.searchsorted(ends, start) - 1]) + 1
                        d, name = ids[part.start + t], block.suffix_items[s]
                        row = (-n, d is not None, d, p - int(shard.first[t]), start)
                        if name not in best or row < best[name]:
                            best[name] = row
                    if best:
                        rows = [(k, -v[0], v[4], v[2], v[3]) for k, v in best.items()]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

        found = found.unionByName(docs.select(F.col(doc).alias("d"), F.col(text).alias("t")).mapInArrow(scan, schema))
    order = F.struct((-F.col("words")).alias("n"), F.col("doc_id").isNotNull().alias("k"), "doc_id", "doc_start", "item_start")
    return found.groupBy("item_id").agg(F.min(order).alias("m")).select(
        "item_id", (-F.col("m.n")).alias("words"), F.col("m.item_start"), F.col("m.doc_id"), F.col("m.doc_start"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that hold a window of the benchmark; columns stay as they are."""
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"))
    found = contamination(whole, benchmark, **options, keep=["row"])
    return found.where(F.size("hits") == 0).select("row.*")


def op13_decontamination(spark, sf_dir: str) -> DataFrame:
    """What each document shares with the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contamination(documents(spark, sf_dir).select("doc_id", "text"), benchmark, keep=["doc_id"])
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
