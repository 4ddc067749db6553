"""Alignment of two tokenizers over the bytes of the same text.

Both sides encode the text with a space before it. Texts are cut where neither side can join bytes (before a space that
stands between a character other than a space and one that is no white space), so each distinct chunk of a batch is encoded once. Token starts and ends are
byte offsets. ``pandas.merge_asof`` finds, per batch and keyed by document, the token of the other side that covers
each token start; an overlapping pair starts together or one starts inside the other, so both directions together give
all overlaps. Offsets where tokens of both sides end cut the tokens into groups.

How often two ids are linked in the whole corpus is summed from one row per document and distinct pair. The sums of the
most frequent pairs travel back to the documents in a table of bounded size; all other pairs meet theirs in a join.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from hybridlake.llm.stored import stored
from hybridlake.llm.texts import documents, fresh

MARKER = "▁"
#: Both tokenizers start a new token at such a space.
CUT = re.compile(r"(?<=[^ ]) (?=\S)")
#: A space that is no cut.
NOT_PLAIN = re.compile(r" (?:\s|\Z)")
#: Chunks of one step of merge_asof. A longer text is aligned in parts that end at cuts.
STEP_CHUNKS = 200_000
#: Chunks that one task remembers, if not longer than CHUNK_LENGTH; beyond that it starts anew.
HELD_CHUNKS, CHUNK_LENGTH = 150_000, 48
#: Distinct chunks that are encoded as one text.
RUN_CHUNKS = 512
#: Linked pairs whose counts are broadcast (24 bytes each).
HOT_PAIRS = 1 << 18
_DOC_BITS = 40  # byte offsets of one text below 2^40


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Side:
    """One tokenizer: ids of chunks, and the bytes of each id."""

    def encode(self, chunks: list[str]) -> list[list[int]]:
        """Ids of each chunk with a space before it."""
        raise NotImplementedError

    def finish(self, token_bytes: dict[int, bytes]) -> None:
        size = max(token_bytes, default=0) + 1
        self.bytes = [token_bytes.get(i, b"") for i in range(size)]
        self.lengths = np.array([len(b) for b in self.bytes], dtype=np.int64)
        #: Decimal ids with the mark that may follow them.
        self.names = {mark: np.array([f"{i}{mark}" for i in range(size)], dtype=object) for mark in ",|;"}

    def encode_runs(self, chunks: list[str]) -> list[list[int]]:
        """Ids of each chunk, from texts of many chunks cut where a chunk ends."""
        out: list[list[int]] = []
        for at in range(0, len(chunks), RUN_CHUNKS):
            run = chunks[at:at + RUN_CHUNKS]
            (ids,) = self.encode([" ".join(run)])
            sizes = np.cumsum([len(c.encode()) + 1 for c in run])
            ends = np.cumsum(self.lengths[ids]) if ids else np.zeros(0, dtype=np.int64)
            cuts = np.searchsorted(ends, sizes)
            if len(ids) and cuts[-1] == len(ids) - 1 and (ends[cuts] == sizes).all():
                cuts = [0, *(cuts + 1).tolist()]
                out += [ids[a:b] for a, b in zip(cuts, cuts[1:])]
            else:  # a chunk lost bytes
                out += self.encode(run)
        return out

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class ByteLevel(Side):
    """A byte-level BPE of the tokenizers library (``.json``); strings of special tokens are plain text."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = True
        alphabet = _byte_alphabet()
        self.finish({i: bytes(map(alphabet.__getitem__, w)) if all(c in alphabet for c in w) else w.encode()
                     for w, i in self.library.get_vocab(with_added_tokens=True).items()})
        sample = ["a", "b\n\nc", "d  ", "e'll", "1", ".."]
        self.cuts = self.library.normalizer is None and (
            self.encode([" ".join(sample)])[0] == list(chain.from_iterable(self.encode(sample))))

    def encode(self, chunks: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast([" " + c for c in chunks], add_special_tokens=False)]


class Pieces(Side):
    """A sentencepiece model (``.model``) that puts the leading space itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(i) for i in range(n)]
        self.finish({i: bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace(MARKER, " ").encode()
                     for i, p in enumerate(pieces)})
        # No piece may cross a cut: a marker stands only at the start of a piece.
        self.cuts = self.joined(self.library.encode("a  b")) == b" a  b" and not any(
            MARKER in p.lstrip(MARKER) for i, p in enumerate(pieces) if not self.library.is_control(i))

    def encode(self, chunks: list[str]) -> list[list[int]]:
        return self.library.encode(chunks, num_threads=1)


_sides: dict[str, Side] = {}


def side(path: str) -> Side:
    """The tokenizer file at ``path``, loaded once per worker."""
    if path not in _sides:
        _sides[path] = ByteLevel(path) if path.endswith(".json") else Pieces(path)
    return _sides[path]


class Chunks(dict):
    """Ids on both sides of each chunk seen, and the chunks that a side does not give back byte by byte."""

    def __init__(self, a: Side, b: Side) -> None:
        super().__init__()
        self.a, self.b, self.cuts = a, b, a.cuts and b.cuts
        self.broken: set[str] = set()

    def of(self, text: str | None) -> list[str]:
        if not text:
            return []
        if not self.cuts:
            return [text]
        return CUT.split(text) if text[0] == " " or NOT_PLAIN.search(text) else text.split(" ")

    def learn(self, chunks: Iterable[str]) -> list[str]:
        """Encode the chunks not seen yet, each once; returns those that are not to be remembered."""
        if len(self) > HELD_CHUNKS:
            self.clear()
            self.broken.clear()
        new = set(chunks).difference(self)
        # Joined by spaces, these are cut apart again by either side.
        plain = [c for c in new if c[0] > " " and c[-1] != " " and not c[0].isspace()] if self.cuts else []
        self._hold(plain, self.a.encode_runs(plain), self.b.encode(plain))
        odd = list(new.difference(plain))
        self._hold(odd, self.a.encode(odd), self.b.encode(odd))
        return [c for c in new if len(c) > CHUNK_LENGTH]

    def _hold(self, new: list[str], a: list[list[int]], b: list[list[int]]) -> None:
        self.update(zip(new, zip(a, b)))
        for side_, ids in ((self.a, a), (self.b, b)):
            for at in range(0, len(new), RUN_CHUNKS):
                run = new[at:at + RUN_CHUNKS]
                given = side_.joined(list(chain.from_iterable(ids[at:at + RUN_CHUNKS])))
                if given != "".join([" " + c for c in run]).encode():
                    self.broken.update(c for c, i in zip(run, ids[at:]) if side_.joined(i) != b" " + c.encode())

    def forget(self, chunks: list[str]) -> None:
        for chunk in chunks:
            del self[chunk]
            self.broken.discard(chunk)


@dataclass
class Aligned:
    """Alignment of one text, or of a part of it."""

    n_a: int
    n_b: int
    n_groups: int
    n_links: int
    groups: str
    pairs: np.ndarray     # a id << 32 | b id, distinct, ascending
    counts: np.ndarray

    def then(self, other: "Aligned") -> "Aligned":
        """This part followed by the next one."""
        pairs, at = np.unique(np.concatenate([self.pairs, other.pairs]), return_inverse=True)
        counts = np.zeros(len(pairs), dtype=np.int64)
        np.add.at(counts, at, np.concatenate([self.counts, other.counts]))
        return Aligned(self.n_a + other.n_a, self.n_b + other.n_b, self.n_groups + other.n_groups, self.n_links + other.n_links,
                       f"{self.groups};{other.groups}" if self.groups and other.groups else self.groups + other.groups,
                       pairs, counts)


NOTHING = Aligned(0, 0, 0, 0, "", np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))


def overlaps(doc_a: np.ndarray, start_a: np.ndarray, doc_b: np.ndarray, start_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A token, B token) of all overlapping pairs, tokens numbered in the order given (by document, then start).

    The merge key holds the document above the byte offset; the first tokens of a document start at 0 on both sides,
    so the token found never belongs to another document.
    """
    a = pd.DataFrame({"at": (doc_a << _DOC_BITS) | start_a, "a": np.arange(len(start_a))})
    b = pd.DataFrame({"at": (doc_b << _DOC_BITS) | start_b, "b": np.arange(len(start_b))})
    into_b = pd.merge_asof(a, b, on="at")
    into_a = pd.merge_asof(b, a, on="at")
    # Tokens that start together are found in both directions: the second one adds those that start inside.
    inside = into_a[into_a["at"].to_numpy() != a["at"].to_numpy()[into_a["a"].to_numpy()]]
    return (np.concatenate([into_b["a"].to_numpy(), inside["a"].to_numpy()]),
            np.concatenate([into_b["b"].to_numpy(), inside["b"].to_numpy()]))


def _gathered(lists: list[list[int]], codes: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all chunks (numbers into ``lists``) in order, and how many each document has."""
    sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    flat = np.fromiter(chain.from_iterable(lists), dtype=np.int32, count=int(sizes.sum()))
    taken = sizes[codes]
    first = (np.cumsum(sizes) - sizes)[codes] - (np.cumsum(taken) - taken)
    ids = flat[np.repeat(first, taken) + np.arange(int(taken.sum()))]
    return ids, np.bincount(doc, weights=taken, minlength=docs).astype(np.int64)


def _offsets(ids: np.ndarray, counts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of all tokens; offsets count from the start of each document."""
    size = lengths[ids]
    end = np.cumsum(size)
    before = np.concatenate([[0], end])[np.cumsum(counts) - counts]
    end -= np.repeat(before, counts)
    return np.repeat(np.arange(len(counts)), counts), end - size, end


def align_batch(a: Side, b: Side, fa: np.ndarray, n_a: np.ndarray, fb: np.ndarray, n_b: np.ndarray) -> list[Aligned]:
    """Alignment of each document: its ids in order and how many they are, on both sides over the same bytes."""
    da, sa, ea = _offsets(fa, n_a, a.lengths)
    db, sb, eb = _offsets(fb, n_b, b.lengths)
    if not len(fa):
        return [NOTHING] * len(n_a)
    docs = np.arange(len(n_a) + 1)
    first_a, first_b = np.searchsorted(da, docs), np.searchsorted(db, docs)

    # Groups end where tokens of both sides end.
    ka, kb = (da << _DOC_BITS) | ea, (db << _DOC_BITS) | eb
    last_a = kb[np.minimum(np.searchsorted(kb, ka), len(kb) - 1)] == ka
    last_b = ka[np.minimum(np.searchsorted(ka, kb), len(ka) - 1)] == kb
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    next_a, next_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
    n_groups = np.searchsorted(da[last_a], docs)

    # Names in the order of the groups: the A tokens of a group, then its B tokens.
    names = np.empty(len(fa) + len(fb), dtype=object)
    before = np.concatenate([[0], next_b])
    named = a.names[","][fa]
    named[last_a] = a.names["|"][fa[last_a]]
    names[np.arange(len(fa)) + before[group_a]] = named
    named = b.names[","][fb]
    named[last_b] = b.names[";"][fb[last_b]]
    names[np.arange(len(fb)) + next_a[group_b]] = named
    first_name = first_a + first_b

    # Overlapping pairs, counted per document and pair of ids.
    at, bt = overlaps(da, sa, db, sb)
    wide = len(b.bytes)
    span = len(a.bytes) * wide
    keys, counts = np.unique(da[at] * span + fa[at].astype(np.int64) * wide + fb[bt], return_counts=True)
    first_pair = np.searchsorted(keys, docs * span)
    keys %= span
    pairs = ((keys // wide) << 32) | (keys % wide)
    n_links = np.bincount(da[at], minlength=len(n_a))
    return [Aligned(int(first_a[d + 1] - first_a[d]), int(first_b[d + 1] - first_b[d]), int(n_groups[d + 1] - n_groups[d]),
                    int(n_links[d]), "".join(names[first_name[d]:first_name[d + 1]].tolist())[:-1],
                    pairs[first_pair[d]:first_pair[d + 1]], counts[first_pair[d]:first_pair[d + 1]])
            for d in range(len(n_a))]


def align_texts(chunks: Chunks, texts: list[str | None]) -> Iterator[Aligned]:
    """Alignment of each text, in steps of about STEP_CHUNKS chunks; a longer text is aligned part by part."""
    def step(parts: list[list[str]]) -> list[Aligned]:
        flat = list(chain.from_iterable(parts))
        number = {chunk: n for n, chunk in enumerate(dict.fromkeys(flat))}
        long = chunks.learn(number)
        if chunks.broken:
            parts = [[] if not chunks.broken.isdisjoint(p) else p for p in parts]
            flat = list(chain.from_iterable(parts))
        codes = np.fromiter(map(number.__getitem__, flat), dtype=np.int64, count=len(flat))
        doc = np.repeat(np.arange(len(parts)), np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)))
        sides = zip(*map(chunks.__getitem__, number)) if number else ((), ())
        ids = [x for lists in sides for x in _gathered(lists, codes, doc, len(parts))]
        chunks.forget(long)
        return align_batch(chunks.a, chunks.b, *ids)

    held: list[list[str]] = []
    n = 0
    for text in texts:
        cut = chunks.of(text)
        if held and n + len(cut) > STEP_CHUNKS:
            yield from step(held)
            held, n = [], 0
        if len(cut) <= STEP_CHUNKS:
            held.append(cut)
            n += len(cut)
            continue
        whole = NOTHING
        for i in range(0, len(cut), STEP_CHUNKS):
            part = step([cut[i:i + STEP_CHUNKS]])[0]
            if not part.n_a:  # one broken chunk leaves the text without tokens
                whole = NOTHING
                break
            whole = whole.then(part)
        yield whole
    if held:
        yield from step(held)


# ---------------------------------------------------------------------------
# Tables
# ---------------------------------------------------------------------------
RESULT = [
    ("n_a", T.LongType()), ("n_b", T.LongType()), ("n_groups", T.LongType()), ("n_links", T.LongType()), ("groups", T.StringType()),
    ("pairs", T.ArrayType(T.LongType())), ("pair_counts", T.ArrayType(T.LongType())),
]


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, all by default) with the alignment of every text.

    Adds ``n_a``, ``n_b`` (tokens), ``n_groups``, ``n_links`` (overlapping pairs), ``groups`` (``a1,a2|b1;a3|b2``: decimal ids),
    ``pairs`` (distinct linked ids, a << 32 | b, ascending) and ``pair_counts``, in place of columns of those names.
    ``path_a`` is a byte-level vocabulary file (.json), ``path_b`` a sentencepiece model (.model) that every executor can
    read. Texts that are NULL, empty, or not given back byte by byte by both sides have no tokens: zeros, '' and empty
    arrays. Rows are aligned one by one, so repeated rows, ties and NULLs in other columns change nothing; an empty
    table gives an empty table.
    """
    taken = {name for name, _ in RESULT}
    kept = [c for c in (keep or docs.columns) if c.lower() not in taken]
    source = fresh(docs, "aligned_text")
    rows = docs.select(*kept, F.col(text).alias(source))
    schema = T.StructType([*[f for f in rows.schema.fields if f.name != source], *[T.StructField(n, t) for n, t in RESULT]])
    arrow = to_arrow_schema(schema)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks(side(path_a), side(path_b))
        for batch in stream:
            at, held, size = 0, [], 0
            found = align_texts(chunks, batch.column(source).to_pylist())
            for i in range(len(batch)):
                held.append(next(found))
                size += held[-1].n_links
                if size > 500_000 or i == len(batch) - 1:
                    yield _rows(batch.slice(at, len(held)), held, kept, arrow)
                    at, held, size = i + 1, [], 0

    return rows.mapInArrow(batches, schema)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(arrays) if arrays else [], pa.int64()))


def _rows(rows: pa.RecordBatch, found: list[Aligned], kept: list[str], arrow: pa.Schema) -> pa.RecordBatch:
    columns = [
        *[rows.column(c) for c in kept],
        *[pa.array([getattr(x, n) for x in found], pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")],
        pa.array([x.groups for x in found], pa.string()), _lists([x.pairs for x in found]), _lists([x.counts for x in found]),
    ]
    return pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, arrow)], schema=arrow)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, links, best): how many links of the corpus hold each linked id pair, and whether no pair of its B id has more.

    Counts are added up where the documents are before anything is shuffled. The highest count per B id is a table of
    at most as many rows as B has ids.
    """
    both = aligned.select(F.explode(F.arrays_zip("pairs", "pair_counts")).alias("p"))
    counts = stored(both.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.pair_counts").alias("links")), "pair-counts")
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    most = counts.groupBy(b.alias("b")).agg(F.max("links").alias("most"))
    return counts.join(F.broadcast(most), b == F.col("b")).select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def with_link_counts(aligned: DataFrame, row: str, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """``aligned`` with ``n_best`` and ``count_sum``, in place of columns of those names; ``row`` is dropped.

    ``aligned`` is a stored table, as it is read three times, and ``row`` a column that is different in every row of it.
    ``count_sum`` adds up, over a document's links, the corpus count of the link's id pair; ``n_best`` counts the links
    whose pair has the highest count among the pairs of its B id, ties included. Pairs beyond the ``hot_pairs`` most
    frequent ones meet their counts in a join, summed per document on the way back.
    """
    kept = [c for c in aligned.columns if c.lower() not in ("n_best", "count_sum", row.lower())]
    counts = stored(pair_counts(aligned), "pair-totals")
    table = counts.orderBy(F.desc("links"), "pair").limit(hot_pairs).toArrow()
    rarer = F.lit(False)
    if 0 < hot_pairs <= len(table):
        links, pair = table.column("links")[-1].as_py(), table.column("pair")[-1].as_py()
        rarer = (F.col("links") < links) | ((F.col("links") == links) & (F.col("pair") > pair))
    cold = counts.where(rarer) if hot_pairs else counts
    table = table.sort_by("pair")
    shared = aligned.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "links", "best")))
    schema = T.StructType([
        T.StructField("r", T.LongType()), T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()),
        T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("pair_counts", T.ArrayType(T.LongType()))])
    arrow = to_arrow_schema(schema)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, links, best = shared.value
        for batch in stream:
            sizes = np.diff(batch.column("pairs").offsets.to_numpy())
            doc = np.repeat(np.arange(len(sizes)), sizes)
            pair, n = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("pairs", "pair_counts"))
            sums = np.zeros((2, len(sizes)), dtype=np.int64)
            known = np.zeros(len(pair), dtype=bool)
            if len(keys) and len(pair):
                at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
                known = keys[at] == pair
                np.add.at(sums[0], doc[known], (n * best[at])[known])
                np.add.at(sums[1], doc[known], (n * links[at])[known])
            offsets = np.searchsorted(doc[~known], np.arange(len(sizes) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("r"), pa.array(sums[0]), pa.array(sums[1]),
                 *[pa.ListArray.from_arrays(offsets, pa.array(x[~known], pa.int64())) for x in (pair, n)]], schema=arrow)

    near = aligned.select(F.col(row).alias("r"), "pairs", "pair_counts").mapInArrow(batches, schema)
    rest = near.select("r", F.explode(F.arrays_zip("pairs", "pair_counts")).alias("p")).select(
        "r", F.col("p.pairs").alias("pair"), F.col("p.pair_counts").alias("n"))
    far = rest.join(cold, "pair").select(
        "r", F.when(F.col("best"), F.col("n")).otherwise(0).alias("n_best"), (F.col("n") * F.col("links")).alias("count_sum"))
    sums = near.select("r", "n_best", "count_sum").unionByName(far).groupBy("r").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return aligned.select(*kept, row).join(sums.withColumnRenamed("r", row), row).drop(row)


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    """Groups and links of the two tokenizers for every document."""
    import public_tokenizers

    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
    digest = F.when(F.col("n_a") == 0, F.lit("")).otherwise(F.sha2("groups", 256))
    rows = found.withColumns({"groups_sha256": digest, "row": F.monotonically_increasing_id()}).drop("groups")
    return with_link_counts(stored(rows, "aligned"), "row").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
