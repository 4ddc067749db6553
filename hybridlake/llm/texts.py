"""Helpers over texts shared by the operators: words, word hashes, batches bounded by bytes, names that do not clash."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Words remembered by one Python worker; beyond it a cache starts anew, so memory stays bounded.
CACHED_WORDS = 250_000
#: Longer words are worked out each time instead of being remembered.
CACHED_LENGTH = 48
#: UTF-8 bytes of the texts that one Python step holds beside its input.
SLICE_BYTES = 8 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def byte_slices(texts: Sequence[str | None], most: int = SLICE_BYTES) -> Iterator[slice]:
    """Cut a batch into runs of neighbours of about ``most`` bytes; one longer text is a run of its own."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        size = (len(text.as_buffer()) if text.is_valid else 0) if isinstance(text, pa.Scalar) else len(text or "")
        if i > start and held + size > most:
            yield slice(start, i)
            start, held = i, 0
        held += size
    if start < len(texts):
        yield slice(start, len(texts))


def trimmed(batches: Iterator, held: dict | None = None) -> Iterator:
    """``batches``, and at the end of the partition give what they took back to the system, with the entries of ``held``.

    Python workers serve one partition after the other; what one leaves behind would count against the next.
    """
    try:
        yield from batches
    finally:
        if held is not None:
            held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # another C library
            pass


def ascii_words(text: str | None, lower: bool = False) -> list[bytes]:
    """The runs of ``[^\\x20\\x09-\\x0D]`` as UTF-8, with A-Z lower-cased on demand; none for NULL."""
    if not text:
        return []
    data = text.encode("utf-8")
    return (data.lower() if lower else data).split()


class WordHashes(dict):
    """XXH64 of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (multiply and shift)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(words: np.ndarray, n: int, multipliers: np.ndarray) -> np.ndarray:
    """64-bit hashes of all runs of ``n`` words, in order; fewer words make one run, no words none."""
    if len(words) == 0:
        return words
    n = min(n, len(words))
    runs = len(words) - n + 1
    out = np.full(runs, n, dtype=np.uint64)
    for j in range(n):
        out += mixed(words[j:j + runs] + multipliers[j]) * multipliers[j]
    return mixed(out)


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers, the same in every run."""
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


#: Bytes of a word that have a key of their own; longer words are hashed one by one.
KEYED_BYTES = 64
#: Bytes hashed in one step.
HASHED_BYTES = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PLACE_KEYS = odd_numbers(KEYED_BYTES, 21)


def _word_hashes(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie one behind the other, and which words are whose."""
    inside = ~_SPACE[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    first = cuts[:-1][cuts[:-1] < len(data)]
    begin[first] = inside[first]
    starts = np.flatnonzero(begin)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(cuts), dtype=np.int64)
    reach = np.diff(starts, append=len(data))
    base = starts[0]
    place = np.arange(base, len(data), dtype=np.int64) - np.repeat(starts, reach)
    np.minimum(place, KEYED_BYTES - 1, out=place)
    value = (data[base:].astype(np.uint64) + np.uint64(1)) * inside[base:]
    hashes = np.add.reduceat(value * _PLACE_KEYS[place], starts - base)
    sizes = np.add.reduceat(inside[base:].astype(np.int64), starts - base)
    for i in np.flatnonzero(sizes > KEYED_BYTES).tolist():
        hashes[i] = xxhash.xxh64_intdigest(data[starts[i]:starts[i] + sizes[i]].tobytes())
    return mixed(hashes), np.searchsorted(starts, cuts)


def hashed_words(texts: pa.Array) -> Iterator[np.ndarray]:
    """For every text the 64-bit hashes of its words, ``[^\\x20\\x09-\\x0D]+``, in order; none for NULL.

    Bytes are weighed by odd keys of their place in the word, added up where they lie, and mixed; no word becomes an
    object. Memory is bounded by the step, also for one long text.
    """
    if not len(texts):
        return
    texts = texts.cast(pa.large_string())
    _, offsets, buffer = texts.buffers()
    cuts = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(cuts, cuts[at] + HASHED_BYTES, "right")) - 1)
        part = data[cuts[at]:cuts[end]]
        if len(part) <= HASHED_BYTES:
            hashes, first = _word_hashes(part, cuts[at:end + 1] - cuts[at])
            for a, b in zip(first.tolist(), first[1:].tolist()):
                yield hashes[a:b]
        else:  # one long text, cut at white space
            found, begin = [], 0
            while begin < len(part):
                stop = begin + HASHED_BYTES
                while stop < len(part):
                    spaces = np.flatnonzero(_SPACE[part[stop:stop + HASHED_BYTES]])
                    if len(spaces):
                        stop += int(spaces[0])
                        break
                    stop += HASHED_BYTES
                stop = min(stop, len(part))
                found.append(_word_hashes(part[begin:stop], np.array([0, stop - begin]))[0])
                begin = stop
            yield np.concatenate(found)
        at = end


def spaced(text: str, n_words: int) -> str:
    """The words of a text joined by one space."""
    data = text.encode("utf-8").translate(_TO_SPACE)
    if len(data) and data.count(b" ") == n_words - 1:  # one separator between any two words
        return data.decode("utf-8")
    return b" ".join(data.split()).decode("utf-8")


_TO_SPACE = bytes(0x20 if _SPACE[b] else b for b in range(256))
