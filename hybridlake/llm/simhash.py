"""SimHash near-duplicates through an index over the bytes of the fingerprints.

A fingerprint is 8 bytes. Two of them with at most ``d`` differing bits (d <= 7) differ in at most ``d`` bytes, so they
share at least 8 - d bytes at their positions: the guaranteed minimum. The index has a posting for each choice of that
many positions together with their bytes; every pair that reaches the minimum meets in one. (A posting per single byte
would hold 1/256 of all fingerprints, and tallying its pairs would grow with the square of the corpus.) Inside a posting
the shared positional bytes of a pair are tallied, pairs below the minimum dropped, and the others verified by their
differing bits. Only links that join what was apart so far leave a posting, at most one per fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from hybridlake.llm.components import components
from hybridlake.llm.stored import stored
from hybridlake.llm.texts import ascii_words, documents, trimmed

BYTES = 8
SEED = 42
#: Fingerprints compared with all others of a posting at once.
BLOCK = 512


def fingerprint_of(text: str | None, words: int) -> int:
    """A bit is 1 if it is set in over half of the XXH64 (seed 42) of all word shingles, repeats included.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, joined by one space. Fewer words than a shingle has make one
    shingle; no words (also NULL) give 0.
    """
    found = ascii_words(text, lower=True)
    if not found:
        return 0
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = min(words, len(found))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts[:len(found) - n + 1].tolist(), ends[n - 1:].tolist())], dtype=np.uint64)
    set_bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)]
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column | str, words: int = 3) -> Column:
    """The 64-bit fingerprint of each whole text as a long."""

    @F.pandas_udf("long")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in trimmed(batches):
            yield pd.Series(np.array([fingerprint_of(t, words) for t in texts], dtype=np.uint64).view(np.int64))

    return prints(text)


def postings(prints: DataFrame, max_bits: int) -> DataFrame:
    """``(choice, bytes, prints)``: the fingerprints of every posting that holds more than one.

    A posting holds at most 256 ** max_bits different fingerprints, whatever the corpus.
    """
    masks = [sum(0xFF << (8 * p) for p in choice) for choice in combinations(range(BYTES), BYTES - max_bits)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    table = F.array(*[F.lit(m).cast("long") for m in signed])
    keyed = prints.select("fp", F.posexplode(F.transform(table, lambda m: m.bitwiseAND(F.col("fp")))).alias("choice", "bytes"))
    return keyed.groupBy("choice", "bytes").agg(F.collect_list("fp").alias("prints")).where(F.size("prints") > 1)


def links_of(prints: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever fingerprints of one posting differ in at most ``max_bits`` bits."""
    labels = np.arange(len(prints))  # the part each fingerprint belongs to, by its least member
    left: list[int] = []
    right: list[int] = []
    for start in range(0, len(prints), BLOCK):
        block = prints[start:start + BLOCK]
        differing = block[:, None] ^ prints[None, start:]
        tally = (differing[:, :, None].view(np.uint8) == 0).sum(axis=2, dtype=np.uint8)
        near = (tally >= BYTES - max_bits) & (np.bitwise_count(differing) <= max_bits)
        for i in range(len(block)):
            beside = start + np.flatnonzero(near[i])
            parts, at = np.unique(labels[beside], return_index=True)
            for part, other in zip(parts, beside[at]):
                own = labels[start + i]
                if part != own:
                    left.append(start + i)
                    right.append(int(other))
                    labels[labels == max(part, own)] = min(part, own)
    return prints[left], prints[right]


def linked(prints: DataFrame, max_bits: int = 3) -> DataFrame:
    """Links ``(u, v)`` between different fingerprints of column ``fp``, enough to connect all that are linked."""

    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            found = [links_of(np.sort(np.asarray(p, dtype=np.int64).view(np.uint64)), max_bits) for p in frame["prints"]]
            yield pd.DataFrame({
                "u": np.concatenate([u for u, _ in found]).view(np.int64) if found else np.array([], dtype=np.int64),
                "v": np.concatenate([v for _, v in found]).view(np.int64) if found else np.array([], dtype=np.int64),
            })

    return postings(prints, max_bits).select("prints").mapInPandas(inside, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fp, root, component_id)`` per row of ``docs``.

    Fingerprints that differ in at most ``max_bits`` (0 to 7) bits are linked, and so are equal ones. ``root`` is the
    least fingerprint of the component, ``component_id`` its smallest key; NULL keys count only where a component
    has no other. Repeated rows stay as they are. Texts without words share fingerprint 0.
    """
    prints = docs.select(F.col(key).alias("doc_id"), fingerprint(text, words).alias("fp"))
    return _components_of(stored(prints, "prints"), max_bits).select("doc_id", "fp", "root", "component_id")


def _components_of(table: DataFrame, max_bits: int) -> DataFrame:
    """``table`` (doc_id, fp, ...; stored) with the root and the component_id of each fingerprint."""
    if not 0 <= max_bits <= 7:
        raise ValueError("max_bits is 0 to 7")
    classes = stored(table.groupBy("fp").agg(F.min("doc_id").alias("least")), "print-classes")
    roots = components(linked(classes.select("fp"), max_bits)).withColumnRenamed("vertex", "fp")
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    members = rooted.select("fp", "root").join(least, "root")
    return table.join(members, "fp")


def representatives(docs: DataFrame, words: int = 3, max_bits: int = 3) -> DataFrame:
    """One row of ``docs`` for each component: the one with its smallest doc_id, whole and with all its columns.

    Of rows that repeat this doc_id, and of components without any doc_id, one row stays: that with the least
    fingerprint and digest of its text. Each text is fingerprinted once; rows are found again by doc_id and digest.
    """
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    prints = stored(docs.select("doc_id", fingerprint("text", words).alias("fp"), digest.alias("digest")), "prints")
    keep = (
        _components_of(prints, max_bits).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("root").agg(F.min(F.struct("doc_id", "fp", "digest")).alias("k"))
        .select(F.struct("k.doc_id", "k.digest").alias("keep"))
    )
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.struct(F.col("doc_id"), digest.alias("digest")).alias("row"))
    kept = rows.join(keep, rows["row"] == keep["keep"], "left_semi")
    return kept.groupBy("row").agg(F.min_by("doc", F.xxhash64("doc.text")).alias("doc")).select("doc.*")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: three-word shingles, at most three differing bits."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return near_duplicates(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
