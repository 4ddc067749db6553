"""MinHash fingerprints: universal hash permutations over word shingles, in numpy; near-duplicates by bands in Spark.

A shingle's 64-bit hash is folded to 32 bits; each permutation is ``(a * x + b) mod 2**64 >> 32`` with fixed odd ``a``, a
strongly universal family. The least value over all shingles, cut to 16 bits, is one place of the signature, so places
agree by chance once in 65,536. Two texts are as alike as the share of places that agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from hybridlake.llm.components import components
from hybridlake.llm.stored import stored
from hybridlake.llm.texts import WordHashes, ascii_words, documents, odd_numbers, shingle_hashes

WORDS = 5
SIMILARITY = 0.8
PERMUTATIONS = 128
BAND = 8            # places of a band: 16 bands of 128 bits
#: Shingles hashed at once: 128 permutations of them take 4 MB.
BLOCK = 4096
EMPTY = 0xFFFF      # every place of a text without words

A = odd_numbers(PERMUTATIONS, 1)
B = odd_numbers(PERMUTATIONS, 2)
SHINGLE = odd_numbers(WORDS, 3)


class Signer:
    """Signatures of texts; holds the word hashes of one worker."""

    def __init__(self) -> None:
        self.hashes = WordHashes()

    def shingles(self, text: str | None) -> np.ndarray:
        """The distinct five-word shingles as sorted 64-bit hashes."""
        return np.unique(shingle_hashes(self.hashes.of(ascii_words(text)), WORDS, SHINGLE))

    def signature(self, text: str | None) -> np.ndarray:
        x = self.shingles(text)
        if len(x) == 0:
            return np.full(PERMUTATIONS, EMPTY, dtype=np.uint16)
        x = (x >> np.uint64(32))[None, :]
        least = np.full(PERMUTATIONS, 0xFFFFFFFF, dtype=np.uint64)
        for at in range(0, x.shape[1], BLOCK):
            values = (A[:, None] * x[:, at:at + BLOCK] + B[:, None]) >> np.uint64(32)
            np.minimum(least, values.min(axis=1), out=least)
        return (least & np.uint64(0xFFFF)).astype(np.uint16)


_signers: list[Signer] = []


def signer() -> Signer:
    if not _signers:
        _signers.append(Signer())
    return _signers[0]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.count_nonzero(a == b)) / PERMUTATIONS


def fingerprint(text: Column | str) -> Column:
    """The signature of each whole text as hexadecimal digits (4 per place). NULL and empty texts have only f's."""

    @F.pandas_udf("string")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([signer().signature(t).astype(">u2").tobytes().hex() for t in texts])

    return prints(text)


# --- every document beside its next one ------------------------------------------
def in_order(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``(block, key, text, guest)``, cut into blocks of neighbours by descending key (NULL last).

    Each block ends with a guest: the first row of the next block (of the first, after the last). Bounds come from the
    quantiles of the keys over all rows, one per shuffle partition; only keys and one text per block are moved twice.
    Rows with one key are ordered by text.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)] or [0.5], 100 * parts)).first()[0]
    bounds = sorted(set(cuts or []), reverse=True)
    # The block of a key is the number of bounds above it; NULL keys stand behind all others.
    number = F.lit(len(bounds)) if not bounds else F.coalesce(_blocks(F.col("key"), bounds), F.lit(len(bounds)))
    rows = docs.withColumn("block", number)
    heads = {r["block"]: r["head"] for r in rows.groupBy("block").agg(F.max("key").alias("head")).collect()}  # one per block
    blocks = sorted(heads)
    head = F.col("key").isin([h for h in heads.values() if h is not None])
    if None in heads.values():
        head = head | F.col("key").isNull()
    guests = rows.where(head).groupBy("block", "key").agg(F.max("text").alias("text"))
    if blocks:  # a guest stands in the block before its own, the first one in the last
        moved = F.create_map(*[F.lit(x) for i, b in enumerate(blocks) for x in (b, blocks[i - 1])])
        guests = guests.withColumn("block", moved[F.col("block")])
    both = rows.withColumn("guest", F.lit(False)).unionByName(guests.withColumn("guest", F.lit(True)))
    return (
        both.repartition(parts, "block")
        .sortWithinPartitions("block", "guest", F.desc_nulls_last("key"), F.desc_nulls_last("text"))
        .select("block", "key", "text", "guest")
    )


def _blocks(key: Column, bounds: list[int]) -> Column:
    """Number of descending ``bounds`` that are above ``key``, by bisection inside one array literal."""
    ascending = F.array(*[F.lit(b) for b in reversed(bounds)])
    return F.when(key.isNotNull(), F.size(F.filter(ascending, lambda b: b > key)).cast("int"))


def edited_text(text: str, following: str) -> str:
    """The last third (floor) of the code points gives way to the first as many (or all) of the following text."""
    third = len(text) // 3
    return text[:len(text) - third] + following[:third]


PAIRED = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that to the next document's.

    The next document has the next smaller key; after the last (NULL keys stand last) comes the first. A single row is
    its own next one. NULL texts are empty; rows with one key follow each other by descending text; repeated rows stay.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            done: list[tuple] = []
            size = 0
            for block, number, body, guest in zip(*[batch.column(c).to_pylist() for c in ("block", "key", "text", "guest")]):
                body = body or ""
                own = signer().signature(body)
                if held is not None and held[0] == block:
                    _, held_key, held_text, held_print = held
                    edited = edited_text(held_text, body)
                    changed = signer().signature(edited)
                    done.append((held_key, len(held_text), edited, *[x.astype(">u2").tobytes().hex() for x in (held_print, changed)],
                                 likeness(held_print, changed), likeness(held_print, own)))
                    size += len(held_text) + len(edited)
                held = None if guest else (block, number, body, own)
                if size > 8 << 20:
                    yield _rows(done)
                    done, size = [], 0
            if done:
                yield _rows(done)

    return in_order(docs, key, text).mapInArrow(pairs, PAIRED)


def _rows(done: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)


# --- near-duplicates ---------------------------------------------------------------
def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY
) -> DataFrame:
    """``(doc_id, class_id, component_id)`` for each row of ``docs``.

    A class is one text; its id is the smallest doc_id that has it (rows of a text without any doc_id get NULLs).
    Classes whose signatures agree in a whole band are candidates, and candidates whose five-word shingles reach the
    Jaccard ``similarity``, worked out from the texts, are linked. ``component_id`` is the smallest class id reached.

    In a band, all classes are first held against its least one. Those linked to it are in its component already; only
    the others meet the rest of the band, so no component is lost and a large group of copies stays linear.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = stored(rows.select("doc_id", F.sha2("text", 256).alias("digest"), fingerprint("text").alias("print")), "signatures")
    classes = texts.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.first("print").alias("print"))
    classes = stored(classes.where(F.col("class_id").isNotNull()), "classes")
    width = BAND * 4
    bands = classes.select("class_id", F.posexplode(F.array(*[
        F.xxhash64(F.substring("print", 1 + width * i, width)) for i in range(PERMUTATIONS // BAND)])).alias("band", "places"))
    least = bands.groupBy("band", "places").agg(F.min("class_id").alias("u"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = stored(bands.join(least, ["band", "places"]).where("class_id <> u").select("band", "places", "u", F.col("class_id").alias("v")), "stars")

    ids = stars.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()
    picked = rows.join(ids, "doc_id", "left_semi").select("doc_id", F.sha2("text", 256).alias("digest"), "text").join(
        classes.select("digest", F.col("class_id").alias("doc_id")), ["doc_id", "digest"], "left_semi")
    sets = stored(picked.select("doc_id", _shingles("text").alias("s")).dropDuplicates(["doc_id"]), "shingles")

    near = stored(_alike(stars.select("u", "v").distinct(), sets, similarity), "near-links")
    apart = stars.join(near, ["u", "v"], "left_anti").select("band", "places", F.col("v").alias("w"))
    rest = apart.join(stars.select("band", "places", "v"), ["band", "places"]).where("v <> w").select(
        F.least("v", "w").alias("u"), F.greatest("v", "w").alias("v")).distinct()
    roots = components(near.union(_alike(rest, sets, similarity))).withColumnRenamed("vertex", "class_id")
    members = classes.join(roots, "class_id", "left").select(
        "digest", "class_id", F.coalesce("root", "class_id").alias("component_id"))
    return texts.select("doc_id", "digest").join(members, "digest", "left").drop("digest")


def _shingles(text: str) -> Column:
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def shingles(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([signer().shingles(t).view(np.int64) for t in texts])

    return shingles(text)


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(u, v)`` whose shingle sets reach the similarity. Two texts without shingles are alike."""
    both = pairs.join(sets.select(F.col("doc_id").alias("u"), F.col("s").alias("su")), "u").join(
        sets.select(F.col("doc_id").alias("v"), F.col("s").alias("sv")), "v")
    shared = F.size(F.array_intersect("su", "sv"))
    union = F.size("su") + F.size("sv") - shared
    return both.where(F.when(union == 0, 1.0).otherwise(shared / union) >= similarity).select("u", "v")


def op1_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and the likeness of both and of the next document's."""
    return with_next(documents(spark, sf_dir)).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next")
