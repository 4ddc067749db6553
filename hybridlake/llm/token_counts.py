"""Token counts of whole texts with the library's own batch encoder; only lengths leave the Python worker.

A text is cut where a space stands between two other characters that are not white space: the byte-level splitter of
these vocabularies always starts a new word there, so counts of the pieces add up. Pieces seen before are looked up in
a bounded table; the others go to the encoder in batches balanced by bytes. A piece of any length is encoded whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from hybridlake.llm.texts import CACHED_LENGTH, CACHED_WORDS, byte_slices, documents

#: A safe cut is before a single space with a character that is not white space on either side.
SAFE = re.compile(r"(?<=\S)(?= \S)")


def safe_pieces(text: str) -> list[str]:
    """``text`` cut at every safe boundary; the pieces joined give the text."""
    return SAFE.split(text)


class PieceCounts(dict):
    """Tokens of each piece seen."""

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        self.by_piece = path.endswith(".json")
        if self.by_piece:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.count = lambda texts: [
                len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            # Pieces add up only where words keep their leading space.
            self.by_piece = self.count(["a b  c\n d"]) == [sum(self.count(safe_pieces("a b  c\n d")))] and (
                tokenizer.normalizer is None)
        else:
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_file=path)
            self.count = lambda texts: [len(ids) for ids in processor.encode(texts, num_threads=1)]

    def counts(self, texts: list[str]) -> list[int]:
        if not self.by_piece:
            return list(chain.from_iterable(self.count(texts[part]) for part in byte_slices(texts)))
        pieces = [safe_pieces(t) if t else [] for t in texts]
        if len(self) >= CACHED_WORDS:
            self.clear()
        new = list(set(chain.from_iterable(pieces)).difference(self))
        for part in byte_slices(new, 1 << 20):
            self.update(zip(new[part], self.count(new[part])))
        totals = [sum(map(self.__getitem__, p)) for p in pieces]
        for piece in new:
            if len(piece) > CACHED_LENGTH:
                del self[piece]
        return totals


_counters: dict[str, PieceCounts] = {}


def token_count(path: str, text: Column | str) -> Column:
    """Tokens of ``text`` with the vocabulary file at ``path`` (``.json`` or ``.model``), which every executor can read.

    No begin, end or other special tokens are added, nothing is cut or padded; NULL and empty texts have 0.
    """

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if path not in _counters:
            _counters[path] = PieceCounts(path)
        for texts in batches:
            whole = texts.fillna("").tolist()
            yield pd.Series(list(chain.from_iterable(
                _counters[path].counts(whole[part]) for part in byte_slices(whole))), dtype="int64")

    return count(text)


def with_token_counts(docs: DataFrame, path: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` in place of columns of those names."""
    source = F.coalesce(F.col(text), F.lit(""))
    counted = docs.withColumns({"n_bytes": F.octet_length(source).cast("long"), "n_tokens": token_count(path, source)})
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it is over 1,024 tokens."""
    import public_tokenizers

    docs = documents(spark, sf_dir).select("doc_id", "text")
    counted = with_token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")
