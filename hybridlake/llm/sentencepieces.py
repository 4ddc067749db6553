"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of a supported model holds the white space marker behind another character, so no merge crosses the start of
a marked word: a chunk (marker or markers, then characters without one). Each distinct chunk is segmented once per
worker by the library and kept in a bounded table; the ids of a text are the ids of its chunks joined by position.
The table stays beside the texts: shuffling every word occurrence to a table of the whole corpus would move several
times the input.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F, types as T

from hybridlake.llm.texts import CACHED_LENGTH, CACHED_WORDS, byte_slices, documents, fresh, trimmed

MARKER = "▁"
CHUNK = re.compile(" *[^ ]+| +")


def crosses_chunks(pieces: list[str]) -> bool:
    """Whether some piece holds a marker behind another character."""
    return any(MARKER in piece.lstrip(MARKER) for piece in pieces)


class ChunkTable(dict):
    """Ids of each chunk seen, segmented once by the library."""

    def __init__(self, model: str) -> None:
        super().__init__()
        self.processor = sentencepiece.SentencePieceProcessor(model_file=model)
        n = self.processor.get_piece_size()
        pieces = [self.processor.id_to_piece(i) for i in range(n) if not self.processor.is_control(i)]
        # Chunks are valid units only if the model marks the start of a text and keeps every space.
        marked = self.processor.encode("a  a", out_type=str)
        plain = "".join(marked) == f"{MARKER}a{MARKER}{MARKER}a" and self.processor.decode(
            self.processor.encode(" Aéﬁ  ")) == " Aéﬁ  "
        self.by_chunk = plain and not crosses_chunks(pieces)
        self.end = [self.processor.eos_id()]

    def __missing__(self, chunk: str) -> list[int]:
        ids = self.processor.encode(chunk[1:])  # the library puts the first marker back
        if len(chunk) <= CACHED_LENGTH:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[chunk] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return list(self.end)
        if not self.by_chunk:
            return self.processor.encode(text) + self.end
        ids: list[int] = []
        for chunk in CHUNK.findall(" " + text.replace(MARKER, " ")):
            # A chunk of one space at the end of a text, or before it, stands for a lone marker.
            ids += self[chunk] if len(chunk) > 1 else self.lone()
        return ids + self.end

    def lone(self) -> list[int]:
        """The ids of a marker alone, which the library never makes of an empty text."""
        if " " not in self:
            last = self.processor.encode("a ")
            self[" "] = last[len(self.processor.encode("a")):]
        return self[" "]


_tables: dict[str, ChunkTable] = {}


def chunk_table(model: str) -> ChunkTable:
    if model not in _tables:
        _tables[model] = ChunkTable(model)
    return _tables[model]


def encode_decode(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array<int>, the end id last) and ``decoded`` (the library's decode of those ids).

    ``model`` is a path that every executor can read. NULL texts count as empty: the end id alone, decoded to ''.
    Columns of ``docs`` called ``ids`` or ``decoded`` are replaced; all others, NULLs and repeated rows pass unchanged.
    Texts of any length are encoded whole; an empty table gives an empty table.
    """
    kept = [c for c in docs.columns if c.lower() not in ("ids", "decoded")]
    source = fresh(docs, "encoded_text")
    docs = docs.select(*kept, F.col(text).alias(source))
    fields = [f for f in docs.schema.fields if f.name != source]
    schema = T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunk_table(model)
        for batch in trimmed(stream, table):
            at = batch.schema.get_field_index(source)
            texts = batch.column(at).to_pylist()
            rest = [i for i in range(batch.num_columns) if i != at]
            for part in byte_slices(texts):
                ids = [table.encode(t) for t in texts[part]]
                decoded = [table.processor.decode(x) for x in ids]
                cut = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays(
                    [*[cut.column(i) for i in rest], pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())],
                    names=[*[batch.schema.names[i] for i in rest], "ids", "decoded"],
                )

    return docs.mapInArrow(batches, schema)


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded; counts and digests of the ids and of the decoded text."""
    import public_tokenizers

    docs = documents(spark, sf_dir).select("doc_id", "text")
    return digests(encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model")), "doc_id")


def digests(encoded: DataFrame, *keys: str) -> DataFrame:
    return encoded.select(
        *keys,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
