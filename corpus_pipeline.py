"""A corpus pipeline: toxic documents out, near-duplicates out, repeated passages out, sources mixed, texts tokenised."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from hybridlake.llm import mixing, sentencepieces, simhash, substrings, toxicity
from hybridlake.llm.stored import stored
from hybridlake.llm.texts import documents


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It learns from the labels of one sample of these documents."""
    model = toxicity.train(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.toxicity(spark, model, "text") < toxicity.THRESHOLD)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the smallest doc_id."""
    return simhash.representatives(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier one holds. Texts that lose nothing stay as they are.

    The words that stay are joined by one space, and n_chars (where the table has it) counts the new text.
    """
    inner = docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "text")
    cut = substrings.without_repeats(inner)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("doc.text"))
    changed = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.char_length("kept").cast("long")).otherwise(
        F.col("doc.n_chars"))} if "n_chars" in docs.columns else {"text": text}
    return cut.select(*[changed.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every document as often as its source's target asks for."""
    return mixing.mixed_rows(docs)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text of the mix, and the text they decode to."""
    return sentencepieces.encode_decode(docs.select("doc_id", "source", "text"), public_tokenizers.path("piece_bpe_32k.model")).select(
        "doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", toxicity_stage), ("simhash near-dedup", simhash_stage), ("substring dedup", substring_stage),
    ("mixing", mixing_stage), ("sentencepiece", sentencepiece_stage),
]

#: The trained classifier, XXH64 fingerprints and the tokenizer cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written and read again."""
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{i + 1}")
    return docs
