"""Keyword evaluation of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hybridlake.functions.columns import missing_keywords


def evaluate(items: DataFrame, answers: DataFrame) -> DataFrame:
    """Per item: the expected keywords its answer lacks, and whether it passes.

    An item without id, question or keyword list is malformed and does not pass; neither does one
    without an answer, unless it expects nothing.
    """
    malformed = F.col("id").isNull() | F.col("question").isNull() | F.col("expected_contains").isNull()
    text = F.coalesce("answer", F.lit(""))
    missing = missing_keywords(text, F.coalesce("expected_contains", F.array().cast("array<string>")))
    judged = items.join(answers.select("id", "answer"), "id", "left").select(
        "id", "category", malformed.alias("malformed"), missing.alias("missing")
    )
    return judged.withColumn("passed", ~F.col("malformed") & (F.size("missing") == 0))


def pass_rates(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("category").agg(
        F.count(F.lit(1)).cast("bigint").alias("items"),
        F.sum(F.col("passed").cast("bigint")).alias("passed"),
        (F.sum(F.col("passed").cast("bigint")).cast("double") / F.count(F.lit(1))).alias("pass_rate"),
    )
