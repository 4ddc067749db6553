"""Evaluation items: one JSON array per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hybridlake.schemas import EVAL_ITEM


def read_eval_items(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVAL_ITEM).json(path, multiLine=True)
