"""Tables cut from their lineage, in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from hybridlake.session import work_dir


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back: reruns after a loss start from the files."""
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
