"""Session defaults and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks; on a cluster the submitter's session is used as it is."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("hybridlake")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A new sub-folder of the shared folder named by ``spark.checkpoint.dir``.

    Only a local session that names none (tests on one machine) gets a temporary folder; on a cluster that is an error, as
    executors would not share it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or _own_folder(spark)
    return f"{root.rstrip('/')}/hybridlake/{purpose}-{uuid.uuid4().hex}"


_OWN: dict[str, str] = {}


def _own_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = tempfile.mkdtemp(prefix="hybridlake-")
    return _OWN[context.applicationId]
