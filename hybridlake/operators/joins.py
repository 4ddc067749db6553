"""Join and numbering helpers that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

HOT_KEYS = 4096      # rows of the lookup that are broadcast: a bound by construction
BLOCK_ROWS = 4096    # rows of one ordered block


def hot_key_join(
    big: DataFrame,
    lookup: DataFrame,
    key: str,
    hot: DataFrame,
    spread: list[str],
    how: str = "inner",
    n_hot: int = HOT_KEYS,
) -> DataFrame:
    """Equi-join ``big`` to ``lookup`` (unique on ``key``) without a hot task.

    ``hot`` names the most frequent keys (distinct), of which at most ``n_hot`` are used. Rows of ``big`` with a hot key
    pass the ordinary join with the lookup with a NULL key, which matches nothing, and a hash of the ``spread`` columns as
    second key, which spreads them. The lookup rows of the hot keys are broadcast and meet them after that join, so the
    shuffle carries the columns of ``big`` alone, however wide the lookup is. Every row is read once.
    """
    values = [c for c in lookup.columns if c != key]
    marks = F.broadcast(hot.select(F.col(key).alias("_hot")).limit(n_hot))
    near = lookup.join(marks, F.col(key) == F.col("_hot"), "left_semi").select(
        F.col(key).alias("_near_key"), F.struct(*values).alias("_near")
    )
    far = lookup.select(
        F.col(key).alias("_far_key"), F.xxhash64(key).alias("_far_hash"), F.struct(*values).alias("_far")
    )
    is_hot = F.col("_hot").isNotNull()
    joined = (
        big.join(marks, F.col(key) == F.col("_hot"), "left")
        .withColumn("_key", F.when(~is_hot, F.col(key)))
        .withColumn("_hash", F.when(is_hot, F.xxhash64(*spread)).otherwise(F.xxhash64(key)))
        .join(far, (F.col("_hash") == F.col("_far_hash")) & (F.col("_key") == F.col("_far_key")), "left")
        .join(F.broadcast(near), F.col("_hot") == F.col("_near_key"), "left")
        .withColumn("_found", F.coalesce("_near", "_far"))
    )
    if how == "inner":
        joined = joined.where(F.col("_found").isNotNull())
    return joined.select(*big.columns, *[F.col("_found")[v].alias(v) for v in values])


def most_frequent(df: DataFrame, key: str, n_hot: int = HOT_KEYS) -> DataFrame:
    """The ``n_hot`` keys with most rows, counted with partial aggregation."""
    return (
        df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        .orderBy(F.desc("_n"), F.col(key)).limit(n_hot).select(key)
    )


def dense_number(df: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """0-based position of each row among the rows of its key, in order of an integer column.

    Rows are numbered inside blocks of neighbouring order values, and the blocks of a key are then
    shifted by the number of rows before them; only one row per block meets in one task.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / F.lit(BLOCK_ROWS)))
    local = Window.partitionBy(*keys, "_block").orderBy(order)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        blocked.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .drop("_rows")
    )
    return (
        blocked.withColumn("_local", F.row_number().over(local) - 1)
        .join(sizes, [*keys, "_block"])
        .withColumn(name, (F.col("_local") + F.col("_before")).cast("int"))
        .drop("_block", "_local", "_before")
    )
