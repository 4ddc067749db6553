"""Additive partial measures of records, the common input of summaries and graph queries.

Every measure is an exact decimal sum beside a count, so partial results can be added in any order
and at any level. One pass over the records (``record_rollup``) serves all twelve aggregates: the
rollup has at most types x years x states x sources x deductions rows, however many records there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hybridlake.functions.columns import mean

KEYS = ["taxpayer_type", "tax_year", "state", "income_source", "deduction_type"]
MEASURES = ["income", "deductions", "taxable_income", "tax_rate", "tax_owed"]
_SUMS = [f"{p}_{m}" for m in [*MEASURES, "ratio"] for p in ("sum", "n")]


def partials(records: DataFrame) -> DataFrame:
    """One row per record in the shape of a rollup (a projection, no shuffle)."""
    ratio = F.try_divide(F.col("taxable_income").cast("double"), F.col("income").cast("double"))
    values = {m: F.col(m) for m in MEASURES} | {"ratio": ratio}
    columns = []
    for name, value in values.items():
        columns.append(value.alias(f"sum_{name}"))
        columns.append(F.when(value.isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias(f"n_{name}"))
    return records.select(*KEYS, F.lit(1).cast("bigint").alias("n"), *columns)


def record_rollup(records: DataFrame) -> DataFrame:
    """Partial measures per combination of all five keys: the only pass over the records."""
    return partials(records).groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in ["n", *_SUMS]])


def group_sums(rows: DataFrame, *keys: str) -> DataFrame:
    """Add partial measures up to coarser keys."""
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ["n", *_SUMS]])


def average(measure: str) -> Column:
    return mean(F.col(f"sum_{measure}"), F.col(f"n_{measure}"))


def total(measure: str) -> Column:
    return F.col(f"sum_{measure}").cast("double")


def count() -> Column:
    return F.col("n").cast("bigint")
