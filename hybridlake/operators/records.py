"""Record rows: validity, ids, the typed projection and the sentence per record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hybridlake.functions.columns import fill, money, or_nan, percent
from hybridlake.schemas import (
    CHUNK_COLUMNS, MONEY_COLUMNS, RECORD, RECORD_SOURCE, RECORD_TEXT, REQUIRED_VALUES,
)

CONTENT = [f.name for f in RECORD.fields if f.name != "id"]
_COPIES_PER_BLOCK = 100_000


def valid_records(records: DataFrame) -> DataFrame:
    """Rows that hold type, year, income and tax owed."""
    return records.na.drop("any", subset=REQUIRED_VALUES)


def content_hash(columns: list[str] = CONTENT):
    """SHA-256 over the columns. Each value stands behind its length, so no two rows give the same text; NULL has none."""
    def field(name: str):
        text = F.col(name).cast("string")
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def with_record_ids(records: DataFrame) -> DataFrame:
    """Add an id that is the same on every load: content hash plus number of the copy.

    Equal rows are counted, with partial aggregation before the shuffle, instead of being ranked:
    copies are interchangeable, so numbering 1..n only needs n. The n copies are written out in
    blocks that are spread again, so one row repeated without bound never fills one task.
    """
    counted = records.groupBy(*CONTENT).agg(F.count(F.lit(1)).alias("_n"))
    per_block = F.lit(_COPIES_PER_BLOCK).cast("bigint")
    few = counted.where(F.col("_n") <= per_block).withColumn("_first", F.lit(1).cast("bigint"))
    many = (
        counted.where(F.col("_n") > per_block)
        .withColumn("_first", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"), per_block)))
        .repartition("_first", *CONTENT)
    )
    last = F.least(F.col("_n"), F.col("_first") + per_block - 1)
    numbered = few.unionByName(many).withColumn("_copy", F.explode(F.sequence(F.col("_first"), last)))
    return numbered.select(
        F.concat_ws("-", content_hash(), F.col("_copy").cast("string")).alias("id"), *CONTENT
    )


def record_params(records: DataFrame) -> DataFrame:
    """The typed, snake-case projection written to the graph; figures as doubles."""
    return records.select(
        "id", "taxpayer_type", F.col("tax_year").cast("int"), F.col("transaction_date").cast("string"),
        "income_source", "deduction_type", "state",
        *[F.col(c).cast("double").alias(c) for c in ["income", "deductions", "taxable_income", "tax_rate", "tax_owed"]],
    )


def record_sentence():
    """One readable sentence per record."""
    parts = {c: or_nan(F.col(c)) for c in CONTENT}
    parts |= {c: F.coalesce(money(F.col(c)), F.lit("$nan")) for c in MONEY_COLUMNS}
    parts["tax_rate"] = F.coalesce(percent(F.col("tax_rate")), F.lit("nan%"))
    return fill(RECORD_TEXT, **parts)


def record_texts(records: DataFrame) -> DataFrame:
    return records.select("id", record_sentence().alias("text"))


def chunk_id() -> Column:
    return F.concat(F.lit("csv_row_"), "id")


def record_chunks(records: DataFrame) -> DataFrame:
    """One chunk per record."""
    return records.select(
        chunk_id().alias("id"),
        record_sentence().alias("text"),
        F.lit(RECORD_SOURCE).alias("source"),
        F.lit("csv").alias("source_type"),
        F.create_map(
            F.lit("source"), F.lit(RECORD_SOURCE),
            F.lit("source_type"), F.lit("csv"),
            F.lit("taxpayer_type"), F.col("taxpayer_type"),
            F.lit("tax_year"), F.col("tax_year").cast("string"),
            F.lit("state"), F.col("state"),
        ).alias("metadata"),
    ).select(*CHUNK_COLUMNS)
