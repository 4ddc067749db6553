"""Views that present the test tables as records, pages, slides, questions and evaluation items."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hybridlake.functions.columns import fill, strip, words
from hybridlake.schemas import INCOME_SOURCES, RATE, RECORD_FILE_COLUMNS, STATES

# How the test tables' vocabularies map to the record vocabularies.
SEGMENT_TYPE = {
    "AUTOMOBILE": "Individual", "BUILDING": "Corporation", "FURNITURE": "Partnership",
    "HOUSEHOLD": "Trust", "MACHINERY": "Non-Profit",
}
PART_SOURCE = {
    "ECONOMY": "Salary", "LARGE": "Investment", "MEDIUM": "Business Income",
    "PROMO": "Capital Gains", "SMALL": "Royalties", "STANDARD": "Rental",
}
PRIORITY_DEDUCTION = {
    "1-URGENT": "Mortgage Interest", "2-HIGH": "Charitable Contributions", "3-MEDIUM": "Business Expenses",
    "4-NOT SPECIFIED": "Education Expenses", "5-LOW": "Medical Expenses",
}
YEAR_SHIFT = 20
MONEY = "decimal(18,6)"  # enough for the test tables' prices
FILE_PREFIXES = ["slides_", "i1040_", "usc_", "report_"]

# Question texts by order key modulo 10.
QUESTIONS = [
    "What do {type} filers owe on average in {any_state}?",
    "What is the tax bill of {type} filers?",
    "Give the figures for {state}",
    "Give the figures for {year}",
    "How much comes from {source} each year?",
    "How large is {deduction}?",
    "Show the overall breakdown",
    "{type} filers in {year}, compare",
    "Explain the excise levy",
    "",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table that row-wise work follows on. One with fewer splits than cores is spread first."""
    df, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _mapped(column: Column, mapping: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(column == k, F.lit(v)) for k, v in mapping.items()])


def _entry(values: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def tax_records(spark: SparkSession, sf_dir: str, extra: list[str] | None = None) -> DataFrame:
    """One record per line item; all figures are exact decimal products."""
    lines = spread_table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer")
    nations = table(spark, sf_dir, "nation")
    parts = table(spark, sf_dir, "part")
    filed = (  # orders meet their customers before the lines, which are several times as many
        orders.join(customers, orders.o_custkey == customers.c_custkey)
        .join(nations, customers.c_nationkey == nations.n_nationkey)
    )
    joined = lines.join(parts, lines.l_partkey == parts.p_partkey).join(filed, lines.l_orderkey == orders.o_orderkey)
    price = F.col("l_extendedprice").cast("decimal(10,2)")
    discount = F.col("l_discount").cast("decimal(4,2)")
    rest = (F.lit(1).cast("decimal(4,2)") - discount).cast("decimal(4,2)")
    rate = F.col("l_tax").cast("decimal(4,2)")
    return joined.select(
        F.concat_ws(
            "-", *[F.col(c).cast("string") for c in ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]],
            F.date_format("l_shipdate", "yyyy-MM-dd"),
        ).alias("id"),
        _mapped(F.col("c_mktsegment"), SEGMENT_TYPE).alias("taxpayer_type"),
        (F.year("o_orderdate") + YEAR_SHIFT).cast("int").alias("tax_year"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("transaction_date"),
        _mapped(F.col("p_type"), PART_SOURCE).alias("income_source"),
        _mapped(F.col("o_orderpriority"), PRIORITY_DEDUCTION).alias("deduction_type"),
        _entry(STATES[:25], F.col("n_nationkey")).alias("state"),
        price.cast(MONEY).alias("income"),
        (price * discount).cast(MONEY).alias("deductions"),
        (price * rest).cast(MONEY).alias("taxable_income"),
        rate.cast(RATE).alias("tax_rate"),
        (price * rest * rate).cast(MONEY).alias("tax_owed"),
        *(extra or []),
    )


def tax_records_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of which some miss their income."""
    lost = (F.col("l_linenumber") == 7) & (F.col("l_quantity") < 5)
    records = tax_records(spark, sf_dir, ["l_linenumber", "l_quantity"])
    return records.withColumn("income", F.when(~lost, F.col("income"))).drop("l_linenumber", "l_quantity")


def tax_records_without_type_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of which some have no taxpayer type, so no FILED_BY edge."""
    records = tax_records(spark, sf_dir, ["l_quantity"])
    return records.withColumn(
        "taxpayer_type", F.when(F.col("l_quantity") != 1, F.col("taxpayer_type"))
    ).drop("l_quantity")


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as paged files, one page per line."""
    documents = spread_table(spark, sf_dir, "documents")
    filename = F.concat(
        _entry(FILE_PREFIXES, F.col("doc_id") % 4), F.col("doc_id").cast("string"), F.lit(".pdf")
    )
    return documents.select(
        filename.alias("filename"), F.posexplode(F.split("text", "\n")).alias("page_num", "text")
    )


def slide_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as slide decks: user and system turns on the slide, assistant turns as its notes."""
    turns = table(spark, sf_dir, "conversations")
    exploded = turns.select("conv_id", "turn", "role", F.posexplode(F.split("text", r"\. ")).alias("n", "sentence"))
    return exploded.select(
        F.concat(F.lit("deck_"), F.col("conv_id").cast("string"), F.lit(".pptx")).alias("filename"),
        (F.floor(F.col("turn") / 2) + 1).cast("int").alias("slide"),
        (F.col("turn") * 1000 + F.col("n")).cast("int").alias("pos"),
        F.when((F.col("role") == "user") & (F.col("n") == 0), "Title 1").otherwise("Content 2").alias("shape_name"),
        strip(F.col("sentence")).alias("text"),
        (F.col("role") == "assistant").alias("is_notes"),
    ).where(F.col("text") != "")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per order; result counts run from 0 to 21 and are missing for every fourth."""
    orders = spread_table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer")
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey)
    turn = F.floor(F.col("o_orderkey") / 10)
    parts = {
        "type": _mapped(F.col("c_mktsegment"), SEGMENT_TYPE),
        "any_state": _entry(STATES, turn % len(STATES)),
        "state": _entry(STATES[:25], F.col("c_nationkey")),
        "year": (F.year("o_orderdate") + YEAR_SHIFT).cast("string"),
        "source": _entry(INCOME_SOURCES, turn % len(INCOME_SOURCES)),
        "deduction": _mapped(F.col("o_orderpriority"), PRIORITY_DEDUCTION),
    }
    message = F.lit("")
    for k, text in enumerate(QUESTIONS[:-1]):
        message = F.when(F.col("o_orderkey") % 10 == k, fill(text, **parts)).otherwise(message)
    return joined.select(
        F.col("o_orderkey").alias("qid"),
        message.alias("message"),
        F.when(turn % 4 != 0, turn % 22).cast("int").alias("n_results"),
    )


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("message"))


def letter_counts():
    """A deterministic stand-in for a model: how often each letter from a to z stands in a text."""
    letters = [chr(c) for c in range(ord("a"), ord("z") + 1)]

    def model(texts: list[str]) -> np.ndarray:
        return np.array([[t.count(c) + t.count(c.upper()) for c in letters] for t in texts], dtype=np.float32)

    return model


def sentence_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct sentence of all conversation turns, as its own message."""
    turns = table(spark, sf_dir, "conversations")
    parts = turns.select(F.explode(F.split("text", r"[.\n]")).alias("message"))
    return parts.select(strip(F.col("message")).alias("message")).where(F.col("message") != "").distinct().select(F.col("message").alias("qid"), "message")


def write_record_files(records: DataFrame, path: str, titles: list[str], note: Column | None = None) -> None:
    """Records as packed CSV files with a header in the order of ``titles``, some of which may be no record columns."""
    columns = [F.col(RECORD_FILE_COLUMNS[t]).alias(t) if t in RECORD_FILE_COLUMNS else note.alias(t) for t in titles]
    records.select(*columns).write.option("header", True).option("escape", '"').option("compression", "gzip").csv(path)


def text_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("source_type")
    )


def eval_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item per user turn of all conversations: its words are the keywords."""
    turns = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("question"),
        words(F.col("text")).alias("expected_contains"),
        F.concat(F.lit("cat"), (F.col("conv_id") % 5).cast("string")).alias("category"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assistant turn that follows each user turn."""
    turns = table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    return turns.select(F.concat_ws("-", F.col("conv_id"), F.col("turn") - 1).alias("id"), F.col("text").alias("answer"))
