"""Row types, closed vocabularies and the fixed texts every result must reproduce."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(28, 6)  # sums of it have 38 digits
RATE = T.DecimalType(9, 6)

# ---------------------------------------------------------------------------
# Column names of a record file, in file order.
# ---------------------------------------------------------------------------
RECORD_FILE_COLUMNS = {
    "Taxpayer Type": "taxpayer_type",
    "Tax Year": "tax_year",
    "Transaction Date": "transaction_date",
    "Income Source": "income_source",
    "Deduction Type": "deduction_type",
    "State": "state",
    "Income": "income",
    "Deductions": "deductions",
    "Taxable Income": "taxable_income",
    "Tax Rate": "tax_rate",
    "Tax Owed": "tax_owed",
}
REQUIRED_VALUES = ["taxpayer_type", "tax_year", "income", "tax_owed"]
MONEY_COLUMNS = ["income", "deductions", "taxable_income", "tax_owed"]

# The texts a CSV reader takes as "missing" by default (public pandas behaviour).
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# The closed vocabularies that questions are searched for, in priority order.
TAXPAYER_TYPES = ["Individual", "Corporation", "Partnership", "Trust", "Non-Profit"]
STATES = [
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA",
    "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA", "ME", "MD",
    "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ",
    "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC",
    "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY",
]
INCOME_SOURCES = ["Salary", "Investment", "Business Income", "Capital Gains", "Royalties", "Rental"]
DEDUCTION_TYPES = [
    "Mortgage Interest", "Charitable Contributions", "Business Expenses",
    "Education Expenses", "Medical Expenses",
]
SOURCE_KEYWORDS = ["income source", "income type"]
DEDUCTION_KEYWORDS = ["deduction", "deduct"]
SUMMARY_KEYWORDS = [
    "average", "total", "summary", "overall", "most", "highest", "lowest", "compare", "breakdown",
]
YEAR_PATTERN = r"\b(201[0-9]|202[0-9])\b"

# Sentence templates. A name in braces is filled with the column of that name.
RECORD_TEXT = (
    "{taxpayer_type} taxpayer filed in {tax_year} (transaction: {transaction_date}) in {state}. "
    "Income source: {income_source}. Gross income: {income}. "
    "Deduction type: {deduction_type}, amount: {deductions}. "
    "Taxable income: {taxable_income}. Tax rate: {tax_rate}. Tax owed: {tax_owed}."
)
SUMMARY_TEXT = {
    "taxpayer_type": (
        "Summary for {taxpayer_type} taxpayers across all years and states: "
        "Total records: {record_count}. Average income: {avg_income}. "
        "Average deductions: {avg_deductions}. Average taxable income: {avg_taxable_income}. "
        "Average tax rate: {avg_tax_rate}. Average tax owed: {avg_tax_owed}. "
        "Total tax owed: {total_tax_owed}."
    ),
    "state": (
        "Summary for the state of {state}: Total records: {record_count}. "
        "Average income: {avg_income}. Average tax owed: {avg_tax_owed}. "
        "Top income source: {top_source}. Most common taxpayer type: {top_type}."
    ),
    "tax_year": (
        "Summary for tax year {tax_year}: Total records: {record_count}. "
        "Average income: {avg_income}. Average tax rate: {avg_tax_rate}. "
        "Average tax owed: {avg_tax_owed}. Total tax collected: {total_tax_owed}."
    ),
    "taxpayer_type_year": (
        "{taxpayer_type} taxpayer summary for {tax_year}: Records: {record_count}. "
        "Avg income: {avg_income}. Avg tax rate: {avg_tax_rate}. Avg tax owed: {avg_tax_owed}."
    ),
    "income_source": (
        "Income source '{income_source}': Total records: {record_count}. "
        "Average income: {avg_income}. Average tax owed: {avg_tax_owed}. "
        "Average tax rate: {avg_tax_rate}."
    ),
}
SUMMARY_ID = {
    "taxpayer_type": "agg_type_{type_slug}",
    "state": "agg_state_{state}",
    "tax_year": "agg_year_{tax_year}",
    "taxpayer_type_year": "agg_type_year_{type_slug}_{tax_year}",
    "income_source": "agg_source_{source_slug}",
}
RECORD_SOURCE = "Financial_Information.csv"
SUMMARY_SOURCE = "csv_aggregate"
PROMPT_TEXT = (
    "CONTEXT FROM KNOWLEDGE BASE:\n{rule}\n{context}\n{rule}\n\n"
    "USER QUESTION: {message}\n\nPlease answer the question using the context above."
)
NOTHING_FOUND = "No relevant financial information found in the knowledge base."
GRAPH_HEADER = "[Graph Database — {label}]"
HITS_HEADER = "[Semantic Search Results]"

# Limits and thresholds.
CHUNK_WORDS = 512
CHUNK_OVERLAP = 50
MIN_CHUNK_CHARS = 80       # a word window must be longer
MIN_PAGE_CHARS = 100       # a page that is shorter joins the next long one
MIN_SLIDE_CHARS = 40       # slide content and notes must be longer
SCORE_THRESHOLD = 0.25
DEFAULT_RESULTS = 8
MAX_RESULTS = 20
MAX_MESSAGE_CHARS = 2000
SHOWN_ROWS = 15
SHOWN_SOURCES = 5
SUMMARY_GROUPS = 20

# ---------------------------------------------------------------------------
# Row types
# ---------------------------------------------------------------------------
RECORD = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("taxpayer_type", T.StringType()),
    T.StructField("tax_year", T.IntegerType()),
    T.StructField("transaction_date", T.StringType()),
    T.StructField("income_source", T.StringType()),
    T.StructField("deduction_type", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("income", MONEY),
    T.StructField("deductions", MONEY),
    T.StructField("taxable_income", MONEY),
    T.StructField("tax_rate", RATE),
    T.StructField("tax_owed", MONEY),
])

# `source` and `source_type` stand beside the map so that filters on them reach the Parquet scan.
CHUNK = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("source_type", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])
CHUNK_COLUMNS = CHUNK.fieldNames()

PAGE = T.StructType([
    T.StructField("filename", T.StringType()),
    T.StructField("page_num", T.IntegerType()),
    T.StructField("text", T.StringType()),
])

SLIDE_PARAGRAPH = T.StructType([
    T.StructField("filename", T.StringType()),
    T.StructField("slide", T.IntegerType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("shape_name", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("is_notes", T.BooleanType()),
])

QUESTION = T.StructType([
    T.StructField("qid", T.LongType()),
    T.StructField("message", T.StringType()),
    T.StructField("n_results", T.IntegerType()),
])

EVAL_ITEM = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("expected_sources", T.ArrayType(T.StringType())),
    T.StructField("expected_contains", T.ArrayType(T.StringType())),
    T.StructField("category", T.StringType()),
    T.StructField("requires_graph", T.BooleanType()),
])

# The star graph: relation -> (dimension label, record column).
RELATIONS = {
    "FILED_BY": ("TaxpayerType", "taxpayer_type"),
    "IN_STATE": ("State", "state"),
    "IN_YEAR": ("TaxYear", "tax_year"),
    "HAS_SOURCE": ("IncomeSource", "income_source"),
    "HAS_DEDUCTION": ("DeductionType", "deduction_type"),
}
