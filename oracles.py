"""DuckDB SQL that answers each registered query on the same Parquet tables.

Every query is a SELECT over named sub-queries; ``sql`` puts the ones it needs in front of it.
"""

from __future__ import annotations

import re

from hybridlake import fixtures as fx
from hybridlake.functions.text import OTHER_SOURCE_TYPE, SOURCE_TYPE_PARTS
from hybridlake.schemas import (
    DEDUCTION_KEYWORDS, DEDUCTION_TYPES, INCOME_SOURCES, NOTHING_FOUND, RELATIONS, SOURCE_KEYWORDS,
    STATES, SUMMARY_KEYWORDS, TAXPAYER_TYPES,
)


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def case(column: str, mapping: dict[str, str]) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in mapping.items()) + " END"


def entry(values: list[str], index: str) -> str:
    return "[" + ", ".join(quote(v) for v in values) + f"][CAST({index} AS INT) + 1]"


def any_of(column: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {quote(n)})" for n in needles) + ")"


def first_of(column: str, values: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN contains({column}, {quote(v.lower())}) THEN {quote(v)}" for v in values) + " END"


def money(x: str) -> str:
    return f"('$' || format('{{:,.2f}}', CAST({x} AS DOUBLE)))"


def percent(x: str) -> str:
    return f"(format('{{:.2f}}', CAST({x} AS DOUBLE) * 100) || '%')"


def mean(x: str) -> str:
    return f"(CAST(sum({x}) AS DOUBLE) / count({x}))"


def hashed(*columns: str) -> str:
    """The text behind a content hash: every value behind its length."""
    return " || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def clean(x: str) -> str:
    for pattern, new in [("\\x0c", "chr(10)"), ("\\r\\n|\\r", "chr(10)"), ("\\n{3,}", "chr(10) || chr(10)"), ("[ \\t]{2,}", "' '")]:
        x = f"regexp_replace({x}, '{pattern}', {new}, 'g')"
    return strip(x)


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"


def terms(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


def source_type(x: str) -> str:
    return "CASE " + " ".join(
        f"WHEN {any_of(f'lower({x})', parts)} THEN {quote(label)}" for label, parts in SOURCE_TYPE_PARTS.items()
    ) + f" ELSE {quote(OTHER_SOURCE_TYPE)} END"


P, D, R = "CAST(l_extendedprice AS DECIMAL(10,2))", "CAST(l_discount AS DECIMAL(4,2))", "CAST(l_tax AS DECIMAL(4,2))"
REST = f"CAST(CAST(1 AS DECIMAL(4,2)) - {D} AS DECIMAL(4,2))"
MEASURES = ["income", "deductions", "taxable_income", "tax_rate", "tax_owed"]

PARTS: dict[str, str] = {}

PARTS["tax_lines"] = f"""
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d')) AS id,
  {case('c_mktsegment', fx.SEGMENT_TYPE)} AS taxpayer_type,
  CAST(year(o_orderdate) + 20 AS INTEGER) AS tax_year,
  strftime(o_orderdate, '%Y-%m-%d') AS transaction_date,
  {case('p_type', fx.PART_SOURCE)} AS income_source,
  {case('o_orderpriority', fx.PRIORITY_DEDUCTION)} AS deduction_type,
  {entry(STATES[:25], 'n_nationkey')} AS state,
  CAST({P} AS DECIMAL(18,6)) AS income,
  CAST({P} * {D} AS DECIMAL(18,6)) AS deductions,
  CAST({P} * {REST} AS DECIMAL(18,6)) AS taxable_income,
  CAST({R} AS DECIMAL(9,6)) AS tax_rate,
  CAST({P} * {REST} * {R} AS DECIMAL(18,6)) AS tax_owed,
  l_linenumber, l_quantity
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey"""
PARTS["tax_records"] = "SELECT * EXCLUDE (l_linenumber, l_quantity) FROM tax_lines"
PARTS["record_texts"] = f"""
SELECT id, taxpayer_type, tax_year, state,
  taxpayer_type || ' taxpayer filed in ' || tax_year || ' (transaction: ' || transaction_date || ') in ' || state
  || '. Income source: ' || income_source || '. Gross income: ' || {money('income')}
  || '. Deduction type: ' || deduction_type || ', amount: ' || {money('deductions')}
  || '. Taxable income: ' || {money('taxable_income')} || '. Tax rate: ' || {percent('tax_rate')}
  || '. Tax owed: ' || {money('tax_owed')} || '.' AS text
FROM tax_records"""
PARTS["record_chunks"] = """
SELECT 'csv_row_' || id AS id, text, 'Financial_Information.csv' AS source, 'csv' AS source_type,
  taxpayer_type, CAST(tax_year AS VARCHAR) AS tax_year, state FROM record_texts"""

_AVG = {m: mean(m) for m in MEASURES}
PARTS["summary_by_type"] = f"""
SELECT 'agg_type_' || replace(taxpayer_type, ' ', '_') AS id,
  'Summary for ' || taxpayer_type || ' taxpayers across all years and states: Total records: ' || count(*)
  || '. Average income: ' || {money(_AVG['income'])} || '. Average deductions: ' || {money(_AVG['deductions'])}
  || '. Average taxable income: ' || {money(_AVG['taxable_income'])} || '. Average tax rate: ' || {percent(_AVG['tax_rate'])}
  || '. Average tax owed: ' || {money(_AVG['tax_owed'])} || '. Total tax owed: ' || {money('sum(tax_owed)')} || '.' AS text,
  'csv_aggregate' AS source, 'taxpayer_type' AS "group", taxpayer_type AS value,
  CAST(NULL AS VARCHAR) AS taxpayer_type, CAST(NULL AS VARCHAR) AS "year"
FROM tax_records t GROUP BY t.taxpayer_type"""
PARTS["state_modes"] = """
SELECT s.state, s.income_source AS top_source, t.taxpayer_type AS top_type FROM
  (SELECT state, income_source, row_number() OVER (PARTITION BY state ORDER BY count(*) DESC, income_source) AS n
   FROM tax_records GROUP BY 1, 2) s
JOIN (SELECT state, taxpayer_type, row_number() OVER (PARTITION BY state ORDER BY count(*) DESC, taxpayer_type) AS n
   FROM tax_records GROUP BY 1, 2) t ON s.state = t.state WHERE s.n = 1 AND t.n = 1"""
PARTS["summary_by_state"] = f"""
SELECT 'agg_state_' || state AS id,
  'Summary for the state of ' || state || ': Total records: ' || count(*) || '. Average income: ' || {money(_AVG['income'])}
  || '. Average tax owed: ' || {money(_AVG['tax_owed'])} || '. Top income source: ' || any_value(top_source)
  || '. Most common taxpayer type: ' || any_value(top_type) || '.' AS text,
  'csv_aggregate' AS source, 'state' AS "group", state AS value,
  CAST(NULL AS VARCHAR) AS taxpayer_type, CAST(NULL AS VARCHAR) AS "year"
FROM tax_records t JOIN state_modes m USING (state) GROUP BY state"""
PARTS["summary_by_year"] = f"""
SELECT 'agg_year_' || tax_year AS id,
  'Summary for tax year ' || tax_year || ': Total records: ' || count(*) || '. Average income: ' || {money(_AVG['income'])}
  || '. Average tax rate: ' || {percent(_AVG['tax_rate'])} || '. Average tax owed: ' || {money(_AVG['tax_owed'])}
  || '. Total tax collected: ' || {money('sum(tax_owed)')} || '.' AS text,
  'csv_aggregate' AS source, 'tax_year' AS "group", CAST(tax_year AS VARCHAR) AS value,
  CAST(NULL AS VARCHAR) AS taxpayer_type, CAST(NULL AS VARCHAR) AS "year"
FROM tax_records GROUP BY tax_year"""
PARTS["summary_by_type_year"] = f"""
SELECT 'agg_type_year_' || replace(t.taxpayer_type, ' ', '_') || '_' || tax_year AS id,
  t.taxpayer_type || ' taxpayer summary for ' || tax_year || ': Records: ' || count(*) || '. Avg income: ' || {money(_AVG['income'])}
  || '. Avg tax rate: ' || {percent(_AVG['tax_rate'])} || '. Avg tax owed: ' || {money(_AVG['tax_owed'])} || '.' AS text,
  'csv_aggregate' AS source, 'taxpayer_type_year' AS "group", CAST(NULL AS VARCHAR) AS value,
  t.taxpayer_type AS taxpayer_type, CAST(tax_year AS VARCHAR) AS "year"
FROM tax_records t GROUP BY t.taxpayer_type, tax_year"""
PARTS["summary_by_source"] = f"""
SELECT 'agg_source_' || replace(income_source, ' ', '_') AS id,
  'Income source ''' || income_source || ''': Total records: ' || count(*) || '. Average income: ' || {money(_AVG['income'])}
  || '. Average tax owed: ' || {money(_AVG['tax_owed'])} || '. Average tax rate: ' || {percent(_AVG['tax_rate'])} || '.' AS text,
  'csv_aggregate' AS source, 'income_source' AS "group", income_source AS value,
  CAST(NULL AS VARCHAR) AS taxpayer_type, CAST(NULL AS VARCHAR) AS "year"
FROM tax_records GROUP BY income_source"""
PARTS["summary_chunks"] = " UNION ALL ".join(
    f"SELECT * FROM {n}" for n in
    ["summary_by_type", "summary_by_state", "summary_by_year", "summary_by_type_year", "summary_by_source"]
)

PARTS["g_all"] = f"""
SELECT taxpayer_type, state, tax_year AS "year", CAST(count(*) AS BIGINT) AS "count", {mean('income')} AS avg_income,
  {mean('tax_owed')} AS avg_tax_owed, {mean('tax_rate')} AS avg_tax_rate FROM tax_records GROUP BY ALL"""
PARTS["g_general_summary"] = 'SELECT * FROM g_all ORDER BY "count" DESC, taxpayer_type, state, "year" LIMIT 20'
PARTS["g_by_type"] = f"""
SELECT taxpayer_type, {mean('tax_owed')} AS avg_tax_owed, {mean('tax_rate')} AS avg_tax_rate,
  CAST(count(*) AS BIGINT) AS record_count FROM tax_records GROUP BY ALL"""
PARTS["g_by_state"] = f"""
SELECT state, taxpayer_type, {mean('tax_owed')} AS avg_tax_owed, CAST(count(*) AS BIGINT) AS record_count
FROM tax_records GROUP BY ALL"""
PARTS["g_by_year"] = f"""
SELECT tax_year AS "year", taxpayer_type, state, {mean('income')} AS avg_income, {mean('tax_owed')} AS avg_tax_owed,
  CAST(count(*) AS BIGINT) AS record_count FROM tax_records GROUP BY ALL"""
PARTS["g_top_income_sources"] = f"""
SELECT income_source, taxpayer_type, CAST(sum(income) AS DOUBLE) AS total_income, {mean('tax_rate')} AS avg_tax_rate,
  CAST(count(*) AS BIGINT) AS record_count FROM tax_records GROUP BY ALL"""
PARTS["g_deduction_impact"] = f"""
SELECT deduction_type, {mean('deductions')} AS avg_deduction_amount,
  round(avg(CAST(taxable_income AS DOUBLE) / nullif(CAST(income AS DOUBLE), 0)), 6) AS avg_effective_reduction_ratio,
  CAST(count(*) AS BIGINT) AS record_count FROM tax_records GROUP BY ALL"""
PARTS["g_by_type_state"] = f"""
SELECT taxpayer_type, state, {mean('income')} AS avg_income, {mean('taxable_income')} AS avg_taxable_income,
  {mean('tax_owed')} AS avg_tax_owed, {mean('tax_rate')} AS avg_tax_rate, CAST(count(*) AS BIGINT) AS record_count
FROM tax_records GROUP BY ALL"""


def shown(columns: list[str]) -> str:
    parts = []
    for c in columns:
        kind = c.split(":")
        value = {"m": money, "p": percent, "t": lambda x: f"CAST({x} AS VARCHAR)"}[kind[1]](f'"{kind[0]}"')
        parts.append(f"'{kind[0]}: ' || {value}")
    return "'  • ' || concat_ws(', ', " + ", ".join(parts) + ")"


def block(route: str, source: str, key: str, label: str, order: str, columns: list[str]) -> str:
    return f"""SELECT '{route}' AS route, key, '[Graph Database — ' || label || ']' || chr(10) || string_agg(line, chr(10) ORDER BY n) AS block
FROM (SELECT {key} AS key, {label} AS label, {shown(columns)} AS line,
        row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS n FROM {source}) WHERE n <= 15 GROUP BY key, label"""


PARTS["graph_blocks"] = " UNION ALL ".join([
    block("type_state_summary", "g_by_type_state", "taxpayer_type || '|' || state", "taxpayer_type || ' in ' || state", "1",
          ["taxpayer_type:t", "state:t", "avg_income:m", "avg_taxable_income:m", "avg_tax_owed:m", "avg_tax_rate:p", "record_count:t"]),
    block("avg_tax_by_type", "g_by_type", "taxpayer_type", "taxpayer_type || ' taxpayers'", "1",
          ["taxpayer_type:t", "avg_tax_owed:m", "avg_tax_rate:p", "record_count:t"]),
    block("avg_tax_by_state", "g_by_state", "state", "'State: ' || state", "avg_tax_owed DESC, state, taxpayer_type",
          ["state:t", "taxpayer_type:t", "avg_tax_owed:m", "record_count:t"]),
    block("records_by_year", "g_by_year", 'CAST("year" AS VARCHAR)', """'Tax Year ' || "year\"""",
          'avg_tax_owed DESC, "year", taxpayer_type, state',
          ["year:t", "taxpayer_type:t", "state:t", "avg_income:m", "avg_tax_owed:m", "record_count:t"]),
    block("top_income_sources", "g_top_income_sources", "''", "'Income sources'", "total_income DESC, income_source, taxpayer_type",
          ["income_source:t", "taxpayer_type:t", "total_income:m", "avg_tax_rate:p", "record_count:t"]),
    block("deduction_impact", "g_deduction_impact", "''", "'Deduction types'", "avg_deduction_amount DESC, deduction_type",
          ["deduction_type:t", "avg_deduction_amount:m", "avg_effective_reduction_ratio:m", "record_count:t"]),
    block("general_summary", "g_general_summary", "''", "'Overall financial summary'", '"count" DESC, taxpayer_type, state, "year"',
          ["taxpayer_type:t", "state:t", "year:t", "count:t", "avg_income:m", "avg_tax_owed:m", "avg_tax_rate:p"]),
])

_TURN = "(o_orderkey // 10)"
_HOLES = {
    "type": case("c_mktsegment", fx.SEGMENT_TYPE), "any_state": entry(STATES, f"{_TURN} % 50"),
    "state": entry(STATES[:25], "c_nationkey"), "year": "CAST(year(o_orderdate) + 20 AS VARCHAR)",
    "source": entry(INCOME_SOURCES, f"{_TURN} % 6"), "deduction": case("o_orderpriority", fx.PRIORITY_DEDUCTION),
}


def filled(template: str) -> str:
    pieces = re.split(r"\{(\w+)\}", template)
    return " || ".join(_HOLES[p] if i % 2 else quote(p) for i, p in enumerate(pieces))


PARTS["questions"] = f"""
SELECT o_orderkey AS qid,
  CASE o_orderkey % 10 {' '.join(f'WHEN {k} THEN {filled(t)}' for k, t in enumerate(fx.QUESTIONS))} END AS message,
  CASE WHEN {_TURN} % 4 <> 0 THEN CAST({_TURN} % 22 AS INTEGER) END AS n_results
FROM orders JOIN customer ON o_custkey = c_custkey"""
PARTS["checked"] = """
SELECT qid, message, coalesce(n_results, 8) AS n_results,
  CASE WHEN length(message) < 1 THEN 'message is empty' WHEN length(message) > 2000 THEN 'message is too long'
       WHEN coalesce(n_results, 8) < 1 OR coalesce(n_results, 8) > 20 THEN 'n_results is out of range' END AS reason
FROM questions"""
PARTS["valid"] = "SELECT qid, message, n_results FROM checked WHERE reason IS NULL"
PARTS["messages"] = "SELECT DISTINCT message FROM valid"
PARTS["entities"] = f"""
SELECT message, lower(message) AS q, {first_of('lower(message)', TAXPAYER_TYPES)} AS found_type,
  nullif(regexp_extract(message, '\\b({'|'.join(STATES)})\\b', 1), '') AS found_state,
  CAST(nullif(regexp_extract(message, '\\b(201[0-9]|202[0-9])\\b', 1), '') AS INTEGER) AS found_year,
  {first_of('lower(message)', INCOME_SOURCES)} AS found_source,
  {first_of('lower(message)', DEDUCTION_TYPES)} AS found_deduction
FROM messages"""
PARTS["tries"] = f"""
SELECT message, 1 AS step, 'type_state_summary' AS route, found_type || '|' || found_state AS key FROM entities
  WHERE found_type IS NOT NULL AND found_state IS NOT NULL
UNION ALL SELECT message, 2, 'avg_tax_by_type', found_type FROM entities
  WHERE found_type IS NOT NULL AND found_state IS NULL AND found_year IS NULL
UNION ALL SELECT message, 3, 'avg_tax_by_state', found_state FROM entities WHERE found_state IS NOT NULL AND found_type IS NULL
UNION ALL SELECT message, 4, 'records_by_year', CAST(found_year AS VARCHAR) FROM entities
  WHERE found_year IS NOT NULL AND found_type IS NULL AND found_state IS NULL
UNION ALL SELECT message, 5, 'top_income_sources', '' FROM entities
  WHERE found_source IS NOT NULL OR {any_of('q', SOURCE_KEYWORDS)}
UNION ALL SELECT message, 6, 'deduction_impact', '' FROM entities
  WHERE found_deduction IS NOT NULL OR {any_of('q', DEDUCTION_KEYWORDS)}
UNION ALL SELECT message, 7, 'general_summary', '' FROM entities WHERE {any_of('q', SUMMARY_KEYWORDS)}"""
PARTS["routed"] = """
SELECT m.message, coalesce(r.route, 'none') AS route, r.block AS graph_block FROM messages m LEFT JOIN (
  SELECT t.message, b.route, b.block, row_number() OVER (PARTITION BY t.message ORDER BY step) AS n
  FROM tries t JOIN graph_blocks b ON t.route = b.route AND t.key = b.key) r ON m.message = r.message AND r.n = 1"""

PARTS["doc_pages"] = f"""
SELECT {entry(fx.FILE_PREFIXES, 'doc_id % 4')} || doc_id || '.pdf' AS filename,
  unnest(range(len(parts))) AS page_num, unnest(parts) AS text
FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)"""
PARTS["clean_pages"] = f"SELECT filename, page_num, {clean('text')} AS text FROM doc_pages"
PARTS["islands"] = """
SELECT filename, page_num, text, count(*) OVER (PARTITION BY filename) AS total_pages,
  min(CASE WHEN length(text) >= 100 THEN page_num END) OVER (PARTITION BY filename ORDER BY page_num
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS merged_page FROM clean_pages"""
PARTS["merged"] = f"""
SELECT filename, coalesce(CAST(merged_page + 1 AS VARCHAR), 'buffer') AS page, merged_page, min(page_num) AS first_page,
  count(*) AS n_pages, any_value(total_pages) AS total_pages,
  {words("string_agg(text, chr(10) ORDER BY page_num)")} AS w
FROM islands GROUP BY filename, merged_page"""
PARTS["page_windows"] = """
SELECT filename, page, merged_page, total_pages, i, array_to_string(w[i + 1 : i + 512], ' ') AS text
FROM (SELECT *, unnest(range(0, len(w), 462)) AS i FROM merged)"""
PARTS["page_chunks"] = f"""
SELECT filename || CASE WHEN merged_page IS NULL THEN '_buffer_c' ELSE '_p' || merged_page || '_c' END || idx AS id, text,
  filename AS source, {source_type('filename')} AS source_type, page, CAST(idx AS VARCHAR) AS chunk_index,
  CAST(total_pages AS VARCHAR) AS total_pages
FROM (SELECT *, row_number() OVER (PARTITION BY filename, page ORDER BY i) - 1 AS idx FROM page_windows WHERE length(text) > 80)"""
PARTS["document_chunks"] = f"""
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS INTEGER) AS chunk_index, text FROM (
  SELECT id, i, array_to_string(w[i + 1 : i + 512], ' ') AS text FROM (
    SELECT id, w, unnest(range(0, len(w), 462)) AS i FROM (SELECT doc_id AS id, {words('text')} AS w FROM documents)))
WHERE length(text) > 80"""

PARTS["slide_paragraphs"] = f"""
SELECT * FROM (SELECT 'deck_' || conv_id || '.pptx' AS filename, turn // 2 + 1 AS slide, turn * 1000 + n AS pos,
  CASE WHEN role = 'user' AND n = 0 THEN 'Title 1' ELSE 'Content 2' END AS shape_name, {strip('sentence')} AS text,
  role = 'assistant' AS is_notes
FROM (SELECT conv_id, turn, role, unnest(range(len(s))) AS n, unnest(s) AS sentence
      FROM (SELECT *, string_split(text, '. ') AS s FROM conversations))) WHERE text <> ''"""
PARTS["slides"] = """
SELECT p.filename, p.slide, coalesce(any_value(t.text), '') AS title,
  coalesce(string_agg(CASE WHEN NOT is_notes AND p.pos IS DISTINCT FROM t.pos THEN p.text END, chr(10) ORDER BY p.pos), '') AS body,
  coalesce(string_agg(CASE WHEN is_notes THEN p.text END, chr(10) ORDER BY p.pos), '') AS notes
FROM slide_paragraphs p LEFT JOIN (
  SELECT filename, slide, min(pos) AS pos, arg_min(text, pos) AS text FROM slide_paragraphs
  WHERE NOT is_notes AND starts_with(lower(shape_name), 'title') GROUP BY 1, 2) t
ON p.filename = t.filename AND p.slide = t.slide GROUP BY p.filename, p.slide"""
PARTS["slide_chunks"] = """
SELECT filename || '_slide' || slide || '_' || section AS id, text, filename AS source, 'presentation' AS source_type,
  CAST(slide AS VARCHAR) AS slide, section, title FROM (
  SELECT filename, slide, title, 'content' AS section,
    'Slide ' || slide || CASE WHEN title <> '' THEN ' — ' || title ELSE '' END
      || CASE WHEN body <> '' THEN ':' || chr(10) || body ELSE '' END AS text
  FROM slides WHERE title <> '' OR body <> ''
  UNION ALL SELECT filename, slide, title, 'notes', 'Speaker notes for slide ' || slide
      || CASE WHEN title <> '' THEN ' (' || title || ')' ELSE '' END || ':' || chr(10) || notes
  FROM slides WHERE length(notes) > 40)
WHERE section = 'notes' OR length(text) > 40"""
PARTS["all_chunks"] = """
SELECT id, text, source, source_type, CAST(NULL AS VARCHAR) AS page, CAST(NULL AS VARCHAR) AS slide FROM record_chunks
UNION ALL SELECT id, text, source, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM summary_chunks
UNION ALL SELECT id, text, source, source_type, page, CAST(NULL AS VARCHAR) FROM page_chunks
UNION ALL SELECT id, text, source, source_type, CAST(NULL AS VARCHAR), slide FROM slide_chunks"""


def tfidf(prefix: str, corpus: str, queries: str) -> None:
    """Sub-queries ``{prefix}_hits``: (qid, id, score, rank) of TF-IDF cosine over a corpus."""
    PARTS[f"{prefix}_tf"] = f"SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({terms('text')}) AS term FROM {corpus}) GROUP BY 1, 2"
    PARTS[f"{prefix}_idf"] = f"""
SELECT term, ln((SELECT count(*) + 1.0 FROM {corpus}) / (count(*) + 1.0)) + 1 AS idf FROM {prefix}_tf GROUP BY 1"""
    PARTS[f"{prefix}_norm"] = f"SELECT id, sqrt(sum((tf * idf) ** 2)) AS norm FROM {prefix}_tf JOIN {prefix}_idf USING (term) GROUP BY 1"
    PARTS[f"{prefix}_q"] = f"""
SELECT qid, term, tf * idf AS w, idf FROM (
  SELECT qid, term, count(*) AS tf FROM (SELECT qid, unnest({terms('message')}) AS term FROM {queries}) GROUP BY 1, 2)
JOIN {prefix}_idf USING (term)"""
    PARTS[f"{prefix}_qn"] = f"SELECT qid, sqrt(sum(w * w)) AS qnorm FROM {prefix}_q GROUP BY 1"
    PARTS[f"{prefix}_scores"] = f"""
SELECT qid, d.id, sum(q.w * d.tf * q.idf) AS dot FROM {prefix}_q q JOIN {prefix}_tf d USING (term) GROUP BY 1, 2"""
    PARTS[f"{prefix}_hits"] = f"""
SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
  SELECT s.qid, s.id, round(dot / qnorm / norm, 4) AS score
  FROM {prefix}_scores s JOIN {prefix}_norm USING (id) JOIN {prefix}_qn USING (qid))) WHERE rank <= 20"""


PARTS["text_corpus"] = "SELECT doc_id AS id, text, source, lang AS source_type FROM documents"
PARTS["text_queries"] = "SELECT item_id AS qid, text AS message FROM benchmark"
PARTS["sentence_queries"] = f"""
SELECT DISTINCT message AS qid, message FROM (SELECT {strip("unnest(string_split_regex(text, '[.\\n]'))")} AS message FROM conversations)
WHERE message <> ''"""
PARTS["message_queries"] = "SELECT message AS qid, message FROM messages"
tfidf("t", "text_corpus", "text_queries")
tfidf("m", "text_corpus", "sentence_queries")
tfidf("h", "all_chunks", "message_queries")

PARTS["hit_rows"] = """
SELECT h.qid AS message, h.rank, h.score, source, source_type, nullif(page, '') AS page, slide,
  '[' || rank || '] ' || coalesce(source, 'unknown')
  || CASE WHEN slide IS NOT NULL THEN ' (slide ' || slide || ')' WHEN coalesce(page, '') <> '' THEN ' (page ' || page || ')' ELSE '' END
  || ' — relevance: ' || format('{:.2f}', score) || chr(10) || text || chr(10) AS line
FROM h_hits h JOIN all_chunks c USING (id)"""
PARTS["context_parts"] = """
SELECT v.qid, v.message, v.n_results, any_value(r.route) AS route, any_value(r.graph_block) AS graph_block,
  CASE WHEN count(h.line) > 0 THEN '[Semantic Search Results]' || string_agg(chr(10) || h.line, '' ORDER BY h.rank) END AS vector_block,
  count(h.line) AS n_hits
FROM valid v JOIN routed r USING (message)
LEFT JOIN hit_rows h ON v.message = h.message AND h.rank <= v.n_results AND h.score >= 0.25
GROUP BY v.qid, v.message, v.n_results"""
PARTS["contexts"] = f"""
SELECT *, contains(context, '[Graph Database') AS graph_used,
  CAST(length(context) - length(replace(context, '[', '')) - CASE WHEN contains(context, '[Graph Database') THEN 1 ELSE 0 END AS BIGINT) AS context_chunks
FROM (SELECT *, coalesce(nullif(concat_ws(chr(10) || chr(10), graph_block, vector_block), ''), {quote(NOTHING_FOUND)}) AS context FROM context_parts)"""

def letters(x: str) -> str:
    return "[" + ", ".join(
        f"CAST(length({x}) - length(replace(replace({x}, '{c}', ''), '{c.upper()}', '')) AS DOUBLE)" for c in map(chr, range(97, 123))) + "]"


# The same contexts from text and vector scores together.
PARTS["d_hits"] = f"""
SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
  SELECT qid, id, max(score) AS score FROM (
    SELECT s.qid, s.id, round(dot / qnorm / norm, 4) AS score FROM h_scores s JOIN h_norm USING (id) JOIN h_qn USING (qid)
    UNION ALL
    SELECT message, id, round(list_cosine_similarity(q, v), 4)
    FROM (SELECT message, {letters('message')} AS q FROM messages), (SELECT id, {letters('text')} AS v FROM all_chunks))
  GROUP BY 1, 2)) WHERE rank <= 20"""
PARTS["d_hit_rows"] = PARTS["hit_rows"].replace("h_hits", "d_hits")
PARTS["d_context_parts"] = PARTS["context_parts"].replace("hit_rows", "d_hit_rows")
PARTS["d_contexts"] = PARTS["contexts"].replace("context_parts", "d_context_parts")

PARTS["centroids"] = """
SELECT label AS qid, list(m ORDER BY dim) AS q FROM (
  SELECT label, dim, avg(x) AS m FROM (
    SELECT label, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
  GROUP BY 1, 2) GROUP BY 1"""
PARTS["v_scores"] = """
SELECT qid, vec_id AS id, label, round(list_cosine_similarity(q, CAST(embedding AS DOUBLE[])), 4) AS score
FROM centroids, embeddings"""

_COSINE = "list_cosine_similarity({0}, {1})"
PARTS["a_cells"] = f"""
SELECT vec_id AS id, arg_max(qid, (similarity, -qid)) AS cell, any_value(v) AS v FROM (
  SELECT vec_id, qid, v, {_COSINE.format('q', 'v')} AS similarity
  FROM centroids, (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)) GROUP BY 1"""
PARTS["a_scores"] = f"SELECT qid, id, round({_COSINE.format('q', 'v')}, 4) AS score FROM centroids JOIN a_cells ON cell = qid"


def ranked(source: str, k: int, where: str = "true") -> str:
    return f"""SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT qid, id, score,
  row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM {source} WHERE {where}) WHERE rank <= {k} AND score >= 0.25"""


PARTS["eval_items"] = f"""
SELECT conv_id || '-' || turn AS id, {words('text')} AS expected, 'cat' || conv_id % 5 AS category FROM conversations WHERE role = 'user'"""
PARTS["answers"] = "SELECT conv_id || '-' || (turn - 1) AS id, text AS answer FROM conversations WHERE role = 'assistant'"
PARTS["verdicts"] = """
SELECT CAST(i.id AS VARCHAR) AS id, category,
  array_to_string(list_filter(expected, lambda k: NOT contains(lower(coalesce(answer, '')), lower(k))), ' ') AS missing,
  len(list_filter(expected, lambda k: NOT contains(lower(coalesce(answer, '')), lower(k)))) = 0 AS passed
FROM eval_items i LEFT JOIN answers a ON i.id = a.id"""
PARTS["graph_edges"] = " UNION ALL ".join(
    f"SELECT id AS src, {quote(rel)} AS rel, {quote(label)} AS dst_label, CAST({column} AS VARCHAR) AS dst_key FROM tax_records"
    for rel, (label, column) in RELATIONS.items()
)


def sql(final: str) -> str:
    """Put the sub-queries that ``final`` needs in front of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in PARTS:
            if name not in needed and name not in seen and re.search(rf"\b{name}\b", text):
                seen.add(name)
                visit(PARTS[name])
                needed.append(name)

    seen: set[str] = set()
    visit(final)
    front = ",\n".join(f"{name} AS ({PARTS[name]})" for name in needed)
    return f"WITH {front}\n{final}" if front else final


ORACLES = {
    "records_valid": f"""
SELECT id, taxpayer_type, tax_year, CAST(tax_owed AS DOUBLE) AS tax_owed FROM tax_lines
WHERE NOT (l_linenumber = 7 AND l_quantity < 5)""",
    "record_ids_unique": f"""
SELECT count(*) AS n_records, count(DISTINCT id) AS n_ids, min(id) AS first_id, max(id) AS last_id FROM (
  SELECT h || '-' || row_number() OVER (PARTITION BY h) AS id FROM (
    SELECT sha256({hashed('taxpayer_type', 'tax_year', 'transaction_date', 'income_source', 'deduction_type', 'state', *MEASURES)}) AS h
    FROM tax_records))""",
    "record_params": "SELECT id, taxpayer_type, tax_year, transaction_date, income_source, deduction_type, state, "
    + ", ".join(f"CAST({m} AS DOUBLE) AS {m}" for m in MEASURES) + " FROM tax_records",
    "record_text": "SELECT id, text FROM record_texts",
    "record_chunks": "SELECT * FROM record_chunks",
    "source_types": f"SELECT DISTINCT filename, {source_type('filename')} AS source_type FROM doc_pages",
    "questions_rejected": "SELECT qid, message, n_results, reason FROM checked WHERE reason IS NOT NULL",
    "chunks_new_only": "SELECT id, text FROM record_chunks WHERE CAST(tax_year AS INTEGER) > 2018",
    "store_counts": "SELECT (SELECT count(*) FROM all_chunks) AS documents, (SELECT count(*) FROM tax_records) AS record_nodes",
    "graph_nodes": "SELECT DISTINCT dst_label AS label, dst_key AS key FROM graph_edges",
    "graph_edges": "SELECT src, rel, dst_label, dst_key FROM graph_edges",
    "traverse_inner": "SELECT id, CAST(tax_owed AS DOUBLE) AS tax_owed, state FROM tax_lines",
    "traverse_optional": "SELECT id, state, CASE WHEN l_quantity <> 1 THEN taxpayer_type END AS taxpayer_type FROM tax_lines",
    "summary_by_type": "SELECT * FROM summary_by_type",
    "summary_by_state": "SELECT * FROM summary_by_state",
    "summary_by_year": "SELECT * FROM summary_by_year",
    "summary_by_type_year": "SELECT * FROM summary_by_type_year",
    "summary_by_source": "SELECT * FROM summary_by_source",
    "summary_chunks": "SELECT * FROM summary_chunks",
    "g_avg_tax_by_type": "SELECT * FROM g_by_type WHERE taxpayer_type = 'Corporation'",
    "g_avg_tax_by_state": "SELECT * FROM g_by_state WHERE state = 'CA'",
    "g_records_by_year": 'SELECT * FROM g_by_year WHERE "year" = 2020',
    "g_top_income_sources": "SELECT * FROM g_top_income_sources",
    "g_deduction_impact": "SELECT * FROM g_deduction_impact",
    "g_type_state_summary": "SELECT * FROM g_by_type_state WHERE taxpayer_type = 'Corporation' AND state = 'CA'",
    "g_general_summary": "SELECT * FROM g_general_summary",
    "clean_text": f"SELECT doc_id AS id, {clean('text')} AS text FROM documents",
    "document_chunks": "SELECT * FROM document_chunks",
    "pages_merged": "SELECT filename, page, CAST(first_page AS INTEGER) AS first_page, n_pages, len(w) AS n_words FROM merged",
    "page_chunks": "SELECT * FROM page_chunks",
    "slide_chunks": "SELECT * FROM slide_chunks",
    "all_chunks": "SELECT id, text, source, source_type FROM all_chunks",
    "vector_topk": ranked("v_scores", 8),
    "ann_topk": ranked("a_scores", 8),
    "search_filtered": ranked("(SELECT s.*, t.source, t.source_type FROM t_all s JOIN text_corpus t USING (id))", 8, "source_type = 'en'"),
    "text_topk": ranked("t_all", 8),
    "text_topk_many": ranked("m_all", 8),
    "records_roundtrip": "SELECT taxpayer_type, tax_year, transaction_date, income_source, deduction_type, state, "
    + ", ".join(f"CAST({m} AS DOUBLE) AS {m}" for m in MEASURES) + " FROM tax_records",
    "ingest_two_loads": "SELECT id, text FROM summary_chunks",
    "vector_blocks": """
SELECT qid, '[Semantic Search Results]' || string_agg(chr(10) || '[' || rank || '] ' || source || ' — relevance: '
  || format('{:.2f}', score) || chr(10) || text || chr(10), '' ORDER BY rank) AS block
FROM t_hits JOIN text_corpus USING (id) WHERE score >= 0.25 GROUP BY qid""",
    "question_entities": "SELECT qid, message, found_type, found_state, found_year, found_source, found_deduction FROM valid JOIN entities USING (message)",
    "question_routes": "SELECT qid, route, graph_block FROM valid JOIN routed USING (message)",
    "graph_blocks": "SELECT route, key, block FROM graph_blocks",
    "hybrid_context": "SELECT qid, route, context, n_hits, graph_used, context_chunks FROM contexts",
    "hybrid_context_dense": "SELECT qid, route, context, n_hits, graph_used, context_chunks FROM d_contexts",
    "answer_sources": """
SELECT v.qid, CAST(rank - 1 AS INTEGER) AS pos, source, page, CAST(slide AS INTEGER) AS slide, score, source_type
FROM valid v JOIN hit_rows h ON v.message = h.message WHERE rank <= least(5, n_results)""",
    "prompts": """
SELECT qid, 'CONTEXT FROM KNOWLEDGE BASE:' || chr(10) || repeat('=', 60) || chr(10) || context || chr(10) || repeat('=', 60)
  || chr(10) || chr(10) || 'USER QUESTION: ' || message || chr(10) || chr(10)
  || 'Please answer the question using the context above.' AS prompt FROM contexts""",
    "eval_keywords": "SELECT id, category, missing, passed FROM verdicts",
    "eval_by_category": """
SELECT category, count(*) AS items, CAST(sum(CAST(passed AS INTEGER)) AS BIGINT) AS passed,
  CAST(sum(CAST(passed AS INTEGER)) AS DOUBLE) / count(*) AS pass_rate FROM verdicts GROUP BY 1""",
    "stream_ingest": "SELECT id, text, source, source_type FROM record_chunks",
    "stream_raw_files": "SELECT text, source, source_type FROM all_chunks",
}
for _prefix in ("t", "m"):
    PARTS[f"{_prefix}_all"] = f"""
SELECT s.qid, s.id, round(dot / qnorm / norm, 4) AS score
FROM {_prefix}_scores s JOIN {_prefix}_norm USING (id) JOIN {_prefix}_qn USING (qid)"""


def oracle_sql() -> dict[str, str]:
    return {name: sql(text) for name, text in ORACLES.items()}
