
from __future__ import annotations

import os
import sys
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracles  # noqa: E402
from hybridlake import fixtures as fx  # noqa: E402
from hybridlake.functions.text import clean, source_type  # noqa: E402
from hybridlake.operators import chunks, evaluate, graph, hybrid, records, routing, search, structured, summaries  # noqa: E402
from hybridlake.operators.aggregates import partials, record_rollup  # noqa: E402
from hybridlake.operators.text_index import TextIndex  # noqa: E402
from hybridlake.operators.vector_index import Centres, VectorIndex  # noqa: E402
from hybridlake.plans import answer, ingest  # noqa: E402
from hybridlake.schemas import RECORD_FILE_COLUMNS, SCORE_THRESHOLD, SUMMARY_SOURCE  # noqa: E402
from hybridlake.session import work_dir  # noqa: E402
from hybridlake.sources import store  # noqa: E402
from hybridlake.sources.records import load_records  # noqa: E402
from hybridlake.streaming import ingest as stream  # noqa: E402

#: The training-data operators, in a subpackage that may be absent or lack its libraries.
try:
    import corpus_pipeline
    from hybridlake.llm import queries as llm
except ImportError:
    llm = None

Query = Callable[[SparkSession, str], DataFrame]

TOP = 8


def _meta(*keys: str) -> list[Column]:
    return [F.col("metadata")[k].alias(k) for k in keys]


def _stored_records(spark, d):
    """The records for queries that read them more than once: their joins are done once."""
    return store.materialize(fx.tax_records(spark, d), "tax-records")


# --- records ---------------------------------------------------------------
def records_valid(spark, d):
    return records.valid_records(fx.tax_records_dirty(spark, d)).select(
        "id", "taxpayer_type", "tax_year", F.col("tax_owed").cast("double").alias("tax_owed")
    )


def record_ids_unique(spark, d):
    return records.with_record_ids(fx.tax_records(spark, d)).agg(
        F.count(F.lit(1)).alias("n_records"), F.count_distinct("id").alias("n_ids"),
        F.min("id").alias("first_id"), F.max("id").alias("last_id"),
    )


def record_chunks(spark, d):
    return records.record_chunks(fx.tax_records(spark, d)).select(
        "id", "text", "source", "source_type", *_meta("taxpayer_type", "tax_year", "state")
    )


def _record_files(spark, d, years_twice=False):
    """The records as two folders of CSV files, written one after the other: the years up to 2018, then the later years with
    another header order and a note in it, or with ``years_twice`` all years, so that the second folder brings the first again."""
    rows, files = store.aside(fx.tax_records(spark, d), "tax-records")
    folder = work_dir(spark, "record-files")
    early, late = f"{folder}/early", f"{folder}/late"
    titles = list(RECORD_FILE_COLUMNS)
    note = F.concat(F.lit('say "'), F.col("state"), F.lit('",\n'), F.col("deduction_type"))
    is_early = F.coalesce(F.col("tax_year") <= 2018, F.lit(False))
    fx.write_record_files(rows.where(is_early), early, titles)
    yield early
    fx.write_record_files(rows if years_twice else rows.where(~is_early), late, ["Note", *reversed(titles)], note)
    files.remove()
    yield late


def records_roundtrip(spark, d):
    """Records written as CSV in two layouts, one with line breaks inside quotes, and loaded again."""
    return records.record_params(load_records(spark, list(_record_files(spark, d)))).drop("id")


def ingest_two_loads(spark, d):
    """The summaries after two loads, one folder after the other; the second brings the records of the first again."""
    lake = ingest.Lake(spark, work_dir(spark, "lake"))
    for folder in _record_files(spark, d, years_twice=True):
        ingest.ingest(spark, folder, lake, skip_graph=True, skip_index=True)
        store.ChunkStore(spark, folder).remove()  # taken in
    return lake.read_chunks().where(F.col("source") == SUMMARY_SOURCE).select("id", "text")


def source_types(spark, d):
    return fx.doc_pages(spark, d).select("filename").distinct().select(
        "filename", source_type(F.col("filename")).alias("source_type")
    )


# --- chunks ----------------------------------------------------------------
def all_chunks_of(spark, d):
    rows = fx.tax_records(spark, d)
    return chunks.union_chunks(
        records.record_chunks(rows),
        summaries.summary_chunks(record_rollup(rows)),
        chunks.page_chunks(fx.doc_pages(spark, d)),
        chunks.slide_chunks(fx.slide_paragraphs(spark, d)),
    )


def _parts(spark, d):
    """The page chunks and the records, each written before the other is begun: what stands on the disk for a part goes with it."""
    pages = store.alone(lambda: chunks.page_chunks(fx.doc_pages(spark, d)), "page-chunks")
    return pages, _stored_records(spark, d)


def all_chunks(spark, d):
    """Every chunk; those of the records are made as they are read."""
    pages, rows = _parts(spark, d)
    parts = records.record_chunks(rows), summaries.summary_chunks(_rollup(spark, d, rows)), pages, chunks.slide_chunks(fx.slide_paragraphs(spark, d))
    return chunks.union_chunks(*parts).select("id", "text", "source", "source_type")


def _stored_chunks(spark, d):
    """(chunks, rollup): all chunks and the rollup of the records as stored tables, without the tables they were made of."""
    kept = store.ChunkStore(spark, work_dir(spark, "chunks"))
    with store.scratch():
        store.write(chunks.page_chunks(fx.doc_pages(spark, d)), kept.path)
    store.write(chunks.slide_chunks(fx.slide_paragraphs(spark, d)), kept.path)
    rows, files = store.aside(fx.tax_records(spark, d), "tax-records")
    rollup = _rollup(spark, d, rows)
    store.write(chunks.union_chunks(records.record_chunks(rows), summaries.summary_chunks(rollup)), kept.path)
    files.remove()
    return kept.read(), rollup


def clean_text(spark, d):
    return fx.text_corpus(spark, d).select("id", clean(F.col("text")).alias("text"))


def page_chunks(spark, d):
    return chunks.page_chunks(fx.doc_pages(spark, d)).select(
        "id", "text", "source", "source_type", *_meta("page", "chunk_index", "total_pages")
    )


def slide_chunks(spark, d):
    return chunks.slide_chunks(fx.slide_paragraphs(spark, d)).select(
        "id", "text", "source", "source_type", *_meta("slide", "section", "title")
    )


def chunks_new_only(spark, d):
    """A store that holds the years up to 2018 meets a load of all years."""
    loaded = records.record_chunks(_stored_records(spark, d))
    stored = loaded.where(F.col("metadata")["tax_year"].cast("int") <= 2018)
    return store.new_chunks(loaded, stored).select("id", "text")


def store_counts(spark, d):
    return store.store_counts(documents=all_chunks_of(spark, d), record_nodes=fx.tax_records(spark, d))


def stream_ingest(spark, d):
    """Two deliveries that overlap, each followed by one run of the stream."""
    incoming, sink, state = (work_dir(spark, p) for p in ("incoming", "sink", "state"))
    rows, files = store.aside(fx.tax_records(spark, d), "tax-records")
    loaded = records.record_chunks(rows)
    store.write(loaded.where(F.col("metadata")["tax_year"].cast("int") <= 2018), incoming)
    stream.run_once(spark, incoming, sink, state)
    store.write(loaded, incoming)
    files.remove()
    stream.run_once(spark, incoming, sink, state)
    return store.ChunkStore(spark, sink).read().select("id", "text", "source", "source_type")


def stream_raw_files(spark, d):
    """Two deliveries of raw record, page and slide files, packed, each followed by one run; then a run without news."""
    incoming, state = work_dir(spark, "raw"), work_dir(spark, "raw-state")
    lake = ingest.Lake(spark, work_dir(spark, "lake"))
    rows, stored = store.aside(fx.tax_records(spark, d), "tax-records")
    pages, slides = fx.doc_pages(spark, d), fx.slide_paragraphs(spark, d)
    titles = list(RECORD_FILE_COLUMNS)
    late = F.coalesce(F.col("tax_year") > 2018, F.lit(False))
    second = F.xxhash64("filename") % 2 != 0

    def deliver(name, columns, years, files):
        fx.write_record_files(rows.where(years), f"{incoming}/{name}/records", columns)
        pages.where(files).write.json(f"{incoming}/{name}/pages", compression="gzip")
        slides.where(files).write.json(f"{incoming}/{name}/slides", compression="gzip")

    deliver("first", titles, ~late, ~second)
    stream.run_files(spark, incoming, lake, state, skip_index=True, skip_graph=True)
    deliver("second", titles[::-1], late, second)
    stored.remove()
    stream.run_files(spark, incoming, lake, state, skip_index=True, skip_graph=True)
    stream.run_files(spark, incoming, lake, state, skip_index=True, skip_graph=True)
    return lake.read_chunks().select("text", "source", "source_type")


# --- summaries and graph ---------------------------------------------------
def summary(*groups: str) -> Query:
    def query(spark, d):
        rollup = record_rollup(fx.tax_records(spark, d))
        return summaries.summary_chunks(rollup, list(groups) or None).select(
            "id", "text", "source", *_meta("group", "value", "taxpayer_type", "year")
        )
    return query


def structured_query(name: str, *args) -> Query:
    return lambda spark, d: getattr(structured, name)(partials(fx.tax_records(spark, d)), *args)


def traverse_inner(spark, d):
    rows = fx.tax_records(spark, d)
    found = graph.traverse(graph.facts(rows), graph.edges(rows), graph.nodes(rows), "IN_STATE", "state")
    return found.select("id", F.col("tax_owed").cast("double").alias("tax_owed"), "state")


def traverse_optional(spark, d):
    rows = store.materialize(fx.tax_records_without_type_edge(spark, d), "tax-records")
    edges, nodes = graph.edges(rows), graph.nodes(rows)
    found = graph.traverse(graph.facts(rows), edges, nodes, "IN_STATE", "state")
    found = graph.traverse(found, edges, nodes, "FILED_BY", "taxpayer_type", optional=True)
    return found.select("id", "state", "taxpayer_type")


# --- search ----------------------------------------------------------------
def _centroids(spark, d):
    """One query per label: the mean vector of the label."""
    vectors = fx.table(spark, d, "embeddings")
    cells = vectors.select("label", F.posexplode("embedding").alias("dim", "x"))
    means = cells.groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("dim", "m"))).alias("v")).select(
        F.col("label").alias("qid"), F.col("v.m").alias("embedding")
    )


def vector_topk(spark, d):
    return search.with_threshold(search.vector_topk(fx.vectors(spark, d), _centroids(spark, d), TOP))


def ann_topk(spark, d):
    """The labels' mean vectors against an index whose cells lie around the same vectors; one cell of ten is probed."""
    asked = _centroids(spark, d)
    centres = Centres.of(np.array([r["embedding"] for r in asked.orderBy("qid").collect()]))  # one row per label
    index = VectorIndex.build(fx.vectors(spark, d), work_dir(spark, "vector-index"), centres)
    return search.with_threshold(index.search(asked, 1, TOP))


def _text_corpus(spark, d):
    """Documents as chunks; the language stands for the source type."""
    return fx.spread_table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), "text", "source", F.col("lang").alias("source_type"),
        F.create_map(F.lit("source"), F.col("source"), F.lit("source_type"), F.col("lang")).alias("metadata"),
    )


def text_topk(spark, d):
    return search.with_threshold(search.text_topk(_text_corpus(spark, d), fx.text_queries(spark, d), k=TOP))


def text_topk_many(spark, d):
    """Every sentence of the conversations against a stored index of the documents."""
    index = TextIndex.build(spark, _text_corpus(spark, d), work_dir(spark, "text-index"))
    return search.with_threshold(index.search(fx.sentence_queries(spark, d), TOP, least=SCORE_THRESHOLD))


def search_filtered(spark, d):
    return search.with_threshold(
        search.text_topk(_text_corpus(spark, d), fx.text_queries(spark, d), k=TOP, source_type="en")
    )


def vector_blocks(spark, d):
    corpus = _text_corpus(spark, d)
    hits = search.text_topk(corpus, fx.text_queries(spark, d))
    return hybrid.vector_blocks(search.attach(hits, corpus))


# --- questions -------------------------------------------------------------
def question_entities(spark, d):
    return routing.entities(hybrid.valid_questions(fx.questions(spark, d))).select(
        "qid", "message", "found_type", "found_state", "found_year", "found_source", "found_deduction"
    )


def _rollup(spark, d, rows=None):
    return store.materialize(record_rollup(fx.tax_records(spark, d) if rows is None else rows), "rollup")


def question_routes(spark, d):
    valid = hybrid.valid_questions(fx.questions(spark, d))
    return routing.route(valid, routing.graph_blocks(_rollup(spark, d))).select("qid", "route", "graph_block")


def _contexts(spark, d):
    stored, rollup = _stored_chunks(spark, d)
    return answer.answer(fx.questions(spark, d), stored, rollup)


def hybrid_context(spark, d):
    return _contexts(spark, d).select("qid", "route", "context", "n_hits", "graph_used", "context_chunks")


def hybrid_context_dense(spark, d):
    """Contexts from text and vector hits together; a vector holds the letter counts of a text."""
    embed = search.embedder(fx.letter_counts)
    stored, rollup = _stored_chunks(spark, d)
    vectors = store.VectorStore(spark, work_dir(spark, "vectors"))
    vectors.add(stored, embed)
    contexts = answer.answer(fx.questions(spark, d), stored, rollup, embed=embed, vectors=vectors.read())
    return contexts.select("qid", "route", "context", "n_hits", "graph_used", "context_chunks")


def eval_verdicts(spark, d):
    return evaluate.evaluate(fx.eval_items(spark, d), fx.answers(spark, d))


def entry(spark: SparkSession) -> DataFrame:
    """The 20 largest groups of type, state and year at the smallest scale."""
    return queries()["g_general_summary"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    """One entry per operator; each takes (spark, sf_dir)."""
    return {
        "records_valid": records_valid,
        "record_ids_unique": record_ids_unique,
        "record_params": lambda s, d: records.record_params(fx.tax_records(s, d)),
        "record_text": lambda s, d: records.record_texts(fx.tax_records(s, d)),
        "record_chunks": record_chunks,
        "records_roundtrip": records_roundtrip,
        "ingest_two_loads": ingest_two_loads,
        "source_types": source_types,
        "questions_rejected": lambda s, d: hybrid.rejected_questions(fx.questions(s, d)),
        "chunks_new_only": chunks_new_only,
        "store_counts": store_counts,
        "graph_nodes": lambda s, d: graph.nodes(fx.tax_records(s, d)),
        "graph_edges": lambda s, d: graph.edges(fx.tax_records(s, d)),
        "traverse_inner": traverse_inner,
        "traverse_optional": traverse_optional,
        "summary_by_type": summary("taxpayer_type"),
        "summary_by_state": summary("state"),
        "summary_by_year": summary("tax_year"),
        "summary_by_type_year": summary("taxpayer_type_year"),
        "summary_by_source": summary("income_source"),
        "summary_chunks": summary(),
        "g_avg_tax_by_type": structured_query("avg_tax_by_type", "Corporation"),
        "g_avg_tax_by_state": structured_query("avg_tax_by_state", "CA"),
        "g_records_by_year": structured_query("records_by_year", 2020),
        "g_top_income_sources": structured_query("top_income_sources"),
        "g_deduction_impact": structured_query("deduction_impact"),
        "g_type_state_summary": structured_query("type_state_summary", "Corporation", "CA"),
        "g_general_summary": structured_query("general_summary"),
        "clean_text": clean_text,
        "document_chunks": lambda s, d: chunks.document_chunks(fx.text_corpus(s, d)),
        "pages_merged": lambda s, d: chunks.page_islands(fx.doc_pages(s, d)),
        "page_chunks": page_chunks,
        "slide_chunks": slide_chunks,
        "all_chunks": all_chunks,
        "vector_topk": vector_topk,
        "ann_topk": ann_topk,
        "text_topk": text_topk,
        "text_topk_many": text_topk_many,
        "search_filtered": search_filtered,
        "vector_blocks": vector_blocks,
        "question_entities": question_entities,
        "question_routes": question_routes,
        "graph_blocks": lambda s, d: routing.graph_blocks(_rollup(s, d)),
        "hybrid_context": hybrid_context,
        "hybrid_context_dense": hybrid_context_dense,
        "answer_sources": lambda s, d: hybrid.source_rows(_contexts(s, d)),
        "prompts": lambda s, d: hybrid.with_prompt(_contexts(s, d)).select("qid", "prompt"),
        "eval_keywords": lambda s, d: eval_verdicts(s, d).select(
            "id", "category", F.array_join("missing", " ").alias("missing"), "passed"
        ),
        "eval_by_category": lambda s, d: evaluate.pass_rates(eval_verdicts(s, d)),
        "stream_ingest": stream_ingest, "stream_raw_files": stream_raw_files,
        **({**llm.QUERIES, "pipeline": corpus_pipeline.run} if llm else {}),
    }


def oracle_sql() -> dict[str, str]:
    """For each query, SQL that DuckDB runs on the same tables."""
    return {**oracles.oracle_sql(), **(llm.SQL if llm else {})}
