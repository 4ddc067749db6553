"""What queries and loads leave on the disk, and that a query's loads are whole."""

import datetime
import glob
import gzip
import os
import uuid

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from hybridlake.operators import records
from hybridlake.plans.ingest import Lake
from hybridlake.sources import store
from hybridlake.streaming import ingest as stream
from samples import RECORD_CSV
from test_ingest import ingest, rows_of, write_data


@pytest.fixture
def left(spark, tmp_path, monkeypatch):
    """The purposes of the work tables that are there."""
    for module in (entry, store):
        monkeypatch.setattr(module, "work_dir", lambda _, purpose: f"{tmp_path}/work/{purpose}-{uuid.uuid4().hex}")
    return lambda: sorted(os.path.basename(p).rsplit("-", 1)[0] for p in glob.glob(f"{tmp_path}/work/*"))


@pytest.fixture
def tables(spark, tmp_path):
    """Ten orders of six years and one without a date, two lines each, two documents and a conversation."""
    days = [datetime.date(1995 + i % 6, 3, 1 + i) for i in range(10)] + [None]
    made = {
        "nation": ("n_nationkey int", [(i,) for i in range(3)]),
        "customer": ("c_custkey long, c_nationkey int, c_mktsegment string", [(1, 1, "AUTOMOBILE"), (2, 2, "MACHINERY")]),
        "part": ("p_partkey long, p_type string", [(1, "PROMO"), (2, "SMALL")]),
        "orders": ("o_orderkey long, o_custkey long, o_orderdate date, o_orderpriority string", [
            (i, 1 + i % 2, day, "5-LOW") for i, day in enumerate(days)]),
        "lineitem": (
            "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate date, l_extendedprice double, "
            "l_discount double, l_tax double, l_quantity double",
            [(i, n, n, 1, datetime.date(1996, 1, 1), 100.0 + i, 0.05, 0.02, 3.0) for i in range(len(days)) for n in (1, 2)]),
        "documents": ("doc_id long, text string, lang string, source string", [
            (i, "\n".join(" ".join(f"w{i}x{j}x{k}" for k in range(30)) for j in range(3)), "en", "s") for i in range(2)]),
        "conversations": ("conv_id long, turn int, role string, text string", [
            (1, 0, "user", "how large is the share of the rent. please"), (1, 1, "assistant", "the rent is a third of the whole sum")]),
    }
    for name, (schema, rows) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "tables" / f"{name}.parquet"))
    return str(tmp_path / "tables")


def test_the_second_load_brings_the_records_of_the_first_again(spark, tables, monkeypatch, left):
    loads, real = [], entry.ingest.ingest
    monkeypatch.setattr(entry.ingest, "ingest", lambda *a, **b: loads.append(real(*a, **b)) or loads[-1])
    got = {r.id: r.text for r in entry.ingest_two_loads(spark, tables).collect()}
    assert [x["rows_read"] for x in loads] == [16, 22] and [x["rows_rejected"] for x in loads] == [0, 2]  # the years 2015 to 2018; all
    whole = entry.summaries.summary_chunks(entry.record_rollup(entry.fx.tax_records(spark, tables).where("tax_year is not null")))
    assert got == {r.id: r.text for r in whole.collect()} != {}
    assert left() == ["lake", "record-files"]


def test_a_load_leaves_no_work_tables(spark, tmp_path, left):
    data, lake = write_data(tmp_path / "data"), Lake(spark, str(tmp_path / "lake"))
    ingest(spark, data, lake)
    (tmp_path / "data" / "r.csv").write_text(RECORD_CSV.replace("2022", "2021"))
    ingest(spark, data, lake)
    assert lake.chunks.count() == 5 + 2 + 2 + 1 and left() == []


def test_packed_files_are_taken_in(spark, tmp_path):
    plain, packed = Lake(spark, str(tmp_path / "a")), Lake(spark, str(tmp_path / "b"))
    ingest(spark, write_data(tmp_path / "data"), plain)
    write_data(tmp_path / "in")
    for path in glob.glob(str(tmp_path / "in" / "**" / "*.*"), recursive=True):
        with open(path, "rb") as text, gzip.open(f"{path}.gz", "wb") as out:
            out.write(text.read())
        os.remove(path)
    stream.run_files(spark, str(tmp_path / "in"), packed, str(tmp_path / "state"), skip_index=True)
    assert rows_of(packed.read_chunks()) == rows_of(plain.read_chunks()) != []


def test_all_chunks_join_the_records_once(spark, tables, left):
    got = entry.all_chunks(spark, tables)
    assert not any("lineitem" in f or "clean-pages" in f for f in got.inputFiles())
    assert left() == ["page-chunks", "rollup", "tax-records"]
    assert rows_of(got) == rows_of(entry.all_chunks_of(spark, tables).select(*got.columns))


def test_stored_chunks_leave_what_they_were_made_of(spark, tables, left):
    stored, rollup = entry._stored_chunks(spark, tables)
    assert left() == ["chunks", "rollup"]
    assert rows_of(stored.drop("metadata")) == rows_of(entry.all_chunks_of(spark, tables).drop("metadata"))
    assert rows_of(rollup) == rows_of(entry.record_rollup(entry.fx.tax_records(spark, tables)))


def test_stream_queries_keep_only_what_arrived_and_what_was_made(spark, tables, left):
    got = entry.stream_ingest(spark, tables)
    assert left() == ["incoming", "sink", "state"]
    whole = records.record_chunks(entry.fx.tax_records(spark, tables)).select(*got.columns)
    assert rows_of(got) == rows_of(whole)
    got = entry.stream_raw_files(spark, tables)
    assert left() == ["incoming", "lake", "raw", "raw-state", "sink", "state"] and got.where("source_type = 'csv'").count() == 20


def test_written_tables_free_their_shuffles_and_serve_again(spark, tmp_path):
    counted = spark.range(100).groupBy((F.col("id") % 7).alias("k")).count()
    before = spark.conf.get(store._FREE)
    for name in "ab":
        store.write(counted, str(tmp_path / name), "overwrite")
        assert spark.read.parquet(str(tmp_path / name)).count() == counted.count() == 7
    assert spark.conf.get(store._FREE) == before
    assert all(".zstd." in f for f in spark.read.parquet(str(tmp_path / "a")).inputFiles())
