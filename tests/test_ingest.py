import gzip
import json

import pytest
from pyspark.sql import functions as F

from hybridlake.fixtures import letter_counts
from hybridlake.operators import records, search
from hybridlake.plans import ingest as plan
from hybridlake.plans.answer import answer
from hybridlake.plans.ingest import Lake
from hybridlake.schemas import CHUNK, PAGE
from hybridlake.session import work_dir
from hybridlake.sources import documents, store
from hybridlake.sources.records import load_records
from hybridlake.sources.rollup import RollupStore
from hybridlake.streaming import ingest as stream
from samples import RECORD_CSV


def ingest(*arguments, skip_index=True, **options):
    return plan.ingest(*arguments, skip_index=skip_index, **options)


def chunk(key, text, source="s"):
    return (key, text, source, None, {"source": source})


def test_store_adds_new_ids_once_and_keeps_the_first(spark, tmp_path):
    kept = store.ChunkStore(spark, str(tmp_path / "chunks"))
    assert kept.count() == 0
    kept.add(spark.createDataFrame([chunk("a", "1"), chunk("b", "1"), chunk("b", "1")], CHUNK))
    kept.add(spark.createDataFrame([chunk("b", "2"), chunk("c", "2")], CHUNK))
    kept.add(spark.createDataFrame([chunk("b", "3")], CHUNK))
    kept.add(spark.createDataFrame([], CHUNK))
    assert {(r.id, r.text) for r in kept.read().collect()} == {("a", "1"), ("b", "1"), ("c", "2")}
    assert kept.count() == 3


def test_copies_that_differ_in_metadata_and_chunks_without_id(spark, tmp_path):
    rows = [("a", "1", "s", None, {"page": str(i)}) for i in (3, 1, 2)] + [(None, "x", "s", None, {})]
    for n in (1, 4):
        kept = store.ChunkStore(spark, str(tmp_path / f"chunks{n}"))
        kept.add(spark.createDataFrame(rows, CHUNK).repartition(n))
        kept.add(spark.createDataFrame(rows[::-1], CHUNK))
        assert [(r.id, r.metadata) for r in kept.read().collect()] == [("a", {"page": "1"})]


def test_store_reset_and_replace_from_itself(spark, tmp_path):
    kept = store.ChunkStore(spark, str(tmp_path / "chunks"))
    kept.add(spark.createDataFrame([chunk("a", "1"), chunk("b", "1")], CHUNK))
    kept.replace(kept.read().where("id = 'a'").withColumn("text", F.lit("new")))
    assert [(r.id, r.text) for r in kept.read().collect()] == [("a", "new")]
    kept.reset()
    assert kept.count() == 0


def test_filters_on_source_reach_the_scan(spark, tmp_path):
    from hybridlake.operators.search import matching

    kept = store.ChunkStore(spark, str(tmp_path / "chunks"))
    kept.add(spark.createDataFrame([chunk("a", "1")], CHUNK))
    plan = matching(kept.read(), source="s").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(source,s)" in plan and "metadata" not in plan.split("ReadSchema")[1]


def write_data(folder):
    folder.mkdir()
    (folder / "r.csv").write_text(RECORD_CSV)
    (folder / "pages").mkdir()
    long = " ".join(f"word{i}" for i in range(30))
    lines = [json.dumps({"filename": "usc.pdf", "page_num": i, "text": t}) for i, t in enumerate([long, "short", long])]
    (folder / "pages" / "p.json").write_text("\n".join([*lines, "{broken"]))
    (folder / "slides").mkdir()
    (folder / "slides" / "s.json").write_text(json.dumps({
        "filename": "d.pptx", "slide": 1, "pos": 0, "shape_name": "Body", "is_notes": False,
        "text": "a line of text that is long enough to keep",
    }))
    return str(folder)


def test_ingest_twice_changes_nothing(spark, tmp_path):
    data, lake = write_data(tmp_path / "data"), Lake(spark, str(tmp_path / "lake"))
    first = ingest(spark, data, lake)
    assert first == {"documents": 5 + 24 + 2 + 1, "record_nodes": 5, "rows_read": 5 + 4 + 1, "rows_rejected": 1}
    assert ingest(spark, data, lake) == first
    assert ingest(spark, data, lake, reset=True) == first
    assert lake.graph.read("edges").count() == 25 and lake.graph.read("nodes").count() == 24
    assert lake.rollup.count() == 5
    assert [(r.file, r.line, r.reason, r.n, r.kind) for r in lake.rejects.read().collect()] == [("p.json", "{broken", "malformed", 1, "page")]
    pages = {r.id: r.metadata["page"] for r in lake.chunks.read().where("source = 'usc.pdf'").collect()}
    assert pages == {"usc.pdf_p0_c0": "1", "usc.pdf_p2_c0": "3"}


def test_answers_from_the_index_equal_those_from_a_scan(spark, tmp_path):
    """Also after a second load, when weights and summaries have changed."""
    data, lake = write_data(tmp_path / "data"), Lake(spark, str(tmp_path / "lake"))
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "r.csv").write_text(RECORD_CSV.replace("2022", "2021"))
    asked = spark.createDataFrame(
        [(1, "rental income of a Trust in OH", 8), (2, "word7 word8", 3), (3, "long enough to keep", 8), (4, "zzz", 8), (5, "Trust 2021", 20)],
        "qid long, message string, n_results int")
    for folder in (data, str(tmp_path / "more")):
        ingest(spark, folder, lake, skip_index=False)
        scanned = answer(asked, lake.read_chunks(), lake.rollup)
        indexed = answer(asked, lake.read_chunks(), lake.rollup, index=lake.index)
        assert rows_of(indexed) == rows_of(scanned) and indexed.where("n_hits > 0").count() >= 3


def test_dense_answers_after_two_loads(spark, tmp_path):
    """New chunks are embedded once, summaries as of now; stored vectors give what embedding everything gives."""
    embed = search.embedder(letter_counts)
    data, lake = write_data(tmp_path / "data"), Lake(spark, str(tmp_path / "lake"))
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "r.csv").write_text(RECORD_CSV.replace("2022", "2021"))
    asked = spark.createDataFrame([(1, "rental of a Trust", 4), (2, "zzz", 20)], "qid long, message string, n_results int")
    for folder in (data, str(tmp_path / "more")):
        ingest(spark, folder, lake, embed=embed)
    assert lake.vectors.read().count() == lake.chunks.count() == lake.vectors.read().select("id").distinct().count()
    stored = answer(asked, lake.read_chunks(), lake.rollup, embed=embed, vectors=lake.read_vectors(embed))
    assert rows_of(stored) == rows_of(answer(asked, lake.read_chunks(), lake.rollup, embed=embed))
    assert {r.qid: r.n_hits for r in stored.collect()}[1] == 4 and rows_of(stored) != rows_of(answer(asked, lake.read_chunks(), lake.rollup))


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("skip_graph_first", [False, True])
def test_two_loads_equal_one(spark, tmp_path, skip_graph_first):
    """Rollup, summaries and stores after A then B are those of A and B together; the second load repeats some rows."""
    header, *lines = RECORD_CSV.splitlines()
    more = [line.replace("2022", "2019").replace(",TX,", ",OH,") for line in lines if "2022" in line]
    for name, part in {"a": lines[:4], "b": lines[2:] + more, "both": lines + more}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "r.csv").write_text("\n".join([header, *part]) + "\n")
    steps, whole = Lake(spark, str(tmp_path / "steps")), Lake(spark, str(tmp_path / "whole"))
    ingest(spark, str(tmp_path / "a"), steps, skip_graph=skip_graph_first)
    if skip_graph_first:
        assert steps.rollup.count() == 0 and steps.chunk_rollup.read().count() == 4
        ingest(spark, str(tmp_path / "a"), steps, skip_vector=True)
    before = {r.id: r.text for r in steps.read_chunks().collect()}
    last = ingest(spark, str(tmp_path / "b"), steps)
    assert {k: v for k, v in last.items() if not k.startswith("rows")} == {
        k: v for k, v in ingest(spark, str(tmp_path / "both"), whole).items() if not k.startswith("rows")}
    assert rows_of(steps.rollup) == rows_of(whole.rollup) and steps.rollup.count() == 7
    assert rows_of(steps.read_chunks()) == rows_of(whole.read_chunks())
    after = {r.id: r.text for r in steps.read_chunks().collect()}
    assert before["agg_year_2019"] != after["agg_year_2019"] and len(after) == steps.read_chunks().count()


def test_a_load_that_broke_off_is_counted_once(spark, tmp_path, record_file, monkeypatch):
    """Nothing of a load is visible unless its one write was committed."""
    rows, kept = load_records(spark, record_file), RollupStore(spark, str(tmp_path / "rollup"))
    with monkeypatch.context() as broken:
        broken.setattr("hybridlake.sources.rollup.record_rollup", lambda df: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            kept.add(rows)
    assert kept.read().count() == 0
    assert kept.add(rows) == 5 and kept.add(rows) == 0 and kept.read().count() == 5
    kept.reset()
    assert kept.read().count() == 0


def test_every_lost_row_is_in_the_sink(spark, tmp_path):
    """Bad record lines, a record file without its columns, page rows without a key, and a damaged file."""
    data, lake = write_data(tmp_path / "data"), Lake(spark, str(tmp_path / "lake"))
    folder = tmp_path / "data"
    (folder / "r.csv").write_text(RECORD_CSV + "Trust,2022\nTrust,2022\n" + RECORD_CSV.splitlines()[1].replace("82000", "lots") + "\n")
    (folder / "s.csv").write_text("A,B\n1,2\n")
    (folder / "pages" / "q.json").write_text('{"page_num": 3, "text": "no file"}\n')
    packed = gzip.compress("\n".join(json.dumps({"filename": "z.pdf", "page_num": i, "text": str(i)}) for i in range(5000)).encode())
    (folder / "pages" / "z.json.gz").write_bytes(packed[:len(packed) // 2])
    with pytest.raises(ValueError, match="missing columns.*s.csv"):
        ingest(spark, data, lake)
    counts = ingest(spark, data, lake, skip_bad_files=True)
    assert (counts["rows_read"], counts["rows_rejected"], counts["record_nodes"]) == (8 + 5 + 1, 3 + 2, 5)
    lost = {(r.file, r.line, r.reason.split(":")[0], r.n, r.kind) for r in lake.rejects.read().collect()}
    assert lost == {
        ("r.csv", "Trust,2022", "malformed", 2, "record"), ("s.csv", None, "missing columns", 1, "record"),
        ("r.csv", "Trust,2019,2019-11-02,Rental,Medical Expenses,OH,lots,7000,75000,0.18,13500", "no value", 1, "record"),
        ("p.json", "{broken", "malformed", 1, "page"), ("q.json", '{"page_num": 3, "text": "no file"}', "missing", 1, "page"),
        ("z.json.gz", None, "unreadable", 1, "page"),
    }
    assert ingest(spark, data, lake, skip_bad_files=True) == counts
    assert lake.rejects.read().count() == 6


def test_ingest_switches_and_missing_inputs(spark, tmp_path, caplog):
    data = write_data(tmp_path / "data")
    assert ingest(spark, data, Lake(spark, str(tmp_path / "a")), skip_graph=True)["record_nodes"] == 0
    only_graph = Lake(spark, str(tmp_path / "b"))
    counts = ingest(spark, data, only_graph, skip_vector=True)
    assert (counts["documents"], counts["record_nodes"]) == (0, 5)
    assert not only_graph.chunks.exists()
    (tmp_path / "empty").mkdir()
    assert ingest(spark, str(tmp_path / "empty"), Lake(spark, str(tmp_path / "c")))["documents"] == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        ingest(spark, str(tmp_path / "nowhere"), Lake(spark, str(tmp_path / "d")))
    assert "no record files" in caplog.text and "no page texts" in caplog.text


def test_graph_sink_adds_only_new_records_and_nodes(spark, tmp_path, record_file):
    rows = load_records(spark, record_file)
    sink = store.GraphStore(spark, str(tmp_path / "graph"))
    sink.add(rows.where("state in ('CA', 'TX')"))
    sink.add(rows)
    assert sink.node_count() == 5 and sink.read("edges").count() == 25
    assert sink.read("nodes").count() == sink.read("nodes").distinct().count() == 24
    plan = sink.read("edges").where("rel = 'IN_STATE'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(rel" in plan


def test_bad_lines_of_page_files_are_kept_apart(spark, tmp_path):
    path = tmp_path / "p.json"
    path.write_text('{"filename": "a.pdf", "page_num": 0, "text": "x"}\n{oops\n')
    assert documents.read_pages(spark, str(path)).count() == 1
    assert [r.line for r in documents.rejected_lines(spark, str(path), PAGE).collect()] == ["{oops"]


def test_stream_equals_batch_and_keeps_the_first_value(spark, tmp_path, record_file):
    loaded = records.record_chunks(load_records(spark, record_file))
    incoming, sink, state = (str(tmp_path / p) for p in ("in", "out", "state"))
    loaded.where("metadata['tax_year'] < 2022").write.mode("append").parquet(incoming)
    stream.run_once(spark, incoming, sink, state)
    loaded.withColumn("text", F.lit("later")).write.mode("append").parquet(incoming)
    stream.run_once(spark, incoming, sink, state)
    got = {(r.id, r.text) for r in store.ChunkStore(spark, sink).read().collect()}
    batch = store.ChunkStore(spark, str(tmp_path / "batch"))
    batch.add(loaded.where("metadata['tax_year'] < 2022"))
    batch.add(loaded.withColumn("text", F.lit("later")))
    assert got == {(r.id, r.text) for r in batch.read().collect()}
    assert sum(t == "later" for _, t in got) == 3


def test_stream_of_raw_files_equals_batch(spark, tmp_path):
    """Deliveries in several folders and batches, with a header order of its own, a bad file and a bad line."""
    incoming, state = tmp_path / "incoming", str(tmp_path / "state")
    incoming.mkdir()
    write_data(incoming / "a")
    lake = Lake(spark, str(tmp_path / "lake"))
    stream.run_files(spark, str(incoming), lake, state, max_files=1)
    first = rows_of(lake.read_chunks())
    header, *lines = RECORD_CSV.strip().split("\n")
    turned = [",".join(reversed(line.split(","))) for line in (header, "Trust,2021,2021-01-02,Salary,Rental,NV,5000,100,4900,0.2,980")]
    (incoming / "b").mkdir()
    (incoming / "b" / "turned.csv").write_text("\n".join(turned))
    (incoming / "b" / "bad.csv").write_text("Tax Year\n2020\n")
    (incoming / "b" / "note.txt").write_text("no data")
    stream.run_files(spark, str(incoming), lake, state, max_files=2)
    stream.run_files(spark, str(incoming), lake, state)
    assert {r.file for r in lake.rejects.read().where("reason like 'missing columns%'").collect()} == {"bad.csv"}

    batch = Lake(spark, str(tmp_path / "batch"))
    ingest(spark, str(incoming / "a"), batch)
    assert rows_of(batch.read_chunks()) == first
    ingest(spark, str(incoming / "b"), batch, skip_bad_files=True)
    assert rows_of(batch.read_chunks()) == rows_of(lake.read_chunks()) != first
    assert rows_of(batch.rollup) == rows_of(lake.rollup)
    assert lake.graph.node_count() == 6


def test_sink_shuffles_ids_before_texts(spark, tmp_path):
    """Texts meet only the table of new ids, and only those of repeated ids are aggregated."""
    kept = store.ChunkStore(spark, str(tmp_path / "chunks"))
    given = store.ChunkStore(spark, str(tmp_path / "given"))
    spark.createDataFrame([chunk(f"k{i % 40}", str(i)) for i in range(60)], CHUNK).write.parquet(given.path)
    kept.add(given.read())
    assert kept.count() == 40
    expected = {f"k{i}": min(str(n) for n in range(i, 60, 40)) for i in range(40)}
    assert {r.id: r.text for r in kept.read().collect()} == expected
    kept.add(given.read())
    assert kept.count() == 40
    plan = store.new_chunks(given.read(), kept.read())._jdf.queryExecution().optimizedPlan().toString()
    assert str(tmp_path) not in plan and plan.count("Aggregate") == 1


def test_work_dir_follows_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert work_dir(spark, "x").startswith(root) and work_dir(spark, "x") != work_dir(spark, "x")


class NoFolder:
    """A session without the setting, of some master."""

    def __init__(self, master):
        self.conf, self.sparkContext = self, self
        self.master, self.applicationId = master, f"app-{master}"

    def get(self, key, default):
        return default


def test_work_dir_without_the_setting():
    local = NoFolder("local[2]")
    assert work_dir(local, "x").rsplit("/", 1)[0] == work_dir(local, "y").rsplit("/", 1)[0]
    for master in ("yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            work_dir(NoFolder(master), "x")


def test_store_counts(spark):
    row = store.store_counts(documents=spark.range(7), record_nodes=spark.range(0)).first()
    assert (row.documents, row.record_nodes) == (7, 0)


def test_missing_folder_of_records_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        load_records(spark, str(tmp_path / "x"))


def test_chunks_of_records_are_made_for_new_records_alone(spark, tmp_path):
    """The first load is written without a shuffle, a second one adds what is new, and a row without an id is none."""
    rows = spark.createDataFrame([(str(i), f"text {i}") for i in range(20)] + [(None, "lost")], "id string, text string")
    made = []

    def chunks_of(new):
        made.append(new)
        return new.select(
            F.concat(F.lit("c"), "id").alias("id"), "text", F.lit("s").alias("source"), F.lit("t").alias("source_type"),
            F.create_map(F.lit("a"), F.lit("b")).alias("metadata"))

    kept, name = store.ChunkStore(spark, str(tmp_path / "made")), F.concat(F.lit("c"), "id")
    kept.add_made(rows.where("id < 15 or id is null"), chunks_of, name)
    assert "Exchange" not in made[0]._jdf.queryExecution().sparkPlan().toString() and kept.count() == 15
    for _ in range(2):
        kept.add_made(rows, chunks_of, name)
    assert sorted(r.id for r in kept.read().collect()) == sorted(f"c{i}" for i in range(20))


def test_a_load_of_records_writes_no_chunk_aside(spark, tmp_path, record_file, monkeypatch):
    import shutil

    (tmp_path / "data").mkdir()
    shutil.copy(record_file, tmp_path / "data" / "r.csv")
    monkeypatch.setattr(store.ChunkStore, "add", lambda *a: pytest.fail("the texts of records were written aside"))
    lake = Lake(spark, str(tmp_path / "lake"))
    assert ingest(spark, str(tmp_path / "data"), lake, skip_index=True, skip_graph=True)["documents"] > 0
