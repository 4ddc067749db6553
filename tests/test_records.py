from decimal import Decimal

import pytest

from hybridlake.operators import records, summaries
from hybridlake.operators.aggregates import record_rollup
from hybridlake.sources.records import (
    MissingColumns, file_catalogue, layouts, load_records, read_record_files, rejected_records, typed_records,
)
from samples import RECORD_CSV


def test_five_rows_load_with_unique_ids_and_int_years(spark, record_file):
    rows = load_records(spark, record_file).collect()
    assert len({r.id for r in rows}) == len(rows) == 5
    assert {r.tax_year for r in rows} == {2019, 2020, 2022, 2023}
    assert max(r.income for r in rows) == Decimal("1250000")


def test_missing_columns_are_named(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("Col1,Col2\n1,2\n")
    with pytest.raises(ValueError, match="missing columns.*Tax Owed"):
        load_records(spark, str(path))


def test_na_texts_float_years_extra_columns_and_column_order(spark, tmp_path):
    header = "Extra,Tax Owed,Taxpayer Type,Tax Year,Transaction Date,Income Source,Deduction Type,State,Income,Deductions,Taxable Income,Tax Rate"
    lines = [
        "x,10.5,Trust,2021.0,2021-01-01,Salary,None,CA,100,NA,n/a,0.1",
        "x,10.5,Trust,2021,2021-01-01,Salary,,CA,NaN,1,1,0.1",
        "x,,Trust,2021,2021-01-01,Salary,,CA,5,1,1,0.1",
        "x,1,N/A,2021,2021-01-01,Salary,,CA,5,1,1,0.1",
        "x,1,Trust,null,2021-01-01,Salary,,CA,5,1,1,0.1",
    ]
    (tmp_path / "r.csv").write_text("\n".join([header, *lines]) + "\n")
    (row,) = load_records(spark, str(tmp_path)).collect()
    assert (row.taxpayer_type, row.tax_year, row.tax_owed) == ("Trust", 2021, Decimal("10.5"))
    assert row.deduction_type is None and row.deductions is None and row.taxable_income is None
    (text,) = records.record_texts(load_records(spark, str(tmp_path))).collect()
    assert "Deduction type: nan, amount: $nan." in text.text


def test_folder_scan_takes_csv_only_and_not_sub_folders(spark, tmp_path):
    (tmp_path / "a.csv").write_text(RECORD_CSV)
    (tmp_path / "b.csv").write_text(RECORD_CSV)
    (tmp_path / "c.txt").write_text("nothing")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.csv").write_text(RECORD_CSV)
    raw = read_record_files(spark, str(tmp_path))
    assert {r.file_name for r in raw.select("file_name").distinct().collect()} == {"a.csv", "b.csv"}
    assert raw.count() == 10


def test_broken_lines_go_to_the_rejects(spark, tmp_path):
    (tmp_path / "a.csv").write_text(RECORD_CSV + "Trust,2022\n")
    raw = read_record_files(spark, str(tmp_path))
    assert [(r.line, r.reason) for r in rejected_records(raw).collect()] == [("Trust,2022", "malformed")]
    assert rejected_records(raw).count() == 1
    assert typed_records(raw).count() == 5


COLUMNS = RECORD_CSV.splitlines()[0].split(",")


def record_line(columns=COLUMNS, **values):
    row = dict(zip(COLUMNS, ["Trust", "2021", "2021-01-01", "Salary", "None", "CA", "100", "1", "99", "0.1", "9.9"])) | values
    return ",".join(row.get(c, "x") for c in columns)


def test_each_file_keeps_its_own_header(spark, tmp_path):
    """Another order, an extra column, a byte order mark, and headers that share a layout: every row of every file."""
    shuffled = ["Note", *reversed(COLUMNS)]
    quoted = ['"Taxpayer Type"', *COLUMNS[1:]]
    for name, columns, mark in [("a", COLUMNS, ""), ("b", shuffled, ""), ("c", [*COLUMNS, "Note"], "\ufeff"), ("d", quoted, ""), ("e", COLUMNS, "\n\n")]:
        names = [c.strip('"') for c in columns]
        lines = [record_line(names, Income=f"{i}", State=name.upper() * 2) for i in range(5)]
        (tmp_path / f"{name}.csv").write_text(mark + "\n".join([",".join(columns), *lines]) + "\n")
    rows = load_records(spark, str(tmp_path)).collect()
    assert sorted((r.state, int(r.income)) for r in rows) == sorted((n * 2, i) for n in "ABCDE" for i in range(5))
    assert {(r.taxpayer_type, r.tax_year, r.tax_owed) for r in rows} == {("Trust", 2021, Decimal("9.9"))}
    groups, bad = layouts(spark, str(tmp_path))
    assert len(groups) == 3 and not bad  # a, d and e are scanned together


def test_a_file_that_lacks_a_column_is_named(spark, tmp_path):
    (tmp_path / "a.csv").write_text(RECORD_CSV)
    (tmp_path / "b.csv").write_text("\n".join(",".join(line.split(",")[:-1]) for line in RECORD_CSV.splitlines()) + "\n")
    with pytest.raises(MissingColumns, match=r"missing columns: \['Tax Owed'\] in b.csv") as error:
        read_record_files(spark, str(tmp_path))
    assert error.value.files == {"b.csv": ["Tax Owed"]}
    assert read_record_files(spark, str(tmp_path), skip_bad=True).count() == 5


def test_quoted_line_breaks_quotes_and_commas(spark, tmp_path):
    """Only files with such a field give up being split; the rows are the same."""
    (tmp_path / "a.csv").write_text("\n".join([",".join(COLUMNS), record_line(State='"C\nA"'), record_line(State='"say ""hi"", ok"')]) + "\n")
    (tmp_path / "b.csv").write_text("\n".join([",".join(COLUMNS), record_line(State='"say ""hi"", ok"')]) + "\n")
    rows = load_records(spark, str(tmp_path)).collect()
    assert sorted(r.state for r in rows) == ["C\nA", 'say "hi", ok', 'say "hi", ok']
    assert {r.file.rsplit("/", 1)[1]: r.by_line for r in file_catalogue(spark, str(tmp_path)).collect()} == {"a.csv": False, "b.csv": True}
    header = "\n".join(['"Taxpayer\nKind",' + ",".join(COLUMNS), "y," + record_line(State="TX")]) + "\n"
    (tmp_path / "a.csv").write_text(header)
    assert {r.state for r in load_records(spark, str(tmp_path)).collect()} == {"TX", 'say "hi", ok'}


def test_a_folder_without_records(spark, tmp_path):
    assert load_records(spark, str(tmp_path)).count() == 0
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "header.csv").write_text(",".join(COLUMNS) + "\n")
    assert load_records(spark, str(tmp_path)).count() == 0


def test_large_figures_are_kept_and_unreadable_ones_named(spark, tmp_path):
    lines = [record_line(Income=x, State=s) for x, s in [
        ("2000000000000", "AA"), ("999999999999999999999.25", "BB"), ("1e40", "CC"), ("abc", "DD"), ("NA", "EE")]]
    lines += [record_line(**{"Tax Year": "soon", "State": "FF"}), record_line(Deductions="much", State="GG")]
    (tmp_path / "a.csv").write_text("\n".join([",".join(COLUMNS), *lines]) + "\n")
    assert {r.state: r.income for r in load_records(spark, str(tmp_path)).collect()} == {
        "AA": Decimal("2000000000000"), "BB": Decimal("999999999999999999999.25")}
    rejects = {r.line.split(",")[5]: r.reason for r in rejected_records(read_record_files(spark, str(tmp_path))).collect()}
    assert rejects == {"CC": "no value: income", "DD": "no value: income", "EE": "missing: income",
                       "FF": "no value: tax_year", "GG": "no value: deductions"}


def test_fields_that_hold_the_old_separator_get_different_ids(spark, tmp_path):
    lines = [record_line(State="a|b", **{"Income Source": "c"}), record_line(State="b", **{"Income Source": "c|a"}),
             record_line(State="CA", **{"Income Source": "1:x"}), record_line(State="", **{"Income Source": "-"})]
    (tmp_path / "a.csv").write_text("\n".join([",".join(COLUMNS), *lines]) + "\n")
    rows = load_records(spark, str(tmp_path))
    assert rows.count() == rows.select("id").distinct().count() == 4


def test_equal_rows_survive_and_ids_do_not_depend_on_the_load(spark, record_file, monkeypatch):
    once = typed_records(read_record_files(spark, record_file))
    many = once
    for _ in range(6):
        many = many.unionByName(once)
    monkeypatch.setattr(records, "_COPIES_PER_BLOCK", 3)
    ids = [r.id for r in records.with_record_ids(many).select("id").collect()]
    assert len(ids) == len(set(ids)) == 35
    assert {i for i in ids if i.endswith("-1")} == {r.id for r in records.with_record_ids(once).collect()}
    assert sorted(ids) == sorted(r.id for r in records.with_record_ids(many.repartition(5)).collect())


def test_record_text(spark, record_file):
    texts = {r.text for r in records.record_texts(load_records(spark, record_file)).collect()}
    assert (
        "Individual taxpayer filed in 2020 (transaction: 2020-05-21) in WA. Income source: Salary. "
        "Gross income: $64,000.00. Deduction type: Education Expenses, amount: $4,000.00. "
        "Taxable income: $60,000.00. Tax rate: 15.00%. Tax owed: $9,000.00."
    ) in texts


def test_record_params_are_typed(spark, record_file):
    row = records.record_params(load_records(spark, record_file)).where("state = 'WA'").first()
    assert (row.taxpayer_type, row.tax_year, row.income, row.tax_rate) == ("Individual", 2020, 64000.0, 0.15)
    assert isinstance(row.income, float)


def test_record_chunk_metadata(spark, record_file):
    row = records.record_chunks(load_records(spark, record_file)).where("metadata['state'] = 'TX'").first()
    assert row.id.startswith("csv_row_") and row.source_type == "csv"
    assert row.metadata == {
        "source": "Financial_Information.csv", "source_type": "csv", "taxpayer_type": "Corporation",
        "tax_year": "2022", "state": "TX",
    }


def test_summaries_of_five_rows(spark, record_file):
    rows = {r.id: r for r in summaries.summary_chunks(record_rollup(load_records(spark, record_file))).collect()}
    assert len(rows) == 5 + 5 + 4 + 5 + 5
    assert rows["agg_year_2022"].text == (
        "Summary for tax year 2022: Total records: 2. Average income: $1,080,000.00. Average tax rate: 17.50%. "
        "Average tax owed: $165,000.00. Total tax collected: $330,000.00."
    )
    assert rows["agg_source_Capital_Gains"].metadata == {
        "source": "csv_aggregate", "group": "income_source", "value": "Capital Gains",
    }
    assert rows["agg_type_year_Non-Profit_2022"].metadata == {
        "source": "csv_aggregate", "group": "taxpayer_type_year", "taxpayer_type": "Non-Profit", "year": "2022",
    }


def test_modes_take_the_smallest_of_equally_frequent_values_and_skip_missing(spark, record_file):
    rows = load_records(spark, record_file).drop("state").selectExpr("*", "'ZZ' as state")
    lost = rows.selectExpr("* except (income_source, state)", "cast(null as string) as income_source", "state")
    for _ in range(3):
        rows = rows.unionByName(lost)
    (row,) = summaries.summary_chunks(record_rollup(rows), ["state"]).collect()
    assert "Top income source: Business Income. Most common taxpayer type: Corporation." in row.text


def test_missing_group_keys_give_no_summary(spark, record_file):
    rows = load_records(spark, record_file).selectExpr("* except (state)", "cast(null as string) as state")
    assert {r.metadata["group"] for r in summaries.summary_chunks(record_rollup(rows)).collect()} == {
        "taxpayer_type", "tax_year", "taxpayer_type_year", "income_source",
    }
