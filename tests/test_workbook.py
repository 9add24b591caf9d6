import os
import zipfile

import pytest
from pyspark.sql import functions as F

from weftline.sources import readers, workbook

SHAPE = "id long, s string, b boolean, d double"
ROWS = [
    (1, "a\r\n_x0041_ <&>\x01\t", True, 1.5),
    (2, None, None, None),
    (1 << 60, "", False, -0.25),
    (-4, "  x  é😀￾ ", True, 1e300),
    (None, "_x000D", None, float("inf")),
]


def foreign(path, sheets, shared):
    """A workbook as other programs write it: shared strings, cell references, several sheets."""
    main, office = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        listed = "".join(f'<sheet name="{n}" sheetId="{k}" r:id="x{k}"/>' for k, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="x{k}" Target="/xl/worksheets/s{k}.xml"/>' for k in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">{"".join(f"<si>{s}</si>" for s in shared)}</sst>')
        for k, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/s{k}.xml", f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>')


SHARED = ["<t>name</t>", "<t>n</t>", "<r><t>two </t></r><r><t>runs</t></r><rPh><t>hint</t></rPh>", "<t>other</t>"]
FIRST = '<row r="3"><c r="B3" t="s"><v>0</v></c><c r="AA3" t="s"><v>1</v></c></row><row r="4"><c r="B4" t="s"><v>2</v></c><c r="AA4"><v>3.0</v></c></row><row r="5"/><row r="6"><c r="AA6"><f>1+1</f><v>2</v></c><c r="AB6" t="e"><v>#N/A</v></c></row>'
SECOND = '<row><c t="s"><v>1</v></c><c t="s"><v>0</v></c></row><row><c><v>7</v></c><c t="s"><v>3</v></c></row>'


def test_values_come_back(spark, tmp_path):
    path = str(tmp_path / "books")
    workbook.write_workbook(spark.createDataFrame(ROWS, SHAPE).repartition(3), path)
    back = workbook.read_workbook(spark, path, SHAPE)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(ROWS, key=repr)
    assert workbook.read_workbook(spark, path).columns == ["id", "s", "b", "d"]
    assert workbook.read_workbook(spark, path, "d double, id long").filter("id = 1").collect() == [(1.5, 1)]


def test_other_programs_files(spark, tmp_path):
    path = str(tmp_path / "other.xlsx")
    foreign(path, {"One": FIRST, "Two": SECOND}, SHARED)
    rows = workbook.read_workbook(spark, path, "name string, n long")
    assert sorted(map(tuple, rows.collect()), key=str) == [("other", 7), ("two runs", 3), (None, 2)]
    assert rows.rdd.getNumPartitions() == 2  # one a sheet
    assert workbook.read_workbook(spark, path, "n long", sheet="Two").collect() == [(7,)]
    assert workbook.read_workbook(spark, path, sheet="Two").collect() == [("7", "other")]
    assert workbook.sheet_names(path) == ["One", "Two"]
    with pytest.raises(Exception, match="no column absent"):
        workbook.read_workbook(spark, path, "absent string").collect()
    with pytest.raises(Exception, match="runs"):
        workbook.read_workbook(spark, path, "name long", sheet="One").collect()


def test_training_table_reads_the_first_sheet(spark, tmp_path):
    path = str(tmp_path / "training.xlsx")
    foreign(path, {"One": FIRST, "Two": SECOND}, SHARED)
    from weftline import schemas

    assert schemas.require_columns(readers.first_sheet(spark, path), ["name", "n"]).count() == 2


def test_overwrite_append_and_failed_writes(spark, tmp_path):
    path = str(tmp_path / "books")
    workbook.write_workbook(spark.range(10), path)
    workbook.write_workbook(spark.range(10, 15), path)
    assert workbook.read_workbook(spark, path, "id long").count() == 15
    workbook.write_workbook(spark.range(3), path, "overwrite")
    assert workbook.read_workbook(spark, path, "id long").agg(F.sum("id")).first()[0] == 3
    with pytest.raises(Exception, match="at most 32767"):
        workbook.write_workbook(spark.createDataFrame([("x" * 40_000,), ("y",)], "s string"), path)
    assert workbook.read_workbook(spark, path, "id long").count() == 3
    assert not [f for f in os.listdir(path) if f.startswith(".") and f.endswith(".xlsx")]


def test_rows_beyond_a_sheet_and_empty_tables(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "books")
    writer = workbook.WorkbookWriter(spark.range(1).schema, {"path": path}, False)
    monkeypatch.setattr(workbook, "SHEET_ROWS", 4)
    writer.commit([writer.write(iter([(k,) for k in range(8)])), writer.write(iter([]))])
    assert [len(workbook.sheet_names(f)) for f in workbook._files(path)] == [3]
    assert sorted(r.id for r in workbook.read_workbook(spark, path, "id long").collect()) == list(range(8))
    empty = str(tmp_path / "empty")
    workbook.write_workbook(spark.range(0), empty)
    assert workbook.read_workbook(spark, empty, "id long").count() == 0
