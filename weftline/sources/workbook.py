"""Excel workbooks (.xlsx) as a data source: sheets are streamed out of the zipped XML, tasks write one workbook each."""

from __future__ import annotations

import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, ByteType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructField, StructType

from weftline.sources.workspace import ship

#: Fixed values of the file format: the most rows of a sheet and the most UTF-16 units of a cell, XML namespaces.
SHEET_ROWS, CELL_UNITS = 1_048_576, 32_767
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"

_ROWS_A_BATCH = 1000
#: Characters that XML cannot hold or does not keep, and what looks like their escape.
_UNSAFE = re.compile("[\x00-\x08\x0b-\x1f￾￿]|_(?=x[0-9A-Fa-f]{4}_)")
_ESCAPED = re.compile("_x([0-9A-Fa-f]{4})_")
_WHOLE = (ByteType, ShortType, IntegerType, LongType)
_REAL = (DoubleType, FloatType)


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """A path's file system and its path there; ``s3a`` is ``s3`` outside the JVM."""
    path = re.sub(r"^s3[an]://", "s3://", path)
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    """The workbooks of a folder in order of name, or the one file."""
    where, inner = _place(path)
    if where.get_file_info(inner).type == fs.FileType.File:
        return [path]
    found = where.get_file_info(fs.FileSelector(inner))
    return sorted(f"{path.rstrip('/')}/{f.base_name}" for f in found if f.is_file and f.base_name.endswith(".xlsx") and f.base_name[0] not in "._~")


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, member) of a workbook's sheets, in its order."""
    links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
        target = links[sheet.get(f"{{{_OFFICE}}}id")]
        out.append((sheet.get("name"), target[1:] if target.startswith("/") else posixpath.normpath(f"xl/{target}")))
    return out


def sheet_names(path: str) -> list[str]:
    where, inner = _place(path)
    with where.open_input_file(inner) as raw, zipfile.ZipFile(raw) as book:
        return [name for name, _ in _sheets(book)]


def _elements(book: zipfile.ZipFile, member: str, tag: str) -> Iterator[ElementTree.Element]:
    """Elements of a member as they are read; what has been given is dropped, so memory holds one."""
    with book.open(member) as stream:
        parents = []
        for event, element in ElementTree.iterparse(stream, ("start", "end")):
            if event == "start":
                parents.append(element)
                continue
            parents.pop()
            if element.tag == _MAIN + tag:
                yield element
                parents[-1].remove(element)


def _unescaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), text)


def _escaped(text: str) -> str:
    return escape(_UNSAFE.sub(lambda m: f"_x{ord(m[0]):04X}_", text))


def _text(element: ElementTree.Element) -> str:
    """The text of a string item: its runs joined, without phonetic hints."""
    runs = [element.find(f"{_MAIN}t"), *(r.find(f"{_MAIN}t") for r in element.findall(f"{_MAIN}r"))]
    return _unescaped("".join(t.text or "" for t in runs if t is not None))


def _column(reference: str) -> int:
    """Zero-based column of a cell reference such as ``AB12``."""
    n = 0
    for c in reference:
        if not "A" <= c <= "Z":
            break
        n = 26 * n + ord(c) - 64
    return n - 1


def _cells(row: ElementTree.Element, shared: list[str]) -> dict[int, str | None]:
    """{column: value as text} of a row; cells without a value are left out."""
    out, at = {}, -1
    for cell in row.findall(f"{_MAIN}c"):
        reference = cell.get("r")
        at = _column(reference) if reference else at + 1
        kind, value = cell.get("t", "n"), cell.find(f"{_MAIN}v")
        if kind == "inlineStr":
            inline = cell.find(f"{_MAIN}is")
            out[at] = "" if inline is None else _text(inline)
        elif value is not None and kind != "e":
            out[at] = shared[int(value.text)] if kind == "s" else ("true" if value.text == "1" else "false") if kind == "b" else _unescaped(value.text or "") if kind == "str" else value.text
    return out


def _rows(path: str, member: str) -> Iterator[dict[int, str | None]]:
    where, inner = _place(path)
    with where.open_input_file(inner) as raw, zipfile.ZipFile(raw) as book:
        shared = [_text(x) for x in _elements(book, "xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in book.namelist() else []
        for row in _elements(book, member, "row"):
            if cells := _cells(row, shared):
                yield cells


def _value(text: str | None, kind) -> object:
    """A cell for a column of that type; a cell that is no such value fails the read."""
    if text is None or isinstance(kind, StringType):
        return text
    if isinstance(kind, BooleanType):
        if text.lower() not in ("true", "false", "1", "0"):
            raise ValueError(f"no boolean: {text!r}")
        return text.lower() in ("true", "1")
    if isinstance(kind, _WHOLE):
        try:
            return int(text)
        except ValueError:  # 3.0 or 1E+3, as some programs write whole numbers
            if not (number := float(text)).is_integer():
                raise
            return int(number)
    if isinstance(kind, _REAL):
        return float(text)
    raise TypeError(f"no cells of type {kind.simpleString()}")


@dataclass
class SheetPartition(InputPartition):
    path: str
    member: str


class WorkbookReader(DataSourceReader):
    """One partition for each sheet; a zipped sheet can only be read from its start."""

    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema, self.path, self.sheet = schema, options["path"], options.get("sheet")

    def partitions(self) -> list[SheetPartition]:
        out = []
        for path in _files(self.path):
            where, inner = _place(path)
            with where.open_input_file(inner) as raw, zipfile.ZipFile(raw) as book:
                out += [SheetPartition(path, member) for name, member in _sheets(book) if self.sheet in (None, name)]
        return out

    def read(self, partition: SheetPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are no sheets
            return
        shape, rows = to_arrow_schema(self.schema), _rows(partition.path, partition.member)
        heads = {name: at for at, name in sorted(next(rows, {}).items(), reverse=True)}
        missing = [f.name for f in self.schema if heads and f.name not in heads]
        if missing:
            raise ValueError(f"{partition.path}: no column {', '.join(missing)}")
        waiting: list[dict[int, str | None]] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([_value(r.get(heads[f.name]), f.dataType) for r in waiting], a.type) for f, a in zip(self.schema, shape, strict=True)], schema=shape)

        for row in rows:
            waiting.append(row)
            if len(waiting) == _ROWS_A_BATCH:
                yield batch()
                waiting = []
        if waiting:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    pending: str
    final: str


class WorkbookWriter(DataSourceWriter):
    """One workbook for each task that has rows, under a hidden name until all tasks are done; a failed write leaves no workbook."""

    def __init__(self, schema: StructType, options: dict, overwrite: bool) -> None:
        self.schema, self.path, self.overwrite = schema, options["path"].rstrip("/"), overwrite
        self.run = uuid.uuid4().hex

    def _cell(self, value: object) -> str:
        if value is None:
            return "<c/>"
        if isinstance(value, bool):
            return f'<c t="b"><v>{int(value)}</v></c>'
        if isinstance(value, int | float) and (isinstance(value, float) or -(1 << 53) <= value <= 1 << 53):
            if value == value and abs(value) != float("inf"):
                return f"<c><v>{value!r}</v></c>"
        text = str(value)
        if len(text) > CELL_UNITS // 2 and len(text.encode("utf-16-le")) // 2 > CELL_UNITS:
            raise ValueError(f"a cell holds at most {CELL_UNITS} characters; divide the text over rows")
        return f'<c t="inlineStr"><is><t xml:space="preserve">{_escaped(text)}</t></is></c>'

    def write(self, iterator: Iterator[Row]) -> Written:
        name = uuid.uuid4().hex
        done = Written(f"{self.path}/.{self.run}-{name}.xlsx", f"{self.path}/part-{self.run[:8]}-{name}.xlsx")
        where, inner = _place(done.pending)
        where.create_dir(posixpath.dirname(inner), recursive=True)
        head = "<row>" + "".join(self._cell(f.name) for f in self.schema) + "</row>"
        sheets, row = 0, next(iterator, None)
        if row is None:
            return Written("", "")
        with where.open_output_stream(inner) as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as book:
            while row is not None:
                sheets += 1
                with book.open(f"xl/worksheets/sheet{sheets}.xml", "w", force_zip64=True) as out:
                    out.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN[1:-1]}"><sheetData>{head}'.encode())
                    for _ in range(SHEET_ROWS - 1):
                        out.write(("<row>" + "".join(map(self._cell, row)) + "</row>").encode())
                        if (row := next(iterator, None)) is None:
                            break
                    out.write(b"</sheetData></worksheet>")
            self._describe(book, sheets)
        return done

    def _describe(self, book: zipfile.ZipFile, sheets: int) -> None:
        """The members that list the sheets."""
        numbers, kind = range(1, sheets + 1), "application/vnd.openxmlformats-officedocument.spreadsheetml"
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="{kind}.worksheet+xml"/>' for n in numbers)
        listed = "".join(f'<sheet name="Sheet{n}" sheetId="{n}" r:id="rId{n}"/>' for n in numbers)
        links = "".join(f'<Relationship Id="rId{n}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{n}.xml"/>' for n in numbers)
        xml = f'<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>'
        book.writestr("[Content_Types].xml", f'<Types xmlns="{_PACKAGE}/content-types">{xml}{parts}</Types>')
        book.writestr("_rels/.rels", f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PACKAGE}/relationships">{links}</Relationships>')
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{_OFFICE}"><sheets>{listed}</sheets></workbook>')

    def commit(self, messages: list[Written | None]) -> None:
        where, folder = _place(self.path)
        where.create_dir(folder, recursive=True)
        old = _files(self.path) if self.overwrite else []
        for m in messages:
            if m and m.pending:
                where.move(_place(m.pending)[1], _place(m.final)[1])
        for path in old:
            where.delete_file(_place(path)[1])
        self._drop_pending()

    def abort(self, messages: list[Written | None]) -> None:
        self._drop_pending()

    def _drop_pending(self) -> None:
        """Whatever tries of this write left, those that were repeated elsewhere included."""
        where, folder = _place(self.path)
        for f in where.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if f.base_name.startswith(f".{self.run}-"):
                where.delete_file(f.path)


class WorkbookSource(DataSource):
    """Format ``workbook``; see ``read_workbook`` and ``write_workbook``."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> StructType:
        """The first row of the first sheet that is read, as strings; repeated and empty heads are left out."""
        for p in WorkbookReader(StructType(), self.options).partitions():
            if first := next(_rows(p.path, p.member), None):
                return StructType([StructField(n, StringType()) for n in dict.fromkeys(first[k] for k in sorted(first)) if n])
        return StructType()

    def reader(self, schema: StructType) -> WorkbookReader:
        return WorkbookReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(schema, self.options, overwrite)


def _registered(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(WorkbookSource)


def read_workbook(spark: SparkSession, path: str, schema: str | StructType | None = None, sheet: str | None = None) -> DataFrame:
    """Rows of a workbook or of a folder of them, one partition a sheet; all sheets of that name, or all.

    The first row of a sheet that holds anything names its columns; ``schema`` picks columns by name (strings, whole numbers,
    doubles, booleans), without it all are strings. A column that a sheet lacks and a cell of another type are errors. Empty
    cells and error values are null, empty rows are skipped, formulas give the value that was stored. Dates are the numbers that the file holds.
    A sheet is streamed, but the table of strings that a workbook's sheets share is held by each task.
    """
    _registered(spark)
    reader = spark.read.format("workbook")
    reader = reader.schema(schema) if schema is not None else reader
    return (reader.option("sheet", sheet) if sheet is not None else reader).load(path)


def write_workbook(df: DataFrame, path: str, mode: str = "append") -> None:
    """Write ``df`` as workbooks in a folder, one a task; a sheet takes what the format allows, the rest goes to further sheets.

    Null is an empty cell. Whole numbers that a double cannot hold are written as text, which reads back the same. A text beyond the
    format's limit of a cell is an error. Files appear when all tasks are done; with ``overwrite`` the former ones then go.
    """
    _registered(df.sparkSession)
    df.write.format("workbook").mode(mode).save(path)
