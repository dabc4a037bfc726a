"""Spreadsheets (XLSX) as cells, and reports as spreadsheets.

A workbook is a ZIP archive of XML. Each file is opened where it lies, its sheets are read
as streams, row by row, and every cell that is not empty becomes a row; merged cells have
their value in the first one, as they are stored. A workbook is written by the task that
has its rows, row by row, with its texts in place; it appears under its name when it is
whole.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names that the format gives its parts.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
CELLS = "path string, sheet string, row int, col int, value string, error string"
BATCH = 50_000


def column_number(reference: str) -> int:
    """1 for A, 27 for AA."""
    number = 0
    for letter in re.match(r"[A-Z]+", reference)[0]:
        number = number * 26 + ord(letter) - 64
    return number


def column_name(number: int) -> str:
    name = ""
    while number:
        number, rest = divmod(number - 1, 26)
        name = chr(65 + rest) + name
    return name


def texts_of(archive: zipfile.ZipFile) -> list[str]:
    """The workbook's shared texts; runs of rich text are put together."""
    if "xl/sharedStrings.xml" not in archive.namelist():
        return []
    found = []
    with archive.open("xl/sharedStrings.xml") as part:
        for _, node in ElementTree.iterparse(part):
            if node.tag == f"{MAIN}si":
                found.append("".join(t.text or "" for t in node.iter(f"{MAIN}t")))
                node.clear()
    return found


def sheets_of(archive: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Names of the sheets and of their parts, in the workbook's order."""
    links = {n.get("Id"): n.get("Target") for n in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
    nodes = ElementTree.fromstring(archive.read("xl/workbook.xml")).iter(f"{MAIN}sheet")
    place = lambda t: t.lstrip("/") if t.startswith("/") else posixpath.normpath(f"xl/{t}")
    return [(n.get("name"), place(links[n.get(LINK)])) for n in nodes]


def cells_of(archive: zipfile.ZipFile) -> Iterator[tuple[str, int, int, str]]:
    """sheet, row, column (from 1) and value of each cell that is not empty."""
    texts = texts_of(archive)
    for name, part in sheets_of(archive):
        with archive.open(part) as opened:
            row = col = 0
            for event, node in ElementTree.iterparse(opened, events=("start", "end")):
                if event == "start":
                    if node.tag == f"{MAIN}row":
                        row, col = int(node.get("r") or row + 1), 0
                    continue
                if node.tag == f"{MAIN}c":
                    col = column_number(node.get("r")) if node.get("r") else col + 1
                    kind, value = node.get("t"), node.find(f"{MAIN}v")
                    if kind == "inlineStr":
                        text = "".join(t.text or "" for t in node.iter(f"{MAIN}t"))
                    elif value is None or value.text is None:
                        text = ""
                    else:
                        text = texts[int(value.text)] if kind == "s" else value.text
                    if text != "":
                        yield name, row, col, text
                elif node.tag == f"{MAIN}row":
                    node.clear()


def sheet_cells(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, row, col and value of all cells of the workbooks at path; a workbook that cannot be read is a row with an error."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in CELLS.split(", ")]
        kinds = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("row", pa.int32()), ("col", pa.int32()), ("value", pa.string()), ("error", pa.string())])
        pack = lambda rows: pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], kinds)
        for batch in batches:
            for at in batch.column(0).to_pylist():
                rows: list[tuple] = []
                try:
                    files, name = fs.FileSystem.from_uri(at if "://" in at else at.replace("file:/", "file:///", 1))
                    with files.open_input_file(name) as opened, zipfile.ZipFile(opened) as archive:
                        for cell in cells_of(archive):
                            rows.append((at, *cell, None))
                            if len(rows) >= BATCH:
                                yield pack(rows)
                                rows = []
                except (zipfile.BadZipFile, KeyError, ValueError, IndexError, OSError, ElementTree.ParseError, pa.ArrowInvalid) as error:
                    rows.append((at, None, None, None, None, f"{type(error).__name__}: {error}"))
                yield pack(rows)

    books = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", True).load(path)
    return books.select("path").mapInArrow(read, CELLS)


def applicability(cells: DataFrame, *, head_row: int, first_col: int, marks: Sequence[str], keys: dict[str, int]) -> DataFrame:
    """A matrix of marks as pairs: path, sheet, the key columns of a row, and the heading of each column that is marked.

    Headings stand in ``head_row`` from ``first_col`` on; keys: names of key columns and their
    numbers. A cell with anything but a mark in it is an error of its row: ``unknown``.
    """
    body = cells.filter((F.col("row") > head_row) & F.col("error").isNull())
    heads = cells.filter((F.col("row") == head_row) & (F.col("col") >= first_col)).select("path", "sheet", "col", F.trim("value").alias("heading"))
    of_row = body.groupBy("path", "sheet", "row").agg(*[F.max(F.when(F.col("col") == n, F.trim("value"))).alias(k) for k, n in keys.items()])
    marked = body.filter(F.col("col") >= first_col).select("path", "sheet", "row", "col", F.trim("value").alias("mark"))
    found = marked.join(heads, ["path", "sheet", "col"]).join(of_row, ["path", "sheet", "row"])
    known: Column = F.col("mark").isin(list(marks))
    return found.select("path", "sheet", "row", *keys, "heading", F.when(~known, F.col("mark")).alias("unknown"))


def write_workbook(rows: DataFrame, path: str, *, sheet: str = "Sheet1", more: dict[str, Sequence[Sequence[str]]] | None = None) -> str:
    """Writes a bounded report as one workbook and gives its path: a header and the rows, in order, then further small sheets. Numbers stay numbers; texts are never formulas."""
    heads, sheets = rows.columns, dict(more or {})

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, target = fs.FileSystem.from_uri(path)
        part = f"{target}.part"
        files.create_dir(posixpath.dirname(target), recursive=True)
        n = 0
        with files.open_output_stream(part) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
            names = [sheet, *sheets]
            for name, text in _frame(names):
                book.writestr(name, text)
            with book.open("xl/worksheets/sheet1.xml", "w") as opened:
                page = io.TextIOWrapper(opened, "utf-8")
                page.write(_OPEN + '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><sheetData>')
                page.write(_row(1, heads))
                for batch in batches:
                    for values in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                        n += 1
                        page.write(_row(n + 1, values))
                page.write("</sheetData></worksheet>")
                page.flush()
                page.detach()
            for i, lines in enumerate(sheets.values(), 2):
                book.writestr(f"xl/worksheets/sheet{i}.xml", _OPEN + "<sheetData>" + "".join(_row(j, line) for j, line in enumerate(lines, 1)) + "</sheetData></worksheet>")
        files.move(part, target)
        yield pa.RecordBatch.from_pydict({"path": [path], "n": pa.array([n], pa.int64())})

    return rows.coalesce(1).mapInArrow(write, "path string, n long").first().path


_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_OPEN = f'{_HEAD}<worksheet xmlns="{MAIN[1:-1]}">'
_DOCUMENT = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _row(number: int, values: Sequence) -> str:
    cells = []
    for i, value in enumerate(values, 1):
        at = f"{column_name(i)}{number}"
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            cells.append(f'<c r="{at}"><v>{value}</v></c>')
        elif value is not None and value != "":
            plain = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(value))
            cells.append(f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(plain)}</t></is></c>')
    return f'<row r="{number}">{"".join(cells)}</row>'


def _frame(names: Sequence[str]) -> Iterator[tuple[str, str]]:
    """The parts that tie sheets to a workbook."""
    packages, kinds = "http://schemas.openxmlformats.org/package/2006", "application/vnd.openxmlformats-officedocument.spreadsheetml"
    numbers = range(1, len(names) + 1)
    override = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kinds}.worksheet+xml"/>' for i in numbers)
    yield "[Content_Types].xml", f'{_HEAD}<Types xmlns="{packages}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/>{override}</Types>'
    yield "_rels/.rels", f'{_HEAD}<Relationships xmlns="{packages}/relationships"><Relationship Id="r1" Type="{_DOCUMENT}/officeDocument" Target="xl/workbook.xml"/></Relationships>'
    sheets = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="r{i}"/>' for i, n in zip(numbers, names, strict=True))
    yield "xl/workbook.xml", f'{_HEAD}<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{_DOCUMENT}"><sheets>{sheets}</sheets></workbook>'
    links = "".join(f'<Relationship Id="r{i}" Type="{_DOCUMENT}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in numbers)
    yield "xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{packages}/relationships">{links}</Relationships>'
