"""Workbooks written and read again, and those of other writers."""

import zipfile

from groma.sources import sheets


def test_a_workbook_comes_back(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", 5, 2.5, None), ("a & <b>\n ", 6, None, "ü"), ("", 7, 0.5, "last")], "a string, b int, `c ü` double, d string").coalesce(1)
    path = sheets.write_workbook(df, f"file://{tmp_path}/out/report.xlsx", sheet="Events & more", more={"Period": [["from", "1"], ["to", "2"]]})
    got = {(r.sheet, r.row, r.col): r.value for r in sheets.sheet_cells(spark, f"{tmp_path}/out").collect()}
    assert path.endswith("report.xlsx") and [p.name for p in (tmp_path / "out").iterdir()] == ["report.xlsx"]
    e = "Events & more"
    assert got == {
        (e, 1, 1): "a", (e, 1, 2): "b", (e, 1, 3): "c ü", (e, 1, 4): "d", (e, 2, 1): "=1+1", (e, 2, 2): "5", (e, 2, 3): "2.5", (e, 3, 1): "a & <b>\n ", (e, 3, 2): "6", (e, 3, 4): "ü", (e, 4, 2): "7", (e, 4, 3): "0.5", (e, 4, 4): "last",
        ("Period", 1, 1): "from", ("Period", 1, 2): "1", ("Period", 2, 1): "to", ("Period", 2, 2): "2",
    }
    assert sheets.column_name(702) == "ZZ" and all(sheets.column_number(sheets.column_name(i)) == i for i in range(1, 2000, 7))


def test_shared_texts_gaps_and_damaged_books(spark, tmp_path):
    main = sheets.MAIN[1:-1]
    with zipfile.ZipFile(tmp_path / "other.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{sheets._DOCUMENT}"><sheets><sheet name="S" sheetId="1" r:id="x"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><Relationship Id="x" Target="/xl/worksheets/s.xml"/></R>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>code</t></si><si><r><t>dig</t></r><r><t>ger</t></r></si><si><t>˅</t></si></sst>')
        z.writestr(
            "xl/worksheets/s.xml",
            f'<worksheet xmlns="{main}"><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c><c r="D2" t="inlineStr"><is><t>crane</t></is></c></row>'
            '<row r="4"><c r="A4"><v>1.10</v></c><c r="C4" t="s"><v>2</v></c><c r="D4"/></row><row><c><v>2</v></c><c/><c t="str"><v>?</v></c><c t="s"><v>2</v></c></row></sheetData></worksheet>',
        )
    (tmp_path / "damaged.xlsx").write_bytes(b"PK nothing")
    cells = sheets.sheet_cells(spark, str(tmp_path))
    found = cells.collect()
    assert {(r.row, r.col): r.value for r in found if not r.error} == {(2, 1): "code", (2, 3): "digger", (2, 4): "crane", (4, 1): "1.10", (4, 3): "˅", (5, 1): "2", (5, 3): "?", (5, 4): "˅"}
    assert [r.path.rsplit("/", 1)[1] for r in found if r.error] == ["damaged.xlsx"]
    got = sheets.applicability(cells, head_row=2, first_col=3, marks=["˅"], keys={"code": 1}).collect()
    assert {(r.code, r.heading, r.unknown) for r in got} == {("1.10", "digger", None), ("2", "digger", "?"), ("2", "crane", None)}
