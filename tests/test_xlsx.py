import zipfile

import pytest

from gridloom.operators import safety, windowing
from gridloom.plans.evaluate import evaluate_cells
from gridloom.plans.sheets import Sheets
from gridloom.sources import xlsx

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
PARTS = {
    "xl/workbook.xml": f'<workbook {MAIN}><sheets><sheet name="Ledger" sheetId="1" r:id="a"/><sheet name="Rates" sheetId="2" state="veryHidden" r:id="b"/></sheets><definedNames><definedName name="Fee" localSheetId="0">Rates!$A$1</definedName></definedNames></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="p"><Relationship Id="a" Target="worksheets/s1.xml"/><Relationship Id="b" Target="/xl/worksheets/s2.xml"/><Relationship Id="c" TargetMode="External" Target="../x"/></Relationships>',
    "xl/sharedStrings.xml": f"<sst {MAIN}><si><t>one</t></si><si><r><t>tw</t></r><r><t>o</t></r><rPh><t>no</t></rPh></si></sst>",
    "xl/worksheets/s1.xml": f'<worksheet {MAIN}><sheetData><row r="1"><c r="A1"><f>SUM(Rates!A1,2.5)</f></c><c t="s"><v>1</v></c><c t="inlineStr"><is><t>in</t></is></c><c r="D1"><v>10</v></c><c r="E1"><f t="shared" si="0" ref="E1:E2">D1*2</f></c></row><row><c r="D2"><v>20</v></c><c><f t="shared" si="0"/></c><c t="b"><v>1</v></c><c t="e"><v>#N/A</v></c><c><f>Fee&amp;"!"</f></c></row></sheetData><mergeCells><mergeCell ref="A3:C3"/></mergeCells></worksheet>',
    "xl/worksheets/s2.xml": f'<worksheet {MAIN}><sheetData><row r="1"><c r="A1"><v>7</v></c></row></sheetData></worksheet>',
}


def write(path, parts):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)


def read(spark, path, table):
    return spark.read.format("xlsx").option("path", str(path)).option("table", table).load()


def test_workbook(spark, tmp_path):
    xlsx.register(spark)
    write(tmp_path / "book.xlsx", PARTS)
    cells = windowing.with_shared_formulas(windowing.with_shared_strings(read(spark, tmp_path, "cell"), read(spark, tmp_path, "shared_string")))
    by = {(r.sheet_ix, r.row, r.col): r for r in cells.collect()}
    assert by[0, 0, 1].str == "two" and by[0, 0, 2].str == "in" and by[0, 1, 5].bool is True and by[0, 1, 6].err == "#N/A"
    assert by[0, 1, 4].formula == "D2*2" and by[1, 0, 0].num == 7
    sheets, names = read(spark, tmp_path, "sheet"), read(spark, tmp_path, "defined_name")
    got = {(r.row, r.col): r for r in evaluate_cells(cells, sheets, names).collect()}
    assert got[0, 0].num == 9.5 and got[0, 4].num == 20 and got[1, 4].num == 40 and got[1, 7].str == "7!"
    assert [tuple(r)[2:] for r in read(spark, tmp_path, "merge").collect()] == [(2, 0, 2, 2)]
    assert [r.name for r in sheets.where("state = 'visible'").collect()] == ["Ledger"]


def test_chain_of_formulas(spark):
    rows = [("w", 0, 0, 0, "n", 1.0, None)] + [("w", 0, r, 0, None, None, f"A{r}+1") for r in range(1, 1000)] + [("w", 0, 0, 1, None, None, "A1000"), ("w", 0, 0, 2, None, None, "C1")]
    cells = spark.createDataFrame([(*r[:6], None, None, None, r[6]) for r in rows], "workbook_id string, sheet_ix int, row int, col int, t string, num double, str string, bool boolean, err string, formula string")
    sheets, names = spark.createDataFrame([("w", 0, "S")], "workbook_id string, sheet_ix int, name string"), spark.createDataFrame([], "workbook_id string, name string, value string, sheet_ix int")
    got = {(r.row, r.col): r for r in evaluate_cells(cells, sheets, names).collect()}
    assert got[999, 0].num == 1000 and got[99, 0].num == 100
    # met first, and deeper than an evaluation may go; refers to itself
    assert got[0, 1].err == "#NUM!" and got[0, 2].err == "#REF!"


def test_unsafe_archives(tmp_path):
    write(tmp_path / "bad.xlsx", PARTS | {"xl/_rels/workbook.xml.rels": '<Relationships xmlns="p"><Relationship Id="a" Target="../bad.xml"/></Relationships>'})
    with pytest.raises(ValueError):
        xlsx.Workbook((tmp_path / "bad.xlsx").read_bytes(), "bad")
    data = bytearray((tmp_path / "bad.xlsx").read_bytes())
    at = data.rfind(b"PK\x01\x02")
    data[at + 24 : at + 28] = (0x7FFFFFFF).to_bytes(4, "little")
    with pytest.raises(ValueError, match="too large"):
        safety.zip_directory(bytes(data))


def test_html():
    got = safety.inert_html('<p onclick="x">a<script>b</script><img src=x><a href=" JavaScript:1" id=q>&amp;</a><base><iframe>z</iframe>t</p>')
    assert got == '<p>a<img src="x" loading="lazy"><a id="q">&amp;</a>t</p>'


def test_urls(spark):
    from pyspark.sql import functions as F

    rows = [("/a/Plan.PPTX?v=2#p", "pptx", True), ("/notes.docm", None, True), ("data:text/html,x", None, False), ("//cdn.example/x.doc", None, False), ("https://me:pw@docs.example/x.xls", None, False), ("https://docs.example/\tx.ppt", None, False), ("http://docs.example/x.doc", "doc", False), ("https://docs.example/y/x.Xls", "xls", True)]
    out = spark.createDataFrame(rows, "u string, f string, s boolean").select("u", "f", "s", safety.document_format(F.col("u")).alias("g"), safety.safe_url(F.col("u")).alias("t")).collect()
    for r in out:
        assert r.t == r.s, r
        if r.s:
            assert r.g == r.f, r


def test_compiled_blanks_and_errors(spark):
    df = spark.createDataFrame([(1.0, "5", True), (None, None, None), (0.0, "x", False)], "a double, b string, c boolean")
    out = Sheets({"t": df}).rows("t", [], eq='A2=""', lt="A2<5", cross='"5">3', strict="B2=5", add="B2+1", text="A2&C2", div="1/A2", guard='IFERROR(1/A2,"none")').collect()
    assert [r.eq for r in out] == [False, True, False] and [r.lt for r in out] == [True, True, True]
    assert out[0].cross is True and out[0].strict is False
    assert out[0].add == 6 and out[1].add == 1 and out[2].add is None and out[2].add_error == "#VALUE!"
    assert [r.text for r in out] == ["1TRUE", "", "0FALSE"]
    assert [r.div_error for r in out] == [None, "#DIV/0!", "#DIV/0!"] and [r.guard for r in out] == ["1", "none", "none"]
    sheet = Sheets({"t": df}, {"t": ["a"]})
    totals = {x: tuple(sheet.total(x).first()) for x in ("SUM(t!A2:A9)", "COUNT(t!A2:A9,\"7\")", "COUNTA(t!B2:B9)", "PRODUCT(t!B2:B9)", "AND(t!C2:C9)", "OR(t!B2:B9)", "AVERAGE(t!B2:B9)", 'COUNTIF(t!A2:A9,"=0")', 'COUNTIF(t!B2:B9,">3")')}
    assert list(totals.values()) == [(1.0, None), (3.0, None), (2.0, None), (0.0, None), (False, None), (None, "#VALUE!"), (None, "#DIV/0!"), (2.0, None), (1.0, None)]
