import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from gridloom import documents
from gridloom.functions.number_formats import shown
from gridloom.operators import display
from gridloom.sources import legacy, pdf, xls, xlsx
from gridloom.sources.files import Window
from test_legacy import ole
from test_xlsx import MAIN, PARTS, write

# -- workbooks ----------------------------------------------------------------


def rec(kind, body=b""):
    return struct.pack("<HH", kind, len(body)) + body


def brief(text):
    return struct.pack("<BB", len(text), 0) + text.encode("latin-1")


def cell(row, column, style=15):
    return struct.pack("<HHH", row, column, style)


def formula(row, column, saved, tokens):
    return rec(6, cell(row, column) + saved + struct.pack("<HIH", 0, 0, len(tokens)) + tokens)


def binary_workbook(encrypted=False):
    strings = ["tide", "wind é", "x" * 40, "日本"]
    # the third text is cut by a record's end, and goes on in wide characters
    first = struct.pack("<II", 4, 4) + b"".join(struct.pack("<HB", len(s), 0) + s.encode("latin-1") for s in strings[:2]) + struct.pack("<HB", 40, 0) + b"x" * 25
    table = rec(0xFC, first) + rec(0x3C, b"\1" + ("x" * 15).encode("utf-16-le") + struct.pack("<HBH", 2, 1 | 8, 1) + "日本".encode("utf-16-le") + b"\0" * 4)
    number = struct.pack("<d", 2.5)
    own = rec(0x1AE, struct.pack("<HH", 2, 0x401)) + rec(0x17, struct.pack("<HHHH", 1, 0, 1, 1))
    name = rec(0x18, struct.pack("<HBBHHH4x", 0, 0, 4, 7, 0, 0) + b"\0Fees" + b"\x3a" + struct.pack("<HHH", 0, 0, 1))
    log = b"".join([
        rec(0x809, struct.pack("<HHHHII", 0x600, 0x10, 0, 0, 0, 0)), rec(0x200, struct.pack("<IIHHH", 0, 9, 0, 4, 0)), rec(0x55, struct.pack("<H", 12)), rec(0x225, struct.pack("<HH", 0, 300)),
        rec(0x7D, struct.pack("<6H", 1, 2, 20 * 256, 15, 1, 0)), rec(0x208, struct.pack("<8H", 3, 0, 4, 600, 0, 0, 0x60, 15)),
        rec(0xFD, cell(0, 0) + struct.pack("<I", 0)), rec(0xFD, cell(0, 1) + struct.pack("<I", 1)), rec(0xFD, cell(0, 2) + struct.pack("<I", 2)), rec(0xFD, cell(0, 3) + struct.pack("<I", 3)),
        rec(0x203, cell(1, 0) + struct.pack("<d", 1.25)), rec(0x27E, cell(1, 1) + struct.pack("<I", (1234 << 2) | 3)), rec(0xBD, struct.pack("<HHHIHIH", 1, 2, 15, (7 << 2) | 2, 15, 0x40590000, 3)),
        rec(0x205, cell(2, 0) + b"\1\0"), rec(0x205, cell(2, 1) + b"\x2a\1"), rec(0xBE, struct.pack("<HHHHH", 2, 2, 15, 15, 3)),
        # SUM($A$1:B2)*2+IF(TRUE,"a""b",-3%), a text, a family, another sheet, a name
        formula(3, 0, number, b"\x25" + struct.pack("<HHHH", 0, 1, 0, 0x4000 | 0x8000 | 1) + b"\x19\x10\0\0" + b"\x1e\2\0\x05" + b"\x1d\1\x17" + b"\3\0a\"b" + b"\x1e\3\0\x14\x13" + b"\x42\3\1\0" + b"\x03"),
        formula(4, 0, b"\0\0\0\0\0\0\xff\xff", b"\x17\2\0hi"), rec(0x207, struct.pack("<HB", 2, 0) + b"hi"),
        formula(5, 1, number, b"\1" + struct.pack("<HH", 5, 1)), rec(0x4BC, struct.pack("<HHBBBBH", 5, 6, 1, 1, 0, 2, 8) + b"\x4c" + struct.pack("<HH", 0, 0xC000 | 0xFF) + b"\x1e\1\0\x03"[:3] + b""), formula(6, 1, number, b"\1" + struct.pack("<HH", 5, 1)),
        formula(7, 0, b"\2\0\7\0\0\0\xff\xff", b"\x5a" + struct.pack("<HHH", 0, 0, 0xC001) + b"\x43" + struct.pack("<HH", 1, 0) + b"\x06"),
        formula(8, 0, b"\1\0\1\0\0\0\xff\xff", b"\x21\x63\0"),
        rec(0xE5, struct.pack("<H4H", 1, 0, 0, 1, 3)), rec(0x23E, struct.pack("<H", 0)), rec(0x0A),
    ])
    rates = rec(0x809, struct.pack("<HHHHII", 0x600, 0x10, 0, 0, 0, 0)) + rec(0x203, cell(0, 0) + struct.pack("<d", 4.0)) + rec(0x203, cell(0, 1) + struct.pack("<d", 5.0)) + rec(0x0A)
    start = rec(0x809, struct.pack("<HHHHII", 0x600, 5, 0, 0, 0, 0)) + (rec(0x2F, b"\0" * 4) if encrypted else b"")
    tail = rec(0x22, b"\1\0") + rec(0x41E, struct.pack("<H", 164) + struct.pack("<HB", 4, 0) + b"0.0%") + rec(0xE0, struct.pack("<HH", 0, 164) + b"\0" * 16) + own + name + table + rec(0x0A)
    sheets = lambda a, b: rec(0x85, struct.pack("<IBB", a, 0, 0) + brief("Log")) + rec(0x85, struct.pack("<IBB", b, 1, 0) + brief("Rates 2"))
    at = len(start) + len(sheets(0, 0)) + len(tail)
    return ole({"Workbook": start + sheets(at, at + len(log)) + tail + log + rates})


def opened(window=None):
    book = xls.Workbook(binary_workbook(), "b")
    book.window = window or Window()
    return book


def test_binary_workbook():
    by = {(r[1], r[2], r[3]): r for r in opened().table_cell()}
    assert [by[0, 0, c][6] for c in range(4)] == ["tide", "wind é", "x" * 40, "日本"]
    assert [by[0, 1, c][5] for c in range(4)] == [1.25, 12.34, 7.0, 100.0]
    assert by[0, 2, 0][7] is True and by[0, 2, 1][8] == "#N/A" and by[0, 2, 2][4] is None
    assert by[0, 3, 0][9] == 'SUM($A$1:B2)*2+IF(TRUE,"a""b",-3%)' and by[0, 3, 0][5] == 2.5
    assert by[0, 4, 0][6] == "hi" and by[0, 4, 0][9] == '"hi"'
    assert by[0, 7, 0][8] == "#DIV/0!" and by[0, 7, 0][9] == "'Rates 2'!B1/Fees"
    assert by[0, 8, 0][7] is True and by[0, 8, 0][9] == "" and by[1, 0, 1][5] == 5.0
    assert [r[1:] for r in opened().table_sheet()] == [(0, "Log", "visible"), (1, "Rates 2", "hidden")]
    assert list(opened().table_merge()) == [("b", 0, 0, 1, 0, 3)]
    assert list(opened().table_sheet_info())[0] == ("b", 0, 9, 4, 12.0, 15.0, False)
    assert list(opened().table_column()) == [("b", 0, 1, 2, 20.0, True, 15)] and list(opened().table_row()) == [("b", 0, 3, 30.0, True, None)]
    assert list(opened().table_defined_name()) == [("b", "Fees", "'Rates 2'!$B$1", None)]
    assert list(opened().table_num_fmt()) == [("b", 164, "0.0%")] and list(opened().table_xf()) == [("b", 0, 164)] and list(opened().table_workbook()) == [("b", True)]
    near = opened(Window((1, 2), (0, 1), [0], [(4, 0)]))
    assert [(r[2], r[3]) for r in near.table_cell()] == [(1, 0), (1, 1), (2, 0), (2, 1), (4, 0)]
    with pytest.raises(ValueError, match="encrypted"):
        list(xls.Workbook(binary_workbook(encrypted=True), "b").table_cell())
    with pytest.raises(ValueError):
        xls.Workbook(ole({"Workbook": b"\0" * 40}), "b")


# -- windows and guards -----------------------------------------------------------


def test_windows_reach_the_scan(spark, tmp_path):
    rows = "".join(f'<row r="{r}"><c r="A{r}" t="inlineStr"><is><t>{"y" * 900}</t></is></c><c r="B{r}"><v>{r}</v></c></row>' for r in range(1, 4001))
    sheet = f'<worksheet {MAIN}><dimension ref="A1:DX5001"/><sheetViews><sheetView showGridLines="0"/></sheetViews><sheetFormatPr defaultRowHeight="18"/><cols><col min="2" max="3" width="9.5" hidden="1"/></cols><sheetData>{rows}</sheetData>'
    write(tmp_path / "far.xlsx", PARTS | {"xl/worksheets/s1.xml": sheet + '<mergeCells><mergeCell ref="A1:B2"/></mergeCells></worksheet>'})
    data = (tmp_path / "far.xlsx").read_bytes()
    book = xlsx.Workbook(data, "far")
    book.window = Window((0, 3), (1, 1), [0])
    read = []
    scan = xlsx.scan

    def counted(stream, *rest):
        class Counted:
            def read(self, n):
                read.append(n)
                return stream.read(n)

        return scan(Counted(), *rest)

    xlsx.scan = counted
    try:
        assert [r[5] for r in book.table_cell()] == [1.0, 2.0, 3.0, 4.0]
        assert len(read) <= 2  # of over 60 pieces
        assert next(book.table_sheet_info()) == ("far", 0, 5001, 128, None, 18.0, False)
    finally:
        xlsx.scan = scan
    assert list(book.table_column()) == [("far", 0, 1, 2, 9.5, True, None)]
    got = documents.sheet_window(spark, str(tmp_path / "far.xlsx"), 0, (3998, 3999), (0, 1), anchors=[(0, 1)]).orderBy("row", "col").collect()
    assert [(r.row, r.col, r.num) for r in got if r.t == "n"] == [(0, 1, 1.0), (3998, 1, 3999.0), (3999, 1, 4000.0)] and len(got) == 5
    xlsx.register(spark)
    cells = spark.read.format("xlsx").option("path", str(tmp_path)).option("table", "cell").load()
    assert cells.where("sheet_ix = 0 and row >= 10 and row < 12 and col = 1").count() == 2
    tables = documents.sheet_info(spark, str(tmp_path / "far.xlsx"))
    assert [(r.name, r.rows, r.columns, r.grid_lines) for r in tables["sheet"].collect()] == [("Ledger", 5001, 128, False)]
    assert tables["merge"].count() == 1


def test_shared_formulas_begin_outside_the_window(spark, tmp_path):
    write(tmp_path / "b.xlsx", PARTS)
    (got,) = documents.sheet_window(spark, str(tmp_path / "b.xlsx"), 0, (1, 1), (4, 4)).collect()
    assert got.formula == "D2*2"


def test_guards(spark, tmp_path):
    late = f'<worksheet {MAIN}><!--{"c" * 6000}--></worksheet>'
    for text in (late.replace("<worksheet", '<!DOCTYPE w [<!ENTITY a "b">]><worksheet', 1), f'<!--{"c" * 9000}--><!DOCTYPE w>{late}', "<worksheet><c></worksheet>"):
        write(tmp_path / "x.xlsx", PARTS | {"xl/worksheets/s1.xml": text})
        with pytest.raises(ValueError):
            list(xlsx.Workbook((tmp_path / "x.xlsx").read_bytes(), "x").table_cell())
    write(tmp_path / "x.xlsx", PARTS | {"xl/worksheets/s1.xml": f'<worksheet {MAIN}><cols><col min="3" max="2"/></cols></worksheet>'})
    with pytest.raises(ValueError):
        list(xlsx.Workbook((tmp_path / "x.xlsx").read_bytes(), "x").table_column())
    write(tmp_path / "fine.xlsx", PARTS)
    path = str(tmp_path / "fine.xlsx")
    with pytest.raises(Exception, match="too large"):
        documents.load_document(spark, path, max_bytes=100).collect()
    (tmp_path / "empty.xlsx").write_bytes(b"")
    assert documents.load_document(spark, str(tmp_path / "empty.xlsx")).collect() == []
    xlsx.register(spark)
    with pytest.raises(Exception, match="empty"):
        spark.read.format("xlsx").option("path", str(tmp_path / "empty.xlsx")).load().collect()
    with pytest.raises(ValueError):
        documents.load_document(spark, str(tmp_path / "fine.odt"))
    assert documents.load_document(spark, path, table="sheet").count() == 2


def test_rich_runs_and_dates(tmp_path):
    parts = PARTS | {"xl/sharedStrings.xml": f'<sst {MAIN}><si><t>plain</t></si><si><r><rPr><b/><sz val="9"/><rFont val="Lato"/><color rgb="FF00AA00"/></rPr><t>bo</t></r><r><t>ld</t></r></si></sst>', "xl/workbook.xml": PARTS["xl/workbook.xml"].replace("<sheets>", '<workbookPr date1904="1"/><sheets>')}
    write(tmp_path / "r.xlsx", parts)
    book = xlsx.Workbook((tmp_path / "r.xlsx").read_bytes(), "r")
    runs = [r for r in book.table_rich_run() if r[4] is not None]
    assert [(r[4], r[5], r[6], r[7], r[11], r[12], r[14]) for r in runs] == [(1, 0, "bo", True, "Lato", 9.0, "FF00AA00"), (1, 1, "ld", None, None, None, None)]
    assert list(book.table_workbook()) == [("r", True)]


# -- what is shown -------------------------------------------------------------------

# Numbers as spreadsheets show them.
SHOWN = [
    ("0.00%", 0.25, "25.00%"), ("General", 42.0, "42"), ("General", 0.1 + 0.2, "0.3"), ("General", 12345678901.5, "12345678902"), ("General", 1e-7, "1E-07"), ("General", 1234567890123.0, "1.23457E+12"), ("0", 2.5, "3"), ("0", -2.5, "-3"), ("0.0", -0.04, "0.0"),
    ("#,##0", 1234567.0, "1,234,567"), ("#,##0.00", -1234.5, "-1,234.50"), ("#,##0;(#,##0)", -1234.0, "(1,234)"), ('0.0,,"M"', 12_345_678.0, "12.3M"), ("00000", 42.0, "00042"), ("#.##", 0.5, ".5"), ("0.0##", 1.5, "1.5"), ("0.00E+00", 12345.0, "1.23E+04"), ("##0.0E+0", 12345.0, "12.3E+3"),
    ("0;-0;\"none\"", 0.0, "none"), ("[>=100]\"big\";\"small\"", 99.0, "small"), ("[Red]0.0;[Blue]-0.0", -1.0, "-1.0"), ("# ?/?", 1.5, "1 1/2"), ("# ??/??", 0.333, "1/3"), ("?/8", 0.25, "2/8"), ('"a"0"b"', 5.0, "a5b"), ("0\\x", 5.0, "5x"), ("$#,##0.00", 3.0, "$3.00"), ("[$€-407]0", 3.0, "€3"),
    ("yyyy-mm-dd", 45658.0, "2025-01-01"), ("d mmm yy", 45658.0, "1 Jan 25"), ("dddd", 45658.0, "Wednesday"), ("mmmm", 45658.0, "January"), ("h:mm AM/PM", 0.75, "6:00 PM"), ("hh:mm:ss", 0.5 + 1 / 86400, "12:00:01"), ("[h]:mm", 1.5, "36:00"), ("mm:ss.0", 0.000_1, "00:08.6"), ("m/d/yyyy", 60.0, "2/29/1900"), ("m/d/yyyy", 1.0, "1/1/1900"), ("yyyy", -1.0, "########"), (";;;", 5.0, ""),
]


@pytest.mark.parametrize("code,value,want", SHOWN)
def test_number_formats(code, value, want):
    assert shown(code, value) == want


def test_texts_and_the_other_calendar():
    assert shown('"<"@">"', "a") == "<a>" and shown("0.0", "a") == "a" and shown("0", True) == "TRUE" and shown(None, 1.5) == "1.5"
    assert shown("yyyy-mm-dd", 0.0, True) == "1904-01-01" and shown("dddd", 0.0, True) == "Friday"


def test_displayed(spark):
    rows = [("n", 0.5, None, None, None, "0%", None), ("n", 5.0, None, None, None, None, "left"), ("b", None, None, True, None, None, None), ("s", None, "é", None, None, "0", None), ("e", None, None, None, "#N/A", None, None), (None, None, None, None, None, None, None)]
    out = display.displayed(spark.createDataFrame(rows, "t string, num double, str string, bool boolean, err string, number_format string, align string")).select("text", "align").collect()
    assert [tuple(r) for r in out] == [("50%", "right"), ("5", "left"), ("TRUE", None), ("é", None), ("#N/A", None), ("", "right")]


def test_pages_and_anchors(spark):
    info = spark.createDataFrame([(0, 120), (1, 50)], "sheet_ix int, rows int")
    rows = spark.createDataFrame([(0, 3, 30.0), (0, 60, 15.0), (0, 4, 90.0)], "sheet_ix int, row int, points double")
    hidden = spark.createDataFrame([(0, 4), (0, 61)], "sheet_ix int, row int")
    got = display.page_heights(rows, display.pages_of(info), hidden).orderBy("sheet_ix", "page").collect()
    assert [tuple(r) for r in got] == [(0, 0, 100 + 50 * 20 + 20 - 20), (0, 1, 1100 - 20), (0, 2, 500), (1, 0, 1100)]
    assert display.shown_windows(display.pages_of(info), 2).count() == 3
    cells = spark.createDataFrame([(0, r, c, 1, 1) for r in (1, 2, 3) for c in (1, 2)] + [(0, 0, 0, None, None)], "sheet_ix int, row int, col int, r0 int, c0 int")
    out = display.shown_anchor(cells, spark.createDataFrame([(0, 1)], "sheet_ix int, row int"), spark.createDataFrame([(0, 9)], "sheet_ix int, col int"))
    assert sorted((r.row, r.col) for r in out.where("is_anchor").collect()) == [(0, 0), (2, 1)]
    sheets = spark.createDataFrame([("a", "visible"), ("b", "hidden"), ("c", "veryHidden"), ("d", None)], "name string, state string")
    assert [r.name for r in display.visible_sheets(sheets).collect()] == ["a", "d"]


# -- word-processing files ------------------------------------------------------------


def test_text_of_word_files(spark, tmp_path):
    text, wide = b"One \x13 HYPERLINK x \x14link\x15.\rTwo\x07", "Thrée\x0bline\r"
    head = bytearray(1024)
    struct.pack_into("<HH", head, 0, 0xA5EC, 193)
    struct.pack_into("<H", head, 32, 14)
    struct.pack_into("<H", head, 62, 22)
    struct.pack_into("<3i", head, 64 + 12, len(text) + len(wide), 4, 0)
    struct.pack_into("<H", head, 152, 93)
    clx = b"\1" + struct.pack("<H", 2) + b"\0\0" + b"\2" + struct.pack("<I", 4 * 4 + 3 * 8) + struct.pack("<4I", 0, len(text), len(text) + len(wide), len(text) + len(wide) + 4)
    notes = b"Foot"
    for place in (0x40000000 | 2 * 1024, 1024 + len(text), 0x40000000 | 2 * (1024 + len(text) + 2 * len(wide))):
        clx += struct.pack("<HIH", 0, place, 0)
    struct.pack_into("<II", head, 154 + 33 * 8, 8, len(clx))
    data = ole({"WordDocument": bytes(head) + text + wide.encode("utf-16-le") + notes, "0Table": b"\0" * 8 + clx})
    want = [("main", 0, "One link."), ("main", 1, "Two"), ("main", 2, "Thrée\nline"), ("footnotes", 0, "Foot")]
    assert [r[1:] for r in legacy.WordFile(data, "w").table_text()] == want
    (tmp_path / "w.doc").write_bytes(data)
    assert [tuple(r)[1:] for r in documents.load_document(spark, str(tmp_path)+"/w.doc").collect()] == want
    with pytest.raises(ValueError):
        list(legacy.WordFile(ole({"WordDocument": bytes(head), "0Table": b"\0" * 8 + clx}), "w").table_text())


# -- PDF --------------------------------------------------------------------------------


def portable(objects: dict[int, bytes], packed: dict[int, bytes] | None = None, trailer=b"<</Root 1 0 R>>"):
    out = b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in objects.items())
    if packed:
        body, index = b"", b""
        for n, x in packed.items():
            index += b"%d %d " % (n, len(body))
            body += x + b" "
        data = zlib.compress(index + body)
        out += b"90 0 obj\n<</Type/ObjStm/N %d/First %d/Filter/FlateDecode/Length %d>>stream\r\n%s\nendstream\nendobj\n" % (len(packed), len(index), len(data), data)
    return out + b"trailer\n" + trailer + b"\n%%EOF"


def stream(data, more=b""):
    return b"<<%s/Length %d>>\nstream\n%s\nendstream" % (more, len(data), data)


def test_pdf(spark, tmp_path):
    cmap = b"1 begincodespacerange <0000><ffff> endcodespacerange 2 beginbfchar <0001><65E5> <0002><0041> endbfchar 1 beginbfrange <0010><0012><0061> endbfrange"
    drawn = b"q 2 0 0 2 10 20 cm BT /F1 6 Tf 1 0 0 1 5 5 Tm (Hi \\(there\\)\\041) Tj 0 -7 Td [(A) -300 (B) 5 (C)] TJ ET Q BT /F2 12 Tf 100 700 Td <000100020010> Tj T* <0011> ' ET /X Do"
    objects = {
        1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[3 0 R 4 0 R 2 0 R]/MediaBox[0 0 300 400]/Resources<</Font<</F1 6 0 R/F2 7 0 R>>/XObject<</X 11 0 R>>>>>>",
        3: b"<</Type/Page/Parent 2 0 R/Contents[5 0 R]>>", 5: stream(zlib.compress(drawn), b"/Filter/FlateDecode"), 6: b"<</Type/Font/Subtype/Type1/Encoding<</Differences[65/fi/Adieresis/uni20AC]>>>>",
        7: b"<</Type/Font/Subtype/Type0/ToUnicode 8 0 R>>", 8: stream(cmap), 11: stream(b"BT /F1 1 Tf (in) Tj ET", b"/Subtype/Form/Matrix[1 0 0 1 7 8]"),
    }
    data = portable(objects, {4: b"<</Type/Page/Rotate 90/MediaBox[0 0 10 20]/Contents 9 0 R>>"})
    document = pdf.Document(data, "p")
    assert list(document.table_page()) == [("p", 0, 300.0, 400.0, 0), ("p", 1, 20.0, 10.0, 90)]
    got = [(r[3], r[4], r[5], r[6]) for r in document.table_text()]
    assert got == [("Hi (there)!", 20.0, 30.0, 12.0), ("fi Ä€", 20.0, 16.0, 12.0), ("日Aa", 100.0, 700.0, 12.0), ("b", 100.0, 700.0, 12.0), ("in", 7.0, 8.0, 1.0)]
    with pytest.raises(ValueError, match="encrypted"):
        list(pdf.Document(portable(objects, trailer=b"<</Root 1 0 R/Encrypt 9 0 R>>"), "p").table_page())
    with pytest.raises(ValueError):
        pdf.Document(b"nothing", "p")
    assert list(pdf.Document(b"%PDF-1.4 junk 1 0 obj << /Kids [", "p").table_page()) == []
    for cut in range(0, len(data), 37):  # damaged files end or fail, and do not hang
        try:
            list(pdf.Document(b"%PDF-" + data[cut:] if cut else data[: len(data) // 2], "p").table_text())
        except ValueError:
            pass
    (tmp_path / "a.pdf").write_bytes(data)
    assert documents.load_document(spark, str(tmp_path / "a.pdf"), table="page").count() == 2


def test_predictors():
    rows = [bytes([0, 1, 2, 3]), bytes([1, 1, 1, 1]), bytes([2, 1, 1, 1]), bytes([4, 1, 0, 0])]
    assert pdf.unpredicted(b"".join(rows), {"Predictor": 15, "Columns": 3}) == bytes([1, 2, 3, 1, 2, 3, 2, 3, 4, 3, 3, 4])


def test_formats_by_short_names(spark, tmp_path):
    for module in (xls, pdf):
        module.register(spark)
    (tmp_path / "b.xls").write_bytes(binary_workbook())
    assert spark.read.format("xls").option("path", str(tmp_path)).option("rows", "1:1").load().where(F.col("t") == "n").count() == 4
    assert documents.sheet_window(spark, str(tmp_path / "b.xls"), 1, (0, 0), (0, 5)).count() == 2
    assert zipfile and documents.format_of("/a/b.PDF") == "pdf"
