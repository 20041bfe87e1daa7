import pytest
from pyspark.sql import functions as F

from gridloom.operators import styles
from gridloom.sources import xlsx
from tests.test_xlsx import MAIN, PARTS, read, write

STYLES = f"""<styleSheet {MAIN}><numFmts><numFmt numFmtId="164" formatCode="0.0000"/></numFmts>
<fonts><font><sz val="11"/><name val="Calibri"/></font><font><b/><i val="0"/><u/><color theme="4" tint="0.4"/></font></fonts>
<fills><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FF204060" tint="-0.5"/></patternFill></fill></fills>
<borders><border/><border><left style="thin"><color indexed="10"/></left><top style="double"/></border></borders>
<cellStyleXfs><xf fontId="1"><alignment horizontal="center" indent="900"/></xf></cellStyleXfs>
<cellXfs><xf/><xf xfId="0" fillId="1" borderId="1" numFmtId="10"><alignment vertical="center" wrapText="1"/></xf><xf xfId="0" fontId="0" numFmtId="164"/></cellXfs></styleSheet>"""
THEME = '<a:theme xmlns:a="a"><a:clrScheme><a:lt1><a:sysClr lastClr="FFFFFF"/></a:lt1><a:accent1><a:srgbClr val="4472C4"/></a:accent1></a:clrScheme></a:theme>'


def test_resolved_styles(spark, tmp_path):
    xlsx.register(spark)
    write(tmp_path / "book.xlsx", PARTS | {"xl/styles.xml": STYLES, "xl/theme/theme1.xml": THEME})
    tables = [read(spark, tmp_path, x) for x in ("xf", "base_xf", "font", "fill", "border", "num_fmt", "theme_color")]
    got = {r.style_ix: r for r in styles.resolved(*tables).collect()}
    assert got[0].font == "Calibri" and got[0].size == 11 and got[0].number_format == "General" and got[0].borders is None
    one = got[1]
    assert (one.bold, one.italic, one.underline, one.align, one.vertical, one.wrap, one.indent) == (True, False, "single", "center", "middle", True, 250)
    assert one.background == "#102030" and one.color == "#8faadc" and one.number_format == "0.00%"
    assert {k: tuple(v) for k, v in one.borders.items()} == {"left": ("thin", "#ff0000"), "top": ("double", "#000000")}
    assert got[2].bold is None and got[2].number_format == "0.0000"


def hls_tint(color: str, tint: float) -> str:
    import colorsys

    h, light, s = colorsys.rgb_to_hls(*(int(color[i : i + 2], 16) / 255 for i in (1, 3, 5)))
    light = light * (1 + tint) if tint < 0 else light * (1 - tint) + tint
    return "#" + "".join(f"{int(x * 255 + 0.5):02x}" for x in colorsys.hls_to_rgb(h, light, s))


def test_tints_agree_with_the_colour_model(spark):
    cases = [(f"#{r:02x}{g:02x}{b:02x}", t) for r in (0, 77, 255) for g in (0, 130, 254) for b in (1, 200, 255) for t in (-0.9, -0.25, 0.35, 1.0)]
    rows = spark.createDataFrame(cases, "c string, t double").select("c", "t", styles.tinted(F.col("c"), F.col("t")).alias("x")).collect()
    near = lambda a, b: max(abs(int(a[i : i + 2], 16) - int(b[i : i + 2], 16)) for i in (1, 3, 5)) <= 1
    assert len(rows) == len(cases) and all(near(r.x, hls_tint(r.c, r.t)) for r in rows)


@pytest.mark.parametrize("code,value,text", [("0.00%", 0.25, "25.00%"), ("0", 2.5, "3"), ("0.00", -1.005, "-1.01"), ("#,##0", 1234567.0, "1,234,567"), ("General", 42.0, "42"), ("General", 0.5, "0.5"), ("m/d/yy", 1.0, None)])
def test_number_formats(spark, code, value, text):
    assert spark.range(1).select(styles.formatted(F.lit(value), code)).first()[0] == text


def test_geometry_and_texts(spark, tmp_path):
    xlsx.register(spark)
    sheet = PARTS["xl/worksheets/s2.xml"].replace("<sheetData>", '<cols><col min="1" max="3" width="9.140625" hidden="1" style="2"/></cols><sheetData><row r="3" ht="15" s="4" customFormat="1" hidden="1"/><row r="4" s="4"/>')
    write(tmp_path / "book.xlsx", PARTS | {"xl/worksheets/s2.xml": sheet})
    column = read(spark, tmp_path, "column").withColumn("px", styles.column_pixels(F.col("chars"))).first()
    assert (column.first, column.last, column.hidden, column.style_ix, column.px) == (0, 2, True, 2, 64)
    row = read(spark, tmp_path, "row").withColumn("px", styles.point_pixels(F.col("points"))).collect()
    assert [(r.row, r.hidden, r.style_ix, r.px) for r in row] == [(2, True, 4, 20.0)]
    write(tmp_path / "a.docx", {"word/document.xml": '<w:document xmlns:w="w"><w:body><w:p><w:pPr><w:tabs><w:tab/></w:tabs></w:pPr><w:r><w:t>one</w:t><w:tab/><w:t>two</w:t></w:r><w:del><w:r><w:t>gone</w:t></w:r></w:del></w:p><w:p/></w:body></w:document>', "word/header1.xml": '<w:hdr xmlns:w="w"><w:p><w:r><w:t>top</w:t></w:r></w:p></w:hdr>'})
    got = spark.read.format("docx").option("path", str(tmp_path)).load().collect()
    assert [tuple(r) for r in got] == [("a.docx", "word/document.xml", 0, "one\ttwo"), ("a.docx", "word/document.xml", 1, ""), ("a.docx", "word/header1.xml", 0, "top")]
    slide = lambda t: f'<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:sld>'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    write(tmp_path / "a.pptx", {"ppt/presentation.xml": f'<p:presentation xmlns:p="p" {rel}><p:sldIdLst><p:sldId r:id="b"/><p:sldId r:id="a"/></p:sldIdLst></p:presentation>', "ppt/_rels/presentation.xml.rels": '<Relationships><Relationship Id="a" Target="slides/slide1.xml"/><Relationship Id="b" Target="slides/slide2.xml"/></Relationships>', "ppt/slides/slide1.xml": slide("first file"), "ppt/slides/slide2.xml": slide("shown first")})
    got = spark.read.format("pptx").option("path", str(tmp_path)).load().orderBy("slide_ix").collect()
    assert [r.text for r in got] == ["shown first", "first file"]


def test_fonts_and_pictures_by_number(spark):
    from gridloom.operators import slides

    runs = spark.createDataFrame([("d", 0, 1), ("d", 1, 9), ("e", 0, 1)], "doc_id string, start int, font int")
    fonts = spark.createDataFrame([("d", 1, "Lato"), ("e", 1, "Inter")], "doc_id string, ix int, name string")
    assert sorted((r.doc_id, r.start, r.font_name) for r in slides.with_fonts(runs, fonts).collect()) == [("d", 0, "Lato"), ("d", 1, None), ("e", 0, "Inter")]
    pictures = spark.createDataFrame([("d", 1, "image/png", b"p"), ("d", 2, None, None), ("d", 3, "image/png", b"p"), ("d", 4, "image/jpeg", b"p")], "doc_id string, ix int, mime string, bytes binary")
    shapes = spark.createDataFrame([("d", i, i) for i in range(1, 6)], "doc_id string, shape_ix int, image int")
    assert sorted((r.shape_ix, r.picture_ix or 0) for r in slides.with_pictures(shapes, pictures).collect()) == [(1, 1), (2, 0), (3, 1), (4, 4), (5, 0)]
    texts = spark.createDataFrame([("d", 0, 1, 2, "a")] * 2 + [("d", 0, 1, 3, "a")], "doc_id string, slide_ix int, shape_ix int, text_ix int, text string")
    assert slides.distinct_texts(texts).count() == 2
