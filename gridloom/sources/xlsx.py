"""XLSX workbooks as tables: ``spark.read.format("xlsx").option("path", ...).option("table", "cell")``.

Tables: cell, sheet, sheet_info, rich_run, merge, defined_name, shared_string, column, row, and those of styles: xf,
base_xf, font, fill, border, num_fmt, theme_color. ``gridloom.operators.styles`` joins these.
Texts of DOCX and PPTX files are read by ``format("docx")`` and ``format("pptx")``. Each file is one partition; parts are
read as streams of elements and rows leave as they are found. External relationships are
dropped, archives over budget or with unsafe names are refused. Bounds on rows, columns and sheets
(options, or filters that Spark pushes down) reach the scan, which ends after the last row they need. ``gridloom.documents`` reads the
same tables through Spark's file system.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource

from gridloom.functions.cells import COLUMNS, ROWS, address
from gridloom.operators.safety import zip_directory
from gridloom.sources.files import FileReader, Window
from gridloom.sources.markup import scan

_COLOR = "rgb string, theme int, indexed int, tint double"
_XF = "font_ix int, fill_ix int, border_ix int, num_fmt_id int, horizontal string, vertical string, wrap string, shrink string, indent string, rotation string"
SCHEMAS = {
    "cell": "workbook_id string, sheet_ix int, row int, col int, t string, num double, str string, bool boolean, err string, formula string, shared_ix int, si string, style_ix int",
    "sheet": "workbook_id string, sheet_ix int, name string, state string",
    "sheet_info": "workbook_id string, sheet_ix int, rows int, columns int, default_chars double, default_points double, grid_lines boolean",
    "rich_run": f"workbook_id string, sheet_ix int, row int, col int, shared_ix int, run int, text string, bold boolean, italic boolean, strike boolean, underline string, font string, size double, script string, {_COLOR}",
    "workbook": "workbook_id string, date1904 boolean",
    "merge": "workbook_id string, sheet_ix int, r0 int, c0 int, r1 int, c1 int",
    "defined_name": "workbook_id string, name string, value string, sheet_ix int",
    "shared_string": "workbook_id string, ix int, text string",
    "column": "workbook_id string, sheet_ix int, first int, last int, chars double, hidden boolean, style_ix int",
    "row": "workbook_id string, sheet_ix int, row int, points double, hidden boolean, style_ix int",
    "xf": f"workbook_id string, style_ix int, base_ix int, {_XF}",
    "base_xf": f"workbook_id string, base_ix int, {_XF}",
    "font": f"workbook_id string, ix int, bold boolean, italic boolean, strike boolean, underline string, font string, size double, script string, {_COLOR}",
    "fill": f"workbook_id string, ix int, solid boolean, {_COLOR}",
    "border": f"workbook_id string, ix int, side string, line string, {_COLOR}",
    "num_fmt": "workbook_id string, num_fmt_id int, code string",
    "theme_color": "workbook_id string, theme int, color string",
}
TEXTS = {"docx": "doc_id string, part string, paragraph_ix int, text string", "pptx": "doc_id string, slide_ix int, paragraph_ix int, text string"}
MAX_MERGES, MAX_HEIGHT = 100_000, 10_000
# Names of theme colours by index; words for false; known alignments.
THEME = ("lt1", "dk1", "lt2", "dk2", "accent1", "accent2", "accent3", "accent4", "accent5", "accent6", "hlink", "folHlink")
FALSE, ALIGNS, VERTICALS = ("0", "false", "off"), ("left", "right", "center", "justify"), {"top": "top", "center": "middle", "bottom": "bottom"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _tag(element) -> str:
    return element.tag.rpartition("}")[2]


def _number(text: str | None, kind=int):
    try:
        return None if text is None else kind(text)
    except ValueError:
        return None


def _child(element, *path: str):
    """The first descendant by the names of its ancestors below ``element``."""
    for name in path:
        element = None if element is None else next((x for x in element if _tag(x) == name), None)
    return element


def _flag(element) -> bool | None:
    return None if element is None else element.get("val") not in FALSE


def _value(element) -> str | None:
    return None if element is None else element.get("val")


def _color(element) -> tuple:
    if element is None:
        return None, None, None, None
    return element.get("rgb"), _number(element.get("theme")), _number(element.get("indexed")), _number(element.get("tint"), float)


class Archive:
    def __init__(self, data: bytes, name: str):
        names = [n for n, _ in zip_directory(data, streaming=True)]
        if len(set(names)) < len(names) or any(".." in n.split("/") for n in names):
            raise ValueError("the archive names entries twice or outside itself")
        self.id, self.zip, self.names, self.window = name, zipfile.ZipFile(io.BytesIO(data)), set(names), Window()

    def links(self, folder: str, part: str) -> dict[str, str]:
        """Parts by relationship; external ones are dropped."""
        out = {}
        for element in self.elements(f"{folder}/_rels/{part}.rels", "Relationship"):
            if element.get("TargetMode") == "External":
                continue
            target = element.get("Target", "")
            if ".." in target.split("/"):
                raise ValueError("a relationship leaves the archive")
            out[element.get("Id")] = target.lstrip("/") if target.startswith("/") else f"{folder}/{target}"
        return out

    def events(self, part: str, wanted: set[str], opened: tuple[str, ...] = ()) -> Iterator:
        if part in self.names:
            with self.zip.open(part) as stream:
                yield from scan(stream, wanted, frozenset(opened))

    def elements(self, part: str, *tags: str) -> Iterator:
        """Elements of these names as they end; nothing else is kept."""
        for _, element in self.events(part, set(tags)):
            yield element

    def text(self, element) -> str:
        out = []
        for part in element:
            if _tag(part) == "t":
                out.append(part.text or "")
            elif _tag(part) != "rPh":
                out.append(self.text(part))
        return "".join(out)

    def paragraphs(self, part: str) -> Iterator[str]:
        """Texts of paragraphs, with tabs and breaks; deleted text and field codes are left out."""
        for element in self.elements(part, "p"):
            marks = {"tab": "\t", "br": "\n", "cr": "\n"}
            yield "".join((x.text or "") if _tag(x) == "t" else marks.get(_tag(x), "") for x in _flat(element))


def _flat(element) -> Iterator:
    """Descendants in order; paragraphs inside, deletions, and lists of tab stops are not entered."""
    for part in element:
        if _tag(part) not in ("p", "del", "pPr", "rPr"):
            yield part
            yield from _flat(part)


class WordText(Archive):
    def table_text(self):
        notes = [x for x in sorted(self.names) if re.fullmatch(r"word/(header|footer|footnotes|endnotes)\d*\.xml", x)]
        for part in ["word/document.xml", *notes]:
            for i, text in enumerate(self.paragraphs(part)):
                yield self.id, part, i, text


class SlideText(Archive):
    def table_text(self):
        links = self.links("ppt", "presentation.xml")
        order = [links.get(e.get(_REL)) for e in self.elements("ppt/presentation.xml", "sldId")]
        for i, part in enumerate(order):
            for n, text in enumerate(self.paragraphs(part)):
                yield self.id, i, n, text


class Workbook(Archive):
    def __init__(self, data: bytes, name: str):
        super().__init__(data, name)
        links = self.links("xl", "workbook.xml")
        self.sheets = [(e.get("name"), e.get("state", "visible"), links.get(e.get(_REL))) for e in self.elements("xl/workbook.xml", "sheet")]

    def chosen(self) -> Iterator[tuple[int, str]]:
        for i, (_, _, part) in enumerate(self.sheets):
            if self.window.sheet(i):
                yield i, part

    def head(self, part: str, *tags: str) -> Iterator:
        """Elements before the cells; the rest of the part is not read."""
        for kind, element in self.events(part, set(tags), ("sheetData",)):
            if kind == "open":
                return
            yield element

    def table_sheet_info(self):
        """Sizes: of the stored dimension, else of the cells; default widths and heights; grid lines."""
        for i, part in self.chosen():
            head = {_tag(e): e for e in self.head(part, "dimension", "sheetFormatPr", "sheetView")}
            stored = head["dimension"].get("ref") if "dimension" in head else None
            if stored:
                row, column = address(stored.rpartition(":")[2])
            else:
                row = column = 0
                for r, c, _ in self.places(part, Window()):
                    row, column = max(row, r), max(column, c)
            defaults = head.get("sheetFormatPr")
            width, height = (None if defaults is None else _number(defaults.get(x), float) for x in ("defaultColWidth", "defaultRowHeight"))
            if height is not None and not 0 < height * 96 / 72 <= MAX_HEIGHT:
                raise ValueError("invalid default height of rows")
            view = head.get("sheetView")
            yield self.id, i, row + 1, column + 1, width, height, view is None or view.get("showGridLines") not in ("0", "false")

    def table_column(self):
        for i, part in self.chosen():
            for e in self.head(part, "col"):
                first, last = (_number(e.get(x)) for x in ("min", "max"))
                if first is None or last is None or not 1 <= first <= last <= COLUMNS:
                    raise ValueError("invalid columns")
                yield self.id, i, first - 1, last - 1, _number(e.get("width"), float), e.get("hidden", "0") not in FALSE, _number(e.get("style"))

    def table_row(self):
        """Rows with a height, a style of their own, or hidden."""
        for i, part in self.chosen():
            row = -1
            for _, e in self.events(part, set(), ("row",)):
                row = int(e.get("r")) - 1 if e.get("r") else row + 1
                if self.window.past(row):
                    break
                style = _number(e.get("s")) if e.get("customFormat", "0") not in FALSE else None
                hidden, points = e.get("hidden", "0") not in FALSE, _number(e.get("ht"), float)
                if points is not None and not 0 <= points * 96 / 72 <= MAX_HEIGHT:
                    raise ValueError("invalid height of a row")
                if hidden or style is not None or points is not None:
                    yield self.id, i, row, points, hidden, style

    def style_parts(self, group: str, name: str):
        for e in self.elements("xl/styles.xml", group):
            yield from enumerate(x for x in e if _tag(x) == name)

    def xfs(self, group: str):
        for ix, e in self.style_parts(group, "xf"):
            align = _child(e, "alignment")
            get = (lambda n: None) if align is None else align.get
            ids = [_number(e.get(n)) for n in ("fontId", "fillId", "borderId", "numFmtId")]
            yield ix, _number(e.get("xfId")), *ids, get("horizontal"), get("vertical"), get("wrapText"), get("shrinkToFit"), get("indent"), get("textRotation")

    def table_xf(self):
        for row in self.xfs("cellXfs"):
            yield self.id, *row

    def table_base_xf(self):
        for ix, _, *rest in self.xfs("cellStyleXfs"):
            yield self.id, ix, *rest

    def table_font(self):
        for ix, e in self.style_parts("fonts", "font"):
            line, name = _child(e, "u"), _value(_child(e, "name"))
            if line is not None:
                line = "none" if not _flag(line) else line.get("val") or "single"
            yield self.id, ix, *(_flag(_child(e, n)) for n in ("b", "i", "strike")), line, name and name[:128], _number(_value(_child(e, "sz")), float), _value(_child(e, "vertAlign")), *_color(_child(e, "color"))

    def table_fill(self):
        for ix, e in self.style_parts("fills", "fill"):
            pattern = _child(e, "patternFill")
            yield self.id, ix, pattern is not None and pattern.get("patternType") == "solid", *_color(_child(e, "patternFill", "fgColor"))

    def table_border(self):
        for ix, e in self.style_parts("borders", "border"):
            for side in ("left", "right", "top", "bottom"):
                edge = _child(e, side)
                if edge is not None and edge.get("style"):
                    yield self.id, ix, side, edge.get("style"), *_color(_child(edge, "color"))

    def table_num_fmt(self):
        for e in self.elements("xl/styles.xml", "numFmts"):
            for x in e:
                yield self.id, _number(x.get("numFmtId")), x.get("formatCode")

    def table_theme_color(self):
        for part in sorted(x for x in self.names if x.startswith("xl/theme/theme"))[:1]:
            for e in self.elements(part, "clrScheme"):
                for x in e:
                    plain, system = _child(x, "srgbClr"), _child(x, "sysClr")
                    color = plain.get("val") if plain is not None else None if system is None else system.get("lastClr")
                    if _tag(x) in THEME and color:
                        yield self.id, THEME.index(_tag(x)), color

    def table_workbook(self):
        yield self.id, any(e.get("date1904", "0") not in FALSE for e in self.elements("xl/workbook.xml", "workbookPr"))

    def table_sheet(self):
        for i, (name, state, _) in enumerate(self.sheets):
            yield self.id, i, name, state

    def table_merge(self):
        for i, part in self.chosen():
            for n, element in enumerate(self.elements(part, "mergeCell")):
                first, _, last = element.get("ref").partition(":")
                (r0, c0), (r1, c1) = address(first), address(last or first)
                if r1 < r0 or c1 < c0 or n >= MAX_MERGES:
                    raise ValueError("invalid merges")
                yield self.id, i, r0, c0, r1, c1

    def table_defined_name(self):
        for element in self.elements("xl/workbook.xml", "definedName"):
            scope = element.get("localSheetId")
            yield self.id, element.get("name"), element.text or "", None if scope is None else int(scope)

    def table_shared_string(self):
        for i, element in enumerate(self.elements("xl/sharedStrings.xml", "si")):
            yield self.id, i, self.text(element)

    def places(self, part: str, window: Window) -> Iterator[tuple[int, int, object]]:
        """(row, column, cell) within the window; a cell without an address stands right of the one before, a row below. Ends after the last row that is wanted."""
        row, column = -1, -1
        for kind, element in self.events(part, {"c"}, ("row",)):
            if kind == "open":
                row, column = int(element.get("r")) - 1 if element.get("r") else row + 1, -1
                if window.past(row):
                    return
                continue
            if element.get("r"):
                row, column = address(element.get("r"))
            else:
                column += 1
            if not (0 <= row < ROWS and 0 <= column < COLUMNS):
                raise ValueError("a cell lies outside the sheet")
            if window.within(row, column):
                yield row, column, element

    def table_cell(self):
        for i, part in self.chosen():
            for row, column, cell in self.places(part, self.window):
                yield self.decoded(i, row, column, cell)

    def table_rich_run(self):
        """Runs of inline texts (row, col) and of shared strings (shared_ix), with what each sets."""
        for i, part in self.chosen():
            for row, column, cell in self.places(part, self.window):
                inline = next((x for x in cell if _tag(x) == "is"), None)
                if inline is not None:
                    yield from ((self.id, i, row, column, None, *run) for run in self.runs(inline))
        for ix, element in enumerate(self.elements("xl/sharedStrings.xml", "si")):
            yield from ((self.id, None, None, None, ix, *run) for run in self.runs(element))

    def runs(self, element) -> Iterator[tuple]:
        for n, run in enumerate(x for x in element if _tag(x) == "r"):
            name, line = _value(_child(run, "rPr", "rFont")), _child(run, "rPr", "u")
            if line is not None:
                line = "none" if not _flag(line) else line.get("val") or "single"
            yield n, self.text(run), *(_flag(_child(run, "rPr", x)) for x in ("b", "i", "strike")), line, name and name[:128], _number(_value(_child(run, "rPr", "sz")), float), _value(_child(run, "rPr", "vertAlign")), *_color(_child(run, "rPr", "color"))

    def decoded(self, sheet: int, row: int, col: int, cell) -> tuple:
        kind, raw, formula, si, inline = cell.get("t"), None, None, None, None
        for part in cell:
            tag = _tag(part)
            if tag == "v":
                raw = part.text
            elif tag == "f":
                formula, si = part.text or "", part.get("si") if part.get("t") == "shared" else None
            elif tag == "is":
                inline = self.text(part)
        t = num = string = flag = err = shared = None
        if kind == "inlineStr":
            t, string = "s", inline or ""
        elif raw is None:
            pass
        elif kind == "s":
            t, shared = "s", int(raw)
        elif kind == "b":
            t, flag = "b", raw == "1"
        elif kind == "e":
            t, err = "e", raw
        elif kind in (None, "n"):
            t, num = "n", float(raw)
        else:
            t, string = "s", raw
        style = cell.get("s")
        return self.id, sheet, row, col, t, num, string, flag, err, formula, shared, si, None if style is None else int(style)


def _source(short: str, tables: dict[str, str], default: str, opened) -> type[DataSource]:
    class Office(DataSource):
        @classmethod
        def name(cls) -> str:
            return short

        def schema(self) -> str:
            return tables[self.options.get("table", default)]

        def reader(self, schema):
            return FileReader(self.options, short, self.options.get("table", default), opened)

    return Office


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session, and lets Spark hand them its filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(_source("xlsx", SCHEMAS, "cell", Workbook))
    spark.dataSource.register(_source("docx", {"text": TEXTS["docx"]}, "text", WordText))
    spark.dataSource.register(_source("pptx", {"text": TEXTS["pptx"]}, "text", SlideText))
