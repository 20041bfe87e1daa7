"""Documents by path: what ``load_document``, ``sheet_info`` and ``sheet_window`` of the public interface give.

Files are read with Spark's file system, wherever they lie; sizes are checked before reading.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import display, windowing
from gridloom.operators.safety import FORMATS
from gridloom.sources import legacy, pdf, xls, xlsx
from gridloom.sources.files import MAX_OFFICE, MAX_PDF, Window, load

#: For each format: what opens a file, its tables, and the table that is meant where none is named.
OPENED = {
    "xlsx": (xlsx.Workbook, xlsx.SCHEMAS, "cell"),
    "xls": (xls.Workbook, xls.SCHEMAS, "cell"),
    "docx": (xlsx.WordText, {"text": xlsx.TEXTS["docx"]}, "text"),
    "pptx": (xlsx.SlideText, {"text": xlsx.TEXTS["pptx"]}, "text"),
    "ppt": (legacy.Presentation, legacy.PPT, "slide"),
    "doc": (legacy.WordFile, legacy.DOC, "text"),
    "pdf": (pdf.Document, pdf.SCHEMAS, "text"),
}


def format_of(path: str) -> str | None:
    found = path.rpartition("/")[2].rpartition(".")[2].lower()
    return found if found in FORMATS else None


def load_document(spark: SparkSession, path: str, format: str | None = None, table: str | None = None, max_bytes: int | None = None, window: Window | None = None) -> DataFrame:
    """A table of the file, or of all files of one format in a folder, at ``path``. The format named wins over the path's ending."""
    format = (format or format_of(path) or "").lower()
    if format not in OPENED:
        raise ValueError(f"unknown format of {path}")
    opened, tables, usual = OPENED[format]
    pattern = None if format_of(path) else f"*.{format}"
    return load(spark, path, opened, tables[table or usual], table or usual, window, max_bytes or (MAX_PDF if format == "pdf" else MAX_OFFICE), pattern)


def sheet_info(spark: SparkSession, path: str, format: str | None = None) -> dict[str, DataFrame]:
    """Tables of a workbook's visible sheets: sheet (with sizes and defaults), merge, column, row."""
    read = lambda table: load_document(spark, path, format, table)
    sheets = display.visible_sheets(read("sheet")).join(read("sheet_info"), ["workbook_id", "sheet_ix"])
    return {"sheet": sheets} | {t: read(t).join(sheets.select("workbook_id", "sheet_ix"), ["workbook_id", "sheet_ix"], "left_semi") for t in ("merge", "column", "row")}


def sheet_window(spark: SparkSession, path: str, sheet: int, rows: tuple[int, int], columns: tuple[int, int], anchors=(), format: str | None = None) -> DataFrame:
    """The cells of an inclusive rectangle of one sheet, and its ``anchors`` outside, with texts and formulas resolved. The scan ends after the last row it needs."""
    kind = (format or format_of(path) or "").lower()
    cells = load_document(spark, path, kind, "cell", window=Window(rows, columns, [sheet], anchors))
    if kind == "xlsx":
        # the family of a shared formula may begin outside the window
        lone = cells.where("si is not null and coalesce(formula, '') = ''").select("workbook_id", "si").distinct()
        heads = load_document(spark, path, kind, "cell", window=Window(sheets=[sheet])).where("si is not null and formula <> ''").join(lone, ["workbook_id", "si"], "left_semi")
        inside = cells.withColumn("_inside", F.lit(True)).unionByName(heads.withColumn("_inside", F.lit(False)))
        cells = windowing.with_shared_formulas(inside).where("_inside").drop("_inside")
        cells = windowing.with_shared_strings(cells, load_document(spark, path, kind, "shared_string"))
    return cells
