"""What a sheet shows: texts of cells by type and number format, alignment, visible sheets, page geometry."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.number_formats import shown
from gridloom.operators.windowing import PAGE_ROWS, page

# Height of a page besides its rows, and of a row.
PAGE_FRAME, ROW_HEIGHT = 100, 20


@F.pandas_udf(T.StringType())
def number_text(value: pd.Series, code: pd.Series, date1904: pd.Series) -> pd.Series:
    """Numbers under their format codes; null where there is no number."""
    return pd.Series([None if pd.isna(x) else shown(None if pd.isna(c) else c, float(x), bool(d)) for x, c, d in zip(value, code, date1904, strict=True)], dtype=object)


def displayed(cells: DataFrame, date1904: Column | None = None) -> DataFrame:
    """``cells`` (t, num, str, bool, err, and number_format and align of their style) with ``text`` and ``align``: numbers are right-aligned unless the style says otherwise."""
    moved = F.lit(False) if date1904 is None else F.coalesce(date1904, F.lit(False))
    text = F.when(F.col("t") == "n", number_text("num", "number_format", moved)).when(F.col("t") == "b", F.when(F.col("bool"), "TRUE").otherwise("FALSE")).when(F.col("t") == "e", F.col("err")).when(F.col("t") == "s", F.col("str"))
    return cells.withColumn("text", F.coalesce(text, F.lit(""))).withColumn("align", F.coalesce("align", F.when(F.col("t").isNull() | (F.col("t") == "n"), "right")))


def visible_sheets(sheets: DataFrame) -> DataFrame:
    return sheets.where(~F.coalesce(F.lower("state"), F.lit("visible")).isin("hidden", "veryhidden"))


def page_heights(rows: DataFrame, pages: DataFrame, hidden: DataFrame | None = None) -> DataFrame:
    """(sheet_ix, page, height) of ``pages`` (sheet_ix, page, n_rows): heights of rows (sheet_ix, row, points), others by default, none for hidden ones."""
    high = rows.select("sheet_ix", "row", (F.col("points") * 96 / 72).alias("h"))
    if hidden is not None:
        gone = hidden.select("sheet_ix", "row", F.lit(0.0).alias("zero"))
        high = high.join(gone, ["sheet_ix", "row"], "full").select("sheet_ix", "row", F.coalesce("zero", "h").alias("h"))
    more = high.withColumn("page", page(F.col("row"))).groupBy("sheet_ix", "page").agg(F.sum(F.col("h") - ROW_HEIGHT).alias("more"))
    return pages.join(more, ["sheet_ix", "page"], "left").select("sheet_ix", "page", (PAGE_FRAME + F.col("n_rows") * ROW_HEIGHT + F.coalesce("more", F.lit(0.0))).cast("double").alias("height"))


def pages_of(info: DataFrame) -> DataFrame:
    """(sheet_ix, page, n_rows) of sheets (sheet_ix, rows)."""
    made = info.select("sheet_ix", "rows", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / PAGE_ROWS))).alias("page"))
    return made.select("sheet_ix", "page", F.least(F.lit(PAGE_ROWS), F.col("rows") - F.col("page") * PAGE_ROWS).alias("n_rows"))


def shown_windows(pages: DataFrame, first: int = 5) -> DataFrame:
    """The first windows of each sheet."""
    return pages.where(F.col("page") < first)


def shown_anchor(cells: DataFrame, hidden_rows: DataFrame, hidden_columns: DataFrame) -> DataFrame:
    """``cells`` of one window (sheet_ix, row, col, r0, c0 of their merge) with ``is_anchor``: whether the cell stands for its merge, at its first row and column that the window has and that are not hidden."""
    seen = cells.join(hidden_rows.select("sheet_ix", "row").distinct(), ["sheet_ix", "row"], "left_anti").join(hidden_columns.select("sheet_ix", "col").distinct(), ["sheet_ix", "col"], "left_anti")
    first = seen.where("r0 is not null").groupBy("sheet_ix", "r0", "c0").agg(F.min("row").alias("_row"), F.min("col").alias("_col"))
    out = seen.join(first, ["sheet_ix", "r0", "c0"], "left")
    return out.withColumn("is_anchor", F.col("r0").isNull() | (F.col("row") == F.col("_row")) & (F.col("col") == F.col("_col"))).drop("_row", "_col")
