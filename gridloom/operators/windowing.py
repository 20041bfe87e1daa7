"""Windows of sheets, merges, hidden rows, offsets and styles as DataFrame operators.

``cells`` has sheet_ix, row, col and more; ``merges`` sheet_ix, r0, c0, r1, c1.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.formula import rebase

# Rows of a page, columns of a window, bounds of a chosen width, default width.
PAGE_ROWS, WINDOW_COLUMNS, MIN_WIDTH, MAX_WIDTH, WIDTH = 50, 20, 24, 2400, 64
#: Keys sampled for each range of rows that are numbered.
SAMPLED = 64


def _bucket(df: DataFrame, order: tuple[str, ...]) -> Column:
    """The number of the range of ``order`` that a row lies in, 0 up to the count of shuffle partitions less 1.

    Bounds come from a sample that is taken now and stand in the column as constants: wherever
    the column is computed a row gets the same range. Any bounds give ranges in order.
    """
    keys = df.select(*order)
    parts, count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), keys.count()
    seen = keys.sample(min(1.0, SAMPLED * parts / max(1, count)), seed=7).orderBy(*order).collect()
    bounds = [seen[i * len(seen) // parts] for i in range(1, parts)] if seen else []
    bounds = [x for i, x in enumerate(bounds) if not i or x != bounds[i - 1]]
    key = F.struct(*order) if len(order) > 1 else F.col(order[0])

    def bound(row: Row) -> Column:
        found = [F.lit(x).cast(c.dataType).alias(c.name) for x, c in zip(row, keys.schema, strict=True)]
        return F.struct(*found) if len(order) > 1 else found[0]

    def placed(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key >= bound(bounds[middle]), placed(middle + 1, high)).otherwise(placed(low, middle))

    return placed(0, len(bounds))


def row_index(df: DataFrame, *order: str, name: str = "row") -> DataFrame:
    """``df`` with 0-based row numbers in the order of columns that are unique together.

    Rows are sorted within ranges; their sizes, a row each, give the offsets. No row goes to one task.
    A range partitioning by Spark won't do: rows and sizes are computed apart, and its bounds and
    the partitions that adaptive execution puts together differ between the two.
    """
    ranged = df.withColumn("_part", _bucket(df, order))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    start = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_i", inside).join(F.broadcast(start), "_part").withColumn(name, F.col("_start") + F.col("_i") - 1).drop("_part", "_i", "_start")


def window(cells: DataFrame, rows: tuple[int, int], columns: tuple[int, int], anchors: DataFrame | None = None) -> DataFrame:
    """Cells of an inclusive rectangle, and the anchor cells (row, col, and their sheet where it is told) outside it. Bounds reach a Parquet scan."""
    inside = F.col("row").between(*rows) & F.col("col").between(*columns)
    found = cells.where(inside)
    if anchors is None:
        return found
    keys = [c for c in ("workbook_id", "sheet_ix", "row", "col") if c in anchors.columns and c in cells.columns]
    return found.unionByName(cells.where(~inside).join(anchors.select(*keys).distinct(), keys, "left_semi").select(cells.columns))


def page(row: Column) -> Column:
    return F.floor(row / PAGE_ROWS).cast("long")


def column_window(col: Column) -> Column:
    """The first column of the window that a column is in."""
    return (F.floor(col / WINDOW_COLUMNS) * WINDOW_COLUMNS).cast("long")


def visible(cells: DataFrame, hidden_rows: DataFrame, hidden_columns: DataFrame) -> DataFrame:
    return cells.join(hidden_rows, ["sheet_ix", "row"], "left_anti").join(hidden_columns, ["sheet_ix", "col"], "left_anti")


def used_range(cells: DataFrame) -> DataFrame:
    return cells.groupBy("sheet_ix").agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("columns"))


def column_offsets(columns: DataFrame, available: float | None = None) -> DataFrame:
    """(sheet_ix, col, width, override, hidden) with offset (where the column begins) and end.

    A hidden column has no width; a finite override is clamped. With ``available``, columns stretch to it, never shrink.
    """
    sheet = W.partitionBy("sheet_ix")
    chosen = F.greatest(F.lit(MIN_WIDTH), F.least(F.lit(MAX_WIDTH), "override"))
    finite = F.col("override").isNotNull() & ~F.isnan("override") & (F.abs("override") != float("inf"))
    wide = columns.withColumn("w", F.when(F.col("hidden"), 0.0).when(finite, chosen).otherwise(F.coalesce("width", F.lit(WIDTH))).cast("double"))
    if available is not None:
        total = F.sum("w").over(sheet)
        wide = wide.withColumn("w", F.col("w") * F.when(total > 0, F.greatest(F.lit(1.0), available / total)).otherwise(1.0))
    end = F.sum("w").over(sheet.orderBy("col").rowsBetween(W.unboundedPreceding, 0))
    return wide.withColumn("end", end).withColumn("offset", F.col("end") - F.col("w")).drop("w")


def column_at(offsets: DataFrame, points: DataFrame) -> DataFrame:
    """The last column that begins at or before each point (sheet_ix, x): an as-of lookup without a pair join.

    Columns and points of a sheet are merged in one order and the last column is carried on.
    """
    both = offsets.select("sheet_ix", F.col("offset").alias("x"), F.col("col"), F.lit(False).alias("point")).unionByName(points.select("sheet_ix", F.col("x").cast("double").alias("x"), F.lit(None).cast("int").alias("col"), F.lit(True).alias("point")))
    order = W.partitionBy("sheet_ix").orderBy("x", "point", F.col("col")).rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("col", F.last("col", ignorenulls=True).over(order)).where("point").select("sheet_ix", "x", "col")


def merges_in(merges: DataFrame, rows: tuple[int, int], columns: tuple[int, int]) -> DataFrame:
    return merges.where((F.col("r0") <= rows[1]) & (F.col("r1") >= rows[0]) & (F.col("c0") <= columns[1]) & (F.col("c1") >= columns[0]))


def covering_merge(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """``cells`` with r0, c0 of the merge that covers each, if any: merges are spread over the pages they touch, then equi-joined."""
    spread = merges.select("sheet_ix", "r0", "c0", "r1", "c1", F.explode(F.sequence(page(F.col("r0")), page(F.col("r1")))).alias("_page"))
    paged = cells.withColumn("_page", page(F.col("row"))).alias("c")
    hit = (F.col("c.sheet_ix") == F.col("m.sheet_ix")) & (F.col("c._page") == F.col("m._page")) & F.col("c.row").between(F.col("m.r0"), F.col("m.r1")) & F.col("c.col").between(F.col("m.c0"), F.col("m.c1"))
    return paged.join(spread.alias("m"), hit, "left").select(*[F.col(f"c.{c}") for c in cells.columns], "m.r0", "m.c0")


def styled(cells: DataFrame, rows: DataFrame, columns: DataFrame, default: int = 0) -> DataFrame:
    """The style of each cell: its own, else its row's, else its column's, else the default."""
    out = cells.join(rows.select("sheet_ix", "row", F.col("style_ix").alias("_r")), ["sheet_ix", "row"], "left").join(columns.select("sheet_ix", "col", F.col("style_ix").alias("_c")), ["sheet_ix", "col"], "left")
    return out.withColumn("style", F.coalesce("style_ix", "_r", "_c", F.lit(default))).drop("_r", "_c")


def with_shared_strings(cells: DataFrame, strings: DataFrame) -> DataFrame:
    """Texts of cells that hold an index into (workbook_id, ix, text); a missing string is an error."""
    out = cells.join(strings.select("workbook_id", F.col("ix").alias("shared_ix"), F.col("text").alias("_text")), ["workbook_id", "shared_ix"], "left")
    missing = F.col("shared_ix").isNotNull() & F.col("_text").isNull()
    return out.withColumn("str", F.when(missing, F.raise_error(F.lit("Missing shared string"))).otherwise(F.coalesce("_text", "str"))).drop("_text")


def with_shared_formulas(cells: DataFrame) -> DataFrame:
    """Formulas of cells that only name a family ``si``: the family's formula, moved to the cell; #REF! without one."""

    @F.pandas_udf(T.StringType())
    def moved(formula: pd.Series, rows: pd.Series, columns: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else rebase(x, int(r), int(c)) for x, r, c in zip(formula, rows, columns, strict=True)])

    keys = ["workbook_id", "sheet_ix", "si"]
    base = cells.where("si is not null and formula <> ''").select(*keys, F.col("row").alias("_row"), F.col("col").alias("_col"), F.col("formula").alias("_formula")).dropDuplicates(keys)
    lone = F.col("si").isNotNull() & (F.coalesce("formula", F.lit("")) == "")
    own = cells.where(~lone)
    rest = cells.where(lone).join(base, keys, "left")
    rest = rest.withColumn("formula", F.coalesce(moved("_formula", F.col("row") - F.col("_row"), F.col("col") - F.col("_col")), F.lit("#REF!")))
    return own.unionByName(rest.select(cells.columns))
