"""Readers over files: rows by the ``table_*`` method of what opens a file's bytes.

``load`` reads with Spark's own file system, so paths are those of the cluster, sizes are checked
before a byte is read, and files are dealt over tasks. ``FileReader`` serves the short names of
``spark.read.format(...)`` over paths that every executor can open.
"""

from __future__ import annotations

import glob
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceReader, InputPartition

# Largest files.
MAX_OFFICE, MAX_PDF = 50 << 20, 1 << 30
#: Rows that leave a reader together.
ROWS = 4096


class Window:
    """Inclusive bounds of rows and columns, sheets, and cells outside that are wanted all the same; None is unbounded."""

    def __init__(self, rows=(0, None), columns=(0, None), sheets=None, anchors=()):
        self.rows, self.columns = (rows[0] or 0, rows[1]), (columns[0] or 0, columns[1])
        self.sheets, self.anchors = None if sheets is None else frozenset(sheets), frozenset(map(tuple, anchors))
        ends = [x for x in (self.rows[1], *(r for r, _ in self.anchors)) if x is not None]
        self.last = None if self.rows[1] is None else max(ends)

    @classmethod
    def of(cls, options) -> Window:
        """From options such as rows="0:49", columns="0:19", sheets="0,2", anchors="3:4,7:0"."""

        def bounds(text):
            a, _, b = (text or "").partition(":")
            return int(a or 0), int(b) if b else None

        sheets, anchors = options.get("sheets"), options.get("anchors")
        return cls(bounds(options.get("rows")), bounds(options.get("columns")), None if not sheets else map(int, sheets.split(",")), [tuple(map(int, x.split(":"))) for x in anchors.split(",")] if anchors else ())

    def within(self, row: int, column: int) -> bool:
        inside = self.rows[0] <= row and (self.rows[1] is None or row <= self.rows[1]) and self.columns[0] <= column and (self.columns[1] is None or column <= self.columns[1])
        return inside or (row, column) in self.anchors

    def past(self, row: int) -> bool:
        """Whether nothing at or after this row is wanted."""
        return self.last is not None and row > self.last

    def sheet(self, index: int) -> bool:
        return self.sheets is None or index in self.sheets


def rows_of(opened, data: bytes, name: str, table: str, window: Window) -> Iterator[tuple]:
    made = opened(data, name)
    made.window = window
    return getattr(made, f"table_{table}")()


def load(spark: SparkSession, path: str, opened: Callable, schema: str, table: str, window: Window | None = None, max_bytes: int = MAX_OFFICE, pattern: str | None = None) -> DataFrame:
    """The rows of a table of all files at ``path``. A file over ``max_bytes`` fails by name, unread; Spark passes over empty files."""
    files = spark.read.format("binaryFile")
    files = (files.option("pathGlobFilter", pattern) if pattern else files).load(path)
    size = F.col("length") <= max_bytes
    name = F.element_at(F.split("path", "/"), -1)
    guarded = files.select(F.when(size, name).otherwise(F.raise_error(F.concat(F.lit("a file is too large: "), "path"))).alias("name"), "content")
    window = window or Window()
    target = spark.createDataFrame([], schema).schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        for batch in batches:
            for i in range(batch.num_rows):
                held = []
                for row in rows_of(opened, batch.column(1)[i].as_py(), batch.column(0)[i].as_py(), table, window):
                    held.append(row)
                    if len(held) == ROWS:
                        yield _batch(held, arrow)
                        held = []
                if held:
                    yield _batch(held, arrow)

    return guarded.mapInArrow(run, target)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(column), field.type) for column, field in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class FileReader(DataSourceReader):
    """A partition for each file. Bounds on row, col and sheet_ix, given as options or pushed down, reach the scan, which stops after the last row it needs."""

    def __init__(self, options, suffix: str, table: str, opened):
        self.suffix, self.table, self.opened = suffix, table, opened
        self.path = re.sub("^file:(//)?", "", options["path"])
        self.window = Window.of(options)
        self.max_bytes = int(options.get("maxBytes", MAX_PDF if suffix == "pdf" else MAX_OFFICE))

    def pushFilters(self, filters):
        rows, columns, sheets = list(self.window.rows), list(self.window.columns), self.window.sheets
        if not self.window.anchors:
            for f in filters:
                kind, name, value = type(f).__name__, getattr(f, "attribute", None), getattr(f, "value", None)
                bounds = {("row",): rows, ("col",): columns}.get(name)
                if bounds is not None and isinstance(value, int):
                    if kind in ("EqualTo", "GreaterThan", "GreaterThanOrEqual"):
                        bounds[0] = max(bounds[0], value + (kind == "GreaterThan"))
                    if kind in ("EqualTo", "LessThan", "LessThanOrEqual"):
                        top = value - (kind == "LessThan")
                        bounds[1] = top if bounds[1] is None else min(bounds[1], top)
                elif name == ("sheet_ix",) and kind == "EqualTo":
                    sheets = {value} if sheets is None else sheets & {value}
            if self.table == "cell":
                self.window = Window(tuple(rows), tuple(columns), sheets)
        yield from filters  # Spark applies them again

    def partitions(self):
        files = glob.glob(os.path.join(self.path, f"*.{self.suffix}") if os.path.isdir(self.path) else self.path)
        return [InputPartition(x) for x in sorted(files)]

    def read(self, partition):
        if partition is None or partition.value is None:
            return
        if not 0 < os.path.getsize(partition.value) <= self.max_bytes:
            raise ValueError(f"a file is empty or too large: {partition.value}")
        with open(partition.value, "rb") as f:
            yield from rows_of(self.opened, f.read(), os.path.basename(partition.value), self.table, self.window)
