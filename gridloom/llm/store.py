"""Where intermediate tables live: the folder that the cluster names in ``spark.checkpoint.dir``.

``materialize`` writes a table there and reads it back. That cuts lineage, and a lost
executor costs nothing that was written. No executor-local storage is used.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings of a session while an intermediate table is written: its shuffle files go at the end, and batches for Python are small, as a task holds several.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}

#: Options of such a write: no checksum files in local folders. The JVM starts a process to set the mode of each file, and while one starts the executor's memory shows twice. Other file systems don't read this.
_PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def shared_root(spark: SparkSession) -> str:
    """The shared folder; a temporary one only where Spark runs inside this process (tests)."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.startswith("local["):
        root = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.sparkContext.setCheckpointDir(root)
        return root
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_gridloom"


#: Paths written within each open ``scratch``, the innermost last.
_written: ContextVar[tuple[list[str], ...]] = ContextVar("written", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written within are deleted at the end, but for those that ``materialize`` keeps."""
    paths: list[str] = []
    token = _written.set((*_written.get(), paths))
    try:
        yield
    finally:
        _written.reset(token)
        for path in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader over what was written.

    The shuffle files of the write are of no use after it, and are removed at its end. The
    table is deleted at the end of the ``scratch`` around it, or with ``keep`` of the next one outside.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    around = _written.get()[: -1 if keep else None]
    if around:
        around[-1].append(path)
    before = {name: spark.conf.get(name, None) for name in _WRITING}
    try:
        for name, value in _WRITING.items():
            spark.conf.set(name, value)
        df.write.options(**_PLAIN).parquet(path)
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def row_hash():
    """A 64-bit hash of a row's doc_id and text."""
    return F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.col("doc_id").isNull(), F.coalesce(F.col("text"), F.lit("")))


def row_key():
    """A key of 128 bits for joining derived rows back: rows equal in doc_id and text share it and get equal results."""
    return F.struct(row_hash().alias("a"), F.xxhash64(F.lit("second"), F.coalesce(F.col("text"), F.lit("")), F.col("doc_id")).alias("b"))
