"""Shared helpers of the corpus operators: inputs, work tables, Arrow text blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Bytes of text that one numpy step works on; intermediate arrays are a few dozen times as large.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, null texts empty: other columns, whatever their names, stay outside."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


#: Folders that this application has written below the checkpoint folder.
_WORK: list[str] = []


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once below ``spark.checkpoint.dir`` and read back (lineage ends there)."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def work_path(spark: SparkSession, label: str) -> str:
    import uuid
    _WORK.append(f"{ensure_checkpoint_dir(spark).rstrip('/')}/routeledger/llm-{label}-{uuid.uuid4().hex}")
    return _WORK[-1]


def work_since(mark: int) -> list[str]:
    """Work folders named after the first ``mark`` of them."""
    return _WORK[mark:]


def work_mark() -> int:
    return len(_WORK)


def drop_work(spark: SparkSession, folders: list[str]) -> None:
    """Delete work folders whose results have been written elsewhere."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and the n + 1 row offsets into them; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_string())
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def row_blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes (a longer row is a range of its own)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def ship_package(spark: SparkSession) -> None:
    """Give this package to the executors' Python (``addPyFile``), once per application."""
    import shutil
    import tempfile
    from pathlib import Path
    sc = spark.sparkContext
    if getattr(sc, "_routeledger_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    made = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="routeledger-")) / package.name), "zip",
                               package.parent, package.name)
    sc.addPyFile(made)
    sc._routeledger_shipped = True
