"""Integer vectors of an embedding table, as little-endian 32-bit integers in a binary column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components at or beyond it fail the job: squared distances of vectors of 64 such components still fit a long.
LIMIT = 1 << 27


def integer_vectors(rows: DataFrame, scale: int, size: int | None = None) -> DataFrame:
    """(vec_id, x) of the rows whose vector is neither null nor holds null or non-finite entries: x = floor(scale * c) of each entry c as double.

    ``size``: only vectors of so many entries.  Other columns stay outside, whatever their names.
    An entry whose integer reaches ``LIMIT`` fails the job, as overflow does in Spark's ANSI arithmetic.
    """
    v = F.col("embedding").cast("array<double>")
    got = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))))
    if size is not None:
        got = got.where(F.size("v") == size)

    def convert(batches):
        for b in batches:
            col = b.column(1)
            x = np.floor(col.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
            if len(x) and np.abs(x).max() >= LIMIT:
                raise OverflowError(f"a vector entry times {scale} reaches {LIMIT}")
            at = np.concatenate([[0], np.cumsum(col.value_lengths().to_numpy(zero_copy_only=False))]) * 4
            yield pa.RecordBatch.from_arrays([b.column(0), pack(x.astype("<i4"), at)], ["vec_id", "x"])

    return got.mapInArrow(convert, "vec_id long, x binary")


def pack(x: np.ndarray, at: np.ndarray) -> pa.Array:
    """Binary array of the bytes of ``x`` cut at byte offsets ``at``."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(np.asarray(at, np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def matrix(col: pa.Array, dim: int | None = None) -> np.ndarray:
    """Rows x ``dim`` int32 (default: the longest row) of a binary column; shorter rows end in zeros."""
    sizes = np.array([len(v.as_buffer()) // 4 for v in col], np.int64)
    dim = int(sizes.max(initial=0)) if dim is None else dim
    out = np.zeros((len(sizes), dim), np.int32)
    if len(sizes):
        out[np.arange(dim)[None, :] < sizes[:, None]] = np.frombuffer(b"".join(v.as_buffer() for v in col), "<i4")
    return out


def blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The rows of all batches, ``rows`` at a time (the last table may be shorter)."""
    held, n = [], 0
    for b in batches:
        while n + b.num_rows >= rows:
            held.append(b.slice(0, rows - n))
            yield pa.Table.from_batches(held)
            b = b.slice(rows - n)
            held, n = [], 0
        if b.num_rows:
            held.append(b)
            n += b.num_rows
    if held:
        yield pa.Table.from_batches(held)
