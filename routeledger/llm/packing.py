"""Best-fit packing of token sequences by hierarchical residual rounds.

Documents become pieces of at most ``size`` tokens.  Every task packs its own
pieces best-fit decreasing; bins with at most ``slack`` free tokens are done.  What
the others hold forms smaller underfull bins, which meet those of other tasks as items
of their used length, in fewer tasks, and so on up the tree.  The last round, in as many
tasks as ``ITEMS`` items each allow, packs what is left.  Only lengths and bin numbers
travel, never ids.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, texts
from .token_store import VOCABULARY, _encoded

SIZE, END_ID, SLACK, FAN_IN, ITEMS = 2048, 0, 16, 8, 1_000_000


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and what each bin holds: longest first, each into the fullest bin that has room.

    Bins wait in a list per free length; a bit per length tells which lists have one.
    """
    bins, offsets, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    waiting: list[list[int]] = [[] for _ in range(size + 1)]
    free = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        room = free >> n
        if room:
            r = n + (room & -room).bit_length() - 1
            b = waiting[r].pop()
            if not waiting[r]:
                free &= ~(1 << r)
        else:
            r, b = size, len(used)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        if r > n:
            waiting[r - n].append(b)
            free |= 1 << (r - n)
    return bins, offsets, np.array(used, np.int64)


def pieces(docs: DataFrame, size: int = SIZE, vocabulary: str = VOCABULARY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """(uid, doc_id, piece, start, length, ids_crc32[, ids]): whole texts as ids with the end id, cut only where longer than ``size``.

    A null or empty text is its end id alone; every row is a document of its own, repeated doc_ids too.
    """
    def run(batches):
        uid = TaskContext.get().partitionId() << 36
        for b in batches:
            out = []
            for d, x in _encoded(b, vocabulary, end_id):
                x = x.astype("<u4")
                for p, s in enumerate(range(0, len(x), size)):
                    y = x[s:s + size]
                    out.append((uid, d, p, s, len(y), zlib.crc32(y.tobytes()), y.astype(np.int32) if ids else None))
                    uid += 1
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))[:6 + ids]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)],
                                             ["uid", "doc_id", "piece", "start", "length", "ids_crc32", "ids"][:6 + ids])

    return texts(docs).mapInArrow(run, "uid long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids)


def _pack_some(lengths: np.ndarray, size: int, slack: int, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset, bin's length and whether the bin is done, for each item.

    Nearly full bins are done.  What lies in the others is binned again at a quarter of
    the size, so that the underfull bins that go up the tree still fit into gaps there.
    """
    bins, offsets, used = best_fit(lengths, size)
    done = used >= (0 if last else size - slack)
    held, closed = used[bins], done[bins]
    rest = np.flatnonzero(~closed)
    if len(rest):
        small = rest[lengths[rest] <= size // 4]
        large = rest[lengths[rest] > size // 4]
        b, o, u = best_fit(lengths[small], size // 4)
        first = len(used)
        bins[small], offsets[small], held[small] = first + b, o, u[b]
        bins[large], offsets[large], held[large] = first + len(u) + np.arange(len(large)), 0, lengths[large]
    return bins, offsets, held, closed


def _round(level: int, size: int, slack: int, last: bool):
    """Pack each task's items: (item, bin, at, used, done) for every item."""
    def run(batches):
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if got:
            items, lengths = (np.concatenate(x) for x in zip(*got, strict=True))
            bins, offsets, held, closed = _pack_some(lengths, size, slack, last)
            base = (level << 58) | (TaskContext.get().partitionId() << 36)
            yield pa.RecordBatch.from_arrays([pa.array(items), pa.array(bins + base), pa.array(offsets), pa.array(held), pa.array(closed)],
                                             ["item", "bin", "at", "used", "done"])
    return run


def pack(lengths: DataFrame, size: int = SIZE, slack: int = SLACK) -> DataFrame:
    """(uid, sequence_id, offset) for each row of ``lengths(uid, length)``, 0 < length <= size.

    Sequences hold at most ``size`` tokens and have no gaps.  Equal lengths are
    placed in any order; an empty table gives no rows.
    """
    items = lengths.select(F.col("uid").alias("item"), F.col("length").cast("long").alias("length"))
    n, level, out = int(lengths.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1, None
    last = False
    while True:
        if level > 1:
            items = items.repartition(n, F.xxhash64("item"))
        placed = staged(items.mapInArrow(_round(level, size, slack, last), "item long, bin long, at long, used long, done boolean"), "packed")
        if out is None:
            out = placed.select(F.col("item").alias("uid"), "bin", F.col("at").alias("offset"))
        else:
            up = placed.select(F.col("item").alias("bin"), F.col("bin").alias("up"), F.col("at").alias("add"))
            out = (out.join(up, "bin", "left")
                   .select("uid", F.coalesce("up", "bin").alias("bin"), (F.col("offset") + F.coalesce("add", F.lit(0))).alias("offset")))
        underfull = placed.where("not done").select(F.col("bin").alias("item"), F.col("used").alias("length")).distinct()
        count = 0 if last else underfull.count()
        if not count:
            return out.select("uid", F.col("bin").alias("sequence_id"), "offset")
        least = -(-count // ITEMS)
        n = max(-(-n // FAN_IN), least)
        last, items, level = n <= least, underfull, level + 1


def pack_documents(docs: DataFrame, size: int = SIZE, vocabulary: str = VOCABULARY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """The pieces of all documents with their sequence_id and offset; sequences sorted by offset are the training rows."""
    p = staged(pieces(docs, size, vocabulary, end_id, ids), "pieces")
    return p.join(pack(p, size), "uid").drop("uid")
