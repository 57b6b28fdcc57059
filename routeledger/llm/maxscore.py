"""Exact top-k by inner product: MaxScore over posting lists of vector components.

Every component is two terms, one for each sign, and a row stands in the list of a term
with the size of its component there.  For a query, the lists whose sign is the query's
can only add to a score, each at most ``|query component| * largest value in the list``;
those of the other sign only take from it.  Given the k-th best score so far, the weakest
adding lists whose bounds together stay below it are non-essential: a row in none of the
others can't be among the best.  The essential lists are traversed; the non-essential
ones and then the lowering ones are probed, strongest first, for the rows that their
remaining bounds still leave competitive.  Every task searches its own rows, block by
block with the k-th score carried on, and the shards' best are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import dense_ids
from .common import staged
from .vectors import blocks, integer_vectors, matrix

SCALE, TOP, EVERY = 1024, 10, 100
#: Rows of the first block of a task, of the later ones, and queries of one broadcast slice.
FIRST, BLOCK, SLICE = 512, 8192, 4096


class Postings:
    """Posting lists of a block of vectors; ``x``: rows x components."""

    def __init__(self, x: np.ndarray):
        self.columns = np.ascontiguousarray(x.T.astype(np.int64))
        self.rows = np.ascontiguousarray(x.astype(np.int64))
        self.lists, self.top = [], np.zeros((2, x.shape[1]), np.int64)
        for negative in (0, 1):
            signed = -self.columns if negative else self.columns
            places = [np.flatnonzero(c > 0) for c in signed]
            self.lists.append([(p, c[p]) for p, c in zip(places, signed, strict=True)])
            self.top[negative] = signed.max(axis=1, initial=0) if x.shape[1] else 0

    def competitive(self, query: np.ndarray, least: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of all rows that score ``least`` or more (None: all rows); the places are rising."""
        dims = np.flatnonzero(query)
        if least is None or least <= 0:  # a row in no list may be among the best
            return np.arange(len(self.rows)), self.rows @ query
        sign, weight = (query[dims] < 0).astype(int), np.abs(query[dims])
        bound = weight * self.top[sign, dims]
        order = np.argsort(bound, kind="stable")
        rest = np.cumsum(bound[order])  # what the i + 1 weakest lists can add
        weak = int(np.searchsorted(rest, least, side="left"))  # so many are non-essential
        total = np.zeros(len(self.rows), np.int64)
        for i in order[weak:]:
            places, values = self.lists[sign[i]][dims[i]]
            total[places] += values * weight[i]
        at = np.flatnonzero(total)  # rows in some essential list
        score = total[at]
        for k in range(weak - 1, -1, -1):
            live = score + rest[k] >= least
            at, score = at[live], score[live]
            if len(at) <= 64:
                break
            i = order[k]
            value = self.columns[dims[i]][at]
            score = score + np.maximum(-value if sign[i] else value, 0) * weight[i]
        else:
            live = score >= least
            at, score = at[live], score[live]
            lowering = weight * self.top[1 - sign, dims]
            for i in np.argsort(-lowering, kind="stable"):
                if len(at) <= 64:
                    break
                value = self.columns[dims[i]][at]
                score = score - np.maximum(value if sign[i] else -value, 0) * weight[i]
                live = score >= least
                at, score = at[live], score[live]
        score = self.rows[at] @ query
        live = score >= least
        return at[live], score[live]


class Best:
    """The k best rows of one query so far: by falling score, then rising id, rows without id last."""

    def __init__(self, k: int):
        self.k, self.score, self.none, self.id = k, np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    @property
    def least(self) -> int | None:
        return int(self.score[-1]) if len(self.score) == self.k else None

    def add(self, score: np.ndarray, none: np.ndarray, ids: np.ndarray) -> None:
        if len(score) > 4 * self.k:
            keep = score >= np.partition(score, -self.k)[-self.k]
            score, none, ids = score[keep], none[keep], ids[keep]
        score, none, ids = np.concatenate([self.score, score]), np.concatenate([self.none, none]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, none, -score))[:self.k]
        self.score, self.none, self.id = score[order], none[order], ids[order]


def _fit(x: np.ndarray, dim: int) -> np.ndarray:
    return x[:, :dim] if x.shape[1] >= dim else np.pad(x, ((0, 0), (0, dim - x.shape[1])))


def top_k(rows: DataFrame, k: int = TOP, every: int = EVERY, scale: int = SCALE, slice_rows: int = SLICE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by ``every`` its ``k`` best of all other rows.

    Scores are inner products of the vectors floor(scale * c); components that a shorter vector
    lacks count as 0.  Rows with a null vector or null or non-finite entries take no part.  Rows
    are told apart by row, not by vec_id: of repeated rows each is a query and a candidate of
    the others.  Ties go to the smaller vec_id, rows without vec_id come last of their
    score (and are never queries).  An empty table gives no rows.  Queries are searched in
    broadcast slices of ``slice_rows``, each over all rows.
    """
    spark = rows.sparkSession
    vectors = staged(integer_vectors(rows, scale).withColumn("r", F.monotonically_increasing_id()), "vectors")
    queries = staged(dense_ids(vectors.where(F.col("vec_id") % every == 0), ["r"], 0, "q"), "queries")
    n = queries.count()
    found = None
    for first in range(1, n + 1, slice_rows):
        part = queries.where(F.col("q").between(first, first + slice_rows - 1)).select("q", "r", "x").toArrow()
        q, own, asked = part.column("q").to_numpy(), part.column("r").to_numpy(), matrix(part.column("x")).astype(np.int64)
        if asked.shape[1] and len(asked) and int(np.abs(asked).max()) * asked.shape[1] >= 1 << 35:
            raise OverflowError("scores of such vectors may not fit a long")
        shared = spark.sparkContext.broadcast((q, own, asked))  # slice_rows vectors

        def search(batches, shared=shared):
            q, own, asked = shared.value
            best = [Best(k) for _ in q]

            def tables():
                rest = iter(batches)
                for b in rest:
                    if b.num_rows:
                        yield pa.Table.from_batches([b.slice(0, FIRST)])
                        def others(b=b):
                            yield b.slice(FIRST)
                            yield from rest
                        yield from blocks(others(), BLOCK)

            for part in tables():
                x = matrix(part.column("x").combine_chunks() if part.column("x").num_chunks != 1 else part.column("x").chunk(0))
                dim = x.shape[1]
                index, r = Postings(x), part.column("r").to_numpy()
                none = part.column("vec_id").is_null().to_numpy()
                ids = part.column("vec_id").fill_null(0).to_numpy()
                for i, query in enumerate(_fit(asked, dim)):
                    at, score = index.competitive(query, best[i].least)
                    other = r[at] != own[i]
                    at, score = at[other], score[other]
                    if len(at):
                        best[i].add(score, none[at], ids[at])
            for i, b in enumerate(best):
                if len(b.id):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.id), q[i])), pa.array(b.id, mask=b.none), pa.array(b.score)], ["q", "vec_id", "score"])

        got = vectors.select("vec_id", "x", "r").mapInArrow(search, "q long, vec_id long, score long")
        found = got if found is None else found.unionByName(got)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    merged = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    named = queries.select("q", F.col("vec_id").alias("query_id"))
    return merged.join(named, "q").select("query_id", "rank", "vec_id", "score")
