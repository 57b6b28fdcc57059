"""Exact k-means rounds by the shallot search.

A vector keeps its centroid, the second-nearest one, an upper bound of the distance to
the first and a lower bound of the distance to any other.  While the bounds, moved by how
far the centroids went, prove the first to be nearest, nothing is computed.  Otherwise
the exact distances to the two remembered centroids are taken, the search starts from the
closer one, and its neighbours are looked at in rising distance from it: a centroid
farther from it than the vector's distance plus that of the second-best one found so far
can't be among the two nearest, and that ball shrinks with every better second.  Bounds are
doubles, rounded outwards; whoever is compared is compared by squared integer distances,
equal ones by number.  Vectors and bounds are a written table of each round; only sums and
counts of the clusters come to the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_work, staged, work_mark, work_since
from .vectors import integer_vectors, matrix

CENTROIDS, ROUNDS, SIZE, SCALE = 40, 5, 64, 256
#: Relative slack of the double bounds; roundings are far smaller.
SLACK = 1e-9

_STATE = "vec_id long, x binary, first int, second int, upper double, lower double, distance long"


def square(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``x`` to ``c`` (one row, or one for each), exact."""
    d = x.astype(np.int64) - c
    return np.einsum("ij,ij->i", d, d)


class Search:
    """Centroids of one round, the order of their neighbours, and how far each moved since the last round."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None):
        self.c = centroids.astype(np.int64)
        k = len(self.c)
        self.gap = np.sqrt(np.stack([square(self.c, c) for c in self.c]).astype(np.float64)) * (1 - SLACK)
        self.near = np.argsort(self.gap, axis=1, kind="stable")
        away = self.gap + np.where(np.eye(k, dtype=bool), np.inf, 0)
        self.half = away.min(axis=1) / 2
        self.moved = np.sqrt(square(self.c, before).astype(np.float64)) * (1 + SLACK) if before is not None else np.zeros(k)
        top = np.sort(self.moved)[::-1]
        self.others = np.where(self.moved == top[0], top[1] if k > 1 and (self.moved == top[0]).sum() == 1 else top[0], top[0])  # largest move of any other

    def assign(self, x, first, second, upper, lower):
        """New (first, second, upper, lower); a ``first`` below 0 means that nothing is known yet."""
        k = len(self.c)
        known = first >= 0
        first, second = np.where(known, first, 0), np.where(known & (second >= 0), second, 1 if k > 1 else -1)
        second = np.where((second == first) & (k > 1), (first + 1) % k, second)
        upper = np.where(known, upper + self.moved[first], np.inf)
        lower = np.where(known, lower - self.others[first], -np.inf)
        open_ = np.flatnonzero(~(upper < np.maximum(lower, self.half[first])))
        d1 = square(x[open_], self.c[first[open_]])
        upper[open_] = np.sqrt(d1.astype(np.float64)) * (1 + SLACK)
        still = ~(upper[open_] < np.maximum(lower[open_], self.half[first[open_]]))
        open_, d1 = open_[still], d1[still]
        if k == 1:
            lower[:] = np.inf
            return first, second, upper, lower
        y, a, b = x[open_], first[open_], second[open_]
        d2 = square(y, self.c[b])
        swap = (d2 < d1) | ((d2 == d1) & (b < a))
        a, b, d1, d2 = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, d2, d1), np.where(swap, d1, d2)
        start, radius, tried = a.copy(), np.sqrt(d1.astype(np.float64)), b.copy()
        for c in np.unique(start):
            live = np.flatnonzero(start == c)
            for j in self.near[c]:
                live = live[self.gap[c, j] <= (radius[live] + np.sqrt(d2[live].astype(np.float64))) * (1 + SLACK)]
                if not len(live):
                    break
                new = live[tried[live] != j] if j != c else live[:0]
                if not len(new):
                    continue
                d = square(y[new], self.c[j])
                best = (d < d1[new]) | ((d == d1[new]) & (j < a[new]))
                next_ = ~best & ((d < d2[new]) | ((d == d2[new]) & (j < b[new])))
                up, side = new[best], new[next_]
                b[up], d2[up] = a[up], d1[up]
                a[up], d1[up] = j, d[best]
                b[side], d2[side] = j, d[next_]
        first[open_], second[open_] = a, b
        upper[open_], lower[open_] = np.sqrt(d1.astype(np.float64)) * (1 + SLACK), np.sqrt(d2.astype(np.float64)) * (1 - SLACK)
        return first, second, upper, lower


def _assign(state: DataFrame, search: Search, last: bool) -> DataFrame:
    """The state after one round's search; ``distance`` is filled in the last one."""
    fresh = "first" not in state.columns

    def run(batches):
        for b in batches:
            n = b.num_rows
            x = matrix(b.column(b.schema.get_field_index("x")), search.c.shape[1])
            col = lambda name: b.column(b.schema.get_field_index(name)).to_numpy(zero_copy_only=False).copy()  # noqa: E731, B023
            was = (np.full(n, -1), np.full(n, -1), np.zeros(n), np.zeros(n)) if fresh else tuple(map(col, ("first", "second", "upper", "lower")))
            first, second, upper, lower = search.assign(x, *was)
            distance = pa.array(square(x, search.c[first])) if last else pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(b.schema.get_field_index("x")), pa.array(first.astype(np.int32)), pa.array(second.astype(np.int32)),
                                              pa.array(upper), pa.array(lower), distance], ["vec_id", "x", "first", "second", "upper", "lower", "distance"])

    return state.mapInArrow(run, _STATE)


def _sums(state: DataFrame, k: int, size: int) -> tuple[list[int], list[list[int]]]:
    """Count and componentwise sum of every cluster: partial sums in the tasks, k * size numbers to the driver."""
    def part(batches):
        count, total = np.zeros(k, np.int64), np.zeros((k, size), np.int64)
        for b in batches:
            x, first = matrix(b.column(1), size).astype(np.int64), b.column(0).to_numpy()
            order = np.argsort(first, kind="stable")
            some, at = np.unique(first[order], return_index=True)
            if len(some):
                total[some] += np.add.reduceat(x[order], at, axis=0)
                count[some] += np.diff(np.append(at, len(first)))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], ["c", "n", "s"])

    got = (state.select("first", "x").mapInArrow(part, "c int, n long, s array<long>").select("c", "n", F.posexplode("s").alias("d", "s"))
           .groupBy("c", "d").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect())
    count, total = [0] * k, [[0] * size for _ in range(k)]
    for r in got:
        count[r["c"]], total[r["c"]][r["d"]] = r["n"], r["s"]
    return count, total


def clusters(rows: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, salt: str = "2") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, second_cluster of every vector of ``size`` finite entries.

    Vectors are floor(scale * c).  The first centroids are the k vectors with the least sha256 of
    ``salt:vec_id`` (equal ids by their bytes, rows without id last); with fewer vectors there are as
    many centroids.  Ties go to the smaller number; a cluster that gets no vector keeps its centroid.
    Repeated rows count and are returned each; null vectors, null or non-finite entries and other
    lengths are left out; an empty table gives no rows.
    """
    spark = rows.sparkSession
    mark = work_mark()
    state = staged(integer_vectors(rows, scale, size), "vectors")
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    seeds = state.orderBy(F.asc_nulls_last(key), "x").limit(k).select("x").collect()  # k vectors
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, second_cluster int"
    if not seeds:
        return spark.createDataFrame([], out)
    centroids, before = np.stack([np.frombuffer(r["x"], "<i4").astype(np.int64) for r in seeds]), None
    for step in range(rounds + 1):
        old, mark = work_since(mark), work_mark()
        state = staged(_assign(state, Search(centroids, before), last=step == rounds), "bounds")
        drop_work(spark, old)
        if step < rounds:
            count, total = _sums(state, len(centroids), size)
            before = centroids
            centroids = np.array([[s // n for s in total[c]] if (n := count[c]) else before[c].tolist() for c in range(len(before))], np.int64)
    inertia = {r["first"]: r["s"] for r in state.groupBy("first").agg(F.sum("distance").alias("s")).collect()}  # k rows
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    per = spark.createDataFrame([(c, s, sum(inertia.values()), digests[c]) for c, s in inertia.items()], "first int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(per), "first").select("vec_id", F.col("first").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256",
                                                        F.when(F.col("second") >= 0, F.col("second")).alias("second_cluster"))
