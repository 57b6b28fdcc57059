"""Whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred vectors.

With X the centred distinct vectors (one a row), the method builds orthonormal v_k and u_k
with X V = U B, B upper bidiagonal.  A left vector always is X times a short vector w, so
it is never stored: one pass over the rows takes y = X z and t = X'y at once, where
z = v_k - beta w_(k-1).  The products of y with all earlier left vectors are w_j . t, so
the full reorthogonalisation of both sides needs only the short vectors on the driver.  The
SVD of the small B turns V into components and its singular values into deviations.

The squares of B's entries add up to what of the trace is spent; what is left bounds every
singular value not yet seen.  So the method may stop once the wanted triplets have
converged and the rest of the trace is below the last of them; in a flat spectrum it takes as many
steps as there are dimensions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_work, staged, work_mark, work_since
from .vectors import blocks, integer_vectors, matrix, pack

SCALE, COMPONENTS = 256, 4
#: Vectors of one packed block and bytes of packed vectors that one task of a pass reads.
ROWS, TASK_BYTES = 4096, 32 << 20
#: Partial sums that one task, and the driver, adds up.
FAN = 1024
#: Relative residual at which a triplet has converged, and singular value (relative to the first) that counts as 0.
CONVERGED, RANK = 1e-14, 1e-9

_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _parts(packed: DataFrame, tasks: int, dim: int, take) -> np.ndarray:
    """The sum over all blocks of ``take(block)``: tasks add up their own, and groups of ``FAN`` tasks theirs until ``FAN`` rows are left for the driver."""
    def run(batches):
        total = None
        for b in batches:
            for block in b.column(0):
                got = take(np.frombuffer(block.as_buffer(), "<i4").reshape(-1, dim))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([total.dtype.str])], ["t", "kind"])

    def add(batches):
        rows = [(t, kind) for b in batches for t, kind in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        if rows:
            total = sum(np.frombuffer(t, kind) for t, kind in rows)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([total.dtype.str])], ["t", "kind"])

    got = packed.mapInArrow(run, "t binary, kind string")
    while tasks > FAN:
        tasks = -(-tasks // FAN)
        got = got.repartition(tasks).mapInArrow(add, "t binary, kind string")
    return sum(np.frombuffer(r["t"], r["kind"]) for r in got.collect())


class Fit:
    """Distinct vectors in packed blocks with their exact count, sums and squares."""

    def __init__(self, vectors: DataFrame, dim: int):
        spark, mark = vectors.sparkSession, work_mark()
        once = staged(vectors.select("x").distinct(), "distinct")
        n, old = once.count(), work_since(mark)

        def packing(batches):
            for b in blocks(batches, ROWS):
                data = matrix(b.column("x").combine_chunks(), dim)
                yield pa.RecordBatch.from_arrays([pack(data, np.array([0, data.nbytes]))], ["x"])

        self.tasks = tasks = max(spark.sparkContext.defaultParallelism, -(-n * dim * 4 // TASK_BYTES))
        self.packed = staged(once.coalesce(tasks).mapInArrow(packing, "x binary"), "blocks").coalesce(tasks)
        drop_work(spark, old)
        self.dim, self.n = dim, n

        def exact(x):
            x = x.astype(np.int64)
            sq = x * x
            return np.concatenate([x.sum(axis=0), [(sq & ((1 << 27) - 1)).sum(), (sq >> 27).sum()]])

        *self.sums, low, high = _parts(self.packed, tasks, dim, exact).tolist()
        #: n^2 times the trace of the covariance, exact.
        self.spread = n * (low + (high << 27)) - sum(s * s for s in self.sums)
        self.mean = np.array([s / n for s in self.sums]) if n else np.zeros(dim)

    def product(self, z: np.ndarray) -> tuple[np.ndarray, float]:
        """X'(X z) and the squared length of X z, over all centred rows."""
        mean = self.mean

        def take(x):
            x = x - mean
            y = x @ z
            return np.append(y @ x, y @ y)

        got = _parts(self.packed, self.tasks, self.dim, take)
        return got[:-1], float(got[-1])

    def bidiagonalise(self, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
        """(singular values, right singular vectors as columns) of the centred rows, falling."""
        dim, total, rng = self.dim, self.spread / self.n, np.random.default_rng(11)
        right, short, back, alpha, beta = [], [], [], [], []

        def orthogonal(r):
            for _ in range(2):
                for v in right:
                    r = r - (v @ r) * v
            return r

        def fresh():
            r = orthogonal(rng.standard_normal(dim))
            return r / np.linalg.norm(r)

        tiny = (1e-14 * total) ** 0.5
        right.append(fresh())
        while True:
            z = right[-1] - (beta[-1] * short[-1] if beta else 0)
            t, length = self.product(z)
            for w, x in zip(short, back, strict=True):  # the part of X z along earlier left vectors
                h = float(w @ t)
                z, t, length = z - h * w, t - h * x, length - h * h
            a = max(length, 0.0) ** 0.5
            a = a if a > tiny else 0.0
            alpha.append(a)
            short.append(z / a if a else np.zeros(dim))
            back.append(t / a if a else np.zeros(dim))
            r = orthogonal(back[-1] - a * right[-1])
            b = float(np.linalg.norm(r))
            b = b if b > tiny else 0.0
            small = np.diag(alpha) + np.diag(beta, 1)
            p, sigma, q = np.linalg.svd(small)
            left = total - sum(x * x for x in alpha) - sum(x * x for x in beta)
            done = len(alpha) >= wanted and np.all(b * np.abs(p[-1, :wanted]) <= CONVERGED * sigma[0]) and left < (1 - 1e-9) * sigma[wanted - 1] ** 2
            if len(alpha) == dim or left <= 1e-13 * total or done:
                return sigma, np.stack(right, axis=1) @ q.T
            beta.append(b)
            right.append(r / b if b else fresh())


def whitened(rows: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every row with a finite vector, for each component.

    Vectors are x = floor(scale * c); entries that a shorter vector lacks count as 0.  The fit takes
    each distinct vector once.  Rows with a null vector or null or non-finite entries are left out;
    repeated rows and rows without vec_id are returned each.  Components of no spread (singular value
    below ``RANK`` of the first) are not returned: fewer than ``components`` in degenerate tables, no
    rows where all vectors are one, and none from an empty table.  The largest entry of a component
    is positive.
    """
    spark = rows.sparkSession
    lengths = staged(integer_vectors(rows, scale), "vectors")
    dim = (lengths.agg(F.max(F.octet_length("x"))).first()[0] or 0) // 4
    if not dim:
        return spark.createDataFrame([], _OUT)
    zeros = F.rpad("x", F.lit(4 * dim), F.unhex(F.lit("00")))
    vectors = lengths.select("vec_id", zeros.alias("x"))
    fit = Fit(vectors, dim)
    if not fit.spread:
        return spark.createDataFrame([], _OUT)
    sigma, basis = fit.bidiagonalise(components)
    keep = min(components, int((sigma > RANK * sigma[0]).sum()))
    sigma, basis = sigma[:keep], basis[:, :keep]
    basis = basis * np.where(basis[np.abs(basis).argmax(axis=0), np.arange(keep)] < 0, -1, 1)
    n, sums, mean = fit.n, fit.sums, fit.mean
    turn = basis * (np.sqrt(n) / sigma)

    def moments(x):
        y = (x - mean) @ turn
        return np.concatenate([y.sum(axis=0), (y.T @ y).ravel()])

    got = _parts(fit.packed, fit.tasks, dim, moments) / n
    covariance = got[keep:].reshape(keep, keep) - np.outer(got[:keep], got[:keep])
    error = float(np.abs(covariance - np.eye(keep)).max())
    explained = [float(s * s / (fit.spread / n)) for s in sigma]

    def project(batches):
        for b in batches:
            x = matrix(b.column(1), dim)
            most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
            wide = dim * most * most >= 1 << 63
            d = x.astype(object if wide else np.int64) * n - np.array(sums, object if wide else np.int64)
            deviation = pa.array((d * d).sum(axis=1).tolist() if len(x) else [], pa.int64())  # fails beyond a long
            y = (x - mean) @ turn
            for c in range(keep):
                same = lambda v, kind: pa.array(np.full(len(x), v), kind)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([b.column(0), same(c + 1, pa.int32()), same(n, pa.int64()), deviation, pa.array(np.ascontiguousarray(y[:, c])),
                                                  same(explained[c], pa.float64()), same(error, pa.float64())],
                                                 ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(project, _OUT)
