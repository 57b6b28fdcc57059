"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms are hashed byte trigrams of the whole text, hashed shapes (four characters by
kind: capital, small, digit, blank, each mark itself) and how often words repeat.
Sublinear, idf-weighted rows of a bounded, balanced sample of labelled documents
(``per_class`` each) are reduced by a truncated SVD; the sample's vectors (at most
2 * per_class * rank numbers) go to every task.  Every document's cosine with all of
them is an exact product, block by block; its nearest ``neighbours`` vote with their
similarity, and votes of a class weigh as the class does among all labelled rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordhash as W
from .common import row_blocks, staged, text_buffer, texts

GRAMS, SHAPES, REPEATS = 1 << 12, 1 << 9, 16
DIM = GRAMS + SHAPES + REPEATS
PER_CLASS, RANK, NEIGHBOURS, POWER, THRESHOLD = 1500, 64, 25, 8, 0.7

_KIND = np.arange(256, dtype=np.uint32)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 3, 2
_KIND[[9, 10, 11, 12, 13, 32]] = 4


def held_out(doc_id: Column | str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """rows x DIM term counts (as logarithms)."""
    rows, lens = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((rows, DIM), np.float32)
    if len(data):
        row = np.repeat(np.arange(rows, dtype=np.int64), lens)
        d = data.astype(np.uint32)
        if len(d) > 2:
            h = (d[:-2] * np.uint32(0x9E3779B1) ^ d[1:-1] * np.uint32(0x85EBCA77) ^ d[2:] * np.uint32(0xC2B2AE3D))
            h = (h * np.uint32(0x27D4EB2F)) >> np.uint32(20)
            ok = row[:-2] == row[2:]
            out[:, :GRAMS] = np.bincount(row[:-2][ok] * GRAMS + h[ok], minlength=rows * GRAMS).reshape(rows, GRAMS)
        if len(d) > 3:
            k = _KIND[data]
            h = ((k[:-3] * np.uint32(131) + k[1:-2]) * np.uint32(137) + k[2:-1]) * np.uint32(139) + k[3:]
            h = (h * np.uint32(0x9E3779B1)) >> np.uint32(23)
            ok = row[:-3] == row[3:]
            out[:, GRAMS:GRAMS + SHAPES] = np.bincount(row[:-3][ok] * SHAPES + h[ok], minlength=rows * SHAPES).reshape(rows, SHAPES)
        hashes, at = W.words(data, offsets, W.SPACE)
        n = np.diff(at)
        owner = np.repeat(np.arange(rows), n)
        order = np.lexsort((hashes, owner))
        same = (hashes[order][1:] == hashes[order][:-1]) & (owner[order][1:] == owner[order][:-1])
        repeated = np.bincount(owner[order][1:][same], minlength=rows) / np.maximum(n, 1)
        some = np.flatnonzero(n)
        out[some, GRAMS + SHAPES + np.minimum((repeated[some] * REPEATS).astype(int), REPEATS - 1)] = 20
    return np.log1p(out)


def _rows(col: pa.Array):
    data, offsets = text_buffer(col)
    for i, j in row_blocks(offsets):
        for a in range(i, j, 512):  # a block of at most 512 rows, whatever their length
            b = min(a + 512, j)
            yield a, features(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])


class QualityModel:
    """idf, projection and labelled vectors; ``rate`` is the share of label 1 among all labelled rows.

    ``x`` (rows x DIM) is weighted in place, the one large array of the fit."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rate: float, rank: int = RANK):
        self.rate = rate
        self.y = y.astype(np.float32)
        self.idf = np.log((1 + len(x)) / (1 + np.count_nonzero(x, axis=0))).astype(np.float32) + 1
        x *= self.idf
        x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]
        rng = np.random.default_rng(7)
        q = rng.standard_normal((x.shape[1], min(rank + 16, max(len(x), 1)))).astype(np.float32)
        for _ in range(4):
            q, _r = np.linalg.qr(x.T @ (x @ q))
        _u, _s, v = np.linalg.svd(x @ q, full_matrices=False)
        self.basis = np.ascontiguousarray(q @ v[:rank].T).astype(np.float32)
        self.vectors = self._unit(x @ self.basis)
        share = max(float(self.y.mean()), 1e-6) if len(y) else 1.0
        self.weight = np.where(self.y > 0, rate / share, (1 - rate) / max(1 - share, 1e-6)).astype(np.float32)

    @classmethod
    def of(cls, rate: float, y, idf, basis, vectors, weight) -> QualityModel:
        """A model of fitted parts."""
        model = cls.__new__(cls)
        model.rate, model.y, model.idf, model.basis, model.vectors, model.weight = rate, y, idf, basis, vectors, weight
        return model

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def _weigh(self, x: np.ndarray) -> np.ndarray:
        return self._unit(x * self.idf)

    def score(self, x: np.ndarray, neighbours: int = NEIGHBOURS, power: int = POWER) -> np.ndarray:
        some = x.any(axis=1)
        cos = np.maximum(self._unit(self._weigh(x) @ self.basis) @ self.vectors.T, 0)
        k = min(neighbours, cos.shape[1])
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        w = np.take_along_axis(cos, near, 1) ** power * self.weight[near]
        total = w.sum(1)
        vote = np.where(total > 0, (w * self.y[near]).sum(1) / np.maximum(total, 1e-12), self.rate)
        return np.clip(np.where(some, vote, self.rate), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> QualityModel | None:
    """Model of labels 0 and 1 (None unless both are there).

    Only rows that aren't held out are read; of each class the ``per_class`` labelled documents
    that come first by a hash of doc_id, then doc_id and features, make the sample (several labels of
    one document all count).  The class shares come from all labelled rows.  One task of an executor
    weighs and projects the sample (at most 2 * per_class * DIM numbers); the driver gets
    basis, vectors and weights alone.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where(
        F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    counts = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if set(counts) != {0, 1}:
        return None
    rate = counts[1] / (counts[0] + counts[1])
    by = [F.xxhash64("doc_id"), "doc_id"]
    picked = [marks.where(F.col("y") == c).orderBy(*by).limit(per_class) for c in (0, 1)]
    sample = texts(docs).join(picked[0].unionByName(picked[1]), "doc_id").select("doc_id", "y", "text")

    def vectors(batches):
        for b in batches:
            for a, x in _rows(b.column(2)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, len(x)), b.column(1).slice(a, len(x)), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())],
                                                 ["doc_id", "y", "x"])

    given = staged(sample.mapInArrow(vectors, "doc_id long, y int, x binary"), "quality-sample")
    parts = [given.where(F.col("y") == c).orderBy(*by, "x").limit(per_class) for c in (0, 1)]
    bound = parts[0].unionByName(parts[1]).select(F.lit(0).alias("one"), "y", "x")

    def train(part: pa.Table) -> pa.Table:
        rows = [(y, r.as_buffer()) for y, r in zip(part.column("y").to_pylist(), (r for c in part.column("x").chunks for r in c), strict=True)]
        rows.sort(key=lambda r: (r[0], r[1].to_pybytes()))  # the same model whatever order the rows came in
        x = np.empty((len(rows), DIM), np.float32)
        for k, (_, r) in enumerate(rows):
            x[k] = np.frombuffer(r, np.float16)
        m = QualityModel(x, np.array([y for y, _ in rows], np.float32), rate)
        out = [m.y, m.idf, m.basis, m.vectors, m.weight]
        return pa.table({"at": pa.array(range(len(out)), pa.int32()), "rows": pa.array([len(o) for o in out], pa.int32()), "v": pa.array([o.astype(np.float32).tobytes() for o in out], pa.binary())})

    got = {r["at"]: np.frombuffer(r["v"], np.float32).reshape(r["rows"], -1) for r in bound.groupBy("one").applyInArrow(train, "at int, rows int, v binary").collect()}
    if not got or len(set(got[0].ravel().tolist())) < 2:
        return None
    return QualityModel.of(rate, got[0].ravel(), got[1].ravel(), got[2], got[3], got[4].ravel())


def score(docs: DataFrame, model: QualityModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document row: doc_id, held_out, score, predicted.

    Null and empty texts get the share of label 1 among labelled rows.  Without a model
    (no usable labels) every score is 0.5.  An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by per_class, RANK and DIM

    def run(batches):
        m = shared.value
        for b in batches:
            got = [m.score(x) if m else np.full(len(x), 0.5) for _, x in _rows(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(got) if got else np.zeros(0), pa.float64())], ["doc_id", "score"])

    out = texts(docs).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"))
