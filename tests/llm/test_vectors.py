"""Whitening, clustering and top-k search against plain forms, on real vectors and on edge rows."""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from routeledger.llm import maxscore, shallot, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, first int, q long, component int"


def _rows(spark, vectors):
    # further columns whose names the operators use inside
    return spark.createDataFrame([(i, v, 1, "x", 7, 9, 2) for i, v in vectors], SCHEMA).repartition(3)


def _edge(size=64, seed=3):
    rng = np.random.default_rng(seed)
    vectors = [(i, [float(np.float32(c)) for c in rng.normal(0, 0.2, size)]) for i in range(150)]
    vectors += [(i, vectors[3][1]) for i in (200, 201, 201)] + [(100, vectors[100][1])]  # copies, a repeated query row
    vectors += [(300, None), (301, [None] * size), (302, [math.nan] * size), (303, [1.0] * (size - 1) + [math.inf]), (400, [0.0] * size),
                (None, vectors[5][1]), (None, vectors[0][1]), (500, [-c for c in vectors[0][1]])]
    return vectors


def _good(vectors, size=None):
    return [(i, v) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v) and size in (None, len(v))]


@pytest.fixture(scope="module", params=["edge", "embeddings"])
def vectors(request, corpus_spark):
    if request.param == "edge":
        return _edge()
    return [(r[0], r[1]) for r in corpus_spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()]


def _plain_top(vectors, k=10, every=100, scale=1024):
    kept = [(i, [math.floor(scale * c) for c in v]) for i, v in _good(vectors)]
    out = []
    for r, (i, q) in enumerate(kept):
        if i is not None and i % every == 0:
            got = sorted(((-sum(a * b for a, b in zip(q, v, strict=False)), j is None, j or 0) for s, (j, v) in enumerate(kept) if s != r))[:k]
            out += [(i, n, None if none else j, -s) for n, (s, none, j) in enumerate(got, 1)]
    return out


_order = lambda r: tuple((x is not None, x) for x in r)


def test_top_k(corpus_spark, vectors, monkeypatch):
    monkeypatch.setattr(maxscore, "FIRST", 16)
    monkeypatch.setattr(maxscore, "BLOCK", 64)
    got = [tuple(r) for r in maxscore.top_k(_rows(corpus_spark, vectors), every=50, slice_rows=2).collect()]
    assert sorted(got, key=_order) == sorted(_plain_top(vectors, every=50), key=_order)


def test_top_k_of_few_and_ragged_rows(corpus_spark):
    vectors = [(0, [1.0, -1.0]), (1, [0.5]), (2, []), (3, [-0.25, 0.5, 9.0])]
    got = [tuple(r) for r in maxscore.top_k(_rows(corpus_spark, vectors)).collect()]
    assert sorted(got) == sorted(_plain_top(vectors))


def test_only_competitive_rows_are_returned():
    rng = np.random.default_rng(5)
    x = rng.integers(-300, 300, (900, 32))
    x[::3, :] *= rng.random((300, 32)) < 0.2  # sparse rows too
    index = maxscore.Postings(x)
    for query in x[:40]:
        scores = x @ query
        for least in (None, -5, 0, 1, int(np.sort(scores)[-10]), int(scores.max()) + 1):
            at, score = index.competitive(query, least)
            want = np.arange(900) if least is None or least <= 0 else np.flatnonzero(scores >= least)
            assert at.tolist() == want.tolist() and score.tolist() == scores[want].tolist()


def _plain_clusters(vectors, k=40, rounds=5, size=64):
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in _good(vectors, size)]
    pack = lambda v: np.array(v, "<i4").tobytes()
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), pack(r[1]))
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    x = np.array([v for _, v in kept], object)

    def nearest():
        d = [[int(((v - np.array(c, object)) ** 2).sum()) for c in centroids] for v in x]
        return [min(range(len(r)), key=lambda j: (r[j], j)) for r in d], [min(r) for r in d]

    for _ in range(rounds):
        at, _d = nearest()
        members = defaultdict(list)
        for v, c in zip(x, at, strict=True):
            members[c].append(v)
        centroids = [[s // len(members[c]) for s in sum(members[c])] if c in members else centroids[c] for c in range(len(centroids))]
    at, d = nearest()
    inertia = defaultdict(int)
    for c, s in zip(at, d, strict=True):
        inertia[c] += s
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, c, s, inertia[c], sum(d), digest[c]) for (i, _), c, s in zip(kept, at, d, strict=True)]


def test_clusters(corpus_spark, vectors):
    got = [tuple(r)[:6] for r in shallot.clusters(_rows(corpus_spark, [*vectors, (9999, [1.0, 2.0])])).collect()]
    assert sorted(got, key=_order) == sorted(_plain_clusters(vectors), key=_order)


@pytest.mark.parametrize("n", [1, 2, 5])
def test_clusters_of_few_rows(corpus_spark, n):
    vectors = _edge()[:n]
    got = [tuple(r)[:6] for r in shallot.clusters(_rows(corpus_spark, vectors)).collect()]
    assert sorted(got) == sorted(_plain_clusters(vectors))


def test_search_keeps_exact_bounds_over_rounds():
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.integers(-40, 40, (300, 8)), np.repeat(rng.integers(-3, 3, (20, 8)), 5, axis=0)]).astype(np.int32)
    centroids, before = x[::23].astype(np.int64), None
    state = (np.full(len(x), -1), np.full(len(x), -1), np.zeros(len(x)), np.zeros(len(x)))
    for _ in range(8):
        state = shallot.Search(centroids, before).assign(x, *[s.copy() for s in state])
        d = np.stack([shallot.square(x, c) for c in centroids], axis=1)
        assert state[0].tolist() == d.argmin(axis=1).tolist()
        rest = np.where(np.arange(len(centroids)) == state[0][:, None], np.iinfo(np.int64).max, d).min(axis=1)
        assert (state[2] ** 2 >= d.min(axis=1)).all() and (np.maximum(state[3], 0) ** 2 <= rest).all()
        before = centroids
        centroids = np.stack([np.floor_divide(x[state[0] == c].sum(axis=0), max((state[0] == c).sum(), 1)) if (state[0] == c).any() else before[c] for c in range(len(before))])


def _check_whitening(got, vectors, components=4):
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in _good(vectors)]
    dim = max(len(v) for _, v in kept)
    rows = [(i, v + [0] * (dim - len(v))) for i, v in kept]
    fit = sorted({tuple(v) for _, v in rows})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    x = np.array(fit, float) - np.array(sums) / n
    cov = x.T @ x / n
    e, vec = np.linalg.eigh(cov)
    e, vec = e[::-1], vec[:, ::-1]
    assert len(got) == len(rows) * components
    want = defaultdict(list)
    for i, v in rows:
        want[i].append((sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)), (np.array(v) - np.array(sums) / n) @ vec[:, :components] / np.sqrt(e[:components])))
    for c in range(components):
        mine = [g for g in got if g["component"] == c + 1]
        assert all(g["n"] == n for g in mine)
        assert {(g["vec_id"], g["deviation"]) for g in mine} == {(i, d) for i, w in want.items() for d, _ in w}
        assert all(abs(g["explained"] / (e[c] / np.trace(cov)) - 1) < 1e-9 and g["identity_error"] < 1e-9 for g in mine)
        first = next(g for g in mine if abs(g["whitened"]) > 0.5 and len(want[g["vec_id"]]) == 1)
        sign = np.sign(first["whitened"] * want[first["vec_id"]][0][1][c])
        for g in mine:
            assert min(abs(sign * g["whitened"] - w[c]) for _, w in want[g["vec_id"]]) < 1e-8


def test_whitening(corpus_spark, vectors):
    _check_whitening(whitening.whitened(_rows(corpus_spark, vectors)).collect(), vectors)


def test_whitening_of_equal_spreads_and_short_rows(corpus_spark):
    # Four equal eigenvalues: one start vector alone would find one of them.
    cross = [(10 * d + s, [float(s - 1) * 8 if k == d else 0.0 for k in range(6)][:6 - (d == 0)]) for d in range(6) for s in (0, 2)]
    got = whitening.whitened(_rows(corpus_spark, cross)).collect()
    assert len(got) == 48 and all(g["identity_error"] < 1e-9 and abs(g["explained"] - 1 / 6) < 1e-9 for g in got)


def test_whitening_stops_early_in_a_steep_spectrum(corpus_spark, monkeypatch):
    rng = np.random.default_rng(2)
    low = rng.normal(0, 1, (400, 5)) * [16, 8, 4, 2, 0.001]
    turn = np.linalg.qr(rng.normal(0, 1, (48, 48)))[0][:5]
    vectors = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(low @ turn)]
    steps, plain = [], whitening.Fit.product
    monkeypatch.setattr(whitening.Fit, "product", lambda self, z: steps.append(1) or plain(self, z))
    _check_whitening(whitening.whitened(_rows(corpus_spark, vectors)).collect(), vectors)
    assert len(steps) < 30


@pytest.mark.parametrize("vectors", [[], [(1, None)], [(1, [])], [(1, [math.nan])]])
def test_tables_without_vectors(corpus_spark, vectors):
    rows = _rows(corpus_spark, vectors) if vectors else corpus_spark.createDataFrame([], SCHEMA)
    assert whitening.whitened(rows).count() == shallot.clusters(rows).count() == maxscore.top_k(rows).count() == 0


def test_one_vector_has_no_components(corpus_spark):
    assert whitening.whitened(_rows(corpus_spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])])).count() == 0


@pytest.mark.parametrize("run", [whitening.whitened, maxscore.top_k])
def test_entries_beyond_the_range_fail(corpus_spark, run):
    with pytest.raises(Exception, match="reaches"):
        run(_rows(corpus_spark, [(0, [1e30, 0.0]), (1, [0.0, 1.0])])).count()
