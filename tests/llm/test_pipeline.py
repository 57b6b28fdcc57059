from __future__ import annotations

import brute as B

from pyspark.sql import functions as F

import corpus_pipeline as P
from routeledger.llm.common import staged


def test_stages_filter_and_keep_columns(corpus_spark):
    d = "/root/testdata/sf0.001"
    docs = corpus_spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    judge = {
        "exact dedup": lambda rows: {min(x for x, u in rows if _norm(u) == _norm(t)) for _, t in rows},
        "MinHash near-dedup": lambda rows: {i for i, n, c in B.components(rows) if c == i or not n},
        "benchmark decontamination": lambda rows: {r[0] for r in B.contamination(rows, [tuple(r) for r in corpus_spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]) if not r[5]},
    }
    for name, stage in P.STAGES[:-1]:
        before = B.rows(docs)
        docs = staged(stage(corpus_spark, docs, d), "test-stage")
        assert docs.columns == columns
        after = B.rows(docs)
        assert set(after) <= set(before)
        if name in judge:
            assert {i for i, _ in after} == judge[name](before), name
    packed = P.STAGES[-1][1](corpus_spark, docs, d)
    assert packed.select("doc_id").distinct().count() == docs.count()


def _norm(t):
    import re
    return re.sub(r"[\x20\x09-\x0D]+", " ", t)


def test_repeated_rows_leave_one(corpus_spark, edge):
    rows = B.rows(P.exact_stage(corpus_spark, edge, ""))
    assert len(rows) == len({_norm(t) for _, t in B.rows(edge)})
    assert P.exact_stage(corpus_spark, edge, "").columns == edge.columns


def test_stages_take_empty_tables(corpus_spark, nothing):
    d = "/root/testdata/sf0.001"
    for _, stage in P.STAGES:
        assert stage(corpus_spark, nothing, d).count() == 0


def test_stages_judge_rows_of_null_and_repeated_ids(corpus_spark, edge):
    d = "/root/testdata/sf0.001"
    item = corpus_spark.read.parquet(f"{d}/benchmark.parquet").select("text").where("length(text) > 80").first()["text"]
    base = next(t for i, t in B.rows(edge) if i == 1).split()
    near = " ".join([*base[:20], "vessels", *base[21:]])
    extra = [(None, "a second row without an id"), (30, near), (30, "quite another text under that id"), (31, item), (31, "clean words under that id"), (None, near)]
    rows = corpus_spark.createDataFrame(extra, "doc_id long, text string")
    docs = edge.unionByName(rows, allowMissingColumns=True).cache()
    before = B.rows(docs)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = P.near_stage(corpus_spark, docs, d)
    assert got.columns == edge.columns
    after = sorted(B.rows(got), key=key)
    groups = B.components([(k, t) for k, (_, t) in enumerate(before)])
    want = [min((before[k] for k, _, c in groups if c == g), key=key) for g in {c for _, _, c in groups}]
    assert after == sorted(want, key=key) and (None, "a second row without an id") in after and (30, near) not in after
    after = B.rows(P.benchmark_stage(corpus_spark, docs, d))
    items = [tuple(r) for r in corpus_spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(after, key=key) == sorted((r for r, c in zip(before, B.contamination(before, items), strict=True) if not c[5]), key=key)
    assert (31, item) not in after and (31, "clean words under that id") in after
    from routeledger.llm import quality
    from routeledger.llm.common import table
    model = quality.fit(docs, table(corpus_spark, d, "labels"))
    scored = quality.score(corpus_spark.createDataFrame(list(enumerate(t for _, t in before)), "doc_id long, text string"), model)
    good = {r["doc_id"] for r in scored.collect() if r["predicted"] == 1}
    assert sorted(B.rows(P.quality_stage(corpus_spark, docs, d)), key=key) == sorted((r for k, r in enumerate(before) if k in good), key=key)


def test_columns_of_any_name_stay(corpus_spark, edge):
    d = "/root/testdata/sf0.001"
    names = ["_key", "__key", "key", "row", "_doc_id", "one", "a.b", "first", "component_id2"]
    docs = edge
    for k, n in enumerate(names):
        docs = docs.withColumn(n, F.lit(k))
    for name, stage in P.STAGES[:-1]:
        got = stage(corpus_spark, docs, d)
        assert got.columns == docs.columns, name
        rows = got.collect()
        assert (rows or name == "quality classifier") and all(r[n] == k for r in rows for k, n in enumerate(names)), name
