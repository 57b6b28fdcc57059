"""Contains-search by postings equals ``ilike`` for terms of any length and reads one list."""

from __future__ import annotations

import random

import pytest

from pyspark.sql import functions as F

from routeledger.functions.scalars import contains_ci
from routeledger.operators import activity, listings, text_index as X
from routeledger.functions import predicates as P

TEXTS = ["", "a", "Ab", "ΟΔΟΣ Σίσυφος", "İstanbul I ı", "straße STRASSE", "100% pure_x", r"back\slash", "日本語テキスト", "a😀b", "\ttab\n", "aaaa", None,
         "long " * 300 + "End"]


@pytest.fixture(scope="module")
def index(spark):
    import tempfile
    path = tempfile.mkdtemp(prefix="routeledger-test-")
    rnd = random.Random(7)
    texts = TEXTS + ["".join(rnd.choice("abAB 1%_\\") for _ in range(rnd.randint(0, 9))) for _ in range(60)]
    rows = [("product", "name", i, s, f"C{i}", s, 1) for i, s in enumerate(texts)]
    rows.append(("product", "code", 3, "C3", "C3", "twice", 1))
    df = spark.createDataFrame(rows, X.TEXT_SCHEMA).cache()
    X.build(df, path, buckets=8)
    return df, path


TERMS = ["a", "AB", "b1", "%", "_", "a%b", "a_b", "__", "%%", "\\", "\\s", "Σ", "σίσ", "ς", "İ", "i", "ß", "SS", "本語", "😀", "A😀B", "d", "g end", "zz", " ",
         "\t", "pure_X", "100%", "aaaa", "aaaaa", "long long long END"]


def test_equals_ilike(spark, index):
    df, path = index
    for term in TERMS:
        want = sorted((r.id, r.field) for r in df.filter(contains_ci("text", term)).collect())
        assert sorted((r.id, r.field) for r in X.matches(spark, path, term).collect()) == want, term


def test_random_terms(spark, index):
    df, path = index
    rnd = random.Random(11)
    for _ in range(15):
        term = "".join(rnd.choice("abB 1%_\\") for _ in range(rnd.randint(1, 5)))
        want = sorted((r.id, r.field) for r in df.filter(contains_ci("text", term)).collect())
        assert sorted((r.id, r.field) for r in X.matches(spark, path, term).collect()) == want, term


def plan(df) -> str:
    mode = df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_one_list_is_read(spark, index):
    text = plan(X.matches(spark, index[1], "aaaa"))
    assert "PartitionFilters: [isnotnull(bucket" in text and "EqualTo(gram,aaa)" in text and text.count("Scan parquet") == 2  # once in the tree
    assert "Python" not in text


def test_searches_equal_the_plain_ones(spark, star, scratch):
    X.build(X.searched_texts(star), scratch, buckets=8)
    for term in ("gear", "0000", "e", "x%1"):
        want = [tuple(r) for r in P.search_products(star, term).select("id", "code", "name").collect()]
        got = X.search_products(spark, scratch, term)
        assert [tuple(r) for r in got.collect()] == want
        assert "part.parquet" not in plan(got)
        assert sorted(map(tuple, X.search_all(spark, scratch, term, 4).collect())) == sorted(map(tuple, activity.search_all(star, term, 4).collect()))
    for term in ("gear", "V-1", "no such text", None):
        assert list(map(tuple, X.issues_enriched(star, scratch, term, "1998-01-01", "1998-06-30").collect())) == list(
            map(tuple, listings.issues_enriched(star, from_="1998-01-01", to_="1998-06-30", search=term).collect()))
    for term in ("note f", "supplier#"):
        assert list(map(tuple, X.returns_enriched(star, scratch, term, limit=30, offset=5).collect())) == list(
            map(tuple, listings.returns_enriched(star, 30, 5, search=term).collect()))


def test_movements_without_keys_and_unfinished_index(spark, seed, scratch):
    X.build(X.searched_texts(seed), f"{scratch}/x", buckets=4)
    none = seed.with_tables(stock_issues=seed.stock_issues.withColumn("product_id", F.lit(None).cast("bigint")))
    assert X.search_movements(none, f"{scratch}/x", "issue", "no such text").count() == 0
    X.build(X.searched_texts(seed).limit(0), f"{scratch}/none", buckets=4)
    assert X.search_products(spark, f"{scratch}/none", "a").count() == 0
    with pytest.raises(FileNotFoundError):
        X.search_products(spark, f"{scratch}/absent", "a")


def test_texts_are_read_once(spark, scratch):
    read = spark.sparkContext.accumulator(0)

    def name(i):
        read.add(1)
        return f"name {i}"
    name = F.udf(name, "string").asNondeterministic()  # so that a plan holds it once
    rows = spark.range(40).select(F.lit("shop").alias("kind"), F.lit("name").alias("field"), "id", name("id").alias("text"), F.lit("c").alias("code"),
                                  F.lit("n").alias("name"), F.lit(1).alias("is_active"))
    X.build(rows, scratch, buckets=4)
    assert X.matches(spark, scratch, "NAME 1").count() == 11 and read.value == 40
