"""F8, F9, U2, X7 by postings: contains-search over grams of one to three characters with exact verification.

``build`` writes one posting per distinct gram of every searched text, lower-cased as ``ilike`` does it, and the empty
gram for terms of wildcards only.  A posting carries its text and what the searches return, so a search reads one list,
the rarest among the term's grams, and tests each text with the very predicate of X7: the result is that of ``ilike``
for terms of any length.  Lists are stored by bucket of the gram and sorted by it: the bucket prunes folders, the gram
row groups, and a long list (a single common letter) is many files.

    path/postings/bucket=<i>/    path/counts/bucket=<i>/    path/marks   (written last: without it there is no index)

An index belongs to the version of the tables it was built from (see S5 for versions).  Searched texts are names, codes,
vehicle numbers and notes; the distinct values of the latter two are indexed, not their movements.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import date_range, where
from ..functions.scalars import contains_ci
from ..sources.sinks import _whole
from ..tables import Tables
from . import listings as L

TEXT_SCHEMA = "kind string, field string, id bigint, text string, code string, name string, is_active int"
SIZES = (1, 2, 3)

#: kind -> (table, searched columns) of the records, and of the movements' own texts.
RECORDS = {"product": ("products", ("code", "name")), "salesperson": ("salespersons", ("code", "name")),
           "shop": ("shops", ("code", "name", "owner_name"))}
MOVEMENTS = {"issue": ("stock_issues", "vehicle_number"), "return": ("stock_returns", "notes")}


def searched_texts(t: Tables) -> DataFrame:
    """The texts of F8, F9 and U2, one row per record and column, and per distinct value of a movement's column."""
    parts = []
    for kind, (table, cols) in RECORDS.items():
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in cols]))
        parts.append(t.get(table).select(F.lit(kind).alias("kind"), "id", "code", "name", F.col("is_active").cast("int").alias("is_active"), pairs.alias("_p"))
                     .select("kind", "_p.field", "id", "_p.text", "code", "name", "is_active"))
    none = F.lit(None)
    for kind, (table, col) in MOVEMENTS.items():
        parts.append(t.get(table).select(F.col(col).alias("text")).distinct().select(
            F.lit(kind).alias("kind"), F.lit(col).alias("field"), none.cast("bigint").alias("id"), "text",
            none.cast("string").alias("code"), none.cast("string").alias("name"), none.cast("int").alias("is_active")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("text is not null")


def _grams(text: Column) -> Column:
    """Distinct grams of a lower-cased text, the empty one among them."""
    n = F.length(text)
    runs = [F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(k))))
            .otherwise(F.array().cast("array<string>")) for k in SIZES]
    return F.array_distinct(F.concat(F.array(F.lit("")), *runs))


def _bucket(gram: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(n)).cast("int")


def build(texts: DataFrame, path: str, buckets: int = 64) -> None:
    """Write the index of ``texts`` (``TEXT_SCHEMA``); NULL texts match nothing and have no posting."""
    spark, path = texts.sparkSession, path.rstrip("/")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.filter("text is not null").withColumn("gram", F.explode(_grams(F.lower("text")))).withColumn("bucket", _bucket(F.col("gram"), buckets))
    order = ["bucket", "gram", "kind", "id", "text"]
    # By bucket and a share of its texts, so that a long list is many tasks.  By hash: ranges would need a sample, and every gram made twice.
    share = F.pmod(F.xxhash64("kind", "field", "id", "text"), F.lit(-(-4 * n // buckets)))
    rows.repartition(n, "bucket", share).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    held = spark.read.schema(f"gram string, {TEXT_SCHEMA}, bucket int").parquet(f"{path}/postings")
    (held.groupBy("bucket", "gram").agg(F.count(F.lit(1)).alias("n")).repartition("bucket")
     .sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/counts"))
    spark.createDataFrame([(str(buckets),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/marks")


def _term_grams(term: str) -> list[str]:
    """Grams that every match of a lower-cased term holds; ``%`` and ``_`` are wildcards as in X7."""
    found = set()
    for run in re.split("[%_]", term):
        found |= {run[i:i + 3] for i in range(len(run) - 2)} if len(run) >= 3 else {run}
    return sorted(found - {""}) or [""]


def matches(spark: SparkSession, path: str, term: str) -> DataFrame:
    """The indexed texts that contain ``term`` (any case): rows of ``TEXT_SCHEMA``, read from one list."""
    path = path.rstrip("/")
    if not _whole(spark, f"{path}/marks"):
        raise FileNotFoundError(f"no complete index at {path}")
    n = int(spark.read.text(f"{path}/marks").first()["value"])
    lowered = spark.range(1).select(F.lower(F.concat(F.lit("%"), F.lit(term), F.lit("%")))).first()[0]
    grams = _term_grams(lowered)
    # As many rows as the term has grams.
    counts = spark.read.schema("gram string, n bigint, bucket int").parquet(f"{path}/counts")
    there = counts.filter(F.col("bucket").isin(_buckets(spark, grams, n)) & F.col("gram").isin(grams)).collect()
    held = spark.read.schema(f"gram string, {TEXT_SCHEMA}, bucket int").parquet(f"{path}/postings")
    columns = ["kind", "field", "id", "text", "code", "name", "is_active"]
    if len(there) < len(grams):
        return held.filter(F.lit(False)).select(*columns)
    rarest = min(there, key=lambda r: (r["n"], r["gram"]))
    return held.filter((F.col("bucket") == rarest["bucket"]) & (F.col("gram") == rarest["gram"]) & contains_ci("text", term)).select(*columns)


def _buckets(spark: SparkSession, grams: list[str], n: int) -> list[int]:
    rows = spark.createDataFrame([(g,) for g in grams], "gram string").select(_bucket(F.col("gram"), n).alias("b")).collect()
    return sorted({r["b"] for r in rows})


# ---------------------------------------------------------------- searches
def search_products(spark: SparkSession, path: str, term: str) -> DataFrame:
    """F8 (id, code, name) from the postings alone."""
    hits = matches(spark, path, term).filter("kind = 'product' and is_active = 1")
    return hits.select("id", "code", "name").distinct().orderBy("name", "id")


def search_all(spark: SparkSession, path: str, term: str, k: int = 5) -> DataFrame:
    """U2 from the postings alone: the first k matches of each kind by (code, id); shops whatever their active flag."""
    hits = matches(spark, path, term)
    out = None
    for kind in RECORDS:
        rows = hits.filter(F.col("kind") == kind)
        if kind != "shop":
            rows = rows.filter("is_active = 1")
        top = rows.select(F.col("kind").alias("type"), "id", "code", "name").distinct().orderBy(F.asc_nulls_last("code"), "id").limit(k)
        out = top if out is None else out.unionByName(top)
    return out


def search_movements(t: Tables, path: str, kind: str, term: str | None, from_=None, to_=None) -> DataFrame:
    """issues (``kind`` issue) or returns (return) of a range of days whose product, salesperson or own text contains ``term``.

    What matches is found in the postings and met with the movements' keys first, each movement once; names are joined
    afterwards, to the movements found.  The movements themselves carry no index: their keys are scanned in the range."""
    table, own = MOVEMENTS[kind]
    m = where(t.get(table), date_range("date", from_, to_))
    if not term:
        return m
    hits = matches(m.sparkSession, path, term)
    sides = [("product", "product_id", "id"), ("salesperson", "salesperson_id", "id"), (kind, own, "text")]
    columns = m.columns
    for side, col, value in sides:
        found = hits.filter(F.col("kind") == side).select(F.col(value).alias(f"_{col}")).distinct().withColumn(f"_hit_{side}", F.lit(True))
        m = m.join(found, F.col(col) == F.col(f"_{col}"), "left").drop(f"_{col}")
    any_hit = F.coalesce(*[F.col(f"_hit_{side}") for side, _, _ in sides], F.lit(False))
    return m.filter(any_hit).select(*columns)


def issues_enriched(t: Tables, path: str, term: str | None, from_=None, to_=None, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """J9 with the search by postings."""
    return L.issues_enriched(t.with_tables(stock_issues=search_movements(t, path, "issue", term, from_, to_)), limit, offset)


def returns_enriched(t: Tables, path: str, term: str | None, from_=None, to_=None, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """J10 with the search by postings."""
    return L.returns_enriched(t.with_tables(stock_returns=search_movements(t, path, "return", term, from_, to_)), limit, offset)
