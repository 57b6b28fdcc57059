"""Exact deduplication against a persistent digest index, bucketed and sorted by digest.

The index is a bucketed table: one row per distinct normalised text and the batch in
which it came, (digest, keep_id, batch).  A new batch is reduced to one row per
digest (partial counts and minima before the shuffle), sort-merge anti-joined with
the index, and what is new is appended.  The index side is read by its buckets and takes
no shuffle.  All comparing is done on 32-byte SHA-256 digests; texts stay
where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, work_path

#: Least number of buckets of a new index.
BUCKETS = 64


def digest(text: Column | str) -> Column:
    """SHA-256 of the text (null: empty) with every run of ASCII white space replaced by one space."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.unhex(F.sha2(F.regexp_replace(t, r"[\x20\x09-\x0D]+", " ").cast("binary"), 256))


class DigestIndex:
    """A digest index kept as the bucketed table ``name`` at ``path`` (made if it isn't there).

    A new index takes as many buckets as the session has shuffle partitions (at least
    ``BUCKETS``), so that a batch reduced by digest already lies as the buckets do and
    each task writes one file; an index that is there keeps the number it was made with.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int | None = None):
        self.spark, self.name, self.path = spark, name, path
        if spark.catalog.tableExists(name):
            said = spark.sql(f"describe extended {name}").where("col_name = 'Num Buckets'").first()
            self.buckets = int(said["data_type"])
        else:
            self.buckets = buckets or max(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
            self._write(spark.createDataFrame([], "digest binary, keep_id long, batch int"))

    def _write(self, rows: DataFrame) -> None:
        (rows.repartition(self.buckets, "digest").write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
         .option("path", self.path).mode("append").saveAsTable(self.name))

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def forget(self) -> None:
        """Take the table out of the catalog; its files, and DataFrames that read them, stay."""
        self.spark.sql(f"drop table if exists {self.name}")

    def add(self, digests: DataFrame, batch: int) -> None:
        """Append the digests of ``digests(doc_id, digest)`` that the index lacks, each with its least doc_id."""
        least = digests.groupBy("digest").agg(F.min("doc_id").alias("keep_id"))
        new = least.hint("merge").join(self.table().hint("merge"), "digest", "left_anti")
        self._write(staged(new.withColumn("batch", F.lit(batch)).select("digest", "keep_id", "batch"), "new-digests"))


def decisions(digests: DataFrame, index: DataFrame) -> DataFrame:
    """``digests(doc_id, digest)`` with keep_id and group_size.

    Texts that stand alone (most) are not joined at all on their group's side: only
    groups of two or more are, and a group of any size is spread by adaptive
    execution, since its rows are only probed.
    """
    groups = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    kept = groups.join(index.select("digest", "keep_id"), "digest")
    shared = staged(kept.where("group_size > 1"), "groups")
    return digests.join(shared, "digest", "left").select(
        "doc_id", "digest", F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"))


def exact_duplicates(docs: DataFrame, batches: int = 2) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    The documents are taken into a fresh index in ``batches`` batches of ascending
    doc_id, so that of equal texts the least doc_id is the one that stays.  Null and
    blank-only texts are texts like any other (null equals empty).  If rows repeat with
    the same doc_id and text, each is marked kept where its doc_id is the kept one.
    An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    path = work_path(spark, "digest-index")
    rows = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text").cast("string")).alias("digest")), "digests")
    index = DigestIndex(spark, "digest_index_" + path.rsplit("-", 1)[-1], path)
    span = rows.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    if span["lo"] is not None:
        width = (span["hi"] - span["lo"]) // batches + 1
        for b in range(batches):
            lo = span["lo"] + b * width
            part = rows.where(F.col("doc_id").between(lo, lo + width - 1))
            index.add(part if b else rows.where(F.col("doc_id").isNull() | (F.col("doc_id") < lo + width)), b)
    elif not rows.isEmpty():
        index.add(rows, 0)
    out = decisions(rows, index.table())
    index.forget()
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
