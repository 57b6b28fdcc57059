"""Training-corpus pipeline: quality, exact and near duplicates, contamination, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents; the last returns the packed pieces.
A stage judges every row that its predecessor kept.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeledger.llm import bottomk, digest_index, packing, positional_index, quality
from routeledger.llm.common import drop_work, ship_package, staged, table, work_mark, work_since
from routeledger.session import materialize

#: The quality vote is not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


#: Work folders of the stage that ran last.
_LAST: list[str] = []


def _stage(first: bool = False):
    """A stage that begins by dropping the work tables of the one before: that one's rows, its docs, are written by now.
    The first stage drops nothing."""
    def deco(fn):
        @functools.wraps(fn)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            ship_package(spark)
            if not first:
                drop_work(spark, _LAST)
            mark = work_mark()
            out = fn(spark, docs, sf_dir)
            _LAST[:] = work_since(mark)
            return out
        return run_stage
    return deco


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` written as (row, key): whole rows, whatever their columns' names, each with a number that stands for the doc_id in a stage's
    verdicts (doc_ids may be null or repeated)."""
    row = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])
    return staged(docs.select(row.alias("row"), F.monotonically_increasing_id().alias("key")), "keyed")


def _by_key(keyed: DataFrame) -> DataFrame:
    return keyed.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text"))


def _rows_of(keyed: DataFrame, kept: DataFrame) -> DataFrame:
    """By a sort-merge join at every size: the rows whose number is in ``kept(doc_id)``."""
    return keyed.join(kept.select(F.col("doc_id").alias("key")).hint("merge"), "key", "left_semi").select("row.*")


def _least(keyed: DataFrame, groups: DataFrame) -> DataFrame:
    """Of each group of ``groups(key, one)`` the row with the least doc_id (a null one last)."""
    named = keyed.select("key", F.col("row.doc_id").cast("long").alias("doc_id")).hint("merge").join(groups, "key")
    first = named.groupBy("one").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"))
    return _rows_of(keyed, staged(first.select(F.col("first.key").alias("doc_id")), "firsts"))


@_stage(first=True)
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the vote predicts to be good."""
    keyed = _keyed(docs)
    scores = quality.score(_by_key(keyed), quality.fit(keyed.select("row.doc_id", "row.text"), table(spark, sf_dir, "labels")))
    return _rows_of(keyed, staged(scores.where("predicted = 1").select("doc_id"), "good"))


@_stage()
def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal normalised texts the one with the least doc_id (a null one last), one row."""
    keyed = _keyed(docs)
    return _least(keyed, digest_index.exact_duplicates(_by_key(keyed)).select(F.col("doc_id").alias("key"), F.col("keep_id").alias("one")))


@_stage()
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the document with the least doc_id (a null one last), one row."""
    keyed = _keyed(docs)
    return _least(keyed, bottomk.near_duplicates(_by_key(keyed)).select(F.col("doc_id").alias("key"), F.col("component_id").alias("one")))


@_stage()
def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    keyed = _keyed(docs)
    found = positional_index.contamination(_by_key(keyed), table(spark, sf_dir, "benchmark"))
    return _rows_of(keyed, staged(found.where("not contaminated").select("doc_id"), "clean"))


@_stage()
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, packed."""
    return packing.pack_documents(docs)


STAGES = [("quality classifier", quality_stage), ("exact dedup", exact_stage), ("MinHash near-dedup", near_stage),
          ("benchmark decontamination", benchmark_stage), ("best-fit packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
