"""Session settings the operators assume, and the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings every operator relies on: UTC wall clock (Q1/Q3), ANSI
# arithmetic, adaptive execution (runtime broadcast conversion, partition
# coalescing, skew-join splitting).  Broadcasts happen only through the
# size-checked threshold below, never by an unconditional hint on a table
# that grows with the data.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    # The driver holds every broadcast side, several at once in a plan of many branches.  Before a run the sizes are
    # those of compressed files (a row of ids is a byte or two there, some 50 as a hash table); at run time they are real.
    "spark.sql.autoBroadcastJoinThreshold": str(1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(4 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  checkpoint_fallback: str | None = None, app: str = "routeledger",
                  extra: dict | None = None) -> SparkSession:
    """Local/test session.  On a cluster, pass the same SESSION_CONF through
    spark-submit and size ``spark.sql.shuffle.partitions`` to the data."""
    b = SparkSession.builder.master(master).appName(app)
    for k, v in SESSION_CONF.items():
        b = b.config(k, v)
    b = (b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
          .config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false")
          .config("spark.driver.memory", "16g"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_conf(spark)
    ensure_checkpoint_dir(spark, checkpoint_fallback)
    return spark


def apply_conf(spark: SparkSession) -> None:
    """Apply the runtime SQL settings to an existing session."""
    for k, v in SESSION_CONF.items():
        spark.conf.set(k, v)


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins.  ``fallback`` is used only when the
    session names none (tests, local runs)."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = sc.getConf().get("spark.checkpoint.dir", None)
    target = named or fallback
    if not target:
        raise RuntimeError("spark.checkpoint.dir is unset; point it at a folder shared by all executors")
    sc.setCheckpointDir(target)
    return sc.getCheckpointDir() or target


#: Work folders that this application has written, in order.
_WRITTEN: list[str] = []


def written() -> int:
    """A mark for ``drop_written``."""
    return len(_WRITTEN)


def drop_written(spark: SparkSession, since: int) -> None:
    """Delete the work tables that ``materialize`` wrote since the mark, once no DataFrame on them is used any more."""
    drop_tables(spark, since)


def last_written() -> str:
    """Folder of the work table that ``materialize`` wrote last."""
    return _WRITTEN[-1]


def drop_tables(spark: SparkSession, since: int, but: tuple = ()) -> None:
    """Delete the work tables that ``materialize`` wrote since the mark, those in ``but`` excepted."""
    kept = [folder for folder in _WRITTEN[since:] if folder in but]
    for folder in _WRITTEN[since:]:
        if folder not in but:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _WRITTEN[since:] = kept


def materialize(df, label: str):
    """Cut lineage by writing ``df`` as a Parquet table in the shared
    checkpoint folder and reading it back (one job; ``Dataset.checkpoint``
    would compute its input twice).  Survives lost executors."""
    import uuid
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/routeledger/{label}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
