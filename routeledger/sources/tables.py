"""S1 typed table reads and S2 additive schema evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import SCHEMAS
from ..tables import Tables


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Shape ``df`` to ``schema``.

    Missing columns get the column default (or NULL), columns of another
    type are ``try_cast`` (a bad value becomes NULL instead of failing the
    job), extra columns are dropped and the order follows ``schema``.
    Pure projection: no shuffle, and Catalyst prunes unused defaults."""
    present = {f.name: f.dataType for f in df.schema.fields}
    cols = []
    for f in schema.fields:
        if f.name not in present:
            default = f.metadata.get("default")
            cols.append(F.lit(default).cast(f.dataType).alias(f.name))
        elif present[f.name] == f.dataType:
            cols.append(F.col(f.name))
        else:
            cols.append(F.col(f.name).try_cast(f.dataType).alias(f.name))
    return df.select(*cols)


def rejects(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of ``df`` of which ``conform`` turns a given value into NULL, with the columns' names in ``bad_columns``."""
    types = {f.name: f.dataType for f in df.schema.fields}
    bad = [F.when(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull(), F.lit(f.name))
           for f in schema.fields if f.name in types and types[f.name] != f.dataType]
    if not bad:
        return df.limit(0).withColumn("bad_columns", F.array().cast("array<string>"))
    return df.withColumn("bad_columns", F.filter(F.array(*bad), lambda x: x.isNotNull())).filter(F.size("bad_columns") > 0)


def load_table(spark: SparkSession, path: str, name: str, fmt: str = "parquet") -> DataFrame:
    """Typed read of one field-sales table.

    Parquet is read with its own footer schema, then conformed (additive
    evolution; ``mergeSchema`` unifies old and new files in one folder).
    CSV columns are taken by their header names, as text, then conformed, so a
    file of an older or reordered layout reads right (one layout per call)."""
    schema = SCHEMAS[name]
    if fmt == "parquet":
        df = spark.read.option("mergeSchema", "true").parquet(path)
    elif fmt == "csv":
        df = spark.read.option("header", True).option("inferSchema", False).option("enforceSchema", False).csv(path)
    else:
        df = spark.read.format(fmt).load(path)
    return conform(df, schema)


def _once(df: DataFrame, **cols) -> DataFrame:
    """``df`` with more columns, each evaluated once a row: a filter on them isn't pushed below a generator, which would
    put their expressions in the place of every mention (a record would be parsed again for each of its columns)."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


#: Text of a CSV row that doesn't split into the header's columns.
_BROKEN = "_broken_row"


def _csv_values(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """Rows of CSV files as text, with the record where it doesn't fit the header; the text of each column given."""
    names = spark.read.option("header", True).csv(path).columns
    text = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _BROKEN]])
    raw = (spark.read.option("header", True).option("enforceSchema", False).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", _BROKEN).option("columnPruning", False).schema(text).csv(path))
    raw = raw.select(F.col("_metadata.file_path").alias("_file"), F.col(_BROKEN).isNotNull().alias("_unread"),
                     F.coalesce(_BROKEN, F.to_csv(F.struct(*[F.col(f"`{n}`") for n in names]))).alias("_record"),
                     *[F.col(f"`{n}`").alias(f"_t_{n}") for n in names])
    return raw, {n: (F.lit(True), F.col(f"`_t_{n}`")) for n in names}


def _json_values(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, dict]:
    """JSON lines as a map of texts in one pass, without inferring a schema; blank lines are no rows."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("_file"), F.col("value").alias("_record"))
    raw = _once(lines.filter(F.trim("_record") != ""), _values=F.from_json("_record", "map<string,string>"))
    # A line that ends early gives the values before its end: it is no record unless it reads as a whole.
    raw = _once(raw, _unread=F.col("_values").isNull() | F.get_json_object("_record", "$").isNull())
    return raw, {f.name: (F.map_contains_key("_values", f.name), F.element_at("_values", F.lit(f.name))) for f in schema.fields}


def parse_table(spark: SparkSession, path: str, name: str, fmt: str = "csv") -> tuple[DataFrame, DataFrame]:
    """Text files (``csv`` with a header, or ``json`` lines) as (rows, rejects).

    Every source row is in exactly one of the two.  ``rows`` has the table's schema; a column that the source
    doesn't give (no such header, no such key) takes its default.  ``rejects`` is (source_file, record,
    bad_columns, reason): rows that don't read as a record, and rows with a value that isn't of its column's
    type, named in ``bad_columns``.  Text after the end of a JSON record is not looked at, as in Spark's own
    reader.  A narrow pass over the files each, without a shuffle."""
    schema = SCHEMAS[name]
    if fmt == "csv":
        raw, given = _csv_values(spark, path)
    elif fmt == "json":
        raw, given = _json_values(spark, path, schema)
    else:
        raise ValueError(f"no text format: {fmt!r}")
    cols, bad, values = [], [], {}
    for f in schema.fields:
        default = F.lit(f.metadata.get("default")).cast(f.dataType)
        if f.name not in given:
            cols.append(default.alias(f.name))
            continue
        there, text = given[f.name]
        values[f"_v_{f.name}"] = text.try_cast(f.dataType)
        value = F.col(f"`_v_{f.name}`")
        cols.append(F.when(there, value).otherwise(default).alias(f.name))
        bad.append(F.when(there & text.isNotNull() & value.isNull(), F.lit(f.name)))
    flaws = F.filter(F.array(*bad), lambda x: x.isNotNull()) if bad else F.array().cast("array<string>")
    if values:
        raw = _once(raw, **values)
    raw = _once(raw, bad_columns=F.when(F.col("_unread"), F.array().cast("array<string>")).otherwise(flaws))
    fine = ~F.col("_unread") & (F.size("bad_columns") == 0)
    rejects = raw.filter(~fine).select(
        F.col("_file").alias("source_file"), F.col("_record").alias("record"), "bad_columns",
        F.when(F.col("_unread"), "not a record").otherwise("value of another type").alias("reason"))
    return raw.filter(fine).select(*cols), rejects


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def load_star(spark: SparkSession, root: str, fmt: str = "parquet") -> Tables:
    """All tables stored as ``root/<table>``; a table never written (the
    lazily created ``product_categories``) reads as empty."""
    out = {}
    for name in Tables.names():
        path = f"{root.rstrip('/')}/{name}"
        try:
            out[name] = load_table(spark, path, name, fmt)
        except Exception as exc:  # missing folder → empty table
            if "PATH_NOT_FOUND" in str(exc) or "does not exist" in str(exc) or "UNABLE_TO_INFER_SCHEMA" in str(exc):
                out[name] = empty_table(spark, name)
            else:
                raise
    return Tables(**out)


def save_star(t: Tables, root: str, mode: str = "overwrite") -> None:
    """Write every table of the bundle as Parquet under ``root/<table>``."""
    for name in Tables.names():
        t.get(name).write.mode(mode).parquet(f"{root.rstrip('/')}/{name}")


def save_text(t: Tables, root: str, fmt: str) -> None:
    """Write every table of the bundle as text for ``parse_table`` (``csv`` or ``json``) under ``root/<table>``.

    The files are compressed: text repeats its column names and digits, and takes many times the room of Parquet.
    A file is one task's rows, so each is read by a task, as it was written."""
    for name in Tables.names():
        (t.get(name).write.option("header", True).option("ignoreNullFields", False).option("compression", "gzip")
         .format(fmt).save(f"{root.rstrip('/')}/{name}"))
