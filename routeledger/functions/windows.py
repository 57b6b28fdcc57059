"""Window building blocks that stay parallel on hot keys.

``running_total``: a running sum per key in a total order.  Keys of up to a task's
share of the rows are a window by key: one shuffle and no table.  The others (``split_hot``) are split in two
levels.  Their rows are range-partitioned by (key, order), so a key of any size -
also one whose rows all fall on one day - spreads over as many ranges as its
share of the rows.  Totals per (key, range) are prefix-summed per key (one row
per range), and the running sum inside a range is a window partitioned by
(key, range).  NULL keys and NULL order values are keys and values like others.
``running_latest`` finds the last value before each row in the same two levels.

``dense_ids``: consecutive ids ``base + 1 ..`` in a given order without a
single-partition window: range-partition on the order, number rows inside
each partition, checkpoint, and shift by the row counts of earlier
partitions (one row per partition, a proven size bound).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: A key is hot if it has more rows than this and than an even share of a task.
HOT_ROWS = 200_000


def _same(keys: Sequence[str], prefix: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return out


def split_hot(df: DataFrame, keys: Sequence[str], counted: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(rows of the other keys, rows of hot keys or None): which keys are hot decides where rows are worked on, not what comes out.

    Counts come from a sample, of ``counted`` if given (a cheaper table with about as many rows of each key);
    the driver gets the hot keys, at most two a task."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = min(1.0, 400 / HOT_ROWS)
    part = (df if counted is None else counted).select(*[F.col(k).alias(f"_k_{k}") for k in keys])
    part = part.sample(share, 11) if share < 1 else part
    counts = part.groupBy(*part.columns).agg(F.count(F.lit(1)).alias("_n"))
    largest = counts.orderBy(F.desc("_n")).limit(2 * n).collect()
    if not largest or largest[0]["_n"] <= HOT_ROWS * share:
        return df, None
    least = max(HOT_ROWS * share, part.count() / n)
    hot = [tuple(r)[:-1] for r in largest if r["_n"] > least]
    if not hot:
        return df, None
    hot = F.broadcast(df.sparkSession.createDataFrame(hot, part.schema))
    return df.join(hot, _same(keys, "_k_"), "left_anti"), df.join(hot, _same(keys, "_k_"), "left_semi")


def _running(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, str], inclusive: bool, fold, both,
             counted: DataFrame | None = None) -> DataFrame:
    """One running ``fold`` per ``values`` item; ``both`` joins the fold of earlier ranges with that inside a range."""
    cold, hot = split_hot(df, keys, counted)
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = cold.select("*", *[fold(v).over(w).alias(f"_in_{o}") for o, v in values.items()])
    out = out.select(*df.columns, *[both(F.lit(None).cast(out.schema[f"_in_{o}"].dataType), F.col(f"_in_{o}")).alias(o) for o in values])
    return out if hot is None else out.unionByName(_running_split(hot, keys, order, values, inclusive, fold, both))


def _running_split(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, str], inclusive: bool, fold, both) -> DataFrame:
    """``_running`` of keys that are spread over many tasks."""
    keys, p = list(keys), "_range"
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written once, so the totals and the rows come from one evaluation of the ranges.
    from ..session import materialize
    d = materialize(df.repartitionByRange(n, *keys, *order).withColumn(p, F.spark_partition_id()), "ranges")
    # Ranges follow one another by key: a key that is in several of them is the first of all but one, so the
    # totals of earlier ranges are two rows a range at most.
    first = d.groupBy(p).agg(F.min(F.struct(*keys)).alias("_f")).select("_f").distinct()
    mine = F.lit(True)
    for k in keys:
        mine = mine & F.col(k).eqNullSafe(F.col(f"_f.{k}"))
    totals = d.join(F.broadcast(first), mine, "left_semi").groupBy(*keys, p).agg(*[fold(v).alias(f"_bt_{o}") for o, v in values.items()])
    w_b = Window.partitionBy(*keys).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(p).alias("_k_range"),
                            *[fold(f"_bt_{o}").over(w_b).alias(f"_off_{o}") for o in values])
    w_in = (Window.partitionBy(*keys, p).orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    for o, v in values.items():
        d = d.withColumn(f"_in_{o}", fold(v).over(w_in))
    same = F.col(p) == F.col("_k_range")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    d = d.join(F.broadcast(offsets), same, "left")
    for o in values:
        d = d.withColumn(o, both(F.col(f"_off_{o}"), F.col(f"_in_{o}")))
    return d.drop(p, "_k_range", *[f"_k_{k}" for k in keys], *[f"_in_{o}" for o in values], *[f"_off_{o}" for o in values])


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, str],
                   inclusive: bool = True, counted: DataFrame | None = None) -> DataFrame:
    """Add one running sum per ``values`` item (``out -> value column``):
    the sum over earlier rows of the same key in ``order`` (NULLs first; and the
    row itself when ``inclusive``).  No row is lost to a NULL key or order.  ``counted``: see ``split_hot``."""
    return _running(df, keys, order, values, inclusive, F.sum,
                    lambda before, inside: F.coalesce(before, F.lit(0)) + F.coalesce(inside, F.lit(0)), counted)


def running_latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, str],
                   counted: DataFrame | None = None) -> DataFrame:
    """Add, per ``values`` item, the value of the last earlier row of the same key whose value isn't NULL.

    Each value column is a struct that begins with the ``order`` columns, so the last one is
    the largest; NULL where no earlier row has one."""
    return _running(df, keys, order, values, False, F.max, F.greatest, counted)


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
                  out: str = "running", inclusive: bool = True) -> DataFrame:
    """One running sum (see ``running_totals``)."""
    return running_totals(df, keys, order, {out: value}, inclusive)


def dense_ids(df: DataFrame, order: Sequence[str], base: Column | int = 0, out: str = "id",
              partitions: int | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """Number rows ``base + 1, base + 2, ..`` following ``order`` (a total order); ``keep``: the columns that are kept."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    tagged = ranged.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    # monotonically_increasing_id = partition index << 33 | row position in partition
    tagged = tagged.withColumn("_pos", F.col("_m") - F.shiftleft(F.col("_p").cast("bigint"), 33))
    # Freeze the numbered partitions (a table written in the shared
    # spark.checkpoint.dir) so the per-partition counts and the rows come
    # from one evaluation, also after a lost executor.
    from ..session import materialize
    if keep is not None:
        tagged = tagged.select(*keep, "_p", "_pos")
    tagged = materialize(tagged.drop("_m"), "dense-ids")
    counts = tagged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition: the only single-partition window here is over
    # at most `n` rows.
    offsets = counts.select("_p", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    base_col = base if isinstance(base, Column) else F.lit(base)
    return (tagged.join(F.broadcast(offsets), "_p")
            .withColumn(out, (base_col + F.col("_off") + F.col("_pos") + 1).cast("bigint"))
            .drop("_p", "_pos", "_off"))
