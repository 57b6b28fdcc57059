"""S4 CSV export of a report; S5 timestamped snapshots and their expiry.

A snapshot is a manifest that names one version of every table; equal tables
share a version, so a snapshot writes only what changed since any earlier one:

    root/_data/<table>/<version>    the rows of a version, written once
    root/_pending/<tag>             versions that a snapshot is about to name, written first
    root/_manifests/<tag>           (table, version), written last: without it a snapshot is incomplete

What is collected to the driver is a row per table and the names of versions and tags.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import Tables

SNAPSHOT_FORMAT = "%Y%m%dT%H%M%S"


def write_report_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header row, written in parallel (one file per task)."""
    df.write.mode(mode).option("header", True).csv(path)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names_in(spark: SparkSession, path: str) -> list[str]:
    p, fs = _fs(spark, path)
    return sorted(st.getPath().getName() for st in fs.listStatus(p)) if fs.exists(p) else []


def _whole(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


def _remove(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)


#: Bits of a row hash in each of its three sums: added as longs these don't overflow below 2^41 rows.
_BITS = 21


def _content(df: DataFrame, name: str) -> DataFrame:
    """One row: the table's row count and two sums of 64-bit row hashes, whatever the order of the rows; a sum comes in three parts."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    given = F.concat(*[F.when(c.isNull(), "0").otherwise("1") for c in cols])
    rows = df.select(*[F.xxhash64(F.lit(seed), given, *cols).alias(h) for seed, h in ((1, "a"), (2, "b"))])
    low = (1 << _BITS) - 1
    part = lambda h, i: F.shiftright(h, i * _BITS) if i == 2 else F.shiftright(h, i * _BITS).bitwiseAND(F.lit(low).cast("bigint"))
    total = lambda h: F.array(*[F.coalesce(F.sum(part(h, i)), F.lit(0).cast("bigint")) for i in range(3)])
    return rows.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n"), total("a").alias("a"), total("b").alias("b"))


def _sum(parts: list[int]) -> int:
    return sum(x << (i * _BITS) for i, x in enumerate(parts))


def table_versions(t: Tables, names=None) -> dict[str, str]:
    """Version of each table by its schema and content: one job, a column-wise scan with partial sums and no
    shuffle of rows.  Equal rows in any order give the same version."""
    names = list(Tables.names() if names is None else names)
    if not names:
        return {}
    rows = reduce(DataFrame.unionByName, [_content(t.get(n), n) for n in names]).collect()
    return {r["table"]: hashlib.sha256(f"{t.get(r['table']).schema.simpleString()}|{r['n']}|{_sum(r['a'])}|{_sum(r['b'])}".encode()).hexdigest()[:32]
            for r in rows}


def _write_names(spark: SparkSession, versions: Mapping[str, str], path: str) -> None:
    spark.createDataFrame(sorted(versions.items()), "table string, version string").coalesce(1).write.mode("overwrite").parquet(path)


def _read_names(spark: SparkSession, path: str) -> dict[str, str]:
    return {r["table"]: r["version"] for r in spark.read.schema("table string, version string").parquet(path).collect()}


def snapshot(t: Tables, root: str, ts: dt.datetime, versions: Mapping[str, str] | None = None) -> str:
    """Keep every table as it is now under the tag of ``ts``; a version that is there already is shared.

    ``versions`` gives the versions of tables whose source knows them (a commit number, a stream's manifest):
    these are trusted and not scanned.  The others are told apart by content."""
    spark, root = t.districts.sparkSession, root.rstrip("/")
    tag = ts.strftime(SNAPSHOT_FORMAT)
    known = dict(versions or {})
    for name, version in known.items():
        t.get(name)
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9.-]*", version):
            raise ValueError(f"version of {name} is no folder name: {version!r}")
    known |= table_versions(t, [n for n in Tables.names() if n not in known])
    _write_names(spark, known, f"{root}/_pending/{tag}")
    for name, version in known.items():
        path = f"{root}/_data/{name}/{version}"
        if not _whole(spark, path):
            t.get(name).write.mode("overwrite").parquet(path)
    _write_names(spark, known, _manifest(root, tag))
    _remove(spark, f"{root}/_pending/{tag}")
    return tag


def _manifest(root: str, tag: str) -> str:
    return f"{root.rstrip('/')}/_manifests/{tag}"


def snapshot_versions(spark: SparkSession, root: str, tag: str) -> dict[str, str]:
    """Version of each table in a complete snapshot."""
    return _read_names(spark, _manifest(root, tag))


def read_snapshot(spark: SparkSession, root: str, name: str, tag: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/_data/{name}/{snapshot_versions(spark, root, tag)[name]}")


def load_snapshot(spark: SparkSession, root: str, tag: str) -> Tables:
    """All tables of a snapshot."""
    held = snapshot_versions(spark, root, tag)
    return Tables(**{n: spark.read.parquet(f"{root.rstrip('/')}/_data/{n}/{held[n]}") for n in Tables.names()})


def list_snapshots(spark: SparkSession, root: str) -> list[str]:
    """Tags of the complete snapshots, those whose manifest was written (sorted)."""
    return [tag for tag in _names_in(spark, f"{root.rstrip('/')}/_manifests") if _whole(spark, _manifest(root, tag))]


def sweep(spark: SparkSession, root: str, now: dt.datetime, grace: dt.timedelta = dt.timedelta(days=1)) -> list[str]:
    """Remove what no complete snapshot names; returns the folders removed, relative to the root.

    A half-written snapshot whose tag is older than ``grace`` before ``now`` counts as abandoned; younger ones
    may still be running and keep what they are about to name."""
    root = root.rstrip("/")
    oldest = (now - grace).strftime(SNAPSHOT_FORMAT)
    done = set(list_snapshots(spark, root))
    gone = [f"_manifests/{tag}" for tag in _names_in(spark, f"{root}/_manifests") if tag not in done and tag < oldest]
    used = {(n, v) for tag in done for n, v in snapshot_versions(spark, root, tag).items()}
    for tag in _names_in(spark, f"{root}/_pending"):
        if tag < oldest:
            gone.append(f"_pending/{tag}")
        elif _whole(spark, f"{root}/_pending/{tag}"):
            used |= set(_read_names(spark, f"{root}/_pending/{tag}").items())
    gone += [f"_data/{n}/{v}" for n in Tables.names() for v in _names_in(spark, f"{root}/_data/{n}") if (n, v) not in used]
    for path in gone:
        _remove(spark, f"{root}/{path}")
    return gone


def expire(spark: SparkSession, root: str, keep_days: int, now: dt.datetime) -> list[str]:
    """Drop snapshots older than ``keep_days`` before ``now``, then what only they named; returns the dropped tags."""
    cutoff = (now - dt.timedelta(days=keep_days)).strftime(SNAPSHOT_FORMAT)
    dropped = [tag for tag in list_snapshots(spark, root) if tag < cutoff]
    for tag in dropped:  # the manifest first: a half-dropped snapshot is not listed
        _remove(spark, _manifest(root, tag))
    sweep(spark, root, now)
    return dropped
