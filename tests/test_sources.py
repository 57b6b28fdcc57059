"""S1/S2 typed reads and schema evolution, S4 CSV export, S5 snapshots."""

from __future__ import annotations

import datetime as dt
import os

import pytest

from pyspark.sql import functions as F

from routeledger.operators import reports as R
from routeledger.schema import SCHEMAS
from routeledger.sources import sinks
from routeledger.sources.tables import conform, load_star, load_table, parse_table, save_star, save_text


def shape(schema):
    return [(f.name, f.dataType) for f in schema.fields]


def test_conform_adds_defaults_and_casts(spark):
    old = spark.createDataFrame([(1, "P1", "Soap", "12.5", "x")], "id int, code string, name string, "
                                                                    "unit_price string, junk string")
    out = conform(old, SCHEMAS["products"])
    assert out.columns == [f.name for f in SCHEMAS["products"].fields]
    r = out.first()
    assert r.unit == "units" and r.category == "general" and r.is_active == 1 and r.stock_quantity == 0
    assert float(r.unit_price) == 12.5 and r.id == 1


def test_bad_value_becomes_null(spark):
    df = spark.createDataFrame([("abc",)], "stock_quantity string")
    assert conform(df, SCHEMAS["products"]).first().stock_quantity is None


def test_star_roundtrip_and_missing_table(spark, seed, scratch):
    save_star(seed, f"{scratch}/star")
    back = load_star(spark, f"{scratch}/star")
    assert back.sales.count() == 22 and shape(back.products.schema) == shape(SCHEMAS["products"])
    empty = load_star(spark, f"{scratch}/nothing")
    assert empty.product_categories.count() == 0


def test_csv_parquet_reads(spark, seed, scratch):
    seed.products.write.option("header", True).csv(f"{scratch}/p_csv")
    p = load_table(spark, f"{scratch}/p_csv", "products", fmt="csv")
    assert p.count() == 15 and shape(p.schema) == shape(SCHEMAS["products"])


def test_report_csv(spark, seed, scratch):
    sinks.write_report_csv(R.shop_outstanding(seed), f"{scratch}/out")
    back = spark.read.option("header", True).csv(f"{scratch}/out")
    assert back.count() == 10 and "risk_level" in back.columns


def test_snapshot_and_expire(spark, seed, scratch):
    root = f"{scratch}/snaps"
    now = dt.datetime(2024, 7, 1, 12, 0)
    old = sinks.snapshot(seed, root, now - dt.timedelta(days=40))
    new = sinks.snapshot(seed, root, now)
    assert sinks.list_snapshots(spark, root) == sorted([old, new])
    assert sinks.read_snapshot(spark, root, "sales", new).count() == 22
    assert sinks.expire(spark, root, 30, now) == [old]
    assert sinks.list_snapshots(spark, root) == [new]
    assert sinks.read_snapshot(spark, root, "sales", new).filter(F.col("id") == 1).count() == 1


def files(root):
    return sorted((os.path.join(d, f), os.stat(os.path.join(d, f)).st_mtime_ns) for d, _, fs in os.walk(root) for f in fs)


def test_unchanged_tables_are_shared(spark, seed, scratch):
    root = f"{scratch}/shared"
    now = dt.datetime(2024, 7, 1, 12, 0)
    a = sinks.snapshot(seed, root, now - dt.timedelta(days=40))
    before = files(f"{root}/_data")
    shuffled = seed.with_tables(sales=seed.sales.orderBy(F.rand(3)))
    b = sinks.snapshot(shuffled, root, now - dt.timedelta(days=2))
    assert files(f"{root}/_data") == before  # equal rows in another order: no data written
    c = sinks.snapshot(seed.with_tables(shops=seed.shops.withColumn("notes", F.lit("x"))), root, now)
    va, vb, vc = (sinks.snapshot_versions(spark, root, tag) for tag in (a, b, c))
    assert va == vb and [n for n in va if va[n] != vc[n]] == ["shops"]
    assert sinks.expire(spark, root, 30, now) == [a]
    for name in va:  # the younger snapshot still names the shared versions
        assert sinks.load_snapshot(spark, root, b).get(name).exceptAll(seed.get(name)).isEmpty()
        assert sinks.read_snapshot(spark, root, name, b).count() == seed.get(name).count()
    assert sinks.expire(spark, root, 1, now) == [b]
    assert len(os.listdir(f"{root}/_data/shops")) == 1


def test_versions_tell_nulls_and_repeats_apart(spark, seed):
    make = lambda rows: sinks.table_versions(seed.with_tables(towns=spark.createDataFrame(rows, seed.towns.schema)), ["towns"])["towns"]
    rows = [(1, "a", None, 2, None), (1, None, "a", 2, None)]
    seen = [make(rows[:1]), make(rows[1:]), make(rows), make(rows[:1] * 2), make(rows[:1] * 3), make([])]
    assert len(set(seen)) == 6 and make(rows[::-1]) == make(rows)


def test_half_written_snapshot_is_removed(spark, seed, scratch, monkeypatch):
    root = f"{scratch}/half"
    now = dt.datetime(2024, 7, 1, 12, 0)
    kept = sinks.snapshot(seed, root, now - dt.timedelta(days=3))
    changed = seed.with_tables(sales=seed.sales.withColumn("notes", F.lit("changed")))
    manifest = sinks._manifest
    monkeypatch.setattr(sinks, "_manifest", lambda *_: 1 / 0)  # ends between the data and the manifest
    with pytest.raises(ZeroDivisionError):
        sinks.snapshot(changed, root, now - dt.timedelta(days=2))
    monkeypatch.setattr(sinks, "_manifest", manifest)
    assert sinks.list_snapshots(spark, root) == [kept] and len(os.listdir(f"{root}/_data/sales")) == 2
    assert sinks.sweep(spark, root, now, grace=dt.timedelta(days=5)) == []  # it may still be running
    gone = sinks.sweep(spark, root, now)
    assert len(gone) == 2 and {g.split("/")[0] for g in gone} == {"_pending", "_data"}
    assert sinks.read_snapshot(spark, root, "sales", kept).count() == 22
    assert sinks.sweep(spark, root, now) == []


def test_known_versions_are_not_scanned(spark, seed, scratch):
    root = f"{scratch}/known"
    now = dt.datetime(2024, 7, 1, 12, 0)
    bad = seed.sales.withColumn("notes", F.raise_error(F.lit("scanned")).cast("string"))
    tag = sinks.snapshot(seed, root, now, versions={"sales": "commit-7"})
    again = sinks.snapshot(seed.with_tables(sales=bad), root, now + dt.timedelta(days=1), versions={"sales": "commit-7"})
    assert sinks.snapshot_versions(spark, root, tag) == sinks.snapshot_versions(spark, root, again)
    with pytest.raises(ValueError):
        sinks.snapshot(seed, root, now, versions={"sales": "../x"})


def write(path, name, text):
    os.makedirs(path)
    with open(f"{path}/{name}", "w") as f:
        f.write(text)
    return path


def test_parse_csv_rows_and_rejects(spark, scratch):
    path = write(f"{scratch}/parse_csv", "a.csv", 'id,amount,shop_id,notes,other\n1,12.5,5,"a,b",z\n2,5\n3,4,5,6,7,8\nx,y,1,,\n,,,,\n')
    rows, rejects = parse_table(spark, path, "collections")
    assert rows.columns == SCHEMAS["collections"].fieldNames()
    assert sorted((r["id"], r["notes"]) for r in rows.collect() if r["id"]) == [(1, "a,b")] and rows.count() == 2
    got = {r["record"]: (r["bad_columns"], r["reason"]) for r in rejects.collect()}
    assert got == {"2,5": ([], "not a record"), "3,4,5,6,7,8": ([], "not a record"),
                   "x,y,1,,": (["id", "amount"], "value of another type")}
    assert rejects.first()["source_file"].endswith("a.csv")


def test_parse_json_rows_and_rejects(spark, scratch):
    lines = ['{"id":1,"unit_price":12.50}', '{"id":2,"unit_price":', "", "[1,2]", '{"id":3,"unit_price":"x1"}',
             '{"id":4,"unit":null,"extra":{"a":[1]}}', '"x"', '{"id":5,"id":5}', "{}"]
    path = write(f"{scratch}/parse_json", "a.json", "\n".join(lines) + "\n")
    rows, rejects = parse_table(spark, path, "products", "json")
    got = {r["id"]: r for r in rows.collect()}
    assert set(got) == {1, 4, 5, None}
    assert float(got[1]["unit_price"]) == 12.5 and got[1]["unit"] == "units" and got[4]["unit"] is None  # default only if not given
    assert sorted(r["record"] for r in rejects.collect()) == sorted([lines[1], lines[3], lines[4], lines[6]])


def test_every_row_parses_into_one_side(spark, seed, scratch):
    for fmt in ("csv", "json"):
        for name in ("sales", "shops"):
            seed.get(name).write.option("header", True).option("ignoreNullFields", False).format(fmt).save(f"{scratch}/all_{fmt}_{name}")
            rows, rejects = parse_table(spark, f"{scratch}/all_{fmt}_{name}", name, fmt)
            assert rejects.isEmpty() and rows.exceptAll(seed.get(name)).isEmpty() and rows.count() == seed.get(name).count()


def test_json_record_is_parsed_once(spark, tmp_path):
    """A filter on the parsed values doesn't parse the record again for every column."""
    path = str(tmp_path / "lines")
    spark.createDataFrame([('{"id":1,"shop_id":2,"amount":"3.50"}',), ('{"id":2,"shop_id":"x"}',), ('{"id":3,',)], "value string").write.text(path)
    rows, rejects = parse_table(spark, path, "collections", "json")
    for df in (rows, rejects):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    assert [(r["id"], r["shop_id"], str(r["amount"])) for r in rows.collect()] == [(1, 2, "3.50")]
    assert sorted((r["reason"], r["bad_columns"]) for r in rejects.collect()) == [("not a record", []), ("value of another type", ["shop_id"])]


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_tables_as_text_are_compressed_and_read_back_whole(spark, seed, scratch, fmt):
    many = seed.with_tables(sale_items=seed.sale_items.crossJoin(spark.range(300).select(F.col("id").alias("_n"))).drop("_n"))
    save_text(many, f"{scratch}/text", fmt)
    many.sale_items.write.option("header", True).option("ignoreNullFields", False).format(fmt).save(f"{scratch}/plain")

    def size(folder):
        return sum(os.path.getsize(os.path.join(folder, f)) for f in os.listdir(folder) if f.startswith("part-"))
    assert size(f"{scratch}/text/sale_items") * 3 < size(f"{scratch}/plain")
    for name in ("sale_items", "shops"):
        rows, rejects = parse_table(spark, f"{scratch}/text/{name}", name, fmt)
        assert rejects.count() == 0 and shape(rows.schema) == shape(SCHEMAS[name])
        assert rows.exceptAll(many.get(name)).count() == 0 and rows.count() == many.get(name).count()
