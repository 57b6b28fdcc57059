"""L8..L12 batch master-data operators on the seed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from routeledger.operators import ledger as G


def test_delete_rules_per_entity(spark, seed):
    out = {r.id: (r.action, r.reason) for r in G.delete_outcome(seed, "salesperson", [1, 8]).collect()}
    assert out[1][0] == "refused" and "holds stock" in out[1][1] and "has sales" in out[1][1]
    assert {r.action for r in G.delete_outcome(seed, "district", [1, 2]).collect()} == {"refused"}
    towns = {r.id: r.action for r in G.delete_outcome(seed, "town", [8]).collect()}
    assert towns == {8: "refused"}  # has a route and a shop
    lonely = seed.with_tables(towns=seed.towns.unionByName(
        spark.createDataFrame([(99, "TW099", "Nowhere", 1)], "id long, code string, name string, district_id long"),
        allowMissingColumns=True))
    assert {r.id: r.action for r in G.delete_outcome(lonely, "town", [99]).collect()} == {99: "deleted"}


def test_delete_products_soft_and_hard(spark, seed):
    extra = spark.createDataFrame([(16, "PRD016", "Unused", 1)], "id long, code string, name string, is_active int")
    t = seed.with_tables(products=seed.products.unionByName(extra, allowMissingColumns=True),
                         salesperson_stock=seed.salesperson_stock.unionByName(
                             spark.createDataFrame([(99, 1, 16, 5)], "id long, salesperson_id long, product_id long, "
                                                                     "quantity long"), allowMissingColumns=True))
    after, outcome = G.delete_records(t, "product", [1, 16])
    assert {r.id: r.action for r in outcome.collect()} == {1: "soft", 16: "hard"}
    assert after.products.filter(F.col("id") == 16).count() == 0
    assert after.products.filter(F.col("id") == 1).first().is_active == 0
    assert after.salesperson_stock.filter(F.col("product_id") == 16).count() == 0


def test_merge_updates_and_inserts(spark, seed):
    upd = spark.createDataFrame([(2, "Renamed"), (77, "New one")], "id long, name string")
    merged = {r.id: (r.name, r.code) for r in G.merge_records(seed.districts, upd).collect()}
    assert merged[2] == ("Renamed", "DT002") and merged[77] == ("New one", None) and merged[1][0] == "Central District"


def test_normalise_products(spark):
    raw = spark.createDataFrame([(" prd9 ", " Soap  ", "12.50"), ("", "X", "1"), ("p2", None, "3")],
                                "code string, name string, unit_price string")
    good, bad = G.normalise_master(raw, "product")
    assert [(r.code, r.name) for r in good.collect()] == [("PRD9", "Soap")]
    assert sorted(r.reason for r in bad.collect()) == ["code is required", "name is required"]


def test_general_category_cannot_be_deleted(spark, seed):
    mapping = spark.createDataFrame([("general", None), ("food", None)], "old_value string, new_value string")
    t = G.recategorise(seed, mapping)
    cats = {r.value for r in t.product_categories.collect()}
    assert "general" in cats and "food" not in cats
    assert t.products.filter(F.col("category") == "food").count() == 0
    assert t.products.filter(F.col("category") == "general").count() == 8


def test_adjust_levels_rejects_inactive_and_missing(spark, seed):
    shops = seed.shops.withColumn("is_active", F.when(F.col("id") == 3, 0).otherwise(1))
    deltas = spark.createDataFrame([(1, 100), (1, 50), (3, 10), (404, 1)], "id long, delta long")
    new, rejects = G.adjust_levels(shops, deltas, "current_balance")
    assert float(new.filter(F.col("id") == 1).first().current_balance) == -4850.0
    assert {(r.id, r.reason) for r in rejects.collect()} == {(3, "inactive"), (404, "not found")}
