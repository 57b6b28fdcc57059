"""Typed schemas of the field-sales tables.

Money is ``DECIMAL(18,2)`` inside every operator (exact, order-independent
sums) and is cast to ``double`` only in report outputs.  Timestamps are
``TIMESTAMP_NTZ`` in UTC.  Each field carries its column default, used by
``sources.tables.conform`` when an older file lacks the column.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
ID = T.LongType()
QTY = T.LongType()
FLAG = T.IntegerType()
TEXT = T.StringType()
TS = T.TimestampNTZType()
DATE = T.DateType()
RATE = T.DoubleType()


def _f(name, dtype, default=None):
    return T.StructField(name, dtype, True, {"default": default} if default is not None else {})


SCHEMAS: dict[str, T.StructType] = {
    "districts": T.StructType([
        _f("id", ID), _f("code", TEXT), _f("name", TEXT), _f("created_at", TS),
    ]),
    "towns": T.StructType([
        _f("id", ID), _f("code", TEXT), _f("name", TEXT), _f("district_id", ID), _f("created_at", TS),
    ]),
    "routes": T.StructType([
        _f("id", ID), _f("code", TEXT), _f("name", TEXT), _f("town_id", ID),
        _f("description", TEXT), _f("created_at", TS),
    ]),
    "products": T.StructType([
        _f("id", ID), _f("code", TEXT), _f("name", TEXT), _f("unit_price", MONEY),
        _f("cost_price", MONEY, 0), _f("stock_quantity", QTY, 0), _f("min_stock_level", QTY, 0),
        _f("max_stock_level", QTY, 0), _f("unit", TEXT, "units"), _f("category", TEXT, "general"),
        _f("description", TEXT), _f("brand", TEXT), _f("supplier", TEXT), _f("is_active", FLAG, 1),
        _f("created_at", TS),
    ]),
    "product_categories": T.StructType([
        _f("id", ID), _f("code", TEXT), _f("value", TEXT), _f("name", TEXT),
        _f("is_active", FLAG, 1), _f("created_at", TS),
    ]),
    "salespersons": T.StructType([
        _f("id", ID), _f("code", TEXT), _f("name", TEXT), _f("contact_number", TEXT), _f("email", TEXT),
        _f("vehicle_number", TEXT), _f("target_amount", MONEY, 0), _f("commission_rate", RATE, 0),
        _f("start_date", DATE), _f("notes", TEXT), _f("is_active", FLAG, 1),
        _f("created_at", TS), _f("updated_at", TS),
    ]),
    "shops": T.StructType([
        _f("id", ID), _f("code", TEXT), _f("name", TEXT), _f("owner_name", TEXT), _f("contact_number", TEXT),
        _f("email", TEXT), _f("address", TEXT), _f("district_id", ID), _f("town_id", ID), _f("route_id", ID),
        _f("credit_limit", MONEY, 0), _f("current_balance", MONEY, 0), _f("payment_terms", T.IntegerType(), 30),
        _f("preferred_payment_method", TEXT, "cash"), _f("notes", TEXT), _f("is_active", FLAG, 1),
        _f("created_at", TS), _f("updated_at", TS),
    ]),
    "sales": T.StructType([
        _f("id", ID), _f("date", TS), _f("shop_id", ID), _f("salesperson_id", ID), _f("route_id", ID),
        _f("total_amount", MONEY), _f("paid_amount", MONEY, 0), _f("balance_amount", MONEY, 0),
        _f("discount_amount", MONEY, 0), _f("tax_amount", MONEY, 0), _f("payment_type", TEXT),
        _f("payment_method", TEXT, "cash"), _f("vehicle_number", TEXT), _f("notes", TEXT),
    ]),
    "sale_items": T.StructType([
        _f("id", ID), _f("sale_id", ID), _f("product_id", ID), _f("quantity", QTY),
        _f("unit_price", MONEY), _f("total_price", MONEY),
    ]),
    "collections": T.StructType([
        _f("id", ID), _f("date", TS), _f("shop_id", ID), _f("salesperson_id", ID), _f("amount", MONEY),
        _f("payment_method", TEXT), _f("reference_number", TEXT), _f("notes", TEXT), _f("vehicle_number", TEXT),
    ]),
    "salesperson_stock": T.StructType([
        _f("id", ID), _f("salesperson_id", ID), _f("product_id", ID), _f("quantity", QTY, 0),
        _f("last_updated", TS),
    ]),
    "stock_issues": T.StructType([
        _f("id", ID), _f("date", TS), _f("salesperson_id", ID), _f("product_id", ID),
        _f("quantity_issued", QTY), _f("vehicle_number", TEXT), _f("notes", TEXT),
    ]),
    "stock_returns": T.StructType([
        _f("id", ID), _f("date", TS), _f("salesperson_id", ID), _f("product_id", ID),
        _f("quantity_returned", QTY), _f("reason", TEXT), _f("condition", TEXT, "good"),
        _f("inspection_required", FLAG, 0), _f("notes", TEXT),
    ]),
}

TABLE_NAMES = tuple(SCHEMAS)

# Command feed for the ledger (L3..L5, ST2).
ITEM = T.StructType([
    T.StructField("product_id", ID), T.StructField("quantity", QTY), T.StructField("unit_price", MONEY),
])
COMMANDS = T.StructType([
    T.StructField("cmd_id", ID), T.StructField("ts", TS), T.StructField("kind", TEXT),
    T.StructField("salesperson_id", ID), T.StructField("shop_id", ID), T.StructField("ref_id", ID),
    T.StructField("amount", MONEY), T.StructField("items", T.ArrayType(ITEM)),
    T.StructField("reason", TEXT), T.StructField("condition", TEXT),
    T.StructField("inspection_required", FLAG), T.StructField("notes", TEXT),
    T.StructField("vehicle_number", TEXT),
])
LEGS = T.StructType([
    T.StructField("cmd_id", ID), T.StructField("ts", TS), T.StructField("resource", TEXT),
    T.StructField("k1", ID), T.StructField("k2", ID), T.StructField("need", MONEY), T.StructField("delta", MONEY),
])
