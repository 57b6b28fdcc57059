"""The reference application's first-launch seed, as test fixture tables.

Fixed values: transcribed seed rows (districts, towns, routes, products,
salespersons, shops, field stock, sales, collections, issues, returns);
ids are 1.. in listing order, dates are ``as_of`` minus the days given.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from routeledger.schema import SCHEMAS
from routeledger.sources.tables import conform
from routeledger.tables import Tables

# Seed rows.
DISTRICTS = [("DT001", "Central District"), ("DT002", "North District"), ("DT003", "South District"),
             ("DT004", "East District"), ("DT005", "West District")]
TOWNS = [("TW001", "Downtown", 1), ("TW002", "Midtown", 1), ("TW003", "Uptown", 2), ("TW004", "Riverside", 3),
         ("TW005", "Harbor View", 2), ("TW006", "Green Valley", 4), ("TW007", "Lakeside", 5),
         ("TW008", "Industrial Area", 1)]
ROUTES = [("RT001", "Route A - Main Street", 1), ("RT002", "Route B - Market Road", 2),
          ("RT003", "Route C - Business Park", 3), ("RT004", "Route D - Riverside Drive", 4),
          ("RT005", "Route E - Harbor Lane", 5), ("RT006", "Route F - Green Fields", 6),
          ("RT007", "Route G - Lake Boulevard", 7), ("RT008", "Route H - Industrial Road", 8)]
PRODUCTS = [
    ("PRD001", "Rice 1kg", 120, 500, 100, "kg", "food"),
    ("PRD002", "Wheat Flour 1kg", 80, 300, 50, "kg", "food"),
    ("PRD003", "Sugar 1kg", 90, 400, 80, "kg", "food"),
    ("PRD004", "Salt 1kg", 25, 600, 100, "kg", "food"),
    ("PRD005", "Tea Leaves 250g", 180, 200, 50, "g", "food"),
    ("PRD006", "Coffee Powder 250g", 250, 150, 40, "g", "food"),
    ("PRD007", "Cooking Oil 1L", 180, 250, 60, "L", "food"),
    ("PRD008", "Biscuits Pack", 60, 400, 100, "packs", "food"),
    ("PRD009", "Soap Bar", 45, 500, 100, "bars", "cleaning"),
    ("PRD010", "Shampoo 200ml", 150, 180, 50, "ml", "cleaning"),
    ("PRD011", "Toothpaste Tube", 85, 300, 80, "tubes", "cleaning"),
    ("PRD012", "Detergent Powder 1kg", 120, 200, 50, "kg", "cleaning"),
    ("PRD013", "Smartphone Model X", 15000, 50, 10, "units", "electronics"),
    ("PRD014", "Bluetooth Speaker", 2500, 75, 20, "units", "electronics"),
    ("PRD015", "USB Cable 1m", 150, 200, 50, "units", "electronics"),
]
SALESPERSONS = [
    ("SP001", "John Smith", "9876543210", "AB-1234-CD", 50000),
    ("SP002", "Sarah Johnson", "9876543211", "EF-5678-GH", 45000),
    ("SP003", "Michael Brown", "9876543212", "IJ-9012-KL", 55000),
    ("SP004", "Emily Davis", "9876543213", "MN-3456-OP", 40000),
    ("SP005", "David Wilson", "9876543214", "QR-7890-ST", 60000),
    ("SP006", "Lisa Anderson", "9876543215", "UV-1234-WX", 48000),
    ("SP007", "Robert Taylor", "9876543216", "YZ-5678-AB", 52000),
    ("SP008", "Jennifer Lee", "9876543217", "CD-9012-EF", 47000),
]
SHOPS = [
    ("SH001", "Fresh Mart", "Alice Cooper", "9123456789", 1, 1, 1, 20000, -5000),
    ("SH002", "Daily Needs Store", "Bob Davis", "9123456790", 1, 2, 2, 15000, -3000),
    ("SH003", "Super Market", "Carol Evans", "9123456791", 2, 3, 3, 30000, -8000),
    ("SH004", "Quick Stop", "Daniel Fox", "9123456792", 2, 5, 5, 10000, -1500),
    ("SH005", "Value Shop", "Eva Green", "9123456793", 3, 4, 4, 25000, -12000),
    ("SH006", "Easy Shop", "Frank Harris", "9123456794", 4, 6, 6, 18000, -4000),
    ("SH007", "Prime Store", "Grace White", "9123456795", 5, 7, 7, 35000, -20000),
    ("SH008", "Mini Mart", "Henry Black", "9123456796", 1, 8, 8, 12000, -6000),
    ("SH009", "City Store", "Ivy King", "9123456797", 1, 1, 1, 22000, 0),
    ("SH010", "Town Corner", "Jack Queen", "9123456798", 1, 2, 2, 16000, 0),
    ("SH011", "Green Shop", "Kate Lewis", "9123456799", 2, 3, 3, 28000, 0),
    ("SH012", "Lake View Store", "Leo Miller", "9123456800", 3, 4, 4, 14000, 0),
    ("SH013", "Harbor Shop", "Mia Nelson", "9123456801", 2, 5, 5, 19000, -2000),
    ("SH014", "Valley Mart", "Noah Clark", "9123456802", 4, 6, 6, 17000, 0),
    ("SH015", "Tech Gadgets", "Olivia Walker", "9123456803", 5, 7, 7, 50000, -15000),
]
FIELD_STOCK = [
    (1, 1, 100), (1, 2, 80), (1, 3, 60), (1, 9, 50), (1, 13, 10),
    (2, 4, 120), (2, 5, 40), (2, 6, 30), (2, 10, 40),
    (3, 1, 90), (3, 7, 50), (3, 8, 60), (3, 14, 15),
    (4, 2, 70), (4, 3, 50), (4, 9, 60), (4, 11, 80),
    (5, 5, 35), (5, 6, 25), (5, 12, 30), (5, 15, 40),
    (6, 1, 85), (6, 4, 95), (6, 7, 45),
    (7, 8, 55), (7, 13, 8), (7, 14, 12),
    (8, 9, 70), (8, 10, 35), (8, 12, 25),
]
# shop, salesperson, route, total, paid, balance, payment type, days ago
SALES = [
    (1, 1, 1, 600, 600, 0, "cash", 5), (1, 1, 1, 800, 280, 520, "credit", 3),
    (2, 2, 2, 360, 360, 0, "cash", 4), (2, 2, 2, 500, 250, 250, "credit", 2),
    (3, 3, 3, 500, 500, 0, "cash", 6), (3, 3, 3, 700, 400, 300, "credit", 1),
    (4, 4, 5, 300, 300, 0, "cash", 7), (4, 4, 5, 600, 300, 300, "credit", 2),
    (5, 5, 4, 800, 800, 0, "cash", 5), (5, 5, 4, 550, 300, 250, "credit", 4),
    (6, 6, 6, 500, 500, 0, "cash", 6), (6, 6, 6, 400, 200, 200, "credit", 3),
    (7, 7, 7, 15000, 10000, 5000, "credit", 2), (7, 7, 7, 4500, 4500, 0, "cash", 1),
    (8, 8, 8, 600, 600, 0, "cash", 7), (9, 1, 1, 500, 500, 0, "cash", 5),
    (10, 2, 2, 450, 450, 0, "cash", 4), (11, 3, 3, 700, 700, 0, "cash", 6),
    (12, 4, 4, 450, 200, 250, "credit", 2), (13, 5, 5, 500, 500, 0, "cash", 5),
    (14, 6, 6, 700, 700, 0, "cash", 3), (15, 7, 7, 5000, 2000, 3000, "credit", 1),
]
# shop, salesperson, amount, days ago
COLLECTIONS = [(1, 1, 4300, 2), (2, 2, 1500, 4), (3, 3, 500, 3), (4, 4, 200, 5), (5, 5, 4000, 1),
               (6, 6, 620, 2), (7, 7, 1250, 6), (8, 8, 800, 7), (15, 7, 2600, 2)]
ISSUES = [(1, 1, 100, 10), (1, 2, 80, 8), (2, 3, 120, 7), (3, 4, 50, 5)]
RETURNS = [(1, 1, 10, 3), (2, 3, 5, 2)]


def sale_item_rows(sale_id: int):
    """The two seed lines of a sale (rule of the seed generator)."""
    q1, p1 = sale_id % 10 + 1, 50 + sale_id * 10
    q2, p2 = sale_id % 5 + 1, 80 + sale_id * 5
    return [(sale_id, sale_id % 15 + 1, q1, p1, q1 * p1), (sale_id, (sale_id + 5) % 15 + 1, q2, p2, q2 * p2)]


def seed_tables(spark, as_of: dt.date = dt.date(2024, 6, 30)) -> Tables:
    def at(days):
        return dt.datetime.combine(as_of - dt.timedelta(days=days), dt.time(10, 0))

    def m(x):
        return Decimal(x).quantize(Decimal("0.01"))

    def frame(name, rows, cols):
        schema = SCHEMAS[name]
        fields = {f.name: f for f in schema.fields}
        from pyspark.sql import types as T
        sub = T.StructType([fields[c] for c in cols])
        return conform(spark.createDataFrame(rows, sub), schema)

    item_rows = [r for i in range(1, len(SALES) + 1) for r in sale_item_rows(i)]
    return Tables(
        districts=frame("districts", [(i, c, n) for i, (c, n) in enumerate(DISTRICTS, 1)], ["id", "code", "name"]),
        towns=frame("towns", [(i, c, n, d) for i, (c, n, d) in enumerate(TOWNS, 1)],
                    ["id", "code", "name", "district_id"]),
        routes=frame("routes", [(i, c, n, tw) for i, (c, n, tw) in enumerate(ROUTES, 1)],
                     ["id", "code", "name", "town_id"]),
        products=frame("products", [(i, c, n, m(p), s, mn, u, cat, 1)
                                    for i, (c, n, p, s, mn, u, cat) in enumerate(PRODUCTS, 1)],
                       ["id", "code", "name", "unit_price", "stock_quantity", "min_stock_level", "unit", "category",
                        "is_active"]),
        product_categories=frame("product_categories",
                                 [(1, "FOOD", "food", "Food"), (2, "CLEANING", "cleaning", "Cleaning"),
                                  (3, "ELECTRONICS", "electronics", "Electronics"),
                                  (4, "GENERAL", "general", "General")], ["id", "code", "value", "name"]),
        salespersons=frame("salespersons", [(i, c, n, ph, v, m(tg), 1)
                                            for i, (c, n, ph, v, tg) in enumerate(SALESPERSONS, 1)],
                           ["id", "code", "name", "contact_number", "vehicle_number", "target_amount", "is_active"]),
        shops=frame("shops", [(i, c, n, o, ph, d, tw, r, m(cl), m(cb), 1)
                              for i, (c, n, o, ph, d, tw, r, cl, cb) in enumerate(SHOPS, 1)],
                    ["id", "code", "name", "owner_name", "contact_number", "district_id", "town_id", "route_id",
                     "credit_limit", "current_balance", "is_active"]),
        salesperson_stock=frame("salesperson_stock", [(i, sp, p, q) for i, (sp, p, q) in enumerate(FIELD_STOCK, 1)],
                                ["id", "salesperson_id", "product_id", "quantity"]),
        sales=frame("sales", [(i, at(d), sh, sp, r, m(tot), m(pd), m(bal), pt)
                              for i, (sh, sp, r, tot, pd, bal, pt, d) in enumerate(SALES, 1)],
                    ["id", "date", "shop_id", "salesperson_id", "route_id", "total_amount", "paid_amount",
                     "balance_amount", "payment_type"]),
        sale_items=frame("sale_items", [(i, s, p, q, m(up), m(tp)) for i, (s, p, q, up, tp) in enumerate(item_rows, 1)],
                         ["id", "sale_id", "product_id", "quantity", "unit_price", "total_price"]),
        collections=frame("collections", [(i, at(d), sh, sp, m(a)) for i, (sh, sp, a, d) in enumerate(COLLECTIONS, 1)],
                          ["id", "date", "shop_id", "salesperson_id", "amount"]),
        stock_issues=frame("stock_issues", [(i, at(d), sp, p, q) for i, (sp, p, q, d) in enumerate(ISSUES, 1)],
                           ["id", "date", "salesperson_id", "product_id", "quantity_issued"]),
        stock_returns=frame("stock_returns", [(i, at(d), sp, p, q) for i, (sp, p, q, d) in enumerate(RETURNS, 1)],
                            ["id", "date", "salesperson_id", "product_id", "quantity_returned"]),
    )
