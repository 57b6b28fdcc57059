"""L3..L5: command batches → legs → exact first-come, all-or-nothing admission.

Sequential rule (the reference runs one command at a time in a
transaction): commands are taken in (ts, cmd_id) order; a command is
accepted iff, at its turn, every leg has ``level ≥ need``; then all its
deltas apply, otherwise nothing changes.

At scale this is decided set-wise, in rounds (``admit``).  For command
*i* and its leg on key *k*, over the earlier legs on *k*:

    low  = level + Σ accepted deltas + Σ undecided negative deltas
    high = level + Σ accepted deltas + Σ undecided positive deltas

*i* is accepted when ``low ≥ need`` on every leg and rejected when
``high < need`` on some leg.  The earliest undecided command has
low = high, so each round decides at least one command and the result
equals the sequential one.  Prefix sums run per (key, day bucket) plus
per-key bucket offsets, so a hot key is spread over many tasks; decided
prefixes are folded into the level and dropped every round, and each
round's state is cut from its lineage with a reliable checkpoint.
"""

from __future__ import annotations

import logging
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.windows import dense_ids, running_totals
from ..schema import MONEY
from ..session import drop_tables, ensure_checkpoint_dir, last_written, materialize, written
from ..tables import Tables
from .hotkeys import KEYS, ORDER, split_hot_keys

log = logging.getLogger(__name__)

ACCEPTED, REJECTED, OPEN = "accepted", "rejected", "open"

# The command kinds of the batch interface.
KINDS = ("issue", "return", "sale", "collection", "sale_update", "sale_delete", "collection_delete",
         "return_update", "return_delete", "issue_update", "issue_delete")


def _m(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(MONEY)


def _leg(seq: int, resource: str, k1, k2, need, delta) -> Column:
    none = F.lit(None).cast(MONEY)
    return F.struct(F.lit(seq).alias("seq"), F.lit(resource).alias("resource"),
                    (k1 if isinstance(k1, Column) else F.lit(k1)).cast("bigint").alias("k1"),
                    (k2 if isinstance(k2, Column) else F.lit(k2)).cast("bigint").alias("k2"),
                    (none if need is None else _m(need)).alias("need"), _m(delta).alias("delta"))


def _explode_legs(df: DataFrame, legs: list[Column]) -> DataFrame:
    arr = F.filter(F.array(*legs), lambda x: x.isNotNull() & x["delta"].isNotNull())
    return df.select("cmd_id", "ts", F.explode(arr).alias("l")).select("cmd_id", "ts", "l.*")


# Numbers of the fact families in the keys of resource ``fact``.
FAMILIES = {"sale": 1, "collection": 2, "return": 3, "issue": 4}


def family(kind: Column) -> Column:
    """Family number of a referring command's fact."""
    out = F.lit(None).cast("bigint")
    for name, number in FAMILIES.items():
        out = F.when(kind.startswith(name + "_"), F.lit(number).cast("bigint")).otherwise(out)
    return out


# ---------------------------------------------------------------- L3
def stored_values(commands: DataFrame, t: Tables) -> dict[str, DataFrame]:
    """What the facts hold that updates and deletes refer to, per command, as stored:
    ``sale`` (cmd_id, o_sp, o_shop, o_bal), ``lines`` (cmd_id, product_id, o_q), ``collection``
    (cmd_id, c_shop, c_amount) and ``move`` (cmd_id, m_sp, m_p, m_q); no row where there is no such fact."""
    k = F.lower(F.trim("kind"))
    refs = commands.select("cmd_id", "ref_id", k.alias("kind")).filter(F.col("ref_id").isNotNull())
    sales = refs.filter(F.col("kind").isin("sale_update", "sale_delete"))
    facts = lambda df, *cols: df.select(F.col("id").alias("ref_id"), *cols)
    lines = t.sale_items.groupBy(F.col("sale_id").alias("ref_id"), "product_id").agg(F.sum("quantity").alias("o_q"))

    def moved(name, table, qty):
        return (refs.filter(F.col("kind").isin(f"{name}_update", f"{name}_delete"))
                .join(facts(table, F.col("salesperson_id").alias("m_sp"), F.col("product_id").alias("m_p"), F.col(qty).alias("m_q")), "ref_id")
                .select("cmd_id", "m_sp", "m_p", "m_q"))

    return {
        "sale": sales.join(facts(t.sales, F.col("salesperson_id").alias("o_sp"), F.col("shop_id").alias("o_shop"),
                                 F.col("balance_amount").alias("o_bal")), "ref_id").select("cmd_id", "o_sp", "o_shop", "o_bal"),
        "lines": sales.join(lines, "ref_id").select("cmd_id", "product_id", "o_q"),
        "collection": refs.filter(F.col("kind") == "collection_delete").join(
            facts(t.collections, F.col("shop_id").alias("c_shop"), F.col("amount").alias("c_amount")), "ref_id").select("cmd_id", "c_shop", "c_amount"),
        "move": moved("return", t.stock_returns, "quantity_returned").unionByName(moved("issue", t.stock_issues, "quantity_issued")),
    }


def to_legs(commands: DataFrame, t: Tables, old: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """L3: validate commands, consolidate lines per product, expand to legs.

    ``old``: what the facts that commands refer to hold at each command's turn
    (``stored_values``, the default, or ``chains.values_at_turn``).

    Returns ``(legs, rejects)``: legs ``(cmd_id, ts, resource, k1, k2,
    need, delta)`` with one leg per command and key, and commands refused
    by a shape or reference rule (they consume nothing) with the reasons.

    Issues and returns of one line, sales and collections whose ``cmd_id`` no other command has are judged row by
    row (``_plain_legs``); whatever is left is grouped by command (``_grouped_legs``).  Both give the same rows."""
    return _to_legs(commands, t, old, repeated_ids(commands))


def repeated_ids(commands: DataFrame) -> DataFrame | None:
    """Ids (a NULL one too) that more than one command has, or None."""
    again = materialize(commands.groupBy("cmd_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or cmd_id is null").select("cmd_id"), "repeated-commands")
    return None if again.isEmpty() else again


def _to_legs(commands: DataFrame, t: Tables, old: dict[str, DataFrame] | None, again: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    cmd = commands.withColumn("kind", F.lower(F.trim("kind")))
    plain = F.coalesce(_is_plain(), F.lit(False))
    alone, rest = cmd.filter(plain), cmd.filter(~plain)
    if again is not None:
        alone = alone.filter(F.col("cmd_id").isNotNull()).join(again, "cmd_id", "left_anti")
        rest = rest.unionByName(cmd.filter(plain).join(again, "cmd_id", "left_semi")).unionByName(cmd.filter(plain & F.col("cmd_id").isNull()))
    legs, rejects = _plain_legs(alone, t)
    if rest.isEmpty():
        return legs, rejects
    more, refused = _grouped_legs(rest, t, old)
    return legs.unionByName(more), rejects.unionByName(refused)


#: Longest list of lines in which a product is summed up by looking through the list again.
_SHORT = 64


def _is_plain() -> Column:
    """Commands that ``_plain_legs`` takes, if no other has their ``cmd_id``."""
    k, items = F.col("kind"), F.col("items")
    size = F.coalesce(F.size(items), F.lit(0))
    products = F.transform(items, lambda x: x["product_id"])
    move = k.isin("issue", "return") & F.col("shop_id").isNull() & (size <= 1)
    sale = (k == "sale") & (items.isNull() | (size <= _SHORT) | (F.size(F.array_distinct(products)) == size))
    return (k == "collection") | ((move | sale) & (items.isNull() | ~F.exists(items, lambda x: x.isNull())))


def _reasons(checks: list[Column]) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.array(*checks), lambda x: x.isNotNull())))


def _refused(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("_reasons") > 0).select("cmd_id", F.array_join("_reasons", "; ").alias("reason"))


def _plain_legs(cmd: DataFrame, t: Tables) -> tuple[DataFrame, DataFrame]:
    """(legs, rejects) of commands of which each is one row with all its lines: a join to products for issues and returns,
    one to shops for sales and collections, and no grouping."""
    products = t.products.filter(F.col("id").isNotNull()).groupBy(F.col("id").alias("product_id")).agg(
        F.count(F.lit(1)).alias("p_rows"), F.max(F.when(F.coalesce("is_active", F.lit(0)) != 1, 1).otherwise(0)).alias("p_bad"))
    # A shop that is stored more than once counts once for a sale's lines: by its most active row.
    inactive = F.coalesce("is_active", F.lit(0)) != 1
    shops = t.shops.filter(F.col("id").isNotNull()).select(
        F.col("id").alias("shop_id"), inactive.alias("s_bad"),
        (F.row_number().over(Window.partitionBy("id").orderBy(inactive)) == 1).alias("s_first"))
    bad_item = lambda x: x["product_id"].isNull() | ~F.coalesce(x["quantity"] > 0, F.lit(False))
    items, k = F.col("items"), F.col("kind")
    no_items = (F.coalesce(F.size(items), F.lit(0)) <= 0).alias("no_items")
    bad_qty = F.coalesce(F.exists(items, bad_item), F.lit(False)).alias("bad_qty")

    moves = cmd.filter(k.isin("issue", "return")).select(
        "cmd_id", "ts", (k == "issue").alias("is_issue"), "salesperson_id", F.get(items, F.lit(0))["product_id"].alias("product_id"),
        F.get(items, F.lit(0))["quantity"].alias("q"), no_items, bad_qty)
    moves = moves.join(products, "product_id", "left").withColumn("_reasons", _reasons([
        F.when(F.col("salesperson_id").isNull(), "missing required fields"), F.when(F.col("no_items"), "no items"),
        F.when(F.col("bad_qty"), "quantity must be positive"),
        F.when(F.coalesce("p_bad", F.lit(1)) == 1, "product missing or inactive")]))
    q, sp, p = F.col("q"), F.col("salesperson_id"), F.col("product_id")
    issued, returned = ([_leg(1, "warehouse", p, -1, q, -q), _leg(2, "field", sp, p, None, q)],
                        [_leg(1, "field", sp, p, q, -q), _leg(2, "warehouse", p, -1, None, q)])
    # Its legs come as often as its product is stored.
    moved = (moves.filter(F.size("_reasons") == 0)
             .withColumn("l", F.explode(F.when(F.col("is_issue"), F.array(*issued)).otherwise(F.array(*returned))))
             .withColumn("l", F.explode(F.array_repeat("l", F.col("p_rows").cast("int")))))

    # One line per product of a sale.
    product, quantity = lambda x: x["product_id"], lambda x: x["quantity"].cast("bigint")
    ids = F.array_distinct(F.transform(items, product))
    summed = F.transform(ids, lambda i: F.struct(i.alias("product_id"), F.aggregate(
        F.filter(items, lambda x: x["product_id"].eqNullSafe(i)), F.lit(0).cast("bigint"),
        lambda a, x: a + F.coalesce(quantity(x), F.lit(0))).alias("q")))
    single = F.transform(items, lambda x: F.struct(product(x).alias("product_id"), quantity(x).alias("q")))
    lines = F.when(F.size(ids) == F.size(items), single).otherwise(summed)
    sales = cmd.filter(k == "sale").select("cmd_id", "ts", "salesperson_id", "shop_id", "amount", no_items, bad_qty, lines.alias("lines"))
    sales = sales.join(shops, "shop_id", "left").withColumn("_reasons", _reasons([
        F.when(F.col("salesperson_id").isNull() | F.col("shop_id").isNull(), "missing required fields"), F.when(F.col("no_items"), "no items"),
        F.when(F.col("bad_qty"), "quantity must be positive"),
        F.when((F.coalesce("amount", F.lit(0)) > 0) & F.coalesce("s_bad", F.lit(True)), "shop missing or inactive")]))
    good = sales.filter(F.size("_reasons") == 0)
    of_lines = F.transform(F.when(F.coalesce("s_first", F.lit(True)), F.col("lines")).otherwise(F.array().cast("array<struct<product_id:bigint,q:bigint>>")),
                           lambda x: _leg(3, "field", sp, x["product_id"], x["q"], -x["q"]))
    owed = F.when(F.col("amount") > 0, F.array(_leg(4, "debt", F.col("shop_id"), -1, None, F.col("amount"))))
    sold = good.withColumn("l", F.explode(F.concat(of_lines, F.coalesce(owed, F.array().cast(_LEGS)))))
    copies = materialize(products.filter("p_rows > 1").select("product_id", "p_rows"), "repeated-products")
    if not copies.isEmpty():
        of = F.when(F.col("l.resource") == "field", F.col("l.k2")).alias("product_id")
        sold = (sold.select("cmd_id", "ts", "l", of).join(copies, "product_id", "left")
                .withColumn("l", F.explode(F.array_repeat("l", F.coalesce("p_rows", F.lit(1)).cast("int")))))

    paid = cmd.filter(k == "collection").select("cmd_id", "ts", "salesperson_id", "shop_id", "amount")
    paid = paid.join(shops.drop("s_first"), "shop_id", "left").withColumn("_reasons", _reasons([
        F.when(F.col("shop_id").isNull() | F.col("salesperson_id").isNull() | F.col("amount").isNull(), "missing required fields"),
        F.when(F.coalesce("amount", F.lit(0)) <= 0, "amount must be positive"),
        F.when(F.coalesce("s_bad", F.lit(True)), "shop missing or inactive")]))
    settled = paid.filter(F.size("_reasons") == 0).withColumn("l", _leg(1, "debt", F.col("shop_id"), -1, F.col("amount"), -F.col("amount")))

    legs = _union([x.select("cmd_id", "ts", *[F.col(f"l.{c}").alias(c) for c in (*KEYS, "need", "delta")]) for x in (moved, sold, settled)], None)
    return legs.filter(F.col("delta").isNotNull()), _union([_refused(x) for x in (moves, sales, paid)], None)


_LEGS = "array<struct<seq:int,resource:string,k1:bigint,k2:bigint,need:decimal(18,2),delta:decimal(18,2)>>"


def _grouped_legs(commands: DataFrame, t: Tables, old: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(legs, rejects) of any commands.

    Every command becomes one row carrying everything its checks need
    (line flags, shop and product flags, the referenced old fact), all
    checks are one array expression, and legs are built from the rows
    without a reason.  Only the branches of kinds present in the batch are
    planned (one small distinct-kind query decides that)."""
    kind = F.lower(F.trim("kind"))
    present = {r[0] for r in commands.select(kind.alias("k")).filter(F.col("k").isin(*KINDS)).distinct().collect()}
    cmd = commands.withColumn("kind", kind)
    spark = commands.sparkSession
    products = t.products.select(F.col("id").alias("product_id"), F.col("is_active").alias("p_active"))
    shops = t.shops.select(F.col("id").alias("shop_id"), F.col("is_active").alias("s_active"))
    k = F.col("kind")

    head = cmd.select("cmd_id", "ts", "kind", "salesperson_id", "shop_id", "ref_id", "amount",
                      F.col("items")[0]["product_id"].alias("n_p"), F.col("items")[0]["quantity"].alias("n_q"))
    head = head.join(shops, "shop_id", "left")

    item_kinds = [x for x in ("issue", "return", "sale", "sale_update") if x in present]
    per_product = None
    if item_kinds:
        lines = (cmd.filter(k.isin(*item_kinds))
                 .select("cmd_id", "ts", "kind", "salesperson_id", F.explode_outer("items").alias("it"))
                 .select("cmd_id", "ts", "kind", "salesperson_id", F.col("it.product_id").alias("product_id"),
                         F.col("it.quantity").alias("quantity"), F.col("it").isNotNull().cast("int").alias("given"),
                         (F.col("it").isNotNull() & (F.col("it.product_id").isNull()
                          | ~F.coalesce(F.col("it.quantity") > 0, F.lit(False)))).cast("int").alias("bad_line")))
        per_product = (lines.groupBy("cmd_id", "ts", "kind", "salesperson_id", "product_id")
                       .agg(F.sum("quantity").alias("q"), F.max("bad_line").alias("bad_line"),
                            F.sum("given").alias("n_lines"))
                       .join(products, "product_id", "left"))
        per_product = materialize(per_product, "command-lines")
        flags = per_product.groupBy("cmd_id").agg(
            F.max(F.when(F.col("n_lines") == 0, 1).otherwise(0)).alias("no_items"),
            F.max("bad_line").alias("bad_qty"),
            F.max(F.when(F.col("kind").isin("issue", "return") & (F.col("p_active").isNull() | (F.col("p_active") != 1)), 1)
                  .otherwise(0)).alias("bad_product"))
        head = head.join(flags, "cmd_id", "left")

    # What the referenced facts hold, one left join per family present.
    old = old or stored_values(cmd, t)
    sale_ref = present & {"sale_update", "sale_delete"}
    coll_ref = "collection_delete" in present
    move_ref = present & {"return_update", "return_delete", "issue_update", "issue_delete"}
    o_active = shops.select(F.col("shop_id").alias("o_shop"), F.col("s_active").alias("o_active"))
    if sale_ref:
        head = head.join(old["sale"].withColumn("s_found", F.lit(True)).join(o_active, "o_shop", "left"), "cmd_id", "left")
    if coll_ref:
        head = head.join(old["collection"].join(o_active.withColumnsRenamed({"o_shop": "c_shop", "o_active": "c_active"}),
                                                "c_shop", "left"), "cmd_id", "left")
    if move_ref:
        moved = old["move"].join(products.select(F.col("product_id").alias("m_p"), F.col("p_active").alias("m_p_active")), "m_p", "left")
        head = head.join(moved, "cmd_id", "left")
        head = (head.withColumn("n_sp", F.coalesce("salesperson_id", "m_sp"))
                .withColumn("n_p2", F.coalesce("n_p", "m_p")).withColumn("n_q2", F.coalesce("n_q", "m_q"))
                .withColumn("same_pair", (F.col("n_sp") == F.col("m_sp")) & (F.col("n_p2") == F.col("m_p"))))
        head = head.join(products.select(F.col("product_id").alias("n_p2"), F.col("p_active").alias("n_p_active")), "n_p2", "left")

    def col_or_null(name):
        return F.col(name) if name in head.columns else F.lit(None)

    checks: list[Column] = [F.when(~k.isin(*KINDS) | k.isNull(), "unknown kind")]
    is_item = k.isin("issue", "return", "sale", "sale_update")
    checks.append(F.when(is_item & (F.col("salesperson_id").isNull() | (k.isin("sale", "sale_update") & F.col("shop_id").isNull())),
                         "missing required fields"))
    checks += [F.when(is_item & (F.coalesce(col_or_null("no_items"), F.lit(1)) == 1), "no items"),
               F.when(is_item & (col_or_null("bad_qty") == 1), "quantity must be positive"),
               F.when(is_item & (col_or_null("bad_product") == 1), "product missing or inactive")]
    inactive = F.coalesce("s_active", F.lit(0)) != 1
    checks.append(F.when(k.isin("sale", "sale_update") & (F.coalesce("amount", F.lit(0)) > 0) & inactive, "shop missing or inactive"))
    is_coll = k == "collection"
    checks += [F.when(is_coll & (F.col("shop_id").isNull() | F.col("salesperson_id").isNull()
                                 | F.col("amount").isNull()), "missing required fields"),
               F.when(is_coll & (F.coalesce("amount", F.lit(0)) <= 0), "amount must be positive"),
               F.when(is_coll & inactive, "shop missing or inactive")]
    if sale_ref:
        is_s = k.isin("sale_update", "sale_delete")
        checks += [F.when(is_s & F.col("s_found").isNull(), "sale not found"),
                   F.when((k == "sale_delete") & (F.coalesce("o_bal", F.lit(0)) > 0) & (F.coalesce("o_active", F.lit(0)) != 1),
                          "shop missing or inactive")]
    if coll_ref:
        is_c = k == "collection_delete"
        checks += [F.when(is_c & F.col("c_amount").isNull(), "collection not found"),
                   F.when(is_c & F.col("c_amount").isNotNull() & (F.coalesce("c_active", F.lit(0)) != 1),
                          "shop missing or inactive")]
    if move_ref:
        is_m = k.isin("return_update", "return_delete", "issue_update", "issue_delete")
        is_del = k.endswith("_delete")
        need_old = is_del | ~F.col("same_pair") | ((F.col("n_q2") - F.col("m_q")) != 0)
        checks += [F.when(is_m & F.col("m_q").isNull(), "movement not found"),
                   F.when(is_m & F.col("m_q").isNotNull() & need_old
                          & (F.coalesce("m_p_active", F.lit(0)) != 1), "product missing or inactive"),
                   F.when(is_m & F.col("m_q").isNotNull() & ~is_del & ~F.col("same_pair")
                          & (F.coalesce("n_p_active", F.lit(0)) != 1), "product missing or inactive"),
                   F.when(is_m & ~is_del & (F.coalesce("n_q2", F.lit(0)) <= 0), "quantity must be positive")]
    checked = materialize(head.withColumn("_reasons", _reasons(checks)), "command-checks")
    rejects = _refused(checked)
    ok = checked.filter(F.size("_reasons") == 0)

    simple: list[DataFrame] = []    # at most one leg per (command, key) already
    ordered: list[DataFrame] = []   # legs with a sequence, combined per key below
    if per_product is not None:
        q, sp, p = F.col("q"), F.col("salesperson_id"), F.col("product_id")
        valid = per_product.filter(F.col("n_lines") > 0).join(ok.select("cmd_id"), "cmd_id", "left_semi")
        if "issue" in present:
            simple.append(_explode_legs(valid.filter(k == "issue"),
                                        [_leg(1, "warehouse", p, -1, q, -q), _leg(2, "field", sp, p, None, q)]))
        if "return" in present:
            simple.append(_explode_legs(valid.filter(k == "return"),
                                        [_leg(1, "field", sp, p, q, -q), _leg(2, "warehouse", p, -1, None, q)]))
        if "sale" in present:
            simple.append(_explode_legs(valid.filter(k == "sale"), [_leg(3, "field", sp, p, q, -q)]))
    if "sale" in present:
        simple.append(_explode_legs(ok.filter((k == "sale") & (F.col("amount") > 0)),
                                    [_leg(4, "debt", F.col("shop_id"), -1, None, F.col("amount"))]))
    if "collection" in present:
        simple.append(_explode_legs(ok.filter(is_coll), [_leg(1, "debt", F.col("shop_id"), -1, F.col("amount"),
                                                               -F.col("amount"))]))
    if coll_ref:
        simple.append(_explode_legs(ok.filter(k == "collection_delete"),
                                    [_leg(1, "debt", F.col("c_shop"), -1, None, F.col("c_amount"))]))
    referring = present - {"issue", "return", "sale", "collection"}
    if referring:
        # The referenced fact is a resource: a delete takes it away, whatever refers to it later finds its level below 0.
        simple.append(_explode_legs(ok.filter(k.isin(*referring)), [
            _leg(0, "fact", family(k), F.col("ref_id"), F.lit(0), F.when(k.endswith("_delete"), -1).otherwise(0))]))
    if sale_ref:
        s_ok = ok.filter(k.isin("sale_update", "sale_delete"))
        # Restore the old lines and balance, then (update) apply the new sale.
        ordered.append(_explode_legs(s_ok.select("cmd_id", "ts", "o_sp").join(old["lines"], "cmd_id"),
                                     [_leg(1, "field", F.col("o_sp"), F.col("product_id"), None, F.col("o_q"))]))
        ordered.append(_explode_legs(s_ok.filter(F.col("o_bal") > 0),
                                     [_leg(2, "debt", F.col("o_shop"), -1, None, -F.col("o_bal"))]))
        ordered.append(_explode_legs(s_ok.filter((k == "sale_update") & (F.col("amount") > 0)),
                                     [_leg(4, "debt", F.col("shop_id"), -1, None, F.col("amount"))]))
        if "sale_update" in present:
            upd_lines = per_product.filter(k == "sale_update").join(ok.select("cmd_id"), "cmd_id", "left_semi")
            ordered.append(_explode_legs(upd_lines, [_leg(3, "field", F.col("salesperson_id"), F.col("product_id"),
                                                          F.col("q"), -F.col("q"))]))
    if move_ref:
        osp, op, oq = F.col("m_sp"), F.col("m_p"), F.col("m_q")
        nsp, np_, nq = F.col("n_sp"), F.col("n_p2"), F.col("n_q2")
        dq = nq - oq
        plans = {
            "return": dict(
                delete=[_leg(1, "warehouse", op, -1, oq, -oq), _leg(2, "field", osp, op, None, oq)],
                up_pos=[_leg(1, "field", osp, op, dq, -dq), _leg(2, "warehouse", op, -1, None, dq)],
                up_neg=[_leg(1, "warehouse", op, -1, -dq, dq), _leg(2, "field", osp, op, None, -dq)],
                other=[_leg(1, "warehouse", op, -1, oq, -oq), _leg(2, "field", osp, op, None, oq),
                       _leg(3, "field", nsp, np_, nq, -nq), _leg(4, "warehouse", np_, -1, None, nq)]),
            "issue": dict(
                delete=[_leg(1, "field", osp, op, oq, -oq), _leg(2, "warehouse", op, -1, None, oq)],
                up_pos=[_leg(1, "warehouse", op, -1, dq, -dq), _leg(2, "field", osp, op, None, dq)],
                up_neg=[_leg(1, "field", osp, op, -dq, dq), _leg(2, "warehouse", op, -1, None, -dq)],
                other=[_leg(1, "field", osp, op, oq, -oq), _leg(2, "warehouse", np_, -1, nq, -nq),
                       _leg(3, "warehouse", op, -1, None, oq), _leg(4, "field", nsp, np_, None, nq)]),
        }
        # One pass over the rows: each is of one case at most.
        is_del, same = k.endswith("_delete"), F.col("same_pair")
        legs_of = F.lit(None).cast(_LEGS)
        for prefix, cases in plans.items():
            for case, when in (("delete", is_del), ("up_pos", ~is_del & same & (dq > 0)), ("up_neg", ~is_del & same & (dq < 0)), ("other", ~is_del & ~same)):
                legs_of = F.when(k.startswith(prefix + "_") & when, F.array(*cases[case]).cast(_LEGS)).otherwise(legs_of)
        moved = ok.filter(k.startswith("return_") | k.startswith("issue_")).withColumn("l", F.explode(F.filter(legs_of, lambda x: x["delta"].isNotNull())))
        ordered.append(moved.select("cmd_id", "ts", "l.*"))

    leg_cols = ["cmd_id", "ts", *KEYS, "need", "delta"]
    empty_legs = spark.createDataFrame([], "cmd_id bigint, ts timestamp_ntz, resource string, k1 bigint, "
                                           "k2 bigint, need decimal(18,2), delta decimal(18,2)")
    legs = _union([x.select(*leg_cols) for x in simple], empty_legs)
    if ordered:
        # The checks of one command on one key are sequential, so
        # need = max_j(need_j - Σ_{i<j} delta_i) and delta = Σ delta.
        raw = _union(ordered, None)
        w = (Window.partitionBy("cmd_id", "ts", *KEYS).orderBy("seq")
             .rowsBetween(Window.unboundedPreceding, -1))
        prior = F.coalesce(F.sum("delta").over(w), F.lit(0).cast(MONEY))
        combined = (raw.withColumn("_need", F.col("need") - prior).groupBy("cmd_id", "ts", *KEYS)
                    .agg(F.max("_need").cast(MONEY).alias("need"), F.sum("delta").cast(MONEY).alias("delta")))
        legs = legs.unionByName(combined.select(*leg_cols))
    return legs, rejects


def _union(parts: list[DataFrame], empty: DataFrame | None) -> DataFrame:
    if not parts:
        return empty
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- helpers
def opening_levels(t: Tables) -> DataFrame:
    """Stored state as opening levels (resource, k1, k2, level)."""
    from .ledger import state_levels
    return state_levels(t).groupBy(*KEYS).agg(F.sum("level").cast(MONEY).alias("level"))


# ---------------------------------------------------------------- L5
def _cents(c) -> Column:
    """Exact integer cents of a DECIMAL(18,2) amount: long arithmetic in the
    round loop instead of BigDecimal sums (ANSI mode fails on overflow)."""
    return (F.col(c) * 100).cast("bigint")


_OPEN, _ACC, _REJ = 0, 1, 2
_SCAN_SCHEMA = "cmd_id long, resource string, k1 long, k2 long, _ok boolean, _fail boolean"


def _make_scan_keys(incoming=None):
    """The scan as a closure: cloudpickle ships it by value, so executors
    need only numpy and pandas, not this package.

    ``incoming``: (lowest, highest) level before a part of a split key, by (key, part)."""
    accepted, incoming = _ACC, incoming or {}

    def scan_keys(batches):
        """Per-key sequential bound scan (runs inside ``mapInPandas``).

        Rows arrive hash-partitioned by (key, part) and sorted by (key, part, ts, cmd_id);
        the state is two numbers per current part, so a key of any length is
        streamed, never held.  For each open leg: ``ok`` if the lowest possible
        level covers the need, ``fail`` if even the highest cannot.  A leg whose
        command is known to fail elsewhere moves nothing; one that is ok here
        and whose other legs were ok last round is certainly accepted and moves
        the level exactly; otherwise the bounds widen: to what is left if it is accepted
        (at least need + delta) and if it isn't (below the need, if only this leg can refuse)."""
        import numpy as np
        import pandas as pd
        cur, lo, hi = None, 0, 0
        for pdf in batches:
            n = len(pdf)
            res = pdf["resource"].to_numpy()
            k1 = pdf["k1"].to_numpy()
            k2 = pdf["k2"].to_numpy()
            part = pdf["part"].to_numpy()
            level = pdf["level"].to_numpy()
            status = pdf["status"].to_numpy()
            delta = pdf["delta"].to_numpy()
            need = pdf["need0"].to_numpy()
            has_need = pdf["has_need"].to_numpy()
            ext_ok = pdf["ext_ok"].to_numpy()
            ext_fail = pdf["ext_fail"].to_numpy()
            ok_out = np.zeros(n, dtype=bool)
            fail_out = np.zeros(n, dtype=bool)
            keep = np.zeros(n, dtype=bool)
            for i in range(n):
                key = (res[i], k1[i], k2[i], part[i])
                if key != cur:
                    cur = key
                    lo, hi = incoming.get(key, (int(level[i]), int(level[i])))
                d = int(delta[i])
                if status[i] == accepted:
                    lo += d
                    hi += d
                    continue
                ok = (not has_need[i]) or lo >= need[i]
                fail = bool(has_need[i]) and hi < need[i]
                ok_out[i], fail_out[i], keep[i] = ok, fail, True
                if fail or ext_fail[i]:
                    continue
                if ok and ext_ok[i]:
                    lo += d
                    hi += d
                elif d < 0 and not ok:
                    lo = min(lo, int(need[i]) + d)
                    if ext_ok[i]:
                        hi = max(hi + d, int(need[i]) - 1)
                elif d < 0:
                    lo += d
                else:
                    hi += d
            out = pdf.loc[keep, ["cmd_id", "resource", "k1", "k2"]].copy()
            out["_ok"] = ok_out[keep]
            out["_fail"] = fail_out[keep]
            yield pd.DataFrame(out)

    return scan_keys


def _window_flags(active: DataFrame) -> DataFrame:
    """Per open leg ``_ok``/``_fail`` from window prefix sums over each key."""
    zero = F.lit(0).cast("bigint")
    is_acc = F.col("status") == _ACC
    is_open = F.col("status") == _OPEN
    x = (active.withColumn("_acc", F.when(is_acc, F.col("delta")).otherwise(zero))
         .withColumn("_neg", F.when(is_open, F.least("delta", zero)).otherwise(zero))
         .withColumn("_pos", F.when(is_open, F.greatest("delta", zero)).otherwise(zero)))
    x = running_totals(x, KEYS, ORDER, {"acc": "_acc", "neg": "_neg", "pos": "_pos"}, inclusive=False)
    low = F.col("level") + F.col("acc") + F.col("neg")
    high = F.col("level") + F.col("acc") + F.col("pos")
    return (x.filter(is_open)
            .select("cmd_id", *KEYS, (F.col("need").isNull() | (low >= F.col("need"))).alias("_ok"),
                    (F.col("need").isNotNull() & (high < F.col("need"))).alias("_fail")))


def _scan_flags(active: DataFrame, prev: DataFrame, split_legs: int | None = None) -> DataFrame:
    """Per open leg ``_ok``/``_fail`` from the per-key scan, using the
    previous round's leg flags (``prev``) to know what other keys said."""
    per_cmd = prev.groupBy("cmd_id").agg(F.sum(F.when(~F.col("_ok"), 1).otherwise(0)).alias("_nok"),
                                         F.sum(F.when(F.col("_fail"), 1).otherwise(0)).alias("_nf"))
    ext = prev.join(per_cmd, "cmd_id").select(
        "cmd_id", *KEYS,
        ((F.col("_nok") - F.when(~F.col("_ok"), 1).otherwise(0)) == 0).alias("ext_ok"),
        ((F.col("_nf") - F.when(F.col("_fail"), 1).otherwise(0)) > 0).alias("ext_fail"))
    x = (active.join(ext, ["cmd_id", *KEYS], "left")
         .select("cmd_id", "ts", *KEYS, "level", "status", "delta",
                 F.coalesce("need", F.lit(0).cast("bigint")).alias("need0"), F.col("need").isNotNull().alias("has_need"),
                 F.coalesce("ext_ok", F.lit(False)).alias("ext_ok"),
                 F.coalesce("ext_fail", F.lit(False)).alias("ext_fail")))
    x, incoming = split_hot_keys(x, split_legs)
    x = x.repartition(*KEYS, "part").sortWithinPartitions(*KEYS, "part", *ORDER)
    return x.mapInPandas(_make_scan_keys(incoming), _SCAN_SCHEMA)


def admit(legs: DataFrame, levels: DataFrame, commands: DataFrame | None = None, split_legs: int | None = None) -> DataFrame:
    """Exact first-come, all-or-nothing admission of multi-key commands.

    ``legs``: (cmd_id, ts, resource, k1, k2, need, delta), one per command
    and key (``to_legs``).  ``levels``: opening (resource, k1, k2, level);
    absent keys start at 0.  Returns (cmd_id, status, round, method) for
    every command with legs, plus ``commands`` ids without legs as accepted.

    Legs on keys that cover whatever is asked of them (``tight_keys``) take no part in the rounds.
    The rounds are the same for every batch size.  The first takes prefix sums
    split by ranges of (key, order), which settle all legs without contention
    (most) with a hot key spread over many tasks.  The later ones scan what is left
    of each key in order (``_make_scan_keys``) with the previous round's leg
    verdicts and settle long chains in few rounds; a scan streams a key with two
    numbers of state, never holds it.  A key with very many open legs is cut into parts
    that are scanned at once, from levels found by composing the parts' effects
    (``hotkeys``; ``split_legs`` overrides its threshold).  Both are exact and each settles at least the earliest open command."""
    decided, held = _rounds(legs, levels, split_legs)
    # Commands of which no leg is on a key where one may not fit: the first round's sums would settle them.
    free = legs.select("cmd_id").distinct().join(held.withColumnRenamed("cmd_id", "_held"), F.col("cmd_id").eqNullSafe(F.col("_held")), "left_anti")
    out = decided.unionByName(free.select("cmd_id", F.lit(ACCEPTED).alias("status"), F.lit(1).alias("round"), F.lit("window").alias("method")))
    if commands is not None:
        legless = commands.select("cmd_id").join(legs.select("cmd_id").distinct(), "cmd_id", "left_anti")
        out = out.unionByName(legless.select("cmd_id", F.lit(ACCEPTED).alias("status"), F.lit(0).alias("round"),
                                             F.lit("none").alias("method")))
    return out


def tight_keys(legs: DataFrame, levels: DataFrame) -> DataFrame:
    """(KEYS, level) of keys on which a leg may not fit (need and delta in cents): if all others that take from the key were
    accepted, it would not cover the leg's need.  On any other key every leg fits, whatever is decided."""
    lv = levels.groupBy(*KEYS).agg(F.sum("level").cast(MONEY).alias("level")).select(*KEYS, _cents("level").alias("level"))
    zero = F.lit(0).cast("bigint")
    sums = legs.groupBy(*KEYS).agg(F.sum(F.least("delta", zero)).alias("_drop"), F.max(F.col("need") + F.least("delta", zero)).alias("_most")).filter("_most is not null")
    return (sums.join(lv, KEYS, "left").withColumn("level", F.coalesce("level", zero)).filter(F.col("level") + F.col("_drop") < F.col("_most"))
            .select(*KEYS, "level"))


def in_cents(legs: DataFrame) -> DataFrame:
    return legs.select("cmd_id", "ts", *KEYS, _cents("need").alias("need"), _cents("delta").alias("delta"))


def on_keys(legs: DataFrame, keys: DataFrame, *more: str) -> DataFrame:
    """The legs on ``keys``, NULLs included, with ``more`` columns of these."""
    k = keys.select(*[F.col(c).alias(f"_{c}") for c in KEYS], *more)
    same = (F.col("resource") == F.col("_resource")) & F.col("k1").eqNullSafe(F.col("_k1")) & F.col("k2").eqNullSafe(F.col("_k2"))
    return legs.join(k, same).select(*legs.columns, *more)


def _rounds(legs: DataFrame, levels: DataFrame, split_legs: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The rounds of ``admit``: (cmd_id, status, round, method) of the commands with a leg on a tight key, and their ids."""
    spark = legs.sparkSession
    ensure_checkpoint_dir(spark)
    # The legs on tight keys with their opening level are written once, so that no round joins them anew.
    mark = written()
    cents = in_cents(legs)
    active = materialize(on_keys(cents, tight_keys(cents, levels), "level").withColumn("status", F.lit(_OPEN)), "admit-active")
    held = materialize(active.select("cmd_id").distinct(), "admit-held")
    held_at = last_written()
    zero = F.lit(0).cast("bigint")
    decided: list[DataFrame] = []
    verdicts: list[str] = []
    n_open = active.count()
    rnd, prev_flags, scanning = 0, None, False
    while n_open:
        rnd += 1
        t_round = time.perf_counter()
        method = "scan" if scanning else "window"
        inner = written()
        flags = _scan_flags(active, prev_flags, split_legs) if scanning else _window_flags(active)
        flags = materialize(flags, "admit-flags")  # read again by the next round
        flags_at = last_written()
        drop_tables(spark, inner, (flags_at,))
        verdict = (flags.groupBy("cmd_id")
                   .agg(F.bool_and("_ok").alias("all_ok"), F.bool_or("_fail").alias("any_fail"))
                   .select("cmd_id", F.when(F.col("any_fail"), F.lit(_REJ)).when(F.col("all_ok"), F.lit(_ACC))
                           .alias("new_status")))
        # The undecided commands too: what is left of a batch follows from these, mostly few.
        verdict = materialize(verdict, "admit-verdict")
        verdicts.append(last_written())
        t_verdict = time.perf_counter()
        known = verdict.filter(F.col("new_status").isNotNull())
        decided.append(known.select("cmd_id", "new_status", F.lit(rnd).alias("round"), F.lit(method).alias("method")))
        # Fold: per key, decided legs before the first open leg go into the level; keys without an open leg are settled.
        left = active.filter(F.col("status") == _OPEN).join(
            verdict.filter(F.col("new_status").isNull()).select("cmd_id"), "cmd_id", "left_semi")
        first_open = materialize(left.groupBy(*KEYS).agg(F.min(F.struct(*ORDER)).alias("_first")), "admit-first")
        u = (active.join(first_open, KEYS).join(known, "cmd_id", "left")
             .withColumn("status", F.coalesce("new_status", "status")).drop("new_status"))
        u = materialize(u, "admit-updated")
        before = F.struct(*ORDER) < F.col("_first")
        fold = (u.filter(before & (F.col("status") == _ACC)).groupBy(*KEYS)
                .agg(F.sum("delta").alias("_fold")))
        keep = u.filter(~before & (F.col("status") != _REJ)).drop("_first")
        active = (keep.join(fold, KEYS, "left")
                  .withColumn("level", F.col("level") + F.coalesce("_fold", zero))
                  .drop("_fold"))
        active = materialize(active, "admit-active")
        # What the next round doesn't read is dropped; verdicts stay (they are the result).
        drop_tables(spark, mark, (*verdicts, held_at, flags_at, last_written()))
        before_round, n_open = n_open, active.filter(F.col("status") == _OPEN).count()
        if n_open >= before_round:
            raise RuntimeError("an admission round settled nothing")
        log.info("admission round %d (%s): %d legs still open (flags %.1fs, state %.1fs)", rnd, method, n_open,
                 t_verdict - t_round, time.perf_counter() - t_verdict)
        scanning, prev_flags = True, flags
    drop_tables(spark, mark, (*verdicts, held_at))
    empty = spark.createDataFrame([], "cmd_id bigint, new_status int, round int, method string")
    out = _union(decided, empty)
    out = out.select("cmd_id", F.when(F.col("new_status") == _ACC, ACCEPTED).otherwise(REJECTED).alias("status"),
                     "round", "method")
    return out, held


def admit_single(legs: DataFrame, levels: DataFrame, **kw) -> DataFrame:
    """L4: admission when every command touches one key (checked).  A
    per-key scan settles every command of a single-key batch in one round,
    the second."""
    multi = legs.groupBy("cmd_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).limit(1).count()
    if multi:
        raise ValueError("admit_single needs commands with exactly one leg; use admit")
    return admit(legs, levels, **kw)


def accepted_deltas(legs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Deltas of accepted commands, ready for ``ledger.apply_levels``."""
    ok = decisions.filter(F.col("status") == ACCEPTED).select("cmd_id")
    return legs.join(ok, "cmd_id", "left_semi").select(*KEYS, "delta")


def decide(commands: DataFrame, t: Tables, old: dict[str, DataFrame] | None = None, written: bool = False, levels: DataFrame | None = None,
           **kw) -> tuple[DataFrame, DataFrame]:
    """L3 + L5: decisions for a command batch against the stored state.

    A command that refers to a fact which an earlier command of the same batch
    deletes is rejected.  A chain of updates on one fact needs the new values
    in between: ``chains.settle`` decides such batches, with ``old`` at each command's turn.
    ``written``: the commands are read from written tables and needn't be written again.  ``levels``: the opening ones of ``t``, if at hand.
    Returns (decisions (cmd_id, status, reason), legs)."""
    if not written:
        commands = materialize(commands, "admit-commands")   # read several times below
    again = repeated_ids(commands)
    legs, rejects = _to_legs(commands, t, old, again)
    legs, rejects = materialize(legs, "admit-legs"), materialize(rejects, "admit-rejects")
    return _decided(commands.select("cmd_id"), legs, rejects, opening_levels(t) if levels is None else levels, again is not None, **kw), legs


def _decided(commands: DataFrame, legs: DataFrame, rejects: DataFrame, levels: DataFrame, repeated: bool, **kw) -> DataFrame:
    """(cmd_id, status, reason) of commands with these legs and rejects."""
    rest = commands.join(rejects, "cmd_id", "left_anti")
    if repeated:
        dec = admit(legs, levels, commands=rest, **kw)
    else:  # whatever has no leg on a tight key is accepted
        dec, held = _rounds(legs, levels, **kw)
        dec = dec.select("cmd_id", "status").unionByName(rest.join(held, "cmd_id", "left_anti").select("cmd_id", F.lit(ACCEPTED).alias("status")))
    return (dec.select("cmd_id", "status", F.lit(None).cast("string").alias("reason"))
            .unionByName(rejects.select("cmd_id", F.lit(REJECTED).alias("status"), "reason")))


# ---------------------------------------------------------------- history as a command feed
def commands_from_history(t: Tables, kinds: tuple[str, ...] = ("issue", "return", "sale", "collection")) -> DataFrame:
    """The stored facts replayed as a command feed (issues, returns, sales,
    collections, or those ``kinds`` of them), each fact one command, for reconciliation runs.

    Command ids: ``kind rank × 10^12 + fact id``; issues and returns carry
    no id in every source, so they are numbered densely by their content.
    For a fixture bundle what is written of the feed is built once per session, kind by kind."""
    from ..sources.testdata import derived
    parts = {"issue": lambda tt: _movement_cmds(tt.stock_issues, "quantity_issued", "issue", 1, ["vehicle_number"]),
             "return": lambda tt: _movement_cmds(tt.stock_returns, "quantity_returned", "return", 2, ["reason", "condition", "notes"]),
             "sale": lambda tt: materialize(_sale_cmds(tt), "history-sales"), "collection": _collection_cmds}
    out = _union([derived(t, f"history-{k}", parts[k]) for k in kinds], None)
    return out.select("cmd_id", "ts", "kind", "salesperson_id", "shop_id", "ref_id", "amount", "items",
                      *[F.lit(None).cast(tp).alias(c) for c, tp in
                        [("reason", "string"), ("condition", "string"), ("inspection_required", "int"),
                         ("notes", "string"), ("vehicle_number", "string")]])


def _movement_cmds(df: DataFrame, qty: str, kind: str, rank: int, more: list[str]) -> DataFrame:
    """Read from the numbered rows that ``dense_ids`` writes."""
    held = ["date", "salesperson_id", "product_id", qty]
    numbered = dense_ids(df.select(*held, *more), [*held, *more], 0, "_n", keep=held)
    return numbered.select(
        (F.lit(rank * 10**12) + F.col("_n")).alias("cmd_id"), F.col("date").alias("ts"), F.lit(kind).alias("kind"),
        "salesperson_id", F.lit(None).cast("bigint").alias("shop_id"),
        F.lit(None).cast("bigint").alias("ref_id"), F.lit(None).cast(MONEY).alias("amount"),
        F.array(F.struct(F.col("product_id").cast("bigint").alias("product_id"),
                         F.col(qty).cast("bigint").alias("quantity"),
                         F.lit(None).cast(MONEY).alias("unit_price"))).alias("items"))


def _sale_cmds(t: Tables) -> DataFrame:
    lines = (t.sale_items.groupBy("sale_id")
             .agg(F.collect_list(F.struct(F.col("product_id").cast("bigint").alias("product_id"),
                                          F.col("quantity").cast("bigint").alias("quantity"),
                                          F.col("unit_price").cast(MONEY).alias("unit_price")))
                  .alias("items")))  # lines of one sale; their order does not matter (consolidated per product)
    return t.sales.join(lines.withColumnRenamed("sale_id", "id"), "id", "left").select(
        (F.lit(3 * 10**12) + F.col("id")).alias("cmd_id"), F.col("date").alias("ts"), F.lit("sale").alias("kind"),
        "salesperson_id", "shop_id", F.lit(None).cast("bigint").alias("ref_id"),
        F.col("balance_amount").cast(MONEY).alias("amount"), "items")


def _collection_cmds(t: Tables) -> DataFrame:
    return t.collections.select(
        (F.lit(4 * 10**12) + F.col("id")).alias("cmd_id"), F.col("date").alias("ts"),
        F.lit("collection").alias("kind"), "salesperson_id", "shop_id", F.lit(None).cast("bigint").alias("ref_id"),
        F.col("amount").cast(MONEY).alias("amount"),
        F.lit(None).cast("array<struct<product_id:bigint,quantity:bigint,unit_price:decimal(18,2)>>")
         .alias("items"))
