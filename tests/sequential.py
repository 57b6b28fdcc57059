"""Plain-Python sequential admission: the test oracle for L4/L5/ST2.

Commands are taken in (ts, cmd_id) order; a command is accepted iff every
leg has level >= need at its turn, then all its deltas apply.  Used on
small collected inputs in the tests only."""

from __future__ import annotations

from collections import defaultdict
from decimal import Decimal


def sequential(legs_rows, level_rows):
    level = defaultdict(Decimal)
    for r in level_rows:
        level[(r["resource"], r["k1"], r["k2"])] += Decimal(r["level"])
    by_cmd = defaultdict(list)
    ts = {}
    for r in legs_rows:
        by_cmd[r["cmd_id"]].append(r)
        ts[r["cmd_id"]] = r["ts"]
    out = {}
    for cmd in sorted(by_cmd, key=lambda c: (ts[c], c)):
        legs = by_cmd[cmd]
        ok = all(g["need"] is None or level[(g["resource"], g["k1"], g["k2"])] >= g["need"] for g in legs)
        if ok:
            for g in legs:
                level[(g["resource"], g["k1"], g["k2"])] += g["delta"]
        out[cmd] = "accepted" if ok else "rejected"
    return out, dict(level)


class Book:
    """The ledger run one command at a time over plain dictionaries: levels and facts, with the checks in the order the rules give."""

    def __init__(self, t):
        rows = lambda df: [r.asDict() for r in df.collect()]
        self.product = {r["id"]: r["is_active"] == 1 for r in rows(t.products)}
        self.shop = {r["id"]: r["is_active"] == 1 for r in rows(t.shops)}
        self.level = defaultdict(Decimal)
        for r in rows(t.products):
            self.level["warehouse", r["id"], -1] += r["stock_quantity"]
        for r in rows(t.salesperson_stock):
            self.level["field", r["salesperson_id"], r["product_id"]] += r["quantity"]
        for r in rows(t.shops):
            self.level["debt", r["id"], -1] -= r["current_balance"]
        lines = defaultdict(lambda: defaultdict(int))
        for r in rows(t.sale_items):
            lines[r["sale_id"]][r["product_id"]] += r["quantity"]
        self.fact = {"sale": {r["id"]: (r["salesperson_id"], r["shop_id"], r["balance_amount"], dict(lines[r["id"]])) for r in rows(t.sales)},
                     "collection": {r["id"]: (r["shop_id"], r["amount"]) for r in rows(t.collections)},
                     "return": {r["id"]: (r["salesperson_id"], r["product_id"], r["quantity_returned"]) for r in rows(t.stock_returns)},
                     "issue": {r["id"]: (r["salesperson_id"], r["product_id"], r["quantity_issued"]) for r in rows(t.stock_issues)}}
        self.top = {k: max(v, default=0) for k, v in self.fact.items()}

    def _new(self, family, value):
        self.top[family] += 1
        self.fact[family][self.top[family]] = value

    def _steps(self, c):
        """(need or None, delta, key) in the order of the checks, and what to do with the facts; None if a rule refuses the command."""
        kind, sp, shop, ref, items = c["kind"], c["salesperson_id"], c["shop_id"], c["ref_id"], c["items"]
        family, _, verb = kind.partition("_")
        per, amount = defaultdict(int), c["amount"] or Decimal(0)
        for p, q, _price in items or ():
            per[p] += q
        if verb and ref not in self.fact[family]:
            return None
        old = self.fact[family].get(ref)
        wh, fd, db = (lambda p: ("warehouse", p, -1)), (lambda s, p: ("field", s, p)), (lambda s: ("debt", s, -1))
        if kind in ("issue", "return"):
            if not items or not all(self.product.get(p) for p in per):
                return None
            take, put = (wh, fd) if kind == "issue" else (fd, wh)
            key = lambda f, p: f(p) if f is wh else f(sp, p)
            return [s for p, q in per.items() for s in ((q, -q, key(take, p)), (None, q, key(put, p)))], lambda: [self._new(kind, (sp, p, q)) for p, q, _ in items]
        if kind == "collection":
            return ([(amount, -amount, db(shop))], lambda: self._new(kind, (shop, amount))) if amount > 0 and self.shop.get(shop) else None
        if kind == "collection_delete":
            return ([(None, old[1], db(old[0]))], lambda: self.fact[family].pop(ref)) if self.shop.get(old[0]) else None
        if family == "sale":
            if verb != "delete" and (not items or (amount > 0 and not self.shop.get(shop))):
                return None
            if verb == "delete" and old[2] > 0 and not self.shop.get(old[1]):
                return None
            steps = []
            if verb:
                steps += [(None, q, fd(old[0], p)) for p, q in old[3].items()] + ([(None, -old[2], db(old[1]))] if old[2] > 0 else [])
            if verb != "delete":
                steps += [(q, -q, fd(sp, p)) for p, q in per.items()] + ([(None, amount, db(shop))] if amount > 0 else [])
            done = {"": lambda: self._new("sale", (sp, shop, amount, dict(per))), "delete": lambda: self.fact["sale"].pop(ref),
                    "update": lambda: self.fact["sale"].update({ref: (sp, shop, amount, dict(per))})}[verb]
            return steps, done
        s0, p0, q0 = old
        taken, given = (wh(p0), fd(s0, p0)) if family == "return" else (fd(s0, p0), wh(p0))  # where the movement's units are, where they go back to
        if verb == "delete":
            return ([(q0, -q0, taken), (None, q0, given)], lambda: self.fact[family].pop(ref)) if self.product.get(p0) else None
        s1, (p1, q1, _price) = sp if sp is not None else s0, (items[0] if items else (None, None, None))
        p1, q1 = p1 if p1 is not None else p0, q1 if q1 is not None else q0
        done = lambda: self.fact[family].update({ref: (s1, p1, q1)})
        if q1 <= 0 or ((s0, p0) != (s1, p1) or q1 != q0) and not self.product.get(p0) or (s0, p0) != (s1, p1) and not self.product.get(p1):
            return None
        if (s0, p0) == (s1, p1):
            d = q1 - q0
            return ([(d, -d, given), (None, d, taken)] if d > 0 else [(-d, d, taken), (None, -d, given)] if d else []), done
        if family == "return":
            return [(q0, -q0, wh(p0)), (None, q0, fd(s0, p0)), (q1, -q1, fd(s1, p1)), (None, q1, wh(p1))], done
        return [(q0, -q0, fd(s0, p0)), (q1, -q1, wh(p1)), (None, q0, wh(p0)), (None, q1, fd(s1, p1))], done

    def run(self, commands):
        """Status by cmd_id of ``commands`` (dicts), in (ts, cmd_id) order."""
        out = {}
        for c in sorted(commands, key=lambda c: (c["ts"], c["cmd_id"])):
            got, out[c["cmd_id"]] = self._steps(c), "rejected"
            if got is None:
                continue
            moved, ok = defaultdict(Decimal), True
            for need, delta, key in got[0]:
                ok &= need is None or self.level[key] + moved[key] >= need
                moved[key] += delta
            if ok:
                for key, d in moved.items():
                    self.level[key] += d
                got[1]()
                out[c["cmd_id"]] = "accepted"
        return out
