"""Keys cut into parts: the same decisions as the sequential rule, and bounds and tables that hold."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest

from routeledger.operators import admission as A
from routeledger.operators import hotkeys as H
from routeledger.schema import LEGS
from sequential import sequential
from test_admission import T0


def _legs(seed_no, n, keys, restock=0.2, second=0.0):
    rnd = random.Random(seed_no)
    rows = []
    for i in range(n):
        ts = T0 + dt.timedelta(seconds=rnd.randint(0, n))
        for k in rnd.sample(range(keys), 1 + (keys > 1 and rnd.random() < second)):
            q = rnd.choice([1, 2, 3, 7, 20])
            need, delta = (None, q) if rnd.random() < restock else (q, -q) if rnd.random() < 0.95 else (q, q)
            rows.append((i, ts, "warehouse", k, -1, None if need is None else Decimal(need), Decimal(delta)))
    return rows


@pytest.mark.parametrize("keys,second", [(1, 0.0), (3, 0.3)])
def test_hot_keys_match_the_sequential_rule(spark, monkeypatch, keys, second):
    monkeypatch.setattr(H, "SPLIT_LEGS", 40)
    rows = _legs(5, 1500 if keys == 1 else 300, keys, second=second)
    legs = spark.createDataFrame(rows, LEGS)
    levels = spark.createDataFrame([("warehouse", k, -1, Decimal(30)) for k in range(keys)], "resource string, k1 long, k2 long, level decimal(18,2)")
    cuts, plain = [], H.split_hot_keys
    monkeypatch.setattr(A, "split_hot_keys", lambda x, n: cuts.append(plain(x)) or cuts[-1])
    got = {r["cmd_id"]: (r["status"], r["round"]) for r in A.admit(legs, levels).collect()}
    want, _ = sequential([r.asDict() for r in legs.collect()], [r.asDict() for r in levels.collect()])
    assert {k: v[0] for k, v in got.items()} == want and len(set(want.values())) == 2
    assert len(cuts[0][1]) > 2 * min(keys, 2)  # several parts
    if keys == 1:
        assert max(r for _, r in got.values()) == 2  # the tables settle every part in one round
        assert all(lo == hi for lo, hi in cuts[0][1].values())


def _frame(rnd, n):
    rows = []
    for _ in range(n):
        q = rnd.choice([1, 2, 5, 9])
        need, d = rnd.choice([(q, -q), (q, -q), (q + 2, -q), (None, q), (None, -1), (q, q)])
        ext = rnd.random()
        rows.append(("w", 1, -1, 0, 0, rnd.choice([0, 0, 0, 1]), d, need or 0, need is not None, ext < 0.8, ext > 0.95))
    return pd.DataFrame(rows, columns=["resource", "k1", "k2", "part", "level", "status", "delta", "need0", "has_need", "ext_ok", "ext_fail"])


@pytest.mark.parametrize("seed_no", range(30))
def test_bounds_hold_for_every_course(seed_no):
    rnd = random.Random(seed_no)
    parts = [_frame(rnd, rnd.randint(1, 12)) for _ in range(4)]
    if seed_no % 2:  # no free takers: the floor counts
        parts = [p[~((p.delta < 0) & ~p.has_need)].reset_index(drop=True) for p in parts]
        parts = [p for p in parts if len(p)]
    level = rnd.randint(0, 12)
    rows = [next(H._make_summaries()(iter([p.assign(part=k, level=level)]))).iloc[0].to_dict() for k, p in enumerate(parts)]
    before = H._before(rows, {})
    for _ in range(60):
        x = level
        for k, p in enumerate(parts):
            assert before[k][0] <= x <= before[k][1], (k, x, before)
            for r in p.itertuples():
                fits = not r.has_need or x >= r.need0
                if r.status == 1:
                    if r.has_need and r.delta < 0 and x < r.need0:
                        x = None  # an accepted leg had what it needed: no such course
                        break
                    x += r.delta
                elif not r.ext_fail and fits and (r.ext_ok or rnd.random() < 0.5):
                    x += r.delta
            if x is None:
                break


def test_tables_hold_every_level():
    rnd = random.Random(3)
    frame = _frame(rnd, 300)
    frame["ext_ok"] = True
    key = ("w", 1, -1, 0)
    got = next(H._make_tables({key: (0, 1, 50)})(iter([frame.iloc[:100], frame.iloc[100:]])))
    after = np.frombuffer(got["after"][0], "<i8")
    for start in range(50):
        x = start
        for r in frame.itertuples():
            if r.status == 1 or (not r.ext_fail and (not r.has_need or x >= r.need0)):
                x += r.delta
        assert after[start] == x


@pytest.mark.parametrize("restock", [0.3, 0.6])
def test_levels_beyond_a_table_settle_in_one_round(spark, monkeypatch, restock):
    monkeypatch.setattr(H, "SPLIT_LEGS", 40)
    monkeypatch.setattr(H, "STATES", 0)  # no tables at all
    legs = spark.createDataFrame([(*r[:5], *(None if v is None else v * 997 + Decimal(r[0] % 89) * (1 if v > 0 else -1) for v in r[5:]))
                                  for r in _legs(7, 800, 1, restock)], LEGS)
    levels = spark.createDataFrame([("warehouse", 0, -1, Decimal(30))], "resource string, k1 long, k2 long, level decimal(18,2)")
    got = {r["cmd_id"]: (r["status"], r["round"]) for r in A.admit(legs, levels).collect()}
    want, _ = sequential([r.asDict() for r in legs.collect()], [r.asDict() for r in levels.collect()])
    assert {k: v[0] for k, v in got.items()} == want and len(set(want.values())) == 2
    assert max(r for _, r in got.values()) == 2
