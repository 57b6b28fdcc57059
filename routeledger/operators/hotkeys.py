"""Keys with very many open legs, cut into parts that are scanned at the same time.

A part's effect on the level before it is a function.  Two forms of it compose, so the
levels before all parts of a key come from one fold over its parts (a parallel prefix):

* bounds: ``low -> max(floor + b, low + s)`` and ``high -> max(b, high + s)``, two numbers
  each, always sound.  A consuming leg that may or may not fit leaves at least
  need + delta if it is accepted (so never less than the key's ``floor``), and less than
  its need if it isn't.
* a table of the level after the part for every level that the bounds allow before it,
  where the legs leave no doubt beyond the level itself and the levels are not too many.
  Folding tables is exact, so a contended key settles in one round, all its parts at once.

* Where the levels are too many for a table, all parts of a key are run at once from supposed levels, and again
  from those that the parts before them left, until these agree: a key that empties now and then forgets
  its start within a part; every turn settles at least the earliest part in doubt and runs only the parts that start anew.

Where that doesn't tell either the parts start from bounds, and later rounds tell more; the first
part always starts from the exact level.  What comes to the driver are the keys with more
legs than a task's share (fewer than there are tasks), and per part of them a
row of ``STATES`` numbers at most.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

KEYS = ["resource", "k1", "k2"]
ORDER = ["ts", "cmd_id"]

#: A key is cut if it has more open legs than this and than an even share of a task; levels of one table.
SPLIT_LEGS, STATES = 50_000, 1024
_LOWEST = -(1 << 62)


def _make_summaries():
    """Per (key, part): the composed bounds, and what a table needs to know (closure, see ``admission._make_scan_keys``)."""
    def summaries(batches):
        import math

        import pandas as pd
        cur, row, rows = None, None, []
        for pdf in batches:
            for res, k1, k2, part, level, status, d, need, has_need, ext_ok, ext_fail in zip(
                    pdf["resource"], pdf["k1"], pdf["k2"], pdf["part"], pdf["level"], pdf["status"], pdf["delta"], pdf["need0"],
                    pdf["has_need"], pdf["ext_ok"], pdf["ext_fail"], strict=True):
                if (res, k1, k2, part) != cur:
                    cur = (res, k1, k2, part)
                    # low and high: shift s, bound b (of low: above the floor); floor: least need + delta; free: negative legs without need
                    row = {"resource": res, "k1": k1, "k2": k2, "part": part, "level": int(level), "low_s": 0, "low_b": -(1 << 62), "high_s": 0,
                           "high_b": -(1 << 62), "floor": 1 << 62, "free": False, "sure": True, "step": 0}
                    rows.append(row)
                d, need = int(d), int(need)
                open_ = status != 1
                if open_ and ext_fail:
                    continue
                row["step"] = math.gcd(row["step"], d)
                low = high = d  # certain shift
                if open_:
                    row["sure"] &= bool(ext_ok)
                    if has_need and d < 0:
                        high = d if ext_ok else 0
                    elif not ext_ok or has_need:
                        low, high = min(d, 0), max(d, 0)
                row["low_s"] += low
                row["high_s"] += high
                row["low_b"] = max(row["low_b"] + low, -(1 << 62))
                row["high_b"] = max(row["high_b"] + high, -(1 << 62))
                if d < 0 and has_need:
                    row["floor"] = min(row["floor"], need + d)
                    if open_:
                        row["low_b"] = max(row["low_b"], 0)
                        if ext_ok:
                            row["high_b"] = max(row["high_b"], need - 1)
                elif d < 0:
                    row["free"] = True
        yield pd.DataFrame(rows, columns=["resource", "k1", "k2", "part", "level", "low_s", "low_b", "high_s", "high_b", "floor", "free", "sure", "step"])

    return summaries


_SUMMARY = ("resource string, k1 long, k2 long, part int, level long, low_s long, low_b long, high_s long, high_b long, floor long, free boolean, "
            "sure boolean, step long")


def _make_tables(ranges):
    """Per (key, part) of ``ranges`` the level after it for every level ``start + i * step``, i < n, before it (closure)."""
    def tables(batches):
        import numpy as np
        import pandas as pd
        cur, states, back, done, seen = None, None, None, [], 0

        def close():
            if cur in ranges:
                done.append((*cur, states[back].astype("<i8").tobytes()))

        for pdf in batches:
            for res, k1, k2, part, status, d, need, has_need, ext_fail in zip(
                    pdf["resource"], pdf["k1"], pdf["k2"], pdf["part"], pdf["status"], pdf["delta"], pdf["need0"], pdf["has_need"], pdf["ext_fail"], strict=True):
                if (res, k1, k2, part) != cur:
                    close()
                    cur, seen = (res, k1, k2, part), 0
                    start, step, n = ranges.get(cur, (0, 0, 1))
                    states, back = start + step * np.arange(n, dtype=np.int64), np.arange(n)
                if status == 1 or (not ext_fail and not has_need):
                    states = states + int(d)
                elif not ext_fail:
                    states = states + int(d) * (states >= int(need))
                seen += 1
                if seen % 64 == 0 and len(states) > 1:  # levels that have met stay together
                    states, at = np.unique(states, return_inverse=True)
                    back = at[back]
        close()
        yield pd.DataFrame(done, columns=["resource", "k1", "k2", "part", "after"])

    return tables


def _before(parts: list, exact: dict) -> dict:
    """(lowest, highest) level before each part of one key; ``exact``: tables as (start, step, levels after) by part."""
    level = parts[0]["level"]
    floor = _LOWEST if any(p["free"] for p in parts) else min([level, *(p["floor"] for p in parts)])
    low = high = level
    out = {}
    for p in parts:
        out[p["part"]] = (low, high)
        start, step, after = exact.get(p["part"], (0, 0, None))
        if after is not None and low == high:
            low = high = int(after[(low - start) // step if step else 0])
            continue
        if low == high == level and not (p["low_s"] or p["high_s"]) and p["low_b"] == p["high_b"] == _LOWEST:
            continue
        low = max(low + p["low_s"], floor + p["low_b"] if floor > _LOWEST and p["low_b"] > _LOWEST // 2 else _LOWEST)
        high = max(high + p["high_s"], p["high_b"])
    return out


def _run_tables(ranged: DataFrame, ranges: dict) -> dict:
    """(key, part) -> levels after the part for the levels before it in ``ranges``."""
    import numpy as np
    ranged = ranged.filter(F.col("part").isin(sorted({part for *_, part in ranges}))) if ranges else ranged
    rows = ranged.mapInPandas(_make_tables(ranges), "resource string, k1 long, k2 long, part int, after binary").collect() if ranges else []
    return {(r["resource"], r["k1"], r["k2"], r["part"]): np.frombuffer(r["after"], "<i8") for r in rows}


def _run_supposed(ranged: DataFrame, by_key: dict, exact: dict) -> None:
    """Add to ``exact`` the parts whose level before them is found by running them from supposed levels; ``by_key``: keys whose legs
    leave no doubt beyond the level."""
    tried: dict = {}
    while True:
        todo = {}
        for key, parts in by_key.items():
            bounds, tables = _before(parts, exact.get(key, {})), exact.setdefault(key, {})
            level, sure = parts[0]["level"], True
            for p in parts:
                at = (*key, p["part"])
                start, step, after = tables.get(p["part"], (0, 0, None))
                if after is not None and 0 <= level - start and (step == 0 and level == start or step and (level - start) // step < len(after)):
                    level = int(after[(level - start) // step if step else 0])
                    continue
                ends = tried.setdefault(at, {})
                if level in ends:
                    if sure:
                        tables[p["part"]] = (level, 0, [ends[level]])
                    level = ends[level]
                    continue
                todo[at] = (level, 0, 1)
                sure = False
                if ends:
                    level = next(reversed(ends.values()))  # where it ended from the last level tried
                else:
                    low, high = bounds[p["part"]]
                    level = level if low <= _LOWEST // 2 else max(low, min(level, high))
        if not todo:
            return
        for at, after in _run_tables(ranged, todo).items():
            tried[at][todo[at][0]] = int(after[0])


def split_hot_keys(x: DataFrame, split_legs: int | None = None, states: int | None = None) -> tuple[DataFrame, dict]:
    """``x`` (legs with ``level``, ``status``, ``ext_ok``, ``ext_fail``) with a ``part`` number, and the levels before the parts of
    split keys as ``{(resource, k1, k2, part): (lowest, highest)}``; keys that aren't cut are part 0."""
    split_legs, states = SPLIT_LEGS if split_legs is None else split_legs, STATES if states is None else states
    tasks = int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = x.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    total = x.count()
    hot = counts.filter(F.col("n") > max(split_legs, total // tasks)).select(*KEYS).collect()  # fewer than tasks
    if not hot:
        return x.withColumn("part", F.lit(0)), {}
    keys = F.broadcast(x.sparkSession.createDataFrame(hot, "resource string, k1 long, k2 long"))
    cut = materialize(x.join(keys, KEYS, "left_semi").repartitionByRange(tasks, *KEYS, *ORDER).withColumn("part", F.spark_partition_id()), "hot-legs")
    ranged = cut.repartition(*KEYS, "part").sortWithinPartitions(*KEYS, "part", *ORDER)
    by_key: dict = {}
    for r in sorted(ranged.mapInPandas(_make_summaries(), _SUMMARY).collect(), key=lambda r: r["part"]):
        by_key.setdefault((r["resource"], r["k1"], r["k2"]), []).append(r.asDict())
    ranges = {}
    for key, parts in by_key.items():
        step = math.gcd(*(p["step"] for p in parts))
        for p, (low, high) in zip(parts, _before(parts, {}).values(), strict=True):
            start = low + (parts[0]["level"] - low) % step if step else low  # levels differ from the first by multiples of step
            n = (high - start) // step + 1 if step else 1
            if p["sure"] and 1 <= n <= states:
                ranges[(*key, p["part"])] = (start, step, n)
    exact: dict = {}
    for (*key, part), after in _run_tables(ranged, ranges).items():
        exact.setdefault(tuple(key), {})[part] = (*ranges[(*key, part)][:2], after)
    _run_supposed(ranged, {k: parts for k, parts in by_key.items() if all(p["sure"] for p in parts)}, exact)
    incoming = {(*key, part): bounds for key, parts in by_key.items() for part, bounds in _before(parts, exact.get(key, {})).items()}
    return x.join(keys, KEYS, "left_anti").withColumn("part", F.lit(0)).unionByName(cut), incoming
