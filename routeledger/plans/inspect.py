"""Compact summaries of physical plans (``python -m routeledger.plans.inspect``).

For each headline query: number of shuffles, join strategies, whether any
Python evaluation or cartesian product is present, and per Parquet scan the
pushed filters and the columns read.  Uses ``explain('formatted')`` text.
"""

from __future__ import annotations

import re
import sys

from pyspark.sql import DataFrame


def formatted(df: DataFrame) -> str:
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def summary(df: DataFrame) -> dict:
    text = formatted(df)
    tree = text.split("\n\n", 1)[0]
    scans = []
    for block in re.split(r"\n\(\d+\) ", text):
        if block.startswith("Scan parquet"):
            loc = re.search(r"Location: \w+ \[[^\]]*?/([^/\]]+)\]", block)
            pushed = re.search(r"PushedFilters: \[(.*)\]", block)
            schema = re.search(r"ReadSchema: struct<(.*)>", block)
            scans.append({"table": loc.group(1) if loc else "?",
                          "pushed": pushed.group(1) if pushed else "",
                          "columns": re.sub(r":[^,]+", "", schema.group(1)) if schema else ""})
    return {
        "shuffles": len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition",
                                   text)) or tree.count("Exchange"),
        "joins": sorted(set(re.findall(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|"
                                       r"CartesianProduct)", tree))),
        "python": any(k in text for k in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "PythonUDF")),
        "scans": scans,
    }


def main(argv) -> None:
    from ..operators import ledger as G
    from ..operators import listings as L
    from ..operators import reports as R
    from ..session import build_session
    from ..sources.testdata import star_from_testdata
    from pyspark.sql import functions as F
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session(shuffle_partitions=16)
    t = star_from_testdata(spark, sf_dir)
    heads = {
        "sales_by_product (A3)": R.sales_by_product(t, "1998-01-01", "1998-12-31"),
        "salesperson_performance (A6)": R.salesperson_performance(t, "1998-01-01", "1998-12-31",
                                                                  "2024-01-01", "2024-01-31"),
        "stock_level_report (A8)": R.stock_level_report(t, "1998-06-30"),
        "sales_enriched page (J6+T3)": L.page(L.sales_enriched(t, ordered=False),
                                              [F.desc_nulls_last("date"), F.desc_nulls_last("id")], 50, 100),
        "positions (L1)": G.positions(t),
        "shop_statement (L2)": G.shop_statement(t),
    }
    print(f"# Plan summaries at {sf_dir} (static plans; AQE may still switch joins at run time)\n")
    for name, df in heads.items():
        s = summary(df)
        print(f"## {name}\n")
        print(f"- shuffles: {s['shuffles']}; joins: {', '.join(s['joins']) or 'none'}; "
              f"python in plan: {'yes' if s['python'] else 'no'}")
        for sc in s["scans"]:
            print(f"- scan `{sc['table']}` reads [{sc['columns']}]; pushed: [{sc['pushed']}]")
        print()


if __name__ == "__main__":
    main(sys.argv)
