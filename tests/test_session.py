"""Session settings: what the driver may hold."""

from __future__ import annotations

from routeledger.session import materialize


def test_a_million_ids_are_not_broadcast(spark):
    """Their file is a few MB, their hash table on the driver many times that."""
    ids = materialize(spark.range(1_000_000), "many-ids")
    rows = materialize(spark.range(1_000_000).selectExpr("id", "id % 7 as v"), "many-rows")
    joined = rows.join(ids, "id")
    assert joined.count() == 1_000_000
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    joined.write.format("noop").mode("overwrite").save()
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().explainString(mode)
