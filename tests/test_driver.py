"""What the driver holds: joins of tables that grow are not broadcast, however small their files or shuffles look."""

from __future__ import annotations

import re

from fieldspark.llm._spark import skew_join
from fieldspark.plans import queries as plans

FOLDER = "/root/testdata/sf0.001"


def broadcast_joins(spark, run) -> list[str]:
    """The types of the joins that ``run`` broadcast, of first and final plans."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    made = store.executionsList()
    texts = [made.apply(i).physicalPlanDescription() for i in range(int(before), made.size())]
    assert texts
    return [kind for text in texts for kind in re.findall(r"\) BroadcastHashJoin[^\n]*\n(?:[^\n]+\n)*?Join type: (\w+)", text)]


def test_zone_cells_are_not_broadcast(spark):
    assert broadcast_joins(spark, plans.QUERIES["w14_zone_cells"](spark, FOLDER).collect) == []


def test_only_hot_keys_are_broadcast(spark):
    rows = spark.range(3000).selectExpr("id", "if(id < 1500, 0, id % 500) as key")
    groups = rows.groupBy("key").count()
    made = skew_join(rows, groups, ["key"], "count")
    assert len(broadcast_joins(spark, made.collect)) == 4  # of hot keys, for both halves of the union, in the first and the final plan
    assert made.count() == 3000
