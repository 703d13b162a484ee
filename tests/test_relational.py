"""Membership in a set with nulls, and its plans."""

import re

import pytest

from sqlsift.operators.relational import SQL

KEYS = {"no nulls": ([1, 2, 3], [2, 2, 5]), "null key": ([1, None, 3], [3, 4]), "null in set": ([1, None, 3], [3, None]), "only nulls": ([1, None], [None]), "empty set": ([1, None], []), "empty": ([], [1])}


def views(spark, customers, orders):
    spark.createDataFrame([(k,) for k in customers], "c_custkey long").createOrReplaceTempView("customer")
    spark.createDataFrame([(k,) for k in orders], "o_custkey long").createOrReplaceTempView("orders")


@pytest.mark.parametrize("name", ("anti_invariant", "anti_not_in"))
def test_membership(spark, name):
    text, check = SQL[name]
    for case, keys in KEYS.items():
        views(spark, *keys)
        got, want = (sorted(map(str, spark.sql(sql).collect())) for sql in (text, check))
        assert got == want, case


@pytest.mark.parametrize("name", ("anti_invariant", "anti_not_in"))
def test_membership_joins_by_key(spark, name):
    views(spark, *KEYS["null in set"])
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = spark.sql(SQL[name][0])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    # what meets in a loop is one row of counts, never the keys
    assert "SortMergeJoin [c_custkey" in plan and not re.search(r"(BroadcastHashJoin|BroadcastNestedLoopJoin).*(ExistenceJoin|LeftAnti)", plan)
