"""Queries that must read the whole of their tables."""

import compare
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"


def test_graph_components_hold_every_part_customer_and_order(spark):
    found = queries()["graph_components"](spark, FOLDER)
    assert compare.difference(found, compare.connect(FOLDER), oracle_sql()["graph_components"]) is None
    table = lambda name: spark.read.parquet(f"{FOLDER}/{name}.parquet")
    ids = table("part").select((F.lit(2 * 10**9) + F.col("p_partkey")).alias("id")).unionByName(table("customer").select(F.col("c_custkey").alias("id")))
    ids = ids.unionByName(table("orders").select((F.lit(10**9) + F.col("o_orderkey")).alias("id")))
    assert ids.join(found, "id", "left_anti").isEmpty()
    assert found.count() == ids.distinct().count()
