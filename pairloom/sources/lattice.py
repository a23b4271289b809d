"""Graph, shots and logs derived from the supplied tables.

The tables hold no weighted graph, so one is laid over them: every part is a
node of a lattice ``WIDTH`` columns wide, every order is a shot, and the parts
that occur an odd number of times in an order are its hits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pairloom.functions.weights import log_odds
from pairloom.operators.hits import odd_hits
from pairloom.sources.tables import table

WIDTH = 40


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    """id, r, c, size."""
    key = F.col("p_partkey")
    return table(spark, folder, "part").select(
        key.alias("id"),
        (key - key % WIDTH).cast("long").alias("row_start"),
        (key % WIDTH).alias("c"),
        F.col("p_size").cast("long").alias("size"),
    ).withColumn("r", (F.col("row_start") / WIDTH).cast("long")).drop("row_start")


def _lattice_pairs(points: DataFrame) -> DataFrame:
    """u, v, size_u, size_v of neighbouring nodes that both exist."""
    right = F.when(F.col("c") < WIDTH - 1, F.col("id") + 1)
    down = F.col("id") + WIDTH
    steps = points.select(
        F.col("id").alias("u"), F.col("size").alias("size_u"), F.explode(F.array(right, down)).alias("v")
    ).where("v IS NOT NULL")
    return steps.join(points.select(F.col("id").alias("v"), F.col("size").alias("size_v")), "v")


def _lattice_rims(points: DataFrame) -> DataFrame:
    """u, side (0 left with observable 0, 1 right without) of the first and last column."""
    side = F.when(F.col("c") == 0, 0).when(F.col("c") == WIDTH - 1, 1)
    return points.select(F.col("id").alias("u"), F.col("size").alias("size_u"), side.alias("side")).where(
        "side IS NOT NULL"
    )


def edges(spark: SparkSession, folder: str, weights: str = "unit") -> DataFrame:
    """u, v (NULL at the boundary), w, p, obs, ord; ``weights`` is unit or noisy."""
    points = nodes(spark, folder)
    inner = _lattice_pairs(points).select(
        "u", "v", ((F.col("size_u") + F.col("size_v")) / 1000.0).alias("p"),
        F.array().cast("array<int>").alias("obs"),
        (F.col("u") * 4 + F.when(F.col("v") == F.col("u") + 1, 0).otherwise(1)).alias("ord"),
    )
    rim = _lattice_rims(points).select(
        "u", F.lit(None).cast("long").alias("v"), (F.col("size_u") / 500.0).alias("p"),
        F.when(F.col("side") == 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")).alias("obs"),
        (F.col("u") * 4 + 2 + F.col("side")).alias("ord"),
    )
    both = inner.unionByName(rim)
    weight = F.lit(1.0) if weights == "unit" else log_odds(F.col("p"))
    return both.select("u", "v", weight.alias("w"), "p", "obs", "ord")


def signed_edges(spark: SparkSession, folder: str) -> DataFrame:
    """The noisy edges with the sign of the weight flipped where p*1000 is a multiple of 7."""
    flip = F.round(F.col("p") * 1000).cast("long") % 7 == 0
    return edges(spark, folder, "noisy").withColumn("w", F.when(flip, -F.col("w")).otherwise(F.col("w")))


def parallel_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Many parallel edges: supplier to part modulo 100, p from the discount, p=0 dropped."""
    items = table(spark, folder, "lineitem").where("l_discount > 0")
    return items.select(
        F.col("l_suppkey").alias("u"),
        (F.col("l_partkey") % 100).alias("v"),
        log_odds(F.col("l_discount")).alias("w"),
        F.col("l_discount").alias("p"),
        F.array((F.col("l_linenumber") - 1).cast("int")).alias("obs"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount").alias("ord"),
    )


def hits(spark: SparkSession, folder: str) -> DataFrame:
    """shot, det."""
    return odd_hits(
        table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("shot"), F.col("l_partkey").alias("det"))
    )


def event_log(spark: SparkSession, folder: str) -> DataFrame:
    """shot, level, cluster, t, seq: user activity read as notifications of clusters.

    Levels are five-day blocks (0 to 5); times fall in a window of an hour that
    starts 900 seconds later on each level, so consecutive levels overlap.
    """
    level = F.floor((F.dayofmonth("ts") - 1) / 5).cast("int")
    second = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return table(spark, folder, "events").select(
        F.col("user_id").alias("shot"),
        level.alias("level"),
        F.col("event_type").alias("cluster"),
        (second % 3600 + level * 900).cast("long").alias("t"),
        F.col("event_id").alias("seq"),
        "value",
    )


def bench_points(spark: SparkSession, folder: str) -> DataFrame:
    """case, mode, y, ord: one benchmark row per order; distance 9, 13, ... by year and month half."""
    distance = (F.year("o_orderdate") - 1995) * 4 + 9
    noise = F.substring("o_orderpriority", 1, 1).cast("int")
    mode = F.when(F.col("o_orderstatus") == "F", F.lit("global")).otherwise(
        F.concat(F.lit("parallel_"), F.lower("o_orderstatus"))
    )
    d = distance.cast("string")
    return table(spark, folder, "orders").select(
        F.concat(F.lit("case_r"), d, F.lit("_d"), d, F.lit("_p"), noise.cast("string")).alias("case"),
        distance.cast("int").alias("distance"),
        noise.alias("noise"),
        mode.alias("mode"),
        F.col("o_totalprice").alias("y"),
        F.col("o_orderkey").alias("ord"),
    )
