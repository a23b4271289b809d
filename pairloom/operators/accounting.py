"""Event accounting: critical path over levels, widths, makespans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BEFORE = (Window.unboundedPreceding, -1)
SO_FAR = (Window.unboundedPreceding, 0)


def cluster_costs(log: DataFrame) -> DataFrame:
    """shot, level, cluster, n, stop, cutoff, before, after.

    The cutoff of a level is the latest stop time of the lower levels; events up
    to it overlap with them, later ones come on top. The window runs over one row
    per (shot, level), never over the events.
    """
    stops = log.groupBy("shot", "level").agg(F.max("t").alias("stop"))
    lower = Window.partitionBy("shot").orderBy("level").rowsBetween(*BEFORE)
    cutoffs = stops.select("shot", "level", F.max("stop").over(lower).alias("cutoff"))
    placed = log.join(cutoffs, ["shot", "level"])
    overlap = F.col("cutoff").isNotNull() & (F.col("t") <= F.col("cutoff"))
    return placed.groupBy("shot", "level", "cluster").agg(
        F.count("*").alias("n"),
        F.max("t").alias("stop"),
        F.max("cutoff").alias("cutoff"),
        F.count_if(overlap).alias("before"),
        F.count_if(~overlap).alias("after"),
    )


def critical_levels(costs: DataFrame) -> DataFrame:
    """shot, level, critical, stop: critical event count and stop time after each level.

    With F the largest number of later events of a level and G the largest total,
    the rule C = max(C_before + F, G) unrolls into a running sum S of F and a
    running maximum of G - S: two windows over one row per (shot, level).
    """
    per_level = costs.groupBy("shot", "level").agg(
        F.max("after").alias("f"), F.max(F.col("before") + F.col("after")).alias("g"), F.max("stop").alias("stop")
    )
    order = Window.partitionBy("shot").orderBy("level").rowsBetween(*SO_FAR)
    sums = per_level.withColumn("s", F.sum("f").over(order))
    best = F.greatest(F.max(F.col("g") - F.col("s")).over(order), F.lit(0))
    return sums.select("shot", "level", (F.col("s") + best).cast("long").alias("critical"), F.max("stop").over(order).alias("stop"))


def cluster_paths(costs: DataFrame) -> DataFrame:
    """Adds base and critical to each cluster: max(critical before, before) and that plus after."""
    levels = critical_levels(costs)
    order = Window.partitionBy("shot").orderBy("level")
    prior = levels.select("shot", "level", F.coalesce(F.lag("critical").over(order), F.lit(0)).alias("prior"))
    return costs.join(prior, ["shot", "level"]).select(
        "shot", "level", "cluster", "n", "before", "after", "prior",
        F.greatest("prior", "before").alias("base"),
        (F.greatest("prior", "before") + F.col("after")).alias("critical"),
    )


def shot_costs(costs: DataFrame) -> DataFrame:
    """shot, clusters, events, critical, nonempty_levels, max_level, peak_width, stop per shot."""
    per_level = costs.groupBy("shot", "level").agg(F.count("*").alias("width"), F.sum("n").alias("events"))
    shape = per_level.groupBy("shot").agg(
        F.sum("width").alias("clusters"),
        F.sum("events").alias("events"),
        F.count_if(F.col("events") > 0).alias("nonempty_levels"),
        F.max("level").alias("max_level"),
        F.max("width").alias("peak_width"),
    )
    last = critical_levels(costs).groupBy("shot").agg(F.max("critical").alias("critical"), F.max("stop").alias("stop"))
    return shape.join(last, "shot")


def level_after_prior(costs: DataFrame) -> DataFrame:
    """shot, critical under the rule of adaptive selection: the sum of each level's largest later count."""
    return costs.groupBy("shot", "level").agg(F.max("after").alias("f")).groupBy("shot").agg(F.sum("f").alias("critical"))


def slowest(costs: DataFrame, time: Column) -> DataFrame:
    """shot, level, slowest, time: the cluster that takes longest; of equal ones the last."""
    return costs.groupBy("shot", "level").agg(F.max(F.struct(time.alias("t"), "cluster")).alias("e")).select(
        "shot", "level", F.col("e.cluster").alias("slowest"), F.col("e.t").alias("time")
    )


def makespan(jobs: DataFrame, keys: list[str], time: str, workers: int) -> DataFrame:
    """keys, makespan of longest-first assignment to ``workers`` equal workers.

    Equal times are counted first, so an array holds one entry per distinct
    time. The assignment itself is sequential by definition.
    """
    counted = jobs.groupBy(*keys, F.col(time).alias("x")).agg(F.count("*").alias("k"))
    queue = counted.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("x", "k")), asc=False).alias("queue"))

    def give(loads: Column, x: Column) -> Column:
        rest = F.slice(loads, 2, workers - 1) if workers > 1 else F.array().cast("array<bigint>")
        return F.array_sort(F.concat(F.array(loads[0] + x), rest))

    idle = F.array_repeat(F.lit(0).cast("long"), workers)
    loads = F.aggregate(
        "queue", idle, lambda acc, job: F.aggregate(F.sequence(F.lit(1).cast("long"), job["k"]), acc, lambda inner, _: give(inner, job["x"]))
    )
    return queue.select(*keys, F.array_max(loads).alias("makespan"))
