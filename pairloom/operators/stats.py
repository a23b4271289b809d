"""Summaries: standard errors, percentiles, level statistics, fits, pairing of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairloom.session import cut


def standard_error(x: Column) -> Column:
    """Aggregate: standard error of the mean, 0 for fewer than two rows."""
    return F.coalesce(F.stddev_samp(x) / F.sqrt(F.count(x)), F.lit(0.0))


def standard_error_from_sums(total: Column, squares: Column, n: Column) -> Column:
    variance = (squares - n * (total / n) * (total / n)) / (n - 1)
    return F.when((n <= 1) | (variance <= 0), 0.0).otherwise(F.sqrt(variance / n))


def quantiles(rows: DataFrame, keys: list[str], value: str, points: dict[str, float], lower: bool = False) -> DataFrame:
    """Exact quantiles per group: keys plus one column per entry of ``points``.

    Linear interpolation between the two neighbours of position q*(n-1), or the
    lower neighbour. Equal values are counted before anything moves. The counts
    are sorted by range, so a group that holds most of the data is spread over
    many partitions, and each partition only needs the totals of those before.
    """
    counts = rows.groupBy(*keys, F.col(value).alias("x")).agg(F.count("*").alias("k"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(counts.repartitionByRange(parts, *keys, "x").withColumn("part", F.spark_partition_id()))
    totals = placed.groupBy(*keys, "part").agg(F.sum("k").alias("k"))
    order = Window.partitionBy(*keys).orderBy("part")
    offsets = totals.select(
        *keys, "part",
        (F.sum("k").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("k")).alias("offset"),
        F.sum("k").over(Window.partitionBy(*keys)).alias("n"),
    )
    inside = Window.partitionBy(*keys, "part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.withColumn("upto", F.sum("k").over(inside)).join(offsets, [*keys, "part"])
    last = F.col("offset") + F.col("upto") - 1
    first = last - F.col("k") + 1
    picks = []
    for name, q in points.items():
        at = F.lit(float(q)) * (F.col("n") - 1)
        below, above = F.floor(at), F.ceil(at)
        picks.append(F.max(F.when(below.between(first, last), F.col("x"))).alias(f"{name}_lo"))
        if not lower:
            picks.append(F.max(F.when(above.between(first, last), F.col("x"))).alias(f"{name}_hi"))
            picks.append(F.max(at - below).alias(f"{name}_at"))
    out = ranked.groupBy(*keys).agg(*picks)
    if lower:
        return out.select(*keys, *[F.col(f"{name}_lo").alias(name) for name in points])
    return out.select(
        *keys,
        *[
            (F.col(f"{n}_lo") * (1.0 - F.col(f"{n}_at")) + F.col(f"{n}_hi") * F.col(f"{n}_at")).alias(n)
            for n in points
        ],
    )


def level_statistics(clusters: DataFrame) -> DataFrame:
    """Per (case, level): clusters per shot and events per cluster.

    ``clusters``: case, rep, shot, level, events, size, diameter, buffer.
    """
    shots = clusters.select("case", "rep", "shot").distinct().groupBy("case").agg(F.count("*").alias("shots"))
    per_shot = clusters.groupBy("case", "level", "rep", "shot").agg(
        F.count("*").alias("n"), F.sum("events").alias("events"), F.min("events").alias("lo"), F.max("events").alias("hi"),
        F.sum("size").alias("size"), F.sum("diameter").alias("diameter"), F.sum("buffer").alias("buffer"),
    )
    main = per_shot.groupBy("case", "level").agg(
        F.count("*").alias("nonempty_shots"),
        F.sum("n").alias("total_clusters"),
        F.max("n").alias("max_clusters_in_shot"),
        F.sum("events").alias("total_events"),
        (F.sum("events") / F.sum("n")).alias("mean_events_per_cluster"),
        F.min("lo").alias("min_events_per_cluster"),
        F.max("hi").alias("max_events_per_cluster"),
        (F.sum("size") / F.sum("n")).alias("mean_active_detectors_per_cluster"),
        (F.sum("diameter") / F.sum("n")).alias("mean_diameter_per_cluster"),
        (F.sum("buffer") / F.sum("n")).alias("mean_buffer_bound_per_cluster"),
    )
    middle = quantiles(clusters, ["case", "level"], "events", {"median_events_per_cluster": 0.5, "p90_events_per_cluster": 0.9})
    return (
        main.join(shots, "case")
        .join(middle, ["case", "level"])
        .withColumn("avg_clusters_per_shot", F.col("total_clusters") / F.col("shots"))
    )


# Columns of the per-shot level table and the summaries made of each.
LEVEL_MEASURES = {
    "cluster_count": ("mean", "median", "p90", "p95", "p99", "max"),
    "assigned_active_detector_count": ("mean", "p95", "max"),
    "max_cluster_active_detectors": ("mean", "p95", "max"),
    "max_cluster_event_count": ("mean", "max"),
    "max_cluster_critical_path_event_count": ("mean", "max"),
}
_POINTS = {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def level_frame(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, level, shots: every level from 0 to the highest of each case."""
    shots = rows.select(*keys, "rep", "shot").distinct().groupBy(*keys).agg(F.count("*").alias("shots"))
    top = rows.groupBy(*keys).agg(F.max("level").alias("top"))
    return shots.join(top, keys).select(*keys, "shots", F.explode(F.sequence(F.lit(0), F.col("top"))).alias("level"))


def level_histogram(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, level, cluster_count, shots, fraction; shots without the level count as 0 clusters.

    The zeros are counted as the shots that are missing, not generated.
    """
    keys = keys or ["case", "method"]
    frame = level_frame(rows, keys)
    seen = rows.groupBy(*keys, "level", F.col("cluster_count").cast("long").alias("cluster_count")).agg(F.count("*").alias("n"))
    present = seen.groupBy(*keys, "level").agg(F.sum("n").alias("present"))
    zeros = (
        frame.join(present, [*keys, "level"], "left")
        .select(*keys, "level", F.lit(0).cast("long").alias("cluster_count"), (F.col("shots") - F.coalesce("present", F.lit(0))).alias("n"))
        .where("n > 0")
    )
    all_counts = seen.unionByName(zeros).groupBy(*keys, "level", "cluster_count").agg(F.sum("n").alias("n"))
    return all_counts.join(frame, [*keys, "level"]).select(
        *keys, "level", "cluster_count", F.col("n").alias("shots"), (F.col("n") / F.col("shots")).alias("fraction")
    )


def level_distribution(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, level, shots, nonempty_shots, nonempty_fraction and the summaries of ``LEVEL_MEASURES``."""
    keys = keys or ["case", "method"]
    frame = level_frame(rows, keys)
    names = {m: (m if m.startswith("max_") else f"max_{m}") for m in LEVEL_MEASURES}
    sums = rows.groupBy(*keys, "level").agg(
        F.count_if(F.col("cluster_count") > 0).alias("nonempty_shots"),
        F.count("*").alias("present"),
        *[F.sum(m).alias(f"sum_{m}") for m in LEVEL_MEASURES],
        *[F.max(m).alias(f"top_{m}") for m in LEVEL_MEASURES],
    )
    out = frame.join(sums, [*keys, "level"], "left").fillna(0)
    columns = [
        *[F.col(k) for k in keys], F.col("level"), F.col("shots"), F.col("nonempty_shots"),
        (F.col("nonempty_shots") / F.col("shots")).alias("nonempty_fraction"),
    ]
    for measure, kinds in LEVEL_MEASURES.items():
        columns.append((F.col(f"sum_{measure}") / F.col("shots")).alias(f"mean_{measure}"))
        columns.append(F.col(f"top_{measure}").alias(names[measure]))
        points = {f"{k}_{measure}": _POINTS[k] for k in kinds if k in _POINTS}
        if points:
            out = out.join(_zero_filled_quantiles(rows, frame, keys, measure, points), [*keys, "level"])
            columns.extend(F.col(name) for name in points)
    return out.select(*columns)


def _zero_filled_quantiles(rows: DataFrame, frame: DataFrame, keys: list[str], measure: str, points: dict[str, float]) -> DataFrame:
    """Quantiles with one 0 for every shot that lacks the level.

    Values are not negative, so the zeros come first and shift all positions.
    """
    counts = rows.groupBy(*keys, "level", F.col(measure).cast("long").alias("x")).agg(F.count("*").alias("k"))
    present = counts.groupBy(*keys, "level").agg(F.sum("k").alias("present"))
    zeros = frame.join(present, [*keys, "level"], "left").select(
        *keys, "level", F.lit(0).cast("long").alias("x"), (F.col("shots") - F.coalesce("present", F.lit(0))).alias("k")
    )
    merged = counts.unionByName(zeros).groupBy(*keys, "level", "x").agg(F.sum("k").alias("k")).where("k > 0")
    order = Window.partitionBy(*keys, "level").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = merged.withColumn("last", F.sum("k").over(order) - 1).join(frame, [*keys, "level"])
    first, last = F.col("last") - F.col("k") + 1, F.col("last")
    picks = []
    for name, q in points.items():
        at = F.lit(q) * (F.col("shots") - 1)
        share = at - F.floor(at)
        weight = F.when(F.floor(at).between(first, last), 1.0 - share).otherwise(0.0) + F.when(
            F.ceil(at).between(first, last) , share
        ).otherwise(0.0)
        picks.append(F.sum(F.col("x") * weight).alias(name))
    return ranked.groupBy(*keys, "level").agg(*picks)


def power_law(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, x_min, x_max, coefficient, exponent, r2 of y = A x^b in log space; positive points only.

    Groups with fewer than two points or no spread in x give no row.
    """
    lx, ly = F.log(F.col(x).cast("double")), F.log(F.col(y).cast("double"))
    usable = points.where((F.col(x) > 0) & (F.col(y) > 0)).withColumns({"lx": lx, "ly": ly})
    fit = usable.groupBy(*keys).agg(
        F.min(x).alias("x_min"), F.max(x).alias("x_max"),
        F.count("*").alias("n"),
        F.regr_sxx("ly", "lx").alias("sxx"), F.regr_syy("ly", "lx").alias("syy"),
        F.regr_slope("ly", "lx").alias("exponent"), F.regr_intercept("ly", "lx").alias("log_a"),
        F.regr_r2("ly", "lx").alias("r2"),
    )
    return fit.where("n >= 2 AND sxx > 0").select(
        *keys, "x_min", "x_max", F.exp("log_a").alias("coefficient"), "exponent",
        F.when(F.col("syy") > 0, F.col("r2")).otherwise(1.0).alias("r2"),
    )


def tail_start(summary: DataFrame, keys: list[str], x: str) -> DataFrame:
    """keys, tail_min: the value a third up the sorted list, for groups with at least six rows."""
    listed = summary.groupBy(*keys).agg(F.sort_array(F.collect_list(x)).alias("xs"))
    return listed.where(F.size("xs") >= 6).select(
        *keys, F.element_at("xs", (F.floor(F.size("xs") / 3) + 1).cast("int")).alias("tail_min")
    )


def fit_set(summary: DataFrame, keys: list[str], x: str, metrics: list[str]) -> DataFrame:
    """One fit per metric over all points and, with six or more, one over the tail; at least one key."""
    long = summary.select(*keys, x, F.explode(F.map_from_arrays(F.array(*[F.lit(m) for m in metrics]), F.array(*[F.col(m).cast("double") for m in metrics]))).alias("metric", "y"))
    everything = power_law(long, [*keys, "metric"], x, "y").withColumn("fit_range", F.lit("all_distances"))
    tails = tail_start(summary, keys, x)
    tail = long.join(tails, keys).where(F.col(x) >= F.col("tail_min"))
    labelled = tail.withColumn("fit_range", F.concat(F.lit("tail_d_ge_"), F.col("tail_min").cast("string")))
    return everything.unionByName(power_law(labelled, [*keys, "metric", "fit_range"], x, "y"))


def pair_runs(rows: DataFrame, case: str = "case", order: str = "ord") -> DataFrame:
    """First global and first parallel row of each case that has both, with the speed-up.

    ``rows``: case, mode, y, ord. The first row is a combinable minimum, so a case
    with very many rows needs no sort.
    """
    first = F.min(F.struct(order, "y", "mode")).alias("e")
    whole = rows.where("mode = 'global'").groupBy(case).agg(first).select(case, F.col("e.y").alias("global_y"))
    parts = rows.where("mode LIKE 'parallel\\\\_%'").groupBy(case).agg(first).select(
        case, F.col("e.y").alias("parallel_y"), F.col("e.mode").alias("parallel_mode")
    )
    return whole.join(parts, case).withColumn(
        "speedup", F.when(F.col("parallel_y") > 0, F.col("global_y") / F.col("parallel_y")).otherwise(0.0)
    )


def best_trial(trials: DataFrame, keys: list[str], score: list[Column]) -> DataFrame:
    """The best row per group by a list of keys, the largest first (negate what should be small)."""
    columns = [c for c in trials.columns if c not in keys]
    ranked = F.struct(*[s.alias(f"s{i}") for i, s in enumerate(score)])
    return trials.groupBy(*keys).agg(F.max_by(F.struct(*columns), ranked).alias("e")).select(*keys, "e.*")


def spaced_sample(values: DataFrame, keys: list[str], value: str, limit: int) -> DataFrame:
    """Evenly spaced distinct values, positions k*(n-1)/(limit-1) of the sorted list."""
    distinct = values.select(*keys, value).distinct()
    order = Window.partitionBy(*keys).orderBy(value)
    ranked = distinct.select(*keys, value, (F.row_number().over(order) - 1).alias("i"), F.count("*").over(Window.partitionBy(*keys)).alias("n"))
    if limit < 1:
        raise ValueError("limit must be positive")
    if limit == 1:
        return ranked.where("i = 0").select(*keys, value)
    # Position i is hit when some k maps onto it: k is the smallest with k*(n-1) >= i*(limit-1).
    k = F.ceil(F.col("i") * (limit - 1) / F.greatest(F.col("n") - 1, F.lit(1)))
    hit = F.floor(k * (F.col("n") - 1) / (limit - 1)) == F.col("i")
    return ranked.where((F.col("n") <= limit) | hit).select(*keys, value)


def distance_unit(matched: DataFrame) -> DataFrame:
    """unit: the mean length of matched paths, rounded up; ``matched`` has v (NULL: to
    the boundary) and d. Pairs decide where there are any; it is an error if no path
    has a length."""
    inner = F.avg(F.when(F.col("v").isNotNull(), F.col("d")))
    mean = matched.agg(F.coalesce(inner, F.avg("d")).alias("mean"))
    missing = F.raise_error(F.lit("no matched path to take a distance unit from")).cast("long")
    return mean.select(F.when(F.col("mean") > 0, F.ceil("mean")).otherwise(missing).alias("unit"))
