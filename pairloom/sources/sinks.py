"""Tables written after a run: cluster events, members, assignments, level parameters, mistakes, totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pairloom.functions.masks import mask_text
from pairloom.operators.stats import standard_error


def append(rows: DataFrame, path: str, partition: list[str] | None = None) -> None:
    """Append to a Parquet table; the schema travels with the files."""
    writer = rows.write.mode("append")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def member_rows(members: DataFrame) -> DataFrame:
    """One row per cluster with its members as ``;``-joined text. ``members``: shot, level, root, det."""
    return members.groupBy("shot", "level", "root").agg(
        F.count("*").alias("active_detectors"),
        F.array_join(F.array_sort(F.collect_set("det")).cast("array<string>"), ";").alias("members"),
    )


def assignment_rows(members: DataFrame) -> DataFrame:
    """One row per (cluster, hit)."""
    return members.select("shot", "level", "root", F.col("det").alias("active_detector"))


def level_rows(clusters: DataFrame) -> DataFrame:
    """One row per non-empty level of a shot. ``clusters``: shot, level, size, n, critical."""
    return clusters.groupBy("shot", "level").agg(
        F.count("*").alias("cluster_count"),
        F.sum("size").alias("assigned_active_detector_count"),
        F.max("size").alias("max_cluster_active_detectors"),
        F.max("n").alias("max_cluster_event_count"),
        F.max("critical").alias("max_cluster_critical_path_event_count"),
    )


def mistakes(predicted: DataFrame, expected: DataFrame) -> DataFrame:
    """Shots whose predicted mask differs from the expected one, with the bits as text."""
    both = predicted.select("shot", F.col("obs_mask").alias("predicted")).join(
        expected.select("shot", F.col("obs_mask").alias("expected")), "shot"
    )
    wrong = both.where("predicted <> expected")
    return wrong.select(
        "shot", "predicted", "expected", mask_text(F.col("predicted")).alias("predicted_bits"), mask_text(F.col("expected")).alias("expected_bits")
    )


def of_mistakes(rows: DataFrame, wrong: DataFrame) -> DataFrame:
    """Rows (clusters, hits, matches) that belong to mistaken shots."""
    return rows.join(wrong.select("shot"), "shot", "left_semi")


# Measures of a benchmark row and the shot columns they average.
BENCH_MEASURES = {
    "global_mwpm_events": "global_events",
    "parallel_cluster_events_total": "cluster_events",
    "parallel_level_critical_events": "critical_events",
    "parallel_critical_path_algorithmic_time": "stop",
}
BENCH_MEANS = {
    "parallel_nonempty_event_levels_per_shot": "nonempty_levels",
    "child_import_messages_per_shot": "imports",
    "avg_clusters": "clusters",
    "avg_max_level": "max_level",
    "avg_peak_width": "peak_width",
    "avg_max_cluster_size": "max_cluster_size",
}


def bench_rows(shots: DataFrame, mode: str) -> DataFrame:
    """One row per case: means and standard errors per shot.

    ``shots``: case, the value columns of ``BENCH_MEASURES`` and ``BENCH_MEANS``, mistake and failed (0/1).
    """
    measures = []
    for name, column in BENCH_MEASURES.items():
        measures.append(F.round(F.avg(column), 6).alias(f"{name}_per_shot"))
        measures.append(F.round(standard_error(F.col(column)), 6).alias(f"{name}_std_error_per_shot"))
    return shots.groupBy("case").agg(
        F.lit(mode).alias("mode"), *measures,
        F.max("critical_events").alias("parallel_critical_events_seen"),
        *[F.round(F.avg(column), 6).alias(name) for name, column in BENCH_MEANS.items()],
        F.sum("mistake").alias("mistakes"), F.sum("failed").alias("exceptions"),
    )
