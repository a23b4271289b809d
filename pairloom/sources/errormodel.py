"""Detector error model text: ``error(p) D0 D1 L0 ^ D2`` instructions, already flattened."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pairloom.functions.weights import log_odds
from pairloom.operators.edges import joint_probabilities, merge_parallel


def pieces(lines: DataFrame, correlated: bool = False, strict: bool = True) -> DataFrame:
    """error, piece, u, v, p, obs, detectors of every piece; ``lines`` has error (an id) and value.

    Instructions other than ``error`` are skipped, a ``repeat`` block is an error,
    probability 0 is dropped. ``strict`` refuses pieces with more than two
    detectors, or with observables but none; otherwise they are dropped.
    With ``correlated`` p > 0.5 and empty pieces of a split error are refused.
    """
    word = F.regexp_extract("value", r"^\s*([a-z_]+)", 1)
    checked = F.when(word == "repeat", F.raise_error(F.lit("model still contains a repeat block")).cast("string")).otherwise(word)
    errors = lines.withColumn("word", checked).where("word = 'error'").select(
        "error",
        F.regexp_extract("value", r"\(([^)]*)\)", 1).cast("double").alias("p"),
        F.split(F.trim(F.regexp_replace("value", r"^\s*error\([^)]*\)", "")), r"\s*\^\s*").alias("parts"),
    ).where("p <> 0")
    if correlated:
        errors = errors.withColumn(
            "p", F.when(F.col("p") > 0.5, F.raise_error(F.lit("probability above 0.5 with correlations")).cast("double")).otherwise(F.col("p"))
        )
    rows = errors.select("error", "p", F.size("parts").alias("n_parts"), F.posexplode("parts").alias("piece", "text"))
    tokens = F.split("text", r"\s+")

    def numbers(letter: str, kind: str):
        return F.transform(F.filter(tokens, lambda t: t.startswith(letter)), lambda t: F.substring(t, 2, 20).cast(kind))

    rows = rows.select(
        "error", "piece", "p", "n_parts", numbers("D", "long").alias("dets"), F.array_sort(F.array_distinct(numbers("L", "int"))).alias("obs")
    )
    bad = (F.size("dets") > 2) | ((F.size("dets") == 0) & (F.size("obs") > 0))
    if correlated:
        bad = (F.size("dets") > 2) | ((F.size("dets") == 0) & (F.col("n_parts") > 1))
    if strict or correlated:
        rows = rows.withColumn("piece", F.when(bad, F.raise_error(F.lit("piece is not an edge")).cast("int")).otherwise(F.col("piece")))
    return rows.where(F.size("dets").isin(1, 2)).select(
        "error", "piece",
        F.array_min("dets").alias("u"), F.when(F.size("dets") == 2, F.array_max("dets")).alias("v"),
        "p", "obs",
    )


def model_lines(edges: DataFrame) -> DataFrame:
    """error, value: one instruction per user edge (u, v, p, obs, ord)."""
    targets = F.concat(
        F.array(F.concat(F.lit("D"), F.col("u").cast("string"))),
        F.when(F.col("v").isNull(), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("D"), F.col("v").cast("string")))),
        F.transform("obs", lambda o: F.concat(F.lit("L"), o.cast("string"))),
    )
    return edges.select(
        F.col("ord").alias("error"),
        F.concat(F.lit("error("), F.format_string("%.17g", "p"), F.lit(") "), F.array_join(targets, " ")).alias("value"),
    )


def graph_edges(lines: DataFrame, correlated: bool = False, merge: str = "independent", strict: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """User edges (u, v, w, p, obs, parallel) of a whole model and, with ``correlated``,
    the joint probabilities of edges that fire in one error.

    Parallel edges merge in the order of their error and piece.
    """
    parts = pieces(lines, correlated, strict)
    rows = parts.select("u", "v", log_odds(F.col("p")).alias("w"), "p", "obs", F.struct("error", "piece").alias("ord"))
    return merge_parallel(rows, merge), joint_probabilities(parts) if correlated else None
