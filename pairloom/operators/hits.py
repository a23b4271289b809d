"""Hit sets of shots: parity, validation and toggling."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def odd_hits(raw: DataFrame) -> DataFrame:
    """Keep the (shot, det) pairs named an odd number of times."""
    return raw.groupBy("shot", "det").count().where("count % 2 = 1").select("shot", "det")


def normalise(raw: DataFrame, nodes: DataFrame, boundary: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """Distinct hits on graph nodes, without those on boundary nodes.

    ``nodes`` and ``boundary`` have a column ``id``. A hit outside the graph is
    an error when ``strict``, otherwise it is dropped.
    """
    known = nodes.select(F.col("id").alias("det"), F.lit(True).alias("known")).distinct()
    out = raw.select("shot", "det").distinct().join(known, "det", "left")
    if strict:
        out = out.withColumn(
            "known",
            F.when(
                F.col("known").isNull(),
                F.raise_error(F.concat(F.lit("hit outside the graph: "), F.col("det").cast("string"))).cast("boolean"),
            ).otherwise(True),
        )
    out = out.where("known").select("shot", "det")
    if boundary is not None:
        out = out.join(boundary.select(F.col("id").alias("det")), "det", "left_anti")
    return out.select("shot", "det")


# Slices of the toggled nodes that a shot meets one by one.
_SLICES = 64


def toggle(hits: DataFrame, shots: DataFrame, toggled: DataFrame | None) -> DataFrame:
    """Exclusive or of every shot's hits with one fixed set of nodes (column id).

    The set comes from the negative edges of a graph, so it is a property of the
    graph and not of the shots; each shot gets all of it, as the meaning demands.
    It stays a table: every shot asks for each slice of it by an equi-join.
    """
    if toggled is None:
        return hits.select("shot", "det")
    part = F.pmod(F.xxhash64("id"), F.lit(_SLICES)).cast("int")
    asked = shots.select("shot").distinct().select("shot", F.explode(F.sequence(F.lit(0), F.lit(_SLICES - 1))).alias("part"))
    extra = asked.join(toggled.select(F.col("id").cast("long").alias("det"), part.alias("part")), "part").select("shot", "det")
    return odd_hits(hits.select("shot", "det").unionByName(extra))


def slice_shots(shots: DataFrame, start: int = 0, most: int | None = None) -> DataFrame:
    """The first ``most`` shots from number ``start`` on, whether or not numbers are missing."""
    out = shots.where(F.col("shot") >= start)
    if most is None:
        return out
    chosen = out.select("shot").distinct().orderBy("shot").limit(most)
    return out.join(chosen, "shot", "left_semi")
