"""Pairs of hits of one shot that lie within reach of each other."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from pairloom.operators import blocks, overlay
from pairloom.operators.landmarks import landmarks
from pairloom.operators.paths import FAR, Graph, balls, pair_distances
from pairloom.session import cut

# A shot up to this size lists its own pairs: at most this many rows per hit.
SMALL_SHOT = 64
_CAP = int(FAR) // 2
# A reach of more hops than this takes longer to grow than to look up by hubs.
FEW_HOPS = 16


def by_size(hits: DataFrame, limit: int = SMALL_SHOT) -> tuple[DataFrame | None, DataFrame | None]:
    """Hits of shots with at most ``limit`` hits, and hits of the larger shots; None where there are none."""
    sizes = hits.groupBy("shot").agg(F.count("*").alias("n_hits"))
    least, most = sizes.agg(F.min("n_hits"), F.max("n_hits")).first()
    if most is None or most <= limit:
        return hits, None
    if least > limit:
        return None, hits
    sized = hits.join(sizes, "shot")
    return sized.where(F.col("n_hits") <= limit).drop("n_hits"), sized.where(F.col("n_hits") > limit).drop("n_hits")


def near_pairs(hits: DataFrame, graph: Graph, limit: int = SMALL_SHOT, strict: bool = False) -> DataFrame:
    """shot, u, v, d, mask with u < v and d <= rho_u + rho_v (``strict``: <).

    ``hits``: shot, det, rho. Shots up to ``limit`` hits pair up by an equi-join
    on the shot, which gives each hit fewer than ``limit`` partners, and only
    pairs that two landmarks of the graph do not rule out are measured. In larger
    shots every hit looks around itself in the graph instead and meets the hits
    it finds by an equi-join on (shot, node), so one enormous shot spreads over
    all tasks and a hit's partners are limited by the size of its ball.
    """
    small, large = by_size(hits.select("shot", "det", "rho"), limit)
    if large is None:
        return listed_pairs(small, graph, strict)
    found = _found_pairs(large, graph, strict)
    return found if small is None else listed_pairs(small, graph, strict).unionByName(found)


def _slack(reach, strict: bool):
    """Whole-number cap equal to d <= reach, or d < reach when strict."""
    capped = F.least(reach.cast("double"), F.lit(float(_CAP)))
    return (F.ceil(capped) - 1 if strict else F.floor(capped)).cast("long")


def _by_hubs(graph: Graph, reach: float) -> bool:
    """Whether pairs are measured by hubs (:mod:`pairloom.operators.overlay`), which know no masks."""
    return not blocks.spans_few_hops(graph, math.ceil(min(reach, _CAP)), FEW_HOPS) and overlay.reachable(graph)


def _without_masks(graph: Graph) -> bool:
    flagged = graph.once("flagged", lambda: graph.edges.where("v IS NOT NULL AND obs_mask <> 0").select("obs_mask").limit(1))
    return flagged.isEmpty()


def listed_pairs(hits: DataFrame, graph: Graph, strict: bool = False) -> DataFrame:
    """:func:`near_pairs` for shots that are all of ordinary size."""
    if _without_masks(graph):
        placed = cut(hits.select("shot", "det", "rho"))
        if _by_hubs(graph, 2 * (placed.agg(F.max("rho")).first()[0] or 0)):
            return _looked_up(placed, graph, strict).withColumn("mask", F.lit(0).cast("long"))
        hits = placed
    if graph.flat is None:
        return _listed_in_blocks(hits, graph, strict)
    marks = landmarks(graph).withColumnRenamed("id", "det")
    placed = hits.join(marks, "det").select("shot", "det", "rho", F.struct("comp", "d1", "d2").alias("at"))
    a = placed.select("shot", F.col("det").alias("u"), F.col("rho").alias("ru"), F.col("at").alias("a"))
    b = placed.select("shot", F.col("det").alias("v"), F.col("rho").alias("rv"), F.col("at").alias("b"))
    listed = a.join(b, "shot").where("u < v AND a.comp = b.comp").select(
        "shot", "u", "v", _slack(F.col("ru") + F.col("rv"), strict).alias("cap"),
        F.greatest(F.abs(F.col("a.d1") - F.col("b.d1")), F.abs(F.col("a.d2") - F.col("b.d2"))).alias("at_least"),
    )
    listed = listed.where("at_least <= cap").select("shot", "u", "v", "cap")
    known = pair_distances(graph, listed.select("u", "v", "cap"))
    return listed.join(known, ["u", "v"]).where("d <= cap").select("shot", "u", "v", "d", "mask")


def _looked_up(hits: DataFrame, graph: Graph, strict: bool = False) -> DataFrame:
    """shot, u, v, d: all pairs of each shot, measured by hubs."""
    a = hits.select("shot", F.col("det").alias("u"), F.col("rho").alias("ru"))
    b = hits.select("shot", F.col("det").alias("v"), F.col("rho").alias("rv"))
    cap = _slack(F.col("ru") + F.col("rv"), strict).alias("cap")
    return overlay.distances(graph, a.join(b, "shot").where("u < v").select("shot", "u", "v", cap).where("cap >= 0"))


def _listed_in_blocks(hits: DataFrame, graph: Graph, strict: bool) -> DataFrame:
    """The same without landmarks, which take a search over the whole graph: pairs go to
    the block of their smaller hit, and what is not near is not found around it."""
    placed = cut(hits.select("shot", "det", "rho"))
    a = placed.select("shot", F.col("det").alias("u"), F.col("rho").alias("ru"))
    b = placed.select("shot", F.col("det").alias("v"), F.col("rho").alias("rv"))
    cap = _slack(F.col("ru") + F.col("rv"), strict).alias("cap")
    listed = a.join(b, "shot").where("u < v").select("shot", "u", "v", cap).where("cap >= 0")
    if not blocks.spans_few_hops(graph, 2 * math.ceil(min(placed.agg(F.max("rho")).first()[0] or 0, _CAP))):
        return _found_pairs(placed, graph, strict)
    return blocks.pair_distances(graph, listed)


def _found_pairs(hits: DataFrame, graph: Graph, strict: bool) -> DataFrame:
    widest = hits.groupBy("shot").agg(F.max("rho").alias("most"))
    centres = hits.join(widest, "shot").select(
        "shot", F.col("det").alias("src"), "rho", F.floor(F.least(F.col("rho") + F.col("most"), F.lit(float(_CAP)))).cast("long").alias("radius")
    )
    reach = balls(graph, centres.select("src", "radius")).where("src < node")
    around = centres.join(reach, "src").where("d <= radius")
    other = hits.select("shot", F.col("det").alias("node"), F.col("rho").alias("rho_v"))
    return (
        around.join(other, ["shot", "node"])
        .where(F.col("d") <= _slack(F.col("rho") + F.col("rho_v"), strict))
        .select("shot", F.col("src").alias("u"), F.col("node").alias("v"), "d", "mask")
    )


def pairs_within(hits: DataFrame, graph: Graph, bound: float, limit: int = SMALL_SHOT, masks: bool = True) -> DataFrame:
    """shot, u, v, d, mask of the hit pairs at distance <= ``bound``; without ``masks``
    shot, u, v, d, where a bound of many hops needs no search."""
    reach = hits.withColumn("rho", F.lit(bound / 2.0))
    if masks:
        return near_pairs(reach, graph, limit)
    if not _by_hubs(graph, bound):
        return near_pairs(reach, graph, limit).drop("mask")
    small, large = by_size(reach.select("shot", "det", "rho"), limit)
    parts = [] if small is None else [_looked_up(small, graph)]
    parts += [] if large is None else [_found_pairs(large, graph, False).drop("mask")]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
