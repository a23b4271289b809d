"""Facts about a whole graph that are worked out once: components, landmarks, spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pairloom.operators import overlay
from pairloom.operators.components import contract
from pairloom.operators.paths import FAR, Graph, balls
from pairloom.session import cut


def graph_components(graph: Graph) -> DataFrame:
    """id, comp: every node with the smallest node of its component."""
    return graph.once("components", lambda: _graph_components(graph))


def _graph_components(graph: Graph) -> DataFrame:
    links = graph.edges.where("v IS NOT NULL").select(F.col("u").alias("a"), F.col("v").alias("b"))
    found = contract(links, []).select(F.col("node").alias("id"), F.col("root").alias("comp"))
    return graph.nodes().join(found, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))


def landmarks(graph: Graph) -> DataFrame:
    """id, comp, d1, d2: distances to two far-apart nodes of the own component.

    The first landmark is the smallest node, the second the node farthest from
    it. For any two nodes the difference of their distances to a landmark is at
    most their distance, and the sum at least.
    """
    return graph.once("landmarks", lambda: _landmarks(graph))


def _landmarks(graph: Graph) -> DataFrame:
    comps = graph_components(graph)
    far = F.lit(int(FAR) // 4)
    if overlay.reachable(graph):
        return _landmarks_by_hubs(graph, comps)
    first = balls(graph, comps.where("id = comp").select(F.col("id").alias("src"), far.alias("radius")))
    first = cut(first.select(F.col("src").alias("comp"), F.col("node").alias("id"), F.col("d").alias("d1")))
    ends = first.groupBy("comp").agg(F.max(F.struct("d1", "id")).alias("e")).select("comp", F.col("e.id").alias("src"))
    second = balls(graph, ends.select("src", far.alias("radius")))
    second = second.join(ends, "src").select("comp", F.col("node").alias("id"), F.col("d").alias("d2"))
    return first.join(second, ["comp", "id"]).select("id", "comp", "d1", "d2")


def _landmarks_by_hubs(graph: Graph, comps: DataFrame) -> DataFrame:
    """The same without growing over the whole graph, which is one task for each component."""

    def measured(sources: DataFrame, name: str) -> DataFrame:
        asked = comps.join(sources, "comp").select(F.col("comp").alias("shot"), F.col("src").alias("u"), F.col("id").alias("v"), F.lit(int(FAR) // 4).alias("cap"))
        found = overlay.distances(graph, asked.where("u <> v")).select(F.col("shot").alias("comp"), F.col("v").alias("id"), F.col("d").alias(name))
        return found.unionByName(sources.select("comp", F.col("src").alias("id"), F.lit(0).cast("long").alias(name)))

    first = cut(measured(comps.where("id = comp").select("comp", F.col("id").alias("src")), "d1"))
    ends = cut(first.groupBy("comp").agg(F.max(F.struct("d1", "id")).alias("e")).select("comp", F.col("e.id").alias("src")))
    return first.join(measured(ends, "d2"), ["comp", "id"]).select("id", "comp", "d1", "d2")


def component_spans(graph: Graph) -> DataFrame:
    """comp, span: an upper bound of the distance inside each component.

    Any two nodes are joined through either landmark, so the smaller of twice
    the first eccentricity and the largest sum of both distances bounds them all.
    """
    return graph.once(
        "spans",
        lambda: landmarks(graph).groupBy("comp").agg(F.least(2 * F.max("d1"), F.max(F.col("d1") + F.col("d2"))).alias("span")),
    )
