"""Hub labels: distances of any two nodes of a graph that stays a table, by one join.

Nodes leave the graph in rounds, always such that no two of them are neighbours and
those with few arcs go first; what a node leaves behind are arcs between its
neighbours as long as the way through it. What remains at the end (the core, few
nodes) is measured whole. Going back, the hubs of a node are itself and those of the
neighbours it had when it left. A shortest path climbs to the node on it that stayed
longest and comes down again, so two nodes share a hub on a shortest path between
them: their distance is the least sum over common hubs. The rounds follow the
logarithm of the number of nodes, not the hops of a path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pairloom.operators.paths import FAR, Graph, balls
from pairloom.session import cut

# Nodes at which the rounds end; most arcs of a node that may leave; largest core that is measured.
CORE = 128
ARCS = 40
LARGEST_CORE = 2_000
_LABELS = "node long, hub long, d long, mask long"


def hub_labels(graph: Graph, core: int = CORE) -> DataFrame | None:
    """node, hub, d, mask for every node; None where a graph is so dense that more than
    ``LARGEST_CORE`` nodes are left when all of them have too many arcs to leave."""
    if "labels" not in graph._tables:
        built = _built(graph, core)
        if built is None:
            return None
        graph._tables["labels"] = built
    return graph._tables["labels"]


def _least(arcs: DataFrame) -> DataFrame:
    best = arcs.groupBy("u", "v").agg(F.min(F.struct("w", "mask")).alias("e"))
    return best.select("u", "v", "e.w", "e.mask")


def _built(graph: Graph, core: int) -> DataFrame | None:
    arcs = cut(_least(graph.arcs().select("u", "v", "w", F.col("obs_mask").alias("mask"))))
    climbs: list[DataFrame] = []
    while True:
        rank = F.struct("arcs", F.xxhash64("u").alias("h"), "u")
        ranks = cut(arcs.groupBy("u").agg(F.count("*").alias("arcs")).select("u", "arcs", rank.alias("rank")))
        if ranks.count() <= core:
            break
        around = arcs.join(ranks.select(F.col("u").alias("v"), F.col("rank").alias("other")), "v").groupBy("u").agg(F.min("other").alias("other"))
        leaving = cut(ranks.where(F.col("arcs") <= ARCS).join(around, "u").where("rank < other").select("u"))
        if leaving.isEmpty():
            break
        climb = cut(arcs.join(leaving, "u"))
        climbs.append(climb)
        through = climb.select("u", F.col("v").alias("a"), F.col("w").alias("wa"), F.col("mask").alias("ma")).join(
            climb.select("u", F.col("v").alias("b"), F.col("w").alias("wb"), F.col("mask").alias("mb")), "u"
        )
        through = through.where("a <> b").select(
            F.col("a").alias("u"), F.col("b").alias("v"), (F.col("wa") + F.col("wb")).alias("w"), F.col("ma").bitwiseXOR(F.col("mb")).alias("mask")
        )
        stay = arcs.join(leaving, "u", "left_anti").join(leaving.withColumnRenamed("u", "v"), "v", "left_anti")
        arcs = cut(_least(stay.select("u", "v", "w", "mask").unionByName(through)))
    left = cut(arcs.select(F.col("u").alias("id")).distinct())
    if left.count() > LARGEST_CORE:
        return None
    inner = Graph(arcs.where("u < v").select("u", "v", "w", F.col("mask").alias("obs_mask")), broadcast_edges=LARGEST_CORE * LARGEST_CORE)
    reach = balls(inner, left.select(F.col("id").alias("src"), F.lit(int(FAR) // 4).alias("radius")))
    labels = [cut(reach.where("src <= node").select(F.col("src").alias("node"), F.col("node").alias("hub"), "d", "mask"))]
    own = graph.nodes().join(left, "id", "left_anti").select(F.col("id").alias("node"), F.col("id").alias("hub"), *[F.lit(0).cast("long").alias(c) for c in ("d", "mask")])
    labels.append(cut(own))
    for climb in reversed(climbs):
        known = labels[0]
        for more in labels[1:]:
            known = known.unionByName(more)
        ups = climb.withColumnRenamed("mask", "m").join(known.withColumnRenamed("node", "v"), "v")
        found = ups.select(F.col("u").alias("node"), "hub", (F.col("d") + F.col("w")).alias("d"), F.col("m").bitwiseXOR(F.col("mask")).alias("mask"))
        best = found.groupBy("node", "hub").agg(F.min(F.struct("d", "mask")).alias("e"))
        labels.append(cut(best.select("node", "hub", "e.d", "e.mask")))
    every = labels[0]
    for more in labels[1:]:
        every = every.unionByName(more)
    return every


def labelled_distances(labels: DataFrame, asked: DataFrame) -> DataFrame:
    """u, v, d, mask where d <= cap, for ``asked`` (u, v, cap), each pair once."""
    ends = asked.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    near = labels.join(ends, "node", "left_semi")
    a = near.select(F.col("node").alias("u"), "hub", F.col("d").alias("du"), F.col("mask").alias("mu"))
    b = near.select(F.col("node").alias("v"), "hub", F.col("d").alias("dv"), F.col("mask").alias("mv"))
    met = asked.join(a, "u").join(b, ["v", "hub"]).where("du + dv <= cap")
    best = met.groupBy("u", "v").agg(F.min(F.struct((F.col("du") + F.col("dv")).alias("d"), F.col("mu").bitwiseXOR(F.col("mv")).alias("mask"))).alias("e"))
    return best.select("u", "v", "e.d", "e.mask")
