"""Growth from all hits of a shot at once: every node belongs to its nearest hit.

Where the regions of two hits touch, the way over the touching edge is a witness of
their distance. Of all pairs of hits only those with touching regions are listed, a few
per hit, and they carry everything that chains: the hits within ``b`` of each other, the
nearest hit of another group, and the steps of a least spanning tree are the same over
witnesses as over all pairs. A node is grown over once for a shot, not once for each
hit that reaches it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairloom.operators import overlay
from pairloom.operators.blocks import spans_few_hops
from pairloom.operators.components import components
from pairloom.operators.landmarks import component_spans
from pairloom.operators.pairs import by_size, near_pairs, pairs_within
from pairloom.operators.paths import FAR, FlatGraph, Graph, _SCRATCH, balls
from pairloom.operators.whole_shots import spanning_steps
from pairloom.session import cut, spread

# First reach of a growth that goes on until all hits of a shot have met.
FIRST = 32


def meetings(hits: DataFrame, graph: Graph, bound: int) -> DataFrame:
    """shot, u, v, d with u < v: pairs of hits whose regions touch over a way of at most
    ``bound``, with the shortest such way. A node between two hits at equal distance
    belongs to the smaller one. Regions reach half the bound, which no shorter chain of
    steps can leave."""
    hits = hits.select("shot", "det").distinct()
    return _meetings_by_join(hits, graph, bound) if graph.flat is None else _meetings_by_arrays(hits, graph, bound)


def owned(hits: DataFrame, graph: Graph, radius: int) -> DataFrame:
    """shot, node, owner, d: every node within ``radius`` of a hit with its nearest one."""
    hits = hits.select("shot", "det").distinct()
    if graph.flat is None:
        return _owned_by_balls(hits, graph, radius) if spans_few_hops(graph, 2 * radius) else _owned_by_join(hits, graph, radius)
    shared = graph.flat

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        growth = _Growth(shared.value)
        for batch in batches:
            for part, lanes, at in growth.parts(batch):
                keys = growth.grow(lanes, at, radius)
                g, n = growth.g, growth.n
                shots = batch.column("shot").take(pa.array(part.start + keys // n))
                yield pa.RecordBatch.from_arrays(
                    [shots, pa.array(g.ids[keys % n]), pa.array(g.ids[growth.own[keys]]), pa.array(growth.dist[keys])],
                    names=["shot", "node", "owner", "d"],
                )
                growth.clear(keys)

    return _per_shot(hits).mapInArrow(run, "shot long, node long, owner long, d long")


def _per_shot(hits: DataFrame) -> DataFrame:
    """One row per shot. The arrays form has a bounded graph, so a shot has few hits."""
    return spread(hits, "shot").groupBy("shot").agg(F.collect_list("det").alias("dets"))


class _Growth:
    """Regions of a few shots at a time, a lane of nodes for each, in one reused buffer."""

    def __init__(self, graph: FlatGraph):
        self.g = graph
        self.n = max(1, len(graph.ids))
        self.lanes = max(1, min(256, _SCRATCH // self.n))
        self.dist = np.full(self.lanes * self.n, FAR)
        self.own = np.zeros(self.lanes * self.n, np.int64)

    def parts(self, batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Slices of a batch of (shot, dets) with the lanes and positions of their hits."""
        lists = batch.column("dets")
        for start in range(0, batch.num_rows, self.lanes):
            part = lists.slice(start, self.lanes)
            lane = np.repeat(np.arange(len(part)), np.diff(part.offsets.to_numpy()))
            at = self.g.position(part.flatten().to_numpy(zero_copy_only=False))
            yield slice(start, start + len(part)), lane[at >= 0], at[at >= 0]

    def _arcs(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every arc out of ``keys``: index into them, arc, key at its end."""
        first = self.g.start[keys % self.n]
        count = self.g.start[keys % self.n + 1] - first
        rep = np.repeat(np.arange(len(keys)), count)
        arc = np.arange(len(rep)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        return rep, arc, (keys[rep] // self.n) * self.n + self.g.end[arc]

    def grow(self, lanes: np.ndarray, at: np.ndarray, radius: int) -> np.ndarray:
        """Fill the buffer; returns the keys lane * n + node that were reached."""
        front = lanes * self.n + at
        self.dist[front], self.own[front] = 0, at
        touched = [front]
        while len(front):
            rep, arc, key = self._arcs(front)
            reach, own = self.dist[front][rep] + self.g.weight[arc], self.own[front][rep]
            keep = (reach <= radius) & ((reach < self.dist[key]) | (reach == self.dist[key]) & (own < self.own[key]))
            key, reach, own = key[keep], reach[keep], own[keep]
            order = np.lexsort((own, reach, key))
            key, reach, own = key[order], reach[order], own[order]
            best = np.flatnonzero(np.diff(key, prepend=-1))
            front = key[best]
            self.dist[front], self.own[front] = reach[best], own[best]
            touched.append(front)
        return np.unique(np.concatenate(touched))

    def touching(self, keys: np.ndarray, bound: int) -> tuple[np.ndarray, ...]:
        """lane, smaller hit, larger hit (positions) and least way of touching regions."""
        rep, arc, other = self._arcs(keys)
        way = self.dist[keys][rep] + self.g.weight[arc] + np.minimum(self.dist[other], FAR)
        a, b = self.own[keys][rep], self.own[other]
        keep = (self.dist[other] < FAR) & (a < b) & (way <= bound)
        lane, a, b, way = (keys[rep] // self.n)[keep], a[keep], b[keep], way[keep]
        order = np.lexsort((way, b, a, lane))
        lane, a, b, way = lane[order], a[order], b[order], way[order]
        first = np.ones(len(lane), bool)
        first[1:] = (np.diff(lane) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0)
        return lane[first], a[first], b[first], way[first]

    def clear(self, keys: np.ndarray) -> None:
        self.dist[keys] = FAR


def _meetings_by_arrays(hits: DataFrame, graph: Graph, bound: int) -> DataFrame:
    shared = graph.flat

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        growth = _Growth(shared.value)
        for batch in batches:
            for part, lanes, at in growth.parts(batch):
                keys = growth.grow(lanes, at, bound // 2)
                lane, a, b, way = growth.touching(keys, bound)
                shots = batch.column("shot").take(pa.array(part.start + lane))
                ids = growth.g.ids
                yield pa.RecordBatch.from_arrays([shots, pa.array(ids[a]), pa.array(ids[b]), pa.array(way)], names=["shot", "u", "v", "d"])
                growth.clear(keys)

    return _per_shot(hits).mapInArrow(run, "shot long, u long, v long, d long")


def _owned_by_balls(hits: DataFrame, graph: Graph, radius: int) -> DataFrame:
    """The same from one ball for each node, whatever the number of shots that hit it. Only
    regions of hits within twice the radius of each other can meet; all others own their
    balls, so their nodes are never brought together by shot."""
    hits = cut(hits)
    reach = cut(balls(graph, hits.select(F.col("det").alias("src"), F.lit(radius).alias("radius"))))
    reach = reach.select(F.col("src").alias("det"), "node", "d")
    near = near_pairs(hits.withColumn("rho", F.lit(float(radius))), graph)
    met = cut(near.select("shot", F.explode(F.array("u", "v")).alias("det")).distinct())
    alone = hits.join(met, ["shot", "det"], "left_anti").join(reach, "det").select("shot", "node", F.col("det").alias("owner"), "d")
    best = hits.join(met, ["shot", "det"], "left_semi").join(reach, "det").groupBy("shot", "node").agg(F.min(F.struct("d", "det")).alias("e"))
    return alone.unionByName(best.select("shot", "node", F.col("e.det").alias("owner"), "e.d"))


def _owned_by_join(hits: DataFrame, graph: Graph, radius: int) -> DataFrame:
    """The same by joins, a round per hop; a round goes on from nodes that were reached
    or came to a nearer or smaller hit."""
    arcs = graph.once("arcs", graph.arcs).select("u", "v", "w")
    inside = hits.join(graph.nodes().withColumnRenamed("id", "det"), "det")
    seeds = inside.select("shot", F.col("det").alias("node"), F.struct(F.lit(0).cast("long").alias("d"), F.col("det").alias("owner")).alias("e"))
    known = cut(seeds.withColumn("fresh", F.lit(True)))
    while not known.where("fresh").isEmpty():
        ahead = known.where("fresh").withColumnRenamed("node", "u").join(arcs, "u")
        steps = ahead.select("shot", F.col("v").alias("node"), F.struct((F.col("e.d") + F.col("w")).alias("d"), F.col("e.owner").alias("owner")).alias("e"), F.lit(None).cast("boolean").alias("old"))
        both = known.select("shot", "node", "e", F.lit(True).alias("old")).unionByName(steps.where(F.col("e.d") <= radius))
        best = both.groupBy("shot", "node").agg(F.min("e").alias("e"), F.min(F.when(F.col("old"), F.col("e"))).alias("before"))
        known = cut(best.select("shot", "node", "e", (F.col("before").isNull() | (F.col("e") < F.col("before"))).alias("fresh")))
    return known.select("shot", "node", "e.owner", "e.d")


def _meetings_by_join(hits: DataFrame, graph: Graph, bound: int) -> DataFrame:
    regions = cut(_owned_by_join(hits, graph, bound // 2))
    arcs = graph.once("arcs", graph.arcs).select("u", "v", "w")
    a = regions.select("shot", F.col("node").alias("u"), F.col("owner").alias("a"), F.col("d").alias("da"))
    b = regions.select("shot", F.col("node").alias("v"), F.col("owner").alias("b"), F.col("d").alias("db"))
    ways = a.join(arcs, "u").join(b, ["shot", "v"]).where("a < b").withColumn("d", F.expr("da + w + db"))
    return ways.where(F.col("d") <= bound).groupBy("shot", F.col("a").alias("u"), F.col("b").alias("v")).agg(F.min("d").alias("d"))


def meetings_to_the_end(hits: DataFrame, graph: Graph, first: int = FIRST) -> DataFrame:
    """:func:`meetings` without a bound. In shots of ordinary size all pairs are measured,
    and those of a least spanning tree are enough. In larger ones the reach is doubled
    until all hits are chained or the reach covers the graph, so their work follows the
    distances between their own hits."""
    left = cut(hits.select("shot", "det").distinct())
    if not overlay.reachable(graph):
        return _doubled(left, graph, first)
    small, large = by_size(left)
    parts = [] if small is None else [spanning_steps(pairs_within(small, graph, int(FAR) // 4, masks=False))]
    parts += [] if large is None else [_doubled(cut(large), graph, first)]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _doubled(left: DataFrame, graph: Graph, first: int) -> DataFrame:
    widest = component_spans(graph).agg(F.max("span")).first()[0] or 0
    bound, done = first, None
    while True:
        found = cut(meetings(left, graph, bound))
        last = bound >= 2 * widest
        if last:
            return found if done is None else done.unionByName(found)
        roots = components(found.select("shot", F.col("u").alias("a"), F.col("v").alias("b")), ["shot"])
        parts = left.join(roots.withColumnRenamed("node", "det"), ["shot", "det"], "left")
        parts = parts.groupBy("shot").agg(F.count_distinct(F.coalesce("root", "det")).alias("parts"))
        open_shots = cut(parts.where("parts > 1").select("shot"))
        closed = found.join(open_shots, "shot", "left_anti")
        done = closed if done is None else done.unionByName(closed)
        if open_shots.isEmpty():
            return done
        left = cut(left.join(open_shots, "shot", "left_semi"))
        bound *= 2
