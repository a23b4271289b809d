"""Shortest paths on discrete edges.

Many sources and a cutoff each. A graph whose edge count is checked against
``BROADCAST_EDGES`` is sent once to the executors as flat arrays and every task
grows the balls of its own sources; a larger graph stays a table and is searched
block by block (:mod:`pairloom.operators.blocks`), or by joins, one hop per round,
where a radius spans very many hops. All ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairloom.session import cut, ship, spread

BROADCAST_EDGES = 2_000_000
FAR = np.int64(2**62)
_SCRATCH = 4_000_000


@dataclass(frozen=True)
class FlatGraph:
    """Adjacency as flat arrays; node positions index ``ids``."""

    ids: np.ndarray
    start: np.ndarray
    end: np.ndarray
    weight: np.ndarray
    mask: np.ndarray
    rim: np.ndarray
    rim_mask: np.ndarray

    def position(self, ids: np.ndarray) -> np.ndarray:
        """Positions of ids, -1 for ids outside the graph."""
        if len(self.ids) == 0:
            return np.full(len(ids), -1)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[at] == ids, at, -1)


class Graph:
    """Discrete edges plus, when they are few enough, their broadcast form."""

    def __init__(self, dedges: DataFrame, broadcast_edges: int = BROADCAST_EDGES):
        self.edges = dedges.where("v IS NULL OR u <> v").select("u", "v", "w", "obs_mask")
        self.spark = dedges.sparkSession
        ship(self.spark)
        self.flat = None
        self._tables: dict[str, DataFrame] = {}
        # Counted first, so that a graph above the limit never travels to the driver.
        self.edges = cut(self.edges)
        if 0 < broadcast_edges and self.edges.count() <= broadcast_edges:
            self.flat = self.spark.sparkContext.broadcast(_flatten(self.edges.toArrow()))

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A table that belongs to the graph, written on first use and read afterwards."""
        if name not in self._tables:
            self._tables[name] = cut(build())
        return self._tables[name]

    def arcs(self) -> DataFrame:
        """Interior edges in both directions: u, v, w, obs_mask."""
        inner = self.edges.where("v IS NOT NULL")
        back = inner.select(F.col("v").alias("u"), F.col("u").alias("v"), "w", "obs_mask")
        return inner.unionByName(back)

    def nodes(self) -> DataFrame:
        return self.edges.select(F.explode(F.array("u", "v")).alias("id")).where("id IS NOT NULL").distinct()


def _flatten(rows: pa.Table) -> FlatGraph:
    u = rows["u"].to_numpy()
    inner = rows["v"].is_valid().to_numpy()
    v = rows["v"].fill_null(-1).to_numpy()
    w = rows["w"].to_numpy()
    m = rows["obs_mask"].to_numpy()
    ids = np.unique(np.concatenate([u, v[inner]])) if len(u) else np.zeros(0, np.int64)
    flat = flat_arrays(ids, np.concatenate([u[inner], v[inner]]), np.concatenate([v[inner], u[inner]]), np.tile(w[inner], 2), np.tile(m[inner], 2))
    at = np.searchsorted(ids, u[~inner])
    flat.rim[at], flat.rim_mask[at] = w[~inner], m[~inner]
    return flat


def flat_arrays(ids: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray, m: np.ndarray) -> FlatGraph:
    """The arcs from u to v among the sorted ``ids``, without boundary edges."""
    a, b = np.searchsorted(ids, u), np.searchsorted(ids, v)
    order = np.lexsort((w, b, a))
    start = np.searchsorted(a[order], np.arange(len(ids) + 1))
    return FlatGraph(ids, start, b[order], w[order], m[order], np.full(len(ids), FAR), np.zeros(len(ids), np.int64))


class _Balls:
    """Distances from a few sources at a time, in one reused buffer."""

    def __init__(self, graph: FlatGraph):
        self.g = graph
        self.n = max(1, len(graph.ids))
        self.lanes = max(1, min(256, _SCRATCH // self.n))
        self.dist = np.full(self.lanes * self.n, FAR)
        self.mask = np.zeros(self.lanes * self.n, np.int64)
        self.came = np.full(self.lanes * self.n, -1, np.int64)

    def grow(self, sources: np.ndarray, radius: np.ndarray, to_rim: bool = False) -> np.ndarray:
        """Fill the buffer for ``sources`` (positions); returns the touched keys lane*n+node.

        With ``to_rim`` a lane stops once no node in reach can beat its best
        boundary distance.
        """
        g, n = self.g, self.n
        front = np.arange(len(sources)) * n + sources
        self.dist[front], self.mask[front], self.came[front] = 0, 0, -1
        touched = [front]
        best = radius.copy()
        if to_rim:
            np.minimum.at(best, front // n, g.rim[sources])
        while len(front):
            node = front % n
            first, last = g.start[node], g.start[node + 1]
            count = last - first
            rep = np.repeat(np.arange(len(front)), count)
            arc = np.arange(len(rep)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
            key = (front[rep] // n) * n + g.end[arc]
            reach = self.dist[front][rep] + g.weight[arc]
            keep = (reach <= best[key // n]) & (reach < self.dist[key])
            key, reach, rep, arc = key[keep], reach[keep], rep[keep], arc[keep]
            np.minimum.at(self.dist, key, reach)
            won = self.dist[key] == reach
            key, at = np.unique(key[won], return_index=True)
            origin = front[rep[won][at]]
            self.mask[key] = self.mask[origin] ^ g.mask[arc[won][at]]
            self.came[key] = origin
            touched.append(key)
            if to_rim and len(key):
                total = self.dist[key] + g.rim[key % n]
                np.minimum.at(best, key // n, np.minimum(total, FAR))
            front = key
        return np.unique(np.concatenate(touched))

    def clear(self, touched: np.ndarray) -> None:
        self.dist[touched] = FAR


def _batches(rows: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[np.ndarray]]:
    for batch in rows:
        if batch.num_rows:
            yield [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]


def balls(graph: Graph, sources: DataFrame) -> DataFrame:
    """All nodes within reach: ``sources`` (src, radius) to src, node, d, mask."""
    # Written first: Spark would take rows that are grouped by the same key as spread already, and fold them into one task.
    wanted = cut(sources.groupBy("src").agg(F.max("radius").cast("long").alias("radius")))
    if graph.flat is None:
        from pairloom.operators import blocks  # built on this module

        few = blocks.spans_few_hops(graph, wanted.agg(F.max("radius")).first()[0])
        return blocks.balls(graph, wanted) if few else _balls_by_join(graph, wanted)
    shared = graph.flat

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = _Balls(shared.value)
        g, n = work.g, work.n
        for src, radius in _batches(rows, ["src", "radius"]):
            at = g.position(src)
            inside = at >= 0
            src, radius, at = src[inside], radius[inside], at[inside]
            for i in range(0, len(src), work.lanes):
                part = slice(i, i + work.lanes)
                keys = work.grow(at[part], radius[part])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(src[part][keys // n]),
                        pa.array(g.ids[keys % n]),
                        pa.array(work.dist[keys]),
                        pa.array(work.mask[keys]),
                    ],
                    names=["src", "node", "d", "mask"],
                )
                work.clear(keys)

    return spread(wanted, "src").mapInArrow(run, "src long, node long, d long, mask long")


# Rounds of growth whose tables are read one by one before they are folded into one.
_LAYERS = 8


def _balls_by_join(graph: Graph, wanted: DataFrame) -> DataFrame:
    """The same by joins, one round per hop within the radius. A round writes the
    nodes that it reached or came closer to, and nothing of what was known before."""
    arcs = cut(graph.arcs())
    start = wanted.join(graph.nodes().withColumnRenamed("id", "src"), "src")
    front = cut(start.select("src", F.col("src").alias("node"), F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("mask"), "radius"))
    layers = [front.drop("radius")]

    def settled() -> DataFrame:
        rows = layers[0]
        for layer in layers[1:]:
            rows = rows.unionByName(layer)
        best = rows.groupBy("src", "node").agg(F.min(F.struct("d", "mask")).alias("e"))
        return best.select("src", "node", "e.d", "e.mask")

    while not front.isEmpty():
        ahead = front.select("src", F.col("node").alias("u"), F.col("d").alias("d0"), F.col("mask").alias("m0"), "radius")
        steps = ahead.join(arcs, "u").select(
            "src", F.col("v").alias("node"), (F.col("d0") + F.col("w")).alias("d"), F.col("m0").bitwiseXOR(F.col("obs_mask")).alias("mask"), "radius"
        )
        steps = steps.where("d <= radius").groupBy("src", "node").agg(F.min(F.struct("d", "mask")).alias("e"), F.max("radius").alias("radius"))
        before = settled().select("src", "node", F.col("d").alias("before"))
        closer = steps.join(before, ["src", "node"], "left").where("before IS NULL OR e.d < before")
        front = cut(closer.select("src", "node", "e.d", "e.mask", "radius"))
        layers.append(front.drop("radius"))
        if len(layers) > _LAYERS:
            layers = [cut(settled())]
    return settled()


def pair_distances(graph: Graph, pairs: DataFrame, masks: bool = True) -> DataFrame:
    """Distances of the asked pairs only: (u, v, cap) to u, v, d, mask where d <= cap;
    without ``masks`` u, v, d.

    Rows are brought together by u; a batch grows each of its sources once, up
    to the largest cap asked for it. A graph that stays a table is searched block by
    block, or answers by its hub labels where the caps span very many hops.
    """
    if not masks:
        return _unmasked_distances(graph, pairs)
    asked = pairs.groupBy("u", "v").agg(F.max("cap").cast("long").alias("cap"))
    if graph.flat is None:
        from pairloom.operators import blocks  # both built on this module
        from pairloom.operators.labels import hub_labels, labelled_distances

        asked = cut(asked)
        if blocks.spans_few_hops(graph, asked.agg(F.max("cap")).first()[0]):
            return blocks.pair_distances(graph, asked.withColumn("shot", F.lit(None).cast("long"))).drop("shot")
        labels = hub_labels(graph)
        if labels is not None:
            return labelled_distances(labels, asked)
        reach = _balls_by_join(graph, asked.groupBy(F.col("u").alias("src")).agg(F.max("cap").alias("radius")))
        found = reach.select(F.col("src").alias("u"), F.col("node").alias("v"), "d", "mask")
        return asked.join(found, ["u", "v"]).where("d <= cap").select("u", "v", "d", "mask")
    shared = graph.flat

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = _Balls(shared.value)
        g, n = work.g, work.n
        for u, v, cap in _batches(rows, ["u", "v", "cap"]):
            pu, pv = g.position(u), g.position(v)
            inside = (pu >= 0) & (pv >= 0)
            u, v, cap, pu, pv = u[inside], v[inside], cap[inside], pu[inside], pv[inside]
            source, lane = np.unique(pu, return_inverse=True)
            radius = np.zeros(len(source), np.int64)
            np.maximum.at(radius, lane, cap)
            for i in range(0, len(source), work.lanes):
                keys = work.grow(source[i : i + work.lanes], radius[i : i + work.lanes])
                pick = np.flatnonzero((lane >= i) & (lane < i + work.lanes))
                spot = (lane[pick] - i) * n + pv[pick]
                ok = work.dist[spot] <= cap[pick]
                pick, spot = pick[ok], spot[ok]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(u[pick]), pa.array(v[pick]), pa.array(work.dist[spot]), pa.array(work.mask[spot])],
                    names=["u", "v", "d", "mask"],
                )
                work.clear(keys)

    return spread(asked, "u").sortWithinPartitions("u").mapInArrow(run, "u long, v long, d long, mask long")


def _unmasked_distances(graph: Graph, pairs: DataFrame) -> DataFrame:
    from pairloom.operators import blocks, overlay  # both built on this module

    asked = cut(pairs.groupBy("u", "v").agg(F.max("cap").cast("long").alias("cap")))
    if blocks.spans_few_hops(graph, asked.agg(F.max("cap")).first()[0]) or not overlay.reachable(graph):
        return pair_distances(graph, asked).drop("mask")
    # A node without arcs has no place among the hubs, and is at no distance from itself.
    itself = asked.where("u = v AND cap >= 0").join(graph.nodes().withColumnRenamed("id", "u"), "u").select("u", "v", F.lit(0).cast("long").alias("d"))
    others = overlay.distances(graph, asked.where("u <> v").withColumn("shot", F.lit(0).cast("long"))).drop("shot")
    return others.unionByName(itself)


def shortest_paths(graph: Graph, pairs: DataFrame) -> DataFrame:
    """Edges on one shortest path of each asked (u, v): u, v, pos, a, b from u to v.

    Ties go to the path found from the node with the smaller position. Needs the
    broadcast form; on a larger graph walk back over :func:`balls` instead, see
    :func:`paths_by_join`.
    """
    if graph.flat is None:
        return paths_by_join(graph, pairs)
    shared = graph.flat
    asked = pairs.groupBy("u", "v").agg(F.max("cap").cast("long").alias("cap"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = _Balls(shared.value)
        g, n = work.g, work.n
        for u, v, cap in _batches(rows, ["u", "v", "cap"]):
            pu, pv = g.position(u), g.position(v)
            inside = (pu >= 0) & (pv >= 0)
            u, v, cap, pu, pv = u[inside], v[inside], cap[inside], pu[inside], pv[inside]
            source, lane = np.unique(pu, return_inverse=True)
            radius = np.zeros(len(source), np.int64)
            np.maximum.at(radius, lane, cap)
            for i in range(0, len(source), work.lanes):
                keys = work.grow(source[i : i + work.lanes], radius[i : i + work.lanes])
                pick = np.flatnonzero((lane >= i) & (lane < i + work.lanes))
                at = (lane[pick] - i) * n + pv[pick]
                ok = work.dist[at] <= cap[pick]
                pick, at = pick[ok], at[ok]
                steps: list[list[np.ndarray]] = []
                live = work.came[at] >= 0
                while live.any():
                    pick, at = pick[live], at[live]
                    before = work.came[at]
                    steps.append([pick, before % n, at % n])
                    at = before
                    live = work.came[at] >= 0
                work.clear(keys)
                if not steps:
                    continue
                which = np.concatenate([s[0] for s in steps])
                back = np.repeat(np.arange(len(steps)), [len(s[0]) for s in steps])
                length = np.zeros(len(u), np.int64)
                np.maximum.at(length, which, back)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(u[which]),
                        pa.array(v[which]),
                        pa.array(length[which] - back),
                        pa.array(g.ids[np.concatenate([s[1] for s in steps])]),
                        pa.array(g.ids[np.concatenate([s[2] for s in steps])]),
                    ],
                    names=["u", "v", "pos", "a", "b"],
                )

    return spread(asked, "u").sortWithinPartitions("u").mapInArrow(
        run, "u long, v long, pos long, a long, b long"
    )


def paths_by_join(graph: Graph, pairs: DataFrame) -> DataFrame:
    """Walk back from v over the distances from u, one edge per round."""
    asked = pairs.groupBy("u", "v").agg(F.max("cap").cast("long").alias("cap"))
    reach = cut(balls(graph, asked.select(F.col("u").alias("src"), F.col("cap").alias("radius"))).select("src", "node", "d"))
    arcs = cut(graph.arcs().select(F.col("u").alias("a"), F.col("v").alias("b"), "w"))
    at = asked.join(reach.select(F.col("src").alias("u"), F.col("node").alias("v"), "d"), ["u", "v"]).where("d <= cap")
    at = cut(at.select("u", "v", F.col("v").alias("b"), "d", F.lit(0).cast("long").alias("back")).where("u <> v"))
    steps = at.select("u", "v", "back", F.col("b").alias("a"), "b").where("false")
    while not at.isEmpty():
        before = reach.select(F.col("src").alias("u"), F.col("node").alias("a"), F.col("d").alias("da"))
        options = at.join(arcs, "b").join(before, ["u", "a"]).where("da + w = d AND a <> b")
        moved = cut(
            options.groupBy("u", "v", "b", "back").agg(F.min(F.struct("da", "a")).alias("e")).select(
                "u", "v", "back", F.col("e.a").alias("a"), "b", "e.da"
            )
        )
        steps = steps.unionByName(moved.select("u", "v", "back", "a", "b"))
        at = moved.where("a <> u").select("u", "v", F.col("a").alias("b"), F.col("da").alias("d"), (F.col("back") + 1).alias("back"))
    last = steps.groupBy("u", "v").agg(F.max("back").alias("last"))
    return steps.join(last, ["u", "v"]).select("u", "v", (F.col("last") - F.col("back")).alias("pos"), "a", "b")


def boundary_distances(graph: Graph) -> DataFrame:
    """Nearest boundary edge of every node: node, d, mask and the node the path leaves by (NULL: none)."""
    return graph.once("boundary", lambda: _boundary(graph))


def _boundary(graph: Graph) -> DataFrame:
    if graph.flat is None:
        return _boundary_by_join(graph)
    shared = graph.flat

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = _Balls(shared.value)
        g, n = work.g, work.n
        for (src,) in _batches(rows, ["id"]):
            at = g.position(src)
            for i in range(0, len(src), work.lanes):
                lanes = at[i : i + work.lanes]
                keys = work.grow(lanes, np.full(len(lanes), FAR), to_rim=True)
                lane, node = keys // n, keys % n
                total = np.where(g.rim[node] < FAR, work.dist[keys] + g.rim[node], FAR)
                order = np.lexsort((node, total, lane))
                first = order[np.searchsorted(lane[order], np.arange(len(lanes)))]
                found = total[first] < FAR
                flags = work.mask[keys[first]] ^ g.rim_mask[node[first]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(src[i : i + work.lanes]),
                        pa.array(total[first], mask=~found),
                        pa.array(flags, mask=~found),
                        pa.array(g.ids[node[first]], mask=~found),
                    ],
                    names=["node", "d", "mask", "leaves_by"],
                )
                work.clear(keys)

    return spread(cut(graph.nodes()), "id").mapInArrow(run, "node long, d long, mask long, leaves_by long")


def _boundary_by_join(graph: Graph) -> DataFrame:
    arcs = cut(graph.arcs())
    reach = F.struct("d", "leaves_by", "mask")
    seeds = graph.edges.where("v IS NULL").select(
        F.col("u").alias("node"), F.struct(F.col("w").alias("d"), F.col("u").alias("leaves_by"), F.col("obs_mask").alias("mask")).alias("e")
    )
    known = cut(seeds.groupBy("node").agg(F.min("e").alias("e")).withColumn("fresh", F.lit(True)))
    while not known.where("fresh").isEmpty():
        steps = (
            known.where("fresh").withColumnRenamed("node", "u").join(arcs, "u")
            .select(
                F.col("v").alias("node"), (F.col("e.d") + F.col("w")).alias("d"), "e.leaves_by",
                F.col("e.mask").bitwiseXOR(F.col("obs_mask")).alias("mask"),
            )
            .select("node", reach.alias("e"), F.lit(False).alias("old"))
        )
        best = (
            known.select("node", "e", F.lit(True).alias("old"))
            .unionByName(steps)
            .groupBy("node")
            .agg(F.min("e").alias("e"), F.min(F.when(F.col("old"), F.col("e"))).alias("before"))
        )
        fresh = F.col("before").isNull() | (F.col("e.d") < F.col("before.d")) | (
            (F.col("e.d") == F.col("before.d")) & (F.col("e.leaves_by") < F.col("before.leaves_by"))
        )
        known = cut(best.select("node", "e", fresh.alias("fresh")))
    return graph.nodes().withColumnRenamed("id", "node").join(
        known.select("node", "e.d", "e.mask", "e.leaves_by"), "node", "left"
    )


def radius_lists(graph: Graph, bounds: DataFrame) -> DataFrame:
    """level, u, v, d: nodes within each level's buffer bound of a node, both directions, itself excluded.

    One growth to the largest bound serves all levels; ``bounds`` has at most 64 rows.
    """
    widest = bounds.agg(F.max("b").alias("radius")).scalar()
    reach = balls(graph, graph.nodes().select(F.col("id").alias("src"), widest.alias("radius")))
    near = reach.where("src <> node").select(F.col("src").alias("u"), F.col("node").alias("v"), "d")
    return near.join(F.broadcast(bounds.select("level", "b")), F.col("d") <= F.col("b")).select("level", "u", "v", "d")
