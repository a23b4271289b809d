"""Searches of bounded reach on a graph that stays a table.

Nodes are dealt to blocks of neighbouring numbers. A block gets the arcs of all nodes
within reach of its own ones, by joins that only widen its rim, and is then searched
as flat arrays inside a task. Where neighbouring numbers are near each other, as on a
lattice, a node stands in few blocks; where they are not, a block holds no more rows
than the balls of its nodes have together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pairloom.operators.paths import _LAYERS, FlatGraph, Graph, _Balls, flat_arrays
from pairloom.session import cut, spread

# Node numbers to a block, and the hops that a reach may span.
BLOCK = 4096
MOST_HOPS = 128


def spans_few_hops(graph: Graph, reach: int | None, most: int | None = None) -> bool:
    """Whether a way as long as ``reach`` has at most ``most`` (``MOST_HOPS`` if not given) edges."""
    lightest = graph.once("lightest", lambda: graph.edges.where("v IS NOT NULL").agg(F.min("w").alias("w"))).first()[0]
    return reach is None or lightest is None or reach <= (MOST_HOPS if most is None else most) * lightest


def _home(node: str) -> Column:
    return F.floor(F.col(node) / BLOCK).cast("long")


def _surroundings(graph: Graph, asked: DataFrame) -> DataFrame:
    """Rows of kind 0: the own nodes of each block of ``asked`` (block, radius), and the
    arcs out of all nodes within its radius of them."""
    arcs = graph.once("arcs", graph.arcs)
    own = graph.nodes().withColumn("block", _home("id")).join(asked, "block")
    front = own.select("block", F.col("id").alias("node"), F.col("radius").alias("left"))
    layers: list[DataFrame] = []

    def settled() -> DataFrame:
        rows = layers[0]
        for layer in layers[1:]:
            rows = rows.unionByName(layer)
        return rows.groupBy("block", "node").agg(F.max("left").alias("left"))

    while True:
        steps = front.withColumnRenamed("node", "u").join(arcs, "u").select("block", F.col("v").alias("node"), (F.col("left") - F.col("w")).alias("left"))
        steps = steps.where((F.col("left") >= 0) & (_home("node") != F.col("block"))).groupBy("block", "node").agg(F.max("left").alias("left"))
        if layers:
            before = settled().withColumnRenamed("left", "before")
            steps = steps.join(before, ["block", "node"], "left").where("before IS NULL OR left > before").drop("before")
        front = cut(steps)
        if front.isEmpty():
            break
        layers.append(front)
        if len(layers) > _LAYERS:
            layers = [cut(settled())]
    inside = own.select("block", F.col("id").alias("u"))
    nodes = inside.select("block", "u", F.lit(None).cast("long").alias("v"), F.lit(0).cast("long").alias("w"), F.lit(0).cast("long").alias("obs_mask"))
    if layers:
        inside = inside.unionByName(settled().select("block", F.col("node").alias("u")))
    rows = nodes.unionByName(inside.join(arcs, "u").select("block", "u", "v", "w", "obs_mask"))
    return rows.select("block", F.lit(0).alias("kind"), "u", "v", F.col("w").alias("d"), F.col("obs_mask").alias("mask"), F.lit(None).cast("long").alias("tag"))


def _flat(parts: list[list[np.ndarray]]) -> FlatGraph:
    u, v, w, m, inner = (np.concatenate(x) for x in zip(*parts))
    ids = np.unique(np.concatenate([u, v[inner]]))
    return flat_arrays(ids, u[inner], v[inner], w[inner], m[inner])


def _searched(graph: Graph, wanted: DataFrame, answer: Callable[..., Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``answer`` on the rows of ``wanted`` (u, v, d, tag), batch by batch, with the arrays
    of what lies around the block of u; d is the reach of a row."""
    placed = wanted.select(
        _home("u").alias("block"), F.lit(1).alias("kind"), "u", "v", "d", F.lit(None).cast("long").alias("mask"), "tag"
    )
    asked = cut(placed.groupBy("block").agg(F.max("d").alias("radius")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, parts, work = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            block, kind, u = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "kind", "u"))
            inner = batch.column("v").is_valid().to_numpy(zero_copy_only=False)
            v, d, mask, tag = (batch.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("v", "d", "mask", "tag"))
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(block)]):
                if block[a] != here:
                    here, parts, work = block[a], [], None
                if kind[a] == 0:
                    parts.append([x[a:b].copy() for x in (u, v, d, mask, inner)])
                elif parts:
                    if work is None:
                        work = _Balls(_flat(parts))
                    yield from answer(work, u[a:b], v[a:b], d[a:b], tag[a:b])

    rows = _surroundings(graph, asked).unionByName(placed)
    return spread(rows, "block").sortWithinPartitions("block", "kind", "u").mapInArrow(run, schema)


def balls(graph: Graph, wanted: DataFrame) -> DataFrame:
    """src, node, d, mask of :func:`pairloom.operators.paths.balls` for ``wanted`` (src, radius)."""

    def answer(work: _Balls, u, _v, radius, _tag) -> Iterator[pa.RecordBatch]:
        g, n = work.g, work.n
        at = g.position(u)
        src, radius, at = u[at >= 0], radius[at >= 0], at[at >= 0]
        for i in range(0, len(src), work.lanes):
            part = slice(i, i + work.lanes)
            keys = work.grow(at[part], radius[part])
            yield pa.RecordBatch.from_arrays(
                [pa.array(src[part][keys // n]), pa.array(g.ids[keys % n]), pa.array(work.dist[keys]), pa.array(work.mask[keys])],
                names=["src", "node", "d", "mask"],
            )
            work.clear(keys)

    none = F.lit(None).cast("long")
    rows = wanted.select(F.col("src").alias("u"), none.alias("v"), F.col("radius").alias("d"), none.alias("tag"))
    return _searched(graph, rows, answer, "src long, node long, d long, mask long")


def pair_distances(graph: Graph, listed: DataFrame) -> DataFrame:
    """shot, u, v, d, mask of the rows of ``listed`` (shot, u, v, cap) with d <= cap."""

    def answer(work: _Balls, u, v, cap, shot) -> Iterator[pa.RecordBatch]:
        g, n = work.g, work.n
        pu, pv = g.position(u), g.position(v)
        inside = (pu >= 0) & (pv >= 0)  # a node outside these arrays is out of reach
        shot, u, v, cap, pu, pv = shot[inside], u[inside], v[inside], cap[inside], pu[inside], pv[inside]
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
                [pa.array(shot[pick]), pa.array(u[pick]), pa.array(v[pick]), pa.array(work.dist[spot]), pa.array(work.mask[spot])],
                names=["shot", "u", "v", "d", "mask"],
            )
            work.clear(keys)

    rows = listed.select("u", "v", F.col("cap").alias("d"), F.col("shot").alias("tag"))
    return _searched(graph, rows, answer, "shot long, u long, v long, d long, mask long")
