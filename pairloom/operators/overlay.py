"""Exact distances of any pairs of nodes, however many hops they span.

Nodes are dealt to blocks of neighbouring numbers, as in :mod:`pairloom.operators.blocks`.
The nodes of a block with an arc to another block are its border; the borders, joined by
the ways inside the blocks, are a small graph with the same distances. Its blocks are
halved again and again: whatever way leads from one half to the other passes the border
nodes of the left half that touch the right one. Every node knows its distance to these
hubs of all the halvings that it lies in, so a distance is the least sum over common hubs.
Inside a block the halving goes on for the pairs that are asked there.

The hubs of a block are one file in the shared folder. A task holds a few blocks, so
neither the graph nor the hubs are ever in one place. Where blocks have very large
borders, numbers say nothing of nearness, and callers go another way.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pairloom.operators.paths import Graph
from pairloom.session import cut, shared_folder, spread

# Node numbers to a block; nodes of a part inside a block that is measured whole.
BLOCK = 4096
LEAF = 128
# Largest border of a block, and of all blocks together, for which hubs are kept.
MOST_BORDER = 512
ALL_BORDERS = 500_000
FAR = np.int64(2**61)
_SCRATCH = 8_000_000
_HELD = 6
# A block that is asked for its own pairs is halved anew for so many of them.
_ROWS = 200_000


@dataclass(frozen=True)
class Arcs:
    """Arcs by the position of their start."""

    start: np.ndarray
    end: np.ndarray
    weight: np.ndarray

    @staticmethod
    def of(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> Arcs:
        order = np.argsort(a, kind="stable")
        return Arcs(np.searchsorted(a[order], np.arange(n + 1)), b[order], w[order])

    def out(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every arc out of ``at``: index into it, and the arc."""
        first = self.start[at]
        count = self.start[at + 1] - first
        rep = np.repeat(np.arange(len(at)), count)
        return rep, np.arange(len(rep)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)

    def settle(self, dist: np.ndarray, lo: int, hi: int) -> None:
        """Bring the rows of ``dist`` (one column for each position from lo to hi), which
        hold distances of some positions, down to the least ways inside lo to hi."""
        n, flat = hi - lo, dist.reshape(-1)
        front = np.flatnonzero(flat < FAR)
        while len(front):
            rep, arc = self.out(front % n + lo)
            end = self.end[arc] - lo
            inside = (end >= 0) & (end < n)
            rep, arc, end = rep[inside], arc[inside], end[inside]
            key, reach = (front[rep] // n) * n + end, flat[front[rep]] + self.weight[arc]
            keep = reach < flat[key]
            key, reach = key[keep], reach[keep]
            np.minimum.at(flat, key, reach)
            front = np.unique(key)

    def ways(self, sources: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Distances inside lo to hi from ``sources``, a row each."""
        dist = np.full((len(sources), hi - lo), FAR)
        dist[np.arange(len(sources)), sources - lo] = 0
        self.settle(dist, lo, hi)
        return dist


def _least_sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least sum over the columns of a and b, for each row of a with each row of b."""
    out = np.full((len(a), len(b)), FAR)
    for k in range(a.shape[1]):
        np.minimum(out, a[:, k, None] + b[None, :, k], out=out)
    return out


def _split(arcs: Arcs, lo: int, mid: int, hi: int, hubs: np.ndarray, leaves: np.ndarray) -> np.ndarray:
    """Distances of all positions from lo to hi (rows) to the new hubs, which are the
    positions below ``mid`` with an arc to those from it on. ``hubs``: distances to the
    hubs of all larger parts, ``leaves``: positions with arcs to outside of all arrays."""
    rep, arc = arcs.out(np.arange(lo, hi))
    end = arcs.end[arc]
    new = np.unique(rep[(rep < mid - lo) & (end >= mid) & (end < hi)])
    outer = np.unique(np.r_[rep[(end < lo) | (end >= hi)], np.flatnonzero(leaves[lo:hi])])
    found = []
    lanes = max(1, _SCRATCH // (hi - lo))
    for i in range(0, len(new), lanes):
        part = new[i : i + lanes]
        dist = np.full((len(part), hi - lo), FAR)
        if hubs.shape[1] and len(outer):
            # A way that leaves this part passes a hub of a larger one.
            dist[:, outer] = _least_sums(hubs[part], hubs[outer])
        dist[np.arange(len(part)), part] = 0
        arcs.settle(dist, lo, hi)
        found.append(dist)
    return np.concatenate(found).T if found else np.zeros((hi - lo, 0), np.int64)


def _passing(arcs: Arcs, lo: int, mid: int, hi: int) -> int:
    """How many positions below ``mid`` have an arc to those from it on."""
    rep, arc = arcs.out(np.arange(lo, mid))
    end = arcs.end[arc]
    return len(np.unique(rep[(end >= mid) & (end < hi)]))


def _matrix(arcs: Arcs, lo: int, hi: int) -> np.ndarray:
    """All distances inside lo to hi."""
    dist = np.full((hi - lo, hi - lo), FAR)
    rep, arc = arcs.out(np.arange(lo, hi))
    end = arcs.end[arc] - lo
    inside = (end >= 0) & (end < hi - lo)
    np.minimum.at(dist, (rep[inside], end[inside]), arcs.weight[arc[inside]])
    np.fill_diagonal(dist, 0)
    for k in range(hi - lo):
        np.minimum(dist, dist[:, k, None] + dist[None, k, :], out=dist)
    return dist


def _save(path: str, **arrays: np.ndarray) -> None:
    """Distances that fit are kept as 32-bit numbers, -1 for none."""
    hubs = arrays["hubs"]
    none = hubs >= FAR
    small = not hubs.size or np.max(hubs, where=~none, initial=0) < 2**31
    np.savez(path, **(arrays | {"hubs": np.where(none, -1, hubs).astype(np.int32 if small else np.int64)}))


class _Block:
    """What a task holds of a block."""

    def __init__(self, path: str):
        with np.load(path) as f:
            self.ids, self.border, self.cells, self.ends = f["ids"], f["border"], f["cells"], f["ends"]
            self.arcs = Arcs(f["start"], f["end"], f["weight"])
            hubs = f["hubs"].astype(np.int64)
        hubs[hubs < 0] = FAR
        self.hubs = hubs

    def position(self, ids: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[at] == ids, at, -1)

    def common(self, other: _Block) -> int:
        """How many hubs both have: those of the parts that hold both blocks."""
        n = min(len(self.cells), len(other.cells))
        same = np.cumprod(self.cells[:n] == other.cells[:n]).sum()
        return int(self.ends[same - 1]) if same else 0


def _over_hubs(a: np.ndarray, b: np.ndarray, pu: np.ndarray, pv: np.ndarray, k: int) -> np.ndarray:
    out = np.full(len(pu), FAR)
    if k:
        for i in range(0, len(pu), 4096):
            part = slice(i, i + 4096)
            out[part] = (a[pu[part], :k] + b[pv[part], :k]).min(axis=1)
    return out


def _inside(block: _Block, pu: np.ndarray, pv: np.ndarray) -> np.ndarray:
    """Distances of pairs of positions in one block."""
    arcs, best = block.arcs, _over_hubs(block.hubs, block.hubs, pu, pv, block.hubs.shape[1])
    todo = [(0, len(block.ids), block.hubs, np.arange(len(pu)))]
    while todo:
        lo, hi, hubs, at = todo.pop()
        if not len(at):
            continue
        mid = (lo + hi) // 2
        if hi - lo <= LEAF or 3 * _passing(arcs, lo, mid, hi) > hi - lo:
            if hi - lo <= 2 * LEAF:
                best[at] = np.minimum(best[at], _matrix(arcs, lo, hi)[pu[at] - lo, pv[at] - lo])
                continue
            source, lane = np.unique(pu[at], return_inverse=True)
            lanes = max(1, _SCRATCH // (hi - lo))
            for i in range(0, len(source), lanes):
                dist = arcs.ways(source[i : i + lanes], lo, hi)
                pick = np.flatnonzero((lane >= i) & (lane < i + lanes))
                best[at[pick]] = np.minimum(best[at[pick]], dist[lane[pick] - i, pv[at[pick]] - lo])
            continue
        new = _split(arcs, lo, mid, hi, hubs, block.border)
        best[at] = np.minimum(best[at], _over_hubs(new, new, pu[at] - lo, pv[at] - lo, new.shape[1]))
        hubs = np.hstack([hubs, new])
        left, right = (pu[at] < mid) & (pv[at] < mid), (pu[at] >= mid) & (pv[at] >= mid)
        todo += [(lo, mid, hubs[: mid - lo], at[left]), (mid, hi, hubs[mid - lo :], at[right])]
    return best


def _home(node: str, block: int) -> Column:
    return F.floor(F.col(node) / block).cast("long")


def _by_key(batches: Iterator[pa.RecordBatch], keys: list[str], columns: list[str]) -> Iterator[tuple]:
    """Runs of rows with equal keys: (keys, columns)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        named = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        values = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        change = np.zeros(batch.num_rows - 1, bool)
        for x in named:
            change |= np.diff(x) != 0
        cuts = np.flatnonzero(change) + 1
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows]):
            yield tuple(int(x[a]) for x in named), [x[a:b] for x in values]


def _merged(runs: Iterator[tuple], most: int | None = None) -> Iterator[tuple]:
    """Neighbouring runs of one key as one; with ``most`` a key may come in several of at
    least so many rows. The rows come in order of the key."""
    here, parts, rows = None, [], 0
    for key, columns in runs:
        if parts and (key != here or (most and rows >= most)):
            yield here, [np.concatenate(x) for x in zip(*parts)]
            parts, rows = [], 0
        here = key
        parts.append([x.copy() for x in columns])
        rows += len(columns[0])
    if parts:
        yield here, [np.concatenate(x) for x in zip(*parts)]


def _arrays(number: int, size: int, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, Arcs]:
    """ids, whether a node is on the border, and the inner arcs of a block."""
    cross = v // size != number
    ids = np.unique(u)
    border = np.zeros(len(ids), bool)
    border[np.searchsorted(ids, u[cross])] = True
    a, b = np.searchsorted(ids, u[~cross]), np.searchsorted(ids, v[~cross])
    return ids, border, Arcs.of(len(ids), a, b, w[~cross])


def _folder(graph: Graph) -> str:
    base = re.sub(r"^file:/+", "/", shared_folder(graph.spark))
    path = os.path.join(base, f"pairloom-{graph.spark.sparkContext.applicationId}", f"hubs-{uuid.uuid4().hex}")
    os.makedirs(path, exist_ok=True)
    return path


def _block_files(graph: Graph, size: int) -> dict[int, str] | None:
    """The file of every block; None where borders are too large."""
    arcs = graph.once("arcs", graph.arcs).select("u", "v", "w")
    home, cross = _home("u", size), _home("u", size) != _home("v", size)
    borders = arcs.where(cross).select("u", home.alias("block")).distinct().groupBy("block").count()
    most, total = borders.agg(F.max("count"), F.sum("count")).first()
    if (most or 0) > MOST_BORDER or (total or 0) > ALL_BORDERS:
        return None
    folder = _folder(graph)
    by_block = spread(arcs.select(home.alias("block"), "u", "v", "w"), "block").sortWithinPartitions("block", "u")

    def cliques(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (number,), (u, v, w) in _merged(_by_key(batches, ["block"], ["u", "v", "w"])):
            ids, border, inner = _arrays(number, size, u, v, w)
            at = np.flatnonzero(border)
            dist = inner.ways(at, 0, len(ids))[:, at]
            # A way over a third border node, nearer to both ends than they are to each other, stands for itself.
            short = np.where(dist > 0, dist, FAR)
            keep = dist < FAR
            for k in range(len(at)):
                keep &= short[:, k, None] + short[None, k, :] > dist
            a, b = np.nonzero(keep & ~np.eye(len(at), dtype=bool))
            yield pa.RecordBatch.from_arrays([pa.array(ids[at[a]]), pa.array(ids[at[b]]), pa.array(dist[a, b])], names=["u", "v", "w"])

    def halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("u", "v", "w")] for batch in batches if batch.num_rows]
        if not parts:
            return
        u, v, w = (np.concatenate(x) for x in zip(*parts))
        ids = np.unique(np.r_[u, v])
        of = ids // size
        g = Arcs.of(len(ids), np.searchsorted(ids, u), np.searchsorted(ids, v), w)
        closed, numbers, paths = np.zeros(len(ids), bool), [], []
        todo, made = [(0, len(ids), np.zeros((len(ids), 0), np.int64), [], [])], 0
        while todo:
            lo, hi, hubs, cells, ends = todo.pop()
            own = np.unique(of[lo:hi])
            if len(own) == 1:
                paths.append(os.path.join(folder, f"border-{own[0]}-{uuid.uuid4().hex}.npz"))
                numbers.append(own[0])
                _save(paths[-1], ids=ids[lo:hi], hubs=hubs, cells=np.array(cells, np.int64), ends=np.array(ends, np.int64))
                continue
            mid = int(np.searchsorted(of, own[len(own) // 2]))
            new = _split(g, lo, mid, hi, hubs, closed)
            hubs, cells, ends, made = np.hstack([hubs, new]), [*cells, made], [*ends, hubs.shape[1] + new.shape[1]], made + 1
            todo += [(lo, mid, hubs[: mid - lo].copy(), cells, ends), (mid, hi, hubs[mid - lo :].copy(), cells, ends)]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(numbers, np.int64)), pa.array(paths)], names=["block", "path"])

    between = by_block.mapInArrow(cliques, "u long, v long, w long").unionByName(arcs.where(cross))
    of_borders = {r["block"]: r["path"] for r in cut(between).repartition(1).mapInArrow(halved, "block long, path string").collect()}

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (number,), (u, v, w) in _merged(_by_key(batches, ["block"], ["u", "v", "w"])):
            ids, border, inner = _arrays(number, size, u, v, w)
            hubs, cells, ends = np.zeros((len(ids), 0), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            if number in of_borders:
                with np.load(of_borders[number]) as f:
                    known, cells, ends = f["hubs"].astype(np.int64), f["cells"], f["ends"]
                known[known < 0] = FAR
                dist = inner.ways(np.flatnonzero(border), 0, len(ids))
                hubs = np.full((len(ids), known.shape[1]), FAR)
                for way, own in zip(dist, known):
                    np.minimum(hubs, way[:, None] + own[None, :], out=hubs)
            path = os.path.join(folder, f"block-{number}-{uuid.uuid4().hex}.npz")
            _save(path, ids=ids, border=border, start=inner.start, end=inner.end, weight=inner.weight, hubs=hubs, cells=cells, ends=ends)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([path])], names=["block", "path"])

    return {r["block"]: r["path"] for r in by_block.mapInArrow(files, "block long, path string").collect()}


def reachable(graph: Graph, size: int | None = None) -> bool:
    """Whether distances can be had this way; prepares them on first use."""
    if "hubs" not in graph._tables:
        graph._tables["hubs"] = (_block_files(graph, size or BLOCK), size or BLOCK)
    return graph._tables["hubs"][0] is not None


def distances(graph: Graph, listed: DataFrame) -> DataFrame:
    """shot, u, v, d of the rows of ``listed`` (shot, u, v, cap) with d <= cap. Asks for
    :func:`reachable` first."""
    files, size = graph._tables["hubs"]
    shared = graph.spark.sparkContext.broadcast(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Block] = {}

        def block(number: int) -> _Block | None:
            if number not in held:
                if number not in shared.value:
                    return None
                if len(held) >= _HELD:
                    held.pop(next(iter(held)))
                held[number] = _Block(shared.value[number])
            return held[number]

        for (x, y), (shot, u, v, cap) in _merged(_by_key(batches, ["x", "y"], ["shot", "u", "v", "cap"]), _ROWS):
            a, b = block(x), block(y)
            if a is None or b is None:
                continue
            pu, pv = a.position(u), b.position(v)
            inside = (pu >= 0) & (pv >= 0)
            shot, u, v, cap, pu, pv = shot[inside], u[inside], v[inside], cap[inside], pu[inside], pv[inside]
            d = _inside(a, pu, pv) if x == y else _over_hubs(a.hubs, b.hubs, pu, pv, a.common(b))
            ok = (d <= cap) & (d < FAR)
            yield pa.RecordBatch.from_arrays([pa.array(c[ok]) for c in (shot, u, v, d)], names=["shot", "u", "v", "d"])

    rows = listed.select(_home("u", size).alias("x"), _home("v", size).alias("y"), "shot", "u", "v", F.col("cap").cast("long").alias("cap"))
    return spread(rows, "x", "y").sortWithinPartitions("x", "y").mapInArrow(run, "shot long, u long, v long, d long")
