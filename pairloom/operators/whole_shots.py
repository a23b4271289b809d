"""Shots of ordinary size, each one row of work, given the distances between their hits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairloom.session import spread

_ROW = "struct<u:long,v:long,d:long>"


def _rows(*tables: DataFrame) -> DataFrame:
    """(shot, rows) of all rows (shot, u, v, d) of a shot; a row without v is a hit, d its boundary distance."""
    rows = tables[0].select("shot", F.struct("u", "v", "d").cast(_ROW).alias("row"))
    for more in tables[1:]:
        rows = rows.unionByName(more.select("shot", F.struct("u", "v", "d").cast(_ROW).alias("row")))
    return spread(rows.where("shot IS NOT NULL"), "shot").groupBy("shot").agg(F.collect_list("row").alias("rows"))


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Row of the batch, u, v, d and whether there is a v, for every row of the lists."""
    lists = batch.column("rows")
    flat = lists.flatten()
    at = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
    v = flat.field("v")
    inner = v.is_valid().to_numpy(zero_copy_only=False)
    u, v, d = (x.to_numpy(zero_copy_only=False) for x in (flat.field("u"), v.fill_null(0), flat.field("d")))
    return at, u, v, d, inner


def _chain(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position that each of n positions is linked to."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all():
            return root


def spanning_steps(pairs: DataFrame) -> DataFrame:
    """shot, u, v, d: the pairs of a least spanning tree of each shot (of several, where
    pairs do not chain all its hits). ``pairs``: shot, u, v, d with u < v. Whatever the
    bound, they chain as all pairs do, and the nearest hit outside a group is the end of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at, u, v, d, _ = _columns(batch)
            order = np.lexsort((v, u, d, at))
            at, u, v, d = at[order], u[order], v[order], d[order]
            ids, spot = np.unique(np.r_[u, v], return_inverse=True)
            _, node = np.unique(np.r_[at, at] * len(ids) + spot, return_inverse=True)
            a, b = node[: len(u)], node[len(u) :]
            n, part = node.max() + 1, np.arange(node.max() + 1)
            left, taken = np.arange(len(u)), []
            while True:
                x, y = part[a[left]], part[b[left]]
                left, x, y = left[x != y], x[x != y], y[x != y]
                if not len(left):
                    break
                # Pairs are in order, so the first of a part is its lightest.
                best = np.full(n, len(u))
                np.minimum.at(best, x, left)
                np.minimum.at(best, y, left)
                first = np.unique(best[best < len(u)])
                taken.append(first)
                part = _chain(n, part[a[first]], part[b[first]])[part]
            if taken:
                pick = np.concatenate(taken)
                yield pa.RecordBatch.from_arrays([batch.column("shot").take(pa.array(at[pick])), pa.array(u[pick]), pa.array(v[pick]), pa.array(d[pick])], names=["shot", "u", "v", "d"])

    return _rows(pairs).mapInArrow(run, "shot long, u long, v long, d long")


def levels_of_shots(
    rim: DataFrame, pairs: DataFrame, levels: Sequence[tuple[int, int]], size_caps: Sequence[int] | None, forced_top: bool, residual_root: bool
) -> DataFrame:
    """shot, level, root, det, size, diameter, forced of
    :func:`pairloom.operators.clusters.cluster_levels` for ``rim`` (shot, det, rim, each
    hit once), ``pairs`` (shot, u, v, d up to the largest bound) and ``levels`` (d, b)."""
    levels, caps = list(levels), list(size_caps) if size_caps else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at, u, v, d, inner = _columns(batch)
            ids = np.unique(u[~inner])
            order = np.lexsort((u[~inner], at[~inner]))
            shot, det, rim_of = (x[~inner][order] for x in (at, u, d))
            key = shot * len(ids) + np.searchsorted(ids, det)
            a, b = (np.searchsorted(key, at[inner] * len(ids) + np.searchsorted(ids, x[inner])) for x in (u, v))
            d, n = d[inner], len(det)
            level, root = np.zeros(n, np.int64), np.zeros(n, np.int64)
            size, diameter, forced = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n, bool)
            alive = np.ones(n, bool)
            for number, (widest, bound) in enumerate(levels, start=1):
                both = alive[a] & alive[b]
                link = both & (d <= bound)
                group = _chain(n, a[link], b[link])
                count = np.bincount(group[alive], minlength=n)
                accepted = np.ones(n, bool)
                far = np.zeros(n, np.int64)
                if forced_top and number == len(levels):
                    far[:] = -1
                else:
                    rims = np.zeros(n, np.int64)
                    np.maximum.at(rims, group[alive], rim_of[alive])
                    near = both & (d <= widest) & (group[a] == group[b])
                    np.maximum.at(far, group[a[near]], d[near])
                    # A group whose pairs are all near is as wide as the farthest of them.
                    accepted = np.bincount(group[a[near]], minlength=n) == count * (count - 1) // 2
                    accepted &= (count % 2 == 0) | (rims <= widest)
                    if caps and caps[number - 1]:
                        accepted &= count <= caps[number - 1]
                taken = alive & accepted[group]
                level[taken], root[taken], size[taken] = number, det[group[taken]], count[group[taken]]
                diameter[taken], forced[taken] = far[group[taken]], forced_top and number == len(levels)
                alive &= ~taken
                if not alive.any():
                    break
            if alive.any() and residual_root:
                highest = np.zeros(batch.num_rows, np.int64)
                np.maximum.at(highest, shot, level)
                # Hits are in order, so the first one left of a shot is the smallest.
                own, first, count = np.unique(shot[alive], return_index=True, return_counts=True)
                which = np.searchsorted(own, shot[alive])
                level[alive], root[alive] = highest[shot[alive]] + 1, det[alive][first][which]
                size[alive], forced[alive], diameter[alive] = count[which], True, -1
                alive[:] = False
            keep = ~alive
            values = [batch.column("shot").take(pa.array(shot[keep])), pa.array(level[keep].astype(np.int32)), *[pa.array(x[keep]) for x in (root, det, size)]]
            values += [pa.array(diameter[keep], mask=diameter[keep] < 0), pa.array(forced[keep])]
            yield pa.RecordBatch.from_arrays(values, names=["shot", "level", "root", "det", "size", "diameter", "forced"])

    none = F.lit(None).cast("long").alias("v")
    rows = _rows(rim.select("shot", F.col("det").alias("u"), none, F.col("rim").alias("d")), pairs)
    return rows.mapInArrow(run, "shot long, level int, root long, det long, size long, diameter long, forced boolean")


def groups_of_shots(rim: DataFrame, pairs: DataFrame) -> DataFrame:
    """shot, root, size, stop, diameter, far_rim, near_rim: every group that some bound on
    the steps chains in a shot, where all its inner pairs are nearer than ``stop``, the
    step to its nearest hit outside (NULL: none). ``rim``: shot, det, rim, each hit once;
    ``pairs``: shot, u, v, d, all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at, u, v, d, inner = _columns(batch)
            hits, links = ~inner, inner
            order = np.lexsort((v[links], u[links], d[links], at[links]))
            first = np.lexsort((u[hits], at[hits]))
            each = np.arange(batch.num_rows + 1)
            link_cuts = np.searchsorted(at[links][order], each).tolist()
            hit_cuts = np.searchsorted(at[hits][first], each).tolist()
            us, vs, ds = (x[links][order].tolist() for x in (u, v, d))
            dets, rims = u[hits][first].tolist(), d[hits][first].tolist()
            out: list[tuple] = []
            for k in range(batch.num_rows):
                own = range(hit_cuts[k], hit_cuts[k + 1])
                # size, inner pairs seen, widest of them, farthest and nearest boundary distance, members
                group = {dets[i]: [1, 0, 0, rims[i], rims[i], [dets[i]]] for i in own}
                root = {dets[i]: dets[i] for i in own}
                for j in range(link_cuts[k], link_cuts[k + 1]):
                    x, y, way = root[us[j]], root[vs[j]], ds[j]
                    if x == y:
                        same = group[x]
                        same[1], same[2] = same[1] + 1, way
                        continue
                    for z in (x, y):
                        n, seen, widest, far, near, _ = group[z]
                        if seen == n * (n - 1) // 2:
                            out.append((k, z, n, way, widest, far, near))
                    low, high = (x, y) if x < y else (y, x)
                    a, b = group[low], group.pop(high)
                    group[low] = [a[0] + b[0], a[1] + b[1] + 1, way, max(a[3], b[3]), min(a[4], b[4]), a[5] + b[5]]
                    for det in b[5]:
                        root[det] = low
                for z, (n, seen, widest, far, near, _) in group.items():
                    if seen == n * (n - 1) // 2:
                        out.append((k, z, n, None, widest, far, near))
            columns = [pa.array(x, type=pa.int64()) for x in zip(*out)] if out else [pa.array([], type=pa.int64())] * 7
            yield pa.RecordBatch.from_arrays([batch.column("shot").take(columns[0]), *columns[1:]], names=["shot", "root", "size", "stop", "diameter", "far_rim", "near_rim"])

    none = F.lit(None).cast("long").alias("v")
    rows = _rows(rim.select("shot", F.col("det").alias("u"), none, F.col("rim").alias("d")), pairs)
    return rows.mapInArrow(run, "shot long, root long, size long, stop long, diameter long, far_rim long, near_rim long")
