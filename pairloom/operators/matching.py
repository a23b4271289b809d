"""Minimum-weight pairing of every shot, as Spark jobs.

A shot is first split into groups that provably cannot influence each other;
each group is one row that one small kernel call pairs up; results are summed
per shot. No shot is gathered as a whole: an ordinary shot is split by distance,
and an enormous one grows its groups from single hits, merging only those whose
regions really meet (see :func:`_grown_groups`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairloom.operators.components import components, label
from pairloom.operators.pairing import FAR, RIM, pair_up
from pairloom.operators.pairs import SMALL_SHOT, by_size, listed_pairs
from pairloom.operators.paths import Graph, balls, boundary_distances
from pairloom.session import cut, spread

DONE, OPEN, UNMATCHED = 0, 1, 2
_REACH_CAP = float(2**60)

_RESULT = (
    "shot long, root long, status int, n_hits int, weight long, obs_mask long, stop_time long, "
    "event_times array<long>, ring_events int, mu array<long>, mv array<long>, md array<long>, dets array<long>, "
    "most array<long>"
)
_ROW = "struct<u:long,v:long,d:long,m:long>"


def rim_of(hits: DataFrame, graph: Graph) -> DataFrame:
    """Hits with their boundary distance: shot, det, rim, rim_mask (FAR when there is no boundary)."""
    rim = boundary_distances(graph).select(
        F.col("node").alias("det"), F.coalesce("d", F.lit(FAR)).alias("rim"), F.coalesce("mask", F.lit(0)).alias("rim_mask")
    )
    return hits.select("shot", "det").join(rim, "det").select("shot", "det", "rim", "rim_mask")


def _roots(at: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position and smallest hit of the component each row belongs to."""
    inner = v != RIM
    group, node, root = label(np.r_[at, at[inner]], np.r_[u, u[inner]], np.r_[u, v[inner]])
    spot = np.searchsorted(_key(group, node, node), _key(at, u, node))
    return group[spot], root[spot]


def _key(group: np.ndarray, node: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    ids = np.unique(nodes)
    return group * len(ids) + np.searchsorted(ids, node)


def _solve(groups: DataFrame, horizon: int | None = None, split: bool = False) -> DataFrame:
    """Rows (shot, root, rows) in, one row of ``_RESULT`` out per group.

    With ``split`` an input row is a whole shot of ordinary size and falls into
    its independent groups here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("rows")
            flat = lists.flatten()
            offsets = lists.offsets.to_numpy()
            at = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            u = flat.field("u").to_numpy(zero_copy_only=False)
            v = flat.field("v").fill_null(RIM).to_numpy(zero_copy_only=False)
            d = flat.field("d").to_numpy(zero_copy_only=False)
            m = flat.field("m").to_numpy(zero_copy_only=False)
            if split:
                # Links of one row fall into independent groups; hits without a link are their own.
                _, root = _roots(at, u, v)
            else:
                root = at
            order = np.lexsort((u, v != RIM, root, at))
            at, root, u, v, d, m = at[order], root[order], u[order], v[order], d[order], m[order]
            cuts = np.flatnonzero((np.diff(at) != 0) | (np.diff(root) != 0)) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(at)]
            one, two = _plain_groups(starts, ends, u, v, d, horizon)
            rest = ~(one | two)
            out = [_one_group(u[a:b], v[a:b], d[a:b], m[a:b], horizon) for a, b in zip(starts[rest], ends[rest])]
            found = [
                (starts[one], _single_hits(starts[one], u, d, m)),
                (starts[two], _single_pairs(starts[two], u, d, m)),
                (starts[rest], [pa.array([row[k] for row in out], type=kind) for k, kind in enumerate(_KINDS)]),
            ]
            for first, columns in found:
                if len(first):
                    shots = batch.column("shot").take(pa.array(at[first]))
                    roots = pa.array(root[first]) if split else batch.column("root").take(pa.array(at[first]))
                    yield pa.RecordBatch.from_arrays([shots, roots, *columns], names=_NAMES)

    return groups.mapInArrow(run, _RESULT)


_NAMES = [part.strip().split(" ")[0] for part in _RESULT.split(", ")]
_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32()] + [pa.list_(pa.int64())] * 5


def _plain_groups(starts, ends, u, v, d, horizon) -> tuple[np.ndarray, np.ndarray]:
    """Which groups are one hit that reaches the boundary, and which are two hits nearer to
    each other than over the boundary: most groups, whose pairing needs no search. Rows
    of a group are in order: boundary rows by hit, then pairs."""
    rows = ends - starts
    one = (rows == 1) & (v[starts] == RIM) & (d[starts] < FAR)
    if horizon is not None:
        return one & (d[starts] <= horizon), np.zeros(len(starts), bool)
    last = len(u) - 1
    second, third = np.minimum(starts + 1, last), np.minimum(starts + 2, last)
    two = (rows == 3) & (v[starts] == RIM) & (v[second] == RIM) & (u[third] == u[starts]) & (v[third] == u[second])
    # In floating point, since two hits without a boundary add up to more than a long.
    near = d[third] < d[starts].astype(float) + d[second].astype(float)
    return one, two & near & (d[third] % 2 == 0) & (d[third] < FAR)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=pa.int64()))


def _single_hits(at, u, d, m) -> list[pa.Array]:
    """Result columns of groups of one hit, which meets the boundary."""
    n, once = len(at), np.ones(len(at), np.int32)
    det, rim = _lists(u[at], once), _lists(d[at], once)
    done, none = pa.array(np.full(n, DONE, np.int32)), pa.array(np.zeros(n, np.int32))
    return [done, pa.array(once), pa.array(d[at]), pa.array(m[at]), pa.array(d[at]), rim, none, det, _lists(np.full(n, RIM), once), rim, det, rim]


def _single_pairs(at, u, d, m) -> list[pa.Array]:
    """Result columns of groups of two hits that pair up. Both grow until they meet; where
    one meets the boundary before, the other goes on and takes it back."""
    n, once = len(at), np.ones(len(at), np.int32)
    r, way = np.stack([d[at], d[at + 1]]), d[at + 2]
    early = r.min(axis=0)
    halted = early <= way // 2
    stop = np.where(halted, way - early, way // 2)
    times = np.stack([early, stop], axis=1)[np.stack([halted, np.ones(n, bool)], axis=1)]
    first = r[0] <= r[1]
    most = np.stack([np.where(halted & first, early, stop), np.where(halted & ~first, early, stop)], axis=1)
    dets = np.stack([u[at], u[at + 1]], axis=1)
    done, none = pa.array(np.full(n, DONE, np.int32)), pa.array(np.zeros(n, np.int32))
    return [
        done, pa.array(2 * once), pa.array(way), pa.array(m[at + 2]), pa.array(stop), _lists(times, 1 + halted), none,
        _lists(u[at], once), _lists(u[at + 1], once), _lists(way, once), _lists(dets.ravel(), 2 * once), _lists(most.ravel(), 2 * once),
    ]


def _one_group(u, v, d, m, horizon):
    """Split a group's rows into boundary rows (v = RIM) and pair rows, and pair it up."""
    at_rim = v == RIM
    order = np.argsort(u[at_rim])
    dets, rim, rim_mask = u[at_rim][order], d[at_rim][order], m[at_rim][order]
    if len(dets) == 1 and rim[0] < FAR and (horizon is None or rim[0] <= horizon):
        r = int(rim[0])
        return DONE, 1, r, int(rim_mask[0]), r, [r], 0, dets, [RIM], [r], dets, [r]
    i, j = np.searchsorted(dets, u[~at_rim]), np.searchsorted(dets, v[~at_rim])
    done, pairs, group = pair_up(rim, i, j, d[~at_rim], horizon)
    times = [t for t, _ in group.events]
    rings = sum(kind == "open" for _, kind in group.events)
    if not done:
        status = UNMATCHED if horizon is None else OPEN
        return status, len(dets), None, None, group.now, times, rings, [], [], [], dets, group.most
    by_pair = {(int(a), int(b)): (int(x), int(y)) for a, b, x, y in zip(i, j, d[~at_rim], m[~at_rim])}
    costs = [(int(rim[a]), int(rim_mask[a])) if b == RIM else by_pair[a, b] for a, b in pairs]
    mask = 0
    for _, flag in costs:
        mask ^= flag
    return (
        DONE, len(dets), sum(c for c, _ in costs), mask, times[-1] if times else 0, times, rings,
        [int(dets[a]) for a, _ in pairs], [int(dets[b]) if b != RIM else RIM for _, b in pairs],
        [c for c, _ in costs], dets, group.most,
    )


def _group_rows(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(shot, root, rows): a group's boundary rows and inner pairs, gathered in one shuffle."""
    rim_rows = members.select(
        "shot", "root",
        F.struct(F.col("det").alias("u"), F.lit(None).cast("long").alias("v"), F.col("rim").alias("d"), F.col("rim_mask").alias("m"))
        .cast(_ROW).alias("row"),
    )
    pair_rows = pairs.select("shot", "root", F.struct("u", "v", "d", F.col("mask").alias("m")).cast(_ROW).alias("row"))
    rows = spread(rim_rows.unionByName(pair_rows), "shot", "root")
    return rows.groupBy("shot", "root").agg(F.collect_list("row").alias("rows"))


def pair_groups(hits: DataFrame, graph: Graph, limit: int = SMALL_SHOT, first_horizon: int | None = None) -> DataFrame:
    """Independent groups of every shot with their optimal pairing (columns of ``_RESULT``)."""
    members = cut(rim_of(hits, graph))
    small, large = by_size(members, limit)
    if large is None:
        return _split_groups(small, graph)
    grown = _grown_groups(cut(large), graph, first_horizon)
    return grown if small is None else _split_groups(small, graph).unionByName(grown)


def _split_groups(members: DataFrame, graph: Graph) -> DataFrame:
    """Groups of shots of ordinary size.

    Two hits farther apart than their two boundary distances together never
    gain from each other, so the components of the remaining pairs can be
    paired up on their own; the sum is the optimum of the shot. A shot is of
    ordinary size here, so finding its components is work for one row.
    """
    pairs = listed_pairs(members.withColumn("rho", F.col("rim")), graph, strict=True)
    whole = F.col("shot").alias("root")
    return _solve(_group_rows(members.select("*", whole), pairs.select("*", whole)), split=True)


def _grown_groups(members: DataFrame, graph: Graph, first_horizon: int | None) -> DataFrame:
    """Groups of enormous shots, grown only as far as needed.

    Every group runs on its own up to a time horizon. If the regions of two
    groups overlap, they merge and run again; groups that are finished and touch
    nobody are final, because their regions together prove that the sum of
    their weights is the optimum. Groups still growing go on with a longer
    horizon. Each round only re-runs merged or unfinished groups.
    """
    if first_horizon is None:
        first_horizon = graph.edges.agg(F.max("w")).first()[0] or 1
    longest = members.where(F.col("rim") < FAR).agg(F.max("rim")).first()[0] or 0
    state = cut(members.select("*", F.col("det").alias("root"), F.lit(0).cast("long").alias("most"), F.lit("todo").alias("state")))
    horizon: int | None = first_horizon
    solved_rounds: list[DataFrame] = []
    while True:
        reach = F.lit(_REACH_CAP) if horizon is None else F.lit(float(horizon))
        rho = F.when(F.col("state") == "todo", F.least(F.col("rim").cast("double"), reach)).otherwise(F.col("most").cast("double"))
        links = cut(_links(state.withColumn("rho", rho), graph))
        inner = links.where("root_u = root_v AND todo_u AND todo_v").select("shot", F.col("root_u").alias("root"), "u", "v", "d", "mask")
        solved = cut(_solve(_group_rows(state.where("state = 'todo'"), inner), horizon))
        solved_rounds.append(solved.withColumn("turn", F.lit(len(solved_rounds))))
        grown = solved.select("shot", "status", F.explode(F.arrays_zip("dets", "most")).alias("x")).select(
            "shot", F.col("x.dets").alias("det"), F.col("x.most").alias("new_most"), "status"
        )
        state = cut(
            state.join(grown, ["shot", "det"], "left").select(
                "shot", "det", "rim", "rim_mask", "root",
                F.coalesce("new_most", "most").alias("most"),
                F.when(F.col("status") == OPEN, "open").when(F.col("status").isNotNull(), "done").otherwise(F.col("state")).alias("state"),
            )
        )
        cover_u = state.select("shot", F.col("det").alias("u"), F.col("most").alias("most_u"))
        cover_v = state.select("shot", F.col("det").alias("v"), F.col("most").alias("most_v"))
        clash = links.where("root_u <> root_v").join(cover_u, ["shot", "u"]).join(cover_v, ["shot", "v"]).where("most_u + most_v > d")
        clash = cut(clash.select("shot", F.col("root_u").alias("a"), F.col("root_v").alias("b")).distinct())
        if not clash.isEmpty():
            merges = components(clash, ["shot"]).select("shot", F.col("node").alias("root"), F.col("root").alias("new_root"))
            state = cut(
                state.join(merges, ["shot", "root"], "left").select(
                    "shot", "det", "rim", "rim_mask", F.coalesce("new_root", "root").alias("root"), "most",
                    F.when(F.col("new_root").isNotNull(), "todo").otherwise(F.col("state")).alias("state"),
                )
            )
            continue
        if horizon is None or state.where("state = 'open'").isEmpty():
            break
        horizon = None if horizon > longest else horizon * 4
        state = cut(state.withColumn("state", F.when(F.col("state") == "open", "todo").otherwise(F.col("state"))))
    # The latest run of every group that still exists; groups that merged are gone.
    runs = solved_rounds[0]
    for later in solved_rounds[1:]:
        runs = runs.unionByName(later)
    final = state.groupBy("shot", "root").agg(F.count("*").alias("members"))
    latest = runs.groupBy("shot", "root").agg(F.max("turn").alias("turn")).join(final, ["shot", "root"], "left_semi")
    return runs.join(latest, ["shot", "root", "turn"], "left_semi").select(*_NAMES)


def _links(everyone: DataFrame, graph: Graph) -> DataFrame:
    """Overlapping hit pairs of a shot of which at least one still has work to do."""
    tagged = everyone.select("shot", "det", "root", "rho", (F.col("state") == "todo").alias("todo"))
    widest = tagged.groupBy("shot").agg(F.max("rho").alias("widest"))
    centres = tagged.where("todo").join(widest, "shot").select(
        "shot", F.col("det").alias("src"), F.col("root").alias("root_a"), F.col("rho").alias("rho_a"),
        F.floor(F.least(F.col("rho") + F.col("widest"), F.lit(_REACH_CAP))).cast("long").alias("radius"),
    )
    found = centres.join(balls(graph, centres.select("src", "radius")), "src").where("d <= radius")
    other = tagged.select("shot", F.col("det").alias("node"), F.col("root").alias("root_b"), F.col("rho").alias("rho_b"), F.col("todo").alias("todo_b"))
    pairs = found.join(other, ["shot", "node"]).where("d < rho_a + rho_b AND (src < node OR (NOT todo_b AND src <> node))")
    low = F.col("src") < F.col("node")
    return pairs.select(
        "shot", F.least("src", "node").alias("u"), F.greatest("src", "node").alias("v"), "d", "mask",
        F.when(low, F.col("root_a")).otherwise(F.col("root_b")).alias("root_u"),
        F.when(low, F.col("root_b")).otherwise(F.col("root_a")).alias("root_v"),
        F.when(low, F.lit(True)).otherwise(F.col("todo_b")).alias("todo_u"),
        F.when(low, F.col("todo_b")).otherwise(F.lit(True)).alias("todo_v"),
    )


# Results -------------------------------------------------------------------


def per_shot(groups: DataFrame) -> DataFrame:
    """shot, n_hits, weight, obs_mask, event_count, stop_time, status of each shot."""
    return groups.groupBy("shot").agg(
        F.sum("n_hits").alias("n_hits"),
        F.sum("weight").alias("weight"),
        F.bit_xor("obs_mask").alias("obs_mask"),
        F.sum(F.size("event_times").cast("long")).alias("event_count"),
        F.max("stop_time").alias("stop_time"),
        F.when(F.max("status") == DONE, "ok").otherwise("no perfect matching").alias("status"),
    )


def pair_clusters(members: DataFrame, graph: Graph, limit: int = SMALL_SHOT) -> tuple[DataFrame, DataFrame]:
    """Every cluster of a given table (shot, level, root, det) paired up on its own.

    Result: the clusters (key, shot, level, root, size) and their groups, in which the
    key stands for the shot. Keys are places in a written table, so no two clusters can
    share one.
    """
    heads = cut(members.groupBy("shot", "level", "root").agg(F.count("*").alias("size")))
    heads = cut(heads.withColumn("key", F.monotonically_increasing_id()))
    same = F.col("m.shot").eqNullSafe(F.col("h.shot")) & F.col("m.level").eqNullSafe(F.col("h.level")) & F.col("m.root").eqNullSafe(F.col("h.root"))
    keyed = members.alias("m").join(heads.alias("h"), same).select(F.col("h.key").alias("shot"), F.col("m.det").alias("det"))
    return heads, pair_groups(cut(keyed.where("det IS NOT NULL")), graph, limit)


def matches(groups: DataFrame) -> DataFrame:
    """shot, u, v (NULL = boundary), d of every matched pair."""
    rows = groups.select("shot", F.explode(F.arrays_zip("mu", "mv", "md")).alias("x"))
    return rows.select(
        "shot", F.col("x.mu").alias("u"), F.when(F.col("x.mv") != RIM, F.col("x.mv")).alias("v"), F.col("x.md").alias("d")
    )


def events(groups: DataFrame) -> DataFrame:
    """shot, root, t: one row per matching event."""
    return groups.select("shot", "root", F.explode("event_times").alias("t"))
