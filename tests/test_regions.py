import random

import pytest
from brute import FAR, distances
from test_decode import as_hits, many_shots
from test_graph import as_table, random_edges

from pairloom.operators import adaptive as A
from pairloom.operators import clusters as C
from pairloom.operators import hierarchy as H
from pairloom.operators.matching import rim_of
from pairloom.operators.paths import Graph
from pairloom.operators.regions import meetings, meetings_to_the_end, owned

BOTH = pytest.mark.parametrize("limit", [10_000, 0], ids=["broadcast", "joins"])


def setup(spark, seed, limit, n=18, m=26, count=14):
    rows = random_edges(seed, n=n, m=m)
    nodes = sorted({x for u, v, _ in rows for x in (u, v) if x is not None})
    d, rim = distances(rows, nodes)
    shots = many_shots(nodes, count, seed)
    return rows, nodes, d, rim, shots, Graph(as_table(spark, rows), broadcast_edges=limit)


def chained(hits, d, b):
    """Smallest member of each hit's group."""
    root = {h: h for h in hits}
    changed = True
    while changed:
        changed = False
        for x in hits:
            for y in hits:
                if d[x, y] <= b and root[y] < root[x]:
                    root[x], changed = root[y], True
    return root


@BOTH
def test_regions_belong_to_the_nearest_hit(spark, limit):
    rows, nodes, d, _, shots, graph = setup(spark, 41, limit)
    got = {(r.shot, r.node): (r.d, r.owner) for r in owned(as_hits(spark, shots), graph, 9).collect()}
    want = {}
    for s, hits in shots.items():
        for x in nodes:
            near = min((d[h, x], h) for h in hits)
            if near[0] <= 9:
                want[s, x] = near
    assert got == want


@BOTH
def test_touching_regions_chain_like_all_pairs(spark, limit):
    _, _, d, _, shots, graph = setup(spark, 42, limit)
    for b in (2, 7, 12, 40) if limit else (8,):
        pairs = {}
        for r in meetings(as_hits(spark, shots), graph, b).collect():
            assert d[r.u, r.v] <= r.d <= b and r.u < r.v
            pairs.setdefault(r.shot, []).append((r.u, r.v))
        for s, hits in shots.items():
            ways = {(x, y): 0 if x == y or (x, y) in pairs.get(s, []) or (y, x) in pairs.get(s, []) else FAR for x in hits for y in hits}
            assert chained(hits, ways, 0) == chained(hits, d, b)


@BOTH
def test_regions_grow_until_all_hits_have_met(spark, limit):
    _, _, d, _, shots, graph = setup(spark, 43, limit, m=17)  # several graph components
    rooted = C.threshold_components(as_hits(spark, shots), graph, 6)
    got = {(r.shot, r.root): r.external for r in C.first_external(rooted, meetings_to_the_end(rooted, graph, first=2)).collect()}
    want = {}
    for s, hits in shots.items():
        root = chained(hits, d, 6)
        for r in set(root.values()):
            out = min((d[x, y] for x in hits for y in hits if root[x] == r != root[y]), default=FAR)
            if out < FAR:
                want[s, r] = out // 2
    assert got == want


def plain_short_pairs(left, hits, d, farthest, diameter, guard, mutual):
    near = {x: min((d[x, y] for y in left if y != x and d[x, y] <= max(farthest, guard)), default=FAR) for x in left}
    pairs = sorted((d[x, y], x, y) for x in left for y in left if x < y and d[x, y] <= min(farthest, diameter))
    used, taken = set(), []
    for w, x, y in pairs:
        if {x, y} & used or mutual and not near[x] == near[y] == w:
            continue
        if guard and any(min(d[x, o], d[y, o]) <= guard for o in hits if o not in (x, y)):
            continue
        used |= {x, y}
        taken.append((x, y, w))
    return taken


@pytest.mark.parametrize("farthest, diameter, guard, mutual", [(8, 20, None, True), (12, 9, 0, False), (20, 20, 4, False), (14, 20, 2, True)])
def test_short_pairs_follow_the_order(spark, farthest, diameter, guard, mutual):
    _, _, d, _, shots, graph = setup(spark, 44, 10_000, n=24, m=34)
    left = {s: hits[: 1 + len(hits) * 3 // 4] for s, hits in shots.items()}
    got = C.accept_short_pairs(as_hits(spark, left), as_hits(spark, shots), graph, farthest, diameter, guard, mutual)
    want = {(s, *p) for s in shots for p in plain_short_pairs(left[s], shots[s], d, farthest, diameter, farthest if guard is None else guard, mutual)}
    assert {tuple(r) for r in got.collect()} == want


def plain_breakpoints(hits, d, rim, previous, phi):
    tries = {previous.b, previous.b + 1}
    need = lambda x: max(-int(-(1 + 2 * (x + 1) / phi) // 1), 2)
    for x in hits:
        tries |= {rim[x], need(rim[x])} if rim[x] < FAR else set()
        for y in hits:
            if x < y and d[x, y] < FAR:
                tries |= {d[x, y], d[x, y] - 1, need(d[x, y])}
    best = None
    for b in sorted(t for t in tries if t >= previous.b):
        most = int((phi / 2 * (b - 1) - 1 + 1e-12) // 1)
        if most < previous.d or most <= 0:
            continue
        root = chained(hits, d, b)
        groups = [[h for h in hits if root[h] == r] for r in set(root.values())]
        told = []
        for g in groups:
            wide = max(d[x, y] for x in g for y in g)
            far, near = (max(rim[x] for x in g), min(rim[x] for x in g)) if len(g) % 2 else (0, 0)
            told.append((len(g), max(wide, far), max(wide, near)))
        asked = max([previous.d, *(near for _, far, near in told if far <= most)])
        if not any(far <= most for _, far, _ in told):
            continue
        kept = [n for n, far, _ in told if far <= asked]
        if kept:
            score = (-len(kept), -sum(kept), len(hits) - sum(kept), asked, b)
            best = score if best is None else min(best, score)
    return best


@pytest.mark.parametrize("phi", [1.0, 0.4])
def test_breakpoints_against_all_bounds(spark, phi):
    _, _, d, rim, shots, graph = setup(spark, 45, 10_000, n=40, m=50, count=40)
    hits = as_hits(spark, shots)
    previous = C.Level(2, 8)
    got = {r.shot: (-r.clusters, -r.active, r.residual, r.d, r.b) for r in A.breakpoint_bounds(hits, rim_of(hits, graph), graph, previous, phi).collect()}
    want = {s: plain_breakpoints(h, d, rim, previous, phi) for s, h in shots.items()}
    assert got == {s: x for s, x in want.items() if x}


def test_parents_cover_what_lies_below(spark):
    # 1 -> 2 -> 3 -> 4 on nodes that overlap by one; shot 2 has one cluster of the whole graph on level 2
    chain = [(1, level, level * 10, level * 5 + i) for level in range(1, 9) for i in range(6)]
    sole = [(2, 1, 1, 3), (2, 1, 7, 70), (2, 3, 5, 3)]
    regions = spark.createDataFrame(chain + sole, "shot long, level int, root long, node long")
    full = spark.createDataFrame([(2, 2, 4)], "shot long, level int, root long")
    found = H.parents(regions, full)
    ups = {(r.shot, r.level, r.root): (r.parent_level, r.parent_root) for r in found.collect()}
    assert ups == {**{(1, k, k * 10): (k + 1, k * 10 + 10) for k in range(1, 8)}, (2, 1, 1): (2, 4), (2, 1, 7): (2, 4)}
    ways = {(r.shot, r.level, r.up_level) for r in H.ancestors(found).collect()}
    assert ways == {(1, a, b) for a in range(1, 9) for b in range(a + 1, 9)} | {(2, 1, 2)}
    wide, whole = H.cover_descendants(regions, found, 41, full)
    nodes = {}
    for r in wide.collect():
        nodes.setdefault((r.shot, r.level), set()).add(r.node)
    assert all(nodes[1, k] == set(range(5, k * 5 + 6)) for k in range(1, 8))
    assert {tuple(r) for r in whole.collect()} == {(1, 8, 80), (2, 2, 4)}


def test_parents_with_several_whole_graphs(spark):
    regions = spark.createDataFrame([(1, 1, 1, 3), (1, 3, 9, 50)], "shot long, level int, root long, node long")
    full = spark.createDataFrame([(1, 2, 4), (1, 4, 8)], "shot long, level int, root long")
    ups = {(r.level, r.root): (r.parent_level, r.parent_root) for r in H.parents(regions, full).collect()}
    assert ups == {(1, 1): (2, 4), (2, 4): (3, 9), (3, 9): (4, 8)}
