import heapq
import random

import pytest
from pyspark.sql import functions as F
from test_decode import as_hits
from test_graph import as_table

from pairloom.operators import adaptive as A
from pairloom.operators import clusters as C
from pairloom.operators import overlay, pairs, paths
from pairloom.operators.landmarks import component_spans
from pairloom.operators.matching import rim_of
from pairloom.operators.paths import Graph, pair_distances
from pairloom.operators.regions import meetings_to_the_end


def strip(seed, width, rows, gaps=0.0, heaviest=6, jumps=0.01):
    """A lattice with gaps and some long edges; weights from 0 on, from 2 on where ``heaviest`` is odd."""
    rnd = random.Random(seed)
    ids = [i for i in range(width * rows) if rnd.random() >= gaps]
    have, out = set(ids), []
    for i in ids:
        if i % width < width - 1 and i + 1 in have:
            out.append((i, i + 1, 2 * rnd.randint(min(1, heaviest % 2), heaviest)))
        if i + width in have:
            out.append((i, i + width, 2 * rnd.randint(min(1, heaviest % 2), heaviest)))
        j = rnd.choice(ids)
        if rnd.random() < jumps and 0 < abs(i - j) < 20 * width:
            out.append((min(i, j), max(i, j), 2 * rnd.randint(5, 30)))
        if i % width == 0:
            out.append((i, None, 4))
    return ids, out


def reach(rows, source):
    around = {}
    for u, v, w in rows:
        if v is not None:
            around.setdefault(u, []).append((v, w))
            around.setdefault(v, []).append((u, w))
    d, todo = {source: 0}, [(0, source)]
    while todo:
        x, u = heapq.heappop(todo)
        for v, w in around.get(u, ()) if x == d[u] else ():
            if x + w < d.get(v, 1 << 60):
                d[v] = x + w
                heapq.heappush(todo, (x + w, v))
    return d


@pytest.mark.parametrize("width, rows, size, gaps", [(5, 60, 32, 0.0), (5, 60, 32, 0.15), (4, 90, 512, 0.3)])
def test_distances_over_hubs_are_exact(spark, width, rows, size, gaps):
    ids, edges = strip(width + rows + size, width, rows, gaps)
    graph = Graph(as_table(spark, edges).where("w IS NOT NULL"), broadcast_edges=0)
    assert overlay.reachable(graph, size)
    rnd = random.Random(1)
    asked = [(k, u, rnd.choice(ids), 40 + 100 * (k % 3)) for k, u in enumerate(rnd.sample(ids, 40)) for _ in range(20)]
    asked = {(k, u, v): cap for k, u, v, cap in asked if u != v}
    listed = spark.createDataFrame([(*key, cap) for key, cap in asked.items()], "shot long, u long, v long, cap long")
    got = {(r.shot, r.u, r.v): r.d for r in overlay.distances(graph, listed).collect()}
    want = {}
    for (k, u, v), cap in asked.items():
        d = reach(edges, u).get(v)
        if d is not None and d <= cap:
            want[k, u, v] = d
    assert got == want and len(want) > 20


def test_far_distances_and_spans_of_a_table_take_no_round_for_each_hop(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("grown by joins")

    ids, edges = strip(3, 3, 150, heaviest=1, jumps=0)
    flat, table = (Graph(as_table(spark, edges), broadcast_edges=limit) for limit in (10_000, 0))
    monkeypatch.setattr(paths, "_balls_by_join", refused)
    assert overlay.reachable(table, 64)
    assert table.flat is None and component_spans(table).collect() == component_spans(flat).collect()
    asked = spark.createDataFrame([(u, v, 10**6) for u in ids[::50] for v in ids[::37] if u <= v], "u long, v long, cap long")
    got = {(r.u, r.v): r.d for r in pair_distances(table, asked, masks=False).collect()}
    assert got == {(r.u, r.v): r.d for r in pair_distances(flat, asked).collect()} and got
    shots = {s: random.Random(s).sample(ids, 5) for s in range(12)}
    for b in (100, 400):
        found = [{tuple(r) for r in C.threshold_components(as_hits(spark, shots), g, b).collect()} for g in (flat, table)]
        assert found[0] == found[1]


@pytest.mark.parametrize("limit", [10_000, 0], ids=["broadcast", "table"])
def test_whole_shots_give_the_same_clusters_as_level_by_level(spark, monkeypatch, limit):
    ids, edges = strip(7, 4, 60, 0.1, heaviest=2)
    graph = Graph(as_table(spark, edges), broadcast_edges=limit)
    assert overlay.reachable(graph, 64)
    shots = {s: random.Random(s).sample(ids, 1 + s % 9) for s in range(40)}
    hits = as_hits(spark, shots)
    for levels, options in (
        ([C.Level(3, 8), C.Level(12, 40)], {}),
        ([C.Level(3, 8), C.Level(12, 300)], {"forced_top": True}),
        ([C.Level(4, 12), C.Level(20, 60)], {"size_caps": [2, 3]}),
        ([C.Level(3, 8)], {"residual_root": False}),
    ):
        got = sorted(map(str, C.cluster_levels(hits, graph, levels, **options).collect()))
        steps = dict(forced_top=False, size_caps=None, residual_root=True) | options
        want = C._level_by_level(rim_of(hits, graph), graph, levels, **steps)
        assert got == sorted(map(str, want.collect())) and got


def test_whole_shots_give_the_same_steps_and_lives_as_growth(spark, monkeypatch):
    ids, edges = strip(11, 4, 60, 0.1, heaviest=3)
    shots = {s: random.Random(s).sample(ids, 2 + s % 8) for s in range(40)}
    hits, found = as_hits(spark, shots), []
    for limit in (pairs.SMALL_SHOT, 0):
        graph = Graph(as_table(spark, edges))
        if not limit:
            monkeypatch.setattr(overlay, "reachable", lambda *_: False)
        rooted = C.threshold_components(hits, graph, 10)
        ends = {tuple(r) for r in C.first_external(rooted, meetings_to_the_end(rooted, graph)).collect()}
        lives = sorted(map(str, A.lasting_clusters(hits, rim_of(hits, graph), graph).collect()))
        found.append((ends, lives))
    assert found[0] == found[1] and found[0][1]


def test_sources_of_balls_are_spread_over_tasks(spark):
    """Grouped by the key that they are spread by, they were folded into one task."""
    ids, edges = strip(5, 4, 60)
    graph = Graph(as_table(spark, edges))
    reach = paths.balls(graph, graph.nodes().select(F.col("id").alias("src"), F.lit(4).alias("radius")))
    assert reach.select(F.spark_partition_id()).distinct().count() > 1
