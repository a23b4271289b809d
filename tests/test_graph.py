import random

import pytest
from brute import FAR, distances
from pyspark.sql import functions as F

from pairloom.operators import edges as E
from pairloom.operators.components import components
from pairloom.operators.landmarks import component_spans, graph_components
from pairloom.operators.paths import Graph, balls, boundary_distances, pair_distances, shortest_paths

USER = "u long, v long, w double, p double, obs array<int>, ord long"
DISCRETE = "u long, v long, w long, sign int, obs_mask long"


def random_edges(seed, n=14, m=22):
    rng = random.Random(seed)
    found = {}
    for _ in range(m):
        u, v = sorted(rng.sample(range(n), 2))
        found[u, v] = 2 * rng.randint(1, 6)
    rims = {u: 2 * rng.randint(2, 9) for u in rng.sample(range(n), 3)}
    return [(u, v, w) for (u, v), w in found.items()] + [(u, None, w) for u, w in rims.items()]


def as_table(spark, rows):
    return spark.createDataFrame([(u, v, w, 1, 1 if v is None else 0) for u, v, w in rows], DISCRETE)


@pytest.mark.parametrize("limit", [10_000, 0], ids=["broadcast", "joins"])
def test_paths_both_ways(spark, limit):
    rows = random_edges(3)
    nodes = sorted({x for u, v, _ in rows for x in (u, v) if x is not None})
    d, rim = distances(rows, nodes)
    graph = Graph(as_table(spark, rows), broadcast_edges=limit)
    assert (graph.flat is None) == (limit == 0)
    reach = balls(graph, spark.createDataFrame([(n, 14) for n in nodes], "src long, radius long"))
    assert {(r.src, r.node): r.d for r in reach.collect()} == {k: x for k, x in d.items() if x <= 14}
    asked = spark.createDataFrame([(a, b, 20) for a in nodes for b in nodes if a < b], "u long, v long, cap long")
    got = {(r.u, r.v): r.d for r in pair_distances(graph, asked).collect()}
    assert got == {(a, b): x for (a, b), x in d.items() if a < b and x <= 20}
    bd = {r.node: r.d for r in boundary_distances(graph).collect()}
    assert bd == {n: (x if x < FAR else None) for n, x in rim.items()}
    weight = {(u, v): w for u, v, w in rows if v is not None}
    steps = {}
    for r in shortest_paths(graph, asked).collect():
        steps.setdefault((r.u, r.v), []).append((r.pos, r.a, r.b))
    assert set(steps) == set(got)
    for (u, v), legs in steps.items():
        legs.sort()
        assert [p for p, _, _ in legs] == list(range(len(legs)))
        assert legs[0][1] == u and legs[-1][2] == v
        assert all(x[2] == y[1] for x, y in zip(legs, legs[1:]))
        assert sum(weight[min(a, b), max(a, b)] for _, a, b in legs) == got[u, v]
    spans = {r.comp: r.span for r in component_spans(graph).collect()}
    comp = {r.id: r.comp for r in graph_components(graph).collect()}
    for (a, b), x in d.items():
        assert (comp[a] == comp[b]) == (x < FAR)
        assert x >= FAR or x <= spans[comp[a]]


@pytest.mark.parametrize("core", [0, 5, 100])
def test_hub_labels_give_all_distances(spark, core):
    from pairloom.operators.labels import hub_labels, labelled_distances

    rows = random_edges(9, n=24, m=32) + [(50, 51, 4)]  # a graph component of its own
    nodes = sorted({x for u, v, _ in rows for x in (u, v) if x is not None})
    d, _ = distances(rows, nodes)
    labels = hub_labels(Graph(as_table(spark, rows), broadcast_edges=0), core=core)
    asked = spark.createDataFrame([(a, b, 30) for a in nodes for b in nodes if a < b], "u long, v long, cap long")
    got = {(r.u, r.v): r.d for r in labelled_distances(labels, asked).collect()}
    assert got == {(a, b): x for (a, b), x in d.items() if a < b and x <= 30}


def test_components_small_and_contracted_agree(spark):
    rng = random.Random(5)
    rows = [(s, rng.randrange(40), rng.randrange(40)) for s in range(3) for _ in range(25)] + [(9, k, k + 1) for k in range(60)]
    links = spark.createDataFrame(rows, "shot long, a long, b long")
    small = {(r.shot, r.node): r.root for r in components(links, ["shot"]).collect()}
    mixed = {(r.shot, r.node): r.root for r in components(links, ["shot"], small=30).collect()}
    assert small == mixed and small[9, 60] == 0


def test_merge_strategies(spark):
    rows = [(1, 2, 3.0, 0.1, [0], 1), (2, 1, 1.0, 0.2, [1], 2), (1, 2, 2.0, 0.3, [2], 3), (1, None, 5.0, 0.01, [], 4)]
    table = spark.createDataFrame(rows, USER)

    def pick(strategy):
        return {(r.u, r.v): r for r in E.merge_parallel(table, strategy).collect()}

    assert pick("keep_original")[1, 2].w == 3.0 and pick("replace")[1, 2].obs == [2]
    assert pick("smallest_weight")[1, 2].obs == [1]
    merged = pick("independent")[1, 2]
    assert merged.obs == [0]
    assert merged.p == pytest.approx((1 - 0.8 * 0.6 * 0.4) / 2)
    import math

    t = math.tanh(1.5) * math.tanh(0.5) * math.tanh(1.0)
    assert merged.w == pytest.approx(2 * math.atanh(t), rel=1e-12)
    assert pick("independent")[1, None].w == pytest.approx(5.0)
    with pytest.raises(Exception, match="parallel edges"):
        pick("disallow")


def test_discretise_rules(spark):
    rows = [
        (0, 1, -1.5, 0.8, [0], 1),  # negative
        (1, 1, -2.0, 0.8, [1], 2),  # negative self loop: bookkeeping only
        (2, 2, 2.0, 0.1, [], 3),
        (1, 8, 3.0, 0.1, [], 4),  # 8 and 9 are boundary nodes
        (1, 9, 2.5, 0.1, [], 5),
        (8, 9, 1.0, 0.1, [], 6),
    ]
    table = spark.createDataFrame(rows, USER)
    rim = spark.createDataFrame([(8,), (9,)], "id long")
    out = E.discretise(table, rim)
    scale = (2**24 - 1) / 3.0
    half = lambda w: int(w * scale + 0.5) * 2
    got = {(r.u, r.v): (r.w, r.sign) for r in E.search_ready(out).collect()}
    assert got == {(0, 1): (half(1.5), -1), (1, None): (half(2.5), 1)}
    total = E.negative_totals(out).first()
    assert (total.negative_weight, total.negative_mask, total.negative_edges) == (-half(1.5) - half(2.0), 3, 2)
    assert sorted(r.id for r in E.negative_toggles(out).collect()) == [0, 1]
    whole = spark.createDataFrame([(0, 1, 4.0, 0.1, [], 1)], USER)
    assert E.discretise(whole).first().w == 8


def test_lookup_and_reweight(spark):
    table = as_table(spark, [(0, 1, 10), (1, 2, 20), (0, None, 6)])
    wanted = spark.createDataFrame([(1, 0), (0, None), (0, 2)], "u long, v long")
    assert {(r.u, r.v): r.w for r in E.lookup(table, wanted).collect()} == {(0, 1): 10, (0, None): 6}
    implied = spark.createDataFrame([(0, None, 1, 2, 8), (0, None, 0, 1, 30)], "u long, v long, other_u long, other_v long, w long")
    fired = spark.createDataFrame([(5, 0, None)], "shot long, u long, v long")
    assert [tuple(r) for r in E.reweight(table, fired, implied).collect()] == [(5, 1, 2, 8)]
    assert E.heaviest_plus_one(table).select(F.col("first_diameter")).first()[0] == 21


def test_pieces_of_an_error_meet_in_one_row(spark):
    """Boundary edges, one edge twice in an error, a number used twice and errors without a name."""
    rows = [
        (1, 0, 0, 1, 0.1), (1, 1, 2, None, 0.1), (1, 2, 1, 0, 0.1),
        (2, 0, 2, None, 0.2), (2, 1, 0, 1, 0.2), (2, 1, 4, 5, 0.2), (2, 2, 2, 3, 0.2),
        (None, 0, 0, 1, 0.3), (None, 1, 2, 3, 0.3),
    ]
    want = {}
    for x, (error, piece, *edge, p) in enumerate(rows):
        for y, (other_error, other_piece, *other, _) in enumerate(rows):
            if x == y or (error is not None and error == other_error and piece != other_piece):
                key = tuple(tuple(e if e[1] is None else sorted(e)) for e in (edge, other))
                want[key] = want.get(key, 1.0) * (1 - 2 * p)
    joint = E.joint_probabilities(spark.createDataFrame(rows, "error long, piece int, u long, v long, p double"))
    got = {((r.u, r.v), (r.other_u, r.other_v)): r.joint for r in joint.collect()}
    assert got.keys() == want.keys() and joint.count() == len(got)
    assert all(got[k] == pytest.approx((1 - want[k]) / 2, rel=1e-12) for k in want)
    plan = joint._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and "Join" not in plan


def test_many_hooks_are_not_sent_to_the_driver(monkeypatch, spark):
    from pairloom.operators import components

    plans, cut = [], components.cut

    def seen(rows):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return cut(rows)

    monkeypatch.setattr(components, "cut", seen)
    monkeypatch.setattr(components, "BROADCAST_HOOKS", 10)
    links = spark.range(400).where("id % 50 <> 49").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {r.node: r.root for r in components.contract(links, []).collect()}
    assert got == {n: n - n % 50 for n in range(400)}
    assert not any("BroadcastHashJoin" in x for x in plans[:5]) and any("SortMergeJoin" in x for x in plans)
