import random

import pytest
from brute import FAR, distances, least_weight
from pyspark.sql import functions as F
from test_graph import USER, as_table, random_edges

from pairloom.operators import clusters as C
from pairloom.operators.correlated import correlated_groups
from pairloom.operators.matching import matches, pair_groups, per_shot
from pairloom.operators.paths import Graph
from pairloom.plans.decode import Decoder, decode_case, Options, logical_errors
from pairloom.sources.casefile import case_lines, read_cases, write_case

HITS = "shot long, det long"

SAMPLE = """3 1 4 3 3 3 0.001
e 0 -1 2 0.11920292202211755 1 0
e 0 1 2 0.11920292202211755 0
e 1 2 2 0.11920292202211755 0
e 2 -1 2 0.11920292202211755 0
s 1 1 0
s 0 2 0 1
s 0 0
"""


def many_shots(nodes, count, seed, most=8):
    rng = random.Random(seed)
    return {s: rng.sample(nodes, rng.randint(1, min(most, len(nodes)))) for s in range(count)}


def as_hits(spark, shots):
    return spark.createDataFrame([(s, d) for s, ds in shots.items() for d in ds], HITS)


@pytest.mark.parametrize("options", [dict(limit=64), dict(limit=0, first_horizon=2), dict(limit=4)], ids=["split", "grown", "mixed"])
def test_weights_match_brute_force(spark, options):
    rows = random_edges(11, n=16, m=26)
    nodes = sorted({x for u, v, _ in rows for x in (u, v) if x is not None})
    d, rim = distances(rows, nodes)
    shots = many_shots(nodes, 40, 2)
    groups = pair_groups(as_hits(spark, shots), Graph(as_table(spark, rows)), **options).cache()
    got = {r.shot: r for r in per_shot(groups).collect()}
    for shot, hits in shots.items():
        want = least_weight(hits, d, rim)
        assert (got[shot].status == "ok") == (want is not None)
        if want is not None:
            assert got[shot].weight == want and got[shot].n_hits == len(hits)
    used = {}
    for r in matches(groups).collect():
        used.setdefault(r.shot, []).extend(x for x in (r.u, r.v) if x is not None)
    assert all(sorted(used[s]) == sorted(h) for s, h in shots.items() if got[s].status == "ok")


def test_one_enormous_shot_is_grown_exactly(spark):
    # A 30 x 30 lattice with a boundary on two sides and most hits in one shot.
    side = 30
    rows = [(r * side + c, r * side + c + 1, 2) for r in range(side) for c in range(side - 1)]
    rows += [(r * side + c, (r + 1) * side + c, 2) for r in range(side - 1) for c in range(side)]
    rows += [(r * side, None, 2) for r in range(side)] + [(r * side + side - 1, None, 2) for r in range(side)]
    rng = random.Random(4)
    shots = {0: rng.sample(range(side * side), 150), 1: [5, 6], 2: [400]}
    graph = Graph(as_table(spark, rows))
    hits = as_hits(spark, shots)
    grown = pair_groups(hits, graph, limit=64).cache()
    whole = per_shot(pair_groups(hits, graph, limit=1000)).collect()
    assert {r.shot: r.weight for r in per_shot(grown).collect()} == {r.shot: r.weight for r in whole}
    # The enormous shot was not paired up as one group.
    assert grown.where("shot = 0").agg(F.max("n_hits")).first()[0] < 150


def test_sample_case_file(spark, tmp_path):
    path = tmp_path / "case_r3_d3.txt"
    path.write_text(SAMPLE)
    case = read_cases(spark, str(path))
    assert case.header.first().noise == 0.001
    shots = case.shots.select((F.col("shot") + 1).alias("shot"), "obs_mask", "hits")
    hits = shots.select("shot", F.explode("hits").alias("det"))
    decoder = Decoder(case.edges)
    out = {r.shot: r for r in decoder.decode(shots, hits).collect()}
    assert (out[1].weight, out[1].obs_mask) == (4, 1)
    assert (out[2].weight, out[2].obs_mask) == (4, 0)
    assert (out[3].weight, out[3].n_hits, out[3].status) == (0, 0, "ok")
    assert tuple(logical_errors(decoder.decode(shots, hits), shots).first()) == (3, 0, 0)
    assert {(r.shot, r.weight, r.obs_mask, r.true_mask) for r in decode_case(case).collect()} == {(0, 4, 1, 1), (1, 4, 0, 0), (2, 0, 0, 0)}
    lines = case_lines(case.edges.withColumn("ord", F.monotonically_increasing_id()), shots, 3, 3, 0.001)
    write_case(lines, str(tmp_path / "again"))
    again = read_cases(spark, str(tmp_path / "again"))
    assert sorted(map(str, again.edges.drop("case", "file", "ord").collect())) == sorted(map(str, case.edges.drop("case", "file", "ord").collect()))
    assert again.shots.count() == 3
    bad = tmp_path / "bad.txt"
    bad.write_text("x 1 2\n")
    with pytest.raises(Exception, match="unknown line tag"):
        read_cases(spark, str(bad)).edges.collect()


def test_no_pairing_and_isolated_component(spark):
    graph = Graph(as_table(spark, [(0, 1, 2), (2, 3, 2), (2, None, 4)]))
    got = {r.shot: r for r in per_shot(pair_groups(as_hits(spark, {0: [0], 1: [0, 1], 2: [3], 3: [0, 1, 3]}), graph)).collect()}
    assert got[0].status == "no perfect matching" and got[1].weight == 2 and got[2].weight == 6 and got[3].weight == 8


def test_hits_are_checked(spark):
    edges = spark.createDataFrame([(0, 1, 1.0, 0.2, [], 1), (1, 7, 1.0, 0.2, [0], 2)], USER)
    rim = spark.createDataFrame([(7,)], "id long")
    decoder = Decoder(edges, rim)
    shots = spark.createDataFrame([(0,)], "shot long")
    out = decoder.decode(shots, spark.createDataFrame([(0, 0), (0, 0), (0, 7)], HITS)).first()
    assert (out.weight, out.obs_mask) == (4, 1)
    with pytest.raises(Exception, match="outside the graph"):
        decoder.decode(shots, spark.createDataFrame([(0, 55)], HITS)).collect()
    with pytest.raises(ValueError):
        Options(mode="other")


def test_negative_weights_match_enumeration(spark):
    # Least total weight over all edge sets with the given odd nodes, the boundary free.
    rng = random.Random(8)
    edges = [(0, 1), (1, 2), (2, 3), (0, 3), (1, 3), (0, None), (3, None)]
    weights = [float(rng.choice([-3, -2, -1, 1, 2, 3, 4])) for _ in edges]
    table = spark.createDataFrame([(u, v, w, 0.1, [k % 2], k) for k, ((u, v), w) in enumerate(zip(edges, weights))], USER)
    shots = {s: [d for d in range(4) if s >> d & 1] for s in range(16)}
    every = spark.createDataFrame([(s,) for s in shots], "shot long")
    out = {r.shot: r.weight for r in Decoder(table).decode(every, as_hits(spark, shots)).collect()}
    for s, hits in shots.items():
        best = min(
            sum(w for k, w in enumerate(weights) if chosen >> k & 1)
            for chosen in range(1 << len(edges))
            if all(
                sum(chosen >> k & 1 for k, e in enumerate(edges) if n in e) % 2 == (n in hits) for n in range(4)
            )
        )
        assert out[s] == 2 * best


@pytest.mark.parametrize("mode", ["global", "hierarchical"])
def test_toggled_nodes_far_from_a_shot_stay_in_the_totals(spark, mode, monkeypatch):
    # A ladder with a boundary at both rails, a negative rung every tenth step, one rung that
    # ends at the boundary, and a far part without a boundary.
    rng = random.Random(17)
    weight = lambda: float(rng.randint(2, 9))
    edges = [(2 * k + s, 2 * k + 2 + s, weight(), [k % 3]) for k in range(99) for s in (0, 1)]
    edges += [(2 * k, 2 * k + 1, -3.0 if k % 10 == 4 else weight(), [k % 2]) for k in range(100)]
    edges += [(2 * k + s, None, weight(), [2] if s else []) for k in range(100) for s in (0, 1)]
    edges += [(180, None, -4.0, [1]), (500, 501, 2.0, [0]), (501, 502, 3.0, [])]
    table = spark.createDataFrame([(u, v, w, 0.1, obs, k) for k, (u, v, w, obs) in enumerate(edges)], USER)
    shots = many_shots([*range(200), 500, 501, 502], 60, 9, 5) | {60: [8, 9], 61: [2 * k + s for k in range(100) for s in (0, 1)]}
    every = spark.createDataFrame([(s,) for s in [*shots, 99]], "shot long")
    decoder = Decoder(table, options=Options(mode=mode))
    whole = {r.shot: r for r in per_shot(decoder.groups(every, as_hits(spark, shots))).collect()}
    sizes = []
    from pairloom.operators import standing

    pair = standing.pair_groups
    monkeypatch.setattr(standing, "pair_groups", lambda hits, *more: (sizes.append(hits.where("shot NOT IN (61)").count()), pair(hits, *more))[1])
    got = {r.shot: r for r in decoder.decode(every, as_hits(spark, shots)).collect()}
    assert sorted(got) == sorted([*shots, 99]) and len({r.status for r in got.values()}) == 2
    for s, r in got.items():
        assert (r.n_hits, r.status) == (whole[s].n_hits, whole[s].status)
        assert r.weight == (whole[s].weight + decoder.negative_weight if r.status == "ok" else None)
    # Shots hold a few groups of toggled nodes each, not all of them.
    assert sizes[-1] < 0.5 * sum(r.n_hits for s, r in whole.items() if s != 61)


@pytest.mark.parametrize("limit", [64, 2], ids=["overlay", "own graph"])
def test_correlated_pass_matches_brute_force(spark, limit):
    rows = random_edges(21, n=10, m=16)
    nodes = sorted({x for u, v, _ in rows for x in (u, v) if x is not None})
    shots = {s: h for s, h in many_shots(nodes, 6 if limit > 2 else 2, 3, 5).items()}
    graph = Graph(as_table(spark, rows))
    hits = as_hits(spark, shots)
    # Every fired edge lowers the next edge of the list to 2.
    rules = [(*rows[k][:2], *rows[(k + 1) % len(rows)][:2], 2) for k in range(len(rows))]
    implied = spark.createDataFrame(rules, "u long, v long, other_u long, other_v long, w long")
    from pairloom.operators.correlated import fired_edges

    first = pair_groups(hits, graph).cache()
    fired = {}
    for r in fired_edges(matches(first), graph).collect():
        fired.setdefault(r.shot, set()).add((r.u, r.v))
    got = {r.shot: r for r in per_shot(correlated_groups(hits, graph, implied, limit)).collect()}
    for shot, hit in shots.items():
        low = {(ou, ov) for u, v, ou, ov, _ in rules if (u, v) in fired.get(shot, set())}
        d, rim = distances([(u, v, 2 if (u, v) in low else w) for u, v, w in rows], nodes)
        want = least_weight(hit, d, rim)
        assert got[shot].weight == want or (want is None and got[shot].status != "ok")


def test_clusters_partition_hits(spark):
    rows = random_edges(31, n=18, m=24)
    nodes = sorted({x for u, v, _ in rows for x in (u, v) if x is not None})
    d, rim = distances(rows, nodes)
    shots = many_shots(nodes, 12, 6)
    graph = Graph(as_table(spark, rows))
    levels = [C.Level(4, 6), C.Level(12, 30)]
    everyone = spark.createDataFrame([(s,) for s in [*shots, 99]], "shot long")
    found = C.cluster_levels(as_hits(spark, shots), graph, levels, shots=everyone).collect()
    assert [(r.level, r.size) for r in found if r.shot == 99] == [(0, 0)]
    seen = {}
    groups = {}
    for r in found:
        if r.shot != 99:
            seen.setdefault(r.shot, []).append(r.det)
            groups.setdefault((r.shot, r.level, r.root, r.forced), []).append(r.det)
    assert {s: sorted(h) for s, h in seen.items()} == {s: sorted(h) for s, h in shots.items()}
    for (_, level, root, forced), members in groups.items():
        assert root == min(members)
        if not forced:
            bound = levels[level - 1].d
            assert max(d[a, b] for a in members for b in members) <= bound
            assert len(members) % 2 == 0 or max(rim[a] for a in members) <= bound
    joined = C.cluster_levels(as_hits(spark, shots), Graph(as_table(spark, rows), broadcast_edges=0), levels, shots=everyone).collect()
    assert sorted(map(str, joined)) == sorted(map(str, found))


def test_arriving_shots(spark, tmp_path):
    from pairloom.streaming.shots import decode_arriving

    graph = Graph(as_table(spark, [(0, 1, 2), (1, 2, 2), (0, None, 2), (2, None, 2)]))
    source = tmp_path / "in"
    as_hits(spark, {1: [0, 1], 2: [2]}).write.parquet(str(source))
    stream = spark.readStream.schema(HITS).parquet(str(source))
    decode_arriving(stream, graph, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(90)
    rows = {r.shot: r.weight for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows == {1: 2, 2: 2}


def test_table_form_gives_the_same_weights_and_masks(spark):
    from pairloom.operators import edges
    from pairloom.session import cut
    from pairloom.sources import lattice

    folder = "/root/testdata/sf0.001"
    discrete = cut(edges.search_ready(edges.discretise(lattice.edges(spark, folder))))
    hits = cut(lattice.hits(spark, folder).where("shot < 400"))
    both = [per_shot(pair_groups(hits, Graph(discrete, broadcast_edges=limit))).select("shot", "weight", "obs_mask").collect() for limit in (10**6, 0)]
    assert len(both[0]) > 50 and sorted(both[0]) == sorted(both[1])
